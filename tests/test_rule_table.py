"""Rules as a table find what the same rules find as literals."""

import pytest

from opslens import rules
from opslens.operators import corpus, ruletable

LINES = [
    "int *p = new Foo();", "free ( p );", "std::recursive_mutex m;", "NULL", "null", "#[=]", "[ & ]", "catch (...) {", "virtual void f();",
    "for (int i = 0; i < v.size (); ++i)", "  using namespace std;", "", None, "ＮＵＬＬ é", "a.b", "axb", "COLOUR color", "x" * 10_000 + "goto end",
]


@pytest.fixture
def lines(spark):
    rows = [(f"f{i % 3}", i, t, t, i % 2 == 0) for i, t in enumerate(LINES)]
    return spark.createDataFrame(rows, "path string, line_no bigint, raw string, stripped string, is_header boolean").repartition(3)


def hits(df):
    return sorted((r.path, r.line_no, r.rule, r.snippet) for r in df.collect())


def table(spark, rows):
    return spark.createDataFrame(rows, "rule string, pattern string, header_only boolean")


def test_same_hits_as_literals(spark, lines, monkeypatch):
    own = [(*r, False) for r in rules.RED_FLAGS] + [(*r, True) for r in rules.HEADER_ONLY_FLAGS]
    want = hits(corpus.red_flag_scan(lines))
    assert want and hits(corpus.red_flag_scan(lines, table(spark, own))) == want
    monkeypatch.setattr(ruletable, "BLOCK_RULES", 7)
    assert hits(corpus.red_flag_scan(lines, table(spark, own))) == want


def test_ten_thousand_rules(spark, lines):
    many = [(f"r{i}", rf"\bword{i}\b|goto\s+w{i}", False) for i in range(10_000)]
    odd = [
        ("nothing known", r"\w+\.\w", False), ("any case", "(?i)colour|NULL", False), ("own dialect", r"\p{Lu}OLOUR", False),
        ("quoted", r"\Qa.b\E", False), ("nested class", "[a[b]]xb", False), ("optional", "(?:goto )?end", False),
        ("twice", "goto", False), ("twice", "goto", False), (None, "goto", False), ("no pattern", None, False),
    ]
    got = [(n, rule) for _, n, rule, _ in hits(corpus.red_flag_scan(lines, table(spark, many + odd)))]
    want = [(14, "nothing known"), (14, "quoted"), (15, "nested class"), (3, "any case"), (4, "any case"), (16, "any case"), (16, "own dialect")]
    want += [(9, "nothing known")] + [(17, r) for r in ("optional", "twice", "twice")]
    assert sorted(got) == sorted(want)


def test_no_rules_or_lines(spark, lines):
    assert hits(corpus.red_flag_scan(lines, table(spark, []))) == []
    assert hits(corpus.red_flag_scan(lines.limit(0), table(spark, [("a", "a", False)]))) == []


@pytest.mark.parametrize(
    "pattern, literals",
    [
        (r"\bnew\s+[A-Z]", ["new"]), ("(?:ab|CDE)f", ["ab", "cde"]), ("a?b+", ["b"]), ("(abc){2}x", ["abc"]), ("a*", None), ("x|", None),
        ("(?i)ÉaB", ["Éab"]), ("[a[b]]c", None), (r"[\[a]cd", ["cd"]), ("(?=zz)ab", ["ab"]), (r"\h+x", None), ("(?x) a b", None),
    ],
)
def test_required_literals(pattern, literals):
    assert ruletable.required_literals(pattern) == literals


@pytest.mark.parametrize("block", [1, 60, 400])
def test_rules_beyond_the_automaton_are_joined_in_one_pass(spark, lines, monkeypatch, block):
    """Far more rules than one automaton takes: lines are not read once more for each block of them."""
    many = [(f"r{i}", rf"\bword{i}\b", False) for i in range(900)]
    odd = [
        ("twice", "recursive_mutex", False), ("twice", "recursive_mutex", False), ("any case", "(?i)RECURSIVE_MUTEX m", False),
        ("several", r"recursive|::recursive_mutex|\bmutex m;|nowhere at all", False), ("header", "catch \\(\\.\\.\\.\\) \\{", True),
        ("header too", "using namespace std", True), ("long", "x{0,5}" + "x" * 40 + "goto", False), ("wide", "ＮＵＬＬ é", False),
        ("held but no match", r"using namespace stdx?\b\w", False), ("whole line", r"^virtual void f\(\);$", False),
    ]
    own = [(*r, False) for r in rules.RED_FLAGS] + [(*r, True) for r in rules.HEADER_ONLY_FLAGS]
    want = hits(corpus.red_flag_scan(lines, table(spark, odd + own)))
    assert {r for _, _, r, _ in want} > {"twice", "any case", "several", "header too", "long", "wide", "whole line"}
    monkeypatch.setattr(ruletable, "BLOCK_RULES", block)
    got = corpus.red_flag_scan(lines, table(spark, many + odd + own))
    plan = got._jdf.queryExecution().analyzed().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") <= 3 and hits(got) == want
    # a full bitmap sends more lines, small cuts tear lines, and both find the same
    monkeypatch.setattr(ruletable, "SEED_BITS", 7)
    monkeypatch.setattr(ruletable, "CUT_BYTES", 5)
    assert hits(corpus.red_flag_scan(lines, table(spark, many + odd + own))) == want
