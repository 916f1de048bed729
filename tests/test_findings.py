"""Review findings."""

import json

import pytest
from pyspark.sql import functions as F

from opslens.operators import findings as ops
from opslens.sources import readers

DDL = "review_id bigint, id string, severity string, category string, file string, line bigint, title string, detail string, fix string"


def finding(n, severity="Minor", category="api", file="src/a/x.cpp", line=1, title="t", detail="d", fix="f", review=1):
    return (review, f"F{n}", severity, category, file, line, title, detail, fix)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), DDL)


@pytest.mark.parametrize(
    "text,want", [(" blocker\n", "Blocker"), ("MAJOR", "Major"), ("nit", "Nit"), ("odd", "Minor"), ("", "Minor"), ("major issue", "Minor")]
)
def test_severity(ask, text, want):
    assert ask(ops.normalize_severity, text) == want


def test_required_fields(spark):
    df = frame(spark, finding(1), finding(2, title=" \t"), finding(3, file=None, fix=""))
    got = sorted((r.id, r.rule) for r in ops.validate_findings(df).collect())
    assert got == [("F2", "missing title"), ("F3", "missing file"), ("F3", "missing fix")]


@pytest.mark.parametrize("verdict,comment,want", [("accept", "", "accept"), ("", "why", "discuss"), ("", " \n", None), (None, None, None)])
def test_status(ask, verdict, comment, want):
    assert ask(ops.effective_status, verdict, comment) == want


def test_join_filter_progress_groups(spark):
    feedback = spark.createDataFrame(
        [("F1", "accept", ""), ("F2", "custom", " "), ("F3", "", "hm"), ("F9", "reject", "gone")], "id string, verdict string, comment string"
    ).withColumns({"severity": F.lit("nit"), "file": F.lit("old.cpp"), "line": F.lit(5).cast("bigint"), "title": F.lit("old"), "fix": F.lit("x")})
    judged = ops.findings_with_verdicts(frame(spark, *[finding(i, severity="Major") for i in range(1, 5)]), feedback)
    rows = {r.id: r for r in judged.collect()}
    assert (rows["F9"].present, rows["F9"].file, rows["F9"].severity) == (False, "old.cpp", "Nit")
    assert (rows["F1"].present, rows["F1"].file, rows["F1"].status) == (True, "src/a/x.cpp", "accept")
    assert [r.id for r in ops.filter_findings(judged, "Major", "none").collect()] == ["F4"]
    assert [r.id for r in ops.filter_findings(judged, status="reject").collect()] == ["F9"]
    assert ops.filter_findings(judged).count() == 5
    progress = ops.decision_progress(judged.where("present")).first()
    assert (progress.total, progress.decided, progress.undecided, progress.alert) == (4, 3, 1, True)
    assert {r.id: r.verdict_group for r in ops.verdict_groups(judged).collect()} == {"F1": "accept", "F2": "discuss", "F3": "discuss", "F9": "reject"}


def test_dedupe_rank_cap(spark):
    rows = [
        finding(1, "Minor", review=2), finding(2, "Major", review=3), finding(3, "Major", review=1), finding(4, "Nit", line=None),
        finding(5, "Blocker", line=None, category="testing"), finding(6, "Minor", line=None),
    ]
    kept = ops.dedupe_findings(frame(spark, *rows))
    assert sorted(r.id for r in kept.collect()) == ["F3", "F5", "F6"]
    assert [r.id for r in ops.rank_findings(frame(spark, *rows)).collect()] == ["F5", "F2", "F3", "F6", "F1", "F4"]
    many = frame(spark, *[finding(i, "Nit", line=i) for i in range(100, 130)], finding(1, "Major"))
    capped = [r.id for r in ops.cap_nits(many, 10).collect()]
    assert sorted(capped) == ["F1"] + [f"F{i}" for i in range(100, 110)]


def test_patterns_and_recall(spark):
    rows = [finding(i, file=f"src/m{i % 2}/f{i}.cpp", line=i) for i in range(5)] + [finding(9, title="once")]
    row = ops.systemic_patterns(frame(spark, *rows)).first()
    assert (row.n, row.modules, row.worst_module, row.examples) == (5, 2, "src/m0", "src/m0/f0.cpp:0,src/m0/f2.cpp:2,src/m0/f4.cpp:4")
    reported = frame(spark, finding(1, line=3), finding(2, line=45), finding(3, line=4))
    expected = frame(spark, finding(7, line=9), finding(8, line=100))
    score = ops.finding_precision_recall(reported, expected).first()
    assert (score.true_positive, score.false_positive, score.missed, score.precision, score.recall) == (1, 1, 1, 0.5, 0.5)
    empty = ops.finding_precision_recall(reported.where("false"), expected.where("false")).first()
    assert (empty.true_positive, empty.precision) == (0, None)


def test_documents(spark, tmp_path):
    good = {
        "review": {"repo": "r", "scope": "all", "coverage": "everything"},
        "summary": "fine",
        "systemic": [{"title": "s", "count": 2, "examples": ["a:1"]}],
        "findings": [{"severity": "major", "file": "a", "line": 3, "title": "t"}, {"id": "X1", "file": "b"}],
    }
    (tmp_path / "a.json").write_bytes(b"\xef\xbb\xbf" + json.dumps(good).encode())
    (tmp_path / "b.json").write_text(json.dumps({"review": {"scope": " ", "coverage": "short"}, "findings": []}))
    documents = readers.read_review_documents(spark, str(tmp_path))
    rows = readers.read_findings(documents).orderBy("pos").collect()
    assert [(r.id, r.severity, r.file, r.line) for r in rows] == [("F1", "major", "a", 3), ("X1", None, "b", None)]
    assert [(r.id, r.title, r["count"]) for r in readers.read_systemic(documents).collect()] == [("S1", "s", 2)]
    bad = sorted(r.rule for r in ops.validate_documents(documents).collect())
    assert bad == ["coverage is missing", "no findings", "scope is empty", "summary is missing"]


def test_feedback(spark, tmp_path):
    verdicts = {"F1": {"verdict": "accept", "comment": "", "severity": "Nit", "file": "a", "line": None, "title": "t", "fix": "x"}}
    (tmp_path / "f.json").write_text(json.dumps({"total_findings": 2, "decided": 1, "verdicts": verdicts}, indent=1))
    row = readers.read_feedback(spark, str(tmp_path / "f.json")).first()
    assert (row.id, row.verdict, row.severity, row.line, row.fix) == ("F1", "accept", "Nit", None, "x")


def test_feedback_lines_of_any_kind(spark, tmp_path):
    def line(key: bytes, rest: bytes = b"") -> bytes:
        return b'{"verdicts":{"' + key + b'":{"verdict":"v"' + rest + b"}}}\n"

    files = {
        "plain": line(b"a", b',"line":3,"comment":null') + line("é".encode()) + line(b"\\u00e9x"), "bom": b"\xef\xbb\xbf" + line(b"b"),
        "inner bom": line(b"c") + b"\xef\xbb\xbf" + line(b"d"), "wide": line(b"e").decode().encode("utf-16"),
        "surrogate": line(b"\\ud83d") + line(b"f"), "number": line(b"g", b',"fix":1.50'), "nested": line(b"h", b",'title' : [1,  2]"),
        "escaped name": line(b"i", b',"f\\u0069x":2.50'), "bad bytes": line(b"\xff") + line(b"j"), "torn": b'{"verdicts":{"k":\n' + line(b"l"),
    }
    for name, data in files.items():
        (tmp_path / f"{name}.json").write_bytes(data)
    plain = spark.read.schema(readers.FEEDBACK_SCHEMA).json(str(tmp_path))
    want = plain.selectExpr("explode(verdicts) AS (id, v)").selectExpr("id", "v.*").collect()
    got = readers.read_feedback(spark, str(tmp_path), per_line=True).collect()
    assert len(want) == 13 and sorted(map(str, got)) == sorted(map(str, want))


def test_feedback_keys_are_read_by_the_parser_that_copies_less(spark, tmp_path):
    """A plan without odd lines reads characters only; one with them reads both ways, each file once."""
    (tmp_path / "a.json").write_text('{"verdicts":{"a":{"verdict":"v"}}}\n' * 3)
    modes = []
    reader = type(spark.read)
    put = reader.json
    try:
        reader.json = lambda self, *a, **k: modes.append(1) or put(self, *a, **k)
        assert readers.read_feedback(spark, str(tmp_path), per_line=True).count() == 3 and len(modes) == 1
        (tmp_path / "b.json").write_text('{"verdicts":{"b":{"verdict":1.50}}}\n')
        rows = readers.read_feedback(spark, str(tmp_path), per_line=True).collect()
        assert sorted(r.verdict for r in rows) == ["1.50", "v", "v", "v"] and len(modes) == 3
    finally:
        reader.json = put
