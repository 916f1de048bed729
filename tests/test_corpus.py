"""Source scan operators against plain Python."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from opslens import rules
from opslens.functions import code as C
from opslens.operators import corpus as ops
from opslens.sources import readers


def corpus(spark, **files):
    rows = [(name.replace("__", "/").replace("_dot_", "."), text) for name, text in files.items()]
    return spark.createDataFrame(rows, "path string, text string")


def plain_strip(text):
    """Regions found one at a time, each replaced by blanks."""
    out, at = [], 0
    while at < len(text):
        if text.startswith("//", at):
            end = text.find("\n", at)
            end = len(text) if end < 0 else end
            keep = ("", "")
        elif text.startswith("/*", at):
            end = text.find("*/", at + 2)
            end = len(text) if end < 0 else end + 2
            keep = ("", "")
        elif text[at] in "\"'":
            end = at + 1
            while end < len(text) and text[end] != text[at]:
                end += 2 if text[end] == "\\" else 1
            closed = end < len(text)
            end = min(end + 1, len(text))
            keep = (text[at], text[at] if closed else "")
        else:
            out.append(text[at])
            at += 1
            continue
        inside = text[at + len(keep[0]) : end - len(keep[1])]
        out.append(keep[0] + re.sub(r"[^\n]", " ", inside) + keep[1])
        at = end
    return "".join(out)


@pytest.mark.parametrize(
    "text",
    [
        'a = "x // y"; // z "q"\nb',
        "/* a\n b */ c /* open",
        "char q = '\"'; s = \"it's\";",
        'p = "a\\"b\\\\"; q = 1; // "',
        "a / b; c //* d\n e */",
        '"never closed\nnext',
        "é = \"ü\"; // ñ",
        "",
        '""\'\'""',
    ],
)
def test_strip_comments(ask, text):
    got = ask(C.strip_comments, text)
    assert got == plain_strip(text)
    assert len(got) == len(text)


def test_strip_survives_very_long_literals(ask):
    body = "\\x00\\\"" * 100_000
    got = ask(C.strip_comments, f'a = "{body}"; // end')
    assert got == 'a = "' + " " * len(body) + '";       '


def test_strip_random_texts(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(['"', "'", "/", "*", "\n", "a", "{", " "]) for _ in range(40)) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.x for r in df.select(C.strip_comments(F.col("t")).alias("x")).collect()] == [plain_strip(t) for t in texts]


@pytest.mark.parametrize("text,want", [("", []), ("a", ["a"]), ("a\n", ["a"]), ("a\r\n\r\nb\r", ["a", "", "b"]), ("\n\n", ["", ""])])
def test_split_lines(ask, text, want):
    assert ask(C.split_lines, text) == want


@pytest.mark.parametrize(
    "line,name",
    [
        ("int run(int a) {", "run"),
        ("void A::b::load_all(x) const {  ", "load_all"),
        ("A::~A() {", "~A"),
        ("if (x) {", None),
        ("} else if (x) {", None),
        ("auto f = [](int) {", None),
        ("return foo(x) {", None),
        ("struct Pod {", None),
        ("int run(int a);", None),
        ("foo::if(x) {", None),
    ],
)
def test_function_name(ask, line, name):
    assert ask(C.function_name, line) == name


def plain_spans(lines):
    out, at = [], 0
    is_start = re.compile(r"^(?:int|void) (f\w*)\(.*\{\s*$")
    while at < len(lines):
        found = is_start.match(lines[at])
        if found:
            depth, end = 0, at
            for end in range(at, len(lines)):
                depth += lines[end].count("{") - lines[end].count("}")
                if depth <= 0:
                    break
            if end - at >= 2:
                out.append((at + 1, found[1], end - at + 1))
            at = end
        at += 1
    return out


def test_function_spans_on_random_files(spark):
    rng = random.Random(5)
    choices = ["int f1(int a) {", "void f2() {", "}", "}}", "{", "x;", "if (a) {", "} int f3() {", "}", "  }"]
    files = {f"m{i}.cpp": [rng.choice(choices) for _ in range(rng.randint(1, 60))] for i in range(40)}
    df = spark.createDataFrame([(p, "\n".join(l) + "\n") for p, l in files.items()], "path string, text string")
    got = {}
    for r in ops.function_spans(ops.explode_code_lines(df)).collect():
        got.setdefault(r.path, []).append((r.start, r.name, r.length))
    assert {p: sorted(s) for p, s in got.items()} == {p: plain_spans(l) for p, l in files.items() if plain_spans(l)}


def test_spans_share_one_shuffle(spark):
    df = ops.function_spans(ops.explode_code_lines(corpus(spark, a_dot_cpp="int f() {\n\n}\n").repartition(4)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize(
    "name,style",
    [("snake_case", "snake_case"), ("Mixed_case", "mixed_case"), ("A_B", "mixed_case"), ("RUN", "UPPER_CASE"),
     ("Run", "PascalCase"), ("runAll", "camelCase"), ("run", "lowercase"), ("~Widget", "PascalCase"), ("_1", "mixed_case")],
)
def test_name_style(ask, name, style):
    assert ask(C.name_style, name) == style


POSITIVE = {
    "raw new": "Foo* p = new Foo();", "malloc/free family": "free (p);", "C string funcs": "atoi(s)", "catch-all (...)": "catch (...) {",
    "const_cast": "const_cast<int*>(p)", "reinterpret_cast": "reinterpret_cast<T>(p)", "dynamic_cast": "dynamic_cast<T>(p)",
    "volatile": "volatile int x;", "mutex-like types": "std::mutex m;", "sleep calls": "std::this_thread::sleep_for(x)",
    "auto_ptr (deprecated)": "auto_ptr<T> p;", "goto": "goto done;", "void* usage": "void *p;", "C-style cast": "(int*)p",
    "typedef struct/union": "typedef struct T T;", "typedef (prefer using)": "typedef int T;", "unscoped enum": "enum Color {",
    "memset/ZeroMemory": "memset(p, 0, n)", "printf family": "printf(x)", "NULL macro": "p = NULL;", "exit() call": "exit(1)",
    "setjmp/longjmp": "longjmp(b, 1)", "this-> assignment": "this->x = 1;", "default lambda capture": "[&](int) {",
    "catch by value": "catch (std::exception e)", "signed/unsigned size() loop": "for (int i = 0; i < v.size(); ++i)",
    "std::bind (prefer lambda)": "std::bind(f)", "virtual + override together": "virtual void f() override;",
    "virtual without override": "virtual void f();",
}
NEGATIVE = {
    "raw new": "renew Foo", "NULL macro": "NULLABLE", "catch by value": "catch (const std::exception& e)",
    "virtual without override": "virtual void f() = 0;", "unscoped enum": "enum class Color {", "this-> assignment": "this->x == 1",
    "mutex-like types": "my_mutex", "goto": "gotox y",
}


def test_every_rule_fires_and_not_on_lookalikes(spark):
    assert set(POSITIVE) == {name for name, _ in rules.RED_FLAGS}
    rows = [("yes", n, t) for n, t in POSITIVE.items()] + [("no", n, t) for n, t in NEGATIVE.items()]
    df = spark.createDataFrame(rows, "kind string, rule string, line string")
    got = df.select("kind", "rule", F.array_contains(C.matching(F.col("line"), rules.RED_FLAGS), F.col("rule")).alias("hit")).collect()
    assert [r.rule for r in got if r.hit != (r.kind == "yes")] == []


def test_rules_see_stripped_lines_and_headers(spark):
    df = corpus(spark, a_dot_h='using namespace std; // new Foo\nconst char* s = "new Foo";\n', b_dot_cpp="using namespace std;\nx = new Foo;\n")
    hits = [(r.path, r.line_no, r.rule) for r in ops.red_flag_scan(ops.explode_code_lines(df)).collect()]
    assert sorted(hits) == [("a.h", 1, "using namespace (in header)"), ("b.cpp", 2, "raw new")]
    own = [(r.path, r.rule) for r in ops.red_flag_scan(ops.explode_code_lines(df), [("mine", "x =")], [("head", "const")]).collect()]
    assert sorted(own) == [("a.h", "head"), ("b.cpp", "mine")]


@pytest.mark.parametrize(
    "line,hit",
    [
        ('printf("n=%d", v.size());', True), ('printf("n=%zu", v.size());', False), ('printf("n=%d", (int)n);', False),
        ('snprintf(buf, sizeof(buf), "n=%d", 3);', False), ('printf("%d", static_cast<int>(v.size()));', False),
        ('fprintf(stderr, "%lu %zu", sizeof(x), y);', True), ('printf("%s", v.size()', False), ('x(printf("%5d", (a(b)).length()));', True),
    ],
)
def test_printf_sizes(spark, line, hit):
    lines = ops.explode_code_lines(corpus(spark, a_dot_cpp=line + "\n"))
    assert (ops.printf_spec_scan(lines).count() == 1) is hit


def test_header_hygiene(spark):
    df = corpus(
        spark,
        mod__a_dot_h="int x;\n#include <b>\n#include <a>\n#include <0>\n\n#include \"z\"\n#include <c>\n#include <b>\n",
        mod__b_dot_h="#ifndef B\n#define B\n#include <a>\n#endif\n",
        mod__c_dot_h="#pragma once\n// text\n#include <a>\n",
        mod__a_dot_cpp="#include <z>\n#include \"a.h\"\n",
        mod__b_dot_cpp="#include \"mod\\b.h\"\n",
        mod__d_dot_cpp="#include \"x.h\"\n",
    )
    got = sorted((r.path, r.line_no, r.rule) for r in ops.header_hygiene(df, ops.explode_code_lines(df)).collect())
    assert got == [
        ("mod/a.cpp", 0, "self-header not first include"),
        ("mod/a.h", 0, "header missing include guard"),
        ("mod/a.h", 1, "code before first include"),
        ("mod/a.h", 3, "unsorted includes"),
        ("mod/a.h", 8, "unsorted includes"),
        ("mod/b.h", 0, "#ifdef guard (no #pragma once)"),
    ]


def test_header_classes(spark):
    df = corpus(spark, a_dot_h="class A;\nclass B\n{\n};\nstruct C : B {\n};\n  struct D {\ntemplate <class T> class E {\nclass F\n\n{\n", b_dot_h="class Z {\n")
    classes = ops.header_class_rows(ops.explode_code_lines(df))
    assert [(r.path, r.classes, r.names) for r in ops.multi_class_headers(classes).collect()] == [("a.h", 3, "B,C,E")]


def test_log_fields_window(spark):
    text = 'printf(\n "a1=%d",\n "b2: x http://y"\n);\n "late1=%d"\n "out2=%d"\nint x;\nlog("%key=1 my_key = 2");\nstd::cout << "QQ:";\n'
    rows = ops.log_field_scan(ops.explode_code_lines(corpus(spark, a_dot_cpp=text))).collect()
    assert sorted((r.line_no, r.key, r.separator) for r in rows) == [(2, "a1", "="), (3, "b2", ":"), (8, "my_key", "="), (9, "QQ", ":")]


def test_magic_numbers(spark):
    text = "const int a = 42;\n#define B 42\nx = 42 + 7 + 0x1234 + 3.14 + a12;\nenum { K = 10 };\nf(100, 200);\nstatic constexpr int c = 99;\n"
    rows = ops.magic_number_counts(ops.explode_code_lines(corpus(spark, a_dot_cpp=text))).collect()
    assert [(r.path, r.n) for r in rows] == [("a.cpp", 3)]


def test_wrappers_and_builds(spark):
    lines = ops.explode_code_lines(corpus(spark, a_dot_cpp="time(NULL); std::time(0); x.crc; myCrc(a); doCRC32(b); rand();\n"))
    got = {(r.facility, r.origin): (r.n, r.mixed) for r in ops.wrapper_bypass(lines).collect()}
    assert got == {("time", "time()/std::time"): (2, False), ("crc", "myCrc"): (1, True), ("crc", "doCRC32"): (1, True), ("rand", "rand()/srand()"): (1, False)}
    flags = ops.build_flag_counts(corpus(spark, CMakeLists_dot_txt="-Wall -Werror -Werror=x /w4 -fsanitize=address\n"))
    found = {r.label: r.n for r in flags.collect()}
    assert found == {"-Wall": 1, "-Werror (all)": 1, "-Werror=specific": 1, "MSVC /W4 /Wall": 1, "-fsanitize=": 1}
    assert [r.category for r in ops.missing_build_categories(flags).collect()] == ["hardening"]


def test_duplicate_blocks(spark):
    block = "a\n b \n\nc   d\ne\nf\n"
    df = corpus(spark, x=block + "g\n" + block, y="zz\n" + block, z="only\nfour\nlines\nhere\n")
    got = [(r.copies, r.files, r.first_path, r.first_line) for r in ops.duplicate_blocks(df).collect()]
    assert got == [(3, 2, "x", 1)]


def test_churn_caps_size(spark):
    stats = spark.createDataFrame([("a", 5000), ("b", 10)], "path string, loc bigint")
    changes = spark.sql("select * from values ('a', timestamp_ntz'2026-01-02 00:00:00'), ('a', timestamp_ntz'2025-01-02 00:00:00'), ('z', timestamp_ntz'2026-01-02 00:00:00') t(path, committed_at)")
    assert [tuple(r) for r in ops.churn_x_size(stats, changes, "2026-01-01").collect()] == [("a", 1, 5000, 3000)]


def test_scan_delta_kinds(spark):
    ddl = "section string, label string, n bigint"
    before = spark.createDataFrame([("s", "gone", 2), ("s", "better", 5), ("s", "worse", 1), ("s", "same", 1)], ddl)
    after = spark.createDataFrame([("s", "new", 2), ("s", "better", 4), ("s", "worse", 3), ("s", "same", 1)], ddl)
    assert all(r.label == r.change for r in ops.scan_delta(before, after).collect())


def test_report_is_json(spark):
    df = corpus(spark, a_dot_cpp='#include <b>\nint f() {\n  x = new Foo; // TODO\n}\nprintf("k1=%d", 42);\n', a_dot_h="#pragma once\n")
    builds = corpus(spark, CMakeLists_dot_txt="-Wall")
    changes = spark.sql("select 'a.cpp' path, timestamp_ntz'2026-01-02 00:00:00' committed_at")
    rows = ops.scan_report_json(df, builds, changes, "2026-01-01").orderBy("section", "place").collect()
    report = json.loads("\n".join(r.text for r in rows))
    assert report["totals"] == [{"scanned_files": 2, "total_loc": 6}]
    assert report["longest_functions"] == [{"path": "a.cpp", "start": 2, "name": "f", "length": 3}]
    assert {r["rule"] for r in report["red_flags"]} == {"raw new", "printf family"}
    assert report["todo_hotspots"] == [{"path": "a.cpp", "todos": 1}] and report["top_log_keys"] == [{"key": "k1", "n": 1}]


def test_read_corpus(spark, tmp_path):
    def put(path, data):
        target = tmp_path / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data)

    put("src/a.cpp", b"int x;\n")
    put("src/b.H", "é\n".encode())
    put("src/bad.cc", b"ok \xff\n")
    put("src/bin.cpp", b"a\x00b")
    put("src/late.cpp", b"x" * 8192 + b"\x00")
    put("src/pp.cpp", b"P0\x10\n")
    put("build/gen.cpp", b"x")
    put("third_party/lib/y.h", b"x")
    put("src/build", b"x")
    put("notes.txt", b"x")
    put("CMakeLists.txt", b"-Wall")
    put("cmake/x.cmake", b"-Wextra")
    got = {r.path: r.text for r in readers.read_corpus(spark, str(tmp_path)).collect()}
    assert set(got) == {"src/a.cpp", "src/b.H", "src/bad.cc", "src/late.cpp", "src/pp.cpp"}
    assert got["src/b.H"] == "é\n" and got["src/bad.cc"] == "ok �\n"
    assert "build/gen.cpp" in {r.path for r in readers.read_corpus(spark, str(tmp_path), True).collect()}
    assert {r.path for r in readers.read_build_files(spark, str(tmp_path)).collect()} == {"CMakeLists.txt", "cmake/x.cmake"}


def plain_prints_size_badly(line):
    """The rule call by call, over each call's own text."""
    import re

    from opslens import rules

    for m in re.finditer(rules.PRINTF_CALL, line):
        depth = 0
        for end in range(m.end() - 1, len(line)):
            depth += {"(": 1, ")": -1}.get(line[end], 0)
            if depth == 0:
                call = line[m.end() - 1 : end + 1]
                head = re.match(r'((?:[^"]*"[^"]*")*)', call).group()
                literal = re.search(rules.QUOTED + r"\Z", head)
                rest = call[len(head) :]
                if literal and re.search(rules.SIZE_ARGUMENT, rest) and "static_cast<" not in rest:
                    if any(not f.group(1) for f in re.finditer(rules.INT_CONVERSION, literal.group(1))):
                        return True
                break
    return False


def test_printing_calls_against_a_plain_reading():
    import random

    from opslens.operators import corpus

    rng = random.Random(4)
    parts = ["printf(", "std::snprintf (", ")", "(", '"', "%d", "%zu", " v.size()", "sizeof(x)", "static_cast<int>(", ", ", "a", ";", "%5.2lld"]
    seen = set()
    for _ in range(20_000):
        line = "".join(rng.choice(parts) for _ in range(rng.randrange(3, 24)))
        want = plain_prints_size_badly(line)
        assert corpus._prints_size_badly(line) == want, line
        seen.add(want)
    assert seen == {True, False}


def test_a_line_of_a_megabyte(spark):
    import time

    from opslens.operators import corpus

    nested = "printf(" * 60_000 + '"%zu", v.size()' + ")" * 60_000
    rows = [("a", 1, nested), ("a", 2, 'printf("%zu", v.size());' * 40_000), ("a", 3, 'printf("%zu", n);' * 60_000 + 'printf("%d", v.size())')]
    began = time.time()
    got = corpus.printf_spec_scan(spark.createDataFrame(rows, "path string, line_no bigint, raw string")).collect()
    assert [r.line_no for r in got] == [3] and time.time() - began < 20


def test_build_files_are_counted(spark):
    from opslens.operators import corpus

    files = spark.createDataFrame([("a", "-Wall -Wall"), ("b", ""), ("c", "x")], "path string, text string")
    assert [tuple(r) for r in corpus.build_flag_counts(files).collect()] == [("warnings", "-Wall", 2, 3), ]


def test_scan_lines_give_what_the_corpus_gives(spark):
    from opslens.operators import corpus

    texts = {
        "a/x.h": '#include "b.h"\n#include "a.h"\nint a;\n', "a/x.cpp": '#include "y.h"\n#include "x.h"\n', "a/empty.h": "",
        "a/g.h": "#ifndef G\n\n#include <a>\n", "a/p.h": "#pragma once\nint q;\n#include <z>\n", "b/empty.cpp": "",
    }
    files = spark.createDataFrame(list(texts.items()), "path string, text string")
    scan = corpus.scan_lines(files)
    plain = corpus.header_hygiene(files, corpus.explode_code_lines(files))
    assert sorted(map(tuple, corpus.scan_hygiene(scan).collect())) == sorted(map(tuple, plain.collect()))
    part = corpus.scan_partials(files)
    assert {r.path: r.n for r in part("files").collect()} == {p: len(t.splitlines()) for p, t in texts.items()}
