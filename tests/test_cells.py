"""Cells, references and base64."""

import base64
import random

import pytest
from pyspark.sql import functions as F

from opslens.functions import b64
from opslens.functions import cells as C
from opslens.operators import cells as ops


@pytest.mark.parametrize(
    "text,kind,num",
    [(" 12 ", "number", 12.0), ("-.5e3", "number", -500.0), ("+7.", "number", 7.0), ("true", "boolean", None), (" FALSE", "boolean", None),
     ("12abc", "string", None), ("inf", "string", None), ("-inf", "string", None), ("0x10", "string", None), ("+", "string", None), ("#REF!", "error", None)],
)
def test_typing(ask, text, kind, num):
    got = ask(C.typed, text)
    assert (got.kind, got.num) == (kind, num)


@pytest.mark.parametrize(
    "left,right,want",
    [("5", "5", 0), ("2", '"10', -1), ("1", '"a', -1), ("TRUE", "1", 0), ("TRUE", "FALSE", 1), ('"b', '"a', 1), ('"10', '"9', -1),
     ('"a', "99", 1), ("TRUE", '"1', 0), ("FALSE", '"x', -1), ('"Z', '"a', -1), ('" 5', "5", 1)],
)
def test_compare(spark, left, right, want):
    def value(text):
        if text.startswith('"'):
            return F.struct(F.lit("string").alias("kind"), F.lit(None).cast("double").alias("num"), F.lit(text[1:]).alias("str"), F.lit(None).cast("boolean").alias("bool"))
        return C.typed(F.lit(text))

    pair = [C.compare(value(left), value(right)), C.compare(value(right), value(left))]
    row = spark.range(1).select(pair[0].alias("a"), pair[1].alias("b")).first()
    assert (row.a, row.b) == (want, -want)


@pytest.mark.parametrize(
    "text,want",
    [("A1", (1, 1)), ("$a$01", (1, 1)), ("Z99", (26, 99)), ("AA10", (27, 10)), ("zz1", (702, 1)), ("A0", None), ("A100", None), ("AAA1", None), ("1A", None), ("A", None)],
)
def test_references(ask, text, want):
    got = ask(C.reference, text)
    assert (got and tuple(got)) == want
    if want:
        assert ask(C.reference_text, *want) == text.upper().replace("$", "").replace("A01", "A1")


def test_references_in_formulas(ask):
    assert ask(C.references_in, '=SUM(A1:$B$3)+LOG10(C2)&"D4"+AB12') == ["A1", "$B$3", "C2", "AB12"]


def sheet(spark, **content):
    rows = [(1, ord(ref[0]) - 64, int(ref[1:]), text) for ref, text in content.items()]
    return spark.createDataFrame(rows, "sheet bigint, col bigint, row_no bigint, content string")


def asked(spark, c1, r1, c2, r2):
    return spark.createDataFrame([(1, "r", c1, r1, c2, r2)], "sheet bigint, range_id string, c1 bigint, r1 bigint, c2 bigint, r2 bigint")


def test_range_results(spark):
    row = ops.range_aggregate(sheet(spark, A1="1", B1="2", A2="3", B2="4"), asked(spark, 2, 2, 1, 1)).first()
    assert (row["count"], row["sum"], row.avg, row.min, row.max, row.error) == (4, 10.0, 2.5, 1.0, 4.0, None)
    row = ops.range_aggregate(sheet(spark, A1="5", B3="str", C1="true", A2=""), asked(spark, 1, 1, 3, 3)).first()
    assert (row["count"], row["sum"]) == (1, 5.0)
    row = ops.range_aggregate(sheet(spark, A1="5"), asked(spark, 8, 1, 9, 5)).first()
    assert (row["count"], row["sum"], row.avg, row.empty_error) == (0, 0.0, None, "#VALUE!")
    row = ops.range_aggregate(sheet(spark, B1="#REF!", A2="#DIV/0!", A1="5"), asked(spark, 1, 1, 3, 3)).first()
    assert (row["sum"], row.error) == (None, "#REF!")


@pytest.mark.parametrize(
    "content,both",
    [({"A1": "0", "B1": "#REF!"}, ("FALSE", "#REF!")), ({"A1": "#REF!", "B1": "0"}, ("#REF!", "#REF!")), ({"A1": "1", "B1": "#REF!"}, ("#REF!", "TRUE")),
     ({"A1": "1", "A2": " true "}, ("TRUE", "TRUE")), ({}, ("TRUE", "FALSE")), ({"A1": "x", "B2": "2"}, ("FALSE", "TRUE"))],
)
def test_range_logic(spark, content, both):
    cells = sheet(spark, **content) if content else sheet(spark, Z9="1")
    row = ops.range_logic(cells, asked(spark, 1, 1, 3, 3)).first()
    assert (row.all_true, row.any_true) == both


def plain_depths(refs):
    """Depth by recursion, None for a cell that reaches a loop."""
    done = {}

    def depth(cell, path):
        if cell in path:
            return None
        if cell not in done:
            below = [depth(c, path | {cell}) for c in refs[cell] if c in refs]
            result = None if None in below else 1 + max(below, default=0)
            if path and result is None:
                return None
            done[cell] = result
        return done[cell]

    return {cell: depth(cell, frozenset()) for cell in refs}


def test_reference_graph(spark):
    rng = random.Random(2)
    refs = {}
    for col in "ABCD":
        for row in range(1, 9):
            if rng.random() < 0.7:
                refs[f"{col}{row}"] = [f"{rng.choice('ABCD')}{min(9, row + rng.randint(1, 2))}" for _ in range(2)]
    refs["A8"], refs["B8"] = ["B8"], ["A8"]
    refs["D8"] = ["D8"]
    rows = [(1, ord(r[0]) - 64, int(r[1:]), "=" + "+".join(t)) for r, t in refs.items()] + [(1, 1, 9, "5")]
    df = spark.createDataFrame(rows, "sheet bigint, col bigint, row_no bigint, formula string")
    got = {f"{chr(r.col + 64)}{r.row_no}": (r.depth, r.state) for r in ops.reference_graph(df).collect()}
    assert got == {c: (d, "ok" if d else "cycle") for c, d in plain_depths(refs).items()}
    # a deep sheet does not change the states of a looping one
    chain = [(1, 1, i, f"=A{i + 1}") for i in range(1, 9)]
    loop = [(2, 1, 1, "=A2"), (2, 1, 2, "=A1"), (2, 1, 3, "=A2"), (2, 1, 4, "=7")]
    deep = spark.createDataFrame(chain + loop, "sheet bigint, col bigint, row_no bigint, formula string")
    states = {(r.sheet, r.row_no): (r.depth, r.state) for r in ops.reference_graph(deep, limit=3).collect()}
    assert states == {
        (1, 8): (1, "ok"), (1, 7): (2, "ok"), (1, 6): (3, "ok"), **{(1, i): (None, "too_deep") for i in range(1, 6)},
        **{(2, i): (None, "cycle") for i in (1, 2, 3)}, (2, 4): (1, "ok"),
    }


@pytest.mark.parametrize("data", [b"", b"f", b"fo", b"foo", b"foob", b"fooba", b"foobar", bytes(range(256)), b"x" * 57, b"x" * 114])
def test_encodings(spark, data):
    df = spark.createDataFrame([(bytearray(data),)], "d binary")
    row = df.select(*[b64.encode(F.col("d"), m).alias(m) for m in ("standard", "url", "mime")]).first()
    plain = base64.b64encode(data).decode()
    assert row.standard == plain and row.url == base64.urlsafe_b64encode(data).decode().rstrip("=")
    assert row.mime == "\r\n".join(plain[i : i + 76] for i in range(0, len(plain), 76))


CASES = [
    ("Zm9v", "strict", "valid", None), ("", "strict", "valid", None), ("Zm9v!", "strict", "bad_character", 4), ("Zg==x", "strict", "data_after_padding", 4),
    ("Zg=", "strict", "incomplete_padding", None), ("Zg", "strict", "missing_padding", None), ("Zm9vY", "strict", "bad_length", None),
    ("Zh==", "strict", "tail_bits", None), ("Zm9=", "strict", "tail_bits", None), ("Zm8=", "strict", "valid", None), ("Zm9v\r\n", "strict", "bad_character", 4),
    ("Zm9v\r\n", "mime", "valid", None), ("Zm 9v", "mime", "bad_character", 2), (" Zm\t9v\n", "lenient", "valid", None), ("Zg= =", "lenient", "valid", None),
    ("Zg= =", "strict", "data_after_padding", 3), ("-_-_", "url", "valid", None), ("ab+_", "url", "bad_character", 2), ("Zg", "url", "valid", None),
    ("Zh", "url", "tail_bits", None), ("Zm9vY", "url", "bad_length", None), ("Zg==", "url", "valid", None), ("-_-_", "strict", "bad_character", 0),
    ("A===", "strict", "incomplete_padding", None), ("====", "strict", "incomplete_padding", None), ("Zh==x", "strict", "tail_bits", None),
    ("Zm9vé", "strict", "bad_character", 4),
]


def test_audit(spark):
    df = spark.createDataFrame([(i, v, m) for i, (v, m, _, _) in enumerate(CASES)], "n int, value string, mode string")
    got = {r.n: (r["class"], r.position) for r in b64.audit(df).collect()}
    assert got == {i: (c, p) for i, (_, _, c, p) in enumerate(CASES)}


def plain_graph(cells, limit):
    """Depth of each formula cell by recursion, None where it reaches a loop."""
    def depth(cell, path):
        if cell in path:
            return None
        found = [depth(t, path | {cell}) for t in cells[cell] if t in cells]
        return None if None in found else 1 + max(found, default=0)

    out = {}
    for cell in cells:
        d = depth(cell, frozenset())
        out[cell] = (None, "cycle") if d is None else (d, "ok") if d <= limit else (None, "too_deep")
    return out


@pytest.mark.parametrize("rows", [3, 1 << 16])
def test_reference_graph_against_recursion(spark, monkeypatch, rows):
    import random

    from opslens.operators import cells as ops

    monkeypatch.setattr(ops, "GRAPH_ROWS", rows)
    rng, table, want = random.Random(rows), [], {}
    for sheet in ["s1", "s2", "s3", None, "s4"]:
        graph = {}
        for col in range(1, 5):
            for row in range(1, 5):
                if rng.random() < 0.7:
                    refs = [(rng.randrange(1, 6), rng.randrange(1, 6)) for _ in range(rng.randrange(3))]
                    if sheet != "s1":  # no loops: upwards only
                        refs = [(c, r) for c, r in refs if r > row]
                    graph[(col, row)] = refs
                    table.append((sheet, col, row, "=1" + "".join(f"+{chr(64 + c)}{r}+${chr(64 + c)}${r}" for c, r in refs)))
        want |= {(sheet, *cell): found for cell, found in plain_graph(graph, 1).items()}
    df = spark.createDataFrame(table, "sheet string, col bigint, row_no bigint, formula string").repartition(2)
    got = {(r.sheet, r.col, r.row_no): (r.depth, r.state) for r in ops.reference_graph(df, 1).collect()}
    assert got == want and {s for _, s in want.values()} == {"ok", "cycle", "too_deep"}
    assert ops.reference_graph(df.limit(0), 3).count() == 0


def test_edges_of_cells_given_several_times(spark):
    rows = [
        (1, 1, 1, "=A2+$A$2+b3"), (1, 1, 1, "=A2+$A$2+b3"), (1, 1, 1, "=B3+C4"), (1, 2, 1, '="A9"&A1'), (1, 2, 1, '="A9"&A1'),
        (None, 1, None, "=A2"), (None, 1, None, "=A2+A3"), (2, 1, 1, "5"), (2, 1, 1, None), (2, 1, 1, "=$Z9"),
    ]
    df = spark.createDataFrame(rows, "sheet bigint, col bigint, row_no bigint, formula string").repartition(3)
    got = [tuple(r) for r in ops.reference_edges(df).collect()]
    want = [(1, 1, 1, 1, 2), (1, 1, 1, 2, 3), (1, 1, 1, 3, 4), (1, 2, 1, 1, 1), (None, 1, None, 1, 2), (None, 1, None, 1, 3), (2, 1, 1, 26, 9)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_cells_of_a_large_table_are_sorted_in_more_tasks(spark, tmp_path, monkeypatch):
    from opslens.sources import views

    rows = spark.range(4000).selectExpr("id div 2 AS l_orderkey", "id AS l_partkey", "cast(id % 7 AS int) AS l_linenumber")
    rows.write.parquet(str(tmp_path / "lineitem.parquet"))
    whole = sorted(views.cells(spark, str(tmp_path)).collect())
    monkeypatch.setattr(views, "CELL_ROWS", 200)
    dealt = views.cells(spark, str(tmp_path))
    assert dealt.rdd.getNumPartitions() == 20 and sorted(dealt.collect()) == whole
    sizes = views.formulas(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert sizes < 400  # no task gets more of a larger table
