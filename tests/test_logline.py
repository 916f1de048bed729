"""Line parsing, fields, predicates, transforms and output lines."""

import zlib

import pytest
from pyspark.sql import functions as F

from opslens.functions import logline as L
from opslens.functions import text as T
from opslens.operators import logs as ops

STRICT = [
    ("k1=v1 k2=v2", {"k1": "v1", "k2": "v2"}),
    ('msg="hello world" level=warn', {"msg": "hello world", "level": "warn"}),
    ("path='/var/log/app' note=\"quoted \\\"inner\\\" text\"", {"path": "/var/log/app", "note": 'quoted "inner" text'}),
    ('win="C:\\\\temp\\\\log"', {"win": "C:\\temp\\log"}),
    ("empty= dup=first dup=second", {"empty": "", "dup": "second"}),
    ('expr="a=b" tail=ok', {"expr": "a=b", "tail": "ok"}),
    ("just a plain log line", {}),
    ("", {}),
    ("   ", {}),
    ("=value", {}),
    ("severity then key=value", {}),
    ("   a=1 b=2 trailing-word", {"a": "1", "b": "2"}),
    ("only=pair", {"only": "pair"}),
    ('q="x=y"', {"q": "x=y"}),
    ('open="never closed', {"open": "never closed"}),
    ("é=ü x='it\\'s'", {"é": "ü", "x": "it's"}),
]


@pytest.mark.parametrize("text,want", STRICT)
def test_kv_strict(ask, text, want):
    assert ask(L.kv_strict, text) == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("evt user=bob host=web-01", {"user": "bob", "host": "web-01"}),
        ('notice msg="hello world" code=7', {"msg": "hello world", "code": "7"}),
        ("nothing to see here", {}),
    ],
)
def test_kv_tail(ask, text, want):
    assert ask(L.kv_tail, text) == want


def test_long_quoted_value_is_read_whole(ask):
    body = "x" * 200_000
    assert ask(L.kv_strict, f'a="{body}" b=1') == {"a": body, "b": "1"}


@pytest.mark.parametrize(
    "text,level,severity,message",
    [
        ("2026-08-30 12:00:00 [INFO] started", "INFO", 1, "started"),
        ("2026-08-30T12:00:00.123 warning low disk", "WARNING", 2, "low disk"),
        ("  2026-08-30 12:00:00 [ fatal ] x  ", "FATAL", 3, "x  "),
        ("2026-08-30 12:00:00 [WIBBER] x", "RAW", 4, "2026-08-30 12:00:00 [WIBBER] x"),
        ("free text", "RAW", 4, "free text"),
        ("2026-08-30 12:00:00 [RAW] x", "RAW", 4, "2026-08-30 12:00:00 [RAW] x"),
        ("2026-08-30 12:00:00 [AUDIT] y", "AUDIT", 7, "y"),
    ],
)
def test_parse(spark, text, level, severity, message):
    df = spark.createDataFrame([(text,)], "text string").withColumn("ingested_ts", F.lit("2026-01-01").cast("timestamp"))
    row = ops.parse_log_line(df, {"audit": 7}).first()
    assert (row.level, row.severity, row.message) == (level, severity, message)
    assert row.parsed == (level != "RAW")
    assert row.ts_text == (text.strip()[:23].split(" [")[0].split(" warn")[0] if row.parsed else "2026-01-01 00:00:00.000")


OPS = ["=", "!=", ">=", ">", "<=", "<", "contains", "starts_with", "ends_with", "matches"]


@pytest.mark.parametrize("op", OPS)
def test_missing_field_matches_nothing(spark, op):
    fields = F.create_map(F.lit("b"), F.lit("1"))
    row = spark.range(1).select(
        L.kv_pred(fields, "a", op, "1").alias("p"), (~L.kv_pred(fields, "a", op, "1")).alias("n")
    ).first()
    assert (row.p, row.n) == (False, True)


@pytest.mark.parametrize(
    "value,op,literal,want",
    [
        ("Disk FULL", "=", "disk full", True),
        ("Disk FULL", "!=", "disk full", False),
        ("Disk FULL", "contains", "k f", True),
        ("Disk FULL", "starts_with", "DISK", True),
        ("Disk FULL", "ends_with", "ull", True),
        ("É", "=", "é", False),
        ("b", ">", "B", True),
        ("b", ">=", "b", True),
        ("a", "<", "B", False),
        ("err 42", "matches", "[0-9]+", True),
        ("err 42", "matches", "ERR", False),
        ("100%", "contains", "%", True),
    ],
)
def test_text_predicates(ask, value, op, literal, want):
    assert ask(lambda c: L.text_pred(c, op, literal), value) is want


def test_predicates_fail_when_built(spark):
    with pytest.raises(ValueError):
        L.level_pred(F.lit(1), "=", "RAW")
    with pytest.raises(ValueError):
        L.level_pred(F.lit(1), "contains", "INFO")
    with pytest.raises(ValueError):
        L.text_pred(F.lit("a"), "like", "b")
    with pytest.raises(ValueError):
        L.check_regex(spark, "(")
    assert L.check_regex(spark, "a+") == "a+"


@pytest.mark.parametrize("spec", ["trim||uppercase", "replace:x", "replace:->y", "tag:novalue", "shout", "trim:1", "|trim"])
def test_bad_transform_specs(spec):
    with pytest.raises(ValueError):
        L.steps(spec)


def test_transform_steps_see_earlier_output(spark):
    chain = L.steps("trim|uppercase|replace:FOO->bar|tag:host=web-01")
    message, fields = L.transformed(F.lit("  foo é foo\n"), F.create_map(F.lit("host"), F.lit("old")), chain)
    row = spark.range(1).select(message.alias("m"), fields.alias("f")).first()
    assert (row.m, row.f) == ("bar é bar", {"host": "web-01"})
    assert L.steps("  ") == []


def test_crc_known_answer(ask):
    assert ask(T.crc32_hex, "123456789") == "CBF43926"


def test_output_lines_verify(ask):
    body = '2026-01-01 10:00:00 [INFO] [app.log] naïve "quote" \\ \t |crc=x'
    lit = [F.lit(x) for x in ("2026-01-01 10:00:00", "INFO", "app.log")]
    text = ask(lambda m: L.text_line(*lit, m), 'naïve "quote" \\ \t |crc=x')
    assert text == f"{body} |crc={zlib.crc32(body.encode()):08X}"
    assert ask(L.text_line_verdict, text) == "ok"
    assert ask(L.text_line_verdict, text.replace("INFO", "WARN")) == "bad_crc"
    assert ask(L.text_line_verdict, text[:-1]) == "bad_shape"
    json = ask(lambda m: L.json_line(*lit, m), 'a"b\\c\u001f/é')
    prefix = '{"ts":"2026-01-01 10:00:00","level":"INFO","source":"app.log","message":"a\\"b\\\\c\\u001F/é"'
    assert json == f'{prefix},"crc":{zlib.crc32(prefix.encode())}}}'
    assert ask(L.json_line_verdict, json) == "ok"
    assert ask(L.json_line_verdict, json.replace("/é", "/e")) == "bad_crc"
    assert ask(L.text_line_verdict, "#log v1.2.0 text created=2026-01-01T00:00:00Z") == "header"


@pytest.mark.parametrize(
    "ms,want", [(0, "0ms"), (999, "999ms"), (1000, "1.0s"), (59999, "59.9s"), (60000, "1m00s"), (125000, "2m05s")]
)
def test_format_duration(ask, ms, want):
    assert ask(T.format_duration, ms) == want


def test_in_line_times(ask):
    assert ask(T.in_line_ms, "2026-01-01T10:00:20 x") == 1767261620000
    assert ask(T.in_line_ms, "2026-02-30 10:00:20 x") is None
    assert ask(T.in_line_ms, "x 2026-01-01 10:00:20") is None
    assert ask(T.setting_ms, "2026-01-01 10:00:20.5") == 1767261620500
    assert ask(T.setting_ms, "2026-01-01 10:00:20.5555") is None


@pytest.mark.parametrize(
    "path,excludes,want",
    [
        ("/var/log/app.log", [], True),
        ("/var/log/app.txt", [], False),
        ("/var/log/app-old.log", ["*-old*"], False),
        ("/var/log/old/app.log", ["*old*"], True),
        ("/var/log/old/app.log", ["*/old/*"], False),
        ("/var/log/ap.log", [], False),
    ],
)
def test_glob(ask, path, excludes, want):
    assert ask(lambda p: T.glob_match(p, "app?*.log" if path.endswith("ap.log") else "*.log", excludes), path) is want


def test_safe_names(ask):
    assert ask(T.safe_source_name, "logs/app 1.log") == "app_1_log"
    assert ask(T.safe_source_name, "") == "stdin"


def test_tags():
    assert ops.tags_of("env=prod, edge ,a=b=c,") == {"env": "prod", "edge": "true", "a": "b=c"}
