"""Log line parsing, severity, key=value fields, predicates and transforms."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from opslens.functions.text import ascii_lower, ascii_upper, blank_trim, crc32_hex, crc32_text

# Severity ordinals, level words and their aliases, and the line
# shape.  They must equal the established log format.
SEVERITIES = {"DEBUG": 0, "INFO": 1, "WARN": 2, "ERROR": 3, "RAW": 4}
ALIASES = {
    "TRACE": "DEBUG",
    "NOTICE": "INFO",
    "WARNING": "WARN",
    "ERR": "ERROR",
    "FATAL": "ERROR",
    "CRITICAL": "ERROR",
    "CRIT": "ERROR",
}
LINE = (
    r"^\s*(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:[.,]\d{1,6})?)"
    r"\s*\[?\s*([A-Za-z]+)\s*\]?\s*([^\n\r]*)\z"
)
PAIR = (
    r"\G\s*+[^\s=]++="
    r'(?:"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+\\?(?:"|\z)'
    r"|'[^'\\]*+(?:\\[\s\S][^'\\]*+)*+\\?(?:'|\z)"
    r"|(?![\"'])\S*+)"
)
HEADER = r"\A#\S+ v\S+ [\s\S]*created="
TAIL = r"(?:^|\s)([^\s=]+=[\s\S]*)\z"


def level_table(custom: dict[str, int] | None = None) -> dict[str, int]:
    """Word -> severity, built-ins, aliases and registered levels.  RAW is a
    severity but not a word a line may carry."""
    words = {w: s for w, s in SEVERITIES.items() if w != "RAW"}
    words.update({alias: SEVERITIES[name] for alias, name in ALIASES.items()})
    words.update({w.upper(): s for w, s in (custom or {}).items()})
    return words


def severity_of(word: Column, custom: dict[str, int] | None = None) -> Column:
    """Severity of a level word in any case, null when unknown."""
    pairs = [F.lit(x) for item in level_table(custom).items() for x in item]
    return F.try_element_at(F.create_map(*pairs), ascii_upper(word))


def level_name(severity: Column) -> Column:
    """Built-in name of a severity; anything at or above 4 shows as RAW."""
    names = list(SEVERITIES)
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.least(severity, F.lit(4)) + 1)


def parse_columns(text: Column, ingested: Column, custom: dict[str, int] | None = None) -> dict[str, Column]:
    """Columns of a parsed line; a line that does not parse is RAW and keeps its text."""
    word = F.regexp_extract(text, LINE, 2)
    severity = severity_of(word, custom)
    known = severity.isNotNull()
    return {
        "parsed": known,
        "severity": F.coalesce(severity, F.lit(SEVERITIES["RAW"])),
        "level": F.when(known, ascii_upper(word)).otherwise(F.lit("RAW")),
        "ts_text": F.when(known, F.regexp_extract(text, LINE, 1)).otherwise(
            F.date_format(ingested, "yyyy-MM-dd HH:mm:ss.SSS")
        ),
        "message": F.when(known, F.regexp_extract(text, LINE, 3)).otherwise(text),
    }


# --- key=value fields -------------------------------------------------------


_BLANKS = " \t\r\n\f\u000b"


def _pair(found: Column) -> Column:
    """``struct(key, value)`` of one matched pair.

    Plain string functions do the common case; patterns are used only for values
    that hold a backslash.
    """
    pair = F.ltrim(found, F.lit(_BLANKS))
    cut = F.instr(pair, "=")
    raw = F.substring(pair, cut + 1, F.length(pair))
    quote = F.substring(raw, 1, 1)
    escaped = F.contains(raw, F.lit("\\"))

    def inner(mark: str) -> Column:
        whole = rf"\A{mark}[^{mark}\\]*+(?:\\[\s\S][^{mark}\\]*+)*+{mark}\z"
        closed = F.when(escaped, raw.rlike(whole)).otherwise((F.length(raw) > 1) & raw.endswith(mark))
        body = F.substring(raw, F.lit(2), F.length(raw) - F.when(closed, 2).otherwise(1))
        return F.when(escaped, F.regexp_replace(body, rf"\\([{mark}\\])", "$1")).otherwise(body)

    value = F.when(quote == '"', inner('"')).when(quote == "'", inner("'")).otherwise(raw)
    return F.struct(F.substring(pair, F.lit(1), cut - 1).alias("key"), value.alias("value"))


def kv_strict(text: Column) -> Column:
    """Map of the ``key=value`` pairs from the start of the text up to the first
    token that is not a pair; a repeated key keeps its last value."""
    pairs = F.reverse(F.transform(F.regexp_extract_all(text, F.lit(PAIR), F.lit(0)), _pair))
    keys = F.transform(pairs, lambda p: p["key"])
    # from the end, the first of equal keys is the last in the text
    kept = F.filter(pairs, lambda p, i: F.array_position(keys, p["key"]) == i + 1)
    return F.map_from_entries(F.reverse(kept))


def kv_tail(text: Column) -> Column:
    """As :func:`kv_strict`, after skipping leading words that hold no ``=``."""
    return kv_strict(F.regexp_extract(text, TAIL, 1))


def kv_cascade(text: Column, message: Column, parsed: Column) -> Column:
    """Whole line, then for parsed lines the message, then the message's tail.

    The first token tells which of the three applies, so pairs are scanned once.
    """
    first = r"\A\s*[^\s=]+="
    start = (
        F.when(text.rlike(first), text)
        .when(parsed & message.rlike(first), message)
        .when(parsed, F.regexp_extract(message, TAIL, 1))
        .otherwise("")
    )
    return kv_strict(start)


def merge_maps(base: Column, override: Column) -> Column:
    """Union of two maps; the second wins."""
    return F.map_zip_with(base, override, lambda _k, a, b: F.coalesce(b, a))


# --- predicates: always true or false, never null ---------------------------

_OPS: dict[str, Callable[[Column, str], Column]] = {
    "=": lambda c, v: ascii_lower(c) == ascii_lower(F.lit(v)),
    "!=": lambda c, v: ascii_lower(c) != ascii_lower(F.lit(v)),
    ">=": lambda c, v: c >= F.lit(v),
    ">": lambda c, v: c > F.lit(v),
    "<=": lambda c, v: c <= F.lit(v),
    "<": lambda c, v: c < F.lit(v),
    "contains": lambda c, v: F.contains(ascii_lower(c), ascii_lower(F.lit(v))),
    "starts_with": lambda c, v: F.startswith(ascii_lower(c), ascii_lower(F.lit(v))),
    "ends_with": lambda c, v: F.endswith(ascii_lower(c), ascii_lower(F.lit(v))),
    "matches": lambda c, v: F.regexp_like(c, F.lit(v)),
}


def text_pred(value: Column, op: str, literal: str) -> Column:
    """Compare a text column; equality and containment ignore ASCII case, order
    comparisons and ``matches`` do not."""
    if op not in _OPS:
        raise ValueError(f"unknown operator {op!r}")
    return F.coalesce(_OPS[op](value, literal), F.lit(False))


def kv_pred(fields: Column, key: str, op: str, literal: str) -> Column:
    """Compare a field; a record without the field matches nothing, ``!=`` included."""
    return text_pred(F.try_element_at(fields, F.lit(key)), op, literal)


def level_pred(severity: Column, op: str, name: str, custom: dict[str, int] | None = None) -> Column:
    """Compare by ordinal with a level word."""
    words = level_table(custom)
    if name.upper() not in words:
        raise ValueError(f"unknown level {name!r}")
    if op not in ("=", "!=", ">=", ">", "<=", "<"):
        raise ValueError(f"operator {op!r} does not apply to level")
    target = F.lit(words[name.upper()])
    return {
        "=": severity == target,
        "!=": severity != target,
        ">=": severity >= target,
        ">": severity > target,
        "<=": severity <= target,
        "<": severity < target,
    }[op]


def check_regex(spark: SparkSession, pattern: str) -> str:
    """The pattern, once Spark has accepted it; ``ValueError`` otherwise."""
    try:
        spark.range(1).select(F.regexp_like(F.lit(""), F.lit(pattern))).first()
    except Exception as error:
        raise ValueError(f"invalid pattern {pattern!r}") from error
    return pattern


def keyword_pred(message: Column, keyword: str) -> Column:
    if not keyword:
        return F.lit(True)
    return text_pred(message, "contains", keyword)


# --- transforms ---------------------------------------------------------------


@dataclass(frozen=True)
class Step:
    kind: str
    first: str = ""
    second: str = ""


def steps(spec: str) -> list[Step]:
    """Steps of ``trim|uppercase|replace:old->new|tag:key=value``."""
    if not spec.strip(" \t\r\n"):
        return []
    out = []
    for part in spec.split("|"):
        kind, colon, body = part.strip(" \t\r\n").partition(":")
        kind = kind.lower()
        arrow, equals = body.split("->", 1), body.split("=", 1)
        if kind in ("uppercase", "trim") and not colon:
            out.append(Step(kind))
        elif kind == "replace" and len(arrow) == 2 and arrow[0]:
            out.append(Step(kind, arrow[0], arrow[1]))
        elif kind == "tag" and len(equals) == 2 and equals[0].strip():
            out.append(Step(kind, equals[0].strip(), equals[1].strip()))
        else:
            raise ValueError(f"bad transform step {part!r} in {spec!r}")
    return out


def transformed(message: Column, fields: Column, chain: Sequence[Step]) -> tuple[Column, Column]:
    """Message and fields after the steps, each seeing the earlier ones' output."""
    for step in chain:
        if step.kind == "uppercase":
            message = ascii_upper(message)
        elif step.kind == "trim":
            message = blank_trim(message)
        elif step.kind == "replace":
            message = F.replace(message, F.lit(step.first), F.lit(step.second))
        else:
            fields = merge_maps(fields, F.create_map(F.lit(step.first), F.lit(step.second)))
    return message, fields


# --- output lines -----------------------------------------------------------


def text_line(ts: Column, level: Column, source: Column, message: Column) -> Column:
    body = F.concat(ts, F.lit(" ["), level, F.lit("] ["), source, F.lit("] "), message)
    return F.concat(body, F.lit(" |crc="), crc32_hex(body))


def json_line(ts: Column, level: Column, source: Column, message: Column) -> Column:
    whole = F.to_json(
        F.struct(ts.alias("ts"), level.alias("level"), source.alias("source"), message.alias("message"))
    )
    body = F.substring(whole, F.lit(1), F.length(whole) - 1)
    return F.concat(body, F.lit(',"crc":'), crc32_text(body).cast("string"), F.lit("}"))


def text_line_verdict(line: Column) -> Column:
    """``header``, ``bad_shape``, ``bad_crc`` or ``ok`` for a text output line."""
    shape = r"\A([\s\S]*) \|crc=([0-9A-F]{8})\z"
    body, crc = F.regexp_extract(line, shape, 1), F.regexp_extract(line, shape, 2)
    return (
        F.when(line.rlike(HEADER), "header")
        .when(crc == "", "bad_shape")
        .when(crc32_hex(body) == crc, "ok")
        .otherwise("bad_crc")
    )


def json_line_verdict(line: Column) -> Column:
    shape = r'\A(\{[\s\S]*),"crc":([0-9]{1,10})\}\z'
    body, crc = F.regexp_extract(line, shape, 1), F.regexp_extract(line, shape, 2)
    record = F.from_json(line, "ts string, level string, source string, message string, crc bigint")
    return (
        F.when(line.rlike(HEADER), "header")
        .when((crc == "") | record["message"].isNull() | record["ts"].isNull(), "bad_shape")
        .when(crc32_text(body).cast("string") == crc, "ok")
        .otherwise("bad_crc")
    )


@dataclass(frozen=True)
class Route:
    """One named output: threshold, predicate, steps and line format."""

    name: str
    min_severity: int = 0
    predicate: Callable[[dict[str, Column]], Column] | None = None
    chain: Sequence[Step] = field(default_factory=tuple)
    position: str = "after"
    format: str = "text"

    def __post_init__(self):
        if self.position not in ("before", "after"):
            raise ValueError(f"position must be before or after, not {self.position!r}")
        if self.format not in ("text", "json"):
            raise ValueError(f"format must be text or json, not {self.format!r}")
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", self.name):
            raise ValueError(f"bad output name {self.name!r}")
