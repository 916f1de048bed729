"""Byte-exact text helpers shared by every family."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; every other character is kept."""
    return F.translate(text, UPPER, LOWER)


def ascii_upper(text: Column) -> Column:
    return F.translate(text, LOWER, UPPER)


def blank_trim(text: Column) -> Column:
    """Strip blanks, tabs, carriage returns and newlines on both sides."""
    return F.btrim(text, F.lit(" \t\r\n"))


def strip_all(text: Column) -> Column:
    """Strip all ASCII white space, form feeds and vertical tabs included."""
    return F.btrim(text, F.lit(" \t\r\n\f\u000b"))


def dash_if_blank(text: Column) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("-"))


def crc32_text(text: Column) -> Column:
    return F.crc32(F.encode(text, "UTF-8"))


def crc32_hex(text: Column) -> Column:
    """CRC-32 as eight upper-case hex digits."""
    return F.lpad(F.hex(crc32_text(text)), 8, "0")


def utf8_bytes(text: Column) -> Column:
    return F.octet_length(text).cast("bigint")


def format_duration(ms: Column) -> Column:
    """``850ms``, ``12.3s`` (truncated) or ``2m05s``."""
    seconds = F.floor(ms / 1000)
    return (
        F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms")))
        .when(
            ms < 60000,
            F.concat(seconds.cast("string"), F.lit("."), F.floor(ms % 1000 / 100).cast("string"), F.lit("s")),
        )
        .otherwise(
            F.concat(
                F.floor(seconds / 60).cast("string"),
                F.lit("m"),
                F.lpad((seconds % 60).cast("string"), 2, "0"),
                F.lit("s"),
            )
        )
    )


def clock_ms(epoch_ms: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss.SSS`` of an epoch in milliseconds."""
    return F.date_format(F.timestamp_millis(epoch_ms), "yyyy-MM-dd HH:mm:ss.SSS")


def compact_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def utc_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def in_line_ms(text: Column) -> Column:
    """Epoch milliseconds of a leading ``YYYY-MM-DD[ Tt]HH:MM:SS``, else null."""
    head = F.substring(text, 1, 19)
    shaped = head.rlike(r"\A\d{4}-\d{2}-\d{2}[ Tt]\d{2}:\d{2}:\d{2}\z")
    plain = F.concat(F.substring(head, 1, 10), F.lit(" "), F.substring(head, 12, 8))
    parsed = F.try_to_timestamp(plain, F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.when(shaped, F.unix_millis(parsed))


def setting_ms(text: Column) -> Column:
    """As :func:`in_line_ms` for a whole value, with optional ``.fff``."""
    shaped = text.rlike(r"\A\d{4}-\d{2}-\d{2}[ Tt]\d{2}:\d{2}:\d{2}(\.\d{1,3})?\z")
    fraction = F.rpad(F.regexp_extract(text, r"\.(\d{1,3})\z", 1), 3, "0")
    return F.when(shaped, in_line_ms(text) + fraction.cast("bigint"))


def glob_regex(mask: str) -> str:
    """Regex of a file mask with ``*`` and ``?``."""
    import re

    return r"\A" + "".join(
        {"*": r"[\s\S]*", "?": r"[\s\S]"}.get(ch, re.escape(ch)) for ch in mask
    ) + r"\z"


def glob_match(path: Column, include: str, excludes: list[str] | None = None) -> Column:
    """File name matches ``include`` and no exclude; an exclude holding ``/`` is
    matched against the whole path."""
    name = F.element_at(F.split(path, "/"), -1)
    keep = name.rlike(glob_regex(include))
    for mask in excludes or []:
        keep = keep & ~(path if "/" in mask else name).rlike(glob_regex(mask))
    return keep


def safe_source_name(source: Column) -> Column:
    """File name with everything outside ``[A-Za-z0-9_-]`` replaced; ``stdin`` if empty."""
    name = F.regexp_replace(F.element_at(F.split(source, "/"), -1), "[^A-Za-z0-9_-]", "_")
    return F.when(name == "", F.lit("stdin")).otherwise(name)


def run_length_packed_bytes(line: Column) -> Column:
    """Size of a line under byte run-length packing.

    A run of 2 to 128 equal bytes costs two bytes; other bytes cost themselves
    plus one byte per started 128; the container adds 12 bytes, its frame 4.
    """
    one_char_per_byte = F.decode(F.encode(line, "UTF-8"), "ISO-8859-1")
    literals = F.split(one_char_per_byte, r"([\s\S])\1{1,127}", -1)
    literal_cost = F.aggregate(
        literals,
        F.lit(0).cast("bigint"),
        lambda acc, s: acc + F.length(s) + F.ceil(F.length(s) / F.lit(128)).cast("bigint"),
    )
    return F.lit(16).cast("bigint") + (F.size(literals) - 1) * 2 + literal_cost
