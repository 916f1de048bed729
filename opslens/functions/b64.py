"""Base64 columns: encodings and an audit of encoded values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.operators.staging import once


def encode(data: Column, mode: str = "standard") -> Column:
    """``standard``, ``url`` (URL-safe, no padding) or ``mime`` (lines of 76, CRLF)."""
    wrapped = F.base64(data)
    plain = F.regexp_replace(wrapped, "[\r\n]", "")
    if mode == "standard":
        return plain
    if mode == "url":
        return F.rtrim(F.translate(plain, "+/", "-_"), F.lit("="))
    if mode == "mime":
        return F.regexp_replace(plain, "(.{76})(?=.)", "$1\r\n")
    raise ValueError(f"unknown mode {mode!r}")


def audit(values: DataFrame) -> DataFrame:
    """Add ``class`` and ``position`` to rows with ``value`` and ``mode``.

    Modes: ``strict``, ``lenient`` (blanks, tabs and line ends ignored), ``mime``
    (line ends ignored), ``url``.  ``position`` is the 0-based place of the first
    offending character in the value as given, null where none is.
    """
    value, mode = F.col("value"), F.col("mode")
    url = mode == "url"
    blanks = {"lenient": " \t\r\n", "mime": "\r\n"}

    def by_mode(url_case: Column, case) -> Column:
        chosen = F.when(url, url_case)
        for name, skipped in blanks.items():
            chosen = chosen.when(mode == name, case(skipped))
        return chosen.otherwise(case(""))

    illegal = by_mode(
        F.regexp_instr(value, F.lit(r"[^A-Za-z0-9_\-=]")),
        lambda skipped: F.regexp_instr(value, F.lit(f"[^A-Za-z0-9+/={skipped}]")),
    )
    dense = by_mode(value, lambda skipped: F.translate(value, skipped, "") if skipped else value)
    pad, length = F.instr(value, "="), F.length(value) % 4
    behind = F.substring(value, pad, F.length(value))
    located = once(
        values,
        __bad=illegal,
        __pad=pad,
        __late=F.when(
            pad > 0,
            by_mode(
                F.regexp_instr(behind, F.lit("[^=]")),
                lambda skipped: F.regexp_instr(behind, F.lit(f"[^={skipped}]")),
            ),
        ).otherwise(0),
        __foreign=F.when(url, F.regexp_instr(value, F.lit("[+/]"))).otherwise(0),
        __length=length,
        __dense=dense,
        __spare=F.when(url & (length == 2), 2).when(url & (length == 3), 1).otherwise(0),
    )
    tight, head = F.col("__dense"), F.substring_index("__dense", "=", 1)
    bad, pad, length, spare = F.col("__bad"), F.col("__pad"), F.col("__length"), F.col("__spare")
    counted = once(
        located,
        __rest=F.length(head) % 4,
        __last=F.substring(head, -1, 1),
        __pads=F.length(tight) - F.length(F.replace(tight, F.lit("="), F.lit(""))),
        __run=F.length(F.regexp_extract(F.substring(tight, F.length(head) + 1, F.length(tight)), r"\A=*", 0)),
        __sextets=(F.length(tight) + spare) % 4,
    )
    rest, pads, last = F.col("__rest"), F.col("__pads"), F.col("__last")
    # Last characters whose low four or two bits are zero.
    clean = F.when(rest == 2, last.rlike("[AQgw]")).when(rest == 3, last.rlike("[AEIMQUYcgkosw048]")).otherwise(True)
    unclean_tail = (rest >= 2) & ~clean & (F.col("__run") + spare >= 4 - rest)
    kind = (
        F.when(F.col("__foreign") > 0, "bad_character")
        .when(url & (length == 1), "bad_length")
        .when((bad > 0) & ((pad == 0) | (bad < pad)), "bad_character")
        .when(unclean_tail, "tail_bits")
        .when(F.col("__late") > 0, "data_after_padding")
        .when(F.col("__sextets") == 1, "bad_length")
        .when(F.col("__sextets") > 0, F.when(pads > 0, "incomplete_padding").otherwise("missing_padding"))
        .when((pads + spare > 2) | ((pads > 0) & (rest == 0)), "incomplete_padding")
        .otherwise("valid")
    )
    judged = counted.withColumn("class", kind)
    position = (
        F.when(F.col("__foreign") > 0, F.col("__foreign") - 1)
        .when(F.col("class") == "bad_character", bad - 1)
        .when(F.col("class") == "data_after_padding", pad + F.col("__late") - 2)
    )
    return judged.select(*values.columns, "class", position.cast("bigint").alias("position"))
