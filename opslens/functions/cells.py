"""Sheet cell values, comparison and references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opslens.functions.text import ascii_upper, strip_all

NUMBER = r"\A[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"
REFERENCE = r"\$?([A-Za-z]{1,2})\$?(0?[1-9]|[1-9][0-9])"

# The error texts a cell may hold.
ERRORS = ["#DIV/0!", "#VALUE!", "#REF!", "#NAME?", "#CYCLE!"]


def _number(text: Column) -> Column:
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def typed(content: Column) -> Column:
    """``struct(kind, num, str, bool)``; kind is number, boolean, string or error."""
    text = strip_all(content)
    upper = ascii_upper(text)
    number = _number(text)
    kind = (
        F.when(text.isin(*ERRORS), "error")
        .when(upper.isin("TRUE", "FALSE"), "boolean")
        .when(number.isNotNull(), "number")
        .otherwise("string")
    )
    return F.struct(
        kind.alias("kind"),
        F.when(kind == "number", number).alias("num"),
        F.when(kind.isin("string", "error"), text).alias("str"),
        F.when(kind == "boolean", upper == "TRUE").alias("bool"),
    )


def _order(left: Column, right: Column) -> Column:
    return F.when(left < right, -1).when(left > right, 1).otherwise(0)


def compare(left: Column, right: Column) -> Column:
    """-1, 0 or 1 for two typed values.

    Booleans compare with each other; otherwise a boolean counts as 1 or 0.  A
    number and a string compare by value when the string is a whole number text,
    else the number is smaller.  Strings compare by bytes.
    """

    def number(v: Column) -> Column:
        return F.when(v["kind"] == "boolean", v["bool"].cast("double")).otherwise(v["num"])

    both_strings = (left["kind"] == "string") & (right["kind"] == "string")
    ln, rn = number(left), number(right)
    lt, rt = _number(left["str"]), _number(right["str"])
    return (
        F.when(both_strings, _order(left["str"], right["str"]))
        .when(right["kind"] == "string", F.when(rt.isNull(), -1).otherwise(_order(ln, rt)))
        .when(left["kind"] == "string", F.when(lt.isNull(), 1).otherwise(_order(lt, rn)))
        .otherwise(_order(ln, rn))
    )


def truth(value: Column) -> Column:
    """Non-zero number, true, or the text TRUE."""
    return (
        F.when(value["kind"] == "number", value["num"] != 0)
        .when(value["kind"] == "boolean", value["bool"])
        .otherwise(ascii_upper(strip_all(F.coalesce(value["str"], F.lit("")))) == "TRUE")
    )


def reference(text: Column) -> Column:
    """``struct(col, row_no)`` of an ``A1`` or ``$A$1`` reference, null if it is none."""
    shape = rf"\A{REFERENCE}\z"
    letters = ascii_upper(F.regexp_extract(text, shape, 1))
    row = F.regexp_extract(text, shape, 2)
    last = F.ascii(F.substring(letters, -1, 1)) - 64
    first = F.when(F.length(letters) == 2, (F.ascii(letters) - 64) * 26).otherwise(0)
    return F.when(
        letters != "",
        F.struct((first + last).cast("bigint").alias("col"), row.try_cast("bigint").alias("row_no")),
    )


def reference_text(col: Column, row: Column) -> Column:
    """``A1`` text of a column number 1..702 and a row."""
    high = F.floor((col - 1) / 26)
    letters = F.concat(
        F.when(high > 0, F.char(high + 64)).otherwise(""), F.char((col - 1) % 26 + 65)
    )
    return F.concat(letters, row.cast("string"))


def references_in(formula: Column) -> Column:
    """References named in a formula, literals left out."""
    code = F.regexp_replace(formula, r'"[^"]*"', " ")
    return F.regexp_extract_all(code, F.lit(rf"(?<![A-Za-z0-9_$]){REFERENCE}(?![A-Za-z0-9_(])"), F.lit(0))
