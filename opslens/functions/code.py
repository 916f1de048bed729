"""Column expressions over source text and source lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opslens import rules

_SPACE = " \t\r\n\f\u000b"
# The characters that end a line (a carriage return takes a newline with it).
BREAKS = r"\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029"
LINE_END = rf"\r\n|[{BREAKS}]"
_TOKEN = r"""//[^\n]*+|/\*[\s\S]*?(?:\*/|\z)|"[^"]*+(?:"|\z)|'[^']*+(?:'|\z)|[^/"']++|/"""


def strip_comments(text: Column) -> Column:
    """Text of equal length with comments and literal contents blanked; line ends stay.

    Escaped quotes and backslashes are blanked first, so a literal ends at the next
    quote.  A newline after a backslash inside a literal is kept, so that lines
    keep their numbers.
    """
    plain = F.regexp_replace(text, r"""\\["'\\]""", "  ")
    blank = lambda c: F.regexp_replace(c, rf"[^{BREAKS}]", " ")

    def token(t: Column) -> Column:
        mark = F.substring(t, 1, 1)
        closed = (F.length(t) > 1) & (F.substring(t, F.length(t), F.lit(1)) == mark)
        body = F.when(closed, F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(
            F.substring(t, F.lit(2), F.length(t))
        )
        literal = F.concat(mark, blank(body), F.when(closed, mark).otherwise(""))
        return (
            F.when(t.startswith("//") | t.startswith("/*"), blank(t))
            .when(mark.isin('"', "'"), literal)
            .otherwise(t)
        )

    return F.array_join(F.transform(F.regexp_extract_all(plain, F.lit(_TOKEN), F.lit(0)), token), "")


def split_lines(text: Column) -> Column:
    """Lines without their ends; a final line end opens no further line."""
    lines = F.split(F.regexp_replace(text, rf"(?:{LINE_END})\z", ""), LINE_END, -1)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(lines)


def shifted(values: Column, by: int, fill: Column) -> Column:
    """Array moved ``by`` places towards its end (negative: towards its start)."""
    size = F.size(values)
    if by >= 0:
        return F.slice(F.concat(F.array_repeat(fill, by), values), F.lit(1), size)
    return F.slice(F.concat(values, F.array_repeat(fill, -by)), F.lit(1 - by), size)


def snippet(raw: Column, limit: int = 100) -> Column:
    return F.substring(F.btrim(raw, F.lit(_SPACE)), 1, limit)


def function_name(stripped: Column) -> Column:
    """Name of the function-like block a line opens, else null."""
    opens = F.rtrim(stripped, F.lit(_SPACE)).endswith("{") & F.contains(stripped, F.lit("("))
    before = F.substring_index(stripped, "(", 1)
    first = F.regexp_extract(before, r"^\s*([A-Za-z_~][\w:]*)", 1)
    last = F.regexp_extract(before, r"([A-Za-z_~][\w:]*)\s*\z", 1)
    name = F.substring_index(last, "::", -1)
    plausible = (
        ~F.contains(before, F.lit("="))
        & (first != "")
        & ~first.isin(*rules.CONTROL_WORDS)
        & (last != "")
        & ~name.isin(*rules.CONTROL_WORDS)
    )
    return F.when(opens & plausible, name)


def brace_balance(stripped: Column) -> Column:
    return F.length(F.regexp_replace(stripped, r"[^{]", "")) - F.length(F.regexp_replace(stripped, r"[^}]", ""))


def name_style(name: Column) -> Column:
    n = F.regexp_replace(name, r"\A~", "")
    has_upper, has_lower = n.rlike("[A-Z]"), n.rlike("[a-z]")
    return (
        F.when(F.contains(n, F.lit("_")), F.when(has_lower & ~has_upper, "snake_case").otherwise("mixed_case"))
        .when(has_upper & ~has_lower, "UPPER_CASE")
        .when(has_upper, F.when(n.rlike(r"\A[A-Z]"), "PascalCase").otherwise("camelCase"))
        .otherwise("lowercase")
    )


def matching(value: Column, table: list[tuple[str, str]]) -> Column:
    """Labels of the rules whose pattern is found in a line."""
    hits = F.array(*[F.when(value.rlike(pattern), F.lit(label)) for label, pattern in table])
    return F.filter(hits, lambda label: label.isNotNull())


def counts_of(value: Column, table: list[tuple]) -> Column:
    """Array of ``(labels..., n)`` with the number of matches of each rule."""
    return F.array(
        *[
            F.struct(
                *[F.lit(part).alias(f"label{i}") for i, part in enumerate(labels)],
                F.regexp_count(value, F.lit(pattern)).cast("bigint").alias("n"),
            )
            for *labels, pattern in table
        ]
    )


def include_target(raw: Column) -> tuple[Column, Column]:
    """Bracket and path of an include line; both empty when it names none."""
    return F.regexp_extract(raw, rules.INCLUDE_PATH, 1), F.regexp_extract(raw, rules.INCLUDE_PATH, 2)
