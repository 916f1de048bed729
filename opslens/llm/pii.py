"""Personal data: rule spans, and boosted trees that add spans from overlapping candidates.

Base rules find e-mail addresses, IP numbers, cards and phones.  Generators propose many
overlapping spans of the same kinds: every window of digit groups with up to ``MOST_DIGITS`` digits in a run of digits
and separators, and addresses written with blanks, ``(at)`` or ``[dot]``.  Trees learn from the base
rules' verdicts (a rule span is right; its fragments, and whole matches that a rule rejects, are
wrong), using the format of the candidate and its surroundings.  A threshold per kind is set on
all held-back candidates for the wanted precision; what passes and overlaps no chosen span is added.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.llm import boosting
from opslens.llm.shared import written
from opslens.llm.words import pieces

# The kinds in their order and the base patterns.
KINDS = ["email", "ip", "card", "phone"]
DOMAIN = r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

_DOMAIN, _IP, _CARD, _PHONE = (re.compile(p) for p in (DOMAIN, IP, CARD, PHONE))
_RUN = re.compile(r"[+(0-9][0-9()+.\x20-]*[0-9]")
_GROUP = re.compile(r"[0-9]+")
_AT = re.compile(r"\x20?(?:@|\(at\)|\[at\])\x20?", re.IGNORECASE)
_LOOSE_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]+)+", re.IGNORECASE)
_HINTS = [
    re.compile(p, re.IGNORECASE)
    for p in (r"mail|contact|write", r"\bip\b|host|server|address", r"card|visa|credit|account", r"phone|tel|call|fax|mobile")
]
MOST_DIGITS = 19
#: Candidates that are taken for the trees, at most about.
SAMPLE = 20_000
SPOTS = 1 << 40
#: Held-back margins are counted in bins; powers of two, so that a bin's border is exact.
MARGIN_BINS, MOST_MARGIN = 1024, 32
PRECISION = 0.98
Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else (2 * n if n < 5 else 2 * n - 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local part, ``@`` and domain, in one pass over the ``@`` signs."""
    out, at_least = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > at_least and text[start - 1] in LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        at_least = found.end() if found else at + 1
        if found:
            out.append((start, at_least))
        at = text.find("@", at_least)
    return out


def base_matches(text: str) -> tuple[list[Span], list[Span]]:
    """The base rules' spans, and the matches that they reject."""
    right, wrong = [(0, a, b) for a, b in emails(text)], []
    for m in _IP.finditer(text):
        good = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))
        (right if good else wrong).append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = _digits(m.group())
        if len(digits) >= 13:
            (right if len(digits) <= 19 and luhn(digits) else wrong).append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        good = 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15
        (right if good else wrong).append((3, m.start(), m.end()))
    return right, wrong


def candidates(text: str) -> Iterator[Span]:
    """Overlapping proposals of all kinds; their number is linear in the text."""
    for m in _AT.finditer(text) if "@" in text or "at)" in text.lower() or "at]" in text.lower() else ():
        start = m.start()
        while start and text[start - 1] in LOCAL:
            start -= 1
        domain = _LOOSE_DOMAIN.match(text, m.end())
        if start < m.start() and domain:
            yield 0, start, domain.end()
    for run in _RUN.finditer(text):
        if run.end() - run.start() < 7:
            continue
        groups = [(g.start(), g.end()) for g in _GROUP.finditer(text, run.start(), run.end())]
        for i, (start, _) in enumerate(groups):
            digits = 0
            for j in range(i, len(groups)):
                digits += groups[j][1] - groups[j][0]
                if digits > MOST_DIGITS:  # a group has a digit at least, so a window has as many groups at most
                    break
                end = groups[j][1]
                between = [text[groups[k][1] : groups[k + 1][0]] for k in range(i, j)]
                if j - i == 3 and all(s == "." for s in between):
                    yield 1, start, end
                if digits >= 13 and all(s in " -" for s in between):
                    yield 2, start, end
                if 9 <= digits <= 15:
                    low = start
                    while low > run.start() and text[low - 1] in "+(":
                        low -= 1
                    yield 3, low, end


def _kind_of_char(text: str, at: int) -> int:
    if at < 0 or at >= len(text) or text[at].isspace():
        return 0
    c = text[at]
    return 2 if c.isdigit() else 1 if c.isalpha() else 3


FEATURES = 22


def features(text: str, span: Span) -> list[float]:
    """Format and context of a candidate."""
    kind, start, end = span
    part = text[start:end]
    groups = _GROUP.findall(part)
    sizes = [len(g) for g in groups] or [0]
    digits = "".join(groups)
    separators = [c for c in part if not c.isalnum()]
    before = text[max(0, start - 24) : start]
    return [
        float(x)
        for x in (
            kind,
            len(digits),
            end - start,
            len(groups),
            sizes[0],
            sizes[-1],
            max(sizes),
            min(sizes),
            part.count(" "),
            part.count("-"),
            part.count("."),
            part.count("("),
            part.count("(") == part.count(")"),
            part[0] == "+",
            "@" in part,
            kind == 2 and luhn(digits),
            kind == 1 and all(len(g) <= 3 and int(g) <= 255 for g in groups),
            len(set(separators)),
            _kind_of_char(text, start - 1),
            _kind_of_char(text, end),
            text[start - 1 : start] in ("+", "(", "-", "."),
            bool(_HINTS[kind].search(before)),
        )
    ]


def labelled(text: str) -> tuple[list[Span], list[tuple[Span, int]]]:
    """Base spans, and the other candidates: 1 right, 0 wrong, -1 unknown."""
    right, wrong = base_matches(text)
    base, rejected = set(right), set(wrong)
    out = []
    seen = set()
    ends = {k: [s[2] for s in right if s[0] == k] for k in range(len(KINDS))}
    starts = {k: [s[1] for s in right if s[0] == k] for k in range(len(KINDS))}
    for span in candidates(text):
        if span in seen:
            continue
        seen.add(span)
        if span in base:
            label = 1
        elif span in rejected:
            label = 0
        else:
            kind, start, end = span
            before = bisect_left(starts[kind], end) - 1  # spans of a kind don't overlap
            label = 0 if before >= 0 and ends[kind][before] > start else -1
        out.append((span, label))
    return sorted(right), out


def shown(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
_CANDIDATE = pa.struct(
    [("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("label", pa.int32()), ("x", pa.list_(pa.float32()))]
)
_FOUND_DDL = (
    "base array<struct<kind:int,start:bigint,end:bigint>>, "
    "found array<struct<kind:int,start:bigint,end:bigint,label:int,x:array<float>>>"
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "__text"):
        base, found = [], []
        for text in batch.column("__text").to_pylist():
            right, others = labelled(text) if text else ([], [])
            base.append([dict(zip(("kind", "start", "end"), s)) for s in right])
            found.append(
                [dict(zip(("kind", "start", "end"), s)) | {"label": label, "x": features(text, s)} for s, label in others]
            )
        keep = [i for i, n in enumerate(batch.schema.names) if n != "__text"]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(i) for i in keep], pa.array(base, pa.list_(_SPAN)), pa.array(found, pa.list_(_CANDIDATE))],
            [*[batch.schema.names[i] for i in keep], "base", "found"],
        )


def scan(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Base spans and labelled candidates of every text, beside the columns ``keep``."""
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text")
    return rows.mapInArrow(_scan, f"{kinds}, {_FOUND_DDL}")


@dataclass
class Detector:
    """Trees and a margin per kind; without enough labelled candidates it adds nothing."""

    trees: boosting.Trees | None
    least: list[float]

    def add(self, base: list[Span], found: list[Span], x: np.ndarray) -> list[Span]:
        """The base spans and the best candidates that overlap no chosen span."""
        chosen = list(base)
        if self.trees is None or not len(found):
            return chosen
        margin = self.trees.margin(x)
        taken = bytearray(max(s[2] for s in [*base, *found]))
        for _, start, end in base:
            taken[start:end] = b"\1" * (end - start)
        for i in np.argsort(-margin, kind="stable"):
            kind, start, end = found[i]
            if margin[i] >= self.least[kind] and not any(taken[start:end]):
                taken[start:end] = b"\1" * (end - start)
                chosen.append(found[i])
        return chosen


def _shares(counts: dict[int, int], sample: int) -> dict[int, float]:
    """The share of each kind's candidates to take: rare kinds whole, the others alike, ``sample`` in all."""
    out, room = {}, sample
    for place, (kind, count) in enumerate(sorted(counts.items(), key=lambda c: (c[1], c[0]))):
        take = min(count, room // (len(counts) - place))
        out[kind] = take / max(count, 1)
        room -= take
    return out


def _bins(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("x").flatten(), np.float32).reshape(-1, FEATURES)
            low = np.floor(sent.value.margin(x) * MARGIN_BINS) if len(x) else np.empty(0)
            last = MOST_MARGIN * MARGIN_BINS
            bins = pa.array(np.clip(low, -last, last).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("kind"), bins, batch.column("label")], ["kind", "bin", "label"])

    return run


def fit(scanned: DataFrame, sample: int = SAMPLE, precision: float = PRECISION) -> Detector:
    """Learn from the labelled candidates, split by hash of their row's key and place.

    Of seven tenths at most about ``sample``, shared out among the kinds, grow the trees; all of the other three
    tenths are counted by kind, margin and label, and set each kind's margin.
    """
    key = F.xxhash64(*[F.col(c) for c in scanned.columns if c not in ("base", "found")])
    rows = scanned.select(key.alias("row"), F.explode("found").alias("c")).select("row", "c.*").where("label >= 0")
    spot = F.pmod(F.xxhash64("row", "start", "end", "kind"), F.lit(10 * SPOTS))
    rows = rows.select("kind", "label", "x", (spot % 10).alias("part"), F.floor(spot / 10).alias("spot"))
    totals = {r["kind"]: r["count"] for r in rows.groupBy("kind").count().collect()}
    wanted = F.lit(False)
    for kind, share in _shares(totals, sample).items():
        wanted = wanted | ((F.col("kind") == kind) & (F.col("spot") < int(share * SPOTS)))
    grow = rows.where((F.col("part") < 7) & wanted).select("kind", "label", "x", "part")
    data = grow.orderBy("part", "kind", "label", "x").toArrow()  # the same order in every run
    y = data.column("label").to_numpy().astype(float)
    if len(y) < 35 or len(set(y)) < 2:
        return Detector(None, [float("inf")] * len(KINDS))
    trees = boosting.fit(np.array(data.column("x").to_pylist(), np.float32), y)
    sent = scanned.sparkSession.sparkContext.broadcast(trees)
    held = rows.where("part >= 7").select("kind", "label", "x").mapInArrow(_bins(sent), "kind int, bin bigint, label int")
    # one row a kind and bin, however many candidates there are
    counts = held.groupBy("kind", "bin").agg(F.sum("label").alias("right"), F.count("*").alias("taken")).toArrow()
    kind, low, right, taken = (counts.column(c).to_numpy() for c in ("kind", "bin", "right", "taken"))
    least = [
        boosting.threshold(low[kind == k] / MARGIN_BINS, right[kind == k], precision, count=taken[kind == k])
        for k in range(len(KINDS))
    ]
    return Detector(trees, [max(m, 0.0) for m in least])


def _finish(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = sent.value
        for batch in batches:
            keep = [i for i, n in enumerate(batch.schema.names) if n not in ("base", "found")]
            counts, sums, spans = [], [], []
            for base, found in zip(batch.column("base").to_pylist(), batch.column("found").to_pylist()):
                right = [(s["kind"], s["start"], s["end"]) for s in base]
                others = [(s["kind"], s["start"], s["end"]) for s in found]
                x = np.array([s["x"] for s in found], np.float32)
                every = detector.add(right, others, x)
                counts.append([sum(s[0] == k for s in right) for k in range(len(KINDS))])
                sums.append(hashlib.sha256(shown(right).encode()).hexdigest())
                spans.append(shown(every))
            table = np.array(counts, np.int64).reshape(-1, len(KINDS))
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in keep]
                + [pa.array(table[:, k]) for k in range(len(KINDS))]
                + [pa.array(sums, pa.string()), pa.array(spans, pa.string())],
                [batch.schema.names[i] for i in keep] + [f"n_{k}" for k in KINDS] + ["base_sha256", "spans"],
            )

    return run


def find_pii(docs: DataFrame, sample: int = SAMPLE, precision: float = PRECISION) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of every document.

    Spans are ``kind:start:end`` in code points.  Null and empty texts have none; repeated rows get
    the same spans; an empty table gives no rows; further columns are ignored.
    """
    scanned = written(scan(docs, ["doc_id"]), "pii")
    detector = docs.sparkSession.sparkContext.broadcast(fit(scanned, sample, precision))
    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    return scanned.mapInArrow(_finish(detector), f"doc_id {kind}, {counts}, base_sha256 string, spans string")


def redact(text: str, spans: str) -> str:
    """The text with every span replaced by its kind in brackets, e.g. ``[phone]``."""
    out, at = [], 0
    parts = [s.split(":") for s in spans.split(",") if s]
    for kind, start, end in sorted(((k, int(a), int(b)) for k, a, b in parts), key=lambda s: (s[1], -s[2])):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])
