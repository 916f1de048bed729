import random
import re
from collections import Counter

import pytest

from opslens.llm import collocations


def brute(rows, least, longest, share, top):
    """Counts of all phrases of all pieces, by language."""
    langs = {}
    for lang, text in rows:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        counts = langs.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            for size in range(1, longest + 1):
                counts.update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, counts in langs.items():
        n = sum(c for p, c in counts.items() if len(p) == 1)
        found = {p: c for p, c in counts.items() if len(p) > 1 and c >= least}
        kept = []
        for p, a in found.items():
            inside = (q for q in found if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))))
            if any(100 * found[q] >= share * a for q in inside):
                continue
            score, _, left, right = min(
                (1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p))
            )
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def check(spark, rows, chunk, monkeypatch, **options):
    monkeypatch.setattr(collocations, "CHUNK_BYTES", chunk)
    options = {"least": 10, "longest": 3, "share": 50, "top": 2000} | options
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = sorted(map(tuple, collocations.collocations(docs, **options).collect()))
    assert got == brute(rows, **options)
    return got


@pytest.mark.parametrize("chunk, longest, kinds", [(8 << 20, 2, 8), (60, 3, 8), (300, 5, 2)])
def test_equals_brute_force(spark, monkeypatch, chunk, longest, kinds):
    rng = random.Random(longest)
    words = ["a", "B", "c", "dd", "é", "日本", "X-1", "#"][:kinds]
    joins = [" "] * 12 + ["\t", "  ", ", ", ".", "\n", "\r\n", "\x0b", "? ", " "]
    texts = [
        (rng.choice(["en", "de", None, "und", ""]), "".join(rng.choice(words) + rng.choice(joins) for _ in range(rng.randrange(60))))
        for _ in range(60)
    ]
    found = check(spark, texts, chunk, monkeypatch, longest=longest, least=4, top=60)
    assert len({r[0] for r in found}) >= 3 and max(len(r[2].split(" ")) for r in found) == longest


def test_one_phrase_everywhere(spark, monkeypatch):
    rows = [("en", "the same words " * 300)] * 40 + [("en", f"own{i} words {i}") for i in range(200)]
    check(spark, rows, 4000, monkeypatch)


def test_ties_and_overlaps(spark, monkeypatch):
    # equal scores: count, then bytes of the phrase; "a a a" holds "a a" twice
    rows = [("en", "b a. c d. B a. z y. é y. a a a a.")] * 12
    check(spark, rows, 8 << 20, monkeypatch, top=3)


def test_products_beyond_64_bits(spark):
    row = spark.sql(
        "SELECT 4000000000000L AS f, array(5000000000000L, 4000000000000L) AS heads, array(4000000000001L, 4000000000000L) AS tails"
    )
    got = row.select(collocations._lowest_cut(2).alias("c")).first()["c"]
    assert got["score"] == 10**6 * (4 * 10**12) ** 2 // (5 * 10**12 * 4000000000001)


def test_odd_rows(odd, none, spark, monkeypatch):
    rows = [(r["lang"], r["text"]) for r in odd.collect()]
    got = sorted(map(tuple, collocations.collocations(odd).collect()))
    assert got == brute(rows, 10, 3, 50, 2000)
    assert collocations.collocations(none).count() == 0
    assert check(spark, [("en", None), (None, ""), ("de", " . ,\t")], 100, monkeypatch) == []
