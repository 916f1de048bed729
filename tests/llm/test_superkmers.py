import hashlib

import pytest

from opslens.llm import superkmers


def brute(rows, window):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in sorted(words, key=lambda r: superkmers.LAST if r[0] is None else r[0]):
        for a in range(len(w) - window + 1):
            first.setdefault(tuple(w[a : a + window]), superkmers.LAST if i is None else i)
    out = []
    for i, w in words:
        keep = [True] * len(w)
        for a in range(len(w) - window + 1):
            if first[tuple(w[a : a + window])] < (superkmers.LAST if i is None else i):
                keep[a : a + window] = [False] * window
        left = b" ".join(x for x, k in zip(w, keep) if k)
        out.append((i, len(w), len(w) - sum(keep), hashlib.sha256(left).hexdigest(), left.decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window,hot", [(50, 20_000), (50, 2), (8, 3), (5, 20_000), (3, 1), (2, 20_000)])
def test_against_brute(small, window, hot):
    got = superkmers.remove_repeats(small, window, with_text=True, hot=hot).collect()
    rows = [(r.doc_id, r.text) for r in small.collect()]
    assert sorted(map(tuple, got), key=repr) == brute(rows, window)


def test_small_alphabet(spark):
    import random

    draw = random.Random(2)
    rows = [(i % 37, " ".join(draw.choice("ab") for _ in range(draw.randint(0, 60)))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for window in (4, 7):
        got = superkmers.remove_repeats(docs, window, with_text=True, hot=5).collect()
        assert sorted(map(tuple, got), key=repr) == brute(rows, window)


def test_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = superkmers.remove_repeats(odd, with_text=True).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 50)
    assert superkmers.remove_repeats(none).count() == 0
