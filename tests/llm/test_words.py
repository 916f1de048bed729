import re

import numpy as np
import pyarrow as pa

from opslens.llm import words

TEXTS = [None, "", " ", "a", " a  b\x0b\x0cc\r\n", "é x y\x1fz w", "A" * 100, "\n\n", "end "]


def test_words_of_a_column():
    found = words.Words(pa.array(TEXTS))
    want = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in TEXTS]
    values = [v.decode() for v in found.values.to_pylist()]
    assert [values[a:b] for a, b in zip(found.first[:-1], found.first[1:])] == want
    assert found.counts.tolist() == [len(w) for w in want]
    sliced = words.Words(pa.array(TEXTS)[3:7])
    assert [v.decode() for v in sliced.values.to_pylist()] == [w for ws in want[3:7] for w in ws]


def test_pieces_keep_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(list(range(9))), pa.array(TEXTS)], ["i", "text"])
    for limit in (1, 5, 1000):
        parts = list(words.pieces([batch], "text", limit))
        assert [i for p in parts for i in p.column("i").to_pylist()] == list(range(9))


def test_pair_ids():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 9, 500), rng.integers(0, 9, 500)
    ids = words.pair_ids(a, b)
    assert len(set(ids)) == len(set(zip(a, b))) == len(set(zip(a, b, ids)))


def test_mix_is_bijective():
    assert len(np.unique(words.mix64(np.arange(10000)))) == 10000
