import hashlib
from collections import Counter

import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from opslens.llm import cross_align, tables, units

PATHS = tables.vocabulary_path("byte_bpe_50k.json"), tables.vocabulary_path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "a", "one two  three\n\n four \n", "It's <|endoftext|> don't", "literal ▁ sign", "Ünïcode Été 日本語 🙂🙂 x",
    " nb 　 x  y", "same words again and again " * 30, "\x00 nul", "x" * 3000, "ends in space ", "\t\ttabs\t here",
]


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=PATHS[1])


def brute(texts, both):
    """Whole texts, token by token."""
    a_lib, b_lib = both
    symbols = units.byte_symbols()
    a_octets = {i: bytes(symbols[c] for c in t) for t, i in a_lib.get_vocab().items() if i != 50256}
    piece = lambda i: bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode()
    docs = []
    for text in texts:
        raw = (" " + (text or "")).encode()
        a = a_lib.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = b_lib.encode(text) if text else []
        if not text or b"".join(a_octets[i] for i in a) != raw or b"".join(map(piece, b)) != raw:
            docs.append(None)
            continue
        sides = []
        for ids, octets in ((a, a_octets.get), (b, piece)):
            at, spans = 0, []
            for i in ids:
                spans.append((at, at + len(octets(i)), i))
                at = spans[-1][1]
            sides.append(spans)
        cuts = sorted({e for _, e, _ in sides[0]} & {e for _, e, _ in sides[1]})
        groups, at = [], [0, 0]
        for cut in cuts:
            group = [[], []]
            for k, side in enumerate(sides):
                while at[k] < len(side) and side[at[k]][0] < cut:
                    group[k].append(side[at[k]][2])
                    at[k] += 1
            groups.append(group)
        links = []
        j = 0
        for s, e, i in sides[0]:
            while sides[1][j][1] <= s:
                j += 1
            k = j
            while k < len(sides[1]) and sides[1][k][0] < e:
                links.append((i, sides[1][k][2]))
                k += 1
        docs.append((len(a), len(b), groups, links))
    counts = Counter(p for d in docs if d for p in set(d[3]))
    most = {}
    for (a, _), n in counts.items():
        most[a] = max(most.get(a, 0), n)
    rows = []
    for d in docs:
        if d is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        spelled = ";".join("|".join(",".join(map(str, side)) for side in g) for g in d[2])
        best = sum(counts[p] == most[p[0]] for p in d[3])
        total = sum(counts[p] for p in d[3])
        rows.append((d[0], d[1], len(d[2]), len(d[3]), best, total, hashlib.sha256(spelled.encode()).hexdigest()))
    return rows, docs, counts


def columns(row):
    return tuple(row[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))


@pytest.mark.parametrize("chunk, links", [(200, 1), (8 << 20, 500)])
def test_equals_brute_force(spark, both, monkeypatch, chunk, links):
    monkeypatch.setattr(cross_align, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(cross_align, "SLICE_LINKS", links)
    monkeypatch.setattr(cross_align, "UNITS", 100 * links)
    corpus = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id % 20 = 3").collect()]
    texts = TEXTS + corpus
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    want, _, _ = brute(texts, both)
    got = {r["doc_id"]: columns(r) for r in cross_align.align_documents(docs, *PATHS).collect()}
    assert len(got) == len(texts)
    for i, row in enumerate(want):
        assert got[i] == row, texts[i]


def test_groups_and_counts_as_tables(spark, both):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").repartition(2)
    _, parsed, counts = brute(TEXTS, both)
    got = {r["doc_id"]: list(zip(r["a_ids"], r["b_ids"])) for r in cross_align.alignments(docs, *PATHS).collect()}
    assert got == {i: [tuple(g) for g in d[2]] if d else [] for i, d in enumerate(parsed)}
    found = {(r["a_id"], r["b_id"]): r["n_docs"] for r in cross_align.link_table(docs, *PATHS).collect()}
    assert found == dict(counts)


def test_coalescing():
    import numpy as np

    a, b = np.array([0, 2, 3, 7]), np.array([0, 1, 3, 5])
    groups = cross_align.coalesce(a, np.array([2, 3, 7, 8]), b, np.array([1, 3, 5, 8]))
    assert [g.tolist() for g in groups] == [[0, 0, 1, 1], [0, 0, 1, 1]]
    left, right = cross_align.overlaps(a, np.array([2, 3, 7, 8]), b, np.array([1, 3, 5, 8]))
    assert list(zip(left, right)) == [(0, 0), (0, 1), (1, 1), (2, 2), (2, 3), (3, 3)]


def test_units_of_white_space_are_encoded_alone(both):
    with open(PATHS[0], encoding="utf-8") as a:
        encoder = cross_align.ByteEncoder(a.read())
    values = [b" a \n", b" b", b"   ", b" c\xc2\xa0", b" d"]
    ids, lengths = encoder.encode_units(pa.array(values, pa.large_binary()))
    want = [both[0].encode(v.decode(), add_special_tokens=False).ids for v in values]
    assert lengths.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])


def test_odd_rows(odd, none, both):
    rows = odd.select("doc_id", "text").collect()
    want, _, _ = brute([r["text"] for r in rows], both)
    got = cross_align.align_documents(odd, *PATHS).collect()
    assert sorted((r["doc_id"] or 0, *columns(r)) for r in got) == sorted((r["doc_id"] or 0, *w) for r, w in zip(rows, want))
    assert cross_align.align_documents(none, *PATHS).count() == 0
    assert cross_align.alignments(none, *PATHS).count() == 0
