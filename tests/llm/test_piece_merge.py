import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor

from opslens.llm import agenda, piece_merge, tables

MODEL = "piece_bpe_32k.model"
ODD = [
    None, "", " ", "  ", "\n", "a", "hello world", "  two  spaces ", "▁ literal ▁▁sign", " ▁", "<s> <0x41> </s> <unk>",
    "日本語のテキスト 🙂🙂 ﬁ" * 30, "x" * 5000, "aaaaaaaaab" * 40, "\x00 a\x00b", "tab\tx\t y", "  nb 　 x  y  z",
    "word " * 3000, "é é combining " * 5, " a" * 100 + "  ", "ab" * 24, "ab" * 25,
]


@pytest.fixture(scope="module")
def encoder():
    with open(tables.vocabulary_path(MODEL), "rb") as file:
        return piece_merge.PieceEncoder(file.read())


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=tables.vocabulary_path(MODEL))


def test_equals_the_library(encoder, library):
    rng = random.Random(5)
    letters = "ab e▁ \n\té日🙂 thinger "
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(90))) for _ in range(5000)]
    ids, lengths = encoder.encode(pa.array(texts, pa.string()))
    mine = [p.tolist() for p in np.split(ids, np.cumsum(lengths)[:-1])]
    assert mine == library.encode([t or "" for t in texts])
    assert encoder.decode(ids, lengths) == [library.decode(i) for i in mine]


@pytest.mark.parametrize("matrix", [1, 7])
def test_small_matrices_and_heaps_agree(encoder, library, monkeypatch, matrix):
    texts = [t or "" for t in ODD]
    monkeypatch.setattr(agenda, "MATRIX", matrix * 50)
    monkeypatch.setattr(agenda, "LONG", matrix)
    monkeypatch.setattr(piece_merge, "LONG", matrix)
    ids, lengths = encoder.encode(pa.array(texts))
    assert [p.tolist() for p in np.split(ids, np.cumsum(lengths)[:-1])] == library.encode(texts)


def test_agenda_takes_the_leftmost_of_equal_ranks():
    # "aa" beats nothing else, so odd runs leave their last letter
    pairs = agenda.PairTable(*(np.array(x) for x in ([1], [1], [2], [0])))
    for n in (2, 3, 7):
        for merge in (lambda s, a: pairs._matrix(s, a, np.array([0]), n), lambda s, a: pairs._heap(s, a, 0, n)):
            symbols, alive = np.ones(n, np.int32), np.ones(n, bool)
            merge(symbols, alive)
            assert symbols[alive].tolist() == [2] * (n // 2) + [1] * (n % 2)


def test_no_difference_on_all_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert piece_merge.differences(docs, tables.vocabulary_path(MODEL)).count() == 0


def test_digests_and_round_trip(spark, odd, library):
    path = tables.vocabulary_path(MODEL)
    got = sorted(map(tuple, piece_merge.digest_documents(odd, path).collect()), key=repr)
    want = []
    for row in odd.select("doc_id", "text").collect():
        ids = library.encode(row["text"] or "")
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want.append((row["doc_id"], len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids))))
    assert got == sorted(want, key=repr)
    decoded = piece_merge.decode_documents(piece_merge.encode_documents(odd, path), path)
    texts = [(r["doc_id"], r["text"] or "") for r in odd.select("doc_id", "text").collect()]
    assert sorted(map(tuple, decoded.collect()), key=repr) == sorted(texts, key=repr)


def test_no_rows(none):
    path = tables.vocabulary_path(MODEL)
    assert piece_merge.digest_documents(none, path).count() == 0
    assert piece_merge.decode_documents(piece_merge.encode_documents(none, path), path).count() == 0


def test_other_vocabularies_are_refused():
    from sentencepiece import sentencepiece_model_pb2 as proto

    with open(tables.vocabulary_path(MODEL), "rb") as file:
        spec = proto.ModelProto.FromString(file.read())
    spec.trainer_spec.model_type = 1
    with pytest.raises(ValueError):
        piece_merge.PieceEncoder(spec.SerializeToString())
