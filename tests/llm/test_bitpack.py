import io
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from opslens.llm import bitpack, tables

ODD = [
    None,
    "",
    "  \t\n ",
    "It's <|endoftext|> don't x<|startoftext|>y <|end| we'll O'Neil''s",
    "Ünïcode Été ÉTÉ ça×b c÷d naïve été Å NBSP sep 日本語テキスト 🙂🙂 ﬁ",
    "a1b22c333 ... !!! a.b,c;d (x) $%& 3.14 mid\x00nul \x1funit",
    "THE the The tHe. the, the's",
    "İstanbul ΣΑΣ ẞtraße H̱ KK",
    "x" * 5000,
    "word " * 3000,
]


@pytest.fixture(scope="module")
def vocabulary():
    with open(tables.vocabulary_path(), encoding="utf-8") as file:
        return file.read()


@pytest.mark.parametrize("width", [1, 3, 7, 8, 16, 17, 31, 32])
def test_pack_round_trip(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1001).astype(np.uint32)
    data = bitpack.pack(ids, width)
    assert len(data) == -(-1001 * width // 8)
    assert (bitpack.unpack(data, width, 1001) == ids).all()


def test_width():
    assert [bitpack.width_of(n) for n in (1, 2, 3, 49408, 65536, 65537)] == [1, 1, 2, 16, 16, 17]


def test_random_access(tmp_path):
    docs = [np.arange(n, dtype=np.uint32) % 500 for n in (0, 1, 99, 100, 101, 1000, 0, 7)]
    path = str(tmp_path / "x.bits")
    from pyarrow import fs

    store = fs.LocalFileSystem()
    with store.open_output_stream(path) as out:
        writer = bitpack.BitWriter(out, 9, 100)
        for i, d in enumerate(docs):
            writer.add(np.array([i]), np.array([0]), np.array([len(d)]), d)
        writer.close()
    with store.open_input_file(path) as source:
        reader = bitpack.BitReader(source)
        for i, d in enumerate(docs):
            assert (reader.document(i) == d).all()
        every = np.concatenate(docs)
        for a, b in [(0, 1308), (99, 101), (100, 200), (5, 5), (1300, 1308)]:
            assert (reader.range(a, b) == every[a:b]).all()


def test_encoder_equals_whole_texts(vocabulary, spark):
    whole = Tokenizer.from_str(vocabulary)
    texts = ODD + [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    encoder = bitpack.Encoder(vocabulary)
    for _ in range(2):  # the second time from memory
        ids, lengths = encoder.encode(pa.array(texts))
        got = np.split(ids, np.cumsum(lengths)[:-1])
        for text, mine in zip(texts, got):
            assert mine.tolist() == whole.encode(text or "", add_special_tokens=False).ids, text


def test_documents(spark, vocabulary):
    rows = [(i * 7 % 10, t, "x") for i, t in enumerate(ODD)] + [(None, "no id", "x"), (3, "again", "y"), (3, "again", "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string").repartition(3)
    got = sorted(map(tuple, bitpack.pack_documents(docs, tables.vocabulary_path()).collect()), key=lambda r: r[1])
    whole = Tokenizer.from_str(vocabulary)
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    want, start = [], 0
    for doc_id, text, _ in rows:
        ids = np.array(whole.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        want.append((doc_id, len(ids), zlib.crc32(ids.tobytes())))
    assert sorted(((r[0], r[2], r[3]) for r in got), key=repr) == sorted(want, key=repr)
    for row in got:
        assert row[1] == start
        start += row[2]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert bitpack.pack_documents(docs, tables.vocabulary_path()).count() == 0
