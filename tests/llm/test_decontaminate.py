import random

import numpy as np
import pyarrow as pa
import pytest

from opslens.llm import decontaminate as dc

ITEMS = [
    "The quick brown fox jumps over the lazy dog while seven wizards boil potions in a copper kettle.",
    "Éléphants et girafes marchent ensemble vers la rivière où les crocodiles attendent leur déjeuner.",
    "short text of ten",
    "A second, much longer passage that tells of a small town by the sea, its harbour, the fishermen who leave "
    "before dawn, the market on the square and the clock that has been wrong for as long as anyone remembers.",
]


def plain(text):
    data, offsets, _ = dc.normal(*dc.text_bytes(pa.array([text], pa.large_string())))
    return data.tobytes()


def sellers(item, text):
    """Least edits of the item in any part of the text, row by row."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def edited(draw, text, edits):
    x = list(text)
    for _ in range(edits):
        kind, at = draw.randrange(3), draw.randrange(len(x))
        if kind == 0:
            x[at] = draw.choice("abcxyz")
        elif kind == 1 and len(x) > 1:
            del x[at]
        else:
            x.insert(at, draw.choice("abcxyz"))
    return "".join(x)


def test_against_full_alignment():
    """Every pair within the budget is found, nothing else is, and edits agree."""
    draw = random.Random(3)
    filler = lambda n: " ".join(draw.choice("over the town copper dog sea lazy vers la a in that clock".split()) for _ in range(n))
    index = dc.Index.build(list(range(len(ITEMS))), ITEMS)
    table = index.filter()
    texts = []
    for n in range(120):
        item = draw.choice(ITEMS)
        texts.append(filler(draw.randint(0, 12)) + draw.choice(["", " "]) + edited(draw, item, draw.randint(0, len(item) // 7)) + " " + filler(draw.randint(0, 12)))
    found = dc.find(index, table, pa.array(texts))
    got = {}
    for text, item, _, _, edits in found:
        got[text, item] = min(edits, got.get((text, item), 999))
    want = {}
    for t, text in enumerate(texts):
        for i, item in enumerate(ITEMS):
            least = sellers(plain(item), plain(text))
            if least <= index.budget[i]:
                want[t, i] = least
    assert got == want and len(want) > 40


def test_region_and_case():
    index = dc.Index.build([7], [ITEMS[1]])
    text = "ééé 🙂  " + ITEMS[1].upper().replace(" ", "  \n") + " fin"
    (row,) = dc.find(index, index.filter(), pa.array([None, "", text]))
    assert row[0] == 2 and row[4] == 0
    assert text[row[2] : row[3]] == ITEMS[1].upper().replace(" ", "  \n")


def test_two_places_and_edges():
    index = dc.Index.build([0, 1], [ITEMS[0], ITEMS[0]])
    rows = dc.find(index, index.filter(), pa.array([ITEMS[0] + ITEMS[0], ITEMS[0][:60], ITEMS[0][60:], ITEMS[0][:-3]]))
    assert [r[:2] for r in rows] == [(0, 0), (0, 0), (0, 1), (0, 1), (3, 0), (3, 1)]


def test_align_columns():
    items = [np.frombuffer(b"abcdef", np.uint8), np.frombuffer(b"xyz", np.uint8)]
    texts = [np.frombuffer(b"--abXdef--", np.uint8).astype(np.int16), np.frombuffer(b"xyxyz", np.uint8).astype(np.int16)]
    out = dc.align(items, texts, np.array([5, 4]), np.array([3, 1]))
    assert out.tolist() == [[1, 2, 8], [0, 2, 5]]


@pytest.fixture
def benchmark(spark):
    rows = [(i, t) for i, t in enumerate(ITEMS)] + [(90, None), (91, ""), (92, "tiny"), (93, ITEMS[0]), (None, ITEMS[3])]
    return spark.createDataFrame(rows, "item_id bigint, text string")


def test_tables(spark, odd, none, benchmark, monkeypatch):
    extra = spark.createDataFrame([(500, "x " + ITEMS[0]), (501, "y " + ITEMS[3] + " z"), (501, "y " + ITEMS[3] + " z")], "doc_id bigint, text string")
    docs = odd.unionByName(extra, allowMissingColumns=True)
    found = sorted((r.doc_id, r.item_id if r.item_id is not None else -1) for r in dc.contaminated(docs, benchmark).collect())
    assert found == [(500, 0), (500, 93), (501, -1), (501, -1), (501, 3), (501, 3)]
    monkeypatch.setattr(dc, "BLOCK_BYTES", 150)  # several blocks
    assert dc.contaminated(docs, benchmark).count() == 6
    kept = dc.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == odd.count()
    assert dc.contaminated(none, benchmark).count() == 0
    assert dc.contaminated(docs, benchmark.where("1 = 0")).count() == 0
    assert dc.drop_contaminated(docs, benchmark.where("1 = 0")).count() == docs.count()


def test_whole_table(spark, small):
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = benchmark.collect()
    exact = {(d.doc_id, i.item_id) for d in small.collect() for i in items if i.text.lower() in d.text.lower()}
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(small, benchmark).collect()}
    assert exact <= got and exact
    assert len(got - exact) <= 1
