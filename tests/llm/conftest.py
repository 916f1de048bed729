import pytest

ODD_TEXTS = [
    (1, None, None, None),
    (2, "", "en", "b"),
    (3, " \t\r\n\x0b\x0c ", "en", "a"),
    (4, "one", "en", "a"),
    (5, "One two three \x1f four", None, "é"),
    (6, "same words here and there " * 40, "en", "a"),
    (6, "same words here and there " * 40, "en", "a"),
    (7, "same words here and there " * 40, "en", "z"),
    (None, "no id but words " * 20, "de", None),
    (8, "long " * 30_000 + "end", "en", "a"),
    (9, "日本語のテキスト 🙂 ünï " * 30, "ja", "b"),
    (-5, "negative id words " * 30, "en", "b"),
]
CLASHES = ["n", "words", "key", "id", "size", "shard", "bits", "target", "spans", "token", "component", "low", "rank", "path"]
CLASHES += ["__id", "__gone", "__rank", "__take", "__takes", "__c0", "__text", "__lang", "chunk", "bucket", "ids"]


@pytest.fixture
def odd(spark):
    """Nulls, empty, long and repeated texts, with further columns named like inner and result columns."""
    names = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in CLASHES)
    rows = [(*r, len(r[1] or ""), *["x"] * len(CLASHES)) for r in ODD_TEXTS]
    return spark.createDataFrame(rows, names).repartition(3)


@pytest.fixture
def none(odd):
    return odd.where("1 = 0")


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
