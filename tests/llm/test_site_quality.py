import numpy as np
from pyspark.sql import functions as F

from opslens.llm import site_quality as sq


def test_sparse_sites_shrink_more(spark):
    rows = [("big", None, 0.9)] * 300 + [("tiny", "a", 0.9)] * 2 + [(f"s{i % 40}", None, 0.2 + 0.6 * (i % 7 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "host string, path string, p double")
    got = {r.host: r.rate for r in sq.shrunk_rates(df, ["host"], "p", F.lit(0.3)).collect()}
    assert 0.3 < got["tiny"] < got["big"] < 0.9


def test_like_sites_are_pooled(spark):
    rng = np.random.default_rng(0)
    rows = [(f"s{i % 20}", float(p)) for i, p in enumerate(rng.random(2000) < 0.3)]
    df = spark.createDataFrame(rows, "host string, p double")
    rates = [r.rate for r in sq.shrunk_rates(df, ["host"], "p", F.lit(0.3)).collect()]
    means = [r.m for r in df.groupBy("host").agg(F.avg("p").alias("m")).collect()]
    assert np.std(rates) < 0.5 * np.std(means)


def test_posterior_by_hand(spark, small):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    got = sq.classify(small, labels).toPandas()
    _, rates = sq.train(small, labels, ["quality", "toxic"])
    logit = lambda p: np.log(p / (1 - p))
    for t in ("quality", "toxic"):
        own = 1 / (1 + np.exp(-got[f"evidence_{t}"]))
        want = 1 / (1 + np.exp(-(got[f"evidence_{t}"] + logit(got[f"path_{t}"]) - logit(rates[t]))))
        assert np.allclose(got[t], want)
        # a site's rate lies between the corpus rate and its own mean
        for host, rows in got.groupby("host"):
            mean, rate = own[rows.index].mean(), rows[f"host_{t}"].iloc[0]
            assert min(mean, rates[t]) - 1e-9 <= rate <= max(mean, rates[t]) + 1e-9
    assert (got.kept == ((got.quality >= 0.5) & (got.toxic < 0.5))).all()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(5))
    got = sq.classify(docs, labels.where(part > 0)).toPandas().set_index("doc_id")
    held = labels.where(part == 0).toPandas().set_index("doc_id")
    own = got.loc[held.index]
    assert ((own.quality >= 0.5) == (held.quality == 1)).mean() > 0.97
    assert (own.toxic[held.toxic == 1] >= 0.5).mean() > 0.7
    assert own.kept[(held.toxic == 0) & (held.quality == 1)].mean() > 0.97


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(6, 1, 0), (8, 0, None), (6, 1, 0), (None, 1, 1), (99, 0, 1)], "doc_id bigint, quality int, toxic int")
    got = sq.classify(odd, labels).collect()
    assert len(got) == odd.count()
    assert all(0 < r.quality < 1 and 0 < r.toxic < 1 for r in got)
    assert len({r.quality for r in got if r.doc_id == 6 and r.host == "a"}) == 1
    assert sq.classify(none, labels).count() == 0
    blank = sq.classify(odd, labels.where("1 = 0")).collect()
    assert {r.evidence_quality for r in blank} == {0.0}


def test_own_sites(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"), "url")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    host, path = F.expr("parse_url(url, 'HOST')"), F.expr("substring_index(parse_url(url, 'PATH'), '/', 2)")
    got = sq.classify(pages, labels, host, path, ["quality"])
    assert got.count() == pages.count() and got.where("quality IS NULL").count() == 0
