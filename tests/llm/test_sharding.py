import zlib

from pyspark.sql import functions as F

from opslens.llm import sharding


def test_growth_moves_only_into_the_new_shard(spark):
    rows = spark.range(4000).withColumn("key", F.col("id").cast("string"))
    got = sharding.assign(rows, F.col("key"), [1.0] * 10, "shard", "grown").toPandas()
    moved = got[got.shard != got.grown]
    assert (moved.grown == 10).all() and 250 < len(moved) < 480
    sizes = got.groupby("shard").size()
    assert len(sizes) == 10 and sizes.min() > 320 and sizes.max() < 480
    again = sharding.assign(rows.repartition(5), F.col("key"), [1.0] * 11).toPandas().set_index("id").shard
    assert (again.sort_index() == got.set_index("id").grown.sort_index()).all()


def test_weights(spark):
    rows = spark.range(6000).withColumn("key", F.col("id").cast("string"))
    sizes = sharding.assign(rows, F.col("key"), [1.0, 2.0, 3.0]).groupBy("shard").count().toPandas().set_index("shard")["count"]
    assert abs(sizes[0] - 1000) < 150 and abs(sizes[1] - 2000) < 200 and abs(sizes[2] - 3000) < 200


def test_odd_rows(odd, none):
    got = sharding.shard_documents(odd).collect()
    assert len(got) == odd.count()
    want = sorted(
        (len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for t in [r.text for r in odd.select("text").collect()]
    )
    assert sorted((r["size"], r["text_crc32"]) for r in got) == want
    for shard in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert len({r.shard for r in got if r.doc_id == 6}) == 1
    assert sharding.shard_documents(none).count() == 0
    kept = sharding.assign(odd, sharding.key_text(F.col("doc_id")), [1.0, 1.0], "shard")
    assert sorted(kept.columns) == sorted(odd.columns)


def test_key_parts_do_not_run_together(spark):
    rows = spark.createDataFrame([("a", "b:1=c"), ("a:5=b", "c"), (None, "c"), ("~", "c")], "x string, y string")
    keys = [r[0] for r in rows.select(sharding.key_text(F.col("x"), F.col("y"))).collect()]
    assert len(set(keys)) == 4


def test_written_shards_are_whole(spark, odd, tmp_path):
    path = str(tmp_path / "shards")
    sharding.write_sharded(odd.drop("shard"), path, sharding.key_text(F.col("doc_id")), [1.0, 1.0])
    back = spark.read.parquet(path)
    assert back.count() == odd.count() and {r.shard for r in back.select("shard").distinct().collect()} <= {0, 1}
