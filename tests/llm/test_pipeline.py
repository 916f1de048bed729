import re

import corpus_pipeline
from opslens.llm import bitpack, decontaminate, jaccard_join, mixing, perplexity, tables

SF_DIR = "/root/testdata/sf0.001"


def test_stages_and_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "mixing_sources", "packed_tokens"]


def test_each_stage_against_its_report(spark, small, tmp_path):
    """Each stage's rows follow from its operator's report on the stage's own input."""
    docs, counts = small, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_DIR)
        path = str(tmp_path / name)
        out.write.parquet(path)
        out, ids = spark.read.parquet(path), sorted(r.doc_id for r in docs.select("doc_id").collect())
        got = sorted(r.doc_id for r in out.select("doc_id").collect())
        if name == "quality_rules":
            want = sorted(r.doc_id for r in perplexity.quality_report(docs).where("kept").collect())
        elif name == "near_duplicates":
            want = sorted({r.component_id for r in jaccard_join.similarity_join(docs).collect()})
        elif name == "decontamination":
            found = decontaminate.contaminated(docs, tables.table(spark, SF_DIR, "benchmark"))
            bad = {r.doc_id for r in found.collect()}
            assert bad
            want = [i for i in ids if i not in bad]
        elif name == "mixing_sources":
            want = sorted(r.doc_id for r in mixing.mix_report(docs).collect() for _ in range(r.takes))
        else:
            want = ids
            assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
        assert got == want
        if name != "packed_tokens":
            assert out.columns == small.columns
        docs = out
        counts.append(len(got))
    assert counts[0] < 200 and counts[-1] > 50
    assert bitpack.END_ID == 1 and re.fullmatch("bigint", dict(docs.dtypes)["start"])


def test_near_duplicates_against_brute_force(spark):
    """Five words and 0.80, all pairs compared: scattered edits and edited blocks on both sides of the limit."""
    texts = []
    for family in range(24):
        base = [f"f{family}w{k}" for k in range(200)]
        scattered, block = list(base), list(base)
        for e in range(family % 8):
            scattered[20 + 22 * e] = "edit"
        for k in range(family):
            block[60 + k] = f"new{k}"
        texts += [base, scattered, block]
    rows = [(i, " ".join(words), "en", "a", 1) for i, words in enumerate(texts)]
    sets = [{tuple(words[k : k + 5]) for k in range(len(words) - 4)} for words in texts]
    first = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                low, high = sorted((first[i], first[j]))
                first = [low if f == high else f for f in first]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = corpus_pipeline.near_duplicates(spark, docs, SF_DIR)
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(first))


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    start = 0
    for row in sorted(rows, key=lambda r: r.start):
        assert row.start == start
        start += row.n_tokens


def test_odd_rows(spark, odd, none):
    """Odd rows pass every stage; an empty table stays empty."""
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF_DIR)
        docs.count()
