"""Registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from opslens.llm import (
    bitpack,
    collocations,
    cross_align,
    decontaminate,
    hmm,
    jaccard_join,
    mixing,
    perplexity,
    piece_merge,
    pii,
    sharding,
    site_quality,
    superkmers,
)
from opslens.llm.tables import table, vocabulary_path


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op3_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.quality_report(table(spark, sf_dir, "documents"))


def op4_site_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_superkmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superkmers.remove_repeats(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similarity_join(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op9_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_documents(table(spark, sf_dir, "documents"))


def op10_bitpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitpack.pack_documents(table(spark, sf_dir, "documents"), vocabulary_path())


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_cross_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model")
    return cross_align.align_documents(table(spark, sf_dir, "documents"), *paths)


def op13_piece_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_merge.digest_documents(table(spark, sf_dir, "documents"), vocabulary_path("piece_bpe_32k.model"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_mixing": op2_mixing,
    "op3_perplexity": op3_perplexity,
    "op4_site_bayes": op4_site_bayes,
    "op5_superkmers": op5_superkmers,
    "op6_sharding": op6_sharding,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_pii": op8_pii,
    "op9_hmm": op9_hmm,
    "op10_bitpack": op10_bitpack,
    "op11_collocations": op11_collocations,
    "op12_cross_align": op12_cross_align,
    "op13_piece_merge": op13_piece_merge,
    "pipeline": corpus_pipeline.run,
}

# CRC-32 is linear in its low byte: the step xors one constant per set bit.
_CRC_BITS = [
    0x77073096, 0xEE0E612C, 0x076DC419, 0x0EDB8832, 0x1DB71064, 0x3B6E20C8, 0x76DC4190, 0xEDB88320,
]


def _crc_sql(text: str) -> str:
    step = "acc >> 8"
    for i, bit in enumerate(_CRC_BITS):
        step = f"xor({step}, ((xor(acc, b) >> {i}) & 1) * {bit}::UBIGINT)"
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::UBIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {octets}), lambda acc, b: {step}), 4294967295::UBIGINT)"


ORACLES: dict[str, str] = {
    "op6_sharding": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT r, shard, substr(md5(coalesce(doc_id::VARCHAR, '~') || '#' || (shard // 2)::VARCHAR),
        1 + 13 * (shard % 2), 13) AS u FROM d, range(41) AS t(shard)),
a AS (SELECT r, arg_max(shard, u) FILTER (shard < 40) AS shard, arg_max(shard, u) AS grown FROM s GROUP BY r),
x AS (SELECT doc_id, octet_length(encode(text)) + 16 AS size, {_crc_sql('text')} AS text_crc32,
        'key' AS law, shard, grown FROM d JOIN a USING (r))
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, law, shard::INT AS shard,
    row_number() OVER (PARTITION BY shard ORDER BY substr(md5(
        coalesce(strlen(doc_id::VARCHAR) || '=' || doc_id, '~') || ':' || strlen(text_crc32::VARCHAR) || '=' || text_crc32
        || ':' || strlen(size::VARCHAR) || '=' || size || '#slot'), 1, 3),
        doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown::INT AS grown_shard FROM x""",
    "op5_superkmers": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS s
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
firsts AS (SELECT s, min(doc_id) AS f FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN firsts USING (s) WHERE f < doc_id),
x AS (SELECT doc_id, p, ws[p] AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w)),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM x ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed,
    sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)""",
    "op7_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g
    FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id FROM m LEFT JOIN n USING (doc_id)""",
    "op11_collocations": r"""
WITH p AS (SELECT d, lang, i, p FROM (SELECT d, lang, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (
        SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents))),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, s, array_to_string(ws[i:i + s - 1], ' ') AS phrase
    FROM (SELECT lang, ws, s, unnest(range(1, len(ws) - s + 2)) AS i FROM w, range(1, 4) AS t(s))),
f AS (SELECT lang, s, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE s = 1 GROUP BY lang),
c AS (SELECT lang, s, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE s > 1 AND f >= 10),
k AS (SELECT c.lang, c.phrase, c.s, a, k, x.f AS l, y.f AS r,
        (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
    FROM c JOIN range(1, 3) AS t(k) ON k < s
    JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1:k], ' ')
    JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(ws[k + 1:], ' ')),
b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
gone AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN (
        SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS part FROM c WHERE s = 3) t
    ON t.lang = c.lang AND t.part = c.phrase WHERE c.s = 2 AND 100 * t.a >= 50 * c.a),
o AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score
    FROM b ANTI JOIN gone USING (lang, phrase))
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM o JOIN n USING (lang) WHERE rank <= 2000""",
}
