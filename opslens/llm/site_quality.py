"""Quality classifier with hierarchical empirical Bayes over sites.

A document's own evidence is the log-odds of a linear word classifier.  Its site (host)
and the part of the site it lies in (path) have their own rates, estimated from all documents by
grouped sums.  A site with few documents is shrunk towards the corpus, a path towards its site; how
strongly is itself estimated from how much sites (paths) differ beyond chance.  The posterior
of a document adds its evidence to the log-odds of its path.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.llm.shared import join_small, written
from opslens.llm.words import Words, numbered, pieces, totals

#: Labelled documents the word classifier is fitted on, at most about; taken by hash of the id.
SAMPLE = 10_000
FEATURE_BITS = 18
EPOCHS = 20
LEAST_TEXTS = 8
LEAST_Z = 5.0
#: Rates and sums are smoothed by so many documents.
PRIOR = 2.0


def _features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed distinct words of each text (rows, slots), and the text's shares."""
    words = Words(column, lower=True)
    ids, distinct = words.ids()
    texts = len(words.first) - 1
    slot = np.fromiter(
        (zlib.crc32(w.strip(b".,;:!?\"'()")) >> (32 - FEATURE_BITS) for w in distinct.to_pylist()), np.int64, len(distinct)
    )
    key = numbered(pa.array(words.owner * (1 << FEATURE_BITS) + slot[ids]))[1] if len(ids) else pa.array([], pa.int64())
    owner, slot = np.divmod(np.sort(np.asarray(key).astype(np.int64)), 1 << FEATURE_BITS)
    data, offsets = words.data, words.offsets
    size = np.maximum(np.diff(offsets), 1)
    count = np.maximum(words.counts, 1)
    distinct_share = np.bincount(owner, minlength=texts) / count
    marks = totals(np.isin(data, np.frombuffer(b"#*$%&|<>!", np.uint8)), offsets) / size
    capitals = totals((data >= 65) & (data <= 90), offsets) / size
    digits = totals((data >= 48) & (data <= 57), offsets) / size
    dense = np.stack(
        [
            np.ones(texts),
            np.log1p(words.counts) / 5,
            np.minimum(marks * 20, 3),
            np.minimum(capitals * 10, 3),
            np.minimum(digits * 10, 3),
            distinct_share,
            np.minimum(size / count / 10, 3),
        ],
        axis=1,
    )
    return owner, slot, dense


DENSE = 7


@dataclass
class Linear:
    """Logistic regression over hashed words and a few shares."""

    words: np.ndarray
    dense: np.ndarray

    def logit(self, column: pa.Array) -> np.ndarray:
        owner, slot, dense = _features(column)
        own = np.bincount(owner, self.words[slot], minlength=len(dense))
        return np.clip(own + dense @ self.dense, -30, 30)


def _telling(owner: np.ndarray, slot: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Words in at least ``LEAST_TEXTS`` texts whose share of positives is off by ``LEAST_Z`` deviations."""
    n = np.bincount(slot, minlength=1 << FEATURE_BITS)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    off = np.bincount(slot, y[owner], minlength=len(n)) - n * share
    return (n >= LEAST_TEXTS) & (np.abs(off) >= LEAST_Z * np.sqrt(np.maximum(n, 1) * share * (1 - share)))


def fit_linear(
    owner: np.ndarray, slot: np.ndarray, dense: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.5, ridge: float = 1e-4
) -> Linear:
    """AdaGrad over seeded small batches of telling words; ``owner`` rises.  Deterministic for a given order."""
    known = _telling(owner, slot, y)[slot]
    owner, slot = owner[known], slot[known]
    first = np.searchsorted(owner, np.arange(len(y) + 1))
    words, weights = np.zeros(1 << FEATURE_BITS), np.zeros(DENSE)
    seen_words, seen_dense = np.full(1 << FEATURE_BITS, 1e-3), np.full(DENSE, 1e-3)
    rng = np.random.default_rng(11)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
            rows = np.repeat(np.arange(len(part)), np.diff(first)[part])
            s = slot[np.concatenate([np.arange(first[i], first[i + 1]) for i in part])]
            z = np.bincount(rows, words[s], minlength=len(part)) + dense[part] @ weights
            wrong = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]
            used, place = np.unique(s, return_inverse=True)
            step = np.bincount(place, wrong[rows], minlength=len(used)) / len(part) + ridge * words[used]
            seen_words[used] += step**2
            words[used] -= rate * step / np.sqrt(seen_words[used])
            step = wrong @ dense[part] / len(part)
            seen_dense += step**2
            weights -= rate * step / np.sqrt(seen_dense)
    return Linear(words, weights)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        owner, slot, dense = _features(batch.column("text"))
        marks = pa.array(np.searchsorted(owner, np.arange(batch.num_rows + 1)), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"),
                batch.column("hash"),
                pa.ListArray.from_arrays(marks, pa.array(slot, pa.int32())),
                pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * DENSE, pa.int32()), pa.array(dense.reshape(-1))),
            ],
            ["id", "hash", "slots", "dense"],
        )


def train(docs: DataFrame, labels: DataFrame, targets: Sequence[str], sample: int = SAMPLE) -> tuple[dict[str, Linear], dict[str, float]]:
    """A classifier per target, from at most about ``sample`` labelled documents, and the targets' rates among all labels.

    A document's label is the mean of its label rows; of several texts with one id, that of the least hash
    counts; without labels a target's evidence is 0.  Features are made in tasks, and only theirs travel.
    """
    agreed = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("label_id"))
    rows = agreed.agg(*[F.avg(F.col(t).cast("double")).alias(f"y_{t}") for t in targets])
    rows = written(rows, "site-labels")
    ids = docs.select(F.col("doc_id").alias("id"))
    of_docs = rows.join(ids, F.col("id") == F.col("label_id"), "left_semi")
    counted = of_docs.agg(*[f(f"y_{t}").alias(f"{n}_{t}") for t in targets for n, f in (("sum", F.sum), ("n", F.count))]).first()
    rates = {t: ((counted[f"sum_{t}"] or 0.0) + 1) / (counted[f"n_{t}"] + 2) for t in targets}  # of all labels, not of the sample
    share = min(1.0, sample / max(rows.count(), 1))
    taken = rows.where(F.pmod(F.xxhash64("label_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    text = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    # about ``sample`` labelled ids, whatever the number of labels
    own = text.join(F.broadcast(taken.select("label_id")), F.col("id") == F.col("label_id"), "left_semi")
    kind = own.schema["id"].dataType.simpleString()
    found = own.withColumn("hash", F.xxhash64("text")).mapInArrow(_sampled, f"id {kind}, hash bigint, slots array<int>, dense array<double>")
    one = found.groupBy("id").agg(F.min(F.struct("hash", "slots", "dense")).alias("f"))
    joined = one.join(F.broadcast(taken), F.col("id") == F.col("label_id"))
    data = joined.select("id", "f.slots", "f.dense", *[f"y_{t}" for t in targets]).orderBy("id").toArrow().combine_chunks()
    models = {}
    size = data.num_rows
    slots = data.column("slots").combine_chunks() if size else None
    dense = data.column("dense").combine_chunks().flatten().to_numpy().reshape(size, DENSE) if size else None
    for t in targets:
        y = data.column(f"y_{t}").to_numpy().astype(float) if size else np.empty(0)
        known = np.flatnonzero(~np.isnan(y))
        if not len(known):
            models[t] = Linear(np.zeros(1 << FEATURE_BITS), np.zeros(DENSE))
            continue
        own = slots.take(pa.array(known))
        counts = own.value_lengths().to_numpy()
        models[t] = fit_linear(np.repeat(np.arange(len(known), dtype=np.int32), counts), own.flatten().to_numpy(), dense[known], y[known])
    return models, rates


def _evidence(targets: list[str], sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "__text"):
            keep = [n for n in batch.schema.names if n != "__text"]
            found = [pa.array(sent.value[t].logit(batch.column("__text"))) for t in targets]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in keep], *found], [*keep, *[f"evidence_{t}" for t in targets]]
            )

    return run


def _chance(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def shrunk_rates(rows: DataFrame, keys: Sequence[str], p: str, parent: Column, prior: float = PRIOR) -> DataFrame:
    """Posterior rate per group: a beta prior around ``parent`` with estimated strength.

    The strength comes from the spread of group means beyond what chance gives (method of
    moments over all groups): like groups are pulled together, unlike ones keep their rates.
    """
    groups = rows.groupBy(*keys).agg(F.sum(p).alias("s"), F.count("*").alias("n"), F.max(parent).alias("up"))
    mean, up = F.col("s") / F.col("n"), F.col("up")
    moments = groups.agg(
        F.sum(F.col("n") * (mean - up) * (mean - up)).alias("spread"),
        F.sum(up * (1 - up)).alias("noise"),
        F.sum("n").alias("rows"),
        F.sum(F.col("n") * up * (1 - up)).alias("most"),
    ).first()
    between = max(((moments["spread"] or 0.0) - (moments["noise"] or 0.0)) / max(moments["rows"] or 1, 1), 1e-9)
    strength = max(prior, (moments["most"] or 0.0) / max(moments["rows"] or 1, 1) / between - 1)
    return groups.select(*keys, ((F.col("s") + F.lit(strength) * up) / (F.col("n") + F.lit(strength))).alias("rate"))


def classify(
    docs: DataFrame,
    labels: DataFrame,
    host: Column | None = None,
    path: Column | None = None,
    targets: Sequence[str] = ("quality", "toxic"),
    sample: int = SAMPLE,
    least_quality: float = 0.5,
    most_toxic: float = 0.5,
) -> DataFrame:
    """Posterior of each target for every document, and ``kept``.

    ``host`` is the site (default: ``source``) and ``path`` the part of it (default: ``lang``); null is a
    site or path of its own.  Per target there are ``evidence_t`` (log-odds from the text alone),
    ``host_t`` and ``path_t`` (shrunk rates) and ``t`` (posterior).  Null and empty texts are judged by their
    site and the missing words; repeated rows are judged alike and count each; without labels all
    evidence is even; an empty table gives no rows.
    """
    targets = list(targets)
    models, rates = train(docs, labels, targets, sample)
    sent = docs.sparkSession.sparkContext.broadcast(models)
    rows = docs.select(
        "doc_id",
        (host if host is not None else F.col("source")).cast("string").alias("host"),
        (path if path is not None else F.col("lang")).cast("string").alias("path"),
        F.col("text").cast("string").alias("__text"),
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, host string, path string, " + ", ".join(f"evidence_{t} double" for t in targets)
    scored = written(rows.mapInArrow(_evidence(targets, sent), schema), "site-evidence")
    out = scored
    for t in targets:
        base = F.lit(rates[t])
        chance = out.withColumn("__p", _chance(F.col(f"evidence_{t}")))
        hosts = written(shrunk_rates(chance, ["host"], "__p", base), "site-hosts").select(
            F.col("host").alias("__host"), F.col("rate").alias(f"host_{t}")
        )
        sited = join_small(chance, hosts, F.expr("host <=> __host")).drop("__host")
        paths = written(shrunk_rates(sited, ["host", "path"], "__p", F.col(f"host_{t}")), "site-paths").select(
            F.col("host").alias("__host"), F.col("path").alias("__path"), F.col("rate").alias(f"path_{t}")
        )
        both = F.expr("host <=> __host AND path <=> __path")
        placed = join_small(sited, paths, both).drop("__host", "__path", "__p")
        # the evidence was fitted at the corpus rate: the site moves it by the difference of log-odds
        posterior = _chance(F.col(f"evidence_{t}") + _logit(F.col(f"path_{t}")) - _logit(base))
        out = placed.withColumn(t, posterior)
    kept = F.lit(True)
    if "quality" in targets:
        kept = kept & (F.col("quality") >= least_quality)
    if "toxic" in targets:
        kept = kept & (F.col("toxic") < most_toxic)
    return out.withColumn("kept", kept)
