"""A hidden Markov language model over words.

States emit *symbols*: each of the most frequent words is a symbol, every other word belongs
to one of a fixed number of classes by its last letters, and within its class a word's share follows
its count.  The training texts are turned into symbols once.  Start values are fitted to the pairs of
neighbours of all of them, which Spark counts; then Baum-Welch counts are summed over them by Spark.  A scaled forward
recursion gives the exact likelihood of each text.

Sizes that are collected or broadcast are bounded whatever the corpus: ``DICTIONARY`` words with their
counts and ``SYMBOLS + CLASSES`` rows of ``STATES`` numbers.  Counts of all other words stay
distributed and are joined word by word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.llm.shared import written
from opslens.llm.words import Words, binary_array, numbered, pieces, totals

STATES = 8
SYMBOLS = 1 << 14
CLASSES = 1 << 12
DICTIONARY = 1 << 18
#: Rounds of the start values, over the counted pairs of neighbours.
START_ROUNDS = 15
ROUNDS = 2
#: Weight of the corpus-wide shares in every state's emissions.
PRIOR = 200.0
#: Tokens of the texts that walk side by side.
WALK_TOKENS = 250_000
#: Text bytes a task turns into symbols at once.
READ_BYTES = 6 << 20
END = " "  # no word holds a space
#: Distinct words a counting task holds before it passes them on.
HELD_WORDS = 1 << 20
#: Distinct pairs of symbols a counting task holds before it passes them on.
HELD_PAIRS = 1 << 20
#: Pairs in a row of the packed table, taken at once in a round.
PAIR_ROWS = 1 << 17


def held_out(doc_id: Column) -> Column:
    """Every fifth text by checksum of its id's text is not learnt from; a null id reads as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def _prepared(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text")
    )


# --- word counts ------------------------------------------------------------------------------


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
    tables, held, texts = [], 0, 0

    def flush():
        table = pa.concat_tables(tables).group_by("word").aggregate([("n", "sum")])
        table = pa.table([table.column("word"), table.column("n_sum")], schema=schema)
        yield from table.to_batches(max_chunksize=1 << 16)

    for batch in pieces(batches, "text"):
        texts += batch.num_rows
        ids, distinct = Words(batch.column("text"), lower=True).ids()
        tables.append(pa.table([distinct.cast(pa.string()), pa.array(np.bincount(ids, minlength=len(distinct)))], schema=schema))
        held += len(distinct)
        if held > HELD_WORDS:
            yield from flush()
            tables, held = [], 0
    if texts:
        tables.append(pa.table([pa.array([END]), pa.array([texts], pa.int64())], schema=schema))
        yield from flush()


def count_words(docs: DataFrame) -> DataFrame:
    """``word, n`` over the training texts; the end of a text counts as the word ``" "``."""
    rows = _prepared(docs).where(~F.col("held_out")).select("text")
    return rows.mapInArrow(_count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _class_of(words: pa.Array | list[bytes]) -> np.ndarray:
    """The class of each word (binary), by its last three bytes."""
    words = pa.array(words, pa.large_binary()) if isinstance(words, list) else words
    ids, endings = numbered(pc.binary_slice(words, -3))
    return np.fromiter((zlib.crc32(e) % CLASSES for e in endings.to_pylist()), np.int64, len(endings))[ids]


def _class_sums(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, kinds = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for batch in batches:
            n = np.asarray(batch.column("n"))
            number = _class_of(batch.column("word").cast(pa.binary()))
            sums += np.bincount(number, n, CLASSES).astype(np.int64)
            kinds += np.bincount(number, minlength=CLASSES)
        seen = np.flatnonzero(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(sums[seen]), pa.array(kinds[seen])], ["class", "n", "v"])

    return run


def _cut(bins: list, most: int) -> int:
    """The least count such that at most ``most`` words have it or more; from (bin's least count, words)."""
    least, words = None, 0
    for low, count in sorted(bins, reverse=True):
        if words + count > most:
            break
        least, words = low, words + count
    return least if least is not None else 1 << 62


@dataclass
class Vocabulary:
    words: pa.Array  # the dictionary, most frequent first, without the end
    counts: np.ndarray
    symbols: int  # the first so many words are symbols
    tokens: int  # N
    kinds: int  # V, with the end
    texts: int
    class_tokens: np.ndarray
    class_kinds: np.ndarray

    @property
    def end(self) -> int:
        return self.symbols + CLASSES

    @property
    def size(self) -> int:
        return self.end + 1

    @property
    def class_logs(self) -> np.ndarray:
        """log10 of each class's total, one unseen word included."""
        return np.log10(self.class_tokens + 0.5 * (self.class_kinds + 1))

    @property
    def base_log(self) -> float:
        return float(np.log10(self.tokens + 0.5 * (self.kinds + 1)))


def vocabulary(counts: DataFrame, dictionary: int = DICTIONARY, symbols: int = SYMBOLS) -> Vocabulary:
    """The dictionary and the class totals.  Thresholds come from a histogram of counts on a log scale
    (some thousand bins), so a tie is never cut."""
    words = counts.where(F.col("word") != END)
    totals_row = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    texts = counts.where(F.col("word") == END).agg(F.sum("n")).first()[0] or 0
    bins = words.groupBy(F.floor(F.log2("n") * 64).alias("bin")).agg(F.min("n").alias("low"), F.count("*").alias("words"))
    bins = [(r["low"], r["words"]) for r in bins.collect()]
    least, top = _cut(bins, dictionary), _cut(bins, symbols)
    found = words.where(F.col("n") >= least).toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    n = found.column("n").to_numpy()
    in_class = words.where(F.col("n") < top).mapInArrow(_class_sums(least), "class bigint, n bigint, v bigint")
    sums = in_class.groupBy("class").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).toArrow()
    class_tokens, class_kinds = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    class_tokens[sums.column("class").to_numpy()] = sums.column("n").to_numpy()
    class_kinds[sums.column("class").to_numpy()] = sums.column("v").to_numpy()
    return Vocabulary(
        found.column("word").combine_chunks().cast(pa.large_binary()),
        n,
        int((n >= top).sum()),
        (totals_row["n"] or 0) + texts,
        totals_row["v"] + (texts > 0),
        texts,
        class_tokens,
        class_kinds,
    )


class Reader:
    """Turns a text column into symbol sequences, each with its end."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab

    def read(self, column: pa.Array):
        vocab = self.vocab
        words = Words(column, lower=True)
        ids, distinct = words.ids()
        found = pc.index_in(distinct, value_set=vocab.words)
        place = np.asarray(pc.fill_null(found, -1)).astype(np.int64)
        symbol = place.copy()
        rest = np.flatnonzero((place < 0) | (place >= vocab.symbols))
        symbol[rest] = vocab.symbols + _class_of(distinct.take(pa.array(rest)))
        lengths = words.counts + 1
        sequence = np.full(int(lengths.sum()), vocab.end, np.int64)
        ends = np.cumsum(lengths) - 1
        inner = np.ones(len(sequence), bool)
        inner[ends] = False
        sequence[inner] = symbol[ids]
        return words, ids, distinct, place, symbol, sequence, lengths


# --- the model --------------------------------------------------------------------------------


@dataclass
class Model:
    start: np.ndarray  # [K]
    move: np.ndarray  # [K, K]
    emit: np.ndarray  # [symbols, K]


class Walk:
    """Texts side by side, longest first; step t holds the texts with more than t tokens."""

    def __init__(self, sequence: np.ndarray, firsts: np.ndarray, lengths: np.ndarray):
        self.lengths = lengths
        steps = int(lengths.max())
        self.active = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(steps), "right")
        self.off = np.concatenate([[0], np.cumsum(self.active)])
        step = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.place = self.off[step] + np.repeat(np.arange(len(lengths)), lengths)
        self.symbols = np.empty(len(step), np.int64)
        self.symbols[self.place] = sequence[np.repeat(firsts, lengths) + step]

    def forward(self, model: Model):
        seen = model.emit[self.symbols]
        alpha, scale = np.empty_like(seen), np.empty(len(seen))
        move, off = model.move, self.off
        before = None
        for t in range(len(self.active)):
            low, high = off[t], off[t + 1]
            here = alpha[low:high]
            np.multiply(model.start if t == 0 else before[: high - low] @ move, seen[low:high], out=here)
            total = here.sum(axis=1)
            here /= total[:, None]
            scale[low:high] = total
            before = here
        return seen, alpha, scale

    def log10(self, model: Model) -> np.ndarray:
        """Log10 probability of each text."""
        logs = np.log10(self.forward(model)[2])[self.place]
        return totals(logs, np.concatenate([[0], np.cumsum(self.lengths)]))

    def expect(self, model: Model, emit: np.ndarray, move: np.ndarray, start: np.ndarray) -> float:
        """Add the expected counts of one Baum-Welch round; returns the log10 likelihood."""
        seen, alpha, scale = self.forward(model)
        seen /= scale[:, None]
        off = self.off
        moved = np.zeros_like(move)
        after = None
        gamma = alpha  # becomes alpha * beta, step by step from the end
        for t in range(len(self.active) - 1, -1, -1):
            low, high = off[t], off[t + 1]
            if after is not None:
                going = high - low if len(after) == high - low else len(after)
                moved += alpha[low : low + going].T @ after
                beta = after @ model.move.T
                gamma[low : low + going] *= beta
                if going < high - low:
                    beta = np.concatenate([beta, np.ones((high - low - going, beta.shape[1]))])
                after = seen[low:high] * beta
            else:
                after = seen[low:high]
        move += moved * model.move
        start += gamma[: off[1]].sum(axis=0)
        for k in range(emit.shape[1]):
            emit[:, k] += np.bincount(self.symbols, gamma[:, k], len(emit))
        return float(np.log10(scale).sum())


def walks(sequence: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, Walk]]:
    """All texts, in groups of about ``WALK_TOKENS`` of similar length; with their indices."""
    order = np.argsort(-lengths, kind="stable")
    firsts = np.cumsum(lengths) - lengths
    group = (np.cumsum(lengths[order]) - lengths[order]) // WALK_TOKENS
    for part in np.split(order, np.flatnonzero(np.diff(group)) + 1):
        if len(part):
            yield part, Walk(sequence, firsts[part], lengths[part])


def shares(vocab: Vocabulary) -> np.ndarray:
    """Corpus-wide share of each symbol."""
    n = np.concatenate([vocab.counts[: vocab.symbols], vocab.class_tokens, [vocab.texts]]) + 0.5
    return n / n.sum()


def renewed(emit: np.ndarray, move: np.ndarray, start: np.ndarray, share: np.ndarray) -> Model:
    """The next model from expected counts, smoothed towards the corpus."""
    emit = (emit + PRIOR * share[:, None]) / (emit.sum(axis=0) + PRIOR)
    move = (move + 1.0) / (move + 1.0).sum(axis=1, keepdims=True)
    start = (start + 1.0) / (start + 1.0).sum()
    return Model(start, move, emit)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    seen, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    n = np.zeros(len(seen), np.int64)
    np.add.at(n, at, np.concatenate([p[1] for p in parts]))
    return seen, n


def _width(vocab: Vocabulary) -> np.dtype:
    return np.dtype("<u2" if vocab.size <= 1 << 16 else "<i4")


def _symbols(vocab):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, kind = Reader(vocab.value), _width(vocab.value)
        for batch in pieces(batches, "text", READ_BYTES):
            *_, sequence, lengths = reader.read(batch.column("text"))
            marks = np.concatenate([[0], np.cumsum(lengths)]) * kind.itemsize
            found = binary_array(marks, sequence.astype(kind).view(np.uint8))
            yield pa.RecordBatch.from_arrays([found.cast(pa.binary())], ["symbols"])

    return run


def training_symbols(docs: DataFrame, vocab) -> DataFrame:
    """``symbols`` of each training text, with its end, packed; written, as each round reads them."""
    rows = _prepared(docs).where(~F.col("held_out")).select("text")
    return written(rows.mapInArrow(_symbols(vocab), "symbols binary"), "hmm-symbols")


def _sequences(batches: Iterator[pa.RecordBatch], vocab: Vocabulary) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Packed symbols as one sequence and the texts' lengths, as many texts at once as are read at once."""
    kind = _width(vocab)
    for batch in pieces(batches, "symbols", READ_BYTES // 6 * kind.itemsize):
        column = batch.column("symbols").cast(pa.large_binary())
        _, marks, data = column.buffers()
        marks = np.frombuffer(marks, np.int64)[column.offset : column.offset + len(column) + 1]
        yield np.frombuffer(data, np.uint8)[marks[0] : marks[-1]].view(kind).astype(np.int64), np.diff(marks) // kind.itemsize


def _pairs(vocab):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0

        def rows(seen: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(seen), pa.array(n)], ["pair", "n"])

        for sequence, _ in _sequences(batches, vocab.value):
            inside = sequence[:-1] != vocab.value.end
            pair = sequence[:-1][inside] * vocab.value.size + sequence[1:][inside]
            parts.append(np.unique(pair, return_counts=True))
            held += len(parts[-1][0])
            if held > HELD_PAIRS:
                parts = [_merged(parts)]
                held = len(parts[0][0])
                if held > HELD_PAIRS // 2:
                    yield rows(*parts[0])
                    parts, held = [], 0
        if parts:
            yield rows(*_merged(parts))

    return run


def count_pairs(symbols: DataFrame, vocab) -> DataFrame:
    """``pair, n``: how often symbol ``pair % size`` follows ``pair // size`` in the texts, their ends included."""
    return symbols.mapInArrow(_pairs(vocab), "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def _pack_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of up to ``PAIR_ROWS`` pairs, sorted, and their counts, both packed."""
    held, size = [], 0

    def row() -> pa.RecordBatch:
        pair, n = (np.concatenate([np.asarray(b.column(c)) for b in held]) for c in ("pair", "n"))
        order = np.argsort(pair)
        packed = [pa.array([x[order].astype("<i8").tobytes()], pa.binary()) for x in (pair, n)]
        return pa.RecordBatch.from_arrays(packed, ["pairs", "times"])

    for batch in batches:
        for start in range(0, batch.num_rows, PAIR_ROWS):
            held.append(batch.slice(start, PAIR_ROWS))
            size += held[-1].num_rows
            if size >= PAIR_ROWS:
                yield row()
                held, size = [], 0
    if size:
        yield row()


def add_pairs(model: Model, a: np.ndarray, b: np.ndarray, n: np.ndarray, emit: np.ndarray, move: np.ndarray, start: np.ndarray) -> None:
    """Add the expected counts of pairs of neighbours that occur ``n`` times; ``start`` is the state of the first.

    What a pair's first symbol gives is worked out once for all pairs with that symbol."""
    if not len(a):
        return
    if (a[1:] < a[:-1]).any():
        order = np.argsort(a, kind="stable")
        a, b, n = a[order], b[order], n[order]
    firsts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    times = np.diff(np.append(firsts, len(a)))
    before = model.emit[a[firsts]] * model.start
    to = before @ model.move
    states = range(emit.shape[1])
    after = [np.ascontiguousarray(model.emit[:, k])[b] for k in states]
    moved = [np.repeat(to[:, k], times) * after[k] for k in states]
    weight = n / sum(moved)
    back = np.stack([np.add.reduceat(after[k] * weight, firsts) for k in states], axis=1)
    first = before * (back @ model.move.T)
    move += before.T @ back * model.move
    start += first.sum(axis=0)
    emit[a[firsts]] += first
    for k in states:
        emit[:, k] += np.bincount(b, moved[k] * weight, len(emit))


def _sum_rows(emit: np.ndarray, move: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    rows = np.concatenate([emit, move, start[None]])
    seen = np.flatnonzero(rows.any(axis=1))
    return pa.RecordBatch.from_arrays(
        [pa.array(seen), *[pa.array(rows[seen, k]) for k in range(rows.shape[1])]],
        ["symbol", *[f"s{k}" for k in range(rows.shape[1])]],
    )


def _expect_pairs(sent, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        sums = [np.zeros(x.shape) for x in (model.emit, model.move, model.start)]
        for batch in batches:
            for row in range(batch.num_rows):
                pair, n = (np.frombuffer(batch.column(c)[row].as_buffer(), "<i8") for c in ("pairs", "times"))
                add_pairs(model, pair // size, pair % size, n, *sums)
        yield _sum_rows(*sums)

    return run


def _round(rows: DataFrame, run, vocab: Vocabulary, states: int) -> list[np.ndarray]:
    """Expected emissions, moves and starts; tasks send one row per symbol they saw (and per state), Spark sums them."""
    names = [f"s{k}" for k in range(states)]
    counted = rows.mapInArrow(run, "symbol bigint, " + ", ".join(f"{n} double" for n in names))
    table = counted.groupBy("symbol").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    sums = np.zeros((vocab.size + states + 1, states))
    sums[table.column("symbol").to_numpy()] = np.stack([table.column(n).to_numpy() for n in names], axis=1)
    return [sums[: vocab.size], sums[vocab.size : -1], sums[-1]]


def start_model(
    docs: DataFrame, vocab: Vocabulary, rounds: int = START_ROUNDS, states: int = STATES, symbols: DataFrame | None = None
) -> Model:
    """Start values: rounds over the pairs of neighbours of all training texts, from seeded noise.

    The pairs are counted once, by Spark, and stay distributed; a text's likelihood is taken as the product of
    its pairs', which the states of the whole model maximise as well.  ``symbols``: the training texts' if at hand."""
    context = docs.sparkSession.sparkContext
    share = shares(vocab)
    rng = np.random.default_rng(7)
    emit = share[:, None] * rng.uniform(0.5, 1.5, (vocab.size, states))
    move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    model = Model(np.full(states, 1.0 / states), move, emit / emit.sum(axis=0))
    sent = context.broadcast(vocab)
    counted = count_pairs(training_symbols(docs, sent) if symbols is None else symbols, sent)
    pairs = written(counted.mapInArrow(_pack_pairs, "pairs binary, times binary"), "hmm-pairs")
    for _ in range(rounds):
        emit, move, start = _round(pairs, _expect_pairs(context.broadcast(model), vocab.size), vocab, states)
        model = renewed(emit / 2, move, start, share)  # a word stands in two pairs
    return model


def _expect(vocab, sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        emit, move, start = (np.zeros(a.shape) for a in (model.emit, model.move, model.start))
        for sequence, lengths in _sequences(batches, vocab.value):
            for _, walk in walks(sequence, lengths):
                walk.expect(model, emit, move, start)
        yield _sum_rows(emit, move, start)

    return run


def baum_welch(docs: DataFrame, vocab: Vocabulary, model: Model, rounds: int = ROUNDS, symbols: DataFrame | None = None) -> Model:
    """Baum-Welch rounds over all training texts, or over their symbols if at hand."""
    context = docs.sparkSession.sparkContext
    sent_vocab = context.broadcast(vocab)
    symbols = training_symbols(docs, sent_vocab) if symbols is None else symbols
    for _ in range(rounds):
        sums = _round(symbols, _expect(sent_vocab, context.broadcast(model)), vocab, len(model.start))
        model = renewed(*sums, shares(vocab))
    return model


# --- scoring ----------------------------------------------------------------------------------

_SCORES = (
    "row bigint, n_tokens bigint, known bigint, base double, model double, "
    "rare array<struct<word:string,times:int>>"
)


def _score(vocab, sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, model, vocab_ = Reader(vocab.value), sent.value, vocab.value
        row = TaskContext.get().partitionId() << 40
        logs = np.log10(vocab_.counts + 0.5)
        class_logs, base_log = vocab_.class_logs, vocab_.base_log
        end_base = np.log10(vocab_.texts + 0.5)
        for batch in pieces(batches, "text", READ_BYTES):
            words, ids, distinct, place, symbol, sequence, lengths = reader.read(batch.column("text"))
            score = np.zeros(len(lengths))
            for part, walk in walks(sequence, lengths):
                score[part] = walk.log10(model)
            # a word's log10 count, where the dictionary has it; rare ones are added by the join
            log = np.where(place >= 0, logs[np.maximum(place, 0)] if len(logs) else 0.0, 0.0)
            in_class = symbol >= vocab_.symbols
            inside = np.where(in_class, log - class_logs[np.where(in_class, symbol - vocab_.symbols, 0)], 0.0)
            score += totals(inside[ids], words.first)
            base = totals(log[ids], words.first) + end_base - lengths * base_log
            known = totals((place >= 0)[ids], words.first) + int(vocab_.texts > 0)
            rare, sizes = _rare(words, ids, distinct, place)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(row + np.arange(len(lengths))),
                    pa.array(lengths, pa.int64()),
                    pa.array(known, pa.int64()),
                    pa.array(base),
                    pa.array(score),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), rare),
                ],
                ["doc_id", "held_out", "row", "n_tokens", "known", "base", "model", "rare"],
            )
            row += len(lengths)

    return run


def _rare(words: Words, ids: np.ndarray, distinct: pa.Array, place: np.ndarray):
    """The words outside the dictionary with how often each text has them, and the number per text."""
    at = np.flatnonzero(place[ids] < 0)
    key = words.owner[at] * max(len(distinct), 1) + ids[at]
    key, times = np.unique(key, return_counts=True)
    owner, number = np.divmod(key, max(len(distinct), 1))
    texts = distinct.take(pa.array(number)).cast(pa.large_string()).cast(pa.string())
    found = pa.StructArray.from_arrays([texts, pa.array(times, pa.int32())], ["word", "times"])
    return found, np.bincount(owner, minlength=len(words.first) - 1)


def score_documents(docs: DataFrame, rounds: int = ROUNDS, dictionary: int = DICTIONARY, symbols: int = SYMBOLS, states: int = STATES) -> DataFrame:
    """Learn from the training texts and score every text.

    ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``; scores are log10
    probabilities.  Null and empty texts consist of their end; repeated rows score alike; without
    training texts all words are unseen; an empty table gives no rows.
    """
    context = docs.sparkSession.sparkContext
    counts = written(count_words(docs), "hmm-words")
    vocab = vocabulary(counts, dictionary, symbols)
    texts = training_symbols(docs, context.broadcast(vocab))
    model = baum_welch(docs, vocab, start_model(docs, vocab, states=states, symbols=texts), rounds, texts)
    rows = _prepared(docs)
    kinds = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean"
    scored = written(rows.mapInArrow(_score(context.broadcast(vocab), context.broadcast(model)), f"{kinds}, {_SCORES}"), "hmm-scores")
    rare = scored.select("row", F.inline("rare"))
    joined = rare.join(counts, "word", "left")
    n = F.coalesce("n", F.lit(0))
    added = joined.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(n + 0.5)).alias("log"),
        F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("more"),
    )
    log, more = F.coalesce("log", F.lit(0.0)), F.coalesce("more", F.lit(0))
    return scored.drop("rare").join(added, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + more).cast("bigint").alias("n_known"),
        F.lit(vocab.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + log).alias("base_score"),
        (F.col("model") + log).alias("score"),
    )
