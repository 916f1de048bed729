import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from opslens.llm import hmm


def tokens(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x20\x09-\x0D]+", lower) + [" "]


def is_held_out(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


def check_base(docs, **options):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    counts = Counter(t for i, text in rows if not is_held_out(i) for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, text in rows:
        own = tokens(text)
        base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own)
        want.append((i, is_held_out(i), len(own), sum(counts[t] > 0 for t in own), n, round(base, 5)))
    got = hmm.score_documents(docs, **options).collect()
    assert sorted(((*r[:5], round(r.base_score, 5)) for r in got), key=repr) == sorted(want, key=repr)
    return got


def test_table(small):
    got = check_base(small)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_small_dictionary_gives_the_same_base(small):
    check_base(small, dictionary=50, symbols=10, states=2, rounds=1)


def test_odd_rows(odd, none):
    got = check_base(odd, states=3)
    assert len({round(r.score, 6) for r in got if r.doc_id == 6}) == 1
    assert all(r.score < 0 for r in got)
    assert hmm.score_documents(none).count() == 0


def random_model(rng, states, symbols):
    norm = lambda a, axis: a / a.sum(axis=axis, keepdims=True)
    return hmm.Model(norm(rng.random(states), 0), norm(rng.random((states, states)), 1), norm(rng.random((symbols, states)), 0))


def test_forward_sums_over_all_paths():
    rng = np.random.default_rng(0)
    model = random_model(rng, 3, 5)
    lengths = np.array([4, 1, 6, 2])
    sequence = rng.integers(0, 5, lengths.sum())
    got = np.zeros(4)
    for part, walk in hmm.walks(sequence, lengths):
        got[part] = walk.log10(model)
    for d, (a, b) in enumerate(zip(np.cumsum(lengths) - lengths, np.cumsum(lengths))):
        own, total = sequence[a:b], 0.0
        for path in itertools.product(range(3), repeat=len(own)):
            p = model.start[path[0]] * model.emit[own[0], path[0]]
            for t in range(1, len(own)):
                p *= model.move[path[t - 1], path[t]] * model.emit[own[t], path[t]]
            total += p
        assert got[d] == pytest.approx(math.log10(total))


def test_expected_counts_by_all_paths():
    rng = np.random.default_rng(1)
    model = random_model(rng, 2, 4)
    lengths = np.array([3, 5, 1])
    sequence = rng.integers(0, 4, 9)
    sums = [np.zeros(a.shape) for a in (model.emit, model.move, model.start)]
    for _, walk in hmm.walks(sequence, lengths):
        walk.expect(model, *sums)
    want = [np.zeros(a.shape) for a in (model.emit, model.move, model.start)]
    for a, b in zip(np.cumsum(lengths) - lengths, np.cumsum(lengths)):
        own = sequence[a:b]
        paths = list(itertools.product(range(2), repeat=len(own)))
        weight = []
        for path in paths:
            p = model.start[path[0]] * model.emit[own[0], path[0]]
            for t in range(1, len(own)):
                p *= model.move[path[t - 1], path[t]] * model.emit[own[t], path[t]]
            weight.append(p)
        for path, p in zip(paths, np.array(weight) / sum(weight)):
            want[2][path[0]] += p
            for t, s in enumerate(path):
                want[0][own[t], s] += p
                if t:
                    want[1][path[t - 1], s] += p
    for x, y in zip(sums, want):
        assert np.allclose(x, y)


def test_rounds_raise_the_likelihood():
    rng = np.random.default_rng(5)
    lengths = rng.integers(5, 40, 60)
    # two kinds of text that use different halves of the symbols
    sequence = np.concatenate([rng.integers(0, 10, n) + 10 * (i % 2) for i, n in enumerate(lengths)])
    model = random_model(rng, 2, 20)
    seen = []
    for _ in range(8):
        sums = [np.zeros(a.shape) for a in (model.emit, model.move, model.start)]
        seen.append(sum(walk.expect(model, *sums) for _, walk in hmm.walks(sequence, lengths)))
        emit, move, start = (s + 1e-12 for s in sums)
        model = hmm.Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    assert all(b >= a - 1e-9 for a, b in zip(seen, seen[1:]))


def test_class_shares_sum_to_one(spark):
    docs = spark.createDataFrame([(i, "aa bb cc dd ee ff gg hh " + "aa bb " * i) for i in range(8)], "doc_id bigint, text string")
    vocab = hmm.vocabulary(hmm.count_words(docs), dictionary=4, symbols=2)
    assert vocab.symbols == 2 and len(vocab.words) >= 2 and vocab.kinds == 9
    total = np.zeros(hmm.CLASSES)
    for word in ("cc", "dd", "ee", "ff", "gg", "hh"):
        n = sum(str(t).split().count(word) for i, t in docs.collect() if not is_held_out(i))
        c = hmm._class_of([word.encode()])[0]
        total[c] += (n + 0.5) / 10 ** vocab.class_logs[c]
    for c in np.flatnonzero(total):  # one unseen word takes the rest
        assert total[c] + 0.5 / 10 ** vocab.class_logs[c] == pytest.approx(1)


def test_reader_adds_ends():
    vocab = hmm.Vocabulary(pa.array([b"a", b"b"], pa.large_binary()), np.array([3, 2]), 1, 7, 3, 2, np.zeros(hmm.CLASSES), np.zeros(hmm.CLASSES))
    *_, sequence, lengths = hmm.Reader(vocab).read(pa.array(["A b", None, "", "a"]))
    assert lengths.tolist() == [3, 1, 1, 2]
    assert sequence.tolist() == [0, 1 + hmm._class_of([b"b"])[0], vocab.end, vocab.end, vocab.end, 0, vocab.end]


def test_start_values_see_every_training_text(spark):
    """Turning one text round keeps all word counts, and changes the pairs and so the start values."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{w}" for w in rng.integers(0, 30, 12))) for i in range(900)]
    learnt = [i for i, _ in rows if not is_held_out(i)]

    def fitted(rows):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
        return hmm.start_model(docs, hmm.vocabulary(hmm.count_words(docs)), rounds=1, states=2).move

    whole = fitted(rows)
    for one in (learnt[0], learnt[len(learnt) // 2], learnt[-1]):
        turned = [(i, " ".join(reversed(text.split())) if i == one else text) for i, text in rows]
        assert np.abs(fitted(turned) - whole).max() > 1e-9


def test_expected_counts_of_pairs():
    model = random_model(np.random.default_rng(2), 3, 6)
    a, b, n = np.array([0, 1, 5]), np.array([2, 2, 0]), np.array([1, 4, 2])
    sums = [np.zeros(x.shape) for x in (model.emit, model.move, model.start)]
    hmm.add_pairs(model, a, b, n, *sums)
    sequence, lengths = np.concatenate([np.repeat(np.stack([a, b], 1), n, axis=0).ravel()]), np.full(n.sum(), 2)
    want = [np.zeros(x.shape) for x in sums]
    for _, walk in hmm.walks(sequence, lengths):
        walk.expect(model, *want)
    assert all(np.allclose(x, y) for x, y in zip(sums, want))


def test_packed_pairs_are_every_pair_of_the_training_texts(spark, odd, monkeypatch):
    """Each round reads a few packed rows, cut anywhere, and not a row a pair."""
    monkeypatch.setattr(hmm, "PAIR_ROWS", 7)
    rows = [(i, " ".join(f"w{(i * k) % 13}" for k in range(i % 9))) for i in range(60)] + [(60, None), (61, "Same same")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    vocab = hmm.vocabulary(hmm.count_words(docs), dictionary=6, symbols=4)
    sent = spark.sparkContext.broadcast(vocab)
    want, reader = {}, hmm.Reader(vocab)
    for i, text in rows:
        if not is_held_out(i):
            own = reader.read(pa.array([text], pa.string()))[-2].tolist()
            for pair in zip(own, own[1:]):
                want[pair] = want.get(pair, 0) + 1
    packed = hmm.count_pairs(hmm.training_symbols(docs, sent), sent).mapInArrow(hmm._pack_pairs, "pairs binary, times binary")
    got, sums = [], [np.zeros(s) for s in ((vocab.size, 2), (2, 2), (2,))]
    model = random_model(np.random.default_rng(4), 2, vocab.size)
    for row in packed.collect():
        pair, n = (np.frombuffer(row[c], "<i8") for c in ("pairs", "times"))
        assert len(pair) <= 7 or len(pair) == len(n) and (pair[1:] > pair[:-1]).all()
        got += zip((pair // vocab.size).tolist(), (pair % vocab.size).tolist(), n.tolist())
        hmm.add_pairs(model, pair // vocab.size, pair % vocab.size, n, *sums)
    assert {(a, b): n for a, b, n in got} == want and len(got) == len(want)
    assert sums[0].sum() == pytest.approx(2 * sum(want.values())) and sums[1].sum() == pytest.approx(sum(want.values()))


def test_class_is_the_checksum_of_the_last_three_bytes():
    words = [b"a", b"", b"word", "größe".encode(), b"xyz", b"yz"]
    assert hmm._class_of(words).tolist() == [zlib.crc32(w[-3:]) % hmm.CLASSES for w in words]
