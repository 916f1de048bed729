import os
import random
import re

import numpy as np
import pytest

from opslens.llm import jaccard_join as jj
from opslens.llm.components import components
from opslens.session import shared_dir


def shingles(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if len(words) < 4:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 4]) for i in range(len(words) - 3)}


def brute(rows, percent=85):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if x and y and i is not None and j is not None and 100 * len(x & y) >= percent * len(x | y):
                i, j = root(i), root(j)
                parent[max(i, j)] = min(i, j)
    return sorted((i, len(x), root(i)) for i, x in sets if i is not None)


def check(docs, **options):
    got = sorted(tuple(r) for r in jj.similarity_join(docs, **options).collect() if r.doc_id is not None)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], options.get("percent", 85))


def test_small_table(small):
    check(small)


def test_near_copies(spark, monkeypatch):
    draw = random.Random(4)
    word = lambda: draw.choice("abcdefgh") + draw.choice("xyz") + str(draw.randrange(6))
    rows = []
    for family in range(12):
        base = [word() for _ in range(draw.randint(3, 90))]
        for _ in range(draw.randint(1, 9)):
            copy = list(base)
            for _ in range(draw.randint(0, 4)):
                copy[draw.randrange(len(copy))] = word()
            rows.append((len(rows) * 7 % 101, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    check(docs, percent=60)
    # hot shingles dealt to several tasks, blocks of few members: the same result
    monkeypatch.setattr(jj, "HOT", 2)
    monkeypatch.setattr(jj, "BLOCK", 2)
    check(docs)


@pytest.mark.parametrize("first", [0, 5_000_000_000])
def test_pairs_that_share_only_hot_shingles(spark, monkeypatch, first):
    """Each salt holds one of the two documents, also the lowest salt."""
    monkeypatch.setattr(jj, "HOT", 1)
    rows = []
    for pair in range(30):
        words = [f"w{pair}x{k}" for k in range(60)]
        rows += [(first + 2 * pair, " ".join(words)), (first + 2 * pair + 1, " ".join([*words, f"last{pair}"]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    check(docs)
    assert {r.component_id for r in jj.similarity_join(docs).collect()} == {first + 2 * pair for pair in range(30)}


def test_signature_is_a_lower_bound():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    for _ in range(50):
        x = np.unique(rng.choice(pool, rng.integers(1, 1500)))
        y = np.unique(rng.choice(pool, rng.integers(1, 700)))
        both = len(np.intersect1d(x, y))
        assert jj.differing(jj.signature(x), jj.signature(y)) <= len(x) + len(y) - 2 * both


def test_least_overlap():
    for a in range(1, 40):
        for b in range(1, 40):
            need = jj.least_overlap(a, b, 85)
            assert 100 * need >= 85 * (a + b - need) and not 100 * (need - 1) >= 85 * (a + b - need + 1)


def test_odd_rows(odd, none):
    check(odd)
    assert jj.similarity_join(odd).count() == odd.count()
    kept = jj.keep_first(odd)
    assert kept.columns == odd.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == [-5, 1, 2, 3, 4, 5, 6, 8, 9]
    assert jj.similarity_join(none).count() == 0 and jj.keep_first(none).count() == 0


@pytest.mark.parametrize("edges", [[(1, 1)], [(i, i + 1) for i in range(40)], [(3, 1), (2, 3), (9, 8), (7, 9), (5, 4), (5, 5)]])
def test_components(spark, edges):
    parent = {x: x for e in edges for x in e if e[0] != e[1]}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {tuple(r) for r in got} == {(x, root(x)) for x in parent} and len(got) == len(parent)


def test_rounds_after_the_first_read_live_rows_only(spark, monkeypatch):
    """Documents that share a passage and little else go through the groups once; near copies go on until they are one."""
    monkeypatch.setattr(jj, "BLOCK", 3)
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(5))
    passage = [word() for _ in range(12)]
    rows = [(i, " ".join([*passage, *(word() for _ in range(30))])) for i in range(40)]
    base = [word() for _ in range(120)]
    for i in range(40, 80):  # each differs from its neighbour in one word, and from others in ever more
        base = [*base]
        base[i] = word()
        rows.append((i, " ".join(base)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    read, inner = [], jj._between_components

    def counted(runs, *rest):
        read.append((runs.count(), rest[-1]))
        return inner(runs, *rest)

    monkeypatch.setattr(jj, "_between_components", counted)
    check(docs)
    assert len(read) > 1 and read[0][1] and all(n < read[0][0] / 2 for n, _ in read[1:])
    # without rounds of nearest ones the full comparison finds the same
    monkeypatch.setattr(jj, "NEAREST_ROUNDS", 1)
    check(docs)


def test_signatures_travel_for_documents_of_pairs(spark, monkeypatch):
    rows = [(i, 1, bytes(jj.LEAST_SIGNATURE // 8)) for i in range(500)]
    rows += [(1, 1, b"\xff" * (jj.LEAST_SIGNATURE // 8))]  # another text of the same id
    facts = spark.createDataFrame(rows, "doc_id bigint, n bigint, signature binary")
    pairs = spark.createDataFrame([(1, 2, 1), (3, 4, 2)], "a bigint, b bigint, shared bigint")
    seen, inner = [], jj._spotted
    monkeypatch.setattr(jj, "_spotted", lambda sent, names: seen.append(int(np.bitwise_count(sent.value).sum())) or inner(sent, names))
    got = sorted(tuple(r) for r in jj.suffix_filter(pairs, facts, 85).collect())
    assert got == [(1, 2, 1), (3, 4, 2)] and seen == [4]


def test_no_table_of_rounds_stays_behind(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"one two three four five {i // 2}") for i in range(20)], "doc_id bigint, text string")
    folder = shared_dir(spark)
    before = set(os.listdir(folder.removeprefix("file:")))
    jj.keep_first(docs).collect()
    new = {name.rsplit("-", 1)[0] for name in set(os.listdir(folder.removeprefix("file:"))) - before}
    assert new == {"join-groups"}


def test_tasks_hold_little_at_once(spark, tmp_path, monkeypatch):
    """Long texts reach the tasks some at a time, and what was sent leaves the executors."""
    rows = [(i, " ".join(f"w{i // 2}x{k}" for k in range(3000))) for i in range(400)]  # some 8 MB
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    seen, inner, gone = tmp_path / "sizes", jj._facts, []

    def noted(size):
        run = inner(size)

        def sizes(batches):
            for batch in batches:
                with open(seen, "a") as file:
                    print(batch.nbytes, file=file)
                yield batch

        return lambda batches: run(sizes(batches))

    monkeypatch.setattr(jj, "_facts", noted)
    ends = jj._ends
    monkeypatch.setattr(jj, "_ends", lambda pairs, sent: gone.append(sent) or ends(pairs, sent))
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    assert jj.keep_first(docs).count() == 200
    sizes = [int(x) for x in seen.read_text().split()]
    assert sum(sizes) > 4 * jj.HELD_BYTES and max(sizes) < 2 * jj.HELD_BYTES
    assert gone and not any(gone)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_sets_are_made_and_compared_in_different_tasks(spark):
    """A core never runs two Python workers, also if the pairs are few enough for a broadcast."""
    docs = spark.createDataFrame([(i, "one two three four five") for i in range(6)], "doc_id bigint, text string")
    pairs = spark.createDataFrame([(1, 2), (3, 5)], "a bigint, b bigint")
    links = jj.verify(docs, pairs, 4, 85)
    assert {tuple(r) for r in links.collect()} == {(1, 2), (3, 5)}
    assert "Broadcast" not in links._jdf.queryExecution().executedPlan().toString()
