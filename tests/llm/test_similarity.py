"""Near copies by Jaccard similarity against brute force."""

import numpy as np
import pytest

pytest.importorskip("wayloom.llm")
import corpus_pipeline

from wayloom.llm import simhash, similarity


def brute(items):
    """The ids that stay, by the smallest id of every group."""
    sets = []
    for _, t in items:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    found = list(range(len(items)))
    find = lambda x: x if found[x] == x else find(found[x])
    for i in range(len(items)):
        for j in range(i):
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                found[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(items):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(d for i, (d, _) in enumerate(items) if d is not None and low[find(i)] == d)


@pytest.fixture(scope="module")
def items():
    """Originals, their edited copies and copies of copies, short and empty texts, a row without an id."""
    rng, held = np.random.default_rng(1), []
    for i in range(260):
        if held and rng.random() < 0.7:
            w = held[int(rng.integers(len(held)))][1].split()
            for _ in range(int(rng.integers(1, 4))):
                w[int(rng.integers(len(w)))] = f"e{rng.integers(10**6)}"
        else:
            w = [f"w{x}" for x in rng.integers(0, 500, int(rng.integers(30, 150)))]
        held.append((i, " ".join(w)))
    odd = [(300, None), (301, ""), (302, "A b"), (303, "a  B"), (304, held[0][1].upper()), (None, held[1][1]), (305, "one two three four five six")]
    return held + odd


def stay(frame, **options):
    return sorted(r[0] for r in simhash.keepers(frame, **options).filter("doc_id is not null").collect())


def test_keepers(spark, items):
    frame = spark.createDataFrame(items, "doc_id long, text string")
    want = brute(items)
    assert stay(frame) == want and len(want) < 240
    # the row without an id is equal in words to held[1] and comes after it
    assert simhash.keepers(frame).filter("doc_id is null").count() == 0
    assert simhash.keepers(frame.filter("false")).count() == 0


def test_cells(spark, items):
    """Buckets cut into cells of blocks, without the star rounds' help, find the same pairs as in one."""
    frame = spark.createDataFrame(items, "doc_id long, text string")
    masks = simhash.covering_masks(2)
    got = [sorted(map(tuple, similarity.near_groups(frame, masks, block=n).collect()), key=str) for n in (1024, 3)]
    assert got[0] == got[1]


def test_across(spark):
    """Buckets in which no star has linked anything: all pairs of different components, each compared once."""
    rng = np.random.default_rng(5)
    base = [np.sort(rng.integers(0, 2**62, 60, dtype=np.uint64)) for _ in range(6)]
    masks = np.array(simhash.covering_masks(2), np.uint64)
    sets = [np.sort(np.r_[base[k % 6][rng.random(60) < 0.93], rng.integers(0, 2**62, int(rng.integers(0, 4)), dtype=np.uint64)]) for k in range(90)]
    marks = [similarity.signs_of(h, masks) for h in sets]
    roots = [k % 50 for k in range(90)]
    classes = spark.createDataFrame([(k, m[0].tolist(), bytearray(m[1])) for k, m in enumerate(marks)], "node long, keys array<long>, signs binary")
    frame = spark.createDataFrame([(k, h.view(np.int64).tolist()) for k, h in enumerate(sets)], "node long, s array<long>")
    rooted = [(int(key), at, k, roots[k]) for k, m in enumerate(marks) for at, key in enumerate(m[0].tolist())]
    rooted = spark.createDataFrame(rooted, "key long, at int, node long, root long")
    jaccard = lambda x, y: len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    want = {(j, i) for i in range(90) for j in range(i) if roots[i] != roots[j] and jaccard(sets[i], sets[j]) >= 0.8}
    for block in (1024, 7):
        got = [tuple(r) for r in similarity.across(rooted, classes, frame, (4, 5), 75, block).collect()]
        assert len(got) == len(set(got)) and set(got) == want and want


def test_one_id_two_texts(spark):
    frame = spark.createDataFrame([(1, "a b c d e f"), (2, "a B c d e f"), (2, "another text")], "doc_id long, text string")
    assert sorted(map(tuple, simhash.keepers(frame).collect())) == [(1, "a b c d e f"), (2, "another text")]


def test_stage(spark, items):
    """The pipeline's near stage leaves no pair of 0.8."""
    frame = spark.createDataFrame([(i, t) for i, t in items if i is not None and t], "doc_id long, text string")
    out = dict(corpus_pipeline.STAGES)["near_dedup"](spark, frame, "")
    assert sorted(r[0] for r in out.collect()) == brute([(r[0], r[1]) for r in frame.collect()])
    left = sorted((r[0], r[1]) for r in out.collect())
    assert brute(left) == [i for i, _ in left]


def test_recall_on_the_test_table(spark):
    """All pairs of 0.8 and more among the documents of the smallest table, by brute force."""
    import os

    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.isfile(path):
        pytest.skip("no test tables")
    frame = spark.read.parquet(path).select("doc_id", "text")
    items = [(r[0], r[1]) for r in frame.collect()]
    assert stay(frame) == brute_by_shingle(items)


def brute_by_shingle(items):
    """As brute(), with the pairs that share a shingle only; texts without a word stay."""
    from collections import Counter, defaultdict

    sets, by = [], defaultdict(list)
    for k, (_, t) in enumerate(items):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
        for s in sets[-1]:
            by[s].append(k)
    found = list(range(len(items)))

    def find(x):
        while found[x] != x:
            x = found[x]
        return x

    for i in range(len(items)):
        common = Counter(j for s in sets[i] for j in by[s] if j < i)
        for j, n in common.items():
            if 5 * n >= 4 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                found[b] = a
    low = {}
    for i, (d, _) in enumerate(items):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted(d for i, (d, _) in enumerate(items) if low[find(i)] == d)
