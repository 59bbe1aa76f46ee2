from collections import defaultdict

import pytest

from eventlab.llm import mixing
from eventlab.llm.mixing import mix, repeat_rows


def slow_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """sizes: {source: words}; rounds of resharing by weight."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    goal, target, full = share * sum(sizes.values()), {}, set()
    while True:
        left = goal - sum(most * sizes[s] for s in full)
        rest = sum(w[s] for s in order if s not in full)
        target = {s: most * sizes[s] if s in full else left * w[s] / rest for s in order}
        over = {s for s in order if s not in full and target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def rows_of(df):
    return sorted(((r.doc_id, r.source, r.size, r.copies) for r in df.collect()), key=str)


def check(rows, near=0.5):
    per = defaultdict(list)
    for r in rows:
        per[r.source].append(r)
        assert r.taken == r.size * r.copies <= 2 * r.size
    want = slow_targets({s: sum(r.size for r in x) for s, x in per.items()})
    for s, x in per.items():
        total = sum(r.size for r in x)
        assert x[0].source_size == total and x[0].target == pytest.approx(want[s], rel=1e-9, abs=1e-9)
        assert abs(sum(r.taken for r in x) - want[s]) <= max(0.01 * want[s], sorted(r.size for r in x)[int(near * (len(x) - 1))])
        if total:
            ratio = want[s] / total
            assert all(r.copies in (int(ratio + 1e-9), int(ratio + 1e-9) + 1) for r in x)
            assert abs(sum(r.copies for r in x) - ratio * len(x)) <= 2.01


def test_documents(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = mix(docs)
    check(first.collect(), near=1)
    assert rows_of(mix(docs.repartition(5))) == rows_of(first)
    assert rows_of(mix(docs, seed=2)) != rows_of(first)
    monkeypatch.setattr(mixing, "BLOCK", 3)  # many levels
    monkeypatch.setattr(mixing, "FAN", 2)
    check(mix(docs).collect(), near=1)


def test_near_targets(spark, sf_dir):
    """Sources of 50 documents: words within 2 % or half the median document, documents within 2, for each source and seed."""
    docs = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet")
    for seed in (1, 2, 3):
        rows = mix(docs, seed=seed).collect()
        check(rows, near=1)
        per = defaultdict(list)
        for r in rows:
            per[r.source].append(r)
        for x in per.values():
            median = sorted(r.size for r in x)[len(x) // 2]
            assert abs(sum(r.taken for r in x) - x[0].target) <= max(0.02 * x[0].target, median / 2)


def test_flight_decides_the_largest_first():
    """Both totals stay as they are, the largest document is decided before smaller ones run out, and each keeps its probability."""
    import random

    import numpy as np

    rng, mean, large = random.Random(3), np.zeros(30), 0
    size = np.array(sorted((rng.randrange(20, 900) for _ in range(30)), reverse=True), float)
    start = np.array([rng.uniform(0.1, 0.9) for _ in size])
    for _ in range(2000):
        p, on = start.copy(), np.arange(30)
        while len(on) > mixing.LANDING:
            q = mixing._move(size[on], p[on], rng.random())
            if q is None:
                break
            p[on] = q
            assert p @ size == pytest.approx(start @ size) and p.sum() == pytest.approx(start.sum())
            on = np.flatnonzero((p > 0) & (p < 1))
        large += sum(k < 12 for k in on)
        mean += p
    assert np.abs(mean / 2000 - start).max() < 0.05 and large / 2000 < 0.5  # of the 12 largest


def test_move_of_few_and_equal_sizes():
    import numpy as np

    for size in ([5, 5, 5], [9, 5, 5], [9, 5], [5, 5], [7], [9, 5, 5, 5], [9, 7, 5], [0, 0], [4, 0, 0, 0]):
        p = np.full(len(size), 0.4)
        q = mixing._move(np.array(size, float), p, 0.3)
        if len(size) == 1 or size == [9, 5]:
            assert q is None
        else:
            assert q @ size == pytest.approx(p @ size) and q.sum() == pytest.approx(p.sum())
            assert ((q == 0) | (q == 1)).any() and (q >= 0).all() and (q <= 1).all()


def test_inclusion_follows_the_probability(spark):
    df = spark.createDataFrame([(i, " ".join("w" * (1 + i % 7)), s) for i in range(40) for s in "ab"], "doc_id long, text string, source string")
    n = defaultdict(int)
    for seed in range(3):
        for r in mix(df, seed=seed).collect():
            n[r.source] += r.copies
            assert r.copies in (1, 2)
    assert n["a"] / n["b"] == pytest.approx(2 / 1, rel=0.05)


def test_odd_rows(spark):
    rows = [(1, None, "b"), (2, "", "b"), (3, "a b c", None), (3, "a b c", None), (None, "x " * 5000, "a"), (4, "y", "a"), (5, "z z", "é"), (6, None, "empty")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size int, p int")
    out = mix(df).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.taken == r.size * r.copies <= 2 * r.size
    assert mix(df.limit(0)).count() == 0


def test_repeat_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.unionByName(docs.limit(7)).unionByName(docs.limit(3).selectExpr("null as doc_id", "text", "lang", "null as source", "n_chars"))
    mixed = mix(docs)
    got = repeat_rows(docs, mixed)
    assert got.columns == docs.columns
    want = defaultdict(int)
    for r in mixed.collect():
        want[r.doc_id] += r.copies
    have = defaultdict(int)
    for r in got.collect():
        have[r.doc_id] += 1
    assert {k: v for k, v in want.items() if v} == dict(have)


def test_landing_keeps_the_probabilities():
    """Each document is taken with its probability, and the words are near to theirs."""
    import random

    import numpy as np

    rng = random.Random(1)
    for _ in range(6):
        size = [float(rng.randrange(50, 900)) for _ in range(12)]
        p = [rng.uniform(0.05, 0.95) for _ in size]
        ways, q = mixing._design(size, p)
        assert np.abs(q @ ways - p).max() < 1e-3
        assert q @ np.abs((ways - p) @ size) < 0.5 * sum(size) / 12


def test_many_equal_rows(spark, monkeypatch):
    """Rows without doc_id and of one size are spread over blocks like others."""
    monkeypatch.setattr(mixing, "BLOCK", 50)
    df = spark.createDataFrame([(None, "w w w", "a")] * 700 + [(i, "v " * (i % 5 + 1), "b") for i in range(300)], "doc_id long, text string, source string")
    out = mix(df).collect()
    assert len(out) == 1000
    check(out, near=1)


def test_repeat_many_equal_rows(spark):
    """Equal rows, and others of the same key, come as often as the mixture takes rows of their key."""
    rows = [(None, "w w w", "a", 1)] * 500 + [(None, "v v v", "a", 2)] * 300 + [(None, "v v v", "a", 3)] + [(i, "x " * (i % 9 + 1), "b", 0) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int").repartition(4)
    mixed = mix(docs)
    got = repeat_rows(docs, mixed)
    taken = defaultdict(int)
    for r in mixed.collect():
        taken[r.doc_id, r.source, r.size] += r.copies
    have = defaultdict(int)
    for r in got.collect():
        have[r.doc_id, r.source, len(r.text.split())] += 1
    assert have == {k: v for k, v in taken.items() if v}
    # each row of a key comes as often as another, or once more
    per = defaultdict(int)
    for r in got.where("source = 'a'").collect():
        per[r.text, r.n] += 1
    ratio = sum(per.values()) / 801
    for (text, n), k in per.items():
        most = {1: 500, 2: 300, 3: 1}[n]
        assert int(ratio) * most <= k <= (int(ratio) + 1) * most
