import hashlib
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa

import duckdb
import pytest

from eventlab.llm import queries, substrings
from eventlab.llm.substrings import ORACLE_SQL, dedup_substrings, repeated_stretches, super_kmers


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def brute(rows, width=20):
    """Documents with equal doc_id and text are one; those of one doc_id alone are not told apart further (see the tests)."""
    docs = sorted({(d is None, d or 0, t or "") for d, t in rows})
    seen, gone = set(), {}
    for key in docs:
        w = words_of(key[2])
        gone[key] = set()
        for k in range(len(w) - width + 1):
            window = tuple(w[k : k + width])
            if window in seen:
                gone[key] |= set(range(k, k + width))
            seen.add(window)
    out = []
    for d, t in rows:
        w, g = words_of(t), gone[(d is None, d or 0, t or "")]
        out.append((d, len(w), len(g), " ".join(x for k, x in enumerate(w) if k not in g)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, bytes(r.kept).decode()) for r in df.collect()), key=str)


def test_super_kmers_cover_each_window_once():
    rng = np.random.default_rng(3)
    lens = [0, 3, 19, 20, 21, 400, 1, 77]
    hashes = rng.integers(0, 40, sum(lens)).astype(np.uint64)
    begins = np.cumsum(lens) - lens
    ends = np.repeat(begins + lens, lens)
    first, n, mini = super_kmers(hashes, ends, 20, 4)
    seen = [k for a, m in zip(first.tolist(), n.tolist()) for k in range(a, a + m)]
    assert seen == [k for b, m in zip(begins, lens) for k in range(b, b + m - 19)]
    by_window = {}
    for a, m, g in zip(first.tolist(), n.tolist(), mini.tolist()):
        for k in range(a, a + m):
            assert by_window.setdefault(hashes[k : k + 20].tobytes(), g) == g


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = brute(rows)
    assert got(dedup_substrings(docs)) == want
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    digests = sorted((d, n, g, hashlib.sha256(t.encode()).hexdigest()) for d, n, g, t in want)
    assert sorted(db.execute(ORACLE_SQL).fetchall()) == digests == sorted(map(tuple, queries.op13_substring_dedup(spark, sf_dir).collect()))
    assert sum(w[2] for w in want) > 0


@pytest.mark.parametrize("partitions", [1, 40])
def test_small_windows_in_few_letters(spark, partitions):
    """Windows of 5 of few different words: buckets with many strings, cut over many partitions."""
    rng = random.Random(4)
    rows = [(d, " ".join(rng.choice("ab" if d % 3 else "abcdefgh") for _ in range(rng.randrange(40)))) for d in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for seed in (1, 3, 5):
            assert got(dedup_substrings(df, 5, seed)) == brute(rows, 5)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_large_bucket_in_passes():
    """A bucket sorted in several passes gives what one pass gives."""
    rng = random.Random(5)
    strings = [(b" ".join(rng.choice((b"a", b"b")) for _ in range(9)), (False, d, 0, 0)) for d in range(300)]
    whole = [sorted(x) for x in substrings._bucket(strings, 5)]
    old, substrings.AT_ONCE = substrings.AT_ONCE, 100
    try:
        assert [sorted(x) for x in substrings._bucket(strings, 5)] == whole
    finally:
        substrings.AT_ONCE = old


def test_copies_in_a_third_of_all_rows(spark):
    """One text copied over and over, and near copies of another: all but the first go, whatever the partitions."""
    copy = " ".join(f"c{k}" for k in range(60))
    near = [f"n{k}" for k in range(80)]
    rng = random.Random(6)
    rows = []
    for d in range(900):
        if d % 3 == 0:
            rows.append((d, copy))
        elif d % 3 == 1:
            w = list(near)
            w[rng.randrange(80)] = f"edit{d}"
            rows.append((d, " ".join(w)))
        else:
            rows.append((d, " ".join(f"u{d}x{k}" for k in range(50))))
    out = got(dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(16)))
    assert out == brute(rows)
    assert sum(1 for r in out if r[1] == 60 and r[2] == 60) == 299


def test_odd_rows(spark):
    a, b = " ".join(f"a{k}" for k in range(25)), " ".join(f"b{k}" for k in range(30))
    rows = [(1, None), (2, ""), (3, "short text"), (5, f"{a} \n\t {b}"), (4, b), (None, a), (None, b + " x"), (6, b.upper()), (7, "ä ö " * 40), (8, "w " * 5000), (9, a), (9, a), (9, a), (10, " ".join(a.split()[:20]))]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, doc int, words string, t int")
    out = got(dedup_substrings(df))
    assert out == brute(rows)
    by = {(r[0], r[1]): r[2] for r in out}
    assert by[(5, 55)] == 30 and by[(8, 5000)] == 4999 and by[(9, 25)] == 25 and by[(10, 20)] == 20
    assert dedup_substrings(df.limit(0)).count() == 0


def test_different_texts_of_one_doc_id(spark):
    """They are two documents, in a fixed order: what they share stays in one of them."""
    a = " ".join(f"a{k}" for k in range(25))
    df = spark.createDataFrame([(1, a), (1, a + " more")], "doc_id long, text string")
    assert sorted(r.n_removed for r in dedup_substrings(df).collect()) == [0, 25]


def test_only_repeats_travel(spark):
    """Windows that occur once aren't packed, and a row of the result is merged stretches."""
    rows = [(d, " ".join(f"u{d}x{k}" for k in range(100))) for d in range(50)] + [(100, " ".join(f"u7x{k}" for k in range(100)))]
    found = repeated_stretches(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.doc for r in found] == [100]
    words = sorted((s["from"], s["to"]) for s in found[0].stretches)
    assert words[0][0] == 0 and max(w[1] for w in words) == 100


def test_words_are_those_of_the_contract():
    texts = [b" \x0b a\x1c\xc2\xa0b\xff\x85 \r\n\x0c c\x00d\t", b"", b" \n ", None, b"x", "ä\u2003ö  ü".encode(), b"y z"]
    batch = pa.RecordBatch.from_arrays([pa.array([b"left out", *texts], pa.binary())], ["text"]).slice(1)
    old, substrings.SLICE = substrings.SLICE, 20
    try:
        slices = list(substrings._slices(batch, 0))
    finally:
        substrings.SLICE = old
    assert [at for at, _ in slices] == [0, 3] and sum(len(t) for _, t in slices) == len(texts)
    for at, part in slices:
        words, lens = substrings._split(part)
        want = [(t or b"").split() for t in texts[at : at + len(part)]]
        assert lens.tolist() == [len(w) for w in want] and words.to_pylist() == [x for w in want for x in w]


class Taken:
    """Takes the place of a table: keeps the function of ``mapInArrow``."""

    def mapInArrow(self, run, schema):
        self.run = run
        return self

    def select(self, *cols):
        return self

    groupBy = agg = where = select


@pytest.mark.parametrize("mb", [4, 12])
def test_memory_of_a_worker_does_not_follow_the_batch(spark, mb):
    """Batches of 4 and 12 MB of different words take the same few MB of Python's and numpy's memory."""
    taken = Taken()
    substrings.repeated_minimisers(taken, 20, 4)
    texts = [b" ".join(b"%07d" % (d * 1250 + k) for k in range(1250)) for d in range(mb * 100)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], ["text"])
    tracemalloc.start()
    try:
        n = sum(b.num_rows for b in taken.run(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n > mb * 100 * 100 and peak < 60 << 20


def test_large_bucket_in_parts(monkeypatch):
    """A bucket of many windows is never unpacked whole, and its parts give what all of it gives."""
    rng = random.Random(7)
    rows = []
    for mini, n in ((1, 40), (2, 2500), (3, 60)):
        for d in range(n):
            w = b" ".join(b"%d%c" % (mini, rng.choice(b"abc")) for _ in range(9))
            rows.append((mini, w, d % 50 == 0, d, 0, 100 * rng.randrange(3)))
    rows = sorted({(r[0], hashlib.md5(r[1]).digest(), *r[1:]) for r in rows})
    cols = list(zip(*((r[0], *r[2:]) for r in rows)))
    types = [pa.int64(), pa.binary(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["mini", "words", "none", "doc", "t", "start"])
    sizes, whole = [], substrings._bucket
    monkeypatch.setattr(substrings, "AT_ONCE", 100)
    monkeypatch.setattr(substrings, "_bucket", lambda strings, width: sizes.append(len(strings)) or whole(strings, width))
    out = [tuple(r.values()) for b in substrings._judge(5)(iter([batch.slice(k, 70) for k in range(0, len(rows), 70)])) for r in b.to_pylist()]
    assert max(sizes) <= 20 and sum(sizes) == len({r[2] for r in rows})
    first, places = {}, {}
    for *place, upto, digest in out:
        if digest is not None:
            assert upto == place[3] + 5
            first[digest] = min(first.get(digest, place), place)
    for _, _, w, *place, start in rows:
        for k, x in enumerate(substrings._windows(w, 5)):
            places.setdefault(x, set()).add((*place, start + k))
    covered = lambda spans: {(*p[:3], k) for p, upto in spans for k in range(p[3], upto)}
    want = covered((p, p[3] + 5) for found in places.values() for p in found - {min(found)})
    assert covered((p, upto) for *p, upto, digest in out if digest is None or p != first[digest]) == want
