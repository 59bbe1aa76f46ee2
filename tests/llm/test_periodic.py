import hashlib
import random
import zlib

import numpy as np
import pytest

from eventlab.llm import periodic, queries
from eventlab.llm.periodic import CoverLCE, longest_run, periodic_runs


def brute_runs(words, least=12):
    """All maximal stretches by each period, smallest first."""
    found = {}
    n = len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(least, 2 * q):
                found.setdefault((start, i + q - start), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed(words, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def words_of(text):
    return [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]


def check(rows, texts, prepare=lambda d, w: w):
    assert len(rows) == len(texts)
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], bytes(r.collapsed).decode()) for r in rows), key=str)
    want = []
    for d, t in texts:
        w = prepare(d, words_of(t))
        runs = brute_runs(w)
        want.append((d, len(w), runs, collapsed(w, runs)))
    assert got == sorted(want, key=str)


def test_lce_against_brute_force():
    rng = np.random.default_rng(1)
    for size, letters in ((1, 1), (5, 1), (40, 1), (200, 2), (300, 3), (500, 1)):
        codes = np.r_[rng.integers(0, letters, size), letters]
        lce = CoverLCE(codes)
        i, j = (x.ravel() for x in np.meshgrid(np.arange(len(codes)), np.arange(len(codes))))
        i, j = i[i < j], j[i < j]
        got = lce.ask(i, j)
        for a, b, n in zip(i.tolist(), j.tolist(), got.tolist()):
            want = 0
            while b + want < len(codes) and codes[a + want] == codes[b + want]:
                want += 1
            assert n == want


@pytest.mark.parametrize("strides", [256, 3])
def test_random_and_periodic_texts(spark, monkeypatch, strides):
    rng = random.Random(2)
    rows = []
    for d in range(300):
        unit = [rng.choice("abcd") for _ in range(rng.randrange(1, 9))]
        kind = d % 5
        text = [rng.choice("ab") for _ in range(rng.randrange(0, 60))] if kind == 0 else [rng.choice("xyzw") for _ in range(rng.randrange(5))] + unit * rng.randrange(1, 12) + unit[: rng.randrange(len(unit) + 1)] + [rng.choice("abc") for _ in range(rng.randrange(9))]
        if kind == 3:
            text = text + text
        rows.append((d, " ".join(text)))
    # tasks are forked from here or read the module anew; the functions are tried here, too
    monkeypatch.setattr(periodic, "STRIDES", strides)
    monkeypatch.setattr(periodic, "AT_ONCE", 50)
    done = list(periodic._slice_runs([t.encode().split() for _, t in rows], 12))
    for (d, t), (runs, kept) in zip(rows, done):
        assert runs == brute_runs(t.split()) and kept.decode() == collapsed(t.split(), runs)
    check(periodic_runs(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect(), rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a " * 30), (4, "a b " * 6), (4, "a b " * 6), (5, "w " * 20_000), (6, " ".join(f"w{k % 5000}" for k in range(12_000))), (7, "x"), (8, "ä b " * 12)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, runs int, n_words string")
    out = periodic_runs(df).collect()
    small = {5: [(0, 20_000, 1)], 6: [(0, 12_000, 5000)]}
    check([r for r in out if r.doc_id not in small], [r for r in rows if r[0] not in small])
    assert {r.doc_id: [tuple(x) for x in r.runs] for r in out if r.doc_id in small} == small
    assert periodic_runs(df.limit(0)).count() == 0


def test_query(spark, sf_dir):
    """The registered query, with its own change of every tenth document, against brute force."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    out = queries.op11_periodic_runs(spark, sf_dir).collect()
    assert len(out) == len(texts)
    changed = 0
    for r in out:
        w = words_of(texts[r.doc_id])
        p = planted(r.doc_id, w)
        changed += p != w
        if len(p) > 3000:
            continue
        runs = brute_runs(p)
        best = min(((-n, s, q) for s, n, q in runs), default=None)
        want = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), *want)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(p, runs).encode()).hexdigest()
    assert changed > 5


def test_longest_run(spark):
    df = spark.createDataFrame([([(4, 20, 3), (1, 20, 7), (1, 20, 5)],), ([],)], f"runs {periodic.RUNS}")
    assert [r.best and tuple(r.best) for r in df.select(longest_run(df["runs"]).alias("best")).collect()] == [(1, 20, 5), None]


def test_slices_with_pairs_that_agree_and_no_run(spark):
    """A word that comes again in a slice that has no run, as in a short slice at the end of a batch."""
    assert list(periodic._slice_runs([b"a a b c".split(), b"d e d f g".split()], 12)) == [([], b"a a b c"), ([], b"d e d f g")]
    rows = [(1, "a a b c"), (2, None), (3, "the one and the other")]
    check(periodic_runs(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect(), rows)
