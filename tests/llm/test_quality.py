import itertools
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from eventlab.llm import quality
from eventlab.llm.quality import quality_rules
from eventlab.llm.tables import cut


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "lines": len(lines),
    }


def brute(rows):
    """rows: (doc_id, text, lang, source) -> {(doc_id, counts..., base_failed, kept)}: the counts by Python, the verdict by the SQL."""
    import pandas as pd

    db = duckdb.connect()
    db.register("documents", pd.DataFrame({n: pd.array([r[i] for r in rows], dtype=t) for i, (n, t) in enumerate((("doc_id", "Int64"), ("text", "string"), ("lang", "string"), ("source", "string")))}))
    out = db.execute(quality.ORACLE_SQL).fetchall()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    want = []
    for d, t, _, _ in rows:
        c = counts(t)
        want.append((d, *(c[n] for n in names), c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]))
    assert sorted(want, key=str) == sorted((r[:-1] for r in out), key=str)
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in df.collect()), key=str)


def rows_of(docs):
    return [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    out = quality_rules(docs)
    have = got(out)
    assert have == brute(rows_of(docs))
    rejected = {h[0] for h in have if not h[-1] and not h[-2]}
    assert 0 < len(rejected) < 0.08 * len(have)
    one_group = docs.drop("lang", "source").selectExpr("*", "'x' as lang", "cast(null as string) as source")
    assert got(quality_rules(one_group)) == brute(rows_of(one_group))


def test_odd_rows(spark):
    prose = " ".join(f"word{i}" for i in range(80))
    texts = [None, "", " \n\t", prose, prose, prose + "\n" + prose, "a b c " * 30, "x" * 100_000, "a b c a b c d\n" + prose, "#$% " * 70, "a\n\n\na\n a\nä *|<>&\x0b\x0c\r" + prose, "é" * 60 + "\n" + "q r " * 25]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(None, prose, None, None), (3, prose, "en", "s"), (3, prose, None, "s"), (7, "one " * 60, "de", None)]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, lang string, source string, n_words int, kept string")
    assert got(quality_rules(df)) == brute(rows)
    assert quality_rules(df.limit(0)).count() == 0


def test_keeps_plain_prose_and_rejects_junk(spark):
    import random

    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["an", "the", "re", "on", "ti", "er"]) for _ in range(rng.choice([1, 1, 2, 3])))
    plain = [(i, " ".join(word() for _ in range(rng.randrange(60, 900))), "en", "s") for i in range(300)]
    junk = [(1000 + i, " ".join(word() + rng.choice(["***", "$$$", "&&&"]) for _ in range(200)), "en", "s") for i in range(30)]
    out = {r.doc_id: r.kept for r in quality_rules(spark.createDataFrame(plain + junk, "doc_id long, text string, lang string, source string")).collect()}
    assert all(out[r[0]] for r in plain) and not any(out[r[0]] for r in junk)


def test_keep_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = quality_rules(docs, keep=("text", "lang", "source", "n_chars"))
    assert out.count() == docs.count() and {"text", "lang", "source", "n_chars", "kept"} <= set(out.columns)


def estimate(spark, x):
    cols = ", ".join(f"{n} long" for n in quality.STATS)
    rows = cut(spark.createDataFrame([("en", "s", *map(int, r)) for r in x], f"lang string, source string, {cols}"))
    (e,) = quality.mcd(rows).collect()
    low = np.array([[e[f"l{i}{j}"] if j <= i else 0.0 for j in range(4)] for i in range(4)])
    return np.array([e[f"m{i}"] for i in range(4)]), low


def test_the_least_determinant(spark):
    """Against all subsets of H of the rows."""
    rng = np.random.default_rng(3)
    for k in range(3):
        x = np.vstack([rng.multivariate_normal([160, 3, 0, 10], np.diag([90, 30, 300, 80]), 10), rng.multivariate_normal([210, 50, 60, 5], np.diag([20, 20, 20, 20]), 3)]).round()
        mean, low = estimate(spark, x)
        least = min(np.linalg.det(np.cov(x[list(c)].T, bias=True) + np.diag(np.array(quality.FLOOR) ** 2)) for c in itertools.combinations(range(13), 10))
        assert np.linalg.det(low @ low.T) <= 1.05 * least
        d2 = ((np.linalg.solve(low, (x - mean).T)) ** 2).sum(0)
        assert d2[:10].max() < quality.CUTOFF < d2[10:].min()


def test_an_outlier_of_each_statistic(spark):
    """Each statistic alone can reject a text, and texts just as long with usual values stay."""
    import random

    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["an", "the", "re", "on", "ti", "er"]) for _ in range(rng.choice([1, 1, 2, 3])))
    prose = lambda n: " ".join(word() + str(rng.randrange(99)) for _ in range(n))
    lines = lambda n, w: "\n".join(prose(w) for _ in range(n))
    plain = [(i, lines(rng.randrange(6, 20), 14), "en", "s") for i in range(200)]
    odd = {
        900: " ".join(word() * 9 for _ in range(200)),  # long words
        901: lines(12, 14).replace(" ", "*#$ "),  # symbols
        902: lines(6, 14) + "\n" + "\n".join(f"{k % 3}" for k in range(60)),  # repeated lines of a word
        903: " ".join(f"{prose(6)} and so it goes again" for _ in range(40)) + "\n" + prose(30),  # repeated windows, under the base rule
    }
    rows = plain + [(k, t, "en", "s") for k, t in odd.items()]
    out = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(out[r[0]].kept for r in plain)
    assert not any(out[k].base_failed or out[k].kept for k in odd), [(k, out[k]) for k in odd]


def test_small_groups_take_the_language(spark):
    """A source of a few texts is measured by its language: junk goes though it is all that the source has."""
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["an", "the", "re", "on", "ti", "er"]) for _ in range(rng.choice([1, 1, 2, 3])))
    rows = [(i, " ".join(word() for _ in range(rng.randrange(60, 300))), "en", "big") for i in range(120)]
    rows += [(500 + i, " ".join(word() + "$$$" for _ in range(100)), "en", "small") for i in range(3)] + [(600, " ".join(word() for _ in range(100)), "en", "small")]
    out = {r.doc_id: r.kept for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert out[600] and not any(out[500 + i] for i in range(3))


def counted_steps(monkeypatch):
    steps, real = [], quality._concentrated
    monkeypatch.setattr(quality, "_concentrated", lambda cells, groups: steps.append(1) or real(cells, groups))
    return steps


def test_steps_go_on_until_nothing_falls(spark, monkeypatch):
    """A group that takes more than eight steps: a further step from its estimate lowers no determinant."""
    steps = counted_steps(monkeypatch)
    x = [(i * i // 40, (i * 7) % 60 * (i > 300), (i * i // 300) % 50, i % 40) for i in range(900)]
    mean, low = estimate(spark, x)
    assert len(steps) > 9
    x = np.array(x, float)
    d2 = ((np.linalg.solve(low, (x - mean).T)) ** 2).sum(0)
    nearest = x[np.argsort(d2, kind="stable")[: int(np.ceil(quality.H * len(x)))]]
    again = np.linalg.det(np.cov(nearest.T, bias=True) + np.diag(np.array(quality.FLOOR) ** 2))
    assert again >= np.linalg.det(low @ low.T) * 0.99  # bins are a little coarser than ranks
    monkeypatch.setattr(quality, "TOO_MANY_STEPS", 3)
    with pytest.raises(RuntimeError, match="3 steps"):
        estimate(spark, x)


def test_sql_has_steps_enough(spark, sf_dir, monkeypatch):
    """The tables take fewer steps than the SQL has, so it gives what the loop gives."""
    steps = counted_steps(monkeypatch)
    quality_rules(spark.read.parquet(f"{sf_dir.replace('0.001', '0.1')}/documents.parquet")).count()
    assert 1 < len(steps) < quality.SQL_STEPS
