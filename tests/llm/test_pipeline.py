import os
from collections import Counter

import test_bpe
import test_linededup
import test_mixing
import test_quality
import test_simhash

import corpus_pipeline
from eventlab.llm import mixing, simhash
from eventlab.llm.tables import cut, shared_dir


def table(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_every_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (10**6, "", "en", "src0", 0), (10**6 + 1, "", "en", "src0", 0)], docs.schema)
    docs = cut(docs.unionByName(odd))
    names = docs.columns
    rows = table(docs)
    stage = dict(corpus_pipeline.STAGES)

    # quality rules
    out = cut(stage["quality rules"](spark, docs, sf_dir))
    kept = Counter(b[0] for b in test_quality.brute([(r[0], r[1], r[2], r[3]) for r in rows]) if b[-1])
    assert out.columns == names and table(out) == [r for r in rows if kept[r[0]]]

    # line dedup
    docs, rows = out, table(out)
    out = cut(stage["line dedup"](spark, docs, sf_dir))
    import hashlib

    want = [(b[0], b[3]) for b in test_linededup.brute([(r[0], r[1]) for r in rows])]
    assert out.columns == names
    assert sorted((r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in table(out)) == sorted(want)
    assert all(r[4] == len(r[1]) for r in table(out))

    # near-duplicates
    docs, rows = out, table(out)
    out = cut(stage["near-duplicates"](spark, docs, sf_dir))
    want = test_simhash.groups_of([(r[0], r[1]) for r in rows])
    first = {}
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(want[r[1] or ""], r)
    assert out.columns == names and table(out) == sorted(first.values(), key=str) and len(first) < len(rows)

    # mixture
    docs, rows = out, table(out)
    out = cut(stage["mixture"](spark, docs, sf_dir))
    mixed = mixing.mix(docs).collect()
    test_mixing.check(mixed, near=1)
    copies = {m.doc_id: m.copies for m in mixed}
    assert out.columns == names and table(out) == [r for r in rows for _ in range(copies[r[0]])]

    # tokens
    import tiktoken
    import public_tokenizers
    from eventlab.llm import bpe

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(test_bpe.PATH), special_tokens={})
    last = stage["tokens"](spark, out, sf_dir)
    assert test_bpe.got(last) == test_bpe.wanted(library, [(r[0], r[1]) for r in table(out)])


def test_empty_and_extra_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for d in (docs.limit(0), docs.limit(60).selectExpr("*", "1 as kept", "'x' as n_words", "2 as copies", "'r' as runs", "7 as n_dropped", "8 as _nth", "9 as _row", "'l' as _list", "1 as _copies", "2 as _copy", "3 as _k0", "'t' as _text")):
        for name, f in corpus_pipeline.STAGES[:-1]:
            out = cut(f(spark, d, sf_dir))
            assert out.columns == d.columns, name
            if "_nth" in d.columns:
                assert out.where("_nth <> 8 or _row <> 9 or _list <> 'l' or _copies <> 1 or _copy <> 2 or _k0 <> 3 or _text <> 't' or runs <> 'r'").isEmpty(), name
            d = out


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns[:2] == ["doc_id", "n_tokens"] and out.count() > 0


def test_near_duplicates_keep_every_distinct_text(spark):
    """A doc_id with two texts, rows that differ in another column only, rows without doc_id, and repeated rows."""
    words = lambda k, n=80: " ".join(f"{k}word{i}" for i in range(n))
    rows = [(0, words("a"), "en"), (1, words("a"), "en"), (1, words("b"), "en"), (2, words("c"), "x"), (2, words("c"), "y"), (None, words("d"), "en"), (None, words("d"), "en"), (3, words("e"), "en"), (3, words("e"), "en"), (None, words("a"), None), (4, words("e") + " more", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    stage = dict(corpus_pipeline.STAGES)["near-duplicates"]
    for d in (docs, docs.repartition(5)):
        out = table(stage(spark, d, ""))
        assert [(r[0], r[1][0]) for r in out] == [(0, "a"), (1, "b"), (2, "c"), (3, "e"), (None, "d")]
        assert out == table(stage(spark, docs, ""))


def test_near_duplicates_connect_once_and_clean_up(spark, monkeypatch):
    """A chain of texts, each near to the next only, is one group after several rounds; what is connected is computed once, and tables of the rounds are gone."""
    calls, plain = [], simhash.components
    monkeypatch.setattr(simhash, "components", lambda edges, *a: (calls.append(1), plain(edges, *a))[1])
    chain = [" ".join(f"w{i}" for i in range(8 * k, 8 * k + 160)) for k in range(40)]
    other = [" ".join(f"v{i}" for i in range(100)), "short", ""]
    rows = [(i, t) for i, t in enumerate(chain[::-1] + other + chain[:5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    shared = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(shared))
    out = table(dict(corpus_pipeline.STAGES)["near-duplicates"](spark, docs, ""))
    assert [r[0] for r in out] == [0, 40, 41, 42] and len(calls) == 1
    assert sorted(x.split("-")[0] for x in set(os.listdir(shared)) - before) == ["groups", "stays"]
