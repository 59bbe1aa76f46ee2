import itertools
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np

from eventlab.llm import filteraudit, queries
from eventlab.llm.filteraudit import ORACLE_SQL, audit_filters, csr_shards


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def brute(docs, labels):
    """docs: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    rows = []
    for d, t, lang in docs:
        t, w = t or "", words_of(t)
        fails = {f for f, bad in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), any(c in "#$%&*|" for c in t), d is not None and d > least[t])) if bad}
        rows.append((lang or "", fails, d in good, d in toxic))
    out, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        for order in itertools.permutations("ABCDE"):
            gone = set()
            for step, f in enumerate(order, 1):
                mine = [(k, r) for k, r in enumerate(rows) if r[0] == part]
                removed = [(k, r) for k, r in mine if k not in gone and f in r[1]]
                redundant = sum(1 for k, r in mine if k in gone and f in r[1])
                gone |= {k for k, _ in removed}
                shapley[part, f] += len(removed)
                out[part, "".join(order), step] = (len(mine) - len(gone & {k for k, _ in mine}), len(removed), redundant, sum(1 for _, r in mine if r[1] == {f}), sum(r[2] for _, r in removed), sum(r[3] for _, r in removed))
    return sorted((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def got(df):
    return sorted(tuple(r) for r in df.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect())


def test_documents(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    want = brute([tuple(r) for r in docs.select("doc_id", "text", "lang").collect()], [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])
    assert got(queries.op12_filter_audit(spark, sf_dir)) == want
    db = duckdb.connect()
    for n in ("documents", "labels"):
        db.execute(f"CREATE VIEW {n} AS SELECT * FROM '{sf_dir}/{n}.parquet'")
    assert sorted(db.execute(ORACLE_SQL).fetchall()) == want
    assert len(want) == 600 * docs.select("lang").distinct().count()


def test_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(250))
    docs = [
        (1, None, "en"), (2, "", "en"), (None, "", "en"), (3, "ABC def", None), (4, "ABC def", ""), (4, "ABC def", ""), (5, long, "fr"), (6, long, "fr"), (7, long + " $", "fr"), (7, long, "de"),
        (8, "same " * 300, "fr"), (9, "Ä" * 50, "fr"), (None, long, "fr"), (10, "x" * 300_000, "fr"), (-3, long, "de"),
    ]
    labels = [(1, 1, 0), (3, 1, 1), (5, 0, 1), (5, 1, None), (6, None, 1), (None, 1, 1), (99, 1, 1)]
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, lang string, words int, part string").repartition(4)
    lab = spark.createDataFrame([(*r, 5) for r in labels], "doc_id long, quality int, toxic int, n int")
    assert got(audit_filters(d, lab)) == brute(docs, labels)
    assert got(audit_filters(d, lab.limit(0))) == brute(docs, [])
    assert audit_filters(d.limit(0), lab).count() == 0


def test_copies_in_a_third_of_all_rows(spark):
    docs = [(d, "one text with Capitals" if d % 3 else f"own text {d} " + "w " * (d % 300), "en" if d % 2 else "de") for d in range(900)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(9)
    lab = spark.createDataFrame([(k, k % 2, k % 5 == 0) for k in range(0, 900, 4)], "doc_id long, quality int, toxic boolean").selectExpr("doc_id", "quality", "int(toxic) toxic")
    assert got(audit_filters(d, lab)) == brute(docs, [tuple(r) for r in lab.collect()])


def test_csr_is_the_matrix(spark, sf_dir, monkeypatch):
    """Entries, dictionary and rows of the CSR shards, put together again, are the documents' words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(6)
    shards, dictionary = csr_shards(docs)
    word = {r.id: r.word for r in dictionary.collect()}
    assert sorted(word) == list(range(len(word))) and len(set(word.values())) == len(word)
    texts = {r.doc_id: Counter(words_of(r.text)) for r in docs.collect()}
    seen = defaultdict(Counter)
    for s in shards.collect():
        assert len(s.indptr) == len(s.doc_id) + 1 and s.indptr[-1] == len(s.columns) == len(s.counts)
        for k, d in enumerate(s.doc_id):
            of = slice(s.indptr[k], s.indptr[k + 1])
            assert s.columns[of] == sorted(set(s.columns[of]))
            seen[d].update({word[c]: n for c, n in zip(s.columns[of], s.counts[of])})
    assert dict(seen) == texts


def test_numbers_of_buckets(monkeypatch):
    """Buckets of several shards, over batches cut anywhere: one dense number for each word, told with the row that first has it."""
    import pyarrow as pa

    monkeypatch.setattr(filteraudit, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": staticmethod(lambda: 7)}))}))
    shards = {11: [b"a", b"b", b"c", b"d"], 12: [b"c", b"e", b"a"], 13: [], 14: [b"d", b"b"]}
    batch = pa.RecordBatch.from_arrays([pa.array(list(shards), pa.int64()), pa.array([b" ".join(w) for w in shards.values()], pa.binary())], names=["shard", "words"])
    rows = sorted((r for b in filteraudit._bucketed(3)(iter([batch])) for r in b.to_pylist()), key=lambda r: r["bucket"])
    for cuts in (1, 2, len(rows)):
        parts = [pa.RecordBatch.from_pylist(rows[k : k + cuts]) for k in range(0, len(rows), cuts)]
        number, told = {}, {}
        for r in (r for b in filteraudit._number(iter(parts)) for r in b.to_pylist()):
            assert r["part"] == 7
            for at, k in zip(np.frombuffer(r["local"], "<i4").tolist(), np.frombuffer(r["number"], "<i8").tolist()):
                assert number.setdefault(shards[r["shard"]][at], k) == k
            for k, w in enumerate(r["new"].split()):
                told[w] = r["first"] + k
        assert told == number and sorted(number.values()) == list(range(5))


def test_a_row_group_holds_few_shards_and_no_shard_leaves_its_task(spark, monkeypatch):
    """Texts of a slice's size in one task: each shard is a row group of its own, and what comes out of shards for the audit are rows of documents."""
    from pathlib import Path

    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    word = F.transform(F.sequence(F.col("id") * 1_700_000, F.col("id") * 1_700_000 + 1_699_999), lambda k: F.concat(F.lit("w"), F.lpad(k.cast("string"), 9, "0")))
    docs = spark.range(0, 2, 1, 1).select(F.col("id").alias("doc_id"), F.array_join(word, " ").alias("text"), F.lit("en").alias("lang"))
    tables = {}
    plain = filteraudit.cut
    monkeypatch.setattr(filteraudit, "cut", lambda df, name, **more: tables.setdefault(name, plain(df, name, **more)))
    shards, _ = csr_shards(docs.select("doc_id", "text"))
    groups = []
    for path in tables["local"].inputFiles():
        meta = pq.ParquetFile(Path(path.removeprefix("file:"))).metadata
        groups += [meta.row_group(k).num_rows for k in range(meta.num_row_groups)]
    assert groups == [1, 1]
    rows = filteraudit.row_counts(docs, ["doc_id"])
    assert "array" not in rows.schema.simpleString()
    assert sorted(tuple(r) for r in rows.select("doc_id", "n_words", "n_distinct").collect()) == [(k, 1_700_000, 1_700_000) for k in range(2)]
