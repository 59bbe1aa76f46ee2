"""Filter interaction audit over a sparse document-term matrix.

A task turns slices of whole texts into shards: for each document the words
that it has, as numbers of the slice's own vocabulary, and how often.  The vocabularies, not the
documents' words, are shuffled: a shard's words are packed by bucket of their hash, and where a bucket of all shards
comes together equal words get one number of the global dictionary, dense over all partitions by a sum over one count for each of them.  The
numbers go back to their shard, which becomes a CSR matrix with global columns (``csr_shards``): a
shard meets its own vocabulary only, so groups are as large as a slice.  There are as many buckets as the number
of shards asks for, so that a bucket stays as large as a slice's vocabulary, whatever the input.

Row sums are numbers of words, numbers of nonzero entries those of distinct words.  With what a text alone
tells (capitals, symbols) and the first document of each text they give each document a set of failed
filters.  All orders of the filters are then judged on counts of such sets for each part, 128 rows at most, so no document
is ever repeated for an order.
"""

from __future__ import annotations

import itertools
import json
import zlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlab.llm.tables import cut, hash128

#: Bytes of whole texts of a shard, and shards for each bucket of words.
SLICE, SHARDS_A_BUCKET = 16_000_000, 2
FILTERS = "ABCDE"
CAPITALS, SYMBOLS = bytes(range(65, 91)), b"#$%&*|"


class _Codes(dict):
    """Numbers of words in order of their first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _one(values: pa.Array) -> pa.Array:
    """All values as one list."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def local_shards(docs: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row for each slice of texts: shard, the columns ``keep`` of its rows as lists, capitals and symbols of its texts, its words (joined by spaces), and ``indptr``, ``columns`` and ``counts`` over these."""
    names = ["shard", *keep, "capitals", "symbols", "words", "indptr", "columns", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            texts, at = batch.column(0), 0
            while at < batch.num_rows:
                first, size, code, columns, counts, indptr = at, 0, _Codes(), array("i"), array("i"), [0]
                capitals, symbols = [], []
                while at < batch.num_rows and (at == first or size < SLICE):
                    raw = texts[at].as_py() or b""
                    size += len(raw)
                    found = Counter(raw.split())
                    columns.extend(map(code.__getitem__, found))
                    counts.extend(found.values())
                    indptr.append(len(columns))
                    capitals.append(len(raw) - len(raw.translate(None, CAPITALS)))
                    symbols.append(len(raw) - len(raw.translate(None, SYMBOLS)))
                    at += 1
                kept = [_one(batch.column(k + 1).slice(first, at - first)) for k in range(len(keep))]
                own = [_one(pa.array(x, t)) for x, t in ((capitals, pa.int64()), (symbols, pa.int64()), (indptr, pa.int32()), (np.array(columns, np.int32), pa.int32()), (np.array(counts, np.int32), pa.int32()))]
                own.insert(2, pa.array([b" ".join(code)], pa.binary()))
                shard = TaskContext.get().partitionId() << 32 | n
                n += 1
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), *kept, *own], names=names)

    work = docs.select(F.col("text").cast("string").cast("binary").alias("text"), *keep)
    kept = ", ".join(f"`{c}` array<{work.schema[c].dataType.simpleString()}>" for c in keep)
    return work.mapInArrow(run, f"shard long, {kept}, capitals array<long>, symbols array<long>, words binary, indptr array<int>, columns array<int>, counts array<int>")


def _bucketed(buckets: int):
    """(bucket, shard, words, local): a shard's words by bucket, joined by spaces, and their numbers in the shard as 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = packed.as_py().split()
                spots = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
                order = np.argsort(spots, kind="stable")
                cuts = np.flatnonzero(np.r_[True, np.diff(spots[order]) != 0]) if len(words) else np.zeros(0, np.int64)
                parts = list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(words)]))
                ordered = [words[k] for k in order.tolist()]
                local = order.astype("<i4")
                cols = [pa.array(spots[order][cuts]), pa.array([shard] * len(parts), pa.int64()), pa.array([b" ".join(ordered[a:b]) for a, b in parts], pa.binary()), pa.array([local[a:b].tobytes() for a, b in parts], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["bucket", "shard", "words", "local"])

    return run


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of bucket: equal words of a bucket get one number, counted within the partition; the row that first has a word goes on with it."""
    part, upto, bucket, code = TaskContext.get().partitionId(), 0, None, _Codes()
    for batch in batches:
        numbers, new, first, n_new = [], [], [], []
        for b, packed in zip(batch.column(0).to_pylist(), batch.column(2)):
            if b != bucket:
                upto, bucket, code = upto + len(code), b, _Codes()
            words, known = packed.as_py().split(), len(code)
            ids = np.fromiter(map(code.__getitem__, words), np.int64, len(words))
            numbers.append((ids + upto).astype("<i8").tobytes())
            new.append(b" ".join(w for w, k in zip(words, ids.tolist()) if k >= known))
            first.append(upto + known)
            n_new.append(len(code) - known)
        cols = [pa.array([part] * batch.num_rows, pa.int32()), pa.array(first, pa.int64()), pa.array(n_new, pa.int64()), pa.array(new, pa.binary()), batch.column(1), batch.column(3), pa.array(numbers, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, names=["part", "first", "n_new", "new", "shard", "local", "number"])


def numbered_words(shards: DataFrame, n_shards: int) -> DataFrame:
    """(before, first, new, shard, local, number): the dictionary's numbers of each shard's words, packed by bucket.

    The word with the shard's number local[k] has the number before + number[k]; ``new`` are the words met first in
    this row, numbered from before + first.  Numbers are dense, from 0: those of a partition follow those of the ones before it.
    """
    buckets = max(1, -(-n_shards // SHARDS_A_BUCKET))
    packed = shards.select("shard", "words").mapInArrow(_bucketed(buckets), "bucket long, shard long, words binary, local binary")
    ordered = packed.repartition("bucket").sortWithinPartitions("bucket")
    rows = cut(ordered.mapInArrow(_number, "part int, first long, n_new long, new binary, shard long, local binary, number binary"), "numbered")
    sizes = rows.groupBy("part").agg(F.sum("n_new").alias("n"))  # a row for each partition
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return rows.join(F.broadcast(before), "part").drop("part", "n_new")


def csr_shards(docs: DataFrame, keep: Sequence[str] = ("doc_id",), made: Callable[[pa.Table], pa.Table] = lambda shard: shard, schema: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The document-term matrix as (shards, dictionary).

    ``made`` says what comes out for a shard, with ``schema``: where a few columns are made of a shard, its arrays needn't leave the task.

    A shard has its number, the columns ``keep`` of its documents, capitals and symbols of their
    texts (lists), and the CSR arrays ``indptr``, ``columns`` (dictionary numbers, ascending in each row) and ``counts``.
    The dictionary has (id, word).  Words are ``[^\\x20\\x09-\\x0D]+``, as they are; null texts have none.
    """
    local = cut(local_shards(docs, keep), "local", large_rows=True)
    numbered = numbered_words(local, local.count())
    matrix = local.drop("words")

    def join(one: pa.Table, words: pa.Table) -> pa.Table:
        indptr, columns, counts = (one[c].combine_chunks().flatten().to_numpy() for c in ("indptr", "columns", "counts"))
        ids = np.zeros(int(columns.max(initial=-1)) + 1, np.int64)
        for at, number, before in zip(words["local"].to_pylist(), words["number"].to_pylist(), words["before"].to_pylist()):
            ids[np.frombuffer(at, "<i4")] = np.frombuffer(number, "<i8") + before
        columns = ids[columns]
        order = np.lexsort((columns, np.repeat(np.arange(len(indptr) - 1), np.diff(indptr))))
        new = {"columns": _one(pa.array(columns[order])), "counts": _one(pa.array(counts[order], pa.int32()))}
        return made(pa.table({c: new.get(c, one[c]) for c in one.column_names}))

    schema = schema or ", ".join(f"`{f.name}` {'array<bigint>' if f.name == 'columns' else f.dataType.simpleString()}" for f in matrix.schema)
    shards = matrix.groupBy("shard").cogroup(numbered.select("shard", "local", "number", "before").groupBy("shard")).applyInArrow(join, schema)
    first = numbered.where(F.length("new") > 0).select((F.col("before") + F.col("first")).alias("at"), F.posexplode(F.split(F.col("new").cast("string"), " ")).alias("k", "word"))
    return shards, first.select((F.col("at") + F.col("k")).alias("id"), "word")


def row_counts(docs: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The columns ``keep``, capitals, symbols, n_words (row sum) and n_distinct (nonzero entries) of each document, from its CSR shard."""
    carried = [*keep, "capitals", "symbols"]

    def sums(shard: pa.Table) -> pa.Table:
        own = {c: shard[c].combine_chunks().flatten() for c in [*carried, "indptr", "counts"]}
        indptr, counts = own["indptr"].to_numpy(), own["counts"].to_numpy()
        total = np.r_[0, np.cumsum(counts, dtype=np.int64)]
        return pa.table({c: own[c] for c in carried} | {"n_words": total[indptr[1:]] - total[indptr[:-1]], "n_distinct": np.diff(indptr).astype(np.int64)})

    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return csr_shards(docs, keep, sums, f"{types}, capitals long, symbols long, n_words long, n_distinct long")[0]


def failed_sets(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, failed, good, toxic, n): how many documents of a part and label fail which filters; bit k of ``failed`` is FILTERS[k].

    Rows that repeat a doc_id each count.  A document is good or toxic if any label of its doc_id says so.  A null
    doc_id is smaller than none and has no smaller one.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    t1, t2 = hash128(text)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), t1.alias("t1"), t2.alias("t2"), F.char_length(text).cast("long").alias("chars"), text.alias("text"))
    keep = ["doc_id", "part", "t1", "t2", "chars"]
    rules = ["n_words < 200", "100 * n_distinct < 50 * n_words", "100 * capitals > 3 * chars", "symbols > 0"]
    alone = " + ".join(f"if({rule}, {1 << k}, 0)" for k, rule in enumerate(rules))
    rows = row_counts(base, keep).select("doc_id", "part", "t1", "t2", F.expr(alone).alias("failed"))
    rows = rows.groupBy("doc_id", "part", "t1", "t2", "failed").count()  # rows that repeat are one from here on
    told = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.expr("int(quality <=> 1)")).alias("good"), F.max(F.expr("int(toxic <=> 1)")).alias("toxic"))
    rows = rows.join(told, "doc_id", "left").fillna(0, ["good", "toxic"])
    # copies are counted before they meet: how many, and how many at the least doc_id
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "count")))
    texts = rows.groupBy("t1", "t2", "part", "failed", "good", "toxic").agg(F.sum("count").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("count")).otherwise(0)).alias("unnamed"), least.alias("least"))
    of_all = F.min("least.doc_id").over(Window.partitionBy("t1", "t2"))  # a row for each part and label
    texts = texts.withColumn("first", F.when(F.col("least.doc_id") == of_all, F.col("least.count")).otherwise(0) + F.col("unnamed"))
    copy = 1 << FILTERS.index("E")
    both = F.explode(F.array(F.struct(F.col("failed").alias("set"), F.col("first").alias("m")), F.struct((F.col("failed") + copy).alias("set"), (F.col("n") - F.col("first")).alias("m"))))
    counted = texts.select("part", "good", "toxic", both.alias("of"))
    return counted.where("of.m > 0").groupBy("part", F.col("of.set").alias("failed"), "good", "toxic").agg(F.sum("of.m").alias("n"))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the five filters and step, with counts of documents (see the columns).

    Takes doc_id, text and lang of ``docs``, doc_id, quality and toxic of ``labels``; other columns are ignored.  Filters:
    A under 200 words; B distinct words are under half; C capitals are over 3 % of the code points; D any of ``#$%&*|``; E the text is
    that of a smaller doc_id.  ``part`` is the language (null: empty).  Null texts are empty.  An empty table gives an empty table.
    """
    sets = cut(failed_sets(docs, labels), "sets")
    steps = [
        {"filter_order": "".join(order), "step": k + 1, "own": 1 << FILTERS.index(name), "before": sum(1 << FILTERS.index(f) for f in order[:k])}
        for order in itertools.permutations(FILTERS)
        for k, name in enumerate(order)
    ]
    at = F.explode(F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, own: int, before: int>>"))
    rows = sets.withColumn("at", at).select("*", "at.*").drop("at")
    counts = {
        "kept": "(failed & (own | before)) = 0",
        "removed": "failed & own != 0 and failed & before = 0",
        "redundant": "failed & own != 0 and failed & before != 0",
        "unique_fails": "failed = own",
        "good_lost": "failed & own != 0 and failed & before = 0 and good = 1",
        "toxic_lost": "failed & own != 0 and failed & before = 0 and toxic = 1",
    }
    # of the orders of five, a filter comes first of the m that a document fails in one of m
    shapley = F.sum(F.expr("if(failed & own != 0, n * 120 div bit_count(failed), 0)")).alias("shapley")
    return rows.groupBy("part", "filter_order", "step").agg(*[F.sum(F.expr(f"if({of}, n, 0)")).alias(name) for name, of in counts.items()], shapley)


ORACLE_SQL = r"""
WITH RECURSIVE letters(f) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders(o) AS (SELECT f FROM letters UNION ALL SELECT o || f FROM orders JOIN letters ON NOT contains(o, f)),
told AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
texts AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
           [w FOR w IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF w <> ''] AS words FROM documents),
judged AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
           CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
           || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
           || CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text) THEN 'C' ELSE '' END
           || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
           || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS failed
    FROM texts LEFT JOIN told USING (doc_id)),
sets AS (SELECT part, good, toxic, failed, count(*) AS n FROM judged GROUP BY ALL),
steps AS (SELECT o AS filter_order, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM orders WHERE length(o) = 5),
meets AS (
    SELECT sets.*, filter_order, step, filter_order[step] AS f, contains(failed, filter_order[step]) AS fails,
           len([x FOR x IN string_split(left(filter_order, step - 1), '') IF x <> '' AND contains(failed, x)]) > 0 AS gone
    FROM sets, steps),
counted AS (
    SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS kept,
           coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (fails AND gone), 0) AS redundant,
           coalesce(sum(n) FILTER (failed = f), 0) AS unique_fails,
           coalesce(sum(n) FILTER (fails AND NOT gone AND good), 0) AS good_lost,
           coalesce(sum(n) FILTER (fails AND NOT gone AND toxic), 0) AS toxic_lost
    FROM meets GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted
"""
