import datetime
import os
import re

from pyspark.sql import functions as F

from eventlab.sources import tables as S
from eventlab.streaming import streams as T


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def local(path):
    return path.removeprefix("file:")


def files(path):
    return {os.path.relpath(os.path.join(d, f), local(path)): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(local(path)) for f in names if f.endswith(".parquet")}


def test_an_append_reads_the_buckets_it_touches(spark):
    path = S.new_path(spark, "bucketed")
    rows = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") % 7).cast("int").alias("g"), F.lit("first").alias("v"))
    assert S.append_idempotent(rows, path, ["k", "g"]).count() == 2000
    before = files(path)
    some = spark.createDataFrame([(5, 5, "again"), (9999, 1, "new"), (9999, 1, "new"), (None, 1, "null key")], "k long, g int, v string")
    new, touched = S.touched_buckets(some, ["k", "g"], S.BUCKETS)
    assert 0 < len(touched) <= 3
    known = S.known_keys(spark, path, new, ["k", "g"], touched)
    scan = re.search(r"PartitionFilters: \[([^\n]*?)\], PushedFilters", plan(known)).group(1)
    assert "_bucket" in scan and "ReadSchema: struct<k:bigint,g:int>" in plan(known)
    read = {r[0] for r in known.select(F.regexp_extract(F.input_file_name(), r"_bucket=(\d+)", 1)).distinct().collect()}
    assert read == {str(b) for b in touched}
    after = S.append_idempotent(some, path, ["k", "g"])
    assert after.count() == 2002 and after.columns == ["k", "g", "v"]
    assert {tuple(r) for r in after.where("v <> 'first'").collect()} == {(9999, 1, "new"), (None, 1, "null key")}
    assert before.items() <= files(path).items()
    assert S.append_idempotent(some.limit(0), path, ["k", "g"]).count() == 2002


def test_expired_directories_go_and_others_stay(spark):
    at = datetime.datetime(2024, 1, 10)
    rows = spark.createDataFrame([(k, at + datetime.timedelta(hours=6 * k)) for k in range(40)], "id long, t timestamp_ntz")
    path = S.new_path(spark, "hours")
    S.write_partitioned(rows, path, "t")
    before = files(path)
    gone = S.drop_expired(spark, path, "2024-01-15 13:30:00", 48)
    left = files(path)
    assert left.items() < before.items()  # no file that stays was written again
    want = S.apply_retention(rows, "2024-01-15 13:30:00", "t", 48)
    assert {r.id for r in spark.read.parquet(path).collect()} == {r.id for r in want.collect()}
    told = gone.collect()
    assert sum(r.files for r in told) >= len(before) - len(left) and all(r.bytes > 0 and not os.path.exists(local(r.folder)) for r in told)
    assert S.drop_expired(spark, path, "2024-01-15 13:30:00", 48).count() == 0


def test_history_by_deltas(spark):
    """What a batch writes follows its own size; late versions and batches done again are right; compaction changes nothing."""
    log, history, mark, feed = (S.new_path(spark, x) for x in ("log", "history", "mark", "feed"))
    versions = [(e, v, datetime.date(2024, 1, 1) + datetime.timedelta(days=v)) for e in range(200) for v in range(1, 6)]
    cdc = spark.createDataFrame(versions, "entity_key long, entity_version int, valid_from date")
    for part in ("entity_version in (1, 3)", "entity_version = 4 and entity_key < 10", "entity_version = 2 or entity_version = 1", "entity_version = 5 or entity_version = 4"):
        cdc.where(part).write.mode("append").parquet(feed)
        T.scd2_stream(spark.readStream.schema(cdc.schema).parquet(feed), log, history, mark, 8)
    deltas = spark.read.parquet(history)
    wrote = {r.batch: r.n for r in deltas.groupBy("batch").agg(F.count("*").alias("n")).collect()}
    assert wrote[1] == 20  # ten versions and the ten that they end
    from eventlab.operators.checks import scd2

    want = sorted(map(tuple, scd2(cdc).collect()))
    assert sorted(map(tuple, T.history_of(deltas).select(*scd2(cdc).columns).collect())) == want
    target = S.new_path(spark, "compacted")
    T.compact_history(spark, history, target)
    one = spark.read.parquet(target)
    assert one.count() == 1000 and sorted(map(tuple, T.history_of(one).select(*scd2(cdc).columns).collect())) == want


def test_a_batch_of_changes_is_shuffled_once(spark, monkeypatch):
    """The log's rows and the batch's meet by one shuffle, with repeats in the batch and of the log; of unlike repeats in a batch the same one stays."""
    plans, whole = [], T.cut
    monkeypatch.setattr(T, "FEW", 0, raising=False)
    monkeypatch.setattr(T, "cut", lambda df, name="t": (plans.append(plan(df)), whole(df, name))[1])
    log, history, mark, feed = (S.new_path(spark, x) for x in ("log", "history", "mark", "feed"))
    versions = [(e, v, datetime.date(2024, 1, 1) + datetime.timedelta(days=v)) for e in range(50) for v in range(1, 6)]
    cdc = spark.createDataFrame(versions, "entity_key long, entity_version int, valid_from date")
    for part in ("entity_version % 2 = 1", "entity_version < 5"):
        rows = cdc.where(part)
        rows.unionByName(rows.where("entity_key < 7")).write.mode("append").parquet(feed)
        T.scd2_stream(spark.readStream.schema(cdc.schema).parquet(feed), log, history, mark, 8)
    assert [p.count("Exchange hashpartitioning") for p in plans] == [1, 1]
    assert spark.read.parquet(log).count() == 250
    from eventlab.operators.checks import scd2

    got = T.history_of(spark.read.parquet(history))
    assert sorted(map(tuple, got.select(*scd2(cdc).columns).collect())) == sorted(map(tuple, scd2(cdc).collect()))
