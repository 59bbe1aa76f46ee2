"""Queries of sources, sinks and layouts: what was written is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlab.catalog import query, table
from eventlab.fixtures import caused, cdc_faults, delivered, env, injections, with_sql
from eventlab.operators import rows as R
from eventlab.sources import tables as S


def envelopes(spark, sf):
    """Events with the 20 delivered fields."""
    df = R.build_envelopes(caused(spark, sf)).withColumns({"envelope_version": F.lit("1.0"), "scenario_slug": F.lit("shop"), "manifest_version": F.lit("1.0.0"), "op": F.lit(None).cast("string"), "payload": F.to_json(F.struct("value", F.get_json_object("props", "$.k").cast("int").alias("k")))})
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in S.ENVELOPE], "_df")


@query("s1_s2_jsonl_round_trip", with_sql("SELECT event_id, sequence_no, 'shop.' || event_type AS subject, 2 AS refs, occurred_at, causation_id, (props->>'k')::INT AS k FROM caus", "caus"))
def s1(spark, sf):
    path = S.new_path(spark, "jsonl")
    S.write_jsonl(envelopes(spark, sf), path, "gzip")
    df = S.read_events(spark, path)
    return df.select("event_id", "sequence_no", "schema_ref.subject", F.size("entity_refs").alias("refs"), F.col("occurred_at").cast("timestamp_ntz").alias("occurred_at"), "causation_id", F.get_json_object("payload", "$.k").cast("int").alias("k"))


@query("s3_append_ledger", with_sql("SELECT event_id, sequence_no FROM env", "env"))
def s3(spark, sf):
    path, e = S.new_path(spark, "ledger"), env(spark, sf)
    keys = ["stream_id", "shard_id", "sequence_no", "emitted_at"]
    S.append_idempotent(e.where("id % 3 <> 0"), path, keys)
    return S.append_idempotent(e.where("id % 2 = 0 or id % 3 = 0").unionByName(e.where("id % 5 = 0")), path, keys).select("event_id", "sequence_no")


@query("s4_append_injections", with_sql("SELECT injection_id, mode FROM inj", "inj"))
def s4(spark, sf):
    path, i = S.new_path(spark, "injections"), injections(spark, sf)
    S.append_idempotent(i, path, ["injection_id"])
    return S.append_idempotent(i.withColumn("mode", F.lit("second write")), path, ["injection_id"]).select("injection_id", "mode")


@query("s5_append_event_buffer", with_sql("""SELECT event_id, row_number() OVER (PARTITION BY stream_id ORDER BY batch, id) AS buffer_seq, CASE WHEN batch = 1 THEN TIMESTAMP '2024-03-01' WHEN has THEN TIMESTAMP '2024-03-01' ELSE TIMESTAMP '2024-02-01' END AS partition_ts
    FROM (SELECT *, CASE WHEN id % 3 = 0 THEN 1 ELSE 2 END AS batch, count(*) FILTER (id % 3 = 0) OVER (PARTITION BY stream_id) > 0 AS has FROM env)""", "env"))
def s5(spark, sf):
    e = env(spark, sf)
    first = S.cut(S.with_buffer_seq(e.where("id % 3 = 0"), None, ["id"], F.lit("2024-03-01").cast("timestamp_ntz")), "buffer")
    second = S.with_buffer_seq(e.where("id % 3 <> 0"), first, ["id"], F.lit("2024-02-01").cast("timestamp_ntz"))
    return first.unionByName(second).select("event_id", "buffer_seq", "partition_ts")


@query("s6_hour_partitions", with_sql("SELECT emitted_at::DATE AS dt, hour(emitted_at) AS hour, count(*) AS n FROM delivered GROUP BY 1, 2", "delivered"))
def s6(spark, sf):
    path = S.new_path(spark, "hours")
    S.write_partitioned(delivered(spark, sf), path, "emitted_at")
    return spark.read.parquet(path).groupBy("dt", "hour").agg(F.count("*").alias("n"))


@query("s7_day_partitions", with_sql("SELECT emitted_at::DATE AS dt, count(*) AS n FROM env GROUP BY 1", "env"))
def s7(spark, sf):
    path = S.new_path(spark, "days")
    S.write_partitioned(env(spark, sf), path, "emitted_at", hour=False)
    return spark.read.parquet(path).groupBy("dt").agg(F.count("*").alias("n"))


@query("s8_apply_retention", with_sql("SELECT event_id FROM env WHERE date_trunc('hour', emitted_at) >= TIMESTAMP '2024-01-18 10:00:00'", "env"))
def s8(spark, sf):
    """Hourly directories on disk, those that are over removed."""
    path = S.new_path(spark, "hours")
    S.write_partitioned(env(spark, sf), path, "emitted_at")
    S.drop_expired(spark, path, "2024-01-20 10:30:00", 48)
    return spark.read.parquet(path).select("event_id")


@query("s8b_retention_filter", with_sql("SELECT event_id FROM env WHERE date_trunc('hour', emitted_at) >= TIMESTAMP '2024-01-18 10:00:00'", "env"))
def s8b(spark, sf):
    return S.apply_retention(env(spark, sf), "2024-01-20 10:30:00", "emitted_at", 48).select("event_id")


@query("s9_retention_ledger", with_sql("SELECT event_id FROM env WHERE emitted_at >= TIMESTAMP '2024-01-13'", "env"))
def s9(spark, sf):
    """Daily directories on disk, those that are over removed."""
    path = S.new_path(spark, "days")
    S.write_partitioned(env(spark, sf), path, "emitted_at", hour=False)
    S.drop_expired(spark, path, "2024-01-20 10:30:00", 24 * 7)
    return spark.read.parquet(path).select("event_id")


@query("s10_s11_export", with_sql("SELECT occurred_at::DATE AS dt, count(*) AS n, max(sequence_no) AS last FROM env GROUP BY 1", "env"))
def s10(spark, sf):
    path = S.new_path(spark, "export")
    S.export_hourly(env(spark, sf), path, 100_000)
    files = S.export_manifest(spark, path)
    day = F.to_date(F.regexp_extract("file", r"dt=(\d{4}-\d\d-\d\d)", 1))
    return files.groupBy(day.alias("dt")).agg(F.sum("n").alias("n"), F.max("last").alias("last"))


@query("s12_export_by_subject", with_sql("SELECT event_id, event_type, value, (props->>'k')::INT AS k FROM env WHERE event_type IN ('purchase', 'view')", "env"))
def s12(spark, sf):
    df = envelopes(spark, sf).select("event_id", "event_type", "stream_id", "sequence_no", "occurred_at", "payload")
    paths = S.export_by_subject(df, S.new_path(spark, "subjects"), {"purchase": "value double, k int", "view": "value double, k int"})
    return spark.read.parquet(paths["purchase"]).unionByName(spark.read.parquet(paths["view"])).select("event_id", "event_type", "value", "k")


@query("s13_export_cdc", with_sql("SELECT 'customers' AS entity, valid_from::DATE AS dt, op, epoch_ms(valid_from) AS ts_ms FROM cdcf", "cdcf"))
def s13(spark, sf):
    out = R.mutations_to_cdc(cdc_faults(spark, sf), "customers")
    path = S.new_path(spark, "cdc")
    S.export_cdc(out.withColumn("entity", F.lit("customers")).withColumn("_at", F.timestamp_millis("payload.ts_ms")), path, "entity", "_at")
    return spark.read.parquet(path).select("entity", "dt", "op", "ts_ms")


@query("s14_kafka_records", with_sql("SELECT workspace_id || ':' || actor_id AS k, event_id, value AS v FROM env", "env"))
def s14(spark, sf):
    df = env(spark, sf).select("event_id", "value", F.concat_ws(":", "workspace_id", "actor_id").alias("partition_key"))
    out = S.kafka_records(df, "partition_key")
    return out.select(F.col("key").cast("string").alias("k"), F.get_json_object("value", "$.event_id").alias("event_id"), F.get_json_object("value", "$.value").cast("double").alias("v"))


@query("s15_bridge_events", with_sql("SELECT event_id FROM env", "env"))
def s15(spark, sf):
    src, sink, mark = (S.new_path(spark, x) for x in ("feed", "sink", "mark"))
    e = env(spark, sf).select("id", "event_id", "value")
    e.where("id % 2 = 0").write.parquet(src)
    S.bridge(spark, src, e.schema, sink, mark)
    e.where("id % 2 = 1").write.mode("append").parquet(src)
    S.bridge(spark, src, e.schema, sink, mark)  # carries on from the checkpoint
    return spark.read.parquet(sink).select("event_id")


@query("s16_scan_injections", with_sql("SELECT injection_id FROM inj WHERE mode = 'missing'", "inj"))
def s16(spark, sf):
    rows = R.filter_injections(injections(spark, sf), "missing").orderBy(F.desc("recorded_at"), F.desc("injection_id"))
    return rows.select(F.get_json_object(F.to_json(F.struct("*")), "$.injection_id").alias("injection_id"))
