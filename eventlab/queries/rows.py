"""Queries of projections, filters and row checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlab.catalog import query, table
from eventlab.fixtures import cdc, cdc_faults, delivered, env, injections, with_sql
from eventlab.operators import rows as R

_COLS = ("event_id", "workspace_id", "stream_id", "event_type", "sequence_no", "occurred_at", "emitted_at")


@query("p1_strip_internal", with_sql(f"SELECT {', '.join(_COLS)} FROM env", "env"))
def p1(spark, sf):
    return R.strip_internal(R.build_envelopes(env(spark, sf)).select(*_COLS, "_df"), _COLS)


@query("p2_reserved_scan", "SELECT event_id FROM events WHERE event_id % 13 = 0")
def p2(spark, sf):
    ev = table(spark, sf, "events")
    doc = F.when(F.col("event_id") % 13 == 0, F.concat(F.lit('{"a": {"_df_note": '), "event_id", F.lit("}}"))).otherwise(F.concat(F.lit('{"a": "_df", "p": '), "props", F.lit("}")))
    return R.scan_reserved(ev.withColumn("doc", doc), "doc").select("event_id")


#: Rules that every so many events break.
_BROKEN = {3: "workspace_id_pattern", 5: "manifest_version_pattern", 7: "scenario_slug_pattern", 11: "event_type_pattern", 13: "correlation_id_pattern", 17: "causation_id_pattern", 19: "partition_key_length", 23: "shard_id_range", 29: "sequence_no_range",
    31: "envelope_version_value", 37: "op_value", 41: "schema_ref", 43: "entity_refs", 47: "payload_object", 53: "emitted_at"}


@query("p3_validate_envelopes", "WITH r(k, rule) AS (VALUES " + ", ".join(f"({k}, '{v}')" for k, v in _BROKEN.items()) + ") SELECT 'ev_' || lpad(event_id::VARCHAR, 12, '0') AS event_id, rule FROM events, r WHERE event_id % 59 = k")
def p3(spark, sf):
    from eventlab.queries.tables import envelopes

    df = envelopes(spark, sf)
    k = F.substring("event_id", 4, 12).cast("long") % 59
    uuid = F.regexp_replace(F.md5("event_id"), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    good = {"correlation_id": uuid, "causation_id": F.when(F.col("causation_id").isNotNull(), uuid), "session_id": uuid, "shard_id": F.lit(0), "op": F.lit(None).cast("string")}
    bad = {"workspace_id": (3, F.lit("ws?")), "manifest_version": (5, F.lit("1.0")), "scenario_slug": (7, F.lit("Shop")), "event_type": (11, F.lit("cdc.")), "correlation_id": (13, F.lit("x")), "causation_id": (17, F.upper(uuid)), "partition_key": (19, F.repeat(F.lit("p"), 257)),
        "shard_id": (23, F.lit(-1)), "sequence_no": (29, F.lit(0)), "envelope_version": (31, F.lit("2.0")), "op": (37, F.lit("x")), "payload": (47, F.lit("[]")), "emitted_at": (53, F.lit("2020-01-01").cast("timestamp"))}
    bad["schema_ref"] = (41, F.struct(F.col("schema_ref.subject").alias("subject"), F.lit(0).alias("version")))
    bad["entity_refs"] = (43, F.slice("entity_refs", 1, 0))
    df = df.withColumns(good).withColumns({c: F.when(k == n, v).otherwise(F.col(c)).cast(df.schema[c].dataType) for c, (n, v) in bad.items()})
    return R.validate_envelopes(df, {"event_id": r"^ev_\d{12}$", "workspace_id": r"^ws_\d+$", "stream_id": r"^st_\d+$"})


@query("p4_p5_validate_ops", with_sql("SELECT entity_key, entity_version, 'images' AS rule FROM cdc WHERE op = 'd'", "cdc"))
def p4(spark, sf):
    return R.validate_ops(cdc(spark, sf))


@query("p6_filter_types", with_sql("SELECT event_id FROM env WHERE event_type IN ('purchase', 'signup')", "env"))
def p6(spark, sf):
    return R.filter_events(env(spark, sf), ["purchase", "signup", "unheard_of"]).select("event_id")


@query("p7_filter_entity", with_sql("SELECT event_id FROM env WHERE props->>'k' = '7'", "env"))
def p7(spark, sf):
    return R.filter_events(R.build_envelopes(env(spark, sf)), entity=("items", "7")).select("event_id")


@query("p8_filter_composed", with_sql("SELECT event_id FROM env WHERE event_type IN ('view', 'click') AND actor_id = 'usr_00000005'", "env"))
def p8(spark, sf):
    return R.filter_events(R.build_envelopes(env(spark, sf)), ["view", "click"], ("users", "usr_00000005")).select("event_id")


@query("p9_filter_injections", with_sql("SELECT injection_id FROM inj WHERE mode = 'duplicates' AND occurred_at >= TIMESTAMP '2024-01-05' AND occurred_at <= TIMESTAMP '2024-01-25'", "inj"))
def p9(spark, sf):
    return R.filter_injections(injections(spark, sf), "duplicates", start="2024-01-05", end="2024-01-25").select("injection_id")


@query("p10_audit_log", with_sql("SELECT event_id AS entry_id, 'event.' || event_type AS action, occurred_at AS happened FROM env WHERE event_type LIKE 'p%' AND actor_id <= 'usr_00000010' ORDER BY happened DESC, entry_id DESC LIMIT 50", "env"))
def p10(spark, sf):
    log = env(spark, sf).where("actor_id <= 'usr_00000010'").select(F.col("event_id").alias("entry_id"), F.concat(F.lit("event."), "event_type").alias("action"), F.col("occurred_at").alias("happened"))
    return R.audit_log(log, "event.p", limit=50)


@query("p11_tenant_scope", with_sql("SELECT event_id, stream_id FROM env WHERE workspace_id = 'ws_2'", "env"))
def p11(spark, sf):
    return R.tenant_scope(env(spark, sf), "ws_2").select("event_id", "stream_id")


@query("p11b_attribution_violations", with_sql("SELECT event_id, copy FROM delivered WHERE workspace_id = 'ws_other'", "delivered"))
def p11b(spark, sf):
    owners = env(spark, sf).groupBy("stream_id").agg(F.min("workspace_id").alias("owner"))
    return R.attribution_violations(delivered(spark, sf), owners).select("event_id", "copy")


@query("p12_flatten_details", with_sql("SELECT injection_id, mode, copies, delay_ms FROM inj", "inj"))
def p12(spark, sf):
    inj = injections(spark, sf).select("injection_id", "mode", F.to_json(F.struct("copies", "delay_ms")).alias("details"))
    return R.flatten_injections(inj, "copies int, delay_ms long")


@query("p16_payload_leaves", "SELECT event_id, unnest(['k', 'o.t', 'l[]', 'l[]']) AS path, unnest([props->>'k', event_type, '1', event_id::VARCHAR]) AS value FROM events")
def p16(spark, sf):
    doc = F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit(', "o": {"t": "'), "event_type", F.lit('"}, "l": [1, '), "event_id", F.lit("]}"))
    return R.explode_leaves(table(spark, sf, "events").withColumn("doc", doc), "doc", "event_id")


@query("p17_set_leaf", "SELECT event_id, 'users' AS t, user_id + 1 AS n FROM events")
def p17(spark, sf):
    df = table(spark, sf, "events").select("event_id", F.struct(F.struct(F.lit("users").alias("t"), F.col("user_id").alias("n")).alias("in")).alias("p"))
    return R.set_leaf(df, "p.in.n", F.col("p.in.n") + 1).select("event_id", "p.in.t", "p.in.n")


@query("p18_predicates", "SELECT event_id FROM events WHERE (props->>'k')::INT >= 50 AND event_type NOT IN ('error') AND value < 20.5")
def p18(spark, sf):
    df = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return R.where_spec(df, [("k", "gte", "50"), ("event_type", "not_in", ["error"]), ("value", "lt", 20.5)]).select("event_id")


@query("p20_cdc_staging", with_sql("SELECT entity_key, entity_version, valid_from, status, total FROM cdc WHERE op <> 'd'", "cdc"))
def p20(spark, sf):
    return R.stage_cdc(cdc(spark, sf))


@query("p23_build_envelopes", with_sql("SELECT event_id, 'shop.' || event_type AS subject, 1 AS version, workspace_id || ':' || stream_id || ':users:' || actor_id AS partition_key, 2 AS refs, true AS canonical FROM env", "env"))
def p23(spark, sf):
    return R.build_envelopes(env(spark, sf)).select("event_id", "schema_ref.*", "partition_key", F.size("entity_refs").alias("refs"), F.col("_df.canonical").alias("canonical"))


@query("p24_cdc_event", with_sql("SELECT entity_key, entity_version, op, epoch_ms(valid_from) AS ts_ms, before_status AS b, CASE WHEN op <> 'd' THEN status END AS a FROM cdcf", "cdcf"))
def p24(spark, sf):
    out = R.mutations_to_cdc(cdc_faults(spark, sf), "customers")
    return out.select("entity_key", "payload.source.entity_version", "payload.op", "payload.ts_ms", F.col("payload.before.status").alias("b"), F.col("payload.after.status").alias("a"))


@query("p21_staging_views", with_sql("SELECT event_id AS order_id, actor_id AS user_id, occurred_at AS at_time, value AS amount FROM env WHERE event_type = 'purchase'", "env"))
def p21(spark, sf):
    return R.stage(env(spark, sf), "purchases").withColumnRenamed("at", "at_time")


@query("p22_staging_full_funnel", with_sql("SELECT CASE event_type WHEN 'view' THEN 'product_views' WHEN 'signup' THEN 'signups' WHEN 'error' THEN 'failures' ELSE 'purchases' END AS fact, count(*) AS n, max(occurred_at) AS last FROM env WHERE event_type <> 'click' GROUP BY 1", "env"))
def p22(spark, sf):
    out = None
    for name in R.VIEWS:
        one = R.stage(env(spark, sf), name).agg(F.count("*").alias("n"), F.max("at").alias("last")).withColumn("fact", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out
