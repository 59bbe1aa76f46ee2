"""Queries of reference, cause, sequence and history checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlab.catalog import query, table
from eventlab.fixtures import caused, cdc, cdc_faults, delivered, env, injections, with_sql
from eventlab.operators import checks as K


@query("j1_j2_fk_match", "SELECT count(*) AS n, count(*) FILTER (o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0)) AS matched, round(100.0 * count(*) FILTER (o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0)) / count(*), 4) AS pct FROM orders")
def j1(spark, sf):
    return K.fk_match(table(spark, sf, "orders"), table(spark, sf, "customer").where("c_custkey % 7 <> 0"), "o_custkey", "c_custkey")


@query("j3_orphans", "SELECT l_orderkey, l_partkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus IN ('F', 'O'))")
def j3(spark, sf):
    return K.orphans(table(spark, sf, "lineitem"), table(spark, sf, "orders"), "l_orderkey", "o_orderkey", F.col("o_orderstatus").isin("F", "O")).select("l_orderkey", "l_partkey")


_PRIOR = "SELECT event_id FROM env e WHERE event_type IN ('purchase') AND NOT EXISTS (SELECT 1 FROM env p WHERE p.actor_id = e.actor_id AND p.event_type IN ({}) AND p.sequence_no < e.sequence_no)"


@query("j4_prior_event_required", with_sql(_PRIOR.format("'view'"), "env"))
def j4(spark, sf):
    return K.requires_prior(env(spark, sf), ["purchase"], ["view"], "actor_id", "sequence_no").select("event_id")


@query("j5_prior_alternatives", with_sql(_PRIOR.format("'error', 'signup'"), "env"))
def j5(spark, sf):
    return K.requires_prior(env(spark, sf), ["purchase"], ["error", "signup"], "actor_id", "sequence_no").select("event_id")


@query("j6_consistent_attribute", with_sql("SELECT event_id, copy FROM delivered WHERE id % 103 = 0", "delivered"))
def j6(spark, sf):
    return K.consistent_attribute(delivered(spark, sf), env(spark, sf), "event_id", "workspace_id").select("event_id", "copy")


@query("j7_refs_resolve", with_sql("""SELECT event_id, CASE WHEN user_id % 5 = 0 THEN 'missing' ELSE 'forward' END AS problem FROM env e
    WHERE user_id % 5 = 0 OR occurred_at < (SELECT min(s.occurred_at) FROM env s WHERE s.event_type IN ('signup', 'view') AND s.user_id = e.user_id)""", "env"))
def j7(spark, sf):
    e = env(spark, sf)
    refs = e.select("event_id", F.lit("users").alias("entity_type"), F.col("actor_id").alias("entity_key"), "occurred_at")
    one = lambda t: e.where((F.col("event_type") == t) & (F.col("user_id") % 5 != 0)).select(F.lit("users").alias("entity_type"), F.col("actor_id").alias("entity_key"), F.col("occurred_at").alias("introduced_at"))
    return K.unresolved_refs(refs, K.introductions(one("signup"), one("view"))).select("event_id", "problem")


@query("j8_introduction_index", with_sql("SELECT 'users' AS entity_type, actor_id AS entity_key, min(occurred_at) AS introduced_at FROM env WHERE event_type IN ('signup', 'view') GROUP BY actor_id", "env"))
def j8(spark, sf):
    e = env(spark, sf)
    one = lambda t: e.where(F.col("event_type") == t).select(F.lit("users").alias("entity_type"), F.col("actor_id").alias("entity_key"), F.col("occurred_at").alias("introduced_at"))
    return K.introductions(one("signup"), one("view"))


@query("j9_causation_resolves", with_sql("SELECT a.event_id, 'unresolved' AS problem FROM caus a JOIN caus c ON c.event_id = a.causation_id WHERE a.id % 97 <> 0 AND c.id % 97 = 0 UNION ALL SELECT a.event_id, 'correlation' FROM caus a JOIN caus c ON c.event_id = a.causation_id WHERE a.id % 97 <> 0 AND c.id % 97 <> 0 AND (a.id % 50 = 0) <> (c.id % 50 = 0)", "caus"))
def j9(spark, sf):
    df = caused(spark, sf).where("id % 97 <> 0")
    return K.causality_violations(df.withColumn("correlation_id", F.when(F.col("id") % 50 == 0, F.lit("other")).otherwise(F.col("correlation_id"))))


@query("j11_lifecycle_latency", with_sql("""SELECT actor_id, (epoch_us(min(e.occurred_at)) - epoch_us(any_value(f))) / 1e6 AS seconds FROM env e JOIN (SELECT actor_id, min(occurred_at) AS f FROM env WHERE event_type = 'view' GROUP BY 1) USING (actor_id)
    WHERE event_type = 'purchase' AND occurred_at > f GROUP BY actor_id""", "env"))
def j11(spark, sf):
    return K.latencies(env(spark, sf), "view", "purchase", "actor_id", "occurred_at")


_RECON = """SELECT event_id, unnest(p) AS problem FROM (SELECT event_id, list_filter([CASE WHEN id % 97 = 0 THEN 'missing' END, CASE WHEN id % 97 <> 0 AND id % 53 = 0 THEN 'repeated' END,
    CASE WHEN id % 97 <> 0 AND (id % 211 = 0 OR id % 101 = 0 OR id % 103 = 0) THEN 'changed' END], lambda x: x IS NOT NULL) AS p FROM env)"""
_CONTENT = ("workspace_id", "occurred_at", "event_type", "value")


@query("j12_reconcile", with_sql(_RECON, "env"))
def j12(spark, sf):
    return K.reconcile(env(spark, sf), delivered(spark, sf), None, _CONTENT)


@query("j13_deviation_to_injection", with_sql(f"""SELECT mode, count(*) FILTER (d AND i) AS matched, count(*) FILTER (NOT i) AS unexplained, count(*) FILTER (NOT d) AS unobserved FROM (
    SELECT coalesce(x.mode, y.mode) AS mode, x.event_id IS NOT NULL AS d, y.event_id IS NOT NULL AS i FROM
    (SELECT CASE problem WHEN 'missing' THEN 'missing' WHEN 'repeated' THEN 'duplicates' ELSE 'corrupted_values' END AS mode, event_id FROM ({_RECON})) x
    FULL JOIN inj y ON x.mode = y.mode AND x.event_id = y.event_id) GROUP BY mode""", "inj"))
def j13(spark, sf):
    found = K.reconcile(env(spark, sf), delivered(spark, sf), None, _CONTENT)
    mode = F.when(F.col("problem") == "missing", "missing").when(F.col("problem") == "repeated", "duplicates").otherwise("corrupted_values")
    return K.grade(found.withColumn("mode", mode), injections(spark, sf))


@query("j14_injection_with_truth", with_sql("SELECT injection_id, e.value FROM inj JOIN env e USING (stream_id, event_id)", "inj"))
def j14(spark, sf):
    return injections(spark, sf).join(env(spark, sf).select("stream_id", "event_id", "value"), ["stream_id", "event_id"]).select("injection_id", "value")


@query("j15_compare_channels", with_sql("SELECT count(*) FILTER (id % 97 = 0) AS only_a, 0 AS only_b, count(*) FILTER (id % 97 <> 0 AND id % 211 = 0) AS different FROM env", "env"))
def j15(spark, sf):
    return K.compare_feeds(env(spark, sf), delivered(spark, sf), ["event_type", "value"])


@query("j20_relationship_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def j20(spark, sf):
    return K.where_exists(table(spark, sf, "customer"), table(spark, sf, "orders"), "c_custkey", "o_custkey", F.col("o_totalprice") > 300000).select("c_custkey")


@query("j20b_relationship_missing", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def j20b(spark, sf):
    return K.where_exists(table(spark, sf, "customer"), table(spark, sf, "orders"), "c_custkey", "o_custkey", F.col("o_totalprice") > 400000, negate=True).select("c_custkey")


@query("j22_version_as_of", with_sql("""SELECT event_id, CASE WHEN event_type = 'purchase' AND occurred_at >= TIMESTAMP '2024-01-20' THEN 3 WHEN event_type = 'purchase' AND occurred_at >= TIMESTAMP '2024-01-10' THEN 2
    WHEN event_type = 'view' AND occurred_at >= TIMESTAMP '2024-01-15' THEN 4 WHEN event_type IN ('purchase', 'view') THEN 1 END AS version FROM env""", "env"))
def j22(spark, sf):
    ups = spark.createDataFrame([("shop.purchase", "2024-01-10", 2), ("shop.purchase", "2024-01-20", 3), ("shop.view", "2024-01-15", 4)], "subject string, at string, to_version int").withColumn("at", F.col("at").cast("timestamp_ntz"))
    pins = spark.createDataFrame([("shop.purchase", 1), ("shop.view", 1)], "subject string, pin int")
    df = env(spark, sf).withColumn("subject", F.concat(F.lit("shop."), "event_type"))
    return K.version_as_of(df, pins, ups).select("event_id", "version")


@query("j24_schema_resolves", with_sql("SELECT event_id FROM env WHERE event_type IN ('signup', 'error')", "env"))
def j24(spark, sf):
    reg = spark.createDataFrame([("shop." + t, v) for t in ("click", "purchase", "view") for v in (1, 2)], "subject string, version int")
    df = env(spark, sf).select("event_id", F.concat(F.lit("shop."), "event_type").alias("subject"), F.lit(1).alias("version"))
    return df.join(reg, ["subject", "version"], "left_anti").select("event_id")


# windows


@query("w1_scd2", with_sql("SELECT entity_key, entity_version, status, valid_from, lead(valid_from) OVER w AS valid_to, lead(valid_from) OVER w IS NULL AS is_current FROM cdc WINDOW w AS (PARTITION BY entity_key ORDER BY entity_version)", "cdc"))
def w1(spark, sf):
    return K.scd2(cdc(spark, sf)).select("entity_key", "entity_version", "status", "valid_from", "valid_to", "is_current")


@query("w2_version_gaps", with_sql("SELECT entity_key, 6 AS entity_version, 4 AS before_version FROM cdcf WHERE entity_version = 6", "cdcf"))
def w2(spark, sf):
    return K.version_gaps(cdc_faults(spark, sf)).select("entity_key", "entity_version", "before_version")


@query("w3_image_chain", with_sql("SELECT entity_key, entity_version FROM cdcf WHERE order_key % 67 = 0 AND entity_version NOT IN (1, 6)", "cdcf"))
def w3(spark, sf):
    return K.image_chain_violations(cdc_faults(spark, sf))


@query("w4_no_ud_before_cr", with_sql("SELECT entity_key, entity_version FROM cdc WHERE entity_version > 1 AND entity_key % 9 = 0", "cdc"))
def w4(spark, sf):
    return K.cdc_order_violations(cdc(spark, sf).where("not (entity_key % 9 = 0 and entity_version = 1)")).select("entity_key", "entity_version")


@query("w8_sequence_gaps", with_sql("""SELECT stream_id, shard_id, b + 1 AS gap_from, sequence_no - 1 AS gap_to FROM (SELECT *, coalesce(lag(sequence_no) OVER (PARTITION BY stream_id, shard_id ORDER BY sequence_no), 0) AS b
    FROM (SELECT DISTINCT stream_id, shard_id, sequence_no FROM delivered)) WHERE sequence_no - b > 1""", "delivered"))
def w8(spark, sf):
    return K.sequence_gaps(delivered(spark, sf))


@query("w9_time_regressions", with_sql("SELECT event_id, copy FROM (SELECT *, lag(occurred_at) OVER (PARTITION BY stream_id, actor_id ORDER BY sequence_no, copy) AS b FROM delivered) WHERE occurred_at < b", "delivered"))
def w9(spark, sf):
    df = delivered(spark, sf)
    return K.time_regressions(df).select("event_id", "copy")


@query("w10_dedup", with_sql("SELECT event_id, copy FROM delivered WHERE copy = 0", "delivered"))
def w10(spark, sf):
    return K.dedup(delivered(spark, sf), ["event_id"], ["emitted_at", "copy"]).select("event_id", "copy")


@query("w11_duplicates_found", with_sql("SELECT event_id, 2 AS n FROM env WHERE id % 97 <> 0 AND id % 53 = 0", "env"))
def w11(spark, sf):
    return K.duplicate_ids(delivered(spark, sf))


@query("w12_displacement", with_sql("""SELECT event_id, d AS delivered_at, c AS canonical_at FROM (SELECT event_id, row_number() OVER (PARTITION BY stream_id, shard_id, date_trunc('hour', occurred_at) ORDER BY arr, sequence_no) AS d,
    row_number() OVER (PARTITION BY stream_id, shard_id, date_trunc('hour', occurred_at) ORDER BY sequence_no) AS c FROM (SELECT *, occurred_at + INTERVAL '1' MINUTE * (id % 37) AS arr FROM env)) WHERE d <> c""", "env"))
def w12(spark, sf):
    df = env(spark, sf).withColumn("arr", F.expr("occurred_at + make_dt_interval(0, 0, cast(id % 37 as int), 0)"))
    return K.displaced(df, "arr").select("event_id", "delivered_at", "canonical_at")


@query("w13_assign_sequence", with_sql("SELECT event_id, sequence_no FROM env", "env"))
def w13(spark, sf):
    return K.assign_sequence(env(spark, sf).drop("sequence_no"), ["stream_id", "shard_id"], "occurred_at", "id").select("event_id", "sequence_no")


@query("w14_partition_fifo", with_sql("""SELECT event_id, actor_id FROM (SELECT event_id, actor_id, sequence_no, lag(sequence_no) OVER (PARTITION BY actor_id ORDER BY occurred_at + INTERVAL '1' HOUR * (id % 5 * 12), event_id) AS b FROM env) WHERE sequence_no < b""", "env"))
def w14(spark, sf):
    e = env(spark, sf)
    return K.fifo_violations(e, e.withColumn("pos", F.expr("occurred_at + make_dt_interval(0, cast(id % 5 * 12 as int), 0, 0)")), "actor_id", "sequence_no", "pos")


@query("w15_current_state", with_sql("SELECT entity_key, entity_version, status, total FROM cdc WHERE op <> 'd' QUALIFY row_number() OVER (PARTITION BY entity_key ORDER BY entity_version DESC) = 1 AND entity_version = (SELECT max(c.entity_version) FROM cdc c WHERE c.entity_key = cdc.entity_key)", "cdc"))
def w15(spark, sf):
    return K.current_state(cdc(spark, sf)).select("entity_key", "entity_version", "status", "total")


@query("w16_lateness", with_sql("SELECT event_id, copy, (epoch_us(max(occurred_at) OVER (PARTITION BY stream_id ORDER BY emitted_at, id, copy ROWS UNBOUNDED PRECEDING)) - epoch_us(occurred_at)) / 1e6 AS late_s FROM delivered", "delivered"))
def w16(spark, sf):
    df = delivered(spark, sf).withColumn("tie", F.struct("id", "copy"))
    return K.lateness(df, "emitted_at", "tie", ["stream_id"]).select("event_id", "copy", "late_s")


# sets


@query("u1_scd2_grade", with_sql("SELECT count(*) FILTER (entity_version % 4 = 0) AS extra, count(*) FILTER (entity_version % 4 = 0 OR entity_version = 3) AS lacking FROM cdc", "cdc"))
def u1(spark, sf):
    c = cdc(spark, sf).select("entity_key", "entity_version", "total")
    return K.grade_table(c.where("entity_version <> 3").withColumn("total", F.when(F.col("entity_version") % 4 == 0, F.col("total") + 1).otherwise(F.col("total"))), c)


@query("u2_suppressed_ids", with_sql("SELECT event_id FROM env WHERE id % 97 = 0 AND id % 2 = 1", "env"))
def u2(spark, sf):
    e = env(spark, sf)
    return K.missing_ids(e, delivered(spark, sf), e.where("id % 97 = 0 and id % 2 = 0"))


@query("u3_all_instances", with_sql("SELECT event_id, count(*) AS n FROM (SELECT event_id FROM delivered UNION ALL SELECT event_id FROM env WHERE id % 89 = 0) GROUP BY 1", "delivered"))
def u3(spark, sf):
    return delivered(spark, sf).select("event_id").unionByName(env(spark, sf).where("id % 89 = 0").select("event_id")).groupBy("event_id").agg(F.count("*").alias("n"))


@query("u4_common_ids", with_sql("SELECT event_id FROM env WHERE id % 97 <> 0 AND event_type = 'view'", "env"))
def u4(spark, sf):
    return delivered(spark, sf).select("event_id").intersect(env(spark, sf).where("event_type = 'view'").select("event_id"))


@query("u5_graded_submission", with_sql("SELECT h AS hits, f AS false_positives, m AS misses, h / (h + f) AS precision, h / (h + m) AS recall FROM (SELECT count(*) FILTER (id % 53 = 0 AND id % 3 = 0)::DOUBLE AS h, count(*) FILTER (id % 53 <> 0 AND id % 30 = 0)::DOUBLE AS f, count(*) FILTER (id % 53 = 0 AND id % 3 <> 0)::DOUBLE AS m FROM env)", "env"))
def u5(spark, sf):
    e = env(spark, sf)
    return K.grade_ids(e.where("(id % 53 = 0 and id % 3 = 0) or (id % 53 <> 0 and id % 30 = 0)"), e.where("id % 53 = 0"))


_CH = "concat('ch_', event_id) AS change_id, sequence_no + 1 AS sequence_no, CASE WHEN id % 7 = 0 THEN occurred_at + INTERVAL '1' SECOND ELSE occurred_at END AS occurred_at, CASE WHEN id % 5 = 0 THEN 'ev_gone' ELSE event_id END AS causation_id, CASE WHEN id % 11 = 0 THEN 'x' ELSE correlation_id END AS correlation_id"


@query("j10_cdc_follows_cause", with_sql("SELECT 'ch_' || event_id AS change_id, CASE WHEN id % 5 = 0 THEN 'unresolved' WHEN id % 7 = 0 THEN 'time' ELSE 'correlation' END AS problem FROM caus WHERE event_type = 'purchase' AND (id % 5 = 0 OR id % 7 = 0 OR id % 11 = 0)", "caus"))
def j10(spark, sf):
    e = caused(spark, sf)
    changes = spark.sql("SELECT " + _CH + " FROM {e} WHERE event_type = 'purchase'", e=e)
    return K.cdc_cause_violations(changes, e)


@query("j23_drift_menu_join", with_sql("SELECT event_id, CASE event_type WHEN 'purchase' THEN 'region' WHEN 'view' THEN 'city' END AS added FROM env", "env"))
def j23(spark, sf):
    menu = spark.createDataFrame([("shop.purchase", "region"), ("shop.view", "city")], "subject string, added string")
    return K.with_drift_menu(env(spark, sf).withColumn("subject", F.concat(F.lit("shop."), "event_type")), menu).select("event_id", "added")


@query("w5_snapshot_rows", with_sql("SELECT entity_key, entity_version, CASE WHEN entity_version > 1 THEN 'repeated' END AS problem FROM cdc WHERE entity_version IN (2, 3) AND entity_key % 2 = 0", "cdc"))
def w5(spark, sf):
    op = F.when((F.col("entity_version") == 1) | (F.col("entity_version").isin(2, 3) & (F.col("entity_key") % 2 == 0)), "r").otherwise(F.col("op"))
    return K.snapshot_violations(cdc(spark, sf).withColumn("op", op))


@query("w6_background_roots", with_sql("SELECT 'o' || order_key AS change_id FROM cdc WHERE order_key % 2 = 0 AND order_key % 6 = 0", "cdc"))
def w6(spark, sf):
    c = cdc(spark, sf).withColumn("change_id", F.concat(F.lit("o"), F.col("order_key").cast("string"))).withColumn("tx_id", F.when(F.col("order_key") % 2 == 1, F.col("order_key")))
    c = c.withColumn("causation_id", F.when(F.col("order_key") % 6 == 0, "someone")).withColumn("actor_id", F.lit(None).cast("string")).withColumn("correlation_id", F.col("change_id"))
    return K.root_violations(c)
