"""Queries of counts, rates, profiles and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlab.catalog import query, table
from eventlab.fixtures import cdc, delivered, env, injections, sessions, with_sql
from eventlab.operators import pages as P
from eventlab.operators import rows as R
from eventlab.operators import stats as A
from eventlab.queries.draws import DIURNAL, WEEKLY


def _ev(spark, sf):
    return table(spark, sf, "events")


@query("a1_row_count", "SELECT count(*) AS n, count(*) = 10000 AS as_expected FROM events")
def a1(spark, sf):
    return A.row_count(_ev(spark, sf), 10000)


@query("a2_daily_revenue", "SELECT o_orderdate::DATE AS day, count(*) AS orders, sum(o_totalprice::DECIMAL(18,2)) AS revenue FROM orders GROUP BY 1")
def a2(spark, sf):
    return A.daily_revenue(table(spark, sf, "orders"), "o_orderdate", "o_totalprice")


@query("a3_stream_tally", with_sql("SELECT stream_id, event_type, count(*) AS n, max(occurred_at) AS last_event_at FROM delivered GROUP BY ROLLUP (stream_id, event_type)", "delivered"))
def a3(spark, sf):
    return A.tally(delivered(spark, sf))


@query("a4_buffer_window", with_sql("SELECT stream_id, min(emitted_at) AS oldest, max(emitted_at) AS newest FROM delivered GROUP BY 1", "delivered"))
def a4(spark, sf):
    return A.buffer_window(delivered(spark, sf))


@query("a5_observed_rate", with_sql("SELECT stream_id, round(count(*) FILTER (epoch_us(emitted_at) // 1000 > epoch_ms(TIMESTAMP '2024-01-15') - 172800000 AND epoch_us(emitted_at) // 1000 <= epoch_ms(TIMESTAMP '2024-01-15')) / 172800, 1) AS rate FROM env GROUP BY 1", "env"))
def a5(spark, sf):
    return A.observed_rate(env(spark, sf), 172800, F.lit("2024-01-15"))


@query("a6_rate_from_tail", with_sql("SELECT stream_id, round(count(*) FILTER (epoch_us(emitted_at) // 1000 > m - 3600000) / 3600, 1) AS rate FROM (SELECT *, max(epoch_us(emitted_at) // 1000) OVER (PARTITION BY stream_id) AS m FROM env) GROUP BY 1", "env"))
def a6(spark, sf):
    return A.observed_rate(env(spark, sf), 3600)


@query("a7_health_status", with_sql("SELECT stream_id, CASE stream_id WHEN 'st_1' THEN 'degraded' WHEN 'st_2' THEN NULL ELSE CASE WHEN TIMESTAMP '2024-01-30 12:00:00' - max(occurred_at) > INTERVAL '30' SECOND THEN 'stale' ELSE 'healthy' END END AS health FROM env GROUP BY 1", "env"))
def a7(spark, sf):
    state = F.when(F.col("stream_id") == "st_1", "failed").when(F.col("stream_id") == "st_2", "paused").otherwise("running")
    stats = env(spark, sf).groupBy("stream_id").agg(F.max("occurred_at").alias("last_event_at")).withColumn("state", state)
    return A.health(stats, F.lit("2024-01-30 12:00:00")).select("stream_id", "health")


_MODES = ", ".join(f"('{m}')" for m in A.MODES)


@query("a8_a9_a10_injection_summary", with_sql(f"""SELECT mode, count(event_id) AS n, coalesce(sum(copies), 0) AS extra_copies, count(*) FILTER (outcome = 'pending') AS pending, count(*) FILTER (outcome = 'emitted') AS emitted,
    count(*) FILTER (outcome = 'discarded') AS discarded FROM (VALUES {_MODES}) m(mode) LEFT JOIN inj USING (mode) GROUP BY mode""", "inj"))
def a8(spark, sf):
    return A.injection_summary(injections(spark, sf))


@query("a11_canonical_events", with_sql(f"""SELECT mode, (SELECT count(*) FROM inj WHERE inj.mode = m.mode AND occurred_at >= TIMESTAMP '2024-01-08' AND occurred_at < TIMESTAMP '2024-01-22') AS n,
    (SELECT count(*) FROM env WHERE occurred_at >= TIMESTAMP '2024-01-08' AND occurred_at < TIMESTAMP '2024-01-22') AS canonical FROM (VALUES {_MODES}) m(mode)""", "inj"))
def a11(spark, sf):
    return A.answer_key_summary(env(spark, sf), injections(spark, sf), "2024-01-08", "2024-01-22")


EDGES = [("view to click", "view", "click", 0.8, 1.2, 30), ("click to purchase", "click", "purchase", 0.2, 0.4, 30), ("purchase to error", "purchase", "error", 0.0, 2.0, 10**9)]


@query("a12_a13_funnel", """SELECT edge, numerator, denominator, numerator / denominator AS ratio, CASE WHEN denominator < least THEN 'INSUFFICIENT' WHEN numerator / denominator BETWEEN low AND high THEN 'pass' ELSE 'fail' END AS verdict
    FROM (SELECT e.*, (SELECT count(*) FROM events WHERE event_type = t) AS numerator, (SELECT count(*) FROM events WHERE event_type = f) AS denominator
    FROM (VALUES ('view to click', 'view', 'click', 0.8, 1.2, 30), ('click to purchase', 'click', 'purchase', 0.2, 0.4, 30), ('purchase to error', 'purchase', 'error', 0.0, 2.0, 1000000000)) e(edge, f, t, low, high, least))""")
def a12(spark, sf):
    return A.funnel(_ev(spark, sf), EDGES)


@query("a14_session_funnel", with_sql("""SELECT count(*) AS sessions, avg(v) AS views, 100.0 * count(*) FILTER (c > 0 AND p > 0) / count(*) FILTER (c > 0) AS conversion_pct FROM (
    SELECT session_id, count(*) FILTER (event_type = 'view') AS v, count(*) FILTER (event_type = 'click') AS c, count(*) FILTER (event_type = 'purchase') AS p FROM sess GROUP BY 1)""", "sess"))
def a14(spark, sf):
    return A.session_funnel(sessions(spark, sf))


@query("a15_shares", "SELECT event_type, count(*) / (SELECT count(*) FROM events) AS share, abs(count(*) / (SELECT count(*) FROM events) - 0.2) <= 0.01 AS ok FROM events GROUP BY 1")
def a15(spark, sf):
    return A.shares(_ev(spark, sf), "event_type", {t: 0.2 for t in ("click", "error", "purchase", "signup", "view")}, 0.01)


@query("a16_conversion_pct", "SELECT count(*) FILTER (event_type = 'purchase') AS part, count(*) FILTER (event_type = 'view') AS whole, 100.0 * count(*) FILTER (event_type = 'purchase') / count(*) FILTER (event_type = 'view') AS pct FROM events")
def a16(spark, sf):
    return A.conversion(_ev(spark, sf), "purchase", "view")


@query("a17_latency_check", "SELECT *, median BETWEEN 1 AND 50 AND p95 BETWEEN 1 AND 5 AS ok FROM (SELECT median(value) AS median, (SELECT value FROM (SELECT value, row_number() OVER (ORDER BY value) AS r, count(*) OVER () AS n FROM events) WHERE r = floor(0.95 * (n - 1) + 0.5) + 1) AS p95 FROM events)")
def a17(spark, sf):
    return A.latency_check(_ev(spark, sf), "value", (1, 50), (1, 5))


@query("a18_hour_profile", f"SELECT h AS hour, count(event_id) AS n, count(event_id) / (SELECT count(*) FROM events) AS share, ({[x / sum(DIURNAL) for x in DIURNAL]})[h + 1] AS expected FROM range(24) r(h) LEFT JOIN events ON hour(ts) = h GROUP BY h")
def a18(spark, sf):
    return A.hour_profile(_ev(spark, sf), "ts", DIURNAL)


@query("a20_weekday_profile", "SELECT isodow(ts) - 1 AS weekday, count(DISTINCT ts::DATE) AS days, count(*) AS n, count(*) / count(DISTINCT ts::DATE) AS per_day FROM events GROUP BY 1")
def a20(spark, sf):
    return A.weekday_profile(_ev(spark, sf), "ts")


@query("a21_pearson_profile", f"SELECT corr(({WEEKLY})[d + 1] * ({DIURNAL})[h + 1], n) AS r FROM (SELECT d, h, count(event_id) AS n FROM range(7) a(d) CROSS JOIN range(24) b(h) LEFT JOIN events ON isodow(ts) - 1 = d AND hour(ts) = h GROUP BY d, h)")
def a21(spark, sf):
    return A.profile_correlation(_ev(spark, sf), "ts", DIURNAL, WEEKLY)


@query("a22_realized_mode_rate", with_sql("""SELECT mode, realized, abs(realized - rate) <= greatest(0.01, 0.1 * rate) AS ok FROM (SELECT *, (SELECT count(*) FROM inj WHERE inj.mode = m.mode) / (SELECT count(*) FROM env) AS realized
    FROM (VALUES ('missing', 0.01), ('duplicates', 0.05), ('nulls', 0.1)) m(mode, rate))""", "inj"))
def a22(spark, sf):
    return A.mode_rates(injections(spark, sf), env(spark, sf), {"missing": 0.01, "duplicates": 0.05, "nulls": 0.1})


@query("a23_late_delay_median", with_sql("SELECT median(delay_ms) AS median_ms, abs(median_ms - 1500000) <= 225000 AS ok, median_ms / 60 AS wall_ms FROM inj WHERE mode = 'late_arriving'", "inj"))
def a23(spark, sf):
    return A.late_delay_stats(injections(spark, sf), 1_500_000, 60)


@query("a24_a25_a26_lag_health", "SELECT *, slope <= 0 AND p99 < 5 AS healthy FROM (SELECT regr_slope(value, event_id) AS slope, (SELECT value FROM (SELECT value, row_number() OVER (ORDER BY value) AS r, count(*) OVER () AS n FROM events) WHERE r = floor(0.99 * (n - 1) + 0.5) + 1) AS p99 FROM events)")
def a24(spark, sf):
    return A.lag_health(_ev(spark, sf), "event_id", "value")


@query("a25b_percentile_by_type", "SELECT event_type, value FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE r = floor(0.9 * (n - 1) + 0.5) + 1")
def a25(spark, sf):
    return A.percentile_nearest(_ev(spark, sf), "value", 0.9, "event_type")


@query("a28_tallies_reconcile", with_sql("SELECT feed, n, false AS equal FROM (SELECT 'truth' AS feed, count(*) AS n FROM env UNION ALL SELECT 'delivered', count(*) FROM delivered)", "delivered"))
def a28(spark, sf):
    return A.tallies_reconcile({"truth": env(spark, sf), "delivered": delivered(spark, sf)})


@query("a31_payload_sizes", "SELECT max(strlen(props)) AS largest, count(*) FILTER (strlen(props) > 8) AS too_large, (SELECT b FROM (SELECT strlen(props) AS b, row_number() OVER (ORDER BY strlen(props)) AS r, count(*) OVER () AS n FROM events) WHERE r = floor(0.99 * (n - 1) + 0.5) + 1) AS p99 FROM events")
def a31(spark, sf):
    return A.payload_sizes(_ev(spark, sf), "props", 8)


@query("a32_transition_rates", with_sql("""SELECT state, nxt AS next, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY state) AS rate FROM (SELECT event_type AS state, coalesce(lead(event_type) OVER (PARTITION BY session_id ORDER BY occurred_at, id), '(end)') AS nxt FROM sess) GROUP BY 1, 2""", "sess"))
def a32(spark, sf):
    return A.transition_rates(sessions(spark, sf), "session_id", ["occurred_at", "id"])


@query("a33_events_per_session", with_sql("SELECT count(*) AS sessions, avg(n) AS events, avg(t) AS types FROM (SELECT count(*) AS n, count(DISTINCT event_type) AS t FROM sess GROUP BY session_id)", "sess"))
def a33(spark, sf):
    return A.session_stats(sessions(spark, sf))


@query("a34_create_parity", with_sql("SELECT *, events = creates AS equal FROM (SELECT (SELECT count(*) FROM events WHERE event_type = 'signup') AS events, count(*) FILTER (op = 'c') AS creates FROM cdc)", "cdc"))
def a34(spark, sf):
    return A.create_parity(_ev(spark, sf), cdc(spark, sf), "signup")


@query("a35_usage_per_day", with_sql("""SELECT workspace_id, d AS day, sum(g)::BIGINT AS generated, sum(x)::BIGINT AS delivered FROM (SELECT workspace_id, occurred_at::DATE AS d, 1 AS g, 0 AS x FROM env
    UNION ALL SELECT workspace_id, occurred_at::DATE, 0, 1 FROM delivered) GROUP BY CUBE (workspace_id, d)""", "delivered"))
def a35(spark, sf):
    return A.usage(env(spark, sf), delivered(spark, sf))


@query("a36_quota_breaches", with_sql("SELECT workspace_id, occurred_at::DATE AS day, count(*) AS n, CASE workspace_id WHEN 'ws_0' THEN 2 ELSE 9 END AS day_limit FROM env GROUP BY 1, 2 HAVING count(*) > CASE workspace_id WHEN 'ws_0' THEN 2 ELSE 9 END", "env"))
def a36(spark, sf):
    per = env(spark, sf).groupBy("workspace_id", F.to_date("occurred_at").alias("day")).agg(F.count("*").alias("n"))
    plans = spark.createDataFrame([(f"ws_{k}", 2 if k == 0 else 9) for k in range(4)], "workspace_id string, day_limit int")
    return A.quota_breaches(per, plans)


@query("a37_estimate_events", "SELECT c_custkey, ceil((c_custkey % 100) * 1.5 * 30 * 4.2)::BIGINT + 7 AS events FROM customer")
def a37(spark, sf):
    plans = table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 100).alias("actors"), F.lit(1.5).cast("decimal(4,1)").alias("visits"), F.lit(30).alias("days"), F.lit(4.2).cast("decimal(4,1)").alias("per_session"), F.lit(7).alias("seeds"))
    return A.estimate(plans).select("c_custkey", F.col("events").cast("long").alias("events"))


@query("a38_freshness_slo", "SELECT count(*) AS n, avg(CASE WHEN value <= 30 THEN 1.0 ELSE 0.0 END) AS good, 1 - (1 - avg(CASE WHEN value <= 30 THEN 1.0 ELSE 0.0 END)) / (1 - 0.99) AS budget_left FROM events")
def a38(spark, sf):
    return A.freshness_slo(_ev(spark, sf), F.col("value"))


@query("a39_availability_slo", "SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS start, count(*) FILTER (event_type <> 'error') AS good, count(*) AS total, (1 - count(*) FILTER (event_type <> 'error') / count(*)) / (1 - 0.999) AS burn FROM events GROUP BY 1")
def a39(spark, sf):
    return A.slo_burn(_ev(spark, sf), "ts", F.col("event_type") != "error", "6 hours", 0.999)


@query("a40_partition_counts", with_sql("SELECT ('0x' || substr(md5(actor_id), 1, 7))::BIGINT % 12 AS partition, count(*) AS n FROM env GROUP BY 1", "env"))
def a40(spark, sf):
    return A.partition_counts(env(spark, sf), "actor_id", 12)


@query("a41_negative_stock", "SELECT l_partkey, l_orderkey, l_linenumber, 60 - sum(l_quantity) OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_quantity ROWS UNBOUNDED PRECEDING) AS stock FROM lineitem QUALIFY stock < 0".replace("l_linenumber", "l_suppkey"))
def a41(spark, sf):
    li = table(spark, sf, "lineitem")
    return A.negative_stock(li, "l_partkey", ["l_orderkey", "l_suppkey", "l_quantity"], -F.col("l_quantity"), F.lit(60)).select("l_partkey", "l_orderkey", "l_suppkey", "stock")


@query("a42_stock_reconciliation", "SELECT l_partkey AS key, 500 - sum(l_quantity) + (l_partkey % 11 = 0)::INT AS stock, 500 - sum(l_quantity) AS expected FROM lineitem WHERE l_partkey % 11 = 0 GROUP BY l_partkey")
def a42(spark, sf):
    li = table(spark, sf, "lineitem")
    final = li.groupBy(F.col("l_partkey").alias("key")).agg((500 - F.sum("l_quantity")).alias("stock")).withColumn("seed", F.lit(500)).withColumn("stock", F.col("stock") + (F.col("key") % 11 == 0).cast("int"))
    return A.stock_reconcile(final, li.select(F.col("l_partkey").alias("key"), (-F.col("l_quantity")).alias("change")))


@query("a43_content_hash", """WITH t AS (SELECT event_id::VARCHAR AS a, epoch_us(ts)::VARCHAR AS b, round(value * 100)::BIGINT::VARCHAR AS c, event_type AS d FROM events),
    h AS (SELECT ('0x' || substr(md5(coalesce(length(a) || ':' || a, '-') || coalesce(length(b) || ':' || b, '-') || coalesce(length(c) || ':' || c, '-') || coalesce(length(d) || ':' || d, '-')), 1, 15))::BIGINT AS h FROM t)
    SELECT count(*) AS n, bit_xor(h) AS x, (sum(h::HUGEINT) % 1152921504606846976)::BIGINT AS s FROM h""")
def a43(spark, sf):
    df = _ev(spark, sf).select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), F.round(F.col("value") * 100).cast("long").alias("cents"), "event_type")
    return A.table_hash(df, "event_id", "micros", "cents", "event_type")


@query("a44_distinct_users", with_sql("SELECT DISTINCT actor_id FROM env", "env"))
def a44(spark, sf):
    return A.users(env(spark, sf))


@query("a45_stats_document", with_sql("SELECT stream_id, total, last_sequence_no, modes FROM (SELECT stream_id, count(*) AS total, max(sequence_no) AS last_sequence_no FROM delivered GROUP BY 1) LEFT JOIN (SELECT stream_id, to_json(map_from_entries(list((mode, n) ORDER BY mode)))::VARCHAR AS modes FROM (SELECT stream_id, mode, count(*) AS n FROM inj GROUP BY 1, 2) GROUP BY 1) USING (stream_id)", "delivered", "inj"))
def a45(spark, sf):
    return A.stats_document(delivered(spark, sf), injections(spark, sf)).withColumn("modes", F.to_json("modes"))


@query("a46_background_rate", with_sql("SELECT count(*) FILTER (order_key % 2 = 0) / (150 * 30) AS realized, abs(realized - 0.16) <= 0.02 AS ok FROM cdc", "cdc"))
def a46(spark, sf):
    return A.background_rate(cdc(spark, sf).withColumn("tx_id", F.when(F.col("order_key") % 2 == 1, F.col("order_key"))), 150, 30, 0.16, 0.02)


# pages

_P0 = 1704844800000  # 2024-01-10


@query("l1_restore_order", with_sql("SELECT event_id, stream_id, shard_id, sequence_no FROM env ORDER BY shard_id, sequence_no, stream_id", "env"))
def l1(spark, sf):
    return P.restore_order(env(spark, sf)).select("event_id", "stream_id", "shard_id", "sequence_no")


_PAGE = f"SELECT * FROM env WHERE epoch_us(emitted_at) // 1000 > {_P0} OR (epoch_us(emitted_at) // 1000 = {_P0} AND sequence_no > 5) ORDER BY epoch_us(emitted_at) // 1000, sequence_no, event_id LIMIT 100"


@query("l2_page_events", with_sql(f"SELECT event_id, sequence_no FROM ({_PAGE})", "env"))
def l2(spark, sf):
    return P.page(env(spark, sf), _P0, 5, 100).select("event_id", "sequence_no")


@query("l3_page_next", with_sql(f"SELECT x[1] AS p, x[2] AS s, x[3] AS e FROM (SELECT max((epoch_us(emitted_at) // 1000, sequence_no, event_id)) AS x FROM ({_PAGE}))", "env"))
def l3(spark, sf):
    return P.next_position(P.page(env(spark, sf), _P0, 5, 100), _P0, 5)


#: Rows of which many share a position: times cut to days, numbers to tens.
_TIED = "SELECT id, event_id, date_trunc('day', emitted_at) AS emitted_at, sequence_no % 10 AS sequence_no FROM env"


@query("l3b_pages_of_ties", with_sql(f"SELECT event_id, (row_number() OVER (ORDER BY emitted_at, sequence_no, event_id) - 1) // 7 AS page FROM (SELECT * FROM ({_TIED}) WHERE epoch_us(emitted_at) // 1000 > {_P0}) QUALIFY row_number() OVER (ORDER BY emitted_at, sequence_no, event_id) <= 35", "env"))
def l3b(spark, sf):
    """Five pages of seven rows, each read from where the one before it ends, among rows that share their positions: none is lost, none comes twice."""
    df = env(spark, sf).select("id", "event_id", F.date_trunc("day", "emitted_at").cast("timestamp_ntz").alias("emitted_at"), (F.col("sequence_no") % 10).alias("sequence_no"))
    at, out = (_P0, 10, None), None
    for k in range(5):
        rows = P.page(df, at[0], at[1], 7, e=at[2])
        at = tuple(P.next_position(rows, at[0], at[1], e=at[2]).first())
        part = rows.select("event_id", F.lit(k).cast("long").alias("page"))
        out = part if out is None else out.unionByName(part)
    return out


@query("l4_from_latest", with_sql("SELECT epoch_us(emitted_at) // 1000 AS p, sequence_no AS s FROM env ORDER BY 1 DESC, 2 DESC LIMIT 1", "env"))
def l4(spark, sf):
    return P.latest(env(spark, sf))


@query("l5_from_time", with_sql("SELECT epoch_us(emitted_at) // 1000 AS p, sequence_no - 1 AS s FROM env WHERE emitted_at >= TIMESTAMP '2024-01-12 06:00:00' ORDER BY 1, 2 LIMIT 1", "env"))
def l5(spark, sf):
    return P.from_time(env(spark, sf), "2024-01-12 06:00:00")


@query("l6_earliest_retained", with_sql("SELECT epoch_us(emitted_at) // 1000 AS p, sequence_no - 1 AS s FROM env ORDER BY 1, 2 LIMIT 1", "env"))
def l6(spark, sf):
    return P.earliest(env(spark, sf))


@query("l7_expired_positions", with_sql(f"SELECT p, s, p < {_P0} - 172800000 OR p < 1704700000000 AS expired FROM (SELECT epoch_us(emitted_at) // 1000 AS p, sequence_no AS s FROM env)", "env"))
def l7(spark, sf):
    pos = env(spark, sf).select(P.epoch_ms(F.col("emitted_at")).alias("p"), F.col("sequence_no").alias("s"))
    return P.expired(pos, _P0, 48, 1704700000000)


@query("l8_page_injections", with_sql("SELECT injection_id FROM inj WHERE recorded_at < TIMESTAMP '2024-01-25' ORDER BY recorded_at DESC, injection_id DESC LIMIT 20", "inj"))
def l8(spark, sf):
    return P.page_injections(injections(spark, sf), ("2024-01-25", ""), 20).select("injection_id")


@query("l9_page_canonical", with_sql("SELECT event_id FROM env WHERE stream_id = 'st_3' AND sequence_no > 10 AND event_type IN ('view', 'click') ORDER BY sequence_no LIMIT 50", "env"))
def l9(spark, sf):
    return P.page_canonical(env(spark, sf), "st_3", (0, 10), ["view", "click"], 50).select("event_id")


@query("l10_page_filtered", with_sql(f"SELECT event_id FROM ({_PAGE}) WHERE event_type = 'view'", "env"))
def l10(spark, sf):
    return R.filter_events(P.page(env(spark, sf), _P0, 5, 100), ["view"]).select("event_id")
