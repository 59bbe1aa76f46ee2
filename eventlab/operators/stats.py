"""Counts, rates, profiles and service levels of event tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlab.operators.ranges import with_running
from eventlab.sources.tables import cut

#: The failure modes, in the order in which they are injected (fixed values).
MODES = ("missing", "duplicates", "corrupted_values", "nulls", "schema_drift", "out_of_order", "late_arriving")


def row_count(df: DataFrame, expected: int) -> DataFrame:
    return df.agg(F.count("*").alias("n")).withColumn("as_expected", F.col("n") == expected)


def daily_revenue(df: DataFrame, time: str, amount: str) -> DataFrame:
    """Orders and exact revenue per UTC day."""
    return df.groupBy(F.to_date(time).alias("day")).agg(F.count("*").alias("orders"), F.sum(F.col(amount).cast("decimal(18,2)")).alias("revenue"))


def tally(df: DataFrame) -> DataFrame:
    """Rows and last event time per stream and type, with totals per stream and over all (nulls)."""
    return df.rollup("stream_id", "event_type").agg(F.count("*").alias("n"), F.max("occurred_at").alias("last_event_at"))


def buffer_window(df: DataFrame) -> DataFrame:
    return df.groupBy("stream_id").agg(F.min("emitted_at").alias("oldest"), F.max("emitted_at").alias("newest"))


def observed_rate(df: DataFrame, window_s: int, now: Column | None = None) -> DataFrame:
    """Events a second per stream in the last ``window_s`` before ``now``, or before the stream's last event; one decimal."""
    ms = F.unix_millis(F.col("emitted_at").cast("timestamp"))
    if now is not None:
        end = F.unix_millis(now.cast("timestamp"))
        n = F.count_if((ms > end - window_s * 1000) & (ms <= end))
        return df.groupBy("stream_id").agg(F.round(n / window_s, 1).alias("rate"))
    last = df.groupBy("stream_id").agg(F.max(ms).alias("_end"))
    both = df.join(last, "stream_id")
    return both.groupBy("stream_id").agg(F.round(F.count_if(ms > F.col("_end") - window_s * 1000) / window_s, 1).alias("rate"))


def health(stats: DataFrame, now: Column, stale_s: int = 30) -> DataFrame:
    """healthy, stale or degraded per stream (stream_id, state, last_event_at); null unless it runs."""
    quiet = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_event_at").cast("timestamp"))) > stale_s * 1_000_000
    status = F.when(F.col("state") == "failed", "degraded").when(F.col("state") != "running", F.lit(None)).when(F.coalesce(quiet, F.lit(True)), "stale").otherwise("healthy")
    return stats.withColumn("health", status)


def injection_summary(inj: DataFrame) -> DataFrame:
    """All modes with their counts, extra copies and outcomes of late rows, zeros included."""
    modes = inj.sparkSession.createDataFrame([(m,) for m in MODES], "mode string")
    found = inj.groupBy("mode").agg(F.count("*").alias("n"), F.sum("copies").alias("extra_copies"), *[F.count_if(F.col("outcome") == o).alias(o) for o in ("pending", "emitted", "discarded")])
    return modes.join(found, "mode", "left").fillna(0)


def answer_key_summary(ledger: DataFrame, inj: DataFrame, start: str, end: str) -> DataFrame:
    """Mode counts of a time window next to its number of truth events."""

    def inside(df: DataFrame) -> DataFrame:
        return df.where((F.col("occurred_at") >= F.lit(start).cast("timestamp_ntz")) & (F.col("occurred_at") < F.lit(end).cast("timestamp_ntz")))

    total = inside(ledger).agg(F.count("*").alias("canonical"))
    return injection_summary(inside(inj)).select("mode", "n").crossJoin(F.broadcast(total))  # one row


def funnel(df: DataFrame, edges: Sequence[tuple[str, str, str, float, float, int]]) -> DataFrame:
    """(edge, numerator, denominator, ratio, verdict) for edges (name, from, to, low, high, least n), in one pass."""
    types = sorted({t for e in edges for t in e[1:3]})
    counts = df.agg(*[F.count_if(F.col("event_type") == t).alias(t) for t in types])
    rows = [F.struct(F.lit(n).alias("edge"), F.col(b).alias("numerator"), F.col(a).alias("denominator"), F.lit(lo).alias("low"), F.lit(hi).alias("high"), F.lit(least).alias("least")) for n, a, b, lo, hi, least in edges]
    out = counts.select(F.inline(F.array(*rows))).withColumn("ratio", F.try_divide("numerator", "denominator"))
    verdict = F.when(F.col("denominator") < F.col("least"), "INSUFFICIENT").when(F.col("ratio").between(F.col("low"), F.col("high")), "pass").otherwise("fail")
    return out.select("edge", "numerator", "denominator", "ratio", verdict.alias("verdict"))


def session_funnel(df: DataFrame) -> DataFrame:
    """Sessions, mean views of a session, and the percentage of sessions with a click that have a purchase."""
    one = df.groupBy("session_id").agg(*[F.count_if(F.col("event_type") == t).alias(t) for t in ("view", "click", "purchase")])
    return one.agg(F.count("*").alias("sessions"), F.avg("view").alias("views"), F.try_divide(100.0 * F.count_if((F.col("click") > 0) & (F.col("purchase") > 0)), F.count_if(F.col("click") > 0)).alias("conversion_pct"))


def shares(df: DataFrame, col: str, expected: dict[str, float], tolerance: float) -> DataFrame:
    """Share of each value against the expected one."""
    per = df.groupBy(col).agg(F.count("*").alias("n"))
    total = per.agg(F.sum("n").alias("_all"))
    want = df.sparkSession.createDataFrame(list(expected.items()), f"{col} string, expected double")
    out = want.join(per, col, "left").crossJoin(F.broadcast(total))  # one row
    share = F.coalesce(F.col("n"), F.lit(0)) / F.col("_all")
    return out.select(col, share.alias("share"), (F.abs(share - F.col("expected")) <= tolerance).alias("ok"))


def conversion(df: DataFrame, part: str, whole: str) -> DataFrame:
    a, b = F.count_if(F.col("event_type") == part), F.count_if(F.col("event_type") == whole)
    return df.agg(a.alias("part"), b.alias("whole"), F.try_divide(100.0 * a, b).alias("pct"))


def _ranked(df: DataFrame, col: str, *keys: str) -> DataFrame:
    """The distinct values per key with ``_u``, the rows up to and with the value, and ``_all``, the key's rows.

    Counts per value are ranged by key and value; ranks run within a range, plus the rows of
    the ranges before.  So no task holds all values of a key, however many there are.
    """
    per = df.where(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count("*").alias("_n"))
    part = cut(per.repartitionByRange(*keys, col).withColumn("_part", F.spark_partition_id()), "counts")
    names = [f"_key{i}" for i in range(len(keys))]
    w = Window.partitionBy(*names)
    before = F.coalesce(F.sum("_size").over(w.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = part.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col("_part").alias("_p")).agg(F.sum("_n").alias("_size"))
    sizes = sizes.select(*names, "_p", before.alias("_before"), F.sum("_size").over(w).alias("_all"))  # a row for each range of a key
    on = F.col("_part") == F.col("_p")
    for k, n in zip(keys, names):
        on = on & F.col(k).eqNullSafe(F.col(n))
    upto = F.sum("_n").over(Window.partitionBy(*keys, "_part").orderBy(col).rowsBetween(Window.unboundedPreceding, 0))
    return part.withColumn("_upto", upto).join(sizes, on).select(*keys, col, (F.col("_upto") + F.col("_before")).alias("_u"), "_all")


def percentile_nearest(df: DataFrame, col: str, p: float, *keys: str) -> DataFrame:
    """The value at nearest rank round(p (n - 1)) + 1 per key, from counts per value."""
    rank = F.floor(p * (F.col("_all") - 1) + 0.5) + 1
    return _ranked(df, col, *keys).where(F.col("_u") >= rank).groupBy(*keys).agg(F.min(col).alias(col))


def latency_check(lat: DataFrame, col: str, median: tuple[float, float], p95: tuple[float, float]) -> DataFrame:
    """Exact median and nearest-rank 95th percentile of latencies against bands."""
    last = F.col("_all") - 1

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("_u") > rank, F.col(col)))

    middle = (at(F.floor(last / 2)) + at(F.ceil(last / 2))) / 2
    out = _ranked(lat, col).agg(middle.alias("median"), at(F.floor(0.95 * last + 0.5)).alias("p95"))
    return out.withColumn("ok", F.col("median").between(*median) & F.col("p95").between(*p95))


def hour_profile(df: DataFrame, time: str, curve: Sequence[float]) -> DataFrame:
    """(hour, n, share, expected) over all 24 hours."""
    per = df.groupBy(F.hour(time).alias("hour")).agg(F.count("*").alias("n"))
    total = per.agg(F.sum("n").alias("_all"))
    want = df.sparkSession.createDataFrame([(h, c / sum(curve)) for h, c in enumerate(curve)], "hour int, expected double")
    out = want.join(per, "hour", "left").crossJoin(F.broadcast(total))  # one row
    return out.select("hour", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / F.col("_all")).alias("share"), "expected")


def weekday_profile(df: DataFrame, time: str) -> DataFrame:
    """(weekday, days, n, per_day): events of a weekday for each such day that has events."""
    days = df.groupBy(F.to_date(time).alias("_d")).agg(F.count("*").alias("_n"))
    return days.groupBy(F.weekday("_d").alias("weekday")).agg(F.count("*").alias("days"), F.sum("_n").alias("n")).withColumn("per_day", F.col("n") / F.col("days"))


def profile_correlation(df: DataFrame, time: str, diurnal: Sequence[float], weekly: Sequence[float]) -> DataFrame:
    """Pearson's r of the 168 hours of the week with the product of two curves."""
    per = df.groupBy(F.weekday(time).alias("wd"), F.hour(time).alias("h")).agg(F.count("*").alias("n"))
    want = df.sparkSession.createDataFrame([(d, h, float(weekly[d] * diurnal[h])) for d in range(7) for h in range(24)], "wd int, h int, x double")
    return want.join(per, ["wd", "h"], "left").agg(F.corr("x", F.coalesce("n", F.lit(0))).alias("r"))


def mode_rates(inj: DataFrame, ledger: DataFrame, policy: dict[str, float]) -> DataFrame:
    """Realized rate of each mode, and whether it is within the larger of 1 point and a tenth of its policy."""
    want = inj.sparkSession.createDataFrame(list(policy.items()), "mode string, rate double")
    per = inj.groupBy("mode").agg(F.count("*").alias("n"))
    out = want.join(per, "mode", "left").crossJoin(F.broadcast(ledger.agg(F.count("*").alias("_all"))))  # one row
    real = F.coalesce("n", F.lit(0)) / F.col("_all")
    return out.select("mode", real.alias("realized"), (F.abs(real - F.col("rate")) <= F.greatest(F.lit(0.01), 0.1 * F.col("rate"))).alias("ok"))


def late_delay_stats(inj: DataFrame, expected_ms: float, k: float) -> DataFrame:
    """Median simulated delay within 15 %, and the wall delay at k simulated seconds a second."""
    ranked = _ranked(inj.where("mode = 'late_arriving'"), "delay_ms")
    # the mean of the two in the middle, which are the same for odd numbers
    low, high = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1
    out = ranked.agg(F.min(F.when(F.col("_u") >= low, F.col("delay_ms"))).alias("a"), F.min(F.when(F.col("_u") >= high, F.col("delay_ms"))).alias("b")).select(((F.col("a") + F.col("b")) / 2).alias("median_ms"))
    return out.withColumn("ok", F.abs(F.col("median_ms") - expected_ms) <= 0.15 * expected_ms).withColumn("wall_ms", F.col("median_ms") / k)


def lag_health(df: DataFrame, x: str, lag: str, limit_s: float = 5.0) -> DataFrame:
    """Slope of the lag by least squares and its p99; healthy if it doesn't rise and p99 is under the limit."""
    slope = df.agg(F.regr_slope(F.col(lag), F.col(x)).alias("slope"))
    out = slope.crossJoin(percentile_nearest(df, lag, 0.99).withColumnRenamed(lag, "p99"))  # one row each
    return out.withColumn("healthy", (F.col("slope") <= 0) & (F.col("p99") < limit_s))


def tallies_reconcile(feeds: dict[str, DataFrame]) -> DataFrame:
    """(feed, n, equal): totals, and whether all are equal."""
    out = None
    for name, df in feeds.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("feed"), "n")
        out = one if out is None else out.unionByName(one)
    w = Window.partitionBy()  # a row for each feed
    return out.withColumn("equal", F.min("n").over(w) == F.max("n").over(w))


def payload_sizes(df: DataFrame, payload: str, limit: int = 65536) -> DataFrame:
    size = df.select(F.octet_length(payload).alias("bytes"))
    top = size.agg(F.max("bytes").alias("largest"), F.count_if(F.col("bytes") > limit).alias("too_large"))
    return top.crossJoin(percentile_nearest(size, "bytes", 0.99).withColumnRenamed("bytes", "p99"))  # one row each


def transition_rates(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """(state, next, n, rate) of steps within a key; the end of a key is a step to ``(end)``."""
    nxt = F.coalesce(F.lead("event_type").over(Window.partitionBy(key).orderBy(*order)), F.lit("(end)"))
    per = df.withColumn("next", nxt).groupBy(F.col("event_type").alias("state"), "next").agg(F.count("*").alias("n"))
    return per.withColumn("rate", F.col("n") / F.sum("n").over(Window.partitionBy("state")))


def session_stats(df: DataFrame) -> DataFrame:
    one = df.groupBy("session_id").agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("types"))
    return one.agg(F.count("*").alias("sessions"), F.avg("n").alias("events"), F.avg("types").alias("types"))


def create_parity(df: DataFrame, cdc: DataFrame, event_type: str) -> DataFrame:
    """Events of a type against CDC creates."""
    a = df.agg(F.count_if(F.col("event_type") == event_type).alias("events"))
    b = cdc.agg(F.count_if(F.col("op") == "c").alias("creates"))
    return a.crossJoin(b).withColumn("equal", F.col("events") == F.col("creates"))  # one row each


def usage(ledger: DataFrame, delivered: DataFrame) -> DataFrame:
    """Events generated and delivered per workspace and UTC day, with totals of either and of all (nulls)."""
    day = F.to_date("occurred_at").alias("day")
    both = ledger.select("workspace_id", day, F.lit(1).alias("g"), F.lit(0).alias("d")).unionByName(delivered.select("workspace_id", day, F.lit(0).alias("g"), F.lit(1).alias("d")))
    return both.cube("workspace_id", "day").agg(F.sum("g").alias("generated"), F.sum("d").alias("delivered"))


def quota_breaches(per: DataFrame, plans: DataFrame) -> DataFrame:
    """Usage rows (workspace_id, day, n) over their plan's limit (workspace_id, day_limit)."""
    return per.join(plans, "workspace_id").where(F.col("n") > F.col("day_limit"))


def estimate(plans: DataFrame) -> DataFrame:
    """Events a backfill will make: actors x visits a day x days x events a session, and the seeds."""
    return plans.withColumn("events", F.ceil(F.col("actors") * F.col("visits") * F.col("days") * F.col("per_session")) + F.col("seeds"))


def freshness_slo(df: DataFrame, lag_s: Column, threshold_s: float = 30, objective: float = 0.99) -> DataFrame:
    """Share of events visible in time, and what is left of the error budget."""
    good = F.avg(F.when(lag_s <= threshold_s, 1.0).otherwise(0.0))
    return df.agg(F.count("*").alias("n"), good.alias("good")).withColumn("budget_left", 1 - (1 - F.col("good")) / (1 - objective))


def slo_burn(df: DataFrame, time: str, good: Column, window: str, objective: float) -> DataFrame:
    """Good and all requests and the burn rate per tumbling window."""
    out = df.groupBy(F.window(F.col(time).cast("timestamp"), window).alias("w")).agg(F.count_if(good).alias("good"), F.count("*").alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "good", "total", ((1 - F.col("good") / F.col("total")) / (1 - objective)).alias("burn"))


def partition_of(key: Column, n: int) -> Column:
    """The partition of a key: the first 28 bits of its MD5 modulo n."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 7), 16, 10).cast("long") % n


def partition_counts(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.groupBy(partition_of(F.col(key), n).alias("partition")).agg(F.count("*").alias("n"))


def negative_stock(df: DataFrame, key: str, order: Sequence[str], change: Column, start: Column) -> DataFrame:
    """Rows at which a running stock is below zero."""
    return with_running(df, [key], order, change, "sum", "_moved").withColumn("stock", start + F.col("_moved")).where("stock < 0").drop("_moved")


def stock_reconcile(final: DataFrame, moves: DataFrame) -> DataFrame:
    """Keys whose final stock (key, seed, stock) isn't seed plus the sum of moves (key, change)."""
    per = moves.groupBy("key").agg(F.sum("change").alias("moved"))
    both = final.join(per, "key", "left").withColumn("expected", F.col("seed") + F.coalesce("moved", F.lit(0)))
    return both.where(F.col("stock") != F.col("expected")).select("key", "stock", "expected")


def table_hash(df: DataFrame, *cols: str) -> DataFrame:
    """A hash of a table's rows in any order: count, xor, and sum modulo 2^60 of row hashes.

    A row's is the first 60 bits of the MD5 of its columns' texts, each with its length, so that engines agree and no two rows read alike.
    """
    texts = [F.when(F.col(c).isNull(), "-").otherwise(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string"))) for c in cols]
    h = F.conv(F.substring(F.md5(F.concat(*texts)), 1, 15), 16, 10).cast("long")
    return df.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), (F.sum(h.cast("decimal(38,0)")) % 2**60).cast("long").alias("s"))


def users(df: DataFrame) -> DataFrame:
    return df.select("actor_id").distinct()


def stats_document(delivered: DataFrame, inj: DataFrame) -> DataFrame:
    """Per stream: total, last sequence number and injections by mode (a map)."""
    a = delivered.groupBy("stream_id").agg(F.count("*").alias("total"), F.max("sequence_no").alias("last_sequence_no"))
    b = inj.groupBy("stream_id", "mode").agg(F.count("*").alias("n")).groupBy("stream_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("mode", "n")))).alias("modes"))
    return a.join(b, "stream_id", "left")


def background_rate(cdc: DataFrame, entities: int, days: int, rate: float, band: float) -> DataFrame:
    """Realized share of entity-days with a background change (no transaction)."""
    real = F.count_if(F.col("tx_id").isNull()) / F.lit(entities * days)
    return cdc.agg(real.alias("realized")).withColumn("ok", F.abs(F.col("realized") - rate) <= band)
