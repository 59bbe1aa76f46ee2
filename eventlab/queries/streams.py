"""Queries of streams over the events table, run over what is there; their SQL is the batch form's."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlab.catalog import query, table
from eventlab.fixtures import cdc, delivered, env, with_sql
from eventlab.operators import rows as R
from eventlab.plans import inject as I
from eventlab.plans import registry as REG
from eventlab.queries.inject import SEED, truth, u
from eventlab.queries.registry import _STEPS, DLQ, _rows, all_docs, upgrades, why
from eventlab.sources import tables as S
from eventlab.streaming import streams as T

#: A last event, far ahead, that moves the watermark past all others; it isn't counted.
END = "2024-06-01"


#: Rows of a file that feeds a stream.
FILE_ROWS = 1_000_000


def written(spark, path, df, files: int | None = None):
    """Append ``df`` in files of about FILE_ROWS rows, or in ``files`` files."""
    df.repartition(files or max(1, -(-df.count() // FILE_ROWS))).write.mode("append").parquet(path)


def feed(spark, df, files: int = 4, order: str = "id"):
    """A stream of ``df`` written in steps, one after the other in order; a batch takes the files of a step.

    Steps have equally many files: a batch that took a part of a step would move the watermark past the rest of it.
    """
    path = S.new_path(spark, "feed")
    df = S.cut(df, "source")
    bounds = df.approxQuantile(order, [k / files for k in range(1, files)], 0.01)
    part = sum((F.when(F.col(order) > x, 1).otherwise(0) for x in bounds), F.lit(0))
    each = max(1, -(-df.count() // (files * FILE_ROWS)))
    for k in range(files):
        written(spark, path, df.where(part == k), each)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", each).parquet(path)


def ltz(df, *cols):
    return df.withColumns({c: F.col(c).cast("timestamp") for c in cols})


def with_end(df, **values):
    """``df`` and one row at the end of time with the given values."""
    sparse = df.sparkSession.range(1).select(*[values[f.name].cast(f.dataType).alias(f.name) if f.name in values else F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema])
    return df.unionByName(sparse)


def collected(spark, sdf, mode="append"):
    sink = S.new_path(spark, "sink")
    T.run_available(sdf, sink, S.new_path(spark, "mark"), mode)
    return spark.read.schema(sdf.schema).parquet(sink)


@query("t1_stream_dedup", with_sql("SELECT event_id FROM env WHERE id % 97 <> 0", "env"))
def t1(spark, sf):
    df = ltz(delivered(spark, sf).select("id", "event_id", "emitted_at"), "emitted_at")
    return collected(spark, T.stream_dedup(feed(spark, df), "emitted_at", ["event_id"], "2 hours")).select("event_id")


@query("t2_tumbling_revenue", with_sql("SELECT date_trunc('hour', occurred_at) AS start, count(*) AS n, sum(value::DECIMAL(18,2))::DOUBLE AS revenue FROM env WHERE event_type = 'purchase' GROUP BY 1", "env"))
def t2(spark, sf):
    df = ltz(env(spark, sf).where("event_type = 'purchase'").select("id", "occurred_at", "value"), "occurred_at")
    df = with_end(df, id=F.lit(2**60), occurred_at=F.lit(END).cast("timestamp"))
    out = collected(spark, T.windowed_revenue(feed(spark, df), "occurred_at", "value", "1 hour", "2 hours")).where(F.col("start") < END)
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "n", F.col("revenue").cast("double").alias("revenue"))


@query("t2b_late_counted", with_sql("""SELECT start, sum(n) FILTER (NOT late)::BIGINT AS admitted, coalesce(sum(n) FILTER (late), 0)::BIGINT AS late FROM (
    SELECT date_trunc('hour', occurred_at) AS start, id % 4 = 0 AND date_trunc('hour', occurred_at) + INTERVAL 1 HOUR <= (SELECT max(occurred_at) FROM env WHERE id % 4 <> 0) - INTERVAL 2 HOUR AS late, count(*) AS n FROM env GROUP BY 1, 2)  GROUP BY 1""", "env"))
def t2b(spark, sf):
    """Every fourth event comes in a second run, when nearly all windows are over: what is counted late and what is admitted are all rows."""
    df = S.cut(ltz(env(spark, sf).select("id", "occurred_at", "value"), "occurred_at"), "source")
    path, a, b, mark = (S.new_path(spark, x) for x in ("feed", "admitted", "late", "mark"))
    for part in ("id % 4 <> 0", "id % 4 = 0"):
        written(spark, path, df.where(part))
        T.counted_revenue(spark.readStream.schema(df.schema).parquet(path), "occurred_at", "value", "1 hour", "2 hours", a, b, mark)
    on_time = T.revenue_of(spark.read.parquet(a)).select("start", F.col("n").alias("admitted"))
    late = spark.read.parquet(b).groupBy("start").agg(F.sum("n").alias("late"))
    both = on_time.join(late, "start", "full_outer")
    return both.select(F.col("start").cast("timestamp_ntz").alias("start"), "admitted", F.coalesce("late", F.lit(0)).alias("late"))


@query("t3_late_split", with_sql("SELECT event_id, id % 3 = 0 AND occurred_at < top - INTERVAL '1' HOUR AS late FROM (SELECT *, max(CASE WHEN id % 3 <> 0 THEN occurred_at END) OVER () AS top FROM env)", "env"))
def t3(spark, sf):
    """Two runs on one checkpoint, as after a restart: every third row comes in the second, where it is judged by the latest of the first and the latest that came before it are all there is."""
    df = S.cut(env(spark, sf).select("id", "event_id", "occurred_at"), "source")
    path, a, b, mark = (S.new_path(spark, x) for x in ("feed", "on-time", "late", "mark"))
    for part in ("id % 3 <> 0", "id % 3 = 0"):
        written(spark, path, df.where(part))
        T.late_split(spark.readStream.schema(df.schema).parquet(path), "occurred_at", 3600, a, b, mark)
    both = spark.read.schema(df.schema)
    return both.parquet(a).withColumn("late", F.lit(False)).unionByName(both.parquet(b).withColumn("late", F.lit(True))).select("event_id", "late")


@query("t4_stream_reorder", with_sql("SELECT stream_id AS key, event_id, sequence_no AS place FROM env", "env"))
def t4(spark, sf):
    df = ltz(env(spark, sf).select("id", "stream_id", "event_id", "sequence_no", "occurred_at"), "occurred_at")
    # rows come up to six minutes late, whatever order the table numbers them in
    df = df.withColumn("arrival", F.unix_micros("occurred_at") + F.col("id") % 7 * 60_000_000)
    ends = df.groupBy("stream_id").agg(F.max("id").alias("id")).select((F.col("id") + 2**50).alias("id"), "stream_id", F.lit("end").alias("event_id"), F.lit(2**50).alias("sequence_no"), F.lit(END).cast("timestamp").alias("occurred_at"), F.lit(2**61).alias("arrival"))
    later = ends.withColumn("occurred_at", F.lit("2024-07-01").cast("timestamp")).withColumn("arrival", F.lit(2**62))
    sdf = feed(spark, df.unionByName(ends).unionByName(later), order="arrival")
    released = collected(spark, T.stream_reorder(sdf, "stream_id", "occurred_at", "sequence_no", "1 hour", "1 hour")).where("event_id <> 'end'")
    return T.placed(released).select("key", "event_id", "place")


@query("t6_stream_stats", with_sql("SELECT stream_id, event_type, count(*) AS n, max(occurred_at) AS last_event_at FROM env GROUP BY 1, 2", "env"))
def t6(spark, sf):
    path = S.new_path(spark, "stats")
    sdf = feed(spark, env(spark, sf).select("id", "stream_id", "event_type", "occurred_at"))
    T.run_batches(T.stream_stats(sdf), lambda batch, n: batch.write.mode("overwrite").parquet(path), S.new_path(spark, "mark"), "complete")
    return spark.read.parquet(path)


@query("t6b_sliding_rate", with_sql("SELECT stream_id, date_trunc('second', occurred_at) - INTERVAL 1 SECOND * k AS start, round(count(*) / 10.0, 1) AS rate FROM env, range(10) r(k) GROUP BY 1, 2", "env"))
def t6b(spark, sf):
    df = ltz(env(spark, sf).select("id", "stream_id", "occurred_at"), "occurred_at")
    df = with_end(df, id=F.lit(2**60), occurred_at=F.lit(END).cast("timestamp"), stream_id=F.lit("end"))
    out = collected(spark, T.sliding_rate(feed(spark, df), "stream_id", "occurred_at", 10, "2 hours")).where("stream_id <> 'end'")
    return out.select("stream_id", F.col("start").cast("timestamp_ntz").alias("start"), "rate")


@query("t7_session_windows", with_sql("SELECT actor_id, min(occurred_at) AS start, count(*) AS n FROM sess GROUP BY actor_id, session_id", "sess"))
def t7(spark, sf):
    df = ltz(env(spark, sf).select("id", "actor_id", "occurred_at"), "occurred_at")
    df = with_end(df, id=F.lit(2**60), occurred_at=F.lit(END).cast("timestamp"), actor_id=F.lit("end"))
    out = collected(spark, T.sessions(feed(spark, df), "actor_id", "occurred_at", "30 minutes", "2 hours")).where("actor_id <> 'end'")
    return out.select("actor_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("t7b_session_windows_batch", with_sql("SELECT actor_id, min(occurred_at) AS start, count(*) AS n FROM sess GROUP BY actor_id, session_id", "sess"))
def t7b(spark, sf):
    return T.sessions(ltz(env(spark, sf), "occurred_at"), "actor_id", "occurred_at", "30 minutes").select("actor_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("t9_stream_filter", with_sql("SELECT event_id FROM env WHERE event_type IN ('view', 'error')", "env"))
def t9(spark, sf):
    return collected(spark, R.filter_events(feed(spark, env(spark, sf).select("id", "event_id", "event_type")), ["view", "error"])).select("event_id")


_GAPS = with_sql("""SELECT stream_id, shard_id::BIGINT AS shard_id, b + 1 AS gap_from, sequence_no - 1 AS gap_to FROM (SELECT *, coalesce(lag(sequence_no) OVER (PARTITION BY stream_id, shard_id ORDER BY sequence_no), 0) AS b
    FROM (SELECT DISTINCT stream_id, shard_id, sequence_no FROM delivered)) WHERE sequence_no - b > 1""", "delivered")


@query("t12_gap_monitor", _GAPS)
def t12(spark, sf):
    return T.open_gaps(S.cut(collected(spark, T.gap_monitor(feed(spark, delivered(spark, sf).select("id", "stream_id", "shard_id", "sequence_no")), 100)), "gaps"))


@query("t12b_late_numbers", _GAPS)
def t12b(spark, sf):
    """Every fifth event comes in the end: the gaps that it left are closed, or split where others lack."""
    df = delivered(spark, sf).select((F.col("id") + F.when(F.col("id") % 5 == 0, 2**40).otherwise(0)).alias("id"), "stream_id", "shard_id", "sequence_no")
    return T.open_gaps(S.cut(collected(spark, T.gap_monitor(feed(spark, df), 100)), "gaps"))


@query("t13_stream_cutover", with_sql(f"SELECT event_id, {_STEPS} AS version, CASE WHEN {_STEPS} >= 3 THEN value END AS city FROM env", "env"))
def t13(spark, sf):
    sdf = feed(spark, env(spark, sf).select("id", "event_id", "stream_id", F.col("event_type").alias("subject"), "occurred_at", "value").withColumn("version", F.lit(1)))
    return collected(spark, REG.apply_cutover(sdf, upgrades(spark, sf), {"city": (3, F.col("value"))})).select("event_id", "version", "city")


@query("t14_resume", with_sql("SELECT event_id FROM env", "env"))
def t14(spark, sf):
    src, sink, mark = (S.new_path(spark, x) for x in ("feed", "sink", "mark"))
    e = env(spark, sf).select("id", "event_id")
    for part in range(3):
        e.where(F.col("id") % 3 == part).write.mode("append").parquet(src)
        T.run_available(spark.readStream.schema(e.schema).parquet(src), sink, mark)
    return spark.read.parquet(sink).select("event_id")


@query("t16_timeout_detect", with_sql("""SELECT actor_id, event_id FROM env a WHERE event_type = 'signup' AND occurred_at + INTERVAL '7' DAY <= TIMESTAMP '2024-02-01'
    AND NOT EXISTS (SELECT 1 FROM env b WHERE b.actor_id = a.actor_id AND b.event_type = 'purchase' AND b.occurred_at > a.occurred_at AND b.occurred_at <= a.occurred_at + INTERVAL '7' DAY)""", "env"))
def t16(spark, sf):
    return T.overdue(env(spark, sf), "actor_id", "occurred_at", "signup", ["purchase"], 7 * 86400, F.lit("2024-02-01"))


@query("t16b_timeout_stream", with_sql("""SELECT actor_id, event_id FROM env a WHERE event_type = 'signup'
    AND NOT EXISTS (SELECT 1 FROM env b WHERE b.actor_id = a.actor_id AND b.event_type = 'purchase' AND b.occurred_at > a.occurred_at AND b.occurred_at <= a.occurred_at + INTERVAL '7' DAY)""", "env"))
def t16b(spark, sf):
    df = ltz(env(spark, sf).where("event_type in ('signup', 'purchase')").select("id", "actor_id", "event_id", "event_type", "occurred_at"), "occurred_at")
    for k, kind in enumerate(("signup", "purchase")):  # both sides' watermarks pass all others
        df = with_end(df, id=F.lit(2**60 + k), occurred_at=F.lit(END).cast("timestamp"), event_type=F.lit(kind), actor_id=F.lit("end"), event_id=F.lit("end"))
    out = collected(spark, T.overdue_stream(feed(spark, df), "actor_id", "occurred_at", "signup", ["purchase"], 7 * 86400, "1 hour"))
    return out.where("actor_id <> 'end'").select("actor_id", "event_id")


@query("t8_stream_inject", with_sql(f"SELECT 'missing' AS mode, count(*) AS n FROM env WHERE {u('missing', 'select')} < 0.1 UNION ALL SELECT 'duplicates', count(*) FROM env WHERE {u('duplicates', 'select')} < 0.1 AND NOT {u('missing', 'select')} < 0.1", "env"))
def t8(spark, sf):
    """Content modes on a stream: deliveries and records in two tables, as the batch form has them."""
    df = truth(spark, sf)
    policy = {"missing": {"rate": 0.1}, "duplicates": {"rate": 0.1}}
    out, rec = S.new_path(spark, "delivered"), S.new_path(spark, "records")

    def split(batch):
        made = S.cut(I.label(batch, policy, SEED), "labelled")
        return [(I.delivered(made).drop("payload"), out, ["event_id", "duplicate_index"]), (I.records(made, SEED), rec, ["injection_id"])]

    T.two_sinks(feed(spark, df), split, S.new_path(spark, "mark"))
    return spark.read.parquet(rec).groupBy("mode").agg(F.count("*").alias("n"))


#: Every mode of the seven, more than once on many events.
_ALL_MODES = {m: {"rate": 0.2} for m in I.MODES} | {"out_of_order": {"rate": 0.4, "window": "6 hours"}}
_MENU = {"purchase": {"region": '"north"'}, "view": {"city": '"word"', "zip": "12345"}}


@query("t8b_stream_all_modes", with_sql("SELECT t AS name, true AS equal, true AS some FROM (VALUES ('delivered'), ('late'), ('records')) x(t)", "env"))
def t8b(spark, sf):
    """All seven modes on a stream against the batch form, row by row: the digests of the three tables are those of its own."""
    df = truth(spark, sf)
    ends = with_end(df.limit(0), id=F.lit(2**60), event_id=F.lit("end"), stream_id=F.lit("end"), occurred_at=F.lit(END).cast("timestamp_ntz"), emitted_at=F.lit(END).cast("timestamp_ntz"), event_type=F.lit("end"), payload=F.create_map(F.lit("k"), F.lit("1")), sequence_no=F.lit(1), shard_id=F.lit(0))
    ends = ends.unionByName(ends.withColumn("id", F.col("id") + 1).withColumn("event_id", F.lit("end2")).withColumn("occurred_at", F.lit("2024-07-01").cast("timestamp_ntz")))
    # the order mode takes the last rows, whose event_ids say so: the watermark is that of the rows it takes
    got = T.inject_stream(feed(spark, df.unionByName(ends)), _ALL_MODES, SEED, "1 day", S.new_path(spark, "injected"), S.new_path(spark, "mark"), _MENU)
    labelled = S.cut(I.label(df, _ALL_MODES, SEED, _MENU), "labelled")
    want = {"delivered": I.delivered(labelled), "late": I.late(labelled), "records": I.records(labelled, SEED)}
    out = None
    for name, batch in want.items():
        cols = sorted(c for c in batch.columns)

        def digest(t):
            return t.where("event_id not like 'end%'").agg(F.count("*").alias("n"), F.sum(F.xxhash64(F.to_json(F.struct(*[F.map_entries(c) if c == "payload" else c for c in cols]))).cast("decimal(38,0)")).alias("h"))

        both = digest(got[name]).unionByName(digest(batch)).agg((F.count_distinct("n", "h") == 1).alias("equal"), (F.min("n") > 0).alias("some")).select(F.lit(name).alias("name"), "equal", "some")
        out = both if out is None else out.unionByName(both)
    return out


@query("t11_stream_scd2", with_sql("SELECT entity_key, entity_version, lead(valid_from) OVER (PARTITION BY entity_key ORDER BY entity_version) AS valid_to FROM cdc", "cdc"))
def t11(spark, sf):
    log, history, c = S.new_path(spark, "log"), S.new_path(spark, "history"), cdc(spark, sf)
    T.scd2_stream(feed(spark, c, order="order_key"), log, history, S.new_path(spark, "mark"))
    return T.history_of(spark.read.parquet(history).select("entity_key", "entity_version", "valid_to", "batch"))


@query("t5_stream_late_buffer", with_sql("SELECT event_id, epoch_us(occurred_at) // 1000 + 60000 * (id % 50) AS due_ms FROM env", "env"))
def t5(spark, sf):
    """Every event is held for up to 49 minutes."""
    df = env(spark, sf).select("id", "event_id", F.expr("timestamp_millis(unix_millis(cast(occurred_at as timestamp)) + 60000 * (id % 50))").alias("due_at"))
    for k in (1, 2):  # two last rows: the first moves the watermark, the second makes the batch in which timers fire
        df = with_end(df, id=F.lit(2**60 + k), due_at=F.lit(f"2024-0{5 + k}-01").cast("timestamp"), event_id=F.lit(f"end{k}"))
    return collected(spark, T.stream_hold(feed(spark, df), "due_at", "1 minute", "1 hour")).where("event_id not like 'end%'")


@query("t10_stream_dlq", DLQ)
def t10(spark, sf):
    df, judged = _rows(spark, sf), REG.judge(REG.schema_rules(all_docs(spark, sf)))
    good, bad = S.new_path(spark, "good"), S.new_path(spark, "bad")

    def split(batch):
        ok, wrong = REG.halves(S.cut(judged(S.spread(batch, "id")), "judged"))
        return [(ok.select("id"), good, ["id"]), (wrong.select("id", "reasons"), bad, ["id"])]

    T.two_sinks(feed(spark, df), split, S.new_path(spark, "mark"))
    return why(spark.read.parquet(good), spark.read.parquet(bad))
