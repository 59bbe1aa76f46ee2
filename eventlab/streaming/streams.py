"""Structured Streaming forms of the event operators; each has a batch form it must equal."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from eventlab.operators.checks import scd2
from eventlab.plans.inject import delivered, drawn, label_content, label_late, late
from eventlab.plans.inject import moved as changed_place
from eventlab.plans.inject import records as injection_records
from eventlab.plans.synth import Generator, described, sample_fk, synth
from eventlab.sources.tables import append_idempotent, cut, drop_folder, exists, touched_buckets


#: Rows of a batch of changes up to which its entities are broadcast to find their rows in the log.
FEW = 100_000


def run_available(df: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over what is there and stop; the checkpoint carries a later run on."""
    df.writeStream.format("parquet").outputMode(mode).option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_batches(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    df.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stream_dedup(sdf: DataFrame, time: str, key: Sequence[str], delay: str) -> DataFrame:
    """Drop repeats that come within the watermark."""
    return sdf.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(key))


def windowed_revenue(df: DataFrame, time: str, amount: str, window: str, delay: str | None = None) -> DataFrame:
    """Orders and exact revenue per tumbling window of event time."""
    if delay:
        df = df.withWatermark(time, delay)
    out = df.groupBy(F.window(time, window).alias("w")).agg(F.count("*").alias("n"), F.sum(F.col(amount).cast("decimal(18,2)")).alias("revenue"))
    return out.select(F.col("w.start").alias("start"), "n", "revenue")


def counted_revenue(sdf: DataFrame, time: str, amount: str, window: str, delay: str, admitted: str, late: str, checkpoint: str) -> None:
    """``windowed_revenue`` of a stream as a table of deltas that adds up to it, and how many rows each batch found late.

    A row is late if its window had ended by the watermark (``delay`` behind the latest event) of the batches before.  Each micro-batch adds what it has for its windows to
    ``admitted`` (start, n, revenue) and its late rows to ``late`` (start, n), both under the number of the batch, so admitted and late rows are all there are.
    ``revenue_of`` sums the deltas.  The latest event is kept next to the checkpoint for the last two batches.
    """
    ms = int(pd.Timedelta(delay).total_seconds() * 1_000_000)

    def each(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        top = f"{checkpoint}-top"
        before = spark.read.schema("top long").parquet(f"{top}/{n - 1}").first()[0] if n else None
        edge = F.lit(-(2**62) if before is None else before - ms).cast("long")
        parts = batch.groupBy(F.window(time, window).alias("w")).agg(F.count("*").alias("n"), F.sum(F.col(amount).cast("decimal(18,2)")).alias("revenue"), F.max(F.unix_micros(F.col(time).cast("timestamp"))).alias("last")).persist()
        is_late = F.unix_micros("w.end") <= edge
        parts.where(~is_late).select(F.col("w.start").alias("start"), "n", "revenue").write.mode("overwrite").parquet(f"{admitted}/batch={n}")
        parts.where(is_late).select(F.col("w.start").alias("start"), "n").write.mode("overwrite").parquet(f"{late}/batch={n}")
        parts.agg(F.greatest(F.max("last"), F.lit(before).cast("long")).alias("top")).write.mode("overwrite").parquet(f"{top}/{n}")
        drop_folder(spark, f"{top}/{n - 2}")
        parts.unpersist()

    run_batches(sdf, each, checkpoint)


def revenue_of(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy("start").agg(F.sum("n").alias("n"), F.sum("revenue").alias("revenue"))


def sessions(df: DataFrame, key: str, time: str, gap: str, delay: str | None = None) -> DataFrame:
    """Sessions that end after ``gap`` without an event."""
    if delay:
        df = df.withWatermark(time, delay)
    out = df.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def stream_stats(sdf: DataFrame) -> DataFrame:
    """Running count and last event time per stream and type (update or complete mode)."""
    return sdf.groupBy("stream_id", "event_type").agg(F.count("*").alias("n"), F.max("occurred_at").alias("last_event_at"))


def sliding_rate(sdf: DataFrame, key: str, time: str, seconds: int, delay: str | None = None) -> DataFrame:
    """Events a second in each window of ``seconds`` that begins at a whole second, one decimal."""
    if delay:
        sdf = sdf.withWatermark(time, delay)
    out = sdf.groupBy(key, F.window(time, f"{seconds} seconds", "1 second").alias("w")).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.round(F.col("n") / seconds, 1).alias("rate"))


def late_split(sdf: DataFrame, time: str, delay_s: float, on_time: str, late: str, checkpoint: str) -> None:
    """Each micro-batch in two tables: rows up to ``delay_s`` behind the latest event of the batches before, and later ones.

    The latest event is kept by batch next to the checkpoint, so a run that carries on, or a batch that is done again, finds what it found before.
    """

    def each(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        micros = F.unix_micros(F.col(time).cast("timestamp"))
        before = spark.read.schema("top long").parquet(f"{checkpoint}-top/{n - 1}").first()[0] if n else None
        edge = F.lit(-(2**62) if before is None else before).cast("long") - int(delay_s * 1e6)
        is_late = F.coalesce(micros < edge, F.lit(False))
        append_idempotent(batch.where(~is_late), on_time, ["event_id"])
        append_idempotent(batch.where(is_late), late, ["event_id"])
        batch.agg(F.greatest(F.max(micros), F.lit(before).cast("long")).alias("top")).write.mode("overwrite").parquet(f"{checkpoint}-top/{n}")
        drop_folder(spark, f"{checkpoint}-top/{n - 2}")  # a batch that is done again needs the one before it
        batch.unpersist()

    run_batches(sdf, each, checkpoint)


#: The store that state with lists and timers needs.
ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _texts(values: Sequence[str]) -> pd.Series:
    """Texts as plain objects: columns of pandas' own text type may come in chunks, which Spark doesn't take."""
    return pd.Series(list(values), dtype=object)


#: Rows in one value of a list state, at most.
PACK = 4096


class _Buckets(StatefulProcessor):
    """Rows of a key (..., bucket) kept in a list that is only ever added to, until the watermark has passed the bucket's end.

    A value of the list is a pack of rows, an array for each column: the state's calls cost by value, not by row.
    """

    def __init__(self, columns: str, width_ms: int, finish: Callable[[tuple, pd.DataFrame], pd.DataFrame], empty: pd.DataFrame):
        self.columns, self.width_ms, self.finish, self.empty = columns, width_ms, finish, empty

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.names, types = zip(*(c.split() for c in self.columns.split(", ")))
        self.rows = handle.getListState("rows", ", ".join(f"{n} array<{t}>" for n, t in zip(self.names, types)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = not self.rows.exists()
        for pdf in rows:
            for at in range(0, len(pdf), PACK):
                self.rows.appendValue(tuple(pdf[n].iloc[at : at + PACK].tolist() for n in self.names))
        if fresh:
            self.handle.registerTimer((key[-1] + 1) * self.width_ms)
        yield self.empty

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        columns = zip(*self.rows.get())
        held = pd.DataFrame({n: [v for pack in packs for v in pack] for n, packs in zip(self.names, columns)})
        self.rows.clear()
        yield self.finish(key, held)

    def close(self) -> None:
        pass


def _in_order(key: tuple, held: pd.DataFrame) -> pd.DataFrame:
    held = held.sort_values(["ordinal", "event_id"], kind="stable")
    return pd.DataFrame({"key": _texts([key[0]] * len(held)), "event_id": _texts(held["event_id"]), "order": held["ordinal"].to_numpy(), "bucket": key[-1], "nth": range(1, len(held) + 1)})


def stream_reorder(sdf: DataFrame, key: str, time: str, order: str, hold: str, width: str = "1 minute") -> DataFrame:
    """Rows of a key held until the watermark (``hold`` behind) has passed their bucket of ``width``, then released in order of ``order``: (key, event_id, order, bucket, nth).

    State is a list of rows for each key and bucket: a batch writes its own rows only, and a key of any size is spread over its buckets.
    Rows of a bucket that is out already are late, and Spark drops them.  ``placed`` numbers what was released over all buckets.
    """
    sdf.sparkSession.conf.set(*ROCKS)
    ms = int(pd.Timedelta(width).total_seconds() * 1000)
    # the state API passes values as they are, so its columns are few and typed
    rows = sdf.withWatermark(time, hold).select(F.col(key).cast("string").alias("key"), F.floor(F.unix_millis(F.col(time)) / ms).cast("long").alias("bucket"), F.col("event_id").cast("string").alias("event_id"), F.col(order).cast("long").alias("ordinal"), time)
    empty = pd.DataFrame({"key": _texts([]), "event_id": _texts([]), "order": pd.Series(dtype="int64"), "bucket": pd.Series(dtype="int64"), "nth": pd.Series(dtype="int64")})
    processor = _Buckets("event_id string, ordinal long", ms, _in_order, empty)
    return rows.groupBy("key", "bucket").transformWithStateInPandas(processor, "key string, event_id string, `order` long, bucket long, nth long", "Append", "EventTime")


def placed(released: DataFrame) -> DataFrame:
    """(key, event_id, order, place): the place of each released row in its key, from the rows of buckets before it; one row for each bucket is summed."""
    sizes = released.groupBy("key", "bucket").agg(F.max("nth").alias("_n"))
    before = sizes.select("key", "bucket", (F.sum("_n").over(Window.partitionBy("key").orderBy("bucket")) - F.col("_n")).alias("_before"))
    return released.join(before, ["key", "bucket"]).select("key", "event_id", "order", (F.col("nth") + F.col("_before")).alias("place"))


def _as_held(key: tuple, held: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"event_id": _texts(held["event_id"]), "due_ms": held["due_ms"].to_numpy()})


def stream_hold(sdf: DataFrame, due: str, delay: str, width: str = "1 minute", spread: int = 16) -> DataFrame:
    """Held rows that come out when the watermark of ``due`` has passed their bucket of ``width``: (event_id, due_ms).

    A bucket is spread over ``spread`` lists by event_id, so many rows that are due at once are several tasks' work.
    """
    sdf.sparkSession.conf.set(*ROCKS)
    ms = int(pd.Timedelta(width).total_seconds() * 1000)
    at = F.unix_millis(F.col(due))
    rows = sdf.withWatermark(due, delay).select(F.pmod(F.xxhash64("event_id"), F.lit(spread)).cast("int").alias("part"), F.floor(at / ms).cast("long").alias("bucket"), F.col("event_id").cast("string").alias("event_id"), at.alias("due_ms"), due)
    empty = pd.DataFrame({"event_id": _texts([]), "due_ms": pd.Series(dtype="int64")})
    processor = _Buckets("event_id string, due_ms long", ms, _as_held, empty)
    return rows.groupBy("part", "bucket").transformWithStateInPandas(processor, "event_id string, due_ms long", "Append", "EventTime")


#: Numbers whose ranges are one state of the gap monitor.
BLOCK = 1 << 16


class _Intervals(StatefulProcessor):
    """The numbers of a block of ranges that have come, as intervals within ranges; a batch that changes them tells which gaps opened and closed, and the ranges' ends.

    Calls and frames cost by key, so many small ranges are one key, and their intervals are merged together.
    """

    def __init__(self, width: int = 1 << 62):
        self.width = width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "first array<long>, last array<long>, version long")

    def _gaps_and_ends(self, a: np.ndarray, b: np.ndarray) -> tuple[set, set]:
        """(range, from, to) of each gap within a range and (range, least, largest) of each range."""
        part = (a - 1) // self.width
        same = np.flatnonzero(part[1:] == part[:-1])
        gaps = set(zip(part[same].tolist(), (b[same] + 1).tolist(), (a[same + 1] - 1).tolist()))
        at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(a) else np.zeros(0, np.int64)
        return gaps, set(zip(part[at].tolist(), a[at].tolist(), b[np.r_[at[1:], len(a)] - 1].tolist())) if len(a) else set()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first, last, version = self.seen.get() if self.seen.exists() else ([], [], 0)
        numbers = np.unique(np.concatenate([pdf["sequence_no"].to_numpy(np.int64) for pdf in rows]))
        cuts = np.flatnonzero((np.diff(numbers) > 1) | (np.diff((numbers - 1) // self.width) > 0))
        before = np.array(first, np.int64), np.array(last, np.int64)
        a = np.r_[before[0], numbers[np.r_[0, cuts + 1]]]
        b = np.r_[before[1], numbers[np.r_[cuts, len(numbers) - 1]]]
        by = np.argsort(a, kind="stable")
        a, upto = a[by], np.maximum.accumulate(b[by])
        new = np.r_[True, (a[1:] > upto[:-1] + 1) | (np.diff((a - 1) // self.width) > 0)]
        a, b = a[new], upto[np.r_[np.flatnonzero(new)[1:] - 1, len(upto) - 1]]
        (old, old_ends), (now, ends) = self._gaps_and_ends(*before), self._gaps_and_ends(a, b)
        out = [("close", *g) for g in sorted(old - now)] + [("open", *g) for g in sorted(now - old)] + [("ends", *e) for e in sorted(ends - old_ends)]
        if out:
            self.seen.update((a.tolist(), b.tolist(), version + 1))
        n = len(out)
        yield pd.DataFrame({"stream_id": _texts([key[0]] * n), "shard_id": [key[1]] * n, "part": [o[1] for o in out], "version": [version + 1] * n, "kind": _texts([o[0] for o in out]), "gap_from": [o[2] for o in out], "gap_to": [o[3] for o in out]})

    def close(self) -> None:
        pass


def gap_monitor(sdf: DataFrame, width: int = 10_000) -> DataFrame:
    """What happens to the gaps of each (stream, shard), in ranges of ``width`` numbers: rows (stream_id, shard_id, part, version, kind, gap_from, gap_to).

    ``kind`` is open or close for a gap between numbers of the range, or ends for its least and largest number.  A number that comes late
    closes its gap and opens what is left on its sides; repeats say nothing.  A range's state is its intervals, one where none lack; ranges of ``BLOCK`` numbers are kept together.
    ``open_gaps`` has the gaps of the moment.
    """
    sdf.sparkSession.conf.set(*ROCKS)
    block = F.floor((F.col("sequence_no") - 1) / (max(1, BLOCK // width) * width)).cast("long")
    rows = sdf.where("sequence_no is not null").select(F.col("stream_id").cast("string"), F.col("shard_id").cast("long"), block.alias("block"), F.col("sequence_no").cast("long"))
    return rows.groupBy("stream_id", "shard_id", "block").transformWithStateInPandas(_Intervals(width), "stream_id string, shard_id long, part long, version long, kind string, gap_from long, gap_to long", "Append", "None")


def open_gaps(changes: DataFrame) -> DataFrame:
    """(stream_id, shard_id, gap_from, gap_to): the gaps that ``gap_monitor``'s rows leave open, from 1 on; ranges are tied by one row each."""
    keys = ["stream_id", "shard_id"]
    inside = changes.where("kind <> 'ends'").groupBy(*keys, "gap_from", "gap_to").agg(F.sum(F.expr("if(kind = 'open', 1, -1)")).alias("n")).where("n > 0").drop("n")
    ends = changes.where("kind = 'ends'").groupBy(*keys, "part").agg(F.max_by(F.struct("gap_from", "gap_to"), "version").alias("e"))
    before = F.coalesce(F.lag("e.gap_to").over(Window.partitionBy(*keys).orderBy("part")), F.lit(0))
    between = ends.select(*keys, (before + 1).alias("gap_from"), (F.col("e.gap_from") - 1).alias("gap_to")).where("gap_from <= gap_to")
    return inside.unionByName(between)


def _in_places(key: tuple, held: pd.DataFrame) -> pd.DataFrame:
    """The rows of a window change places: the row drawn k-th takes the k-th time."""
    by_place = held.sort_values(["at_us", "sequence_no", "duplicate_index"], kind="stable")
    place = pd.Series(range(1, len(held) + 1), index=by_place.index)
    by_draw = held.sort_values(["draw", "sequence_no", "duplicate_index"], kind="stable")
    spot = place.loc[by_draw.index].to_numpy()
    return pd.DataFrame({"row": _texts(by_draw["row"]), "place": spot, "moved": spot != range(1, len(held) + 1), "new_us": by_place["at_us"].to_numpy()})


#: Texts of rows that wait in a state keep their microseconds.
_EXACT = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def label_stream(sdf: DataFrame, policy: Mapping[str, Mapping], seed: int, delay: str, menu: Mapping[str, Mapping[str, str]] | None = None) -> DataFrame:
    """As ``label``, on a stream of events in order of ``occurred_at`` up to ``delay``: each instance comes once, labelled with all seven modes.

    Only rows that the order mode selects wait, for the watermark to pass their window; a window's rows are one list of the state.  Those that come
    after it are late, and Spark drops them.
    """
    rows = label_content(sdf, policy, seed, menu)
    p = policy.get("out_of_order")
    if p:
        sdf.sparkSession.conf.set(*ROCKS)
        ms = int(pd.Timedelta(p.get("window", "1 hour")).total_seconds() * 1000)
        rows = drawn(rows, p, seed)
        plain = rows.where("not _sel").drop("_sel", "_order")
        at = F.col("occurred_at").cast("timestamp")
        held = rows.where("_sel").withColumn("_time", at).withWatermark("_time", delay)
        packed = F.to_json(F.struct(*plain.columns), _EXACT)
        held = held.select(
            F.col("stream_id").cast("string").alias("stream_id"), F.col("shard_id").cast("long").alias("shard_id"), F.floor(F.unix_millis("_time") / ms).cast("long").alias("bucket"), packed.alias("row"),
            F.unix_micros(F.col("emitted_at").cast("timestamp")).alias("at_us"), F.col("sequence_no").cast("long").alias("sequence_no"), F.col("duplicate_index").cast("long").alias("duplicate_index"), F.col("_order").cast("string").alias("draw"), "_time",
        )
        empty = pd.DataFrame({"row": _texts([]), "place": pd.Series(dtype="int64"), "moved": pd.Series(dtype=bool), "new_us": pd.Series(dtype="int64")})
        processor = _Buckets("row string, at_us long, sequence_no long, duplicate_index long, draw string", ms, _in_places, empty)
        out = held.groupBy("stream_id", "shard_id", "bucket").transformWithStateInPandas(processor, "row string, place long, moved boolean, new_us long", "Append", "EventTime")
        out = out.select(F.from_json("row", plain.schema, _EXACT).alias("r"), "place", "moved", "new_us").select("r.*", "place", "moved", "new_us")
        out = changed_place(out, F.col("moved"), F.col("place"), F.timestamp_micros("new_us").cast("timestamp_ntz")).drop("place", "moved", "new_us")
        rows = plain.unionByName(out)
    return label_late(rows, policy, seed).withColumnRenamed("_records", "records")


def commit_batch(tables: Mapping[str, DataFrame], root: str, n: int) -> None:
    """The tables of batch ``n``, all or none of them: each is written to a folder of the batch, replacing what an earlier try left, then the batch is noted in ``commits``."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}/batch={n}")
    spark = next(iter(tables.values())).sparkSession
    spark.range(n, n + 1).select(F.col("id").alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{root}/commits/batch={n}")


def committed(spark: SparkSession, root: str, name: str, schema: StructType) -> DataFrame:
    """The rows of a table's committed batches."""
    done = spark.read.schema("n long, batch long").parquet(f"{root}/commits").select("batch")
    return spark.read.schema(StructType([*schema, StructField("batch", LongType())])).parquet(f"{root}/{name}").join(done, "batch", "left_semi").drop("batch")


def inject_stream(sdf: DataFrame, policy: Mapping[str, Mapping], seed: int, delay: str, root: str, checkpoint: str, menu: Mapping[str, Mapping[str, str]] | None = None) -> dict[str, DataFrame]:
    """All seven modes on a stream, to tables below ``root`` that grow by whole batches: what is delivered, what is held back and the injection records."""
    labelled = label_stream(sdf, policy, seed, delay, menu)
    parts = {"delivered": delivered, "late": late, "records": lambda df: injection_records(df, seed)}

    def each(batch: DataFrame, n: int) -> None:
        batch = batch.persist()  # each part reads it once more
        commit_batch({name: f(batch) for name, f in parts.items()}, root, n)
        batch.unpersist()

    run_batches(labelled, each, checkpoint)
    return {name: committed(sdf.sparkSession, root, name, f(labelled).schema) for name, f in parts.items()}


def two_sinks(sdf: DataFrame, split: Callable[[DataFrame], Sequence[tuple[DataFrame, str, Sequence[str]]]], checkpoint: str) -> None:
    """Each micro-batch split into tables (rows, path, keys) that are appended to once."""

    def each(batch: DataFrame, n: int) -> None:
        for rows, path, keys in split(batch):
            append_idempotent(rows, path, keys)

    run_batches(sdf, each, checkpoint)


def overdue(df: DataFrame, key: str, time: str, open_type: str, close_types: Sequence[str], limit_s: int, now) -> DataFrame:
    """Open events without a closing one of the same key within ``limit_s``, where that time is over by ``now``."""
    a = df.where(F.col("event_type") == open_type).select(key, F.col("event_id"), F.unix_micros(F.col(time).cast("timestamp")).alias("_a"))
    b = df.where(F.col("event_type").isin(list(close_types))).select(F.col(key).alias("_k"), F.unix_micros(F.col(time).cast("timestamp")).alias("_b"))
    due = a.where(F.col("_a") + limit_s * 1_000_000 <= F.unix_micros(now.cast("timestamp")))
    return due.join(b, (F.col(key) == F.col("_k")) & (F.col("_b") > F.col("_a")) & (F.col("_b") <= F.col("_a") + limit_s * 1_000_000), "left_anti").select(key, "event_id")


def overdue_stream(sdf: DataFrame, key: str, time: str, open_type: str, close_types: Sequence[str], limit_s: int, delay: str) -> DataFrame:
    """As ``overdue``, on a stream: an open event comes out once the watermark (``delay`` behind) has passed its limit without a closing one."""
    rows = sdf.withWatermark(time, delay)
    a = rows.where(F.col("event_type") == open_type).select(key, "event_id", F.col(time).alias("_a"))
    b = rows.where(F.col("event_type").isin(list(close_types))).select(F.col(key).alias("_k"), F.col(time).alias("_b"))
    span = F.expr(f"interval {int(limit_s)} seconds")
    both = a.join(b, (F.col(key) == F.col("_k")) & (F.col("_b") > F.col("_a")) & (F.col("_b") <= F.col("_a") + span), "left_outer")
    return both.where("_k is null").select(key, "event_id")


def scd2_stream(sdf: DataFrame, log: str, history: str, checkpoint: str, buckets: int = 64) -> None:
    """Maintain the history of a CDC stream as deltas: the log of versions, each once, and at ``history`` the rows of ``scd2`` that a batch makes or changes.

    A batch writes its own versions and, for each, at most the row before it, which it ends; it reads the log's rows of
    the buckets of its entities.  A batch that is done again writes the same.  ``history_of`` has the rows in force, ``compact_history`` makes one delta of all.
    """

    def each(batch: DataFrame, n: int) -> None:
        spark, columns = batch.sparkSession, batch.columns
        batch = batch.withColumn("_bucket", F.pmod(F.xxhash64("entity_key"), F.lit(buckets)).cast("int"))
        touched = {r["_bucket"]: r["count"] for r in batch.groupBy("_bucket").count().collect()}
        if not touched:
            return
        rows = batch.withColumn("_new", F.lit(True))
        if exists(spark, log):
            before = spark.read.schema(StructType([*batch.schema, StructField("batch", LongType())])).parquet(log).where((F.col("batch") != n) & F.col("_bucket").isin(sorted(touched)))
            if sum(touched.values()) <= FEW:  # else most entities of the buckets are in the batch; others come to nothing below
                before = before.join(F.broadcast(batch.select("entity_key").distinct()), "entity_key", "left_semi")
            rows = before.select(*batch.columns, F.lit(False).alias("_new")).unionByName(rows)
        # an entity's rows meet once: repeats go, of those in the log what the batch brings, and each row finds the next
        by, version = Window.partitionBy("entity_key"), Window.partitionBy("entity_key", "entity_version")
        rows = rows.repartition("entity_key").withColumn("_nth", F.row_number().over(version.orderBy("_new", F.xxhash64(*columns)))).where("_nth = 1").drop("_nth")
        ends = F.coalesce(F.lead("_new").over(by.orderBy("entity_version")), F.lit(False))
        changed = cut(scd2(rows).withColumn("_ends", ends).where("_new or _ends"), "versions")
        changed.where("_new").select(*batch.columns).repartition("_bucket").sortWithinPartitions("_bucket").write.mode("overwrite").parquet(f"{log}/batch={n}")
        changed.drop("_new", "_ends", "_bucket").write.mode("overwrite").parquet(f"{history}/batch={n}")

    run_batches(sdf, each, checkpoint)


def history_of(deltas: DataFrame) -> DataFrame:
    """The rows in force: of each version the one of the latest batch."""
    keys, columns = ["entity_key", "entity_version"], [c for c in deltas.columns if c != "batch"]
    last = deltas.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in columns if c not in keys]), "batch").alias("_r"))
    return last.select(*[F.col(c if c in keys else f"_r.{c}").alias(c) for c in columns])


def compact_history(spark: SparkSession, history: str, target: str) -> None:
    """The deltas at ``history`` as one at ``target``, under the number of the latest batch, so that later ones can follow it there."""
    deltas = spark.read.parquet(history)
    last = deltas.agg(F.max("batch")).first()[0]
    history_of(deltas).write.mode("overwrite").parquet(f"{target}/batch={last}")


def rate_stream(spark: SparkSession, rows_per_batch: int) -> DataFrame:
    """A live source of numbered rows at a target rate."""
    return spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rows_per_batch).option("advanceMillisPerBatch", 1000).load()


def synth_stream(spark: SparkSession, rows_per_batch: int, columns: Mapping[str, Generator], table: str, seed: int) -> DataFrame:
    """A live source of synthetic rows: row k has the values that ``synth_table`` gives it."""
    live = rate_stream(spark, rows_per_batch).withColumnRenamed("value", "row")
    return synth(live, F.col("row"), columns, table, seed)


def live_events(spark: SparkSession, per_second: int, types: Mapping[str, float], actors: DataFrame, actor_order: str, actor_key: str, seed: int, start: str) -> DataFrame:
    """A live source of events: ``per_second`` rows a batch, a second of event time each from ``start`` on, bound to drawn actors of a table.

    Columns are row, actor, event_type, event_id, occurred_at, shard_id and sequence_no.  Row k has the type and actor that ``synth_events`` gives row k, and rows are
    numbered without gaps, across restarts too.  The actors are numbered once, when the stream is declared; without any actor there are no events.
    """
    at = F.timestamp_micros((F.unix_micros(F.lit(start).cast("timestamp")) + F.floor(F.col("row") * 1_000_000 / per_second)).cast("long")).cast("timestamp_ntz")
    live = rate_stream(spark, per_second).select(F.col("value").alias("row")).withColumn("_time", at)
    bound = sample_fk(live, F.col("row"), actors, actor_order, actor_key, "actors", seed).withColumnRenamed("fk", "actor")
    return described(bound, F.col("row"), types, "_time", seed).drop("_time").withColumn("shard_id", F.lit(0)).withColumn("sequence_no", F.col("row") + 1)
