"""Replayable pages over an event table, by position: milliseconds, sequence number and, within a page of rows that share both, event_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlab.functions.values import epoch_ms


def _p(time: str = "emitted_at") -> Column:
    return epoch_ms(F.col(time))


def restore_order(df: DataFrame) -> DataFrame:
    """Canonical order."""
    return df.orderBy("shard_id", "sequence_no", "stream_id")


def page(df: DataFrame, p: int, s: int, limit: int, time: str = "emitted_at", partition: str | None = None, e: str | None = None) -> DataFrame:
    """The rows strictly after position (p, s, e), in order, ``limit`` at most.

    Rows that share time and number are in order of event_id, so a page can end between them.  Without ``e`` the position is after
    all of (p, s).  ``partition`` names a date column that the table is laid out by; the position
    then bounds it, so older directories aren't read.
    """
    here = _p(time) == p
    after = (_p(time) > p) | (here & (F.col("sequence_no") > s))
    if e is not None:
        after = after | (here & (F.col("sequence_no") == s) & (F.col("event_id") > e))
    df = df.where(after & (F.col(time) >= F.timestamp_millis(F.lit(p)).cast("timestamp_ntz")))
    if partition:
        df = df.where(F.col(partition) >= F.to_date(F.timestamp_millis(F.lit(p))))
    return df.orderBy(_p(time), "sequence_no", "event_id").limit(limit)


def next_position(rows: DataFrame, p: int, s: int, time: str = "emitted_at", e: str | None = None) -> DataFrame:
    """The last row's position (p, s, e), or the given one if there is none."""
    last = F.max(F.struct(_p(time).alias("p"), F.col("sequence_no").alias("s"), F.col("event_id").alias("e")))
    given = F.struct(F.lit(p).cast("long").alias("p"), F.lit(s).cast("long").alias("s"), F.lit(e).cast("string").alias("e"))
    return rows.agg(last.alias("x")).select(F.coalesce(F.col("x"), given).alias("x")).select("x.*")


def latest(df: DataFrame, time: str = "emitted_at") -> DataFrame:
    return df.agg(F.max(F.struct(_p(time).alias("p"), F.col("sequence_no").alias("s"))).alias("x")).select("x.*")


def earliest(df: DataFrame, time: str = "emitted_at") -> DataFrame:
    """Just before the oldest row."""
    return df.agg(F.min(F.struct(_p(time).alias("p"), F.col("sequence_no").alias("s"))).alias("x")).select("x.p", (F.col("x.s") - 1).alias("s"))


def from_time(df: DataFrame, at: str, time: str = "emitted_at") -> DataFrame:
    """Just before the first row at or after ``at``, else the tail; in one pass."""
    here = F.struct(_p(time).alias("p"), F.col("sequence_no").alias("s"))
    first = F.min(F.when(F.col(time) >= F.lit(at).cast("timestamp_ntz"), here))
    both = df.agg(first.alias("f"), F.max(here).alias("l"))
    return both.select(F.coalesce("f.p", "l.p").alias("p"), F.coalesce(F.col("f.s") - 1, F.col("l.s")).alias("s"))


def expired(positions: DataFrame, now_ms: int, hours: int, floor_ms: int) -> DataFrame:
    """Whether each position (p, s) is below the retention horizon or the oldest partition."""
    return positions.withColumn("expired", (F.col("p") < now_ms - hours * 3_600_000) | (F.col("p") < floor_ms))


def page_injections(inj: DataFrame, after: tuple[str, str] | None, limit: int) -> DataFrame:
    """Newest first after (recorded_at, injection_id); at most 500."""
    if after:
        t = F.lit(after[0]).cast("timestamp_ntz")
        inj = inj.where((F.col("recorded_at") < t) | ((F.col("recorded_at") == t) & (F.col("injection_id") < after[1])))
    return inj.orderBy(F.desc("recorded_at"), F.desc("injection_id")).limit(min(limit, 500))


def page_canonical(ledger: DataFrame, stream: str, after: tuple[int, int], types: list[str], limit: int) -> DataFrame:
    """A page of one stream's truth by (shard, sequence), of some types."""
    df = ledger.where((F.col("stream_id") == stream) & ((F.col("shard_id") > after[0]) | ((F.col("shard_id") == after[0]) & (F.col("sequence_no") > after[1]))))
    if types:
        df = df.where(F.col("event_type").isin(types))
    return df.orderBy("shard_id", "sequence_no").limit(limit)
