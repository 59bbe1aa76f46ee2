"""Windows and as-of joins over keys of any size, and joins of points to intervals.

Rows are shuffled once, by key.  A key with more than one of ``HOT`` of all rows is cut into parts by its
first order column, so its rows are many tasks' work; a row for each of its parts ties them together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlab.sources.tables import cut

#: A key is hot if it has more than one of so many rows, so there are at most as many hot keys.
HOT = 256
#: Rows of a part of a hot key, about, and the most parts of one.
PART_ROWS, MOST_PARTS = 1_000_000, 10_000


def _sortable(df: DataFrame, name: str) -> Column | None:
    """The order column as a number; None for other types, by which keys aren't cut."""
    kind = df.schema[name].dataType.simpleString()
    if kind.startswith("timestamp"):
        return F.unix_micros(F.col(name).cast("timestamp"))
    if kind == "date":
        return F.unix_date(name)
    return F.col(name).cast("double") if kind.startswith(("decimal", "double", "float", "int", "bigint", "smallint", "tinyint")) else None


def in_parts(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df``, written, with ``_key`` (the keys as one value, so nulls are like others) and ``_part``: parts of a hot key follow each other in order, other keys are whole."""
    df = cut(df.withColumn("_key", F.struct(*keys) if keys else F.struct(F.lit(0))), "rows")
    by = _sortable(df, order[0])
    part = F.lit(0)
    if by is not None:
        sizes = cut(df.groupBy("_key").agg(F.count("*").alias("_n")), "sizes")
        total = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
        hot = sizes.where(F.col("_n") > max(total / HOT, PART_ROWS / 10))
        if total > PART_ROWS / 10 and not hot.isEmpty():
            most = hot.agg(F.max("_n")).first()[0]
            cuts = min(MOST_PARTS, max(8, -(-most // PART_ROWS)))
            # at most HOT keys, and MOST_PARTS numbers for each
            bounds = df.select("_key", by.alias("_by")).join(F.broadcast(hot.select("_key")), "_key").groupBy("_key").agg(F.percentile_approx("_by", [k / cuts for k in range(1, cuts)], 10 * cuts).alias("_bounds"))
            df = df.join(F.broadcast(cut(bounds, "bounds")), "_key", "left")
            part = F.coalesce(F.size(F.filter("_bounds", lambda b: b < by)), F.lit(0))
            part = F.when(F.col("_bounds").isNull(), 0).otherwise(part)
            return df.withColumn("_part", part).drop("_bounds")
    return df.withColumn("_part", part)


def _dealt(part: DataFrame) -> DataFrame:
    """The one shuffle of all rows; what is grouped by key and part is combined before it moves, and comes to them."""
    return part.repartition("_key", "_part")


def _carried(df: DataFrame, ends: DataFrame) -> DataFrame:
    """The columns of ``ends`` (a row for each key and part) to its rows, which stay where they are."""
    right = ends.withColumnsRenamed({"_key": "_k", "_part": "_p"})
    return df.join(right, (df["_key"] == right["_k"]) & (df["_part"] == right["_p"])).drop("_k", "_p")


def with_lag(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """``name``: ``value`` of the row before, by ``order`` within ``keys``; null for the first."""
    part = in_parts(df, keys, order)
    ends = part.groupBy("_key", "_part").agg(F.max_by(F.struct(value), F.struct(*order)).alias("_last"))
    before = F.lag("_last").over(Window.partitionBy("_key").orderBy("_part"))  # a row for each part
    w = Window.partitionBy("_key", "_part").orderBy(*order)
    own = _dealt(part).withColumn("_nth", F.row_number().over(w)).withColumn("_own", F.lag(value).over(w))
    out = _carried(own, ends.select("_key", "_part", before.alias("_before")))
    return out.withColumn(name, F.when(F.col("_nth") == 1, F.col("_before")[value]).otherwise(F.col("_own"))).drop("_nth", "_own", "_before", "_part", "_key")


def with_running(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, kind: str, name: str) -> DataFrame:
    """``name``: sum or max of ``value`` up to and with the row, by ``order`` within ``keys``, or its last one that isn't null."""
    part = in_parts(df.withColumn("_v", value), keys, order)
    upto = lambda c: F.last(c, ignorenulls=True)
    total = {"sum": F.sum, "max": F.max, "last": lambda c: F.max_by(c, F.when(F.col("_v").isNotNull(), F.struct(*order)))}[kind]
    over = {"sum": F.sum, "max": F.max, "last": upto}[kind]
    ends = part.groupBy("_key", "_part").agg(total("_v").alias("_total"))
    w = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("_key", "_part", over("_total").over(w).alias("_before"))  # a row for each part
    own = over("_v").over(Window.partitionBy("_key", "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = _carried(_dealt(part).withColumn("_own", own), ends)
    both = {"sum": F.col("_own") + F.coalesce("_before", F.lit(0)), "max": F.greatest("_own", "_before"), "last": F.coalesce("_own", "_before")}[kind]
    return out.withColumn(name, both).drop("_v", "_own", "_before", "_part", "_key")


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, values: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """``left`` with ``values`` of the last row of ``right`` of the same keys at or before the left row's time; null if there is none.

    Both sides go into one order by time, and what was last seen is carried along, so neither side is made into lists
    and a key may have any number of rows on both.  Of right rows at one time that with the greatest ``tie`` counts.  Rows of ``left`` without time get nothing.
    """
    ties = [f"_t{i}" for i in range(len(tie))]
    seen = F.struct(*[F.col(v).alias(v) for v in values])
    a = left.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(left_time).alias("_time"), F.lit(1).alias("_side"), *[F.lit(None).cast(right.schema[t].dataType).alias(n) for n, t in zip(ties, tie)], F.struct(*left.columns).alias("_row"))
    b = right.where(F.col(right_time).isNotNull()).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(right_time).alias("_time"), F.lit(0).alias("_side"), *[F.col(t).alias(n) for n, t in zip(ties, tie)], seen.alias("_seen"))
    both = a.unionByName(b, allowMissingColumns=True)
    out = with_running(both, [f"_k{i}" for i in range(len(keys))], ["_time", "_side", *ties], F.col("_seen"), "last", "_found")
    return out.where("_side = 1").select("_row.*", *[F.col(f"_found.{v}").alias(v) for v in values])


def interval_join(points: DataFrame, at: str, intervals: DataFrame, low: str, high: str, width: float) -> DataFrame:
    """Each point with the intervals [low, high) that hold it: an equi-join on steps of ``width``, so an interval comes once for each step it touches and its points are spread over them."""
    step = lambda c: F.floor(F.col(c) / width).cast("long")
    spread = intervals.where(F.col(low) < F.col(high)).withColumn("_step", F.explode(F.sequence(step(low), step(high))))
    both = points.withColumn("_step", step(at)).join(spread, "_step")
    return both.where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("_step")
