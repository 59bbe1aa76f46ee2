"""Checks that report what breaks a rule: references, causes, sequences, histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlab.operators.ranges import as_of, with_lag, with_running


def fk_match(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """One row: children, those whose parent exists, and the percentage."""
    keys = parent.select(F.col(parent_key).alias("_k")).distinct()
    both = child.join(keys, F.col(child_key) == F.col("_k"), "left")
    return both.agg(F.count("*").alias("n"), F.count("_k").alias("matched")).withColumn("pct", F.when(F.col("n") > 0, F.round(100.0 * F.col("matched") / F.col("n"), 4)))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, cond: Column | None = None) -> DataFrame:
    """Children without a parent that meets ``cond``."""
    p = parent if cond is None else parent.where(cond)
    return child.join(p.select(F.col(parent_key).alias("_k")), F.col(child_key) == F.col("_k"), "left_anti")


def requires_prior(df: DataFrame, child_types: Sequence[str], parent_types: Sequence[str], key: str, order: str) -> DataFrame:
    """Child events that don't follow a parent event of the same key."""
    first = df.where(F.col("event_type").isin(list(parent_types))).groupBy(key).agg(F.min(order).alias("first_parent"))
    late = F.col("first_parent").isNull() | (F.col("first_parent") >= F.col(order))
    return df.where(F.col("event_type").isin(list(child_types))).join(first, key, "left").where(late)


def consistent_attribute(child: DataFrame, parent: DataFrame, on: str, attr: str) -> DataFrame:
    """Children whose attribute differs from their parent's."""
    p = parent.select(on, F.col(attr).alias("_expected"))
    return child.join(p, on).where(~F.col(attr).eqNullSafe(F.col("_expected")))


def introductions(*sources: DataFrame) -> DataFrame:
    """Earliest (entity_type, entity_key, introduced_at) over all sources of introductions."""
    every = sources[0]
    for s in sources[1:]:
        every = every.unionByName(s)
    return every.groupBy("entity_type", "entity_key").agg(F.min("introduced_at").alias("introduced_at"))


def unresolved_refs(refs: DataFrame, intro: DataFrame) -> DataFrame:
    """References (event_id, entity_type, entity_key, occurred_at) to what was never introduced, or only later."""
    both = refs.join(intro, ["entity_type", "entity_key"], "left")
    problem = F.when(F.col("introduced_at").isNull(), "missing").when(F.col("introduced_at") > F.col("occurred_at"), "forward")
    return both.withColumn("problem", problem).where("problem is not null")


def causality_violations(df: DataFrame) -> DataFrame:
    """(event_id, problem) of events whose cause is unknown, not earlier, or of another correlation."""
    cause = df.select(F.col("event_id").alias("_c"), F.col("sequence_no").alias("_seq"), F.col("correlation_id").alias("_corr"))
    both = df.where("causation_id is not null").join(cause, F.col("causation_id") == F.col("_c"), "left")
    problem = F.when(F.col("_c").isNull(), "unresolved").when(F.col("_seq") >= F.col("sequence_no"), "not earlier").when(F.col("_corr") != F.col("correlation_id"), "correlation")
    return both.select("event_id", problem.alias("problem")).where("problem is not null")


def latencies(df: DataFrame, parent: str, child: str, key: str, time: str) -> DataFrame:
    """(key, seconds) from the first parent event to the first child event after it."""
    first = F.min(F.when(F.col("event_type") == parent, F.col(time))).over(Window.partitionBy(key))
    found = df.where(F.col("event_type").isin(parent, child)).withColumn("_first", first)
    after = found.where((F.col("event_type") == child) & (F.col(time) > F.col("_first")))
    nxt = after.groupBy(key, "_first").agg(F.min(time).alias("_next"))
    micros = F.unix_micros(F.col("_next").cast("timestamp")) - F.unix_micros(F.col("_first").cast("timestamp"))
    return nxt.select(key, (micros / 1e6).alias("seconds"))


def reconcile(ledger: DataFrame, delivered: DataFrame, late: DataFrame | None, content: Sequence[str]) -> DataFrame:
    """(event_id, problem) for events that are missing, unknown, repeated or changed in what was delivered and is held back."""
    out = delivered if late is None else delivered.unionByName(late)
    digest = F.xxhash64(*content)
    truth = ledger.select(F.col("event_id"), digest.alias("_truth"))
    seen = out.groupBy("event_id").agg(F.count("*").alias("_n"), F.min(digest).alias("_lo"), F.max(digest).alias("_hi"))
    both = truth.join(seen, "event_id", "full_outer")
    problems = F.array(
        F.when(F.col("_n").isNull(), F.lit("missing")),
        F.when(F.col("_truth").isNull(), F.lit("unknown")),
        F.when(F.col("_n") > 1, F.lit("repeated")),
        F.when((F.col("_lo") != F.col("_truth")) | (F.col("_hi") != F.col("_truth")), F.lit("changed")),
    )
    return both.select("event_id", F.explode(F.array_compact(problems)).alias("problem"))


def grade(deviations: DataFrame, inj: DataFrame) -> DataFrame:
    """Per mode: deviations with a record, those without, and records without a deviation; both sides are (mode, event_id)."""
    d = deviations.select("mode", "event_id").distinct().withColumn("_d", F.lit(1))
    i = inj.select("mode", "event_id").distinct().withColumn("_i", F.lit(1))
    both = d.join(i, ["mode", "event_id"], "full_outer")
    return both.groupBy("mode").agg(
        F.count_if(F.col("_d").isNotNull() & F.col("_i").isNotNull()).alias("matched"),
        F.count_if(F.col("_i").isNull()).alias("unexplained"),
        F.count_if(F.col("_d").isNull()).alias("unobserved"),
    )


def compare_feeds(a: DataFrame, b: DataFrame, content: Sequence[str]) -> DataFrame:
    """One row: events only in the one, only in the other, and with different content."""
    digest = F.xxhash64(*content)
    x = a.groupBy("event_id").agg(F.min(digest).alias("_a"))
    y = b.groupBy("event_id").agg(F.min(digest).alias("_b"))
    both = x.join(y, "event_id", "full_outer")
    return both.agg(F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"), F.count_if(F.col("_a") != F.col("_b")).alias("different"))


def where_exists(df: DataFrame, related: DataFrame, key: str, related_key: str, cond: Column, negate: bool = False) -> DataFrame:
    """Rows with (or without) a related row that meets ``cond``."""
    r = related.where(cond).select(F.col(related_key).alias("_k"))
    return df.join(r, F.col(key) == F.col("_k"), "left_anti" if negate else "left_semi")


def version_as_of(df: DataFrame, pins: DataFrame, upgrades: DataFrame) -> DataFrame:
    """The version in force at each event: the highest of the subject's upgrades (subject, at, to_version) so far, else its pin.

    Upgrades are carried along in time (``as_of``), so a subject may have any number of them.  An event whose subject has no pin has none.
    """
    reached = with_running(upgrades.select("subject", "at", "to_version"), ["subject"], ["at", "to_version"], F.col("to_version"), "max", "_reached")
    known = as_of(df, reached, ["subject"], "occurred_at", "at", ["_reached"], ["to_version"]).join(pins, "subject", "left")
    return known.withColumn("version", F.greatest(F.coalesce("_reached", "pin"), F.col("pin"))).drop("_reached")


def cdc_cause_violations(cdc: DataFrame, events: DataFrame) -> DataFrame:
    """(change_id, problem) of changes whose cause is unknown, not earlier, or of another time or correlation."""
    cause = events.select(F.col("event_id").alias("_c"), F.col("sequence_no").alias("_seq"), F.col("occurred_at").alias("_at"), F.col("correlation_id").alias("_corr"))
    both = cdc.join(cause, F.col("causation_id") == F.col("_c"), "left")
    problem = F.when(F.col("_c").isNull(), "unresolved").when(F.col("_seq") >= F.col("sequence_no"), "not earlier").when(F.col("_at") != F.col("occurred_at"), "time").when(~F.col("_corr").eqNullSafe(F.col("correlation_id")), "correlation")
    return both.select("change_id", problem.alias("problem")).where("problem is not null")


def with_drift_menu(df: DataFrame, menu: DataFrame) -> DataFrame:
    """The fields that the next version of each event's subject adds (subject, added); null where there is none."""
    return df.join(menu, "subject", "left")


def snapshot_violations(cdc: DataFrame) -> DataFrame:
    """(entity_key, entity_version, problem) of read rows that repeat, or that have a before image."""
    nth = F.row_number().over(Window.partitionBy("entity_key").orderBy("entity_version"))
    reads = cdc.where("op = 'r'").withColumn("_nth", nth)
    problem = F.when(F.col("_nth") > 1, "repeated").when(F.col("before_status").isNotNull(), "before image")
    return reads.select("entity_key", "entity_version", problem.alias("problem")).where("problem is not null")


def root_violations(cdc: DataFrame) -> DataFrame:
    """Background changes (no transaction) that have a cause or an actor, or aren't their own root."""
    root = F.col("causation_id").isNull() & F.col("actor_id").isNull() & F.col("correlation_id").eqNullSafe(F.col("change_id"))
    return cdc.where(F.col("tx_id").isNull() & ~root).select("change_id")


# windows


def scd2(cdc: DataFrame) -> DataFrame:
    """History rows with valid_to and is_current, by gapless version."""
    nxt = F.lead("valid_from").over(Window.partitionBy("entity_key").orderBy("entity_version"))
    return cdc.withColumn("valid_to", nxt).withColumn("is_current", F.col("valid_to").isNull())


def version_gaps(cdc: DataFrame) -> DataFrame:
    """Versions that don't follow the one before by 1."""
    before = F.lag("entity_version").over(Window.partitionBy("entity_key").orderBy("entity_version"))
    return cdc.withColumn("before_version", before).where(F.col("entity_version") - F.col("before_version") != 1)


def image_chain_violations(cdc: DataFrame) -> DataFrame:
    """Updates whose before image isn't the after image of the version before."""
    w = Window.partitionBy("entity_key").orderBy("entity_version")
    last = cdc.withColumn("_s", F.lag("status").over(w)).withColumn("_t", F.lag("total").over(w)).withColumn("_v", F.lag("entity_version").over(w))
    same = F.col("before_status").eqNullSafe(F.col("_s")) & F.col("before_total").eqNullSafe(F.col("_t"))
    return last.where((F.col("_v") == F.col("entity_version") - 1) & ~same).select("entity_key", "entity_version")


def cdc_order_violations(cdc: DataFrame) -> DataFrame:
    """Updates and deletes before the entity's first create or read."""
    first = F.min(F.when(F.col("op").isin("c", "r"), F.col("entity_version"))).over(Window.partitionBy("entity_key"))
    return cdc.withColumn("_first", first).where(F.col("op").isin("u", "d") & (F.col("_first").isNull() | (F.col("_first") > F.col("entity_version")))).drop("_first")


def sequence_gaps(df: DataFrame) -> DataFrame:
    """Missing ranges of sequence_no in each (stream, shard), from 1 on."""
    seen = with_lag(df.select("stream_id", "shard_id", "sequence_no").distinct(), ["stream_id", "shard_id"], ["sequence_no"], "sequence_no", "_b")
    gaps = seen.withColumn("_b", F.coalesce("_b", F.lit(0))).where(F.col("sequence_no") - F.col("_b") > 1)
    return gaps.select("stream_id", "shard_id", (F.col("_b") + 1).alias("gap_from"), (F.col("sequence_no") - 1).alias("gap_to"))


def time_regressions(df: DataFrame) -> DataFrame:
    """Events of an actor that occurred before the one ahead of them in sequence."""
    seen = with_lag(df, ["stream_id", "actor_id"], ["sequence_no", "copy"], "occurred_at", "_ahead")
    return seen.where(F.col("occurred_at") < F.col("_ahead")).drop("_ahead")


def dedup(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first instance of each key by arrival."""
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def duplicate_ids(df: DataFrame) -> DataFrame:
    return df.groupBy("event_id").agg(F.count("*").alias("n")).where("n > 1")


def displaced(df: DataFrame, arrival: str, window: str = "1 hour") -> DataFrame:
    """Events whose place by arrival within a tumbling window of a shard isn't their place in sequence."""
    w = Window.partitionBy("stream_id", "shard_id", F.window(F.col("occurred_at").cast("timestamp"), window)["start"])
    out = df.withColumn("delivered_at", F.row_number().over(w.orderBy(arrival, "sequence_no"))).withColumn("canonical_at", F.row_number().over(w.orderBy("sequence_no")))
    return out.where("delivered_at <> canonical_at")


def assign_sequence(df: DataFrame, keys: Sequence[str], time: str, tie: str, bucket: str = "hour") -> DataFrame:
    """Gapless sequence_no per key in time order, without a key's rows in one task.

    Rows are numbered within (key, bucket of time); the numbers before a bucket are
    a running sum over the counts of buckets.
    """
    b = df.withColumn("_b", F.date_trunc(bucket, time))
    counts = b.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*keys, "_b", before.alias("_before"))
    nth = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(time, tie))
    return b.withColumn("_nth", nth).join(offsets, [*keys, "_b"]).withColumn("sequence_no", F.col("_nth") + F.col("_before")).drop("_b", "_nth", "_before")


def fifo_violations(a: DataFrame, b: DataFrame, key: str, pos_a: str, pos_b: str) -> DataFrame:
    """Events of ``b`` that come after one of their key that ``a`` has later."""
    both = b.select("event_id", key, F.col(pos_b).alias("_pb")).join(a.select("event_id", F.col(pos_a).alias("_pa")), "event_id")
    return with_lag(both, [key], ["_pb", "event_id"], "_pa", "_ahead").where(F.col("_pa") < F.col("_ahead")).select("event_id", key)


def current_state(cdc: DataFrame) -> DataFrame:
    """The latest row of each entity, without those that were deleted; combined before the shuffle."""
    cols = [c for c in cdc.columns if c not in ("entity_key", "entity_version")]
    last = cdc.groupBy("entity_key").agg(F.max_by(F.struct(*cols), "entity_version").alias("_r"), F.max("entity_version").alias("entity_version"))
    return last.select("entity_key", "entity_version", "_r.*").where("op <> 'd'")


def lateness(df: DataFrame, arrival: str, tie: str, keys: Sequence[str]) -> DataFrame:
    """Seconds by which each event is behind the latest one that arrived before or with it."""
    micros = F.unix_micros(F.col("occurred_at").cast("timestamp"))
    return with_running(df, keys, [arrival, tie], micros, "max", "_top").withColumn("late_s", (F.col("_top") - micros) / 1e6).drop("_top")


# sets


def grade_table(got: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: rows too many and rows too few, repeats counted."""
    extra = got.exceptAll(expected).agg(F.count("*").alias("extra"))
    lacking = expected.exceptAll(got).agg(F.count("*").alias("lacking"))
    return extra.crossJoin(lacking)  # one row each


def missing_ids(ledger: DataFrame, delivered: DataFrame, late: DataFrame) -> DataFrame:
    return ledger.select("event_id").subtract(delivered.select("event_id").unionByName(late.select("event_id")))


def grade_ids(submitted: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: true and false positives, misses, precision and recall of a set of ids."""
    s = submitted.select("event_id").distinct().withColumn("_s", F.lit(1))
    t = truth.select("event_id").distinct().withColumn("_t", F.lit(1))
    both = s.join(t, "event_id", "full_outer")
    n = both.agg(F.count_if(F.col("_s").isNotNull() & F.col("_t").isNotNull()).alias("hits"), F.count_if(F.col("_t").isNull()).alias("false_positives"), F.count_if(F.col("_s").isNull()).alias("misses"))
    return n.withColumn("precision", F.try_divide("hits", F.col("hits") + F.col("false_positives"))).withColumn("recall", F.try_divide("hits", F.col("hits") + F.col("misses")))
