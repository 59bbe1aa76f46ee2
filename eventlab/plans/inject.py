"""Failure injection: seven seeded modes over a clean event table, each recorded.

Every decision is a draw keyed by the event's identity, so batches, streams and any
partitioning agree.  ``label`` keeps one row for each instance, with what happened
to it; ``delivered``, ``late`` and ``records`` are views of that table, which a job
should write once.

A policy is a dict of modes: ``{"missing": {"rate": 0.1}, ...}``.  Selectors in a mode
restrict it: ``types`` to some event types, ``paths`` to some leaves (or added fields),
``kinds`` to some corruptions; ``["*"]``, the default, is all of them and an empty list none.
``custom`` in corrupted_values is a function of a column that takes the place of the kinds.  Payloads are maps from a leaf's path to its JSON
text, so a broken type can be held.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlab.functions import draws as D
from eventlab.functions import values as V
from eventlab.sources.tables import cut, spread

MODES = ("missing", "duplicates", "corrupted_values", "nulls", "schema_drift", "out_of_order", "late_arriving")
MOST_FIELDS = 4
#: The six named policies of the exercises.  Delays are in seconds; ``gap`` is for ``place_copies``.
PRESETS = {
    "dedup_101": {"duplicates": {"rate": 0.05, "weights": [1.0], "gap": 0}},
    "late_data_30min": {"late_arriving": {"rate": 0.03, "delay": {"kind": "lognormal", "median": 1800, "p95": 7200}, "max_delay": 86400}},
    "out_of_order_60s": {"out_of_order": {"rate": 0.10, "window": "60 seconds"}},
    "dlq_mix": {"corrupted_values": {"rate": 0.02, "fields": 1}, "nulls": {"rate": 0.02, "fields": 1}},
    "drift_day": {"schema_drift": {"rate": 0.20, "types": ["*"], "paths": ["*"]}},
    "consumer_group_spice": {"duplicates": {"rate": 0.02, "weights": [1.0], "gap": 100}},
}
ANY = ["*"]


def check_policy(policy: Mapping[str, Mapping]) -> None:
    """Raise for unknown modes, rates outside of 0 to 1 and counts of fields outside of 1 to 4."""
    for mode, p in policy.items():
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode}")
        if not 0 <= p.get("rate", 0) <= 1:
            raise ValueError(f"{mode}: the rate is from 0 to 1")
        if not 1 <= p.get("fields", 1) <= MOST_FIELDS:
            raise ValueError(f"{mode}: from 1 to {MOST_FIELDS} fields")


def _hit(key: bytes, mode: str, p: Mapping, *instance: Column) -> Column:
    hit = D.prf_u(key, mode, F.col("event_id"), "select", *instance) < p.get("rate", 0.0)
    return hit & _eligible(F.col("event_type"), p.get("types", ANY))


def _eligible(name: Column, selector: Sequence[str]) -> Column:
    return F.lit(True) if list(selector) == ANY else name.isin(list(selector))


def _record(mode: str, **details: Column) -> Column:
    fields = {"copies": "int", "path": "string", "original": "string", "delay_ms": "bigint", "displaced_from": "bigint", "fields_added": "array<string>"}
    return F.struct(F.lit(mode).alias("mode"), *[(details[f] if f in details else F.lit(None)).cast(t).alias(f) for f, t in fields.items()])


def _settle(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns behind a generator, which the optimizer doesn't merge with what follows: a draw is
    computed once for a row, and expressions don't grow from step to step."""
    names = list(columns)
    made = df.withColumn("_s", F.explode(F.array(F.struct(*[columns[n].alias(n) for n in names]))))
    return made.withColumns({n: F.col("_s")[n] for n in names}).drop("_s")


def _add(df: DataFrame, when: Column, record: Column) -> DataFrame:
    return df.withColumn("_records", F.when(when, F.array_append("_records", record)).otherwise(F.col("_records")))


def _picked(paths: Column, key: bytes, mode: str, j: int, dup: Column) -> Column:
    """The path that draw j picks of an array that no longer has the paths picked before."""
    u = D.prf_u(key, mode, F.col("event_id"), f"pick{j}", dup)
    return F.get(paths, F.floor(u * F.size(paths)).cast("int"))


def _set(path: Column, value: Column) -> Column:
    return F.transform_values("payload", lambda k, v: F.when(k == path, value).otherwise(v))


def _kind_for(text: Column, u: Column, selector: Sequence[str]) -> Column:
    """A selected kind of corruption that is valid for the value's type, by a draw; null if there is none."""
    kinds: dict[str, list[str]] = {}
    for name, types in V.CORRUPTIONS.items():
        for t in types if list(selector) == ANY or name in selector else ():
            kinds.setdefault(t, []).append(name)
    kind = V.infer_type(text)
    out = None
    for t, names in kinds.items():
        pick = F.get(F.lit(names), F.floor(u * len(names)).cast("int"))
        out = F.when(kind == t, pick) if out is None else out.when(kind == t, pick)
    return F.lit(None).cast("string") if out is None else out


def label(df: DataFrame, policy: Mapping[str, Mapping], seed: int, menu: Mapping[str, Mapping[str, str]] | None = None) -> DataFrame:
    """A row for each instance of each event: the event's columns, changed, with duplicate_index, missing, due_at and records.

    ``menu`` has the fields that an event type's next version adds, with JSON texts.
    """
    df = label_content(df, policy, seed, menu)
    if policy.get("out_of_order"):
        df = _disorder(df, policy["out_of_order"], seed)
    return label_late(df, policy, seed).withColumnRenamed("_records", "records")


def label_content(df: DataFrame, policy: Mapping[str, Mapping], seed: int, menu: Mapping[str, Mapping[str, str]] | None = None) -> DataFrame:
    """The part of ``label`` that looks at one row at a time, but for lateness: instances with payload, missing and ``_records``; ``df`` may be a stream."""
    check_policy(policy)
    key = D.subseed(seed, "chaos")
    # draws are dear, and events come from few files or few shards' windows
    df = spread(df, "event_id").withColumn("_records", F.array().cast("array<struct<mode:string,copies:int,path:string,original:string,delay_ms:bigint,displaced_from:bigint,fields_added:array<string>>>"))

    p = policy.get("missing", {})
    df = _settle(df, missing=_hit(key, "missing", p)) if p else df.withColumn("missing", F.lit(False))
    df = _add(df, F.col("missing"), _record("missing"))

    p = policy.get("duplicates", {})
    if p:
        hit = _hit(key, "duplicates", p) & ~F.col("missing")
        k = F.when(hit, D.weighted_choice(D.prf_u(key, "duplicates", F.col("event_id"), "copies"), p.get("weights", [0.8, 0.15, 0.05])) + 1).otherwise(0)
        df = _settle(df, _k=k)
        df = _add(df, F.col("_k") > 0, _record("duplicates", copies=F.col("_k")))
        df = df.withColumn("duplicate_index", F.explode(F.sequence(F.lit(0), F.col("_k")))).drop("_k")
        df = df.withColumn("_records", F.when(F.col("duplicate_index") == 0, F.col("_records")).otherwise(F.slice("_records", 1, 0)))
    else:
        df = df.withColumn("duplicate_index", F.lit(0))
    dup = F.col("duplicate_index")

    df = df.withColumn("_free", F.array_sort(F.map_keys("payload")))
    for mode in ("corrupted_values", "nulls"):
        p = policy.get(mode, {})
        if not p:
            continue
        paths = list(p.get("paths", ANY))
        free = F.col("_free") if paths == ANY else F.filter("_free", lambda x: x.isin(paths))
        df = _settle(df, _hit=_hit(key, mode, p, dup) & ~F.col("missing"), _free=F.col("_free"), payload=F.col("payload"), _records=F.col("_records"))
        for j in range(p.get("fields", 1)):
            df = _settle(df, _path=F.when(F.col("_hit"), _picked(free, key, mode, j, dup)))
            df = _settle(df, _old=F.element_at("payload", F.col("_path")))
            if mode == "nulls":
                new = F.lit("null")
            elif "custom" in p:
                new = p["custom"](F.col("_old"))
            else:
                df = _settle(df, _u=D.prf_u(key, mode, F.col("event_id"), f"kind{j}", dup))
                df = _settle(df, _kind=F.coalesce(_kind_for(F.col("_old"), F.col("_u"), p.get("kinds", ANY)), F.lit("none")))
                new = V.corrupt(F.col("_old"), F.col("_kind"))
            df = _settle(df, _new=new)
            change = F.col("_path").isNotNull() & ~F.col("_new").eqNullSafe(F.col("_old"))
            df = _add(df, change, _record(mode, path=F.col("_path"), original=F.col("_old")))
            df = df.withColumn("payload", F.when(change, _set(F.col("_path"), F.col("_new"))).otherwise(F.col("payload")))
            left = F.when(F.col("_path").isNotNull(), F.array_remove("_free", F.coalesce("_path", F.lit("")))).otherwise(F.col("_free"))
            df = _settle(df, _free=left, payload=F.col("payload"), _records=F.col("_records"))

    p = policy.get("schema_drift", {})
    paths = list(p.get("paths", ANY))
    if p and menu:
        menu = {t: {n: v for n, v in fs.items() if paths == ANY or n in paths} for t, fs in menu.items()}
        menu = {t: fs for t, fs in menu.items() if fs}
    if p and menu:
        added = F.create_map(*[x for t, fs in menu.items() for x in (F.lit(t), F.create_map(*[F.lit(y) for kv in fs.items() for y in kv]))])
        df = _settle(df, _added=F.when(_hit(key, "schema_drift", p, dup) & ~F.col("missing"), F.element_at(added, F.col("event_type"))))
        df = _add(df, F.col("_added").isNotNull(), _record("schema_drift", fields_added=F.map_keys("_added")))
        df = df.withColumn("payload", F.when(F.col("_added").isNotNull(), F.map_concat("payload", F.coalesce("_added", F.create_map().cast("map<string,string>")))).otherwise(F.col("payload"))).drop("_added")
    return df.drop("_free", "_hit", "_path", "_old", "_new", "_u", "_kind")


def label_late(df: DataFrame, policy: Mapping[str, Mapping], seed: int) -> DataFrame:
    """Instances with ``due_at``, null for those that aren't held back; ``df`` may be a stream."""
    key = D.subseed(seed, "chaos")
    p = policy.get("late_arriving", {})
    df = df.withColumn("due_at", F.lit(None).cast("timestamp_ntz"))
    if p:
        dup = F.col("duplicate_index")
        hit = _hit(key, "late_arriving", p, dup) & ~F.col("missing")
        kind = p.get("delay", {"kind": "uniform", "min": 60, "max": 3600})
        seconds = D.dist(kind["kind"], D.prf_u(key, "late_arriving", F.col("event_id"), "delay", dup), **{k: v for k, v in kind.items() if k != "kind"})
        if "max_delay" in p:
            seconds = F.least(seconds, F.lit(float(p["max_delay"])))
        df = _settle(df, _ms=F.when(hit, F.floor(seconds * 1000).cast("bigint")))
        df = _add(df, F.col("_ms").isNotNull(), _record("late_arriving", delay_ms=F.col("_ms")))
        df = df.withColumn("due_at", F.when(F.col("_ms").isNotNull(), F.col("emitted_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("_ms").cast("decimal(18,6)") / float(1000 * p.get("speed", 1))))).drop("_ms")
    return df


def drawn(df: DataFrame, p: Mapping, seed: int) -> DataFrame:
    """``df`` with what the order mode asks of each row: ``_sel``, whether it takes part, and ``_order``, its draw."""
    key, dup = D.subseed(seed, "chaos"), F.col("duplicate_index")
    df = _settle(df, _sel=_hit(key, "out_of_order", p, dup) & ~F.col("missing"))
    return df.withColumn("_order", F.when(F.col("_sel"), D.prf_digest(key, "out_of_order", F.col("event_id"), "order", dup)))


def moved(df: DataFrame, when: Column, place: Column, at: Column) -> DataFrame:
    """Rows that change places get their new time, and a record if the place is another one."""
    return _add(df, when, _record("out_of_order", displaced_from=place)).withColumn("emitted_at", F.coalesce(at, F.col("emitted_at")))


def _disorder(df: DataFrame, p: Mapping, seed: int) -> DataFrame:
    """Selected rows of a shard's tumbling window change places: the k-th place goes to the k-th row by draw."""
    df = drawn(df, p, seed)
    df = df.withColumn("_start", F.window(F.col("occurred_at").cast("timestamp"), p.get("window", "1 hour"))["start"])
    df = cut(df, "drawn")  # three read it
    rest, df = df.where("not _sel"), df.where("_sel")  # others are neither sorted nor joined
    w = Window.partitionBy("stream_id", "shard_id", "_start")
    place = F.row_number().over(w.orderBy("emitted_at", "sequence_no", "duplicate_index"))
    drawn_at = F.row_number().over(w.orderBy("_order", "sequence_no", "duplicate_index"))
    df = df.withColumn("_place", place).withColumn("_drawn", drawn_at)
    # in order of places, and of draws, the k-th times meet: the row drawn k-th takes the k-th time
    spots = df.select("stream_id", "shard_id", "_start", F.col("_place").alias("_drawn"), F.col("emitted_at").alias("_new_at"))
    out = df.join(spots, ["stream_id", "shard_id", "_start", "_drawn"], "left")
    out = moved(out, F.col("_place") != F.col("_drawn"), F.col("_place"), F.col("_new_at")).select(*[c for c in rest.columns])
    return out.unionByName(rest).drop("_sel", "_start", "_order")


def delivered(labelled: DataFrame) -> DataFrame:
    """What reaches the feed: neither missing nor held back."""
    return labelled.where(~F.col("missing") & F.col("due_at").isNull()).drop("missing", "due_at", "records")


def late(labelled: DataFrame) -> DataFrame:
    """What is held back, with due_at."""
    return labelled.where(F.col("due_at").isNotNull()).drop("missing", "records")


def _injection_id(key: bytes, mode: Column, path: Column, dup: Column) -> Column:
    digest = D.prf_digest(key, mode, F.col("event_id"), F.concat(F.lit("id"), F.coalesce(path, F.lit(""))), dup)
    return D.uuid7(V.epoch_ms(F.col("occurred_at")), digest)


def instance_labels(labelled: DataFrame, seed: int) -> DataFrame:
    """``labelled`` with the internal block of each instance: canonical, injection_ids and chaos (its records).

    An instance is canonical if no mode touched it.  A copy carries the id of the
    duplicates record that its original has; the original stays canonical.
    """
    key, copy = D.subseed(seed, "chaos"), F.col("duplicate_index") > 0
    touched = F.filter("records", lambda r: r["mode"] != "duplicates")
    ids = F.transform(touched, lambda r: _injection_id(key, r["mode"], r["path"], F.col("duplicate_index")))
    own = F.when(copy, F.array(_injection_id(key, F.lit("duplicates"), F.lit(""), F.lit(0)))).otherwise(F.array().cast("array<string>"))
    block = F.struct((~copy & (F.size(touched) == 0)).alias("canonical"), F.concat(own, ids).alias("injection_ids"), touched.alias("chaos"))
    return labelled.withColumn("_df", block)


def records(labelled: DataFrame, seed: int) -> DataFrame:
    """The injection records, with ids that repeat for a seed."""
    key = D.subseed(seed, "chaos")
    each = labelled.select("event_id", "stream_id", "shard_id", "sequence_no", "occurred_at", "duplicate_index", F.explode("records").alias("_r"))
    return each.select(_injection_id(key, F.col("_r.mode"), F.col("_r.path"), F.col("duplicate_index")).alias("injection_id"), "event_id", "stream_id", "shard_id", "sequence_no", "occurred_at", "duplicate_index", "_r.*")


def release_due(held: DataFrame, now: Column, limit: int | None = None) -> DataFrame:
    """Held rows that are due, the earliest first, delivered at ``now``, with the delay they had."""
    due = held.where(F.col("due_at") <= now)
    if limit is not None:
        due = due.orderBy("due_at", "event_id", "duplicate_index").limit(limit)
    wall = F.unix_millis(now.cast("timestamp")) - F.unix_millis(F.col("emitted_at").cast("timestamp"))
    return due.withColumn("realized_ms", wall).withColumn("emitted_at", now).withColumn("outcome", F.lit("emitted"))


def flush(held: DataFrame, now: Column) -> DataFrame:
    """All held rows, delivered at ``now``."""
    return held.withColumn("emitted_at", now).withColumn("outcome", F.lit("emitted"))


def discard(held: DataFrame) -> DataFrame:
    return held.withColumn("outcome", F.lit("discarded"))


def reinsert_late(feed: DataFrame, held: DataFrame) -> DataFrame:
    """A batch with its held rows in it, each at the first place whose event time reaches its own plus its delay (``place_at``)."""
    a = feed.withColumn("place_at", F.col("occurred_at")).withColumn("held", F.lit(False))
    b = held.withColumn("place_at", F.col("occurred_at") + (F.col("due_at") - F.col("emitted_at"))).withColumn("held", F.lit(True)).drop("due_at")
    return a.unionByName(b)


def place_copies(labelled: DataFrame, most: int, seed: int) -> DataFrame:
    """``place`` for delivery order (with duplicate_index): a copy comes 1 to ``most`` rows after its original, or right after it if ``most`` is 0."""
    gap = F.floor(D.prf_u(D.subseed(seed, "chaos"), "duplicates", F.col("event_id"), "gap", F.col("duplicate_index")) * most) + 1 if most else F.lit(0)
    return labelled.withColumn("place", F.col("sequence_no") + F.when(F.col("duplicate_index") > 0, gap).otherwise(0))


def value_for(fragment: Mapping, key: bytes, *ids: Column, depth: int = 4, at: str = "") -> Column:
    """JSON text of a seeded value that fits a schema fragment."""
    u = D.prf_u(key, "schema_drift", *ids, f"value{at}")
    hexed = D.prf_digest(key, "schema_drift", *ids, f"value{at}")
    quote = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    if "const" in fragment:
        return F.lit(json.dumps(fragment["const"]))
    if "enum" in fragment:
        return F.get(F.lit([json.dumps(v) for v in fragment["enum"]]), F.floor(u * len(fragment["enum"])).cast("int"))
    low, high = fragment.get("minimum", 0), fragment.get("maximum", 100)
    kind = fragment.get("type")
    if kind == "boolean":
        return F.when(u < 0.5, "true").otherwise("false")
    if kind == "integer":
        return (low + F.floor(u * (high - low + 1))).cast("long").cast("string")
    if kind == "number":
        return (low + u * (high - low)).cast("decimal(18,2)").cast("string")
    if kind == "string" and fragment.get("format") == "date-time":
        return quote(F.date_format(F.timestamp_seconds(1704067200 + F.floor(u * 86400 * 30)), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    if kind == "string":
        return quote(F.substring(hexed, 1, 8))
    if kind == "array" and depth > 0:
        return F.concat(F.lit("["), value_for(fragment.get("items", {"type": "string"}), key, *ids, depth=depth - 1, at=at + "[]"), F.lit("]"))
    if kind == "object" and depth > 0:
        parts = [F.concat(F.lit(json.dumps(n) + ":"), value_for(f, key, *ids, depth=depth - 1, at=f"{at}.{n}")) for n, f in fragment.get("properties", {}).items()]
        return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    return F.lit("null")
