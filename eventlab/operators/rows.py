"""Projections, filters and row checks of event tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlab.functions.values import predicate

RESERVED = "_df"


def strip_internal(df: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """Drop internal columns; with ``fields``, fail if one is missing or another is left."""
    out = df.drop(*[c for c in df.columns if c.startswith(RESERVED)])
    if fields is not None and set(out.columns) != set(fields):
        raise ValueError(f"missing {sorted(set(fields) - set(out.columns))}, extra {sorted(set(out.columns) - set(fields))}")
    return out


def scan_reserved(df: DataFrame, col: str) -> DataFrame:
    """Rows whose JSON has a key with the reserved prefix at any depth."""
    return df.where(F.col(col).rlike(rf'"{RESERVED}[^"]*"\s*:'))


def violations(df: DataFrame, rules: dict[str, Column], *ids: str) -> DataFrame:
    """A row (ids, rule) for each rule that isn't true of a row."""
    found = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    return df.select(*ids, F.explode(F.filter(found, lambda r: r.isNotNull())).alias("rule"))


#: Patterns, longest texts, ranges and values of envelope fields (fixed values); null is allowed where OPTIONAL says so.
UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
PATTERNS = {
    "event_id": UUID,
    "workspace_id": UUID,
    "stream_id": UUID,
    "session_id": UUID,
    "correlation_id": UUID,
    "causation_id": UUID,
    "scenario_slug": r"^[a-z][a-z0-9_]*$",
    "manifest_version": r"^\d+\.\d+\.\d+$",
    "event_type": r"^(cdc\.[a-z][a-z0-9_]{0,63}|[a-z][a-z0-9_]{0,63})$",
}
LONGEST = {"scenario_slug": 32, "event_type": 64, "partition_key": 256}
RANGES = {"shard_id": (0, 2**31 - 1), "sequence_no": (1, 2**53 - 1)}
VALUES = {"envelope_version": ("1.0",), "op": ("c", "u", "d", "r")}
OPTIONAL = ("session_id", "causation_id", "actor_id", "op")


def validate_envelopes(df: DataFrame, patterns: dict[str, str] = PATTERNS) -> DataFrame:
    """(event_id, rule) for each broken rule of the envelope.  ``patterns`` replaces those of fields whose ids look otherwise."""
    rules = {f"{c}_pattern": F.col(c).rlike(p) for c, p in (PATTERNS | patterns).items()}
    rules |= {f"{c}_length": F.length(c) <= n for c, n in LONGEST.items()}
    rules |= {f"{c}_range": F.col(c).between(a, b) for c, (a, b) in RANGES.items()}
    rules |= {f"{c}_value": F.col(c).isin(*v) for c, v in VALUES.items()}
    rules = {n: F.col(n.rsplit("_", 1)[0]).isNull() | r if n.rsplit("_", 1)[0] in OPTIONAL else r for n, r in rules.items()}
    refs = F.col("entity_refs")
    rules |= {
        "schema_ref": F.col("schema_ref.subject").isNotNull() & (F.col("schema_ref.version") >= 1),
        "entity_refs": (F.size(refs) >= 1) & F.forall(refs, lambda r: r["entity_type"].isNotNull() & (F.length(r["entity_key"]) <= 64)),
        "payload_object": F.col("payload").startswith("{"),
        "occurred_at": F.col("occurred_at").isNotNull(),
        "emitted_at": F.col("emitted_at") >= F.col("occurred_at"),
    }
    return violations(df, rules, "event_id")


def validate_ops(df: DataFrame) -> DataFrame:
    """CDC rows whose operation or images don't fit: c and r have no before, u both, d no after."""
    before, after = F.col("before_status").isNotNull(), F.col("status").isNotNull()
    ok = F.when(F.col("op").isin("c", "r"), ~before & after).when(F.col("op") == "u", before & after).when(F.col("op") == "d", before & ~after).otherwise(False)
    return violations(df, {"known_op": F.col("op").isin("c", "u", "d", "r"), "images": ok}, "entity_key", "entity_version")


def filter_events(df: DataFrame, types: Sequence[str] = (), entity: tuple[str, str] | None = None) -> DataFrame:
    """Rows of the types (none: all) that refer to the entity (type, key); for batches and streams alike."""
    if types:
        df = df.where(F.col("event_type").isin(list(types)))
    if entity:
        df = df.where(F.exists("entity_refs", lambda r: (r["entity_type"] == entity[0]) & (r["entity_key"] == entity[1])))
    return df


def filter_injections(inj: DataFrame, mode: str | None = None, event_id: str | None = None, start=None, end=None) -> DataFrame:
    """Injection records by mode, event and inclusive time of occurrence."""
    for c, v in (("mode", mode), ("event_id", event_id)):
        if v is not None:
            inj = inj.where(F.col(c) == v)
    if start is not None:
        inj = inj.where(F.col("occurred_at") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        inj = inj.where(F.col("occurred_at") <= F.lit(end).cast("timestamp_ntz"))
    return inj


def audit_log(df: DataFrame, prefix: str | None = None, actor: str | None = None, limit: int = 100) -> DataFrame:
    """The newest entries by action prefix and actor."""
    if prefix is not None:
        df = df.where(F.startswith("action", F.lit(prefix)))
    if actor is not None:
        df = df.where(F.col("actor_id") == actor)
    return df.orderBy(F.desc("happened"), F.desc("entry_id")).limit(limit)


def tenant_scope(df: DataFrame, workspace: str) -> DataFrame:
    return df.where(F.col("workspace_id") == workspace)


def attribution_violations(df: DataFrame, owners: DataFrame) -> DataFrame:
    """Rows whose workspace isn't the owner (stream_id, owner) of their stream."""
    return df.join(owners, "stream_id").where(~F.col("workspace_id").eqNullSafe(F.col("owner")))


def explode_leaves(df: DataFrame, col: str, *ids: str, depth: int = 4) -> DataFrame:
    """(ids, path, value) of each scalar leaf of a JSON object text: nested objects to ``depth`` levels, items of arrays under ``[]``."""
    level = df.select(*ids, F.lit("").alias("_p"), F.col(col).alias("_v"))
    out = None
    for _ in range(depth):
        items = F.when(F.col("_v").rlike(r"^\s*\{"), F.transform(F.map_entries(F.from_json("_v", "map<string,string>")), lambda e: F.struct(F.concat("_p", F.when(F.col("_p") != "", ".").otherwise(""), e["key"]).alias("p"), e["value"].alias("v"))))
        arrays = F.when(F.col("_v").rlike(r"^\s*\["), F.transform(F.from_json("_v", "array<string>"), lambda v: F.struct(F.concat("_p", F.lit("[]")).alias("p"), v.alias("v"))))
        level = level.select(*ids, F.explode(F.coalesce(items, arrays)).alias("_e")).select(*ids, F.col("_e.p").alias("_p"), F.col("_e.v").alias("_v"))
        nested = F.coalesce(F.col("_v").rlike(r"^\s*[\{\[]"), F.lit(False))
        leaves = level.where(~nested).select(*ids, F.col("_p").alias("path"), F.col("_v").alias("value"))
        out = leaves if out is None else out.unionByName(leaves)
        level = level.where(nested)
    return out


def set_leaf(df: DataFrame, path: str, value: Column) -> DataFrame:
    """Replace the leaf at a dotted path of struct columns."""
    top, _, rest = path.partition(".")
    return df.withColumn(top, F.col(top).withField(rest, value) if rest else value)


def where_spec(df: DataFrame, spec: Sequence[tuple[str, str, object]]) -> DataFrame:
    """Rows for which every (column, operation, argument) holds."""
    for col, op, arg in spec:
        df = df.where(predicate(F.col(col), op, arg))
    return df


def stage_cdc(cdc: DataFrame) -> DataFrame:
    """Create, read and update rows as (key, version, valid_from, image)."""
    return cdc.where(F.col("op").isin("r", "c", "u")).select("entity_key", "entity_version", "valid_from", "status", "total")


def build_envelopes(df: DataFrame, subject_prefix: str = "shop") -> DataFrame:
    """Schema reference, entity references, partition key and internal block of plain event rows."""
    return df.withColumns(
        {
            "schema_ref": F.struct(F.concat(F.lit(subject_prefix + "."), "event_type").alias("subject"), F.lit(1).alias("version")),
            "entity_refs": F.array(F.struct(F.lit("users").alias("entity_type"), F.col("actor_id").alias("entity_key")), F.struct(F.lit("items").alias("entity_type"), F.get_json_object("props", "$.k").alias("entity_key"))),
            "partition_key": F.concat_ws(":", "workspace_id", "stream_id", F.lit("users"), "actor_id"),
            "_df": F.struct(F.lit(True).alias("canonical"), F.array().cast("array<string>").alias("injection_ids")),
        }
    )


def mutations_to_cdc(cdc: DataFrame, table: str, connector: str = "eventlab") -> DataFrame:
    """(entity_key, payload): before, after, op, ts_ms and source of each change."""
    ms = F.unix_millis(F.col("valid_from").cast("timestamp"))

    def image(status: str, total: str) -> Column:
        return F.when(F.col(status).isNotNull(), F.struct(F.col(status).alias("status"), F.col(total).alias("total")))

    source = F.struct(F.lit(connector).alias("connector"), F.lit(table).alias("table"), ms.alias("ts_ms"), F.col("entity_version"), F.when(F.col("op") == "r", "true").otherwise("false").alias("snapshot"))
    after = F.when(F.col("op") != "d", image("status", "total"))
    return cdc.select("entity_key", F.struct(image("before_status", "before_total").alias("before"), after.alias("after"), "op", ms.alias("ts_ms"), source.alias("source")).alias("payload"))


def flatten_injections(inj: DataFrame, schema: str) -> DataFrame:
    """The fields of the JSON column ``details`` as columns."""
    return inj.withColumn("_d", F.from_json("details", schema)).select(*[c for c in inj.columns if c != "details"], "_d.*")


#: Facts and the event types and columns they take.
VIEWS = {
    "purchases": ("purchase", {"order_id": "event_id", "user_id": "actor_id", "at": "occurred_at", "amount": "value"}),
    "product_views": ("view", {"event_id": "event_id", "user_id": "actor_id", "at": "occurred_at", "item": "get_json_object(props, '$.k')"}),
    "signups": ("signup", {"user_id": "actor_id", "at": "occurred_at"}),
    "failures": ("error", {"event_id": "event_id", "at": "occurred_at"}),
}


def stage(df: DataFrame, name: str) -> DataFrame:
    """The rows and columns of a fact."""
    event_type, cols = VIEWS[name]
    return df.where(F.col("event_type") == event_type).select(*[F.expr(e).alias(c) for c, e in cols.items()])
