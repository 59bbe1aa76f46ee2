"""Queries of failure injection."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlab.catalog import query
from eventlab.fixtures import env, with_sql
from eventlab.functions import draws as D
from eventlab.operators import checks as K
from eventlab.plans import inject as I
from eventlab.queries.draws import sql_hmac, sql_u
from eventlab.sources import tables as S

SEED = 7
KEY = D.subseed(SEED, "chaos")


def truth(spark, sf):
    text = F.col("value").cast("decimal(18,2)").cast("string")
    return env(spark, sf).withColumn("payload", F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("type"), F.concat(F.lit('"'), "event_type", F.lit('"')), F.lit("value"), F.concat(F.lit('"'), text, F.lit('"'))))


def u(mode, label, *instance):
    return sql_u(f"'{mode}:' || event_id || ':{label}'" + "".join(f" || ':{i}'" for i in instance), KEY)


def labelled(spark, sf, **policy):
    return I.label(truth(spark, sf), policy, SEED, {"purchase": {"region": '"north"'}, "view": {"city": '"word"', "zip": "12345"}})


@query("c2_missing", with_sql(f"SELECT event_id FROM env WHERE {u('missing', 'select')} < 0.1", "env"))
def c2(spark, sf):
    return I.records(labelled(spark, sf, missing={"rate": 0.1}), SEED).select("event_id")


_COPIES = f"SELECT *, CASE WHEN {u('duplicates', 'select')} < 0.2 THEN CASE WHEN c < 0.8 THEN 1 WHEN c < 0.8 + 0.15 THEN 2 ELSE 3 END ELSE 0 END AS k FROM (SELECT *, {u('duplicates', 'copies')} * (0.8 + 0.15 + 0.05) AS c FROM env)"


@query("c3_duplicates", with_sql(f"SELECT event_id, unnest(range(k + 1))::INT AS duplicate_index, value FROM ({_COPIES})", "env"))
def c3(spark, sf):
    return I.delivered(labelled(spark, sf, duplicates={"rate": 0.2})).select("event_id", "duplicate_index", "value")


_KIND = """CASE WHEN path = 'k' THEN CASE floor(q * 4) WHEN 0 THEN '"abc"' WHEN 1 THEN '"\\"' || old || '\\""' WHEN 2 THEN '-' || old ELSE '9007199254740993' END
    WHEN path = 'type' THEN CASE floor(q * 4) WHEN 0 THEN '""' WHEN 1 THEN '"' || substr(old, 2, 1) || '"' WHEN 2 THEN '"Ã©Ã¶Ã±"' ELSE '123' END
    ELSE CASE floor(q * 3) WHEN 0 THEN '"abc"' WHEN 1 THEN replace(old, '.', ',') ELSE '""' END END"""
_OLD = """CASE path WHEN 'k' THEN props->>'k' WHEN 'type' THEN '"' || event_type || '"' ELSE '"' || value::DECIMAL(18,2)::VARCHAR || '"' END"""


@query("c5_corrupted_values", with_sql(f"""SELECT event_id, path, old AS original, {_KIND} AS now FROM (SELECT *, {_OLD} AS old FROM (SELECT *, ['k', 'type', 'value'][floor({u('corrupted_values', 'pick0', 0)} * 3)::INT + 1] AS path,
    {u('corrupted_values', 'kind0', 0)} AS q FROM env WHERE {u('corrupted_values', 'select', 0)} < 0.3))""", "env"))
def c5(spark, sf):
    df = labelled(spark, sf, corrupted_values={"rate": 0.3}).select("event_id", "payload", F.explode("records").alias("r"))
    return df.select("event_id", "r.path", "r.original", F.element_at("payload", F.col("r.path")).alias("now"))


@query("c6_nulls", with_sql(f"""SELECT event_id, a AS first, list_filter(['k', 'type', 'value'], lambda x: x <> a)[floor({u('nulls', 'pick1', 0)} * 2)::INT + 1] AS second, 2 AS n_null
    FROM (SELECT event_id, ['k', 'type', 'value'][floor({u('nulls', 'pick0', 0)} * 3)::INT + 1] AS a FROM env WHERE event_type = 'view' AND {u('nulls', 'select', 0)} < 0.5)""", "env"))
def c6(spark, sf):
    df = labelled(spark, sf, nulls={"rate": 0.5, "fields": 2, "types": ["view"]}).where("size(records) > 0")
    return df.select("event_id", F.col("records")[0]["path"].alias("first"), F.col("records")[1]["path"].alias("second"), F.size(F.filter(F.map_values("payload"), lambda v: v == "null")).alias("n_null"))


@query("c7_schema_drift", with_sql(f"SELECT event_id, CASE event_type WHEN 'purchase' THEN 'region' ELSE 'city,zip' END AS added, CASE event_type WHEN 'purchase' THEN 4 ELSE 5 END AS n FROM env WHERE event_type IN ('purchase', 'view') AND {u('schema_drift', 'select', 0)} < 0.4", "env"))
def c7(spark, sf):
    df = labelled(spark, sf, schema_drift={"rate": 0.4}).where("size(records) > 0")
    return df.select("event_id", F.array_join(F.col("records")[0]["fields_added"], ",").alias("added"), F.size("payload").alias("n"))


_ORDER = sql_hmac("'out_of_order:' || event_id || ':order:0'", KEY)


@query("c9_out_of_order", with_sql(f"""SELECT x.event_id, y.emitted_at FROM (SELECT *, row_number() OVER (PARTITION BY stream_id, t ORDER BY o, sequence_no) AS k FROM sel) x JOIN (SELECT stream_id, t, emitted_at, event_id,
    row_number() OVER (PARTITION BY stream_id, t ORDER BY emitted_at, sequence_no) AS k FROM sel) y USING (stream_id, t, k) WHERE x.event_id <> y.event_id""".replace("FROM sel", f"FROM (SELECT *, date_trunc('day', occurred_at) AS t, {_ORDER} AS o FROM env WHERE {u('out_of_order', 'select', 0)} < 0.5)"), "env"))
def c9(spark, sf):
    return labelled(spark, sf, out_of_order={"rate": 0.5, "window": "1 day"}).where("size(records) > 0").select("event_id", "emitted_at")


_MS = f"floor((60.0 + {u('late_arriving', 'delay', 0)} * 3540.0) * 1000)::BIGINT"


@query("c10_late_arriving", with_sql(f"SELECT event_id, {_MS} AS delay_ms, epoch_us(emitted_at) + {_MS} * 1000 AS due_us FROM env WHERE {u('late_arriving', 'select', 0)} < 0.15", "env"))
def c10(spark, sf):
    df = labelled(spark, sf, late_arriving={"rate": 0.15})
    held = I.late(df).select("event_id", "due_at")
    return I.records(df, SEED).select("event_id", "delay_ms").join(held, "event_id").select("event_id", "delay_ms", F.unix_micros(F.col("due_at").cast("timestamp")).alias("due_us"))


_LATE = f"(SELECT event_id, emitted_at, occurred_at, {_MS} AS ms FROM env WHERE {u('late_arriving', 'select', 0)} < 0.15)"


@query("c11_release_due", with_sql(f"SELECT event_id, epoch_ms(TIMESTAMP '2024-01-16') - epoch_us(emitted_at) // 1000 AS realized_ms FROM {_LATE} WHERE epoch_us(emitted_at) + ms * 1000 <= epoch_us(TIMESTAMP '2024-01-16')", "env"))
def c11(spark, sf):
    held = I.late(labelled(spark, sf, late_arriving={"rate": 0.15}))
    return I.release_due(held, F.lit("2024-01-16").cast("timestamp_ntz")).select("event_id", "realized_ms")


@query("c12_flush", with_sql(f"SELECT event_id, TIMESTAMP '2024-02-01' AS emitted_at, 'emitted' AS outcome FROM {_LATE}", "env"))
def c12(spark, sf):
    return I.flush(I.late(labelled(spark, sf, late_arriving={"rate": 0.15})), F.lit("2024-02-01").cast("timestamp_ntz")).select("event_id", "emitted_at", "outcome")


@query("c13_backfill_reinsert", with_sql(f"SELECT event_id, epoch_us(occurred_at) + coalesce((SELECT ms * 1000 FROM {_LATE} l WHERE l.event_id = env.event_id), 0) AS place_us FROM env", "env"))
def c13(spark, sf):
    df = labelled(spark, sf, late_arriving={"rate": 0.15})
    return I.reinsert_late(I.delivered(df), I.late(df)).select("event_id", F.unix_micros(F.col("place_at").cast("timestamp")).alias("place_us"))


@query("c1_inject_all", with_sql("SELECT mode, true AS some FROM (VALUES ('missing'), ('duplicates'), ('corrupted_values'), ('nulls'), ('schema_drift'), ('out_of_order'), ('late_arriving')) m(mode)", "env"))
def c1(spark, sf):
    policy = {m: {"rate": 0.3} for m in I.MODES} | {"out_of_order": {"rate": 0.5, "window": "2 days"}}
    return I.records(labelled(spark, sf, **policy), SEED).groupBy("mode").agg((F.count("*") > 0).alias("some"))


@query("e1_inject_dedup_grade", with_sql(f"SELECT count(*) FILTER (k > 0) AS events_with_copies, sum(k)::BIGINT AS copies, 0 AS deviations FROM ({_COPIES})", "env"))
def e1(spark, sf):
    """Inject duplicates, remove them, and hold the result against the truth and the records."""
    clean = truth(spark, sf)
    df = I.label(clean, {"duplicates": {"rate": 0.2}}, SEED)
    repaired = K.dedup(I.delivered(df), ["event_id"], ["duplicate_index"])
    wrong = K.reconcile(clean, repaired, None, ("event_type", "value", "occurred_at")).agg(F.count("*").alias("deviations"))
    return I.records(df, SEED).agg(F.count("*").alias("events_with_copies"), F.sum("copies").alias("copies")).crossJoin(wrong)  # one row each


@query("c4_duplicates_gap", with_sql(f"SELECT event_id, i AS duplicate_index, sequence_no + CASE WHEN i > 0 THEN floor({u('duplicates', 'gap').replace(':gap', ':gap:' + chr(39) + ' || i || ' + chr(39))} * 20)::BIGINT + 1 ELSE 0 END AS place FROM (SELECT event_id, sequence_no, unnest(range(k + 1))::INT AS i FROM ({_COPIES}))", "env"))
def c4(spark, sf):
    return I.place_copies(I.delivered(labelled(spark, sf, duplicates={"rate": 0.2})), 20, SEED).select("event_id", "duplicate_index", "place")


_FRAGMENT = {"type": "object", "properties": {"c": {"const": "USD"}, "e": {"enum": ["a", "b", 3]}, "b": {"type": "boolean"}, "i": {"type": "integer", "minimum": 5, "maximum": 9}, "l": {"type": "array", "items": {"type": "string"}}}}


def _v(at):
    return sql_u(f"'schema_drift:' || event_id || ':value{at}'", KEY)


@query("c8_drift_value", with_sql(f"""SELECT event_id, '{{"c":"USD","e":' || (['"a"', '"b"', '3'])[floor({_v('.e')} * 3)::INT + 1] || ',"b":' || CASE WHEN {_v('.b')} < 0.5 THEN 'true' ELSE 'false' END || ',"i":' || (5 + floor({_v('.i')} * 5)::BIGINT)
    || ',"l":["' || substr({sql_hmac("'schema_drift:' || event_id || ':value.l[]'", KEY)}, 1, 8) || '"]}}' AS v FROM env""", "env"))
def c8(spark, sf):
    return env(spark, sf).select("event_id", I.value_for(_FRAGMENT, KEY, F.col("event_id")).alias("v"))


@query("d2_custom_corruption", with_sql(f"SELECT event_id, 'reverse of ' || {_OLD} AS now FROM (SELECT *, ['k', 'type', 'value'][floor({u('corrupted_values', 'pick0', 0)} * 3)::INT + 1] AS path FROM env WHERE {u('corrupted_values', 'select', 0)} < 0.3)", "env"))
def d2(spark, sf):
    df = labelled(spark, sf, corrupted_values={"rate": 0.3, "custom": lambda c: F.concat(F.lit("reverse of "), c)}).where("size(records) > 0")
    return df.select("event_id", F.element_at("payload", F.col("records")[0]["path"]).alias("now"))


@query("c14_selectors", with_sql(f"""SELECT event_id, old AS original, CASE WHEN floor(q * 2) = 0 THEN '"abc"' ELSE '""' END AS now FROM (SELECT event_id, '"' || value::DECIMAL(18,2)::VARCHAR || '"' AS old, {u('corrupted_values', 'kind0', 0)} AS q
    FROM env WHERE event_type IN ('view', 'click') AND {u('corrupted_values', 'select', 0)} < 0.4)""", "env"))
def c14(spark, sf):
    policy = {"rate": 0.4, "types": ["view", "click"], "paths": ["value"], "kinds": ["alpha_string", "empty_string", "truncate"]}
    df = labelled(spark, sf, corrupted_values=policy).select("event_id", "payload", F.explode("records").alias("r"))
    return df.select("event_id", "r.original", F.element_at("payload", F.col("r.path")).alias("now"))


_LABELLED = f"SELECT event_id, i, {sql_u("'nulls:' || event_id || ':select:' || i", KEY)} < 0.3 AS hit FROM (SELECT event_id, unnest(range(k + 1))::INT AS i FROM ({_COPIES}))"


@query("c17_label_instances", with_sql(f"SELECT event_id, i AS duplicate_index, i = 0 AND NOT hit AS canonical, (i > 0)::INT + hit::INT AS n_ids, CASE WHEN hit THEN 'nulls' ELSE '' END AS modes, true AS recorded FROM ({_LABELLED})", "env"))
def c17(spark, sf):
    """The block of each instance, and whether all of its ids are those of injection records."""
    df = S.cut(labelled(spark, sf, duplicates={"rate": 0.2}, nulls={"rate": 0.3}), "labelled")
    out = I.instance_labels(df, SEED).select("event_id", "duplicate_index", "_df.canonical", F.col("_df.injection_ids").alias("ids"), F.array_join("_df.chaos.mode", ",").alias("modes"))
    known = I.records(df, SEED).groupBy("event_id").agg(F.collect_set("injection_id").alias("known"))
    both = out.join(known, "event_id", "left")
    recorded = F.size(F.array_except("ids", F.coalesce("known", F.array().cast("array<string>")))) == 0
    return both.select("event_id", "duplicate_index", "canonical", F.size("ids").alias("n_ids"), "modes", recorded.alias("recorded"))


@query("c16_presets", with_sql(" UNION ALL ".join(f"SELECT '{name}' AS preset, event_id, unnest(range(1 + ({u('duplicates', 'select')} < {rate})::INT))::INT AS duplicate_index FROM env" for name, rate in (("dedup_101", 0.05), ("consumer_group_spice", 0.02))), "env"))
def c16(spark, sf):
    each = [I.delivered(labelled(spark, sf, **I.PRESETS[name])).select(F.lit(name).alias("preset"), "event_id", "duplicate_index") for name in ("dedup_101", "consumer_group_spice")]
    return each[0].unionByName(each[1])
