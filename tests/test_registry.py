import json
import re

from pyspark.sql import functions as F

from eventlab.operators.ranges import with_lag, with_running
from eventlab.plans import registry as R


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def fields_of(spark, *docs):
    rows = [(s, v, json.dumps(d, separators=(",", ":"))) for s, v, d in docs]
    df = spark.createDataFrame(rows, "subject string, version int, doc string")
    return df, R.schema_fields(df)


def closed(**props):
    return {"type": "object", "additionalProperties": False, "required": [], "properties": props}


def test_documents_are_read_once(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    docs = part.select(F.concat(F.lit("s"), "p_partkey").alias("subject"), F.lit(1).alias("version"), F.lit('{"properties":{"id":{"type":"integer"}}}').alias("doc"))
    fields = R.schema_fields(docs)
    assert len(re.findall("Relation", plan(fields))) == 1
    rows = part.select(F.col("p_partkey").alias("id"), F.concat(F.lit("s"), "p_partkey").alias("subject"), F.lit(1).alias("version"), F.lit('{"id":1}').alias("payload"))
    for df in R.dlq_split(rows, fields):
        assert len(re.findall("Relation", plan(df))) == 2  # the rows and the documents


def test_compatibility(spark):
    a = closed(x={"type": "string"}, o=closed(p={"type": "integer"}), l={"type": "array", "items": closed(q={"type": "string"})}, gone=closed(deep={"type": "string"}))
    cases = {
        "same": (a, set()),
        "added": (closed(**a["properties"], new={"type": "string"}), set()),
        "nested": (closed(**(a["properties"] | {"o": closed(p={"type": "integer"}, r={"type": "string"}), "l": {"type": "array", "items": closed(q={"type": "string"}, t={"type": "number"})}})), set()),
        "annotated": (closed(**(a["properties"] | {"x": {"title": "an x", "type": "string"}})), set()),
        "changed": (closed(**(a["properties"] | {"x": {"type": "number"}, "o": closed(p={"type": "string"})})), {("x", "C002"), ("o.p", "C002")}),
        "removed": (closed(**{k: v for k, v in a["properties"].items() if k != "gone"}), {("gone", "C001")}),
        "retyped": (closed(**(a["properties"] | {"gone": {"type": "string"}})), {("gone", "C002")}),
        "needed": (a | {"required": ["x"]}, {("x", "C003")}),
        "open": (a | {"additionalProperties": True}, {("", "C004")}),
        "inner": (closed(**(a["properties"] | {"o": closed(p={"type": "integer"}) | {"additionalProperties": True}, "l": {"type": "array", "items": {"type": "object"}}})), {("o", "C004"), ("l[]", "C005")}),
        "list": ({"type": "array"}, {("", "C005")}),
        "words": (closed(**(a["properties"] | {"x": {"type": "string", "anyOf": []}, "_dfa": {"type": "string"}, "Up": {"type": "string"}})), {("x", "C006"), ("_dfa", "C009"), ("Up", "C009")}),
    }
    _, latest = fields_of(spark, *[(k, 1, a) for k in cases])
    docs, new = fields_of(spark, *[(k, 2, c) for k, (c, _) in cases.items()])
    got = {}
    for r in R.compat_errors(latest, new, docs).collect():
        got.setdefault(r.subject, set()).add((r.path, r.code))
    assert got == {k: want for k, (_, want) in cases.items() if want}


def test_windows_by_ranges(spark):
    """One key with most rows, null keys, and equal values, against plain windows."""
    from pyspark.sql import Window

    df = spark.range(3000).select(F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 == 8, F.lit(None)).otherwise(F.col("id").cast("string")).alias("k"), F.col("id"), (F.col("id") * 7919 % 101).alias("v"))
    w = Window.partitionBy("k").orderBy("v", "id")
    want = df.withColumn("l", F.lag("v").over(w)).withColumn("s", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("m", F.max("id").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    got = with_running(with_running(with_lag(df, ["k"], ["v", "id"], "v", "l"), ["k"], ["v", "id"], F.col("v"), "sum", "s"), ["k"], ["v", "id"], F.col("id"), "max", "m")
    assert sorted(map(tuple, got.select("k", "id", "v", "l", "s", "m").collect()), key=lambda r: r[1]) == sorted(map(tuple, want.select("k", "id", "v", "l", "s", "m").collect()), key=lambda r: r[1])


def test_any_depth(spark):
    """Six levels, arrays of arrays, names that look like keywords, braces in texts; too deep raises."""
    doc = {"type": "string"}
    for k in range(6):
        doc = closed(**{f"f{k}": doc, "note": {"type": "string", "pattern": "^[{}]*$"}})
    grid = closed(g={"type": "array", "items": {"type": "array", "items": {"type": "array", "items": closed(items={"type": "integer"}, properties={"type": "string"})}}})
    _, fields = fields_of(spark, ("deep", 1, doc), ("grid", 1, grid))
    got = {(r.subject, r.path) for r in fields.collect()}
    steps = [".".join(f"f{j}" for j in range(5, k - 1, -1)) for k in range(5, -1, -1)]
    want = {("deep", p) for p in steps} | {("deep", "note")} | {("deep", f"{p}.note") for p in steps[:-1]} | {("grid", p) for p in ("g", "g[][][].items", "g[][][].properties")}
    assert got == want
    for _ in range(R.MOST_LEVELS):
        doc = closed(x=doc)
    try:
        fields_of(spark, ("deeper", 1, doc))
    except ValueError as e:
        assert "levels" in str(e)
    else:
        raise AssertionError("no error")


def test_reasons_of_nested_payloads(spark):
    doc = closed(id={"type": "integer"}, n={"type": "number", "enum": [1.5, 2]}, box=closed(w={"type": "integer"}) | {"required": ["w"]}, tags={"type": "array", "items": closed(t={"type": "string"}) | {"required": ["t"]}}, flags={"type": "array", "items": {"type": "boolean"}}) | {"required": ["id"]}
    _, fields = fields_of(spark, ("s", 1, doc))
    cases = [
        ('{"id":7}', []), ('{"id":7.0,"n":2.0}', []), ('{"id":7e0,"n":15e-1}', []), ('{"id":7,"n":3}', ["n:enum"]), ('{"id":"7"}', ["id:type"]), ('{"id":null}', ["id:null"]), ("{}", ["id:missing"]),
        ('{"id":7,"box":{"w":1,"x":{"y":1}}}', ["box.x:extra"]), ('{"id":7,"box":null}', ["box:null"]), ('{"id":7,"tags":[]}', []), ('{"id":7,"tags":[5,{"t":null}]}', ["tags[].t:null", "tags[]:type"]),
        ('{"id":7,"flags":[true,0,"x"]}', ["flags[]:type"]), ('"text"', [":not an object"]), (None, [":not an object"]), ("{", [":not an object"]),
        ('{"id":123456789012345678901234567890}', []), ('{"id":-0.5}', ["id:type"]),
    ]
    rows = spark.createDataFrame([(k, "s", 1, p) for k, (p, _) in enumerate(cases)] + [(100, "s", 2, "{}"), (101, "t", 1, "{}")], "id long, subject string, version int, payload string")
    good, bad = R.dlq_split(rows, fields)
    got = {r.id: sorted(f"{x.path}:{x.reason}" for x in r.reasons) for r in bad.collect()}
    assert got == {k: sorted(w) for k, (_, w) in enumerate(cases) if w} | {100: [":unknown schema"], 101: [":unknown schema"]}
    assert {r.id for r in good.collect()} == {k for k, (_, w) in enumerate(cases) if not w}


def test_repair_puts_back_at_any_depth(spark):
    bad = spark.createDataFrame([(1, '{"a":1,"b":{"c":{"d":2},"e":[3]}}'), (2, '{"a":1}'), (3, "[1]"), (4, '{"b":5}')], "id long, payload string")
    rec = spark.createDataFrame([(1, "b.c.d", "20"), (1, "a", '"x"'), (1, "b.f", "null"), (2, "new", "[1,2]"), (3, "a", "1"), (4, "b.c", "1")], "id long, path string, original string")
    got = {r.id: json.loads(r.payload) for r in R.repair(bad, rec).collect()}
    assert got == {1: {"a": "x", "b": {"c": {"d": 20}, "e": [3], "f": None}}, 2: {"a": 1, "new": [1, 2]}, 3: [1], 4: {"b": 5}}


def test_each_text_is_read_once_and_rows_are_dealt(spark, sf_dir, monkeypatch):
    """Documents of equal texts share their fields and rules; a table of one file feeds more than one task."""
    from eventlab.queries import registry as Q

    read = []
    nested = R._nested
    monkeypatch.setattr(R, "_nested", lambda docs: read.append(docs.count()) or nested(docs))
    doc = closed(id={"type": "integer"}) | {"required": ["id"]}
    rows = [(f"s{k}", 1, doc if k % 2 else closed(x={"type": "string"})) for k in range(40)]
    df, fields = fields_of(spark, *rows)
    assert sorted({(r.subject, r.path) for r in fields.collect()}) == sorted((s, "id" if "id" in d["properties"] else "x") for s, _, d in rows)
    events = df.select(F.monotonically_increasing_id().alias("id"), "subject", "version", F.lit('{"id":"a"}').alias("payload"))
    by_fields, by_rules = (sorted(map(str, R.with_reasons(events, x).select("subject", "reasons").collect())) for x in (fields, R.schema_rules(df)))
    assert by_fields == by_rules and len(by_rules) == 40
    assert read == [2, 2]
    assert Q.docs(spark, sf_dir).rdd.getNumPartitions() > 8


def test_a_filter_by_reasons_stays_above_the_steps(spark):
    df, fields = fields_of(spark, ("s", 1, closed(o=closed(p={"type": "integer"}), l={"type": "array", "items": closed(q={"type": "string"})})))
    rows = spark.createDataFrame([(1, "s", 1, "{}")], "id long, subject string, version int, payload string")
    filters = [line for line in plan(R.dlq_split(rows, fields)[1]).splitlines() if "Filter" in line]
    assert filters and all("schema_of_variant" not in line for line in filters)


def test_drift_menu_sends_no_subjects_to_the_driver(spark, sf_dir):
    """Subjects are as many as documents: their join is no broadcast, whatever size Spark estimates.  Several current versions of a subject give the lowest one above any."""
    import eventlab.queries  # noqa: F401  registers the queries
    from eventlab.catalog import QUERIES

    assert "BroadcastHashJoin" not in QUERIES["r11_drift_menu"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    fields = spark.createDataFrame([("s", 1, "a"), ("s", 2, "a"), ("s", 2, "b.c"), ("s", 3, "d"), ("t", 1, "a"), ("cdc.u", 2, "x")], "subject string, version int, path string")
    menu = lambda *now: sorted(tuple(r) for r in R.drift_menu(fields, spark.createDataFrame([*now], "subject string, version int")).collect())
    assert menu(("s", 1), ("t", 1), ("cdc.u", 1)) == [("s", 2, "b")]
    assert menu(("s", 2)) == [("s", 3, "d")]
    assert menu(("s", 1), ("s", 2), ("x", 1)) == [("s", 2, "b")]
