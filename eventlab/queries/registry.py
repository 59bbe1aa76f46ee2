"""Queries of the schema registry: every part has a subject with one to three versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlab.catalog import query, table
from eventlab.fixtures import env, with_sql
from eventlab.plans import registry as R
from eventlab.sources import tables as S

#: Versions of each part's subject; the second adds a field, the third another, a nested one and, in some, what isn't allowed.
_BOX = """concat(',"box":{"type":"object","additionalProperties":false,"required":[],"properties":{"w":{"type":"', CASE WHEN p_partkey % 31 = 0 AND v = 3 THEN 'number' ELSE 'integer' END, '"}',
    CASE WHEN v >= 3 THEN ',"tags":{"type":"array","items":{"type":"object","additionalProperties":false,"required":[],"properties":{"t":{"type":"string"}}}}' ELSE '' END, '}}')"""
_DOC = f"""SELECT concat('part.', cast(p_partkey AS string)) AS subject, cast(v AS int) AS version, p_partkey,
    concat('{{"type":"object","additionalProperties":', CASE WHEN p_partkey % 17 = 0 THEN 'true' ELSE 'false' END, ',"required":["id"', CASE WHEN p_partkey % 13 = 0 AND v = 2 THEN ',"name"' ELSE '' END, '],"properties":{{"id":{{"type":"integer","minimum":0}},',
    '"name":{{"type":"string","minLength":2,"maxLength":12,"pattern":"^n"', CASE WHEN p_partkey % 23 = 0 AND v = 3 THEN ',"anyOf":[]' ELSE '' END, '}},"kind":{{"type":"string","enum":["a","b"]}},"unit":{{"type":"string","const":"kg"}},"at":{{"type":"string","format":"date"}}',
    CASE WHEN v >= 2 THEN concat(',"size":{{"type":"', CASE WHEN p_partkey % 19 = 0 AND v = 3 THEN 'string' ELSE 'number' END, '"}}') ELSE '' END,
    CASE WHEN p_partkey % 29 = 0 AND v = 3 THEN ',"_dfx":{{"type":"string"}}' ELSE '' END,
    CASE WHEN v >= 3 OR v = 2 AND p_partkey % 7 = 0 THEN {_BOX} ELSE '' END, '}}}}') AS doc
FROM part CROSS JOIN (SELECT 1 AS v UNION ALL SELECT 2 UNION ALL SELECT 3) x WHERE v <= 1 + p_partkey % 3"""
_FIELDS = """SELECT subject, version, path, type, required FROM (SELECT *, unnest(list_concat([('id', 'integer', true), ('name', 'string', p_partkey % 13 = 0 AND version = 2), ('kind', 'string', false), ('unit', 'string', false), ('at', 'string', false)],
    CASE WHEN version >= 2 THEN [('size', CASE WHEN p_partkey % 19 = 0 AND version = 3 THEN 'string' ELSE 'number' END, false)] ELSE [] END,
    CASE WHEN version = 3 AND p_partkey % 29 = 0 THEN [('_dfx', 'string', false)] ELSE [] END,
    CASE WHEN version >= 3 OR version = 2 AND p_partkey % 7 = 0 THEN [('box', 'object', false), ('box.w', CASE WHEN p_partkey % 31 = 0 AND version = 3 THEN 'number' ELSE 'integer' END, false)] ELSE [] END,
    CASE WHEN version >= 3 THEN [('box.tags', 'array', false), ('box.tags[].t', 'string', false)] ELSE [] END)) AS f FROM docs) , LATERAL (SELECT f[1] AS path, f[2] AS type, f[3] AS required)"""


def sql(body, *names):
    pre = f"docs AS ({_DOC}), fields AS ({_FIELDS})"
    return with_sql(body, *names).replace("WITH ", f"WITH {pre}, ", 1) if names else f"WITH {pre} {body}"


def parts(spark, sf):
    """Keys of parts, dealt over all tasks: the table is a small file."""
    return S.spread(table(spark, sf, "part").select("p_partkey"), "p_partkey")


def docs(spark, sf):
    return spark.sql(_DOC.replace("{", "{{").replace("}", "}}").replace("FROM part ", "FROM {part} "), part=parts(spark, sf))


def fields(spark, sf):
    return R.schema_fields(docs(spark, sf))


@query("r1_schema_fields", sql("SELECT * FROM fields"))
def r1(spark, sf):
    return fields(spark, sf).select("subject", "version", "path", "type", "required")


@query("r2_schema_diff", sql("SELECT subject, version, path FROM fields f WHERE version > 1 AND NOT EXISTS (SELECT 1 FROM fields g WHERE g.subject = f.subject AND g.version = f.version - 1 AND g.path = f.path)"))
def r2(spark, sf):
    return R.schema_diff(fields(spark, sf))


@query("r3_compat_check", sql("""SELECT subject, c[1] AS path, c[2] AS code FROM (SELECT subject, unnest(CASE WHEN len(shape) > 0 THEN shape ELSE list_filter([CASE WHEN p_partkey % 19 = 0 THEN ('size', 'C002') END, CASE WHEN p_partkey % 13 = 0 THEN ('name', 'C003') END,
        CASE WHEN p_partkey % 31 = 0 AND p_partkey % 7 = 0 THEN ('box.w', 'C002') END], lambda x: x IS NOT NULL) END) AS c
    FROM (SELECT subject, p_partkey, list_filter([CASE WHEN p_partkey % 17 = 0 THEN ('', 'C004') END, CASE WHEN p_partkey % 23 = 0 THEN ('name', 'C006') END, CASE WHEN p_partkey % 29 = 0 THEN ('_dfx', 'C009') END], lambda x: x IS NOT NULL) AS shape FROM docs WHERE version = 3))"""))
def r3(spark, sf):
    d = docs(spark, sf)
    f = S.cut(R.schema_fields(d.where("p_partkey % 3 = 2")), "fields")
    return R.compat_errors(f.where("version = 2"), f.where("version = 3"), d.where("version = 3"))


@query("f14_fingerprint", sql("""SELECT subject, version, sha256(string_agg(path || '|' || type || '|' || CASE WHEN required THEN 'true' ELSE 'false' END || '|' || fragment, chr(10) ORDER BY path || '|' || type)) AS fingerprint FROM (
    SELECT d.subject, d.version, d.path, d.type, d.required, CASE WHEN d.path = 'box.tags[].t' THEN '{"type":"string"}' ELSE json_extract(doc, '$.properties.' || replace(d.path, '.', '.properties.'))::VARCHAR END AS fragment
    FROM fields d JOIN docs USING (subject, version)) GROUP BY subject, version"""))
def f14(spark, sf):
    return R.fingerprint(fields(spark, sf))


@query("r4_register_versions", sql("SELECT subject, version FROM docs WHERE version <= 2 UNION ALL SELECT subject, 3 FROM docs WHERE version = 3 UNION ALL SELECT subject, version + 1 FROM docs WHERE version = 1 AND p_partkey % 3 = 0 AND p_partkey % 2 = 0"))
def r4(spark, sf):
    d = docs(spark, sf).withColumn("fingerprint", F.sha2("doc", 256))
    reg = d.where("version <= 2").select("subject", "version", "fingerprint")
    changed = F.when((F.col("p_partkey") % 3 == 0) & (F.col("p_partkey") % 2 == 0), F.concat("fingerprint", F.lit("x"))).otherwise(F.col("fingerprint"))
    new = d.where("version = 1 + p_partkey % 3").select("subject", changed.alias("fingerprint"))
    return R.register(reg, new).select("subject", "version")


@query("r5_version_caps", sql("SELECT 'versions' AS kind, subject AS name, count(*) AS n FROM docs GROUP BY subject HAVING count(*) > 2 UNION ALL SELECT 'subjects', 'sc_' || (p_partkey % 4)::VARCHAR, count(DISTINCT subject) FROM docs GROUP BY p_partkey % 4 HAVING count(DISTINCT subject) > 10"))
def r5(spark, sf):
    return R.cap_violations(docs(spark, sf).withColumn("scenario", F.concat(F.lit("sc_"), (F.col("p_partkey") % 4).cast("string"))), 2, 10)


_PINS = "SELECT concat('st_', cast(p_partkey % 8 AS string)) AS stream_id, subject, version AS pin, p_partkey FROM docs WHERE version = 1"
_UPS = "SELECT concat('st_', cast(p_partkey % 8 AS string)) AS stream_id, subject, version AS to_version, CASE WHEN p_partkey % 4 = 0 THEN 'pending' ELSE 'applied' END AS status, p_partkey FROM docs WHERE version > 1"


def pins(spark, sf):
    return spark.sql(_PINS.replace("FROM docs", "FROM {docs}"), docs=docs(spark, sf))


def ups(spark, sf):
    return spark.sql(_UPS.replace("FROM docs", "FROM {docs}"), docs=docs(spark, sf))


@query("r6_effective_versions", sql(f"SELECT stream_id, subject, greatest(pin, coalesce((SELECT max(to_version) FROM ({_UPS}) u WHERE status = 'applied' AND u.subject = p.subject), 0)) AS version FROM ({_PINS}) p"))
def r6(spark, sf):
    return R.effective(pins(spark, sf), ups(spark, sf))


@query("r7_materialize_pins", sql(f"SELECT stream_id, subject, CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 1 + p_partkey % 3 END AS version FROM ({_PINS})"))
def r7(spark, sf):
    p = pins(spark, sf)
    return R.materialize(p.select("stream_id", "subject"), p.where("p_partkey % 5 = 0").select("stream_id", "subject", "pin"), docs(spark, sf))


@query("r8_pin_violations", sql(f"SELECT stream_id, CASE WHEN p_partkey % 7 = 0 THEN subject || '.x' ELSE subject END AS subject, 2 AS pin, CASE WHEN p_partkey % 7 = 0 THEN 'unknown subject' ELSE 'unknown version' END AS problem FROM ({_PINS}) WHERE p_partkey % 7 = 0 OR p_partkey % 3 = 0"))
def r8(spark, sf):
    p = pins(spark, sf).withColumn("subject", F.when(F.col("p_partkey") % 7 == 0, F.concat("subject", F.lit(".x"))).otherwise(F.col("subject"))).withColumn("pin", F.lit(2))
    return R.pin_violations(p.select("stream_id", "subject", "pin"), docs(spark, sf))


@query("r9_schema_versions_view", sql(f"SELECT stream_id, subject, pin, CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 1 + p_partkey % 3 END AS effective, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 4 = 0 THEN '' ELSE CASE p_partkey % 3 WHEN 1 THEN '2' ELSE '2,3' END END AS applied, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 4 <> 0 THEN '' ELSE CASE p_partkey % 3 WHEN 1 THEN '2' ELSE '2,3' END END AS pending FROM ({_PINS})"))
def r9(spark, sf):
    out = R.versions_view(pins(spark, sf).drop("p_partkey"), ups(spark, sf))
    return out.select("stream_id", "subject", "pin", "effective", *[F.array_join(c, ",").alias(c) for c in ("applied", "pending")])


@query("r10_upgrade_violations", sql(f"""SELECT p_partkey AS request_id, CASE WHEN p_partkey % 11 = 5 THEN 'change subject' WHEN p_partkey % 11 = 0 THEN 'unknown subject' WHEN to_version > 1 + p_partkey % 3 THEN 'unregistered version' WHEN to_version <= 1 THEN 'not above effective' WHEN p_partkey % 5 = 0 THEN 'in the past' END AS problem
    FROM (SELECT *, 1 + p_partkey % 4 AS to_version FROM ({_PINS})) WHERE problem IS NOT NULL"""))
def r10(spark, sf):
    p = pins(spark, sf)
    req = p.select(F.col("p_partkey").alias("request_id"), "stream_id", F.when(F.col("p_partkey") % 11 == 0, "gone").when(F.col("p_partkey") % 11 == 5, F.concat(F.lit("cdc."), "subject")).otherwise(F.col("subject")).alias("subject"), (1 + F.col("p_partkey") % 4).cast("int").alias("to_version"), F.when(F.col("p_partkey") % 5 == 0, F.lit("2024-01-01")).otherwise(F.lit("2024-03-01")).cast("timestamp").alias("at"))
    return R.upgrade_violations(req, p.select("stream_id", "subject", F.col("pin").alias("version")), docs(spark, sf), F.lit("2024-02-01").cast("timestamp"))


@query("r11_drift_menu", sql("SELECT subject, 2 AS next_version, unnest(CASE WHEN p_partkey % 7 = 0 THEN ['size', 'box'] ELSE ['size'] END) AS path FROM docs WHERE version = 2 AND p_partkey % 10 <> 3"))
def r11(spark, sf):
    d = docs(spark, sf).withColumn("subject", F.when(F.col("p_partkey") % 10 == 3, F.concat(F.lit("cdc."), "subject")).otherwise(F.col("subject")))
    return R.drift_menu(R.schema_fields(d), d.where("version = 1").select("subject", "version"))


_CUT = "TIMESTAMP '2024-01-16'"
#: Two upgrades of every event type of all streams but one; the second skips a version.
_STEPS = "CASE WHEN stream_id = 'st_3' THEN 1 WHEN occurred_at >= TIMESTAMP '2024-01-20' THEN 4 WHEN occurred_at >= TIMESTAMP '2024-01-10' THEN 2 ELSE 1 END"


def upgrades(spark, sf):
    steps = F.array(*[F.struct(F.lit(at).cast("timestamp_ntz").alias("at"), F.lit(v).alias("to_version")) for at, v in (("2024-01-10", 2), ("2024-01-20", 4))])
    per = env(spark, sf).where("stream_id <> 'st_3'").select("stream_id", F.col("event_type").alias("subject")).distinct()
    return S.cut(per.select("stream_id", "subject", F.explode(steps).alias("s")).select("stream_id", "subject", "s.*"), "upgrades")


@query("r12_apply_cutover", with_sql(f"SELECT event_id, {_STEPS} AS version, CASE WHEN {_STEPS} >= 2 THEN event_type || '!' END AS region, CASE WHEN {_STEPS} >= 3 THEN value END AS city FROM env", "env"))
def r12(spark, sf):
    df = env(spark, sf).withColumn("version", F.lit(1)).withColumn("subject", F.col("event_type"))
    return R.apply_cutover(df, upgrades(spark, sf), {"region": (2, F.concat("event_type", F.lit("!"))), "city": (3, F.col("value"))}).select("event_id", "version", "region", "city")


@query("r13_cutover_position", with_sql("SELECT stream_id, shard_id, min(sequence_no) AS sequence_no FROM env WHERE occurred_at >= TIMESTAMP '2024-01-20' AND stream_id <> 'st_3' GROUP BY 1, 2", "env"))
def r13(spark, sf):
    df = env(spark, sf).withColumn("version", F.lit(1)).withColumn("subject", F.col("event_type"))
    return R.cutover_position(R.apply_cutover(df, upgrades(spark, sf), {}), 3)


#: Each part also has a lot, whose document is nested: objects and items that require something, and arrays of arrays.
_LOT = """{"type":"object","additionalProperties":false,"required":["id"],"properties":{"id":{"type":"integer"},"size":{"type":"number","maximum":100},
    "box":{"type":"object","additionalProperties":false,"required":["w"],"properties":{"w":{"type":"integer"},"lid":{"type":"object","additionalProperties":false,"required":["c"],"properties":{"c":{"type":"string","enum":["red","blue"]}}}}},
    "tags":{"type":"array","items":{"type":"object","additionalProperties":false,"required":["t"],"properties":{"t":{"type":"string"}}}},
    "grid":{"type":"array","items":{"type":"array","items":{"type":"integer"}}}}}"""
#: Payloads of lots and why they are bad, one of them for each number modulo their count; null stands for one without a registered version.
_LOTS = [
    ('{"id":7}', ""), ('{"id":7,"box":{"w":1}}', ""), ('{"id":7,"box":{"w":"x"}}', "box.w:type"), ('{"id":7,"box":{}}', "box.w:missing"), ('{"id":7,"size":1e2}', ""), ('{"id":1.0,"size":1.5E1}', ""), ('{"id":1.5}', "id:type"),
    ('{"id":7,"tags":[{"t":"a"},{}]}', "tags[].t:missing"), ('{"id":7,"tags":[{"t":1},{"t":"b"},{"t":2},{"t":"c","u":2}]}', "tags[].t:type,tags[].u:extra"), ('{"id":7,"box":5,"tags":{}}', "box:type,tags:type"), ('{"id":7,"size":1e3}', "size:range"),
    ('{"id":7,"grid":[[1,2],[],["x"]]}', "grid[][]:type"), ('{"id":7,"grid":[[1],2,null]}', "grid[]:null,grid[]:type"), ('{"id":7,"box":{"w":1,"lid":{"c":"green"}}}', "box.lid.c:enum"), ('{"id":7,"box":{"lid":{}}}', "box.lid.c:missing,box.w:missing"),
    ('{"box":{"w":1}}', "id:missing"), ("[7]", ":not an object"), ("{id}", ":not an object"), (None, ":unknown schema"),
]


def _lots(spark, sf):
    """Rows of lots, with ids after those of parts."""
    kind = F.col("p_partkey") % len(_LOTS)
    payload = F.coalesce(*[F.when(kind == k, F.lit(p or '{"id":7}')) for k, (p, _) in enumerate(_LOTS)])
    version = F.when(kind == len(_LOTS) - 1, 9).otherwise(1)
    return parts(spark, sf).select((F.col("p_partkey") + 2**40).alias("id"), F.concat(F.lit("lot."), F.col("p_partkey").cast("string")).alias("subject"), version.alias("version"), payload.alias("payload"))


def all_docs(spark, sf):
    """Documents of parts and lots."""
    lots = parts(spark, sf).select(F.concat(F.lit("lot."), F.col("p_partkey").cast("string")).alias("subject"), F.lit(1).alias("version"), F.lit(_LOT).alias("doc"))
    return docs(spark, sf).select("subject", "version", "doc").unionByName(lots)


def _rows(spark, sf):
    """Each part as a row of its first version, some with faults, and each lot."""
    p = parts(spark, sf).select(F.col("p_partkey").alias("id"))
    n = F.col("id").cast("string")
    payload = F.map_from_entries(F.array_compact(F.array(
        F.struct(F.lit("id").alias("k"), F.when(F.col("id") % 10 == 0, F.concat(F.lit('"'), n, F.lit('"'))).when(F.col("id") % 10 == 1, "null").when(F.col("id") % 20 == 13, "-5").otherwise(n).alias("v")),
        F.struct(F.lit("name").alias("k"), F.when(F.col("id") % 20 == 9, '"x"').when(F.col("id") % 20 == 15, '"nnnnnnnnnnnnnnnn"').otherwise(F.concat(F.lit('"n'), n, F.lit('"'))).alias("v")),
        F.struct(F.lit("kind").alias("k"), F.when(F.col("id") % 20 == 3, '"z"').otherwise('"a"').alias("v")),
        F.struct(F.lit("unit").alias("k"), F.when(F.col("id") % 20 == 5, '"lb"').otherwise('"kg"').alias("v")),
        F.struct(F.lit("at").alias("k"), F.when(F.col("id") % 20 == 7, '"2024-13-41"').otherwise('"2024-01-31"').alias("v")),
        F.when(F.col("id") % 6 == 1, F.struct(F.lit("size").alias("k"), F.lit("1.5").alias("v"))),
        F.when(F.col("id") % 15 == 4, F.struct(F.lit("zzz").alias("k"), F.lit("1").alias("v"))))))
    payload = F.when(F.col("id") % 10 == 2, F.map_filter(payload, lambda k, v: k != "id")).otherwise(payload)
    text = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(payload), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"])), ","), F.lit("}"))
    return p.select("id", F.concat(F.lit("part."), n).alias("subject"), F.lit(1).alias("version"), text.alias("payload")).unionByName(_lots(spark, sf))


@query("r14_detect_drift", "SELECT p_partkey AS id, 'size' AS path, 2 AS known_from FROM part WHERE p_partkey % 6 = 1")
def r14(spark, sf):
    return R.detect_drift(_rows(spark, sf), fields(spark, sf))


_WHY = """SELECT p_partkey AS id, unnest(list_filter([CASE WHEN p_partkey % 10 = 0 THEN 'id:type' WHEN p_partkey % 10 = 1 THEN 'id:null' WHEN p_partkey % 10 = 2 THEN 'id:missing' WHEN p_partkey % 20 = 13 THEN 'id:range' END,
    CASE p_partkey % 20 WHEN 9 THEN 'name:pattern' WHEN 15 THEN 'name:length' WHEN 3 THEN 'kind:enum' WHEN 5 THEN 'unit:const' WHEN 7 THEN 'at:format' END, CASE WHEN p_partkey % 6 = 1 THEN 'size:extra' END,
    CASE WHEN p_partkey % 15 = 4 THEN 'zzz:extra' END], lambda x: x IS NOT NULL)) AS why FROM part"""
#: What r15 and its streaming form find.
DLQ = f"""SELECT id, string_agg(why, ',' ORDER BY why) AS why FROM ({_WHY}) GROUP BY id UNION ALL SELECT p_partkey, 'good' FROM part WHERE p_partkey NOT IN (SELECT id FROM ({_WHY}))
    UNION ALL SELECT p_partkey + {2**40}, [{", ".join(f"'{w or 'good'}'" for _, w in _LOTS)}][CAST(p_partkey % {len(_LOTS)} + 1 AS BIGINT)] FROM part"""


@query("r15_dlq_split", DLQ)
def r15(spark, sf):
    return why(*R.halves(S.cut(R.with_reasons(_rows(spark, sf), R.schema_rules(all_docs(spark, sf))), "judged")))


def why(good, bad):
    text = F.array_join(F.transform("reasons", lambda r: F.concat(r["path"], F.lit(":"), r["reason"])), ",")
    return bad.select("id", text.alias("why")).unionByName(good.select("id", F.lit("good").alias("why")))


#: What is put back into bad rows, by path.
_OLD_LOTS = {2: ("box.w", "4"), 3: ("box.w", "4"), 6: ("id", "8"), 13: ("box.lid.c", '"blue"')}


@query("r17_reprocess_dlq", f"""SELECT p_partkey AS id, p_partkey::VARCHAR AS v, NULL AS box FROM part WHERE p_partkey % 10 IN (0, 1) AND p_partkey % 6 <> 1 AND p_partkey % 15 <> 4
    UNION ALL SELECT p_partkey + {2**40}, CASE WHEN k = 6 THEN '8' ELSE '7' END, CASE WHEN k IN (2, 3) THEN '{{"w":4}}' WHEN k = 13 THEN '{{"lid":{{"c":"blue"}},"w":1}}' END FROM (SELECT p_partkey, p_partkey % {len(_LOTS)} AS k FROM part) WHERE k IN (2, 3, 6, 13)""")
def r17(spark, sf):
    judged = R.judge(R.schema_rules(all_docs(spark, sf)))
    bad = S.cut(R.halves(judged(_rows(spark, sf)))[1], "bad")
    rec = bad.where("id % 10 in (0, 1) and subject like 'part.%'").select("id", F.lit("id").alias("path"), F.col("id").cast("string").alias("original"))
    kind = (F.col("id") - 2**40) % len(_LOTS)
    for k, (path, original) in _OLD_LOTS.items():
        rec = rec.unionByName(bad.where(F.col("subject").startswith("lot.") & (kind == k)).select("id", F.lit(path).alias("path"), F.lit(original).alias("original")))
    good, _ = R.halves(judged(R.repair(bad.drop("reasons"), rec)))
    return good.select("id", F.get_json_object("payload", "$.id").alias("v"), F.get_json_object("payload", "$.box").alias("box"))
