"""Queries of seeded draws and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlab.catalog import query, table
from eventlab.fixtures import env, with_sql
from eventlab.functions import draws as D
from eventlab.functions import values as V

KEY = D.subseed(42, "chaos")


def sql_hmac(message: str, key: bytes = KEY) -> str:
    """DuckDB: hex of the HMAC of a text."""
    inner, outer = D.pads(key)
    return f"sha256(from_hex('{outer}') || from_hex(sha256(from_hex('{inner}') || encode({message}))))"


def sql_u(message: str, key: bytes = KEY) -> str:
    return f"(('0x' || substr({sql_hmac(message, key)}, 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0)"


def _poly(x: str, cs) -> str:
    out = repr(cs[0])
    for c in cs[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


def sql_normal(u: str) -> str:
    return f"""(SELECT CASE WHEN p < 0.02425 THEN {_poly('t', D._C)} / ({_poly('t', D._D)} * t + 1.0) WHEN p > 1 - 0.02425 THEN -({_poly('t', D._C)} / ({_poly('t', D._D)} * t + 1.0))
        ELSE {_poly('(q * q)', D._A)} * q / ({_poly('(q * q)', D._B)} * (q * q) + 1.0) END
        FROM (SELECT p, p - 0.5 AS q, sqrt(-2.0 * ln(least(p, 1.0 - p))) AS t FROM (SELECT least(greatest({u}, 1e-15), 1 - 1e-15) AS p)))"""


_E = "FROM events"


def _ev(spark, sf):
    return table(spark, sf, "events")


@query("f2_prf_digest", f"SELECT event_id, {sql_hmac(chr(39) + 'missing:' + chr(39) + ' || event_id::VARCHAR || ' + chr(39) + ':select' + chr(39))} AS digest {_E}")
def f2(spark, sf):
    return _ev(spark, sf).select("event_id", D.prf_digest(KEY, "missing", F.col("event_id"), "select").alias("digest"))


_M = "'m:' || event_id::VARCHAR || ':x:' || user_id::VARCHAR"
_U = sql_u(_M)


def _u(*label):
    return D.prf_u(KEY, "m", F.col("event_id"), "x", F.col("user_id"))


@query("f3_prf_u", f"SELECT event_id, {_U} AS u {_E}")
def f3(spark, sf):
    return _ev(spark, sf).select("event_id", _u().alias("u"))


@query("f4_weighted_choice", f"SELECT event_id, CASE WHEN u * 10 < 7 THEN 0 WHEN u * 10 < 9 THEN 1 ELSE 2 END AS choice FROM (SELECT event_id, {_U} AS u {_E})")
def f4(spark, sf):
    return _ev(spark, sf).select("event_id", D.weighted_choice(_u(), [7, 2, 1]).alias("choice"))


_CTR = "from_hex(lpad(to_hex(event_id), 16, '0'))"


@query("f5_counter_draw", f"SELECT event_id, d AS digest, (('0x' || substr(d, 53, 12))::BIGINT & 1048575) AS bits FROM (SELECT event_id, {sql_hmac('X').replace('encode(X)', _CTR)} AS d {_E})")
def f5(spark, sf):
    d = D.counter_digest(KEY, F.col("event_id"))
    return _ev(spark, sf).select("event_id", d.alias("digest")).withColumn("bits", D.low_bits(F.col("digest"), 20))


@query("f6_f9_distributions", f"""SELECT event_id, 5.0 + u * 20.0 AS uniform, least(-30.0 * ln(1.0 - u), 31536000.0) AS exponential, 12.0 AS fixed,
    least(exp(ln(20.0) + (ln(90.0) - ln(20.0)) / {D.Z95} * z), 31536000.0) AS lognormal FROM (SELECT event_id, u, {sql_normal('u')} AS z FROM (SELECT event_id, {_U} AS u {_E}))""")
def f6(spark, sf):
    df = _ev(spark, sf).select("event_id", _u().alias("u"))
    u = F.col("u")
    return df.select("event_id", D.dist("uniform", u, min=5, max=25).alias("uniform"), D.dist("exponential", u, mean=30).alias("exponential"), D.dist("fixed", u, value=12).alias("fixed"), D.dist("lognormal", u, median=20, p95=90).alias("lognormal"))


_UUID = """lower(substr(t, 1, 8) || '-' || substr(t, 9, 4) || '-7' || substr(d, 46, 3) || '-' || substr('89ab', (('0x' || substr(d, 49, 1))::INT % 4) + 1, 1) || substr(d, 50, 3) || '-' || substr(d, 53, 12))"""


@query("f10_injection_id", f"SELECT event_id, {_UUID} AS injection_id FROM (SELECT event_id, lpad(to_hex(epoch_us(ts) // 1000), 12, '0') AS t, {sql_hmac(_M)} AS d {_E})")
def f10(spark, sf):
    df = _ev(spark, sf).select("event_id", "ts", D.prf_digest(KEY, "m", F.col("event_id"), "x", F.col("user_id")).alias("d"))
    return df.select("event_id", D.uuid7(V.epoch_ms(F.col("ts")), F.col("d")).alias("injection_id"))


_SCALARS = """SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'true' WHEN 1 THEN cast(event_id AS {s}) WHEN 2 THEN concat(cast(event_id AS {s}), '.5') WHEN 3 THEN concat('"', cast(event_id AS {s}), '.25"')
    WHEN 4 THEN '"2024-01-05T10:00:00Z"' WHEN 5 THEN concat('"', event_type, '"') ELSE 'null' END AS v FROM {t}"""
_INFER = """CASE WHEN v = 'null' THEN NULL WHEN v IN ('true', 'false') THEN 'boolean' WHEN regexp_full_match(v, '-?[0-9]+') THEN 'integer' WHEN regexp_full_match(v, '-?[0-9]+[.][0-9]+') THEN 'number'
    WHEN regexp_full_match(v, '"[0-9-]{10}T[0-9:]{8}Z"') THEN 'datetime' WHEN regexp_full_match(v, '"-?[0-9]+[.][0-9]+"') THEN 'decimal' ELSE 'string' END"""


@query("f11_infer_type", f"SELECT event_id, v, {_INFER} AS kind FROM ({_SCALARS.format(s='VARCHAR', t='events')})")
def f11(spark, sf):
    df = spark.sql(_SCALARS.format(s="string", t="{events}"), events=_ev(spark, sf))
    return df.select("event_id", "v", V.infer_type(F.col("v")).alias("kind"))


_CORR = """CASE kind WHEN 'boolean' THEN '"yes"' WHEN 'integer' THEN '-' || v WHEN 'number' THEN '"abc"' WHEN 'decimal' THEN replace(v, '.', ',') WHEN 'datetime' THEN replace(v, 'Z"', '"')
    WHEN 'string' THEN '"' || substr(v, 2, 1) || '"' ELSE v END"""


@query("f12_corrupt_value", f"SELECT event_id, v, {_CORR} AS corrupted FROM (SELECT event_id, v, {_INFER} AS kind FROM ({_SCALARS.format(s='VARCHAR', t='events WHERE event_id > 0')}))")
def f12(spark, sf):
    df = spark.sql(_SCALARS.format(s="string", t="{events} WHERE event_id > 0"), events=_ev(spark, sf))
    kinds = F.create_map(*[F.lit(x) for p in {"boolean": "bool_string", "integer": "negative_flip", "number": "alpha_string", "decimal": "locale_comma", "datetime": "naive_local", "string": "truncate"}.items() for x in p])
    return df.select("event_id", "v", V.corrupt(F.col("v"), F.coalesce(F.element_at(kinds, F.coalesce(V.infer_type(F.col("v")), F.lit("none"))), F.lit("none"))).alias("corrupted"))


@query("f13_derive", """SELECT l_orderkey, count(*) AS n, sum(round_even((l_extendedprice * (1 - l_discount))::DECIMAL(18,4), 2)::DECIMAL(18,2))::DOUBLE AS total, min(l_quantity) AS least, max(l_quantity) AS most FROM lineitem GROUP BY 1""")
def f13(spark, sf):
    li = table(spark, sf, "lineitem")
    line = F.bround((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)"), 2).cast("decimal(18,2)")
    return li.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(line).cast("double").alias("total"), F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"))


@query("f17_local_hour", "SELECT event_id, hour(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York') AS h, isodow(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York') - 1 AS wd FROM events")
def f17(spark, sf):
    h, wd = V.local_hour(F.col("ts"), "America/New_York")
    return _ev(spark, sf).select("event_id", h.alias("h"), wd.alias("wd"))


DIURNAL = [1 + 0.5 * (h in range(8, 20)) + 0.25 * (h % 3) for h in range(24)]
WEEKLY = [1.0, 1.0, 1.1, 1.2, 1.4, 0.8, 0.6]


@query("f18_intensity", f"SELECT event_id, ({[x * 24 / sum(DIURNAL) for x in DIURNAL]})[hour(ts) + 1] * ({[x * 7 / sum(WEEKLY) for x in WEEKLY]})[isodow(ts)] AS rate FROM events")
def f18(spark, sf):
    return _ev(spark, sf).select("event_id", V.intensity(F.col("ts"), DIURNAL, WEEKLY).alias("rate"))


@query("p13_partition_key", with_sql("SELECT event_id, workspace_id || ':' || stream_id || ':' || event_type AS k, NOT contains(event_type, 'e') OR true AS ok FROM env", "env"))
def p13(spark, sf):
    k, ok = V.partition_key(F.col("workspace_id"), F.col("stream_id"), F.col("event_type"))
    return env(spark, sf).select("event_id", k.alias("k"), ok.alias("ok"))


@query("p14_format_timestamps", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS text, epoch_us(ts) // 1000 AS ms FROM events")
def p14(spark, sf):
    return _ev(spark, sf).select("event_id", V.rfc3339(F.col("ts")).alias("text"), V.epoch_ms(F.col("ts")).alias("ms"))


@query("p15_uuid7", f"SELECT event_id, {_UUID} AS id FROM (SELECT event_id, lpad(to_hex(epoch_us(ts) // 1000), 12, '0') AS t, {sql_hmac('event_id::VARCHAR')} AS d {_E})")
def p15(spark, sf):
    return _ev(spark, sf).select("event_id", "ts", D.prf_digest(KEY, F.col("event_id")).alias("d")).select("event_id", D.uuid7(V.epoch_ms(F.col("ts")), F.col("d")).alias("id"))


@query("p19_within_window", "SELECT event_id, TIMESTAMP '2024-01-20' - ts <= INTERVAL '10' DAY AS recent FROM events")
def p19(spark, sf):
    return _ev(spark, sf).select("event_id", V.within(F.col("ts").cast("string"), F.lit("2024-01-20").cast("timestamp"), "P10D").alias("recent"))
