"""Event, CDC and injection rows made from the given tables.

The adapter's SQL is plain enough for Spark and DuckDB, so the registered queries and
their oracles start from equal rows.  Real jobs start from tables that have these
columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventlab.catalog import table

#: Truth events: the delivered fields that operators use.  ``id`` is the table's own number.
ENV = """
SELECT event_id AS id,
       concat('ev_', lpad(cast(event_id AS string), 12, '0')) AS event_id,
       concat('ws_', cast(user_id % 4 AS string)) AS workspace_id,
       concat('st_', cast(user_id % 8 AS string)) AS stream_id,
       0 AS shard_id, event_type,
       row_number() OVER (PARTITION BY user_id % 8 ORDER BY ts, event_id) AS sequence_no,
       concat('usr_', lpad(cast(user_id AS string), 8, '0')) AS actor_id,
       ts AS occurred_at, ts + INTERVAL '1' MILLISECOND * (event_id % 1000) AS emitted_at,
       user_id, value, props
FROM events
"""
#: The same for Spark, whose interval arithmetic is spelled otherwise.
ENV_SPARK = ENV.replace("INTERVAL '1' MILLISECOND * (event_id % 1000)", "make_dt_interval(0, 0, 0, cast(event_id % 1000 AS decimal(18, 6)) / 1000)").replace("FROM events", "FROM {events}")
#: Sessions of 30 minutes, and each event's cause: the one before it in the session.
SESSIONS = """
SELECT *, concat(actor_id, '-', cast(sum(fresh) OVER (PARTITION BY actor_id ORDER BY occurred_at, id ROWS UNBOUNDED PRECEDING) AS string)) AS session_id
FROM (SELECT *, CASE WHEN before IS NULL OR occurred_at > before + INTERVAL '30' MINUTE THEN 1 ELSE 0 END AS fresh
      FROM (SELECT *, lag(occurred_at) OVER (PARTITION BY actor_id ORDER BY occurred_at, id) AS before FROM env))
"""
CAUSES = """
SELECT *, lag(event_id) OVER (PARTITION BY session_id ORDER BY occurred_at, id) AS causation_id,
       first_value(event_id) OVER (PARTITION BY session_id ORDER BY occurred_at, id) AS correlation_id
FROM sess
"""
#: A delivered feed with planted faults: gaps, repeats, falling times, foreign tenants.
DELIVERED = """
SELECT id, event_id, CASE WHEN id % 103 = 0 THEN 'ws_other' ELSE workspace_id END AS workspace_id, stream_id, shard_id, event_type, sequence_no, actor_id,
       CASE WHEN id % 101 = 0 THEN occurred_at - INTERVAL '1' HOUR ELSE occurred_at END AS occurred_at, emitted_at, user_id,
       CASE WHEN id % 211 = 0 THEN value + 1 ELSE value END AS value, copy
FROM (SELECT *, 0 AS copy FROM env WHERE id % 97 <> 0 UNION ALL SELECT *, 1 AS copy FROM env WHERE id % 97 <> 0 AND id % 53 = 0)
"""
#: One customer is one entity, one order one version.
CDC = """
SELECT o_custkey AS entity_key, o_orderkey AS order_key,
       row_number() OVER w AS entity_version,
       CASE WHEN row_number() OVER w = 1 THEN 'c' WHEN o_orderkey % 41 = 0 THEN 'd' ELSE 'u' END AS op,
       o_orderdate AS valid_from, o_orderstatus AS status, o_totalprice AS total,
       lag(o_orderstatus) OVER w AS before_status, lag(o_totalprice) OVER w AS before_total
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
"""
#: A CDC feed with version gaps and changed images.
CDC_FAULTS = """
SELECT entity_key, order_key, entity_version, op, valid_from, status, total,
       CASE WHEN order_key % 67 = 0 THEN 'X' ELSE before_status END AS before_status, before_total
FROM cdc WHERE entity_version <> 5
"""
#: Injection records of the faults in DELIVERED.
INJECTIONS = """
SELECT concat('inj_', mode, '_', event_id) AS injection_id, workspace_id, stream_id, shard_id, mode, event_id, sequence_no, occurred_at,
       emitted_at AS recorded_at, copies, delay_ms, outcome
FROM (SELECT *, 'missing' AS mode, 0 AS copies, 0 AS delay_ms, '' AS outcome FROM env WHERE id % 97 = 0
      UNION ALL SELECT *, 'duplicates', 1, 0, '' FROM env WHERE id % 53 = 0 AND id % 97 <> 0
      UNION ALL SELECT *, 'corrupted_values', 0, 0, '' FROM env WHERE id % 211 = 0 AND id % 97 <> 0
      UNION ALL SELECT *, 'late_arriving', 0, 60000 * (1 + id % 50), CASE WHEN id % 3 = 0 THEN 'pending' WHEN id % 3 = 1 THEN 'emitted' ELSE 'discarded' END FROM env WHERE id % 89 = 0)
"""
_CHAIN = {"env": (ENV, ()), "sess": (SESSIONS, ("env",)), "caus": (CAUSES, ("sess",)), "delivered": (DELIVERED, ("env",)), "inj": (INJECTIONS, ("env",)), "cdc": (CDC, ()), "cdcf": (CDC_FAULTS, ("cdc",))}


def with_sql(sql: str, *names: str) -> str:
    """``sql`` with the fixtures it names as common table expressions."""
    order: list[str] = []

    def need(n: str) -> None:
        for m in _CHAIN[n][1]:
            need(m)
        if n not in order:
            order.append(n)

    for n in names:
        need(n)
    return "WITH " + ", ".join(f"{n} AS ({_CHAIN[n][0]})" for n in order) + f"\n{sql}"


def env(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ENV_SPARK, events=table(spark, sf_dir, "events"))


def _from(spark: SparkSession, sql: str, **frames: DataFrame) -> DataFrame:
    for n in frames:
        sql = sql.replace(f"FROM {n}", f"FROM {{{n}}}")
    return spark.sql(sql, **frames)


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from(spark, SESSIONS, env=env(spark, sf_dir))


def caused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from(spark, CAUSES, sess=sessions(spark, sf_dir))


def delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from(spark, DELIVERED, env=env(spark, sf_dir))


def injections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from(spark, INJECTIONS, env=env(spark, sf_dir))


def cdc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from(spark, CDC, orders=table(spark, sf_dir, "orders"))


def cdc_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from(spark, CDC_FAULTS, cdc=cdc(spark, sf_dir))
