"""Queries of synthetic columns, keyed by customers, and of drawn references."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlab.catalog import query, table
from eventlab.functions import draws as D
from eventlab.plans import synth as G
from eventlab.queries.draws import DIURNAL, sql_hmac, sql_normal, sql_u
from eventlab.sources import tables as S
from eventlab.streaming import streams as T

SEED = 11
KEY = D.subseed(SEED, "values")
_C = "FROM customer"


def cust(spark, sf, **columns):
    return G.synth(table(spark, sf, "customer").select("c_custkey"), F.col("c_custkey"), columns, "t", SEED)


def u(column, n=0, key=KEY):
    return sql_u(f"'t:' || c_custkey || ':{column}:{n}'", key)


def hx(column, n=0):
    return sql_hmac(f"'t:' || c_custkey || ':{column}:{n}'", KEY)


def pick(values, column, n=0):
    return f"({list(values)})[floor({u(column, n)} * {len(values)})::INT + 1]"


def digits(k, column, n=0):
    return f"lpad(floor({u(column, n)} * {10**k})::BIGINT::VARCHAR, {k}, '0')"


@query("g1_g2_keys", f"SELECT c_custkey, 'usr_' || substr({hx('k')}, 1, 16) AS k, 100 + c_custkey * 5 AS n, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-' || substr('89ab', ('0x' || substr(h, 17, 1))::INT % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS i FROM (SELECT *, {hx('i')} AS h {_C})")
def g1(spark, sf):
    return cust(spark, sf, k=G.key("usr"), n=G.seq(100, 5), i=G.uuid())


@query("g1_people", f"""SELECT c_custkey, f, l, f || ' ' || l AS full, lower(f) || {digits(3, 'mail')} || '@example.com' AS mail, lower(l) || {digits(3, 'nick')} AS nick, '+1' || {digits(10, 'tel')} AS tel
    FROM (SELECT *, {pick(G.FIRST, 'f')} AS f, {pick(G.LAST, 'l')} AS l {_C})""")
def g1_people(spark, sf):
    return cust(spark, sf, f=G.choice(G.FIRST), l=G.choice(G.LAST), full=G.template("{f} {l}"), mail=G.email("f"), nick=G.username("l"), tel=G.phone())


@query("g1_addresses", f"""SELECT c_custkey, (floor({u('a', 'n')} * 999)::INT + 1) || ' ' || {pick(G.STREETS, 'a')} || ' ' || {pick(G.STREET_KINDS, 'a', 1)} AS street, {pick(G.CITIES, 'a', 'c')} AS city, {pick(G.STATES, 'a', 's')} AS state,
    {digits(5, 'a', 'p')} AS postal_code, {pick(G.COUNTRIES, 'a', 'k')} AS country, {digits(5, 'zip')} AS zip {_C}""")
def g1_addresses(spark, sf):
    return cust(spark, sf, a=G.address(), zip=G.postal()).select("c_custkey", "a.*", "zip")


@query("g1_commerce", f"""SELECT c_custkey, {pick(G.ADJECTIVES, 'p', 0)} || ' ' || {pick(G.MATERIALS, 'p', 1)} || ' ' || {pick(G.PRODUCTS, 'p', 2)} AS p, array_to_string(([{', '.join(pick(G.CATEGORIES, 'cat', i) for i in range(3))}])[1:floor({u('cat', 'n')} * 3)::INT + 1], '/') AS cat,
    {pick(G.BRANDS, 'brand')} AS brand, round_even((5.0 + {u('cost')} * 95.0)::DECIMAL(18,6), 2)::DOUBLE AS cost, round_even((5.0 + {u('skew')} * {u('skew')} * 95.0)::DECIMAL(18,6), 2)::DOUBLE AS skew {_C}""")
def g1_commerce(spark, sf):
    out = cust(spark, sf, p=G.joined(" ", G.ADJECTIVES, G.MATERIALS, G.PRODUCTS), cat=G.category(), brand=G.choice(G.BRANDS), cost=G.price(5, 100), skew=G.price(5, 100, True))
    return out.withColumn("cost", F.col("cost").cast("double")).withColumn("skew", F.col("skew").cast("double"))


@query("g1_internet", f"""SELECT c_custkey, (floor({u('ip', 'a')} * 223)::INT + 1) || '.' || floor({u('ip', 0)} * 256)::INT || '.' || floor({u('ip', 1)} * 256)::INT || '.' || floor({u('ip', 2)} * 256)::INT AS ip, {pick(G.AGENTS, 'ua')} AS ua,
    'https://www.example.com/' || {pick(G.WORDS, 'link')} || '-' || substr({hx('link', 'x')}, 1, 6) AS link, 'SKU-' || translate(substr({hx('code', 1)}, 1, 4), '0123456789abcdef', 'ABCDEFGHIJKLMNOP') || '-' || {digits(4, 'code', 3)} AS code {_C}""")
def g1_internet(spark, sf):
    return cust(spark, sf, ip=G.ip_v4(), ua=G.choice(G.AGENTS), link=G.url(), code=G.sku())


_WORDS = ", ".join(pick(G.WORDS, "s", i) for i in range(9))


@query("g1_text", f"SELECT c_custkey, {pick(G.WORDS, 'w')} AS w, upper(substr(t, 1, 1)) || substr(t, 2) || '.' AS s FROM (SELECT *, array_to_string(([{_WORDS}])[1:floor({u('s', 'n')} * 6)::INT + 4], ' ') AS t {_C})")
def g1_text(spark, sf):
    return cust(spark, sf, w=G.choice(G.WORDS), s=G.sentence(), par=G.paragraph()).drop("par")


_ZIPF = [1 / k for k in range(1, 11)]
_ZIPF_SQL = "CASE " + " ".join(f"WHEN z * {sum(_ZIPF)!r} < {sum(_ZIPF[: k + 1])!r} THEN {k + 1}" for k in range(9)) + " ELSE 10 END"


@query("g1_numbers", f"""SELECT c_custkey, 10 + floor({u('i')} * 41)::BIGINT AS i, round(1.0 + {u('f')} * 8.0, 4) AS f, least(greatest(50.0 + 10.0 * {sql_normal(u('n'))}, 0.0), 100.0) AS n, exp(ln(20.0) + (ln(90.0) - ln(20.0)) / {D.Z95} * {sql_normal(u('l'))}) AS l,
    (SELECT {_ZIPF_SQL} FROM (SELECT {u('z')} AS z)) AS z, {u('b')} < 0.3 AS b, CASE WHEN {u('c')} * 10.0 < 7 THEN 'x' WHEN {u('c')} * 10.0 < 9 THEN 'y' ELSE 'z' END AS c {_C}""")
def g1_numbers(spark, sf):
    return cust(spark, sf, i=G.integer(10, 50), f=G.double(1, 9), n=G.normal(50, 10, 0, 100), l=G.lognormal(20, 90), z=G.zipf(10), b=G.boolean(0.3), c=G.weighted(["x", "y", "z"], [7, 2, 1]))


@query("g1_times_decimals", f"SELECT c_custkey, epoch_ms(epoch_ms(TIMESTAMP '2024-01-01') + floor({u('t')} * (epoch_ms(TIMESTAMP '2024-02-01') - epoch_ms(TIMESTAMP '2024-01-01')))::BIGINT) AS t, round_even((1.0 + {u('d')} * 9.0)::DECIMAL(24,10), 3)::DOUBLE AS d, c_custkey * 2 + 1 AS e {_C}")
def g1_times(spark, sf):
    out = cust(spark, sf, t=G.between("2024-01-01", "2024-02-01"), d=G.decimal(1, 10, 3), e=G.derived("c_custkey * 2 + 1"))
    return out.withColumn("d", F.col("d").cast("double"))


_FK = sql_u("'fk:' || o_orderkey || ':fk:0'", KEY)
_NUM = "SELECT {k} AS fk, row_number() OVER (ORDER BY {k}) - 1 AS n FROM {t}"


def _fk(name, expr):
    return f"SELECT o_orderkey, fk FROM (SELECT o_orderkey, {expr} AS n FROM (SELECT o_orderkey, {_FK} AS u, (SELECT count(*) FROM part) AS c FROM orders)) JOIN ({_NUM.format(k='p_partkey', t='part')}) USING (n)"


def _orders(spark, sf, how, **by):
    parts = table(spark, sf, "part").withColumn("w", F.col("p_partkey") % 7 + 1)
    return G.sample_fk(table(spark, sf, "orders").select("o_orderkey"), F.col("o_orderkey"), parts, "p_partkey", "p_partkey", "fk", SEED, how, **by)


@query("j16_fk_sample", _fk("uniform", "floor(u * c)::BIGINT"))
def j16(spark, sf):
    return _orders(spark, sf, "uniform")


def _by_weight(w):
    """DuckDB: the key whose share of the cumulative weights holds the draw."""
    shares = f"SELECT p_partkey AS fk, lag(upto, 1, 0.0) OVER (ORDER BY n) AS low, upto AS high FROM (SELECT *, sum(w) OVER (ORDER BY n ROWS UNBOUNDED PRECEDING) AS upto FROM (SELECT *, {w} AS w FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS n FROM part)))"
    return f"WITH s AS ({shares}), d AS (SELECT o_orderkey, {_FK} * (SELECT max(high) FROM s) AS x FROM orders) SELECT o_orderkey, fk FROM d ASOF JOIN s ON d.x >= s.low"


@query("j17_fk_sample_zipf", _by_weight("pow(n + 1.0, -1.0)"))
def j17(spark, sf):
    return _orders(spark, sf, "zipf")


@query("j17b_fk_sample_zipf_half", _by_weight("pow(n + 1.0, -0.5)"))
def j17b(spark, sf):
    return _orders(spark, sf, "zipf", s=0.5)


@query("j17c_fk_sample_zipf_two", _by_weight("pow(n + 1.0, -2.0)"))
def j17c(spark, sf):
    return _orders(spark, sf, "zipf", s=2.0)


@query("j17d_fk_sample_weighted", _by_weight("(p_partkey % 7 + 1)::DOUBLE"))
def j17d(spark, sf):
    return _orders(spark, sf, "weighted", weight="w")


@query("j18_fk_sample_recent", _fk("recent", "c - greatest(1, c // 4) + floor(u * greatest(1, c // 4))::BIGINT"))
def j18(spark, sf):
    return _orders(spark, sf, "recent")


@query("j19_ref_attr", "SELECT o_orderkey, c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey".replace("c_mktsegment", "c_nationkey"))
def j19(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("segment"))
    return table(spark, sf, "orders").join(c, "o_custkey").select("o_orderkey", "segment")


@query("j21_one_to_one", f"SELECT c_custkey, fk AS partner FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS n FROM customer) JOIN ({_NUM.format(k='o_orderkey', t='orders')}) USING (n)")
def j21(spark, sf):
    return G.assign_one_to_one(table(spark, sf, "customer").select("c_custkey"), "c_custkey", table(spark, sf, "orders"), "o_orderkey", "o_orderkey")


@query("g4_snapshot_rows", "SELECT c_custkey AS entity_key, 1 AS entity_version, 'r' AS op, TIMESTAMP '2024-01-01' AS valid_from, c_nationkey AS nation FROM customer")
def g4(spark, sf):
    t = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return G.snapshot_cdc(t, "c_custkey", "2024-01-01").select("entity_key", "entity_version", "op", "valid_from", F.col("after.c_nationkey").alias("nation"))


_BG = D.subseed(SEED, "background")


def _bg(label):
    return sql_u(f"c_custkey || ':' || {label}", _BG)


@query("g6_w17_background_mutations", f"""SELECT entity_key, day, row_number() OVER w + 1 AS entity_version, coalesce(lag(after) OVER w, f) AS before, after FROM (
    SELECT c_custkey AS entity_key, d::INT AS day, floor({_bg("d || ':value'")} * 1000)::INT AS after, floor({_bg("'first'")} * 1000)::INT AS f FROM customer CROSS JOIN range(30) r(d) WHERE {_bg("d || ':hit'")} < 0.2) WINDOW w AS (PARTITION BY entity_key ORDER BY day)""")
def g6(spark, sf):
    return G.background_mutations(table(spark, sf, "customer"), "c_custkey", 30, 0.2, SEED, "2024-01-01").drop("date")


_RULES = [("customer", 0, 0.05, ["credit"]), ("customer", 1, 0.01, ["credit", "city"]), ("customer", 2, 0.0, ["city"]), ("supplier", 0, 1.0, ["credit"]), ("supplier", 1, 0.3, ["city"]), ("nobody", 0, 0.5, ["city"])]
_SETS = {"city": G.choice(G.CITIES), "credit": G.integer(0, 999)}
#: Every fifth customer is born on day 10, every seventh ends on day 40.
_ENTITIES = """SELECT 'customer' AS entity_type, c_custkey AS entity_key, 'none' AS city, cast(c_nationkey AS bigint) AS credit,
    CASE WHEN c_custkey % 5 = 0 THEN 10 END AS live_from, CASE WHEN c_custkey % 7 = 0 THEN 40 END AS live_until FROM {customer}
    UNION ALL SELECT 'supplier', s_suppkey, 'none', cast(s_nationkey AS bigint), NULL, NULL FROM {supplier}"""


def _hit(label):
    return sql_u(f"entity_type || ':' || rule || ':' || entity_key || ':' || {label}", _BG)


def _set(column, values):
    return sql_u(f"'background:' || entity_type || ':' || rule || ':' || entity_key || ':' || day || ':{column}:0'", _BG) + f" * {values}"


_RULES_SQL = ", ".join(f"('{t}', {n}, {p}::DOUBLE, {a})" for t, n, p, a in _RULES)


@query("g6_mutations_by_rules", f"""WITH rules(entity_type, rule, chance, attributes) AS (VALUES {_RULES_SQL}), entities AS ({_ENTITIES.format(customer="customer", supplier="supplier")}),
    gaps AS (SELECT *, CASE WHEN chance >= 1 THEN 1 ELSE 1 + floor(ln(1 - {_hit("k || ':gap'")}) / ln(1 - chance)) END AS gap FROM entities JOIN rules USING (entity_type) CROSS JOIN range(60) r(k) WHERE chance > 0),
    days AS (SELECT *, (coalesce(live_from, 0) + sum(gap) OVER (PARTITION BY entity_type, entity_key, rule ORDER BY k) - 1)::BIGINT AS day FROM gaps),
    hits AS (SELECT *, epoch_us(TIMESTAMP '2024-01-01') + day * 86400000000 + floor({_hit("day || ':offset'")} * 86400000000)::BIGINT AS us,
        CASE WHEN list_contains(attributes, 'city') THEN ({list(G.CITIES)})[floor({_set("city", len(G.CITIES))})::INT + 1] END AS new_city,
        CASE WHEN list_contains(attributes, 'credit') THEN floor({_set("credit", 1000)})::BIGINT END AS new_credit FROM days WHERE day < least(coalesce(live_until, 60), 60))
    SELECT entity_type, entity_key, row_number() OVER w + 1 AS entity_version, rule, day, make_timestamp(us) AS occurred_at,
        coalesce(last_value(new_city IGNORE NULLS) OVER b, city) AS before_city, coalesce(last_value(new_credit IGNORE NULLS) OVER b, credit) AS before_credit,
        coalesce(last_value(new_city IGNORE NULLS) OVER a, city) AS after_city, coalesce(last_value(new_credit IGNORE NULLS) OVER a, credit) AS after_credit
    FROM hits WINDOW w AS (PARTITION BY entity_type, entity_key ORDER BY us, rule), a AS (PARTITION BY entity_type, entity_key ORDER BY us, rule ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        b AS (PARTITION BY entity_type, entity_key ORDER BY us, rule ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def g6_rules(spark, sf):
    entities = spark.sql(_ENTITIES, customer=table(spark, sf, "customer"), supplier=table(spark, sf, "supplier"))
    rules = spark.createDataFrame(_RULES, "entity_type string, rule int, chance double, attributes array<string>")
    out = G.mutations_by_rules(entities, rules, _SETS, 60, SEED, "2024-01-01")
    images = [F.col(f"{i}.{a}").alias(f"{i}_{a}") for i in ("before", "after") for a in _SETS]
    return out.select("entity_type", "entity_key", "entity_version", "rule", "day", "occurred_at", *images)


_MASS = [20 * DIURNAL[h % 24] * 24 / sum(DIURNAL) for h in range(72)]
_UPTO = [sum(_MASS[:h]) for h in range(73)]
_GAP = sql_u("'arrivals:' || event_id || ':gap:0'", D.subseed(SEED, "arrivals"))


@query("g5_arrivals", f"""SELECT event_id, round((h + (m - ({_UPTO})[h + 1]) / ({_MASS})[h + 1]) * 3600.0, 2) AS second FROM (SELECT event_id, m, len(list_filter({_UPTO[1:]}, lambda b: b <= m)) AS h
    FROM (SELECT event_id, sum(-ln(1 - {_GAP})) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS m FROM events) WHERE m < {_UPTO[-1]!r})""")
def g5(spark, sf):
    df = G.arrivals(table(spark, sf, "events").select("event_id"), F.col("event_id"), 20, DIURNAL, SEED, "2024-01-01", 72)
    micros = F.unix_micros(F.col("arrived_at").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))
    return df.select("event_id", F.round(micros / 1e6 + 5e-7, 2).alias("second"))


@query("d1_custom_generator", f"SELECT c_custkey, {u('x')} * 2 AS x {_C}")
def d1(spark, sf):
    return cust(spark, sf, x=G.custom(lambda s: s * 2, "double"))


_EV = D.subseed(SEED, "events")
_SQL_TYPE = sql_u("event_id || ':type'", _EV)
_SQL_ACTOR = sql_u("'actors:' || event_id || ':fk:0'", KEY)


@query("g7_g8_g10_backfill", f"""SELECT event_id AS row, CASE WHEN {_SQL_TYPE} * 10.0 < 7 THEN 'view' WHEN {_SQL_TYPE} * 10.0 < 9 THEN 'click' ELSE 'purchase' END AS event_type, fk AS actor, row_number() OVER (ORDER BY event_id) AS sequence_no
    FROM (SELECT event_id, floor({_SQL_ACTOR} * (SELECT count(*) FROM customer))::BIGINT AS n FROM (SELECT event_id, sum(-ln(1 - {_GAP})) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS m FROM events) WHERE m < {_UPTO[-1]!r}) JOIN ({_NUM.format(k='c_custkey', t='customer')}) USING (n)""")
def g7(spark, sf):
    arrived = G.arrivals(table(spark, sf, "events").select("event_id").withColumnRenamed("event_id", "row"), F.col("row"), 20, DIURNAL, SEED, "2024-01-01", 72)
    out = G.synth_events(arrived, F.col("row"), {"view": 7, "click": 2, "purchase": 1}, table(spark, sf, "customer"), "c_custkey", "c_custkey", SEED)
    return out.select("row", "event_type", "actor", "sequence_no")


_TYPES = {"view": 7, "click": 2, "purchase": 1}


@query("g9_live_events", f"""SELECT r AS row, CASE WHEN {_SQL_TYPE} * 10.0 < 7 THEN 'view' WHEN {_SQL_TYPE} * 10.0 < 9 THEN 'click' ELSE 'purchase' END AS event_type, fk AS actor, r + 1 AS sequence_no,
    make_timestamp(epoch_us(TIMESTAMP '2024-01-01') + (r * 1000000 // per)) AS occurred_at
    FROM (SELECT *, event_id AS r, floor({_SQL_ACTOR} * (SELECT count(*) FROM customer))::BIGINT AS n FROM (SELECT unnest(range(4 * per)) AS event_id, per FROM (SELECT ceil(count(*) / 4.0)::BIGINT AS per FROM events))) JOIN ({_NUM.format(k='c_custkey', t='customer')}) USING (n)""")
def g9(spark, sf):
    """As many live events as the events table has, a quarter a batch, bound to customers; the stream is stopped after each batch and carried on."""
    sink, mark = S.new_path(spark, "live"), S.new_path(spark, "mark")
    per = -(-table(spark, sf, "events").count() // 4)
    live = T.live_events(spark, max(per, 1), _TYPES, table(spark, sf, "customer").select("c_custkey"), "c_custkey", "c_custkey", SEED, "2024-01-01")
    for _ in range(4):
        T.run_available(live, sink, mark)
    return spark.read.schema(live.schema).parquet(sink).select("row", "event_type", "actor", "sequence_no", "occurred_at")


_BUYER = sql_u("'bought.buyer:' || o_orderkey || ':fk:0'", KEY)


@query("g3_related_tables", f"""WITH bought AS (SELECT o_orderkey, fk AS buyer FROM (SELECT o_orderkey, floor({_BUYER} * (SELECT count(*) FROM customer))::BIGINT AS n FROM orders) JOIN ({_NUM.format(k='c_custkey', t='customer')}) USING (n)),
    paid AS (SELECT payment, fk AS bill FROM (SELECT o_orderkey AS payment, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders WHERE o_orderstatus = 'F') JOIN ({_NUM.format(k='o_orderkey', t='orders')}) USING (n))
    SELECT payment, bill, buyer FROM paid JOIN bought ON bill = o_orderkey""")
def g3(spark, sf):
    """Customers, orders with a drawn buyer, and payments that are one to one with orders."""
    orders = table(spark, sf, "orders")
    made = G.synth_tables(
        {
            "buyers": G.Related(table(spark, sf, "customer").select("c_custkey"), "c_custkey", {"name": G.joined(" ", G.FIRST, G.LAST)}),
            "bought": G.Related(orders.select("o_orderkey"), "o_orderkey", {}, {"buyer": ("buyers", "c_custkey", "uniform")}),
            "paid": G.Related(orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("payment")), "payment", {}, {"bill": ("bought", "o_orderkey", "one_to_one")}),
        },
        SEED,
    )
    return made["paid"].join(made["bought"].withColumnRenamed("o_orderkey", "bill"), "bill").select("payment", "bill", "buyer")
