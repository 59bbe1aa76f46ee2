import random
import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from eventlab.operators import ranges
from eventlab.operators.checks import version_as_of
from eventlab.operators.ranges import as_of, interval_join, with_lag, with_running


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def keyed(spark, n=3000):
    key = F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 == 8, F.lit(None)).otherwise(F.col("id").cast("string"))
    return spark.range(n).select(key.alias("k"), F.col("id"), (F.col("id") * 7919 % 101).alias("v"))


def test_a_hot_key_is_cut_and_rows_move_once(spark, monkeypatch):
    monkeypatch.setattr(ranges, "PART_ROWS", 300)
    df = keyed(spark)
    parts = ranges.in_parts(df, ["k"], ["v", "id"])
    n = {r.k: r.n for r in parts.groupBy("k").agg(F.count_distinct("_part").alias("n")).collect()}
    assert n["hot"] > 4 and max(v for k, v in n.items() if k not in ("hot", None)) == 1
    w = Window.partitionBy("k").orderBy("v", "id")
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    some = F.when(F.col("id") % 5 == 0, F.col("id"))
    want = df.select("k", "id", F.lag("v").over(w), F.sum("v").over(up), F.max("id").over(up), F.last(some, ignorenulls=True).over(up))
    got = with_lag(df, ["k"], ["v", "id"], "v", "a")
    for kind, value, name in (("sum", F.col("v"), "b"), ("max", F.col("id"), "c"), ("last", some, "d")):
        got = with_running(got, ["k"], ["v", "id"], value, kind, name)
    rows = lambda x: sorted(map(tuple, x.collect()), key=lambda r: r[1])
    assert rows(got.select("k", "id", "a", "b", "c", "d")) == rows(want)


def test_one_exchange_of_the_rows(spark):
    """Without a hot key there is one exchange of all rows; the others carry a row for each key."""
    df = spark.range(1000).select((F.col("id") % 50).alias("k"), F.col("id").alias("o"), F.lit("wide text").alias("pad"))
    out = with_running(df, ["k"], ["o"], F.col("o"), "sum", "s")
    assert out.count() == 1000 and len(re.findall("REPARTITION_BY_COL", plan(out))) == 1
    # the others are those of grouped rows: under each is an aggregate that combines, or a row for each key and part
    wide = [line for line in re.findall(r"Exchange [^\n]*\n[^\n]*", plan(out)) if "REPARTITION_BY_COL" not in line]
    assert wide and all("HashAggregate" in w or "Project" in w or "SortAggregate" in w for w in wide)


def test_as_of_against_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(ranges, "PART_ROWS", 100)
    left = [(k, rng.choice(["a", "b", "c", None]), rng.choice([None, *range(60)])) for k in range(600)]
    right = [(rng.choice(["a", "a", "b", None, "d"]), rng.randrange(60), k, f"v{k}") for k in range(300)]
    a = spark.createDataFrame(left, "id long, k string, t long")
    b = spark.createDataFrame(right, "k string, at long, n long, v string")
    got = {r.id: r.v for r in as_of(a, b, ["k"], "t", "at", ["v"], ["n"]).collect()}
    want = {}
    for i, k, t in left:
        found = [(at, n, v) for rk, at, n, v in right if rk == k and t is not None and at <= t]
        want[i] = max(found)[2] if found else None
    assert got == want
    every = as_of(a, b, [], "t", "at", ["v"], ["n"]).where("t is not null").collect()
    assert all(r.v == max(((at, n, v) for _, at, n, v in right if at <= r.t), default=(0, 0, None))[2] for r in every)
    assert "collect_list" not in plan(as_of(a, b, ["k"], "t", "at", ["v"], ["n"]))


def test_many_upgrades_of_one_subject(spark, monkeypatch):
    """A million upgrades of one subject, and no list of them anywhere."""
    n = 1_000_000
    ups = spark.range(n).select(F.lit("s").alias("subject"), (F.col("id") * 10).alias("at"), (F.col("id") + 2).cast("int").alias("to_version"))
    events = spark.range(2000).select(F.col("id").alias("event_id"), F.lit("s").alias("subject"), (F.col("id") * 5000 + 5).alias("occurred_at"))
    pins = spark.createDataFrame([("s", 1)], "subject string, pin int")
    out = version_as_of(events, pins, ups)
    assert "collect_list" not in plan(out)
    assert all(r.version == r.occurred_at // 10 + 2 for r in out.collect())
    assert version_as_of(events.withColumn("subject", F.lit("other")), pins, ups).where("version is not null").count() == 0


def test_interval_join(spark):
    rng = random.Random(3)
    cuts = sorted(rng.uniform(0, 100) for _ in range(40))
    spans = [(k, a, b) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))] + [(100, 5.0, 5.0), (101, 0.0, 100.0)]
    points = [(k, rng.uniform(-5, 105)) for k in range(500)] + [(1000, cuts[3])]
    p, i = spark.createDataFrame(points, "id long, x double"), spark.createDataFrame(spans, "span long, low double, high double")
    got = sorted((r.id, r.span) for r in interval_join(p, "x", i, "low", "high", 1.7).collect())
    assert got == sorted((k, s) for k, x in points for s, a, b in spans if a <= x < b)


def test_zipf_and_weights(spark):
    """Shares follow 1 / rank^s, for a hot first key too, and keys without weight are never drawn."""
    from eventlab.plans.synth import sample_fk

    target = spark.range(1, 51).select(F.col("id").alias("k"), F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(0).alias("w"))
    rows = spark.range(20_000)
    for s in (0.5, 1.0, 2.0):
        n = {r.fk: r.n for r in sample_fk(rows, F.col("id"), target, "k", "k", "t", 1, "zipf", s=s).groupBy("fk").agg(F.count("*").alias("n")).collect()}
        total = sum(k**-s for k in range(1, 51))
        assert sum(n.values()) == 20_000
        assert all(abs(n.get(k, 0) / 20_000 - k**-s / total) < 0.015 for k in range(1, 51))
    n = {r.fk: r.n for r in sample_fk(rows, F.col("id"), target, "k", "k", "t", 1, "weighted", weight="w").groupBy("fk").agg(F.count("*").alias("n")).collect()}
    assert sum(n.values()) == 20_000 and all(k % 2 == 0 and abs(v / 20_000 - k / 650) < 0.01 for k, v in n.items())
