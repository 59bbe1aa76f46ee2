"""Related tables, background changes and live synthetic rows."""

import hashlib
import hmac
import math
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from eventlab.functions import draws as D
from eventlab.plans import synth as G
from eventlab.streaming import streams as T

COLUMNS = {"name": G.joined(" ", G.FIRST, G.LAST), "n": G.integer(1, 9)}


def related(spark, parents, children, how):
    return {
        "parents": G.Related(spark.range(parents), "id", COLUMNS),
        "children": G.Related(spark.range(children), "id", {}, {"a": ("parents", "id", how), "b": ("parents", "id", "uniform")}),
    }


@pytest.mark.parametrize("how", ["uniform", "zipf", "recent", "one_to_one"])
def test_references_resolve(spark, how):
    made = G.synth_tables(related(spark, 50, 40, how), 3)
    rows = made["children"].collect()
    assert len(rows) == 40 and {x for r in rows for x in (r.a, r.b)} <= set(range(50))
    assert [r.a for r in rows] != [r.b for r in rows]
    if how == "one_to_one":
        assert len({r.a for r in rows}) == 40


def test_references_that_cannot_resolve(spark):
    for parents, children, how in ((0, 5, "uniform"), (3, 5, "one_to_one")):
        with pytest.raises(ValueError):
            G.synth_tables(related(spark, parents, children, how), 3)
    with pytest.raises(ValueError):
        G.synth_tables(dict(reversed(related(spark, 3, 3, "uniform").items())), 3)
    assert G.synth_tables(related(spark, 0, 0, "uniform"), 3)["children"].count() == 0


def test_live_rows_are_those_of_the_table(spark, tmp_path):
    got = []
    live = T.synth_stream(spark, 20, COLUMNS, "t", 3)
    run = live.writeStream.foreachBatch(lambda df, _: got.extend(df.select("row", *COLUMNS).collect())).option("checkpointLocation", str(tmp_path)).start()
    until = time.time() + 60
    while len(got) < 40 and time.time() < until:
        time.sleep(0.2)
    run.stop()
    want = {r.row: r for r in G.synth_table(spark, max(r.row for r in got) + 1, COLUMNS, "t", 3).orderBy(F.col("row")).collect()}
    assert len(got) >= 40 and all(tuple(r) == tuple(want[r.row]) for r in got)


RULES = "entity_type string, rule int, chance double, attributes array<string>"
SETS = {"n": G.integer(1, 9), "city": G.choice(G.CITIES)}


def entities(spark, n, kind="a"):
    return spark.range(n).select(F.lit(kind).alias("entity_type"), F.col("id").alias("entity_key"), F.lit(0).cast("long").alias("n"), F.lit("-").alias("city"))


def slow_days(kind, rule, key, chance, days, seed, born=0):
    k = D.subseed(seed, "background")
    at, i = born - 1, 0
    while True:
        u = int.from_bytes(hmac.new(k, f"{kind}:{rule}:{key}:{i}:gap".encode(), hashlib.sha256).digest()[:8], "big") / 2**64
        at += 1 if chance >= 1 else 1 + math.floor(math.log(1 - u) / math.log(1 - chance))
        i += 1
        if at >= days:
            return
        yield at


@pytest.mark.parametrize("deviations", [6, -100])
def test_days_are_hit_by_geometric_gaps(spark, deviations):
    """With lists of two gaps, most pairs need several, and the days are the same."""
    rules = [("a", 0, 0.3, ["n"]), ("a", 1, 1.0, ["n"]), ("a", 2, 0.0, ["n"]), ("a", 3, None, ["n"]), ("b", 0, 0.5, ["n"])]
    alive = entities(spark, 6).withColumn("live_from", F.when(F.col("entity_key") == 2, 4)).withColumn("live_until", F.when(F.col("entity_key") == 3, 7))
    out = G.hits_of(alive, spark.createDataFrame(rules, RULES), 12, 5, deviations).collect()
    got = sorted((r.rule, r.entity_key, r.day) for r in out)
    want = sorted((n, e, d) for kind, n, p, _ in rules[:2] for e in range(6) for d in slow_days(kind, n, e, p, 7 if e == 3 else 12, 5, 4 if e == 2 else 0))
    assert got == want and len(got) > 60


def test_misses_are_not_made(spark):
    """10^9 days of entities and rules, a hit in 10,000: as many as chance has it, evenly over days."""
    rules = spark.createDataFrame([("a", i, 1e-4, ["n"]) for i in range(5)], RULES)
    n, days = 100_000, 2_000
    made = G.hits_of(entities(spark, n).selectExpr("*", "null AS live_from", "null AS live_until"), rules, days, 3).groupBy("rule", F.floor(F.col("day") / 500).alias("q")).count().collect()
    each = n * 500 * 1e-4
    assert len(made) == 20 and all(abs(r["count"] - each) < 5 * math.sqrt(each) for r in made)


def test_changes_follow_each_other(spark):
    rules = spark.createDataFrame([("a", 0, 0.4, ["n"]), ("a", 1, 0.2, ["n", "city"]), ("a", 2, 0.5, [])], RULES)
    rows = entities(spark, 20).unionByName(entities(spark, 3, None)).withColumn("day", F.lit("clashes"))
    out = G.mutations_by_rules(rows, rules, SETS, 30, 7, "2024-01-01").collect()
    again = G.mutations_by_rules(rows.repartition(5), rules, SETS, 30, 7, "2024-01-01").collect()
    assert Counter(map(str, out)) == Counter(map(str, again)) and len({r.event_id for r in out}) == len(out)
    per = defaultdict(list)
    for r in out:
        per[r.entity_type, r.entity_key].append(r)
        assert r.op == "u" and r.correlation_id == r.event_id and r.causation_id is None
        assert (r.occurred_at - r.occurred_at.replace(year=2024, month=1, day=1, hour=0, minute=0, second=0, microsecond=0)).days == r.day
        assert {0: r.before.city == r.after.city, 1: r.after.city in G.CITIES, 2: r.before == r.after}[r.rule]
    assert {k[0] for k in per} == {"a"}
    for x in per.values():
        x.sort(key=lambda r: r.entity_version)
        assert [r.entity_version for r in x] == list(range(2, len(x) + 2)) and x[0].before == (0, "-")
        assert all(a.after == b.before and a.occurred_at <= b.occurred_at for a, b in zip(x, x[1:]))


def test_rules_that_change_nothing(spark):
    none = spark.createDataFrame([], RULES)
    assert G.mutations_by_rules(entities(spark, 3), none, SETS, 30, 7, "2024-01-01").count() == 0
    some = spark.createDataFrame([("a", 0, 0.4, ["n"])], RULES)
    assert G.mutations_by_rules(entities(spark, 0), some, SETS, 30, 7, "2024-01-01").count() == 0
    with pytest.raises(ValueError, match="size"):
        G.mutations_by_rules(entities(spark, 3), spark.createDataFrame([("a", 0, 0.4, ["size"])], RULES), SETS, 30, 7, "2024-01-01")


def test_many_rules_are_joined(spark, monkeypatch):
    rules = spark.createDataFrame([("a", i, 0.1, ["n"]) for i in range(4)], RULES)
    rows = entities(spark, 50)
    few = G.mutations_by_rules(rows, rules, SETS, 30, 7, "2024-01-01").collect()
    monkeypatch.setattr(G, "BROADCAST_RULES", 3)
    assert Counter(map(str, few)) == Counter(map(str, G.mutations_by_rules(rows, rules, SETS, 30, 7, "2024-01-01").collect()))


def test_live_events_carry_on_where_they_stopped(spark, tmp_path):
    sink, mark = str(tmp_path / "live"), str(tmp_path / "mark")
    live = T.live_events(spark, 50, {"x": 1, "y": 3}, spark.range(7), "id", "id", 3, "2024-01-01")
    for _ in range(3):
        T.run_available(live, sink, mark)
    rows = sorted(spark.read.parquet(sink).collect(), key=lambda r: r.row)
    assert [r.sequence_no for r in rows] == list(range(1, 151)) and len({r.event_id for r in rows}) == 150
    assert {r.actor for r in rows} == set(range(7)) and {r.event_type for r in rows} == {"x", "y"}
    assert (rows[-1].occurred_at - rows[0].occurred_at).total_seconds() == pytest.approx(149 / 50)
    T.run_available(T.live_events(spark, 50, {"x": 1}, spark.range(0), "id", "id", 3, "2024-01-01"), sink + "0", mark + "0")
    assert spark.read.schema(live.schema).parquet(sink + "0").count() == 0
