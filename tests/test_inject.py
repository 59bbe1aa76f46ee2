"""Injection: the same in any partitioning, and every deviation has its record."""

import pytest
from pyspark.sql import functions as F

from eventlab.operators import checks as K
from eventlab.plans import inject as I
from eventlab.queries.inject import SEED, truth
from eventlab.sources.tables import cut

ALL = {m: {"rate": 0.2} for m in I.MODES}
MENU = {"purchase": {"region": '"north"'}}


def rows(df):
    cols = [c for c in df.columns if c not in ("payload", "records")]
    return sorted(map(str, df.withColumn("_p", F.to_json("payload")).select(*cols, "_p").collect()))


def test_any_partitioning(spark, sf_dir):
    clean = cut(truth(spark, sf_dir).where("id < 400"))
    want = rows(I.label(clean, ALL, SEED, MENU))
    for df in (clean.repartition(1), clean.repartition(16, F.rand(3))):
        assert rows(I.label(df, ALL, SEED, MENU)) == want
    assert rows(I.label(clean, ALL, SEED + 1, MENU)) != want


@pytest.mark.parametrize("modes", [(), ("missing",), ("duplicates", "nulls"), ("corrupted_values", "schema_drift", "late_arriving"), I.MODES])
def test_reconciles(spark, sf_dir, modes):
    clean = cut(truth(spark, sf_dir).where("id < 400").withColumn("text", F.to_json("payload")))
    labelled = cut(I.label(clean, {m: {"rate": 0.25} for m in modes}, SEED, MENU))
    feed = I.delivered(labelled).withColumn("text", F.to_json("payload"))
    held = I.late(labelled).withColumn("text", F.to_json("payload")).drop("due_at")
    found = K.reconcile(clean, feed, held, ("text",)).groupBy("problem").agg(F.collect_set("event_id").alias("ids")).collect()
    found = {r.problem: set(r.ids) for r in found}
    per = {}
    for r in I.records(labelled, SEED).select("mode", "event_id", "injection_id").collect():
        per.setdefault(r.mode, set()).add(r.event_id)
    assert set(per) <= set(modes)
    assert found.get("missing", set()) == per.get("missing", set())
    assert found.get("repeated", set()) == per.get("duplicates", set())
    assert found.get("changed", set()) == per.get("corrupted_values", set()) | per.get("nulls", set()) | per.get("schema_drift", set())
    assert "unknown" not in found
    ids = [r.injection_id for r in I.records(labelled, SEED).collect()]
    assert len(ids) == len(set(ids))


def test_odd_input(spark, sf_dir):
    clean = truth(spark, sf_dir)
    assert I.label(clean.limit(0), ALL, SEED).count() == 0
    one = clean.where("id = 1")
    assert I.label(one, {"missing": {"rate": 1}}, SEED).where("missing").count() == 1
    assert I.delivered(I.label(one, {"duplicates": {"rate": 1, "weights": [0, 0, 1]}}, SEED)).count() == 4
    empty = one.withColumn("payload", F.create_map().cast("map<string,string>"))
    assert I.records(I.label(empty, {"nulls": {"rate": 1}, "corrupted_values": {"rate": 1, "fields": 4}}, SEED), SEED).count() == 0
    same = clean.withColumn("occurred_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    assert I.label(same, {"out_of_order": {"rate": 0.5}}, SEED).count() == clean.count()
    for bad in ({"unheard_of": {}}, {"missing": {"rate": 2}}, {"nulls": {"fields": 9}}):
        with pytest.raises(ValueError):
            I.label(one, bad, SEED)


def test_presets(spark, sf_dir):
    clean = cut(truth(spark, sf_dir))
    for name, policy in I.PRESETS.items():
        I.check_policy(policy)
        found = I.records(I.label(clean, policy, SEED, MENU), SEED).groupBy("mode").count().collect()
        assert {r["mode"] for r in found} <= set(policy), name
    assert I.PRESETS.keys() == {"dedup_101", "late_data_30min", "out_of_order_60s", "dlq_mix", "drift_day", "consumer_group_spice"}


def test_selectors(spark, sf_dir):
    clean = cut(truth(spark, sf_dir).where("id < 200"))
    n = clean.count()

    def hits(**policy):
        return I.records(I.label(clean, policy, SEED, MENU), SEED).count()

    assert hits(missing={"rate": 1, "types": ["*"]}) == n and hits(missing={"rate": 1, "types": []}) == 0
    assert hits(nulls={"rate": 1, "paths": []}) == 0 and hits(nulls={"rate": 1, "paths": ["k"], "fields": 4}) == n
    assert hits(corrupted_values={"rate": 1, "kinds": []}) == 0 and hits(schema_drift={"rate": 1, "paths": ["other"]}) == 0
    held = I.label(clean, {"late_arriving": {"rate": 1, "max_delay": 100}}, SEED)
    assert I.records(held, SEED).agg(F.max("delay_ms")).first()[0] == 100_000


def test_copies_right_after(spark, sf_dir):
    clean = truth(spark, sf_dir).where("id < 50")
    placed = I.place_copies(I.label(clean, {"duplicates": {"rate": 1}}, SEED), 0, SEED)
    assert placed.where("place <> sequence_no").count() == 0


def test_dear_draws_are_dealt_over_all_tasks(spark):
    """Rows of one file, or of few windows, are not one task's; what several read of the order mode is made once."""
    from eventlab.plans import synth as G

    df = spark.range(100).coalesce(1).select(F.concat(F.lit("e"), "id").alias("event_id"), F.lit("view").alias("event_type"), F.create_map(F.lit("k"), F.lit("1")).alias("payload"))
    assert I.label_content(df, {"missing": {"rate": 0.5}}, 7).rdd.getNumPartitions() > 8
    people = spark.range(100).coalesce(1).withColumnRenamed("id", "c")
    assert "Repartition" in G.background_mutations(people, "c", 30, 0.2, 7, "2024-01-01")._jdf.queryExecution().optimizedPlan().toString()
