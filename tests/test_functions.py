import hashlib
import hmac
import statistics

import pytest
from pyspark.sql import functions as F

from eventlab.functions import draws as D
from eventlab.functions import values as V
from eventlab.operators import rows as R
from eventlab.operators import stats as A
from eventlab.sources import tables as S


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()[0]


def test_hmac_is_pythons(spark):
    key = D.subseed(42, "chaos")
    for message in ("missing:ev_1:select", "", "ä" * 200):
        want = hmac.new(key, message.encode(), hashlib.sha256)
        assert one(spark, D.hmac_hex(key, F.lit(message))) == want.hexdigest()
        assert one(spark, D.unit(D.hmac_hex(key, F.lit(message)))) == int.from_bytes(want.digest()[:8], "big") / 2**64


def test_inverse_normal(spark):
    for u in (1e-9, 0.001, 0.02, 0.3, 0.5, 0.77, 0.98, 0.999999):
        assert one(spark, D.inverse_normal(F.lit(u))) == pytest.approx(statistics.NormalDist().inv_cdf(u), abs=1e-6)


def test_distributions_are_clamped(spark):
    assert one(spark, D.dist("exponential", F.lit(1.0), mean=1e9)) == D.YEAR_S
    assert one(spark, D.dist("uniform", F.lit(0.0), min=-5, max=1)) == 0.0
    with pytest.raises(ValueError):
        D.dist("unheard_of", F.lit(0.5))


def test_uuid7_is_valid(spark):
    import uuid

    x = uuid.UUID(one(spark, D.uuid7(F.lit(1704067200000), F.sha2(F.lit("a"), 256))))
    assert x.version == 7 and x.variant == uuid.RFC_4122 and x.int >> 80 == 1704067200000


def test_values(spark):
    assert V.duration_seconds("P1DT2H3M4.5S") == 93784.5
    for bad in ("", "P", "1D", "PX"):
        with pytest.raises(ValueError):
            V.duration_seconds(bad)
    k, ok = V.partition_key(F.lit("a"), F.lit("b:c"))
    assert one(spark, ok) is False and one(spark, V.partition_key(F.lit("a"), F.lit(""))[1]) is False and one(spark, V.partition_key(F.lit("a"), F.lit("x" * 300))[1]) is False
    assert one(spark, V.predicate(F.lit("abc"), "gt", 5)) is False and one(spark, V.predicate(F.lit("7.5"), "gt", 5)) is True
    assert one(spark, V.predicate(F.lit(None).cast("string"), "ne", "a")) is True
    assert one(spark, V.within(F.lit("no time"), F.lit("2024-01-01"), "P1D")) is False
    for kind, types in V.CORRUPTIONS.items():
        sample = {"decimal": '"1.50"', "integer": "7", "number": "1.5", "string": '"abc"', "boolean": "true", "datetime": '"2024-01-05T10:00:00Z"', "enum": '"x"'}[types[0]]
        assert one(spark, V.corrupt(F.lit(sample), F.lit(kind))) != sample, kind


def test_strip_internal(spark):
    df = spark.createDataFrame([(1, 2)], "a int, _df_note int")
    assert R.strip_internal(df, ["a"]).columns == ["a"]
    with pytest.raises(ValueError, match="missing"):
        R.strip_internal(df, ["a", "b"])


def test_zero_denominators(spark):
    df = spark.createDataFrame([], "event_type string")
    row = A.funnel(df, [("e", "a", "b", 0.1, 0.2, 5)]).first()
    assert row.verdict == "INSUFFICIENT" and row.ratio is None
    assert A.conversion(df, "a", "b").first().pct is None


def test_nearest_rank(spark):
    values = [5, 1, 4, 2, 3, 3, None]
    df = spark.createDataFrame([(v,) for v in values], "v int")
    for p in (0, 0.5, 0.9, 1):
        data = sorted(v for v in values if v is not None)
        assert A.percentile_nearest(df, "v", p).first()[0] == data[int(p * (len(data) - 1) + 0.5)]


def test_nearest_rank_of_keys(spark):
    rows = [(k, v) for k in ("a", "b", None) for v in range(200)] + [("c", None)]
    got = A.percentile_nearest(spark.createDataFrame(rows, "k string, v int"), "v", 0.9, "k").collect()
    assert {(r.k, r.v) for r in got} == {("a", 179), ("b", 179), (None, 179)}


def test_median_and_p95(spark):
    for n in (1, 2, 7, 100):
        row = A.latency_check(spark.range(n).select(F.col("id").cast("double").alias("v")), "v", (0, 1), (0, 1)).first()
        assert row["median"] == statistics.median(range(n)) and row.p95 == int(0.95 * (n - 1) + 0.5)
    assert A.latency_check(spark.range(0).select(F.col("id").alias("v")), "v", (0, 1), (0, 1)).first()["median"] is None


def test_append_twice(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string")
    path = S.new_path(spark, "append")
    for _ in range(2):
        out = S.append_idempotent(df, path, ["k"])
    assert sorted(r.k for r in out.collect()) == [1, 2]


def test_entry_without_the_corpus_package():
    """The driver's contract holds where the corpus package and pipeline are gone."""
    import subprocess
    import sys

    code = "import sys; sys.modules['eventlab.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e\nassert len(e.queries()) > 150 and not any(n.startswith('op') for n in e.queries()) and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True)
