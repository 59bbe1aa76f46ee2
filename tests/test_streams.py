import datetime
import random
import tempfile

import pandas as pd


from eventlab.operators.checks import sequence_gaps
from eventlab.sources.tables import new_path
from eventlab.streaming import streams as T


def steps(spark, parts, schema):
    """A stream that takes one of ``parts`` a batch."""
    path = new_path(spark, "steps")
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(sdf, sink, mark=None):
    q = sdf.writeStream.format("parquet").option("path", sink).option("checkpointLocation", mark or tempfile.mkdtemp()).trigger(availableNow=True).start()
    q.awaitTermination()
    return [p["stateOperators"][0] for p in q.recentProgress if p["stateOperators"]]


def test_reorder_writes_its_own_rows_only(spark):
    """One stream, all of it held to the end: what a batch writes to the state is what came, not what is held."""
    n, each = 8, 2000
    at = lambda k: f"timestamp_millis({1_700_000_000_000} + {k})"
    path = new_path(spark, "steps")
    for b in range(n):
        spark.range(b * each, (b + 1) * each, 1, 1).selectExpr("'s' as stream_id", "concat('e', id) as event_id", f"id * 7919 % {n * each} as sequence_no", f"{at('id * 10')} as occurred_at").write.mode("append").parquet(path)
    for k, late in ((1, 10**9), (2, 2 * 10**9)):
        spark.range(1).coalesce(1).selectExpr("'s' as stream_id", f"'end{k}' as event_id", f"{10**9 + k} as sequence_no", f"{at(late)} as occurred_at").write.mode("append").parquet(path)
    sdf = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    sink = new_path(spark, "out")
    ops = run(T.stream_reorder(sdf, "stream_id", "occurred_at", "sequence_no", "10 days", "20 seconds"), sink)
    wrote = [o["numRowsUpdated"] for o in ops][:n]
    assert max(wrote) < 1.5 * each and wrote[-1] < 1.5 * wrote[0]
    out = T.placed(spark.read.parquet(sink)).where("event_id not like 'end%'").orderBy("place").collect()
    assert [r.place for r in out] == list(range(1, n * each + 1))
    want = sorted(range(n * each), key=lambda i: (i // 2000, i * 7919 % (n * each)))  # buckets of 20 s, in order inside
    assert [r.event_id for r in out] == [f"e{i}" for i in want]


def test_gaps_with_late_and_repeated_numbers(spark):
    rng = random.Random(5)
    batches = []
    for _ in range(6):
        batches.append([(f"s{rng.randrange(2)}", rng.randrange(2), rng.randrange(1, 60)) for _ in range(25)])
    batches.insert(3, [("s0", 0, None)])
    schema = "stream_id string, shard_id int, sequence_no long"
    sink, mark = new_path(spark, "out"), tempfile.mkdtemp()
    path = new_path(spark, "steps")
    for k, rows in enumerate(batches):  # a run for each batch on one checkpoint, as after restarts
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        run(T.gap_monitor(spark.readStream.schema("stream_id string, shard_id int, sequence_no long").parquet(path), 7), sink, mark)
        so_far = spark.createDataFrame([r for b in batches[: k + 1] for r in b if r[2] is not None], schema)
        want = sorted(map(tuple, sequence_gaps(so_far).collect()))
        assert sorted(map(tuple, T.open_gaps(spark.read.parquet(sink)).collect())) == want
    assert spark.read.parquet(sink).where("kind = 'close'").count() > 5


def test_hold_lets_go_when_due(spark):
    at = lambda m, s=0: datetime.datetime(2024, 1, 1, 0, m, s)
    rows = [(f"e{k}", at(k)) for k in range(50)]
    sink = new_path(spark, "out")
    sdf = steps(spark, [rows[:30], rows[30:], [("end", at(48, 30))], [("end", at(48, 40))]], "event_id string, due timestamp")
    run(T.stream_hold(sdf, "due", "0 seconds"), sink)
    # the watermark stands at the last due time, 49 minutes, so only what is due before that minute is out
    out = {r.event_id for r in spark.read.parquet(sink).collect()}
    assert out - {"end"} == {f"e{k}" for k in range(49)}


def test_windows_of_state_are_bounded(spark):
    """A run of numbers without a gap is one interval, however long."""
    state = []

    class Value:
        def exists(self):
            return bool(state)

        def get(self):
            return state[-1]

        def update(self, v):
            state.append(v)

    p = T._Intervals()
    p.seen = Value()
    for part in ([3, 1], [2, 9], [4, 5, 6, 7, 8], [1, 9]):
        (out,) = p.handleInputRows(("s", 0, 0), iter([pd.DataFrame({"sequence_no": part})]), None)
        last = out
    assert state[-1][:2] == ([1], [9]) and len(last) == 0



def test_a_batch_takes_whole_steps(spark, sf_dir, monkeypatch):
    """Steps of several files, and a table whose numbers don't follow time: no row of a step is late."""
    from eventlab.fixtures import env
    from eventlab.queries import streams as Q

    monkeypatch.setattr(Q, "FILE_ROWS", 90)
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    path = new_path(spark, "copies")
    e.unionByName(e.selectExpr("event_id + 10000000 as event_id", "ts", "user_id + 1000000 as user_id", *e.columns[3:])).coalesce(1).write.parquet(f"{path}/events.parquet")
    got = {(r.key, r.event_id, r.place) for r in Q.t4(spark, path).collect()}
    assert got == {(r.stream_id, r.event_id, r.sequence_no) for r in env(spark, path).collect()}


def test_ranges_of_a_block_are_told_apart():
    """Many ranges come in one call of the state, and their gaps and ends are those of each range."""
    state = []
    p = T._Intervals(5)
    p.seen = type("Value", (), {"exists": lambda s: bool(state), "get": lambda s: state[-1], "update": lambda s, v: state.append(v)})()
    told = []
    for part in ([1, 4, 5, 6, 12], [2, 8], [3]):
        (out,) = p.handleInputRows(("s", 0, 0), iter([pd.DataFrame({"sequence_no": part})]), None)
        told.append(sorted(zip(out.kind, out.part, out.gap_from, out.gap_to)))
    assert told == [[("ends", 0, 1, 5), ("ends", 1, 6, 6), ("ends", 2, 12, 12), ("open", 0, 2, 3)], [("close", 0, 2, 3), ("ends", 1, 6, 8), ("open", 0, 3, 3), ("open", 1, 7, 7)], [("close", 0, 3, 3)]]
    assert state[-1][:2] == ([1, 6, 8, 12], [5, 6, 8, 12])
