import hashlib
from collections import defaultdict

import duckdb

from eventlab.llm import linededup
from eventlab.llm.linededup import ORACLE_SQL, dedup_lines, holders


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def brute(rows):
    holders = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 20 and len(holders[key(x)] - {None}) >= 3 and d != max(holders[key(x)] - {None}))]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in df.collect()), key=str)


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = brute(rows)
    assert got(dedup_lines(docs)) == want
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert sorted(db.execute(ORACLE_SQL).fetchall(), key=str) == want
    assert sum(w[2] for w in want) > 0


def test_odd_rows(spark):
    line, other = "A line of twenty chars or more", "Ä second line that is long enough"
    rows = [
        (1, line), (2, f" {line.upper()}\t\nshort\n\n"), (3, f"{line}\nx\n{line}\r"), (None, line), (4, None), (5, ""), (6, "\n"),
        (7, other), (7, other), (7, f"{other}\n{other}"), (8, other), (9, "z" * 200_000), (10, "exactly nineteen ch"), (11, "exactly nineteen ch"), (12, "exactly nineteen ch"),
        (3, f"{line}\nx\n{line}\r"), (2, "another text of two"),
    ]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, t1 int, runs string")
    assert got(dedup_lines(df)) == brute(rows)
    assert got(dedup_lines(df.limit(0))) == []


def test_a_line_in_every_document(spark):
    rows = [(i, f"own line number {i} of this document\nthis line is in each of the documents\n") for i in range(3000)]
    assert got(dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))) == brute(rows)


def test_lines_are_streamed_in_order(spark):
    """The plan has the range exchange, the sort by line, document and position, and aggregates that need their order."""
    rows = spark.createDataFrame([(1, 1, 5, 0)], "k1 long, k2 long, doc_id long, pos int")
    plan = holders(rows, 3)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(k1" in plan and "HashAggregate" not in plan and plan.count("SortAggregate") == 4
    first = plan[: plan.index("rangepartitioning")].rindex("Sort [k1")
    assert "pos" in plan[first : plan.index("]", first)], plan


def test_texts_that_lose_nothing_are_not_shuffled(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "x" * 30), (2, "y")], "doc_id long, text string")
    monkeypatch.setattr(linededup, "MAP_BITS", 6)  # everything may lose lines: same result
    rows = [(i, f"own line number {i} of this document\nthis line is in each of the documents\n") for i in range(30)] + [(50, "a"), (None, None)]
    assert got(dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    assert got(dedup_lines(docs)) == brute([tuple(r) for r in docs.collect()])
