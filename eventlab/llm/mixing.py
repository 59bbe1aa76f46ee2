"""Mixing sources to target weights with the cube method.

Each source gets a target of words; its documents are taken ``target / size``
times on average.  The whole part of that is taken of every document.  The rest
is an inclusion probability, and the cube method decides it: in the flight,
probabilities move at random along the null space of the constraints (words and
documents of the source stay as they are in sum) until one is 0 or 1, again and
again.  Of the ``WINDOW`` documents that fly together the largest moves, and the others
balance it by a little each, so large documents are decided first.  The last and smallest
``LANDING`` of any run of documents are left undecided; those of many runs fly again together, until one
run of each source is left.  Its last ones are the landing problem: of all ways to take them one is drawn, from the
distribution that favours ways near to the totals as much as each document's probability allows.
So every step keeps each document's probability as the mean.  A document that is larger than those that could balance it together
stays undecided up to the landing, and its source's words are then as near as its probability lets them be.

A run is a block of a source: documents by hash, about ``BLOCK`` in each, so a
source with a third of all rows is spread over many tasks; rows that are equal in doc_id, source and size are
counted, and their number is split over blocks.  A task streams
its blocks in sorted order, the largest documents first, holding ``WINDOW`` of them at a time.  The draws depend
on (seed, level, source, block) and the order on the rows alone: reruns and other
partitionings agree.
"""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlab.llm.tables import cut, words_of

BLOCK = 4096
#: Blocks of one level whose leftovers fly together on the next.
FAN = 1024
#: Documents that fly together.
WINDOW = 64
#: Documents of a run that are left for the next level or land together, and the weight of missing the words by their mean size.
LANDING, NEARNESS = 12, 6.0


def source_targets(sized: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, n_docs, target) from rows (source, size).

    Sources in order of code points, null last, have the weights in turn; together
    they get ``share`` of all sizes.  No target is over ``most`` times its source;
    what that leaves goes to the others by weight until none is over.  That is a
    level: each target is the lesser of level x weight and its bound, and the
    bounds that are met first are those with the least bound / weight.
    One row per source: the windows over all sources read that table alone.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    per = per.withColumn("rank", rank).withColumn("weight", weight).withColumn("bound", most * F.col("source_size"))
    order = Window.orderBy((F.col("bound") / F.col("weight")), "rank").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    per = per.withColumn("goal", share * F.sum("source_size").over(every)).withColumn("all_weight", F.sum("weight").over(every))
    per = per.withColumn("met", F.sum("bound").over(order)).withColumn("rest", F.col("all_weight") - F.sum("weight").over(order))
    full = F.col("met") + F.col("bound") / F.col("weight") * F.col("rest") <= F.col("goal")
    per = per.withColumn("full", full)
    left = F.col("goal") - F.sum(F.when(F.col("full"), F.col("bound")).otherwise(0.0)).over(every)
    open_weight = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(every)
    target = F.when(F.col("full"), F.col("bound")).otherwise(F.least(F.col("bound"), left / open_weight * F.col("weight")))
    return per.select("source", "source_size", "n_docs", F.coalesce(target, F.lit(0.0)).alias("target"))


def _direction(s: np.ndarray, p: np.ndarray) -> np.ndarray | None:
    """A move that keeps number and words of the documents, of which the first moves most where others can balance it; None if there is none.

    The others share what balances it by p (1 - p), so those with room move and those near 0 or 1 hardly do.
    """
    v = np.zeros(len(s))
    if len(s) < 2:
        return None
    w, d = (p * (1 - p))[1:], s[1:] - s[0]
    if not d.any():
        v[0], v[1:] = 1.0, -w / w.sum()
    elif (d == d[0]).all():  # the first document has no balance, the others have
        if len(s) == 2:
            return None
        v[1], v[2] = 1.0, -1.0
    else:
        d = d / np.abs(d).max()
        m0, m1, m2 = w.sum(), w @ d, w @ (d * d)
        det = m0 * m2 - m1 * m1
        if len(s) == 3 or det <= 1e-9 * m0 * m2:  # two sizes that are far apart from the rest's weights: three documents are enough
            other = int(np.argmax(d != d[0])) + 1
            v[0], v[1], v[other] = s[other] - s[1], s[0] - s[other], s[1] - s[0]
        else:
            v[0], v[1:] = 1.0, -w * (m2 - m1 * d) / det
    return v


def _move(s: np.ndarray, p: np.ndarray, u: float) -> np.ndarray | None:
    """Probabilities after a move that makes one of them 0 or 1; each keeps its mean over ``u``.  None if nothing can move."""
    v = _direction(s, p)
    if v is None:
        return None
    on = np.flatnonzero(v)
    rate, room = np.abs(v[on]), p[on]
    up, down = np.where(v[on] > 0, 1 - room, room) / rate, np.where(v[on] > 0, room, 1 - room) / rate
    a, b = int(up.argmin()), int(down.argmin())
    rises = u * (up[a] + down[b]) < down[b]
    step, at = (up[a], on[a]) if rises else (-down[b], on[b])
    p = p + step * v
    p[at] = 1.0 if (v[at] > 0) == rises else 0.0
    p[p < 1e-9] = 0.0
    p[p > 1 - 1e-9] = 1.0
    return p


def _design(s: list[float], p: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """All ways to take documents (rows of 0 and 1) and how likely each is: near ones most, and ``p`` the mean of all.

    Ways are weighted by their distance and by a factor for each document; the factors are fitted in turn until the means agree.
    """
    size, want = np.array(s), np.array(p)
    ways = (np.arange(1 << len(p))[:, None] >> np.arange(len(p)) & 1).astype(float)
    off = NEARNESS * np.abs((ways - want) @ size) / max(size.mean(), 1.0) + 2 * (ways - want).sum(1) ** 2
    log = ways @ np.log(want / (1 - want)) - off
    for _ in range(200):
        worst = 0.0
        for k in range(len(p)):
            q = np.exp(log - log.max())
            mean = min(max(float(q @ ways[:, k] / q.sum()), 1e-12), 1 - 1e-12)
            worst = max(worst, abs(mean - want[k]))
            log += ways[:, k] * (np.log(want[k] / (1 - want[k])) - np.log(mean / (1 - mean)))
        if worst < 1e-4:
            break
    q = np.exp(log - log.max())
    return ways, q / q.sum()


def _land(s: list[float], p: list[float], u: float) -> list[float]:
    ways, q = _design(s, p)
    return ways[min(int(np.searchsorted(np.cumsum(q), u, side="right")), len(ways) - 1)].tolist()


def _flight(seed: int, level: int, land: bool):
    """A function for mapInPandas over rows sorted by source, block and size, the largest first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, rng, held, out = None, random.Random(), [], []

        def fly(most: int) -> None:
            """Decide the largest documents held until ``most`` are left or none can move."""
            nonlocal held
            while len(held) > most:
                p = _move(np.array([h[2] for h in held], float), np.array([h[4] for h in held]), rng.random())
                if p is None:
                    break
                held = [(*h[:4], q) for h, q in zip(held, p.tolist())]
                out.extend(h for h in held if h[4] in (0.0, 1.0))
                held = [h for h in held if h[4] not in (0.0, 1.0)]

        def close() -> None:
            nonlocal held
            fly(LANDING)
            if land and held:
                held = [(*h[:4], e) for h, e in zip(held, _land([float(h[2]) for h in held], [h[4] for h in held], rng.random()))]
            out.extend(held)
            held = []

        for pdf in batches:
            sources = pdf["source"].astype(object).where(pdf["source"].notna(), None).tolist()
            ids = pdf["doc_id"].astype(object).where(pdf["doc_id"].notna(), None).tolist()
            for row in zip(ids, sources, pdf["size"].tolist(), pdf["block"].tolist(), pdf["p"].tolist()):
                if (row[1], row[3]) != group:
                    close()
                    group = (row[1], row[3])
                    rng.seed(f"{seed}:{level}:{row[1]!r}:{row[3]}")
                held.append(row)
                fly(WINDOW)
            yield frame(out)
            out = []
        close()
        yield frame(out)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        cols = list(zip(*rows)) or [()] * 5
        types = ("Int64", "object", "int64", "int64", "float64")
        return pd.DataFrame({n: pd.array(list(c), dtype=t) if t != "object" else pd.Series(list(c), dtype=t) for n, c, t in zip(("doc_id", "source", "size", "block", "p"), cols, types)})

    return run


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 1) -> DataFrame:
    """One row for each row: doc_id, source, size, source_size, target, copies, taken.

    Takes doc_id, text and source; other columns are ignored.  ``size`` is the
    number of words (null: 0), ``copies`` how often the mix takes the document (its
    source's ``target / source_size``, rounded down or up), ``taken`` is
    ``size * copies``.  A null source is a source.  A source without words has target 0.
    Rows that repeat are decided one by one.  An empty table gives an empty table.
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.size(words_of(F.col("text").cast("string"))).cast("long").alias("size"))
    sized = cut(sized, "sized")
    targets = cut(source_targets(sized, weights, share, most), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = targets.select(
        F.col("source").alias("_source"), "source_size", "target", F.floor(ratio + 1e-12).alias("base"), F.greatest(F.lit(0.0), ratio - F.floor(ratio + 1e-12)).alias("part"), F.ceil(F.col("n_docs") / BLOCK).alias("blocks")
    )

    def planned(df: DataFrame, *columns) -> DataFrame:
        return df.join(plan, df["source"].eqNullSafe(F.col("_source"))).select("doc_id", "source", "size", *columns)

    rows = planned(sized, F.col("part").alias("p"), "blocks")
    whole = rows.where(F.col("p") == 0).select("doc_id", "source", "size", F.lit(0.0).alias("p"))
    # equal rows are one row with a number, split into parts of BLOCK that go to blocks of their own
    equal = rows.where(F.col("p") > 0).groupBy("doc_id", "source", "size", "p", "blocks").count()
    equal = equal.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("count") - 1) / BLOCK))))
    spot = F.xxhash64(F.lit(seed), "doc_id", "size", "nth")
    equal = equal.withColumn("block", F.pmod(spot, F.col("blocks")).cast("long")).withColumn("count", F.least(F.lit(BLOCK), F.col("count") - F.col("nth") * BLOCK))
    equal = equal.repartition("source", "block")
    now = equal.select("doc_id", "source", "size", "block", "p", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count")))).drop("col")
    level, decided = 0, [whole]
    blocks = targets.agg(F.coalesce(F.max(F.ceil(F.col("n_docs") / BLOCK)), F.lit(1))).first()[0]
    while True:
        last = blocks <= 1
        now = now if level == 0 else now.repartition("source", "block")
        flown = now.sortWithinPartitions("source", "block", F.desc("size"), F.xxhash64(F.lit(seed), "doc_id", "size"), "doc_id", "p")
        flown = cut(flown.mapInPandas(_flight(seed, level, last), "doc_id long, source string, size long, block long, p double"), f"flight{level}")
        decided.append(flown.where(F.col("p").isin(0.0, 1.0)).select("doc_id", "source", "size", "p"))
        if last:
            break
        now = flown.where(~F.col("p").isin(0.0, 1.0)).withColumn("block", F.floor(F.col("block") / FAN))
        level, blocks = level + 1, -(-blocks // FAN)
    every = decided[0]
    for d in decided[1:]:
        every = every.unionByName(d)
    copies = (F.col("base") + F.col("p")).cast("long")
    return planned(every, "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def repeat_rows(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as ``mixed`` (of the same rows) takes it.

    Rows are carried as one column, so no column of ``docs`` can clash with those used here.
    """
    key = [F.col("doc_id").cast("long"), F.col("source").cast("string"), F.size(words_of(F.col("text").cast("string"))).cast("long")]
    known = docs.select(F.struct(*docs.columns).alias("_row"), F.xxhash64("text").alias("_order"), F.xxhash64(*docs.columns).alias("_every"), *[k.alias(f"_k{i}") for i, k in enumerate(key)])
    known = known.withColumns({"_n0": F.col("_k0").isNull(), "_n1": F.col("_k1").isNull()})
    known = known.fillna({"_k0": 0, "_k1": ""}, subset=["_k0", "_k1"])
    lists = mixed.select(F.coalesce("doc_id", F.lit(0)).alias("_k0"), F.coalesce("source", F.lit("")).alias("_k1"), F.col("size").alias("_k2"), F.col("doc_id").isNull().alias("_n0"), F.col("source").isNull().alias("_n1"), "copies")
    on = ["_k0", "_k1", "_k2", "_n0", "_n1"]
    # how many rows of each key are taken how often, as (copies, rows up to these): two entries at most
    w = Window.partitionBy(*on).orderBy("copies").rowsBetween(Window.unboundedPreceding, 0)
    lists = lists.groupBy(*on, "copies").count().withColumn("_upto", F.sum("count").over(w))
    lists = lists.groupBy(*on).agg(F.sort_array(F.collect_list(F.struct("_upto", "copies"))).alias("_list"))
    both = known.join(lists, on)
    # equal keys have numbers only where their rows differ in copies; there, rows that are equal in everything are one with a number before they meet
    alone = both.where(F.size("_list") == 1).select("_row", F.col("_list")[0]["copies"].alias("_times"))
    classes = both.where(F.size("_list") > 1).groupBy(*on, "_order", "_every").agg(F.first("_row").alias("_row"), F.first("_list").alias("_list"), F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*on).orderBy("_order", "_every").rowsBetween(Window.unboundedPreceding, 0))
    classes = classes.withColumn("_upto", upto)

    def times(entry: Column, k: Column) -> Column:
        """Copies that an entry of the list gives to the rows of a class: those that both have, times its copies."""
        before = F.when(k > 0, F.get("_list", k - 1)["_upto"]).otherwise(F.lit(0).cast("long"))
        have = F.least(entry["_upto"], F.col("_upto")) - F.greatest(before, F.col("_upto") - F.col("_n"))
        return F.greatest(have, F.lit(0).cast("long")) * entry["copies"]

    split = classes.select("_row", F.aggregate(F.transform("_list", times), F.lit(0).cast("long"), lambda x, y: x + y).alias("_times"))
    out = alone.unionByName(split).where(F.col("_times") > 0)
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))).select("_row.*")
