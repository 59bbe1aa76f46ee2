"""Quality rules: robust multivariate outliers within each language and source.

Only DataFrame functions.  Counts of each text give a vector of transformed
statistics.  For each (lang, source) a minimum-covariance-determinant estimate
is made: the mean and covariance of the ``H`` share of rows whose covariance has the least determinant.  From each of
three starts (medians and MADs; medians and fixed scales; mean and covariance of all), concentration steps
take the mean and covariance of the nearest ``H`` share and measure all rows anew,
until the determinant falls no more; the start that ends with the least one wins.
Groups of fewer than ``LEAST_ROWS`` rows take the estimate of their language, such languages that of all rows.
Rows whose squared Mahalanobis distance is over the cutoff, a quantile of chi-square, are rejected.

Statistics are whole numbers in fixed steps, so every sum is exact and does not
depend on partitioning.  Equal vectors of a group are counted once, then a step sums counts and moments per bin of
distance, so a group of any size is aggregated before it is shuffled, into a bounded
number of rows; of the bin on the edge the share counts that makes up ``H``.  A ridge (``FLOOR``) keeps covariances regular where most
texts of a group have equal values, as with the share of repeated lines, and says what a difference of no account is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlab.llm.tables import WS, cut, words_of

#: The statistics, in steps of 1/100: log of the mean word length, and square
#: roots of the shares of symbols, repeated lines and repeated words.
STATS = ("word_len", "symbols", "dup_lines", "repeats")
#: Least standard deviation of each statistic, in its steps.
FLOOR = (4.0, 6.0, 11.0, 11.0)
#: Share of a group's rows that an estimate rests on.
H = 0.75
#: Rows of a group with an estimate of its own: ten for each statistic.
LEAST_ROWS = 40
STARTS = 3
#: Steps go on until no determinant falls; so many mean that something is wrong, and raise.
TOO_MANY_STEPS = 500
#: Steps that the SQL has, which can't loop: more than the tables at hand take (a test says so).
SQL_STEPS = 14
#: The 0.999999 quantile of chi-square with 4 degrees of freedom: a statistic alone is an outlier beyond 5.8 deviations.
CUTOFF = 33.38
#: Median of chi-square with 4 degrees of freedom, for the scale of the estimate.
CHI2_MEDIAN = 3.3566939800333213
#: Bins of distance: BINS_PER_E for each factor of e.
BINS_PER_E = 50
#: What names a group: 0 a language and source, 1 a language, 2 all.
_GROUP = ("level", "lang", "source")


def base_counts(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns ``keep``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (with a word)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(F.col("_text"), "\n", -1), lambda x: F.btrim(x, F.lit(WS)) != "")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, text.alias("_text"))
    words, hashes, order = F.col("_words"), F.col("_h"), F.col("_order")
    base = base.select(
        "doc_id",
        *keep,
        words_of(F.col("_text")).alias("_words"),
        F.char_length(F.translate("_text", WS, "")).cast("long").alias("word_chars"),
        (F.char_length("_text") - F.char_length(F.translate("_text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
    )
    counts = ["word_chars", "n_symbols", "n_words", "n_lines", "n_dup_lines"]
    base = base.select(
        "doc_id",
        *keep,
        "word_chars",
        "n_symbols",
        F.size("_words").cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(words) >= 3, F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))).otherwise(F.array().cast("array<long>")).alias("_h"),
    )
    # only texts that repeat a window sort their windows
    repeats = F.size(F.array_distinct(hashes)) < F.size(hashes)
    base = base.select("doc_id", *keep, *counts, F.when(repeats, F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_order"))
    again = F.filter(order, lambda e, k: F.get(order, k - 1)["h"].eqNullSafe(e["h"]) | F.get(order, k + 1)["h"].eqNullSafe(e["h"]))
    base = base.select("doc_id", *keep, *counts, F.sort_array(F.transform(again, lambda e: e["i"])).alias("_at"))
    at = F.col("_at")
    covered = F.aggregate(F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - p, F.lit(3)))), F.lit(0), lambda a, b: a + b)
    return base.select("doc_id", *keep, *counts, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _stats() -> list[Column]:
    """The statistics as whole numbers; every text without words has zeros."""
    some = F.col("n_words") > 0

    def root(part: str, of: str) -> Column:
        return F.when(some, F.floor(100 * F.sqrt(F.col(part) / F.col(of)) + 0.5)).otherwise(0)

    return [
        F.when(some, F.floor(100 * F.log(F.col("word_chars") / F.col("n_words")) + 0.5)).otherwise(0).cast("long").alias("word_len"),
        root("n_symbols", "word_chars").cast("long").alias("symbols"),
        root("n_dup_lines", "n_lines").cast("long").alias("dup_lines"),
        root("n_repeat_words", "n_words").cast("long").alias("repeats"),
    ]


def _same(x: str, y: str, names: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{x}.{c}").eqNullSafe(F.col(f"{y}.{c}")) for c in names])


def _joined(left: DataFrame, right: DataFrame, names: tuple[str, ...], kind: str = "inner") -> DataFrame:
    """``right``'s other columns to the rows of ``left``, by ``names``, of which each may be null."""
    other = [c for c in right.columns if c not in names]
    return left.alias("x").join(right.alias("y"), _same("x", "y", names), kind).select("x.*", *[f"y.{c}" for c in other])


def _cells(rows: DataFrame) -> DataFrame:
    """(level, lang, source, *STATS, w): how many rows have a vector, for each group of each level."""
    one = cut(rows.groupBy("lang", "source", *STATS).agg(F.count("*").alias("w")), "cells")
    none = F.lit(None).cast("string")
    per_lang = one.groupBy("lang", *STATS).agg(F.sum("w").alias("w"))
    every = one.groupBy(*STATS).agg(F.sum("w").alias("w"))
    columns = [*_GROUP, *STATS, "w"]
    out = one.withColumn("level", F.lit(0)).select(*columns)
    out = out.unionByName(per_lang.withColumn("level", F.lit(1)).withColumn("source", none).select(*columns))
    out = out.unionByName(every.withColumn("level", F.lit(2)).withColumn("lang", none).withColumn("source", none).select(*columns))
    return cut(out, "cells")


def _middle(cells: DataFrame) -> DataFrame:
    """Per group: medians m<i> and MADs d<i>, from counts per value."""
    keys = (*_GROUP, "stat")
    tall = cells.select(*_GROUP, "w", F.posexplode(F.array(*STATS)).alias("stat", "v")).groupBy(*keys, "v").agg(F.sum("w").alias("n"))

    def middle(df: DataFrame, col: str, name: str) -> DataFrame:
        w = Window.partitionBy(*keys)  # a row for each value of a statistic
        df = df.withColumn("_upto", F.sum("n").over(w.orderBy(col).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("n").over(w))
        return df.where(2 * F.col("_upto") >= F.col("_all")).groupBy(*keys).agg(F.min(col).alias(name))

    med = middle(tall, "v", "m")
    off = _joined(tall, med, keys).groupBy(*keys, F.abs(F.col("v") - F.col("m")).alias("d")).agg(F.sum("n").alias("n"))
    both = _joined(med, middle(off, "d", "mad"), keys)
    p = range(len(STATS))
    return both.groupBy(*_GROUP).agg(*[F.max(F.when(F.col("stat") == i, F.col(c))).cast("double").alias(f"{n}{i}") for i in p for c, n in (("m", "m"), ("mad", "d"))])


def _sums(w: Column) -> list[Column]:
    p = range(len(STATS))
    return [
        F.sum(w).alias("n"),
        *[F.sum(w * F.col(STATS[i])).alias(f"s{i}") for i in p],
        *[F.sum(w * F.col(STATS[i]) * F.col(STATS[j])).alias(f"q{i}{j}") for i in p for j in range(i + 1)],
    ]


def _factor(moments: DataFrame) -> DataFrame:
    """Mean m<i>, Cholesky factor l<ij> with the ridge and its determinant of each row's sums s<i> and q<ij> over n."""
    p, n, other = len(STATS), F.col("n"), [c for c in moments.columns if c in (*_GROUP, "start")]
    means = [(F.col(f"s{i}") / n).alias(f"m{i}") for i in range(p)]
    df = moments.select(*other, *means, *[(F.col(f"q{i}{j}") / n - (F.col(f"s{i}") / n) * (F.col(f"s{j}") / n)).alias(f"c{i}{j}") for i in range(p) for j in range(i + 1)])
    for i in range(p):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}") + (F.lit(FLOOR[i] ** 2) if i == j else F.lit(0.0))
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            df = df.withColumn(f"l{i}{j}", F.sqrt(rest) if i == j else rest / F.col(f"l{j}{j}"))
    det = reduce(lambda a, b: a * b, [F.col(f"l{i}{i}") for i in range(p)])
    return df.withColumn("det", det).select(*other, *_ESTIMATE)


_ESTIMATE = [f"m{i}" for i in range(len(STATS))] + [f"l{i}{j}" for i in range(len(STATS)) for j in range(i + 1)] + ["det"]


def _starts(cells: DataFrame) -> DataFrame:
    """Three first estimates of each group; their determinants count as infinite, so the first step is always taken."""
    middle = cut(_middle(cells), "middle")
    far, p = F.lit(float("inf")), range(len(STATS))

    def diagonal(start: int, scale: list[Column]) -> DataFrame:
        cols = [(scale[i] if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i in p for j in range(i + 1)]
        return middle.select(*_GROUP, F.lit(start).alias("start"), *[f"m{i}" for i in p], *cols, far.alias("det"))

    out = diagonal(0, [F.greatest(F.col(f"d{i}") * 1.4826, F.lit(FLOOR[i])) for i in p]).unionByName(diagonal(1, [F.lit(FLOOR[i]) for i in p]))
    every = _factor(cells.groupBy(*_GROUP).agg(*_sums(F.col("w")))).withColumn("start", F.lit(2)).withColumn("det", far)
    return out.unionByName(every.select(*out.columns))


def _distance2() -> Column:
    """Squared Mahalanobis distance by forward substitution with the Cholesky factor l_ij."""
    y: list[Column] = []
    for i, s in enumerate(STATS):
        rest = F.col(s) - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * y[j]
        y.append(rest / F.col(f"l{i}{i}"))
    return reduce(lambda a, b: a + b, [v * v for v in y])


def _bin(d2: Column) -> Column:
    return F.floor(BINS_PER_E * F.log1p(d2)).cast("long")


def _concentrated(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """The estimates after a step, where that lowers the determinant; else as they were."""
    keys = (*_GROUP, "start")
    measured = _joined(cells, groups.drop("det"), _GROUP).withColumn("bin", _bin(_distance2()))
    bins = measured.groupBy(*keys, "bin").agg(*_sums(F.col("w")))
    w = Window.partitionBy(*keys)  # a row for each bin
    upto, every = F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)), F.sum("n").over(w)
    bins = bins.withColumn("_before", upto - F.col("n")).withColumn("_h", F.ceil(F.lit(H) * every)).where("_before < _h")
    # whole numbers but for the bin on the edge, of which the share counts that is missing
    inside = F.col("_before") + F.col("n") <= F.col("_h")
    share = (F.col("_h") - F.col("_before")) / F.col("n")
    names = [f"s{i}" for i in range(len(STATS))] + [f"q{i}{j}" for i in range(len(STATS)) for j in range(i + 1)]

    def total(c: str) -> Column:
        edge = F.max(F.when(~inside, F.col(c) * share))  # one row
        return F.coalesce(F.sum(F.when(inside, F.col(c))), F.lit(0)).cast("double") + F.coalesce(edge, F.lit(0.0))

    new = _factor(bins.groupBy(*keys).agg(F.max("_h").cast("double").alias("n"), *[total(c).alias(c) for c in names]))
    both = groups.alias("x").join(new.alias("y"), _same("x", "y", keys))
    lower = F.col("y.det") < F.col("x.det") * (1 - 1e-6)
    return both.select(*[f"x.{c}" for c in keys], *[F.when(lower, F.col(f"y.{c}")).otherwise(F.col(f"x.{c}")).alias(c) for c in _ESTIMATE], lower.alias("moved"))


def mcd(rows: DataFrame) -> DataFrame:
    """(lang, source, m_i, l_ij, scale) for the rows (lang, source, *STATS): each group's robust estimate."""
    cells = _cells(rows)
    groups = cut(_starts(cells), "groups")
    for _ in range(TOO_MANY_STEPS):
        stepped = cut(_concentrated(cells, groups), "groups")
        groups = stepped.drop("moved")
        if stepped.where("moved").isEmpty():
            break
    else:
        raise RuntimeError(f"determinants still fall after {TOO_MANY_STEPS} steps")
    best = groups.groupBy(*_GROUP).agg(F.min_by(F.struct(*_ESTIMATE), F.struct("det", "start")).alias("best")).select(*_GROUP, "best.*")
    tally = _joined(cells, best, _GROUP).groupBy(*_GROUP, _bin(_distance2()).alias("bin")).agg(F.sum("w").alias("n"))
    w = Window.partitionBy(*_GROUP)  # a row for each bin
    tally = tally.withColumn("_upto", F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("n").over(w))
    mid = tally.where(2 * F.col("_upto") >= F.col("_all")).groupBy(*_GROUP).agg(F.min("bin").alias("mid"), F.max("_all").alias("size"))
    # the ridge is part of the scale: it only ever widens
    scale = F.greatest(F.lit(1.0), F.expm1((F.col("mid") + 1) / F.lit(float(BINS_PER_E))) / CHI2_MEDIAN)
    best = cut(_joined(best, mid, _GROUP).withColumn("scale", scale), "mcd")
    wanted = [*_ESTIMATE[:-1], "scale"]
    own = best.where("level = 0").select("lang", "source", "size", F.struct(*wanted).alias("e0"))
    lang = best.where("level = 1").select("lang", F.col("size").alias("size1"), F.struct(*wanted).alias("e1"))
    every = best.where("level = 2").select(F.struct(*wanted).alias("e2"))
    both = _joined(own, lang, ("lang",)).crossJoin(F.broadcast(every))  # one row
    pick = F.when(F.col("size") >= LEAST_ROWS, F.col("e0")).when(F.col("size1") >= LEAST_ROWS, F.col("e1")).otherwise(F.col("e2"))
    return cut(both.select("lang", "source", pick.alias("e")).select("lang", "source", "e.*"), "estimates")


def quality_rules(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row: doc_id, ``keep``, n_words, the four counts, base_failed, distance2, kept.

    Takes doc_id, text, lang and source; other columns are ignored.  Nulls of
    lang or source are a group of their own; null and empty texts have no
    words and fail the base rules.  Estimates rest on the rows that pass the base
    rules, and each row that passes them is measured.  Repeated rows count each.
    Where all rows together are few the ridge makes most of the estimate, and little is rejected.
    An empty table gives an empty table.
    """
    counts = base_counts(docs.select("doc_id", "text", F.col("lang").alias("_lang0"), F.col("source").alias("_source0"), *keep), ("_lang0", "_source0", *keep))
    counts = counts.withColumnsRenamed({"_lang0": "lang", "_source0": "source"}) if not {"lang", "source"} & set(keep) else counts.withColumn("lang", F.col("_lang0")).withColumn("source", F.col("_source0")).drop("_lang0", "_source0")
    rows = cut(counts.withColumn("base_failed", base_failed()).select("*", *_stats()), "stats")
    measured = _joined(rows, mcd(rows.where(~F.col("base_failed")).select("lang", "source", *STATS)), ("lang", "source"), "left")
    d2 = F.when(F.col("base_failed"), F.lit(None)).otherwise(_distance2() / F.col("scale"))
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return measured.select("doc_id", *keep, *columns, d2.alias("distance2"), (~F.col("base_failed") & (d2 <= CUTOFF)).alias("kept"))


def _oracle() -> str:
    """DuckDB: the same estimate, common table expressions for each step."""
    ws = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    p = range(len(STATS))
    pairs = [(i, j) for i in p for j in range(i + 1)]
    moments = [f"s{i}" for i in p] + [f"q{i}{j}" for i, j in pairs]
    estimate = [f"m{i}" for i in p] + [f"l{i}{j}" for i, j in pairs] + ["det"]
    y = ["((x%d - m%d%s) / l%d%d)" % (i, i, "".join(f" - l{i}{j} * y{j}" for j in range(i)), i, i) for i in p]
    lateral = ", ".join(f"LATERAL (SELECT {e} AS y{i}) t{i}" for i, e in enumerate(y))
    d2 = " + ".join(f"y{i} * y{i}" for i in p)
    same = "g.level = c.level AND g.lang IS NOT DISTINCT FROM c.lang AND g.source IS NOT DISTINCT FROM c.source"

    def bins(groups: str) -> str:
        return f"SELECT c.*, g.* EXCLUDE (level, lang, source), floor({BINS_PER_E} * ln(1 + {d2}))::BIGINT AS bin FROM cells c JOIN {groups} g ON {same}, {lateral}"

    def factor(src: str) -> str:
        df = "(SELECT level, lang, source, start, " + ", ".join(f"s{i} / n AS m{i}" for i in p) + ", " + ", ".join(f"q{i}{j} / n - (s{i} / n) * (s{j} / n) AS c{i}{j}" for i, j in pairs) + f" FROM {src})"
        for i, j in pairs:
            rest = f"c{i}{j} + {FLOOR[i] ** 2 if i == j else 0.0}" + "".join(f" - l{i}{h} * l{j}{h}" for h in range(j))
            df = f"(SELECT *, {f'sqrt({rest})' if i == j else f'({rest}) / l{j}{j}'} AS l{i}{j} FROM {df})"
        return f"(SELECT level, lang, source, start, {', '.join(estimate[:-1])}, {' * '.join(f'l{i}{i}' for i in p)} AS det FROM {df})"

    sums = ["sum(w) AS n", *[f"sum(w * x{i}) AS s{i}" for i in p], *[f"sum(w * x{i} * x{j}) AS q{i}{j}" for i, j in pairs]]
    steps = []
    for k in range(SQL_STEPS):
        total = [f"coalesce(sum({c}) FILTER (before + n <= h), 0)::DOUBLE + coalesce(max({c} * ((h - before) / n)) FILTER (before + n > h), 0.0) AS {c}" for c in moments]
        steps.append(
            f"b{k} AS MATERIALIZED (SELECT *, sum(n) OVER (w ORDER BY bin ROWS UNBOUNDED PRECEDING) - n AS before, ceil({H} * sum(n) OVER w) AS h FROM (SELECT level, lang, source, start, bin, {', '.join(sums)} FROM ({bins(f'g{k}')}) GROUP BY ALL) WINDOW w AS (PARTITION BY level, lang, source, start)),\n"
            f"f{k} AS MATERIALIZED (SELECT * FROM {factor(f'(SELECT level, lang, source, start, max(h)::DOUBLE AS n, {chr(44).join(total)} FROM b{k} WHERE before < h GROUP BY ALL)')}),\n"
            f"g{k + 1} AS MATERIALIZED (SELECT g.level, g.lang, g.source, g.start, {', '.join(f'CASE WHEN c.det < g.det * (1 - 1e-6) THEN c.{e} ELSE g.{e} END AS {e}' for e in estimate)} FROM g{k} g JOIN f{k} c ON {same} AND g.start = c.start)"
        )
    middle = lambda v: f"quantile_disc({v}, 0.5)"
    spread = "SELECT level, lang, source, " + ", ".join(f"x{i}" for i in p) + " FROM cells, LATERAL (SELECT unnest(range(w)))"
    root = lambda a, b: f"CASE WHEN n_words > 0 THEN floor(100 * sqrt({a} / {b}) + 0.5) ELSE 0 END::BIGINT"
    diagonal = lambda start, scale: f"SELECT level, lang, source, {start} AS start, {', '.join(f'm{i}' for i in p)}, {', '.join(scale(i) + f' AS l{i}{j}' if i == j else f'0.0 AS l{i}{j}' for i, j in pairs)}, 'infinity'::DOUBLE AS det FROM mid0"
    xs = ", ".join(f"x{i}" for i in p)
    return f"""
WITH base AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(t, chr(10)), lambda l: trim(l, {ws}) <> '') AS lines FROM (SELECT *, coalesce(text, '') AS t FROM documents)),
win AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM base)),
rep AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, w) > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM rep, range(3) r(k) GROUP BY rid),
counts AS (SELECT rid, doc_id, lang, source, len(words) AS n_words, length(translate(t, {ws}, '')) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, len(lines) AS n_lines FROM base LEFT JOIN cov USING (rid)),
rows AS MATERIALIZED (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, CASE WHEN n_words > 0 THEN floor(100 * ln(word_chars / n_words) + 0.5) ELSE 0 END::BIGINT AS x0,
    {root('n_symbols', 'word_chars')} AS x1, {root('n_dup_lines', 'n_lines')} AS x2, {root('n_repeat_words', 'n_words')} AS x3 FROM counts),
good AS (SELECT * FROM rows WHERE NOT base_failed),
cells AS MATERIALIZED (SELECT 0 AS level, lang, source, {xs}, count(*)::BIGINT AS w FROM good GROUP BY ALL
    UNION ALL SELECT 1, lang, NULL, {xs}, count(*)::BIGINT FROM good GROUP BY ALL UNION ALL SELECT 2, NULL, NULL, {xs}, count(*)::BIGINT FROM good GROUP BY ALL),
each AS MATERIALIZED ({spread}),
med AS (SELECT level, lang, source, {', '.join(f'{middle(f"x{i}")}::DOUBLE AS m{i}' for i in p)} FROM each GROUP BY ALL),
mid0 AS MATERIALIZED (SELECT c.level, c.lang, c.source, {', '.join(f'any_value(m{i}) AS m{i}, {middle(f"abs(x{i} - m{i})")} AS d{i}' for i in p)} FROM each c JOIN med g ON {same} GROUP BY ALL),
g0 AS MATERIALIZED ({diagonal(0, lambda i: f"greatest(d{i} * 1.4826, {FLOOR[i]})")} UNION ALL {diagonal(1, lambda i: f"{FLOOR[i]}")}
    UNION ALL SELECT * REPLACE ('infinity'::DOUBLE AS det) FROM {factor(f"(SELECT level, lang, source, 2 AS start, {', '.join(sums)} FROM cells GROUP BY ALL)")}),
{(',' + chr(10)).join(steps)},
best AS MATERIALIZED (SELECT * EXCLUDE (start) FROM g{SQL_STEPS} QUALIFY row_number() OVER (PARTITION BY level, lang, source ORDER BY det, start) = 1),
tally AS (SELECT level, lang, source, bin, sum(w) AS n FROM ({bins('best')}) GROUP BY ALL),
upto AS (SELECT *, sum(n) OVER (w ORDER BY bin ROWS UNBOUNDED PRECEDING) AS u, sum(n) OVER w AS size FROM tally WINDOW w AS (PARTITION BY level, lang, source)),
mid AS (SELECT level, lang, source, greatest(1.0, (exp((min(bin) FILTER (2 * u >= size) + 1) / {float(BINS_PER_E)}) - 1) / {CHI2_MEDIAN}) AS scale, max(size) AS size FROM upto GROUP BY ALL),
est AS MATERIALIZED (SELECT c.*, scale, size FROM best c JOIN mid g ON {same}),
level_of AS (SELECT lang, source, CASE WHEN size >= {LEAST_ROWS} THEN 0 WHEN (SELECT max(b.size) FROM est b WHERE b.level = 1 AND b.lang IS NOT DISTINCT FROM a.lang) >= {LEAST_ROWS} THEN 1 ELSE 2 END AS level FROM est a WHERE a.level = 0),
picked AS (SELECT o.lang AS lang, o.source AS source, e.* EXCLUDE (level, lang, source) FROM level_of o JOIN est e ON e.level = o.level
    AND (o.level = 2 OR e.lang IS NOT DISTINCT FROM o.lang) AND (o.level > 0 OR e.source IS NOT DISTINCT FROM o.source))
SELECT c.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(({d2}) / scale <= {CUTOFF}, false) AS kept
FROM rows c LEFT JOIN picked g ON g.lang IS NOT DISTINCT FROM c.lang AND g.source IS NOT DISTINCT FROM c.source, {lateral}
"""


ORACLE_SQL = _oracle()
