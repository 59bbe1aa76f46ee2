"""Seeded synthetic columns and tables.

A value depends on (seed, table, row, column) alone, so any partitioning gives the same
rows.  A generator takes a ``Draws`` and returns a column; ``synth`` adds generated columns
to any table with a row number or key, such as ``spark.range(n)``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventlab.functions import draws as D
from eventlab.operators.ranges import as_of, interval_join
from eventlab.sources.tables import cut, spread

FIRST = ("Ada", "Ben", "Cleo", "Dina", "Emil", "Fay", "Gus", "Hana", "Ivan", "June", "Kai", "Lena")
LAST = ("Adler", "Brook", "Castro", "Dunn", "Egger", "Frost", "Gray", "Haas", "Irwin", "Jung", "Klein", "Lowe")
CITIES = ("Arden", "Brill", "Corva", "Delph", "Esker", "Fenn", "Galt", "Hollow")
STATES = ("AR", "BL", "CV", "DP", "EK", "FN")
COUNTRIES = ("DE", "ES", "FR", "US")
STREETS = ("Ash", "Birch", "Cedar", "Elm", "Fir", "Oak")
STREET_KINDS = ("St", "Ave", "Rd")
ADJECTIVES = ("Bold", "Calm", "Light", "Quick", "Solid", "Warm")
MATERIALS = ("Cotton", "Oak", "Steel", "Wool")
PRODUCTS = ("Chair", "Coat", "Lamp", "Mug", "Table")
CATEGORIES = ("home", "garden", "office", "sport", "toys")
BRANDS = ("Arlo", "Bexa", "Corin", "Dovo")
AGENTS = ("agent/1.0 (desktop)", "agent/1.1 (phone)", "agent/2.0 (tablet)")
WORDS = ("alpha", "bravo", "delta", "echo", "lima", "metro", "nova", "oscar", "sierra", "tango", "victor", "zulu")


class Draws:
    """The draws of one column of one row; each call of ``u`` or ``hex`` is another draw."""

    def __init__(self, key: bytes, table: str, row: Column, column: str, siblings: Mapping[str, Column]):
        self.key, self.table, self.row, self.column, self.siblings = key, table, row, column, siblings

    def hex(self, n: int | str = 0) -> Column:
        return D.prf_digest(self.key, self.table, self.row, self.column, n)

    def u(self, n: int | str = 0) -> Column:
        return D.unit(self.hex(n))

    def index(self, size: int | Column, n: int | str = 0) -> Column:
        """0 to size - 1."""
        return F.floor(self.u(n) * size).cast("int")

    def pick(self, values: Sequence[str], n: int | str = 0) -> Column:
        return F.get(F.lit(list(values)), self.index(len(values), n))

    def digits(self, k: int, n: int | str = 0) -> Column:
        return F.lpad(F.floor(self.u(n) * 10**k).cast("long").cast("string"), k, "0")


Generator = Callable[[Draws], Column]


def _slug(c: Column, sep: str) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", sep)


def key(prefix: str) -> Generator:
    return lambda d: F.concat(F.lit(prefix + "_"), F.substring(d.hex(), 1, 16))


def uuid() -> Generator:
    def make(d: Draws) -> Column:
        h = d.hex()
        v = F.get(F.lit(list("89ab")), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4)
        return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)), F.concat(v, F.substring(h, 18, 3)), F.substring(h, 21, 12))

    return make


def seq(start: int = 1, step: int = 1) -> Generator:
    return lambda d: F.lit(start) + d.row * step


def choice(values: Sequence[str]) -> Generator:
    return lambda d: d.pick(values)


def weighted(values: Sequence[str], weights: Sequence[float]) -> Generator:
    return lambda d: F.get(F.lit(list(values)), D.weighted_choice(d.u(), weights))


def boolean(p: float = 0.5) -> Generator:
    return lambda d: d.u() < p


def joined(sep: str, *lists: Sequence[str]) -> Generator:
    return lambda d: F.concat_ws(sep, *[d.pick(v, i) for i, v in enumerate(lists)])


def email(sibling: str, domain: str = "example.com") -> Generator:
    return lambda d: F.concat(_slug(d.siblings[sibling], "."), d.digits(3), F.lit("@" + domain))


def username(sibling: str) -> Generator:
    return lambda d: F.concat(_slug(d.siblings[sibling], "_"), d.digits(3))


def phone() -> Generator:
    return lambda d: F.concat(F.lit("+1"), d.digits(10))


def street() -> Generator:
    return lambda d: F.concat_ws(" ", (d.index(999, "n") + 1).cast("string"), d.pick(STREETS, 0), d.pick(STREET_KINDS, 1))


def postal() -> Generator:
    return lambda d: d.digits(5)


def address() -> Generator:
    return lambda d: F.struct(street()(d).alias("street"), d.pick(CITIES, "c").alias("city"), d.pick(STATES, "s").alias("state"), d.digits(5, "p").alias("postal_code"), d.pick(COUNTRIES, "k").alias("country"))


def category(most: int = 3) -> Generator:
    return lambda d: F.array_join(F.slice(F.array(*[d.pick(CATEGORIES, i) for i in range(most)]), 1, d.index(most, "n") + 1), "/")


def sku() -> Generator:
    return template("SKU-#upper4-#digits4")


def price(low: float, high: float, skewed: bool = False) -> Generator:
    def make(d: Draws) -> Column:
        u = d.u() * d.u() if skewed else d.u()
        return F.bround((low + u * (high - low)).cast("decimal(18,6)"), 2).cast("decimal(18,2)")

    return make


def ip_v4(private: bool = False) -> Generator:
    return lambda d: F.concat_ws(".", F.lit("10") if private else (d.index(223, "a") + 1).cast("string"), *[d.index(256, i).cast("string") for i in range(3)])


def url() -> Generator:
    return lambda d: F.concat(F.lit("https://www.example.com/"), d.pick(WORDS), F.lit("-"), F.substring(d.hex("x"), 1, 6))


def sentence(low: int = 4, high: int = 9) -> Generator:
    def make(d: Draws) -> Column:
        n = d.index(high - low + 1, "n") + low
        words = F.slice(F.array(*[d.pick(WORDS, i) for i in range(high)]), 1, n)
        text = F.array_join(words, " ")
        return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 10_000), F.lit("."))

    return make


def paragraph(sentences: int = 2) -> Generator:
    def make(d: Draws) -> Column:
        return F.concat_ws(" ", *[sentence()(Draws(d.key, d.table, d.row, f"{d.column}.{i}", d.siblings)) for i in range(sentences)])

    return make


def integer(low: int, high: int) -> Generator:
    return lambda d: (F.lit(low) + F.floor(d.u() * (high - low + 1))).cast("long")


def double(low: float, high: float, places: int = 4) -> Generator:
    return lambda d: F.round(low + d.u() * (high - low), places)


def normal(mean: float, sd: float, low: float, high: float) -> Generator:
    return lambda d: D.clamp(mean + sd * D.inverse_normal(d.u()), low, high)


def lognormal(median: float, p95: float, low: float = 0.0, high: float = D.YEAR_S) -> Generator:
    return lambda d: D.clamp(D.dist("lognormal", d.u(), median=median, p95=p95), low, high)


def zipf(n: int, s: float = 1.0) -> Generator:
    return lambda d: D.weighted_choice(d.u(), [1 / k**s for k in range(1, n + 1)]) + 1


def decimal(low: float, high: float, scale: int = 2) -> Generator:
    return lambda d: F.bround((low + d.u() * (high - low)).cast("decimal(24,10)"), scale).cast(f"decimal(18,{scale})")


def between(start: str, end: str) -> Generator:
    """A time at whole milliseconds from ``start`` on, before ``end``."""

    def make(d: Draws) -> Column:
        a, b = (F.unix_millis(F.lit(x).cast("timestamp")) for x in (start, end))
        return F.timestamp_millis(a + F.floor(d.u() * (b - a))).cast("timestamp_ntz")

    return make


def template(text: str) -> Generator:
    """Literal text with #hex8, #hex16, #digits4, #digits8 and #upper4 draws, and {sibling} columns."""
    import re

    def make(d: Draws) -> Column:
        parts = []
        for i, piece in enumerate(re.split(r"(#hex8|#hex16|#digits4|#digits8|#upper4|\{\w+\})", text)):
            if piece.startswith("#hex"):
                parts.append(F.substring(d.hex(i), 1, int(piece[4:])))
            elif piece.startswith("#digits"):
                parts.append(d.digits(int(piece[7:]), i))
            elif piece == "#upper4":
                parts.append(F.translate(F.substring(d.hex(i), 1, 4), "0123456789abcdef", "ABCDEFGHIJKLMNOP"))
            elif piece.startswith("{"):
                parts.append(d.siblings[piece[1:-1]].cast("string"))
            elif piece:
                parts.append(F.lit(piece))
        return F.concat(*parts)

    return make


def attr(column: str) -> Generator:
    """A column the row has already, such as a referenced row's attribute."""
    return lambda d: d.siblings[column]


def derived(expr: str) -> Generator:
    """An expression over the row's columns."""
    return lambda d: F.expr(expr)


def custom(fn: Callable, return_type: str) -> Generator:
    """A function of a pandas Series of draws.  Slow: its rows go through Python in Arrow batches."""
    return lambda d: F.pandas_udf(fn, return_type)(d.u())


def synth(df: DataFrame, row: Column, columns: Mapping[str, Generator], table: str, seed: int) -> DataFrame:
    """``df`` with generated columns; later ones can use earlier ones as siblings."""
    k = D.subseed(seed, "values")
    for name, gen in columns.items():
        df = df.withColumn(name, gen(Draws(k, table, row, name, {c: F.col(c) for c in df.columns})))
    return df


def synth_table(spark: SparkSession, n: int, columns: Mapping[str, Generator], table: str, seed: int) -> DataFrame:
    """n rows with a number ``row`` and the columns."""
    return synth(spark.range(n).withColumnRenamed("id", "row"), F.col("row"), columns, table, seed)


# references


def numbered(target: DataFrame, *order: str) -> DataFrame:
    """Rows with ``_n`` from 0 on in order: numbered within ranges of the order, plus the rows of the ranges before.

    The ranges are written once, so that their counts and their rows are of the same ones.
    """
    ranged = target.repartitionByRange(*order).sortWithinPartitions(*order)
    part = cut(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id()), "numbered")
    # the low 33 bits count a partition's rows
    at = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = part.groupBy("_part").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    return part.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part").withColumn("_n", at + F.col("_before")).drop("_part", "_id", "_before")


def weighted_ranges(target: DataFrame, order: str, key_col: str, s: float | None, weight: str | None) -> tuple[DataFrame, float]:
    """((fk, low, high), total): each key's share of the line from 0 to the total of weights, in order.

    The weight is a column, or 1 / rank^s.  Sums are two-level: within ranges of the order, plus the sums of the ranges before.
    """
    keys = target.select(*dict.fromkeys([order, key_col, *([weight] if weight else [])])).dropDuplicates([key_col])
    ranked = numbered(keys, order).withColumn("_w", F.col(weight).cast("double") if weight else F.pow(F.col("_n") + 1.0, F.lit(-float(s))))
    block = ranked.withColumn("_block", F.floor(F.col("_n") / 65536))
    sums = block.groupBy("_block").agg(F.sum("_w").alias("_s"))
    before = F.coalesce(F.sum("_s").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))  # a row for each block
    within = F.sum("_w").over(Window.partitionBy("_block").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0))
    out = block.withColumn("_in", within).join(sums.select("_block", before.alias("_before")), "_block")
    upto = F.col("_before") + F.col("_in")
    # a range begins where the one before it ends, to the last bit
    out = cut(out.select(F.col(key_col).alias("fk"), (F.col("_before") + F.coalesce(F.lag("_in").over(Window.partitionBy("_block").orderBy("_n")), F.lit(0.0))).alias("low"), upto.alias("high"), F.col("_n")), "weights")
    return out, out.agg(F.coalesce(F.max("high"), F.lit(0.0))).first()[0]


def sample_fk(df: DataFrame, row: Column, target: DataFrame, order: str, key_col: str, table: str, seed: int, how: str = "uniform", size: int | None = None, s: float = 1.0, weight: str | None = None) -> DataFrame:
    """``df`` with a foreign key ``fk`` drawn from the target: uniform, recent (the newest quarter), zipf (1 / rank^s by order) or weighted (by the column ``weight``).

    A key of zipf and weighted is found by the range that its weights cover.  Keys without weight are never drawn, and without any weight at all none is.
    """
    n = target.count() if size is None else size
    u = Draws(D.subseed(seed, "values"), table, row, "fk", {}).u()
    if how in ("zipf", "weighted"):
        ranges, total = weighted_ranges(target, order, key_col, s, weight if how == "weighted" else None)
        columns = df.columns
        points = df.withColumn("_at", u * total)
        return interval_join(points, "_at", ranges.drop("_n"), "low", "high", total / max(n, 1) if total > 0 else 1.0).select(*columns, "fk")
    if how == "uniform":
        at = F.floor(u * n)
    elif how == "recent":
        at = F.lit(n - max(1, n // 4)) + F.floor(u * max(1, n // 4))
    else:
        raise ValueError(f"unknown way {how}")
    keys = numbered(target.select(order, key_col).distinct() if order != key_col else target.select(key_col).distinct(), order).select(F.col("_n"), F.col(key_col).alias("fk"))
    return df.withColumn("_n", at.cast("long")).join(keys, "_n").drop("_n")


def assign_one_to_one(df: DataFrame, order: str, target: DataFrame, target_order: str, key_col: str) -> DataFrame:
    """The k-th row gets the k-th target."""
    keys = numbered(target.select(*dict.fromkeys([target_order, key_col])), target_order).select("_n", F.col(key_col).alias("partner"))
    return numbered(df, order).join(keys, "_n").drop("_n")


@dataclass(frozen=True)
class Related:
    """A table to make: rows numbered or keyed by ``row``, generated columns, and foreign keys.

    ``refs`` has for each new column (table, key column, how): a table declared
    before, and uniform, recent, zipf or one_to_one (no more rows than the other has).
    """

    rows: DataFrame
    row: str
    columns: Mapping[str, Generator] = field(default_factory=dict)
    refs: Mapping[str, tuple[str, str, str]] = field(default_factory=dict)


def synth_tables(tables: Mapping[str, Related], seed: int) -> dict[str, DataFrame]:
    """The tables in declaration order, each written once, so that references meet the rows that were made.

    Rows of an empty table give an empty table.  Rows that refer to an empty table, or
    one to one to fewer rows, raise: every reference resolves.
    """
    made: dict[str, DataFrame] = {}
    for name, t in tables.items():
        df = synth(t.rows, F.col(t.row), t.columns, name, seed)
        for fk, (parent, key_col, how) in t.refs.items():
            if parent not in made:
                raise ValueError(f"{name}.{fk} refers to {parent}, which isn't declared before it")
            target = made[parent]
            if how == "one_to_one":
                df = assign_one_to_one(df, t.row, target, key_col, key_col).withColumnRenamed("partner", fk)
            else:
                df = sample_fk(df, F.col(t.row), target, key_col, key_col, f"{name}.{fk}", seed, how).withColumnRenamed("fk", fk)
        made[name] = cut(df, name)
        if t.refs and made[name].count() != t.rows.count():
            raise ValueError(f"{name} has rows whose references don't resolve")
    return made


# histories and arrivals


def snapshot_cdc(table: DataFrame, key_col: str, at: str) -> DataFrame:
    """One read row of version 1 for each entity."""
    cols = [c for c in table.columns if c != key_col]
    return table.select(F.col(key_col).alias("entity_key"), F.lit(1).alias("entity_version"), F.lit("r").alias("op"), F.lit(at).cast("timestamp_ntz").alias("valid_from"), F.struct(*cols).alias("after"))


def background_mutations(entities: DataFrame, key_col: str, days: int, rate: float, seed: int, start: str) -> DataFrame:
    """(entity_key, day, entity_version, before, after): a seeded chance for each entity and day to get a new value; version 1 is the entity's first value."""
    k = D.subseed(seed, "background")
    # entities are few rows of a small file, and each makes many
    each = spread(entities.select(F.col(key_col).alias("entity_key")), "entity_key").select("entity_key", F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("day"))
    hit = D.prf_u(k, F.col("entity_key"), F.col("day"), "hit") < rate
    value = F.floor(D.prf_u(k, F.col("entity_key"), F.col("day"), "value") * 1000).cast("int")
    first = F.floor(D.prf_u(k, F.col("entity_key"), "first") * 1000).cast("int")
    w = Window.partitionBy("entity_key").orderBy("day")
    hits = each.where(hit).withColumn("after", value)
    return hits.select("entity_key", "day", (F.row_number().over(w) + 1).alias("entity_version"), F.coalesce(F.lag("after").over(w), first).alias("before"), "after", (F.lit(start).cast("date") + F.col("day")).alias("date"))


#: Up to so many rules are sent to all tasks; more are joined by entity type like any other table.
BROADCAST_RULES = 100_000


def _gap(key_: bytes, k: Column | int) -> Column:
    """Days from one hit of a chance to the next, at least 1: a geometric draw, the k-th of an entity and rule."""
    miss = F.log(1 - F.least(D.prf_u(key_, F.col("entity_type"), F.col("rule"), F.col("entity_key"), k, "gap"), F.lit(1 - 2.0**-53)))
    return F.when(F.col("chance") >= 1, F.lit(1)).otherwise(1 + F.least(F.floor(miss / F.log(1 - F.col("chance"))), F.lit(2**31))).cast("long")


def hits_of(entities: DataFrame, rules: DataFrame, days: int, seed: int, deviations: float = 6) -> DataFrame:
    """``entities`` by the rules of their type, with a ``day`` for each hit: every day of an entity's life is hit by ``chance``, and no missed day is made.

    The gaps from hit to hit are geometric draws.  The first one, in the entity's own row, drops the pairs that are never hit; the others
    come as lists, long enough for nearly all (by so many ``deviations`` above what is to be expected), and pairs that go on after their list take another one.
    """
    k = D.subseed(seed, "background")
    few = rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    pairs = spread(entities, "entity_type", "entity_key").join(F.broadcast(rules) if few else rules, "entity_type").where("chance > 0")
    end = F.least(F.coalesce(F.col("live_until"), F.lit(days)), F.lit(days)).cast("long")
    born = F.greatest(F.coalesce(F.col("live_from"), F.lit(0)), F.lit(0)).cast("long")
    left = (F.col("_end") - F.col("_at")).cast("double")
    size = F.least(left, F.greatest(F.ceil(left * F.col("chance") + deviations * F.sqrt(left * F.col("chance"))), F.lit(0)) + 2).cast("int")
    going = pairs.withColumns({"_end": end, "_at": born - 1 + _gap(k, 0), "_k": F.lit(0)}).where("_at < _end")
    found = []
    while True:
        gaps = F.transform(F.sequence(F.lit(1), F.col("_size")), lambda i: _gap(k, F.col("_k") + i))
        run = F.aggregate(gaps, F.array("_at"), lambda days_, g: F.concat(days_, F.array(F.element_at(days_, -1) + g)))
        listed = cut(going.withColumn("_size", size).withColumn("_days", run), "hits")
        found.append(listed.withColumn("day", F.explode(F.filter(F.slice("_days", 1, F.col("_size")), lambda d: d < F.col("_end")))).drop("_days", "_size", "_end", "_at", "_k"))
        going = listed.withColumns({"_at": F.element_at("_days", -1), "_k": F.col("_k") + F.col("_size")}).where("_at < _end").drop("_days", "_size")
        if going.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def mutations_by_rules(entities: DataFrame, rules: DataFrame, sets: Mapping[str, Generator], days: int, seed: int, start: str) -> DataFrame:
    """Updates of entities that no event causes, by a table of rules.

    ``entities`` has a row for each (entity_type, entity_key), the attributes of ``sets`` with their first values and, if it likes, ``live_from`` (first day) and
    ``live_until`` (the day after the last).  ``rules`` has entity_type, ``rule`` (a number within the type), ``chance`` for each day, and ``attributes``, the names it
    changes; ``sets`` says how each is drawn.  Rules without a chance, types without rules and rows without a type or key change nothing.

    Returns (entity_type, entity_key, entity_version, op, rule, day, occurred_at, event_id, correlation_id, causation_id, before, after): versions of an entity
    follow each other from 2 on, 1 being its first values; ``after`` of one is ``before`` of the next.  Each update is the root of its chain: its correlation is its
    own id, its cause is null.  An entity has at most a row for each rule and day.
    """
    unknown = rules.select(F.explode("attributes").alias("a")).where(~F.col("a").isin(list(sets))).first()
    if unknown is not None:
        raise ValueError(f"no generator for the attribute {unknown.a}")
    for bound in ("live_from", "live_until"):
        if bound not in entities.columns:
            entities = entities.withColumn(bound, F.lit(None).cast("int"))
    k = D.subseed(seed, "background")
    hits = hits_of(entities.select("entity_type", "entity_key", *sets, "live_from", "live_until"), rules.select("entity_type", "rule", "chance", "attributes"), days, seed)
    place = ("entity_type", "rule", "entity_key", "day")
    micros = F.unix_micros(F.lit(start).cast("timestamp")) + F.col("day") * 86_400_000_000 + F.floor(D.prf_u(k, *[F.col(c) for c in place], "offset") * 86_400_000_000)
    hits = hits.withColumn("_micros", micros.cast("long")).withColumn("event_id", D.uuid7(F.floor(F.col("_micros") / 1000).cast("long"), D.prf_digest(k, *[F.col(c) for c in place], "id")))
    row = F.concat_ws(":", *place)
    new = {f"_new_{a}": F.when(F.array_contains("attributes", a), gen(Draws(k, "background", row, a, {c: F.col(c) for c in sets}))) for a, gen in sets.items()}
    w = Window.partitionBy("entity_type", "entity_key").orderBy("_micros", "rule")
    upto, earlier = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    before = F.struct(*[F.coalesce(F.last(f"_new_{a}", ignorenulls=True).over(earlier), F.col(a)).alias(a) for a in sets])
    after = F.struct(*[F.coalesce(F.last(f"_new_{a}", ignorenulls=True).over(upto), F.col(a)).alias(a) for a in sets])
    return hits.withColumns(new).select(
        "entity_type", "entity_key", (F.row_number().over(w) + 1).alias("entity_version"), F.lit("u").alias("op"), "rule", "day", F.timestamp_micros("_micros").cast("timestamp_ntz").alias("occurred_at"),
        "event_id", F.col("event_id").alias("correlation_id"), F.lit(None).cast("string").alias("causation_id"), before.alias("before"), after.alias("after"),
    )


def arrivals(df: DataFrame, row: Column, rate_per_hour: float, diurnal: Sequence[float], seed: int, start: str, hours: int) -> DataFrame:
    """Arrival times of a Poisson process with hourly intensity, one for each row in its order, until ``hours`` are over.

    Exponential gaps are summed in two levels, within blocks of rows and over blocks; the
    sum is the process's mass, and each hour begins at a known mass, so a time is found by an as-of
    join to the hours, by mass, and linear inversion.
    """
    mass = [rate_per_hour * diurnal[h % 24] * 24 / sum(diurnal) for h in range(hours)]
    if min(mass) <= 0:
        raise ValueError("every hour needs some intensity")
    upto = [sum(mass[:h]) for h in range(hours + 1)]
    u = Draws(D.subseed(seed, "arrivals"), "arrivals", row, "gap", {}).u()
    block = F.floor(row / 4096)
    gaps = df.withColumn("_row", row).withColumn("_gap", -F.log(1 - F.least(u, F.lit(1 - 2.0**-53)))).withColumn("_block", block)
    sums = gaps.groupBy("_block").agg(F.sum("_gap").alias("_s"))
    before = F.coalesce(F.sum("_s").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    within = F.sum("_gap").over(Window.partitionBy("_block").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0))
    at = gaps.withColumn("_in", within).join(sums.select("_block", before.alias("_before")), "_block").withColumn("_mass", F.col("_in") + F.col("_before"))
    at = at.where(F.col("_mass") < upto[-1]).select(*df.columns, "_mass")
    starts = df.sparkSession.createDataFrame([(h, float(upto[h]), float(mass[h])) for h in range(hours)], "_hour int, _begin double, _of double")
    at = as_of(at, starts, [], "_mass", "_begin", ["_hour", "_begin", "_of"])
    seconds = (F.col("_hour") + (F.col("_mass") - F.col("_begin")) / F.col("_of")) * 3600.0
    base = F.unix_micros(F.lit(start).cast("timestamp"))
    return at.withColumn("arrived_at", F.timestamp_micros(base + F.floor(seconds * 1e6).cast("long")).cast("timestamp_ntz")).drop("_mass", "_hour", "_begin", "_of")


def synth_events(arrived: DataFrame, row: Column, types: Mapping[str, float], actors: DataFrame, actor_order: str, actor_key: str, seed: int) -> DataFrame:
    """Events of arrivals: each bound to a drawn actor, with a weighted type, an id of its time and digest, and its number in the actor's shard."""
    from eventlab.operators.checks import assign_sequence

    df = sample_fk(arrived, row, actors, actor_order, actor_key, "actors", seed).withColumnRenamed("fk", "actor")
    return assign_sequence(described(df, row, types, "arrived_at", seed).withColumn("shard_id", F.lit(0)), ["shard_id"], "arrived_at", "event_id")


def described(df: DataFrame, row: Column, types: Mapping[str, float], time: str, seed: int) -> DataFrame:
    """``df`` with a weighted event_type, an event_id of the row's time and digest, and occurred_at."""
    from eventlab.functions.values import epoch_ms

    key_ = D.subseed(seed, "events")
    df = df.withColumn("event_type", F.get(F.lit(list(types)), D.weighted_choice(D.prf_u(key_, row, "type"), list(types.values()))))
    return df.withColumn("event_id", D.uuid7(epoch_ms(F.col(time)), D.prf_digest(key_, row, "id"))).withColumn("occurred_at", F.col(time))
