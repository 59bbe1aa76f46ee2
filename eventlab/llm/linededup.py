"""Line dedup: range-partitioned line hashes, streamed in order, give keep bitmaps.

Only DataFrame functions.  The rows that move are (two 64-bit hashes of the
line's key, document, position).  They are range-partitioned by hash and
document, largest first, and sorted by position within, so a line that a third of all documents
share is spread over many partitions.  Two aggregations read each partition in that order,
without hash tables: the first row of a line in a document, then of these the first document of the line and
how many there are; one row for each line and partition goes on to find the
largest document of all.  What comes back for a document is a run-length
compressed bitmap of the lines it keeps, as (start, length) runs.

Texts of documents that lose no line stay where they are read: a map of fixed size
(``MAP_BITS`` bits, at most ``2^MAP_BITS / 64`` rows to broadcast) tells which may lose some, and only those are
joined to their bitmaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlab.llm.tables import WS, cut, hash128, lower_ascii

#: Bits of the map of documents that lose lines.
MAP_BITS = 23


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """White space stripped at both ends, A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit(WS)))


def _base(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    t1, t2 = hash128(text)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), t1.alias("t1"), t2.alias("t2"))


def holders(rows: DataFrame, min_docs: int) -> DataFrame:
    """(k1, k2, holder) of the lines (k1, k2, doc_id, pos) that ``min_docs`` documents or more have."""
    # -1 - doc_id never overflows, and is in the order that sorted aggregation keeps
    named = rows.where("doc_id is not null").select("k1", "k2", (F.lit(-1) - F.col("doc_id")).alias("back"), "pos")
    ordered = named.repartitionByRange("k1", "k2", "back").sortWithinPartitions("k1", "k2", "back", "pos")
    # values of first() that are structs make Spark aggregate in the order of the rows
    firsts = ordered.groupBy("k1", "k2", "back").agg(F.first(F.struct("pos")).alias("first"))
    spread = firsts.groupBy("k1", "k2").agg(F.count("first").alias("n"), F.min(F.struct("back", "first")).alias("top"))
    return spread.where(F.col("n") >= min_docs).select("k1", "k2", (F.lit(-1) - F.col("top.back")).alias("holder"))


def line_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """The documents that lose lines: doc_id, t1, t2, n_lines, n_dropped, runs.

    A line whose key has ``min_chars`` code points or more and is in at least
    ``min_docs`` documents stays only in the largest doc_id that holds it.
    ``runs`` are the (start, length) runs of the lines that stay; t1 and t2
    are hashes of the text, so that rows repeating a doc_id keep apart.
    Null doc_ids never count and never hold a line.
    """
    base = _base(docs)
    n_lines = F.size(_lines(F.col("text")))
    key = line_key(F.col("line"))
    k1, k2 = hash128(key)
    rows = base.select("doc_id", "t1", "t2", n_lines.alias("n_lines"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    rows = rows.where(F.char_length(key) >= min_chars).select("doc_id", "t1", "t2", "n_lines", "pos", k1.alias("k1"), k2.alias("k2"))
    rows = cut(rows, "lines")
    spread = cut(holders(rows, min_docs), "spread")
    lost = rows.join(spread, ["k1", "k2"]).where(~F.col("doc_id").eqNullSafe(F.col("holder")))
    lost = lost.groupBy("doc_id", "t1", "t2").agg(F.first("n_lines").alias("n_lines"), F.sort_array(F.collect_set("pos")).alias("gone"))
    gone, n = F.col("gone"), F.col("n_lines")
    runs = F.transform(
        F.sequence(F.lit(0), F.size(gone)),
        lambda k: F.struct(
            F.when(k == 0, F.lit(0)).otherwise(F.get(gone, k - 1) + 1).alias("start"),
            (F.coalesce(F.get(gone, k), n) - F.when(k == 0, F.lit(0)).otherwise(F.get(gone, k - 1) + 1)).alias("length"),
        ),
    )
    return lost.select("doc_id", "t1", "t2", "n_lines", F.size(gone).alias("n_dropped"), F.filter(runs, lambda r: r["length"] > 0).alias("runs"))


def _spot(doc_id: Column, t1: Column) -> Column:
    return F.xxhash64(doc_id, t1).bitwiseAND(F.lit((1 << MAP_BITS) - 1))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, keep: tuple[str, ...] = (), made: Column | None = None) -> DataFrame:
    """doc_id, the columns ``keep``, text with the kept lines only, n_lines and n_dropped.

    A text that loses nothing comes back as it is; a null one is empty.  ``made`` is a column of ``text``
    to have instead of it, worked out where the text is.  ``bitmaps`` is read twice and should be a written table.
    """
    t1, t2 = hash128(F.col("text").cast("string"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), t1.alias("t1"), t2.alias("t2"), *keep)
    b = bitmaps.select(F.col("doc_id").alias("_d"), F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), "n_dropped", "runs")
    spot = _spot(F.col("_d"), F.col("_t1"))
    bits = b.groupBy(F.shiftright(spot, 6).alias("_word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(xxhash64(_d, _t1) & 63 as int))")).alias("_bits"))
    mine = _spot(F.col("doc_id"), F.col("t1"))
    base = base.withColumn("_spot", mine).join(F.broadcast(bits), F.shiftright("_spot", 6) == F.col("_word"), "left")  # 2^MAP_BITS / 64 rows at most
    may = F.coalesce(F.expr("shiftright(_bits, cast(_spot & 63 as int)) & 1"), F.lit(0)) == 1
    # lines are counted by their separators: no array where nothing is dropped
    n_lines = (F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))).cast("long") + 1
    lines = _lines(F.col("text"))
    kept = F.array_join(F.flatten(F.transform("runs", lambda r: F.slice(lines, r["start"] + 1, r["length"]))), "\n")
    out = F.col("text") if made is None else made
    name = "text" if made is None else "made"

    def done(df: DataFrame, dropped: Column) -> DataFrame:
        return df.select("doc_id", *keep, out.alias(name), "n_lines", dropped.cast("long").alias("n_dropped"))

    base = base.withColumn("n_lines", n_lines)
    both = base.where(may).drop("_spot", "_word", "_bits")
    both = both.join(b, both["doc_id"].eqNullSafe(F.col("_d")) & (both["t1"] == F.col("_t1")) & (both["t2"] == F.col("_t2")), "left")
    both = both.withColumn("text", F.when(F.col("runs").isNull(), F.col("text")).otherwise(kept))
    return done(base.where(~may), F.lit(0)).unionByName(done(both, F.coalesce(F.col("n_dropped"), F.lit(0))))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 for every row of ``docs``.

    Takes ``doc_id`` and ``text``; other columns are ignored.  Null and empty
    texts are one empty line.  Repeated rows each come out, and count as one
    document.  A document that loses every line keeps the empty text.  An
    empty table gives an empty table.
    """
    bitmaps = cut(line_bitmaps(docs, min_chars, min_docs), "bitmaps")
    out = apply_bitmaps(docs, bitmaps, made=F.sha2(F.col("text").cast("binary"), 256))
    return out.select("doc_id", "n_lines", "n_dropped", F.col("made").alias("kept_sha256"))


ORACLE_SQL = r"""
WITH lines AS (
    SELECT doc_id, coalesce(text, '') AS text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
spread AS (
    SELECT k, max(doc_id) AS holder FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
    SELECT keyed.*, spread.k IS NOT NULL AND doc_id IS DISTINCT FROM holder AS gone FROM keyed LEFT JOIN spread USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
