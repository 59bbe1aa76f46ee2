"""Substring dedup: windows of words go to the bucket of their minimiser, packed as super-k-mers.

A window is ``width`` consecutive words of one document.  Its minimiser is the
run of ``seed_words`` words in it with the least hash, the leftmost of equal ones, so
equal windows have equal minimisers.  Consecutive windows that share one occurrence of a minimiser
travel as one packed string, their words: some three words for each window word instead of twenty.

A first pass counts minimisers; those that occur once have windows that occur once,
so their strings stay where they are.  Which occur again is told by a map of fixed
size (``MAP_BITS`` bits, whatever the input); a full map only sends more strings.

Strings are range-partitioned by minimiser, string and place (document, start) and
sorted, so a bucket that is too large for a task is cut into several.  A task streams its buckets.  Of
equal strings the first place stands for all and the others repeat it whole.  The
windows of the different strings of a bucket are unpacked and sorted together with their places: all but the
first place of equal windows repeat.  A bucket of more windows than are sorted at once is judged in parts.  Parts, and
the first and the last bucket of a partition, can go on elsewhere; of each of their windows the first place in the part is left
open, and a grouping by the window's digest, of one row for each part at most, tells which of these is first of all.

A worker holds a slice of texts as Arrow arrays and one part of a bucket, however large partitions and buckets are.

What comes back for a document are the stretches of words that such windows cover.  Texts
without any stay where they are read, told by another map of that size.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlab.llm.tables import cut

#: Bits of the two maps.
MAP_BITS = 26
#: Bytes of whole texts that are worked on at once.
SLICE = 1_000_000
#: Windows of a bucket that are sorted at once; a larger bucket is judged in parts of little more.
AT_ONCE = 100_000

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _least_at(g: np.ndarray, span: int) -> np.ndarray:
    """For each start the index of the least of ``span`` values, the leftmost of equal ones."""
    at, have = np.arange(len(g)), 1
    while have < span:
        step = min(have, span - have)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(g[b] < g[a], b, a)
        have += step
    return at


def super_kmers(hashes: np.ndarray, ends: np.ndarray, width: int, seed_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, minimiser) of the runs of windows that share a minimiser's occurrence.

    ``hashes`` are those of the words of several texts, ``ends`` the end of its text for each word.
    """
    if len(hashes) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = np.zeros(len(hashes) - seed_words + 1, np.uint64)
    for k in range(seed_words):
        g = g * _ODD + hashes[k : k + len(g)]
    g ^= g >> np.uint64(32)
    g *= _ODD
    g ^= g >> np.uint64(29)
    at = _least_at(g, width - seed_words + 1)
    starts = np.flatnonzero(ends[: len(at)] - np.arange(len(at)) >= width)
    if not len(starts):
        return starts, starts, np.zeros(0, np.uint64)
    new = np.flatnonzero(np.r_[True, (np.diff(starts) != 1) | (np.diff(at[starts]) != 0)])
    return starts[new], np.diff(np.r_[new, len(starts)]), g[at[starts[new]]]


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts without nulls) for slices of about SLICE bytes of whole texts."""
    texts, at = batch.column(column), 0
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    while at < len(texts):
        end = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLICE)) + 1
        yield at, texts.slice(at, end - at).cast(pa.binary()).fill_null(b"")
        at = min(end, len(texts))


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in a row, and how many each text has."""
    lists = pc.ascii_split_whitespace(texts.view(pa.string()))
    flat = lists.flatten().view(pa.binary())
    real = pc.not_equal(pc.binary_length(flat), 0)
    upto = np.r_[0, np.cumsum(real.to_numpy(zero_copy_only=False))]
    return flat.filter(real), np.diff(upto[lists.offsets.to_numpy()])


def _runs_of(texts: pa.Array, width: int, seed_words: int):
    """Words of all texts in a row, first word of each text, text of each word, and the super-k-mers; each different word is hashed once."""
    words, lens = _split(texts)
    coded = words.dictionary_encode()
    each = np.fromiter(map(xxhash.xxh64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    hashes = each[coded.indices.to_numpy()]
    begins = np.cumsum(lens) - lens
    return words, begins, np.repeat(np.arange(len(lens)), lens), super_kmers(hashes, np.repeat(begins + lens, lens), width, seed_words)


def _base(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    doc = F.col("doc_id").cast("long")
    return docs.select(doc.isNull().alias("none"), F.coalesce(doc, F.lit(0)).alias("doc"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("t"), text.cast("binary").alias("text"))


def _bitmap(bits: DataFrame) -> np.ndarray:
    """The bits that the column ``bit`` sets, as bytes: 2^MAP_BITS bits, whatever the input."""
    words = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()
    found = np.zeros(1 << MAP_BITS - 6, np.int64)
    found[words["word"].to_numpy()] = words["bits"].to_numpy()
    return found.view(np.uint8)


def _low(mark: Column) -> Column:
    return mark.bitwiseAND(F.lit((1 << MAP_BITS) - 1))


def _set(bitmap: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """For each mark whether its bit is set."""
    spot = (marks & np.uint64((1 << MAP_BITS) - 1)).astype(np.int64)
    return bitmap[spot >> 3] >> (spot & 7).astype(np.uint8) & 1 == 1


def repeated_minimisers(docs: DataFrame, width: int, seed_words: int) -> DataFrame:
    """(mini) of the minimisers of two super-k-mers or more; slices are counted before anything moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in _slices(batch, 0):
                mini, n = np.unique(_runs_of(texts, width, seed_words)[3][2], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(mini.view(np.int64)), pa.array(n)], names=["mini", "n"])

    found = docs.select(F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, "mini long, n long")
    return found.groupBy("mini").agg(F.sum("n").alias("n")).where("n > 1").select("mini")


def packed(docs: DataFrame, bitmap: np.ndarray, width: int, seed_words: int) -> DataFrame:
    """(mini, words, none, doc, t, start): the super-k-mers whose minimiser's bit is set."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            for at, texts in _slices(batch, 3):
                words, begins, text_of, (first, n, mini) = _runs_of(texts, width, seed_words)
                live = _set(bits, mini)
                first, n, mini = first[live], n[live], mini[live]
                row = text_of[first]
                place = np.r_[0, np.cumsum(pc.binary_length(words).to_numpy().astype(np.int64) + 1)]
                every = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), b" ")[0].as_py()
                strings = [every[a:b] for a, b in zip(place[first].tolist(), (place[first + n + width - 1] - 1).tolist())]
                keys = [batch.column(k).take(pa.array(row + at)) for k in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(mini.view(np.int64)), pa.array(strings, pa.binary()), *keys, pa.array((first - begins[row]).astype(np.int64))], names=["mini", "words", "none", "doc", "t", "start"])

    return _base(docs).mapInArrow(run, "mini long, words binary, none boolean, doc long, t long, start long")


Place = tuple[bool, int, int, int]


def _windows(string: bytes, width: int) -> list[bytes]:
    parts = string.split(b" ")
    at = [0, *accumulate(len(p) + 1 for p in parts)]
    return [string[at[j] : at[j + width] - 1] for j in range(len(parts) - width + 1)]


def _bucket(strings: list[tuple[bytes, Place]], width: int) -> tuple[list[Place], list[tuple[Place, bytes]]]:
    """Of the windows of a bucket's strings: the places that repeat an earlier one, and the first place of each window."""
    n = sum(s.count(b" ") + 2 - width for s, _ in strings)
    passes = -(-n // AT_ONCE)
    again, firsts = [], []
    for k in range(passes):
        rows = []
        for s, (none, doc, t, start) in strings:
            rows += [(w, (none, doc, t, start + j)) for j, w in enumerate(_windows(s, width)) if passes == 1 or zlib.crc32(w) % passes == k]
        rows.sort()
        last, first = None, None
        for w, place in rows:
            if w != last:
                last, first = w, place
                firsts.append((place, w))
            elif place != first:
                again.append(place)
    return again, firsts


def _stretches(places: list[Place], width: int) -> Iterator[tuple[bool, int, int, int, int]]:
    """(none, doc, t, from, to): the words that windows at these places cover, overlapping ones as one."""
    places.sort()
    now = None
    for none, doc, t, start in places:
        if now and now[:3] == (none, doc, t) and start <= now[4]:
            now = (*now[:4], start + width)
        else:
            if now:
                yield now
            now = (none, doc, t, start, start + width)
    if now:
        yield now


def _judge(width: int):
    """For rows in order of mini, words' hash and place: rows (none, doc, t, from, to, digest); those with a digest are open."""
    names = ["none", "doc", "t", "from", "to", "digest"]
    types = [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mini, is_first, strings, repeats = None, True, [], []
        last, stands, out = None, None, []
        held, parted = 0, False

        def close(is_last: bool) -> None:
            """The bucket, or a part of it, ends here."""
            nonlocal is_first, strings, repeats, held
            if mini is None:
                return
            is_open = is_first or is_last or parted
            again, firsts = _bucket(strings, width) if is_open or len(strings) > 1 else ([], [])
            out.extend((*s, None) for s in _stretches(again, width))
            out.extend(repeats)
            if is_open:
                out.extend((*p, p[3] + width, hashlib.blake2b(w, digest_size=16).digest()) for p, w in firsts)
            is_first, strings, repeats, held = False, [], [], 0

        def frame() -> pa.RecordBatch:
            cols = list(zip(*out)) or [()] * 6
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

        for batch in batches:
            for m, words, *place in zip(*(batch.column(k).to_pylist() for k in range(6))):
                place = tuple(place)
                if m != mini:
                    close(False)
                    mini, last, parted = m, None, False
                if words != last:
                    if held >= AT_ONCE:
                        parted = True
                        close(False)
                    last, stands = words, place
                    strings.append((words, place))
                    held += words.count(b" ") + 2 - width
                elif place != stands:
                    repeats.append((*place, place[3] + words.count(b" ") + 1, None))
                    if len(repeats) >= AT_ONCE:
                        out.extend(repeats)
                        repeats = []
                if len(out) >= AT_ONCE:
                    yield frame()
            yield frame()
        close(True)
        yield frame()

    return run


def repeated_stretches(docs: DataFrame, width: int = 20, seed_words: int = 4) -> DataFrame:
    """(none, doc, t, stretches): for each document with repeated windows the stretches (from, to) of words that they cover.

    A document is its doc_id (``none``: null, then doc is 0) and a hash ``t`` of its text.  A window repeats if it also starts at an
    earlier place: a smaller doc_id, null last, or the same document further left; documents of one doc_id are in order of ``t``.
    """
    if not 1 <= seed_words <= width:
        raise ValueError("seed_words must be between 1 and width")
    bitmap = _bitmap(repeated_minimisers(docs, width, seed_words).select(_low(F.col("mini")).alias("bit")))
    rows = cut(packed(docs, bitmap, width, seed_words), "packed").withColumn("k", F.xxhash64("words"))
    order = ["mini", "k", "none", "doc", "t", "start"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("k")
    schema = "none boolean, doc long, t long, `from` long, `to` long, digest binary"
    found = cut(rows.select("mini", "words", "none", "doc", "t", "start").mapInArrow(_judge(width), schema), "found")
    # each part of a bucket has one open place of a window at most
    place = F.struct("none", "doc", "t", "from")
    first = F.min(place).over(Window.partitionBy("digest"))
    later = found.where("digest is not null").withColumn("first", first).where(place > F.col("first"))
    every = found.where("digest is null").drop("digest").unionByName(later.drop("digest", "first"))
    return every.groupBy("none", "doc", "t").agg(F.collect_set(F.struct("from", "to")).alias("stretches"))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts, stretches = batch.column(0), batch.column(1), batch.column(2)
        for at in range(0, batch.num_rows, 1024):
            n, gone, kept = [], [], []
            for raw, found in zip(texts.slice(at, 1024), stretches.slice(at, 1024)):
                words = (raw.as_py() or b"").split()
                n.append(len(words))
                if found := found.as_py():
                    keep, upto = [], 0
                    for s in sorted(found, key=lambda s: s["from"]):
                        keep += words[upto : s["from"]]
                        upto = max(upto, s["to"])
                    words = keep + words[upto:]
                gone.append(n[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([ids.slice(at, 1024), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])


def dedup_substrings(docs: DataFrame, width: int = 20, seed_words: int = 4) -> DataFrame:
    """doc_id, n_words, n_removed and ``kept`` (binary: the words that stay, joined by one space) for every row of ``docs``.

    Takes ``doc_id`` and ``text``; other columns are ignored.  Words are ``[^\\x20\\x09-\\x0D]+``; null and empty texts have none.
    A word goes if a window of ``width`` words that covers it also starts at an earlier place (see
    ``repeated_stretches``).  Rows that repeat in doc_id and text are one document and each come out with its result.
    Null doc_ids come after all others.  Texts shorter than a window keep all words.  An empty table gives an empty table.
    """
    stretches = cut(repeated_stretches(docs, width, seed_words), "stretches")
    mark = F.xxhash64("none", "doc", "t")
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(stretches.select(_low(mark).alias("bit"))))

    def told(is_set: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                marks = batch.column(batch.num_columns - 1).to_numpy().view(np.uint64)
                yield batch.filter(pa.array(_set(bitmap.value, marks) == is_set))

        return run

    base = _base(docs).withColumn("mark", mark)
    doc_id = F.when(~F.col("none"), F.col("doc")).alias("doc_id")
    schema = "doc_id long, n_words long, n_removed long, kept binary"
    some = base.mapInArrow(told(True), base.schema).join(stretches, ["none", "doc", "t"], "left").select(doc_id, "text", "stretches")
    # in one step, so that a task has one worker
    rest = base.select(doc_id, "text", F.lit(None).cast(stretches.schema["stretches"].dataType).alias("stretches"), "mark")
    return some.mapInArrow(_kept, schema).unionByName(rest.mapInArrow(lambda batches: _kept(told(False)(batches)), schema))


ORACLE_SQL = r"""
WITH texts AS (
    SELECT doc_id, [w FOR w IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF w <> ''] AS words FROM documents),
each AS (SELECT doc_id, words, unnest(words) AS word, unnest(range(len(words))) AS pos FROM texts),
windows AS (
    SELECT doc_id, pos, array_to_string(words[pos + 1 : pos + 20], ' ') AS w FROM each WHERE pos + 20 <= len(words)),
judged AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) > 1 AS again FROM windows),
covered AS (
    SELECT each.doc_id, each.pos, word,
           coalesce(bool_or(again) OVER (PARTITION BY each.doc_id ORDER BY each.pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS gone
    FROM each LEFT JOIN judged ON each.doc_id = judged.doc_id AND each.pos = judged.pos)
SELECT texts.doc_id, any_value(len(texts.words)) AS n_words, count(*) FILTER (gone) AS n_removed,
       sha256(coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM texts LEFT JOIN covered USING (doc_id) GROUP BY texts.doc_id
"""
