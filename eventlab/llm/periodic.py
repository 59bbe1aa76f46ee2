"""Periodic runs of words by difference-cover LCE queries over harmonic grids.

A run is a stretch of words with smallest period q, at least ``least`` and 2q words long, that no neighbour
extends.  It contains two neighbouring points of the grid 0, q, 2q, ..., so for each q the
grid's pairs (i, i + q) are asked how far the words from them agree (LCE) and how far those before them
do: together q or more words make a run.  Grids have n/q pairs, all of them n log n.

LCE queries: of the suffixes only those at places in a difference cover modulo ``COVER`` are sorted.  For any two places a
shift under ``COVER`` takes both into the cover, so that many words are compared one
by one, and most pairs differ there.  Where both places are sampled, the longest common prefix of
two suffixes is the least entry between their ranks, by a sparse table, in blocks of ``COVER`` words; the last block is compared by words.
Agreement to the left is the same over the words in reverse.

Texts are worked on in slices, the longest first, as one row of numbered words with a
number of its own after each, so that nothing agrees across texts and a grid of period q reads
the texts of 2q words and more only.  Suffixes are sorted for those texts alone that have a pair which
agrees up to a sampled place.  Nothing moves between tasks; memory grows with a slice or the longest text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of whole texts in a slice, and pairs that are asked at once.
SLICE, AT_ONCE = 4_000_000, 1_000_000
#: Every difference modulo 13 is one of two of these.
COVER, SAMPLES = 13, (0, 1, 3, 9)
#: Periods up to this are asked by strides, larger ones many at once.
STRIDES = 256


def _shifts() -> np.ndarray:
    """For two remainders the least shift that takes both into the cover."""
    inside = np.isin(np.arange(2 * COVER) % COVER, SAMPLES)
    r = np.arange(COVER)
    both = np.stack([inside[(r + k) % COVER][:, None] & inside[(r + k) % COVER][None, :] for k in range(COVER)])
    return both.argmax(0)


SHIFT = _shifts()


def _ranked(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


class CoverLCE:
    """Lengths of agreement between places of ``codes``, of which the last one occurs once."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        top = int(codes.max(initial=0)) + 1
        # numbers of their own after the end, so that blocks can be read there
        self.codes = np.r_[codes, np.arange(top, top + 2 * COVER)]
        self._sorted = False

    def _sort(self) -> None:
        """Ranks of the sampled suffixes and the sparse table over what neighbours in rank have in common, in blocks."""
        classes = [np.arange(a, self.n + 1, COVER) for a in SAMPLES]
        place = np.concatenate(classes)
        blocks, top = self.codes[place], int(self.codes.max()) + 1
        for k in range(1, COVER):  # numbers of whole blocks, one word more at a time
            blocks = _ranked(blocks * top + self.codes[place + k])
        ends = np.cumsum([len(c) for c in classes])
        rest = np.repeat(ends, [len(c) for c in classes]) - np.arange(len(place))  # blocks to the end of the class
        levels, step = [blocks], 1
        while len(blocks) and levels[-1].max() < len(place) - 1 and step < len(place):
            now = levels[-1]
            after = np.where(rest > step, np.r_[now[step:], np.zeros(step, np.int64)] + len(SAMPLES), np.searchsorted(ends, np.arange(len(place)), side="right"))
            levels.append(_ranked(now * (len(place) + len(SAMPLES) + 1) + after))
            step *= 2
        rank = levels[-1]
        order = np.empty(len(rank), np.int64)
        order[rank] = np.arange(len(rank))
        common = np.zeros(len(order), np.int64)
        x, y = order[:-1].copy(), order[1:].copy()
        for k in range(len(levels) - 1, -1, -1):
            inside = (x < len(rank)) & (y < len(rank))
            same = inside & (levels[k][np.where(inside, x, 0)] == levels[k][np.where(inside, y, 0)])
            common[1:] += same << k
            x, y = x + (same << k), y + (same << k)
        self.table = [common]
        width = 1
        while 2 * width <= len(common):
            self.table.append(np.minimum(self.table[-1][:-width], self.table[-1][width:]))
            width *= 2
        self.rank = np.full(self.n + COVER, -1, np.int64)
        self.rank[place] = rank
        self._sorted = True

    def _compare(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many of the next words agree, up to ``most`` (at most COVER)."""
        n = np.zeros(len(i), np.int64)
        live = np.flatnonzero(most > 0)
        while len(live):
            at = n[live]
            live = live[self.codes[i[live] + at] == self.codes[j[live] + at]]
            n[live] += 1
            live = live[n[live] < most[live]]
        return n

    def ask(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For places i < j how many words from there on agree."""
        shift = SHIFT[i % COVER, j % COVER]
        n = self._compare(i, j, shift)
        on = np.flatnonzero(n == shift)
        if not len(on):
            return n
        # most that are left differ in the first word
        on = on[self.codes[i[on] + n[on]] == self.codes[j[on] + n[on]]]
        if not len(on):
            return n
        if not self._sorted:
            self._sort()
        a, b = self.rank[i[on] + n[on]], self.rank[j[on] + n[on]]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        blocks = np.zeros(len(on), np.int64)
        for k in np.unique(level):
            of = level == k
            blocks[of] = np.minimum(self.table[k][low[of]], self.table[k][high[of] - (1 << k)])
        n[on] += blocks * COVER
        n[on] += self._compare(i[on] + n[on], j[on] + n[on], np.full(len(on), COVER))
        return n


def _pairs(codes: np.ndarray, lens: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, q) of the grids' pairs that agree in their own word or in the one before; texts are in order of length, the longest first."""
    begins = np.r_[0, np.cumsum(lens + 1)]
    longest = int(lens[0]) // 2 if len(lens) else 0

    def upto(q: np.ndarray) -> np.ndarray:
        """Words of the texts of 2q words or more."""
        return begins[np.searchsorted(-lens, -2 * q, side="right")]

    def agree(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (codes[i] == codes[j]) | (codes[np.maximum(i - 1, 0)] == codes[np.maximum(j - 1, 0)]) & (i > 0)

    small = np.arange(1, min(longest, STRIDES) + 1)
    for q, end in zip(small.tolist(), upto(small).tolist()):
        part = codes[:end]
        same = part[:-q:q] == part[q::q]
        if q > 1:
            before = part[q - 1 : -q : q] == part[2 * q - 1 :: q]
            same[1 : 1 + len(before)] |= before[: len(same) - 1]
        i = np.flatnonzero(same) * q
        yield i, np.full(len(i), q)
    large = np.arange(STRIDES + 1, longest + 1)
    points = np.maximum(-(-upto(large) // large) - 1, 0)
    for at in np.split(np.arange(len(large)), np.flatnonzero(np.diff(np.cumsum(points) // AT_ONCE)) + 1):
        if not len(at):
            continue
        q = np.repeat(large[at], points[at])
        i = (np.arange(len(q)) - np.repeat(np.cumsum(points[at]) - points[at], points[at])) * q
        ok = agree(i, i + q)
        yield i[ok], q[ok]


def find_runs(codes: np.ndarray, lens: np.ndarray, least: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of several texts, in order of start and period.

    ``codes`` has numbers of words, and after each text one that occurs once; ``lens`` are the texts'
    numbers of words, the largest first.
    """
    n = len(codes)
    ahead, back = CoverLCE(codes), CoverLCE(np.r_[codes[:-1][::-1], codes[-1:]])
    found: list[np.ndarray] = []
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def judge() -> None:
        if not waiting:
            return
        every, periods = (np.concatenate(x) for x in zip(*waiting))
        waiting.clear()
        for at in range(0, len(every), AT_ONCE):
            i, q = every[at : at + AT_ONCE], periods[at : at + AT_ONCE]
            right = ahead.ask(i, i + q)
            # in reverse the word before i is at n - 2 - (i - 1); the first word of all has none before it
            left = np.zeros(len(i), np.int64)
            has = i > 0
            left[has] = back.ask(n - 1 - i[has] - q[has], n - 1 - i[has])
            # a run is told by its leftmost pair
            ok = (left < q) & (left + right >= np.maximum(q, least - q))
            found.append(np.stack([i[ok] - left[ok], q[ok] + left[ok] + right[ok], q[ok]]))

    for i, q in _pairs(codes, lens):
        if len(i):
            waiting.append((i, q))
            if sum(len(w[0]) for w in waiting) >= AT_ONCE:
                judge()
    judge()
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, length, period = np.concatenate(found, 1)
    # the same stretch with a multiple of its period is not another run
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.r_[True, (np.diff(start) != 0) | (np.diff(length) != 0)][: len(start)]  # pairs may agree and none make a run
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


Prepare = Callable[[int | None, list[bytes]], list[bytes]]


def _slice_runs(split: list[list[bytes]], least: int) -> Iterator[tuple[list[tuple[int, int, int]], bytes]]:
    """For each text its runs and what is left of it: (start, length, period) and the words that no run repeats."""
    order = sorted(range(len(split)), key=lambda k: -len(split[k]))
    code: dict[bytes, int] = {}
    words = list(chain.from_iterable(split[k] for k in order))
    numbers = np.fromiter((code.setdefault(w, len(code)) for w in words), np.int64, len(words))
    lens = np.fromiter((len(split[k]) for k in order), np.int64, len(order))
    ends = np.cumsum(lens + 1) - 1
    codes = np.empty(len(words) + len(order), np.int64)
    is_end = np.zeros(len(codes), bool)
    is_end[ends] = True
    codes[~is_end] = numbers
    codes[ends] = len(code) + np.arange(len(order))
    start, length, period = find_runs(codes, lens, least)
    text = np.searchsorted(ends, start)
    bounds = np.searchsorted(text, np.arange(len(order) + 1))
    begins = ends - lens
    done: list[tuple[list[tuple[int, int, int]], bytes]] = [([], b"")] * len(split)
    for at, k in enumerate(order):
        of = slice(bounds[at], bounds[at + 1])
        runs = list(zip((start[of] - begins[at]).tolist(), length[of].tolist(), period[of].tolist()))
        kept = split[k]
        if runs:
            gone = np.zeros(len(kept) + 1, np.int64)
            for s, n, q in runs:
                gone[s + q] += 1
                gone[s + n] -= 1
            kept = [w for w, g in zip(kept, np.cumsum(gone).tolist()) if not g]
        done[k] = (runs, b" ".join(kept))
    yield from done


RUNS = "array<struct<start: long, length: long, period: long>>"


def periodic_runs(docs: DataFrame, least: int = 12, prepare: Prepare | None = None) -> DataFrame:
    """doc_id, n_words, ``runs`` (start, length, period; by start, then period) and ``collapsed`` (binary) for every row of ``docs``.

    Takes ``doc_id`` and ``text``; other columns are ignored.  Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0; null and empty texts have
    none.  ``collapsed`` has the words, joined by one space, that are in no run after its first period.
    ``prepare`` may change the words first, given the doc_id (which may be null).  Repeated rows
    each come out; an empty table gives an empty table.
    """
    out = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, at = batch.column(0), batch.column(1), 0
            while at < batch.num_rows:
                first, size, split = at, 0, []
                while at < batch.num_rows and (at == first or size < SLICE):
                    raw = texts[at].as_py() or b""
                    size += len(raw)
                    words = raw.split()
                    split.append(prepare(ids[at].as_py(), words) if prepare else words)
                    at += 1
                runs, kept = zip(*_slice_runs(split, least))
                flat = np.array(list(chain.from_iterable(runs)), np.int64).reshape(-1, 3)
                offsets = pa.array(np.r_[0, np.cumsum([len(r) for r in runs])], pa.int32())
                structs = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
                cols = [ids.slice(first, at - first), pa.array([len(w) for w in split], pa.int64()), pa.ListArray.from_arrays(offsets, structs).cast(out), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "runs", "collapsed"])

    work = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return work.mapInArrow(run, f"doc_id long, n_words long, runs {RUNS}, collapsed binary")


def longest_run(runs: Column) -> Column:
    """The run of greatest length; of several that of the smallest start, then period.  Null if there is none."""
    key = F.transform(runs, lambda r: F.struct((-r["length"]).alias("length"), r["start"].alias("start"), r["period"].alias("period")))
    best = F.array_min(key)
    return F.when(best.isNotNull(), F.struct(best["start"].alias("start"), (-best["length"]).alias("length"), best["period"].alias("period")))
