"""Byte-level BPE encoding and decoding by DuckDB recursive queries in each partition.

A text is split by the vocabulary's pattern.  A piece that is itself in the
vocabulary is one token.  Of the others, the distinct ones that this Python
worker hasn't met go to DuckDB as rows (word and position in one number, token).  Each step of a recursive
query joins neighbouring tokens to the merge table and contracts each word's
pairs of least rank, from the left; words without a pair are done.  Its state is
keyed by that number, so it has a row for each byte at most, however many steps
there are.  The ids of whole documents are decoded by an ordered aggregation of
their tokens' bytes, for a slice of documents at once.

The merge table has (left, right, merged) for every way to put a vocabulary
token together from two others; ranks are token ids, so it needs no merge list.
Its size is the vocabulary's.  All pairs of a word that make its least token are contracted in one
step, since what comes of the first can't rank lower; tokens of which that isn't true
(``alone``: they are part of a token of lower rank) are contracted one by one, as the definition has it.

Before that, words are cut where no token can span: a place of which neither the two bytes
around it are a token, nor the three, nor any four are within one.  That is exact, for words of any length, and keeps those
of unspaced script short.  Texts go through in slices of ``SLICE`` characters'
worth of whole texts and ``ROWS`` bytes' worth of whole words, so memory depends on the longest text and word only.
DuckDB has no folder to spill to.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE = 2_000_000
ROWS = 600_000
CACHED = 150_000
_DUCKDB = {"threads": 1, "memory_limit": "500MB", "temp_directory": ""}

_ENCODE = """
WITH RECURSIVE step(spot, tok) USING KEY (spot) AS (
    SELECT spot, tok FROM start_rows
    UNION ALL
    (WITH live AS (
        SELECT spot, tok, lead(tok) OVER w AS ntok, lead(spot) OVER w AS next FROM step WHERE tok >= 0 WINDOW w AS (ORDER BY spot)),
    pairs AS (
        SELECT spot, next, spot >> 32 AS word, merged, alone FROM live JOIN merges ON l = tok AND r = ntok
        WHERE spot >> 32 = next >> 32),
    least AS (SELECT word, min(merged) AS merged FROM pairs GROUP BY word),
    hits AS (
        SELECT spot, next, word, merged, alone, lag(next) OVER w IS NOT DISTINCT FROM spot AS joined, row_number() OVER w AS nth
        FROM pairs JOIN least USING (word, merged) WINDOW w AS (ORDER BY spot)),
    runs AS (
        SELECT *, max(CASE WHEN NOT joined THEN nth END) OVER w AS first, lag(word) OVER w IS DISTINCT FROM word AS leftmost
        FROM hits WINDOW w AS (ORDER BY spot)),
    taken AS (SELECT spot, next, merged FROM runs WHERE CASE WHEN alone THEN leftmost ELSE (nth - first) % 2 = 0 END),
    new AS (SELECT spot, merged AS tok FROM taken UNION ALL SELECT next, -1 FROM taken)
    SELECT live.spot, coalesce(new.tok, live.tok) AS tok
    FROM live SEMI JOIN least ON least.word = live.spot >> 32 LEFT JOIN new ON new.spot = live.spot))
SELECT spot >> 32 AS word, list(tok ORDER BY spot) AS ids FROM step WHERE tok >= 0 GROUP BY word
"""

_DECODE = "SELECT list(b ORDER BY i) AS bytes FROM ids_in LEFT JOIN vocab USING (id)"


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a ``.tiktoken`` file: token bytes -> id."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _fill(db: duckdb.DuckDBPyConnection, name: str, rows: pa.Table) -> None:
    db.register("rows_in", rows)
    db.execute(f"CREATE TABLE {name} AS SELECT * FROM rows_in")
    db.unregister("rows_in")


class Decoder:
    """A vocabulary's bytes in DuckDB."""

    def __init__(self, ranks: dict[bytes, int]):
        self.db = duckdb.connect(":memory:", config=_DUCKDB)
        _fill(self.db, "vocab", pa.table({"id": pa.array(ranks.values(), pa.int32()), "b": pa.array(ranks, pa.binary())}))

    def decode(self, ids: list[np.ndarray]) -> Iterator[bytes]:
        """The bytes of each list of ids, in order; an id that isn't in the vocabulary raises."""
        ends = np.cumsum([0, *map(len, ids)]).tolist()
        if not ends[-1]:
            yield from (b"" for _ in ids)
            return
        self.db.register("ids_in", pa.table({"i": np.arange(ends[-1], dtype=np.int32), "id": np.concatenate(ids).astype(np.int32)}))
        values = self.db.sql(_DECODE).to_arrow_table()["bytes"].combine_chunks().values
        self.db.unregister("ids_in")
        if values.null_count:
            raise ValueError("unknown id")
        # the tokens' bytes lie side by side in the list's buffer
        wide = pa.types.is_large_binary(values.type)
        at = np.frombuffer(values.buffers()[1], np.int64 if wide else np.int32)[values.offset :]
        data = memoryview(values.buffers()[2])
        for a, b in zip(ends, ends[1:]):
            yield bytes(data[at[a] : at[b]])


class Bpe(Decoder):
    """A vocabulary in DuckDB and what this worker has encoded with it lately."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__(ranks)
        self.ranks = ranks
        self.findall = regex.compile(pattern).findall
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        found = [(ranks[t[:i]], ranks[t[i:]], m) for t, m in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        m = np.array(found, np.int32).reshape(-1, 3)
        lower = np.zeros(max(ranks.values()) + 1, bool)
        lower[m[m[:, 2] < m[:, 0], 0]] = True
        lower[m[m[:, 2] < m[:, 1], 1]] = True
        _fill(self.db, "merges", pa.table({"l": m[:, 0], "r": m[:, 1], "merged": m[:, 2], "alone": lower[m[:, 2]]}))
        self.two, self.three = np.zeros(1 << 16, bool), np.zeros(1 << 24, bool)
        self.two[[int.from_bytes(t, "big") for t in ranks if len(t) == 2]] = True
        self.three[[int.from_bytes(t, "big") for t in ranks if len(t) == 3]] = True
        four = {int.from_bytes(t[i : i + 4], "big") for t in ranks if len(t) > 3 for i in range(len(t) - 3)}
        self.four = np.array(sorted(four), np.uint32)
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _places(self, data: np.ndarray) -> np.ndarray:
        """Whether a token may span the place before each byte."""
        spans = np.zeros(len(data), bool)
        b = data.astype(np.uint32)
        two = b[:-1] << 8 | b[1:]
        spans[1:] |= self.two[two]
        three = two[:-1] << 8 | b[2:]
        found = self.three[three]
        spans[1:-1] |= found
        spans[2:] |= found
        four = three[:-1] << 8 | b[3:]
        if len(four) and len(self.four):
            found = self.four[np.minimum(np.searchsorted(self.four, four), len(self.four) - 1)] == four
            for k in (1, 2, 3):
                spans[k : len(data) - 3 + k] |= found
        return spans

    def _query(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian 32-bit integers."""
        joined = b"".join(words)
        data = np.frombuffer(joined, np.uint8)
        starts = np.cumsum([0, *map(len, words)])
        fresh = ~self._places(data) if len(data) > 3 else np.ones(len(data), bool) if len(data) < 2 else np.zeros(len(data), bool)
        fresh[starts[:-1]] = True
        ends = np.append(np.flatnonzero(fresh), len(data))
        parts = [joined[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())]
        known: dict[bytes, bytes] = {}
        todo = []
        for p in dict.fromkeys(parts):
            if len(p) == 1:
                known[p] = int(self.byte[p[0]]).to_bytes(4, "little")
            else:
                todo.append(p)
        if todo:
            known.update(zip(todo, self._merge(todo)))
        ids = [known[p] for p in parts]
        of = np.searchsorted(ends, starts).tolist()
        return [ids[a] if b == a + 1 else b"".join(ids[a:b]) for a, b in zip(of, of[1:])]

    def _merge(self, words: list[bytes]) -> list[bytes]:
        size = np.fromiter(map(len, words), np.int64, len(words))
        tok = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        at = np.repeat(np.arange(len(words), dtype=np.int64) << 32, size) + np.arange(len(tok))
        self.db.register("start_rows", pa.table({"spot": at, "tok": tok}))
        got = self.db.sql(_ENCODE).to_arrow_table()
        self.db.unregister("start_rows")
        ids = got["ids"].combine_chunks()
        flat, ends = ids.values.to_numpy().astype("<u4"), ids.offsets.to_numpy()
        out = [b""] * len(words)
        for k, w in enumerate(got["word"].to_pylist()):
            out[w] = flat[ends[k] : ends[k + 1]].tobytes()
        return out

    def learn(self, pieces: Iterable[str]) -> None:
        """Have every one of the pieces in ``new``."""
        todo: list[tuple[str, bytes]] = []
        rows = 0

        def ask() -> None:
            if todo:
                self.new.update(zip((p for p, _ in todo), self._query([r for _, r in todo])))

        for p in pieces:
            if (known := self.old.get(p)) is not None:
                self.new[p] = known
                continue
            raw = p.encode()
            if (i := self.ranks.get(raw)) is not None:
                self.new[p] = i.to_bytes(4, "little")
                continue
            if todo and rows + len(raw) > ROWS:
                ask()
                todo, rows = [], 0
            todo.append((p, raw))
            rows += len(raw)
        ask()

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """(ids as little-endian 32-bit integers, the bytes that they decode to) of each text, in order."""
        at = 0
        while at < len(texts):
            split, chars = [], 0
            while at < len(texts) and (not split or chars + len(texts[at]) <= SLICE):
                split.append(self.findall(texts[at]))
                chars += len(texts[at])
                at += 1
            met = set().union(*split)
            self.learn(p for p in met if p not in self.new)
            known = self.new
            ids = [b"".join([known[p] for p in pieces]) for pieces in split]
            yield from zip(ids, self.decode([np.frombuffer(x, "<u4").astype(np.int32) for x in ids]))
            if len(self.new) > CACHED:
                self.old, self.new = self.new, {}


#: Vocabularies of this Python worker, by the file's digest and the pattern.
_WORKER: dict[tuple[str, str], Bpe] = {}


def _bpe(ranks: dict[bytes, int], key: str, pattern: str) -> Bpe:
    if (key, pattern) not in _WORKER:
        _WORKER.clear()
        _WORKER[key, pattern] = Bpe(ranks, pattern)
    return _WORKER[key, pattern]


def encode(docs: DataFrame, path: str, pattern: str, *, keep_ids: bool = True) -> DataFrame:
    """Encode the whole ``text`` of every row, and decode the ids again.

    ``path`` is the rank file; it is read on the driver and sent to the
    executors (its size is the vocabulary's).  Takes the columns ``doc_id`` and
    ``text`` (null: empty) and ignores others.  Returns, one row for each row:
    doc_id, n_tokens, ids (array of int, if ``keep_ids``), ids_sha256 of the ids as
    little-endian unsigned 32-bit integers, and decoded_sha256.  Empty texts have no ids; repeated rows
    and doc_ids each come out; an empty table gives an empty table.
    """
    ranks = load_ranks(path)
    key = hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(shared.value, key, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids, n, sha, back = [], [], [], []
                for raw, text in bpe.encode([t.as_py() or "" for t in part.column(1)]):
                    n.append(len(raw) // 4)
                    sha.append(hashlib.sha256(raw).hexdigest())
                    back.append(hashlib.sha256(text).hexdigest())
                    if keep_ids:
                        ids.append(np.frombuffer(raw, "<u4").astype(np.int32))
                cols = [part.column(0), pa.array(n, pa.int64()), *([pa.array(ids, pa.list_(pa.int32()))] if keep_ids else []), pa.array(sha, pa.string()), pa.array(back, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=names)
        bpe.new, bpe.old = {}, {}  # the worker may stay idle for long

    names = ["doc_id", "n_tokens", *(["ids"] if keep_ids else []), "ids_sha256", "decoded_sha256"]
    schema = "doc_id long, n_tokens long, " + ("ids array<int>, " if keep_ids else "") + "ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def decode(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) to (doc_id, data): the tokens' bytes in order, by an ordered aggregation in DuckDB.

    Null ids give null, no ids give empty bytes; an id that isn't in the
    vocabulary raises.
    """
    shared = rows.sparkSession.sparkContext.broadcast(load_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = [x.as_py() for x in part.column(1)]
                data = decoder.decode([np.array(x or [], np.int32) for x in lists])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([None if x is None else d for x, d in zip(lists, data)], pa.binary())], names=["doc_id", "data"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, data binary")
