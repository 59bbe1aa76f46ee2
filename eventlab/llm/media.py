"""Media payloads in content-defined chunks.

A text's UTF-8 bytes, padded with zeros to a positive multiple of 64, are the
8-bit samples of a mono WAV file.  The file, header included, is cut where a rolling gear hash
of the last 16 bytes is zero in its top ``MASK_BITS`` bits, with a least and a largest
chunk.  Its manifest is the ordered list of its chunks' SHA-256 digests.

The store keeps each chunk once.  Files are grouped by digest, then the chunks of distinct
files: those that several files have, or one file several times, are shared.
Both sets of digests set bits of maps of fixed size (``MAP_BITS``) that tasks get.  A file's other
chunks are written together, as one pack, where the file is read; shared chunks, and the packs of files
that have copies, are shuffled by digest and the first of each is written.  So bytes of
neither kind don't cross the network.  A map fills up at some 10^8 digests that repeat; beyond that more and more
goes through the shuffle, with the same result.

Files are rebuilt from the store: a pack without shared chunks in its own task; the
others meet their shared chunks by joins of digests and are streamed in order.
Every digest is verified on the way, and a chunk or file that is missing raises.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlab.llm.tables import cut

#: Bytes of the least and the largest chunk, and bits of the hash that are zero at a cut: about 0.75 KB
#: to a chunk, as payloads have 2.5 KB on average.
LEAST, LARGEST, MASK_BITS = 256, 4 << 10, 9
MAP_BITS = 25
LEVEL = 6
#: Bytes of a WAV header.
HEADER = 44
#: One 16-bit number for each byte value, from a rule.
GEAR = np.array([xxhash.xxh64_intdigest(bytes([b]), 7) & 0xFFFF for b in range(256)], np.uint16)


def payload_of(text: bytes | None) -> bytes:
    raw = text or b""
    return raw + bytes(-len(raw) % 64 if raw else 64)


def header_of(n: int) -> bytes:
    """The header of a WAV file of n 8-bit samples, mono, 8000 a second."""
    return b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", n)


def media_of(payload: bytes) -> bytes:
    return header_of(len(payload)) + payload


def cuts(media: bytes) -> list[int]:
    """The ends of the chunks of a file."""
    n = len(media)
    if n <= LEAST:
        return [n]
    h = GEAR[np.frombuffer(media, np.uint8)]
    for k in (1, 2, 4, 8):  # sums of 2, 4, 8 and 16 shifted terms
        h[k:] += h[:-k] << np.uint16(k)
    spots = np.flatnonzero(h >> np.uint16(16 - MASK_BITS) == 0) + 1
    ends, at = [], 0
    while n - at > LEAST:
        k = np.searchsorted(spots, at + LEAST)
        end = min(int(spots[k]) if k < len(spots) else n, at + LARGEST, n)
        ends.append(end)
        at = end
    return [*ends, n] if at < n else ends


def chunks(media: bytes) -> list[bytes]:
    ends = cuts(media)
    return [media[a:b] for a, b in zip([0, *ends], ends)]


def _bit(digest: bytes, width: int) -> int:
    return int.from_bytes(digest[:7], "big") & (1 << width) - 1


def _mark(digest: Column) -> Column:
    """The first 56 bits of a digest: enough to tell which may repeat, as a chunk that is taken for shared is stored like those that are."""
    return F.conv(F.hex(F.substring(digest, 1, 7)), 16, 10).cast("long")


def marked(refs: DataFrame) -> DataFrame:
    """Manifests with ``marks`` instead of ``digests``."""
    return refs.withColumn("marks", F.transform("digests", _mark)).drop("digests")


def _bitmap(marks: DataFrame) -> np.ndarray:
    """The bits that the column ``mark`` sets, as bytes; 2^MAP_BITS bits, whatever the input."""
    low = F.col("mark").bitwiseAND(F.lit((1 << MAP_BITS) - 1))  # as _bit()
    words = marks.select(low.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(1 << MAP_BITS - 6, np.int64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy()
    return bits.view(np.uint8)


class Features:
    """What is computed of a file as its chunks come by."""

    def __init__(self, n: int):
        self.n = n
        self.media, self.payload = hashlib.sha256(), hashlib.sha256()
        self.head = b""
        self.tail, self.chunks, self.seen, self.total, self.squares, self.crossings, self.last = b"", 0, 0, 0, 0, 0, None

    def add(self, data: bytes) -> None:
        self.media.update(data)
        self.chunks += 1
        skip = min(len(data), HEADER - len(self.head))
        self.head += data[:skip]
        data = data[skip:]
        if not data:
            return
        self.payload.update(data)
        self.tail = (self.tail + data)[-64:]
        self.seen += len(data)
        x = np.frombuffer(data, np.uint8)
        high = x >= 128
        self.total += int(x.sum(dtype=np.int64))
        self.squares += int(np.einsum("i,i", x, x, dtype=np.int64))
        self.crossings += int(np.count_nonzero(high[1:] != high[:-1])) + (self.last is not None and self.last != bool(high[0]))
        self.last = bool(high[-1])

    def row(self, media: bytes) -> tuple:
        if self.media.digest() != media or self.head != header_of(self.seen):
            raise ValueError(f"file {media.hex()} is damaged or lacks chunks")
        feature = f"chunks={self.chunks};sum={self.total};squares={self.squares};crossings={self.crossings}"
        return media, self.seen, self.payload.hexdigest(), zlib.crc32(self.tail), HEADER + self.seen, feature


_FEATURES = "media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, feature string"
_FEATURE_ROWS = pa.schema([("media", pa.binary()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("feature", pa.string())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema)], schema=schema)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))


def manifests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (the file's SHA-256) and the ordered ``digests`` of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("digests", pa.list_(pa.binary()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = t.as_py() or b""
                media = media_of(payload_of(raw))
                rows.append((d, len(raw), hashlib.sha256(media).digest(), [hashlib.sha256(c).digest() for c in chunks(media)]))
            yield _batch(rows, schema)

    return _texts(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary, digests array<binary>")


def chunk_store(docs: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The packs (media, manifest, digests, sizes, data) of distinct files and the chunks (digest, n, data) that they share.

    ``refs`` are the manifests of ``docs``, marked or not.  A pack has the chunks of a file that no other shares, in order, compressed
    together; ``manifest`` is the file's if it has shared chunks too, else null.
    """
    refs = refs if "marks" in refs.columns else marked(refs)
    files = cut(refs.groupBy("media").agg(F.count("*").alias("uses"), F.first("marks").alias("marks")).select(_mark(F.col("media")).alias("mark"), "uses", "marks"), "files")
    each = files.select(F.explode("marks").alias("mark"))
    again = _bitmap(each.groupBy("mark").count().where("count > 1").select("mark"))
    copied = _bitmap(files.where("uses > 1").select("mark"))
    shared, width = docs.sparkSession.sparkContext.broadcast((again, copied)), MAP_BITS
    schema = pa.schema([("media", pa.binary()), ("copied", pa.bool_()), ("manifest", pa.list_(pa.binary())), ("digests", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int32())), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, copies = shared.value
        pack, lately = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False), set()
        sent: set[bytes] = set()
        for batch in batches:
            rows, size = [], 0
            for t in batch.column(1):
                media = media_of(payload_of(t.as_py()))
                name = hashlib.sha256(media).digest()
                if name in lately:
                    continue
                many = bool(copies[(bit := _bit(name, width)) >> 3] >> (bit & 7) & 1)
                for known in (lately, sent):
                    if len(known) > 20_000:
                        known.clear()
                if many:  # copies nearby go no further
                    lately.add(name)
                own, sizes, data, every = [], [], [], []
                for c in chunks(media):
                    digest = hashlib.sha256(c).digest()
                    every.append(digest)
                    if bits[(bit := _bit(digest, width)) >> 3] >> (bit & 7) & 1:
                        if digest not in sent:
                            sent.add(digest)
                            rows.append((None, True, None, [digest], [len(c)], pack.compress(c)))
                    else:
                        own.append(digest)
                        sizes.append(len(c))
                        data.append(c)
                rows.append((name, many, None if len(own) == len(every) else every, own, sizes, pack.compress(b"".join(data))))
                size += len(media)
                if size > 8 << 20:
                    yield _batch(rows, schema)
                    rows, size = [], 0
            yield _batch(rows, schema)

    made = cut(_texts(docs).mapInArrow(run, "media binary, copied boolean, manifest array<binary>, digests array<binary>, sizes array<int>, data binary"), "made")
    packs = made.where("media is not null")
    first = packs.where("copied").groupBy("media").agg(*[F.first(c).alias(c) for c in ("manifest", "digests", "sizes", "data")])
    packs = packs.where("not copied").drop("copied").unionByName(cut(first, "packs"))
    single = made.where("media is null").select(F.col("digests")[0].alias("digest"), F.col("sizes")[0].alias("n"), "data")
    return packs, cut(single.groupBy("digest").agg(F.first("n").alias("n"), F.first("data").alias("data")), "shared")


def _unpack(data: bytes, digests: list[bytes], sizes: list[int]) -> Iterator[bytes]:
    """The chunks of a pack, each verified."""
    raw, at = zstandard.ZstdDecompressor().decompress(data, max_output_size=sum(sizes)), 0
    for digest, n in zip(digests, sizes):
        chunk = raw[at : at + n]
        if hashlib.sha256(chunk).digest() != digest:
            raise ValueError(f"chunk {digest.hex()} is damaged")
        yield chunk
        at += n


def media_features(packs: DataFrame, shared: DataFrame) -> DataFrame:
    """The features of every distinct file, from the stored chunks read back and verified."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for media, digests, sizes, data in zip(*(batch.column(k) for k in range(4))):
                f = Features(0)
                for c in _unpack(data.as_py(), digests.as_py(), sizes.as_py()):
                    f.add(c)
                rows.append(f.row(media.as_py()))
            yield _batch(rows, _FEATURE_ROWS)

    def pieced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by file and place: -1 the pack, then the whole manifest with the data of shared chunks."""
        now, f, own = None, None, iter(())
        for batch in batches:
            rows = []
            for media, seq, digests, sizes, data in zip(*(batch.column(k) for k in range(5))):
                if (name := media.as_py()) != now:
                    if f:
                        rows.append(f.row(now))
                    now, f, own = name, Features(0), iter(())
                if seq.as_py() < 0:
                    own = iter(list(zip(digests.as_py(), _unpack(data.as_py(), digests.as_py(), sizes.as_py()))))
                elif data.is_valid:
                    for c in _unpack(data.as_py(), digests.as_py(), sizes.as_py()):
                        f.add(c)
                else:
                    digest, c = next(own, (None, b""))
                    if digest != digests[0].as_py():
                        raise ValueError(f"chunk {digests[0].as_py().hex()} is not in the store")
                    f.add(c)
            yield _batch(rows, _FEATURE_ROWS)
        if f:
            yield _batch([f.row(now)], _FEATURE_ROWS)

    done = packs.where("manifest is null").select("media", "digests", "sizes", "data").mapInArrow(whole, _FEATURES)
    parts = packs.where("manifest is not null")
    lists = parts.select("media", F.posexplode("manifest").alias("seq", "digest"))
    known = shared.select(F.col("digest").alias("_digest"), F.col("n").alias("_n"), F.col("data").alias("_data"))
    met = lists.join(known, F.col("digest") == F.col("_digest"), "left")
    met = met.select("media", "seq", F.array("digest").alias("digests"), F.array("_n").alias("sizes"), F.col("_data").alias("data"))
    met = met.unionByName(parts.select("media", F.lit(-1).alias("seq"), "digests", "sizes", "data"))
    met = met.repartition("media").sortWithinPartitions("media", "seq")
    return done.unionByName(met.mapInArrow(pieced, _FEATURES))


def _needed(col: str) -> Column:
    return F.coalesce(F.col(col), F.raise_error(F.concat(F.lit("no stored file "), F.lower(F.hex("media")))))


def store_media(docs: DataFrame) -> DataFrame:
    """One row for each row: doc_id, n_bytes and the features read back from the store.

    Takes ``doc_id`` and ``text`` (null: empty); other columns are ignored.
    Repeated rows and equal texts have equal values; their bytes are stored once.
    A stored chunk that doesn't fit its digest raises, and so does one that is missing.  An empty table gives an
    empty table.
    """
    refs = cut(marked(manifests(docs)), "manifests")
    packs, shared = chunk_store(docs, refs)
    found = cut(media_features(packs, shared), "features")
    named = refs.select("doc_id", "n_bytes", "media").join(found.withColumnRenamed("media", "_media"), F.col("media") == F.col("_media"), "left")
    return named.select("doc_id", "n_bytes", _needed("payload_bytes").alias("payload_bytes"), "payload_sha256", "tail_crc32", "media_bytes", F.lower(F.hex("media")).alias("media_sha256"), "feature")
