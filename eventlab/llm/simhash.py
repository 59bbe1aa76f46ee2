"""SimHash near-duplicates with a pigeonring filter.

A fingerprint is 64 bits in five segments in a ring.  If two fingerprints
differ in at most ``tau`` bits, some segment starts a chain whose first ``l``
segments differ in at most ``l * tau / 5`` bits for every ``l``.  With
``tau = 4`` that is 0, 1, 2, 3 and 4 bits, so the chain's first segment is equal
and its second differs in one bit at most.  Both make the join key (25 or 26
bits): the one side stores its own key, the other asks with the second segment
as it is and with each of its bits turned.  The longer chains and the full
distance are part of the join's condition, and a link comes out at its first
chain only, so a pair of fingerprints is emitted once.

Documents are reduced to distinct fingerprints before anything is joined:
copies cost one row each and never make pairs.  Links join by alternating
large-star and small-star rounds, each written to the shared folder.

At a Jaccard similarity of 0.8, fingerprints differ in 15 % of their bits, which
64 bits can't tell from chance, and segments of wider ones are equal by chance in more
pairs the more texts there are.  ``near_duplicates`` takes a MinHash sketch: ``BANDS`` x ``ROWS`` minima
of the text's set of shingles, a 64-bit key for each band.  Two texts meet if a band is equal, which
needs common shingles: texts without any don't meet, however many there are.  A bit of each minimum
tells how near two texts are (``MOST`` differing bits at most), then comes the exact similarity.
Two texts at 0.8 have an equal band in 997 of 1,000 cases, at 0.85 in all but 1 of 10^5.

Bands only make groups early.  That no link between groups is missed is the work of prefixes: with
all shingles in one fixed order, two sets at a similarity of s have a shingle in common among the first n - ceil(s * n) + 1
of each, and l among the first n - ceil(s * n) + l.  Texts with fewer than l there that a second text has as well are left out;
the others meet by the keys of their shorter prefix, if they are in different groups.
Any order does; one with rare shingles first makes few texts meet.  Pairs that meet are told apart by
what never leaves out a link: their sizes, then the parities of the numbers of shingles in ``PARITIES`` slots,
of which no more can differ than there are shingles in one set only, then the sets themselves.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlab.llm.tables import cut

#: (first bit, bits) of each segment.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
_SLICE = 1 << 16
#: Sketches: bands, minima in a band (64 divides all minima), and the most bits in which the sketches of a link differ: at 0.8, 256 of them differ in 26, and in 4.8 more or less.
BANDS, ROWS, MOST = 32, 8, 47
#: Bits of the map of texts that take part in a comparison, and rounds of comparisons with hubs before all that is left is compared.
TEXT_BITS, ROUNDS = 23, 3
#: Doublings of the way up a tree of links after each such round.
JUMPS = 3
#: Slots of a text's parities and of the table of frequencies that shingles are ordered by, and bits of the map of keys that repeat: a full map only keeps more keys.
PARITIES, SLOTS, MAP_BITS = 512, 1 << 16, 26
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Of a key's rows that have one near by, up to so many make pairs; those of keys with more are compared in a join's condition.
FEW = 32


def _bit_sums(words: np.ndarray) -> np.ndarray:
    """How many rows of (n, words) set each bit."""
    total = np.zeros(words.shape[1] * 64, np.int64)
    for at in range(0, len(words), 255):  # sums of 255 ones fit a byte
        total += np.add.reduce(np.unpackbits(words[at : at + 255].view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return total


def shingle_hashes(text: bytes | None, width: int) -> Iterator[np.ndarray]:
    """XXH64 of every shingle, repeats included, in slices; a shorter text is one shingle, and so is an empty one."""
    words = (text or b"").lower().split()
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) >= width:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    else:
        starts, ends = np.array([0]), np.array([len(line)])
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), _SLICE):
        s, e = starts[at : at + _SLICE].tolist(), ends[at : at + _SLICE].tolist()
        yield np.array([digest(line[a:b], 42) for a, b in zip(s, e)], np.uint64)


def fingerprint(text: bytes | None, width: int) -> int:
    """The unsigned 64-bit fingerprint of one text; without words it is zero."""
    if not (text or b"").split():
        return 0
    total, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, width):
        total += _bit_sums(h.reshape(-1, 1))
        n += len(h)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp) for every row of ``docs``; ``fp`` is the signed form of the 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            fps = np.fromiter((fingerprint(t.as_py(), width) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _segment(fp: Column, i: int) -> Column:
    first, bits = SEGMENTS[i % 5]
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def _chain_ok(a: Column, b: Column, i: int, tau: int) -> Column:
    """Every chain from segment ``i`` keeps within its budget."""
    ok, total = None, F.lit(0)
    for n in range(1, 5):
        total = total + F.bit_count(_segment(a.bitwiseXOR(b), i + n - 1))
        within = total <= F.lit(n * tau // 5)
        ok = within if ok is None else ok & within
    return ok


def links(fps: DataFrame, tau: int = 4) -> DataFrame:
    """Distinct ``fp`` in, (a, b) with a < b and at most ``tau`` (4 or fewer) differing bits out."""
    if not 0 <= tau <= 4:
        raise ValueError("tau must be 0 to 4: the keys allow one bit in a chain's second segment")
    fp = F.col("fp")
    own, asked = [], []
    for i in range(5):
        head = _segment(fp, i) * F.lit(1 << 16) + F.lit(i * (1 << 32)).cast("long")
        nxt, bits = _segment(fp, i + 1), SEGMENTS[(i + 1) % 5][1]
        own.append(head + nxt)
        asked += [head + nxt] + [head + nxt.bitwiseXOR(F.lit(1 << j).cast("long")) for j in range(bits)]
    left = fps.select(fp.alias("a"), F.explode(F.array(*asked)).alias("key"))
    right = fps.select(fp.alias("b"), F.explode(F.array(*own)).alias("key"))
    a, b = F.col("a"), F.col("b")
    first = F.lit(False)
    at = F.shiftrightunsigned(F.col("key"), 32)
    seen = None
    for i in range(5):
        ok = _chain_ok(a, b, i, tau)
        first = first | ((at == i) & ok & (F.lit(True) if seen is None else ~seen))
        seen = ok if seen is None else seen | ok
    near = F.bit_count(a.bitwiseXOR(b)) <= tau
    pairs = left.join(right, (left["key"] == right["key"]) & (a < b) & near)
    return pairs.select("a", "b", left["key"].alias("key")).where(first).select("a", "b")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b) can reach.

    Alternating large-star and small-star rounds; the number of rounds follows
    the logarithm of the largest component.  Raises if ``rounds`` don't suffice.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "links")
    state = None
    for _ in range(rounds):
        # large star: each larger neighbour of a node goes to the node's least neighbour
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(now.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("v"), F.col("m").alias("u"))
        # small star: each smaller neighbour and the node go to the least of them
        large = large.distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v")
        small = small.where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(low.select("v", F.col("m").alias("u")))
        now = cut(small.distinct(), "stars")
        got = now.agg(F.count("*"), F.bit_xor(F.xxhash64("v", "u")), F.sum(F.col("u").cast("decimal(38,0)"))).first()
        if got == state:
            return now.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
        state = got
    raise RuntimeError("components did not settle")


def simhash_components(docs: DataFrame, width: int = 4, tau: int = 4) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint, component_id.

    Takes the columns ``doc_id`` and ``text``; other columns are ignored.  Null
    and empty texts have fingerprint zero and link like any other.  Rows that
    repeat a doc_id each come out.  A null doc_id comes out as null and is never
    a component's name, unless the component has no other.  An empty table
    gives an empty table.
    """
    prints = cut(fingerprints(docs, width), "fp")
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    comp = cut(components(links(classes.select("fp"), tau)), "comp")
    in_comp = cut(classes.join(comp, classes["fp"] == comp["node"]).select("fp", "rep", "root"), "members")
    roots = in_comp.groupBy("root").agg(F.min("rep").alias("least"))
    linked = in_comp.join(roots, "root").select("fp", F.col("least").alias("component_id"))
    named = cut(
        classes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id")),
        "named",
    )
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@functools.cache
def _mixers(n: int) -> np.ndarray:
    """Odd numbers, from a rule."""
    return np.array([xxhash.xxh64_intdigest(f"minimum {i}") | 1 for i in range(n)], np.uint64)


def sketch(hashes: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """A key for each band of the minima of a set of shingles, and a bit for each minimum in words of 64."""
    mixers, least = _mixers(bands * rows), np.full(bands * rows, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 1020):
        np.minimum(least, (hashes[at : at + 1020, None] * mixers).min(0), out=least)
    mixed = least ^ least >> np.uint64(32)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for part in mixed.reshape(bands, rows).T:
        key = (key ^ part) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    return key, np.packbits((mixed >> np.uint64(40) & np.uint64(1)).astype(np.uint8), bitorder="little").view(np.uint64)


def _sketched(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """(node, n, keys, bits) of rows (node, text): number of distinct shingles, and the sketch.  Copies that a task meets again soon are left out."""
    longs = pa.list_(pa.int64())
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("keys", longs), ("bits", longs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lately: set[int] = set()
        for batch in batches:
            made: list[tuple[int, int, np.ndarray, np.ndarray]] = []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
                if node in lately:
                    continue
                if len(lately) > 50_000:
                    lately.clear()
                lately.add(node)
                found = np.unique(np.concatenate(list(shingle_hashes(text.as_py(), width))))
                made.append((node, len(found), *(x.view(np.int64) for x in sketch(found, bands, rows))))
            cols = list(zip(*made)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return docs.mapInArrow(run, "node long, n long, keys array<long>, bits array<long>")


def _off(a: str, b: str, bits: int) -> Column:
    """In how many of their ``bits`` two sketches differ."""
    words = [F.bit_count(F.get(F.col(a), F.lit(i)).bitwiseXOR(F.get(F.col(b), F.lit(i)))) for i in range(bits // 64)]
    return sum(words[1:], words[0])


def _sizes_fit(a: str, b: str, similarity: float) -> Column:
    return F.least(a, b) >= F.lit(similarity - 1e-9) * F.greatest(a, b)


def _similar(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) of rows (node, text) whose sets of shingles are similar, exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, np.ndarray] = (None, np.zeros(0, np.uint64))

        def hashes(text) -> np.ndarray:
            return np.unique(np.concatenate(list(shingle_hashes(text.as_py(), width))))

        for batch in batches:
            ok = []
            for a, ta, tb in zip(batch.column(0).to_pylist(), batch.column(2).cast(pa.large_binary()), batch.column(3).cast(pa.large_binary())):
                if a != last[0]:
                    last = (a, hashes(ta))
                x, y = last[1], hashes(tb)
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(common >= (similarity - 1e-9) * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    held = _texts_of(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))), texts)
    # the members' texts first: a hub's text is not copied until nothing is shuffled any more
    both = pairs.join(held.select(F.col("node").alias("b"), F.col("text").alias("_b")), "b").join(held.select(F.col("node").alias("a"), F.col("text").alias("_a")), "a")
    return both.select("a", "b", "_a", "_b").mapInArrow(run, "a long, b long")


def _texts_of(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, text) of the rows of ``texts`` whose node is among ``nodes``, each once."""
    involved = cut(nodes.select("node").distinct(), "involved")
    # a map of fixed size tells which texts may be meant, so the others stay where they are
    spot = lambda: F.col("node").bitwiseAND(F.lit((1 << TEXT_BITS) - 1))
    bits = involved.groupBy(F.shiftright(spot(), 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(node & 63 as int))")).alias("_bits"))
    texts = texts.join(F.broadcast(bits), F.shiftright(spot(), 6) == F.col("_word")).where(F.expr("shiftright(_bits, cast(node & 63 as int)) & 1") == 1)  # 2^TEXT_BITS / 64 rows at most
    return cut(texts.select("node", "text").join(involved, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")), "texts")


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """(node, set) of rows (node, text): the hashes of a text's shingles, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [np.unique(np.concatenate(list(shingle_hashes(t.as_py(), width)))).view(np.int64) for t in part.column(1).cast(pa.large_binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "set"])

    return texts.mapInArrow(run, "node long, set array<long>")


def _sets_of(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """(node, its shingles' hashes, each once) of rows (node, text), some texts at a time.  Copies that a task meets again soon are left out."""
    lately: set[int] = set()
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part, made = batch.slice(at, 512), []
            for node, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.large_binary())):
                if node not in lately:
                    if len(lately) > 50_000:
                        lately.clear()
                    lately.add(node)
                    made.append((node, np.unique(np.concatenate(list(shingle_hashes(text.as_py(), width))))))
            if made:
                yield made


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(48)).astype(np.int64)


def frequency_classes(base: DataFrame, width: int) -> np.ndarray:
    """A number for each of ``SLOTS`` slots of shingles, larger where more texts have them.  It only gives the shingles an order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for made in _sets_of(batches, width):
            total += np.bincount(_slot(np.concatenate([h for _, h in made])), minlength=SLOTS)
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(total[slot])], names=["slot", "n"])

    found = base.mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # SLOTS rows at most
    counts = np.zeros(SLOTS)
    counts[found["slot"].to_numpy()] = found["n"].to_numpy()
    return np.clip(4 * np.log2(np.maximum(counts / max(1, counts.mean()), 1)), 0, 63).astype(np.uint64)


def _least(n: int, similarity: float) -> int:
    return int(np.ceil((similarity - 1e-9) * n))


def _more(n: int) -> int:
    """How many shingles beyond the shorter prefix are looked at, and so many texts at a similarity share at least."""
    return max(1, n // 10)


def prefix(hashes: np.ndarray, classes: np.ndarray, similarity: float) -> tuple[np.ndarray, int, int]:
    """Keys of the first shingles of a set, in order of class and key; how many of them are the shorter prefix, and how many must be found in other sets.

    Two sets at ``similarity`` have a key of their shorter prefixes in common, and of the longer ones as many as are told.
    """
    n = len(hashes)
    least = _least(n, similarity)
    keys = classes[_slot(hashes)] << np.uint64(56) | hashes * _ODD >> np.uint64(8)
    long = min(n, n - least + _more(n))
    # the other set may be smaller, and its prefix, too
    return np.sort(np.partition(keys, long - 1)[:long]), min(n, n - least + 1), _more(least)


def parities(hashes: np.ndarray) -> np.ndarray:
    """Whether the number of a set's shingles in each of ``PARITIES`` slots is odd, in words of 64."""
    slots = np.bincount((hashes >> np.uint64(20) & np.uint64(PARITIES - 1)).astype(np.int64), minlength=PARITIES)
    return np.packbits((slots & 1).astype(np.uint8), bitorder="little").view(np.int64)


def _repeated(base: DataFrame, classes: np.ndarray, width: int, similarity: float) -> np.ndarray:
    """A map of ``MAP_BITS`` with the bit of each key that several texts have in their prefixes; keys are packed by bucket and counted there."""
    shared = base.sparkSession.sparkContext.broadcast(classes)
    buckets = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            keys = np.concatenate(held)
            held.clear()
            spots = (keys % np.uint64(buckets)).astype(np.int64)
            # 32 bits within a bucket: keys that agree in these are few, and count as repeated
            keys = (keys // np.uint64(buckets)).astype(np.uint32)[np.argsort(spots, kind="stable")]
            ends = np.cumsum(np.bincount(spots, minlength=buckets))
            packs = [keys[e - n : e].tobytes() for e, n in zip(ends.tolist(), np.diff(np.r_[0, ends]).tolist())]
            return pa.RecordBatch.from_arrays([pa.array(range(buckets), pa.int64()), pa.array(packs, pa.binary())], names=["bucket", "keys"])

        for made in _sets_of(batches, width):
            held += [prefix(h, shared.value, similarity)[0] for _, h in made]
            if sum(map(len, held)) > 1 << 20:
                yield out()
        if held:
            yield out()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for bucket, keys in zip(batch.column(0).to_pylist(), batch.column(1)):
                packs.setdefault(bucket, []).append(np.frombuffer(keys.as_py(), np.uint32))
        while packs:
            bucket, parts = packs.popitem()
            keys = np.sort(np.concatenate(parts))
            again = keys[1:][keys[1:] == keys[:-1]].astype(np.uint64) * np.uint64(buckets) + np.uint64(bucket)  # a key's low bits
            spots = np.unique(again & np.uint64((1 << MAP_BITS) - 1))
            if len(spots):
                words, begins = np.unique((spots >> np.uint64(6)).astype(np.int64), return_index=True)
                bits = np.bitwise_or.reduceat(np.uint64(1) << (spots & np.uint64(63)), begins)
                yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(bits.view(np.int64))], names=["word", "bits"])

    packed = base.mapInArrow(pack, "bucket long, keys binary").repartition("bucket")
    found = packed.mapInArrow(count, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # 2^MAP_BITS / 64 rows at most
    bitmap = np.zeros(1 << MAP_BITS - 6, np.int64)
    bitmap[found["word"].to_numpy()] = found["bits"].to_numpy()
    return bitmap.view(np.uint8)


def _keyed(base: DataFrame, classes: np.ndarray, bitmap: np.ndarray, width: int, similarity: float) -> DataFrame:
    """(node, n, keys, parities) of rows (node, text) that may have a link: the keys of the shorter prefix that several texts have, in order."""
    shared = base.sparkSession.sparkContext.broadcast((classes, bitmap))
    longs = pa.list_(pa.int64())
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("keys", longs), ("parities", longs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, bitmap = shared.value
        for made in _sets_of(batches, width):
            rows = []
            for node, found in made:
                keys, short, needed = prefix(found, classes, similarity)
                spot = (keys & np.uint64((1 << MAP_BITS) - 1)).astype(np.int64)
                again = bitmap[spot >> 3] >> (spot & 7).astype(np.uint8) & 1 == 1
                keys = keys[:short][again[:short]]
                if len(keys) and again.sum() >= needed:
                    rows.append((node, len(found), keys.view(np.int64), parities(found)))
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    rows = base.mapInArrow(run, "node long, n long, keys array<long>, parities array<long>")
    return rows.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "keys", "parities")])


def _rest(base: DataFrame, roots: DataFrame | None, width: int, similarity: float) -> DataFrame:
    """All links (a, b) between texts in different groups; ``roots`` has (node, root) of those whose group has another name.

    Texts meet by the keys of their prefixes. First come the rows of a key that have any row of another group near by sizes and parities.
    Of keys with few of these the pairs are compared, each once. Of keys with more, at the first key that two share, they are compared by the join's
    condition: only links come out as rows. A key's largest group is on one side of a join only, so it isn't compared with itself.
    """
    classes = frequency_classes(base, width)
    found = _keyed(base, classes, _repeated(base, classes, width, similarity), width, similarity)
    if roots is not None:
        found = found.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    else:
        found = found.withColumn("root", F.col("node"))
    rows = cut(found, "keyed")
    spark = rows.sparkSession
    # rows are few and each is compared with many, so partitions go by number and not by size
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)

    def sides(every: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Rows (key, x) that aren't of their key's largest group, those that are, and all as (key, y, large)."""
        largest = every.groupBy("key", "root").count().groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("largest"), F.count("*").alias("groups"))
        dealt = every.repartition(tasks, "key").join(largest.where("groups > 1").drop("groups"), "key")
        row = F.struct(*[c for c in every.columns if c != "key"])
        a = dealt.where("root <> largest").select("key", row.alias("x"))
        return a, dealt.where("root = largest").select("key", row.alias("x")), dealt.select("key", row.alias("y"), (F.col("root") == F.col("largest")).alias("_large"))

    apart = F.col("x.root") != F.col("y.root")
    # of the sets' sizes together, what is in one only is (1 - s) / (1 + s) at most
    few = F.floor((F.col("x.n") + F.col("y.n")) * ((1 - similarity) / (1 + similarity)) + 1e-6)
    near = _sizes_fit("x.n", "y.n", similarity) & (_off("x.parities", "y.parities", PARITIES) <= few)
    keys = rows.select(F.explode("keys").alias("key"), "node", "root")
    shared = keys.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("key")
    every = keys.join(shared, "key").drop("root").join(rows.select("node", "n", "root", "parities"), "node")
    a, large, b = sides(cut(every, "prefixes"))
    small = b.where("not _large")
    some = a.join(b, (a["key"] == b["key"]) & apart & near, "left_semi").unionByName(large.join(small, (large["key"] == small["key"]) & apart & near, "left_semi"))
    some = cut(some.select("key", "x.*"), "near")
    many = some.groupBy("key").count().where(F.col("count") > FEW).select("key")
    few_rows = some.join(many, "key", "left_anti")
    a, b = (few_rows.select("key", F.struct(*[c for c in some.columns if c != "key"]).alias(c)) for c in ("x", "y"))
    pairs = a.join(b, (a["key"] == b["key"]) & (F.col("x.node") < F.col("y.node")) & apart & near)  # FEW for each row at most
    pairs = cut(pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct(), "pairs")
    linked = _similar(pairs, base, width, similarity)

    dense = cut(some.join(many, "key", "left_semi"), "dense")
    a, large, b = sides(cut(dense.join(dense.groupBy("node").agg(F.sort_array(F.collect_list("key")).alias("keys")), "node"), "listed"))
    small = b.where("not _large")
    first = lambda key: F.get(F.array_intersect("x.keys", "y.keys"), F.lit(0)) == key
    # sets go to the rows alone that have one to be compared with
    met = a.join(b, (a["key"] == b["key"]) & apart & near & first(a["key"]), "left_semi").unionByName(large.join(small, (large["key"] == small["key"]) & apart & near & first(large["key"]), "left_semi"))
    met = cut(met.select("key", "x.*"), "met")
    a, _, b = sides(cut(met.join(_sets(_texts_of(met, base), width), "node"), "sets"))
    new = apart & (F.col("_large") | (F.col("x.node") < F.col("y.node"))) & first(a["key"])
    common = F.size(F.array_intersect("x.set", "y.set"))
    exact = common * (1 + similarity - 1e-9) >= (F.col("x.n") + F.col("y.n")) * (similarity - 1e-9)  # of the union; written so that it is computed once
    found = a.join(b, (a["key"] == b["key"]) & apart & near & new & exact)
    return linked.unionByName(found.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))).distinct()


def near_duplicates(docs: DataFrame, similarity: float = 0.8, width: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(node, root) of the texts that have near-duplicates; ``node`` is ``text_node`` of a text, ``root`` names its group.

    Takes ``text``; other columns are ignored.  Two texts are linked if the Jaccard similarity of
    their sets of ``width``-word shingles (A-Z in lower case) is ``similarity`` or more; a shorter text is one
    shingle, null and empty ones are equal texts.  Groups are what links connect.
    Each link is exact, and none between groups is missed (see above).

    Copies are one node.  In each of up to ``ROUNDS`` rounds a node is compared with one hub only, that of its keys' hubs whose sketch is nearest;
    a key's hub is of the group that is drawn first, anew each round, and members of that group don't meet it.  So a large group grows from
    stars, a link for each node, and not from all its pairs.  Rounds end when one finds nothing.  Then texts that are still
    in different groups meet by their prefixes, whether a band is equal or not, and are compared by their sets, so no link between groups is lost; only links become rows.
    Between rounds a node takes the top of its tree of links for its group: two names of one group cost comparisons and no link. What is connected is computed once, at the end.
    """
    base = docs.select(text_node(F.col("text")).alias("node"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    classes = cut(_sketched(base, width, bands, rows).groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "keys", "bits")]), "sketches")
    keys = classes.select(F.posexplode("keys").alias("band", "key"), "node")
    again = keys.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("key")
    live = cut(keys.join(again, "key").join(classes.select("node", "n", "bits"), "node").select("key", "band", "node", "n", "bits"), "live")
    size = bands * rows

    links_found, ups, named = [], [], live.withColumn("root", F.col("node"))
    for r in range(ROUNDS):
        # a link goes to a group of lesser draw, so what the groups point at is a forest
        hub = F.min(F.struct(F.xxhash64("root", F.lit(r)).alias("draw"), F.xxhash64("node", "key").alias("turn"), "node", "n", "bits", "root"))
        hubs = named.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), hub.alias("hub")).where("least < most").select("key", "hub")
        met = named.join(hubs, "key").where(F.col("root") != F.col("hub.root")).withColumn("off", _off("bits", "hub.bits", size))
        met = met.where((F.col("off") <= MOST) & _sizes_fit("n", "hub.n", similarity))
        star = met.groupBy(F.col("node").alias("b")).agg(F.min(F.struct("off", F.col("hub.node").alias("a"), F.col("root").alias("from"), F.col("hub.root").alias("to"))).alias("best"))
        star = cut(star.select("best.a", "b", "best.from", "best.to"), "star")
        new = cut(_similar(star.select("a", "b"), base, width, similarity), "linked")
        if new.isEmpty():
            break
        groups = star.join(new, ["a", "b"]).groupBy(F.col("from").alias("node")).agg(F.min_by("to", F.xxhash64("to", F.lit(r))).alias("to"))
        up = _tops(cut(groups, "up"))
        ups.append(up)
        links_found += [new, up.select(F.col("node").alias("a"), F.col("to").alias("b"))]
        now = named.join(up.select(F.col("node").alias("root"), "to"), "root", "left").withColumn("root", F.coalesce("to", "root")).drop("to")
        named = cut(now.join(hubs.select("key"), "key", "left_semi"), "named")
    roots = _tops(cut(functools.reduce(DataFrame.unionByName, ups).groupBy("node").agg(F.min("to").alias("to")), "ups")).withColumnRenamed("to", "root") if ups else None
    last = cut(_rest(base, roots, width, similarity), "last")
    return components(functools.reduce(DataFrame.unionByName, links_found, last))


def _tops(up: DataFrame) -> DataFrame:
    """A forest (node, to) with each node sent up to ``2 ** JUMPS`` steps further: to the top of its tree, or near it."""
    for _ in range(JUMPS):
        higher = up.select(F.col("node").alias("to"), F.col("to").alias("_higher"))
        up = cut(up.join(higher, "to", "left").select("node", F.coalesce("_higher", "to").alias("to")), "up")
    return up


def text_node(text: Column) -> Column:
    """The node of a text; null is the empty text."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))
