import hashlib
import io
import random
import wave
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventlab.llm import media
from eventlab.llm.media import chunk_store, chunks, cuts, header_of, manifests, media_features, media_of, payload_of, store_media
from eventlab.llm.tables import cut


def brute(rows):
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        buf = io.BytesIO()
        with wave.open(buf, "wb") as w:
            w.setparams((1, 1, 8000, 0, "NONE", ""))
            w.writeframes(payload)
        x = np.frombuffer(payload, np.uint8).astype(int)
        feature = f"chunks={len(cuts(media_of(payload)))};sum={x.sum()};squares={(x * x).sum()};crossings={(np.diff((x >= 128).astype(int)) != 0).sum()}"
        whole = buf.getvalue()
        out.append((d, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(whole), hashlib.sha256(whole).hexdigest(), feature))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert got(store_media(docs)) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])


def slow_cuts(payload):
    ends, at, n = [], 0, len(payload)
    while at < n:
        end = n
        if n - at > media.LEAST:
            for i in range(at + media.LEAST, n + 1):
                h = sum(int(media.GEAR[payload[i - 1 - k]]) << k for k in range(16)) & 0xFFFF
                if h >> 16 - media.MASK_BITS == 0 or i - at == media.LARGEST:
                    end = i
                    break
        ends.append(end)
        at = end
    return ends


def test_cuts(monkeypatch):
    monkeypatch.setattr(media, "LEAST", 100)
    monkeypatch.setattr(media, "LARGEST", 900)
    monkeypatch.setattr(media, "MASK_BITS", 8)
    data = random.Random(2).randbytes(20_000) + bytes(3000)
    assert cuts(data) == slow_cuts(data)
    assert b"".join(chunks(data)) == data
    moved = cuts(b"new start" + data)  # cuts follow the content
    assert len(set(moved) & {e + 9 for e in cuts(data)}) > 0.8 * len(moved)


def test_odd_rows_and_long_texts(spark):
    rng = random.Random(5)
    long = " ".join(rng.choice(["aé", "the", "ßst", "qu"]) + str(rng.randrange(999)) for _ in range(60_000))
    rows = [(1, None), (2, ""), (2, ""), (None, "x"), (3, "a" * 64), (4, "a" * 65), (5, long), (6, long), (7, "front" + long), (8, long[:200_000]), (9, "é" * 100_000), (10, "a\0"), (11, "a")]
    df = spark.createDataFrame([(*r, b"d", 1) for r in rows], "doc_id long, text string, digest binary, n int").repartition(3)
    assert got(store_media(df)) == brute(rows)
    refs = cut(manifests(df))
    packs, shared = chunk_store(df, refs)
    stored = [(bytes(d), n) for r in packs.collect() for d, n in zip(r.digests, r.sizes)] + [(bytes(r.digest), r.n) for r in shared.collect()]
    used = {bytes(d) for r in refs.collect() for d in r.digests}
    assert len(stored) == len({d for d, _ in stored}) == len(used)  # each chunk once
    assert sum(n for _, n in stored) < 0.6 * sum(len((t or "").encode()) for _, t in rows)
    assert store_media(df.limit(0)).count() == 0


def test_damage_is_found(spark, monkeypatch):
    rng = random.Random(8)
    words = lambda n: " ".join(f"w{rng.randrange(10**5)}" for _ in range(n))
    passage = words(900)
    df = spark.createDataFrame([(i, f"{words(300 * i)} {passage} {words(30)}") for i in range(4)] + [(9, "some text")], "doc_id long, text string")
    refs = cut(manifests(df))
    packs, shared = (cut(t) for t in chunk_store(df, refs))
    assert shared.count() > 2 and packs.where("manifest is not null").count() == 4
    assert media_features(packs, shared).count() == 5
    with pytest.raises(Exception, match="is damaged|could not|decompress"):
        media_features(packs.withColumn("data", F.col("data").substr(F.lit(1), F.length("data") - 1)), shared).collect()
    with pytest.raises(Exception, match="is damaged"):
        media_features(packs.withColumn("digests", F.transform("digests", lambda d: F.unhex(F.lit("00" * 32)))), shared).collect()
    with pytest.raises(Exception, match="is not in the store"):
        media_features(packs, shared.where(F.col("digest") != F.lit(bytes(shared.first().digest)))).collect()
    lost = bytes(packs.where("manifest is null").first().media)
    monkeypatch.setattr(media, "chunk_store", lambda *_: (packs.where(F.col("media") != F.lit(lost)), shared))
    with pytest.raises(Exception, match="no stored file"):
        store_media(df).collect()


def test_a_map_without_room(spark, monkeypatch, sf_dir):
    """With few bits nearly every chunk takes the shuffled way: same result."""
    monkeypatch.setattr(media, "MAP_BITS", 7)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert got(store_media(docs)) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_header():
    with wave.open(io.BytesIO(header_of(64) + payload_of(None))) as w:
        assert w.getnframes() == 64 and w.getsampwidth() == 1


def test_payloads_of_usual_size_are_cut(spark, sf_dir):
    texts = [(r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    usual = [t for t in texts if len(t) >= 2000]
    assert len(usual) > 20 and sum(len(cuts(media_of(payload_of(t)))) > 1 for t in usual) > 0.95 * len(usual)
    # a passage that texts share is stored once, but for its ends
    rng = random.Random(6)
    words = lambda n: " ".join(f"w{rng.randrange(10**5)}" for _ in range(n))
    passage = words(900)
    rows = [(i, f"{words(20 + i)} {passage} {words(30)}") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(store_media(df)) == brute(rows)
    packs, shared = chunk_store(df, cut(manifests(df)))
    assert sum(sum(r.sizes) for r in packs.collect()) + sum(r.n for r in shared.collect()) < 0.5 * sum(len(t) for _, t in rows)
