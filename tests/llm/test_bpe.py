import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken

from eventlab.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def wanted(library, rows):
    out = []
    for d, t in rows:
        ids = library.encode_ordinary(t or "")
        out.append((d, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in df.collect()), key=str)


def test_documents(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert got(bpe.encode(docs, PATH, public_tokenizers.PATTERN, keep_ids=False)) == wanted(library, rows)


def test_odd_rows(spark, library):
    rng = random.Random(1)
    odd = "".join(chr(rng.choice([rng.randrange(1, 0x300), rng.randrange(0x2000, 0x3100), rng.randrange(0x1F000, 0x1FFFF), 0x20, 0x0A])) for _ in range(5000))
    texts = [None, "", " ", "a", odd, "x" * 3000, "ab" * 700, "　\x1c\x85  \n\n a", "it's we'LL 123٣½ <|endoftext|>", "naïve Übergröße " * 40, "".join(rng.choice("abcdefé") for _ in range(5000))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "null id"), (3, "a"), (3, "a")]
    df = spark.createDataFrame([(*r, 7, "y") for r in rows], "doc_id long, text string, n_tokens int, ids string")
    enc = bpe.encode(df, PATH, public_tokenizers.PATTERN)
    assert got(enc) == wanted(library, rows)
    back = bpe.decode(enc, PATH)
    assert sorted((str(r.doc_id), bytes(r.data).decode()) for r in back.collect()) == sorted((str(d), t or "") for d, t in rows)
    assert bpe.encode(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(Exception, match="unknown id"):
        bpe.decode(spark.createDataFrame([(1, [10**6])], "doc_id long, ids array<int>"), PATH).collect()


def test_caches_do_not_change_results(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 3)
    monkeypatch.setattr(bpe, "SLICE", 50)
    monkeypatch.setattr(bpe, "ROWS", 12)
    b = bpe.Bpe(bpe.load_ranks(PATH), public_tokenizers.PATTERN)
    texts = ["gschwundene Häuser wahrscheinlich"] * 3 + ["abcabcabcabcabcabcabc zyx"] * 2
    for t, (ids, back) in zip(texts * 2, b.encode(texts * 2)):
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == library.encode_ordinary(t)
        assert back == t.encode()


def test_long_pieces(library):
    """Unspaced script, repeats of tokens and letters without any cut: whole pieces of thousands of bytes."""
    rng = random.Random(3)
    common = "的一是不了人我在有他这为之大来以个中上们到说国和地也子时道出而要于就下得可你年生"
    texts = ["".join(rng.choice(common) for _ in range(20_000)), "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(5000)), "a" * 4001, "abab" * 999 + "b", "ก" * 700]
    texts += ["".join(rng.choice("etaoinshrdlu") for _ in range(n)) for n in (*range(1, 60), 3000)]
    b = bpe.Bpe(bpe.load_ranks(PATH), public_tokenizers.PATTERN)
    for t, (ids, back) in zip(texts, b.encode(texts)):
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == library.encode_ordinary(t)
        assert back == t.encode()


def test_places_without_tokens_are_cuts(library):
    """No token of a text spans a place where it is cut."""
    b = bpe.Bpe(bpe.load_ranks(PATH), public_tokenizers.PATTERN)
    text = "wirklichkeitsnah的一是不了人我在有他qqzzxx" * 20
    data = text.encode()
    import numpy as np

    spans, at, ends = b._places(np.frombuffer(data, np.uint8)), 0, set()
    for i in library.encode_ordinary(text):
        at += len(library.decode_single_token_bytes(i))
        ends.add(at)
    assert {int(p) for p in np.flatnonzero(~spans)} - {0} <= ends and (~spans).sum() > 20
