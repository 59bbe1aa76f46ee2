import functools
import random
import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer, models

from eventlab.llm import unigram
from eventlab.llm.unigram import MARK, Trie, token_counts, zipf_scores

SCORES = zipf_scores(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def library():
    """The tokenizers library's unigram model over the same pieces, with byte fallback."""
    vocab = [("<unk>", 0.0), *SCORES.items(), *((f"<0x{b:02X}>", -1000.0) for b in range(256))]
    return Tokenizer(models.Unigram(vocab, 0, True))


def wanted(library, rows):
    out = []
    for d, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        out.append((d, len(words), sum(len(library.encode(MARK + w).ids) for w in words)))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_documents(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert got(token_counts(docs, SCORES)) == wanted(library, [tuple(r) for r in docs.select("doc_id", "text").collect()])


@functools.cache
def slow(word):
    """All ways to cover a short word."""
    unknown = min(SCORES.values()) - unigram.UNKNOWN
    if not word:
        return 0.0, 0
    ways = [(unknown + slow(word[1:])[0], len(word[0].encode()) + slow(word[1:])[1])]
    for k in range(1, len(word) + 1):
        if word[:k] in SCORES:
            s, n = slow(word[k:])
            ways.append((SCORES[word[:k]] + s, n + 1))
    return max(ways)


def test_trie_against_all_ways():
    rng = random.Random(8)
    words = sorted({MARK + "".join(rng.choice("theraionsé中\U0001f600") for _ in range(rng.randrange(1, 8))) for _ in range(400)})
    trie = Trie(SCORES)
    assert list(trie.counts(words)) == [slow(w)[1] for w in words]
    prefixes = {w[:k] for w in words for k in range(1, len(w) + 1)}
    assert trie.nodes == len(prefixes)  # each shared prefix once


def test_odd_rows(spark, library):
    rows = [(1, None), (2, ""), (2, ""), (None, "a b"), (3, "中文  x y \x1cz 😀😀"), (4, "w" * 5000), (5, "the " * 100_000), (6, "\n\t\x0b")]
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], "doc_id long, text string, n_words int, n_tokens string")
    assert got(token_counts(df, SCORES)) == wanted(library, rows)
    assert token_counts(df.limit(0), SCORES).count() == 0
