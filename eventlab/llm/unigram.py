"""Unigram token counts by dynamic programming shared along a trie.

A word's forward scores (best score and token count of each prefix) depend on the
prefix alone, so words that share a prefix share them.  Each task takes slices of
whole texts, puts the slice's distinct words that it hasn't met lately in sorted
order, which is a depth-first walk of their trie, and keeps the scores of the
current path only: a node is computed once, and the count at a word's end is stored
for all its occurrences.  No rows move between tasks.

The score of a token sequence is the sum of its pieces' scores.  A character that
no piece covers counts as its UTF-8 bytes, at ``UNKNOWN`` under the least score.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE = 8_000_000
CACHED = 400_000
UNKNOWN = 10.0
#: Put before each word, as the vocabularies' pieces have it.
MARK = "▁"


def zipf_scores(path: str) -> dict[str, float]:
    """Scores by Zipf's law for the pieces of a SentencePiece file: -ln(rank + 10.5), without control and byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    usual = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return {p: -math.log(i + 10.5) for i, p in enumerate(usual)}


class Trie:
    """Counts of words in sorted order; ``best`` and ``count`` belong to the current path from the root."""

    def __init__(self, scores: Mapping[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN
        self.nodes = 0

    def counts(self, words: Iterable[str]) -> Iterator[int]:
        """The token count of each of the sorted ``words``."""
        path, best, count = "", [0.0], [0]
        get, unknown, longest = self.scores.get, self.unknown, self.longest
        for w in words:
            at = 0
            for a, b in zip(path, w):
                if a != b:
                    break
                at += 1
            del best[at + 1 :], count[at + 1 :]
            for end in range(at + 1, len(w) + 1):
                c = w[end - 1]
                top, n = best[end - 1] + unknown, count[end - 1] + len(c.encode())
                for begin in range(max(0, end - longest), end):
                    s = get(w[begin:end])
                    if s is not None and best[begin] + s > top:
                        top, n = best[begin] + s, count[begin] + 1
                best.append(top)
                count.append(n)
            self.nodes += len(w) - at
            path = w
            yield count[-1]


def token_counts(docs: DataFrame, scores: Mapping[str, float]) -> DataFrame:
    """doc_id, n_words, n_tokens for every row: unigram tokens of the words ``[^\\x20\\x09-\\x0D]+`` of the whole text.

    Takes ``doc_id`` and ``text``; other columns are ignored.  Null and empty
    texts have no words.  Repeated rows each come out; an empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dict(scores))  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, new, old = Trie(shared.value), {}, {}
        for batch in batches:
            ids, texts, at = batch.column(0), batch.column(1), 0
            while at < batch.num_rows:
                split, size, first = [], 0, at
                while at < batch.num_rows and (not split or size < SLICE):
                    raw = texts[at].as_py() or b""
                    split.append(raw.split())
                    size += len(raw)
                    at += 1
                todo = []
                for w in set().union(*split):
                    if w not in new:
                        if (n := old.get(w)) is None:
                            todo.append(w)
                        else:
                            new[w] = n
                todo.sort()  # the order of UTF-8 bytes is that of code points
                new.update(zip(todo, trie.counts(MARK + w.decode() for w in todo)))
                known = new.__getitem__
                cols = [ids.slice(first, at - first), pa.array(list(map(len, split)), pa.int64()), pa.array([sum(map(known, s)) for s in split], pa.int64())]
                if len(new) > CACHED:
                    old, new = new, {}
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
