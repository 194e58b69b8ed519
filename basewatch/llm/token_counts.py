"""Token counts under a unigram model, by dynamic programming over a trie.

The distinct pre-tokens of a block go into a trie. A node stands for a prefix and holds the best
score of any segmentation of that prefix and its number of tokens; it is computed once, from
nodes above it, however many pre-tokens share it. The node at a pre-token's end is its terminal
and holds the count; a document's count is the sum over its pre-tokens. The trie is held as the
sorted pre-tokens: one that shares d characters with its forerunner owns the nodes below depth d,
and all nodes of a depth are computed together.

The vocabulary is a public one and fixed. A unigram model needs a probability for each piece;
its file has only an order, so piece number r of that order has probability in proportion to
1 / (r + 2.7) (Zipf and Mandelbrot's law). A character that is no piece costs one token for each
UTF-8 byte. Of segmentations with equal scores the one with fewest tokens counts.

One map over rows, no shuffle. The counts that a worker keeps are bounded: beyond that they are
thrown away and computed again, and they end with the task.

Defined cases: null or empty text has no tokens; a very long pre-token costs time in proportion to
its length; repeated rows each come out; an empty table gives an empty one; other columns, whatever
their names, aren't read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basewatch.llm.pieces import MARK, WIDE, Words, piece_table, unknown_log_prob, zipf_log_probs

MAX_WORDS, BLOCK = 300_000, 65_536
TIE = 1e-9


class Counter:
    def __init__(self, path: str):
        self.table = piece_table(path)
        n = len(self.table.pieces)
        self.scores, self.byte_score = zipf_log_probs(n), unknown_log_prob(n)
        self.counts: dict[bytes, int] = {}
        self.nodes = self.characters = 0

    def trie(self, words: list[str]) -> np.ndarray:
        """Counts of sorted distinct words, none longer than WIDE."""
        w = Words(words)
        shared = np.zeros(len(words), np.int64)  # characters shared with the word before
        shared[1:] = np.minimum.accumulate(w.codes[1:] == w.codes[:-1], axis=1).sum(axis=1)
        shared = np.minimum(shared, w.lengths)
        best, tokens = np.zeros((w.width + 1, len(words))), np.zeros((w.width + 1, len(words)), np.int32)
        at = np.arange(len(words))
        for d in range(1, w.width + 1):
            new = np.nonzero((shared < d) & (w.lengths >= d))[0]
            self.nodes += len(new)
            piece = self.table.find(w.substring(new, d, 1))
            n_bytes = np.digitize(w.codes[new, d - 1], [0x80, 0x800, 0x10000]) + 1
            s = best[d - 1, new] + np.where(piece >= 0, self.scores[piece], n_bytes * self.byte_score)
            t = tokens[d - 1, new] + np.where(piece >= 0, 1, n_bytes)
            for k in range(2, min(d, self.table.longest) + 1):
                piece = self.table.find(w.substring(new, d, k))
                hit = np.nonzero(piece >= 0)[0]
                s2, t2 = best[d - k, new[hit]] + self.scores[piece[hit]], tokens[d - k, new[hit]] + 1
                better = (s2 > s[hit] + TIE) | (s2 > s[hit] - TIE) & (t2 < t[hit])
                s[hit[better]], t[hit[better]] = s2[better], t2[better]
            best[d, new], tokens[d, new] = s, t
            owner = np.maximum.accumulate(np.where((shared < d) & (w.lengths >= d), at, 0))
            best[d], tokens[d] = best[d, owner], tokens[d, owner]
        self.characters += int(w.lengths.sum())
        return tokens[w.lengths, at]

    def path(self, word: str) -> int:
        """The count of a word too long for the matrix: a trie of one path."""
        best, tokens, index = [0.0], [0], self.table.index
        longest = max(map(len, self.table.pieces))
        for d, char in enumerate(word, 1):
            found = [(best[d - k] + self.scores[index[p]], tokens[d - k] + 1) for k in range(1, min(d, longest) + 1) if (p := word[d - k : d]) in index]
            if char not in index:
                n = len(char.encode())
                found.insert(0, (best[d - 1] + n * self.byte_score, tokens[d - 1] + n))
            s, t = found[0]
            for s2, t2 in found[1:]:
                if s2 > s + TIE or s2 > s - TIE and t2 < t:
                    s, t = s2, t2
            best.append(s)
            tokens.append(t)
        return tokens[-1]

    def learn(self, words: set[bytes]) -> None:
        texts = sorted((MARK + w.decode(), w) for w in words)
        wide = [x for x in texts if len(x[0]) > WIDE or "\0" in x[0]]
        self.counts.update((w, self.path(t)) for t, w in wide)
        if wide:
            texts = [x for x in texts if len(x[0]) <= WIDE and "\0" not in x[0]]
        for i in range(0, len(texts), BLOCK):
            block = texts[i : i + BLOCK]
            self.counts.update(zip((w for _, w in block), self.trie([t for t, _ in block]).tolist(), strict=True))

    def documents(self, texts: list[bytes | None]) -> list[tuple[int, int]]:
        out = []
        for i in range(0, len(texts), 2048):
            split = [t.split() if t else [] for t in texts[i : i + 2048]]
            distinct = set().union(*split)
            new = distinct.difference(self.counts)
            if len(self.counts) + len(new) > MAX_WORDS:
                self.counts, new = {}, distinct
            self.learn(new)
            out += [(len(words), sum(map(self.counts.__getitem__, words))) for words in split]
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str, id_col="doc_id", text_col="text") -> DataFrame:
    """docs -> doc_id, n_pretokens, n_tokens."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        c = counter(path)
        for b in batches:
            done = c.documents(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])
        c.counts = {}  # a worker outlives its task

    return rows.mapInArrow(run, f"doc_id {kind}, n_pretokens long, n_tokens long")
