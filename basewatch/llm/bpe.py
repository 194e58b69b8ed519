"""BPE encoding and decoding: speculate, then verify.

Texts are cut at white space, and each distinct chunk of a batch is normalised and cut into
pre-tokens once. A new pre-token gets the greedy longest-match tokens. A token list is what the
merges give exactly if each token is its own encoding and each adjacent pair is left alone by
the merges; so all adjacent pairs of the batch are held, as numbers, against the pairs known so
far, pairs not seen before are decided once, and only pre-tokens with a pair that fails are
merged in rank order.

The work is one map over rows, without a shuffle. What a worker keeps (chunks, words, pairs) is
bounded by size: what wasn't used since the last time that the bound was reached is thrown away and
built again when needed, which changes the time and not the result. Chunks and words end with the task.

Defined cases: null text counts as empty, which has no tokens; very long chunks merge in
O(n log n); repeated rows each come out; an empty table gives an empty one; other columns,
whatever their names, aren't read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = "</w>"
#: Of a generation of chunks or words: characters, with OVERHEAD for each entry. Pairs: their number.
CACHED, OVERHEAD, CACHED_PAIRS = 14_000_000, 40, 1_000_000
#: Unicode's White_Space, as the vocabulary's own patterns have it.
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
_ODD_SPACE = re.compile("[\x1c-\x1f]")  # str.split() splits there, the patterns don't
#: Below this code point every character is its own NFC form and has one lower case, whatever stands beside it.
_PLAIN = "\u0250"


def _byte_names() -> dict[int, str]:
    """The character that stands for each byte: itself if printable, else the next from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in shown)
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class Recent:
    """A bounded store of two generations: what the older one has and nobody asks for again is dropped."""

    def __init__(self, limit: int = CACHED):
        self.limit, self.weight, self.young, self.old = limit, 0, {}, {}

    def missing(self, keys: set[str]) -> set[str]:
        """Those of keys that aren't known; all others are in the young generation afterwards."""
        if self.weight > self.limit:
            self.weight, self.young, self.old = 0, {}, self.young
        young, old = self.young, self.old
        new = keys.difference(young)
        if old:
            again = new.intersection(old)
            young.update(zip(again, map(old.__getitem__, again), strict=True))
            self.weight += sum(map(len, again)) + OVERHEAD * len(again)
            new.difference_update(again)
        return new

    def add(self, found: dict) -> None:
        self.young.update(found)
        self.weight += sum(map(len, found)) + OVERHEAD * len(found)

    def clear(self) -> None:
        self.weight, self.young, self.old = 0, {}, {}


class Encoder:
    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.words_in = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.byte_names = _byte_names()
        self.words = Recent()  # pre-token -> ids
        self.rank = {(a, b): i for i, (a, b) in enumerate(merges)}
        self.vocab = vocab
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.name = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        self.inner = {t: i for t, i in vocab.items() if not t.endswith(END)}
        self.final = {t[: -len(END)]: i for t, i in vocab.items() if t.endswith(END)}
        self.longest = max(map(len, [*self.inner, *self.final]))
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.n_ids = max(self.name) + 1
        self.id_bytes = [i.to_bytes(4, "little") for i in range(self.n_ids)]
        self.name_bytes = [self.name.get(i, "").encode() for i in range(self.n_ids)]
        self.good_pairs = np.empty(0, np.int64)
        self.bad_pairs = np.empty(0, np.int64)
        self.chunks = Recent()  # chunk -> ids' bytes, their number, decoded bytes
        self.merged_words = self.guessed_words = 0

    def guess(self, word: str) -> list[int] | None:
        out, i, n, inner = [], 0, len(word), self.inner
        while i < n:
            found = self.final.get(word[i:])
            if found is not None:
                out.append(found)
                return out
            for j in range(min(n - 1, i + self.longest), i, -1):
                if (piece := word[i:j]) in inner:
                    out.append(inner[piece])
                    i = j
                    break
            else:
                return None
        return out

    def merge(self, symbols: list[str]) -> list[int]:
        """The merges in rank order, leftmost first: by scanning a short list, else over a linked list with a heap."""
        n, rank = len(symbols), self.rank
        if n <= 48:
            text, none = list(symbols), len(rank)
            ranks = [rank.get(p, none) for p in zip(text, text[1:], strict=False)]
            while ranks and (least := min(ranks)) < none:
                i = ranks.index(least)
                text[i : i + 2] = [text[i] + text[i + 1]]
                del ranks[i]
                if i:
                    ranks[i - 1] = rank.get((text[i - 1], text[i]), none)
                if i < len(ranks):
                    ranks[i] = rank.get((text[i], text[i + 1]), none)
            return [self.vocab[t] for t in text if t in self.vocab]
        text, after, before = list(symbols), [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, text[i], text[i + 1]) for i in range(n - 1) if (r := rank.get((text[i], text[i + 1]))) is not None]
        heapq.heapify(heap)
        gone = [False] * n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j < 0 or text[i] != a or text[j] != b:
                continue
            text[i], gone[j], after[i] = a + b, True, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := rank.get((text[x], text[y]))) is not None:
                    heapq.heappush(heap, (r, x, text[x], text[y]))
        return [self.vocab[text[i]] for i in range(n) if not gone[i] and text[i] in self.vocab]

    def exact(self, word: str) -> list[int]:
        return self.merge([*word[:-1], word[-1] + END]) if word else []

    def _symbols(self, token: int) -> list[str]:
        t = self.name[token]
        return [*t[: -len(END) - 1], t[-len(END) - 1 :]] if t.endswith(END) and len(t) > len(END) else list(t)

    def _holds(self, pair: int) -> bool:
        """Whether merging the two tokens' symbols gives the two tokens back; a pair with n_ids is one token alone."""
        a, b = divmod(pair, self.n_ids + 1)
        tokens = [a] if b == self.n_ids else [a, b]
        return self.merge([s for t in tokens for s in self._symbols(t)]) == tokens

    def verified(self, words: list[str]) -> dict[str, list[int]]:
        guesses = [self.guess(w) for w in words]
        sure = [i for i, g in enumerate(guesses) if g]
        out = {w: self.exact(w) for w, g in zip(words, guesses, strict=True) if not g}
        self.guessed_words += len(sure)
        if not sure:
            return out
        lengths = np.fromiter((len(guesses[i]) for i in sure), np.int64, len(sure))
        ids = np.fromiter((t for i in sure for t in guesses[i]), np.int64, int(lengths.sum()))
        word_of = np.repeat(np.arange(len(sure)), lengths)
        last = np.append(word_of[1:] != word_of[:-1], True)
        follower = np.where(last, self.n_ids, np.append(ids[1:], self.n_ids))
        pairs = ids * (self.n_ids + 1) + follower  # every adjacent pair, and each last token alone
        distinct = np.unique(pairs)
        new = distinct[~np.isin(distinct, self.good_pairs, assume_unique=True) & ~np.isin(distinct, self.bad_pairs, assume_unique=True)]
        if len(self.good_pairs) + len(self.bad_pairs) > CACHED_PAIRS:
            self.good_pairs, self.bad_pairs, new = np.empty(0, np.int64), np.empty(0, np.int64), distinct
        holds = np.fromiter((self._holds(int(p)) for p in new), bool, len(new))
        self.good_pairs = np.union1d(self.good_pairs, new[holds])
        self.bad_pairs = np.union1d(self.bad_pairs, new[~holds])
        failed = np.zeros(len(sure), bool)
        failed[word_of[np.isin(pairs, self.bad_pairs)]] = True
        self.merged_words += int(failed.sum())
        out.update((words[i], self.exact(words[i]) if bad else guesses[i]) for i, bad in zip(sure, failed.tolist(), strict=True))
        return out

    def _parts(self, chunk: str) -> list[str | int]:
        """Pre-tokens, and ids of special tokens, of a chunk without white space."""
        pieces = self.split_special.split(chunk) if self.split_special and "<" in chunk else [chunk]
        out: list[str | int] = []
        for p in pieces:
            if p in self.special:
                out.append(self.special[p])
            elif p and max(p) < _PLAIN:
                words = self.words_in(p.lower())
                out += words if p.isascii() and p.isprintable() else [w.encode().decode("latin-1").translate(self.byte_names) for w in words]
            elif p:
                out += [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(p))]
        return out

    def learn(self, chunks: set[str]) -> None:
        """Add the chunks' encodings to self.chunks."""
        parts = {c: self._parts(c) for c in chunks}
        words = {w for p in parts.values() for w in p if isinstance(w, str)}
        self.words.add(self.verified(list(self.words.missing(words))))
        done, found = self.words.young, {}
        for c, p in parts.items():
            ids = [t for w in p for t in (done[w] if isinstance(w, str) else (w,))]
            found[c] = b"".join([self.id_bytes[t] for t in ids]), len(ids), b" ".join([self.name_bytes[t] for t in ids])
        self.chunks.add(found)

    def split(self, text: str) -> list[str]:
        return [c for c in _SPACE.split(text) if c] if _ODD_SPACE.search(text) else text.split()

    def encode_batch(self, texts: list[str]) -> list[tuple[bytes, int, bytes]]:
        """For each text: ids as little-endian unsigned 32-bit integers, their number, the decoded text in UTF-8."""
        out = []
        for at in range(0, len(texts), 512):
            split = [self.split(t) for t in texts[at : at + 512]]
            distinct = set().union(*split)
            self.learn(self.chunks.missing(distinct))
            known = self.chunks.young
            for chunks in split:
                found = [x for x in map(known.__getitem__, chunks) if x[1]]
                out.append((b"".join([x[0] for x in found]), sum([x[1] for x in found]), b" ".join([x[2] for x in found])))
        return out

    def forget(self) -> None:
        self.chunks.clear()
        self.words.clear()

    def decode(self, ids) -> str:
        return " ".join(self.name[int(i)] for i in ids)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(docs: DataFrame, path: str, id_col="doc_id", text_col="text") -> DataFrame:
    """docs -> doc_id, ids (binary: little-endian unsigned 32-bit), n_tokens, decoded."""
    return _mapped(docs, path, id_col, text_col, digest=False)


def encode_digests(docs: DataFrame, path: str, id_col="doc_id", text_col="text") -> DataFrame:
    """docs -> doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return _mapped(docs, path, id_col, text_col, digest=True)


def _mapped(docs: DataFrame, path: str, id_col: str, text_col: str, digest: bool) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        e = encoder(path)
        for b in batches:
            done = e.encode_batch(b.column("text").to_pylist())
            n = pa.array([x[1] for x in done], pa.int64())
            if digest:
                cols = {"n_tokens": n, "ids_sha256": pa.array([hashlib.sha256(x[0]).hexdigest() for x in done], pa.string()), "decoded_sha256": pa.array([hashlib.sha256(x[2]).hexdigest() for x in done], pa.string())}
            else:
                cols = {"ids": pa.array([x[0] for x in done], pa.binary()), "n_tokens": n, "decoded": pa.array([x[2].decode() for x in done], pa.string())}
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols.values()], ["doc_id", *cols])
        e.forget()

    more = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "ids binary, n_tokens long, decoded string"
    return rows.mapInArrow(run, f"doc_id {kind}, {more}")
