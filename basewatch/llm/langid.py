"""Language ID by unigrams with the segmentations summed out.

Each language has a probability for every piece of a fixed public vocabulary. A word's
probability under a language is the sum over all its segmentations into pieces of the product of
their probabilities, by a forward pass; a text's score is the sum of its words' logarithms. The
language with the largest score is predicted, with its posterior under even priors.

Training: the expected number of times that each piece is used, over all segmentations, by a
forward and a backward pass under the last round's probabilities (round one starts from piece
order alone, alike for all languages), weighted by how often a word occurs in the language. The
words come from at most `sample` labelled documents of each language in expectation, chosen by a
hash of their id; their counts are added up by Spark, the passes run in its tasks, and the driver
gets one row of numbers for each language: languages times pieces, whatever the input's size.

Only text and the label are used in training, and text alone in prediction. Words are runs of
letters, lower-cased, and never cut: blocks are made of words of like length, and long ones are
summed in logarithms, so that no segmentation is left out and nothing underflows.

Defined cases: a text that is null or has no letter is `und` with score 0; rows without label aren't
learnt from; equal scores go to the language first in order; with nothing to learn from all is
`und`; repeated rows are learnt from as often as they stand and each come out; a word of very many
letters costs time in proportion to them; an empty table gives an empty one; other columns, whatever
their names, aren't read. More than `MAX_LANGS` languages are an error, since the model has a number
for each piece and language.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basewatch.llm.common import cut
from basewatch.llm.pieces import MARK, WIDE, Words, piece_table, unknown_log_prob, zipf_log_probs

SAMPLE, ROUNDS, SMOOTH = 4000, 2, 0.5
BLOCK, MAX_WORDS, MAX_LANGS = 32_768, 400_000, 400
#: In linear space every character is worth e to the STEP more: up to WIDE characters then stay within the range of doubles.
STEP = 10.0


class Segmenter:
    """Forward and backward passes for all words of a block and all languages at once."""

    def __init__(self, path: str, probs: np.ndarray):
        self.table = piece_table(path)
        self.probs = probs  # pieces x languages
        self.unknown = np.exp(unknown_log_prob(len(probs)))

    def lattice(self, w: Words):
        """For each end position d and length k: rows with a piece there, and the pieces; rows without any one-character piece."""
        for d in range(1, w.width + 1):
            rows = np.nonzero(w.lengths >= d)[0]
            for k in range(1, min(d, self.table.longest) + 1):
                piece = self.table.find(w.substring(rows, d, k))
                hit = piece >= 0
                yield d, k, rows[hit], piece[hit], rows[~hit] if k == 1 else None

    def forward(self, w: Words, edges) -> np.ndarray:
        """Sums over all segmentations of each prefix, times e to the STEP for each character."""
        a = np.zeros((w.width + 1, len(w.lengths), self.probs.shape[1]))
        a[0] = 1
        for d, k, rows, piece, missing in edges:
            a[d, rows] += a[d - k, rows] * (self.probs[piece] * np.exp(STEP * k))
            if missing is not None:
                a[d, missing] += a[d - 1, missing] * (self.unknown * np.exp(STEP))
        return a

    def forward_logs(self, w: Words, edges) -> np.ndarray:
        """Logarithms of the sums over all segmentations of each prefix."""
        a = np.full((w.width + 1, len(w.lengths), self.probs.shape[1]), -np.inf)
        a[0] = 0
        for d, k, rows, piece, missing in edges:
            a[d, rows] = np.logaddexp(a[d, rows], a[d - k, rows] + np.log(self.probs[piece]))
            if missing is not None:
                a[d, missing] = np.logaddexp(a[d, missing], a[d - 1, missing] + np.log(self.unknown))
        return a

    def log_probs(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), self.probs.shape[1]))
        for at in blocks(words):
            w = Words([words[i] for i in at])
            rows = np.arange(len(at))
            if w.width <= WIDE:
                out[at] = np.log(self.forward(w, self.lattice(w))[w.lengths, rows]) - STEP * w.lengths[:, None]
            else:
                out[at] = self.forward_logs(w, self.lattice(w))[w.lengths, rows]
        return out

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece by language; counts: words x languages."""
        out = np.zeros_like(self.probs)
        for at in blocks(words):
            w = Words([words[i] for i in at])
            (self._expected if w.width <= WIDE else self._expected_logs)(w, counts[at], out)
        return out

    def _expected(self, w: Words, counts: np.ndarray, out: np.ndarray) -> None:
        edges, at = list(self.lattice(w)), np.arange(len(w.lengths))
        a = self.forward(w, edges)
        b = np.zeros_like(a)
        b[w.lengths, at] = counts / a[w.lengths, at]
        for d, k, rows, piece, missing in reversed(edges):
            if missing is not None:
                b[d - 1, missing] += b[d, missing] * (self.unknown * np.exp(STEP))
            use = b[d, rows] * (self.probs[piece] * np.exp(STEP * k))
            b[d - k, rows] += use
            np.add.at(out, piece, use * a[d - k, rows])

    def _expected_logs(self, w: Words, counts: np.ndarray, out: np.ndarray) -> None:
        edges, at = list(self.lattice(w)), np.arange(len(w.lengths))
        a = self.forward_logs(w, edges)
        b = np.full_like(a, -np.inf)
        with np.errstate(divide="ignore"):
            b[w.lengths, at] = np.log(counts) - a[w.lengths, at]
        for d, k, rows, piece, missing in reversed(edges):
            if missing is not None:
                b[d - 1, missing] = np.logaddexp(b[d - 1, missing], b[d, missing] + np.log(self.unknown))
            use = b[d, rows] + np.log(self.probs[piece])
            b[d - k, rows] = np.logaddexp(b[d - k, rows], use)
            np.add.at(out, piece, np.exp(use + a[d - k, rows]))


def blocks(words: list[str]):
    """Indices of words in blocks of like length; a block's matrix has at most BLOCK * WIDE cells, or one row."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    start = 0
    while start < len(order):
        # the longest word is the last: widen while the matrix still fits; words of the linear path don't share a block with longer ones
        end = start + 1
        low, high = end, len(order)
        if lengths[order[start]] <= WIDE:
            high = start + int(np.searchsorted(lengths[order[start:]], WIDE, side="right"))
        while low < high:
            middle = (low + high + 1) // 2
            if (middle - start) * int(lengths[order[middle - 1]]) <= BLOCK * WIDE:
                low = middle
            else:
                high = middle - 1
        yield order[start:low]
        start = low


@lru_cache(maxsize=1)
def _letters():
    import regex

    return regex.compile(r"\p{L}+").findall


def letters(text: str | None) -> list[str]:
    return _letters()(text.lower()) if text else []


def is_held_out(id_col: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _word_counts(labelled: DataFrame) -> DataFrame:
    """labelled(lang, text) -> lang, word, n: counted in each batch first, so that a common word is one row of a batch."""

    def run(batches):
        for b in batches:
            counts: dict[tuple[str, str], int] = {}
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                for w in letters(text):
                    counts[lang, MARK + w] = counts.get((lang, MARK + w), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"])

    return labelled.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, path: str, sample=SAMPLE, rounds=ROUNDS, text_col="text", lang_col="lang") -> tuple[list[str], np.ndarray]:
    """docs: labelled rows with a doc_id, none held out. -> languages in order, pieces x languages probabilities."""
    labelled = docs.select("doc_id", F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGS + 1).collect()}
    langs = sorted(sizes)
    if len(langs) > MAX_LANGS:
        raise ValueError(f"{len(langs)} languages; the model is made for {MAX_LANGS} at most")
    n_pieces = len(piece_table(path).pieces)
    if not langs:
        return [], np.zeros((n_pieces, 0))
    part = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, sample / sizes[lang]))])
    chosen = labelled.filter((F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1_000_003)) / 1_000_003.0) < part[F.col("lang")])
    words = cut(_word_counts(chosen.select("lang", "text")), "lang-words")
    probs = np.repeat(np.exp(zipf_log_probs(n_pieces))[:, None], len(langs), axis=1)
    column = {lang: i for i, lang in enumerate(langs)}
    for _ in range(rounds):
        now = probs

        def uses(batches, now=now):
            s, total = Segmenter(path, now), np.zeros_like(now)
            for pdf in batches:
                for i in range(0, len(pdf), BLOCK):
                    part = pdf.iloc[i : i + BLOCK]
                    names, at = np.unique(part["word"].to_numpy(object), return_inverse=True)
                    counts = np.zeros((len(names), len(langs)))
                    np.add.at(counts, (at, part["lang"].map(column).to_numpy()), part["n"].to_numpy())
                    total += s.expected(list(names), counts)
            piece, lang = np.nonzero(total)
            yield pd.DataFrame({"lang": lang, "piece": piece, "uses": total[piece, lang]})

        got = words.mapInPandas(uses, "lang int, piece int, uses double").groupBy("lang", "piece").agg(F.sum("uses").alias("uses"))
        per_lang = got.groupBy("lang").agg(F.collect_list(F.struct("piece", "uses")).alias("p")).collect()  # at most all pieces for each language
        total = np.zeros_like(probs)
        for r in per_lang:
            total[[x["piece"] for x in r["p"]], r["lang"]] = [x["uses"] for x in r["p"]]
        base = np.exp(zipf_log_probs(n_pieces))[:, None]
        probs = (total + SMOOTH * n_pieces * base) / (total.sum(axis=0) + SMOOTH * n_pieces)
    return langs, probs


class Scorer:
    def __init__(self, path: str, langs: list[str], probs: np.ndarray):
        self.segmenter, self.langs = Segmenter(path, probs), langs
        self.rows: dict[str, int] = {}
        self.scores = np.zeros((MAX_WORDS, len(langs)))

    def documents(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for i in range(0, len(texts), 1024):
            split = [letters(t) for t in texts[i : i + 1024]]
            distinct = set().union(*split)
            new = list(distinct.difference(self.rows))
            if len(self.rows) + len(new) > len(self.scores):
                self.rows, new = {}, list(distinct)
                if len(new) > len(self.scores):
                    self.scores = np.zeros((len(new), len(self.langs)))
            self.learn(new)
            for words in split:
                if not words or not self.langs:
                    names.append("und")
                    scores.append(0.0)
                    continue
                s = self.scores[np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))].sum(axis=0)
                k = int(s.argmax())
                names.append(self.langs[k])
                scores.append(float(1 / np.exp(s - s[k]).sum()))
        return names, scores

    def learn(self, words: list[str]) -> None:
        first = len(self.rows)
        self.scores[first : first + len(words)] = self.segmenter.log_probs([MARK + w for w in words])
        self.rows.update((w, first + i) for i, w in enumerate(words))


def predict(docs: DataFrame, path: str, langs: list[str], probs: np.ndarray, text_col="text") -> DataFrame:
    """docs -> doc_id, held_out, lang_pred, score. probs, pieces times languages, goes to the tasks with the function."""
    rows = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    model = docs.sparkSession.sparkContext.broadcast(probs.astype(np.float32))  # 32,000 pieces, 4 bytes for each language

    def run(batches):
        s = Scorer(path, langs, model.value.astype(np.float64))
        for b in batches:
            names, scores = s.documents(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, path: str, sample=SAMPLE, rounds=ROUNDS) -> DataFrame:
    langs, probs = train(docs.filter(~is_held_out(F.col("doc_id"))), path, sample, rounds)
    return predict(docs, path, langs, probs)
