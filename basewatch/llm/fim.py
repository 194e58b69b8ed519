"""Fill-in-the-middle: cut a text at two hashed places and put the middle last.

Where a cut falls is found on a wavelet matrix over character classes. Each UTF-8 byte has one of
eight classes: inside a character, and seven kinds of first bytes, told apart by white space, line
end, start of a word and start of a line. The matrix holds their three bits level by level, packed,
with counts at each 64-bit word. A rank query (how often a class occurs before a place) takes three
look-ups; the starts of a unit (code points, words or lines) before a place are the sum of its
classes' ranks. A text's size in units is one difference of such sums, and a cut after k units is
found by bisection on them. One matrix is built over all texts of a block, and every step of the
bisection answers all cuts of the block together.

Only the cuts, as byte offsets, come back from the Python workers; texts are put together on the JVM
side. One map over rows, no shuffle.

Units: a code point; a word with the white space after it (the text's first also with that before
it); a line with its line feed. Words are runs of anything but ASCII white space.

Defined cases: null text counts as empty, and an empty text is plain; a null doc_id is hashed as
no digits at all; texts that hold a sentinel are plain, so that restored() gives back every text
exactly; repeated rows each come out; a very long text is one row of a task, whose classes have to
fit there; an empty table gives an empty one; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basewatch.llm.common import let

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of texts that stay plain, and of the others percent with the suffix first.
PLAIN, SPM = 10, 20
#: The classes at which a unit starts; class 0 is a byte inside a character.
STARTS = {"code point": (1, 2, 3, 4, 5, 6, 7), "word": (3, 4), "line": (3, 6, 7)}
LEVELS, BLOCK = 3, 4 << 20


def classes(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Class of each byte. begins: where texts begin.

    1 white space, 2 line feed, 3 first of a word and line, 4 first of a word, 5 later in a word,
    6 white space at a line's start, 7 line feed at a line's start."""
    feed = data == 10
    white = ((data >= 9) & (data <= 13)) | (data == 32)
    first, after_white = np.zeros(len(data), bool), np.zeros(len(data), bool)
    first[1:], after_white[1:] = feed[:-1], white[:-1]
    begins = begins[begins < len(data)]
    first[begins] = after_white[begins] = True
    word = np.where(after_white, np.where(first, 3, 4), 5)
    out = np.where(feed, np.where(first, 7, 2), np.where(white, np.where(first, 6, 1), word)).astype(np.uint8)
    out[(data & 0xC0) == 0x80] = 0
    return out


class WaveletMatrix:
    """Ranks of symbols below 2**LEVELS over a sequence; all queries are vectors."""

    def __init__(self, symbols: np.ndarray):
        self.n, self.levels = len(symbols), []
        for level in range(LEVELS - 1, -1, -1):
            bit = (symbols >> level) & 1
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(len(packed) // 8 + 2, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            before = np.zeros(len(words), np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=before[1:])
            ones = bit.view(bool)
            self.levels.append((words, before, self.n - int(before[-1])))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])
        # where each symbol's run begins on the last level
        self.run = {c: self._down(c, np.zeros(1, np.int64))[0] for c in range(2**LEVELS)}

    def _down(self, symbol: int, i: np.ndarray) -> np.ndarray:
        for k, (words, before, zeros) in enumerate(self.levels):
            below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
            ones = before[i >> 6] + np.bitwise_count(words[i >> 6] & below)
            i = zeros + ones if symbol >> (LEVELS - 1 - k) & 1 else i - ones
        return i

    def rank(self, symbol: int, i: np.ndarray) -> np.ndarray:
        """How often symbol occurs before each place i."""
        return self._down(symbol, i) - self.run[symbol]

    def starts(self, unit: str, i: np.ndarray) -> np.ndarray:
        """Units that start before each place; summed over the fewer classes."""
        own = STARTS[unit]
        rest = [c for c in range(2**LEVELS) if c not in own]
        if len(own) <= len(rest):
            return sum(self.rank(c, i) for c in own)
        return i - sum(self.rank(c, i) for c in rest)

    def cut(self, unit: str, begin: np.ndarray, end: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The place after the first k units of each stretch: the last one before which no more than k units start."""
        low, high = begin.copy(), end.copy()
        aim = self.starts(unit, begin) + k
        while (low < high).any():
            middle = (low + high + 1) >> 1
            fits = self.starts(unit, middle) <= aim
            low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
        return np.where(k <= 0, begin, low)


def _located(data: np.ndarray, at: np.ndarray, h1: np.ndarray, h2: np.ndarray, unit: str):
    """Units and the bytes before both cuts of texts data[at[i]:at[i+1]], block by block."""
    n, one, two = (np.zeros(len(h1), np.int64) for _ in range(3))
    i = 0
    while i < len(h1):
        j = max(i + 1, int(np.searchsorted(at, at[i] + BLOCK, side="right")) - 1)
        places = at[i : j + 1] - at[i]
        begin, end = places[:-1], places[1:]
        m = WaveletMatrix(classes(data[at[i] : at[j]], begin))
        n[i:j] = m.starts(unit, end) - m.starts(unit, begin)
        x, y = h1[i:j] % (n[i:j] + 1), h2[i:j] % (n[i:j] + 1)
        one[i:j] = m.cut(unit, begin, end, np.minimum(x, y)) - begin
        two[i:j] = m.cut(unit, begin, end, np.maximum(x, y)) - begin
        i = j
    return n, one, two


def cuts(text: Column, h1: Column, h2: Column, unit: str = "code point") -> Column:
    """struct<n, one, two>: a text's units, and the bytes before its cuts after the smaller and the larger of h1 and h2 modulo n + 1 units."""

    @F.arrow_udf("n long, one long, two long")
    def located(texts: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        texts = texts.cast(pa.large_binary())
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
        found = _located(data, at, a.to_numpy(), b.to_numpy(), unit)
        return pa.StructArray.from_arrays([pa.array(x) for x in found], ["n", "one", "two"])

    return located(text, h1, h2)


def hashed(doc_id: Column, seed: str = "1") -> Column:
    """The four first groups of eight hex digits of sha256(seed:doc_id), as an array of longs."""
    digest = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return let(digest, lambda d: F.array(*[F.conv(F.substring(d, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]))


def transform(docs: DataFrame, id_col="doc_id", text_col="text", unit: str = "code point", plain_pct: int = PLAIN, spm_pct: int = SPM, seed: str = "1") -> DataFrame:
    """docs -> doc_id, n (units), form (plain, psm or spm), output, prefix, middle (parts of the text, null if plain)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), hashed(F.col(id_col), seed).alias("h"))
    rows = rows.withColumn("c", cuts(F.col("text").cast("binary"), F.col("h")[0], F.col("h")[1], unit))
    plain = (F.col("text") == "") | (F.col("h")[2] % 100 >= 100 - plain_pct)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        plain = plain | F.contains("text", F.lit(mark))
    form = F.when(plain, "plain").when(F.col("h")[3] % 100 < spm_pct, "spm").otherwise("psm")
    data = F.col("text").cast("binary")
    part = lambda begin, length: F.substring(data, (begin + 1).cast("int"), length.cast("int")).cast("string")
    one, two = F.col("c.one"), F.col("c.two")
    cut = F.col("form") != "plain"
    rows = rows.select("doc_id", "text", "c", form.alias("form"))
    rows = rows.withColumns({"prefix": F.when(cut, part(F.lit(0), one)), "middle": F.when(cut, part(one, two - one)), "suffix": F.when(cut, part(two, F.octet_length("text") - two))})
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    return rows.select("doc_id", F.col("c.n").alias("n"), "form", output.alias("output"), "prefix", "middle")


def restored(output: Column, form: Column) -> Column:
    """The text from an output and its form: sentinels occur only where transform() put them."""
    between = lambda a, b: F.substring_index(F.substring_index(output, a, -1), b, 1)
    psm = F.concat(between(PREFIX, SUFFIX), F.substring_index(output, MIDDLE, -1), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), F.substring_index(output, MIDDLE, -1), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(rows: DataFrame) -> DataFrame:
    """transform()'s rows as lengths and digests of the output and of what is read back from it."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select(
        "doc_id", "n", "form", F.char_length("prefix").cast("long").alias("prefix_chars"), F.char_length("middle").cast("long").alias("middle_chars"),
        sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


ORACLE = """WITH h AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
 g AS (SELECT doc_id, t, n, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4 FROM h),
 c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
   CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
 p AS (SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1, n - b) AS suf FROM c)
 SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
