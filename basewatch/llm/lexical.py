"""Ranked lexical search by Block-Max MaxScore over an inverted index in shards.

Index. Each task turns its rows into segments of bounded size and writes, for each term of a segment,
a posting list: in blocks of BLOCK documents, gaps and term frequencies as variable-length bytes, and
beside each block its impacts, the pairs of frequency and document length that no other pair of the
block beats in both. From these a block's exact maximum score follows for any collection statistics,
so that one pass over the texts is enough. A segment's documents (ids and lengths) are one more row.
The table is written to the shared folder; it can be kept and asked again.

Search. Queries go through the index in blocks of bounded size. N, L and the document frequencies of
a block's terms are sums over index rows. Segments are dealt to shards, and a shard joins its segments'
lists end to end. For each query its lists are ordered by their greatest impact, the bound on what they
can add. With the tenth best score so far as threshold, lists whose bounds together stay below it are
non-essential: a document in none but these can't get in. The essential lists of a stretch of
documents are added up; for its candidates the block maxima of the non-essential lists are looked up,
and a candidate whose score and remaining block maxima stay below the threshold is dropped before any
block is decompressed for it. Only blocks that a live candidate falls into are decompressed. Equal
scores never drop a candidate, as a smaller id may win. Stretches grow, so that the threshold is there
early. A shard gives its best K of each query, and these heaps are merged by a ranking of few rows.

Scores are 64-bit integers, alike on every machine (see weight() and norms()).

Defined cases: null or empty text, or text without terms, isn't counted as a document and never found;
a query without terms, or whose terms no document has, has no rows; of queries that are alike in id
and text one is answered, and queries of one id but different texts are each ranked under that id; a
document with a null id is ranked, after the others of its score; repeated documents are each ranked
and take the ranks between them; a very long text is a segment of its own; an empty table gives an
empty result; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basewatch.llm.common import cut

#: Terms are runs of ASCII letters, digits and everything beyond ASCII; only A-Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes(c if c >= 0x80 or chr(c).isalnum() else 32 for c in bytes(range(256)).lower())
K, BLOCK = 10, 128
SEGMENT_DOCS, SEGMENT_BYTES = 32_768, 12 << 20
#: Documents of a shard, and queries and bytes of query text of a block, in expectation.
SHARD_DOCS, BLOCK_QUERIES, BLOCK_BYTES = 65_536, 2_048, 8 << 20
FIRST_STRETCH = 1_024
INDEX = "segment string, term binary, n_docs long, n_terms long, first binary, last binary, ends binary, impacts binary, of_impacts binary, postings binary"
_NO_ID = 2**63 - 1


def terms(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def term_column(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(f"({TERM})"), F.lit(1))


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values as bytes of seven bits, low ones first, the last of each below 128; and how many bytes each takes."""
    n = np.ones(len(values), np.int64)
    for k in range(7, 63, 7):
        n += values >= 1 << k
    at = np.cumsum(n) - n
    out = np.zeros(int(n.sum()), np.uint8)
    for k in range(int(n.max(initial=0))):
        has = n > k
        out[at[has] + k] = (values[has] >> 7 * k & 127) | np.where(n[has] > k + 1, 128, 0)
    return out, n


def from_varints(data: np.ndarray) -> np.ndarray:
    last = np.nonzero(data < 128)[0]
    if not len(last):
        return np.zeros(0, np.int64)
    first = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * place, first)


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Stretches of data that end at each of ends (in bytes), as binary values without a Python object for each."""
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


class Segment:
    def __init__(self):
        self.vocabulary: dict[bytes, int] = defaultdict(lambda: len(self.vocabulary))
        self.ids, self.lengths, self.distinct, self.held = array("q"), array("q"), array("i"), 0
        self.term, self.tf = array("i"), array("i")

    def add(self, doc_id: int | None, text: bytes | None) -> None:
        words = terms(text)
        if not words:
            return
        found = Counter(words)
        self.term.extend(map(self.vocabulary.__getitem__, found))
        self.tf.extend(found.values())
        self.distinct.append(len(found))
        self.ids.append(_NO_ID if doc_id is None else doc_id)
        self.lengths.append(len(words))
        self.held += len(text)

    def full(self) -> bool:
        return len(self.ids) >= SEGMENT_DOCS or self.held >= SEGMENT_BYTES

    def rows(self, name: str) -> list[pa.RecordBatch]:
        """A row for each term, and then the documents' own."""
        lengths = np.array(self.lengths, np.int64)
        term = np.array(self.term, np.int32)
        order = np.argsort(term, kind="stable")  # documents stay in order
        doc, tf = np.repeat(np.arange(len(lengths), dtype=np.int32), self.distinct)[order], np.array(self.tf, np.int32)[order]
        del order
        df = np.bincount(term, minlength=len(self.vocabulary))
        starts = np.cumsum(df) - df
        begins = np.zeros(len(doc) + 1, bool)  # of blocks
        of_list = -(-df // BLOCK)  # blocks
        upto = np.cumsum(of_list)
        first = np.repeat(starts, of_list) + BLOCK * (np.arange(upto[-1]) - np.repeat(upto - of_list, of_list))
        begins[first] = True
        block = (np.cumsum(begins[:-1]) - 1).astype(np.int32)
        last = np.append(first[1:], len(doc)) - 1
        gap = np.diff(doc, prepend=np.int32(0))
        gap[first] = 0
        data, n = varints(np.stack([gap, tf], axis=1).ravel())
        ends = np.cumsum(np.add.reduceat(n, 2 * first))  # of blocks, in bytes
        del gap, n, begins
        # impacts: by falling frequency, those whose length is below all lengths before
        own = lengths[doc]
        order = np.lexsort((own, -tf, block))
        block, f, own = block[order], tf[order], own[order]
        low = own - block * np.int64(lengths.max() + 1)
        better = np.ones(len(low), bool)
        better[1:] = low[1:] < np.minimum.accumulate(low)[:-1]
        of_impacts = np.cumsum(np.bincount(block[better], minlength=len(first)))
        impacts = np.stack([f[better], own[better]], axis=1).astype(np.int64)
        # every list's blocks, bytes and impacts lie side by side, in the order of terms
        relative = lambda x: (x - np.repeat(np.append(0, x[upto - 1][:-1]), of_list)).astype(np.int32)
        m = len(df)
        columns = [
            pa.repeat(name, m), pa.array(list(self.vocabulary), pa.binary()), pa.array(df, pa.int64()), pa.nulls(m, pa.int64()), _binary(doc[first].astype(np.int32), 4 * upto), _binary(doc[last].astype(np.int32), 4 * upto),
            _binary(relative(ends), 4 * upto), _binary(impacts, 16 * of_impacts[upto - 1]), _binary(relative(of_impacts), 4 * upto), _binary(data, ends[upto - 1]),
        ]
        documents = [name, None, len(lengths), int(lengths.sum()), self.ids.tobytes(), self.lengths.tobytes(), None, None, None, None]
        names, kinds = [x.split()[0] for x in INDEX.split(", ")], [pa.string(), pa.binary(), pa.int64(), pa.int64(), *[pa.binary()] * 6]
        return [pa.RecordBatch.from_arrays(columns, names), pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(documents, kinds, strict=True)], names)]


def build_index(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """docs -> the index, written to the shared folder: a row for each segment and term, and one for each segment's documents (term null)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches):
        task, made, segment = TaskContext.get().partitionId(), 0, Segment()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                segment.add(doc_id, text.as_py())
                if segment.full():
                    yield from segment.rows(f"{task}-{made}")
                    made, segment = made + 1, Segment()
        if segment.ids:
            yield from segment.rows(f"{task}-{made}")

    return cut(rows.mapInArrow(run, INDEX), "index")


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def norms(lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """m of documents of these lengths: 10 and 90 times the length over the mean length, rounded down."""
    if len(lengths) and 90 * int(lengths.max()) * n >= 2**63:
        return np.array([10 + 90 * int(x) * n // total for x in lengths], np.int64)
    return 10 + 90 * lengths * n // total


def scored(w: int, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return w * (1_000_000_000 * tf // (1000 * tf + 8 * m))


class PostingList:
    """A term's lists of a shard's segments, end to end: documents are numbered through."""

    def __init__(self, w: int, parts: list[tuple], n: int, total: int):
        first, last, ends, maxima, self.payload, self.at = [], [], [], [], [], []
        for base, row in parts:
            of = lambda c, kind=np.int32: np.frombuffer(row[c], kind).astype(np.int64)  # noqa: E731, B023
            first.append(of("first") + base)
            last.append(of("last") + base)
            e, pairs = of("ends"), of("impacts", np.int64).reshape(-1, 2)
            self.at += [(len(self.payload), int(a), int(b)) for a, b in zip(np.append(0, e[:-1]), e, strict=True)]
            self.payload.append(row["postings"])
            starts = np.append(0, of("of_impacts")[:-1])
            maxima.append(np.maximum.reduceat(scored(w, pairs[:, 0], norms(pairs[:, 1], n, total)), starts))
        self.w, self.first, self.last, self.maxima = w, np.concatenate(first), np.concatenate(last), np.concatenate(maxima)
        self.bound, self.done = int(self.maxima.max()), {}

    def block(self, i: int, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of block i. A decompressed block is held while the shard is searched."""
        if i not in self.done:
            part, a, b = self.at[i]
            values = from_varints(np.frombuffer(self.payload[part], np.uint8, b - a, a)).reshape(-1, 2)
            docs = self.first[i] + np.cumsum(values[:, 0])
            self.done[i] = docs.astype(np.int32), scored(self.w, values[:, 1], m[docs])
        return self.done[i]

    def blocks(self, which: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [self.block(int(i), m) for i in which]
        return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


class Shard:
    def __init__(self, ids: np.ndarray, m: np.ndarray, lists: dict[bytes, PostingList]):
        self.ids, self.m, self.lists = ids, m, lists
        self.decompressed = self.rejected = 0

    def best(self, query: list[bytes], k: int = K) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the k best documents with a score above zero, by falling score, then id."""
        lists = sorted((x for t in query if (x := self.lists.get(t)) and x.bound > 0), key=lambda x: -x.bound)
        after = np.cumsum([0, *[x.bound for x in lists[::-1]]])[::-1]  # what lists from the i-th on can add
        top_s, top_d, least = np.zeros(0, np.int64), np.zeros(0, np.int64), 1
        begin, width = 0, FIRST_STRETCH
        while begin < len(self.ids) and lists:
            end = min(len(self.ids), begin + width)
            essential = max(1, int((after[1:] >= least).sum() + 1)) if after[0] >= least else 0
            essential = min(essential, len(lists))
            if not essential:
                break
            total = np.zeros(end - begin, np.int64)
            for x in lists[:essential]:
                i, j = np.searchsorted(x.last, begin), np.searchsorted(x.first, end)
                if i < j:
                    docs, scores = x.blocks(np.arange(i, j), self.m)
                    a, b = np.searchsorted(docs, (begin, end))
                    total[docs[a:b] - begin] += scores[a:b]
            live = np.nonzero(total)[0]
            s, live = total[live], live + begin
            rest = lists[essential:]
            if rest and len(live):
                inside, most = np.zeros((len(rest), len(live)), np.int64), np.zeros((len(rest) + 1, len(live)), np.int64)
                for r, x in enumerate(rest):
                    i = np.minimum(np.searchsorted(x.last, live), len(x.last) - 1)
                    inside[r] = np.where((x.first[i] <= live) & (live <= x.last[i]), i, -1)
                    most[r] = np.where(inside[r] >= 0, x.maxima[i], 0)
                most = np.cumsum(most[::-1], axis=0)[::-1]  # of this list and those after it
                for r, x in enumerate(rest):
                    keep = s + most[r] >= least
                    self.rejected += int((~keep).sum())
                    live, s, inside, most = live[keep], s[keep], inside[:, keep], most[:, keep]
                    need = np.unique(inside[r])
                    need = need[need >= 0]
                    if len(need):
                        docs, scores = x.blocks(need, self.m)
                        i = np.minimum(np.searchsorted(docs, live), len(docs) - 1)
                        s = s + np.where(docs[i] == live, scores[i], 0)
            keep = (s >= least) & (s > 0)
            top_s, top_d = np.concatenate([top_s, s[keep]]), np.concatenate([top_d, live[keep]])
            order = np.lexsort((self.ids[top_d], -top_s))[:k]
            top_s, top_d = top_s[order], top_d[order]
            if len(top_s) == k:
                least = int(top_s[-1])
            begin, width = end, width * 4
        return top_s, self.ids[top_d]


def _block(index: DataFrame, asked: DataFrame, n: int, total: int, shards: int, k: int) -> DataFrame:
    """asked(query, terms), a block of bounded size -> the k best of each shard for each query."""
    queries = [(r.query, [t.encode() for t in r.terms]) for r in asked.select("query", "terms").collect()]
    wanted = asked.select(F.explode(F.col("terms").cast("array<binary>")).alias("term")).distinct()
    some = index.join(F.broadcast(wanted), "term", "left_semi")
    df = {bytes(r.term): weight(n, r.df) for r in some.groupBy("term").agg(F.sum("n_docs").alias("df")).collect()}
    rows = some.unionByName(index.filter("term IS NULL")).withColumn("shard", F.pmod(F.xxhash64("segment"), F.lit(shards)))

    def search(group: pa.Table) -> pa.Table:
        held = group.to_pylist()
        own = sorted((r for r in held if r["term"] is None), key=lambda r: r["segment"])
        ids = np.concatenate([np.frombuffer(r["first"], np.int64) for r in own])
        m = norms(np.concatenate([np.frombuffer(r["last"], np.int64) for r in own]), n, total)
        base = dict(zip((r["segment"] for r in own), np.cumsum([0, *[r["n_docs"] for r in own]]).tolist()))
        parts = defaultdict(list)
        for r in held:
            if r["term"] is not None:
                parts[r["term"]].append((base[r["segment"]], r))
        shard = Shard(ids, m, {t: PostingList(df[t], sorted(p, key=lambda x: x[0]), n, total) for t, p in parts.items()})
        out = [(q, *shard.best(ts, k)) for q, ts in queries]
        cat = lambda i: np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64)
        return pa.table({"query": np.repeat(np.array([x[0] for x in out], np.int64), [len(x[1]) for x in out]), "score": cat(1).astype(np.int64), "doc_id": cat(2).astype(np.int64)})

    return rows.groupBy("shard").applyInArrow(search, "query long, score long, doc_id long")


def search(index: DataFrame, queries: DataFrame, k: int = K, id_col="item_id", text_col="text") -> DataFrame:
    """build_index()'s table, queries -> item_id, rank, doc_id, score: each query's k best documents."""
    own = index.filter("term IS NULL").agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("total"), F.count("*").alias("segments")).first()
    asked = queries.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).distinct().withColumn("terms", F.array_distinct(term_column("text"))).filter("size(terms) > 0")
    # the query's number: a hash of what makes it one
    asked = cut(asked.select("item_id", F.xxhash64("item_id", "text").alias("query"), "terms"), "queries")
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.concat_ws(" ", "terms"))), F.lit(0)).alias("bytes")).first()
    blocks = max(1, math.ceil(size.n / BLOCK_QUERIES), math.ceil(size.bytes / BLOCK_BYTES))
    shards = max(1, math.ceil(own.n / SHARD_DOCS), min(own.segments, 8))
    found = [cut(_block(index, asked.filter(F.pmod("query", F.lit(blocks)) == b), own.n, own.total, shards, k), "best") for b in range(blocks)] if own.n else []
    if not found:
        return asked.select("item_id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    best = found[0]
    for more in found[1:]:
        best = best.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc_id"))
    best = best.withColumn("rank", rank).filter(F.col("rank") <= k)
    return best.join(asked.select("query", "item_id"), "query").select("item_id", "rank", F.nullif("doc_id", F.lit(_NO_ID)).alias("doc_id"), "score")


ORACLE = rf"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{TERM}') AS w FROM documents),
 n AS (SELECT doc_id, w, len(w)::BIGINT AS n FROM d WHERE len(w) > 0), s AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM n),
 q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{TERM}')) AS t FROM benchmark),
 u AS (SELECT doc_id, n, unnest(w) AS t FROM n), p AS (SELECT doc_id, n, t, count(*)::BIGINT AS tf FROM u WHERE t IN (SELECT t FROM q) GROUP BY ALL),
 f AS (SELECT t, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY t, nn),
 r AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll))))::BIGINT AS score FROM q JOIN p USING (t) JOIN f USING (t), s GROUP BY ALL)
 SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM r WHERE score > 0 QUALIFY rank <= 10"""
