"""Fill-in-the-middle, SimHash and lexical search against plain versions, with nulls, empty and long texts, repeats and clashing names."""

import collections
import hashlib
import math
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from basewatch.llm import fim, lexical, simhash
from basewatch.llm.common import table
from tests.llm.test_text_operators import LONG, ODD, SF

MORE = [(10, "a <P> b", "en", "a"), (11, "é€\U0001f600 x\r\n\n ñ", "es", "a"), (12, "<<S<M<P", "en", "a"), (-3, "Straße ÉCOLE école_42", "de", "b"), (14, "\n\n  \n", None, None), (15, "a\x00b", "en", "a")]
CLASH = ["n", "h", "c", "form", "output", "node", "home", "leaf", "label", "first_id", "term", "segment", "query", "score", "rank", "_key", "_gone"]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD + MORE, "doc_id long, text string, lang string, source string").withColumns({c: F.lit("mine") for c in CLASH}).cache()


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


def test_wavelet_ranks_and_cuts_equal_plain_counts():
    rng = np.random.default_rng(4)
    for n in (0, 1, 63, 64, 65, 700):
        symbols = rng.integers(0, 8, n).astype(np.uint8)
        m, at = fim.WaveletMatrix(symbols), np.arange(n + 1)
        for c in range(8):
            assert (m.rank(c, at) == [(symbols[:i] == c).sum() for i in at]).all()
    texts = ["", "a", " a  bc\n\nd é\n", "\n", "é€😀", "x" * 200 + " y\n" * 50, "  lead", "no end\n"]
    data = [t.encode() for t in texts]
    begin = np.cumsum([0, *map(len, data)])
    m = fim.WaveletMatrix(fim.classes(np.frombuffer(b"".join(data), np.uint8), begin[:-1]))
    plain = {"code point": list, "word": lambda t: re.findall(r"\s*\S+\s*|", t, re.A)[:-1] if t.strip() else [], "line": lambda t: re.findall(r"[^\n]*\n|[^\n]+", t)}
    for unit, split in plain.items():
        for i, t in enumerate(texts):
            parts = split(t)
            a, z = begin[i : i + 1], begin[i + 1 : i + 2]
            assert m.starts(unit, z)[0] - m.starts(unit, a)[0] == len(parts)
            for k in range(len(parts) + 1):
                want = len("".join(parts[:k]).encode()) if k < len(parts) else len(data[i])
                assert m.cut(unit, a, z, np.array([k]))[0] - a[0] == (want if k else 0), (unit, t, k)


def plain_fim(doc_id, text):
    t = text or ""
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(t)
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", t, None, None
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = t[:a], t[a:b], t[b:]
    return (n, "spm", f"<S>{suf}<P>{pre}<M>{mid}", pre, mid) if h[3] % 100 < 20 else (n, "psm", f"<P>{pre}<S>{suf}<M>{mid}", pre, mid)


def test_fill_in_middle(docs, odd):
    for d in (docs, odd, odd.withColumn("doc_id", F.col("doc_id") * 7919)):
        want = collections.Counter((r.doc_id, *plain_fim(r.doc_id, r.text)) for r in d.select("doc_id", "text").collect())
        got = fim.transform(d).select("doc_id", "n", "form", "output", "prefix", "middle", fim.restored(F.col("output"), F.col("form")).alias("back"))
        rows = got.collect()
        assert collections.Counter(tuple(r)[:6] for r in rows) == want
        assert collections.Counter((r.doc_id, r.back) for r in rows) == collections.Counter((r.doc_id, r.text or "") for r in d.select("doc_id", "text").collect())
    assert fim.transform(odd.limit(0)).count() == 0 and fim.digests(fim.transform(odd)).count() == len(ODD + MORE)
    words = fim.transform(docs, unit="word", plain_pct=0).filter("form <> 'plain'").collect()
    assert words and all(r.prefix == "" or r.prefix.encode()[-1:].isspace() or r.middle == "" for r in words)


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def plain_groups(rows):
    prints = {f for _, f in rows}
    up = {f: f for f in prints}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f

    ordered = sorted(prints)
    for i, a in enumerate(ordered):
        for b in ordered[:i]:
            if (a ^ b).bit_count() <= 3 and root(a) != root(b):
                up[root(a)] = root(b)
    low = {}
    for i, f in rows:
        if i is not None:
            low[root(f)] = min(low.get(root(f), i), i)
    return collections.Counter((i, f"{f:016x}", None if i is None else low[root(f)]) for i, f in rows)


def test_simhash(docs, odd):
    for d in (docs, odd):
        rows = [(r.doc_id, plain_fingerprint(r.text)) for r in d.select("doc_id", "text").collect()]
        got = simhash.near_duplicates(d).collect()
        assert collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == plain_groups(rows)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert simhash.near_duplicates(odd.limit(0)).count() == 0 and simhash.deduplicated(odd).columns == odd.columns
    # null, empty and blank texts are alike: the smallest id stays
    assert {r.doc_id: r.component_id for r in got if r.doc_id in (1, 2, 7, 14)} == {1: 1, 2: 1, 7: 1, 14: 1}


def near_copies(rng, sizes, loose):
    out = [rng.integers(0, 2**63, loose, dtype=np.uint64)]
    for n in sizes:
        x, bits = np.full(n, rng.integers(0, 2**63, dtype=np.uint64)), rng.integers(0, 9, n)
        for j in range(8):
            x = np.where(j < bits, x ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)), x)
        out.append(x)
    return np.unique(np.concatenate(out))


def test_vantage_point_tree_loses_no_link(spark, monkeypatch):
    points = near_copies(np.random.default_rng(9), [4000, 700, 300, 40], 2500)
    monkeypatch.setattr(simhash, "PIECE", 700)  # hot shards are split on both sides
    nodes = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "node long")
    found = simhash.links(nodes).collect()
    at = {int(x): i for i, x in enumerate(points.view(np.int64))}
    a, b = np.array([at[r.a] for r in found]), np.array([at[r.b] for r in found])
    assert len(found)
    mine, plain = simhash.Forest(len(points)), simhash.Forest(len(points))
    mine.link(a, b)
    n_links = 0
    for i in range(len(points)):
        near = np.nonzero(simhash.distance(points[:i], points[i]) <= 3)[0]
        n_links += len(near)
        plain.link(near, np.full(len(near), i))
    every = np.arange(len(points))
    assert (mine.labels(every) == plain.labels(every)).all()
    assert len(found) < n_links / 3  # a forest a shard, not all pairs


def plain_search(rows, items, k=10):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(fold))
    docs = [(i, c) for i, t in rows if (c := collections.Counter(terms(t)))]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df, out = collections.Counter(t for _, c in docs for t in c), collections.Counter()
    for item, text in set(items):
        scores = []
        for i, c in docs:
            m = 10 + 90 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scores.append((-s, math.inf if i is None else i))
        out.update((item, r, None if i == math.inf else i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1))
    return out


@pytest.mark.parametrize("segment", [32_768, 5])
def test_lexical_search(spark, docs, odd, segment, monkeypatch):
    monkeypatch.setattr(lexical, "SEGMENT_DOCS", segment)
    monkeypatch.setattr(lexical, "FIRST_STRETCH", 16)
    items = [(1, "one word5 Straße école_42 zzz"), (1, "one word5 Straße école_42 zzz"), (1, "three"), (2, None), (3, "..."), (4, LONG), (None, "x two"), (5, "ÉCOLE")]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("mine") for c in CLASH})
    for d, q in ((odd, asked), (docs.unionByName(docs.limit(40)), table(spark, SF, "benchmark"))):
        got = collections.Counter(tuple(r) for r in lexical.search(lexical.build_index(d), q).select("item_id", "rank", "doc_id", "score").collect())
        assert got == plain_search([(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()], [(r.item_id, r.text) for r in q.select("item_id", "text").collect()])
    assert lexical.search(lexical.build_index(odd.limit(0)), asked).count() == 0 and lexical.search(lexical.build_index(odd), asked.limit(0)).count() == 0


def test_queries_in_several_blocks_are_the_same(spark, docs, monkeypatch):
    index, items = lexical.build_index(docs), table(spark, SF, "benchmark")
    want = sorted(map(str, lexical.search(index, items).collect()))
    monkeypatch.setattr(lexical, "BLOCK_QUERIES", 9)
    assert sorted(map(str, lexical.search(index, items).collect())) == want


def test_blocks_are_rejected_before_they_are_decompressed():
    rng, segment = np.random.default_rng(2), lexical.Segment()
    texts = [" ".join(["common"] * int(rng.integers(0, 4)) + [f"w{rng.integers(40)}" for _ in range(int(rng.integers(2, 60)))] + (["rare"] * 5 if i % 97 == 0 else [])) for i in range(12_000)]
    for i, t in enumerate(texts):
        segment.add(i, t.encode())
    rows = [r for b in segment.rows("0") for r in b.to_pylist()]
    lengths = np.frombuffer(rows[-1]["last"], np.int64)
    n, total = len(lengths), int(lengths.sum())
    lists = {r["term"]: lexical.PostingList(lexical.weight(n, r["n_docs"]), [(0, r)], n, total) for r in rows[:-1]}
    for t, x in lists.items():  # block maxima are exact, and postings come back as they were
        docs, scores = x.blocks(np.arange(len(x.last)), lexical.norms(lengths, n, total))
        assert docs.tolist() == [i for i, text in enumerate(texts) if t.decode() in text.split()]
        assert [int(scores[i : i + lexical.BLOCK].max()) for i in range(0, len(scores), lexical.BLOCK)] == x.maxima.tolist()
        x.done = {}
    shard = lexical.Shard(np.arange(n), lexical.norms(lengths, n, total), lists)
    score, ids = shard.best([b"rare", b"common", b"w3"])
    want = plain_search(list(enumerate(texts)), [(0, "rare common w3")])
    assert collections.Counter((0, r, int(i), int(s)) for r, (s, i) in enumerate(zip(score, ids, strict=True), 1)) == want
    assert shard.rejected and len(lists[b"common"].done) < len(lists[b"common"].last) / 2


@pytest.mark.parametrize("values", [[], [0], [127, 128, 129, 16383, 16384, 2**31, 2**40, 5]])
def test_varints_round_trip(values):
    data, n = lexical.varints(np.array(values, np.int64))
    assert len(data) == n.sum() and lexical.from_varints(data).tolist() == values
