"""MinHash near-dedup by min-max hashing.

A document's set is that of its five-word shingles. Each permutation is hashed once and gives two
signature values, its minimum and its maximum, so half the hash evaluations make a signature of
the same length. Bands of six values bucket the documents: two sets of similarity 0.75 share one
of the 56 bands with a chance over 0.99998, two of 0.33 with one under 0.08.

Documents with equal sets are one node. In a bucket every node is held, on full sets, against one
centre; the links make components. Buckets whose nodes then lie in several components are gone
through again with another centre. The nodes of buckets that still hold several components are
joined exactly, by place in one common order (see `across`): shingles that no node of another
component has come first, then the rarest. A set's shingles from the first common one on have to
hold the whole intersection, so both sets must meet within the first seventh of the smaller one
and at a place of the larger one that follows from the two sizes. Sets that share a passage and
else are different never meet, however many there are: their own shingles fill that seventh.
Sizes are part of the join's key, in classes, so that rows which can't be similar aren't compared.
Tested pairs aren't tested again. In the steps by centre, pairs that sizes or sketches rule out
aren't tested. A sketch is four bits of each of the 336 signature values; sets of similarity 0.75
differ in 79 values with a deviation of 8, and a pair is ruled out beyond 125, six deviations off.
So a large group of near copies costs rows in proportion to its size, and no link in a bucket is
lost but with a chance of one in a thousand million.

Links are exact: intersection and union of the full sets (of 64-bit shingle hashes). Components
are found by passing on smallest labels with jumps, each round written to the shared folder.

Defined cases: a text with fewer than five words is one shingle; null text or one without words
has the empty set and is linked with nothing; rows with a null doc_id are linked with nothing and
have a null component; repeated rows are copies of each other; rows that share a doc_id but not
their text are judged each by its own text, and a component's id is still its smallest doc_id; a
very long text is one row of a task, and its set has to fit there; an empty table gives an empty
one; other columns, whatever their names, are carried or left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basewatch.llm.common import cut, packed, remove, unpacked, written

SHINGLE, PERMUTATIONS, ROWS, BANDS, SEED = 5, 168, 6, 56, 20_240
#: A link: LINK[1] * intersection >= LINK[0] * union.
LINK = (75, 100)
SKETCH_APART = 125
_SKETCH = [f"k{i}" for i in range(2 * PERMUTATIONS * 4 // 64)]
_P = np.uint64(0x9E3779B97F4A7C15)
MAX_WORDS, SETS_HELD = 1_000_000, 8_000_000


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    def __init__(self, k: int = SHINGLE):
        import xxhash

        self.hash, self.k = xxhash.xxh3_64_intdigest, k
        self.words: dict[bytes, int] = {}

    def set_of(self, text: bytes | None) -> np.ndarray:
        """Sorted distinct hashes of the text's shingles."""
        words = text.lower().split() if text else []  # of bytes: ASCII letters and ASCII white space only
        if not words:
            return np.empty(0, np.uint64)
        if len(self.words) > MAX_WORDS:
            self.words = {}
        known = self.words
        for w in set(words).difference(known):
            known[w] = self.hash(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = len(h) - self.k + 1
        width = self.k if n > 0 else len(h)
        n = max(n, 1)
        out = np.full(n, np.uint64(width), np.uint64)
        for i in range(width):
            out = _mix(out * _P + h[i : i + n])
        return np.unique(out)


class Signer:
    def __init__(self):
        r = np.random.default_rng(SEED)
        self.a = r.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = r.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)

    def signature(self, s: np.ndarray) -> np.ndarray:
        """Minimum and maximum under each permutation, side by side."""
        low, high = np.full(PERMUTATIONS, np.uint64(2**64 - 1)), np.zeros(PERMUTATIONS, np.uint64)
        for i in range(0, len(s), 512):
            h = s[i : i + 512, None] * self.a + self.b
            np.minimum(low, h.min(axis=0), out=low)
            np.maximum(high, h.max(axis=0), out=high)
        return np.stack([low, high], axis=1).ravel()

    @staticmethod
    def sketch(signature: np.ndarray) -> np.ndarray:
        """Four well-mixed bits of each value, sixteen values to a word."""
        four = ((_mix(signature * _P) >> np.uint64(17)) & np.uint64(15)).reshape(-1, 16)
        return np.bitwise_or.reduce(four << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=1).view(np.int64)

    @staticmethod
    def bands(signature: np.ndarray) -> np.ndarray:
        v = signature.reshape(BANDS, ROWS)
        out = np.arange(BANDS, dtype=np.uint64)
        for i in range(ROWS):
            out = _mix(out * _P + v[:, i])
        return out.view(np.int64)


def signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs -> doc_id, text_key, n_shingles, set_key (digest of the set, null if empty), bands, sketch."""
    text = F.col(text_col).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))

    def run(batches):
        import xxhash

        shingler, signer = Shingler(), Signer()
        for b in batches:
            n, keys, bands, sketches = [], [], [], []
            for t in b.column("text"):
                s = shingler.set_of(t.as_py())
                n.append(len(s))
                keys.append(xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None)
                v = signer.signature(s)
                bands.append(signer.bands(v) if len(s) else [])
                sketches.append(signer.sketch(v))
            words = np.array(sketches, np.int64).reshape(len(n), len(_SKETCH))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(n, pa.int64()), pa.array(keys, pa.string()), pa.array(bands, pa.list_(pa.int64())), *[pa.array(words[:, i]) for i in range(len(_SKETCH))]], ["doc_id", "text_key", "n_shingles", "set_key", "bands", *_SKETCH])

    return rows.mapInArrow(run, "doc_id long, text_key long, n_shingles long, set_key string, bands array<long>, " + ", ".join(f"{k} long" for k in _SKETCH))


def linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs(a, b), texts(node, text) -> the pairs whose full sets are similar enough."""
    # each side finds its texts by the narrow pairs, and a pair's two sides meet by both nodes: no centre's texts are in one task
    one = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    two = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = one.join(two, ["a", "b"]).select("a", "b", "text_a", "text_b")

    def run(batches):
        shingler, sets, held = Shingler(), {}, 0

        def get(node: int, column, i: int) -> np.ndarray:
            nonlocal sets, held
            s = sets.get(node)
            if s is None:
                s = shingler.set_of(column[i].as_py())
                if held > SETS_HELD:
                    sets, held = {}, 0
                sets[node], held = s, held + len(s) + 16
            return s

        for batch in batches:
            a, b, keep = batch.column("a").to_pylist(), batch.column("b").to_pylist(), []
            text_a, text_b = batch.column("text_a"), batch.column("text_b")
            for i in range(len(a)):
                x, y = get(a[i], text_a, i), get(b[i], text_b, i)
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep.append(LINK[1] * both >= LINK[0] * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def components(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """links(a, b) -> node, label: the smallest node that links lead to. labels: what is known from before."""
    edges = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if labels is not None:  # earlier components are links to their label
        known = labels.filter("node != label").select(F.col("node").alias("a"), F.col("label").alias("b"))
        edges = edges.unionByName(known).unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = cut(edges.distinct(), "edges")
    now = cut(edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels")
    while True:
        seen = edges.join(now.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        nearer = now.join(seen, now["node"] == seen["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = now.select(F.col("node").alias("label"), F.col("label").alias("far"))
        after = cut(nearer.join(jump, "label", "left").select("node", "old", F.coalesce(F.least("far", "label"), "label").alias("label")), "labels")
        if after.filter("label != old").limit(1).count() == 0:
            return after.select("node", "label")
        now = after.select("node", "label")


def _allowed(x: str, y: str):
    """Whether sizes and sketches of two rows leave a link possible."""
    a, b = F.col(f"{x}.n_shingles"), F.col(f"{y}.n_shingles")

    def differ(k: str):
        """Values of a word that differ: those with any of their four bits set in the xor."""
        w = F.col(f"{x}.{k}").bitwiseXOR(F.col(f"{y}.{k}"))
        w = w.bitwiseOR(F.shiftrightunsigned(w, 1))
        w = w.bitwiseOR(F.shiftrightunsigned(w, 2))
        return F.bit_count(w.bitwiseAND(F.lit(0x1111111111111111)))

    apart = sum((differ(k) for k in _SKETCH), F.lit(0))
    return ((LINK[1] * F.least(a, b)) >= (LINK[0] * F.greatest(a, b))) & (apart <= SKETCH_APART)


def placed_shingles(contested: DataFrame, texts: DataFrame) -> DataFrame:
    """contested(node, label, n_shingles), texts(node, text) -> node, label, n, n_shared, shingle, place.

    Of each set those shingles that a node of another label has too, with their place: those that
    none has come first, then the rarest, with the hash to break ties, alike for all. n_shared is
    how many the set has. Only places from which on there are enough for a link are kept, and only
    sets that share enough of themselves."""

    def run(batches):
        shingler = Shingler()
        for b in batches:
            for node, label, t in zip(b.column("node").to_pylist(), b.column("label").to_pylist(), b.column("text"), strict=True):
                s = shingler.set_of(t.as_py()).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), node, np.int64)), pa.array(np.full(len(s), label, np.int64)), pa.array(s)], ["node", "label", "shingle"])

    every = texts.join(contested.select("node", "label"), "node").select("node", "label", "text").mapInArrow(run, "node long, label long, shingle long")
    every = cut(every, "shingles")
    shared = every.groupBy("shingle").agg(F.count("*").alias("df"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high")
    own = every.join(shared.select("shingle", "df"), "shingle").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("own"))
    own = own.join(contested.select("node", "label", F.col("n_shingles").alias("n")), "node").withColumn("n_shared", F.size("own").cast("long"))
    own = own.filter(LINK[1] * F.col("n_shared") >= LINK[0] * F.col("n"))
    room = F.floor(F.col("n") * (LINK[1] - LINK[0]) / LINK[1]) + 1 - (F.col("n") - F.col("n_shared"))
    own = own.select("node", "label", "n", "n_shared", F.posexplode(F.slice("own", F.lit(1), F.greatest(room, F.lit(0)).cast("int"))).alias("at", "s"))
    return own.select("node", "label", "n", "n_shared", "s.shingle", (F.col("n") - F.col("n_shared") + F.col("at")).alias("place"))


def _size_class(n):
    return F.floor(F.ln(n.cast("double")) * 32).cast("int")


def across(placed: DataFrame) -> DataFrame:
    """placed_shingles()'s rows -> pairs a, b of different labels that may be linked: all that are linked are among them.

    Linked sets of n and m shingles have at least t(n + m) / (1 + t) in common for similarity t. The
    first common shingle in the common order stands at places p and q; all that is common stands
    there or after it, so n - p and m - q must be that large. Hence m is at most ((1 + t)(n - p) -
    tn) / t for the smaller set, and likewise for the larger one, which gives the size classes that
    an entry can meet."""
    link, both = LINK[0], LINK[0] + LINK[1]
    n, p = F.col("n"), F.col("place")
    most = F.floor((both * (n - p) - link * n) / link)  # of the other set
    short = placed.filter(most >= n).select(*[F.col(c).alias(f"s_{c}") for c in ("node", "label", "n", "n_shared", "place")], "shingle", _size_class(n).alias("small"), F.explode(F.sequence(_size_class(n), _size_class(most))).alias("large"))
    least = F.ceil(n * link / LINK[1])
    long = placed.filter(most >= least).select(*[F.col(c).alias(f"l_{c}") for c in ("node", "label", "n", "n_shared", "place")], "shingle", F.explode(F.sequence(_size_class(least), _size_class(F.least(n, most)))).alias("small"), _size_class(n).alias("large"))
    s, l = (lambda c: F.col(f"s_{c}")), (lambda c: F.col(f"l_{c}"))  # noqa: E741
    met = short.join(long, ["shingle", "small", "large"])
    need = link * (s("n") + l("n"))
    met = met.filter((s("label") != l("label")) & ((s("n") < l("n")) | ((s("n") == l("n")) & (s("node") < l("node")))))
    met = met.filter((both * (s("n") - s("place")) >= need) & (both * (l("n") - l("place")) >= need) & (both * F.least(s("n_shared"), l("n_shared")) >= need))
    return met.select(F.greatest("s_node", "l_node").alias("a"), F.least("s_node", "l_node").alias("b")).distinct()


def _nodes(rows: DataFrame) -> DataFrame:
    """Signed rows -> one node for each distinct set: set_key, node, first_id, text_key, n_shingles, bands, sketch.

    A node is named by the smallest doc_id of its set. Where rows of one doc_id have different
    sets, these get names of their own below all ids, by their digest."""
    full = rows.filter("doc_id IS NOT NULL AND set_key IS NOT NULL")
    one = full.groupBy("set_key").agg(F.min(F.struct("doc_id", "text_key")).alias("m"), *[F.first(c).alias(c) for c in ("n_shingles", "bands", *_SKETCH)])
    one = one.select("set_key", F.col("m.doc_id").alias("first_id"), "m.text_key", "n_shingles", "bands", *_SKETCH)
    several = full.groupBy("doc_id").agg(F.min("set_key").alias("low"), F.max("set_key").alias("high")).filter("low != high").select(F.col("doc_id").alias("first_id"), F.lit(True).alias("unsure"))
    own_name = -(F.lit(2**62) + F.pmod(F.xxhash64("set_key"), F.lit(2**62)))
    return one.join(several, "first_id", "left").withColumn("node", F.when(F.col("unsure"), own_name).otherwise(F.col("first_id"))).drop("unsure")


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """docs -> doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    rows, signed_path = written(signed(docs, id_col, text_col), "signed")
    nodes, nodes_path = written(_nodes(rows), "nodes")
    # signatures are the bulk of what is written: each table of them goes as soon as the next one is there
    rows = cut(rows.select("doc_id", "n_shingles", "set_key"), "sets")
    remove(spark, signed_path)
    in_bands = nodes.select("node", F.explode("bands").alias("band"))
    buckets = cut(in_bands.groupBy("band").agg(F.min("node").alias("centre"), F.count("*").alias("n")).filter("n > 1").select("band", "centre"), "centres")
    # only buckets of several nodes: everything below works on these few rows
    shared = cut(in_bands.join(buckets, "band"), "buckets")
    marks = cut(nodes.join(shared.select("node").distinct(), "node", "left_semi").select("node", "first_id", "text_key", "n_shingles", *_SKETCH), "sketches")
    nodes = cut(nodes.select("set_key", "node", "first_id"), "names")
    remove(spark, nodes_path)
    text = F.col(text_col).cast("binary")
    texts = docs.select(F.col(id_col).cast("long").alias("first_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    # narrow and written, so that Spark knows how small it is: as long as it may be broadcast, no text is shuffled to be found
    wanted = cut(marks.select("node", "first_id", "text_key"), "wanted")
    texts, texts_path = written(texts.join(wanted, ["first_id", "text_key"]).dropDuplicates(["node"]).select("node", "text"), "texts")
    marks = marks.drop("first_id", "text_key")

    def stars(rows: DataFrame) -> DataFrame:
        """rows(node, centre) -> pairs of different nodes that may be similar."""
        p = rows.filter("node != centre").select("node", "centre").distinct().join(marks, "node").alias("x")
        p = p.join(marks.withColumnRenamed("node", "other_node").alias("y"), (F.col("x.centre") == F.col("y.other_node")) & _allowed("x", "y"))
        return p.select(F.greatest("x.node", "x.centre").alias("a"), F.least("x.node", "x.centre").alias("b")).distinct()

    tested = cut(stars(shared), "pairs")
    links = cut(linked(tested, texts), "links")
    labels = components(links)
    for last in (False, True):
        named = shared.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        apart = named.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max_by("node", "label").alias("other")).filter("low != high")
        left = cut(named.join(apart, "band").select("band", "node", "label", "other"), "apart")
        if last:
            contested = cut(left.select("node", "label").distinct().join(marks.select("node", "n_shingles"), "node"), "contested")
            new = across(cut(placed_shingles(contested, texts), "placed"))
        else:
            of_other = left.filter("node = other").select("band", F.col("label").alias("other_label"))
            new = stars(left.join(of_other, "band").filter("label != other_label").select("node", F.col("other").alias("centre")))
        new = cut(new.join(tested, ["a", "b"], "left_anti"), "pairs")
        more = cut(linked(new, texts), "links")
        if more.limit(1).count():
            labels = components(more, labels)
        tested = tested.unionByName(new)
    remove(spark, texts_path)  # all links are found
    of_set = nodes.select("set_key", "node", "first_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    names = of_set.groupBy("label").agg(F.min("first_id").alias("component"))
    of_set = of_set.select("set_key", "label").join(names, "label").select("set_key", "component")
    known = F.col("doc_id").isNotNull()
    out = rows.select("doc_id", "n_shingles", F.when(known, F.col("set_key")).alias("set_key")).join(of_set, "set_key", "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """The rows of docs of which each group of near duplicates keeps one document, with all their columns."""
    gone = cut(near_duplicates(docs, id_col, text_col).filter("NOT kept").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    rows = packed(docs, _key=F.col(id_col).cast("long"))
    return unpacked(rows.join(gone, F.col("_key") == F.col("_gone"), "left_anti"))
