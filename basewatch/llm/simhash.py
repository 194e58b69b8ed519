"""SimHash near-dedup with vantage-point trees.

A document's fingerprint has 64 bits, each the majority over the hashes of its three-word shingles,
repeats counted. Fingerprints that differ in at most RADIUS bits are linked; components of links are
groups of near duplicates. Equal fingerprints are one node, so exact copies cost one row.

Nodes are dealt to shards by a vantage-point tree: an inner node has a vantage point and a radius,
and a fingerprint goes near or far by its Hamming distance to that point. The tree is fitted on a
bounded sample (SAMPLE fingerprints at most, in expectation, and never more than a quarter of the nodes); every node is placed by it. A fingerprint has
one home, and is also asked in every other shard that its ball overlaps: by the triangle inequality
all that lies within RADIUS of it is found on the near side only if its distance is at most the
radius plus RADIUS, and on the far side only if it is over the radius minus RADIUS. A pair is looked
for once, in the later of its two homes, so only later shards are asked. Nothing else is cut off:
each linked pair meets in exactly one shard.

A shard is gone through by further vantage points, chosen among its own rows, with the same bounds,
until few rows are left, and these are compared bit by bit. Fingerprints already in one component
needn't be compared, so a dense group of thousands of near copies costs about one pass, not all its
pairs; a shard gives back only links that join components (a forest), never all pairs. Shards of more
than PIECE homes or asked rows are split by a hash on both sides, and each pair of pieces is a task's
group of its own: no group grows with the data.

The number of shards grows with the 0.6th power of the nodes: unrelated fingerprints lie at distance
32 give or take 4 of any vantage point, so that about three fifths of them overlap both sides of a
median radius. Copies of a row then grow like the 0.4th power and comparisons inside a shard fall
behind the square; that is what exact search by these bounds costs.

Links depend on fingerprints alone and are exact. Components are found by passing on smallest labels,
each round written to the shared folder.

Defined cases: null or empty text, or one without words, has fingerprint zero, linked like any other;
texts of one or two words are one shingle; rows with a null doc_id are linked with nothing and have a
null component; rows that share a doc_id but not their text are judged each by its own text; repeated
rows each come out; a very long text is one row of a task, whose words have to fit there; an empty
table gives an empty one; other columns, whatever their names, are carried or left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basewatch.llm.common import cut, packed, unpacked
from basewatch.llm.near_dedup import components

WIDTH, SEED, RADIUS = 3, 42, 3
SAMPLE, PIECE, SMALL = 131_072, 65_536, 384
_ROWS = 1 << 16


def fingerprint(text: bytes | None) -> int:
    """Bits set in over half of the shingles' hashes; zero if there is no word."""
    import xxhash

    words = text.lower().split() if text else []  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    whole, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n, h = max(1, len(words) - WIDTH + 1), xxhash.xxh64_intdigest
    begins = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    ends = ends[min(WIDTH, len(words)) - 1 :].tolist()
    votes = np.zeros(64, np.int64)
    for i in range(0, n, _ROWS):
        hashes = np.fromiter((h(whole[a:b], SEED) for a, b in zip(begins[i : i + _ROWS], ends[i : i + _ROWS], strict=True)), np.uint64, min(_ROWS, n - i))
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """docs -> doc_id, node: the fingerprint as a signed long."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches):
        for b in batches:
            nodes = np.fromiter((fingerprint(t.as_py()) for t in b.column("text")), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(nodes.view(np.int64))], ["doc_id", "node"])

    return rows.mapInArrow(run, "doc_id long, node long")


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


def split(points: np.ndarray) -> tuple[np.uint64, int] | None:
    """A vantage point among points whose distances spread widest, and the radius that halves them best; None if none divides them."""
    tried = points[:: max(1, len(points) // 4)][:4]
    sample = points[:: max(1, len(points) // 2048)]
    spread = [(float(d.std()), -i) for i, v in enumerate(tried) for d in [distance(sample, v)]]
    vantage = tried[-max(spread)[1]]
    d = np.sort(distance(points, vantage))
    if d[0] == d[-1]:
        return None
    radius = int(d[(len(d) - 1) // 2])
    return vantage, radius if radius < d[-1] else radius - 1


class Tree:
    """A vantage-point tree: for each inner node its point, radius, and the nodes near and far; a leaf's number is ~node."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.nodes, self.leaves = [], 0
        self.root = self._grow(sample, leaves)

    def _grow(self, points: np.ndarray, leaves: int) -> int:
        found = split(points) if leaves > 1 and len(points) > 16 else None
        if found is None:
            self.leaves += 1
            return ~(self.leaves - 1)
        vantage, radius = found
        near = distance(points, vantage) <= radius
        at = len(self.nodes)
        self.nodes.append(None)
        self.nodes[at] = (vantage, radius, self._grow(points[near], leaves - leaves // 2), self._grow(points[~near], leaves // 2))
        return at

    def place(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each point's home, and all pairs (row, leaf) of later leaves that its ball overlaps."""
        home, rows, leaves = np.zeros(len(points), np.int32), [], []

        def walk(node: int, at: np.ndarray, inside: np.ndarray) -> None:
            if not len(at):
                return
            if node < 0:
                home[at[inside]] = ~node
                rows.append(at[~inside])
                leaves.append(np.full(len(rows[-1]), ~node, np.int32))
                return
            vantage, radius, near, far = self.nodes[node]
            d = distance(points[at], vantage)
            go = d <= radius + RADIUS
            walk(near, at[go], inside[go] & (d[go] <= radius))
            go = d > radius - RADIUS
            walk(far, at[go], inside[go] & (d[go] > radius))

        walk(self.root, np.arange(len(points)), np.ones(len(points), bool))
        rows, leaves = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*leaves, np.zeros(0, np.int32)])
        later = leaves > home[rows]
        return home, rows[later], leaves[later]


class Forest:
    """Components of the rows seen so far, and the links that joined them."""

    def __init__(self, n: int):
        self.up, self.a, self.b = np.arange(n), [], []

    def labels(self, at: np.ndarray) -> np.ndarray:
        out = self.up[at]
        while (further := self.up[out] != out).any():
            out = np.where(further, self.up[out], out)
        self.up[at] = out
        return out

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Take in links a[i]-b[i], keeping those that join two components."""
        while len(a):
            x, y = self.labels(a), self.labels(b)
            apart = x != y
            a, b, x, y = a[apart], b[apart], np.maximum(x, y)[apart], np.minimum(x, y)[apart]
            x, first = np.unique(x, return_index=True)  # each larger root goes below one smaller root
            self.up[x] = y[first]
            self.a.append(a[first])
            self.b.append(b[first])


def linked(points: np.ndarray, homes: np.ndarray, asked: np.ndarray, forest: Forest, alone: bool) -> None:
    """Link all rows of homes within RADIUS of a row of asked (indexes of points). alone: both are the same rows."""
    todo = [(homes, asked, alone)]
    while todo:
        h, q, same = todo.pop()
        if not len(h) or not len(q):
            continue
        found = split(points[h]) if len(h) > SMALL and len(q) > 16 else None
        if found is None:
            _compare(points, h, q, forest)
            continue
        vantage, radius = found
        dh, dq = distance(points[h], vantage), distance(points[q], vantage)
        # all within 1 of the point and all within RADIUS - 1 of it are linked, whatever their own distance
        inner, outer = h[dh <= 1], q[dq <= RADIUS - 1]
        if len(inner) and len(outer):
            forest.link(np.full(len(outer), inner[0]), outer)
            forest.link(inner, np.full(len(inner), outer[0]))
        for of_h, of_q in ((dh <= radius, dq <= radius + RADIUS), (dh > radius, dq > radius - RADIUS)):
            todo.append((h[of_h], q[of_q], False))


def _compare(points: np.ndarray, h: np.ndarray, q: np.ndarray, forest: Forest) -> None:
    """Compare rows of different components."""
    step = max(1, (1 << 18) // max(1, len(q)))
    for i in range(0, len(h), step):
        some = h[i : i + step]
        own, other = forest.labels(some), forest.labels(q)
        rest = q[other != own[0]] if (own == own[0]).all() else q
        if len(rest):
            a, b = np.nonzero(distance(points[some][:, None], points[rest][None, :]) <= RADIUS)
            forest.link(some[a], rest[b])


def links(nodes: DataFrame) -> DataFrame:
    """nodes(node), all different -> a, b: links within RADIUS whose components are those of all such links."""
    n = nodes.count()
    share = min(0.25, SAMPLE / max(n, 1))
    kept = F.pmod(F.xxhash64("node", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = np.sort(np.array([r[0] for r in nodes.filter(kept).select("node").collect()], np.int64)).view(np.uint64)
    tree = Tree(sample, max(1, min(len(sample) // 16, round((n / 512) ** 0.6))))

    def placed(batches):
        for b in batches:
            points = b.column("node").to_numpy().view(np.uint64)
            home, rows, leaves = tree.place(points)
            for i in range(0, len(rows) + 1, _ROWS):
                at = rows[i : i + _ROWS]
                yield pa.RecordBatch.from_arrays([pa.array(leaves[i : i + _ROWS]), pa.array(points[at].view(np.int64)), pa.array(np.zeros(len(at), bool))], ["leaf", "node", "home"])
            yield pa.RecordBatch.from_arrays([pa.array(home), b.column("node"), pa.array(np.ones(len(points), bool))], ["leaf", "node", "home"])

    rows = cut(nodes.select("node").mapInArrow(placed, "leaf int, node long, home boolean"), "placed")
    pieces = lambda c: F.ceil(c / PIECE).cast("int")
    sizes = rows.groupBy("leaf").agg(pieces(F.greatest(F.sum(F.col("home").cast("long")), F.lit(1))).alias("of_h"), pieces(F.count("*")).alias("of_q"))
    # one row for each leaf, of which there are at most SAMPLE / 16
    rows = rows.join(F.broadcast(sizes), "leaf")
    at = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    # homes stand against all rows of their leaf, themselves included: both sides come from the same rows
    as_home = rows.filter("home").select("leaf", at(F.col("of_h")).alias("h"), F.explode(F.sequence(F.lit(0), F.col("of_q") - 1)).alias("q"), "node", F.lit(True).alias("home"))
    as_asked = rows.select("leaf", F.explode(F.sequence(F.lit(0), F.col("of_h") - 1)).alias("h"), at(F.col("of_q")).alias("q"), "node", F.lit(False).alias("home"))

    def compare(group: pa.Table) -> pa.Table:
        points, home = group.column("node").to_numpy().view(np.uint64), group.column("home").to_numpy(zero_copy_only=False)
        distinct, at = np.unique(points, return_inverse=True)
        forest = Forest(len(distinct))
        linked(distinct, at[home], at[~home], forest, False)
        a, b = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (forest.a, forest.b))
        return pa.table({"a": distinct[a].view(np.int64), "b": distinct[b].view(np.int64)})

    return as_home.unionByName(as_asked).groupBy("leaf", "h", "q").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """docs -> doc_id, fingerprint (16 hex digits), component_id, kept (doc_id = component_id)."""
    rows = cut(fingerprints(docs, id_col, text_col), "fingerprints")
    firsts = cut(rows.filter("doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first_id")), "nodes")
    labels = components(cut(links(firsts), "links"))
    of_node = firsts.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    names = of_node.groupBy("label").agg(F.min("first_id").alias("component_id"))
    of_node = cut(of_node.join(names, "label").select("node", "component_id"), "components")
    out = rows.join(of_node, "node", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return out.select("doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """The rows of docs of which each group of near duplicates keeps one document, with all their columns."""
    gone = cut(near_duplicates(docs, id_col, text_col).filter("NOT kept").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    rows = packed(docs, _key=F.col(id_col).cast("long"))
    return unpacked(rows.join(gone, F.col("_key") == F.col("_gone"), "left_anti"))
