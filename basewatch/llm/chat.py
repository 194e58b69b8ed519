"""Chat formatting as prefix trees.

Conversations are dealt to packs by their first turn, so that those which share initial turns
meet; each pack merges them into a forest whose nodes are turns. The pack holds the tokens of each
node's segment once, depth-first, and a position id for each token, which continues its parent's
(so that every conversation counts its positions as if it stood alone). A segment has its interval
in the pack, its parent, and the intervals of its ancestors, which are what it may attend to
besides itself; ancestors that stand side by side are one interval, so that a conversation that
shares nothing has one for each segment, however many turns it has.

Initial turns that more than `per_pack` conversations share are split where the conversations part:
a conversation goes to the pack of its shortest beginning that so many at most have in common (or,
where all its beginnings have more, of itself). All turns from there on are merged; only the few
before it stand once in each of the packs. Equal conversations are one path, and are put apart again
by a join at the end. So no task gets more than about `per_pack` distinct conversations, whatever
the input's shape. A conversation itself, like a text, has to fit into a task. Positions and
intervals count tokens.

Tokens are those of a byte-level BPE file of the tokenizers library, whose decoding gives every
text back. A segment's head, its text and its end are encoded apart, so that no token lies on both
sides of the loss mask and a segment's tokens are the same in every pack.

Template: <|turn|>role<|text|>text<|end|>. Control strings inside roles and texts get a backslash
after their first character (one more where there are some), and lose it when read back. The loss
mask covers the texts of assistant turns, without marks.

Defined cases: null text and null role count as empty; turns sort with null first, and equal
turns by role and text; a repeated row is a turn of its own; rows with a null conv_id are one
conversation; an empty table gives an empty one; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basewatch.llm.common import cut

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings: ours, and those of other common templates, so that no text can look like a mark.
_CONTROL = r"(<)(\\*)(\||/?s>)|(\[)(\\*)(/?INST\])"
_ESCAPE = re.compile(_CONTROL)
_UNESCAPE = re.compile(r"(<|\[)\\(\\*)(?=\||/?s>|/?INST\])")
_SEGMENT = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.DOTALL)
PER_PACK = 256
MASKED = "assistant"
#: Characters that the tokenizer is given at once: what it returns is some times larger.
AT_ONCE = 1 << 20


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: f"{m[1]}\\{m[2]}{m[3]}" if m[1] else f"{m[4]}\\{m[5]}{m[6]}", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def paths(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) -> conv_id, path (digest of the turns), turns (array in order)."""
    t = turns.select("conv_id", F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    convs = t.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    in_order = F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return convs.select("conv_id", in_order.alias("turns")).withColumn("path", F.sha2(F.to_json("turns").cast("binary"), 256))


@functools.lru_cache(maxsize=2)
def library(path: str):
    """The tokenizer of a file; the strings of special tokens are ordinary text to it."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


def _encoded(lib, texts: list[str]):
    """Token ids of each text, in order, some texts at a time."""
    start = 0
    while start < len(texts):
        end, size = start + 1, len(texts[start])
        while end < len(texts) and size + len(texts[end]) <= AT_ONCE:
            size, end = size + len(texts[end]), end + 1
        for e in lib.encode_batch_fast(texts[start:end], add_special_tokens=False):
            yield np.array(e.ids, "int32")
        start = end


def _tree(pdf: pd.DataFrame, vocabulary: str) -> pd.DataFrame:
    """One pack: rows (path, turns) -> its tokens, its segments, and the segment at which each path ends."""
    lib = library(vocabulary)
    children: dict[int, dict[tuple[str, str], int]] = {-1: {}}
    nodes: list[tuple[str, str]] = []
    leaves = []
    for path, turns in sorted(zip(pdf["path"], pdf["turns"], strict=True), key=lambda x: x[0]):
        at = -1
        for t in turns:
            key = (t["role"], t["text"])
            child = children[at].get(key)
            if child is None:
                child = children[at][key] = len(nodes)
                nodes.append(key)
                children[child] = {}
            at = child
        leaves.append((path, at))
    roles = sorted({role for role, _ in nodes})
    heads = dict(zip(roles, _encoded(lib, [f"{TURN}{escape(r)}{TEXT}" for r in roles]), strict=True))
    (close,) = _encoded(lib, [END])
    bodies = list(_encoded(lib, [escape(text) for _, text in nodes]))
    tokens, positions, segments, place, length = [], [], [], {}, 0
    stack = [(n, -1, 0, []) for _, n in sorted(children[-1].items(), reverse=True)]
    while stack:  # depth-first
        node, parent, position, above = stack.pop()
        role = nodes[node][0]
        segment = np.concatenate([heads[role], bodies[node], close])
        start, end = length, length + len(segment)
        text_start = start + len(heads[role])
        place[node] = len(segments)
        segments.append({"parent": parent, "start": start, "end": end, "loss_start": text_start if role == MASKED else end, "loss_end": text_start + len(bodies[node]) if role == MASKED else end, "ancestors": above})
        tokens.append(segment)
        positions.append(np.arange(position, position + len(segment), dtype="int32"))
        length = end
        joins = above and above[-1]["end"] == start
        below = [*above[:-1], {"start": above[-1]["start"], "end": end}] if joins else [*above, {"start": start, "end": end}]
        stack += [(n, place[node], position + len(segment), below) for _, n in sorted(children[node].items(), reverse=True)]
    whole = lambda parts: np.concatenate([np.empty(0, "int32"), *parts])
    return pd.DataFrame([{"pack": int(pdf["pack"].iloc[0]), "tokens": whole(tokens), "positions": whole(positions), "segments": segments, "leaves": [{"path": p, "segment": place[n]} for p, n in leaves if n >= 0]}])


_PACK = "pack long, tokens array<int>, positions array<int>, segments array<struct<parent: int, start: long, end: long, loss_start: long, loss_end: long, ancestors: array<struct<start: long, end: long>>>>, leaves array<struct<path: string, segment: int>>"


def pack(conversations: DataFrame, vocabulary: str, per_pack=PER_PACK) -> DataFrame:
    """conversations(path, turns), as paths() gives them -> packs; vocabulary is the path of a byte-level BPE file."""
    last = lambda a: F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0).cast("long"))
    begins = F.aggregate("turns", F.array().cast("array<long>"), lambda a, t: F.concat(a, F.array(F.xxhash64(last(a), t["role"], t["text"]))))
    distinct = conversations.groupBy("path").agg(F.first("turns").alias("turns")).withColumn("begins", begins)
    distinct = cut(distinct, "paths")
    shared = distinct.select("path", F.posexplode("begins").alias("depth", "begin"))
    small = shared.groupBy("begin").agg(F.count("*").alias("n")).filter(F.col("n") <= per_pack).select("begin")
    own = shared.join(small, "begin").groupBy("path").agg(F.min_by("begin", "depth").alias("begin"))
    n_packs = max(1, -(-distinct.count() // per_pack))
    dealt = distinct.select("path", "turns").join(own, "path", "left").select("path", "turns", F.pmod(F.xxhash64(F.coalesce("begin", F.xxhash64("path"))), F.lit(n_packs)).alias("pack"))
    return dealt.groupBy("pack").applyInPandas(lambda pdf: _tree(pdf, vocabulary), _PACK)


def _read(pdfs, vocabulary: str):
    lib = library(vocabulary)
    text_of = lambda tokens: lib.decode(tokens.tolist(), skip_special_tokens=False)
    for pdf in pdfs:
        rows = []
        for tokens, segments, leaves in zip(pdf["tokens"], pdf["segments"], pdf["leaves"], strict=True):
            said = [text_of(tokens[s["start"] : s["end"]]) for s in segments]
            learnt = [unescape(text_of(tokens[s["loss_start"] : s["loss_end"]])) for s in segments]
            # each path: its last segment, after those that its parents lead to
            for leaf in leaves:
                own, at = [], leaf["segment"]
                while at >= 0:
                    own.append(at)
                    at = segments[at]["parent"]
                own.reverse()
                text = "".join(said[i] for i in own)
                turns = [(unescape(r), unescape(t)) for r, t in _SEGMENT.findall(text)]
                loss = "".join(learnt[i] for i in own)
                told = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((leaf["path"], len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text), sum(int(segments[i]["end"] - segments[i]["start"]) for i in own)))
        yield pd.DataFrame(rows, columns=["path", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"])


def read_back(packs: DataFrame, vocabulary: str) -> DataFrame:
    """Digests of each path, read from the packs' tokens alone."""
    return packs.mapInPandas(lambda pdfs: _read(pdfs, vocabulary), "path string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long")


def formatted_digests(turns: DataFrame, vocabulary: str, per_pack=PER_PACK) -> DataFrame:
    convs = cut(paths(turns), "conversations")
    seen = read_back(pack(convs.select("path", "turns"), vocabulary, per_pack), vocabulary)
    return convs.select("conv_id", "path").join(seen, "path").drop("path")
