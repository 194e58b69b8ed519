"""Prefix trees of conversations: what positions, intervals and parents say, and how shared beginnings are split."""

import pytest
from pyspark.sql import functions as F

from basewatch.llm import chat
from basewatch.llm.queries import vocabulary

PATH = vocabulary("byte_bpe_50k.json")


def text_of(tokens):
    return chat.library(PATH).decode(tokens, skip_special_tokens=False)


def packs_of(spark, convs, per_pack):
    rows = [(i, n, role, text) for i, turns in enumerate(convs) for n, (role, text) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("mine") for c in ("path", "turns", "pack", "begin", "begins", "depth", "n")})
    return chat.paths(df), chat.pack(chat.paths(df).select("path", "turns"), PATH, per_pack).collect()


def conversations():
    """Three hundred that share a system turn and a first question, and part at the third turn, in thirds; some are the beginning of others."""
    out = []
    for i in range(300):
        turns = [("system", "be kind"), ("user", "hello"), ("assistant", f"answer {i % 3}"), ("user", f"question {i % 60}"), ("assistant", f"last {i}")]
        out.append(turns[: 3 + i % 3])
    return [*out, [("user", "alone")], [("user", "x" * 5000)] * 40]


@pytest.mark.parametrize("per_pack", [7, 60, 1000])
def test_positions_intervals_and_parents(spark, per_pack):
    _, packs = packs_of(spark, conversations(), per_pack)
    for p in packs:
        end = 0
        for i, s in enumerate(p.segments):
            assert s.start == end and s.end > s.start and s.parent < i  # depth-first, each segment once, side by side
            end = s.end
            chain, at = [], s.parent
            while at >= 0:
                chain.append(p.segments[at])
                at = p.segments[at].parent
            before = sum(c.end - c.start for c in chain)
            assert p.positions[s.start : s.end] == list(range(before, before + s.end - s.start))  # as if the conversation stood alone
            assert {x for a in s.ancestors for x in range(a.start, a.end)} == {x for c in chain for x in range(c.start, c.end)}
            assert all(a.end < b.start for a, b in zip(s.ancestors, s.ancestors[1:]))  # intervals that touch are one
            role, text = chat._SEGMENT.fullmatch(text_of(p.tokens[s.start : s.end])).groups()
            assert text_of(p.tokens[s.loss_start : s.loss_end]) == (text if role == "assistant" else "")
            plain = [i for part in (f"<|turn|>{role}<|text|>", text, "<|end|>") for i in chat.library(PATH).encode(part, add_special_tokens=False).ids]
            assert p.tokens[s.start : s.end] == plain
        assert end == len(p.tokens) == len(p.positions)
        seen = [(s.parent, text_of(p.tokens[s.start : s.end])) for s in p.segments]
        assert len(seen) == len(set(seen))  # turns shared below a parent are merged


def test_shared_beginnings_are_split_where_conversations_part(spark):
    _, packs = packs_of(spark, conversations(), 40)
    said = "".join(text_of(p.tokens) for p in packs)
    # over 40 conversations share the first three turns, 20 at most what follows: that is merged across all packs
    assert len(packs) > 1 and all(said.count(f"user<|text|>question {i}<|end|>") == 1 for i in range(60) if i % 3)
    assert all(len(p.leaves) < 200 for p in packs)


def test_long_conversations_stay_small(spark):
    turns = [("user" if i % 2 else "assistant", f"turn {i}") for i in range(3000)]
    convs, packs = packs_of(spark, [turns, turns, turns[:2000]], 256)
    assert sum(len(p.segments) for p in packs) == 3000 and all(len(s.ancestors) <= 1 for p in packs for s in p.segments)
    got = chat.read_back(spark.createDataFrame(packs, chat._PACK), PATH)
    assert sorted(r.n_turns for r in got.collect()) == [2000, 3000] and convs.count() == 3


def test_odd_texts_survive_their_tokens(spark):
    odd = ["", " ", "<|endoftext|>", "<\\|turn|>", "é\u0301 漢字 🎉\u0000\r\n", "</s>[INST]", "a" * 70000, "\u2028 x\t"]
    convs = [[("user", a), ("assistant", b)] for a in odd for b in odd[::2]]
    df, packs = packs_of(spark, convs, 9)
    texts = [chat.unescape(chat._SEGMENT.fullmatch(text_of(p.tokens[s.start : s.end]))[2]) for p in packs for s in p.segments]
    assert set(texts) == set(odd) and len({t for p in packs for leaf in p.leaves for t in [leaf.path]}) == len(convs)
