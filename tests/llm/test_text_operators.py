"""Each operator against a plain version on small tables, with nulls, empty and long texts, repeats and clashing names."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from basewatch.llm import bpe, chat, exact_dedup, html_text, langid, mixing, near_dedup, pii, quality, token_counts
from basewatch.llm.common import table
from basewatch.llm.queries import oracle_sql, queries, vocabulary

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 900}" for i in range(20_000))
ODD = [(1, None, "en", "a"), (2, "", None, None), (3, "one two three", "en", "a"), (4, LONG, "en", "b"), (5, "one two three", "en", "a"), (5, "one two three", "en", "a"), (None, "x y z", "fr", "a"), (7, " \n\t ", "fr", "b"), (8, "ONE  two\tthree", "en", "a"), (9, "a</w>\x00b <|endoftext|> é́ " + "q" * 3000, "de", None)]


@pytest.fixture(scope="module")
def odd(spark):
    """The odd rows, with columns named like the operators' own."""
    clash = ["size", "kept", "label", "_key", "c", "group", "node", "locator", "target", "rate", "digest", "d2"]
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string").withColumns({c: F.lit("mine") for c in clash}).cache()


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "conversations", "pages", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, sql = queries()[name](spark, SF), c.sql(oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(sql.columns)
    at = [sql.columns.index(x) for x in cols]
    assert sorted(str([r[x] for x in cols]) for r in df.collect()) == sorted(str([r[i] for i in at]) for r in sql.fetchall())


def plain_counts(text):
    words = (text or "").encode().split()
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(words), sum(len(w.decode()) for w in words), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, docs, odd):
    for d in (docs, odd):
        texts = collections.defaultdict(list)
        for r in d.collect():
            texts[r.doc_id].append(r.text)
        for r in quality.quality(d).collect():
            c = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
            assert c in map(plain_counts, texts[r.doc_id])
            assert r.base_failed == (c[0] < 50 or 100 * c[4] > 50 * c[0]) and not (r.base_failed and r.kept)
    good = docs.join(table(spark, SF, "labels"), "doc_id").join(quality.quality(docs), "doc_id").filter("NOT base_failed")
    assert good.filter("quality = 1 AND NOT kept").count() <= 2 and good.filter("quality = 0 AND kept").count() <= 2
    assert quality.quality(docs.limit(0)).count() == 0 and quality.passed(odd).columns == odd.columns


def plain_components(rows):
    sets, parent = {}, {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {b" ".join(w)} if 0 < len(w) < 5 else {b" ".join(w[k : k + 5]) for k in range(len(w) - 4)}
        parent[i] = i

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both) and root(a) != root(b):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_near_dedup(docs, odd):
    want = plain_components([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs).collect()} == want
    got = [(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(odd).collect()]
    assert sorted(x for x in got if x[0] in (1, 2, 3, 5, 7, 8)) == [(1, 1, True), (2, 2, True), (3, 3, True), (5, 3, False), (5, 3, False), (7, 7, True), (8, 3, False)] and (None, None, True) in got
    assert near_dedup.near_duplicates(odd.limit(0)).count() == 0 and near_dedup.deduplicated(odd).columns == odd.columns


def test_near_dedup_finds_chains_and_spares_shared_passages(spark):
    rng = np.random.default_rng(5)
    word = lambda: "w%d" % rng.integers(10**6)
    passage = [word() for _ in range(120)]
    rows = [passage + [word() for _ in range(30 + i % 50)] for i in range(120)]
    chain = [word() for _ in range(200)]
    for _ in range(12):
        chain = [*chain[6:], *[word() for _ in range(6)]]
        rows.append(chain)
    data = [(i, " ".join(r)) for i, r in enumerate(rows)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == plain_components(data)


def test_token_counts(docs, odd):
    c = token_counts.Counter(vocabulary("piece_bpe_32k.model"))
    for d in (docs.limit(60), odd):
        texts = collections.defaultdict(list)
        for r in d.collect():
            texts[r.doc_id].append(r.text or "")
        for r in token_counts.token_counts(d, vocabulary("piece_bpe_32k.model")).collect():
            assert (r.n_pretokens, r.n_tokens) in [(len(t.encode().split()), sum(c.path("▁" + w.decode()) for w in t.encode().split())) for t in texts[r.doc_id]]


def test_mixing(docs, odd):
    plan = mixing.mix_plan(docs)
    assert plan.filter("taken > 2 * size OR target > 2 * source_size").count() == 0
    total, share = plan.agg(F.sum("size"), F.sum("taken")).first()
    assert abs(share / total - 1.5) < 0.1
    assert sorted(map(str, plan.collect())) == sorted(map(str, mixing.mix_plan(docs).collect()))
    assert mixing.mix_plan(odd.limit(0)).count() == 0 and mixing.mixed(odd).columns == odd.columns
    n = {r.doc_id: r.n_copies for r in plan.collect()}
    assert {r.doc_id: r["count"] for r in mixing.mixed(docs).groupBy("doc_id").count().collect()} == {k: v for k, v in n.items() if v}


def test_exact_dedup_survives_digest_collisions_and_batches(spark, odd, tmp_path):
    rows = [(i, f"t{i % 7}  x") for i in range(40)] + [(None, "t0 x"), (3, "t3 x")]
    path = f"file://{tmp_path}/t"
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
    for digest in (exact_dedup.sha256, lambda t: F.substring(F.md5(t), 1, 1)):
        got = exact_dedup.groups(spark, path, digest=digest, files_per_batch=1).collect()
        assert len(got) == 42 and sum(r.kept for r in got) == 7
        assert all(r.keep_id == r.doc_id % 7 for r in got if r.doc_id is not None)
        assert {r.group_size for r in got if r.keep_id == 0} == {7} and {r.group_size for r in got if r.keep_id == 3} == {7}
    assert exact_dedup._pattern("/a/b*/c[1]") == "/a/b\\*/c\\[1\\]" and exact_dedup._pattern("file:/a/t.parquet/") == "file:/a/t.parque[t]"
    assert exact_dedup.deduplicated(odd).columns == odd.columns
    assert exact_dedup.deduplicated(odd).count() == 7
    assert exact_dedup.deduplicated(odd.limit(0)).count() == 0


def test_exact_dedup_meets_the_state_of_earlier_runs(spark, tmp_path):
    state, schema = f"file://{tmp_path}/state", "doc_id long, text string"
    first = spark.createDataFrame([(5, "a  b"), (6, "c"), (7, "c")], schema)
    second = spark.createDataFrame([(1, "a b"), (8, "d"), (9, "d\t"), (10, "d ")], schema)
    assert sorted(r.doc_id for r in exact_dedup.deduplicated(first, state=state).collect()) == [5, 6]
    # a new stream over the old folder: 1 and 9 are copies of what came before or comes now
    assert sorted(r.doc_id for r in exact_dedup.deduplicated(second, state=state).collect()) == [8, 9]
    assert [r.doc_id for r in exact_dedup.deduplicated(second.limit(1), state=state).collect()] == []
    path = f"file://{tmp_path}/t"
    for i, rows in enumerate(([(3, "x")], [(2, "x"), (4, "y")])):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(path)
        got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.groups(spark, path, state=f"file://{tmp_path}/s2").collect()}
    assert got == {2: (2, 2), 3: (2, 2), 4: (4, 1)}


def test_exact_dedup_picks_rows_by_bitmaps(spark, tmp_path, monkeypatch):
    n, path = exact_dedup.STRETCH, f"file://{tmp_path}/p#1 %"
    spark.range(2 * n + 50).withColumn("text", F.col("id").cast("string")).coalesce(1).write.parquet(path)
    rows = spark.read.parquet(path)
    placed = rows.select("id", *[c.alias(k) for k, c in exact_dedup._place().items()])
    wanted = {0, 7, 8, n - 1, n, 2 * n - 1, 2 * n, 2 * n + 49}
    locators = rows.filter(F.col("id").isin(*wanted)).select(exact_dedup._locator().alias("locator"))
    for most in (exact_dedup.BROADCAST, 0):
        monkeypatch.setattr(exact_dedup, "BROADCAST", most)
        assert sorted(r.id for r in exact_dedup.picked(placed, locators, "some").collect()) == sorted(wanted)
    assert exact_dedup.picked(placed, locators.limit(0), "none").count() == 0


def test_exact_dedup_shuffles_shared_texts_only(spark, tmp_path):
    # without broadcasts of Spark's own choice, the rows that stay come straight from their files
    docs = spark.createDataFrame([(i, f"text {i % 90}") for i in range(100)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = exact_dedup.deduplicated(docs)
        assert sorted(r.doc_id for r in kept.collect()) == list(range(90))
        assert "Exchange hash" not in kept._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_main_text():
    page = "<html><body><header>Site</header><nav><a href=x>Home</a></nav><div class='ad'>Buy</div><article><h1>Title &amp; more</h1><p><b>One  two<br><p>three&eacute; <a href=y>four</a></article><div id='comments'><p>me too</p></div><footer>c</footer></body></html>"
    assert html_text.main_text(page) == "Title & more\nOne two\nthreeé four"
    loose = "<body><div class=top-menu><a href=1>a</a></div><div><div><p>" + "long text here. " * 9 + "</p><p>" + "more text now. " * 9 + "</p></div></div></body>"
    assert html_text.main_text(loose) == ("long text here. " * 9).strip() + "\n" + ("more text now. " * 9).strip()
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<script>x</script>") == ""


def test_main_text_keeps_articles_by_any_class():
    p = "<p>" + "long text here. " * 9 + "</p>"
    want = "Title\n" + ("long text here. " * 9).strip()
    for c in ("post-12 post type-post category-world tag-economy hentry", "story related-topics", "tags", "widget sidebar"):
        assert html_text.main_text(f"<body><nav>x</nav><article class='{c}'><h1>Title</h1>{p}</article></body>") == want
    for c in ("content has-sidebar", "sidebar", "page with-comments", "widget"):
        assert html_text.main_text(f"<body><div class='{c}'><div><h1>Title</h1>{p}{p}</div></div></body>") == want + "\n" + ("long text here. " * 9).strip()
    for c in ("entry-header", "article-header", "header"):
        assert html_text.main_text(f"<body><article><div class='{c}'><h1>Title</h1></div>{p}</article></body>") == want
    off = "".join(f"<div class='{c}'>Buy now, all of this</div>" for c in ("ad", "cookie-banner", "box related_posts", "newsletter-signup", "comment-list"))
    assert html_text.main_text(f"<body><form><article><h1>Title</h1>{off}{p}</article></form></body>") == want
    remarks = "<div id='comments'>" + "<p>me too, and much more than that.</p>" * 40 + "</div>"
    assert html_text.main_text(f"<body><article><h1>Title</h1>{p}</article>{remarks}</body>") == want


def test_main_text_keeps_bare_text_beside_the_heart():
    lead, p, last = "A bare <b>lead</b> of the story. " + "It goes on. " * 18, "<p>" + "long text here. " * 9 + "</p>", "And its bare end. " * 12
    got = html_text.main_text(f"<body><div><a href=1>a</a></div>{lead}<div>{p}{p}</div>{last}<div><a href=2>b</a></div></body>")
    assert got.split("\n") == [re.sub("</?b>", "", lead).strip(), ("long text here. " * 9).strip(), ("long text here. " * 9).strip(), last.strip()]


def test_bpe_equals_the_library(spark, docs, odd):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    lib, own = Tokenizer.from_file(path), bpe.encoder(path)
    texts = [r.text or "" for r in [*docs.collect(), *odd.collect()]] + ["a\x85b\x1cc　y ΑΣ İ ß 'S don't!!!", "😀👍🏽 𝔘 ก็", "<|startoftext|>x<|EndOfText|>"]
    for t, (ids, n, decoded) in zip(texts, own.encode_batch(texts), strict=True):
        want = lib.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want and n == len(want) and decoded.decode() == lib.decode(want, skip_special_tokens=False) == own.decode(want)
    assert own.merged_words and own.guessed_words > own.merged_words
    assert bpe.encode_digests(odd, path).count() == len(ODD)


def test_chat_round_trip(spark):
    said = [(1, [("user", "a <|end|> b"), ("assistant", "<\\|x \\ [INST]")]), (2, [("user", "a <|end|> b"), ("assistant", "no")]), (3, [("user", "a <|end|> b"), ("assistant", "no")]), (-1, [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]), (4, [("system", ""), (None, None)])]
    rows = [(c, i, r, t) for c, turns in said for i, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    path = vocabulary("byte_bpe_50k.json")
    for per_pack in (1, 256):
        got = {r.conv_id: r for r in chat.formatted_digests(df, path, per_pack).collect()}
        assert len(got) == 5
        for c, turns in said:
            whole = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
            loss = "".join(t or "" for r, t in turns if r == "assistant")
            assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    packs = chat.pack(chat.paths(df).select("path", "turns"), path).collect()
    assert sum(chat.library(path).decode(p.tokens).count("<|turn|>user<|text|>a <\\|end|>") for p in packs) == 1
    assert chat.formatted_digests(df.limit(0), path).count() == 0


def test_language(spark, docs, odd):
    got = {r.doc_id: r for r in langid.identify(docs, vocabulary("piece_bpe_32k.model")).collect()}
    rows = docs.collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert {r.doc_id for r in held} == {i for i, g in got.items() if g.held_out}
    right = [got[r.doc_id].lang_pred == r.lang for r in held if got[r.doc_id].lang_pred != "und"]
    assert sum(right) >= 0.97 * len(right)
    runs = spark.createDataFrame([(i, "\u13a0\u13b1\u1401\u0f40" * 125 if i % 5 == 0 else f"the words of text {i} with it", "en" if i % 2 else "de") for i in range(40)] + [(99, "hello world of the text", None), (100, "\ua000" * 3000, None)], "doc_id long, text string, lang string")
    assert all(0 < r.score <= 1 for r in langid.identify(runs, vocabulary("piece_bpe_32k.model")).collect())
    und = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(odd, vocabulary("piece_bpe_32k.model")).collect()}
    assert und[1] == und[2] == und[7] == ("und", 0.0) and len(und) == 9
    assert langid.identify(odd.limit(0), vocabulary("piece_bpe_32k.model")).count() == 0


def test_forward_sums_all_segmentations():
    path = vocabulary("piece_bpe_32k.model")
    n = len(langid.piece_table(path).pieces)
    probs = np.exp(langid.zipf_log_probs(n))[:, None]
    s, index = langid.Segmenter(path, probs), langid.piece_table(path).index

    def total(w):
        return 1.0 if not w else sum(probs[index[w[:k]], 0] * total(w[k:]) for k in range(1, len(w) + 1) if w[:k] in index)

    words = ["▁there", "▁antion", "▁de"]
    assert np.allclose(np.exp(s.log_probs(words))[:, 0], [total(w) for w in words])

    def plain(w):  # the same sum by a plain loop, in logarithms
        a = [0.0]
        for d in range(1, len(w) + 1):
            terms = [a[d - k] + np.log(probs[index[w[d - k : d]], 0]) for k in range(1, min(d, 32) + 1) if w[d - k : d] in index]
            terms += [] if w[d - 1] in index else [a[d - 1] + np.log(s.unknown)]
            a.append(np.logaddexp.reduce(terms))
        return a[-1]

    words += ["▁" + "ᎠᏱᐁཀ" * 125, "▁" + "donaudampfschifffahrtsgesellschaft" * 3, "▁" + "ᎠᏱ" * 15, "▁x"]
    assert np.allclose(s.log_probs(words)[:, 0], [plain(w) for w in words])
    counts = np.arange(1.0, len(words) + 1)[:, None]
    uses = s.expected(words, counts)
    assert np.isfinite(uses).all() and uses[index["▁x"], 0] > 0
    # expected uses, weighted by piece length, make up all characters that pieces cover
    covered = sum(counts[i, 0] * sum(c in index for c in w) for i, w in enumerate(words))
    assert np.isclose(sum(uses[i, 0] * len(p) for p, i in index.items()), covered)


def plain_spans(t):
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m)
    tests = {"email": lambda m: True, "ip": lambda m: all(int(x) <= 255 for x in m.split(".")), "card": lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m)), "phone": lambda m: 9 <= len(digits(m)) <= 15}
    base = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    return [f"{k}:{m.start()}:{m.end()}" for k, p in base.items() for m in re.finditer(p, t) if tests[k](m.group())]


def test_personal_data(spark, docs):
    extra = ["a@b.c_d@e.f x@@y.z 1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.004", "😀 +1 (605) 555-9305 4111111111111111 4111-1111 1111 1111", "9" * 5000 + " " + "1 2 3 4 " * 3000, "+1+1 234 567 8901+", None, ""]
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    texts = {r.doc_id: r.text or "" for r in d.collect()}
    for r in pii.digests(pii.find(d)).collect():
        base = plain_spans(texts[r.doc_id])
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r.base_sha256, texts[r.doc_id][:200]
        assert set(base) <= set(r.spans.split(",")) | {""}
    assert pii.digests(pii.find(d.limit(0))).count() == 0


def test_addresses_with_zero_parts(spark):
    texts = ["10.0.0.1, 127.0.0.1", "0.0.0.0 00.1.2.000", "at 192.168.0.1.", "0.0.0.256 0.0.0.0256", "0" * 4000 + ".0.0.0" + " 000.000.000.000"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.digests(pii.find(rows)).collect()}
    assert [got[i].n_ip for i in range(5)] == [2, 2, 1, 0, 2]
    for i, t in enumerate(texts):
        assert hashlib.sha256(",".join(plain_spans(t)).encode()).hexdigest() == got[i].base_sha256


def test_personal_data_without_base_form_is_added_and_look_alikes_stay(spark):
    n = lambda i, k: f"{(i * 7919 + 13 * k) % 10 ** k:0{k}d}"
    learnt = [f"some words, +1 ({n(i, 3)}) 555-{n(i, 4)} and then name{i}.x@mail{i % 9}.example.com so 10.{i % 200}.7.{i % 90 + 1} it goes" for i in range(300)]
    planted = {"my phone: (605) 555-9305 now": "phone", "Tel. 605-555-9306, thanks": "phone", "call 1 605 555 9307": "phone", "write to jo.doe [at] mail [dot] example [dot] org soon": "email", "or jo(at)example.org then": "email", "seen from 203[.]0[.]113[.]9 today": "ip"}
    alike = ["order (605) 555-9305 now", "the hotel 605-555-9306, thanks", "it is 1 605 555 9307", "meet me [at] noon then", "seen from 303[.]0[.]113[.]9 today"]
    texts = [*planted, *alike, *learnt]
    found = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    added = {r.doc_id: [(s.kind, texts[r.doc_id][s.start : s.end]) for s in r.added] for r in found}
    assert [[k for k, _ in added[i]] for i in range(len(planted))] == [[k] for k in planted.values()], added
    assert added[0] == [("phone", "(605) 555-9305")] and added[3] == [("email", "jo.doe [at] mail [dot] example [dot] org")] and added[5] == [("ip", "203[.]0[.]113[.]9")]
    assert not any(added[i] for i in range(len(planted), len(texts))), added


def plain_mix(rows):
    """rows (doc_id, source, size) -> copies, by a loop of dealing, capping and resharing, and trying every turn."""
    names = sorted({s for _, s, _ in rows if s is not None}) + ([None] if any(s is None for _, s, _ in rows) else [])
    size = {n: sum(z for _, s, z in rows if s == n) for n in names}
    weight = {n: (3.0, 1.0, 2.0)[i % 3] for i, n in enumerate(names)}
    target, left, free = {}, 1.5 * sum(size.values()), set(names)
    while free:
        share = {n: left * weight[n] / sum(weight[m] for m in free) for n in free}
        over = {n for n in free if share[n] > 2 * size[n]}
        if not over:
            target.update(share)
            break
        target.update({n: 2.0 * size[n] for n in over})
        left -= sum(target[n] for n in over)
        free -= over
    out = {}
    for n in names:
        rate = target[n] / size[n] if size[n] else 0.0
        own = [(d, z, int(hashlib.md5(f"mix-1:{d}".encode()).hexdigest()[:13], 16) / 16**13) for d, s, z in rows if s == n]
        turns = [{d: int(rate) + ((u + k / 32) % 1 < rate - int(rate)) for d, _, u in own} for k in range(32)]
        out.update(min(turns, key=lambda c: abs(sum(z * c[d] for d, z, _ in own) - target[n])))
    return out


def test_mixing_equals_a_plain_loop(docs):
    rows = [(r.doc_id, r.source, len((r.text or "").encode().split())) for r in docs.collect()]
    assert {r.doc_id: r.n_copies for r in mixing.mix_plan(docs).collect()} == plain_mix(rows)


def test_pipeline_equals_a_plain_version(spark):
    from tokenizers import Tokenizer

    import corpus_pipeline as p

    docs = table(spark, SF, "documents")
    for name, stage in p.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
    good = {r.doc_id for r in quality.quality(docs).filter("kept").collect()}
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    kept, seen = {}, set()
    for r in docs.orderBy("doc_id").collect():
        if r.doc_id in good and norm(r.text) not in seen:
            seen.add(norm(r.text))
            kept[r.doc_id] = r
    roots = sorted({c for _, c in plain_components([(i, r.text) for i, r in kept.items()]).values()})
    copies = plain_mix([(i, kept[i].source, len((kept[i].text or "").encode().split())) for i in roots])
    lib, want = Tokenizer.from_file(vocabulary("word_bpe_49k.json")), collections.Counter()
    for i in roots:
        ids = lib.encode(kept[i].text or "", add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] = copies[i]
    got = collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in p.run(spark, SF).collect())
    assert got == +want


def test_html_table(spark):
    p, long = "<p>" + "long text here. " * 9 + "</p>", ("long text here. " * 9).strip()
    rows = [(1, "u", None), (2, None, ""), (3, "u", f"<article><h1>T</h1>{p}</article>"), (3, "u", f"<article><h1>T</h1>{p}</article>"), (None, "v", "<body>" + "<div>" * 2000 + p + "</div>" * 2000), (5, "w", f"<div>{p}{p}</div><div>{p}{p}</div>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("mine"), "n_chars": F.lit(1)})
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in html_text.extract(pages).collect()), key=str)
    assert all(n == len(t) for _, _, t, n in got) and html_text.extract(pages.limit(0)).count() == 0
    texts = {(i, u): t for i, u, t, _ in got}
    assert len(got) == 6 and texts[1, "u"] == texts[2, None] == "" and texts[3, "u"] == f"T\n{long}" and texts[None, "v"] == long and texts[5, "w"].startswith(long)


def test_density_decides_inside_articles():
    p = "<p>" + "long text here. " * 9 + "</p>"
    links = "<div>" + "".join(f"<a href={i}>Read this other story too</a> " for i in range(12)) + "</div>"
    got = html_text.main_text(f"<body><article><h1>Title</h1><p>Short.</p><div>{p}{p}{p}</div>{links}</article></body>")
    assert got.startswith("Title\nShort.\nlong text") and "other story" not in got
    for part in ("<p class='side note'>An aside in a paragraph</p>", "<section class='related-work'><p>An aside in a section</p></section>"):
        assert "An aside" in html_text.main_text(f"<body><article><h1>Title</h1>{p}{part}{p}</article></body>")


def test_near_dedup_of_rows_that_share_an_id(spark):
    rng = np.random.default_rng(3)
    a, b = (" ".join(f"w{rng.integers(10**6)}" for _ in range(60)) for _ in range(2))
    rows = [(5, a), (5, b), (4, a + " more"), (3, b + " more"), (9, "alone in the world here today")]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(3, 57, 3), (4, 57, 4), (5, 56, 3), (5, 56, 4), (9, 2, 9)]
