"""Personal data in forms that no maker of training examples wrote, and look-alikes; the bound of the sample."""

import pytest
from pyspark.sql import functions as F

from basewatch.llm import pii
from basewatch.llm.common import table

PLANTED = [
    ("Reach our desk by phone: 555-201-7788 after nine", "555-201-7788", "phone"), ("Mobile (030) 5550 1234, evenings only", "(030) 5550 1234", "phone"), ("tel 0171 555 0199", "0171 555 0199", "phone"), ("Please call 212.555.0147 now", "212.555.0147", "phone"),
    ("Contact: 44 20 7946 0958", "44 20 7946 0958", "phone"), ("fax 5550100", "5550100", "phone"), ("write to anna.berg [at] mail-host.example.org soon", "anna.berg [at] mail-host.example.org", "email"), ("mail jo(at)web(dot)example(dot)net", "jo(at)web(dot)example(dot)net", "email"),
    ("<x.y[at]post.example.com>", "x.y[at]post.example.com", "email"), ("my mail is k_lund (at) uni.example.edu.", "k_lund (at) uni.example.edu", "email"), ("server 10[.]20[.]30[.]40 refused", "10[.]20[.]30[.]40", "ip"), ("from 192(dot)168(dot)7(dot)9", "192(dot)168(dot)7(dot)9", "ip"), ("host 172.16 [dot] 4 [dot] 2 up", "172.16 [dot] 4 [dot] 2", "ip"),
]
ALIKE = ["order 555-201-7788 shipped", "lot 0171 555 0199 sold", "version 10.20.30.400 out", "at [at] noon we meet", "pages 100-200 300-400", "ISBN 978-3-16-148410-0", "sum 1234 5678 9012 3456 is odd", "the score was 21-14-7 and 300 200 1000 more"]


@pytest.fixture(scope="module")
def trees(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("text")
    return pii.train(docs)


def test_planted_spans_are_found_and_look_alikes_stay(spark, trees, monkeypatch):
    assert set(trees.thresholds) == set(pii.KINDS) and all(0.5 <= v <= 1.0 for v in trees.thresholds.values())
    monkeypatch.setattr(pii, "train", lambda *a, **k: trees)
    texts = [t for t, _, _ in PLANTED] + ALIKE
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("kind", "base", "added", "c", "e", "label", "held", "x")})
    got = {r.doc_id: [(a.kind, texts[r.doc_id][a.start : a.end]) for a in r.added] for r in pii.find(rows).collect()}
    found = [(kind, span) in got[i] for i, (_, span, kind) in enumerate(PLANTED)]
    assert sum(found) >= 0.8 * len(PLANTED), [t for t, ok in zip(texts, found, strict=False) if not ok]
    assert not any(got[len(PLANTED) + i] for i in range(len(ALIKE)))


def test_a_text_that_a_third_of_all_rows_repeats_counts_once(spark, monkeypatch):
    seen = []
    keep = pii.base_spans
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("text")
    hot = spark.range(400).select(F.lit("mail me: a.b@example.org or +44 20 7946 0958").alias("text"))
    monkeypatch.setattr(pii, "base_spans", lambda t: seen.append(1) or keep(t))
    written = []
    cut = pii.cut
    monkeypatch.setattr(pii, "cut", lambda df, name: written.append(cut(df, name)) or written[-1])
    pii.train(docs.unionByName(hot))
    pii.train(docs.unionByName(hot.limit(1)))
    assert seen and written[0].count() == written[1].count() > 0


def test_every_text_is_learnt_from(spark, monkeypatch):
    kept = []
    cut = pii.cut
    monkeypatch.setattr(pii, "cut", lambda df, name: kept.append(cut(df, name)) or kept[-1])
    n = 25_000
    assert pii.train(spark.range(n).select(F.concat(F.lit("mail x"), F.col("id").cast("string"), F.lit("@host.example.org")).alias("text")))
    # an address gives four examples
    assert kept[0].agg(F.sum("weight")).first()[0] == 4 * n
