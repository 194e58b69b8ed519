"""Personal data: candidate spans, boosted trees, calibrated thresholds.

Base spans - emails, IPv4 addresses, card numbers, phone numbers - come from patterns and checks
and always stay. Generators of high recall propose further spans, which may overlap base matches
that failed and each other: card-like digit runs and groups, phone-like numbers with or without a
plus, email and IPv4 addresses plain, bracketed or spelled out. Boosted trees score a candidate
from its format (digits, groups, separators, a plus, the Luhn sum, whether it reads as an address)
and its context (words before it that announce such data, what stands at its edges). They learn
from the corpus itself: a candidate that is a base span is positive; its twin, damaged so that it
is none in any context, is negative. Further examples have lost their base form: addresses spelled
out are positive, and negative when damaged as well; phone numbers without plus or country code
are positive after a word that announces one and negative elsewhere. Found candidates that are
neither are what is to be decided, and aren't learnt from. The
training set is every different text of the corpus: a text that many rows repeat counts once.
Examples alike in all features are one row with a weight, so that the trees' input stays small, and all
of them, not a sample, give the thresholds that the trees try. Each kind has a threshold of its own, calibrated on a part held out
from training: the smallest score from which on its examples keep `precision`. A kind with fewer than
five held-out examples of either label takes the threshold of all kinds together; with fewer than five
in all there is nothing to learn from.

The trees become one SQL expression, so that proposing, scoring and selecting is a single pass
over the rows, with functions of the row alone: nothing is shuffled, no text leaves its row.

Positions are code points, end exclusive. Defined cases: null text counts as empty and has no
spans; with no base span to learn from nothing is added; repeated rows
each come out; very long texts need time in proportion to their length and their valid spans.
"""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basewatch.llm.common import cut, let

KINDS = ("email", "ip", "card", "phone")
#: Base patterns, with possessive quantifiers and a look behind so that a long run is read once:
#: a match begins at the start of a run or where the last match ended, which changes no match.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_AT, _DOT = r"\x20?[(\[](?i:at)[)\]]\x20?", r"\x20?[(\[](?i:dot|\.)[)\]]\x20?"
#: Generators: name -> kind, pattern, a cheap pattern that any match has.
GENERATORS = {
    "card_run": ("card", r"(?<![0-9])[0-9]{13,19}+(?![0-9])", "[0-9]{13}"),
    "card_groups": ("card", r"(?<![0-9])[0-9]{4}(?:[\x20-][0-9]{4}){2}[\x20-][0-9]{1,7}+(?![0-9])", r"[0-9]{4}[\x20-][0-9]{4}[\x20-]"),
    "phone": ("phone", r"(?<![0-9])(?:\+?[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])", r"[0-9]{3,4}[\x20.-]?[0-9]{3,4}"),
    "address": ("email", rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+(?:@|{_AT})[A-Za-z0-9-]{{1,63}}+(?:(?:\.|{_DOT})[A-Za-z0-9-]{{1,63}}+)*+", r"@|[(\[](?i:at)[)\]]"),
    "dotted": ("ip", rf"(?<![0-9])[0-9]{{1,3}}+(?:(?:\.|{_DOT})[0-9]{{1,3}}+){{3}}(?![0-9])", r"[0-9](?:\.|\x20?[(\[])"),
}
_HINTS = r"(?i)(?:phone|tel|call|mobile|fax|card|visa|account|iban|ssn|e-?mail|mail|contact|ip)[^A-Za-z0-9]{0,6}$"
#: Whole words that announce a phone number, and what training examples are announced by, or by none of them.
_PHONE = r"(?i)(?<![A-Za-z])(?:(?:tele)?phones?|tel|call|dial|mobile|cell|fax|contact)(?:\x20(?:me|us|at|on|is|no|number)){0,2}[^A-Za-z0-9]{0,6}$"
_ANNOUNCED, _UNANNOUNCED = ("phone: ", "tel. ", "call ", "mobile ", "fax: ", "contact: ", "Phone number "), ("order ", "account no. ", "item: ", "hotel ", "ref. ", "card ", "and ")
PRECISION, TREES, DEPTH, SEED = 0.98, 12, 3, 7
#: Values of a feature that the trees tell apart at least, and how many rows Spark reads whole for that number of them.
BINS, WHOLE = 32, 10_000
FEATURES = ("digits", "groups", "longest_group", "plus", "brackets", "dots", "dashes", "spaces", "letters", "at", "dot_after_at", "length", "hint", "edge_left", "edge_right", "first_digit", "luhn", "announced", "whole_address", "octets")


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        digits = F.regexp_replace(m, r"[\x20-]", "")
        return F.when(F.length(digits).between(13, 19), F.call_function("luhn_check", digits)).otherwise(False)
    if kind == "phone":
        return F.length(F.regexp_replace(m, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


_SPANS = "array<struct<start:int,end:int,text:string>>"
_ADDED = "array<struct<kind:string,start:int,end:int>>"


def spans(text: Column, pattern: str, needs: str, valid) -> Column:
    """Leftmost non-overlapping matches that are valid, with their positions; needs: a cheap pattern that any match has."""

    def found(matches: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
        steps = F.zip_with(gaps, matches, lambda g, m: F.struct(g.alias("g"), m.alias("m")))

        def step(a: Column, x: Column) -> Column:
            start = a["at"] + x["g"]
            end = start + F.coalesce(F.length(x["m"]), F.lit(0))
            one = F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("text")))
            keep = F.coalesce(x["m"].isNotNull() & valid(x["m"]), F.lit(False))
            return F.struct(end.alias("at"), F.when(keep, F.concat(a["out"], one)).otherwise(a["out"]).cast(_SPANS).alias("out"))

        return F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out")), step, lambda a: a["out"])

    return F.when(text.rlike(needs), let(F.regexp_extract_all(text, F.lit(pattern), 0), found)).otherwise(F.array().cast(_SPANS))


_NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}


def base_spans(text: Column) -> Column:
    """Struct of the four kinds' spans."""
    return F.struct(*[spans(text, PATTERNS[k], _NEEDS[k], partial(_valid, k)).alias(k) for k in KINDS])


def candidates(text: Column) -> Column:
    """Spans that the generators propose, each with its kind and the text beside it."""

    def beside(kind: str):
        def of(s: Column) -> Column:
            left = F.substring(text, F.greatest(s["start"] - 23, F.lit(1)), F.least(s["start"], F.lit(24)))
            right = F.substring(text, s["end"] + 1, F.lit(4))
            return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), left.alias("left"), right.alias("right"))

        return of

    return F.concat(*[F.transform(spans(text, pattern, needs, lambda m: F.lit(True)), beside(kind)) for kind, pattern, needs in GENERATORS.values()])


def _with(c: Column, text: Column, left: Column | None = None) -> Column:
    return F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), text.alias("text"), (c["left"] if left is None else left).alias("left"), c["right"].alias("right"))


def twin(c: Column) -> Column:
    """A candidate damaged so that it is none of its kind in any context: a wrong last digit; too short; no domain ending; a part over 255."""
    t = c["text"]
    last = F.pmod(F.instr(F.lit("0123456789"), F.substring(t, -1, 1)), F.lit(10)).cast("string")
    bad = F.when(c["kind"] == "card", F.concat(F.substring(t, F.lit(1), F.length(t) - 1), last)).when(c["kind"] == "phone", F.substring(t, 1, 7)).when(c["kind"] == "ip", F.regexp_replace(t, "[0-9]+$", "999"))
    host = F.substring_index(t, "@", -1)
    # either shorter or as long as a whole one, so that length tells nothing
    host = F.when(F.pmod(F.xxhash64(t), F.lit(2)) == 0, F.substring_index(host, ".", 1)).otherwise(F.replace(host, F.lit("."), F.lit("-")))
    return _with(c, bad.otherwise(F.concat_ws("@", F.substring_index(t, "@", 1), host)))


def lost(c: Column) -> Column:
    """A base span's candidate without its base form: a phone number without plus or country code, an address with @ or dots spelled out."""
    t = c["text"]
    nth = lambda seed, of: F.pmod(F.xxhash64(t, c["start"], F.lit(seed)), F.lit(of))
    phone = F.when(nth(0, 3) == 0, F.regexp_replace(t, r"^\+", "")).otherwise(F.regexp_replace(t, r"^\+[0-9]{1,3}[\x20.-]?", ""))
    dot = F.when(nth(1, 3) == 0, F.lit(" [dot] ")).when(nth(1, 3) == 1, F.lit("(dot)"))
    at = F.when(nth(2, 3) == 0, F.lit(" [at] ")).when(nth(2, 3) == 1, F.lit("(at)")).otherwise(F.lit("[at]"))
    # some with a shorter name or host
    name, host = F.substring_index(t, "@", 1), F.substring_index(t, "@", -1)
    name = F.when(nth(3, 2) == 0, F.substring(name, 1, 3)).otherwise(name)
    host = F.when(nth(4, 2) == 0, F.substring_index(host, ".", -2)).otherwise(host)
    email = F.concat_ws("", name, at, F.replace(host, F.lit("."), dot.otherwise(F.lit("."))))
    return _with(c, F.when(c["kind"] == "phone", phone).when(c["kind"] == "ip", F.replace(t, F.lit("."), dot.otherwise(F.lit("[.]")))).otherwise(email))


def examples(c: Column) -> Column:
    """A base span's candidate as training examples, array of (label, c).

    As it is, and damaged. Further, but for cards, without its base form: of an address, the form
    itself is evidence, so that the damaged one in the same form is its look-alike; of a phone
    number, only words before it are, so that its look-alike is itself without them."""
    pick = lambda of: F.element_at(F.array(*map(F.lit, of)), (F.pmod(F.xxhash64(c["text"], c["end"]), F.lit(len(of))) + 1).cast("int"))
    is_phone, said, l = c["kind"] == "phone", c["left"].rlike(_PHONE), lost(c)
    announced = _with(l, l["text"], F.when(is_phone & ~said, pick(_ANNOUNCED)).otherwise(l["left"]))
    unannounced = _with(l, l["text"], F.when(said | (F.pmod(F.xxhash64(c["left"]), F.lit(2)) == 0), pick(_UNANNOUNCED)).otherwise(l["left"]))
    alike = F.when(is_phone, unannounced).otherwise(lost(twin(c)))
    one = lambda label, x: F.struct(F.lit(label).alias("label"), x.alias("c"))
    own = [one(1.0, c), one(0.0, twin(c))]
    return F.when(c["kind"] == "card", F.array(*own)).otherwise(F.array(*own, one(1.0, announced), one(0.0, alike)))


def features(c: Column) -> list[Column]:
    t = c["text"]
    plain = F.regexp_replace(F.regexp_replace(t, _AT, "@"), _DOT, ".")
    n = lambda pattern: F.regexp_count(t, F.lit(pattern))
    flag = lambda x: x.cast("int")
    out = [
        n("[0-9]"), n("[0-9]+"), F.coalesce(F.array_max(F.transform(F.regexp_extract_all(t, F.lit("[0-9]+"), 0), lambda x: F.length(x))), F.lit(0)),
        flag(t.startswith("+") | c["left"].endswith("+")), n(r"[()\[\]]"), n(r"\."), n("-"), n(r"\x20"), n("[A-Za-z]"), n("@"), flag(t.rlike(r"@[^@]*\.[A-Za-z]{2,}$")), F.length(t),
        flag(c["left"].rlike(_HINTS)), flag(c["left"].rlike(r"[^\s\"'(<:;,|]$")), flag(c["right"].rlike(r"^[^\s\"')>:;,.|]")), F.instr(F.lit("0123456789"), F.regexp_extract(t, "[0-9]", 0)), flag(_valid("card", t)),
        flag(c["left"].rlike(_PHONE)), flag(plain.rlike(r"^[^@]+@[^@]*\.[A-Za-z]{2,}$")), flag(_valid("ip", plain)),
    ]
    return [x.cast("double") for x in out]


def is_base(c: Column, base: Column) -> Column:
    """Whether a candidate is a base span of its kind."""
    same = lambda s: (s["start"] == c["start"]) & (s["end"] == c["end"])
    return F.when(c["kind"] == "card", F.exists(base["card"], same)).when(c["kind"] == "phone", F.exists(base["phone"], same)).when(c["kind"] == "ip", F.exists(base["ip"], same)).otherwise(F.exists(base["email"], same))


def _tree(node, c: list[Column]) -> Column:
    """A fitted tree as nested conditions."""
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(c[split.featureIndex()] <= F.lit(float(split.threshold())), _tree(node.leftChild(), c)).otherwise(_tree(node.rightChild(), c))


class Trees:
    """Boosted trees as an expression, and the threshold of each kind."""

    def __init__(self, model, thresholds: dict[str, float]):
        self.roots = [(float(w), t._call_java("rootNode")) for w, t in zip(model.treeWeights, model.trees, strict=True)]
        self.thresholds = thresholds

    def least(self, kind: Column) -> Column:
        return F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in self.thresholds.items()], F.lit(2.0))

    def score(self, x: list[Column]) -> Column:
        margin = sum((F.lit(w) * _tree(r, x) for w, r in self.roots), F.lit(0.0))
        return 1 / (1 + F.exp(-2 * margin))


def train(rows: DataFrame, precision=PRECISION) -> Trees | None:
    """rows(text) -> trees, or None where there is nothing to learn from. Fitted on the examples of all rows."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    text = F.col("text")
    # candidates only where a base span is; the whole row in one expression, so that no step of it is done twice
    some = lambda b: F.exists(F.array(*[F.size(b[k]) > 0 for k in KINDS]), lambda x: x)
    good = let(base_spans(text), lambda b: F.when(some(b), F.filter(candidates(text), lambda c: is_base(c, b))))
    got = rows.select(F.coalesce("text", F.lit("")).alias("text")).select("text", F.explode(good).alias("c"))
    got = got.select(F.sha2(text.cast("binary"), 256).alias("of"), "c").distinct()
    held = (F.pmod(F.xxhash64("c"), F.lit(4)) == 0).alias("held")
    got = got.select(held, F.explode(examples(F.col("c"))).alias("e")).select("held", "e.label", F.col("e.c.kind").alias("kind"), *[x.alias(n) for n, x in zip(FEATURES, features(F.col("e.c")), strict=True)])
    got = got.groupBy("held", "label", "kind", *FEATURES).agg(F.count("*").cast("double").alias("weight"))
    got = cut(VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(got).select("label", "held", "kind", "weight", "x", *FEATURES), "candidates")
    seen = {(r["label"], r["held"]): r for r in got.groupBy("label", "held").agg(F.sum("weight").alias("n"), F.count("*").alias("rows")).collect()}
    if not all((label, held) in seen and seen[label, held]["n"] >= 5 for label in (0.0, 1.0) for held in (False, True)):
        return None
    # Spark looks for thresholds among max(bins ** 2, WHOLE) rows: as many bins as make that all of them
    n = sum(seen[label, False]["rows"] for label in (0.0, 1.0))
    bins = BINS if n <= WHOLE else math.isqrt(n) + 1
    model = GBTClassifier(featuresCol="x", labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=SEED, maxBins=bins).fit(got.filter("NOT held"))
    trees = Trees(model, {})
    held = got.filter("held").select("kind", "label", "weight", F.round(trees.score([F.col(n) for n in FEATURES]), 2).alias("p"))
    by_score = held.groupBy("kind", "p").agg(F.sum(F.col("label") * F.col("weight")).alias("good"), F.sum("weight").alias("n")).collect()  # at most 101 rows a kind

    def smallest(rows) -> float:
        good = n = 0
        out = 2.0
        for p in sorted({r["p"] for r in rows}, reverse=True):
            good, n = good + sum(r["good"] for r in rows if r["p"] == p), n + sum(r["n"] for r in rows if r["p"] == p)
            if good >= precision * n and p >= 0.5:
                out = p
        return out

    together = smallest(by_score)
    for kind in KINDS:
        own = [r for r in by_score if r["kind"] == kind]
        good, n = sum(r["good"] for r in own), sum(r["n"] for r in own)
        trees.thresholds[kind] = smallest(own) if min(good, n - good) >= 5 else together
    return trees


def find(docs: DataFrame, id_col="doc_id", text_col="text", precision=PRECISION) -> DataFrame:
    """docs -> doc_id, base (struct of arrays of spans), added (array of kind, start, end, score)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    trees = train(rows.select("text"), precision)
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    none = F.array().cast(_ADDED)

    def added(base: Column) -> Column:
        def free(c: Column) -> Column:
            return ~F.exists(F.concat(*[base[k] for k in KINDS]), lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"]))

        fits = lambda c: let(F.array(*features(c)), lambda x: trees.score([x[i] for i in range(len(FEATURES))])) >= trees.least(c["kind"]) - 0.005
        chosen = F.filter(F.filter(candidates(F.col("text")), free), fits)
        spans = F.sort_array(F.transform(chosen, lambda c: F.struct(c["start"].alias("start"), (-c["end"]).alias("back"), c["kind"].alias("kind"))))
        # of overlapping ones the first, and of those the longest
        kept = F.aggregate(spans, none, lambda a, s: F.when(F.coalesce(F.try_element_at(a, F.lit(-1))["end"], F.lit(0)) <= s["start"], F.concat(a, F.array(F.struct(s["kind"].alias("kind"), s["start"].alias("start"), (-s["back"]).alias("end"))))).otherwise(a).cast(_ADDED))
        return kept

    both = let(base_spans(F.col("text")), lambda b: F.struct(b.alias("base"), (added(b) if trees else none).alias("added")))
    return rows.select("doc_id", both.alias("both")).select("doc_id", "both.base", "both.added")


def redacted(text: Column, spans_of: Column) -> Column:
    """text with each span (struct kind, start, end; none overlapping, in order) replaced by its kind in brackets."""
    whole = F.aggregate(
        spans_of,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit("["), s["kind"], F.lit("]")).alias("out")),
    )
    return let(whole, lambda w: F.concat(w["out"], F.substring(text, w["at"] + 1, F.length(text))))


def _listed(kinds: list[tuple[str, Column]]) -> Column:
    """kind:start:end, by kind and start, comma-joined."""

    def named(kind: str):
        return lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"])

    return F.array_join(F.concat(*[F.transform(F.sort_array(a), named(k)) for k, a in kinds]), ",")


def digests(found: DataFrame) -> DataFrame:
    """find()'s rows -> doc_id, n_*, base_sha256, spans."""
    base = _listed([(k, F.col("base")[k]) for k in KINDS])
    pick = lambda k: F.transform(F.filter("added", lambda s: s["kind"] == k), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    slim = lambda k: F.transform(F.col("base")[k], lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    every = _listed([(k, F.concat(slim(k), pick(k))) for k in KINDS])
    return found.select("doc_id", *[F.size(F.col("base")[k]).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(base.cast("binary"), 256).alias("base_sha256"), every.alias("spans"), F.size("added").cast("long").alias("n_added"))
