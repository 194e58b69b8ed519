"""Quality rules with robust multivariate outliers.

Every text gets counts of words, symbols, repeated lines and repeated three-word windows, all by
functions on its own row. Plain rules reject very short and very repetitive texts. The others
become vectors of transformed statistics - those counts, and what varies in any ordinary text: the
mean and the spread of word lengths, the share of distinct words, punctuation - and each language
and source has a centre and a covariance of its own: the minimum covariance determinant estimate,
that of the half of its rows whose covariance has the smallest determinant. A text whose Mahalanobis
distance from its group's centre lies beyond the cutoff is rejected.

The estimate is searched by concentration steps from two starts (median and mean deviation; mean
and covariance), at most `STEPS` of them, until no group's determinant falls any more. A step measures all rows, adds up
each group's moments in bins of distance - one pass with partial sums, so that a group's size
doesn't matter - and takes the bins that hold the nearest half. The covariance is then scaled to
make the median distance that of a normal law. Every group, however small, has its estimate;
centre and covariance are drawn towards those of its language, and these towards those of all
rows, with the weight of `PRIOR` rows.

A row meets its group's estimate by a broadcast while there are at most `BROADCAST` groups, whose
number is counted first; beyond that by a join on group and salt, each estimate copied to each
salt, so that a hot group never is in one task.

Defined cases: null or empty text fails the base rules (no words); null language or source is a
group of its own; a statistic that is the same in all rows has `FLOOR` as its variance; a
repeated row is judged alike each time; a very long text is one row of a task, and time grows with
its length; an empty table gives an empty result; other columns, whatever their names, are carried
or left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from basewatch.llm.common import WORD, cut, let, packed, unpacked
from basewatch.llm.exact_dedup import _locator, _place, picked

MIN_WORDS, STEPS = 50, 6
#: Of the squared distance. A normal law leaves 1e-8 beyond 52; the statistics of texts of fifty words have tails about twice as long.
CUTOFF = 150.0
#: Median of chi-squared with as many degrees of freedom as there are statistics.
MEDIAN_D2 = 6.346
#: Added to each statistic's variance: against a singular covariance, and for counts that most ordinary texts have none of about what one symbol, repeated line or repeated window makes in a text of a hundred words.
FLOOR = (1e-4, 0.004, 0.012, 0.008, 1e-4, 1e-5, 1e-4)
DIM = len(FLOOR)
PRIOR, BROADCAST, SALTS = 50, 20_000, 64
#: Of a determinant's logarithm: a step that brings less ends the search.
LEAST_FALL = 0.01
#: Longer words count as so long: one address says nothing of a text's words.
LONG_WORD = 20
_BINS_PER_OCTAVE = 8


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of three words which the text has twice or more."""
    n = F.size(words)
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(n, F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    windows = F.zip_with(pairs, F.slice(words, 3, F.greatest(n, F.lit(1))), lambda p, c: F.struct(p["a"].alias("a"), p["b"].alias("b"), c.alias("c")))
    windows = F.slice(windows, 1, F.greatest(n - 2, F.lit(0)))

    def positions(w3: Column) -> Column:
        """Of windows equal to a neighbour, once sorted; the hash orders, the words decide."""
        entries = F.sort_array(F.transform(w3, lambda x, i: F.struct(F.xxhash64(x).alias("h"), x.alias("x"), i.alias("i"))))

        def twice(s: Column) -> Column:
            both = F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s)), lambda a, b: F.when((a["h"] == b["h"]) & (a["x"] == b["x"]), F.array(a["i"], b["i"])))
            return F.sort_array(F.array_distinct(F.flatten(F.filter(both, lambda x: x.isNotNull()))))

        return let(entries, twice)

    def covered(p: Column) -> Column:
        """Words under windows at sorted positions p: three each, less what the next one covers."""
        steps = F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda a, b: F.coalesce(F.least(F.lit(3), b - a), F.lit(3)))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def count(w3: Column) -> Column:
        hashes = F.transform(w3, lambda x: F.xxhash64(x))
        return F.when(let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h)), F.lit(0)).otherwise(let(positions(w3), covered))

    return F.when(n < 4, F.lit(0)).otherwise(let(windows, count))


def counts(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and n_distinct, n_marks, mean_length, spread (mean deviation of lengths)."""
    text = F.coalesce(text, F.lit(""))

    def of(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(words).cast("long").alias("n_repeat_words"),
            F.size(F.array_distinct(words)).cast("long").alias("n_distinct"),
            F.regexp_count(text, F.lit("[.,;:!?]")).cast("long").alias("n_marks"),
            let(F.transform(words, lambda w: F.least(F.length(w), F.lit(LONG_WORD))), lengths).alias("lengths"),
        )

    def lengths(x: Column) -> Column:
        n = F.greatest(F.size(x), F.lit(1)).cast("double")
        mean = F.aggregate(x, F.lit(0), lambda a, v: a + v) / n
        return let(mean, lambda m: F.struct(m.alias("mean"), (F.aggregate(x, F.lit(0.0), lambda a, v: a + F.abs(v - m)) / n).alias("spread")))

    return let(F.regexp_extract_all(text, F.lit(WORD), 0), of)


def base_failed(c: Column) -> Column:
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > 50 * c["n_words"])


def vector(c: Column) -> list[Column]:
    n = F.greatest(c["n_words"], F.lit(2)).cast("double")
    return [
        F.ln(F.greatest(c["lengths"]["mean"], F.lit(1.0))), F.sqrt(c["n_symbols"] / n), F.sqrt(10 * c["n_dup_lines"] / n), F.sqrt(c["n_repeat_words"] / n),
        F.ln(c["lengths"]["spread"] + 0.1), F.ln(F.greatest(c["n_distinct"], F.lit(1)).cast("double")) / F.ln(n), F.sqrt(c["n_marks"] / n),
    ]


_X = [f"x{i}" for i in range(DIM)]
_MU = [f"mu{i}" for i in range(DIM)]
_PAIRS = [(i, j) for i in range(DIM) for j in range(i + 1)]
_C = [f"c{i}{j}" for i, j in _PAIRS]
#: The inverse of the covariance's Cholesky factor: squared distances are sums of squares of its rows' products.
_V = [f"v{i}{j}" for i, j in _PAIRS]


def _factored(means: DataFrame, *others: str) -> DataFrame:
    """Columns c{i}{j} -> v{i}{j}, of the covariance with FLOOR added to its diagonal, and ln_det; MU, C and others are kept."""
    total = lambda terms: " + ".join(terms) or "0D"
    out = []
    for i, j in _PAIRS:  # row by row, each entry from those before it
        rest = f"c{i}{j} - (" + total([f"l{i}{k} * l{j}{k}" for k in range(j)]) + ")"
        out.append(f"sqrt(greatest({rest}, 0D) + {FLOOR[i]!r}D) AS l{i}{j}" if i == j else f"({rest}) / l{j}{j} AS l{i}{j}")
    for i, j in _PAIRS:
        out.append(f"1 / l{i}{i} AS v{i}{j}" if i == j else f"-({total([f'l{i}{k} * v{k}{j}' for k in range(j, i)])}) / l{i}{i} AS v{i}{j}")
    det = total([f"2 * ln(l{i}{i})" for i in range(DIM)]) + " AS ln_det"
    return means.selectExpr(*others, *_MU, *_C, *out, det).select(*others, *_MU, *_C, *_V, "ln_det")


def _d2() -> Column:
    """Squared Mahalanobis distance."""
    rows = [" + ".join(f"v{i}{j} * ({_X[j]} - {_MU[j]})" for j in range(i + 1)) for i in range(DIM)]
    return F.expr(" + ".join(f"power({r}, 2)" for r in rows))


def _moments() -> list[Column]:
    sums = [f"sum({_X[i]}) AS s{i}" for i in range(DIM)] + [f"sum({_X[i]} * {_X[j]}) AS p{i}{j}" for i, j in _PAIRS]
    return [F.expr(x) for x in ("count(*) AS n", *sums)]


def _covariance(m: DataFrame, *keys: str) -> DataFrame:
    """Moments -> centre, covariance, inverse factor, ln_det."""
    mean, cov = [f"s{i} / n AS {_MU[i]}" for i in range(DIM)], [f"p{i}{j} / n - s{i} * s{j} / (n * n) AS c{i}{j}" for i, j in _PAIRS]
    return _factored(m.selectExpr(*keys, *mean, *cov), *keys)


def _beside(rows: DataFrame, estimates: DataFrame, n_groups: int, how: str = "inner") -> DataFrame:
    """Rows with their group's estimates."""
    if n_groups <= BROADCAST:
        return rows.join(F.broadcast(estimates), "group", how)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*_X), F.lit(SALTS)).cast("int"))
    return salted.join(estimates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["group", "salt"], how).drop("salt")


def _binned(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Moments by bin of distance, with the rows of nearer bins and of the whole group."""
    b = F.floor(F.log2(_d2() + 2.0**-20) * _BINS_PER_OCTAVE)
    m = rows.withColumn("bin", F.least(F.lit(320), b)).groupBy(*keys, "bin").agg(*_moments())
    w = Window.partitionBy(*keys)
    return m.withColumn("nearer", F.coalesce(F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("all", F.sum("n").over(w))


def _concentrated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One step: rows joined with estimates -> estimates of the nearest half."""
    half = _binned(rows, keys).filter("2 * nearer < all")
    sums = half.groupBy(*keys).agg(*[F.expr(f"sum({c}) AS {c}") for c in ["n"] + [f"s{i}" for i in range(DIM)] + [f"p{i}{j}" for i, j in _PAIRS]])
    return _covariance(sums, *keys)


def _group(level: int) -> Column:
    """A group's name: the row's language and source, its language, or everything."""
    return F.concat(F.lit(f"{level}:"), F.to_json(F.struct(*[F.col(c) for c in ("lang", "source")[: 2 - level]]))) if level < 2 else F.lit("2:")


def estimates(stats: DataFrame, steps: int = STEPS) -> tuple[DataFrame, int]:
    """stats(lang, source, x0..) -> for each language and source: group, rows, mu*, v*; and how many groups there are."""
    levels = [F.struct(_group(k).alias("group"), (_group(k + 1) if k < 2 else F.lit(None).cast("string")).alias("parent")) for k in range(3)]
    rows = cut(stats.select(F.explode(F.array(*levels)).alias("g"), *_X).select("g.group", "g.parent", *_X), "vectors")
    middle = rows.groupBy("group", "parent").agg(F.count("*").alias("rows"), *[F.percentile_approx(F.col(x), 0.5, 2000).alias(m) for x, m in zip(_X, _MU, strict=True)], *_moments())
    middle = cut(middle, "middles")
    n_groups = middle.count()
    away = _beside(rows, middle.select("group", *_MU), n_groups).groupBy("group").agg(*[F.expr(f"first({m}) AS {m}") for m in _MU], *[F.expr(f"avg(abs({x} - {m})) AS a{i}") for i, (x, m) in enumerate(zip(_X, _MU, strict=True))])
    spread = away.selectExpr("group", *_MU, *[f"1.57D * a{i} * a{i} AS c{i}{i}" if i == j else f"0D AS c{i}{j}" for i, j in _PAIRS])
    median = _factored(spread, "group").withColumn("start", F.lit(1))
    now = cut(_covariance(middle.drop(*_MU), "group").withColumn("start", F.lit(0)).unionByName(median), "estimates")
    for step in range(steps):
        after = _concentrated(_beside(rows, now.drop("ln_det", *_C), n_groups), ["group", "start"])
        if step == 1:  # the better start goes on alone
            best = Window.partitionBy("group").orderBy("ln_det", "start")
            after = after.withColumn("nth", F.row_number().over(best)).filter("nth = 1").drop("nth")
        if step > 1:  # a determinant that doesn't fall ends its group's search: the estimate before stays
            old = now.select("group", F.struct(*[c for c in now.columns if c != "group"]).alias("old"))
            new = after.select("group", F.struct(*[c for c in now.columns if c != "group"]).alias("new"))
            falls = F.col("new.ln_det") < F.col("old.ln_det") - LEAST_FALL
            after = cut(old.join(new, "group").select("group", falls.alias("falls"), F.when(falls, F.col("new")).otherwise(F.col("old")).alias("e")), "estimates")
            now = after.select("group", "e.*")
            if after.filter("falls").limit(1).count() == 0:
                break
        else:
            now = cut(after, "estimates")
    # scaled to the median distance that normal data have
    half = _binned(_beside(rows, now.select("group", *_MU, *_V), n_groups), ["group"]).filter("2 * nearer < all").groupBy("group").agg(F.max("bin").alias("bin"))
    scale = F.pow(F.lit(2.0), (F.col("bin") + 0.5) / _BINS_PER_OCTAVE) / MEDIAN_D2
    own = now.join(half, "group").join(middle.select("group", "parent", "rows"), "group")
    own = own.withColumn("scale", scale)
    own = cut(own.selectExpr("group", "parent", "rows", *_MU, *[f"{c} * scale AS {c}" for c in _C]), "estimates")
    drawn = own.filter("parent IS NULL")
    for level in (1, 0):
        above = drawn.selectExpr("group AS parent", *[f"{c} AS up_{c}" for c in (*_MU, *_C)])
        below = own.filter(F.col("group").startswith(f"{level}:")).join(above, "parent")
        drawn = below.selectExpr("group", "parent", "rows", *[f"(rows * {c} + {PRIOR}D * up_{c}) / (rows + {PRIOR}D) AS {c}" for c in (*_MU, *_C)])
    return cut(_factored(drawn, "group", "rows").select("group", "rows", *_MU, *_V), "estimates"), n_groups


def _judged(rows: DataFrame, steps: int) -> DataFrame:
    """rows(c, lang, source, ...) -> with base_failed, d2, kept."""
    rows = rows.withColumn("base_failed", base_failed(F.col("c")))
    named = rows.select("*", _group(0).alias("group"), *[v.alias(x) for v, x in zip(vector(F.col("c")), _X, strict=True)])
    e, n_groups = estimates(named.filter(~F.col("base_failed")), steps)
    out = _beside(named, e, n_groups, "left").withColumn("d2", _d2())
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= CUTOFF))


def quality(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", source_col="source", steps=STEPS) -> DataFrame:
    """docs -> doc_id, the counts, base_failed, d2, kept."""
    stats = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), counts(F.col(text_col)).alias("c")), "counts")
    return _judged(stats, steps).select("doc_id", *[f"c.{n}" for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", "d2", "kept")


def passed(docs: DataFrame, text_col="text", lang_col="lang", source_col="source", steps=STEPS, in_files: bool = False) -> DataFrame:
    """The rows of docs that are kept, with all their columns.

    in_files: docs is a plain read of files. Its texts then aren't written a second time: rows are picked by their places while the files are read again."""
    if in_files:
        rows = cut(docs.select(_locator().alias("locator"), counts(F.col(text_col)).alias("c"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source")), "counted")
        return unpacked(picked(packed(docs, **_place()), _judged(rows, steps).filter("kept").select("locator"), "passed"))
    rows = cut(packed(docs, c=counts(F.col(text_col)), lang=F.col(lang_col), source=F.col(source_col)), "counted")
    return unpacked(_judged(rows, steps).filter("kept"))
