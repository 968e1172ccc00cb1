"""Quality rules with robust multivariate outliers (operator 2).

Each text gives counts (words, characters in words, symbols, repeated lines, words in repeated
5-word windows, capitals, punctuation) and from them a vector of six transformed statistics: the
logarithm of the mean word length and the arcsine square roots of five shares. Per language and
source, a minimum-covariance-determinant estimate of their centre and covariance is found by
concentration steps: the three quarters of the rows with the smallest Mahalanobis distances give the
next mean and covariance. Three starts are followed, each until its determinant falls no more: medians
and median absolute deviations, all rows, and the half of the rows nearest to the medians. The
estimate with the lowest determinant is the group's. A row farther from it than ``cutoff`` is rejected.
Short texts have noisy shares, so a squared distance counts n_words / (n_words + 50) times.

Everything is DataFrame expressions. Statistics are whole numbers (1/512 of a unit), so that sums
of them and of their products are exact and the verdicts don't depend on the order of rows; a step
is one aggregation by (group, start, distance bin), of a few hundred rows per group, so a source with a
third of all rows is pre-aggregated in every task. A group under ``min_rows`` rows with words is
judged with the other small ones of its language; if those are too few as well, by the estimate of
all rows of its language, and if that has too few, by the estimate of the whole table. Only a table
that has under ``min_rows`` rows with words itself is left to the base rules alone.

Defined cases: NULL, empty or blank text has no words (all counts 0) and fails the base rules; NULL
language or source are values like others; repeated rows are rows of their own; no rows, no result;
extra columns are ignored. 5-word windows are told apart by 64-bit hashes within one text.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window, functions as F

from clickweave.llm.common import WORD, bounded, count_of, text_or_empty, without_rows, words_of, written

SYMBOLS = "#*$%&|<>"
GRID = 512
STATS = ("q1", "q2", "q3", "q4", "q5", "q6")
#: Variances added to those found: a share that is 0 in nearly every text has none. Repeated lines
#: and windows, which the base rules bound already, count less.
FLOOR = tuple((x * GRID) ** 2 for x in (0.05, 0.05, 0.15, 0.15, 0.05, 0.05))
#: Median of the chi-squared distribution with six degrees of freedom.
CHI2_MEDIAN = 5.348
_P = len(STATS)
_PAIRS = [(i, j) for i in range(_P) for j in range(i + 1)]
#: An estimate: centre, and covariance as L D L'.
_MOMENTS = [*[f"m{i}" for i in range(_P)], *[f"d{i}" for i in range(_P)], *[f"l{i}{j}" for i, j in _PAIRS if j < i]]


def _window_hashes(hashes: Column) -> Column:
    """Of the 5-word windows, from the hashes of the words, each of which is hashed once."""
    windows = F.transform(F.sequence(F.lit(1), F.size(hashes) - 4), lambda i: F.xxhash64(*[F.element_at(hashes, i + j) for j in range(5)]))
    return F.when(F.size(hashes) >= 5, windows).otherwise(F.array().cast("array<bigint>"))


def _covered_words(h: Column) -> Column:
    """h: the hashes of the windows at 0, 1, ... Equal ones are neighbours after sorting by (hash,
    position); the windows at their positions cover min(5, distance to the next) words each."""
    at = F.array_sort(F.transform(h, lambda x, p: F.struct(x.alias("h"), p.alias("p"))))
    n = F.size(h)
    before = F.concat(F.array(F.lit(None).cast("struct<h:bigint,p:int>")), F.slice(at, F.lit(1), n - 1))
    after = F.concat(F.slice(at, F.lit(2), n - 1), F.array(F.lit(None).cast("struct<h:bigint,p:int>")))
    twice = F.zip_with(F.zip_with(at, before, lambda a, b: F.struct(a.p.alias("p"), a.h.alias("h"),
                                                                  F.coalesce(a.h == b.h, F.lit(False)).alias("t"))),
                       after, lambda a, b: F.when(a.t | F.coalesce(a.h == b.h, F.lit(False)), a.p))
    places = F.array_sort(F.filter(twice, lambda p: p.isNotNull()))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-5).alias("last"))
    total = F.aggregate(places, start, lambda s, p: F.struct((s.n + F.least(F.lit(5), p - s.last)).alias("n"), p.alias("last")),
                        lambda s: s.n)
    return F.when(F.size(F.array_distinct(h)) == n, F.lit(0).cast("long")).otherwise(total)


def text_counts(docs: DataFrame) -> DataFrame:
    """rid (the scan's row number), doc_id, lang, source and the counts of each row's whole text."""
    text, lines = F.col("t"), F.col("lines")
    punctuation = "".join(c for c in string.punctuation if c not in SYMBOLS)
    d = (docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long"), "lang", "source", text_or_empty().alias("t"))
         .withColumn("words", words_of(text)).withColumn("each", F.transform("words", lambda w: F.xxhash64(w)))
         .withColumn("h", _window_hashes(F.col("each")))
         .withColumn("lines", F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)))
    return d.select(
        "rid", "doc_id", "lang", "source", F.size("words").cast("long").alias("n_words"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        count_of(text, SYMBOLS).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _covered_words(F.col("h")).alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"), count_of(text, string.ascii_uppercase).cast("long").alias("n_capitals"),
        count_of(text, punctuation).cast("long").alias("n_punctuation"))


def _statistics(counts: DataFrame) -> DataFrame:
    def share(part: str, whole: str) -> Column:
        return F.asin(F.sqrt(F.when(F.col(whole) > 0, F.least(F.lit(1.0), F.col(part) / F.col(whole))).otherwise(0.0)))

    values = (F.log(F.greatest(F.lit(1.0), F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)))),
              share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"),
              share("n_capitals", "word_chars"), share("n_punctuation", "word_chars"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counts.select("*", *[F.round(v * GRID).cast("long").alias(q) for v, q in zip(values, STATS)],
                         failed.alias("base_failed"))


def _groups(rows: DataFrame, min_rows: int) -> DataFrame:
    """(lang, source) -> the group that judges it, NULL where the table has too few rows, and the
    groups whose estimates its rows enter."""
    own = written(rows.groupBy("lang", "source").agg(F.count_if(F.col("n_words") > 0).alias("n")), "quality-sizes")
    whole = F.lit(own.agg(F.sum("n")).first()[0] or 0) >= min_rows
    by_lang = Window.partitionBy("lang")
    lang = (F.coalesce("lang", F.lit("")).alias("lang"), F.col("lang").isNull().alias("no_lang"))
    source = (F.coalesce("source", F.lit("")).alias("source"), F.col("source").isNull().alias("no_source"))
    large = F.col("n") >= min_rows
    own = (own.withColumn("pooled", F.coalesce(F.sum(F.when(~large, F.col("n"))).over(by_lang), F.lit(0)))
           .withColumn("spoken", F.sum("n").over(by_lang)))
    of_lang = F.to_json(F.struct(*lang))
    # a pool of small groups and a whole language share a name: no language has both
    name = (F.when(large, F.to_json(F.struct(*lang, *source))).when((F.col("pooled") >= min_rows) | (F.col("spoken") >= min_rows), of_lang)
            .when(whole, F.lit("{}")))
    own = own.withColumn("g", name)
    some = F.max((F.col("g") == "{}").cast("int"))
    tabled = F.lit(own.agg(some).first()[0] == 1)
    short = F.max((~large & (F.col("pooled") < min_rows)).cast("int")).over(by_lang) == 1
    feeds = F.array(F.when(large | (F.col("pooled") >= min_rows), F.col("g")),
                    F.when(short & (F.col("spoken") >= min_rows), of_lang), F.when(tabled, F.lit("{}")))
    return own.select(F.col("lang").alias("l_"), F.col("source").alias("s_"), "g", F.array_distinct(F.array_compact(feeds)).alias("feeds"))


def _start(rows: DataFrame) -> DataFrame:
    """Exact medians and median absolute deviations by counting grid values."""
    def median(values: DataFrame, out: str) -> DataFrame:
        seen = values.groupBy("g", "j", "q").agg(F.count(F.lit(1)).alias("n"))
        w = Window.partitionBy("g", "j")
        upto = F.sum("n").over(w.orderBy("q"))
        return (seen.withColumn("upto", upto).withColumn("all", F.sum("n").over(w)).where(2 * F.col("upto") >= F.col("all"))
                .groupBy("g", "j").agg(F.min("q").alias(out)))

    long = rows.select("g", F.posexplode(F.array(*STATS)).alias("j", "q"))
    centre = written(median(long, "m"), "mcd-median")
    spread = median(long.join(bounded(centre), ["g", "j"]).select("g", "j", F.abs(F.col("q") - F.col("m")).alias("q")), "a")
    both = centre.join(spread, ["g", "j"])
    by_stat = both.groupBy("g").pivot("j", list(range(_P))).agg(F.first("m").alias("m"), F.first("a").alias("a"))
    return by_stat.select("g", *[F.col(f"{j}_m").cast("double").alias(f"m{j}") for j in range(_P)],
                          *[(F.pow(F.col(f"{j}_a") * 1.4826, F.lit(2.0)) + FLOOR[j]).alias(f"d{j}") for j in range(_P)],
                          *[F.lit(0.0).alias(f"l{i}{j}") for i, j in _PAIRS if j < i])


def _with_distance(rows: DataFrame, estimate: DataFrame, groups: int) -> DataFrame:
    """Adds ``far``, the squared Mahalanobis distance to the group's estimate (each of them, if there are
    several): with covariance L D L', z = inverse(L) (q - m) and the distance is the sum of z_j squared
    over D_j."""
    rows = rows.join(bounded(estimate.select("g", "start", *_MOMENTS), groups), "g")
    for j in range(_P):
        z = F.col(STATS[j]) - F.col(f"m{j}")
        for k in range(j):
            z = z - F.col(f"l{j}{k}") * F.col(f"z{k}")
        rows = rows.withColumn(f"z{j}", z)
    d2 = sum((F.col(f"z{j}") * F.col(f"z{j}") / F.col(f"d{j}") for j in range(1, _P)), F.col("z0") * F.col("z0") / F.col("d0"))
    return rows.withColumn("far", d2).drop(*_MOMENTS, *[f"z{j}" for j in range(_P)])


def _estimate(rows: DataFrame, share: float) -> DataFrame:
    """A concentration step's mean and covariance (as L D L') per group and start, from the bins of
    smallest distance that hold ``share`` of its rows; ``size``: the logarithm of the determinant;
    ``half``: a distance that half the rows are within."""
    sums = [F.sum(q).alias(f"s{i}") for i, q in enumerate(STATS)]
    products = [F.sum(F.col(STATS[i]) * F.col(STATS[j])).alias(f"p{i}{j}") for i, j in _PAIRS]
    bins = rows.groupBy("g", "start", F.floor(F.log1p("far") * 32).alias("b")).agg(F.count(F.lit(1)).alias("n"), *sums, *products)
    w = Window.partitionBy("g", "start")
    bins = bins.withColumn("upto", F.sum("n").over(w.orderBy("b"))).withColumn("all", F.sum("n").over(w))
    names = ["n", *[f"s{i}" for i in range(_P)], *[f"p{i}{j}" for i, j in _PAIRS]]
    got = (bins.withColumn("half", F.min(F.when(2 * F.col("upto") >= F.col("all"), F.expm1((F.col("b") + 1) / 32))).over(w))
           .where(F.col("upto") - F.col("n") < share * F.col("all"))
           .groupBy("g", "start").agg(*[F.sum(c).cast("double").alias(c) for c in names], F.first("half").alias("half")))
    got = got.select("g", "start", "half", *[(F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(_P)],
                     *[(F.col(f"p{i}{j}") / F.col("n") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("n") / F.col("n")
                        + (FLOOR[j] if i == j else 0.0)).alias(f"c{i}{j}") for i, j in _PAIRS])
    for j in range(_P):
        d = F.col(f"c{j}{j}")
        for k in range(j):
            d = d - F.col(f"l{j}{k}") * F.col(f"l{j}{k}") * F.col(f"d{k}")
        got = got.withColumn(f"d{j}", F.greatest(d, F.lit(FLOOR[j] / 4)))
        for i in range(j + 1, _P):
            c = F.col(f"c{i}{j}")
            for k in range(j):
                c = c - F.col(f"l{i}{k}") * F.col(f"l{j}{k}") * F.col(f"d{k}")
            got = got.withColumn(f"l{i}{j}", c / F.col(f"d{j}"))
    size = sum((F.log(f"d{j}") for j in range(1, _P)), F.log("d0"))
    return got.select("g", "start", "half", size.alias("size"), *_MOMENTS)


def _lowest(rows: DataFrame, groups: int, share: float, falls: float) -> DataFrame:
    """Per group the estimate of the lowest determinant (``start`` says from where). A step that lowers a
    start's determinant by over ``falls`` replaces its estimate; the start is followed until one does not.
    Determinants have a lower bound and fall by at least that, so this ends."""
    at_medians = written(_start(rows).withColumn("start", F.lit(0)), "mcd-0")
    near = written(_with_distance(rows, at_medians, groups), "mcd-near")
    # the medians' spread is no subset's covariance: its first step counts whatever its determinant
    none = F.lit(None).cast("double")
    best = at_medians.select("g", "start", none.alias("half"), F.lit(float("inf")).alias("size"), *_MOMENTS)
    for start, part in ((1, 1.0), (2, 0.5)):
        best = best.unionByName(_estimate(near, part).withColumn("start", F.lit(start)))
    best, step = written(best.withColumn("open", F.lit(True)), "mcd-1"), 1
    while not best.where("open").isEmpty():
        step += 1
        now = _estimate(_with_distance(rows, best.where("open"), 3 * groups), share)
        new = now.select("g", "start", F.struct("half", "size", *_MOMENTS).alias("now"))
        lower = F.col("open") & (F.col("now.size") < F.col("size") - falls)
        columns = [F.when(lower, F.col(f"now.{c}")).otherwise(F.col(c)).alias(c) for c in ("half", "size", *_MOMENTS)]
        # a row per group and start
        best = written(best.join(bounded(new, 3 * groups), ["g", "start"], "left")
                       .select("g", "start", *columns, F.coalesce(lower, F.lit(False)).alias("open")), f"mcd-{step}")
    place = Window.partitionBy("g").orderBy("size", "start")
    return best.withColumn("place", F.row_number().over(place)).where("place = 1").select("g", "start", *_MOMENTS)


def quality_rules(docs: DataFrame, cutoff: float = 25.0, share: float = 0.75, falls: float = 1e-3,
                  min_rows: int = 100) -> DataFrame:
    """One row per row of ``docs``: rid, doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, distance (squared; NULL where no group judges it)."""
    counts = written(_statistics(text_counts(docs)), "quality-counts")
    groups = written(_groups(counts, min_rows), "quality-groups")
    n = groups.count()
    known = bounded(groups, n)
    n = 2 * n + 1  # with those of whole languages and of the whole table
    rows = counts.join(known, F.col("lang").eqNullSafe(F.col("l_")) & F.col("source").eqNullSafe(F.col("s_"))).drop("l_", "s_")
    judged = rows.where(F.col("n_words") > 0).select(*STATS, F.explode("feeds").alias("g"))
    # each step ends in a table of one row per group and start
    found = _lowest(judged, n, share, falls)
    final = _estimate(_with_distance(judged, found, n), share).select("g", "half")
    estimate = written(found.join(final, "g"), "mcd-final")
    scaled = _with_distance(rows.where(F.col("g").isNotNull()), estimate, n).join(bounded(estimate.select("g", "half"), n), "g")
    wider = F.greatest(F.lit(1.0), F.col("half") / CHI2_MEDIAN)
    out = ("rid", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    distance = F.col("far") / wider * F.col("n_words") / (F.col("n_words") + 50)
    scaled = scaled.select(*out, distance.alias("distance"))
    rest = rows.where(F.col("g").isNull()).select(*out, F.lit(None).cast("double").alias("distance"))
    return scaled.unionByName(rest).select(
        *out, (~F.col("base_failed") & ~F.coalesce(F.col("distance") > cutoff, F.lit(False))).alias("kept"), "distance")


def good_documents(docs: DataFrame, **params) -> DataFrame:
    """The rows of ``docs`` (a table) that the rules keep."""
    return without_rows(docs, quality_rules(docs, **params).where("not kept").select("rid"))
