"""Quality rules: robust multivariate outliers by minimum covariance determinant, in DataFrame functions.

A document's statistics become a vector of ``DIMS`` transformed values. For each language and source the estimate is
searched from several starts: the ``SHARE`` of documents that lie closest (1) by the sum and (2) by the largest of their squared
distances from the medians in median deviations, and (3) by the Mahalanobis distance of all documents' mean and
covariance. Concentration steps follow: mean and covariance of the ``SHARE`` closest by the last estimate. After ``FIRST`` steps
a group goes on from the start with the smallest determinant of the covariance, until no step makes it smaller in any
group. ``FLOORS`` are added to each standard deviation, so that a statistic that hardly varies in a group rejects nothing by
itself. Distances are scaled to their median under normality, but never stretched (scale of at least 1), as that would undo
the floors in tight groups. A document is rejected if its squared distance exceeds ``CUTOFF``: with normal vectors of ``DIMS``
dimensions one in some seven million lies beyond 40, so that only gross outliers go. Steps are a few aggregates a group with
map-side combine over narrow stored rows, so that a source with most documents is no special case.

Rules that need no estimate come first: fewer than 10 words, or over 20 % of the words in repeated
5-word windows. Documents that fail them take no part in the estimates.

Nulls: a null text has no words (and fails the rules); null languages or sources are groups of their
own. A group too small to vary keeps its documents. Repeated rows count as often as they come; ties at a limit are
on its near side. An empty table gives no rows. Very long texts are counted whole. ``kept_documents`` keeps all columns
whatever they are called; ``statistics`` needs columns other than ``stats`` and names with two leading underscores.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ketspark.llm.common import SPACE, observed, stored

SYMBOLS = "#*$%&|<>"
SIGNS = "!\"'()+,-./:;=?@[\\]^_`{}~"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIMS = 5
SHARE = 0.75
FIRST = 2
#: least fall of the log-determinant for which another step is made
FALL = 1e-6
#: smallest standard deviation of each statistic
FLOORS = (0.05, 0.04, 0.05, 0.1, 0.05)
#: median and far quantile of chi-square with DIMS degrees of freedom
CHI2_MEDIAN = 4.3515
CUTOFF = 40.0


def count_of(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def words_covered(starts: Column) -> Column:
    """Words in the 5-word windows with these starts, in ascending order."""
    return F.aggregate(
        starts, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, i: F.struct((a["n"] + i + 5 - F.greatest(i, a["end"])).alias("n"), (i + 5).alias("end")),
        lambda a: a["n"].cast("long"),
    )


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the struct column ``stats``: counts, base_failed and the vector x0.."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn("__words", F.filter(F.split(text, SPACE), lambda w: w != ""))
    out = out.withColumn("__n", F.size("__words"))
    starts = F.when(F.col("__n") >= 5, F.sequence(F.lit(0), F.col("__n") - 5)).otherwise(F.array().cast("array<int>"))
    window = lambda i: F.xxhash64(*[F.get(F.col("__words"), i + k) for k in range(5)])
    out = out.withColumn("__windows", F.transform(starts, window))
    out = out.withColumn("__repeats", F.size("__windows") > F.size(F.array_distinct("__windows")))
    # only texts that repeat a window are sorted to find which ones
    placed = F.array_sort(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("__placed", F.when(F.col("__repeats"), placed).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    at = lambda k: F.get(F.col("__placed"), k)["h"]
    twice = F.filter("__placed", lambda p, k: F.coalesce(p["h"] == at(k - 1), F.lit(False)) | F.coalesce(p["h"] == at(k + 1), F.lit(False)))
    out = out.withColumn("__twice", F.sort_array(F.transform(twice, lambda p: p["i"])))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumn("__lines", lines)
    out = out.withColumn("__counts", F.struct(
        F.col("__n").cast("long").alias("n_words"),
        F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        count_of(text, SYMBOLS).alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size("__lines").alias("n_lines"),
        words_covered(F.col("__twice")).alias("n_repeat_words"),
        count_of(text, CAPITALS).alias("n_capitals"),
        count_of(text, SIGNS).alias("n_signs"),
    ))
    c = lambda name: F.col("__counts")[name]
    x = [
        # a few added characters keep short texts from looking extreme by chance
        F.log((c("word_chars") + 100) / (c("n_words") + 20)),
        F.sqrt(c("n_symbols") / (c("word_chars") + 50)),
        F.sqrt((c("n_capitals") + c("n_signs")) / (c("word_chars") + 50)),
        c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1)),
        c("n_repeat_words") / F.greatest(c("n_words"), F.lit(1)),
    ]
    failed = (c("n_words") < 10) | (100 * c("n_repeat_words") > 20 * c("n_words"))
    kept = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    out = out.withColumn("stats", F.struct(*[c(k).alias(k) for k in kept], failed.alias("base_failed"), *[v.alias(f"x{i}") for i, v in enumerate(x)]))
    return out.drop("__words", "__n", "__windows", "__repeats", "__placed", "__twice", "__lines", "__counts")


def group_key(lang_col: str, source_col: str) -> Column:
    return F.to_json(F.struct(F.col(lang_col).alias("l"), F.col(source_col).alias("s")))


def moments(rows: DataFrame, *by: str) -> DataFrame:
    """Mean, lower Cholesky factor of the covariance, and its log-determinant, of each group."""
    xs = [F.col(f"x{i}") for i in range(DIMS)]
    both = [(i, j) for i in range(DIMS) for j in range(i + 1)]
    out = rows.groupBy(*by).agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(xs)], *[F.avg(xs[i] * xs[j]).alias(f"c{i}{j}") for i, j in both])
    for i, j in both:
        inner = reduce(lambda a, k: a - F.col(f"l{i}{k}") * F.col(f"l{j}{k}"), range(j), F.col(f"c{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}"))  # noqa: B023
        out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(inner, F.lit(0.0)) + FLOORS[i] ** 2) if i == j else inner / F.col(f"l{j}{j}"))
    determinant = reduce(lambda a, b: a + b, [2 * F.log(f"l{i}{i}") for i in range(DIMS)])
    return out.withColumn("log_det", determinant).drop(*[f"c{i}{j}" for i, j in both])


def with_distance(rows: DataFrame, fitted: DataFrame, *by: str) -> DataFrame:
    """``rows`` (by, x0..) with d2, the squared distance by the group's estimate; null without one."""
    out = rows.join(fitted, list(by), "left")
    for i in range(DIMS):
        inner = reduce(lambda a, k: a - F.col(f"l{i}{k}") * F.col(f"y{k}"), range(i), F.col(f"x{i}") - F.col(f"m{i}"))  # noqa: B023
        out = out.withColumn(f"y{i}", inner / F.col(f"l{i}{i}"))
    return out.withColumn("d2", reduce(lambda a, b: a + b, [F.col(f"y{i}") * F.col(f"y{i}") for i in range(DIMS)]))


def nearest(rows: DataFrame, *by: str) -> DataFrame:
    """The SHARE of each group's rows with the smallest d2."""
    limits = rows.groupBy(*by).agg(F.percentile_approx("d2", SHARE, 10_000).alias("limit"))
    return rows.join(stored(limits, "limits"), list(by)).where("d2 <= limit")


def starts(rows: DataFrame) -> DataFrame:
    """``rows`` (g, x0..) once for each start s, with their distance d2 by it."""
    xs = [f"x{i}" for i in range(DIMS)]
    middle = stored(rows.groupBy("g").agg(*[F.percentile_approx(x, 0.5, 10_000).alias(f"m{x}") for x in xs]), "medians")
    spread = rows.join(middle, "g").groupBy("g").agg(*[F.first(f"m{x}").alias(f"m{x}") for x in xs], *[F.percentile_approx(F.abs(F.col(x) - F.col(f"m{x}")), 0.5, 10_000).alias(f"s{x}") for x in xs])
    z2 = [F.pow((F.col(x) - F.col(f"m{x}")) / (1.4826 * F.col(f"s{x}") + FLOORS[i]), F.lit(2.0)) for i, x in enumerate(xs)]
    own = with_distance(rows, stored(moments(rows, "g"), "estimate"), "g").select("g", *xs, "d2").join(stored(spread, "spreads"), "g")
    each = F.array(reduce(lambda a, b: a + b, z2), F.greatest(*z2), F.col("d2"))
    return own.select("g", *xs, F.posexplode(each).alias("s", "d2"))


def fit(rows: DataFrame) -> DataFrame:
    """Estimates by group, from rows (g, x0..) that passed the base rules; a stored table."""
    xs = [f"x{i}" for i in range(DIMS)]
    rows = rows.select("g", *xs)
    tried = stored(moments(nearest(starts(rows), "g", "s"), "g", "s"), "estimate")
    copies = rows.withColumn("s", F.explode(F.array(*[F.lit(k) for k in range(3)])))
    for _ in range(FIRST):
        tried = stored(moments(nearest(with_distance(copies, tried, "g", "s").select("g", "s", *xs, "d2"), "g", "s"), "g", "s"), "estimate")
    names = [c for c in tried.columns if c != "s"]
    fitted = stored(tried.groupBy("g").agg(F.min_by(F.struct(*names), F.struct("log_det", "s")).alias("e")).select("e.*"), "estimate")
    while True:
        step = moments(nearest(with_distance(rows, fitted, "g").select("g", *xs, "d2"), "g"), "g")
        both = fitted.select("g", F.struct(*names).alias("old")).join(step.select("g", F.struct(*names).alias("new")), "g")
        falls = F.col("new.log_det") < F.col("old.log_det") - FALL
        chosen = both.select(F.when(falls, F.col("new")).otherwise(F.col("old")).alias("e"), falls.alias("falls"))
        fitted, left = observed(chosen, "estimate", F.count_if("falls").alias("n"))
        fitted = fitted.select("e.*")
        if not left["n"]:
            break
    scale = with_distance(rows, fitted, "g").groupBy("g").agg((F.percentile_approx("d2", 0.5, 10_000) / CHI2_MEDIAN).alias("scale"))
    return stored(fitted.join(scale, "g"), "estimate")


def verdict(rows: DataFrame, fitted: DataFrame) -> DataFrame:
    """``rows`` (g, base_failed, x0..) with distance (null if the base rules failed) and kept."""
    out = with_distance(rows, fitted, "g")
    distance = F.when(~F.col("base_failed"), F.col("d2") / F.greatest(F.coalesce(F.col("scale"), F.lit(1.0)), F.lit(1.0)))
    drop = [c for c in fitted.columns if c != "g"] + [f"y{i}" for i in range(DIMS)] + ["d2"]
    return out.withColumn("distance", distance).withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= CUTOFF)).drop(*drop)


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (text, lang, source, ...) that the rules keep, columns unchanged."""
    whole = F.struct(*docs.columns).alias("__row")
    own = statistics(docs.select(whole, "text", "lang", "source")).select("__row", group_key("lang", "source").alias("g"), "stats.*")
    rows = stored(own, "statistics")  # the filter below would otherwise repeat the statistics' expressions
    return verdict(rows, fit(rows.where("not base_failed"))).where("kept").select("__row.*")


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    rows = stored(statistics(docs).select("doc_id", group_key("lang", "source").alias("g"), "stats.*"), "statistics")
    out = verdict(rows, fit(rows.where("not base_failed")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
