"""Splits, samples and class balance in a portable pseudo-random order (md5 of seed and key)."""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ketspark.base import one_of
from ketspark.plans.numbering import numbered, shuffle_key


#: rows of a class that one window ranks, about
BUCKET = 50_000


def check_ratios(*ratios: float) -> None:
    if abs(sum(ratios) - 1) > 1e-6:
        raise ValueError("the ratios must sum to 1")


def parts(rank, n, train: float, val: float):
    """Name of the part of the row with rank 0.. among n.

    Ratios count as the decimal numbers they are written as: in doubles 90 * 0.7 falls short of 63."""
    a, b = (F.floor(n * F.lit(Decimal(str(ratio)))).cast("long") for ratio in (train, val))
    return F.when(rank < a, "train").when(rank < a + b, "val").otherwise("test")


def split(df: DataFrame, key: str, train: float = 0.7, val: float = 0.15, test: float = 0.15, seed: int = 42) -> DataFrame:
    """``df`` with its part; the sizes are exact."""
    check_ratios(train, val, test)
    n = df.count()
    return numbered(df.withColumn("__r", shuffle_key(key, seed)), "__r", key).withColumn("part", parts(F.col("rn"), F.lit(n), train, val)).drop("rn", "__r")


def ranked_in_class(df: DataFrame, key: str, label: str, seed: int) -> DataFrame:
    """``df`` with __rank (0..) in its class and the class size __n.

    Ranks are counted in buckets of the random order, about BUCKET rows of the largest class each, so that no class is
    one task, however large it is."""
    r = shuffle_key(key, seed)
    largest = df.groupBy(label).count().agg(F.max("count")).first()[0] or 0
    digits = max(1, math.ceil(math.log(max(1, largest / BUCKET), 16)))
    dealt = df.withColumn("__r", r).withColumn("__b", F.substring("__r", 1, digits))
    sizes = dealt.groupBy(label, "__b").agg(F.count("*").alias("__c"))
    whole = W.partitionBy(label)
    sizes = sizes.withColumn("__before", F.sum("__c").over(whole.orderBy("__b")) - F.col("__c")).withColumn("__n", F.sum("__c").over(whole))
    own = dealt.withColumn("__own", F.row_number().over(W.partitionBy(label, "__b").orderBy("__r", key)) - 1)
    s = sizes.select(F.col(label).alias("__label"), F.col("__b").alias("__sb"), "__before", "__n")
    joined = own.join(F.broadcast(s) if sizes.count() <= 100_000 else s, F.col(label).eqNullSafe(F.col("__label")) & (F.col("__b") == F.col("__sb")))
    return joined.withColumn("__rank", F.col("__before") + F.col("__own")).drop("__r", "__b", "__own", "__before", "__label", "__sb")


def stratified_split(df: DataFrame, key: str, label: str, train: float = 0.7, val: float = 0.15, test: float = 0.15, seed: int = 42) -> DataFrame:
    return ranked_in_class(df, key, label, seed).withColumn("part", parts(F.col("__rank"), F.col("__n"), train, val)).drop("__rank", "__n")


def sample(df: DataFrame, key: str, n: int, seed: int = 42, replace: bool = False) -> DataFrame:
    """``min(n, rows)`` rows; with ``replace`` each draw is a row of its own."""
    if not replace:
        return df.withColumn("__r", shuffle_key(key, seed)).orderBy("__r", key).limit(n).drop("__r")
    total = df.count()
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), (F.conv(F.substring(shuffle_key("id", seed), 1, 12), 16, 10).cast("long") % max(1, total)).alias("rn"))
    return numbered(df, key).join(draws, "rn").drop("rn")


def stratified_sample(df: DataFrame, key: str, label: str, n: int, seed: int = 42) -> DataFrame:
    """n divided by the number of classes from each class, or all it has."""
    classes = df.select(label).distinct().count()
    return ranked_in_class(df, key, label, seed).where(F.col("__rank") < n // max(1, classes)).drop("__rank", "__n")


def balance_info(df: DataFrame, label: str) -> DataFrame:
    """(label, n, imbalance): class sizes and largest over smallest."""
    sizes = df.groupBy(label).agg(F.count("*").alias("n"))
    span = sizes.agg((F.max("n") / F.min("n")).alias("imbalance"))
    return sizes.crossJoin(F.broadcast(span))


def balance(df: DataFrame, key: str, label: str, method: str = "undersample", features: list[str] | None = None, seed: int = 42) -> DataFrame:
    """'undersample' to the smallest class; 'oversample': each smaller class becomes copies drawn in turn from
    its random order, up to the largest; 'smote': originals and mixtures of two rows of the class."""
    one_of(method, ("oversample", "undersample", "smote"), "method")
    ranked = ranked_in_class(df, key, label, seed)
    low, high = df.groupBy(label).count().agg(F.min("count"), F.max("count")).first()
    if method == "undersample":
        return ranked.where(F.col("__rank") < low).drop("__rank", "__n")
    if method == "oversample":
        # copy number k of a row exists while rank + k * n < high
        copies = F.floor((high - 1 - F.col("__rank")) / F.col("__n"))
        return ranked.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), copies.cast("long")))).drop("__rank", "__n")
    lacking = ranked.select(label, "__n").distinct().where(F.col("__n") < high)
    new = lacking.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), high - F.col("__n") - 1)))
    draw = lambda at: F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed), F.col(label), F.col("k"))), at, 8), 16, 10).cast("long")
    new = new.select(F.col(label).alias("__label"), "k", (draw(1) % F.col("__n")).alias("__a"), (draw(9) % F.col("__n")).alias("__b"), (draw(17) / float(2**32)).alias("alpha"))
    side = lambda p: ranked.select(F.col(label).alias(f"__l{p}"), F.col("__rank").alias(f"__r{p}"), *[F.col(c).cast("double").alias(f"{p}_{c}") for c in features or []])
    both = new.join(side("a"), (F.col("__label") == F.col("__la")) & (F.col("__a") == F.col("__ra"))).join(side("b"), (F.col("__label") == F.col("__lb")) & (F.col("__b") == F.col("__rb")))
    mixed = both.select(F.col("__label").alias(label), *[(F.col("alpha") * F.col(f"a_{c}") + (1 - F.col("alpha")) * F.col(f"b_{c}")).alias(c) for c in features or []], F.lit(True).alias("synthetic"))
    return df.select(label, *[F.col(c).cast("double").alias(c) for c in features or []], F.lit(False).alias("synthetic")).unionByName(mixed)


def augment(df: DataFrame, cols: list[str], factor: int = 2, seed: int = 42) -> DataFrame:
    """Rows of ``cols`` and ``factor`` times as many Gaussian ones with the columns' means and deviations."""
    from ketspark.plans.stats import column_stats

    stats = column_stats(df, cols)
    new = df.sparkSession.range(df.count() * factor).select(*[(gaussian("id", seed + i) * (stats[c]["std"] or 0.0) + (stats[c]["mean"] or 0.0)).alias(c) for i, c in enumerate(cols)])
    return df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unionAll(new)


def gaussian(key: str, seed: int) -> Column:
    """Standard normal draws that follow from seed and key alone (Box-Muller on two numbers of an md5)."""
    draw = lambda at: (F.conv(F.substring(shuffle_key(key, seed), at, 8), 16, 10).cast("long") + 0.5) / float(2**32)
    return F.sqrt(-2 * F.log(draw(1))) * F.cos(2 * math.pi * draw(9))
