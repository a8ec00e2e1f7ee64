"""Mutual information of a continuous feature and a class by distances to nearest neighbours in one dimension.

For every row the distance to its ``k``-th nearest neighbour of the same class is found, and how many rows of any class are
nearer than that. Rows are numbered in order of feature, class and value; blocks of numbers get ``k`` rows of the blocks beside them, so
neighbours are found inside a block. Rows nearer than a distance are counted in the order of all values: both ends of
each row's interval take part in a second numbering, with running counts by block. No task holds more than a block.

Rows whose value or class is null or NaN are left out, as are classes of one row. Equal values have distance 0, and then the rows of
equal value are counted. A feature without rows has no score (null). Column names are free.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ketspark.plans.numbering import numbered

#: rows of a block
BLOCK = 50_000


def digamma(n: Column) -> Column:
    """Of numbers from 1 on, to 12 digits: the asymptotic series from six steps further."""
    y = n + 6
    steps = sum((1 / (n + i) for i in range(1, 6)), 1 / n)
    return F.log(y) - 1 / (2 * y) - 1 / (12 * y**2) + 1 / (120 * y**4) - 1 / (252 * y**6) + 1 / (240 * y**8) - steps


def distances(rows: DataFrame, k: int, block: int) -> DataFrame:
    """``rows`` (rn, feature, label, x, size of the class) with r, the distance to the ``k``-th neighbour, or to the last of a smaller class."""
    place = lambda n: F.floor(n / block)
    near = rows.select("*", F.explode(F.array_distinct(F.array(*[place(F.col("rn") + i) for i in (-k, 0, k)]))).alias("__block"))
    order = W.partitionBy("__block").orderBy("rn")

    def side(f, sign: int) -> list[Column]:
        own = lambda i: (f("feature", i).over(order) == F.col("feature")) & (f("label", i).over(order) == F.col("label"))
        return [F.lit(0.0), *[F.when(own(i), sign * (F.col("x") - f("x", i).over(order))).otherwise(math.inf) for i in range(1, k + 1)]]

    left, right = side(F.lag, 1), side(F.lead, -1)
    with_sides = near.select("*", F.array(*left).alias("__l"), F.array(*right).alias("__r")).where(F.col("__block") == place(F.col("rn")))
    nth = lambda m: F.least(*[F.greatest(F.get("__l", F.lit(i)), F.get("__r", F.lit(m - i))) for i in range(m + 1)])
    kth = F.array(*[nth(m) for m in range(1, k + 1)])
    taken = F.least(F.lit(k), F.col("size") - 1)
    return with_sides.withColumn("r", F.get(kth, taken.cast("int") - 1)).drop("__block", "__l", "__r")


def counted_inside(rows: DataFrame, block: int) -> DataFrame:
    """(rn, feature, m): rows of the feature nearer than r, itself included; with r = 0, those of equal value."""
    x, r = F.col("x"), F.col("r")
    # a mark of kind 0 counts the values below it, one of kind 2 also those equal to it; values are of kind 1
    mark = lambda v, kind, sign: F.struct(v.alias("v"), F.lit(kind).alias("kind"), F.lit(sign).alias("sign"))
    marks = F.when(r > 0, F.array(mark(x, 1, 0), mark(x + r, 0, 1), mark(x - r, 2, -1))).otherwise(F.array(mark(x, 1, 0), mark(x, 2, 1), mark(x, 0, -1)))
    events = numbered(rows.select("feature", F.col("rn").alias("row"), F.inline(marks)), "feature", "v", "kind", name="at")
    events = events.withColumn("__block", F.floor(F.col("at") / block))
    values = F.when(F.col("kind") == 1, 1).otherwise(0)
    # a row a block: at most three rows of the table in ``block``
    totals = events.groupBy("__block").agg(F.sum(values).alias("__n"))
    before = totals.select("__block", (F.sum("__n").over(W.orderBy("__block")) - F.col("__n")).alias("__before"))
    inside = events.select("*", F.sum(values).over(W.partitionBy("__block").orderBy("at")).alias("__inside")).where("sign <> 0")
    found = inside.join(before, "__block").withColumn("c", F.col("sign") * (F.col("__before") + F.col("__inside")))
    return found.groupBy("feature", "row").agg(F.sum("c").alias("m"))


def mutual_info_knn(df: DataFrame, cols: Sequence[str], label: str, k: int = 3, block: int = BLOCK) -> DataFrame:
    """(feature, mi) in nats, at least 0: digamma of rows and neighbours less the mean digammas of class sizes and of rows inside."""
    if k < 1 or block <= 2 * k:
        raise ValueError("k must be positive, and a block hold more than both its borders")
    cells = df.select(F.col(label).alias("__label"), *[F.col(c).cast("double").alias(c) for c in cols]).where(F.col("__label").isNotNull())
    cells = cells.select(F.col("__label").alias("label"), F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in cols])))
    rows = numbered(cells.where(F.col("x").isNotNull() & ~F.isnan("x")), "feature", "label", "x")
    sizes = rows.groupBy("feature", "label").agg(F.count(F.lit(1)).alias("size"))
    rows = rows.join(sizes, ["feature", "label"]).where("size > 1")
    # numbers keep the order of rows when classes of one row have gone
    measured = distances(rows, k, block)
    own = measured.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.avg(digamma(F.least(F.lit(k), F.col("size") - 1).cast("double"))).alias("near"), F.avg(digamma(F.col("size").cast("double"))).alias("of_class"))
    inside = counted_inside(measured, block).groupBy("feature").agg(F.avg(digamma(F.col("m").cast("double"))).alias("within"))
    found = own.join(inside, "feature").select("feature", F.greatest(F.lit(0.0), digamma(F.col("n").cast("double")) + F.col("near") - F.col("of_class") - F.col("within")).alias("mi"))
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "feature string")
    return names.join(found, "feature", "left")
