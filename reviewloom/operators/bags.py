"""Algebra of bags in long form: (set_id, key, cnt)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count_words(rows: DataFrame, set_col: str, words: str) -> DataFrame:
    """A bag for each set: how often each word stands in its arrays."""
    got = rows.select(F.col(set_col).alias("set_id"), F.explode(words).alias("key"))
    return got.groupBy("set_id", "key").agg(F.count(F.lit(1)).cast("double").alias("cnt"))


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Additive union: counts of equal set and key add up."""
    return a.unionByName(b).groupBy("set_id", "key").agg(F.sum("cnt").alias("cnt"))


def normalise(bags: DataFrame) -> DataFrame:
    """Counts divided by their set's total; an empty bag stays empty, a total of 0 raises.

    Totals are summed with partial sums and joined back: no task needs a whole bag, and a skewed join is split as it runs.
    """
    total = bags.groupBy("set_id").agg(F.sum("cnt").alias("_t"))
    return bags.join(total, "set_id").select("set_id", "key", (F.col("cnt") / F.col("_t")).alias("cnt"))


def divide(a: DataFrame, b: DataFrame) -> DataFrame:
    """a[k] / b[k] where both bags hold k, else a[k]; b[k] = 0 raises."""
    other = b.select("set_id", "key", F.col("cnt").alias("_b"))
    got = a.join(other, ["set_id", "key"], "left")
    return got.select("set_id", "key", F.when(F.col("_b").isNull(), F.col("cnt")).otherwise(F.col("cnt") / F.coalesce("_b", F.lit(1.0))).alias("cnt"))


def _pairs(bags: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Totals of both bags of each pair (x, y), and for every common key of a pair both counts."""
    total = bags.groupBy("set_id").agg(F.sum("cnt").alias("total"))
    ends = pairs.join(total.select(F.col("set_id").alias("x"), F.col("total").alias("tx")), "x", "left")
    ends = ends.join(total.select(F.col("set_id").alias("y"), F.col("total").alias("ty")), "y", "left")
    ends = ends.select("x", "y", F.coalesce("tx", F.lit(0.0)).alias("tx"), F.coalesce("ty", F.lit(0.0)).alias("ty"))
    left = pairs.join(bags.select(F.col("set_id").alias("x"), "key", F.col("cnt").alias("cx")), "x")
    both = left.join(bags.select(F.col("set_id").alias("y"), "key", F.col("cnt").alias("cy")), ["y", "key"])
    return ends, both


def dot(bags: DataFrame, pairs: DataFrame) -> DataFrame:
    """(x, y, dot): sum of products over common keys, 0 without any."""
    ends, both = _pairs(bags, pairs)
    s = both.groupBy("x", "y").agg(F.sum(F.col("cx") * F.col("cy")).alias("dot"))
    return ends.join(s, ["x", "y"], "left").select("x", "y", F.coalesce("dot", F.lit(0.0)).alias("dot"))


def jaccard(bags: DataFrame, pairs: DataFrame) -> DataFrame:
    """(x, y, jaccard): sum of minima over the additive union; two empty bags: 1, equal bags: 0.5."""
    ends, both = _pairs(bags, pairs)
    s = both.groupBy("x", "y").agg(F.sum(F.least("cx", "cy")).alias("n"))
    union = F.col("tx") + F.col("ty")
    value = F.when(union == 0, F.lit(1.0)).otherwise(F.coalesce("n", F.lit(0.0)) / F.when(union == 0, 1.0).otherwise(union))
    return ends.join(s, ["x", "y"], "left").select("x", "y", value.alias("jaccard"))


def tversky(bags: DataFrame, pairs: DataFrame, a: float, b: float) -> DataFrame:
    """(x, y, tversky): n / (u - a * |x minus y| - b * |y minus x|) with the additive union u; a + b must be 1.

    Two empty bags: 1; a zero denominator otherwise raises.
    """
    if a + b != 1:
        raise ValueError("a + b must be 1")
    ends, both = _pairs(bags, pairs)
    s = both.groupBy("x", "y").agg(F.sum(F.least("cx", "cy")).alias("n"))
    got = ends.join(s, ["x", "y"], "left").withColumn("n", F.coalesce("n", F.lit(0.0)))
    # the positive part of the difference is the total less what is common
    union, only_x, only_y = F.col("tx") + F.col("ty"), F.col("tx") - F.col("n"), F.col("ty") - F.col("n")
    value = F.when(union == 0, F.lit(1.0)).otherwise(F.col("n") / (union - a * only_x - b * only_y + F.when(union == 0, 1.0).otherwise(0.0)))
    return got.select("x", "y", value.alias("tversky"))
