"""Connected components by alternating large-star and small-star joins (no driver collection)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_written, salted_join, written


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component), a written table, for every id of edges (a, b); component is the smallest id reachable.

    Ids are of any type that has an order. Each round links neighbours to the smallest id near them, so the number of
    rounds grows with the logarithm of the longest path. A round writes its edges to the shared folder. A vertex of any
    degree is handled by aggregation and salted joins; no neighbour list is ever gathered, nor sent to one task.
    Null ends and loops are ignored; an empty table gives an empty result.
    """
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    mark, total = None, e.count()
    while total:
        # large star: the larger end of each edge meets the smallest vertex near the smaller end
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n"))
        far = salted_join(e, low.withColumnRenamed("u", "v"), ["v"], "n", total, rows=2 * total).select("u", F.col("m").alias("v"))
        large = written(far.where("u <> v"), "edges")
        # small star: a vertex and its smaller neighbours meet the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        near = salted_join(large, low, ["u"], "n", total, rows=total).select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = written(near.unionAll(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        drop_written(e, large)
        e = new
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        total = now[0]
        if now == mark:
            break
        mark = now
    out = written(e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()), "components")
    drop_written(e)
    return out
