"""Rankings, statistics, tag scores, latent factors."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import drop_written, reads, salted_join, ship, written

#: weights of experience, response and activity
SCORE = (0.4, 0.2, 0.4)


def top_reviewers(scores: DataFrame, k: int) -> DataFrame:
    """(pr, candidate, score, rank): the k best candidates of each pull request; ties by name.

    One linear objective with a fixed number of choices has its optimum at the k largest scores: no search is needed.
    """
    e, r, a = SCORE
    got = scores.withColumn("score", F.round(e * F.col("exp") + r * F.col("rsp") + a * F.col("act"), 9))
    w = Window.partitionBy("pr").orderBy(F.desc("score"), "candidate")
    return got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("pr", "candidate", "score", F.col("rank").cast("long").alias("rank"))


def tag_scores(lines: DataFrame) -> DataFrame:
    """(precision, recall, f1) of place tags over rows (ref, pred); a zero denominator raises."""
    place = lambda c: F.col(c).isin("B", "M", "E", "S")
    n = lambda cond: F.sum(cond.cast("long"))
    t = lines.agg(n(place("ref") & (F.col("ref") == F.col("pred"))).alias("hit"), n(place("pred")).alias("pred"), n(place("ref")).alias("ref"))
    t = t.select((F.col("hit") / F.col("pred")).alias("precision"), (F.col("hit") / F.col("ref")).alias("recall"))
    return t.withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))


def period_means(values: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Means over the periods of each group."""
    return values.groupBy(group).agg(*[F.avg(c).alias(c) for c in columns])


def pearson(rows: DataFrame, x: str, y: str, *groups: str) -> DataFrame:
    """(corr, n), of all rows or of each group; n counts the rows in which both are given."""
    both = F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1))
    return rows.groupBy(*groups).agg(F.corr(x, y).alias("corr"), both.alias("n"))


def pearson_test(rows: DataFrame, x: str, y: str, *groups: str) -> DataFrame:
    """pearson with p, the two-sided p-value of the correlation; see correlation_p."""
    got = pearson(rows, x, y, *groups)
    return got.withColumn("p", correlation_p(F.col("corr"), F.col("n")))


#: steps of the continued fraction: far more than it needs on the side of its argument that is used
FRACTION = 200


def log_gamma(z: Column) -> Column:
    """ln of the gamma function of z > 0: Stirling's series at z + 8, and the steps back."""
    w = z + 8
    series = 1 / (12 * w) - 1 / (360 * w**3) + 1 / (1260 * w**5) - 1 / (1680 * w**7) + 1 / (1188 * w**9)
    back = F.log(z)
    for i in range(1, 8):
        back = back + F.log(z + i)
    return (w - 0.5) * F.log(w) - w + 0.5 * math.log(2 * math.pi) + series - back


def _beta_fraction(x: Column, a: Column, b: Column) -> Column:
    """The continued fraction of the incomplete beta function, folded from its beginning (Lentz): no loop outside the plan."""
    tiny = 1e-300
    safe = lambda v: F.when(F.abs(v) < tiny, F.lit(tiny)).otherwise(v)

    def step(s, i):
        m = F.floor(i / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        num = F.when(i % 2 == 0, even).otherwise(odd)
        d, c = 1 / safe(1 + num * s["d"]), safe(1 + num / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

    # the first step has no even part; one is a double from the data, so that the fold's types agree
    one = x * 0 + 1
    start = F.struct(one.alias("c"), (1 / safe(one - (a + b) * x / (a + 1))).alias("d"), (1 / safe(one - (a + b) * x / (a + 1))).alias("h"))
    return F.aggregate(F.sequence(F.lit(2), F.lit(FRACTION)), start, step)["h"]


def correlation_p(corr: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation of n pairs: the t distribution with n - 2 degrees, as an expression.

    Under three pairs 1, at a correlation of 1 or -1 0, without a correlation null.
    """
    df = n.cast("double") - 2
    x = 1 - corr * corr  # df / (df + t * t)
    a, half = df / 2, F.lit(0.5)
    front = F.exp(log_gamma(a + 0.5) - log_gamma(a) - 0.5 * math.log(math.pi) + a * F.log(x) + 0.5 * F.log(corr * corr))
    # the fraction converges fast below the mean of the beta distribution; above it, the other tail is taken
    low = x < (a + 1) / (a + 2.5)
    tail = F.when(low, front * _beta_fraction(x, a, half) / a).otherwise(1 - front * _beta_fraction(1 - x, half, a) / half)
    return F.when(corr.isNull() | n.isNull(), F.lit(None).cast("double")).when(n < 3, F.lit(1.0)).when(x <= 0, F.lit(0.0)).when(corr == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), tail)))


def line_fit(rows: DataFrame, x: str, y: str) -> DataFrame:
    """One row (slope, intercept, r2) of y = intercept + slope * x."""
    return rows.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def surface_fit(rows: DataFrame, x1: str, x2: str, y: str) -> DataFrame:
    """One row (b0, b1, b2) of y = b0 + b1 * x1 + b2 * x2 squared, from covariances: one pass, no model fit.

    Nulls where the rows don't determine a surface (fewer than three points, or x1 and x2 squared on a line).
    """
    t = rows.select(F.col(x1).cast("double").alias("a"), (F.col(x2) * F.col(x2)).cast("double").alias("b"), F.col(y).cast("double").alias("y"))
    c = lambda p, q: F.covar_pop(p, q).alias(p + q)
    s = t.agg(c("a", "a"), c("a", "b"), c("b", "b"), c("a", "y"), c("b", "y"), *[F.avg(v).alias(f"m{v}") for v in "aby"])
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    over = F.when(F.abs(det) > 1e-12 * F.col("aa") * F.col("bb"), det)
    b1, b2 = (F.col("ay") * F.col("bb") - F.col("by") * F.col("ab")) / over, (F.col("by") * F.col("aa") - F.col("ay") * F.col("ab")) / over
    return s.select((F.col("my") - b1 * F.col("ma") - b2 * F.col("mb")).alias("b0"), b1.alias("b1"), b2.alias("b2"))


#: ratings of a block of the grid, about: a task holds one block and its factors
BLOCK_RATINGS = 200_000


def latent_factors(ratings: DataFrame, rank: int = 5, step: float = 0.1, reg: float = 0.1, rounds: int = 20, seed: int = 1, blocks: int | None = None) -> DataFrame:
    """(user, item, rate, prediction) from factors learned by stratified gradient steps; ratings: user, item, rate.

    Users and items are dealt to `blocks` groups each by a hash, ratings so to a grid of blocks. The blocks of a stratum, one in
    each row and column of the grid, have no user or item in common, so tasks step through them side by side; a round goes
    through all strata. Within a block ratings follow each other by user and item: err = rate - p.q, p += step * (err * q - reg * p),
    then q += step * (err * p - reg * q) with the new p. After each round step shrinks to 0.9 of itself. Factors begin at
    seeded numbers in [0, 1 / sqrt(rank)). Equal inputs give equal results; with one block it is the sequential method.
    Rows with a null are left out; of a repeated pair every row counts.
    """
    spark = ratings.sparkSession
    ship(spark)
    text = lambda c: F.col(c).cast("string")
    rows = ratings.where("user is not null and item is not null and rate is not null")
    rows = written(rows.select("user", "item", F.col("rate").cast("double").alias("rate"), text("user").alias("u"), text("item").alias("i")), "ratings")
    n = rows.count()
    g = blocks or max(1, math.ceil(math.sqrt(n / BLOCK_RATINGS)))
    group = lambda c: F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(g)).cast("int")
    begin = F.transform(F.sequence(F.lit(1), F.lit(rank)), lambda f: F.pmod(F.xxhash64("kind", "id", f, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40) / math.sqrt(rank))
    ids = rows.select(F.lit("p").alias("kind"), F.col("u").alias("id")).unionAll(rows.select(F.lit("q"), "i")).groupBy("kind", "id").agg(F.count(F.lit(1)).alias("n"))
    factors = written(ids.select("kind", "id", "n", group("id").alias("at"), begin.alias("v")), "factors")
    given = written(rows.select(group("u").alias("row"), group("i").alias("column"), "u", "i", "rate"), "grid")
    kind = "kind string, id string, n long, at int, v array<double>"

    def stepped(alpha: float, times: int):
        def work(table: pa.Table) -> pa.Table:
            rated = table.filter(pc.equal(table.column("kind"), "r")).sort_by([("id", "ascending"), ("item", "ascending"), ("rate", "ascending")])
            held = {k: table.filter(pc.equal(table.column("kind"), k)) for k in "pq"}
            place = {k: {x: j for j, x in enumerate(t.column("id").to_pylist())} for k, t in held.items()}
            p, q = (np.array(held[k].column("v").to_pylist(), float).reshape(-1, rank) for k in "pq")
            at_p = [place["p"][x] for x in rated.column("id").to_pylist()]
            at_q = [place["q"][x] for x in rated.column("item").to_pylist()]
            rate, a = rated.column("rate").to_pylist(), alpha
            for _ in range(times):
                for x, y, r in zip(at_p, at_q, rate):
                    u, v = p[x], q[y]
                    err = r - float(u @ v)
                    u += a * (err * v - reg * u)
                    v += a * (err * u - reg * v)
                a *= 0.9
            return pa.concat_tables([held[k].select(["kind", "id", "n", "at"]).append_column("v", pa.array(m.tolist(), pa.list_(pa.float64()))) for k, m in (("p", p), ("q", q))])

        return work

    alpha, together = step, rounds if g == 1 else 1  # one block alone goes through all rounds in its task
    for _ in range(rounds // together if together else 0):
        for s in range(g):
            block = given.where(F.pmod(F.col("column") - F.col("row"), F.lit(g)) == s)
            block = block.select(F.col("row").alias("task"), F.lit("r").alias("kind"), F.col("u").alias("id"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("at"), F.lit(None).cast("array<double>").alias("v"), F.col("i").alias("item"), "rate")
            task = F.when(F.col("kind") == "p", F.col("at")).otherwise(F.pmod(F.col("at") - s, F.lit(g)))
            both = block.unionAll(factors.select(task.alias("task"), "kind", "id", "n", "at", "v", F.lit(None).cast("string"), F.lit(None).cast("double")))
            new = written(both.groupBy("task").applyInArrow(stepped(alpha, together), kind), "factors")
            drop_written(factors)
            factors = new
        alpha *= 0.9
    drop_written(given)
    side = lambda k, name, v: factors.where(F.col("kind") == k).select(F.col("id").alias(name), F.col("n").alias(f"_n{k}"), F.col("v").alias(v))
    got = salted_join(rows, side("p", "u", "_p"), ["u"], "_np", n)
    got = salted_join(got, side("q", "i", "_q"), ["i"], "_nq", n)
    dot = F.aggregate(F.zip_with("_p", "_q", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return reads(got.select("user", "item", "rate", dot.alias("prediction")), rows, factors)


def best_on_grid(grid: DataFrame, value) -> DataFrame:
    """The row of a grid with the largest value, the smallest of equals: (x, value)."""
    return grid.select("x", value.alias("value")).orderBy(F.desc("value"), "x").limit(1)


def undominated(points: DataFrame, a: str, b: str) -> DataFrame:
    """Points (both to be small) that no other point dominates: a running minimum over sorted values, no pairwise join.

    Values are sorted by ranges; the minimum of each range is carried on to the next ones, so no task sees all.
    """
    best = points.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a).agg(F.min(b).alias(b))
    best = best.repartitionByRange(a).sortWithinPartitions(a).withColumn("_p", F.spark_partition_id())
    best = written(best, "ranges")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    least = best.groupBy("_p").agg(F.min(b).alias("_l")).select("_p", F.min("_l").over(before).alias("_before"))
    inner = Window.partitionBy("_p").orderBy(a).rowsBetween(Window.unboundedPreceding, -1)
    front = best.join(F.broadcast(least), "_p").withColumn("_m", F.least(F.min(b).over(inner), "_before"))  # a row for each range
    front = front.where(F.col("_m").isNull() | (F.col(b) < F.col("_m"))).select(a, b)
    return reads(points.join(front, [a, b], "left_semi"), best)


def constrained_points(points: DataFrame) -> DataFrame:
    """points (x1, x2, ...) with f1 and f2, those that keep both constraints of the two-objective demo.

    f1 = 4 x1^2 + 4 x2^2, f2 = (x1 - 5)^2 + (x2 - 5)^2; (x1 - 5)^2 + x2^2 <= 25, (x1 - 8)^2 + (x2 - 3)^2 >= 7.7.
    """
    x, y = F.col("x1"), F.col("x2")
    kept = points.where(((x - 5) * (x - 5) + y * y <= 25) & ((x - 8) * (x - 8) + (y - 3) * (y - 3) >= 7.7))
    return kept.withColumns({"f1": 4 * x * x + 4 * y * y, "f2": (x - 5) * (x - 5) + (y - 5) * (y - 5)})
