"""Whitening of embeddings: leading principal components by LOBPCG over distributed covariance-block products.

The fit list holds each distinct fixed-point vector once. The covariance is never formed: each step multiplies it with a block
of a few directions in one pass over the centred rows, and the driver holds blocks of (dimension x directions) only.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import drop_written, ship, written

#: entries times SCALE, rounded down, are the fixed-point entries
SCALE = 256
#: directions iterated beside the wanted ones; rounds at most; residuals (as a part of the largest eigenvalue) aimed at, and the largest accepted
GUARD, ROUNDS, AIM, LARGEST = 28, 500, 1e-13, 1e-10
#: partial blocks that one task adds up
FAN = 512
#: eigenvalues below this part of the largest are no variance
LEAST = 1e-12


def fixed_point(vector: Column) -> Column:
    """floor(SCALE * c) of every entry; null for a null or empty vector and for one with null or non-finite entries."""
    v = vector.cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when(vector.isNotNull() & (F.size(v) > 0) & fine, F.transform(v, lambda c: F.floor(c * SCALE).cast("long")))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _added(fit: DataFrame, d: int, partial, shape: tuple[int, ...]) -> np.ndarray:
    """Sum over all rows of fit of partial(x), x a matrix of rows: tasks add their batches, then FAN tasks' blocks each, the driver the rest.

    Blocks are added in the order of the tasks, so equal layouts give equal sums.
    """

    def run(batches):
        total, part = np.zeros(shape), None
        for b in batches:
            part = b.column(0)[0].as_py() if b.num_rows else part
            if b.num_rows:
                total += partial(_matrix(b.column(1), d))
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "block"])

    def add(table: pa.Table) -> pa.Table:
        table, total = table.sort_by("part"), np.zeros(shape)
        for block in table.column("block"):
            total += np.frombuffer(block.as_py()).reshape(shape)
        return pa.table({"part": table.column("part")[:1], "block": pa.array([total.tobytes()], pa.binary())})

    kind = "part int, block binary"
    parts = fit.select(F.spark_partition_id().alias("part"), "x").mapInArrow(run, kind)
    total = np.zeros(shape)
    for r in sorted(parts.groupBy(F.floor(F.col("part") / FAN)).applyInArrow(add, kind).collect()):
        total += np.frombuffer(r.block).reshape(shape)
    return total


def _stats(fit: DataFrame, d: int) -> tuple[int, list[int], list[int], list[int]]:
    """Exactly: rows, sums, least and largest entries by dimension. Entries are summed as halves of 32 bits, in 64."""
    at = F.posexplode("x").alias("i", "v")
    each = fit.select(at).groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.sum(F.shiftright("v", 32)).alias("high"), F.sum(F.col("v").bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"), F.min("v").alias("least"), F.max("v").alias("most"))
    rows = sorted(each.collect())
    return rows[0].n, [r.high * 2**32 + r.low for r in rows], [r.least for r in rows], [r.most for r in rows]


def _orthonormal(block: np.ndarray, against: list[np.ndarray]) -> np.ndarray:
    """An orthonormal basis of what block adds to the columns of against (orthonormal); twice, so that rounding leaves nothing."""
    norm = np.linalg.norm(block, axis=0)
    block = block[:, norm > 0] / norm[norm > 0]
    for _ in range(2):
        for a in against:
            block = block - a @ (a.T @ block)
        if not block.shape[1]:
            break
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > 1e-8 * max(1e-300, s[0])] if s[0] > 1e-14 else u[:, :0]
    return block


def lobpcg(product, d: int, k: int, guard: int = GUARD, rounds: int = ROUNDS, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, their vectors (columns) and residuals; product(B) is the matrix times a block.

    Each round solves the small problem on the span of iterate, residual and previous direction (Rayleigh-Ritz) and needs the
    products of the residual block only. At the end the products of the iterate are made afresh: its residuals are certified by
    them. ValueError if they stay above LARGEST.
    """
    k = min(k, d)
    m = min(d, k + guard)
    x = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, m)))[0]
    best = p = ap = None
    fresh, stale, low, idle = True, 0, np.inf, 0
    ax = product(x)
    for _ in range(rounds):
        values, turn = np.linalg.eigh((x.T @ ax + ax.T @ x) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        x, ax = x @ turn, ax @ turn
        r = ax - x * values
        size = np.linalg.norm(r[:, :k], axis=0)
        scale = max(float(values[0]), 1e-300)
        low, idle = (size.max(), 0) if size.max() < low / 2 else (low, idle + 1)
        if fresh:
            better = best is None or size.max() < best[2].max()
            best, stale = ((values[:k].copy(), x[:, :k].copy(), size.copy()), stale) if better else (best, stale + 1)
            if size.max() <= AIM * scale or stale >= 3 or not values[0] > 0:
                break
        w = _orthonormal(r, [x] if p is None else [x, p])
        if not w.shape[1] or not fresh and (size.max() <= AIM * scale or idle >= 8 and low <= LARGEST * scale):
            x, p = np.linalg.qr(x)[0], None  # converged, or nothing is left but rounding
            ax, fresh, idle, stale = product(x), True, 0, stale + (not w.shape[1])
            continue
        basis, image = [x, w] if p is None else [x, w, p], [ax, product(w)] if p is None else [ax, product(w), ap]
        q, aq = np.concatenate(basis, axis=1), np.concatenate(image, axis=1)
        _, c = np.linalg.eigh((q.T @ aq + aq.T @ q) / 2)
        c = c[:, ::-1][:, :m]
        # the part of the step outside the old iterate, made orthonormal to the new one; its image follows by the same combinations
        new, rest = c, np.concatenate([np.zeros((m, c.shape[1])), c[m:]])
        rest = _orthonormal(rest, [new])
        x, ax, p, ap = q @ new, aq @ new, q @ rest, aq @ rest
        fresh = False
        if not p.shape[1]:
            p = ap = None
    values, x, size = best if best is not None else (values[:k], x[:, :k], size)
    if values[0] > 0 and size.max() > LARGEST * values[0]:
        raise ValueError(f"residuals stay at {size.max() / values[0]:.1e} of the largest eigenvalue")
    return values, x, size


def fitted(rows: DataFrame, vector: str, components: int = 4) -> dict | None:
    """What whitening needs, from the distinct fixed-point vectors of rows; None without any.

    The dimension is the length that most distinct vectors have (ties: the larger); others are left out, as are those without
    a place in fixed_point. Components whose eigenvalue is under LEAST of the largest carry no variance and are left out, so
    there may be fewer than asked for, or none (a single vector).
    """
    spark = rows.sparkSession
    ship(spark)
    fit = written(rows.select(fixed_point(F.col(f"`{vector}`")).alias("x")).where("x is not null").distinct(), "fit")
    lengths = fit.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not lengths:
        drop_written(fit)
        return None
    d = lengths[0].d
    same = fit.where(F.size("x") == d)
    n, sums, least, most = _stats(same, d)
    mean = np.array([float(Fraction(s, n)) for s in sums])
    trace = float(_added(same, d, lambda x: np.square(x - mean).sum(axis=0), (d,)).sum()) / n
    model = {"n": n, "d": d, "sums": sums, "mean": mean, "trace": trace, "far": max(max(abs(n * a - s), abs(n * b - s)) for a, b, s in zip(least, most, sums))}
    if trace > 0:

        def product(block: np.ndarray) -> np.ndarray:
            def partial(x):
                c = x - mean
                return c.T @ (c @ block)

            return _added(same, d, partial, block.shape) / n

        values, axes, residuals = lobpcg(product, d, components)
        held = values > LEAST * values[0]
        values, axes, residuals = values[held], axes[:, held], residuals[held]
    else:
        values, axes, residuals = np.zeros(0), np.zeros((d, 0)), np.zeros(0)
    model |= {"values": values, "axes": axes, "residuals": residuals}
    k = len(values)
    gram = _added(same, d, lambda x: _moments(project(model, x)), (k + 1, k + 1)) / n
    model["identity_error"] = float(np.abs(gram[:k, :k] - np.outer(gram[k, :k], gram[k, :k]) - np.eye(k)).max()) if k else 0.0
    drop_written(fit)
    return model


def _moments(z: np.ndarray) -> np.ndarray:
    """Products of all pairs of columns, and (last row) their sums."""
    z = np.concatenate([z, np.ones((len(z), 1))], axis=1)
    return z.T @ z


def project(model: dict, x: np.ndarray) -> np.ndarray:
    """Centred rows on the components, in units of their deviation."""
    return (x - model["mean"]) @ (model["axes"] / np.sqrt(model["values"]))


def deviations(model: dict, x: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n * x - S) squared, exactly; null where it passes 64 bits."""
    n, sums = model["n"], model["sums"]
    if n * max(1, max(map(abs, sums), default=0)) < 2**62 and model["d"] * model["far"] ** 2 < 2**63:
        return np.square(n * x - np.array(sums, np.int64)).sum(axis=1).tolist()
    got = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
    return [v if v < 2**63 else None for v in got]


_OUT = [T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))]


def whitened(rows: DataFrame, vector: str, model: dict | None, keep: list[str] | None = None) -> DataFrame:
    """For every row with a vector of the model's dimension: `row` (a struct of its columns, or of those in keep), deviation, whitened.

    Rows with a null, empty or non-finite vector or one of another length have no result; without a model there is none.
    """
    fields = [rows.schema[c] for c in (rows.columns if keep is None else keep)]
    schema = T.StructType([T.StructField("row", T.StructType(fields)), *_OUT])
    spark = rows.sparkSession
    if model is None:
        return spark.createDataFrame([], schema)
    ship(spark)
    d, k = model["d"], len(model["values"])
    held = spark.sparkContext.broadcast(model)  # blocks of d numbers

    def run(batches):
        for b in batches:
            x = _matrix(b.column(1), d)
            z = project(held.value, x) if k else np.zeros((len(x), 0))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(deviations(held.value, x), pa.int64()), lists], ["row", "deviation", "whitened"])

    src = rows.select(F.struct(*[F.col(f"`{f.name}`") for f in fields]).alias("row"), fixed_point(F.col(f"`{vector}`")).alias("x"))
    return src.where(F.size("x") == d).mapInArrow(run, schema)
