"""Whitening against NumPy's eigenvectors on the whole covariance."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewloom.llm import queries, whitening

from conftest import DATA


def exact(vectors):
    """n, sums, eigenvalues (falling), axes of the distinct fixed-point vectors."""
    x = np.unique(np.floor(np.array(vectors, np.float64) * 256).astype(np.int64), axis=0)
    c = x - x.mean(axis=0)
    values, axes = np.linalg.eigh(c.T @ c / len(x))
    return len(x), x.sum(axis=0), values[::-1], axes[:, ::-1]


def test_query_against_numpy(spark):
    got = queries.op11_embedding_whitening(spark, DATA).toPandas()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    n, sums, values, axes = exact([v for _, v in rows])
    assert len(got) == 4 * len(rows) and (got.n == n).all() and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    for component in range(4):
        own = got[got.component == component + 1].set_index("vec_id")
        x = np.floor(np.array([v for _, v in rows], np.float64) * 256)
        want = (x - sums / n) @ axes[:, component] / np.sqrt(values[component])
        have = own.whitened[[i for i, _ in rows]].to_numpy()
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-7
        assert np.allclose(own.explained, values[component] / values.sum(), rtol=1e-10)
    deviation = got[got.component == 1].set_index("vec_id").deviation
    for i, v in rows[:50]:
        assert deviation[i] == sum((n * int(np.floor(np.float64(a) * 256)) - int(s)) ** 2 for a, s in zip(v, sums))


@pytest.mark.parametrize("d, guard", [(40, 2), (40, 8), (7, 28)])
def test_lobpcg_certified(d, guard):
    rng = np.random.default_rng(d + guard)
    a = rng.normal(size=(200, d)) * np.linspace(1, 2, d)
    v = a.T @ a / 200
    values, axes, residuals = whitening.lobpcg(lambda b: v @ b, d, 4, guard=guard)
    want = np.linalg.eigvalsh(v)[::-1][:4]
    assert np.allclose(values, want, rtol=1e-13) and np.abs(v @ axes - axes * values).max() < 1e-11 * want[0] and residuals.max() < 1e-11 * want[0]


def test_equal_eigenvalues_and_little_rank():
    values, axes, _ = whitening.lobpcg(lambda b: 3.0 * b, 6, 4)
    assert np.allclose(values, 3) and np.allclose(axes.T @ axes, np.eye(4))
    a = np.outer(np.arange(6), np.arange(6)).astype(float)
    values, _, _ = whitening.lobpcg(lambda b: a @ b, 6, 4)
    assert np.allclose(values, [55, 0, 0, 0], atol=1e-9)


def test_rows_without_a_place(spark):
    """Nulls, empty, non-finite and odd lengths have no result; repeats count once; extra columns of inner names pass."""
    rng = np.random.default_rng(1)
    good = [[float(v) for v in rng.normal(size=3)] for _ in range(20)]
    bad = [None, [], [1.0, None, 2.0], [float("nan"), 0.0, 0.0], [float("inf"), 0.0, 0.0], [1.0, 2.0]]
    rows = [(i, v, "a") for i, v in enumerate(good + good[:5] + bad)] + [(None, good[0], None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string").withColumn("whitened", F.lit(1)).withColumn("part", F.lit(2))
    model = whitening.fitted(table, "embedding")
    got = whitening.whitened(table, "embedding", model)
    assert model["n"] == 20 and len(model["values"]) == 3 and model["identity_error"] < 1e-9
    out = got.select("row.vec_id", "row.x", "row.part", "deviation", F.size("whitened").alias("k")).collect()
    assert len(out) == 26 and {r.k for r in out} == {3} and sorted(r.vec_id for r in out if r.vec_id is not None) == list(range(25))


def test_one_vector_and_empty_table(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    model = whitening.fitted(one, "embedding")
    assert [tuple(r) for r in whitening.whitened(one, "embedding", model, keep=["vec_id"]).select("row.vec_id", "deviation", F.size("whitened")).orderBy("vec_id").collect()] == [(1, 0, 0), (2, 0, 0)]
    none = one.where("vec_id > 5")
    assert whitening.fitted(none, "embedding") is None and whitening.whitened(none, "embedding", None).count() == 0


def test_deviation_beyond_64_bits(spark):
    rows = spark.createDataFrame([(1, [1e9, 1.0]), (2, [-1e9, 1.0]), (3, [0.0, 2.0]), (4, [0.0, 1.0])], "vec_id long, embedding array<double>")
    model = whitening.fitted(rows, "embedding")
    got = {r.vec_id: r.deviation for r in whitening.whitened(rows, "embedding", model, keep=["vec_id"]).select("row.vec_id", "deviation").collect()}
    assert got[1] is None and got[3] == (4 * 512 - 5 * 256) ** 2
