"""Queries whose results once changed, or whose memory, disk or time grew too far, on larger tables."""

import json
import os
import random
import re
import subprocess
import sys
from collections import Counter
from datetime import datetime, timedelta

import pytest

from reviewloom.operators import components, features, spans
from reviewloom.plans import registry
from reviewloom.sources import readers

from conftest import DATA, ROOT, rows_of

SPILLING = """
import json, sys
from pyspark.sql import SparkSession
from reviewloom.plans import registry
from reviewloom.sources import readers
conf = {"spark.shuffle.spill.numElementsForceSpillThreshold": "50", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false"}
spark = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
got = registry.QUERIES[sys.argv[1]](spark, sys.argv[2])
print("ROWS" + json.dumps([got.columns, [list(r) for r in got.collect()]]))
"""


@pytest.mark.parametrize("name", ["corpus_files", "tagged_test_file"])
def test_order_holds_when_sorts_spill(name, duck):
    run = subprocess.run([sys.executable, "-c", SPILLING, name, DATA], capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(ROOT)}, timeout=300)
    columns, rows = json.loads(next(line for line in run.stdout.splitlines() if line.startswith("ROWS"))[4:])
    want = duck.execute(registry.ORACLE_SQL[name])
    assert rows_of(columns, rows) == rows_of([d[0] for d in want.description], want.fetchall())


SPANS = ("review int, project int, opened timestamp_ntz, closed timestamp_ntz", "project int, kind string, at timestamp_ntz, text string, ws array<string>")


def _shuffled(spark):
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    return spark._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


@pytest.mark.parametrize("what", ["texts", "terms"])
def test_no_row_for_each_pair_of_review_and_text(what, spark):
    """2,000 reviews over the same 2,000 texts: what is shuffled grows with reviews and texts, not with their product."""
    reviews = spark.range(2000).selectExpr("int(id) AS review", "0 AS project", "timestamp_ntz'2024-01-01 00:00:00' AS opened", "timestamp_ntz'2024-01-01 03:00:00' AS closed")
    texts = spark.range(2000).selectExpr("0 AS project", "'a' AS kind", "timestamp_ntz'2024-01-01 01:00:00' AS at", "'w' || id AS text", "array('w' || id % 3) AS ws")
    before = _shuffled(spark)
    if what == "texts":
        got = features.review_texts(reviews, texts, ["a"]).selectExpr("sum(n_texts)", "sum(length(text))").first()
        assert tuple(got) == (4_000_000, 2000 * (sum(len(f"w{i}") + 1 for i in range(2000)) - 1))
    else:
        tf, every = features.review_terms(reviews, texts, ["a"])
        assert tf.agg({"tf": "sum"}).first()[0] == 4_000_000 and every.count() == 2000
    assert _shuffled(spark) - before < 1 << 20


def test_spans_of_all_lengths_in_pieces(spark, monkeypatch):
    """Stretches of several lengths, cut into pieces, returned in small batches, by both ways to count: equal to all pairs."""
    r, day = random.Random(5), datetime(2024, 1, 1)
    at = lambda h: day + timedelta(hours=h)
    reviews = [(i, r.choice([0, 1, None]), at(h := r.randrange(90)), at(h + r.choice([0, 1, 5, 40, 4000]))) for i in range(80)]
    texts = [(r.choice([0, 1, None]), r.choice(["a", "b", "other", None]), at(r.choice([r.randrange(120), r.randrange(4000)])), t, t.split() if t is not None else None) for t in r.choices(["x", "y x", "", "é 𝄞", None], k=400)]
    monkeypatch.setattr(spans, "HEAVY_SPANS", 3)
    monkeypatch.setattr(spans, "BATCH_BYTES", 10)
    monkeypatch.setattr(spans, "BATCH_ROWS", 7)
    monkeypatch.setattr(spans, "BATCH_WORDS", 12)
    a, b = spark.createDataFrame(reviews, SPANS[0]), spark.createDataFrame(texts, SPANS[1])
    want, terms, parts = {}, Counter(), Counter()
    for i, p, o, c in reviews:
        for k in "ab":
            held = sorted((t, x) for q, kind, t, x, _ in texts if q == p and q is not None and kind == k and o <= t <= c and x is not None)
            want[i, k] = (len(held), " ".join(x for _, x in held))
            terms.update((i, w) for _, x in held for w in x.split())
            parts.update({(i, w) for _, x in held for w in x.split()})
    rows = features.review_texts(a, b, ["a", "b"], 3 * 3600).collect()
    assert len(rows) == len(want) and {(x.review, x.kind): (x.n_texts, x.text) for x in rows} == want
    rows = features.review_terms(a, b, ["a", "b"], 3 * 3600)[0].collect()
    assert len(rows) == len(terms) and {(x.doc, x.term): x.tf for x in rows} == terms and {(x.doc, x.term): x.parts for x in rows} == parts


@pytest.mark.parametrize("run", [1, 3, 4096])
def test_json_pieces_in_runs(spark, tmp_path, monkeypatch, run):
    """A window holds a run of pieces, not a block of the file, and runs of all lengths give the rows of the plain reader."""
    monkeypatch.setattr(readers, "RUN", run, raising=False)
    odd = ["}", '"', "{[", '\\"', 'x"}],[{"', "\\\\", ""]
    (tmp_path / "x.json").write_text(json.dumps([{"a": i, "b": odd[i % 7] * (1 + i % 3), "c": {"d": odd[i % 5]}} for i in range(60)]))
    kind = "a long, b string, c struct<d:string>"
    got = readers.json_array(spark, str(tmp_path / "x.json"), kind)
    windows = re.findall(r"windowspecdefinition\((.*?) ASC", got._jdf.queryExecution().optimizedPlan().toString())
    assert windows and all("_at" not in w or "_run" in w for w in windows)
    assert sorted(map(str, got.collect())) == sorted(map(str, spark.read.schema(kind).json(str(tmp_path / "x.json"), multiLine=True).collect()))


def test_components_of_many_rows(spark, monkeypatch):
    """Several blocks: the matrix of moments, made in pieces, gives what passes over the rows give; lengths are those of the components, none of which is stored."""
    import numpy as np

    r = np.random.default_rng(7)
    x = np.where(r.random((500, 300)) < 0.018, r.random((500, 300)), 0.0) * np.geomspace(9, 0.5, 300)
    rows = spark.createDataFrame([(i, int(i % 5 == 0), [int(j) for j in v.nonzero()[0]], [float(w) for w in v[v.nonzero()]]) for i, v in enumerate(x)], "doc long, label int, indices array<int>, values array<double>")
    monkeypatch.setattr(components, "STEP", 64)
    train = x[np.arange(500) % 5 != 0]
    got = np.zeros((300, 300))
    for m in components.moments(rows.where("label = 0"), 300).collect():
        got[m.at, m.indices] = m["values"]
    assert np.allclose(got, train.T @ train, rtol=1e-12, atol=1e-12)
    stored, write = [], components.written
    monkeypatch.setattr(components, "written", lambda df, name: (stored.append((name, df.dtypes)), write(df, name))[1])
    fit = lambda **more: components.principal_components(rows, 300, block=70, **more).orderBy("doc").collect()
    lengths = fit(parts=False)
    assert [name for name, _ in stored].count("moments") == 1 and [name for name, _ in stored].count("parts") > 1
    assert all(kind != "array<double>" for name, table in stored if name != "moments" for _, kind in table)
    whole = fit()
    assert len(whole) == 500 and [(g.doc, g.label, g.n_parts) for g in lengths] == [(g.doc, g.label, len(g.parts)) for g in whole]
    assert np.allclose([g.norm2 for g in lengths], [sum(p * p for p in g.parts) for g in whole], atol=1e-8)
    own = np.array([g.parts for g in whole if g.label == 0])
    assert np.allclose(np.trace(np.cov(own.T)) / np.trace(np.cov(train.T)), whole[0].kept) and whole[0].kept > 0.95
    stored.clear()
    monkeypatch.setattr(components, "MOMENT_BYTES", 0)
    by_rows = fit(parts=False)
    assert "moments" not in [name for name, _ in stored]
    assert [g.n_parts for g in by_rows] == [g.n_parts for g in lengths] and np.allclose([(g.norm2, g.kept) for g in by_rows], [(g.norm2, g.kept) for g in lengths], atol=1e-6)


@pytest.mark.parametrize("by_rows", [False, True])
def test_components_where_few_are_left_out(spark, monkeypatch, by_rows):
    """A flat spectrum: what is left out is searched for, not what is kept; few products, the same lengths as whole components give."""
    import numpy as np

    r = np.random.default_rng(3)
    x = np.where(r.random((900, 240)) < 0.05, r.random((900, 240)), 0.0)
    x[:, :4] = x[:, 4:8] + x[:, 8:12]  # four directions without variance
    rows = spark.createDataFrame([(i, int(i % 5 == 0), [int(j) for j in v.nonzero()[0]], [float(w) for w in v[v.nonzero()]]) for i, v in enumerate(x)], "doc long, label int, indices array<int>, values array<double>")
    monkeypatch.setattr(components, "MOMENT_BYTES", 0 if by_rows else 4 << 30)
    products, product = [], components._product
    monkeypatch.setattr(components, "_product", lambda *a: (products.append(a[4].shape), product(*a))[1])
    lengths = components.principal_components(rows, 240, block=30, parts=False).orderBy("doc").collect()
    few = len(products)
    whole = components.principal_components(rows, 240, block=30).orderBy("doc").collect()
    own = np.array([g.parts for g in whole if g.label == 0])
    cov = np.cov(x[np.arange(900) % 5 != 0].T)
    best = int(np.searchsorted(np.cumsum(np.linalg.eigvalsh(cov)[::-1]) / np.trace(cov), 0.95, side="right")) + 1
    assert len(lengths) == 900 and {(g.n_parts, g.kept) for g in lengths} == {(own.shape[1], whole[0].kept)}
    assert best <= own.shape[1] <= best + 8 and few <= 14
    assert np.allclose([g.norm2 for g in lengths], [sum(p * p for p in g.parts) for g in whole], atol=1e-9)
    assert np.allclose(np.trace(np.cov(own.T)) / np.trace(cov), lengths[0].kept, atol=1e-12) and lengths[0].kept > 0.95


def test_vectors_of_reviews_without_rows_of_terms_in_between(spark, monkeypatch):
    """400 reviews over 300 words each: no row of a review and a term is shuffled or stored, and by all ways to count the vectors are those of the written counts."""
    words = "transform(sequence(0, 99), i -> 'w' || (id * 7 + i) % 310)"
    reviews = spark.range(400).selectExpr("int(id) AS review", "int(id % 2) AS project", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, int(id)) AS opened", "timestamp_ntz'2024-01-01 09:00:00' AS closed")
    texts = spark.range(60).selectExpr("int(id % 2) AS project", "if(id % 3 = 0, 'a', 'b') AS kind", "timestamp_ntz'2024-01-01 03:00:00' + make_dt_interval(0, 0, int(id * 9 - 200)) AS at", "'x' AS text", f"{words} AS ws")
    tf, every = features.review_terms(reviews, texts, ["a", "b"])
    want = {(r.doc, r.term): r.w for r in features.tfidf_of_part_terms(tf, every.count()).collect()}
    stored = []
    monkeypatch.setattr(features, "written", lambda df, name, write=features.written: (stored.append(name), write(df, name))[1])
    for cells in (1 << 21, 1000, 0):
        monkeypatch.setattr(spans, "DENSE_CELLS", cells)
        before = _shuffled(spark)
        got = features.review_tfidf(reviews, texts, ["a", "b"]).collect()
        assert _shuffled(spark) - before < 1 << 18
        assert len(got) == len(want) > 50_000 and all(abs(r.w - want[r.doc, r.term]) < 1e-12 for r in got)
    assert set(stored) == {"df"}
    monkeypatch.setattr(features, "BROADCAST_TERMS", 5)
    got = features.review_tfidf(reviews, texts, ["a", "b"]).collect()
    assert len(got) == len(want) and all(abs(r.w - want[r.doc, r.term]) < 1e-12 for r in got)
