"""Values worked out by hand from the definitions."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reviewloom.functions import tagging, text
from reviewloom.operators import bags, features, graphs, learning, shaping
from reviewloom.sources import readers, schemas


def close(a, b):
    return abs(a - b) < 1e-6


def test_path_prefixes(spark):
    got = spark.createDataFrame([("actionpack/lib/a.rb",), ("/x",)], "p string").select(text.path_prefixes(F.col("p")).alias("x")).collect()
    assert got[0].x == ["/actionpack", "/actionpack/lib", "/actionpack/lib/a.rb"]
    assert got[1].x == ["/", "//x"]


def test_epoch_and_floats(spark):
    r = spark.range(1).select(text.epoch_ms_text(F.lit(1530513131000)).alias("t"), text.float_div(F.lit(-1), F.lit(1)).alias("a"), text.float_div(F.lit(1), F.lit(0)).alias("b"), text.float_div(F.lit(0), F.lit(0)).alias("c"), text.float_mul(F.lit(0.1), F.lit(3)).alias("d")).first()
    assert r.t == "2018-07-02 06:32:11" and r.a == -1 and r.b == math.inf and math.isnan(r.c) and abs(r.d - 0.3) < 1e-6


def test_bots(spark):
    got = spark.createDataFrame([("x[bot]",), ("CLAassistant",), ("claassistant",), ("stale",)], "n string").select(text.is_bot(F.col("n")).alias("b")).collect()
    assert [r.b for r in got] == [True, True, False, True]


FILES = [(1, "a/b"), (1, "a/c"), (2, "a/b"), (3, "x")]


def weights(df):
    return {(r.doc, r.term): r.w for r in df.collect()}


def test_tfidf(spark):
    tf = features.term_frequency(features.path_terms(spark.createDataFrame(FILES, "pr long, filename string"), "pr"))
    w = weights(features.tfidf_plain(tf))
    assert close(w[1, "/a"], 2.810930) and close(w[1, "/a/b"], 1.405465) and close(w[1, "/a/c"], 2.098612) and close(w[3, "/x"], 2.098612)
    w = weights(features.tfidf(tf))
    assert close(w[1, "/a"], 0.569307) and close(w[1, "/a/b"], 0.284654) and close(w[1, "/a/c"], 0.771272) and close(w[2, "/a"], 0.707107) and close(w[3, "/x"], 1)
    same = features.term_frequency(features.path_terms(spark.createDataFrame([(1, "q"), (2, "q")], "pr long, filename string"), "pr"))
    assert features.tfidf(same).count() == 0


def bag(spark, rows):
    return spark.createDataFrame([(s, str(k), float(c)) for s, k, c in rows], "set_id int, key string, cnt double")


def as_map(df):
    return {(r.set_id, r.key): r.cnt for r in df.collect()}


def test_bag_algebra(spark):
    s1, s2 = bag(spark, [(1, 1, 0.1), (1, 2, 0.2)]), bag(spark, [(1, 2, 0.3), (1, 3, 0.4)])
    merged = bags.merge(s2, s1)
    m = as_map(merged)
    assert close(m[1, "1"], 0.1) and close(m[1, "2"], 0.5) and close(m[1, "3"], 0.4)
    d = as_map(bags.divide(s1, merged))
    assert close(d[1, "1"], 1) and close(d[1, "2"], 0.4)
    n = as_map(bags.normalise(bags.divide(s1, merged)))
    assert close(n[1, "1"], 0.714286) and close(n[1, "2"], 0.285714)
    two = bag(spark, [(1, 1, 0.1), (1, 2, 0.2), (2, 2, 0.3), (2, 3, 0.4)])
    pair = spark.createDataFrame([(1, 2)], "x int, y int")
    assert close(bags.dot(two, pair).first().dot, 0.06)


def test_bag_similarity(spark):
    b = bag(spark, [(1, "a", 2), (1, "b", 1), (2, "b", 1), (2, "c", 2), (3, "b", 1)])
    pairs = spark.createDataFrame([(1, 2), (1, 1), (8, 9), (1, 3)], "x int, y int")
    j = {(r.x, r.y): r.jaccard for r in bags.jaccard(b, pairs).collect()}
    assert close(j[1, 2], 1 / 6) and close(j[1, 1], 0.5) and j[8, 9] == 1
    for a, want in ((1.0, 1 / 2), (0.0, 1 / 4), (0.5, 1 / 3)):
        t = {(r.x, r.y): r.tversky for r in bags.tversky(b, pairs, a, 1 - a).collect()}
        assert close(t[1, 3], want)
    with pytest.raises(ValueError):
        bags.tversky(b, pairs, 1.0, 1.0)
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        bags.tversky(bag(spark, [(1, "a", 1)]), spark.createDataFrame([(1, 2)], "x int, y int"), 1.0, 0.0).collect()


def test_digraph(spark):
    calls = spark.createDataFrame([(0, "x", "y", 1.0, 2), (1, "x", "y", 3.0, 1), (2, "x", "z", 2.0, 0)], "ord int, src string, dst string, cost double, r_cnt int")
    nodes, edges, top = graphs.calls_summary(calls)
    n = {r.node: (r.in_cnt, r.author_cnt, r.reviewer_cnt) for r in nodes.collect()}
    assert n == {"x": (0, 3, 0), "y": (2, 0, 3), "z": (1, 0, 0)} and top.first().max_weight == 3
    mark = lambda *d: spark.createDataFrame([("x", v) for v in d], "src string, dst string")
    best = lambda m=None: [r.dst for r in graphs.best_neighbour(edges, m).collect()]
    assert best() == ["y"] and best(mark("y")) == ["z"] and best(mark("y", "z")) == []


def test_edges(spark):
    e = spark.createDataFrame([(0, "t", 1, 2, 2.0, "first"), (1, "t", 2, 1, 3.0, "second")], "ord int, type string, u int, v int, weight double, description string")
    assert [tuple(r) for r in graphs.accumulate(e).collect()] == [("t", 1, 2, 5.0, "first")]


def test_hypergraph(spark):
    inc = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 1), (2, 2)], "edge_id int, node_id int")
    w = spark.createDataFrame([(1, 1.0), (2, 2.0)], "edge_id int, weight double")
    a = {(r.u, r.v): r.value for r in graphs.propagation(inc, w).collect()}
    assert len(a) == 9 and all(close(a[k], 0.388889) for k in ((0, 0), (0, 1), (1, 1))) and close(a[0, 2], 0.272166) and close(a[2, 1], 0.272166) and close(a[2, 2], 1 / 3)
    left, nodes, edges = graphs.remove_node(inc, 0)
    assert sorted(map(tuple, left.collect())) == [(2, 1), (2, 2)]
    assert sorted(map(tuple, nodes.collect())) == [(1, 0), (2, 1)] and [tuple(r) for r in edges.collect()] == [(2, 0)]


def test_random_walk(spark):
    e = spark.createDataFrame([(0, 0, 1, 2.0), (1, 0, 2, 3.0), (2, 1, 2, 1.0)], "ord int, u int, v int, weight double")
    got = {(r.i, r.j): r.value for r in graphs.random_walk(e, 3).collect()}
    assert got == {(0, 1): 1, (0, 2): 0.75, (1, 0): 1, (1, 2): 0.25}


def test_communities_and_modularity(spark):
    edges = [(a, b, 1.0) for g in (0, 10) for a in range(g, g + 4) for b in range(a + 1, g + 4)] + [(3, 10, 1.0)]
    e = spark.createDataFrame(edges, "u int, v int, weight double")
    parts = graphs.communities(e)
    c = {r.node: r.community for r in parts.collect()}
    assert len({c[i] for i in range(4)}) == 1 and len({c[i] for i in range(10, 14)}) == 1
    best = spark.createDataFrame([(i, i // 10) for i in c], "node int, community int")
    assert close(graphs.modularity(e, best).first().q, 2 * (6 / 13 - 0.25))


def test_tagging(spark):
    tag = lambda s: "".join(t for _, t in tagging.tag_tokens(s.split()))
    assert tag("[中国/ns 人民/n]nt 好/a 北京/ns") == "OOOOOBE" and tag("[上/x 海/x]ns") == "BE" and tag("京/ns") == "S"
    with pytest.raises(ValueError):
        tagging.tag_tokens(["[a/x"])
    lines = spark.createDataFrame([("B", "B"), ("E", "E"), ("O", "S"), ("S", "O")], "ref string, pred string")
    assert all(close(x, 2 / 3) for x in learning.tag_scores(lines).first())


def test_timeline(spark):
    node = lambda i, k: f'{{"node": {{"id": "{i}", "typename": "{k}"}}}}'
    j = f'{{"id": "p", "timelineItems": {{"edges": [{node("n0", "c")}, {{"node": null}}, {node("n2", "r")}]}}}}'
    got = shaping.timeline(spark.createDataFrame([(j,)], "j string").select(readers.nested(F.col("j"), schemas.TIMELINE).alias("r")).select("r.*"))
    assert [r.position for r in got.collect()] == [0, 2]
    items = spark.createDataFrame([("p", "r3", "r", 3), ("p", "c4", "c", 4), ("p", "c6", "c", 6), ("p", "r7", "r", 7)], "pullrequest_node string, timelineitem_node string, typename string, position long")
    got = sorted((r[3], r[4]) for r in shaping.changes_by_round(items, "r", "c").collect())
    assert got == [(3, 4), (3, 6), (7, -1)]


def test_follow_without_followers(spark):
    j = '{"data": {"user": {"login": "a", "following": {"totalCount": 1, "edges": [{"cursor": "x", "node": {"login": "b"}}, {"cursor": "y", "node": null}]}}}}'
    parsed = spark.createDataFrame([(j,), ("{}",), ("no json",)], "j string").select(readers.nested(F.col("j"), schemas.FOLLOW).alias("r")).select("r.*")
    assert [tuple(r) for r in shaping.follow_edges(parsed).collect()] == [("a", "b")]
    assert [r.last_cursor for r in shaping.connection_state(parsed, "following").collect() if r.login] == ["y"]


def test_reviewers(spark):
    s = spark.createDataFrame([(1, "A", 1.0, 0.0, 0.0), (1, "B", 0.0, 1.0, 0.0), (1, "C", 0.0, 0.0, 1.0), (1, "D", 1.0, 1.0, 1.0)], "pr int, candidate string, exp double, rsp double, act double")
    assert [r.candidate for r in learning.top_reviewers(s, 2).orderBy("rank").collect()] == ["D", "A"]


def test_fits(spark):
    df = spark.range(10).select(F.col("id").cast("double").alias("x"), (2.0 * F.col("id") + 1).alias("y"), F.pow(F.col("id") - 4, 3).alias("z")).withColumn("w", 3 + F.col("x") - 2 * F.col("z") * F.col("z"))
    r = learning.line_fit(df, "x", "y").first()
    assert close(r.slope, 2) and close(r.intercept, 1) and close(r.r2, 1) and close(learning.pearson(df, "x", "y").first().corr, 1)
    s = learning.surface_fit(df, "x", "z", "w").first()
    assert close(s.b0, 3) and close(s.b1, 1) and close(s.b2, -2)


def test_correlation_p(spark):
    """Against the integral of the t density, and its ends."""
    import numpy as np

    cases = [(r, n) for n in (3, 4, 5, 10, 101, 5000) for r in (0.0, 1e-6, 0.01, -0.3, 0.5, 0.9, 0.999999, -1.0)] + [(0.5, 2), (None, 9), (0.5, 0)]
    got = spark.createDataFrame([(i, r, n) for i, (r, n) in enumerate(cases)], "i int, r double, n long").select("i", learning.correlation_p(F.col("r"), F.col("n")).alias("p")).collect()
    for i, p in got:
        r, n = cases[i]
        if r is None or n < 3:
            assert p == (None if r is None else 1.0)
            continue
        # with r = sin(u) the density of the correlation is cos(u) to the power n - 3
        u = np.linspace(-np.pi / 2, np.pi / 2, 400_001)
        density = np.cos(u) ** (n - 3)
        cdf = np.concatenate([[0], np.cumsum((density[1:] + density[:-1]) / 2)])
        want = 2 * (1 - np.interp(np.arcsin(abs(r)), u, cdf / cdf[-1]))
        assert abs(p - want) < 2e-5, (r, n, p, want)
    r = spark.createDataFrame([(0.5, 10)], "r double, n long").select(learning.correlation_p(F.col("r"), F.col("n")).alias("p")).first()
    assert close(r.p, 0.1411133)


def sequential(rows, p, q, step, reg, rounds):
    for _ in range(rounds):
        for u, i, r in sorted(rows):
            err = r - sum(a * b for a, b in zip(p[u], q[i]))
            for f in range(len(p[u])):
                p[u][f] += step * (err * q[i][f] - reg * p[u][f])
                q[i][f] += step * (err * p[u][f] - reg * q[i][f])
        step *= 0.9


def ratings(spark, n=600, seed=2):
    import numpy as np

    r = np.random.default_rng(seed)
    p, q = r.random((30, 3)), r.random((25, 3))
    pairs = sorted({(int(a), int(b)) for a, b in zip(r.integers(0, 30, n), r.integers(0, 25, n))})
    return [(f"u{a}", b, float(p[a] @ q[b])) for a, b in pairs]


def test_latent_factors_in_order(spark):
    """One block: equal to the loops over users and items, written out."""
    from reviewloom.sources import scratch

    rows = ratings(spark)
    df = spark.createDataFrame(rows + [(None, 1, 1.0), ("u1", None, 1.0), ("u1", 1, None)], "user string, item int, rate double")
    begun = []
    real = scratch.written

    def noted(table, name):
        out = real(table, name)
        if name == "factors" and not begun:
            begun.extend(out.collect())
        return out

    learning.written, back = noted, learning.written
    try:
        got = {(r.user, r.item): r.prediction for r in learning.latent_factors(df, rank=3, rounds=4).collect()}
    finally:
        learning.written = back
    assert all(0 <= x <= 1 / math.sqrt(3) for r in begun for x in r.v)
    p, q = ({r.id: list(r.v) for r in begun if r.kind == k} for k in "pq")
    sequential([(u, str(i), r) for u, i, r in rows], p, q, 0.1, 0.1, 4)
    assert len(got) == len(rows) and all(close(got[u, i], sum(a * b for a, b in zip(p[u], q[str(i)]))) for u, i, _ in rows)


def test_latent_factors_in_blocks(spark):
    """Four blocks: repeatable, every rating and repeat used, about as good as alternating least squares of the same weight of terms."""
    from pyspark.ml.recommendation import ALS

    rows = ratings(spark, 900)
    df = spark.createDataFrame(rows, "user string, item int, rate double").repartition(3)
    run = lambda rounds: sorted((r.user, r.item, r.rate, r.prediction) for r in learning.latent_factors(df, rank=3, reg=0.02, rounds=rounds, blocks=2).collect())
    got = run(12)
    assert run(2) == run(2) and [x[:3] for x in got] == sorted(rows)
    error = lambda pairs: math.sqrt(sum((a - b) ** 2 for a, b in pairs) / len(rows))
    ours = error([x[2:] for x in got])
    mean = sum(r for *_, r in rows) / len(rows)
    ids = df.withColumn("user", F.expr("int(substr(user, 2))"))
    als = ALS(rank=3, regParam=0.1, maxIter=12, seed=1, userCol="user", itemCol="item", ratingCol="rate").fit(ids).transform(ids)
    assert ours <= 1.05 * error([(r.rate, r.prediction) for r in als.collect()]) and ours < 0.5 * error([(r, mean) for *_, r in rows])
    empty = learning.latent_factors(df.where("rate > 1e9"))
    assert empty.count() == 0


def test_texts_of_reviews(spark):
    """Spans over several buckets, ends included; order by time and text; open reviews and null texts give nothing; equal to all pairs."""
    import random
    from datetime import datetime, timedelta

    r, day = random.Random(3), datetime(2024, 1, 1)
    at = lambda h: day + timedelta(hours=h)
    reviews = [(i, r.randrange(3), at(h := r.randrange(90)), None if i % 5 == 0 else at(h + r.randrange(-3, 40))) for i in range(60)]
    texts = [(r.randrange(3), r.choice(["a", "b", "c", "other"]), at(r.randrange(120)), r.choice(["x", "y", "", None])) for _ in range(300)]
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    got = features.review_texts(spark.createDataFrame(reviews, "review int, project int, opened timestamp_ntz, closed timestamp_ntz"), spark.createDataFrame(texts, "project int, kind string, at timestamp_ntz, text string"), ["a", "b", "c"], 3 * 3600)
    want = set()
    for i, p, o, c in reviews:
        if c is not None and o <= c:
            for k in "abc":
                held = sorted((t, x) for q, kind, t, x in texts if q == p and kind == k and o <= t <= c and x is not None)
                want.add((i, k, len(held), " ".join(x for _, x in held)))
    rows = [tuple(x) for x in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_moves_beat_their_start(spark):
    """Planted groups: the score is that of the partition, no less than the start's or the plant's; a graph without weight stays alone."""
    import random

    r = random.Random(1)
    edges = {(a, b): 1.0 for g in range(6) for a in range(g * 6, g * 6 + 6) for b in range(a + 1, g * 6 + 6) if r.random() < 0.9} | {(a * 6, (a * 6 + 7) % 36): 0.5 for a in range(6)}
    e = spark.createDataFrame([(min(k), max(k), w) for k, w in edges.items()], "u int, v int, weight double")
    planted = spark.createDataFrame([(i, i // 6) for i in range(36)], "node int, community int")
    q = lambda p: graphs.modularity(e, p).first().q
    parts, score = graphs.louvain(e)
    assert close(score, q(parts)) and score >= q(planted) - 1e-9 and parts.count() == 36
    odd = spark.createDataFrame([(i, i % 12) for i in range(36)], "node int, community int")
    assert graphs.louvain(e, odd, rounds=2)[1] > q(odd)
    empty, score = graphs.louvain(e.where("u > 99"))
    assert empty.count() == 0 and score == 0


def test_pairs_of_a_large_edge(spark, monkeypatch):
    """An edge of more members than HEAVY_ROWS is made in pieces: same matrix."""
    from reviewloom.sources import scratch

    inc = spark.createDataFrame([(1, i) for i in range(12)] + [(2, 3), (2, 4)], "edge_id int, node_id int")
    w = spark.createDataFrame([(1, 1.0), (2, 2.0)], "edge_id int, weight double")
    plain = sorted(map(tuple, graphs.propagation(inc, w).collect()))
    monkeypatch.setattr(scratch, "HEAVY_ROWS", 3)
    assert [(u, v, round(x, 9)) for u, v, x in sorted(map(tuple, graphs.propagation(inc, w).collect()))] == [(u, v, round(x, 9)) for u, v, x in plain]


def test_strip_namespace_and_log(spark, caplog):
    from reviewloom.sources import writers

    got = spark.createDataFrame([("{http://x/y}Node",), ("Edge",)], "t string").select(text.strip_namespace(F.col("t")).alias("t")).collect()
    assert [r.t for r in got] == ["node", "edge"]
    with caplog.at_level("INFO", "reviewloom"):
        writers.log_line("ERROR", "a")
        writers.log_line("odd", "b")
    assert [(r.levelname, r.message) for r in caplog.records] == [("ERROR", "a"), ("INFO", "b")]


def test_missing_label(spark):
    v = spark.createDataFrame([(1, "t", 1.0)], "doc int, term string, w double")
    with pytest.raises(ValueError):
        features.labelled(v, spark.createDataFrame([(1, 2)], "doc int, other int"))


counts = st.dictionaries(st.sampled_from("abcde"), st.integers(1, 5), max_size=5)


@settings(max_examples=5, deadline=None)
@given(st.lists(counts, min_size=2, max_size=4))
def test_similarity_properties(spark, sets):
    b = bag(spark, [(i, k, c) for i, s in enumerate(sets) for k, c in s.items()])
    pairs = spark.createDataFrame([(i, j) for i in range(len(sets)) for j in range(len(sets))], "x int, y int")
    j = {(r.x, r.y): r.jaccard for r in bags.jaccard(b, pairs).collect()}
    t1 = {(r.x, r.y): r.tversky for r in bags.tversky(b, pairs, 0.25, 0.75).collect()}
    t2 = {(r.x, r.y): r.tversky for r in bags.tversky(b, pairs, 0.75, 0.25).collect()}
    for x, y in j:
        assert close(j[x, y], j[y, x]) and (j[x, y] <= 0.5 or not (sets[x] or sets[y])) and close(t1[x, y], t2[y, x])


def test_reduced_keeps_the_share_of_all_terms(spark):
    import numpy as np

    r = np.random.default_rng(4)
    x = np.where(r.random((160, 90)) < 0.15, r.random((160, 90)), 0.0)
    x[:40, 85:] = 0  # terms of train documents only
    label = np.arange(160) < 40
    cells = [(int(i), f"t{j:02}", float(x[i, j])) for i, j in zip(*x.nonzero())] + [(0, "only in test", 1.0)]
    vectors = spark.createDataFrame(cells, "doc long, term string, w double")
    labels = spark.createDataFrame([(i, int(label[i])) for i in range(160)], "doc long, label int")
    got = {g.doc: np.array(g.parts) for g in features.reduced(vectors, labels).collect()}
    train = x[~label]
    mean = train.mean(0)
    values, axes = np.linalg.eigh(np.cov(train.T))
    kept = np.cumsum(values[::-1]) / values.sum()
    k = int((kept <= 0.95).sum()) + 1
    assert 32 < k < 90 and kept[k - 1] > 0.95
    want = (x - mean) @ axes[:, ::-1][:, :k]
    assert len(got) == 160 and all(len(v) == k for v in got.values())
    assert all(np.allclose(abs(got[i]), abs(want[i]), atol=1e-8) for i in range(160))
    for g in features.reduced(vectors, labels).take(3):
        assert close(g.kept, kept[k - 1])


def test_components_in_blocks(spark, monkeypatch):
    """Blocks far smaller than the vocabulary: orthonormal directions, the share exact, leading ones those of NumPy; partial blocks in ranges."""
    import numpy as np

    from reviewloom.operators import components

    monkeypatch.setattr(components, "GATHER", 4 * 8 * 8 * 5)
    monkeypatch.setattr(components, "STEP", 64)
    r = np.random.default_rng(5)
    x = np.where(r.random((150, 60)) < 0.2, r.random((150, 60)), 0.0) * np.geomspace(9, 0.3, 60)
    rows = spark.createDataFrame([(i, int(i % 5 == 0), [int(j) for j in v.nonzero()[0]], [float(w) for w in v[v.nonzero()]]) for i, v in enumerate(x)], "doc long, label int, indices array<int>, values array<double>")
    got = components.principal_components(rows, 60, block=16, power=12).orderBy("doc").collect()
    parts, train = np.array([g.parts for g in got]), x[np.arange(150) % 5 != 0]
    values, axes = np.linalg.eigh(np.cov(train.T))
    fewest = int((np.cumsum(values[::-1]) / values.sum() <= 0.95).sum()) + 1
    assert fewest <= parts.shape[1] <= fewest + 3 and 0.95 < got[0].kept
    own = parts[np.arange(150) % 5 != 0]
    cov = np.cov(own.T)
    assert close(np.trace(cov) / values.sum(), got[0].kept) and np.allclose(own.mean(0), 0, atol=1e-9)
    assert np.allclose(abs(parts[:, :3]), abs((x - train.mean(0)) @ axes[:, ::-1][:, :3]), atol=1e-3)
    # the same data, whole: as many numbers as NumPy's, and no variance gives no components
    flat = rows.withColumn("indices", F.array(F.lit(0))).withColumn("values", F.array(F.lit(2.0)))
    assert {(len(g.parts), g.kept) for g in components.principal_components(flat, 1).collect()} == {(0, 1.0)}


def test_term_numbers(spark, monkeypatch):
    """Numbers are dense and don't depend on partitions; broadcast and salted vectors are equal; unseen test terms are left out."""
    from reviewloom.operators import components

    terms = spark.createDataFrame([(f"t{i}",) for i in range(500)], "term string")
    a, n = components.term_dictionary(terms.repartition(7))
    b, _ = components.term_dictionary(terms.coalesce(1))
    assert n == 500 and sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and sorted(r.at for r in a.collect()) == list(range(500))
    vectors = spark.createDataFrame([(d, f"t{d % 3 + i}", float(i + 1)) for d in range(8) for i in range(3)] + [(8, "only test", 1.0)], "doc long, term string, w double")
    labels = spark.createDataFrame([(d, int(d > 5)) for d in range(9)] + [(0, 7)], "doc long, label int")
    rows = lambda: sorted((r.doc, r.label, r.size, tuple(r.indices), tuple(r["values"])) for r in components.sparse_vectors(vectors, labels)[0].collect())
    plain = rows()
    assert [r[2] for r in plain] == [5] * 9 and plain[8][3:] == ((), ()) and all(list(r[3]) == sorted(r[3]) for r in plain)
    monkeypatch.setattr(components, "BROADCAST_TERMS", 0)
    assert rows() == plain
