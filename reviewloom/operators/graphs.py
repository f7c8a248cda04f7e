"""Graphs as tables of nodes, edges and incidences; matrices in coordinate form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import scratch
from ..sources.readers import dense_numbers
from ..sources.scratch import drop_written, reads, salted_join, written


def add_nodes(rows: DataFrame) -> DataFrame:
    """(id, type, key): nodes of rows (ord, type, key), numbered from 0 in first-seen order."""
    first = rows.groupBy("type", "key").agg(F.min("ord").alias("ord"))
    return dense_numbers(first, "id", "ord", "type", "key").select(F.col("id").cast("long").alias("id"), "type", "key")


def overwrite_nodes(rows: DataFrame) -> DataFrame:
    """(key, value, num_nodes): nodes added without a look at those that are there (ord, key, value): the last value of a key stays, num_nodes counts every add."""
    last = rows.groupBy("key").agg(F.max_by("value", "ord").alias("value"))
    return last.join(F.broadcast(rows.agg(F.count(F.lit(1)).alias("num_nodes"))))  # one row


def node_keys(nodes: DataFrame, kind: str) -> DataFrame:
    """Keys of the nodes (id, type, key) of a kind."""
    return nodes.where(F.col("type") == kind).select("key")


def printed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A line of text for each node (id, type, key) and each edge (type, u, v, weight)."""
    weight = F.format_string("%.2f", F.col("weight"))
    return nodes.select(F.concat_ws(" ", F.lit("node"), "id", "type", "key").alias("line")).unionAll(edges.select(F.concat_ws(" ", F.lit("edge"), "type", "u", "v", weight)))


def calls_summary(calls: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and the largest cost of ordered calls (ord, src, dst, cost, r_cnt).

    Nodes (node, in_cnt, author_cnt, reviewer_cnt) count calls; an edge's weight is that of its last call.
    """
    into = calls.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("in_cnt"), F.sum("r_cnt").alias("reviewer_cnt"))
    out = calls.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("author_cnt"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    nodes = into.join(out, "node", "full").select("node", zero("in_cnt"), zero("author_cnt"), zero("reviewer_cnt"))
    edges = calls.groupBy("src", "dst").agg(F.max_by("cost", "ord").alias("weight"), F.min("ord").alias("ord"))
    return nodes, edges, calls.agg(F.max("cost").alias("max_weight"))


def best_neighbour(edges: DataFrame, marked: DataFrame | None = None) -> DataFrame:
    """(src, dst, weight): the heaviest unmarked neighbour of each node, the first inserted of equals; all marked: no row."""
    if marked is not None:
        edges = edges.join(marked, ["src", "dst"], "left_anti")
    w = Window.partitionBy("src").orderBy(F.desc("weight"), "ord")
    return edges.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("src", "dst", "weight")


def accumulate(edges: DataFrame) -> DataFrame:
    """(type, u, v, weight, description): undirected edges (ord, type, u, v, weight, description); weights add up, the first description stays."""
    e = edges.withColumns({"u": F.least("u", "v"), "v": F.greatest("u", "v")})
    return e.groupBy("type", "u", "v").agg(F.sum("weight").alias("weight"), F.min_by("description", "ord").alias("description"))


def remove_node(incidence: DataFrame, node) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Incidence, node positions and edge positions after a node is gone.

    Edges of more than two members lose it, others go with it. Positions run from 0 without gaps.
    """
    sizes = incidence.groupBy("edge_id").agg(F.count(F.lit(1)).alias("n"), F.max((F.col("node_id") == node).cast("int")).alias("has"))
    gone = sizes.where("has = 1 and n <= 2").select("edge_id")
    left = incidence.where(F.col("node_id") != node).join(gone, "edge_id", "left_anti")
    nodes = dense_numbers(incidence.where(F.col("node_id") != node).select("node_id").distinct(), "position", "node_id")
    return left, nodes, dense_numbers(left.select("edge_id").distinct(), "position", "edge_id")


def degrees(incidence: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Weighted node degrees (node_id, degree) and edge sizes (edge_id, size)."""
    nodes = incidence.join(edges, "edge_id").groupBy("node_id").agg(F.sum("weight").alias("degree"))
    return nodes, incidence.groupBy("edge_id").agg(F.count(F.lit(1)).alias("size"))


def propagation(incidence: DataFrame, edges: DataFrame) -> DataFrame:
    """(u, v, value) of the propagation matrix: sum over common edges of weight / size, over the root of both degrees.

    Rows grow with the squares of edge sizes: pre-aggregate or filter edges of very many members. Where there is an edge of more than
    HEAVY_ROWS members, the pairs of such an edge are made by many tasks. Half of the symmetric matrix is summed, then mirrored.
    """
    degree, size = degrees(incidence, edges)
    share = edges.join(size, "edge_id").select("edge_id", (F.col("weight") / F.col("size")).alias("share"))
    a = incidence.join(share, "edge_id").select("edge_id", F.col("node_id").alias("u"), "share")
    b = incidence.join(size, "edge_id").select("edge_id", F.col("node_id").alias("v"), "size")
    largest, total = size.agg(F.max("size"), F.sum("size")).first()
    pairs = salted_join(a, b, ["edge_id"], "size", total) if (largest or 0) > scratch.HEAVY_ROWS else a.join(b, "edge_id")
    half = pairs.where("u <= v").groupBy("u", "v").agg(F.sum("share").alias("s"))
    half = half.join(degree.select(F.col("node_id").alias("u"), F.col("degree").alias("du")), "u").join(degree.select(F.col("node_id").alias("v"), F.col("degree").alias("dv")), "v")
    half = half.select("u", "v", (F.col("s") / F.sqrt(F.col("du") * F.col("dv"))).alias("value"))
    return half.unionAll(half.where("u < v").select(F.col("v").alias("u"), F.col("u").alias("v"), "value"))


def random_walk(edges: DataFrame, n: int) -> DataFrame:
    """(i, j, value) of the column-normalised walk matrix of edges (ord, u, v, weight) over nodes 0 ... n - 1.

    The last edge of a pair counts; the last row is 0; columns without weight stay 0.
    """
    pair = edges.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.max_by("weight", "ord").alias("weight"))
    cells = pair.select(F.col("u").alias("i"), F.col("v").alias("j"), "weight").unionAll(pair.where("u <> v").select(F.col("v").alias("i"), F.col("u").alias("j"), "weight"))
    cells = cells.where(F.col("i") != n - 1)
    total = cells.groupBy("j").agg(F.sum("weight").alias("t"))  # joined back: a hub's column is no task's alone
    return cells.join(total, "j").where("t <> 0").select("i", "j", (F.col("weight") / F.col("t")).alias("value"))


def modularity(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """One row (q): sum over communities of inner weight / m - (degree / 2m) squared; edges (u, v, weight) undirected, u <> v."""
    e = edges.join(parts.select(F.col("node").alias("u"), F.col("community").alias("cu")), "u").join(parts.select(F.col("node").alias("v"), F.col("community").alias("cv")), "v")
    inner = e.where("cu = cv").groupBy(F.col("cu").alias("c")).agg(F.sum("weight").alias("inner"))
    ends = e.select(F.col("cu").alias("c"), "weight").unionAll(e.select(F.col("cv").alias("c"), "weight")).groupBy("c").agg(F.sum("weight").alias("degree"))
    m = edges.agg(F.sum("weight").alias("m"))
    got = ends.join(inner, "c", "left").crossJoin(F.broadcast(m))
    return got.agg(F.sum(F.coalesce("inner", F.lit(0.0)) / F.col("m") - F.pow(F.col("degree") / (2 * F.col("m")), 2)).alias("q"))


def communities(edges: DataFrame, rounds: int = 20, seed: int = 1) -> DataFrame:
    """(node, community) by label propagation over undirected edges (u, v, weight); written.

    In each round every node of one half, chosen by a hash, takes the heaviest label near it (ties: the
    smallest); halves alternate, so neighbours don't swap for ever. It ends when neither half changes, or after `rounds`.
    Deterministic for a seed.
    """
    both = written(edges.select("u", "v", "weight").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "weight")), "edges")
    label = written(both.select(F.col("u").alias("node")).distinct().withColumn("community", F.col("node")), "labels")
    idle = 0
    for r in range(rounds):
        near = both.join(label.select(F.col("node").alias("v"), "community"), "v").groupBy("u", "community").agg(F.sum("weight").alias("w"))
        best = near.groupBy("u").agg(F.min_by("community", F.struct(-F.col("w"), "community")).alias("new"))
        turn = F.pmod(F.xxhash64(F.col("node"), F.lit(seed)), F.lit(2)) == r % 2
        new = label.select("node", "community").join(best.withColumnRenamed("u", "node"), "node").withColumn("go", turn & (F.col("new") != F.col("community")))
        new = written(new.select("node", F.when(F.col("go"), F.col("new")).otherwise(F.col("community")).alias("community"), "go"), "labels")
        drop_written(label)
        label = new
        idle = 0 if label.where("go").limit(1).count() else idle + 1
        if idle == 2:
            break
    drop_written(both)
    return reads(label.select("node", "community"), label)


def louvain(edges: DataFrame, start: DataFrame | None = None, rounds: int = 8) -> tuple[DataFrame, float]:
    """(node, community), written, and its score: modularity raised by moves of nodes, then of whole communities; edges (u, v, weight) undirected, u <> v.

    start: a partition to begin with (node, community), else each node is alone. In a round every node picks the neighbouring
    community of its largest gain. A move is made if no better one touches the community it leaves or the one it enters: such moves
    share no community, so each adds its whole gain, and the score rises with every round. After `rounds` rounds, or when no move
    is left, communities become nodes; when those find no move, it ends. The score is at least that of start.
    """
    level = written(edges.select("u", "v", "weight"), "level")  # the graph whose nodes move; loops hold inner weight
    nodes = level.select(F.col("u").alias("node")).unionAll(level.select("v")).distinct()
    first = nodes.withColumn("community", F.col("node")) if start is None else nodes.join(start, "node", "left").select("node", F.coalesce("community", "node").alias("community"))
    label = written(first.select(F.col("node").alias("at"), "community"), "label")
    place = written(nodes.select("node", F.col("node").alias("at")), "place")  # node of the graph -> node of the level
    m = level.agg(F.sum("weight")).first()[0] or 0.0
    moved = bool(m)
    while moved:
        both = level.unionAll(level.select(F.col("v").alias("u"), F.col("u").alias("v"), "weight"))
        degree = written(both.groupBy(F.col("u").alias("at")).agg(F.sum("weight").alias("k")), "degrees")
        moved = False
        for _ in range(rounds):
            own = label.join(degree, "at")
            total = own.groupBy("community").agg(F.sum("k").alias("tot"))
            near = both.where("u <> v").join(label.select(F.col("at").alias("v"), "community"), "v").groupBy(F.col("u").alias("at"), "community").agg(F.sum("weight").alias("w"))
            near = near.join(own.select("at", F.col("community").alias("own"), "k"), "at").join(total, "community")
            # gain of standing in a community, the node itself not counted in its total
            value = F.col("w") - F.col("k") * (F.col("tot") - F.when(F.col("community") == F.col("own"), F.col("k")).otherwise(0.0)) / (2 * m)
            near = near.withColumn("value", F.round(value, 9))
            pick = near.groupBy("at").agg(F.max_by("community", F.struct("value", "community")).alias("to"), F.max("value").alias("value"), F.max(F.when(F.col("community") == F.col("own"), F.col("value"))).alias("stay"), F.first("own").alias("own"), F.first("k").alias("k"))
            alone = pick.join(total.withColumnRenamed("community", "own"), "own")
            stay = F.coalesce("stay", F.round(-F.col("k") * (F.col("tot") - F.col("k")) / (2 * m), 9))
            moves = written(alone.select("at", "own", "to", (F.col("value") - stay).alias("gain")).where("gain > 1e-9"), "moves")
            best = moves.select("at", "gain", F.explode(F.array("own", "to")).alias("c")).groupBy("c").agg(F.max_by("at", F.struct("gain", "at")).alias("at"))
            go = moves.join(best.groupBy("at").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("at"), "at").select("at", "to")
            some = moves.limit(1).count() > 0
            if some:
                new = written(label.join(go, "at", "left").select("at", F.coalesce("to", "community").alias("community")), "label")
                drop_written(label)
                label, moved = new, True
            drop_written(moves)
            if not some:
                break
        onward = written(place.join(label, "at").select("node", F.col("community").alias("at")), "place")
        ends = level.join(label.select(F.col("at").alias("u"), F.col("community").alias("cu")), "u").join(label.select(F.col("at").alias("v"), F.col("community").alias("cv")), "v")
        above = written(ends.groupBy(F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v")).agg(F.sum("weight").alias("weight")), "level")
        fewer = label.agg(F.count(F.lit(1)) > F.count_distinct("community")).first()[0]  # a start that joins nodes
        drop_written(level, place, degree, label)
        level, place, moved = above, onward, moved or fewer
        label = written(place.select("at").distinct().withColumn("community", F.col("at")), "label")
    score = modularity(level, label.select(F.col("at").alias("node"), "community")).first().q if m else 0.0  # that of a level is that of the graph
    out = written(place.select("node", F.col("at").alias("community")), "communities")
    drop_written(level, place, label)
    return out, score


def nodes_by_key(nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """keys (type, key) with the id of their node, null where there is none."""
    return keys.join(nodes.select("type", "key", "id"), ["type", "key"], "left")


def nodes_by_id(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """ids (id) with type and key of their node, null where there is none."""
    return ids.join(nodes, "id", "left")


def edges_by_ends(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (type, u, v), in any order of their ends, with the weight of their undirected edge, null where there is none."""
    ends = [F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")]
    return pairs.select("type", *ends).join(edges.select("type", *ends, "weight"), ["type", "u", "v"], "left")


def neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, neighbour, weight) of the edges (src, dst, weight) that leave nodes (node)."""
    return nodes.join(edges.select(F.col("src").alias("node"), F.col("dst").alias("neighbour"), "weight"), "node")


def edge_weights(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (src, dst) with held (whether the graph has that edge) and its weight."""
    got = pairs.join(edges.select("src", "dst", "weight", F.lit(True).alias("held")), ["src", "dst"], "left")
    return got.select("src", "dst", F.coalesce("held", F.lit(False)).alias("held"), "weight")
