"""Mixing sources to target weights, with DataFrame and SQL functions only.

Targets: a share of all words is dealt to the sources by weight; no source gets more than `cap` times its own
words, what it can't take is dealt to the others again.

Draws: the rows of a source stand in the order of a hash of their id, cut into blocks by its leading bits. A source gives whole passes over its blocks, then one part of a pass, up to the row at which the target is
met most closely. That row is found by descending through the leading bits: sums of blocks, sums of blocks
within the one where the target lies, then a window over the few rows left. No step sorts a whole source.

Shards: the blocks of all passes are dealt to 2 ** depth output shards by a splitting tree; depth grows with the words of
the mix. Each node holds a quota of blocks for every source; an urn draw (multivariate hypergeometric) splits them
exactly between two children of equal totals: the node's quota units stand in the order of a hash, the first half goes
left. A leaf's quota names a range of the source's permuted blocks; ranges are disjoint. Each shard is one partition of
the mix, whose rows are ordered by a hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import drop_written, release, written

WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2.0
#: words of an output shard, about; bounds of the depth (2 ** depth shards); a source has 2 ** (depth + BLOCK_BITS) blocks
SHARD_WORDS, DEPTHS, BLOCK_BITS, HASH_BITS = 2_000_000, (5, 18), 5, 60
#: tables of sources and block plans of up to this many rows are broadcast (under 50 MB); larger ones are joined by shuffle
BROADCAST_ROWS = 500_000
#: quota units of a node that one window orders; larger nodes are cut at a count of buckets first
NODE_UNITS = 32_768


def depth_for(words: float) -> int:
    """Depth of the tree for a mix of so many words: shards of SHARD_WORDS words at most, within DEPTHS."""
    depth, most = DEPTHS
    while depth < most and SHARD_WORDS * 2.0**depth < words:
        depth += 1
    return depth


def n_words(text):
    """Number of words between white space (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def _hash(*parts):
    """60 bits of md5: SQL engines agree on it."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, HASH_BITS // 4), 16, 10).cast("long")


def _order(doc_id, seed: int):
    return _hash(F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null")))


def _key(source):
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def _block(h, level: int, bits: int):
    return F.shiftright(h, HASH_BITS - bits * (level + 1))


def _small(df: DataFrame) -> DataFrame:
    """A written table with a broadcast hint if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(key, source_size, target) from (key, source, source_size); one row per source.

    Sources by code point, null last, weigh `weights`, repeating. Windows run over one row per source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    t = sizes.withColumn("rank", F.row_number().over(by_name))
    t = t.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    t = t.withColumn("top", F.lit(float(cap)) * F.col("source_size"))
    order = Window.orderBy(F.col("top") / F.col("w"), "rank")
    whole = Window.partitionBy()
    t = t.withColumn("total", F.lit(float(share)) * F.sum("source_size").over(whole)).withColumn("pos", F.row_number().over(order))
    t = t.withColumn("before", F.coalesce(F.sum("top").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("after", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    open_ = (F.col("total") - F.col("before")) * F.col("w") < F.col("top") * F.col("after")
    t = t.withColumn("k", F.min(F.when(open_, F.col("pos"))).over(whole))
    at_k = lambda c: F.max(F.when(F.col("pos") == F.col("k"), F.col(c))).over(whole)
    t = t.withColumn("rest", at_k("total") - at_k("before")).withColumn("wsum", at_k("after"))
    target = F.when(F.col("k").isNull() | (F.col("pos") < F.col("k")), F.col("top")).otherwise(F.col("rest") * F.col("w") / F.col("wsum"))
    return t.select("key", "source_size", target.alias("target"))


def _split(units: DataFrame, depth: int, seed: int) -> DataFrame:
    """(shard, key, quota): quota units (key, i) dealt to 2 ** depth leaves of equal totals.

    A node's units stand in the order of a hash of their own, the first half goes to the left child: of each source that
    takes a hypergeometric number. Nodes of more than NODE_UNITS units are halved at the count of hash buckets, and only the
    bucket where the half lies is ordered: no task orders a whole large node.
    """
    n = units.count()
    nodes = units.select("key", "i", F.lit(0).cast("long").alias("node"))
    for level in range(depth):
        h = _hash(F.lit(str(seed)), F.lit("tree"), F.lit(str(level)), F.col("node").cast("string"), "key", F.col("i").cast("string"))
        nodes = nodes.withColumn("h", h)
        if n >> level > NODE_UNITS:
            bits = ((n >> level) // NODE_UNITS).bit_length() + 4  # at most 32 buckets for NODE_UNITS units
            nodes = written(nodes.withColumn("bucket", F.shiftright("h", HASH_BITS - bits)), "nodes")
            run = Window.partitionBy("node").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
            sums = nodes.groupBy("node", "bucket").agg(F.count(F.lit(1)).alias("c"))
            sums = sums.withColumn("upto", F.sum("c").over(run)).withColumn("half", F.floor(F.sum("c").over(Window.partitionBy("node")) / 2))
            sums = sums.select("node", "bucket", (F.col("half") - (F.col("upto") - F.col("c"))).alias("left"), "c")
            rank = F.row_number().over(Window.partitionBy("node", "bucket").orderBy("h", "key", "i"))
            part = nodes.join(_small(written(sums, "sums")), ["node", "bucket"])
            open_ = part.where("left > 0 and left < c").withColumn("right", rank > F.col("left"))
            part = part.where("left <= 0 or left >= c").withColumn("right", F.col("left") <= 0).unionByName(open_)
        else:
            whole = Window.partitionBy("node")
            rank = F.row_number().over(whole.orderBy("h", "key", "i"))
            part = nodes.withColumn("rank", rank).withColumn("right", F.col("rank") > F.floor(F.count(F.lit(1)).over(whole) / 2))
        nodes = part.select("key", "i", (2 * F.col("node") + F.col("right").cast("long")).alias("node"))
    return nodes.groupBy(F.col("node").cast("int").alias("shard"), "key").agg(F.count(F.lit(1)).alias("quota"))


def _planned(docs: DataFrame, weights, share: float, cap: float, seed: int, depth: int | None, source_col: str, keep: list[str] | None) -> tuple[DataFrame, int]:
    fields = docs.columns if keep is None else keep
    row = F.struct(*[F.col(f"`{c}`") for c in fields]).alias("row")
    text = F.col("text").cast("string")
    rows = docs.select(
        row,
        F.col("doc_id").cast("string").alias("id"),
        _key(F.col(source_col)).alias("key"),
        F.col(source_col).cast("string").alias("source"),
        text.alias("text"),
        _order(F.col("doc_id"), seed).alias("h"),
    ).withColumn("size", n_words(F.col("text")))
    # where the text isn't asked for, its words are counted once and rows are taken from here
    light = "text" not in fields
    base = written(rows.select(*(["row"] if light else []), "key", "source", "size", "h", "id"), "sizes")
    sizes = base.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    sources = targets(sizes, weights, share, cap)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    sources = written(sources.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")), "sources")
    if depth is None:
        depth = depth_for(share * (sources.agg(F.sum("source_size")).first()[0] or 0))
    bits = depth + BLOCK_BITS
    blocks = written(base.groupBy("key", _block(F.col("h"), 0, bits).alias("b")).agg(F.sum("size").alias("words")), "blocks")

    # the part of a pass: descend to the row where the rest is met
    def boundary(sums: DataFrame, rest: DataFrame, name: str) -> DataFrame:
        run = Window.partitionBy("key").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
        t = sums.join(rest, "key").withColumn("upto", F.sum("words").over(run))
        t = t.where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("words") < F.col("rest")))
        return t.select("key", F.col("b").alias(name), (F.col("rest") - (F.col("upto") - F.col("words"))).alias("rest"))

    first = written(boundary(blocks.select("key", "b", "words"), sources.where("rest > 0").select("key", "rest"), "b"), "first")
    inner = base.withColumn("b", _block(F.col("h"), 0, bits)).join(_small(first).select("key", "b"), ["key", "b"], "left_semi").drop("b")
    second = written(boundary(inner.groupBy("key", _block(F.col("h"), 1, bits).alias("b")).agg(F.sum("size").alias("words")), first.select("key", "rest"), "p"), "second")
    last = base.withColumn("p", _block(F.col("h"), 1, bits)).join(_small(second), ["key", "p"])
    # rows of one place and size are one step
    steps = last.groupBy("key", "p", "rest", "h", "id", "size").agg(F.sum("size").alias("words"))
    run = Window.partitionBy("key").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumn("upto", F.sum("words").over(run)).where(F.col("upto") - F.col("words") / 2 <= F.col("rest"))
    cuts = second.join(steps.groupBy("key").agg(F.max(F.struct("h", "id", "size")).alias("cut")), "key", "left").select("key", "p", "cut")

    # every pass over every block, permuted within its source, goes to a shard
    cuts = written(cuts, "cuts")
    of = sources.join(cuts, "key", "left").select("key", "source_size", "target", "passes", "p", "cut")
    copies = blocks.join(of.select("key", "passes", "p"), "key").select("key", "b", F.explode(F.sequence(F.lit(0), F.col("passes"))).alias("copy"), "passes", "p")
    copies = copies.where((F.col("copy") < F.col("passes")) | (F.col("b") <= F.shiftright("p", bits)))
    place = _hash(F.lit(str(seed)), F.lit("block"), "key", F.col("b").cast("string"), F.col("copy").cast("string"))
    permuted = copies.select("key", "b", "copy", F.row_number().over(Window.partitionBy("key").orderBy(place, "b", "copy")).cast("long").alias("i"))
    permuted = written(permuted, "permuted")
    leaves = _split(permuted.select("key", "i"), depth, seed)
    ends = F.sum("quota").over(Window.partitionBy("key").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    leaves = leaves.withColumn("end", ends).select("key", "shard", F.explode(F.sequence(F.col("end") - F.col("quota") + 1, F.col("end"))).alias("i"))
    # the shards of a block's copies, in their order
    plan = permuted.join(leaves, ["key", "i"]).groupBy("key", "b").agg(F.transform(F.array_sort(F.collect_list(F.struct("copy", "shard"))), lambda x: x["shard"]).alias("plan"))
    plan = written(blocks.select("key", "b").join(plan, ["key", "b"], "left"), "plan")
    of = written(of, "of")

    if light:
        rows = base
    got = rows.withColumn("b", _block(F.col("h"), 0, bits)).join(_small(plan), ["key", "b"]).join(_small(of), "key")
    place, cut = _block(F.col("h"), 1, bits), F.col("cut")
    # words are counted for the tie alone, unless the size is asked for
    to_cut = (F.struct("h", "id") < F.struct(cut["h"].alias("h"), cut["id"].alias("id"))) | ((F.col("h") == cut["h"]) & F.col("id").eqNullSafe(cut["id"]) & (F.col("size") <= cut["size"]))
    in_part = (place < F.col("p")) | ((place == F.col("p")) & to_cut)
    got = got.withColumn("part", F.coalesce(in_part, F.lit(False)))
    draws = F.expr("filter(transform(coalesce(plan, array()), (s, i) -> struct(i as copy, s as shard)), x -> x.copy < passes or part)")
    order = lambda x: _hash(F.lit(str(seed)), F.lit("row"), x["shard"].cast("string"), x["copy"].cast("string"), F.col("h").cast("string"))
    draws = F.transform(draws, lambda x: F.struct(x["copy"].alias("copy"), x["shard"].alias("shard"), order(x).alias("order_key")))
    drop_written(first, second, blocks, permuted, cuts, sources)
    release(docs.sparkSession)
    return got.select("row", "size", "source_size", "target", draws.alias("draws")), depth


def planned(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 7, depth: int | None = None, source_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """For every row: `row`, size, source_size, target and draws, an array of (copy, shard, order_key).

    size is the number of words (null and empty texts: 0; such rows are drawn like others). A null source is a
    source. A source without words has the target 0. Rows are drawn whole, at most ceil(cap) times; a source's
    words differ from its target by half of one row at most. A repeated id has the same place in the order;
    ties go by size, then equal rows share their fate or, at the very end of the draw, all of them are taken
    or none. Needs the columns doc_id, text and source. Results depend on the seed and the data only.
    """
    return _planned(docs, weights, share, cap, seed, depth, source_col, keep)[0]


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 7, depth: int | None = None, source_col: str = "source") -> DataFrame:
    """The mix itself: the rows of docs, repeated as drawn. Partition k holds shard k, in the order of the local shuffle."""
    got, depth = _planned(docs, weights, share, cap, seed, depth, source_col, None)
    drawn = got.select("row", F.explode("draws").alias("draw"))
    dealt = drawn.repartitionById(1 << depth, F.col("draw.shard")).sortWithinPartitions("draw.order_key")
    return dealt.select("row.*")
