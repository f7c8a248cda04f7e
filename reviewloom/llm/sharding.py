"""Sharding by balanced label propagation, with row counts at most one apart.

Rows that share a link key are neighbours. Linked rows start in shards by a hash; in each round every row
names the shard that holds most of its neighbours (counted per key and shard, never as pairs), and rows of
one bundle move there together as far as the shard's quota of rows has room. Rows without neighbours then
fill the shards to their exact sizes. A key with more rows than a shard holds is first cut into the fewest
parts that fit. Joins on keys and bundles are salted: no task meets all rows of a large one.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import drop_written, release, salted_join, written

SHARDS, ROUNDS, BUCKETS = 24, 4, 1024
#: rows that one window of a distributed rank sorts, on average
RANK_ROWS = 20_000


def _ranked(df: DataFrame, by: list[str], order: str, rows: int, big: DataFrame | None = None) -> DataFrame:
    """Adds `rank` (from 0) within `by`, in the order of a hash of `order`, then `order`, without sorting a whole group in one task.

    big (order, pieces): values of `order` with many rows; they come first, and too many for a window are ranked in pieces.
    """
    buckets = max(16, rows // RANK_ROWS)
    own = F.pmod(F.xxhash64(order), F.lit(buckets))
    if big is None:
        df = df.withColumn("_b", own)
    else:
        piece = F.pmod(F.xxhash64(order, F.pmod(F.xxhash64("rid"), F.col("pieces"))), F.lit(buckets))
        df = df.join(big, order, "left").withColumn("_b", F.when(F.col("pieces").isNull(), own + buckets).otherwise(piece)).drop("pieces")
    counts = df.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    counts = counts.select(*by, "_b", before.alias("_before"))
    inner = F.row_number().over(Window.partitionBy(*by, "_b").orderBy(order, "rid"))
    return df.withColumn("_i", inner).join(counts, [*by, "_b"]).withColumn("rank", F.col("_before") + F.col("_i") - 1).drop("_b", "_i", "_before")


def _moved(wish: DataFrame, room: list[int], r: int, total: int) -> DataFrame:
    """(rid, bundle, shard) after the moves of wish (rid, bundle, shard, to) that the rooms of the shards allow.

    Bundles larger than the room of their shard stay. Larger ones of the rest are taken first, those of like sizes in the
    order of a hash, as long as they fit; sums run over buckets first.
    """
    left = F.element_at(F.array(*[F.lit(max(0, k)) for k in room]), F.col("to") + 1)
    ends = written(wish.groupBy("to", "bundle").agg(F.count_if(F.col("shard") != F.col("to")).alias("n"), F.count(F.lit(1)).alias("rows")), "moves")
    move = ends.where((F.col("n") > 0) & (F.col("n") <= left)).drop("rows")
    move = move.withColumn("b", (64 - F.floor(F.log2("n"))) * BUCKETS + F.pmod(F.xxhash64("bundle", F.lit(r)), F.lit(BUCKETS)))
    upto = Window.partitionBy("to").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    by_bucket = move.groupBy("to", "b").agg(F.sum("n").alias("m")).select("to", "b", (F.sum("m").over(upto) - F.col("m")).alias("before"))
    inner = Window.partitionBy("to", "b").orderBy("bundle").rowsBetween(Window.unboundedPreceding, 0)
    move = move.withColumn("inner", F.sum("n").over(inner)).join(by_bucket, ["to", "b"]).where(F.col("before") + F.col("inner") <= left)
    ends = ends.drop("n").join(move.select("to", "bundle", F.lit(True).alias("took")), ["to", "bundle"], "left")
    new = salted_join(wish, ends, ["to", "bundle"], "rows", total, rows=total)
    return new.select("rid", "bundle", F.when(F.col("took"), F.col("to")).otherwise(F.col("shard")).alias("shard"))


def balanced_shards(rows: DataFrame, links: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, seed: int = 9) -> DataFrame:
    """(rid, shard, slot) for rows (rid, unique) and links (rid, key long): rows that share a key are neighbours.

    Shard sizes differ by one row at most, slots are gapless from 0. No rows: no result. Propagation takes `rounds` rounds at
    most; repair goes on until a round brings next to nothing together.
    """
    total = rows.count()
    cap = total // shards
    sizes = written(links.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    # keys of more than `cap` rows: at most (links / cap) of them, which is `shards` times the keys of a row
    large = written(sizes.where(F.col("n") > cap).select("key", "n", F.ceil(F.col("n") / max(1, cap)).alias("parts")), "large")
    few = links.join(F.broadcast(large), "key", "left_anti")
    small = salted_join(few, sizes.where(F.col("n") <= cap), ["key"], "n", max(total, 1)).select("rid", "key")
    parted = _ranked(links.join(F.broadcast(large), "key"), ["key"], "rid", total).select("rid", F.xxhash64("key", F.expr("rank * parts div n")).alias("key"))
    links = written(small.unionAll(parted), "linked")
    n_links = links.count()
    # parts of large keys, about as many as shards, each start in a shard of their own
    number = F.row_number().over(Window.orderBy("key", "part"))
    starts = large.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).select(F.xxhash64("key", "part").alias("bundle"), ((number - 1) % shards).cast("int").alias("start"))
    label = links.groupBy("rid").agg(F.min("key").alias("bundle")).join(F.broadcast(starts), "bundle", "left")
    label = written(label.select("rid", "bundle", F.coalesce("start", F.pmod(F.xxhash64("rid", F.lit(seed)), F.lit(shards)).cast("int")).alias("shard")), "labels")
    drop_written(sizes, large)

    for r in range(rounds):
        held = links.join(label.select("rid", "shard"), "rid").groupBy("key", "shard").agg(F.count(F.lit(1)).alias("n"))
        if r < rounds // 2:  # first all move at once
            held = held.withColumn("free", F.lit(total).cast("long"))
        else:  # then only to where the rest of the key has room
            load = {x["shard"]: x["n"] for x in label.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per shard
            held = held.withColumn("free", F.element_at(F.array(*[F.lit(max(0, cap - load.get(s, 0))).cast("long") for s in range(shards)]), F.col("shard") + 1))
        # a key's shards: one row of at most `shards` entries
        held = held.groupBy("key").agg(F.sum("n").alias("all"), F.collect_list(F.struct("shard", "n", "free")).alias("held"))
        near = salted_join(links, written(held, "held"), ["key"], "all", n_links, rows=n_links).select("rid", "key", "all", F.explode("held").alias("h"))
        near = near.select("rid", "key", "h.shard", "h.n", (F.col("all") <= F.col("h.n") + F.col("h.free")).alias("fits"))
        near = near.groupBy("rid", "shard").agg(F.bool_and("fits").alias("fits"), F.sum("n").alias("n"), F.max(F.xxhash64("key", "shard")).alias("tie"))
        near = near.groupBy("rid").agg(F.max_by("shard", F.struct("fits", "n", "tie")).alias("to"))
        wish = written(label.join(near, "rid"), "wishes")
        flow = wish.groupBy("shard", "to").agg(F.count(F.lit(1)).alias("n")).collect()  # at most shards ** 2 rows
        if not any(x["shard"] != x["to"] for x in flow):
            drop_written(wish)
            break
        stay = [sum(x["n"] for x in flow if x["shard"] == s and x["to"] == s) for s in range(shards)]
        old, label = label, written(_moved(wish, [cap - k for k in stay], r, n_links), "labels")
        drop_written(old, wish)

    big = label.groupBy("bundle").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > min(RANK_ROWS, max(1, cap // 8)))
    big = written(big.select("bundle", F.ceil(F.col("n") / RANK_ROWS).alias("pieces")), "big")
    big = None if big.isEmpty() else big

    # bundles that a full shard can't hold, or that are still apart, move whole to shards with room
    r, before = 0, None
    while True:
        load = {x["shard"]: x["n"] for x in label.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per shard
        room = [max(0, cap - load.get(s, 0)) for s in range(shards)]
        if not sum(room):
            break
        apart = label.groupBy("bundle").agg((F.min("shard") != F.max("shard")).alias("out"), F.count(F.lit(1)).alias("n"))
        if max(load.values(), default=0) > cap:
            over = _ranked(label, ["shard"], "bundle", total // max(1, shards), big).where(F.col("rank") >= cap).select("bundle", F.lit(True).alias("over"))
            apart = apart.join(over.distinct(), "bundle", "left").select("bundle", "n", (F.col("out") | F.coalesce("over", F.lit(False))).alias("out"))
        apart = written(apart, "apart")
        out = apart.where("out").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if not out or (before is not None and out > before - max(1, before // 1000)):
            drop_written(apart)
            break
        ends = [sum(room[: s + 1]) for s in range(shards)]
        draw = F.pmod(F.xxhash64("bundle", F.lit(100 + r)), F.lit(sum(room)))
        to = F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in ends]), lambda e: e <= draw))
        wish = salted_join(label, apart, ["bundle"], "n", n_links, rows=n_links).select("rid", "bundle", "shard", F.when(F.col("out"), to).otherwise(F.col("shard")).alias("to"))
        wish = written(wish, "wishes")
        old, label = label, written(_moved(wish, room, r, n_links), "labels")
        drop_written(old, wish, apart)
        r, before = r + 1, out

    release(rows.sparkSession)
    # linked rows keep their shard up to its size; all others fill the gaps
    kept = written(_ranked(label, ["shard"], "bundle", total // max(1, shards), big).where(F.col("rank") < cap).select("rid", "shard", F.col("rank").alias("slot")), "kept")
    load = {x["shard"]: x["n"] for x in kept.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per shard
    ends, starts, used, at = [], [], [], 0
    for s in range(shards):
        free = cap + (s < total % shards) - load.get(s, 0)
        starts.append(at)
        at += free
        ends.append(at)
        used.append(load.get(s, 0))
    fill = _ranked(rows.join(kept, "rid", "left_anti").select("rid", F.lit(0).alias("all")), ["all"], "rid", total)
    shard = F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in ends]), lambda e: e <= F.col("rank")))
    fill = fill.withColumn("shard", shard)
    pick = lambda v: F.element_at(F.array(*[F.lit(x).cast("long") for x in v]), F.col("shard") + 1)
    fill = fill.select("rid", "shard", (F.col("rank") - pick(starts) + pick(used)).alias("slot"))
    return kept.select("rid", "shard", F.col("slot").cast("long").alias("slot")).unionAll(fill.select("rid", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot")))


def sharded(docs: DataFrame, shards: int = SHARDS, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """For every row: `row`, size (UTF-8 bytes of the text plus 8; null: 8), text_crc32, shard, slot.

    Rows of equal texts are neighbours, empty texts among them; a null text has no neighbour. Rows that are
    equal in everything are rows of their own. Rows are told apart by their place in their files.
    """
    fields = docs.columns if keep is None else keep
    rows = _numbered(docs, text_col, fields)
    base = rows.select(
        "rid",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.when(F.col("text").isNotNull(), F.xxhash64(F.md5("text"), F.octet_length("text"))).alias("key"),
    )
    base = written(base, "rows")
    out = balanced_shards(base.select("rid"), base.where("key is not null").select("rid", "key"), shards)
    out = base.drop("key").join(out, "rid")
    return rows.select("rid", "row").join(out, "rid").select("row", "size", "text_crc32", "shard", "slot")


def _numbered(docs: DataFrame, text_col: str, fields: list[str]) -> DataFrame:
    """(rid, row, text): rid tells rows apart, the same on every evaluation; columns travel inside row, so no name can clash.

    Rows of Parquet files have their file and their place in it; other rows are numbered and written.
    """
    kept = [F.struct(*[F.col(f"`{c}`") for c in fields]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text")]
    try:
        return docs.select(F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("rid"), *kept)
    except AnalysisException:
        return written(docs.select(F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("row")).alias("rid"), *kept), "numbered")
