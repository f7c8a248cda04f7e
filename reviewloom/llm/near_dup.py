"""MinHash near-duplicate detection with odd sketches.

1. Every text becomes its set of word shingles. From the set come its size, a 128-bit fingerprint, BANDS
   keys of ROWS MinHash values each, and an odd sketch: every MinHash value flips one bit of a bitmap, so
   that the XOR of two bitmaps marks the values in which the samples differ, and its population count
   estimates the similarity.
2. Texts of equal sets form a class; a vertex (its smallest id, its fingerprint) stands for it from here on. Rows that
   share an id but not the set are vertices of their own.
3. Classes that share a band key are linked to the smallest class of that key (a star, not all pairs).
   Star links whose sketches differ too much are dropped; the others are confirmed on the full sets.
4. Connected components join the confirmed links. A key whose classes are all in one component needs no
   more. In the others, sketches are compared across components, in pairs of blocks of bounded size, which
   gives clusters. Within a cluster that holds several components, full sets are compared wherever sketches
   pass, again by blocks. A task returns only as many links as connect what it found, never all pairs.

A pair at the threshold of 0.8 shares no key with probability (1 - 0.8 ** 4) ** 32 < 5e-8, and its sketches
differ beyond MAX_FLIPS about as rarely (over five standard deviations).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .components import connected_components
from .shared import drop_written, release, salted_join, ship, written

U = np.uint64
HAS_WORD = r"[^\x20\x09-\x0D]"
BANDS, ROWS, SKETCH_BITS = 32, 4, 512
#: least threshold that bands and MAX_FLIPS are proven for
LEAST_PERCENT = 80
#: XOR bits at which the sketch estimate of the similarity is about 0.5
MAX_FLIPS = 100
#: classes of a key whose sketches one task compares with as many others; for full sets: classes, and shingles of theirs
BLOCK, SET_BLOCK, BLOCK_SHINGLES = 512, 1024, 2_000_000
#: ids up to this many (16 MB) are broadcast to select texts; more are joined by shuffle
BROADCAST_IDS = 2_000_000


def shingle_sets(arr: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and their n + 1 bounds.

    A text of fewer words than `width`, but not none, has its whole sequence as its one shingle.
    """
    buf, offs = tv.pack(arr)
    buf = tv.LOWER[buf]
    starts, ends, first = tv.word_bounds(buf, offs, tv.NOT_SPACE)
    h = tv.word_hashes(buf, starts, ends)
    n = np.diff(first)
    salt = tv.randoms(7, width + 1)
    parts, sizes = [], np.zeros(len(arr), np.int64)
    if len(h) >= width:
        s = h[: len(h) - width + 1] * salt[0]
        for k in range(1, width):
            s = tv.mix(s) + h[k : len(h) - width + 1 + k] * salt[k]
        s = tv.mix(s)
    for i in range(len(arr)):
        a, b = first[i], first[i + 1]
        if n[i] >= width:
            u = np.unique(s[a : b - width + 1])
        elif n[i]:
            x = tv.mix(np.array([int(n[i])], dtype=U) * salt[width])
            for k in range(a, b):
                x = tv.mix(x) + h[k : k + 1] * salt[k - a]
            u = tv.mix(x)
        else:
            continue
        parts.append(u)
        sizes[i] = len(u)
    flat = np.concatenate(parts) if parts else np.zeros(0, U)
    return flat, np.concatenate([[0], np.cumsum(sizes)])


def signatures(flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints (n, 2), band keys (n, BANDS) and odd sketches (n, SKETCH_BITS / 64) of non-empty sets."""
    n, at = len(bounds) - 1, bounds[:-1]
    with np.errstate(over="ignore"):
        fp = np.stack([np.add.reduceat(tv.mix(flat ^ k), at) for k in tv.randoms(11, 2)], axis=1)
        mult, salt = tv.randoms(1, BANDS * ROWS) | U(1), tv.randoms(2, BANDS * ROWS)
        bands = np.empty((n, BANDS), U)
        sketch = np.zeros((n, SKETCH_BITS // 64), U)
        rows = np.arange(n)
        tmp = np.empty_like(flat)
        for band in range(BANDS):
            key = np.full(n, salt[band], U)
            for i in range(band * ROWS, band * ROWS + ROWS):
                np.multiply(flat, mult[i], out=tmp)
                least = np.minimum.reduceat(tmp, at)
                key = tv.mix(key ^ least) + salt[i]
                bit = tv.mix(least ^ salt[i])
                sketch[rows, (bit >> U(6)) % U(SKETCH_BITS // 64)] ^= U(1) << (bit & U(63))
            bands[:, band] = key
    return fp, bands, sketch


def _lists(a: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32)), pa.array(a.reshape(-1).view(np.int64)))


def sign(docs: DataFrame, width: int) -> DataFrame:
    """(id, th, n_shingles, fp, bands, sketch) of docs (id, th, text); empty sets have null lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = tv.text_column(batch, "text")
            for lo, hi in tv.slices(texts):
                flat, bounds = shingle_sets(texts.slice(lo, hi - lo), width)
                sizes = np.diff(bounds)
                full = np.flatnonzero(sizes)
                cols = [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(sizes)]
                if len(full):
                    fp, bands, sketch = signatures(flat, np.concatenate([bounds[:-1][full], bounds[-1:]]))
                    take = np.full(len(sizes), -1)
                    take[full] = np.arange(len(full))
                    index = pa.array(take, mask=take < 0)
                    cols += [_lists(x).take(index) for x in (fp, bands, sketch)]
                else:
                    cols += [pa.nulls(len(sizes), pa.list_(pa.int64()))] * 3
                yield pa.RecordBatch.from_arrays(cols, ["id", "th", "n_shingles", "fp", "bands", "sketch"])

    return docs.select("id", "th", "text").mapInArrow(run, "id long, th long, n_shingles long, fp array<long>, bands array<long>, sketch array<long>")


def sets_of(docs: DataFrame, width: int) -> DataFrame:
    """(id, tag, shingles) of docs (id, text): tag is the first half of the set's fingerprint."""
    salt = tv.randoms(11, 2)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = tv.text_column(batch, "text")
            for lo, hi in tv.slices(texts):
                flat, bounds = shingle_sets(texts.slice(lo, hi - lo), width)
                full, tag = np.diff(bounds) > 0, np.zeros(hi - lo, U)
                if full.any():
                    with np.errstate(over="ignore"):
                        tag[full] = np.add.reduceat(tv.mix(flat ^ salt), bounds[:-1][full])
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(tag.view(np.int64)), lists], ["id", "tag", "shingles"])

    return docs.select("id", "text").mapInArrow(run, "id long, tag long, shingles array<long>")


def _sets(texts: DataFrame, need: DataFrame, width: int, repeated: bool) -> DataFrame:
    """need (v, ...; a written table, one row for each vertex) with the vertices' shingles; repeated: whether equal rows are there."""
    few = F.broadcast if need.count() <= BROADCAST_IDS else (lambda x: x)
    some = texts.join(few(need.select(F.col("v.id").alias("id")).distinct()), "id", "left_semi")
    # sets of an id's other texts meet no vertex
    got = sets_of(some, width).select(F.struct("id", "tag").alias("v"), "shingles").join(few(need), "v")
    return got.dropDuplicates(["v"]) if repeated else got


def flips(a: str, b: str):
    """Population count of the XOR of two sketches."""
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(SKETCH_BITS // 64)), F.lit(0))


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int, repeated: bool) -> DataFrame:
    """Those of pairs (a, b; a written table) whose full sets reach the threshold: 100 * intersection >= percent * union."""
    ends = pairs.select(F.col("a").alias("v"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(pairs.select("b", F.lit(0), F.lit(1)))
    need = written(ends.groupBy("v").agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b")), "needed")
    sets, total = written(_sets(texts, need, width, repeated), "sets"), pairs.count()
    got = salted_join(pairs, sets.select(F.col("v").alias("b"), F.col("shingles").alias("sb"), "n_b").where("n_b > 0"), ["b"], "n_b", total)
    got = salted_join(got.select("a", "b", "sb"), sets.select(F.col("v").alias("a"), F.col("shingles").alias("sa"), "n_a").where("n_a > 0"), ["a"], "n_a", total)
    both = F.size(F.array_intersect("sa", "sb"))
    got = got.select("a", "b", (F.size("sa") + F.size("sb")).alias("n"), both.alias("i")).where(100 * F.col("i") >= percent * (F.col("n") - F.col("i"))).select("a", "b")
    out = written(got, "links")
    drop_written(need, sets)
    return out


def _in_blocks(rows: DataFrame, group: str, size: int, columns: list[str]) -> DataFrame:
    """Deals rows (group, v, n_shingles, ...; a written table) to tasks (group, x, y), one for every pair of blocks of a group.

    A block holds `size` rows or BLOCK_SHINGLES shingles at most, about: no task gathers a whole group.
    """
    sized = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.sum("n_shingles").alias("_s"))
    sized = sized.withColumn("_blocks", F.greatest(F.lit(1), F.ceil(F.col("_n") / size), F.ceil(F.col("_s") / BLOCK_SHINGLES)).cast("int"))
    n = rows.count()
    dealt = salted_join(rows, sized, [group], "_n", n, rows=n).withColumn("own", F.pmod(F.xxhash64("v"), F.col("_blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return dealt.select(group, F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", F.col("v.id").alias("id"), F.col("v.tag").alias("tag"), F.col("component.id").alias("c_id"), F.col("component.tag").alias("c_tag"), *columns)


def _sides(t: pa.Table):
    own, x, y = (t.column(c).to_numpy() for c in ("own", "x", "y"))
    left = np.flatnonzero(own == x[0])
    right = left if x[0] == y[0] else np.flatnonzero(own != x[0])
    sk = t.column("sketch").combine_chunks().flatten().to_numpy().view(U).reshape(len(own), -1)
    pair = lambda a, b: np.stack([t.column(a).to_numpy(), t.column(b).to_numpy()], axis=1)
    _, comp = np.unique(pair("c_id", "c_tag"), axis=0, return_inverse=True)
    return left, right, pair("id", "tag"), comp.reshape(-1).copy(), sk


_EDGE = "a_id long, a_tag long, b_id long, b_tag long"


def _edges(ids: np.ndarray, found: list[tuple[int, int]]) -> pa.Table:
    a, b = np.array(found, np.int64).reshape(-1, 2).T
    return pa.table({"a_id": ids[a, 0], "a_tag": ids[a, 1], "b_id": ids[b, 0], "b_tag": ids[b, 1]})


def _as_links(edges: DataFrame) -> DataFrame:
    a, b = F.struct(F.col("a_id").alias("id"), F.col("a_tag").alias("tag")), F.struct(F.col("b_id").alias("id"), F.col("b_tag").alias("tag"))
    return edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _linked(t: pa.Table, test) -> pa.Table:
    """Links between rows of different components: as few as connect what all links of the two blocks connect.

    test(i, js) says which of the rows js are linked with row i; only rows whose sketches pass are asked about.
    """
    left, right, ids, comp, sk = _sides(t)
    found = []
    for i in left:
        near = right[(comp[right] != comp[i]) & (np.bitwise_count(sk[right] ^ sk[i]).sum(axis=1) <= MAX_FLIPS)]
        for j in test(i, near) if len(near) else ():
            if comp[j] != comp[i]:
                found.append((i, j))
                comp[comp == comp[j]] = comp[i]
    return _edges(ids, found)


def sketch_links(members: DataFrame) -> DataFrame:
    """Links (a, b) that connect, within each key, the rows whose sketches pass. members: key, v, component, sketch."""
    dealt = _in_blocks(members.withColumn("n_shingles", F.lit(0)), "key", BLOCK, ["sketch"])
    return _as_links(dealt.groupBy("key", "x", "y").applyInArrow(lambda t: _linked(t, lambda i, js: js), _EDGE))


def full_links(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect, within each cluster, the rows whose full sets reach the threshold.

    members: cluster, v, n_shingles, component, sketch, shingles.
    """

    def compare(t: pa.Table) -> pa.Table:
        left, right, _, _, _ = _sides(t)
        col = t.column("shingles").combine_chunks()
        flat, bounds = col.flatten().to_numpy(), col.offsets.to_numpy() - col.offsets[0].as_py()
        size = np.diff(bounds)
        # which rows of the right side hold a shingle
        at = np.repeat(np.arange(len(right)), size[right])
        values = np.concatenate([flat[bounds[j] : bounds[j + 1]] for j in right])
        order = np.argsort(values, kind="stable")
        values, at = values[order], at[order]
        place = np.full(len(size), -1)
        place[right] = np.arange(len(right))

        def test(i, js):
            own = flat[bounds[i] : bounds[i + 1]]
            lo, hi = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
            n = hi - lo
            hits = at[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            both = np.bincount(hits, minlength=len(right))[place[js]]
            return js[100 * both >= percent * (size[i] + size[js] - both)]

        return _linked(t, test)

    return _as_links(_in_blocks(members, "cluster", SET_BLOCK, ["sketch", "shingles"]).groupBy("cluster", "x", "y").applyInArrow(compare, _EDGE))


def _differ(vertex: str):
    """Whether a group holds several vertices, from plain numbers."""
    return (F.min(f"{vertex}.id") != F.max(f"{vertex}.id")) | (F.min(f"{vertex}.tag") != F.max(f"{vertex}.tag"))


def groups(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(id, th, n_shingles, component) of every row: th is a hash of its text, component the least vertex (id, tag) reachable.

    Rows with an empty set or a null id have a null component.
    """
    if percent < LEAST_PERCENT:
        raise ValueError(f"percent {percent}: bands and sketches find links of {LEAST_PERCENT} percent or more only")
    ship(docs.sparkSession)
    text = F.col(f"`{text_col}`").cast("string")
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    sig = written(sign(texts, width), "signatures")
    full = sig.where("n_shingles > 0 and id is not null")
    repeated = not full.groupBy("id", F.col("fp")[0].alias("tag")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    # classes of equal sets: their rows agree in everything but the id
    classes = full.groupBy("fp", "n_shingles").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("rows"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = written(classes.select("fp", "n_shingles", "rows", F.struct("id", F.col("fp")[0].alias("tag")).alias("v"), "bands", "sketch"), "classes")
    keyed = classes.select("v.id", "v.tag", F.posexplode("bands").alias("band", "key")).select(F.xxhash64("band", "key").alias("key"), "id", "tag")
    # plain numbers, so that sums run in hash tables; of two vertices of one id either may be the centre of the star
    low = keyed.groupBy("key").agg(F.struct(F.min("id").alias("id"), F.min_by("tag", "id").alias("tag")).alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1")
    low, n_classes = written(low, "lows"), classes.count()
    shared = salted_join(keyed, low, ["key"], "n", BANDS * n_classes, rows=low.count()).select("key", F.struct("id", "tag").alias("v"), "low", "n")
    shared = written(shared.distinct(), "keys")
    sketches = classes.select("v", "sketch")

    star = written(shared.where("v <> low").select(F.col("low").alias("a"), F.col("v").alias("b")).distinct(), "stars")
    ends = star.groupBy("a").agg(F.count(F.lit(1)).alias("n")).join(sketches.select(F.col("v").alias("a"), F.col("sketch").alias("ka")), "a")
    n_star = star.count()
    near = salted_join(star, ends, ["a"], "n", n_star, rows=2 * n_star).join(sketches.select(F.col("v").alias("b"), F.col("sketch").alias("kb")), "b")
    pairs = written(near.where(flips("ka", "kb") <= MAX_FLIPS).select("a", "b"), "pairs")
    texts = texts.where("id is not null")
    links = confirmed(pairs, texts, width, percent, repeated)
    comp = connected_components(links)
    drop_written(low, star, pairs)
    release(docs.sparkSession)

    # keys whose classes are not yet in one component; pairs with the smallest class have been tried
    of = comp.select(F.col("id").alias("v"), "component")
    at = written(shared.where("n > 2").join(of, "v", "left").select("key", "v", F.coalesce("component", "v").alias("component")), "placed")
    keys = at.groupBy("key").agg(_differ("component").alias("open"), F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("v").cast("decimal(38,0)")).alias("set"))
    keys = keys.where("open").groupBy("n", "set").agg(F.min("key").alias("key")).select("key", "n")  # equal keys once
    n_at = at.count()
    members = written(salted_join(at, keys, ["key"], "n", n_at, rows=n_at).join(sketches, "v").select("key", "v", "component", "sketch"), "members")
    # clusters: what passing sketches and components connect; only there can further links be
    alike = sketch_links(members)
    cluster = connected_components(alike.unionAll(comp.where("id <> component").select(F.col("component").alias("a"), F.col("id").alias("b"))))
    inside = written(cluster.select(F.col("id").alias("v"), F.col("component").alias("cluster")).join(of, "v", "left").select("v", "cluster", F.coalesce("component", "v").alias("component")), "inside")
    several = inside.groupBy("cluster").agg(_differ("component").alias("open"), F.count(F.lit(1)).alias("n")).where("open").select("cluster", "n")
    n_inside = inside.count()
    need = written(salted_join(inside, several, ["cluster"], "n", n_inside, rows=n_inside).drop("n"), "several")
    sets = written(_sets(texts, need, width, repeated).join(sketches, "v").withColumn("n_shingles", F.size("shingles")), "sets")
    more = written(full_links(sets, percent), "more")
    drop_written(shared, at, members, cluster, inside, need, sets, comp)
    comp = connected_components(links.unionAll(more))
    drop_written(links, more)
    release(docs.sparkSession)

    found = classes.join(comp.withColumnRenamed("id", "v"), "v", "left").select("fp", "n_shingles", "rows", F.coalesce("component", "v").alias("component"))
    out = salted_join(full.select("id", "th", "fp", "n_shingles"), found, ["fp", "n_shingles"], "rows", sig.count(), rows=n_classes).select("id", "th", "n_shingles", "component")
    rest = sig.where("n_shingles = 0 or id is null").select("id", "th", "n_shingles", F.lit(None).cast(out.schema["component"].dataType))
    return out.unionAll(rest)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id) of every row.

    Rows are linked when their sets of `width`-word shingles (words lower-cased in A-Z, split at white
    space) have 100 * intersection >= percent * union; component_id is the smallest id reachable.
    Null and empty texts have empty sets and are linked with nothing. Ids must be integers. Rows that share an id are linked
    by their texts alone, like others; a null id is its own component (null).
    Other columns are not read, whatever their names. A percent under LEAST_PERCENT is an error: links would be missed.
    """
    got = groups(docs, width, percent, id_col, text_col)
    return got.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component.id", "id").alias("component_id"))


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each group of near-duplicates, that of the smallest id (ties: by a hash of the text).

    Rows with an empty or null text, and rows without an id, stay. Rows that share an id but not the text are told apart: each
    stays or goes with its own group. Of rows equal in id and text one stays, whichever: they differ in other columns only.
    """
    got = written(groups(docs, width, percent, id_col, text_col).where("component is not null").select("id", "th", "component"), "groups")
    kept = written(got.groupBy("component").agg(F.min(F.struct("id", "th")).alias("who")).select(F.col("who.id").alias("_id"), F.col("who.th").alias("_th")).distinct(), "kept")
    repeated = not got.groupBy("id", "th").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    drop_written(got)
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("_id"), F.xxhash64(text).alias("_th"), F.coalesce(F.rlike(text, F.lit(HAS_WORD)), F.lit(False)).alias("_full"))
    found = rows.where("_full and _id is not null").join(kept, ["_id", "_th"], "left_semi")
    if repeated:
        found = found.withColumn("_n", F.row_number().over(Window.partitionBy("_id", "_th").orderBy("_id"))).where("_n = 1")
    return found.select("row.*").unionAll(rows.where("not _full or _id is null").select("row.*"))
