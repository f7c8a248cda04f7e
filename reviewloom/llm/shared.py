"""What the operators share: the shared folder, written tables, bounded labelled samples."""

from __future__ import annotations

import ctypes
import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import drop_written, new_path, salted_join, shared_dir, ship, written  # noqa: F401


def fold(doc_id: str, parts: int):
    """crc32 of the id as text, modulo parts (null id: fold of the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % F.lit(parts)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, keep=None) -> list[tuple[str, int]]:
    """At most `bound` labelled (text, label) rows, chosen by a hash of the id: the same rows on every run.

    Conflicting or repeated labels of an id: the largest. Null ids and null labels are left out.
    The bound keeps what reaches the driver the same at every corpus size. It is taken per class,
    half of it each, so that a rare class is not lost.
    """
    rows = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y"))
    rows = rows.where(F.col("_id").isNotNull() & F.col("_y").isNotNull())
    if keep is not None:
        rows = rows.where(keep(F.col("_id")))
    rows = rows.groupBy("_id").agg(F.max("_y").alias("_y"))
    half = max(1, bound // 2)
    order = [F.xxhash64("_id"), F.col("_id")]
    few = rows.where(F.col("_y") == 0).orderBy(*order).limit(half).unionAll(rows.where(F.col("_y") == 1).orderBy(*order).limit(half))
    # The chosen ids number `bound` at most, whatever the corpus holds: that bound makes the broadcast safe.
    chosen = [(r._id, r._y) for r in few.collect()]
    if not chosen:
        return []
    spark = docs.sparkSession
    ids = spark.createDataFrame(chosen, f"_id {dict(docs.dtypes)['doc_id']}, _y int")
    got = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))
    # a repeated id gives one sample row
    got = got.groupBy("_id", "_y").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))
    return [(r.text, r._y) for r in got.orderBy(F.xxhash64("_id"), "_id").toLocalIterator()]


def release(spark: SparkSession | None = None) -> None:
    """Give freed memory back to the system: a fit on the driver leaves none behind (glibc only, else nothing happens).

    With a session the driver's JVM collects, too: broadcasts and plans that are no longer used go, on executors as well.
    """
    gc.collect()
    if spark is not None:
        spark._jvm.System.gc()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def map_texts(rows: DataFrame, text_col: str, make, out, keep: list[str] | None = None, limit: int = 1 << 20) -> DataFrame:
    """One output row for each row: `row` (a struct of its columns, or of those in keep) and the columns `out`.

    make() is called once in each task and returns a function from an Arrow array of whole texts
    (null: empty; about `limit` bytes at a time) to the arrays of `out` (a StructType). Input columns travel
    inside the struct, so their names can't clash with the output's.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    from . import textvec as tv

    ship(rows.sparkSession)
    fields = [rows.schema[c] for c in (rows.columns if keep is None else keep)]
    names = ["row", *out.fieldNames()]

    def run(batches):
        work = make()
        for batch in batches:
            texts = tv.text_column(batch, "text")
            for lo, hi in tv.slices(texts, limit):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *work(texts.slice(lo, hi - lo))], names)

    src = rows.select(F.struct(*[F.col(f"`{f.name}`") for f in fields]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return src.mapInArrow(run, T.StructType([T.StructField("row", T.StructType(fields)), *out.fields]))
