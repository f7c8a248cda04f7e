"""The folder that driver and executors share, tables written there, joins on hot keys, and sending this package to the executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`, else the folder of setCheckpointDir.

    Only where neither is set and the master is local (tests) is a temporary folder made. Elsewhere that is an error:
    each executor would write to a disk of its own.
    """
    sc = spark.sparkContext
    conf = sc.getConf().get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    given = sc._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get().rstrip("/")
    own = getattr(spark, "_reviewloom_shared", None)
    if own is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = "file://" + tempfile.mkdtemp(prefix="reviewloom-")
        spark._reviewloom_shared = own
    return own


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else has."""
    return f"{shared_dir(spark)}/reviewloom-{name}-{uuid.uuid4().hex}"


def ship(spark: SparkSession | None = None) -> None:
    """Send this package to the executors' Python workers, once in a session."""
    sc = (spark or SparkSession.active()).sparkContext
    if getattr(sc, "_reviewloom_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="reviewloom-")) / f"{top.name}-{uuid.uuid4().hex}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(str(target))
    sc._reviewloom_shipped = True


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._reviewloom_paths = (path,)
    return out


def reads(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """df, noted as a lazy result that reads written tables (or such results): drop_written(df) deletes them."""
    df._reviewloom_paths = tuple(p for t in tables for p in getattr(t, "_reviewloom_paths", ()))
    return df


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_written(*tables: DataFrame | None) -> None:
    """Delete tables made by `written`, or those that a result noted by `reads` reads, that no later plan needs."""
    for df in tables:
        for path in getattr(df, "_reviewloom_paths", ()):
            drop_path(df.sparkSession, path)


#: a key of more rows is heavy; heavy keys, at most (their numbers of pieces are broadcast)
HEAVY_ROWS, HEAVY_KEYS = 512, 20_000
#: rows of a table of numbers that is broadcast whole (about 10 MB)
SMALL_ROWS = 100_000


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], n: str, total: int, how: str = "inner", rows: int | None = None) -> DataFrame:
    """left joined with right, so that no task meets all of left's rows of a heavy key.

    right has the number n of left's rows of a key in each of its rows (n goes with it into the result); total is the number of
    left's rows. A key of more than max(HEAVY_ROWS, total / HEAVY_KEYS) rows is cut into pieces of about that size by a hash of the row and of
    the task that holds it: equal rows go to as many pieces as tasks held them. (A row's place in its task would spread them
    further, but after a lost executor a task may meet its rows in another order and deal them otherwise: rows would be lost.)
    right's rows are repeated for each piece. Heavy keys number HEAVY_KEYS at most, whatever the corpus holds: that bound makes
    the broadcast of their numbers of pieces safe. If right is known to have `rows` rows at most (of a few numbers each), and
    these are at most SMALL_ROWS, it is broadcast whole: nothing is shuffled.
    """
    if rows is not None and rows <= SMALL_ROWS:
        return left.join(F.broadcast(right), keys, how)
    per = max(HEAVY_ROWS, total // HEAVY_KEYS)
    pieces = F.ceil(F.col(n) / per).cast("int")
    heavy = F.broadcast(right.where(F.col(n) > per).select(*keys, pieces.alias("_pieces")).distinct())
    salt = F.xxhash64(*[F.col(c) for c, kind in left.dtypes if "map<" not in kind], F.spark_partition_id())
    dealt = left.withColumn("_salt", salt).join(heavy, keys, "left")
    dealt = dealt.withColumn("_piece", F.coalesce(F.pmod("_salt", "_pieces").cast("int"), F.lit(0))).drop("_pieces", "_salt")
    copies = right.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.greatest(pieces, F.lit(1)) - 1)))
    return dealt.join(copies, [*keys, "_piece"], how).drop("_piece")
