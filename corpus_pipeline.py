"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; docs needs doc_id (an integer), text and source.
Further columns are passed on. Null and empty texts have no toxic sentence, no near-duplicate and no benchmark
passage: they stay. An empty table gives an empty table. Each stage's result is written and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.llm import decontam, mixing, near_dup, sharding, toxicity
from reviewloom.llm.shared import drop_written, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a toxicity score under 0.5; the model learns from all labelled rows of docs, within its bound."""
    model = toxicity.trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.toxicity(docs, model).where("score < 0.5").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest id, of each group of near-duplicates (five-word shingles, similarity of 0.8).

    Rows are told apart by id and text: a repeated id loses only rows whose text is a near-duplicate. Rows without an id
    can't be named and stay, as do rows without words. Ids that are no integers are a ValueError, before any work.
    """
    kind = dict(docs.dtypes)["doc_id"]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"doc_id must be an integer, not {kind}")
    return near_dup.deduplicated(docs, width=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any window of a benchmark item, items without an id included."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = decontam.contamination(docs, bench.withColumn("item_id", F.coalesce(F.col("item_id").cast("string"), F.lit("null"))))
    return got.where(F.size("spans") == 0).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of all sources at their target weights: rows repeat as often as they are drawn."""
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and their place in it (columns shard and slot, or shard_ and slot_ if docs has those)."""
    got = sharding.sharded(docs)
    name = lambda c: c + "_" * (c in docs.columns)
    return got.select("row.*", F.col("shard").alias(name("shard")), F.col("slot").alias(name("slot")))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The first stage scores with a trained model, which SQL can't express. tests/llm/test_stages.py compares what each stage keeps
#: with brute force (drawn copies and shards: with the laws they must keep).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's table goes as soon as the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept = written(stage(spark, docs, sf_dir), name)
        drop_written(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
