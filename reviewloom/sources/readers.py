"""Readers: landed tables, TSV and CSV, JSON, text in order, report blocks, GEXF, INI settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import schemas, scratch
from .scratch import reads, written


def pull_requests(table: DataFrame, project: str, limit: int | None = 20) -> DataFrame:
    """The used columns of the pull-request table under their aliases, of one project; with a limit the smallest ids."""
    out = table.where(F.col(schemas.PROJECT) == project).select(*[F.col(n).alias(a) for n, a in schemas.PULL_REQUEST])
    return out if limit is None else out.orderBy("pr_id").limit(limit)


def reviewer_rows(table: DataFrame, project: str, limit: int | None = 20) -> DataFrame:
    """The second scan, of reviewers, reads pull requests as well."""
    return pull_requests(table, project, limit)


def commit_files(table: DataFrame) -> DataFrame:
    """All commit files: two columns."""
    return table.select("commit_sha", "filename")


def all_commit_files(table: DataFrame) -> list[DataFrame]:
    """The one result of the commit-file query, in a list."""
    return [commit_files(table)]


def training_rows(spark: SparkSession, path: str) -> DataFrame:
    """TSV without header; columns are named by place."""
    return spark.read.csv(path, sep="\t", header=False, schema=schemas.TRAIN_ROW)


def delimited(spark: SparkSession, path: str, schema: str | None = None, sep: str = "\t") -> DataFrame:
    """TSV or CSV with header."""
    return spark.read.csv(path, sep=sep, header=True, schema=schema, inferSchema=schema is None)


#: pieces of a JSON array whose quotes and brackets are summed at a time
RUN = 4096


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that are one JSON array of objects (or one object) each: a row for each object. A file is read by many tasks.

    Pieces end at every closing brace, wherever a task's part of the file begins. Whether a piece begins inside a string, and how
    deep, follows from the quotes (escapes left out) and brackets of all pieces before it, whose counts are summed by runs of RUN pieces
    of a block of the file for both cases: a window holds one run, not a block. A piece that begins at the depth of the elements begins one; the pieces of an element are put together
    again and parsed; an object that doesn't parse gives nulls. A member of the array that is no object is an error.
    """
    pieces = spark.read.option("lineSep", "}").text(path)
    pieces = written(pieces.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at")).withColumn("_run", F.col("_at") - F.col("_at") % RUN), "pieces")
    count = lambda c, pattern: F.length(c) - F.length(F.regexp_replace(c, pattern, ""))
    key = ["_file", "_start", "_run"]
    small = _by_size(pieces, key)
    bare = F.regexp_replace("value", r"(?s)\\.", "")  # without escapes

    def depth(text: Column) -> Column:
        text = F.regexp_replace(text, r'(?s)"[^"]*("|$)', "")
        return count(text, r"[\[{]") - count(text, r"[\]}]")

    block = Window.partitionBy(*key).orderBy("_at")
    before = block.rowsBetween(Window.unboundedPreceding, -1)
    odd = pieces.withColumn("_bare", bare).withColumn("_odd", count(F.col("_bare"), '"') % 2)
    odd = odd.withColumns({"_d0": depth(F.col("_bare")), "_d1": depth(F.regexp_replace("_bare", r'(?s)^[^"]*("|$)', ""))}).drop("_bare")
    odd = odd.withColumn("_in", F.coalesce(F.sum("_odd").over(before), F.lit(0)) % 2)  # inside a string, if the block doesn't begin in one
    # what a piece adds to the depth when its block begins outside (0) or inside (1) of a string; the brace at its end counts outside
    inside = lambda s: (F.col("_in") + s) % 2
    for s in (0, 1):
        odd = odd.withColumn(f"_add{s}", F.when(inside(s) == 0, F.col("_d0")).otherwise(F.col("_d1")) - F.when((inside(s) + F.col("_odd")) % 2 == 0, 1).otherwise(0))
    files = Window.partitionBy("_file").orderBy("_start", "_run")  # a row for each run
    earlier = files.rowsBetween(Window.unboundedPreceding, -1)
    blocks = odd.groupBy(*key).agg(F.sum("_odd").alias("_o"), F.sum("_add0").alias("_a0"), F.sum("_add1").alias("_a1"), F.min_by(F.substring("value", 1, 100), "_at").alias("_v"))
    blocks = blocks.withColumn("_s", F.coalesce(F.sum("_o").over(earlier), F.lit(0)) % 2)
    blocks = blocks.withColumn("_depth", F.coalesce(F.sum(F.when(F.col("_s") == 0, F.col("_a0")).otherwise(F.col("_a1"))).over(earlier), F.lit(0)))
    # elements of an array stand at depth 1, an object alone at 0
    blocks = blocks.withColumn("_base", F.first(F.ltrim("_v").startswith("[").cast("int")).over(files)).select(*key, "_s", "_depth", "_base")
    placed = odd.join(small(blocks), key)
    add = F.when(F.col("_s") == 0, F.col("_add0")).otherwise(F.col("_add1"))
    at_depth = F.col("_depth") + F.coalesce(F.sum(add).over(before), F.lit(0))
    begins = (inside(F.col("_s")) == 0) & ((at_depth == F.col("_base")) | (at_depth == 0))
    marks = placed.withColumn("_first", F.when(begins, F.col("_at"))).select(*key, "_at", "value", "_first")
    marks = marks.withColumn("_first", F.last("_first", ignorenulls=True).over(block))
    last = marks.groupBy(*key).agg(F.max("_first").alias("_l"))
    last = last.select(*key, F.last("_l", ignorenulls=True).over(earlier).alias("_carried"))
    element = marks.join(small(last), key).withColumn("_first", F.coalesce("_first", "_carried"))
    parts = F.array_sort(F.collect_list(F.struct("_start", "_at", "value")))
    text = F.concat(F.array_join(F.transform(parts, lambda x: x["value"]), "}"), F.lit("}"))
    text = F.regexp_replace(text, r"^[\s\[,]*", "")
    whole = element.groupBy("_file", "_first").agg(text.alias("j")).where(~F.col("j").rlike(r"^\]?\s*\}$"))
    checked = F.when(F.col("j").startswith("{"), F.col("j")).otherwise(F.raise_error(F.lit("a member of the array is no object")))
    return reads(whole.select(F.from_json(checked, schema).alias("r")).select("r.*"), pieces)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file (a trailing empty line is none)."""
    return spark.read.text(path)


def stop_words(spark: SparkSession, path: str) -> DataFrame:
    """Distinct, trimmed, non-empty entries of a stop-word file."""
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''").distinct()


def ordered_lines(spark: SparkSession, path: str, keep: Column | None = None) -> DataFrame:
    """(line_no, value) of the lines of a text file, or of the files of a folder in the order of their paths; written.

    keep: a condition on `value`; only lines that meet it are numbered, without gaps. Files may be read in any order and in
    parts: a line's number is its place in its block plus the lines of all blocks before it, by (file, start of the block).
    """
    lines = spark.read.text(path)
    lines = lines.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    at = F.monotonically_increasing_id().alias("_at")  # rises within a block
    got = written((lines if keep is None else lines.where(keep)).select("value", "_file", "_start", at), "lines")
    blocks = got.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    starts = blocks.select("_file", "_start", (before - F.col("_first")).alias("_shift"))
    return reads(got.join(_by_size(got)(starts), ["_file", "_start"]).select((F.col("_at") + F.col("_shift")).alias("line_no"), "value"), got)


def _by_size(rows: DataFrame, key: tuple | list = ("_file", "_start")):
    """How to join a table of a row for each block (or run) of a file to rows: broadcast up to SMALL_ROWS of them; beyond, its rows meet in a task."""
    return F.broadcast if rows.select(*key).distinct().count() <= scratch.SMALL_ROWS else (lambda df: df)


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, words) of the lines of a segmented corpus, a file or a folder of files; the first token of a line is its id and goes.

    Lines are numbered without gaps over those with a word, in the order of the files' paths and of the lines in them.
    """
    words = F.filter(F.split(F.trim("value"), r"\s+"), lambda w: w != "")
    lines = ordered_lines(spark, path, keep=F.size(words) > 1)
    return reads(lines.select("line_no", F.slice(words, 2, 1_000_000_000).alias("words")), lines)


def every_nth(lines: DataFrame, n: int = 5) -> tuple[DataFrame, DataFrame]:
    """(train, test) of numbered lines: every n-th from 0 is test."""
    return lines.where(F.col("line_no") % n != 0), lines.where(F.col("line_no") % n == 0)


def numbered(rows: DataFrame, at: str) -> DataFrame:
    """Adds line_no: 0, 1, ... in the order of `at`, a monotonically increasing id (its high bits are the partition).

    Partition sizes are summed first, so no task sorts all rows.
    """
    part = F.shiftright(F.col(at), 33)
    rows = rows.withColumn("_p", part)
    sizes = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    inner = F.row_number().over(Window.partitionBy("_p").orderBy(at)) - 1
    return rows.withColumn("_i", inner).join(sizes.select("_p", before.alias("_b")), "_p").withColumn("line_no", F.col("_b") + F.col("_i")).drop("_p", "_i", "_b")


def dense_numbers(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """Adds `name`: 0, 1, ... in a total order. Rows are sorted by ranges; no task sorts them all."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranges = written(dealt, "ranges")
    return reads(numbered(ranges, "_at").drop("_at").withColumnRenamed("line_no", name), ranges)


def report_cells(spark: SparkSession, path: str, columns: int = 7) -> DataFrame:
    """Report sheets landed as CSV: row_idx, c0 ... c6, all text but the row number, and `sheet` where folders name it."""
    cells = "row_idx long, " + ", ".join(f"c{i} string" for i in range(columns))
    return spark.read.csv(path, header=True, schema=cells + ", sheet string")


def gexf(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Attributes, nodes (with attvalues) and edges of a GEXF file; namespaces of tags are dropped."""
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", "true").schema(schema).load(path)
    values = "attvalues struct<attvalue:array<struct<_for:string,_value:string>>>"
    return {
        "attributes": read("attribute", "_id string, _title string, _type string, default string").select(F.col("_id").alias("id"), F.col("_title").alias("title"), F.col("_type").alias("type"), "default"),
        "nodes": read("node", f"_id string, _label string, _start string, _end string, {values}").select(F.col("_id").alias("id"), F.col("_label").alias("label"), F.col("_start").alias("start"), F.col("_end").alias("end"), F.col("attvalues.attvalue").alias("attvalues")),
        "edges": read("edge", f"_id string, _source string, _target string, _weight string, _label string, _start string, _end string, color struct<_r:int,_g:int,_b:int>, {values}").select(F.col("_id").alias("id"), F.col("_source").alias("source"), F.col("_target").alias("target"), F.col("_weight").cast("double").alias("weight"), F.col("_label").alias("label"), F.col("_start").alias("start"), F.col("_end").alias("end"), F.struct(F.col("color._r").alias("r"), F.col("color._g").alias("g"), F.col("color._b").alias("b")).alias("colour"), F.col("attvalues.attvalue").alias("attvalues")),
    }


def gexf_values(nodes: DataFrame, attribute: str) -> DataFrame:
    """(id, value) of one attribute of GEXF nodes, such as a community class."""
    return nodes.select("id", F.explode("attvalues").alias("a")).where(F.col("a._for") == attribute).select("id", F.col("a._value").alias("value"))


#: sections that hold credentials: never read
SECRET = ("authorization", "database")


def settings(spark: SparkSession, path: str, section: str | None = None) -> DataFrame:
    """(file, section, key, value) of INI files: a file or a folder of files. section: that one only.

    A line `[name]` begins a section, whose name is carried on over the lines of its file; `key = value` or `key: value` is an entry (trimmed;
    of a repeated key the last one counts), lines that begin with # or ; are comments. A line of another kind is left out, as is
    what stands before the first section. Sections of credentials are filtered out before an entry is read, and nothing is written;
    asking for one is a ValueError.
    """
    if section in SECRET:
        raise ValueError("credentials are not read")
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "value"))
    head, line = r"^\s*\[([^\]]*)\]\s*$", F.trim("value")
    w = Window.partitionBy("file").orderBy("line_no")  # the lines of one file of settings, which one task has read whole
    named = F.last(F.when(F.col("value").rlike(head), F.trim(F.regexp_extract("value", head, 1))), ignorenulls=True).over(w)
    lines = files.withColumn("section", named)
    lines = lines.where(F.col("section").isNotNull() & ~F.lower("section").isin(*SECRET))
    if section is not None:
        lines = lines.where(F.col("section") == section)
    pair = r"(?s)^\s*([^=:\[#;][^=:]*?)\s*[=:](.*)$"
    entries = lines.where(line.rlike(pair)).select("file", "section", "line_no", F.regexp_extract(line, pair, 1).alias("key"), F.trim(F.regexp_extract(line, pair, 2)).alias("value"))
    return entries.groupBy("file", "section", "key").agg(F.max_by("value", "line_no").alias("value"))


def nested(json_text: Column, schema: str) -> Column:
    """Guarded navigation: a missing key or a wrong type is null."""
    return F.from_json(json_text, schema)
