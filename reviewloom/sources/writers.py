"""Writers: CSV, month slices, tagged corpora, GEXF, row records, plot data, logs."""

from __future__ import annotations

import logging
from xml.sax.saxutils import quoteattr

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import NODE_KINDS
from .scratch import drop_path


def merged(spark: SparkSession, folders: list[str], path: str) -> None:
    """One file from the parts of written folders, in their order; the folders go. Bytes are streamed, not gathered."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(conf).create(target, True)
    try:
        for folder in folders:
            top = jvm.org.apache.hadoop.fs.Path(folder)
            fs = top.getFileSystem(conf)
            for p in sorted(p.getPath().toString() for p in fs.listStatus(top) if p.getPath().getName().startswith("part-")):
                part = fs.open(jvm.org.apache.hadoop.fs.Path(p))
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
                part.close()
    finally:
        out.close()
    for folder in folders:
        drop_path(spark, folder)


def csv_file(df: DataFrame, path: str) -> None:
    """One UTF-8 CSV file with header (quoted as values are): parts are written by all tasks, then joined."""
    spark = df.sparkSession
    head = spark.createDataFrame([tuple(df.columns)], ", ".join(f"c{i} string" for i in range(len(df.columns))))
    head.coalesce(1).write.mode("overwrite").csv(path + ".head", header=False, encoding="UTF-8")
    df.write.mode("overwrite").csv(path + ".parts", header=False, encoding="UTF-8")
    merged(spark, [path + ".head", path + ".parts"], path)


def by_month(df: DataFrame, date_col: str) -> DataFrame:
    """Adds year and month of a date column: the slices of `write_months`."""
    return df.withColumn("year", F.year(date_col)).withColumn("month", F.month(date_col))


def write_months(df: DataFrame, date_col: str, path: str) -> None:
    """TSV, a folder for every month."""
    by_month(df, date_col).write.mode("overwrite").partitionBy("year", "month").csv(path, sep="\t", header=True)


def tagged_lines(tagged: DataFrame) -> DataFrame:
    """One text per sentence of (line_no, tags): `char<TAB>tag` lines and an empty line."""
    lines = F.transform("tags", lambda x: F.concat(x["ch"], F.lit("\t"), x["tag"]))
    return tagged.orderBy("line_no").select(F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("value"))


def write_tagged(tagged: DataFrame, path: str) -> None:
    """Train or test text of a tagged corpus: a folder of parts in the order of their names (readers.ordered_lines reads them so)."""
    tagged_lines(tagged).write.mode("overwrite").text(path)


def write_gexf(nodes: DataFrame, edges: DataFrame, path: str, attributes: list[tuple[str, str, str]] = (), mode: str = "static", default_edge_type: str = "undirected", edge_attributes: list[tuple[str, str, str]] = ()) -> None:
    """GEXF 1.1 text at `path` (a folder of parts in order: header, nodes, edges; `merged` makes one file of such a folder).

    nodes: id, label, attvalues array<struct<for, value>>; edges: id, source, target, weight. Both may have start, end and
    colour (struct<r, g, b>), edges label and attvalues; null ones are left out. attributes: (id, title, type) of
    node attributes, edge_attributes of edges. An edge with an unknown end, or an attribute that is not declared, raises ValueError.
    """
    mode = mode if mode in ("static", "dynamic") else "static"
    default_edge_type = default_edge_type if default_edge_type in ("directed", "undirected") else "undirected"
    ends = edges.select(F.explode(F.array("source", "target")).alias("id"))
    if ends.join(nodes, "id", "left_anti").limit(1).count():
        raise ValueError("an edge has an unknown end")
    for table, known in ((nodes, attributes), (edges, edge_attributes)):
        if "attvalues" in table.columns and table.select(F.explode("attvalues").alias("a")).where(~F.col("a.for").isin([x[0] for x in known])).limit(1).count():
            raise ValueError("an attribute is not declared")
    declared = lambda kind, known: f'<attributes class="{kind}" mode="{mode}">\n' + "".join(f"<attribute id={quoteattr(i)} title={quoteattr(t)} type={quoteattr(k)}/>\n" for i, t, k in known) + "</attributes>\n"
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<gexf xmlns="http://www.gexf.net/1.1draft" xmlns:viz="http://www.gexf.net/1.1draft/viz" version="1.1">\n' + f'<graph mode="{mode}" defaultedgetype="{default_edge_type}">\n'
    head += declared("node", attributes) + (declared("edge", edge_attributes) if edge_attributes else "") + "<nodes>"
    attr = lambda name, c: F.concat(F.lit(f" {name}=\""), _escaped(c.cast("string")), F.lit('"'))
    none = F.lit("")

    def element(tag: str, table: DataFrame, names: list[str]) -> Column:
        have = lambda c: c in table.columns
        own = [F.when(F.col(c).isNotNull(), attr(c, F.col(c))).otherwise(none) for c in (*names, "start", "end") if have(c)]
        colour = F.when(F.col("colour").isNotNull(), F.concat(F.lit("<viz:color"), *[attr(c, F.col(f"colour.{c}")) for c in "rgb"], F.lit("/>"))).otherwise(none) if have("colour") else none
        values = F.transform("attvalues", lambda a: F.concat(F.lit("<attvalue"), attr("for", a["for"]), attr("value", a["value"]), F.lit("/>"))) if have("attvalues") else F.array().cast("array<string>")
        return F.concat(F.lit(f"<{tag}"), *own, F.lit(">"), colour, F.lit("<attvalues>"), F.coalesce(F.array_join(values, ""), none), F.lit(f"</attvalues></{tag}>"))

    # names of elements and attributes, here and in the header, are fixed values of the format
    one = lambda k, text: nodes.sparkSession.createDataFrame([(k, "", text)], "part int, id string, value string")
    parts = one(0, head).unionAll(nodes.select(F.lit(1), F.col("id").cast("string"), element("node", nodes, ["id", "label"]))).unionAll(one(2, "</nodes>\n<edges>"))
    parts = parts.unionAll(edges.select(F.lit(3), F.col("id").cast("string"), element("edge", edges, ["id", "source", "target", "weight", "label"]))).unionAll(one(4, "</edges>\n</graph>\n</gexf>"))
    parts.orderBy("part", "id").select("value").write.mode("overwrite").text(path)


def _escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.coalesce(c, F.lit(""))


def graph_counts(nodes: DataFrame, edges: DataFrame) -> tuple[int, int]:
    """Numbers of nodes and edges."""
    return nodes.count(), edges.count()


def plot_nodes(nodes: DataFrame) -> DataFrame:
    """Adds size and colour by node type, for a plot."""
    pr, reviewer, _ = NODE_KINDS
    size = F.when(F.col("type") == pr, 100).otherwise(300)
    colour = F.when(F.col("type") == pr, "r").when(F.col("type") == reviewer, "b").otherwise("g")
    return nodes.withColumn("size", size).withColumn("colour", colour)


def log_line(level: str, text: str) -> None:
    """time, level, text to the package's log; level is INFO or ERROR."""
    logging.getLogger("reviewloom").log(logging.ERROR if level == "ERROR" else logging.INFO, text)
