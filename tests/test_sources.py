"""Readers and writers: round trips and refusals."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from reviewloom.functions import tagging
from reviewloom.sources import readers, schemas, scratch, sheets, writers


def test_delimited(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("r\t1\t2\tsha\n")
    assert readers.training_rows(spark, str(tmp_path / "t.tsv")).first().commit == "sha"
    (tmp_path / "h.tsv").write_text("pull_number\tfilename\n3\ta/b\n")
    assert tuple(readers.delimited(spark, str(tmp_path / "h.tsv"), schemas.CHANGE_FILE).first()) == (3, "a/b")


def test_json_and_text(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([{"changeNumber": 1, "timestamp": 5, "reviewers": [{"name": "a"}], "filePaths": []}]))
    assert readers.json_array(spark, str(tmp_path / "r.json"), schemas.CHANGE_DATASET).first().reviewers[0].name == "a"
    (tmp_path / "s.txt").write_text("the\n of \nthe\n\n")
    assert sorted(r.word for r in readers.stop_words(spark, str(tmp_path / "s.txt")).collect()) == ["of", "the"]


def test_settings(spark, tmp_path):
    (tmp_path / "a.txt").write_text("stray = 1\n[recommend]\ntopk=10\r\nUsers : a,b\n# no = 1\n; no = 2\nword\n\n[ other ]\nx = y = z\nx = \n[database]\npassword = p\n[recommend]\ntopk = 11\n")
    (tmp_path / "b.txt").write_text("[recommend]\ntopk=7")
    rows = lambda df: sorted((r.file.rsplit("/")[-1], r.section, r.key, r.value) for r in df.collect())
    every = [("a.txt", "other", "x", ""), ("a.txt", "recommend", "Users", "a,b"), ("a.txt", "recommend", "topk", "11"), ("b.txt", "recommend", "topk", "7")]
    assert rows(readers.settings(spark, str(tmp_path))) == every
    assert rows(readers.settings(spark, str(tmp_path), "other")) == every[:1]
    with pytest.raises(ValueError):
        readers.settings(spark, str(tmp_path), "database")


def test_corpus(spark, tmp_path):
    (tmp_path / "c.txt").write_text("".join(f"id{i} 北京/ns 好/a\n\n" for i in range(6)))
    rows = readers.corpus(spark, str(tmp_path / "c.txt"))
    tagged = rows.select("line_no", tagging.tags_udf()("words").alias("tags"))
    assert [r.line_no for r in tagged.orderBy("line_no").collect()] == list(range(6))
    train, test = readers.every_nth(tagged)
    assert (train.count(), test.count()) == (4, 2)
    writers.write_tagged(test, str(tmp_path / "out"))
    assert [r.value for r in readers.ordered_lines(spark, str(tmp_path / "out")).orderBy("line_no").collect()][:4] == ["北\tB", "京\tE", "好\tO", ""]


@pytest.fixture
def small_parts(spark):
    """Files are read in parts of a few hundred bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "40"}
    old = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("rows", [100_000, 0])
def test_lines_of_many_files_in_order(spark, tmp_path, small_parts, monkeypatch, rows):
    """Files of unequal size, each in several parts, packed by size: numbers follow the paths, then the lines; blocks broadcast or not."""
    monkeypatch.setattr(scratch, "SMALL_ROWS", rows)
    want = []
    for name, n in (("a", 2), ("b", 2000), ("c", 200), ("d", 0), ("e", 1)):
        lines = [f"id{i} {name}{i}" if i % 4 != 1 else ["", "id", " \t "][i % 3] for i in range(n)]
        (tmp_path / name).write_text("\n".join(lines) + "\n" * (name != "c"))
        want += [x.split()[1] for x in lines if len(x.split()) > 1]
    got = readers.corpus(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    assert sorted((r.line_no, r.words[0]) for r in got.collect()) == list(enumerate(want))


OBJECT = "a long, b string, c struct<d:string,e:array<struct<f:string>>>, g map<string,string>"


def test_json_array_in_parts(spark, tmp_path, small_parts):
    """Braces, brackets, quotes and escapes in strings, nested objects, cuts at every place: rows of the plain reader."""
    odd = ["}", "]", "{[", '"', "\\", '\\"', 'x"}],[{"', "\\\\", "é日\n\t", ",", ""]
    rows = [{"a": i, "b": odd[i % len(odd)] * (1 + i % 3), "c": {"d": odd[i % 7], "e": [{"f": odd[(i + j) % len(odd)]} for j in range(i % 4)]}, "g": {}} for i in range(300)]
    for name, text in (("x", json.dumps(rows)), ("y", json.dumps(rows[:3], indent=2, ensure_ascii=False) + "\n"), ("z", "[]"), ("one", json.dumps(rows[5])), ("none", " [ ] \n")):
        (tmp_path / f"{name}.json").write_text(text)
    for path, n in ((tmp_path / "x.json", 300), (tmp_path / "one.json", 1), (tmp_path / "z.json", 0), (tmp_path / "none.json", 0), (tmp_path, 304)):
        got = sorted(map(str, readers.json_array(spark, str(path), OBJECT).collect()))
        assert got == sorted(map(str, spark.read.schema(OBJECT).json(str(path), multiLine=True).collect())) and len(got) == n
    assert spark.read.option("lineSep", "}").text(str(tmp_path / "x.json")).rdd.getNumPartitions() > 20
    (tmp_path / "bad.json").write_text('[1, {"a": 2}]')
    with pytest.raises(Exception, match="no object"):
        readers.json_array(spark, str(tmp_path / "bad.json"), OBJECT).collect()


def test_workbooks(spark, tmp_path):
    """Written and read back; shared, inline and formatted strings, booleans, formulas, missing references of other writers."""
    rows = spark.createDataFrame([("s1", 0, "a", None, "1.5"), ("s1", 4, "<&\"> ", "é", "1e400"), ("s 2", 1, "007x", " 7", "-3")], "sheet string, row_idx long, c0 string, c1 string, c2 string")
    sheets.write_workbooks(rows, F.lit("b"), str(tmp_path), columns=3)
    got = sheets.cells(spark, str(tmp_path))
    assert sorted((r.sheet, r.row_idx, r.col_idx, r.value) for r in got.collect()) == sorted([("s1", 0, 0, "a"), ("s1", 0, 2, "1.5"), ("s1", 4, 0, "<&\"> "), ("s1", 4, 1, "é"), ("s1", 4, 2, "1e400"), ("s 2", 1, 0, "007x"), ("s 2", 1, 1, " 7"), ("s 2", 1, 2, "-3.0")])
    assert sorted(map(tuple, sheets.report_cells(got, 2).select("sheet", "row_idx", "c0", "c1").collect())) == [("s 2", 1, "007x", " 7"), ("s1", 0, "a", None), ("s1", 4, "<&\"> ", "é")]
    data = "<row><c><v>1</v></c><c t='inlineStr'><is><t>in</t></is></c><c r='D1' t='b'><v>1</v></c></row><row r='5'><c r='AB5' t='str'><f>A1</f><v>x</v></c><c t='s'><v>0</v></c><c t='e'><v>#N/A</v></c><c/></row><row/><row><c><v>2</v></c></row>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook xmlns='{sheets.MAIN}' xmlns:q='{sheets.OFFICE}'><sheets><sheet name='A' q:id='x'/></sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships xmlns='{sheets.PACKAGE}'><Relationship Id='x' Target='/xl/other.xml'/></Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst xmlns='{sheets.MAIN}'><si><r><t>rich </t></r><r><t>text</t></r><rPh><t>no</t></rPh></si></sst>")
        z.writestr("xl/other.xml", f"<worksheet xmlns='{sheets.MAIN}'><sheetData>{data}</sheetData></worksheet>")
    assert list(sheets.read_workbook(out.getvalue())) == [("A", 0, 0, "1"), ("A", 0, 1, "in"), ("A", 0, 3, "TRUE"), ("A", 4, 27, "x"), ("A", 4, 28, "rich text"), ("A", 4, 29, "#N/A"), ("A", 6, 0, "2")]
    assert [sheets.column_number(sheets.column_name(i)) for i in range(2000)] == list(range(2000))


def test_csv_header_is_quoted(spark, tmp_path):
    writers.csv_file(spark.createDataFrame([("x,y", 1)], "`a,b` string, `c\"d` int"), str(tmp_path / "csv"))
    got = spark.read.csv(str(tmp_path / "csv"), header=True)
    assert got.columns == ["a,b", 'c"d'] and [tuple(r) for r in got.collect()] == [("x,y", "1")]


def test_equal_rows_of_a_heavy_key_are_spread(spark):
    """20,000 equal rows of one key, from eight tasks: joined whole, by more tasks than one, none with more than a few tasks' rows."""
    left = spark.range(0, 20_000, 1, 8).select(F.lit(7).alias("k"), F.lit("same").alias("v"))
    right = spark.createDataFrame([(7, 20_000, "x"), (8, 0, "y")], "k int, n long, w string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = scratch.salted_join(left, right, ["k"], "n", 20_000)
        sizes = [r.n for r in got.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert sum(sizes) == 20_000 and got.select("w").distinct().count() == 1
        few = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        sizes = [r.n for r in scratch.salted_join(left, right, ["k"], "n", 20_000).groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
        spark.conf.set("spark.sql.shuffle.partitions", few)
        assert len(sizes) >= 5 and max(sizes) <= 7500
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_csv_and_months(spark, tmp_path):
    df = spark.createDataFrame([("2020-01-05", 1), ("2020-02-05", 2)], "d string, v int").withColumn("d", F.to_date("d"))
    writers.csv_file(df, str(tmp_path / "csv"))
    assert readers.delimited(spark, str(tmp_path / "csv"), "d date, v int", ",").count() == 2
    writers.write_months(df, "d", str(tmp_path / "months"))
    assert sorted(p.name for p in (tmp_path / "months" / "year=2020").iterdir()) == ["month=1", "month=2"]


def test_gexf(spark, tmp_path):
    attr = "array<struct<for:string,value:string>>"
    nodes = spark.createDataFrame([(1, 'a<"&', [("m", "7")]), (2, "b", [])], f"id int, label string, attvalues {attr}")
    edges = spark.createDataFrame([("e", 1, 2, 0.5)], "id string, source int, target int, weight double")
    path = str(tmp_path / "g")
    writers.write_gexf(nodes, edges, path, [("m", "Class", "integer")], default_edge_type="odd")
    got = readers.gexf(spark, path)
    assert sorted((r.id, r.label) for r in got["nodes"].collect()) == [("1", 'a<"&'), ("2", "b")]
    assert [tuple(r) for r in readers.gexf_values(got["nodes"], "m").collect()] == [("1", "7")]
    assert tuple(got["edges"].select("source", "target", "weight").first()) == ("1", "2", 0.5) and got["attributes"].first().title == "Class"
    assert writers.graph_counts(nodes, edges) == (2, 1)
    with pytest.raises(ValueError):
        writers.write_gexf(nodes, spark.createDataFrame([("e", 1, 9, 0.5)], edges.schema), path, [("m", "Class", "integer")])
    with pytest.raises(ValueError):
        writers.write_gexf(nodes, edges, path)


def test_plot_data(spark):
    got = writers.plot_nodes(spark.createDataFrame([("pr",), ("reviewer",), ("author",)], "type string"))
    assert [(r["size"], r["colour"]) for r in got.collect()] == [(100, "r"), (300, "b"), (300, "g")]
