"""All queries of the collaboration-analytics operators over the driver's tables, with the SQL they are compared with.

Proxies: orders are pull requests, lines with their part are changed files, suppliers are reviewers,
customers are authors, documents are texts, events are timelines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import porter, tagging, text
from ..operators import bags, components, features, graphs, learning, shaping
from ..sources import readers, schemas, scratch, sheets, writers

QUERIES: dict = {}
ORACLE_SQL: dict = {}
STOP = ["the", "of", "and", "to", "in", "a", "is", "that", "de", "la"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c: str):
    return F.round(F.col(c), 6).alias(c)


# ---- sources, projection, joins

_PR = "o_orderkey AS pr_id, o_orderstatus AS pr_state, o_custkey AS pr_author, o_orderdate AS pr_created_at"


def _pull_requests(spark, sf):
    """Orders in the shape of the pull-request table."""
    o = t(spark, sf, "orders")
    have = {"repo_full_name": "o_orderpriority", "number": "o_orderkey", "state": "o_orderstatus", "user_login": "o_custkey", "created_at": "o_orderdate"}
    return o.select(*[(F.col(have[n]) if n in have else F.lit(None).cast("string")).alias(n) for n in (schemas.PROJECT, *[n for n, _ in schemas.PULL_REQUEST])])


@query(f"SELECT {_PR} FROM orders WHERE o_orderpriority = '1-URGENT'")
def pr_projection(spark, sf):
    return readers.pull_requests(_pull_requests(spark, sf), "1-URGENT", limit=None).select("pr_id", "pr_state", "pr_author", "pr_created_at")


@query(f"SELECT {_PR} FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderkey LIMIT 20")
def pr_filter_limit(spark, sf):
    return readers.pull_requests(_pull_requests(spark, sf), "1-URGENT").select("pr_id", "pr_state", "pr_author", "pr_created_at")


def _files(spark, sf) -> DataFrame:
    """(pr, commit_sha, filename, ...): a line with the path of its part. Parts are joined by shuffle or broadcast, as their size allows."""
    path = F.concat_ws("/", F.regexp_replace("p_brand", "#", ""), F.lower("p_type"), F.regexp_replace("p_name", " ", "_"))
    part = t(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), path.alias("filename"))
    return t(spark, sf, "lineitem").join(part, "l_partkey").select(F.col("l_orderkey").alias("pr"), "filename")


_FILES = """files AS (SELECT l_orderkey AS pr, replace(p_brand, '#', '') || '/' || lower(p_type) || '/' || replace(p_name, ' ', '_') AS filename FROM lineitem JOIN part ON l_partkey = p_partkey)"""


@query(f"WITH {_FILES} SELECT o_orderkey AS commit_sha, o_custkey AS author, filename FROM orders LEFT JOIN files ON o_orderkey = pr")
def commit_files_left_join(spark, sf):
    files = readers.commit_files(_files(spark, sf).withColumnRenamed("pr", "commit_sha"))
    rows = t(spark, sf, "orders").select(F.col("o_orderkey").alias("commit_sha"), F.col("o_custkey").alias("author"))
    return shaping.with_commit_files(rows, files).select("commit_sha", "author", "filename")


_FIRST = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]


@query(f"SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY {', '.join(_FIRST)}) AS n FROM lineitem) WHERE n = 1")
def keep_first(spark, sf):
    return features.keep_first(t(spark, sf, "lineitem"), "l_suppkey", _FIRST).select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")


_CONCAT = "SELECT o_orderkey, 0::INT AS label FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT o_orderkey, 1::INT FROM orders WHERE o_orderkey % 5 = 0"


def _labels(spark, sf) -> DataFrame:
    return t(spark, sf, "orders").select(F.col("o_orderkey").alias("doc"), (F.col("o_orderkey") % 5 == 0).cast("int").alias("label"))


@query(_CONCAT)
def train_test_concat(spark, sf):
    label = _labels(spark, sf).withColumnRenamed("doc", "o_orderkey")
    return label.where("label = 0").unionByName(label.where("label = 1"))


@query("SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem")
def distinct_pairs(spark, sf):
    return t(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").distinct()


# ---- path and text features

_PREFIX = "unnest(list_transform(range(1, len(string_split(filename, '/')) + 1), lambda i: '/' || array_to_string(string_split(filename, '/')[1:i], '/')))"
_COUNTS = f"terms AS (SELECT pr AS doc, {_PREFIX} AS term FROM files), tf AS (SELECT doc, term, count(*) AS tf FROM terms GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), n AS (SELECT count(DISTINCT doc) AS n FROM tf)"
_TERMS = f"{_FILES}, {_COUNTS}"
_TFIDF = "raw AS (SELECT doc, term, tf * log2(n / df) AS w FROM tf JOIN df USING (term), n WHERE log2(n / df) > 0), vec AS (SELECT doc, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc)) AS w FROM raw)"


def _tf(spark, sf) -> DataFrame:
    return features.term_frequency(features.path_terms(_files(spark, sf), "pr"))


@query(f"SELECT p_partkey, unnest(list_transform(range(1, len(string_split(p_name, ' ')) + 1), lambda i: '/' || array_to_string(string_split(p_name, ' ')[1:i], '/'))) AS prefix FROM part")
def path_prefixes(spark, sf):
    return t(spark, sf, "part").select("p_partkey", F.explode(text.path_prefixes(F.regexp_replace("p_name", " ", "/"))).alias("prefix"))


@query(f"WITH {_TERMS} SELECT * FROM tf")
def path_tf(spark, sf):
    return _tf(spark, sf)


@query(f"WITH {_TERMS} SELECT * FROM df")
def path_df(spark, sf):
    return features.document_frequency(_tf(spark, sf))


@query(f"WITH {_TERMS} SELECT doc, term, round(tf * (ln(n / df) + 1), 6) AS w FROM tf JOIN df USING (term), n")
def path_tfidf_manual(spark, sf):
    return features.tfidf_plain(_tf(spark, sf)).select("doc", "term", r6("w"))


@query(f"WITH {_TERMS}, {_TFIDF} SELECT doc, term, round(w, 6) AS w FROM vec")
def path_tfidf(spark, sf):
    return features.tfidf(_tf(spark, sf)).select("doc", "term", r6("w"))


@query(f"WITH {_FILES.replace('SELECT l_orderkey', 'SELECT DISTINCT l_orderkey')}, {_COUNTS}, {_TFIDF}, labels_ AS ({_CONCAT}) SELECT doc, term, round(w, 6) AS w, label FROM vec JOIN labels_ ON doc = o_orderkey")
def labelled_path_features(spark, sf):
    tf = features.term_frequency(features.path_terms(_files(spark, sf).distinct(), "pr"))
    return features.labelled(features.tfidf(tf), _labels(spark, sf)).select("doc", "term", r6("w"), "label")


@query()
def pca_path_features(spark, sf):
    vectors = features.tfidf(_tf(spark, sf))
    got = features.reduced(vectors, _labels(spark, sf), parts=False)
    scratch.drop_written(vectors)
    return got.select("doc", "label", "n_parts", r6("norm2"), r6("kept"))


@query("""WITH f AS (SELECT l_orderkey AS doc, (l_orderkey % 5 = 0)::INT AS label, count(*)::DOUBLE AS x, avg(l_quantity) / 10 AS y FROM lineitem GROUP BY ALL),
c AS (SELECT avg(x) AS mx, avg(y) AS my, 0.5 * atan2(2 * covar_samp(x, y), var_samp(x) - var_samp(y)) AS a FROM f WHERE label = 0)
SELECT doc, label, round(abs((x - mx) * cos(a) + (y - my) * sin(a)), 4) AS first, round(abs((y - my) * cos(a) - (x - mx) * sin(a)), 4) AS second FROM f, c""")
def pca_two_features(spark, sf):
    """Two features of each order, fitted on the rows of label 0 and applied to all: compared with the closed form for two dimensions."""
    per = t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(F.count(F.lit(1)).cast("double").alias("x"), (F.avg("l_quantity") / 10).alias("y"))
    rows = per.select("doc", (F.col("doc") % 5 == 0).cast("int").alias("label"), F.array(F.lit(0), F.lit(1)).alias("indices"), F.array("x", "y").alias("values"))
    part = lambda i, name: F.round(F.abs(F.col("parts")[i]), 4).alias(name)
    return components.principal_components(rows, 2, share=0.9999999).select("doc", "label", part(0, "first"), part(1, "second"))


_MICRO = "string_agg(round(w * 1000000)::BIGINT::VARCHAR, ',' ORDER BY pos)"


@query(f"""WITH {_TERMS}, {_TFIDF}, labels_ AS ({_CONCAT}), v AS (SELECT doc, term, w, label FROM vec JOIN labels_ ON doc = o_orderkey),
dict AS (SELECT term, (row_number() OVER (ORDER BY md5(term)[1:3], term) - 1)::INT AS pos FROM (SELECT DISTINCT term FROM v WHERE label = 0)),
c AS (SELECT doc, count(*) AS n, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS indices, {_MICRO} AS millionths FROM v JOIN dict USING (term) GROUP BY doc)
SELECT doc, label, (SELECT count(*) FROM dict)::INT AS size, coalesce(n, 0) AS n, coalesce(indices, '') AS indices, coalesce(millionths, '') AS millionths FROM (SELECT DISTINCT doc, label FROM v) LEFT JOIN c USING (doc)""")
def sparse_path_features(spark, sf):
    vectors = features.tfidf(_tf(spark, sf))
    got, _ = components.sparse_vectors(vectors, _labels(spark, sf))
    scratch.drop_written(vectors)
    millionths = F.transform("values", lambda w: F.round(w * 1000000).cast("long").cast("string"))
    return got.select("doc", "label", "size", F.size("indices").cast("long").alias("n"), F.array_join(F.col("indices").cast("array<string>"), ",").alias("indices"), F.array_join(millionths, ",").alias("millionths"))


_STOPS = "[" + ", ".join(f"'{w}'" for w in STOP) + "]"
_WORDS = f"words AS (SELECT doc_id AS doc, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+'), lambda w: NOT list_contains({_STOPS}, w)) AS ws FROM documents)"


def _words(spark, sf) -> DataFrame:
    return t(spark, sf, "documents").select(F.col("doc_id").alias("doc"), text.without_stop_words(text.tokens(F.col("text")), STOP).alias("ws"))


def _text_tf(words: DataFrame) -> DataFrame:
    return features.term_frequency(words.select("doc", F.explode("ws").alias("term")))


@query(f"WITH {_WORDS} SELECT doc, len(ws)::BIGINT AS n_tokens, len(list_distinct(ws))::BIGINT AS n_terms FROM words")
def text_tokens(spark, sf):
    return _words(spark, sf).select("doc", F.size("ws").cast("long").alias("n_tokens"), F.size(F.array_distinct("ws")).cast("long").alias("n_terms"))


@query(f"WITH {_WORDS}, tf AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(ws) AS term FROM words) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), n AS (SELECT count(DISTINCT doc) AS n FROM tf), {_TFIDF} SELECT doc, term, round(w, 6) AS w, quality AS label FROM vec JOIN labels ON doc = doc_id")
def text_tfidf(spark, sf):
    labels = t(spark, sf, "labels").select(F.col("doc_id").alias("doc"), F.col("quality").alias("label"))
    return features.labelled(features.tfidf(_text_tf(_words(spark, sf))), labels).select("doc", "term", r6("w"), "label")


_WORD_TF = f"{_WORDS}, wf AS (SELECT doc, word, count(*) AS tf FROM (SELECT doc, unnest(ws) AS word FROM words) GROUP BY ALL), vocabulary AS (SELECT DISTINCT word FROM wf), {porter.stems_sql('vocabulary')}"


@query(f"WITH {_WORD_TF} SELECT word, stem FROM stems")
def porter_stems(spark, sf):
    return porter.stems(_text_tf(_words(spark, sf)).select(F.col("term").alias("word")).distinct())


@query(f"WITH {_WORD_TF}, tf AS (SELECT doc, stem AS term, sum(tf) AS tf FROM wf JOIN stems USING (word) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), n AS (SELECT count(DISTINCT doc) AS n FROM tf), {_TFIDF} SELECT doc, term, round(w, 6) AS w FROM vec")
def text_tfidf_stemmed(spark, sf):
    stemmed = features.stemmed(_text_tf(_words(spark, sf)))
    got = features.tfidf(stemmed)  # which has written the counts by stem
    scratch.drop_written(stemmed)
    return got.select("doc", "term", r6("w"))


# ---- scalars and shaping

_LOGIN = "CASE WHEN c_custkey % 7 = 0 THEN c_name || '[bot]' WHEN c_custkey % 11 = 0 THEN 'codecov-io' ELSE c_name END"


@query(f"SELECT c_custkey, login, contains(login, '[bot]') OR login = 'codecov-io' AS bot FROM (SELECT c_custkey, {_LOGIN} AS login FROM customer)")
def bot_filter(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", F.expr(_LOGIN).alias("login")).withColumn("bot", text.is_bot(F.col("login")))


def _pairs(spark, sf) -> DataFrame:
    """(customer, supplier) pairs of all orders, once each."""
    lines = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    return t(spark, sf, "orders").join(lines, "o_orderkey").select(F.col("o_custkey").cast("string").alias("c"), F.concat(F.lit("s"), "l_suppkey").alias("s")).distinct()


_PAIRS = "pairs AS (SELECT DISTINCT o_custkey::VARCHAR AS c, 's' || l_suppkey AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


def _connection(pairs: DataFrame, key: str, field: str) -> DataFrame:
    """JSON replies (login, reply): one connection per login, made from pairs, read back by the guarded parser."""
    other = "s" if key == "c" else "c"
    edges = F.array_sort(F.collect_list(F.struct(F.col(other).alias("cursor"), F.struct(F.col(other).alias(field)).alias("node"))))
    return pairs.groupBy(F.col(key).alias("login")).agg(F.struct(F.count(F.lit(1)).alias("totalCount"), edges.alias("edges")).alias("list"))


@query(f"WITH {_PAIRS} SELECT c AS login, s AS following_login FROM pairs UNION ALL SELECT c, s FROM pairs")
def follow_edges(spark, sf):
    pairs = _pairs(spark, sf)
    following = _connection(pairs, "c", "login").select(F.to_json(F.struct(F.struct(F.struct("login", F.col("list").alias("following")).alias("user")).alias("data"))).alias("j"))
    followers = _connection(pairs, "s", "login").select(F.to_json(F.struct(F.struct(F.struct("login", F.col("list").alias("followers")).alias("user")).alias("data"))).alias("j"))
    return shaping.follow_edges(following.unionAll(followers).select(readers.nested(F.col("j"), schemas.FOLLOW).alias("r")).select("r.*"))


@query(f"WITH {_PAIRS} SELECT c AS login, s AS repo_full_name, count(*) OVER (PARTITION BY c) AS total, max(s) OVER (PARTITION BY c) AS last_cursor FROM pairs")
def watch_edges(spark, sf):
    replies = _connection(_pairs(spark, sf), "c", "nameWithOwner").select(F.to_json(F.struct(F.struct(F.struct("login", F.col("list").alias("watching")).alias("user")).alias("data"))).alias("j"))
    parsed = replies.select(readers.nested(F.col("j"), schemas.WATCH).alias("r")).select("r.*")
    return shaping.watch_edges(parsed).join(shaping.connection_state(parsed, "watching"), "login")


@query("SELECT 'r' || o_orderstatus AS repository, o_orderkey::VARCHAR AS parent_oid, l_partkey::VARCHAR AS child_oid, 'tree' AS parent_type, l_returnflag AS child_type, l_linenumber::VARCHAR AS child_path FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_linenumber % 5 <> 0")
def tree_entries(spark, sf):
    node = F.when(F.col("l_linenumber") % 5 != 0, F.struct(F.col("l_suppkey").cast("string").alias("id"), F.col("l_partkey").cast("string").alias("oid")))
    entry = F.struct(F.col("l_linenumber").cast("string").alias("name"), F.col("l_returnflag").alias("type"), node.alias("object"))
    trees = t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(entry).alias("entries")).join(t(spark, sf, "orders"), "o_orderkey")
    reply = F.struct(F.struct(F.concat(F.lit("r"), "o_orderstatus").alias("nameWithOwner")).alias("repository"), F.lit("tree").alias("__typename"), F.col("o_orderkey").cast("string").alias("oid"), F.lit("n").alias("id"), "entries")
    parsed = trees.select(readers.nested(F.to_json(reply), schemas.TREE).alias("r")).select("r.*")
    return shaping.tree_entries(parsed).select("repository", "parent_oid", "child_oid", "parent_type", "child_type", "child_path")


@query("SELECT p_brand AS repository, p_partkey::VARCHAR AS oid, 'n' || p_size AS node_id, p_size::BIGINT AS byte_size, p_size > 25 AS is_binary, false AS is_truncated, p_name AS text FROM part")
def blob_records(spark, sf):
    reply = F.struct(F.col("p_partkey").cast("string").alias("oid"), F.concat(F.lit("n"), "p_size").alias("id"), (F.col("p_size") > 25).alias("isBinary"), F.lit(False).alias("isTruncated"), F.col("p_size").alias("byteSize"), F.col("p_name").alias("text"), F.struct(F.col("p_brand").alias("nameWithOwner")).alias("repository"))
    return shaping.blobs(t(spark, sf, "part").select(readers.nested(F.to_json(reply), schemas.BLOB).alias("r")).select("r.*"))


@query("SELECT event_id AS id, event_type AS path, user_id::VARCHAR AS commit_id, props AS body, json_extract_string(props, '$.k')::BIGINT AS original_line, 'u' || user_id AS user_login FROM events")
def comment_records(spark, sf):
    reply = F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("path"), F.col("user_id").cast("string").alias("commit_id"), F.col("props").alias("body"), F.get_json_object("props", "$.k").cast("long").alias("original_line"), F.struct(F.concat(F.lit("u"), "user_id").alias("login"), F.col("user_id").alias("id")).alias("user"))
    got = shaping.comments(t(spark, sf, "events").select(readers.nested(F.to_json(reply), schemas.COMMENT).alias("r")).select("r.*"))
    return got.select("id", "path", "commit_id", "body", "original_line", "user_login")


def _timeline(spark, sf) -> DataFrame:
    """Timelines of all users; signups are null nodes."""
    node = F.when(F.col("event_type") != "signup", F.struct(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("typename"), F.col("ts").cast("string").alias("createdAt")))
    edges = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", node.alias("node")))), lambda x: F.struct(x["node"].alias("node")))
    users = t(spark, sf, "events").groupBy("user_id").agg(edges.alias("edges"))
    reply = F.struct(F.col("user_id").cast("string").alias("id"), F.lit("r").alias("repo_full_name"), F.struct("edges").alias("timelineItems"))
    return shaping.timeline(users.select(readers.nested(F.to_json(reply), schemas.TIMELINE).alias("r")).select("r.*"))


_TIMELINE = "tl AS (SELECT * FROM (SELECT user_id::VARCHAR AS pullrequest_node, event_id::VARCHAR AS timelineitem_node, event_type AS typename, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS position FROM events) WHERE typename <> 'signup')"


@query(f"WITH {_TIMELINE} SELECT * FROM tl")
def timeline_positions(spark, sf):
    return _timeline(spark, sf).select("pullrequest_node", "timelineitem_node", "typename", "position")


@query(f"""WITH {_TIMELINE}, s AS (SELECT *, max(CASE WHEN typename = 'purchase' THEN position END) OVER (PARTITION BY pullrequest_node ORDER BY position) AS since FROM tl WHERE typename IN ('purchase', 'click')),
c AS (SELECT * FROM s WHERE typename = 'click' AND since IS NOT NULL)
SELECT r.pullrequest_node, r.timelineitem_node AS opened, coalesce(c.timelineitem_node, '-1') AS change_node, r.position AS at, coalesce(c.position, -1) AS change_position
FROM (SELECT * FROM s WHERE typename = 'purchase') r LEFT JOIN c ON c.pullrequest_node = r.pullrequest_node AND c.since = r.position""")
def changes_by_round(spark, sf):
    return shaping.changes_by_round(_timeline(spark, sf), "purchase", "click").toDF("pullrequest_node", "opened", "change_node", "at", "change_position")


@query(f"""WITH o AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS made FROM orders), {_FILES}, l AS (SELECT DISTINCT l_orderkey, 's' || l_suppkey AS s FROM lineitem), f AS (SELECT DISTINCT pr, filename FROM files)
SELECT 'p/p' AS repo_full_name, o_orderkey AS pull_number, made AS pr_created_at, s AS reviewer, filename AS file_filename FROM o JOIN l ON o_orderkey = l_orderkey JOIN f ON o_orderkey = pr""")
def reviewer_path_rows(spark, sf):
    paths = _files(spark, sf).groupBy("pr").agg(F.collect_set(F.struct(F.col("filename").alias("location"))).alias("filePaths"))
    who = t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("pr")).agg(F.collect_set(F.struct(F.concat(F.lit("s"), "l_suppkey").alias("name"))).alias("reviewers"))
    at = F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("timestamp")
    replies = t(spark, sf, "orders").select(F.col("o_orderkey").alias("pr"), at).join(paths, "pr").join(who, "pr").withColumnRenamed("pr", "changeNumber")
    return shaping.reviewer_paths(replies, "p").drop("commit").toDF("repo_full_name", "pull_number", "pr_created_at", "reviewer", "file_filename")


@query("SELECT year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, count(*) AS n, min(o_orderkey) AS first_pr FROM orders GROUP BY ALL")
def month_slices(spark, sf):
    got = writers.by_month(t(spark, sf, "orders"), "o_orderdate")
    return got.groupBy("year", "month").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_pr"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity::FLOAT * l_discount::FLOAT)::DOUBLE, 5) AS mul, CASE WHEN l_tax = 0 THEN NULL ELSE round((l_quantity::FLOAT / l_tax::FLOAT)::DOUBLE, 3) END AS div, l_tax = 0 AS infinite FROM lineitem")
def float32_mul_div(spark, sf):
    div = text.float_div(F.col("l_quantity"), F.col("l_tax"))
    infinite = div == F.lit(float("inf"))
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(text.float_mul(F.col("l_quantity"), F.col("l_discount")).cast("double"), 5).alias("mul"), F.when(~infinite, F.round(div.cast("double"), 3)).alias("div"), infinite.alias("infinite"))


# ---- bags: brands that the suppliers of each nation deliver

_BAGS = "bags AS (SELECT s_nationkey AS set_id, p_brand AS key, count(*)::DOUBLE AS cnt FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY ALL), x AS (SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a, nation b WHERE a.n_nationkey < b.n_nationkey)"
_COMMON = f"WITH {_BAGS}, tot AS (SELECT set_id, sum(cnt) AS t FROM bags GROUP BY set_id), c AS (SELECT x, y, sum(a.cnt * b.cnt) AS d, sum(least(a.cnt, b.cnt)) AS n FROM x JOIN bags a ON a.set_id = x JOIN bags b ON b.set_id = y AND b.key = a.key GROUP BY ALL), j AS (SELECT x.x, x.y, coalesce(d, 0) AS d, coalesce(n, 0) AS n, coalesce(tx.t, 0) AS tx, coalesce(ty.t, 0) AS ty FROM x LEFT JOIN c ON c.x = x.x AND c.y = x.y LEFT JOIN tot tx ON tx.set_id = x.x LEFT JOIN tot ty ON ty.set_id = x.y)"


def _bags(spark, sf) -> DataFrame:
    lines = t(spark, sf, "lineitem").join(t(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    lines = lines.join(t(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    return lines.groupBy(F.col("s_nationkey").alias("set_id"), F.col("p_brand").alias("key")).agg(F.count(F.lit(1)).cast("double").alias("cnt"))


def _nation_pairs(spark, sf) -> DataFrame:
    n = t(spark, sf, "nation")
    return n.select(F.col("n_nationkey").alias("x")).join(n.select(F.col("n_nationkey").alias("y")), F.col("x") < F.col("y"))


@query("SELECT lang AS set_id, w AS key, count(*)::DOUBLE AS cnt FROM (SELECT lang, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS w FROM documents) GROUP BY ALL")
def bag_count(spark, sf):
    return bags.count_words(t(spark, sf, "documents").withColumn("ws", text.tokens(F.col("text"))), "lang", "ws")


@query(f"WITH {_BAGS} SELECT set_id, key, sum(cnt) AS cnt FROM (SELECT * FROM bags UNION ALL SELECT r.n_regionkey, key, cnt FROM bags JOIN nation r ON r.n_nationkey = set_id) GROUP BY ALL")
def bag_merge(spark, sf):
    b = _bags(spark, sf)
    region = b.join(t(spark, sf, "nation"), F.col("set_id") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("set_id"), "key", "cnt")
    return bags.merge(b, region)


@query(f"WITH {_BAGS} SELECT set_id, key, round(cnt / sum(cnt) OVER (PARTITION BY set_id), 6) AS cnt FROM bags")
def bag_normalise(spark, sf):
    return bags.normalise(_bags(spark, sf)).select("set_id", "key", r6("cnt"))


@query(f"WITH {_BAGS} SELECT a.set_id, a.key, round(coalesce(a.cnt / b.cnt, a.cnt), 6) AS cnt FROM bags a LEFT JOIN (SELECT set_id + 1 AS set_id, key, cnt FROM bags WHERE key < 'Brand#2') b USING (set_id, key)")
def bag_divide(spark, sf):
    b = _bags(spark, sf)
    return bags.divide(b, b.where("key < 'Brand#2'").withColumn("set_id", F.col("set_id") + 1)).select("set_id", "key", r6("cnt"))


@query(f"{_COMMON} SELECT x, y, d AS dot FROM j")
def bag_dot(spark, sf):
    return bags.dot(_bags(spark, sf), _nation_pairs(spark, sf))


@query(f"{_COMMON} SELECT x, y, round(CASE WHEN tx + ty = 0 THEN 1 ELSE n / (tx + ty) END, 6) AS jaccard FROM j")
def bag_jaccard(spark, sf):
    return bags.jaccard(_bags(spark, sf), _nation_pairs(spark, sf)).select("x", "y", r6("jaccard"))


@query(f"{_COMMON} SELECT x, y, round(CASE WHEN tx + ty = 0 THEN 1 ELSE n / (tx + ty - 0.25 * (tx - n) - 0.75 * (ty - n)) END, 6) AS tversky FROM j")
def bag_tversky(spark, sf):
    return bags.tversky(_bags(spark, sf), _nation_pairs(spark, sf), 0.25, 0.75).select("x", "y", r6("tversky"))


# ---- graphs: customers' orders to suppliers

def _calls(spark, sf) -> DataFrame:
    lines = t(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    ord_ = F.struct("o_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_suppkey")
    return t(spark, sf, "orders").join(lines, "o_orderkey").select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"), F.col("l_extendedprice").alias("cost"), F.col("l_linenumber").alias("r_cnt"), ord_.alias("ord"))


_CALLS = "calls AS (SELECT ('c' || o_custkey) AS src, ('s' || l_suppkey) AS dst, l_extendedprice AS cost, l_linenumber AS r_cnt, {'a': o_orderkey, 'b': l_linenumber, 'c': l_partkey, 'd': l_extendedprice, 'e': l_suppkey} AS ord FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


@query(f"WITH {_CALLS}, i AS (SELECT dst AS node, count(*) AS in_cnt, sum(r_cnt)::BIGINT AS reviewer_cnt FROM calls GROUP BY dst), o AS (SELECT src AS node, count(*) AS author_cnt FROM calls GROUP BY src) SELECT node, coalesce(in_cnt, 0) AS in_cnt, coalesce(author_cnt, 0) AS author_cnt, coalesce(reviewer_cnt, 0) AS reviewer_cnt FROM i FULL JOIN o USING (node)")
def digraph_counters(spark, sf):
    return graphs.calls_summary(_calls(spark, sf))[0]


@query(f"WITH {_CALLS}, e AS (SELECT src, dst, arg_max(cost, ord) AS weight, min(ord) AS ord FROM calls GROUP BY ALL) SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, ord) AS n FROM e) WHERE n = 1")
def best_neighbour(spark, sf):
    return graphs.best_neighbour(graphs.calls_summary(_calls(spark, sf))[1])


@query(f"WITH {_CALLS} SELECT 'author-reviewer' AS type, src AS u, dst AS v, round(sum(cost), 2) AS weight FROM calls GROUP BY ALL")
def edge_accumulate(spark, sf):
    edges = _calls(spark, sf).select("ord", F.lit(schemas.EDGE_KINDS[3]).alias("type"), F.col("dst").alias("u"), F.col("src").alias("v"), F.col("cost").alias("weight"), F.lit("").alias("description"))
    return graphs.accumulate(edges).select("type", "u", "v", F.round("weight", 2).alias("weight"))


@query(f"WITH {_CALLS}, a AS (SELECT 'author' AS type, src AS key, min(ord) AS ord FROM calls GROUP BY ALL UNION ALL SELECT 'reviewer', dst, min(ord) FROM calls GROUP BY ALL) SELECT row_number() OVER (ORDER BY ord, type, key) - 1 AS id, type, key FROM a")
def graph_nodes(spark, sf):
    c = _calls(spark, sf)
    return graphs.add_nodes(c.select("ord", F.lit("author").alias("type"), F.col("src").alias("key")).unionAll(c.select("ord", F.lit("reviewer"), "dst")))


def _incidence(spark, sf) -> DataFrame:
    return t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("edge_id"), F.col("l_suppkey").alias("node_id")).distinct()


def _edge_weights(spark, sf) -> DataFrame:
    return t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("edge_id")).agg(F.count(F.lit(1)).cast("double").alias("weight"))


_INC = "inc AS (SELECT DISTINCT l_orderkey AS edge_id, l_suppkey AS node_id FROM lineitem), ew AS (SELECT l_orderkey AS edge_id, count(*)::DOUBLE AS weight FROM lineitem GROUP BY ALL), sz AS (SELECT edge_id, count(*) AS size FROM inc GROUP BY ALL), dg AS (SELECT node_id, sum(weight) AS degree FROM inc JOIN ew USING (edge_id) GROUP BY ALL)"


@query(f"WITH {_INC}, gone AS (SELECT edge_id FROM sz WHERE size <= 2 AND edge_id IN (SELECT edge_id FROM inc WHERE node_id = 7)) SELECT edge_id, node_id FROM inc WHERE node_id <> 7 AND edge_id NOT IN (SELECT edge_id FROM gone)")
def remove_node(spark, sf):
    left, nodes, edges = graphs.remove_node(_incidence(spark, sf), 7)
    scratch.drop_written(nodes, edges)
    return left


@query(f"WITH {_INC} SELECT node_id AS id, 'node' AS kind, degree FROM dg UNION ALL SELECT edge_id, 'edge', size::DOUBLE FROM sz")
def hypergraph_degrees(spark, sf):
    nodes, edges = graphs.degrees(_incidence(spark, sf), _edge_weights(spark, sf))
    return nodes.select(F.col("node_id").alias("id"), F.lit("node").alias("kind"), "degree").unionAll(edges.select("edge_id", F.lit("edge"), F.col("size").cast("double")))


@query(f"WITH {_INC} SELECT u, v, round(s / sqrt(du.degree * dv.degree), 6) AS value FROM (SELECT a.node_id AS u, b.node_id AS v, sum(weight / size) AS s FROM inc a JOIN inc b USING (edge_id) JOIN ew USING (edge_id) JOIN sz USING (edge_id) GROUP BY ALL) JOIN dg du ON du.node_id = u JOIN dg dv ON dv.node_id = v")
def hypergraph_matrix(spark, sf):
    return graphs.propagation(_incidence(spark, sf), _edge_weights(spark, sf)).select("u", "v", r6("value"))


_NATION_EDGES = "ne AS (SELECT least(c_nationkey, s_nationkey) AS u, greatest(c_nationkey, s_nationkey) AS v, l_quantity AS weight, {'a': o_orderkey, 'b': l_linenumber, 'c': l_partkey, 'd': l_suppkey, 'e': l_quantity} AS ord FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey WHERE c_nationkey <> s_nationkey)"


def _nation_edges(spark, sf) -> DataFrame:
    """(ord, u, v, weight): one edge for each line between two nations, of its quantity."""
    cust = t(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    supp = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    rows = t(spark, sf, "orders").join(t(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey").join(cust, "o_custkey").join(supp, "l_suppkey")
    ord_ = F.struct("o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("ord")
    return rows.where("c_nationkey <> s_nationkey").select(ord_, F.least("c_nationkey", "s_nationkey").alias("u"), F.greatest("c_nationkey", "s_nationkey").alias("v"), F.col("l_quantity").alias("weight"))


@query(f"WITH {_NATION_EDGES}, p AS (SELECT u, v, arg_max(weight, ord) AS w FROM ne GROUP BY ALL), c AS (SELECT u AS i, v AS j, w FROM p UNION ALL SELECT v, u, w FROM p) SELECT i, j, round(w / sum(w) OVER (PARTITION BY j), 6) AS value FROM c WHERE i <> 24")
def random_walk_matrix(spark, sf):
    return graphs.random_walk(_nation_edges(spark, sf), 25).select("i", "j", r6("value"))


_SUMMED = f"{_NATION_EDGES}, e AS (SELECT u, v, sum(weight) AS w FROM ne GROUP BY ALL)"


@query(f"WITH {_SUMMED}, m AS (SELECT sum(w) AS m FROM e), r AS (SELECT e.*, a.n_regionkey AS cu, b.n_regionkey AS cv FROM e JOIN nation a ON a.n_nationkey = u JOIN nation b ON b.n_nationkey = v), d AS (SELECT c, sum(w) AS d FROM (SELECT cu AS c, w FROM r UNION ALL SELECT cv, w FROM r) GROUP BY c), i AS (SELECT cu AS c, sum(w) AS i FROM r WHERE cu = cv GROUP BY ALL) SELECT round(sum(coalesce(i, 0) / m - (d / (2 * m)) ** 2), 6) AS q FROM d LEFT JOIN i USING (c), m")
def modularity_score(spark, sf):
    edges = _nation_edges(spark, sf).groupBy("u", "v").agg(F.sum("weight").alias("weight"))
    parts = t(spark, sf, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("community"))
    return graphs.modularity(edges, parts).select(r6("q"))


@query()
def communities(spark, sf):
    return graphs.communities(_nation_edges(spark, sf).groupBy("u", "v").agg(F.sum("weight").alias("weight")))


def _gexf(spark, sf) -> dict[str, DataFrame]:
    path = scratch.new_path(spark, "gexf")
    nation = t(spark, sf, "nation")
    value = F.array(F.struct(F.lit("modularity_class").alias("for"), F.col("n_regionkey").cast("string").alias("value")))
    nodes = nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("label"), value.alias("attvalues"))
    e = _nation_edges(spark, sf).groupBy("u", "v").agg(F.sum("weight").alias("weight"))
    e = e.select(F.concat_ws("-", "u", "v").alias("id"), F.col("u").alias("source"), F.col("v").alias("target"), "weight")
    writers.write_gexf(nodes, e, path, [("modularity_class", "Modularity Class", "integer")])
    return readers.gexf(spark, path)


@query("SELECT n_nationkey::VARCHAR AS id, n_name AS label, n_regionkey::VARCHAR AS value FROM nation")
def gexf_nodes(spark, sf):
    got = _gexf(spark, sf)["nodes"]
    return got.join(readers.gexf_values(got, "modularity_class"), "id").select("id", "label", "value")


@query(f"WITH {_SUMMED} SELECT u || '-' || v AS id, u::VARCHAR AS source, v::VARCHAR AS target, w AS weight FROM e")
def gexf_edges(spark, sf):
    return _gexf(spark, sf)["edges"].select("id", "source", "target", "weight")


# ---- tags, reports, statistics, ranking, factors


@query()
def tag_corpus(spark, sf):
    rows = t(spark, sf, "conversations").select("conv_id", "turn", F.transform(F.filter(F.split("text", r"[\s/\[\]]+"), lambda w: w != ""), lambda w: F.concat(w, F.when(F.length(w) > 6, F.lit("/ns")).otherwise(F.lit("/n")))).alias("ws"))
    tags = tagging.tags_udf()
    return rows.select("conv_id", "turn", tags("ws").alias("tags")).select("conv_id", "turn", F.size("tags").cast("long").alias("n_chars"), F.size(F.filter("tags", lambda x: x["tag"] == "B")).cast("long").alias("n_places"))


@query(f"WITH r AS (SELECT substr('BMESO', l_linenumber % 5 + 1, 1) AS ref, CASE WHEN l_partkey % 4 = 0 THEN 'O' ELSE substr('BMESO', l_linenumber % 5 + 1, 1) END AS pred FROM lineitem), a AS (SELECT count(*) FILTER (ref <> 'O' AND ref = pred) AS hit, count(*) FILTER (pred <> 'O') AS p, count(*) FILTER (ref <> 'O') AS r FROM r) SELECT round(hit / p, 6) AS precision, round(hit / r, 6) AS recall, round(2 * (hit / p) * (hit / r) / (hit / p + hit / r), 6) AS f1 FROM a")
def tag_scores(spark, sf):
    ref = F.expr("substr('BMESO', l_linenumber % 5 + 1, 1)")
    lines = t(spark, sf, "lineitem").select(ref.alias("ref"), F.when(F.col("l_partkey") % 4 == 0, "O").otherwise(ref).alias("pred"))
    return learning.tag_scores(lines).select(r6("precision"), r6("recall"), r6("f1"))


_PERIODS = "per AS (SELECT o_orderpriority AS sheet, year(o_orderdate) * 12 + month(o_orderdate) AS m, avg(o_totalprice) AS modularity, count(*)::DOUBLE AS entropy, min(o_totalprice) AS top1, max(o_totalprice) AS top3, sum(o_totalprice) AS top5 FROM orders GROUP BY ALL), num AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY m) - 1 AS period FROM per), rep AS (SELECT sheet, period, round(modularity, 2) AS modularity, entropy, round(top1, 2) AS top1, round(top3, 2) AS top3, round(top5, 2) AS top5 FROM num WHERE period < 12)"


def _report(spark, sf) -> DataFrame:
    return shaping.report_values(_report_cells(spark, sf))


def _report_cells(spark, sf) -> DataFrame:
    """Monthly figures of each priority, laid out as the cells of a report sheet."""
    from pyspark.sql import Window

    per = t(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("sheet"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("m")).agg(F.round(F.avg("o_totalprice"), 2).alias("modularity"), F.count(F.lit(1)).cast("double").alias("entropy"), F.round(F.min("o_totalprice"), 2).alias("top1"), F.round(F.max("o_totalprice"), 2).alias("top3"), F.round(F.sum("o_totalprice"), 2).alias("top5"))
    per = per.withColumn("p", F.row_number().over(Window.partitionBy("sheet").orderBy("m")) - 1)
    no = F.lit(None).cast("string")
    s = lambda c: F.col(c).cast("string")
    row = lambda at, *cells: F.struct((F.col("p") * 18 + at).cast("long").alias("row_idx"), *[c.alias(f"c{i}") for i, c in enumerate(cells)])
    cells = F.explode(F.array(
        row(2, F.lit("community"), no, no, no, no, no, no), row(3, no, F.lit("whole"), no, no, s("modularity"), s("entropy"), no),
        row(4, F.lit("accuracy"), no, no, no, no, no, no), row(6, no, no, s("top1"), no, s("top3"), no, s("top5")),
    ))
    return per.select("sheet", cells.alias("x")).select("sheet", "x.*")


@query(f"WITH {_PERIODS} SELECT * FROM rep")
def report_blocks(spark, sf):
    return _report(spark, sf)


@query(f"WITH {_PERIODS} SELECT sheet, round(avg(modularity), 4) AS modularity, round(avg(entropy), 4) AS entropy, round(avg(top1), 4) AS top1 FROM rep GROUP BY sheet")
def period_means(spark, sf):
    got = learning.period_means(_report(spark, sf), "sheet", ["modularity", "entropy", "top1"])
    return got.select("sheet", *[F.round(c, 4).alias(c) for c in ("modularity", "entropy", "top1")])


@query("SELECT round(corr(l_extendedprice, l_quantity), 6) AS corr, count(*) AS n FROM lineitem")
def pearson(spark, sf):
    return learning.pearson(t(spark, sf, "lineitem"), "l_quantity", "l_extendedprice").select(r6("corr"), "n")


# the t distribution's closed form (a finite sum of powers of the cosine) for even and for odd degrees of freedom
@query("""WITH c AS (SELECT l_suppkey, corr(l_quantity, l_discount) AS r, count(*) AS n FROM lineitem GROUP BY ALL),
h AS (SELECT l_suppkey, r, n, n - 2 AS v, asin(abs(r)) AS th, abs(r) AS s, sqrt(1 - r * r) AS co FROM c WHERE n > 3),
e AS (SELECT l_suppkey, v, s * sum(exp(lgamma(k + 0.5) - lgamma(k + 1)) / sqrt(pi()) * co ** (2 * k)) AS a FROM h, range(0, 5000) q(k) WHERE v % 2 = 0 AND k < v // 2 GROUP BY l_suppkey, v, s),
o AS (SELECT l_suppkey, v, 2 / pi() * (any_value(th) + s * sum(exp(lgamma(k + 1) - lgamma(k + 1.5)) * sqrt(pi()) / 2 * co ** (2 * k + 1))) AS a FROM h, range(0, 5000) q(k) WHERE v % 2 = 1 AND k <= (v - 3) // 2 GROUP BY l_suppkey, v, s)
SELECT h.l_suppkey, round(r, 6) AS corr, n, round(greatest(0, 1 - coalesce(e.a, o.a)), 6) AS p FROM h LEFT JOIN e ON e.l_suppkey = h.l_suppkey LEFT JOIN o ON o.l_suppkey = h.l_suppkey""")
def pearson_by_supplier(spark, sf):
    got = learning.pearson_test(t(spark, sf, "lineitem"), "l_quantity", "l_discount", "l_suppkey").where("n > 3")
    return got.select("l_suppkey", r6("corr"), "n", r6("p"))


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem")
def ols_1(spark, sf):
    return learning.line_fit(t(spark, sf, "lineitem"), "l_quantity", "l_extendedprice").select(F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"), r6("r2"))


@query("""WITH x AS (SELECT l_quantity AS a, l_discount * l_discount AS b, l_extendedprice AS y FROM lineitem), c AS (SELECT covar_pop(a, a) AS aa, covar_pop(a, b) AS ab, covar_pop(b, b) AS bb, covar_pop(a, y) AS ay, covar_pop(b, y) AS by_, avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM x),
s AS (SELECT *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS b1, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS b2 FROM c) SELECT round(my - b1 * ma - b2 * mb, 3) AS b0, round(b1, 3) AS b1, round(b2, 3) AS b2 FROM s""")
def ols_2(spark, sf):
    return learning.surface_fit(t(spark, sf, "lineitem"), "l_quantity", "l_discount", "l_extendedprice").select(*[F.round(c, 3).alias(c) for c in ("b0", "b1", "b2")])


@query("""WITH s AS (SELECT p_brand AS pr, 's' || l_suppkey AS candidate, count(*)::DOUBLE AS e, (-max(l_linenumber))::DOUBLE AS r, sum(l_quantity) AS a FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
q AS (SELECT *, round(0.4::DOUBLE * e + 0.2::DOUBLE * r + 0.4::DOUBLE * a, 9) AS score FROM s) SELECT pr, candidate, score, n AS rank FROM (SELECT *, row_number() OVER (PARTITION BY pr ORDER BY score DESC, candidate) AS n FROM q) WHERE n <= 10""")
def top_reviewers(spark, sf):
    part = t(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("pr"))
    scores = t(spark, sf, "lineitem").join(part, "l_partkey").groupBy("pr", F.concat(F.lit("s"), "l_suppkey").alias("candidate")).agg(F.count(F.lit(1)).cast("double").alias("exp"), (-F.max("l_linenumber")).cast("double").alias("rsp"), F.sum("l_quantity").alias("act"))
    return learning.top_reviewers(scores, 10)


@query()
def latent_factors(spark, sf):
    ratings = _bags(spark, sf).select(F.col("set_id").alias("user"), F.regexp_extract("key", r"(\d+)", 1).cast("int").alias("item"), F.log1p("cnt").alias("rate"))
    return learning.latent_factors(ratings).select("user", "item", r6("rate"), F.col("prediction").cast("double").alias("prediction"))


@query("WITH g AS (SELECT ((l_orderkey * 7 + l_partkey + l_linenumber) % 30001 - 10000) / 10000.0::DOUBLE AS x FROM lineitem) SELECT x, round(x * sin(10 * pi() * x) + 2, 9) AS value FROM g ORDER BY 2 DESC, 1 LIMIT 1")
def grid_maximum(spark, sf):
    """Points on [-1, 2], one from the keys of each line."""
    points = t(spark, sf, "lineitem").select((((F.col("l_orderkey") * 7 + F.col("l_partkey") + F.col("l_linenumber")) % 30001 - 10000) / 10000.0).alias("x"))
    return learning.best_on_grid(points, F.round(F.col("x") * F.sin(10 * F.pi() * F.col("x")) + 2, 9))


@query("SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier a WHERE NOT EXISTS (SELECT 1 FROM supplier b WHERE b.s_nationkey <= a.s_nationkey AND b.s_acctbal <= a.s_acctbal AND (b.s_nationkey < a.s_nationkey OR b.s_acctbal < a.s_acctbal))")
def pareto_front(spark, sf):
    return learning.undominated(t(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), "s_nationkey", "s_acctbal")


# ---- landed files: written in the shared folder, read back and compared with the table


def _landed(spark, name: str) -> str:
    return scratch.new_path(spark, name)


@query("SELECT o_orderkey AS pr_id, o_orderstatus AS pr_state, o_custkey AS pr_author, o_orderdate AS pr_created_at FROM orders WHERE o_orderpriority = '5-LOW'")
def reviewer_scan(spark, sf):
    return readers.reviewer_rows(_pull_requests(spark, sf), "5-LOW", limit=None).select("pr_id", "pr_state", "pr_author", "pr_created_at")


@query(f"WITH {_FILES} SELECT pr AS commit_sha, filename FROM files")
def commit_file_sync(spark, sf):
    return readers.all_commit_files(_files(spark, sf).withColumnRenamed("pr", "commit_sha"))[0]


@query("SELECT 's' || l_suppkey AS reviewer, l_orderkey AS request, l_linenumber::BIGINT AS files, l_quantity::DOUBLE AS gap FROM lineitem")
def training_rows_file(spark, sf):
    path, have = _landed(spark, "rows"), {"reviewer": F.concat(F.lit("s"), "l_suppkey"), "request": F.col("l_orderkey"), "files": F.col("l_linenumber"), "gap": F.col("l_quantity")}
    names = [c.split()[0] for c in schemas.TRAIN_ROW.split(", ")]
    t(spark, sf, "lineitem").select(*[have.get(n, F.lit(None)).cast("string").alias(n) for n in names]).write.csv(path, sep="\t")
    return readers.training_rows(spark, path).select(*have)


@query("SELECT p_partkey AS pull_number, p_name AS filename FROM part")
def change_files_file(spark, sf):
    path = _landed(spark, "changes")
    writers.csv_file(t(spark, sf, "part").select(F.col("p_partkey").alias("pull_number"), F.col("p_name").alias("filename")), path)
    return readers.delimited(spark, path, schemas.CHANGE_FILE, ",")


@query("SELECT o_orderkey AS \"changeNumber\", o_custkey AS \"timestamp\", 'a \"}]\" \\{ ' || o_orderpriority AS reviewer, o_orderstatus AS location FROM orders")
def json_array_file(spark, sf):
    """One file that is one array of all orders; strings hold braces, quotes and escapes."""
    path, parts = _landed(spark, "array"), _landed(spark, "array-parts")
    o = t(spark, sf, "orders")
    name = F.concat(F.lit('a "}]" \\{ '), "o_orderpriority")
    row = F.to_json(F.struct(F.col("o_orderkey").alias("changeNumber"), F.col("o_custkey").alias("timestamp"), F.array(F.struct(name.alias("name"))).alias("reviewers"), F.array(F.struct(F.col("o_orderstatus").alias("location"))).alias("filePaths")))
    first = o.agg(F.min_by(row, "o_orderkey").alias("value"), F.min("o_orderkey").alias("k"))
    first.select(F.concat(F.lit("["), "value").alias("value")).coalesce(1).write.text(parts + "-a")
    o.join(F.broadcast(first.select("k")), F.col("o_orderkey") > F.col("k")).select(F.concat(F.lit(","), row).alias("value")).write.text(parts + "-b")  # one row
    spark.range(1).select(F.lit("]").alias("value")).coalesce(1).write.text(parts + "-c")
    writers.merged(spark, [parts + "-a", parts + "-b", parts + "-c"], path)
    got = readers.json_array(spark, path, schemas.CHANGE_DATASET)  # which has written its pieces
    scratch.drop_path(spark, path)
    return got.select("changeNumber", "timestamp", F.col("reviewers")[0]["name"].alias("reviewer"), F.col("filePaths")[0]["location"].alias("location"))


@query("SELECT p_name AS value FROM part WHERE p_name <> ''")
def text_lines_file(spark, sf):
    path = _landed(spark, "lines")
    t(spark, sf, "part").where("p_name <> ''").select("p_name").write.text(path)
    return readers.text_lines(spark, path)


@query("SELECT DISTINCT trim(p_type) AS word FROM part WHERE trim(p_type) <> ''")
def stop_words_file(spark, sf):
    path = _landed(spark, "stop")
    t(spark, sf, "part").select(F.concat(F.lit(" "), "p_type", F.lit("  "))).unionAll(spark.sql("SELECT ''")).write.text(path)
    return readers.stop_words(spark, path)


_SEGMENTED = "seg AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS line_no, n_name AS name FROM nation)"


def _segmented(spark, sf) -> DataFrame:
    """Nations as lines of a segmented corpus, empty lines between them, written and read back."""
    path = _landed(spark, "corpus")
    line = F.concat(F.lit("id"), "n_nationkey", F.lit(" "), F.regexp_replace("n_name", " ", "_"), F.lit("/ns to/p [San_/n Jose/n]ns\n"))
    t(spark, sf, "nation").orderBy("n_nationkey").select(line).coalesce(1).write.text(path)  # 25 lines
    got = readers.corpus(spark, path)
    scratch.drop_path(spark, path)
    return got


@query(f"WITH {_SEGMENTED} SELECT line_no, replace(name, ' ', '_') || '/ns to/p [San_/n Jose/n]ns' AS words FROM seg")
def corpus_file(spark, sf):
    return _segmented(spark, sf).select("line_no", F.array_join("words", " ").alias("words"))


@query(f"WITH {_SEGMENTED} SELECT line_no, 'B' || repeat('M', length(name) - 2) || 'E' || 'OO' || 'BMMMMMME' AS tags FROM seg")
def tag_places(spark, sf):
    tags = tagging.tags_udf()
    return _segmented(spark, sf).select("line_no", F.array_join(F.transform(tags("words"), lambda x: x["tag"]), "").alias("tags"))


_LINES = "lines AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS line_no, 'k' || o_orderkey || '/ns ' || replace(o_orderpriority, ' ', '_') || '/n' AS words FROM orders WHERE o_orderkey % 7 <> 3)"


def _corpus_files(spark, sf) -> DataFrame:
    """Orders as lines of a segmented corpus in a folder of at least six files of very unequal sizes, empty lines between them."""
    path, k = _landed(spark, "corpus"), F.col("o_orderkey")
    part = F.when(k < 40, 0).when(k < 700, 1).when(k < 900, 2).when(k < 4000, 3).when(k < 4100, 4).otherwise(5)
    line = F.when(k % 7 == 3, F.lit("id")).otherwise(F.concat(F.lit(" id"), k, F.lit(" k"), k, F.lit("/ns  "), F.regexp_replace("o_orderpriority", " ", "_"), F.lit("/n")))
    rows = t(spark, sf, "orders").select(line.alias("value"), part.alias("part"), "o_orderkey").repartitionByRange(4, "o_orderkey").sortWithinPartitions("part", "o_orderkey")
    rows.select("value", "part").write.partitionBy("part").text(path)  # sorted by folder already: the writer's own sort isn't stable once it spills
    got = readers.corpus(spark, path)  # which has written its lines
    scratch.drop_path(spark, path)
    return got


@query(f"WITH {_LINES} SELECT line_no, words, line_no % 5 = 0 AS is_test FROM lines")
def corpus_files(spark, sf):
    train, test = readers.every_nth(_corpus_files(spark, sf))
    mark = lambda df, is_test: df.select("line_no", F.array_join("words", " ").alias("words"), F.lit(is_test).alias("is_test"))
    return mark(train, False).unionAll(mark(test, True))


@query(f"WITH {_LINES}, w AS (SELECT line_no, string_split(words, ' ') AS ws FROM lines WHERE line_no % 5 = 0), c AS (SELECT line_no, replace(ws[1], '/ns', '') AS place, replace(ws[2], '/n', '') AS word FROM w), x AS (SELECT line_no, unnest(range(1, length(place) + length(word) + 1)) AS i, place, word FROM c) SELECT row_number() OVER (ORDER BY line_no, i) + line_no // 5 - 1 AS line_no, CASE WHEN i <= length(place) THEN place[i] || chr(9) || CASE WHEN i = 1 THEN 'B' WHEN i = length(place) THEN 'E' ELSE 'M' END ELSE word[i - length(place)] || chr(9) || 'O' END AS value FROM x")
def tagged_test_file(spark, sf):
    """The test lines of the corpus, tagged, written and read back: the order of all lines is compared. (Empty lines between sentences count, but aren't returned.)"""
    path, tags = _landed(spark, "tagged"), tagging.tags_udf()
    corpus = _corpus_files(spark, sf)
    _, test = readers.every_nth(corpus)
    writers.write_tagged(test.select("line_no", tags("words").alias("tags")), path)
    scratch.drop_written(corpus)
    got = readers.ordered_lines(spark, path)
    scratch.drop_path(spark, path)
    return got.where("value <> ''")


@query("SELECT year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, o_orderkey FROM orders")
def month_files(spark, sf):
    path = _landed(spark, "months")
    writers.write_months(t(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", path)
    return readers.delimited(spark, path, "o_orderkey long, o_orderdate string, year int, month int").select("year", "month", "o_orderkey")


@query(f"WITH {_PERIODS} SELECT * FROM rep")
def report_file(spark, sf):
    path = _landed(spark, "report")
    _report_cells(spark, sf).write.partitionBy("sheet").csv(path, header=True)
    return shaping.report_values(readers.report_cells(spark, path))


@query(f"WITH {_PERIODS} SELECT * FROM rep")
def report_sheets(spark, sf):
    """Workbooks of the same figures, one for each priority, and their cells read back."""
    path = _landed(spark, "books")
    sheets.write_workbooks(_report_cells(spark, sf), F.concat(F.lit("book "), "sheet"), path)
    return shaping.report_values(sheets.report_cells(sheets.cells(spark, path)))


@query("SELECT r_name AS section, n_name AS key, n_nationkey || ' = ' || n_regionkey || '; 5' AS value FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT r_name, 'topk', r_regionkey::VARCHAR FROM region")
def settings_files(spark, sf):
    """INI files made of nations by region, with comments, repeated keys and a section of credentials, which never comes back."""
    path = _landed(spark, "settings")
    entry = F.concat("n_name", F.lit("= "), "n_nationkey", F.lit(" = "), "n_regionkey", F.lit("; 5 "))
    per = t(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_join(F.array_sort(F.collect_list(entry)), "\n").alias("x")).join(t(spark, sf, "region"), "r_regionkey")
    text = F.concat(F.lit("# made\n[Authorization]\ntoken = secret\n[ "), "r_name", F.lit(" ]\ntopk: 99\n; no = entry\n\n"), "x", F.lit("\ntopk :"), "r_regionkey", F.lit("\nno entry\n[database]\npassword=secret"))
    per.select(text.alias("value")).repartition(3).write.text(path)
    return readers.settings(spark, path).select("section", "key", "value")


# ---- texts of reviews, nodes for plots

_KINDS = ["user", "assistant", "system", "event"]
_AT = "TIMESTAMP '2024-01-01 00:00:00' + to_minutes(((conv_id * 53 + turn * 11) % 43200)::INT)"
_REVIEWS = f"""tx AS (SELECT conv_id % 150 AS project, role AS kind, {_AT} AS moment, text FROM conversations UNION ALL SELECT user_id % 150, 'event', ts, event_type || ' ' || props FROM events WHERE event_type <> 'purchase'),
rv AS (SELECT event_id AS review, user_id % 150 AS project, ts AS opened, ts + to_hours((event_id % 60)::INT) AS closed FROM events WHERE event_type = 'purchase' AND event_id % 9 <> 0),
hit AS (SELECT review, kind, count(*) AS n_texts, string_agg(text, ' ' ORDER BY moment, text) AS text FROM rv JOIN tx ON rv.project = tx.project AND tx.moment BETWEEN opened AND closed WHERE text IS NOT NULL GROUP BY ALL),
rt AS (SELECT review, kind, coalesce(n_texts, 0) AS n_texts, coalesce(text, '') AS text FROM (SELECT review, unnest(['user', 'assistant', 'system', 'event']) AS kind FROM rv) LEFT JOIN hit USING (review, kind))"""


def _reviews(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Purchases as reviews (every ninth still open) with the turns and other events of their project within their span."""
    e, c = t(spark, sf, "events"), t(spark, sf, "conversations")
    minute = (F.col("conv_id") * 53 + F.col("turn") * 11) % 43200
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=minute.cast("int"))
    texts = c.select((F.col("conv_id") % 150).alias("project"), F.col("role").alias("kind"), at.alias("at"), "text")
    texts = texts.unionAll(e.where("event_type <> 'purchase'").select(F.col("user_id") % 150, F.lit("event"), "ts", F.concat("event_type", F.lit(" "), "props")))
    closed = F.when(F.col("event_id") % 9 != 0, F.col("ts") + F.make_dt_interval(hours=(F.col("event_id") % 60).cast("int")))
    reviews = e.where("event_type = 'purchase'").select(F.col("event_id").alias("review"), (F.col("user_id") % 150).alias("project"), F.col("ts").alias("opened"), closed.alias("closed"))
    return reviews, texts


@query(f"WITH {_REVIEWS} SELECT review, kind, n_texts, md5(text) AS text_md5 FROM rt")
def review_texts(spark, sf):
    return features.review_texts(*_reviews(spark, sf), _KINDS, bucket_seconds=12 * 3600).select("review", "kind", "n_texts", F.md5("text").alias("text_md5"))


@query(f"WITH {_REVIEWS}, ws AS (SELECT review AS doc, kind, unnest(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: NOT list_contains({_STOPS}, w))) AS term FROM rt), tf AS (SELECT doc, term, count(*) AS tf FROM ws GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc, kind, term FROM ws) GROUP BY term), n AS (SELECT count(*) AS n FROM rt), {_TFIDF} SELECT doc, term, round(w, 6) AS w FROM vec")
def review_text_tfidf(spark, sf):
    reviews, texts = _reviews(spark, sf)
    words = texts.withColumn("ws", text.without_stop_words(text.tokens(F.col("text")), STOP))
    return features.review_tfidf(reviews, words, _KINDS, bucket_seconds=12 * 3600).select("doc", "term", r6("w"))


@query("SELECT o_orderkey AS id, 'pr' AS type, 100 AS size, 'r' AS colour FROM orders UNION ALL SELECT s_suppkey, 'reviewer', 300, 'b' FROM supplier UNION ALL SELECT c_custkey, 'author', 300, 'g' FROM customer")
def plot_nodes(spark, sf):
    kind = lambda table, key, name: t(spark, sf, table).select(F.col(key).alias("id"), F.lit(name).alias("type"))
    return writers.plot_nodes(kind("orders", "o_orderkey", "pr").unionAll(kind("supplier", "s_suppkey", "reviewer")).unionAll(kind("customer", "c_custkey", "author")))


# ---- rows with vectors, lookups, moves of communities, fronts


@query(f"WITH {_TERMS}, {_TFIDF}, r AS (SELECT o_orderkey AS pr, o_custkey AS author FROM orders UNION ALL SELECT -o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P') SELECT pr, author, term, round(w, 6) AS w FROM r LEFT JOIN vec ON doc = pr")
def rows_with_vectors(spark, sf):
    """All orders, and ids without files for those of status P."""
    rows = t(spark, sf, "orders").select(F.col("o_orderkey").alias("pr"), F.col("o_custkey").alias("author"), "o_orderstatus")
    rows = rows.drop("o_orderstatus").unionAll(rows.where("o_orderstatus = 'P'").select(-F.col("pr"), "author"))
    return features.with_vectors(rows, features.tfidf(_tf(spark, sf)), "pr").select("pr", "author", "term", r6("w"))


@query("SELECT o_orderkey, o_custkey, n FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL) ON l_orderkey = o_orderkey")
def rows_joined_back(spark, sf):
    found = t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(F.count(F.lit(1)).alias("n"))
    return features.joined_back(t(spark, sf, "orders").select("o_orderkey", "o_custkey"), found, "o_orderkey")


@query(f"WITH tx AS (SELECT p_partkey AS doc, coalesce(p_name, '') || ' ' || coalesce(p_type, '') AS text FROM part), words AS (SELECT doc, list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: NOT list_contains({_STOPS}, w)) AS ws FROM tx), tf AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(ws) AS term FROM words) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), n AS (SELECT count(DISTINCT doc) AS n FROM tf), {_TFIDF} SELECT doc, term, round(w, 6) AS w FROM vec")
def title_body_tfidf(spark, sf):
    p = t(spark, sf, "part")
    texts = features.title_and_body(p.select(F.col("p_partkey").alias("doc")), p.select(F.col("p_partkey").alias("number"), F.col("p_name").alias("title"), F.col("p_type").alias("body")))
    words = texts.select("doc", text.without_stop_words(text.tokens(F.col("text")), STOP).alias("ws"))
    return features.tfidf(_text_tf(words)).select("doc", "term", r6("w"))


_NODES = "nodes AS (SELECT n_nationkey AS id, 'nation' AS type, n_name AS key FROM nation UNION ALL SELECT 100 + r_regionkey, 'region', r_name FROM region)"


def _nodes(spark, sf) -> DataFrame:
    n = t(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.lit("nation").alias("type"), F.col("n_name").alias("key"))
    return n.unionAll(t(spark, sf, "region").select((F.col("r_regionkey") + 100).alias("id"), F.lit("region"), "r_name"))


@query(f"WITH {_NODES}, w AS (SELECT * FROM (VALUES ('nation', 'FRANCE'), ('region', 'ASIA'), ('region', 'FRANCE')) v(type, key)) SELECT w.type, w.key, id FROM w LEFT JOIN nodes USING (type, key)")
def lookup_nodes_by_key(spark, sf):
    return graphs.nodes_by_key(_nodes(spark, sf), spark.createDataFrame([("nation", "FRANCE"), ("region", "ASIA"), ("region", "FRANCE")], "type string, key string"))


@query(f"WITH {_NODES}, w AS (SELECT * FROM (VALUES (3), (101), (999)) v(id)) SELECT w.id::BIGINT AS id, type, key FROM w LEFT JOIN nodes USING (id)")
def lookup_nodes_by_id(spark, sf):
    return graphs.nodes_by_id(_nodes(spark, sf), spark.createDataFrame([(3,), (101,), (999,)], "id long"))


@query(f"WITH {_SUMMED}, w AS (SELECT * FROM (VALUES (3, 1), (1, 24), (5, 5)) v(a, b)) SELECT 'trade' AS type, least(a, b)::BIGINT AS u, greatest(a, b)::BIGINT AS v, w AS weight FROM w LEFT JOIN e ON u = least(a, b) AND v = greatest(a, b)".replace("w AS weight FROM w LEFT", "e.w AS weight FROM w LEFT"))
def lookup_edges_by_ends(spark, sf):
    edges = _nation_edges(spark, sf).groupBy("u", "v").agg(F.sum("weight").alias("weight")).withColumn("type", F.lit("trade"))
    return graphs.edges_by_ends(edges, spark.createDataFrame([("trade", 3, 1), ("trade", 1, 24), ("trade", 5, 5)], "type string, u long, v long"))


@query(f"WITH {_CALLS}, e AS (SELECT src, dst, arg_max(cost, ord) AS weight FROM calls GROUP BY ALL) SELECT src AS node, dst AS neighbour, weight FROM e WHERE src IN ('c1', 'c7', 'c13')")
def neighbours(spark, sf):
    return graphs.neighbours(graphs.calls_summary(_calls(spark, sf))[1], spark.createDataFrame([("c1",), ("c7",), ("c13",), ("none",)], "node string"))


@query(f"WITH {_CALLS}, e AS (SELECT src, dst, arg_max(cost, ord) AS weight, min(ord) AS ord FROM calls GROUP BY ALL) SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, ord) AS n FROM e WHERE NOT (length(src) + length(dst)) % 2 = 0) WHERE n = 1")
def best_unmarked_neighbour(spark, sf):
    edges = graphs.calls_summary(_calls(spark, sf))[1]
    return graphs.best_neighbour(edges, edges.where("(length(src) + length(dst)) % 2 = 0").select("src", "dst"))


@query(f"WITH {_CALLS} SELECT dst AS key, arg_max(cost, ord) AS value, (SELECT count(*) FROM calls) AS num_nodes FROM calls GROUP BY dst")
def nodes_overwritten(spark, sf):
    return graphs.overwrite_nodes(_calls(spark, sf).select("ord", F.col("dst").alias("key"), F.col("cost").alias("value")))


@query("SELECT n_name AS key FROM nation")
def node_keys(spark, sf):
    return graphs.node_keys(_nodes(spark, sf), "nation")


@query(f"WITH {_NODES}, {_SUMMED} SELECT 'node ' || id || ' ' || type || ' ' || key AS line FROM nodes UNION ALL SELECT 'edge trade ' || u || ' ' || v || ' ' || printf('%.2f', w) FROM e".replace(", WITH", ","))
def graph_lines(spark, sf):
    edges = _nation_edges(spark, sf).groupBy("u", "v").agg(F.sum("weight").alias("weight")).withColumn("type", F.lit("trade"))
    return graphs.printed(_nodes(spark, sf), edges)


@query(f"WITH {_FILES} SELECT DISTINCT o_custkey AS request, filename FROM orders JOIN files ON pr = o_orderkey JOIN customer ON c_custkey = o_custkey")
def request_files(spark, sf):
    requests = t(spark, sf, "customer").select(F.col("c_custkey").alias("request"))
    commits = t(spark, sf, "orders").select(F.col("o_custkey").alias("request"), F.col("o_orderkey").alias("commit"))
    return shaping.request_files(requests, commits, _files(spark, sf).withColumnRenamed("pr", "commit"))


@query(f"WITH {_PAIRS} SELECT c AS login, s AS following_login FROM pairs")
def follow_edges_once(spark, sf):
    """Follow edges that two replies tell of, once by their identity key."""
    return shaping.one_of_each(follow_edges(spark, sf), "follow")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity + l_tax AS x, l_discount + l_linenumber AS y FROM lineitem")
def struct_sums(spark, sf):
    pair = lambda x, y: F.array(F.struct(F.col(x).alias("x"), F.col(y).cast("double").alias("y")))
    lines = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", text.add_structs(pair("l_quantity", "l_discount"), pair("l_tax", "l_linenumber"), ["x", "y"])[0].alias("s"))
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "s.x", "s.y")


@query(f"WITH {_CALLS}, e AS (SELECT src, dst, arg_max(cost, ord) AS weight FROM calls GROUP BY ALL), p AS (SELECT 'c' || c_custkey AS src, 's' || (c_custkey % 10 + 1) AS dst FROM customer) SELECT p.src, p.dst, weight IS NOT NULL AS held, weight FROM p LEFT JOIN e ON e.src = p.src AND e.dst = p.dst")
def edge_weights(spark, sf):
    pairs = t(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("s"), F.col("c_custkey") % 10 + 1).alias("dst"))
    return graphs.edge_weights(graphs.calls_summary(_calls(spark, sf))[1], pairs)


@query(f"WITH {_SUMMED} SELECT (SELECT count(*) FROM nation) AS n_nodes, (SELECT count(*) FROM e) AS n_edges")
def graph_counts(spark, sf):
    return spark.createDataFrame([writers.graph_counts(t(spark, sf, "nation"), _nation_edges(spark, sf).select("u", "v").distinct())], "n_nodes long, n_edges long")


@query()
def louvain_score(spark, sf):
    """The partition of nations that moves make, and its modularity."""
    edges = scratch.written(_nation_edges(spark, sf).groupBy("u", "v").agg(F.sum("weight").alias("weight")), "nations")
    parts, q = graphs.louvain(edges)
    scratch.drop_written(edges)
    return parts.select("node", "community", F.lit(round(q, 9)).alias("q"))


_GRID = "g AS (SELECT DISTINCT l_quantity::DOUBLE / 10 AS x1, round(l_discount::DOUBLE * 30, 6) AS x2 FROM lineitem)"


@query(f"""WITH {_GRID}, f AS (SELECT x1, x2, 4 * x1 * x1 + 4 * x2 * x2 AS f1, (x1 - 5) * (x1 - 5) + (x2 - 5) * (x2 - 5) AS f2 FROM g WHERE (x1 - 5) * (x1 - 5) + x2 * x2 <= 25 AND (x1 - 8) * (x1 - 8) + (x2 - 3) * (x2 - 3) >= 7.7)
SELECT round(x1, 6) AS x1, round(x2, 6) AS x2, round(f1, 6) AS f1, round(f2, 6) AS f2 FROM f a WHERE NOT EXISTS (SELECT 1 FROM f b WHERE b.f1 <= a.f1 AND b.f2 <= a.f2 AND (b.f1 < a.f1 OR b.f2 < a.f2))""")
def constrained_front(spark, sf):
    """Points on [0, 5] x [0, 3] from the quantities and discounts of all lines."""
    points = t(spark, sf, "lineitem").select((F.col("l_quantity").cast("double") / 10).alias("x1"), F.round(F.col("l_discount").cast("double") * 30, 6).alias("x2")).distinct()
    return learning.undominated(learning.constrained_points(points), "f1", "f2").select(r6("x1"), r6("x2"), r6("f1"), r6("f2"))


@query(f"WITH {_SUMMED} SELECT u || '-' || v AS id, 'n' || u AS label, '2020' AS start, '2021' AS \"end\", u::INT AS r, v::INT AS g, v::VARCHAR AS value FROM e")
def gexf_edge_details(spark, sf):
    path, n = _landed(spark, "gexf"), t(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("label"), F.lit("1999").alias("start"))
    e = _nation_edges(spark, sf).select("u", "v").distinct()
    colour = F.struct(F.col("u").alias("r"), F.col("v").alias("g"), F.lit(0).alias("b")).alias("colour")
    value = F.array(F.struct(F.lit("k").alias("for"), F.col("v").cast("string").alias("value"))).alias("attvalues")
    e = e.select(F.concat_ws("-", "u", "v").alias("id"), F.col("u").alias("source"), F.col("v").alias("target"), F.concat(F.lit("n"), "u").alias("label"), F.lit("2020").alias("start"), F.lit("2021").alias("end"), colour, value)
    writers.write_gexf(n, e, path, mode="dynamic", edge_attributes=[("k", "Kind", "string")])
    got = readers.gexf(spark, path)["edges"]
    return got.join(readers.gexf_values(got, "k"), "id").select("id", "label", "start", "end", "colour.r", "colour.g", "value")
