"""The queries of this package and their SQL. Each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontam, html_extract, langid, mil_quality, mixing, near_dup, quality_rules, sharding, toxicity, url_filter, warc, whitening
from .shared import fold

LOWER_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = quality_rules.quality(docs, quality_rules.trained(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return got.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(table(spark, sf_dir, "pages"))
    got = warc.read_archives(archives, payloads=False)
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    n_hit = decontam.hit_words(F.col("spans"))
    return got.select("row.doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = mil_quality.trained(docs, table(spark, sf_dir, "labels"), keep=lambda i: F.crc32(i.cast("string")) % 4 != 2)
    got = mil_quality.quality_score(docs, model, keep=["doc_id"])
    return got.select("row.doc_id", (fold("row.doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


#: allow and block rules (verdict, host, path)
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: size of the made part of the list of canonical URLs
URL_LIST = 120_000


def url_list(pages: DataFrame) -> DataFrame:
    """The list that the Bloom filter holds: hosts, folders and pages made by a rule, and such of pages, drawn by a hash of their names."""
    i = F.col("id").cast("string")
    made = F.when(F.col("id") % 3 == 0, F.concat(F.lit("spam-"), i, F.lit(".example.org/"))).when(F.col("id") % 3 == 1, F.concat(F.lit("free-bets.example.net/"), i, F.lit("/"))).otherwise(F.concat(F.lit("pills.example.org/item/"), i))
    url = F.col("url").cast("string")
    own = pages.select(url_filter.canonical(url_filter.host_of(url), url_filter.path_of(url)).alias("entry")).where("entry <> '/'").distinct()
    host, folder = F.concat(F.substring_index("entry", "/", 1), F.lit("/")), F.regexp_extract("entry", r"(?s)^(.*/)[^/]*$", 1)
    drawn = lambda e, parts: own.select(e.alias("entry")).where(F.conv(F.substring(F.md5("entry"), 1, 6), 16, 10).cast("long") % parts == 1)
    return pages.sparkSession.range(URL_LIST).select(made.alias("entry")).unionAll(drawn(F.col("entry"), 50)).unionAll(drawn(folder, 40)).unionAll(drawn(host, 30)).where("entry <> ''")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    got = url_filter.judged(pages, url_list(pages), URL_RULES, keep=["page_id"])
    return got.select("row.page_id", "host", "path", "rule", "verdict", "listed_by")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.trained(docs, table(spark, sf_dir, "labels"), keep=lambda i: F.crc32(i.cast("string")) % 5 != 0)
    got = toxicity.toxicity(docs, model, keep=["doc_id"])
    return got.select("row.doc_id", (fold("row.doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.planned(table(spark, sf_dir, "documents"), keep=["doc_id"])
    each = lambda field: F.array_join(F.transform("draws", lambda x: x[field].cast("string")), ",")
    return got.select(
        "row.doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).cast("long").alias("taken"),
        F.size("draws").cast("long").alias("copies"), each("shard").alias("shards"), each("order_key").alias("order_keys"),
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sharding.sharded(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return got.select("row.doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = html_extract.main_text(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return got.select("row.page_id", "row.url", "text", "n_chars")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = near_dup.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)
    return got.withColumn("kept", got.doc_id == got.component_id)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    model = whitening.fitted(rows, "embedding", components=4)
    got = whitening.whitened(rows, "embedding", model, keep=["vec_id"])
    n, trace, error = (model["n"], model["trace"], model["identity_error"]) if model else (0, 0.0, 0.0)
    values, residuals = (model["values"], model["residuals"]) if model else ((), ())
    per = lambda x: F.array(*[F.lit(float(v)) for v in x]).cast("array<double>")[F.col("i")]
    got = got.select("row.vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    return got.select(
        "vec_id", (F.col("i") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        (per(values) / F.lit(trace or 1.0)).alias("explained"), F.lit(error).alias("identity_error"), per(residuals).alias("residual"),
    )


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.trained(docs, keep=lambda i: fold("doc_id", 5) != 0)
    got = langid.identified(docs, model, keep=["doc_id"])
    return got.select("row.doc_id", (fold("row.doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_warc": op2_warc,
    "op3_decontamination": op3_decontamination,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_url_filters": op5_url_filters,
    "op6_toxicity": op6_toxicity,
    "op7_mixing": op7_mixing,
    "op8_html_extraction": op8_html_extraction,
    "op9_sharding": op9_sharding,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_language_id": op13_language_id,
}

ALNUM_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = {
    "op2_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS DISTINCT FROM top AND page_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM top AND page_id IS NOT NULL THEN top END AS refers_to FROM m""",
    "op3_decontamination": rf"""
WITH d AS (SELECT doc_id, coalesce({ALNUM_WORDS}, []) AS ws FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {ALNUM_WORDS} AS ws FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
w AS (SELECT DISTINCT item, unnest(list_transform(range(1, greatest(len(ws) - 9, 1) + 1), lambda i: ws[i:i+9])) AS win FROM b WHERE len(ws) > 0),
k AS (SELECT DISTINCT len(win) AS size FROM w),
p AS (SELECT doc_id, size, i, ws[i:i + size - 1] AS win FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM d, k)),
h AS (SELECT p.doc_id, p.i, p.size, w.item FROM p JOIN w ON p.win = w.win),
n AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS pos FROM (SELECT DISTINCT doc_id, i, size FROM h)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op5_url_filters": r"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*(/[^?#]*)?', 1, 's') AS path FROM pages),
rules(v, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
r AS (SELECT u.*, v, h || p AS rule, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST, h || p) AS n
  FROM u LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
cu AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(regexp_replace(host, '^[^@]*@', ''), '(:[0-9]*)?\.?$', ''), '^www\.', '') || CASE WHEN path = '' THEN '/' ELSE regexp_replace(path, '/+', '/', 'g') END END AS url
  FROM r WHERE n = 1),
own AS (SELECT DISTINCT url FROM cu WHERE url <> '/'),
list AS (SELECT CASE i % 3 WHEN 0 THEN 'spam-' || i || '.example.org/' WHEN 1 THEN 'free-bets.example.net/' || i || '/' ELSE 'pills.example.org/item/' || i END AS entry FROM range(120000) q(i)
  UNION SELECT url FROM own WHERE ('0x' || md5(url)[1:6])::BIGINT % 50 = 1
  UNION SELECT f FROM (SELECT regexp_extract(url, '^(.*/)[^/]*$', 1, 's') AS f FROM own) WHERE ('0x' || md5(f)[1:6])::BIGINT % 40 = 1
  UNION SELECT h FROM (SELECT string_split(url, '/')[1] || '/' AS h FROM own) WHERE ('0x' || md5(h)[1:6])::BIGINT % 30 = 1),
seen AS (SELECT DISTINCT url, string_split(string_split(url, '/')[1], '.') AS labels FROM cu WHERE url IS NOT NULL),
looked AS (SELECT url, url AS entry FROM seen UNION SELECT url, regexp_replace(url, '/$', '') FROM seen
  UNION SELECT url, unnest(list_transform(list_filter(range(1, length(url) + 1), lambda i: url[i] = '/'), lambda i: url[1:i])) FROM seen
  UNION SELECT url, unnest(list_transform(list_filter(range(1, len(labels) + 1), lambda i: i = 1 OR i < len(labels)), lambda i: array_to_string(labels[i:], '.') || '/')) FROM seen),
hit AS (SELECT url, arg_max(entry, {'n': length(entry), 'e': entry}) AS listed_by FROM looked JOIN list USING (entry) WHERE entry NOT IN ('', '/') GROUP BY url)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN listed_by IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, listed_by FROM cu LEFT JOIN hit USING (url)""",
    "op7_mixing": r"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
  ('0x' || md5('7:' || coalesce(doc_id::VARCHAR, 'null'))[1:15])::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w, 2.0::DOUBLE * source_size AS top,
  row_number() OVER (ORDER BY source NULLS LAST) AS rank, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s),
o AS (SELECT *, row_number() OVER x AS pos, coalesce(sum(top) OVER (ORDER BY top / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(w) OVER (ORDER BY top / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM r WINDOW x AS (ORDER BY top / w, rank)),
k AS (SELECT arg_min(total - before, pos) AS rest, arg_min(after, pos) AS wsum, min(pos) AS k FROM o WHERE (total - before) * w < top * after),
t AS (SELECT source, source_size, CASE WHEN k IS NULL OR pos < k THEN top ELSE rest * w / wsum END AS target FROM o, k),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes FROM t),
g AS (SELECT source, h, doc_id::VARCHAR AS id, size, sum(size) AS words FROM d GROUP BY ALL),
c AS (SELECT g.source, g.h, g.id, g.size, sum(words) OVER (PARTITION BY g.source ORDER BY g.h, g.id, g.size ROWS UNBOUNDED PRECEDING) - words / 2.0::DOUBLE <= target - passes * source_size AND target - passes * source_size > 0 AS part
  FROM g JOIN e ON g.source IS NOT DISTINCT FROM e.source),
y AS (SELECT coalesce(min(x), 18) AS depth FROM range(5, 18) q(x) WHERE 2000000.0::DOUBLE * 2 ** x >= (SELECT 1.5::DOUBLE * coalesce(sum(size), 0) FROM d)),
bl AS (SELECT source, h >> (55 - depth)::INT AS b, sum(size) AS words FROM d, y GROUP BY ALL),
fb AS (SELECT bl.source, min(b) FILTER (upto >= target - passes * source_size AND target - passes * source_size > 0) AS fb
  FROM (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY b) AS upto FROM bl) bl JOIN e ON e.source IS NOT DISTINCT FROM bl.source GROUP BY bl.source),
cp AS (SELECT bl.source, coalesce('s' || bl.source, 'n') AS key, b, unnest(range(0, (passes + (b <= coalesce(fb, -1))::INT)::BIGINT)) AS copy
  FROM bl JOIN e ON e.source IS NOT DISTINCT FROM bl.source JOIN fb ON fb.source IS NOT DISTINCT FROM bl.source),
pm AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ('0x' || md5('7:block:' || key || ':' || b || ':' || copy)[1:15])::BIGINT, b, copy) AS i FROM cp),
tree(key, i, node, level) AS (SELECT key, i, 0::BIGINT, 0 FROM pm UNION ALL
  SELECT key, i, 2 * node + (row_number() OVER (PARTITION BY node ORDER BY ('0x' || md5('7:tree:' || level || ':' || node || ':' || key || ':' || i)[1:15])::BIGINT, key, i) > count(*) OVER (PARTITION BY node) // 2)::INT, level + 1
  FROM tree WHERE level < (SELECT depth FROM y)),
lf AS (SELECT key, node AS shard, count(*) AS quota FROM tree WHERE level = (SELECT depth FROM y) GROUP BY ALL),
le AS (SELECT *, sum(quota) OVER (PARTITION BY key ORDER BY shard) AS upto FROM lf),
dr AS (SELECT pm.source, pm.b, pm.copy, le.shard FROM pm JOIN le ON le.key = pm.key AND pm.i <= le.upto AND pm.i > le.upto - le.quota),
w AS (SELECT d.*, e.source_size, e.target, e.passes, part, d.h >> (55 - depth)::INT AS b, row_number() OVER () AS n
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.h = c.h AND d.doc_id::VARCHAR IS NOT DISTINCT FROM c.id AND d.size = c.size, y),
f AS (SELECT n, count(*) AS copies, string_agg(shard::VARCHAR, ',' ORDER BY copy) AS shards, string_agg((('0x' || md5('7:row:' || shard || ':' || copy || ':' || h)[1:15])::BIGINT)::VARCHAR, ',' ORDER BY copy) AS order_keys
  FROM w JOIN dr ON dr.source IS NOT DISTINCT FROM w.source AND dr.b = w.b AND (dr.copy < passes OR part) GROUP BY n)
SELECT doc_id, size, source_size, target, (size * coalesce(copies, 0))::BIGINT AS taken, coalesce(copies, 0)::BIGINT AS copies, coalesce(shards, '') AS shards, coalesce(order_keys, '') AS order_keys
FROM w LEFT JOIN f USING (n)""",
    "op10_minhash_near_dedup": rf"""
WITH RECURSIVE w AS (SELECT doc_id, {LOWER_WORDS} AS ws FROM documents WHERE text IS NOT NULL),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(ws) - 3, 1) + 1), lambda i: ws[i:i+3])) AS sh FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 80 * (nx.n + ny.n - k)),
e AS (SELECT x AS a, y AS b FROM l UNION ALL SELECT y, x FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, least(a, min(b)) AS c FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.c, d.doc_id)::BIGINT AS component_id, d.doc_id = coalesce(c.c, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)""",
    "op12_phrase_collocations": r"""
WITH p AS (SELECT row_number() OVER () AS id, lang, unnest(regexp_extract_all(x, '[^.,;:!?\x0A-\x0D]+')) AS piece
  FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents)),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 5) q(k) WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
cut AS (SELECT c.*, i, array_to_string(ws[1:i], ' ') AS x, array_to_string(ws[i + 1:], ' ') AS y FROM c, range(1, 4) q(i) WHERE i < k),
sc AS (SELECT cut.*, fx.f AS l, fy.f AS r, ((2000000::HUGEINT * a) // (fx.f::HUGEINT + fy.f))::BIGINT AS score FROM cut JOIN f fx ON fx.lang = cut.lang AND fx.phrase = x JOIN f fy ON fy.lang = cut.lang AND fy.phrase = y),
b AS (SELECT lang, k, phrase, a, l, r, score FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) AS o FROM sc) WHERE o = 1),
sub AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT c.lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')] || CASE WHEN k = 4 THEN [array_to_string(ws[3:4], ' '), array_to_string(ws[1:3], ' '), array_to_string(ws[2:4], ' ')] ELSE [] END) AS phrase FROM c WHERE k > 2) GROUP BY ALL),
kept AS (SELECT b.* FROM b LEFT JOIN sub USING (lang, phrase) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000""",
}
