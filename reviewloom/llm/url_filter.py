"""URL filters with DataFrame functions only: a blocked Bloom filter before an exact hash join.

A list holds canonical URLs, of a page, of a folder (ending in "/") or of a host ("host/"). A URL is listed if the
list holds it, one of its folders, its host or a parent domain. Allow and block rules on (host, path prefix) are entries
of the same filter and come first. All that could name a URL are its candidates: distinct candidates are looked up in a
Bloom filter whose bits lie in blocks of 512, so that a candidate reads one block. Possible hits then meet the entries in
an equi-join, which removes false positives, and go back to their URLs.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import drop_written, salted_join, written

#: bits of a block, bits set for an entry, bits of the filter for an entry
BLOCK_BITS, HASHES, BITS_PER_ENTRY = 512, 8, 16
#: filters of up to this many blocks (64 bytes each) are broadcast; larger ones are joined by shuffle
BROADCAST_BLOCKS = 500_000
#: entries that were hit, up to this many, are broadcast to the URLs; more are joined by shuffle
BROADCAST_HITS = 100_000
URLS_A_TASK = 100_000
WORDS = BLOCK_BITS // 64


def host_of(url: Column) -> Column:
    """Between the first :// and the next / ? # or the end, A-Z lower-cased; empty without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the host's end to the next ? # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*(/[^?#]*)?", 1)


def canonical(host: Column, path: Column) -> Column:
    """host + path, without user, port, a leading www. and a trailing slash run; an empty path counts as "/"."""
    h = F.regexp_replace(F.regexp_replace(host, r"^[^@]*@", ""), r"(:\d*)?\.?$", "")
    return F.concat(F.regexp_replace(h, r"^www\.", ""), F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, r"/+", "/")))


def _ints(values: list) -> Column:
    """A constant array."""
    return F.from_json(F.lit(json.dumps(sorted(values))), "array<int>")


def _suffix(host: Column, n: Column) -> Column:
    """Whether the last n characters of a host are the host itself or a parent domain."""
    return (F.length(host) == n) | ((F.length(host) > n) & (F.substr(host, F.length(host) - n, F.lit(1)) == "."))


def list_lengths(entries: DataFrame) -> tuple[list[int], list[int]]:
    """Distinct lengths of the folders (with their host) and of the hosts of a list: as many as the longest entry has characters, at most."""
    got = entries.where(F.endswith("entry", F.lit("/"))).select(F.length("entry").alias("n"), (F.instr("entry", "/") == F.length("entry")).alias("host"))
    rows = got.distinct().collect()
    return sorted({r.n for r in rows}), sorted({r.n - 1 for r in rows if r.host})


def candidates(url: Column, folders: list[int], hosts: list[int]) -> Column:
    """All entries of a list that would list this canonical URL: itself, its folders, its host and parent domains.

    Only folders and domains of a length that the list has are named: their number and size don't grow with the URL's.
    """
    host = F.substring_index(url, "/", 1)
    own = F.array(url, F.regexp_replace(url, "/$", ""))
    above = F.transform(F.filter(_ints(folders), lambda n: F.substr(url, n, F.lit(1)) == "/"), lambda n: F.substr(url, F.lit(1), n))
    dotted = F.contains(host, F.lit("."))
    inside = lambda n: (F.length(host) == n) | (dotted & F.contains(F.right(host, n), F.lit(".")))  # noqa: E731  a top domain lists none but itself
    parents = F.transform(F.filter(_ints(hosts), lambda n: _suffix(host, n) & inside(n)), lambda n: F.concat(F.right(host, n), F.lit("/")))
    return F.filter(F.array_distinct(F.concat(own, above, parents)), lambda x: (x != "") & (x != "/"))


def rule_candidates(host: Column, path: Column, lengths: list[tuple[int, int]]) -> Column:
    """All rules (host and path, joined) that would fit: lengths are the distinct (host, path) lengths of the rules."""
    pairs = F.from_json(F.lit(json.dumps([{"h": h, "p": p} for h, p in lengths])), "array<struct<h:int,p:int>>")
    fits = F.filter(pairs, lambda x: _suffix(host, x["h"]) & (F.length(path) >= x["p"]))
    return F.transform(fits, lambda x: F.concat(F.right(host, x["h"]), F.left(path, x["p"])))


def _block(entry: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(entry), F.lit(blocks))


def _bit(entry: Column, k: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(k), entry), F.lit(BLOCK_BITS)).cast("int")


def bloom(entries: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 ... w7): the filter of entries (entry); one row for every block that has a bit."""
    bits = entries.select(_block(F.col("entry"), blocks).alias("block"), *[_bit(F.col("entry"), k).alias(f"b{k}") for k in range(HASHES)])
    one = lambda k, w: F.when(F.floor(F.col(f"b{k}") / 64) == w, F.expr(f"shiftleft(1L, b{k} % 64)")).otherwise(F.lit(0).cast("long"))

    def word(w):
        out = one(0, w)
        for k in range(1, HASHES):
            out = out.bitwiseOR(one(k, w))
        return F.bit_or(out).alias(f"w{w}")

    return bits.groupBy("block").agg(*[word(w) for w in range(WORDS)])


def blocks_of(n_entries: int) -> int:
    return max(1, -(-n_entries * BITS_PER_ENTRY // BLOCK_BITS))


def possible(rows: DataFrame, entries: DataFrame, n_entries: int) -> DataFrame:
    """Those of rows (entry, ...) that pass the filter of entries; a superset of the listed ones."""
    blocks = blocks_of(n_entries)
    f = bloom(entries, blocks)
    f = F.broadcast(f) if blocks <= BROADCAST_BLOCKS else f
    got = rows.withColumn("block", _block(F.col("entry"), blocks)).join(f, "block")
    for k in range(HASHES):
        bit = _bit(F.col("entry"), k)
        word = F.element_at(F.array(*[F.col(f"w{w}") for w in range(WORDS)]), F.floor(bit / 64).cast("int") + 1)
        got = got.withColumn("_w", word).withColumn("_b", (bit % 64)).where(F.expr("shiftright(_w, _b) & 1L = 1L"))
    return got.drop("block", "_w", "_b", *[f"w{w}" for w in range(WORDS)])


def listed(urls: DataFrame, entries: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, n, rule, verdict, listed_by) of urls (host, path, n; distinct): the longest fitting rule and list entry.

    entries: (entry), rules: (verdict, host, path); both without nulls. Only urls with one or the other are returned.
    """
    known = rules.groupBy(F.concat(F.lit("r"), "host", "path").alias("entry")).agg(F.max("verdict").alias("verdict"))
    known = written(known.unionAll(entries.select(F.concat(F.lit("l"), "entry"), F.lit(None).cast("string")).distinct()), "entries")
    folders, hosts = list_lengths(entries)
    pairs = sorted({(r.h, r.p) for r in rules.select(F.length("host").alias("h"), F.length("path").alias("p")).distinct().collect()})
    marked = lambda mark, xs: F.transform(xs, lambda x: F.concat(F.lit(mark), x))
    all_ = F.concat(marked("r", rule_candidates(F.col("host"), F.col("path"), pairs)), marked("l", candidates(canonical(F.col("host"), F.col("path")), folders, hosts)))
    looked = urls.select("host", "path", "n", F.explode(F.array_distinct(all_)).alias("entry"))
    size = known.count()
    if blocks_of(size) <= BROADCAST_BLOCKS:
        # the filter is where the candidates are: only possible hits are kept, counted and joined
        looked = written(possible(looked, known, size), "possible")
        once = looked.groupBy("entry").agg(F.count(F.lit(1)).alias("times"))
    else:
        # distinct candidates go to the filter's blocks: a domain that many URLs share is looked up once
        once = possible(looked.groupBy("entry").agg(F.count(F.lit(1)).alias("times"), F.count(F.lit(1)).alias("_t")), known, size)
    found = written(once.join(known, "entry").select("entry", "times", "verdict"), "hits")
    hits, total = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("times"), F.lit(0))).first()
    if hits <= BROADCAST_HITS:
        got = looked.join(F.broadcast(found.select("entry", "verdict")), "entry")
    else:
        got = salted_join(looked, found.select("entry", "verdict", "times"), ["entry"], "times", total)
    name, longest = F.substr("entry", F.lit(2)), F.struct(F.length("entry"), F.col("entry"))
    rule = F.when(F.startswith("entry", F.lit("r")), longest)
    best = got.groupBy("host", "path", "n").agg(F.max_by(F.struct(name.alias("rule"), "verdict"), rule).alias("hit"), F.max_by(name, F.when(F.startswith("entry", F.lit("l")), longest)).alias("listed_by"))
    best = written(best.select("host", "path", "n", "hit.rule", "hit.verdict", "listed_by"), "best")
    drop_written(known, found, looked)
    return best


def judged(pages: DataFrame, entries: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, keep: list[str] | None = None, url_col: str = "url") -> DataFrame:
    """For every row: `row`, host, path, rule, listed_by (list entry or null) and verdict.

    verdict is the longest fitting rule's; without one, block if the URL is listed, else allow. A rule (verdict, host, path)
    fits its host and all subdomains where the path starts with the rule's; of two verdicts for one rule block counts. A null
    URL, or one without ://, has an empty host and path, no rule, and is allowed. entries: a column `entry` of canonical
    URLs. Null entries, and rules with a null or without a host, are ignored. Neither list nor rules have a bound. Repeated
    URLs are looked up once and joined back on the URL.
    """
    fields = pages.columns if keep is None else keep
    if not isinstance(rules, DataFrame):
        rules = pages.sparkSession.createDataFrame(rules, "verdict string, host string, path string")
    rules = rules.where("verdict is not null and host <> '' and path is not null").select("verdict", "host", "path")
    url = F.col(f"`{url_col}`").cast("string")
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in fields]).alias("row"), host_of(url).alias("host"), path_of(url).alias("path"))
    urls = written(rows.where("host <> ''").groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")), "urls")
    # naming candidates takes time, not bytes: few URLs to a task, and every core has some
    dealt = urls.repartition(max(pages.sparkSession.sparkContext.defaultParallelism, urls.count() // URLS_A_TASK))
    best = listed(dealt, entries.where("entry is not null").select("entry"), rules)
    total = urls.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    drop_written(urls)
    out = salted_join(rows.where("host <> ''"), best, ["host", "path"], "n", total, "left").select("row", "host", "path", "rule", "verdict", "listed_by")
    none = F.lit(None).cast("string")
    # rows without host have no part in the join: their key would fall to one task
    out = out.unionAll(rows.where("host = ''").select("row", "host", "path", none, none, none))
    verdict = F.coalesce("verdict", F.when(F.col("listed_by").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("row", "host", "path", "rule", "listed_by", verdict.alias("verdict"))
