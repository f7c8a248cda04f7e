"""Mixing, sharding, URL filters and archives: laws, and brute force."""

import base64
import collections
import gzip
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from reviewloom.llm import mixing, sharding, url_filter, warc
from reviewloom.sources import scratch


def docs(spark, n, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        s = r.choice(["hot"] * 6 + ["a", "b", "B", None, "é", "empty"])
        rows.append((i, " ".join(["w"] * (0 if s == "empty" else r.choice([0, 1, 5, 20, 300]))) if r.random() < 0.97 else None, s))
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


@pytest.mark.parametrize("depth, units, rows", [(3, 2_000_000, 1_000_000), (0, 2_000_000, 1_000_000), (4, 40, 0), (6, 40, 1_000_000)])
def test_mix(spark, monkeypatch, depth, units, rows):
    """Targets, disjoint blocks, shard totals and reruns; small bounds force the ways that large inputs take."""
    monkeypatch.setattr(mixing, "NODE_UNITS", units)
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", rows)
    d = docs(spark, 1500)
    got = mixing.planned(d, depth=depth).select("row.*", "size", "source_size", "target", "draws").collect()
    size, target, taken, largest = collections.Counter(), {}, collections.Counter(), collections.Counter()
    shards, place = collections.Counter(), {}
    for r in got:
        assert len(r.draws) <= 2 and len({x["copy"] for x in r.draws}) == len(r.draws)
        size[r.source] += r["size"]
        target[r.source] = r.target
        taken[r.source] += r["size"] * len(r.draws)
        largest[r.source] = max(largest[r.source], r["size"])
        shards.update(x["shard"] for x in r.draws)
        for x in r.draws:  # a pass over a block is in one shard
            h = int(hashlib.md5(f"7:{r.doc_id}".encode()).hexdigest()[:15], 16)
            block = (r.source, h >> (60 - depth - mixing.BLOCK_BITS), x["copy"])
            assert place.setdefault(block, x["shard"]) == x["shard"]
    assert len(got) == 1500 and all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6 for s in size)
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-3 and all(target[s] <= 2 * size[s] + 1e-9 for s in size)
    blocks = collections.Counter(place.values())
    # the part of a pass may leave a block of the plan without a row
    assert set(blocks) == set(range(1 << depth)) and max(blocks.values()) - min(blocks.values()) <= 4
    again = mixing.planned(d.repartition(7), depth=depth).select("row.doc_id", "draws").collect()
    assert {r.doc_id: r.draws for r in again} == {r.doc_id: r.draws for r in got}
    mixed = mixing.mixed(d, depth=depth)
    assert mixed.columns == d.columns
    dealt = mixed.withColumn("at", F.spark_partition_id()).collect()
    assert collections.Counter((r.doc_id, r["at"]) for r in dealt) == collections.Counter((r.doc_id, x["shard"]) for r in got for x in r.draws)


@pytest.mark.parametrize("units", [2_000_000, 100])
def test_tree_splits_exactly(spark, monkeypatch, units):
    monkeypatch.setattr(mixing, "NODE_UNITS", units)
    q = {f"s{i}": n for i, n in enumerate((1000, 1, 0, 37, 512))}
    table = spark.createDataFrame([(k, i) for k, n in q.items() for i in range(1, n + 1)], "key string, i long")
    leaves = mixing._split(table, 3, 5).collect()
    by_key, by_shard = collections.Counter(), collections.Counter()
    for r in leaves:
        by_key[r.key] += r.quota
        by_shard[r.shard] += r.quota
    assert by_key == {k: n for k, n in q.items() if n} and max(by_shard.values()) - min(by_shard.values()) <= 1
    assert 60 < next(r.quota for r in leaves if r.shard == 0 and r.key == "s0") < 190


def test_depth_follows_the_words():
    assert [mixing.depth_for(w) for w in (0, 64e6, 65e6, 129e6, 1e30)] == [5, 5, 6, 7, 18]


@pytest.mark.parametrize("rank_rows", [20_000, 10])
def test_shards(spark, monkeypatch, rank_rows):
    monkeypatch.setattr(sharding, "RANK_ROWS", rank_rows)
    monkeypatch.setattr(scratch, "SMALL_ROWS", rank_rows - 10)
    r = random.Random(4)
    texts = ["hot"] * 400 + [f"pair {i // 2}" for i in range(200)] + [f"five {i // 5}" for i in range(200)] + [f"own {i} {r.random()}" for i in range(300)] + [None] * 40 + [""] * 30
    r.shuffle(texts)
    d = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, shard int")
    got = sharding.sharded(d, shards=12).select("row.doc_id", "row.text", "size", "text_crc32", "shard", "slot").collect()
    count = collections.Counter(x.shard for x in got)
    assert len(got) == len(texts) and len(count) == 12 and max(count.values()) - min(count.values()) <= 1
    for s in count:
        assert sorted(x.slot for x in got if x.shard == s) == list(range(count[s]))
    where = collections.defaultdict(set)
    for x in got:
        where[x.text].add(x.shard)
        assert x["size"] == len((x.text or "").encode()) + 8
    small = [t for t in where if t is not None and t.split()[:1] in (["pair"], ["five"])]
    assert sum(len(where[t]) > 1 for t in small) <= 0.03 * len(small) and len(where[""]) == 1
    assert len(where["hot"]) <= 6  # 97 rows fill a shard


def test_general_links(spark):
    """Two chains of linked rows, each row in two keys: far fewer links are cut than at random."""
    n = 400
    rows = spark.createDataFrame([(i,) for i in range(n)], "rid long")
    keys = [(i, i // 4) for i in range(n)] + [(i, 10_000 + (i + 2) // 4) for i in range(n)]
    got = {r.rid: r.shard for r in sharding.balanced_shards(rows, spark.createDataFrame(keys, "rid long, key long"), 4).collect()}
    cut = sum(got[i] != got[i + 1] for i in range(n - 1))
    assert sorted(collections.Counter(got.values()).values()) == [100] * 4 and cut < 0.6 * n


def judge(rows, entries, rules):
    return lambda spark: {r.url: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judged(spark.createDataFrame([(u,) for u in rows], "url string"), spark.createDataFrame([(e,) for e in entries], "entry string"), rules).select("row.url", "host", "path", "rule", "verdict").collect()}


def test_urls(spark):
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/")]
    rows = ["http://A.Example.COM/en/x?q#f", "https://www.example.com/en/", "http://example.com", "http://ncom/", "//x.com/", None, "", "http://bad.org/page/", "http://www.bad.org:80/page", "http://sub.bad.org/other", "http://good.org/dir/a/b", "http://good.org/dirx", "x://host?/a"]
    got = judge(rows, ["bad.org/page", "good.org/dir/", None, "sub.bad.org/"], rules)(spark)
    assert got["http://A.Example.COM/en/x?q#f"] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert got["https://www.example.com/en/"][2:] == ("www.example.com/en/", "allow") and got["http://example.com"] == ("example.com", "", None, "allow")
    assert got["http://ncom/"][2] is None and got["//x.com/"] == ("", "", None, "allow") and got[None] == got[""] == ("", "", None, "allow")
    assert [got[u][3] for u in rows[7:12]] == ["block", "block", "block", "block", "allow"] and got["x://host?/a"][:2] == ("host", "")


@pytest.mark.parametrize("blocks, hits, heavy", [(500_000, 100_000, 512), (0, 0, 1)])
def test_urls_against_brute_force(spark, monkeypatch, blocks, hits, heavy):
    """Broadcast and shuffle ways; deep folders, long hosts, hot URLs; a false positive of the filter changes nothing."""
    monkeypatch.setattr(url_filter, "BROADCAST_BLOCKS", blocks)
    monkeypatch.setattr(url_filter, "BROADCAST_HITS", hits)
    monkeypatch.setattr(scratch, "HEAVY_ROWS", heavy)
    monkeypatch.setattr(scratch, "HEAVY_KEYS", 1 << 40)
    monkeypatch.setattr(scratch, "SMALL_ROWS", 0)
    r = random.Random(5)
    part = lambda k: "/".join(r.choice("ab") for _ in range(r.randint(0, k)))
    hosts = ["a.org", "x.a.org", "b.org", "deep." * 60 + "b.org", "org", "localhost", "www.a.org:80"]
    urls = ["http://" + r.choice(hosts) + r.choice(["", "/", "/" + part(4), "/" + part(4) + "/"]) for _ in range(300)] + ["http://b.org/" + "d/" * 200 + "x"] + ["http://a.org/a"] * 200
    entries = ["a.org/" + "a/b/", "b.org/" + "d/" * 200, "org/", "localhost/", "x.a.org/", "a.org/a", "deep.b.org/"]
    rules = [("block", "a.org", "/b"), ("allow", "org", "/b/a"), ("allow", "localhost", ""), ("block", "b.org", "/d/d/d/q"), ("block", "", "/"), ("allow", "a.org", "/b")]
    got = url_filter.judged(spark.createDataFrame([(u,) for u in urls], "url string"), spark.createDataFrame([(e,) for e in entries], "entry string"), rules).select("row.url", "host", "path", "rule", "listed_by", "verdict").collect()
    assert sorted(x.url for x in got) == sorted(urls)
    for x in got:
        fits = [(len(h + p), h + p, v) for v, h, p in rules if h and (x.host == h or x.host.endswith("." + h)) and x.path.startswith(p)]
        host = x.host.split(":")[0].removeprefix("www.")
        own = host + (x.path or "/")
        hit = [e for e in entries if e == own or e == own.removesuffix("/") or (e.endswith("/") and own.startswith(e)) or (e.count("/") == 1 and e.endswith("/") and "." in e and host.endswith("." + e[:-1]))]
        rule = max(fits, default=(0, None, None))
        name = max(hit, key=lambda e: (len(e), e), default=None)
        assert (x.rule, x.listed_by, x.verdict) == (rule[1], name, rule[2] or ("block" if name else "allow")), x


def test_the_filter_comes_before_any_exchange_of_candidates(spark):
    """With a broadcast filter, what explodes the candidates has no exchange above it before the bit test."""
    entries = spark.range(50).select(F.concat(F.lit("h.org/"), "id").alias("entry"))
    looked = spark.range(9).select(F.explode(F.array(F.lit("h.org/1"), F.lit("no/"))).alias("entry"), "id")
    plan = url_filter.possible(looked, entries, 50)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Generate explode")]
    assert "BroadcastHashJoin" in above and "shiftright" in above and "Exchange hashpartitioning" not in above.split("BroadcastExchange")[0]


def test_bloom_passes_all_listed_and_few_others(spark):
    entries = spark.range(3000).select(F.concat(F.lit("h.org/"), "id").alias("entry"))
    rows = spark.range(20000).select(F.concat(F.lit("h.org/"), "id").alias("entry"), "id")
    got = {r.id for r in url_filter.possible(rows, entries, 3000).collect()}
    assert set(range(3000)) <= got and len(got) < 3000 + 0.02 * 17000


def test_archives(spark):
    big, other = "<p>" + "é" * 600, "<p>" + "x" * 2000
    rows = [(1, "http://a/", big), (2, "http://b/\r\nX: y", big), (3, None, "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (7, "u", other), (9, "u", big), (None, "u", big)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    archives = warc.write_archives(d)
    got = {r.page_id: r for r in warc.read_archives(archives).collect()}
    assert len(got) == len(rows) and sum(r.records for r in archives.collect()) == len(rows)
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {1: ("revisit", 9), 2: ("revisit", 9), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None), 7: ("response", None), 9: ("response", None), None: ("response", None)}
    assert got[1].payload_bytes == len(big.encode()) and got[1].payload is None and bytes(got[9].payload) == big.encode() and bytes(got[5].payload) == b""
    assert all(r.found for r in warc.resolved(warc.read_archives(archives)).collect())


def test_reader_frames_and_verifies():
    data = b"".join(warc.page_record(i, "u", bytes(range(256)) * i, __import__("hashlib").sha1(bytes(range(256)) * i).hexdigest(), None) for i in range(1, 6))
    for size in (1, 7, 1000, 1 << 20):
        chunks = [data[i : i + size] for i in range(0, len(data), size)]
        assert [len(warc.payload_of(h, b)) for h, b in warc.read_records(chunks)] == [256 * i for i in range(1, 6)]
    assert gzip.GzipFile(fileobj=io.BytesIO(data)).read().count(b"WARC/1.1") == 5
    with pytest.raises(warc.WarcError, match="ends inside"):
        list(warc.read_records([data[:-3]]))
    plain = gzip.decompress(warc.page_record(1, "u", b"abc", "0", None))
    for old, new, says in ((b"Content-Length: ", b"Content-Length: 1", "end with"), (b"abc", b"abd", "block digest"), (b"WARC/1.1", b"HTTP/1.1", "version")):
        with pytest.raises(warc.WarcError, match=says):
            list(warc.read_records([gzip.compress(plain.replace(old, new, 1))]))
    with pytest.raises(warc.WarcError, match="payload digest"):
        warc.payload_of(*next(warc.read_records([warc.page_record(1, "u", b"abc", "0", None)])))


def test_records_of_other_writers():
    """warcinfo and request records, base-32 digests, missing headers; a header without end is an error."""
    sha = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    body = b"HTTP/1.1 200 OK\r\n\r\n<p>hello"
    data = warc.record([("WARC-Type", "warcinfo")], b"software: x\r\n") + warc.record([("WARC-Type", "request"), ("WARC-Target-URI", "http://a/")], b"GET / HTTP/1.1\r\n\r\n")
    data += warc.record([("WARC-Type", "response"), ("WARC-Target-URI", "http://a/"), ("WARC-Payload-Digest", sha(b"<p>hello")), ("WARC-Block-Digest", sha(body))], body)
    rows = [warc.row_of(h, warc.payload_of(h, b), True) for h, b in warc.read_records([data])]
    assert [r[2] for r in rows] == ["warcinfo", "request", "response"] and rows[0][1] is None
    assert rows[2] == (None, "http://a/", "response", hashlib.sha1(b"<p>hello").hexdigest(), 8, None, b"<p>hello")
    with pytest.raises(warc.WarcError, match="without end"):
        list(warc.read_records([gzip.compress(b"WARC/1.1\r\nA: " + b"x" * (1 << 22))]))
