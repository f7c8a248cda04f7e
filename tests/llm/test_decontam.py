"""Wu-Manber search and decontamination against brute force."""

import random
import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import numpy as np

from reviewloom.llm import decontam

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text, items, size):
    w = WORDS.findall((text or "").translate(LOW))
    hit, found = set(), set()
    for item, t in items:
        x = WORDS.findall((t or "").translate(LOW))
        for i in range(max(1, len(x) - size + 1)) if x else ():
            win = x[i : i + size]
            for k in range(len(w) - len(win) + 1):
                if w[k : k + len(win)] == win:
                    hit |= set(range(k, k + len(win)))
                    found.add(item)
    return len(w), len(hit), sorted(found)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=40).map(lambda b: bytes(97 + x % 3 for x in b)), min_size=1, max_size=12, unique=True), st.binary(max_size=300).map(lambda b: bytes(97 + x % 3 for x in b)), st.integers(1, 64))
def test_search_finds_all(patterns, text, stride):
    size = np.array([len(x) for x in patterns], np.int32)
    data = np.frombuffer(b"".join(patterns) + b"\0" * 8, np.uint8)
    p, at = decontam.WuManber(data, (np.cumsum(size) - size).astype(np.int32), size).find(np.frombuffer(text + b"\0" * 8, np.uint8), len(text), stride)
    want = sorted((i, k) for i, x in enumerate(patterns) for k in range(len(text)) if text.startswith(x, k))
    assert sorted(zip(p.tolist(), at.tolist())) == want


def cases(seed, n=60):
    r = random.Random(seed)
    word = lambda: r.choice(["a", "b", "c", "dd", "É", "x1", "The", "the", "ß"])
    some = lambda a, b: r.choice([" ", ", ", "\n"]).join(word() for _ in range(r.randint(a, b)))
    items = [(str(i), some(0, 16)) for i in range(12)] + [("12", None), ("13", "!!"), ("2", some(3, 9))]
    docs = [some(0, 50) for _ in range(n)] + [None, "", "?!", some(20000, 20000)]
    return items, docs


def test_matcher():
    for seed in range(4):
        items, docs = cases(seed)
        m = decontam.Matcher(items, 4)
        text = decontam.Prepared(pa.array([d or "" for d in docs], pa.large_string()))
        text.add(m)
        n, spans, found = text.result()
        got = [(int(a), int(sum(s[1::2]) - sum(s[::2])), f) for a, s, f in zip(n, spans, found)]
        assert got == [brute(d, items, 4) for d in docs]


def test_passes_give_the_same(spark):
    items, docs = cases(9)
    d = spark.createDataFrame(list(enumerate(docs)), "items long, text string")  # a clashing name
    b = spark.createDataFrame(items, "item_id string, text string")
    run = lambda size: {r.id: (r.n_words, r.n_hit, r["items"]) for r in decontam.contamination(d, b, 4, pass_bytes=size).select(F.col("row.items").alias("id"), "n_words", decontam.hit_words(F.col("spans")).alias("n_hit"), "items").collect()}
    one = run(1 << 20)
    assert one == {i: brute(t, items, 4) for i, t in enumerate(docs)} == run(200)


def test_no_items(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id string, text string")
    assert [tuple(r) for r in decontam.contamination(d, b).select("n_words", "spans", "items").collect()] == [(3, [], [])]


def test_stage_drops_passages_of_items_without_id(spark, tmp_path):
    import corpus_pipeline

    passage = "one two three four five six seven eight nine ten"
    spark.createDataFrame([(None, passage), (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, f"so {passage} it is", "s"), (2, "nothing of the kind", "s")], "doc_id long, text string, source string")
    assert [r.doc_id for r in corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()] == [2]
