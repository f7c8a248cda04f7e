"""Stages of the pipeline on 320 rows against brute force, or the laws that a drawn result must keep."""

import collections
import random
import re

import pytest

from reviewloom.llm import toxicity
from reviewloom.llm.shared import labelled_sample

import corpus_pipeline
from test_decontam import brute as hits
from test_near_dup import brute as groups
from test_near_dup import texts


def test_stages_against_brute_force(spark, tmp_path):
    r = random.Random(6)
    passage = lambda k: " ".join(f"item{k}word{i}" for i in range(14))
    bad = "what an idiot and moron . "
    rows = texts(320, 5)
    rows = [(i, f"{t} {passage(r.randrange(5))}" if t and r.random() < 0.1 else (f"{bad}{t}" if t and i % 9 == 0 else t), r.choice(["a", "b", None])) for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    spark.createDataFrame([(i, 1, int("idiot" in (t or ""))) for i, t, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    items = [(str(k), passage(k)) for k in range(5)]
    spark.createDataFrame([(int(k), t) for k, t in items], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    run = lambda k, d: corpus_pipeline.written(corpus_pipeline.STAGES[k][1](spark, d, str(tmp_path)), "stage")

    # the model's own scores decide, row by row
    first = run(0, docs)
    model = toxicity.fit(labelled_sample(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"), "toxic", toxicity.SAMPLE))
    import pyarrow as pa

    score = {i: toxicity.score(model, pa.array([t or ""], pa.large_string()))[0][0] for i, t, _ in rows}
    kept = {x.doc_id: x for x in first.collect()}
    assert set(kept) == {i for i in score if score[i] < 0.5}
    assert set(kept) == {i for i, t, _ in rows if "idiot" not in (t or "")}

    second = run(1, first)
    want = groups([(i, x.text) for i, x in kept.items()], 5)
    kept = {i: x for i, x in kept.items() if want[i][1] == i or not want[i][0]}
    assert sorted(x.doc_id for x in second.collect()) == sorted(kept)

    third = run(2, second)
    kept = {i: x for i, x in kept.items() if not hits(x.text, items, 10)[1]}
    assert sorted(x.doc_id for x in third.collect()) == sorted(kept) and len(kept) > 100

    fourth = run(3, third)
    drawn = collections.Counter(x.doc_id for x in fourth.collect())
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", x.text or "")) for i, x in kept.items()}
    assert set(drawn) <= set(kept) and max(drawn.values()) <= 2
    # every source is at its cap, or near its share of 150 % of all words
    total, largest = sum(size.values()), max(size.values())
    taken, own = collections.Counter(), collections.Counter()
    for i, x in kept.items():
        taken[x.source] += size[i] * drawn[i]
        own[x.source] += size[i]
    assert all(taken[s] <= 2 * own[s] for s in own) and abs(sum(taken.values()) - 1.5 * total) <= 3 * largest

    last = run(4, fourth).collect()
    assert collections.Counter(x.doc_id for x in last) == drawn
    shards = collections.Counter(x.shard for x in last)
    assert max(shards.values()) - min(shards.values()) <= 1
    assert all(sorted(x.slot for x in last if x.shard == s) == list(range(n)) for s, n in shards.items())


def test_ids_must_be_integers(spark):
    docs = spark.createDataFrame([("a", "b c d e f", "s")], "doc_id string, text string, source string")
    with pytest.raises(ValueError, match="integer"):
        corpus_pipeline.drop_near_duplicates(spark, docs, "")
