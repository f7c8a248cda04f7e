"""Naive Bayes against counts by hand, and its accuracy on held-out rows."""

import math
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reviewloom.llm import langid, queries

from conftest import DATA


def grams(text):
    out, last = "", " "
    for ch in text.lower():
        ch = ch if unicodedata.category(ch)[0] == "L" else " "
        out += "" if ch == last == " " else ch
        last = ch
    return [out[i : i + n] for n in (1, 2, 3) for i in range(len(out) - n + 1) if out[i : i + n] != " "]


def bucket(gram):
    m = 2**64
    h = 0
    for ch in gram:
        h = (h * 0x9E3779B97F4A7C15 + ord(ch) + 1) % m
    x = (h + len(gram)) % m
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = ((x ^ (x >> shift)) * by) % m
    return (x ^ (x >> 31)) >> 48


ROWS = [(1, "The cat, the DOG!", "en"), (2, "das Haus und die Straße", "de"), (3, "Le château — la forêt", "fr"), (4, None, "en"), (5, "123 ...", "de"), (6, "the house", None), (7, "", "fr"), (None, "die Katze", "de"), (1, "The cat, the DOG!", "en"), (8, "日本語 and 漢字", "en")]


def test_against_counts_by_hand(spark, monkeypatch):
    """Null, empty and letterless texts, repeated and null ids; extra columns of inner names; a step of a few letters."""
    monkeypatch.setattr(langid, "STEP", 5)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string").withColumn("bucket", F.lit(1)).withColumn("score", F.lit("s"))
    model = langid.trained(docs)
    count, of = {}, Counter()
    for _, text, lang in ROWS:
        if lang and text and grams(text):
            count.setdefault(lang, Counter()).update(map(bucket, grams(text)))
            of[lang] += 1
    assert model["langs"] == sorted(count)
    got = {(r["row"].doc_id, r["row"].text): (r.lang_pred, r.score) for r in langid.identified(docs, model).collect()}
    for i, text, _ in ROWS:
        if not text or not grams(text):
            assert got[i, text] == ("und", 0.0)
            continue
        total = {}
        for lang, c in count.items():
            low = math.log(sum(c.values()) + 0.5 * 65536)
            total[lang] = math.log(of[lang] / sum(of.values())) + sum(math.log(c[b] + 0.5) - low for b in map(bucket, grams(text)))
        best = max(sorted(total), key=total.get)
        assert got[i, text][0] == best and math.isclose(got[i, text][1], 1 / sum(math.exp(v - total[best]) for v in total.values()), rel_tol=1e-9)


def test_long_text_and_bounds():
    cp, bounds = langid.letters(pa.array(["a" * 10, "", "b1c", "!!"], pa.large_string()))
    assert list(bounds) == [0, 10, 10, 13, 13] and bytes(cp.astype(np.uint8)) == b"a" * 10 + b"b c"
    long = "the cat " * 300_000
    model = {"langs": ["x", "y"], "log_p": np.log(np.stack([np.full(65536, 1 / 65536), np.full(65536, 1 / 65537)])), "prior": np.log([0.5, 0.5])}
    langs, p = langid.score(model, pa.array([long, long[:8]], pa.large_string()))
    assert langs == ["x", "x"] and p[0] >= p[1] > 0.5


def test_empty_table_and_no_language(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    none = langid.trained(docs.where("doc_id > 100"))
    assert none["langs"] == [] and {(r.lang_pred, r.score) for r in langid.identified(docs, none).collect()} == {("und", 0.0)}
    assert langid.identified(docs.where("doc_id > 100"), langid.trained(docs)).count() == 0


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGS", 2)
    with pytest.raises(ValueError):
        langid.trained(spark.createDataFrame(ROWS, "doc_id long, text string, lang string"))


def test_held_out_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = queries.op13_language_id(spark, DATA).where("held_out").join(docs, "doc_id").where("lang_pred <> 'und'")
    n, right = got.agg(F.count(F.lit(1)), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n >= 30 and right >= 0.97 * n
