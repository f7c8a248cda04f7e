"""Phrases against a count by hand; the query itself is compared with its SQL in test_queries."""

import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reviewloom.llm import collocations


def by_hand(rows, least, most):
    count, n = Counter(), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, 5):
                count.update((lang, tuple(ws[i : i + k])) for i in range(len(ws) - k + 1))
    cand = {key: a for key, a in count.items() if len(key[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in cand.items():
        if any(x == lang and len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (x, q), b in cand.items()):
            continue
        cuts = [(int(Fraction(2000000 * a, count[lang, p[:i]] + count[lang, p[i:]])), i, count[lang, p[:i]], count[lang, p[i:]]) for i in range(1, len(p))]
        score, _, left, right = min(cuts)
        out.append((lang, -score, -a, " ".join(p).encode(), left, right))
    ranked = []
    for lang in n:
        for i, (_, s, a, p, left, right) in enumerate(sorted(x for x in out if x[0] == lang)[:most], 1):
            ranked.append((lang, i, p.decode(), -a, left, right, n[lang], -s))
    return sorted(ranked)


def corpus(seed):
    rng = random.Random(seed)
    words = ["Ab", "cd", "é", "f-g", "日本", "x" * 40, "A", "b"]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".\n", " ! ", "\x0b"]) for _ in range(rng.randrange(60)))
    return [(rng.choice(["en", "de", None]), rng.choice([text(), text(), text(), None, "", " \t.\n"])) for _ in range(120)] + [("en", "ab cd " * 4000)]


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_by_hand(spark, seed):
    """Nulls, empty and long texts, repeats and ties; columns of inner names pass by."""
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "lang string, text string").withColumn("phrase", F.lit("x")).withColumn("k", F.lit(0)).repartition(3)
    assert rows_of(collocations.collocations(docs, least=5, most=20)) == by_hand(rows, 5, 20)


def test_a_full_sketch_loses_nothing(spark, monkeypatch):
    """A sketch far too small lets everything through: the result is the same."""
    rows = corpus(3)
    docs = spark.createDataFrame(rows, "lang string, text string")
    monkeypatch.setattr(collocations, "SMALLEST", 14)
    small = collocations.frequent(docs, least=5, largest=14)
    assert rows_of(small) == rows_of(collocations.frequent(docs, least=5))


def test_hot_keys_are_cut(spark, monkeypatch):
    """Every join of a common part goes in pieces."""
    from reviewloom.sources import scratch

    monkeypatch.setattr(scratch, "HEAVY_ROWS", 2)
    rows = corpus(4)
    assert rows_of(collocations.collocations(spark.createDataFrame(rows, "lang string, text string"), least=5, most=30)) == by_hand(rows, 5, 30)


def test_empty_table(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(none).count() == 0
    assert collocations.collocations(spark.createDataFrame([(None, None), ("en", "")], "lang string, text string")).count() == 0


def test_products_beyond_64_bits(spark):
    big = 9_000_000_000_000_000_000
    counts = spark.createDataFrame([("en", 1, "a", big), ("en", 1, "b", big), ("en", 2, "a b", big), ("en", 3, "a b c", big - 2), ("en", 1, "c", big), ("en", 2, "b c", big - 1)], "lang string, k int, phrase string, f long")
    got = {r.phrase: r for r in collocations.scored(counts).collect()}
    assert got["a b"].score == 1000000 and got["a b c"].score == 2000000 * (big - 2) // (2 * big - 1)
    assert [r.phrase for r in collocations.subsumed(collocations.scored(counts)).collect()] == ["a b c"]


def test_grams_of_a_slice():
    g = collocations.Grams(pa.array(["A b a b. a b", "", "b"], pa.large_string()), pa.array(["x", "x", None]))
    got = {}
    for k, (at, count) in enumerate(g.grams, 1):
        for lang, p, c in zip(g.lang[at], g.phrases(k, at).to_pylist(), count):
            got[g.langs[int(lang)].as_py(), p] = int(c)
    assert got == {("x", "a"): 3, ("x", "b"): 3, ("und", "b"): 1, ("x", "a b"): 3, ("x", "b a"): 1, ("x", "a b a"): 1, ("x", "b a b"): 1, ("x", "a b a b"): 1}
    assert np.array_equal(g.n_words, [6, 1])
