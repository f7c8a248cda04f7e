"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts are summed by Spark over all labelled rows. The matrix of log probabilities (languages x BUCKETS) is broadcast;
texts are scored in batches from the n-grams they hold.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec as tv
from .shared import map_texts, ship

#: buckets of n-grams; their lengths; smoothing; languages of a model at most (half a megabyte of the matrix each)
BUCKETS, SIZES, SMOOTH, MAX_LANGS = 1 << 16, (1, 2, 3), 0.5, 256
#: code points worked on at a time; languages counted at a time in a task
STEP, HELD = 1 << 19, 64
UNKNOWN = "und"


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters (category L)."""
    return np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)), bool, 0x110000)


def letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters of the texts as code points, every run of other characters as one space, and the texts' n + 1 bounds."""
    low = pc.utf8_lower(texts)
    sizes = pc.utf8_length(low).to_numpy(zero_copy_only=False).astype(np.int64)
    buf, offs = tv.pack(low)
    cp = np.frombuffer(buf[: offs[-1]].tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    is_letter = _letters()[cp]
    first = np.zeros(len(cp) + 1, bool)
    first[bounds] = True
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1] & ~first[1:-1]
    place = np.concatenate([[0], np.cumsum(keep)])
    return np.where(is_letter, cp, 32)[keep].astype(np.uint64), place[bounds]


def ngrams(cp: np.ndarray, bounds: np.ndarray):
    """(text, bucket) of all n-grams, STEP code points at a time. An n-gram stays in its text; a space alone is none."""
    for lo in range(0, len(cp), STEP):
        n = min(STEP, len(cp) - lo)
        part = cp[lo : lo + n + max(SIZES) - 1]
        text = np.searchsorted(bounds, np.arange(lo, lo + n), side="right") - 1
        room = bounds[text + 1] - np.arange(lo, lo + n)
        h = np.zeros(n, np.uint64)
        for size in range(1, max(SIZES) + 1):
            m = min(n, len(part) - size + 1)
            h = h[:m] * np.uint64(0x9E3779B97F4A7C15) + part[size - 1 : size - 1 + m] + np.uint64(1)
            if size in SIZES:
                fits = room[:m] >= size
                if size == 1:
                    fits &= part[:m] != 32
                yield text[:m][fits], (tv.mix(h[fits] + np.uint64(size)) >> np.uint64(48)).astype(np.int64) % BUCKETS


def counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, bucket, n) over all rows with a language: n-grams, and under bucket -1 the number of texts with a letter."""
    ship(docs.sparkSession)

    def flushed(held: dict):
        for lang, c in held.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at - 1, pa.int32()), pa.array(c[at], pa.int64())], ["lang", "bucket", "n"])
        held.clear()

    def run(batches):
        held: dict[str, np.ndarray] = {}
        for b in batches:
            texts, langs = tv.text_column(b, "text"), b.column(1)
            for lo, hi in tv.slices(texts):
                cp, bounds = letters(texts.slice(lo, hi - lo))
                coded = langs.slice(lo, hi - lo).dictionary_encode()
                names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                for name in names:
                    held.setdefault(name, np.zeros(BUCKETS + 1, np.int64))
                full = np.bincount(code[np.diff(bounds) > 0], minlength=len(names))
                for i, name in enumerate(names):
                    held[name][0] += full[i]
                for text, bucket in ngrams(cp, bounds):
                    for i, name in enumerate(names):
                        held[name][1:] += np.bincount(bucket[code[text] == i] if len(names) > 1 else bucket, minlength=BUCKETS)
                if len(held) > HELD:
                    yield from flushed(held)
        yield from flushed(held)

    got = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")).where("lang is not null and text is not null")
    return got.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def trained(docs: DataFrame, keep=None, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> dict:
    """A model from all rows of docs with a language and a letter; keep: a condition on the id.

    The driver gets BUCKETS numbers for each language. More than MAX_LANGS languages are an error, never cut.
    """
    rows = docs if keep is None else docs.where(keep(F.col(id_col)))
    # the number of languages is not known before: at most that many groups of numbers come to the driver
    got = counts(rows, text_col, lang_col)
    table = got.limit(MAX_LANGS * (BUCKETS + 1) + 1).toArrow()
    langs = sorted(pc.unique(table.column("lang").filter(pc.equal(table.column("bucket"), -1))).to_pylist())
    if len(langs) > MAX_LANGS or table.num_rows > MAX_LANGS * (BUCKETS + 1):
        raise ValueError(f"more than {MAX_LANGS} languages")
    at = {lang: i for i, lang in enumerate(langs)}
    c, docs_of = np.zeros((len(langs), BUCKETS)), np.zeros(len(langs))
    for lang in langs:
        own = table.filter(pc.equal(table.column("lang"), lang))
        bucket, n = own.column("bucket").to_numpy(), own.column("n").to_numpy()
        docs_of[at[lang]] = n[bucket < 0].sum()
        c[at[lang], bucket[bucket >= 0]] = n[bucket >= 0]
    log_p = np.log(c + SMOOTH) - np.log(c.sum(axis=1, keepdims=True) + SMOOTH * BUCKETS)
    return {"langs": langs, "log_p": log_p, "prior": np.log(docs_of / docs_of.sum()) if len(langs) else docs_of}


def score(model: dict, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """(language, its probability) of each text; `und` and 0 without a letter, or without a learned language."""
    n, k = len(texts), len(model["langs"])
    cp, bounds = letters(texts)
    if not k:
        return [UNKNOWN] * n, np.zeros(n)
    total = np.tile(model["prior"][:, None], (1, n))
    for text, bucket in ngrams(cp, bounds):
        if len(text):
            edge = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
            for i in range(k):
                total[i, text[edge]] += np.add.reduceat(model["log_p"][i][bucket], edge)
    best = total.argmax(axis=0)
    p = 1 / np.exp(total - total.max(axis=0)).sum(axis=0)
    held = np.diff(bounds) > 0  # spaces stand behind letters only
    return [model["langs"][b] if h else UNKNOWN for b, h in zip(best, held)], np.where(held, p, 0.0)


_OUT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def identified(docs: DataFrame, model: dict, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """For every row: `row`, lang_pred and score, the probability of that language (equal ones: the first by name).

    A null text and one without a letter is `und` with score 0.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # MAX_LANGS x BUCKETS numbers at most

    def make():
        def work(texts):
            langs, p = score(held.value, texts)
            return [pa.array(langs, pa.string()), pa.array(p, pa.float64())]

        return work

    return map_texts(docs, text_col, make, _OUT, keep)
