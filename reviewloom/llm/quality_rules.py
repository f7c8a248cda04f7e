"""Quality rules: counts of a text, and line labelling by a linear-chain conditional random field.

Viterbi decoding marks each line as content or boilerplate; a text is kept if the base rules pass and
content lines hold at least SHARE of its words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import crf, textstats
from . import textvec as tv
from .shared import labelled_sample, map_texts, release

#: labelled texts the field is fitted on, at most; share of words in content lines that keeps a text
SAMPLE, SHARE = 3000, 0.5
ROUNDS = 2
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def _lines(texts: pa.Array):
    w = textstats.Words(texts)
    repeated = w.repeated()
    bounds, doc, copied = w.lines()
    return w, repeated, bounds, doc, copied, textstats.features(w, bounds, repeated, copied)


def fit(sample: list[tuple[str, int]]) -> dict:
    """A field from (text, quality) rows: lines take the label of their text, 1 for content.

    Texts of label 0 hold content lines, too: in further rounds their lines take the labels that the field
    of the round before gives them, as long as one is boilerplate. Without rows of both labels every line
    is content.
    """
    sequences = []
    if {y for _, y in sample} == {0, 1}:
        arr, y = pa.array([t for t, _ in sample], pa.large_string()), [y for _, y in sample]
        for lo, hi in tv.slices(arr):
            _, _, bounds, doc, _, x = _lines(arr.slice(lo, hi - lo))
            for d in np.unique(doc):
                rows = doc == d
                sequences.append((x[rows], np.full(int(rows.sum()), y[lo + d])))
    if not sequences:
        return {"emit": np.zeros((len(textstats.NAMES), 2)), "step": np.zeros((2, 2)), "start": np.array([0.0, 1.0])}
    model = crf.fit(_cut(sequences), steps=150, rate=0.2, l2=0.05)
    for _ in range(ROUNDS):
        again = []
        for x, y in sequences:
            if not y[0]:
                got = np.array(crf.viterbi((x @ model["emit"]).tolist(), model["step"].tolist(), model["start"].tolist()))
                y = y if got.all() else got
            again.append((x, y))
        model = crf.fit(_cut(again), steps=150, rate=0.2, l2=0.05)
    return model


def _cut(sequences, size: int = 64):
    """Long sequences in pieces: fitting needs transitions, not whole texts' lengths."""
    return [(x[i : i + size], y[i : i + size]) for x, y in sequences for i in range(0, len(y), size)]


_OUT = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("content_share", T.DoubleType()), T.StructField("kept", T.BooleanType()), T.StructField("line_labels", T.ArrayType(T.IntegerType()))]
)


def judge(model: dict, texts: pa.Array) -> list[pa.Array]:
    w, repeated, bounds, doc, copied, x = _lines(texts)
    n = len(texts)
    words, n_repeat = w.n_words(), np.bincount(w.doc, repeated, minlength=n).astype(np.int64) if len(w.doc) else np.zeros(n, np.int64)
    dup = np.bincount(doc, copied, minlength=n).astype(np.int64) if len(doc) else np.zeros(n, np.int64)
    failed = (words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * words)
    scores, size = (x @ model["emit"]).tolist(), np.diff(bounds)
    step, start = model["step"].tolist(), model["start"].tolist()
    edge = np.searchsorted(doc, np.arange(n + 1))
    labels, share = [], np.zeros(n)
    for d in range(n):
        a, b = edge[d], edge[d + 1]
        got = crf.viterbi(scores[a:b], step, start)
        labels.append(got)
        if got:
            share[d] = float((size[a:b] * np.array(got)).sum()) / float(words[d])
    kept = ~failed & (share >= SHARE)
    return [pa.array(v) for v in (words, w.word_chars(), w.n_symbols(), dup, n_repeat, failed, share, kept)] + [pa.array(labels, pa.list_(pa.int32()))]


def quality(docs: DataFrame, model: dict, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """For every row: `row`, the counts, base_failed, content_share, kept, line_labels (of lines with a word).

    Words lie between white space. n_repeat_words counts words in three-word windows found twice or more,
    n_dup_lines lines equal to an earlier line. Null and empty texts have no words and fail the base rules.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, text_col, lambda: lambda texts: judge(held.value, texts), _OUT, keep)


def trained(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> dict:
    """A field from the labelled rows of docs, `bound` at most. Labels: `quality`."""
    model = fit(labelled_sample(docs, labels, "quality", bound))
    release(docs.sparkSession)
    return model
