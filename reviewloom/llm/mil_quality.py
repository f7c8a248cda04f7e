"""Quality classifier by attention-based multiple-instance learning.

A text is a bag of passages of PASSAGE words. Each passage is encoded from its surface and its words (hashed into
BUCKETS), gated attention weighs the encodings, and the weighted sum is scored. Encoder, attention and score are fitted together from labels of whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import textstats
from . import textvec as tv
from .shared import labelled_sample, map_texts, release

#: labelled texts the model is fitted on, at most; words of a passage; buckets of its words; sizes of encoding and attention
SAMPLE, PASSAGE, BUCKETS, ENCODING, GATE = 3000, 64, 256, 16, 8


def passages(texts: pa.Array):
    """(features, text) of each passage of whole texts: surface statistics, and the root of each bucket's share of the words."""
    w = textstats.Words(texts)
    bounds, doc = w.passages(PASSAGE)
    size, m = np.diff(bounds), len(doc)
    at = np.repeat(np.arange(m), size) * BUCKETS + (w.hash % np.uint64(BUCKETS)).astype(np.int64)
    content = np.sqrt(np.bincount(at, minlength=m * BUCKETS).reshape(m, BUCKETS) / size[:, None])
    return np.concatenate([textstats.features(w, bounds, w.repeated()), content], axis=1), doc


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def forward(m: dict, x: np.ndarray, doc: np.ndarray, n: int) -> dict:
    h = np.tanh(x @ m["W"] + m["b"])
    v, u = np.tanh(h @ m["V"]), _sigmoid(h @ m["U"])
    e = np.clip((v * u) @ m["w"], -30, 30)
    ex = np.exp(e)
    a = ex / np.maximum(np.bincount(doc, ex, minlength=n), 1e-30)[doc]
    z = np.zeros((n, h.shape[1]))
    if len(doc):  # passages stand in the order of their texts
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        z[doc[first]] = np.add.reduceat(a[:, None] * h, first, axis=0)
    return {"h": h, "v": v, "u": u, "a": a, "z": z, "p": _sigmoid(z @ m["c"] + m["d"])}


def fit(sample: list[tuple[str, int]], steps: int = 200, rate: float = 0.02, l2: float = 1e-4, seed: int = 4) -> dict:
    """A model from (text, label) rows. Without rows of both labels all texts get the share of label 1."""
    y = np.array([k for _, k in sample], float)
    if not len(y) or y.min() == y.max():
        return {"constant": float(y.mean()) if len(y) else 0.5}
    arr, xs, docs = pa.array([t for t, _ in sample], pa.large_string()), [], []
    for lo, hi in tv.slices(arr):
        x, d = passages(arr.slice(lo, hi - lo))
        xs.append(x)
        docs.append(d + lo)
    x, doc, n = np.concatenate(xs), np.concatenate(docs), len(y)
    r, f = np.random.default_rng(seed), x.shape[1]
    m = {"W": r.normal(0, 0.5, (f, ENCODING)), "b": np.zeros(ENCODING), "V": r.normal(0, 0.3, (ENCODING, GATE)), "U": r.normal(0, 0.3, (ENCODING, GATE)), "w": r.normal(0, 0.3, GATE), "c": r.normal(0, 0.3, ENCODING), "d": np.zeros(())}
    first, second = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    for t in range(1, steps + 1):
        s = forward(m, x, doc, n)
        gs = weight * (s["p"] - y)
        gz = gs[:, None] * m["c"]
        gh_sum = gz[doc]
        ga = (gh_sum * s["h"]).sum(axis=1)
        ge = s["a"] * (ga - np.bincount(doc, s["a"] * ga, minlength=n)[doc])
        gvu = ge[:, None] * m["w"]
        gv, gu = gvu * s["u"] * (1 - s["v"] ** 2), gvu * s["v"] * s["u"] * (1 - s["u"])
        gh = s["a"][:, None] * gh_sum + gv @ m["V"].T + gu @ m["U"].T
        gx = gh * (1 - s["h"] ** 2)
        grad = {"W": x.T @ gx, "b": gx.sum(axis=0), "V": s["h"].T @ gv, "U": s["h"].T @ gu, "w": (s["v"] * s["u"]).T @ ge, "c": s["z"].T @ gs, "d": gs.sum()}
        for k in m:
            g = grad[k] + l2 * m[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            m[k] = m[k] - rate * np.sqrt(1 - 0.999**t) / (1 - 0.9**t) * first[k] / (np.sqrt(second[k]) + 1e-9)
    return m


def score(m: dict, texts: pa.Array):
    """Scores of texts, and the attention weights of their passages."""
    n = len(texts)
    if "constant" in m:
        return np.full(n, m["constant"]), [[] for _ in range(n)]
    x, doc = passages(texts)
    s = forward(m, x, doc, n)
    edge = np.searchsorted(doc, np.arange(n + 1))
    return s["p"], [s["a"][edge[i] : edge[i + 1]] for i in range(n)]


_OUT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("attention", T.ArrayType(T.DoubleType()))])


def quality_score(docs: DataFrame, model: dict, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """For every row: `row`, score (0 to 1) and the attention weight of each passage.

    A null or empty text has no passage: its score is that of an empty bag.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def work(texts):
            p, a = score(held.value, texts)
            return [pa.array(p, pa.float64()), pa.array(a, pa.list_(pa.float64()))]

        return work

    return map_texts(docs, text_col, make, _OUT, keep)


def trained(docs: DataFrame, labels: DataFrame, keep=None, bound: int = SAMPLE) -> dict:
    """A model from the labelled rows of docs; keep: a condition on the id. Labels: `quality`."""
    model = fit(labelled_sample(docs, labels, "quality", bound, keep))
    release(docs.sparkSession)
    return model
