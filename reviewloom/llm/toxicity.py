"""Toxicity by multiple-instance learning: a text is toxic if at least one of its sentences is.

A sentence has a logistic score over hashed features of each of its words (the word, and what longer words begin with). The text's score
is the noisy-or of its sentences above the background p0, the score of a sentence without features:
1 - prod((1 - p) / (1 - p0)), so that neutral sentences add nothing, however many there are. Only labels of
whole texts are needed to fit the weights, yet each sentence gets a score of its own, so offending sentences
are located.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec as tv
from .shared import labelled_sample, map_texts, release

U = np.uint64
#: labelled texts the model is fitted on, at most (half of them toxic at most)
SAMPLE = 3000
BITS = 20
#: bytes of the beginnings of longer words
PREFIXES = (3, 4, 5, 6, 7, 8)
#: settings that a validation split chooses from: least z-score of a screened feature, l2 and the bias to which l2 draws
SETTINGS = [(z, l2, b) for z in (3.0, 5.0) for l2 in (0.2, 1.0) for b in (-9.0, -6.0)]
#: a false alarm weighs as much as so many misses when settings are chosen
FALSE_ALARM = 3.0

_all = np.arange(256)
WORD = ((_all >= 0x30) & (_all <= 0x39)) | ((_all >= 0x41) & (_all <= 0x5A)) | ((_all >= 0x61) & (_all <= 0x7A)) | (_all >= 0x80)
STOP = np.isin(_all, [0x0A, ord("."), ord("!"), ord("?")])


def sentences(texts: pa.Array):
    """(buf, word starts, word ends, sentence of each word, text of each sentence, sentence bounds in words).

    Sentences end at a line end or at . ! ? and hold at least one word.
    """
    buf, offs = tv.pack(texts)
    buf = tv.LOWER[buf]
    starts, ends, first = tv.word_bounds(buf, offs, WORD)
    if not len(starts):
        z = np.zeros(0, np.int64)
        return buf, starts, ends, z, z, np.zeros(1, np.int64)
    stops = np.searchsorted(np.flatnonzero(STOP[buf[: offs[-1]]]), starts)
    new = np.ones(len(starts), bool)
    new[1:] = stops[1:] != stops[:-1]
    new[first[:-1][np.diff(first) > 0]] = True
    bounds = np.append(np.flatnonzero(new), len(starts))
    sent = np.cumsum(new) - 1
    doc = np.searchsorted(first, bounds[:-1], side="right") - 1
    return buf, starts, ends, sent, doc, bounds


def features(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashed features of each word: itself, and its first bytes if it is longer than those (else 0)."""
    view = np.ndarray((len(buf) - 7,), "<u8", np.ascontiguousarray(buf), 0, (1,))
    head, size = view[starts], ends - starts
    cols = [tv.word_hashes(buf, starts, ends) >> U(64 - BITS)]
    for n in PREFIXES:
        h = tv.mix((head & U((1 << (8 * n)) - 1)) + U(n * 0x9E3779B97F4A7C15 % 2**64)) >> U(64 - BITS)
        cols.append(np.where(size > n, h, U(0)))
    return np.stack(cols, axis=1).astype(np.int32)


def _chunks(texts: list[str]):
    arr = pa.array(texts, pa.large_string())
    for lo, hi in tv.slices(arr, tv.SLICE_BYTES // 4):
        yield lo, arr.slice(lo, hi - lo)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _evidence(p: np.ndarray, p0: float) -> np.ndarray:
    """log of the share of doubt that sentences leave: log((1 - p) / (1 - p0)), 0 at the background p0 and below."""
    return np.minimum(np.log1p(-np.minimum(p, 1 - 1e-12)) - np.log1p(-p0), 0.0)


def _counted(keys: np.ndarray) -> np.ndarray:
    """Keys, each at most twice: a feature counts twice in a sentence, not as often as it is repeated."""
    keys = np.sort(keys)
    third = np.zeros(len(keys), bool)
    third[2:] = keys[2:] == keys[:-2]
    return keys[~third]


def _screened(texts: list[str], y: np.ndarray, least: float) -> dict:
    """What a fit needs of texts: features that stand in more texts of label 1 than chance allows, and where they stand.

    Only screened features are kept, so the memory follows them and not the words. Sentences without any say nothing: they
    have the background score, and no row.
    """
    seen = np.zeros((2, 1 << BITS), np.int32)
    for lo, part in _chunks(texts):
        buf, a, b, sent, doc, _ = sentences(part)
        f = features(buf, a, b)
        key = np.unique((doc[sent][:, None].astype(np.int64) << BITS | f).ravel()) if len(f) else np.zeros(0, np.int64)
        np.add.at(seen, (y[lo + (key >> BITS)].astype(int), key & ((1 << BITS) - 1)), 1)
    n1, n0 = y.sum(), (1 - y).sum()
    share = ((seen[0] + seen[1] + 1) / (len(y) + 2)).astype(np.float32)
    z = (seen[1] / n1 - seen[0] / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))
    good = (seen[1] >= 3) & (z > least)
    good[0] = False
    index = np.cumsum(good) - 1
    rows, cols, docs, base = [], [], [], 0
    for lo, part in _chunks(texts):
        buf, a, b, sent, doc, _ = sentences(part)
        f = features(buf, a, b)
        word, col = np.nonzero(good[f])
        key = _counted(sent[word].astype(np.int64) << BITS | f[word, col])
        used, at = np.unique(key >> BITS, return_inverse=True)
        rows.append(base + at)
        cols.append(index[key & ((1 << BITS) - 1)])
        docs.append(lo + doc[used])
        base += len(used)
    rows, cols, docs = map(np.concatenate, (rows, cols, docs))
    return {"rows": rows, "cols": cols, "docs": docs, "features": np.flatnonzero(good), "z": z[good], "y": y}


def _fit(data: dict, steps: int, z_least: float, l2: float, bias0: float) -> dict:
    """Weights for one setting, from the features of `_screened` whose z-score is above z_least."""
    y, chosen = data["y"], data["z"] > z_least
    index, kept = np.cumsum(chosen) - 1, chosen[data["cols"]]
    rows, cols, docs, k = data["rows"][kept], index[data["cols"][kept]], data["docs"], int(chosen.sum())
    n1, n0 = y.sum(), (1 - y).sum()
    w, bias = np.full(k, 2.0), bias0  # at 0 no sentence is above the background
    m, v, mb, vb = np.zeros(k), np.zeros(k), 0.0, 0.0
    rate = np.where(y > 0, 0.5 * len(y) / n1, 0.5 * len(y) / n0)  # both classes weigh the same
    for t in range(1, steps + 1):
        z = bias + np.bincount(rows, w[cols], minlength=len(docs)) if len(rows) else np.full(len(docs), bias)
        p, p0 = _sigmoid(z), _sigmoid(bias)
        logq = np.bincount(docs, _evidence(p, p0), minlength=len(y))
        score = np.clip(-np.expm1(logq), 1e-9, 1)
        up = rate * np.where(y > 0, np.exp(logq) / score, -1.0) / len(y)  # dL/dz is up * p above the background
        gz = up[docs] * np.where(p >= p0, p, 0.0)
        g = np.bincount(cols, gz[rows], minlength=k) - l2 * w / len(y)
        gb = (up[docs] * np.maximum(p - p0, 0.0)).sum() - 0.5 * (bias - bias0) / len(y)  # most sentences are harmless
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        step = 0.1 * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w += step * m / (np.sqrt(v) + 1e-8)
        bias += step * mb / (np.sqrt(vb) + 1e-8)
    table = np.zeros(1 << BITS, np.float32)
    table[data["features"][chosen]] = w
    return {"weights": table, "bias": float(bias), "prior": None}


def fit(sample: list[tuple[str, int]], steps: int = 300, folds: int = 4) -> dict:
    """Weights from (text, label) rows. Without rows of both classes all texts get the share of label 1.

    Every folds-th row of each class is set aside first: the setting that does best there is fitted to all rows. Samples too
    small for that (under 10 rows of a class set aside) take the first setting.
    """
    y = np.array([x[1] for x in sample], float)
    if not len(y) or y.min() == y.max():
        return {"weights": np.zeros(1 << BITS, np.float32), "bias": -30.0, "prior": float(y.mean()) if len(y) else 0.0}
    place, least = np.zeros(len(y), np.int64), min(z for z, _, _ in SETTINGS)
    for label in (0, 1):
        place[y == label] = np.arange(int((y == label).sum()))
    aside = place % folds == 0
    best = SETTINGS[0]
    if min((y[aside] == k).sum() for k in (0, 1)) >= 10:
        data = _screened([x[0] for x, out in zip(sample, aside) if not out], y[~aside], least)
        held, truth, value = [x[0] for x, out in zip(sample, aside) if out], y[aside] > 0, -1.0
        for setting in SETTINGS:
            m = _fit(data, steps, *setting)
            got = np.concatenate([score(m, part)[0] for _, part in _chunks(held)]) >= 0.5
            now = got[truth].mean() + FALSE_ALARM * (~got[~truth]).mean()
            if now > value:
                best, value = setting, now
    return {**_fit(_screened([x[0] for x in sample], y, least), steps, *best), "setting": best}


def score(model: dict, texts: pa.Array, cut: float = 0.5):
    """Scores of texts, and per text the sentences (start, end in code points, score) of at least `cut`."""
    n = len(texts)
    if model["prior"] is not None:
        return np.full(n, model["prior"]), [[] for _ in range(n)]
    buf, a, b, sent, doc, bounds = sentences(texts)
    z = np.full(len(doc), model["bias"])
    if len(a):
        f = features(buf, a, b)
        word, col = np.nonzero(model["weights"][f])
        key = _counted(sent[word].astype(np.int64) << BITS | f[word, col])
        z += np.bincount(key >> BITS, model["weights"][key & ((1 << BITS) - 1)], minlength=len(z))
    p = _sigmoid(z)
    logq = np.bincount(doc, _evidence(p, _sigmoid(model["bias"])), minlength=n) if len(doc) else np.zeros(n)
    found: list[list[dict]] = [[] for _ in range(n)]
    hit = np.flatnonzero(p >= cut)
    if len(hit):
        chars = np.concatenate([[0], np.cumsum((buf[:-8] & 0xC0) != 0x80)])
        base = chars[tv.offsets(texts) - tv.offsets(texts)[0]]
        for s in hit.tolist():
            d = int(doc[s])
            found[d].append({"start": int(chars[a[bounds[s]]] - base[d]), "end": int(chars[b[bounds[s + 1] - 1]] - base[d]), "score": float(p[s])})
    return -np.expm1(logq) + 0.0, found


_SENTENCE = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])
_OUT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("sentences", T.ArrayType(_SENTENCE))])
_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def toxicity(docs: DataFrame, model: dict, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """For every row: `row`, score (0 to 1) and its offending sentences (start, end, score).

    Null and empty texts have no sentence and the score 0 (or the model's constant).
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def work(texts):
            p, found = score(held.value, texts)
            return [pa.array(p, pa.float64()), pa.array(found, _ARROW)]

        return work

    return map_texts(docs, text_col, make, _OUT, keep)


def trained(docs: DataFrame, labels: DataFrame, keep=None, bound: int = SAMPLE) -> dict:
    """A model from the labelled rows of docs; keep: a condition on the id, for held-out rows. Labels: `toxic`."""
    model = fit(labelled_sample(docs, labels, "toxic", bound, keep))
    release(docs.sparkSession)
    return model
