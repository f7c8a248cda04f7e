"""Statistics of words and of segments of texts (lines or passages), on packed bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import textvec as tv

U = np.uint64
_all = np.arange(256)


def _chars(s: str) -> np.ndarray:
    return np.isin(_all, [ord(c) for c in s])


SYMBOL = _chars("#*$%&|<>")
UPPER, ALPHA_LOW, DIGIT = (_all >= 65) & (_all <= 90), (_all >= 97) & (_all <= 122), (_all >= 48) & (_all <= 57)
LEAD = (_all & 0xC0) != 0x80
STOPS = _chars(".,;:?")
NAMES = ["bias", "upper", "symbols", "exclaims", "bars", "stutter", "repeats", "windows", "stops", "short", "middle", "long", "very_long", "word_length", "non_ascii", "digits", "copied", "ends"]


class Words:
    """Words (between white space) of some texts, with counts by text."""

    def __init__(self, texts: pa.Array):
        self.texts = texts
        self.buf, self.offs = tv.pack(texts)
        self.starts, self.ends, self.first = tv.word_bounds(self.buf, self.offs, tv.NOT_SPACE)
        self.hash = tv.word_hashes(self.buf, self.starts, self.ends)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def cum(self, table: np.ndarray) -> np.ndarray:
        """Running count of bytes that table marks."""
        return np.concatenate([[0], np.cumsum(table[self.buf[: self.offs[-1]]], dtype=np.int64)])

    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    def word_chars(self) -> np.ndarray:
        c = self.cum(LEAD & tv.NOT_SPACE)
        return c[self.offs[1:]] - c[self.offs[:-1]]

    def n_symbols(self) -> np.ndarray:
        c = self.cum(SYMBOL)
        return c[self.offs[1:]] - c[self.offs[:-1]]

    def repeated(self) -> np.ndarray:
        """Which words lie in a three-word window that their text holds twice or more."""
        n = len(self.hash)
        hit = np.zeros(n + 1, np.int64)
        if n >= 3:
            h, d = self.hash, self.doc
            with np.errstate(over="ignore"):
                w = tv.mix(tv.mix(tv.mix(h[:-2] + d[:-2].astype(U) * U(0x9E3779B97F4A7C15)) + h[1:-1]) + h[2:])
            ok = np.flatnonzero(d[:-2] == d[2:])
            order = ok[np.argsort(w[ok], kind="stable")]
            same = np.concatenate([[False], w[order[1:]] == w[order[:-1]]]) if len(order) else np.zeros(0, bool)
            twice = same.copy()
            twice[:-1] |= same[1:]
            at = order[twice]
            np.add.at(hit, at, 1)
            np.add.at(hit, np.minimum(at + 3, n), -1)
        return np.cumsum(hit[:-1]) > 0

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bounds in words of the lines that hold words (m + 1), their texts, and which equal an earlier line."""
        if not len(self.starts):
            return np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        line = np.searchsorted(np.flatnonzero(self.buf[: self.offs[-1]] == 10), self.starts)
        new = np.ones(len(line), bool)
        new[1:] = (line[1:] != line[:-1]) | (self.doc[1:] != self.doc[:-1])
        copied = []
        for b in self.texts.cast(pa.large_binary()).to_pylist():
            seen = set()
            for x in b.split(b"\n"):
                if x.strip(b" \t\n\v\f\r"):
                    copied.append(x in seen)
                    seen.add(x)
        bounds = np.append(np.flatnonzero(new), len(line))
        return bounds, self.doc[bounds[:-1]], np.array(copied, bool)

    def passages(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Bounds in words of runs of `size` words (the last of a text may be shorter), and their texts."""
        place = np.arange(len(self.starts)) - self.first[:-1][self.doc] if len(self.starts) else np.zeros(0, np.int64)
        at = np.flatnonzero(place % size == 0)
        return np.append(at, len(self.starts)), self.doc[at]


def features(w: Words, bounds: np.ndarray, repeated: np.ndarray, copied: np.ndarray | None = None) -> np.ndarray:
    """Features (0 to 1, NAMES) of segments of words; bounds: m + 1."""
    m = len(bounds) - 1
    if not m:
        return np.zeros((0, len(NAMES)))
    a, b = w.starts[bounds[:-1]], w.ends[bounds[1:] - 1]
    n = np.diff(bounds).astype(float)
    count = lambda t: (lambda c: (c[b] - c[a]).astype(float))(w.cum(t))
    over = lambda x, y, k=1.0: np.minimum(1.0, k * x / np.maximum(1.0, y))
    upper, low, chars = count(UPPER), count(ALPHA_LOW), count(LEAD)
    seg = np.repeat(np.arange(m), np.diff(bounds))
    with np.errstate(over="ignore"):
        key = tv.mix(w.hash + seg.astype(U) * U(0xD6E8FEB86659FD93))
    order = np.argsort(key, kind="stable")  # equal words of one segment fall together
    dup = np.zeros(len(order), bool)
    dup[order[1:]] = key[order[1:]] == key[order[:-1]]
    adjacent = np.zeros(len(seg), bool)
    adjacent[1:] = (w.hash[1:] == w.hash[:-1]) & (seg[1:] == seg[:-1])
    total = lambda x: np.bincount(seg, x, minlength=m)
    return np.stack([
        np.ones(m),
        over(upper, upper + low),
        over(count(SYMBOL), chars, 5),
        over(count(_chars("!")), n),
        over(count(_chars("|")), n),
        over(total(adjacent), n),
        np.clip(2.5 * (total(dup) / n - 0.6), 0, 1),  # long plain segments repeat about half of their words
        over(total(repeated), n),
        over(count(STOPS), n, 5),
        n < 3, (n >= 3) & (n < 10), (n >= 10) & (n < 30), n >= 30,
        over(chars, n, 0.05),
        over(count(LEAD & (_all >= 0x80)), chars, 3),
        over(count(DIGIT), chars, 3),
        np.zeros(m) if copied is None else copied,
        STOPS[w.buf[b - 1]] | (w.buf[b - 1] == ord("!")),
    ], axis=1).astype(float)
