"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts are normalised to words between single spaces, so that a pattern " w1 ... wn " occurs at word bounds
only. Patterns are the windows of the test items, kept as places in the items' text. A table gives, for the hash of a
block of bytes, how far a search position can move on without missing an occurrence; where it can't move, the bucket
of that suffix hash names the patterns to compare byte by byte. Many positions of a text are searched at once.
Items come in blocks of bounded text; all blocks are searched, one after another, in one scan of the documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec as tv
from .shared import map_texts

U = np.uint64
#: words of a window; bytes of item text in a block (its tables take about ten times that); text searched for a block at a time
WINDOW, PASS_BYTES, SCAN_BYTES = 10, 4 << 20, 16 << 20
_SPACE, _MARK = 0x20, 0x0A

_all = np.arange(256)
_word = ((_all >= 0x30) & (_all <= 0x39)) | ((_all >= 0x41) & (_all <= 0x5A)) | ((_all >= 0x61) & (_all <= 0x7A)) | (_all >= 0x80)
NORMAL = np.where(_word, tv.LOWER, _SPACE).astype(np.uint8).tobytes()
data_words = _all != _SPACE


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words of digits, ASCII letters and all other code points above 0x7F."""
    return (text or "").encode("utf-8", "replace").translate(NORMAL).split(b" ") if text else []


class WuManber:
    """Occurrences of byte patterns: places (at, size) in a buffer with 8 spare bytes; patterns must be distinct and not empty."""

    #: patterns of such lengths and up to the next are searched together: a short one shortens all shifts
    CLASSES = (1, 4, 8, 16, 32)

    def __init__(self, data: np.ndarray, at: np.ndarray, size: np.ndarray):
        self.bytes, self.at, self.size = data, at, size
        self.groups = []
        bounds = [*self.CLASSES, 1 << 31]
        for lo, hi in zip(bounds, bounds[1:]):
            ids = np.flatnonzero((size >= lo) & (size < hi)).astype(np.int32)
            if len(ids):
                self.groups.append(self._tables(ids))

    @staticmethod
    def _hash(words: np.ndarray, block: int, bits: int) -> np.ndarray:
        return (words & U((1 << (8 * block)) - 1)) * U(0x9E3779B97F4A7C15) >> U(64 - bits)

    def _tables(self, ids: np.ndarray):
        view = np.ndarray((len(self.bytes) - 7,), "<u8", self.bytes, 0, (1,))
        at, least = self.at[ids], int(self.size[ids].min())
        # blocks grow with the patterns, so that few blocks of a text are one of theirs by chance, and so does the table
        entries = min(len(ids) * least, len(self.bytes))
        block = min(max(3, -(-int(entries).bit_length() // 3)), 8, least)
        bits = min(max(12, int(entries).bit_length() + 2), 24)
        shift = np.full(1 << bits, min(least - block + 1, 255), np.uint8)
        for end in range(block, least + 1):  # later blocks allow smaller shifts
            if least - end <= 255:
                shift[self._hash(view[at + (end - block)], block, bits)] = least - end
        suffix = self._hash(view[at + (least - block)], block, 32).astype(np.uint32)
        order = np.argsort(suffix, kind="stable")
        return least, block, bits, shift, suffix[order], ids[order]

    def mean_shift(self) -> float:
        """Mean of the shift tables: how far a position of random bytes moves."""
        return float(np.mean([g[3].mean() for g in self.groups]))

    def find(self, buf: np.ndarray, n: int, stride: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, position) of every occurrence in buf[:n]; buf has 8 spare bytes."""
        view = np.ndarray((len(buf) - 7,), "<u8", buf, 0, (1,))
        own = np.ndarray((len(self.bytes) - 7,), "<u8", self.bytes, 0, (1,))
        out_p, out_at = [], []
        for least, block, bits, shift, suffix, ids in self.groups:
            pos = np.arange(least - 1, n, stride)
            stop = np.minimum(pos + stride, n)
            found = []
            while len(pos):
                move = shift[self._hash(view[pos - (block - 1)], block, bits)]
                here = move == 0
                if here.any():
                    found.append(pos[here])
                pos = pos + np.maximum(move, 1)
                on = pos < stop
                if not on.all():
                    pos, stop = pos[on], stop[on]
            if not found:
                continue
            pos = np.concatenate(found)
            start = pos - (least - 1)
            h = self._hash(view[pos - (block - 1)], block, 32).astype(np.uint32)
            low = np.searchsorted(suffix, h, "left")
            many = np.searchsorted(suffix, h, "right") - low
            total = int(many.sum())
            for cut in range(0, len(h), 1 << 18) if total > 1 << 22 else (0,):  # bounded memory
                part = slice(cut, cut + (1 << 18)) if total > 1 << 22 else slice(None)
                m = many[part]
                first = np.repeat(low[part] - (np.cumsum(m) - m), m)
                pat = ids[first + np.arange(int(m.sum()))]
                at = np.repeat(start[part], m)
                ok = at + self.size[pat] <= n
                pat, at = _equal(view, own, self.at, self.size, pat[ok], at[ok], pat[ok])
                out_p.append(pat)
                out_at.append(at)
        z = np.zeros(0, np.int64)
        return (np.concatenate(out_p), np.concatenate(out_at)) if out_p else (z, z)


def _equal(view: np.ndarray, own: np.ndarray, pat_at: np.ndarray, pat_size: np.ndarray, pat: np.ndarray, at: np.ndarray, tag: np.ndarray):
    """(tag, at) of those comparisons in which own's bytes of pattern pat equal view's bytes from at on, eight at a time."""
    off = 0
    done_p, done_at = [], []
    while len(pat):
        size = pat_size[pat].astype(np.int64)
        rest = size - off
        keep = np.where(rest >= 8, U(2**64 - 1), (U(1) << (U(8) * np.clip(rest, 0, 7).astype(U))) - U(1))
        ok = (view[at + off] & keep) == (own[pat_at[pat] + off] & keep)
        off += 8
        end = ok & (size <= off)
        done_p.append(tag[end])
        done_at.append(at[end])
        ok &= ~end
        pat, at, tag = pat[ok], at[ok], tag[ok]
    return (np.concatenate(done_p), np.concatenate(done_at)) if done_p else (tag, at)


class Matcher:
    """Windows of items (id, text) and the items that hold them."""

    def __init__(self, items: list[tuple[str, str | None]], size: int):
        self.names = sorted({i for i, _ in items})
        index = {name: k for k, name in enumerate(self.names)}
        parts = [b" " + b" ".join(w) + b" " for w in ([x for x in words_of(t) if x] for _, t in items)]
        owner = np.array([index[i] for i, _ in items], np.int32)
        data = np.frombuffer(b"".join(parts) + b"\0" * 8, np.uint8)
        offs = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        del parts
        starts, ends, first = tv.word_bounds(data, offs, data_words)
        n = np.diff(first)
        many = np.where(n > 0, np.maximum(1, n - size + 1), 0)  # windows of each item
        total = int(many.sum())
        head = (np.repeat(first[:-1] - (np.cumsum(many) - many), many) + np.arange(total)).astype(np.int32)  # first word of each window
        words = np.minimum(np.repeat(n, many), size).astype(np.int32)
        owner = np.repeat(owner, many)
        at = (starts[head] - 1).astype(np.int32)
        length = (ends[head + words - 1] + 1 - at).astype(np.int32)
        # equal windows are one pattern: equal hashes first, then equal bytes
        own, h = tv.word_hashes(data, starts, ends), np.zeros(total, U)
        del starts, ends
        salt = tv.randoms(3, size)
        with np.errstate(over="ignore"):
            for k in range(size):
                h = tv.mix(h + np.where(k < words, own[np.minimum(head + k, max(0, len(own) - 1))] * salt[k], U(0))) if total else h
        del own, head
        order = np.argsort(h, kind="stable").astype(np.int32)
        new = np.ones(total, bool)
        new[1:] = h[order[1:]] != h[order[:-1]]
        rep = order[np.flatnonzero(new)][np.cumsum(new) - 1] if total else order
        differ = np.ones(total, bool)
        view = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
        same, _ = _equal(view, view, at, length, rep, at[order], np.arange(total))
        differ[same] = length[order[same]] != length[rep[same]]
        if differ.any():  # a collision of hashes: the windows of such a hash are patterns of their own, each
            new |= np.isin(rep, rep[differ])
        group = np.cumsum(new) - 1
        chosen = order[new]
        pair = np.unique(group * max(1, len(self.names)) + owner[order])
        group, item = pair // max(1, len(self.names)), pair % max(1, len(self.names))
        self.flat = item.astype(np.int32)
        self.first = np.searchsorted(group, np.arange(len(chosen) + 1)).astype(np.int32)
        self.words = words[chosen]
        self.search = WuManber(data, at[chosen], length[chosen]) if total else None

    def hits(self, text: Prepared) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first word, words) of occurrences, and distinct (text, item) pairs."""
        z = np.zeros(0, np.int64)
        if self.search is None or not len(text.starts):
            return z, z, z, z
        pat, at = self.search.find(text.buf, text.size)
        begin = np.searchsorted(text.starts, at)
        doc = np.searchsorted(text.bounds, begin, side="right") - 1
        one = np.unique(doc * len(self.words) + pat)
        d, p = one // len(self.words), one % len(self.words)
        m = (self.first[p + 1] - self.first[p]).astype(np.int64)
        which = self.flat[np.repeat(self.first[p] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))]
        pairs = np.unique(np.repeat(d, m) * max(1, len(self.names)) + which)
        return begin, self.words[pat], pairs // max(1, len(self.names)), pairs % max(1, len(self.names))


class Prepared:
    """Normalised texts and what was found in them so far."""

    def __init__(self, texts: pa.Array):
        parts = [t.translate(NORMAL) for t in texts.cast(pa.large_binary()).to_pylist()]
        raw = np.frombuffer(b"\n " + b" \n ".join(parts) + b" \n", np.uint8)
        word, mark = raw != _SPACE, raw == _MARK
        word &= ~mark
        keep = word | mark
        keep[1:] |= word[:-1] | mark[:-1]
        self.buf = np.concatenate([raw[keep], np.zeros(8, np.uint8)])
        self.size = len(self.buf) - 8
        word = (self.buf[: self.size] != _SPACE) & (self.buf[: self.size] != _MARK)
        first = word.copy()
        first[1:] &= ~word[:-1]
        self.starts = np.flatnonzero(first)
        self.bounds = np.searchsorted(self.starts, np.flatnonzero(self.buf[: self.size] == _MARK))
        self.step = np.zeros(len(self.starts) + 1, np.int32)
        self.items: list[set[str]] = [set() for _ in range(len(texts))]

    def add(self, m: Matcher) -> None:
        begin, words, doc, item = m.hits(self)
        np.add.at(self.step, begin, 1)
        np.add.at(self.step, begin + words, -1)
        for d, i in zip(doc.tolist(), item.tolist()):
            self.items[d].add(m.names[i])

    def result(self) -> tuple[np.ndarray, list[np.ndarray], list[list[str]]]:
        """n_words, merged hit spans [start, end, ...] in words, and items of each text."""
        spans, b = [np.zeros(0, np.int64)] * len(self.items), self.bounds
        hit = (np.cumsum(self.step[:-1]) > 0).astype(np.int8)
        for x, found in enumerate(self.items):
            if found:
                spans[x] = np.flatnonzero(np.diff(np.concatenate([[0], hit[b[x] : b[x + 1]], [0]])))
        return np.diff(b), spans, [sorted(x) for x in self.items]


_OUT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))])


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, keep: list[str] | None = None, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", pass_bytes: int = PASS_BYTES) -> DataFrame:
    """For every row of docs: `row`, n_words, spans (start, end, start, ... in words, end exclusive), items.

    items are the ids, sorted as strings, of the items with a window in the row's text; spans cover the
    words inside occurrences. Null and empty texts have no words. Items without words have no window;
    item rows with a null id are ignored, rows of one id are one item. Item text reaches the tasks in
    blocks of about `pass_bytes`; a task holds the tables of one block at a time and reads its rows once.
    """
    spark = docs.sparkSession
    bench = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("text")).where("id is not null")
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(total) // pass_bytes))
    part = F.pmod(F.xxhash64("id"), F.lit(blocks))
    held = [spark.sparkContext.broadcast(Matcher([(r.id, r.text) for r in bench.where(part == k).collect()], size)) for k in range(blocks)]

    def make():
        def work(texts):
            parts = [Prepared(texts.slice(lo, hi - lo)) for lo, hi in tv.slices(texts)]
            for b in held:
                # with several blocks the tables of one are let go before those of the next are read
                model = b.value if len(held) == 1 or not b._path else b.load_from_path(b._path)
                for p in parts:
                    p.add(model)
            got = [p.result() for p in parts]
            n_words, spans, items = ([x for g in got for x in g[i]] for i in range(3))
            return [pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]

        return work

    return map_texts(docs, text_col, make, _OUT, keep, SCAN_BYTES if blocks > 1 else tv.SLICE_BYTES)


def hit_words(spans):
    """Number of words in spans."""
    return F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("bigint"), lambda a, x: a + x)
