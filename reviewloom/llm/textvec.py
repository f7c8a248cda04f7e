"""Vectorised text primitives on UTF-8 bytes: packing, word bounds, word hashes.

All functions work on whole texts. Work is cut into row ranges of bounded bytes (`slices`),
so memory follows the longest text, not the size of an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SLICE_BYTES = 1 << 20

_all = np.arange(256)
#: bytes of words that white space (0x20, 0x09-0x0D) bounds
NOT_SPACE = ~((_all == 0x20) | ((_all >= 0x09) & (_all <= 0x0D)))
LOWER = np.where((_all >= 65) & (_all <= 90), _all + 32, _all).astype(np.uint8)
LOWER_BYTES = LOWER.tobytes()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def mix_int(x: int) -> int:
    return int(mix(np.array([x & (2**64 - 1)], dtype=U))[0])


def randoms(seed: int, n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(mix_int(seed)))


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A string column without nulls (null: empty), with 64-bit offsets."""
    col = batch.column(batch.schema.get_field_index(name)).cast(pa.large_string())
    return pc.fill_null(col, "")


def offsets(arr: pa.Array) -> np.ndarray:
    return np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1]


def slices(arr: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [lo, hi) of at most `limit` bytes, or of one row."""
    if not len(arr):
        return
    offs, lo = offsets(arr), 0
    while lo < len(arr):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        hi = min(hi, len(arr))
        yield lo, hi
        lo = hi


def pack(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, with 8 spare bytes behind, and the n + 1 bounds of the texts."""
    offs = offsets(arr)
    data = np.frombuffer(arr.buffers()[2] or b"", dtype=np.uint8)[offs[0] : offs[-1]] if len(arr) and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return np.concatenate([data, np.zeros(8, np.uint8)]), offs - offs[0]


def word_bounds(buf: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and each text's first word (n + 1 bounds). Words never cross texts."""
    n = int(offs[-1])
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    w = is_word[buf[:n]]
    first, last = w.copy(), w.copy()
    first[1:] &= ~w[:-1]
    last[:-1] &= ~w[1:]
    full = offs[:-1] < offs[1:]
    a, b = offs[:-1][full], offs[1:][full] - 1
    first[a] = w[a]
    last[b] = w[b]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, eight bytes at a time; equal bytes, equal hash."""
    view = np.ndarray((len(buf) - 7,), "<u8", np.ascontiguousarray(buf), 0, (1,))
    left = ends - starts
    keep = np.where(left >= 8, U(2**64 - 1), (U(1) << (U(8) * np.minimum(left, 7).astype(U))) - U(1))
    h = mix((view[starts] & keep) + U(0x9E3779B97F4A7C15) * (left.astype(U) + U(1)))
    todo, at = np.flatnonzero(left > 8), 8
    while len(todo):
        rest = left[todo] - at
        keep = np.where(rest >= 8, U(2**64 - 1), (U(1) << (U(8) * np.minimum(rest, 7).astype(U))) - U(1))
        h[todo] = mix(h[todo] * U(0xD6E8FEB86659FD93) + (view[starts[todo] + at] & keep))
        at += 8
        todo = todo[left[todo] > at]
    return h


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between n + 1 bounds; empty ranges give 0."""
    c = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values)])
    return c[bounds[1:]] - c[bounds[:-1]]
