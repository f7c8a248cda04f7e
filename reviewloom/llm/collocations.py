"""Phrase collocations: merged count-min sketches over-estimate counts of word n-grams, a second pass counts the survivors exactly.

A sketch never estimates too little, so no frequent n-gram is lost: whatever it lets through beyond them is dropped
after the exact count. Candidates are then scored at their weakest cut, and those inside a longer one of about their count go.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .shared import drop_written, salted_join, ship, written

#: words of a phrase; occurrences of a candidate; share of a longer phrase's count (percent) from which a shorter one goes
WORDS, LEAST, COVERED = 4, 30, 80
#: rows of a sketch; its cells for a row: one for each CELL_BYTES bytes of text, 2^LARGEST at most (a byte each, in a task)
ROWS, CELL_BYTES, SMALLEST, LARGEST = 2, 16, 16, 27
#: cells of a block that is merged at a time; bytes of text that a task reads for each byte of its sketch, at least
BLOCK, PER_BYTE = 1 << 14, 32
#: pieces of a language whose best phrases are chosen apart
PIECES = 32
UNDEFINED = "und"

_b = np.arange(256)
#: bytes that bound pieces of a text, and those of words
_PIECE = np.isin(_b, [ord(c) for c in ".,;:!?"]) | ((_b >= 0x0A) & (_b <= 0x0D))
_WORD = ~_PIECE & (_b != 0x20) & (_b != 0x09)


class Grams:
    """The distinct n-grams of a slice of texts, by language: for n = 1 ... WORDS a place of each and how often it stands.

    Words get dense numbers from a dictionary of their bytes, n-grams from pairs of (n-1)-gram and word: equality is exact.
    """

    def __init__(self, texts: pa.Array, langs: pa.Array, most: int = WORDS):
        buf, offs = tv.pack(texts)
        low = tv.LOWER[buf]
        starts, ends, first = tv.word_bounds(low, offs, _WORD)
        n = len(starts)
        coded = pc.fill_null(langs.cast(pa.string()), UNDEFINED).dictionary_encode()
        self.langs, doc = coded.dictionary, np.repeat(np.arange(len(texts)), np.diff(first))
        self.lang = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[doc]
        self.n_words = np.bincount(self.lang, minlength=len(self.langs))
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        if not n:
            return
        size = ends - starts
        body = low[: offs[-1]][_WORD[buf[: offs[-1]]]]
        bounds = np.concatenate([[0], np.cumsum(size)])
        words = pa.LargeStringArray.from_buffers(n, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(body)))
        coded = words.dictionary_encode()
        self.words, self.word = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        held = np.concatenate([np.frombuffer(self.words.buffers()[2] or b"", np.uint8)[: tv.offsets(self.words)[-1]], np.zeros(8, np.uint8)])
        at = tv.offsets(self.words)
        self.word_hash = tv.word_hashes(held, at[:-1], at[1:])
        # the piece of a word: separators before it, and its text
        breaks = np.cumsum(_PIECE[buf[: offs[-1]]])[starts]
        joined = np.zeros(n, bool)
        joined[1:] = (breaks[1:] == breaks[:-1]) & (doc[1:] == doc[:-1])
        key, live = self.lang * len(self.words) + self.word, np.arange(n)
        for k in range(1, most + 1):
            order = np.argsort(key, kind="quicksort")
            run = key[order]
            new = np.concatenate([[True], run[1:] != run[:-1]])
            edge = np.flatnonzero(new)
            self.grams.append((live[order[edge]], np.diff(np.append(edge, len(run)))))
            if k == most:
                break
            number = np.empty(len(key), np.int64)
            number[order] = np.cumsum(new) - 1
            # an n-gram goes on where its next word is joined to its last one
            on = live + k < n
            on[on] = joined[live[on] + k]
            key, live = number[on] * len(self.words) + self.word[live[on] + k], live[on]
            if not len(live):
                break

    def hashes(self, lang_hash: np.ndarray):
        """(n, places, counts, hashes) for each n; the hash depends on language, length and words only."""
        for k, (at, count) in enumerate(self.grams, 1):
            h = lang_hash[self.lang[at]] + np.uint64(k)
            for i in range(k):
                h = tv.mix(h * np.uint64(0x9E3779B97F4A7C15) + self.word_hash[self.word[at + i]])
            yield k, at, count, h

    def phrases(self, k: int, at: np.ndarray) -> pa.Array:
        parts = [self.words.take(pa.array(self.word[at + i])) for i in range(k)]
        return parts[0] if k == 1 else pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()))


def _lang_hashes(langs: pa.Array) -> np.ndarray:
    data, offs = tv.pack(langs.cast(pa.large_string()))
    return tv.word_hashes(data, offs[:-1], offs[1:])


def _cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (tv.mix(h + np.uint64(tv.mix_int(row + 1))) >> np.uint64(64 - bits)).astype(np.int64)


def _slices(batches):
    for b in batches:
        texts = tv.text_column(b, "text")
        for lo, hi in tv.slices(texts):
            yield Grams(texts.slice(lo, hi - lo), b.column(1).slice(lo, hi - lo))


def sketched(texts: DataFrame, bits: int, least: int) -> list[tuple[int, int, bytes]]:
    """(row, block, bits): which cells of the merged sketch reach `least`. texts: text, lang.

    Each task counts into a sketch of its own, in bytes that stop at 255 (least is below that). Tasks' blocks are added by
    key; the driver gets one bit for each cell. Blocks without such a cell are left out.
    """

    def run(batches):
        cells = np.zeros((ROWS, 1 << bits), np.uint8)
        for g in _slices(batches):
            for _, _, count, h in g.hashes(_lang_hashes(g.langs)):
                for row in range(ROWS):
                    at = _cells(h, row, bits)
                    order = np.argsort(at, kind="quicksort")
                    run_ = at[order]
                    edge = np.flatnonzero(np.concatenate([[True], run_[1:] != run_[:-1]]))
                    cells[row, run_[edge]] = np.minimum(cells[row, run_[edge]] + np.add.reduceat(count[order], edge), 255)
        for row in range(ROWS):
            blocks = cells[row].reshape(-1, BLOCK)
            full = np.flatnonzero(blocks.any(axis=1))
            for lo in range(0, len(full), 256):
                some = full[lo : lo + 256]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), row, np.int32)), pa.array(some, pa.int32()), pa.array([blocks[i].tobytes() for i in some], pa.binary())], ["row", "block", "cells"])

    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.int64)
        for c in table.column("cells"):
            total += np.frombuffer(c.as_py(), np.uint8)
        held = total >= least
        one = table.select(["row", "block"]).slice(0, 1 if held.any() else 0)
        return one.append_column("bits", pa.array([np.packbits(held).tobytes()] * one.num_rows, pa.binary()))

    parts = texts.mapInArrow(run, "row int, block int, cells binary")
    return [tuple(r) for r in parts.groupBy("row", "block").applyInArrow(merge, "row int, block int, bits binary").toLocalIterator()]


def frequent(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, largest: int = LARGEST) -> DataFrame:
    """(lang, k, phrase, f): exact counts of all n-grams of 1 ... WORDS words that stand `least` times in their language; written.

    Under k = 0 stands each language's number of words. The sketch grows with the text up to 2^largest cells for a row: beyond
    that (16 bytes of text for a cell) it lets more n-grams through to the exact count, which spills and is spread like any
    other sum. Bytes above 255 aren't told apart, so least must be 255 at most.
    """
    if not 1 <= least <= 255:
        raise ValueError("least must be 1 to 255")
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(UNDEFINED)).alias("lang")).where("text is not null")
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(largest, max(SMALLEST, int(total // CELL_BYTES).bit_length()))
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // (PER_BYTE * ROWS << bits)))
    flags = np.zeros((ROWS, 1 << (bits - 3)), np.uint8)
    for row, block, some in sketched(texts.coalesce(tasks), bits, least):
        flags[row, block * (BLOCK >> 3) : (block + 1) * (BLOCK >> 3)] = np.frombuffer(some, np.uint8)
    held = spark.sparkContext.broadcast(flags)  # 2^largest bits for a row at most
    del flags

    def survivors(batches):
        flags = held.value
        for g in _slices(batches):
            n = len(g.langs)
            yield pa.RecordBatch.from_arrays([g.langs, pa.array([0] * n, pa.int32()), pa.array([""] * n, pa.string()), pa.array(g.n_words, pa.int64())], ["lang", "k", "phrase", "f"])
            for k, at, count, h in g.hashes(_lang_hashes(g.langs)):
                for row in range(ROWS):
                    c = _cells(h, row, bits)
                    kept = (flags[row, c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 > 0
                    at, count, h = at[kept], count[kept], h[kept]
                names = g.langs.take(pa.array(g.lang[at]))
                yield pa.RecordBatch.from_arrays([names, pa.array(np.full(len(at), k, np.int32)), g.phrases(k, at).cast(pa.string()), pa.array(count, pa.int64())], ["lang", "k", "phrase", "f"])

    got = texts.mapInArrow(survivors, "lang string, k int, phrase string, f long").groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f"))
    out = written(got.where((F.col("f") >= least) | (F.col("k") == 0)), "ngrams")
    held.unpersist()
    return out


def scored(counts: DataFrame) -> DataFrame:
    """(lang, k, phrase, a, l, r, score) of all candidates: the cut of the lowest floor(2000000 * a / (l + r)), the first of equal ones."""
    grams = counts.where("k > 0")
    cut = F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")
    words = F.split("phrase", " ")
    part = lambda lo, n: F.array_join(F.slice(words, lo, n), " ")
    cuts = grams.where("k > 1").select("lang", "phrase", cut).select("lang", "phrase", "cut", F.explode(F.array(F.struct(F.lit(True).alias("left"), part(F.lit(1), F.col("cut")).alias("part")), F.struct(F.lit(False).alias("left"), part(F.col("cut") + 1, F.size(words)).alias("part")))).alias("p"))
    cuts = cuts.select("lang", "phrase", "cut", "p.left", "p.part")
    # a common word begins or ends very many phrases: such keys are cut into pieces
    fan = cuts.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("fan"))
    right = grams.select("lang", F.col("phrase").alias("part"), F.col("f").alias("pf")).join(fan, ["lang", "part"])
    total = counts.where("k > 1").agg(F.sum(2 * (F.col("k") - 1))).first()[0] or 0
    sides = salted_join(cuts, right, ["lang", "part"], "fan", total)
    side = lambda i, left: F.max(F.when((F.col("cut") == i) & (F.col("left") == left), F.col("pf")))
    by_cut = sides.groupBy("lang", "phrase").agg(*[side(i, left).alias(f"{'l' if left else 'r'}{i}") for i in range(1, WORDS) for left in (True, False)])
    value = lambda i: F.expr(f"2000000BD * cast(a as decimal(20,0)) div (cast(l{i} as decimal(20,0)) + cast(r{i} as decimal(20,0)))")
    got = grams.where("k > 1").select("lang", "k", "phrase", F.col("f").alias("a")).join(by_cut, ["lang", "phrase"])
    options = F.array_compact(F.array(*[F.when(F.col("k") > i, F.struct(value(i).alias("score"), F.lit(i).alias("cut"), F.col(f"l{i}").alias("l"), F.col(f"r{i}").alias("r"))) for i in range(1, WORDS)]))
    return got.withColumn("x", F.array_min(options)).select("lang", "k", "phrase", "a", "x.l", "x.r", F.col("x.score").cast("long").alias("score"))


def subsumed(candidates: DataFrame, covered: int = COVERED) -> DataFrame:
    """candidates (lang, k, phrase, a, ...) without those that stand inside a longer one with 100 * f(longer) >= covered * a."""
    words = F.split("phrase", " ")
    spans = [(i, n) for n in range(2, WORDS) for i in range(1, WORDS - n + 2)]
    inner = F.array_distinct(F.array_compact(F.array(*[F.when((F.col("k") > n) & (F.col("k") >= i + n - 1), F.array_join(F.slice(words, i, n), " ")) for i, n in spans])))
    longer = candidates.where("k > 2").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    held = F.col("longer").isNull() | (wide("longer") * 100 < wide("a") * covered)
    return candidates.join(longer, ["lang", "phrase"], "left").where(held).drop("longer")


def best(candidates: DataFrame, most: int) -> DataFrame:
    """The first `most` of each language by score, count (both falling) and phrase, with their rank.

    The best of PIECES pieces of a language are chosen first, so that no task gets more than PIECES * most rows of it.
    """
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    piece = F.pmod(F.xxhash64("phrase"), F.lit(PIECES))
    few = candidates.withColumn("_piece", piece).withColumn("_n", F.row_number().over(Window.partitionBy("lang", "_piece").orderBy(*order))).where(F.col("_n") <= most)
    got = few.drop("_piece", "_n").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return got.where(F.col("rank") <= most)


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, most: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `most` phrases of 2 ... WORDS words of each language (null: `und`).

    Texts (null: empty) are lower-cased (A-Z), split at .,;:!? and line ends into pieces, these at spaces and tabs into words.
    The counts are written to the shared folder; the result reads them.
    """
    counts = frequent(docs, text_col, lang_col, least)
    candidates = written(scored(counts), "candidates")
    words = counts.where("k = 0").select("lang", F.col("f").alias("n"))
    got = best(subsumed(candidates), most).join(F.broadcast(words), "lang")  # a row for each language
    return got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
