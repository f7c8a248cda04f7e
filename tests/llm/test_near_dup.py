"""Near-duplicates against brute force."""

import collections
import random
import re

import pytest

from reviewloom.llm import near_dup
from reviewloom.llm.components import connected_components
from reviewloom.sources import scratch

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, width, percent=80):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            k = len(sets[x] & sets[y])
            if y < x and k and 100 * k >= percent * (len(sets[x]) + len(sets[y]) - k):
                a, b = find(x), find(y)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def texts(n, seed):
    """Random texts, with copies of few and of many edits, short ones, empty ones and a long one."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeXé") for _ in range(r.randint(1, 6)))
    out = []
    base = [word() for _ in range(120)]
    for i in range(n):
        k = r.random()
        if k < 0.45:  # one large group whose members differ by various amounts
            w = list(base)
            for _ in range(r.randint(0, 9)):
                w[r.randrange(len(w))] = word()
            out.append(" ".join(w))
        elif k < 0.6 and out:
            out.append((r.choice(out) or "") + r.choice(["", " " + word()]))
        elif k < 0.7:
            out.append(r.choice(["", None, " \n\t", "one", "one two", "One two", "one two three four", "a a a a a a a"]))
        else:
            out.append(" ".join(word() for _ in range(r.randint(1, 60))))
    out.append(" ".join(word() for _ in range(30000)))
    return list(enumerate(out, 10))


@pytest.mark.parametrize("width, block", [(4, 512), (5, 16)])
def test_same_as_brute_force(spark, monkeypatch, width, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    monkeypatch.setattr(near_dup, "SET_BLOCK", block)
    monkeypatch.setattr(near_dup, "BROADCAST_IDS", 2_000_000 if block > 100 else 0)  # small bounds force the ways that large inputs take
    monkeypatch.setattr(scratch, "HEAVY_ROWS", block)
    monkeypatch.setattr(scratch, "HEAVY_KEYS", 1 << 40)
    monkeypatch.setattr(scratch, "SMALL_ROWS", 100_000 if block > 100 else 0)
    rows = texts(220, width)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs, width).collect()}
    want = brute(rows, width)
    assert got == want and max(collections.Counter(c for _, c in want.values()).values()) > 20


def test_components_of_a_path(spark):
    n = 70
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 100: 100, 101: 100}


def test_sketches_estimate(spark):
    import numpy as np

    r = np.random.default_rng(3)
    flat, bounds, true = [], [0], []
    for j in (1.0, 0.9, 0.8, 0.3, 0.0):
        common = int(400 * 2 * j / (1 + j))
        a = r.integers(0, 2**63, 400, dtype=np.uint64)
        b = np.concatenate([a[:common], r.integers(0, 2**63, 400 - common, dtype=np.uint64)])
        for s in (a, b):
            flat.append(s)
            bounds.append(bounds[-1] + len(s))
        true.append(j)
    _, _, sketch = near_dup.signatures(np.concatenate(flat), np.array(bounds))
    z = [int(np.bitwise_count(sketch[i] ^ sketch[i + 1]).sum()) for i in range(0, len(sketch), 2)]
    assert z[0] == 0 and z[1] < near_dup.MAX_FLIPS and z[2] < near_dup.MAX_FLIPS < z[3] < z[4]


def test_percent_below_the_proven_one_is_an_error(spark):
    with pytest.raises(ValueError):
        near_dup.near_duplicates(spark.createDataFrame([], "doc_id long, text string"), percent=50)
