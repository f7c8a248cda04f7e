"""The stemmer's expressions against the algorithm written out word by word."""

import random

from reviewloom.functions import porter



def _shape(w: str) -> str:
    """c and v for each letter; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(w):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    s = _shape(stem)
    return sum(1 for a, b in zip(s, s[1:]) if a == "v" and b == "c")


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c"


def _cvc(w: str) -> bool:
    return len(w) > 2 and _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay."""
    w = word
    if len(w) <= 2:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        cut = next((s for s in ("ed", "ing") if w.endswith(s) and "v" in _shape(w[: -len(s)])), None)
        if cut:
            w = w[: -len(cut)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (porter.STEP2, porter.STEP3):
        for end, new in sorted(table, key=lambda x: -len(x[0])):
            if w.endswith(end):
                if _measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + new
                break
    for end in sorted(porter.STEP4, key=len, reverse=True):
        if w.endswith(end):
            rest = w[: -len(end)]
            if _measure(rest) > 1 and (end != "ion" or rest[-1:] in ("s", "t")):
                w = rest
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


STEMS = [("caresses", "caress"), ("ponies", "poni"), ("ties", "ti"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("rational", "ration"), ("adjustable", "adjust"), ("effective", "effect"), ("rate", "rate"), ("controll", "control"), ("one", "on"), ("ones", "on"), ("apples", "appl"), ("generalizations", "gener"), ("enjoy", "enjoi"), ("by", "by"), ("a", "a"), ("", "")]


def test_known_stems(spark):
    got = porter.stems(spark.createDataFrame([(w,) for w, _ in STEMS] + [(None,)], "word string")).collect()
    assert sorted((r.word, r.stem) for r in got if r.word is not None) == sorted(STEMS) and [r.stem for r in got if r.word is None] == [None]


def test_words_of_all_endings(spark):
    """Random stems, rich in y, with every ending, and two in a row."""
    r = random.Random(1)
    ends = ["", "s", "ies", "sses", "eed", "ed", "ing", "y", "e", "ll"] + [e for e, _ in porter.STEP2 + porter.STEP3] + porter.STEP4
    words = {"".join(r.choice("aeiouyyyybcdlsstz") for _ in range(r.randrange(1, 7))) + r.choice(ends) + r.choice(["", "", r.choice(ends)]) for _ in range(6000)}
    got = {x.word: x.stem for x in porter.stems(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert {w: s for w, s in got.items() if s != stem(w)} == {}
