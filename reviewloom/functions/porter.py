"""Porter's stemmer (1980) as SQL expressions: its rules, in order, over a table of distinct words.

Each rule is a pattern of a word's end with a condition on what stands before it. Vowels and consonants are letters, with one
exception: y is a vowel after a consonant. So the words are marked first: a y that counts as a consonant becomes Y.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Endings and what replaces them.
STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

_V, _C = "[aeiouy]", "[^aeiouy]"
#: a beginning of measure over 0, over 1, and a whole stem of measure 1 (vowels, consonants: one turn)
_OVER_0, _OVER_1, _IS_1 = f"^{_C}*{_V}+{_C}", f"^{_C}*{_V}+{_C}+{_V}+{_C}", f"^{_C}*{_V}+{_C}+{_V}*"
_DOUBLE = "(" + "|".join(2 * c for c in "bcdfghjkmnpqrtvwx") + ")$"
#: consonant, vowel, consonant other than w, x and y
_CVC = f"{_C}{_V}[^aeiouywxY]"


def _endings(rules: list[tuple[str, str]], holds) -> str:
    """The longest ending that fits decides, whether its condition holds or not."""
    return "CASE " + " ".join(f"WHEN w LIKE '%{end}' THEN CASE WHEN {holds(end)} THEN substr(w, 1, length(w) - {len(end)}) || '{new}' ELSE w END" for end, new in sorted(rules, key=lambda r: -len(r[0]))) + " ELSE w END"


def rules(match: str = "w RLIKE '{}'") -> list[tuple[str, str]]:
    """(column, expression) of each step in order; expressions read w, and the column `cut` of the step before it.

    match: how the SQL dialect asks for a pattern in w. Words of one or two letters stay as they are (`stems` leaves them out).
    """
    has = lambda pattern: match.format(pattern)
    less = lambda n: f"substr(w, 1, length(w) - {n})"
    over = lambda beginning: lambda end: has(f"{beginning}.*{end}$")
    return [
        ("w", f"CASE WHEN w LIKE '%sses' OR w LIKE '%ies' THEN {less(2)} WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN {less(1)} ELSE w END"),
        ("cut", f"CASE WHEN w LIKE '%eed' THEN 0 WHEN {has(_V + '.*ed$')} THEN 2 WHEN {has(_V + '.*ing$')} THEN 3 ELSE 0 END"),
        ("w", f"CASE WHEN w LIKE '%eed' AND {has(_OVER_0 + '.*eed$')} THEN {less(1)} ELSE {less('cut')} END"),
        ("w", f"CASE WHEN cut = 0 THEN w WHEN {has('(at|bl|iz)$')} THEN w || 'e' WHEN {has(_DOUBLE)} THEN {less(1)} WHEN {has(_IS_1 + '$')} AND {has(_CVC + '$')} THEN w || 'e' ELSE w END"),
        ("w", f"CASE WHEN {has(_V + '.*[yY]$')} THEN {less(1)} || 'i' ELSE w END"),
        ("w", _endings(STEP2, over(_OVER_0))),
        ("w", _endings(STEP3, over(_OVER_0))),
        ("w", _endings([(end, "") for end in STEP4], lambda end: has(f"{_OVER_1}.*{end}$") if end != "ion" else f"{has(_OVER_1 + '.*ion$')} AND {has('[st]ion$')}")),
        ("w", f"CASE WHEN w NOT LIKE '%e' THEN w WHEN {has(_OVER_1 + '.*e$')} OR {has(_IS_1 + 'e$')} AND NOT {has(_CVC + 'e$')} THEN {less(1)} ELSE w END"),
        ("w", f"CASE WHEN w LIKE '%ll' AND {has(_OVER_1)} THEN {less(1)} ELSE w END"),
    ]


#: what marks consonant y: at the beginning, after a vowel, and every second y of a run
MARKS = [("(^|[aeiou])y", "Y"), ("yy", "yY")]


def stems(words: DataFrame, word: str = "word") -> DataFrame:
    """words with `stem`, the stem of a lower-case word of a-z: two letters or fewer stay, null stays null. One row for each row."""
    got = words.withColumn("w", F.regexp_replace(F.regexp_replace(F.col(word), MARKS[0][0], "$1Y"), MARKS[1][0], MARKS[1][1])).withColumn("cut", F.lit(0))
    for name, step in rules():
        got = got.withColumn(name, F.expr(step))
    return got.withColumn("stem", F.when(F.length(word) <= 2, F.col(word)).otherwise(F.lower("w"))).drop("w", "cut")


def stems_sql(source: str) -> str:
    """CTEs of the same rules for a dialect with regexp_matches: `stems` (word, stem) of `source` (word)."""
    ctes = [f"s0 AS (SELECT word, regexp_replace(regexp_replace(word, '{MARKS[0][0]}', '\\1Y', 'g'), 'yy', 'yY', 'g') AS w, 0 AS cut FROM {source})"]
    for i, (name, step) in enumerate(rules("regexp_matches(w, '{}')")):
        ctes.append(f"s{i + 1} AS (SELECT word, {step if name == 'w' else 'w'} AS w, {step if name == 'cut' else 'cut'} AS cut FROM s{i})")
    return ", ".join([*ctes, f"stems AS (SELECT word, CASE WHEN length(word) <= 2 THEN word ELSE lower(w) END AS stem FROM s{len(rules())})"])
