"""Tagging of segmented corpora: characters of place names get B M E or S, others O."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F

PLACE = "ns"
#: a bracket group with its tag, or a token
_UNIT = re.compile(r"\[([^\[\]]*)\](\S*)|(\S+)")


def tag_tokens(words: list[str]) -> list[tuple[str, str]]:
    """(character, tag) of word/tag tokens; [a/x b/y]tag is one word with the bracket's tag.

    An unbalanced bracket raises ValueError.
    """
    out: list[tuple[str, str]] = []
    for inner, group_tag, token in _UNIT.findall(" ".join(words)):
        if "[" in token or "]" in token:
            raise ValueError("unbalanced bracket")
        word, tag = ("".join(w.split("/")[0] for w in inner.split()), group_tag) if not token else (token.split("/")[0], token.partition("/")[2])
        n = len(word)
        if tag != PLACE:
            tags = "O" * n
        else:
            tags = "S" if n == 1 else "B" + "M" * (n - 2) + "E" if n else ""
        out += zip(word, tags)
    return out


def tags_udf():
    """Arrays of tokens to arrays of (ch, tag): brackets join words across tokens, which no expression states clearly."""
    from ..sources.scratch import ship

    ship()

    @F.pandas_udf("array<struct<ch:string,tag:string>>")
    def tags(words: pd.Series) -> pd.Series:
        return words.map(lambda ws: None if ws is None else [{"ch": c, "tag": t} for c, t in tag_tokens(list(ws))])

    return tags
