"""English suffix stripping by the published algorithm of M. F. Porter (1980), over arrays of tokens."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tessera.functions.text import tokens

# The suffixes of steps 2, 3 and 4 with what replaces them, tried from the longest.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e",
    "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous",
    "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize", "ion")

_LETTERS = re.compile(r"[a-z]+")


def _shape(word: str) -> str:
    """v or c for each letter; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out[-1:] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short(word: str) -> bool:
    """Ends in consonant, vowel, consonant, the last not w, x or y."""
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _swap(word: str, endings: dict[str, str], holds: Callable[[str], bool]) -> str:
    for end in sorted(endings, key=len, reverse=True):
        if word.endswith(end):
            stem = word[: -len(end)]
            return stem + endings[end] if holds(stem) else word
    return word


def _plurals(word: str) -> str:
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(end):
            return word[: len(word) - len(end)] + new
    return word


def _past(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for end in ("ed", "ing"):
        if word.endswith(end):
            stem = word[: -len(end)]
            if not _has_vowel(stem):
                return word
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if _doubled(stem) and stem[-1] not in "lsz":
                return stem[:-1]
            return stem + "e" if _measure(stem) == 1 and _short(stem) else stem
    return word


def _final(word: str) -> str:
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short(word[:-1])):
            word = word[:-1]
    return word[:-1] if _measure(word) > 1 and _doubled(word) and word[-1] == "l" else word


@functools.lru_cache(maxsize=1 << 18)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of two letters or with other characters than a to z stay."""
    if len(word) <= 2 or not _LETTERS.fullmatch(word):
        return word
    word = _past(_plurals(word))
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(word, STEP2, lambda s: _measure(s) > 0)
    word = _swap(word, STEP3, lambda s: _measure(s) > 0)
    for end in sorted(STEP4, key=len, reverse=True):
        if word.endswith(end):
            left = word[: -len(end)]
            if _measure(left) > 1 and (end != "ion" or left.endswith(("s", "t"))):
                word = left
            break
    return _final(word)


@F.pandas_udf(ArrayType(StringType()))
def _stems(words: pd.Series) -> pd.Series:
    return words.map(lambda ws: [stem(w) for w in ws])


def stemmed(text: Column) -> Column:
    """Index tokens reduced to stems; distinct words are stemmed once in a worker."""
    return _stems(tokens(text))
