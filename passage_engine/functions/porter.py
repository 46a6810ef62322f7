"""Tokens of the full-text index: Unicode letters and digits, diacritics folded, lower case, Porter's stemmer."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Fixed values of Porter's algorithm (Porter 1980), steps 2 to 4: suffix and replacement.
STEP_2 = dict(
    ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", logi="log", bli="ble", alli="al", entli="ent", eli="e", ousli="ous",
    ization="ize", ation="ate", ator="ate", alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble",
)
STEP_3 = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _form(stem: str) -> str:
    """The stem as a run of c (consonant) and v (vowel)."""
    out = ""
    for i, ch in enumerate(stem):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _form(stem)))


def _double(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and _form(stem)[-1] == "c"


def _cvc(stem: str) -> bool:
    return _form(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _replaced(word: str, table: dict[str, str]) -> str:
    for suffix in sorted(table, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + table[suffix] if _measure(stem) > 0 else word
    return word


@lru_cache(200_000)
def stem(word: str) -> str:
    """Porter's stem; words of fewer than three or more than 64 letters stay as they are."""
    if not 3 <= len(word) <= 64 or not word.isascii():
        return word
    if (word.endswith("sses") and len(word) > 4) or (word.endswith("ies") and len(word) > 3):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    cut = None
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    elif word.endswith("ed") and "v" in _form(word[:-2]):
        cut = word[:-2]
    elif word.endswith("ing") and "v" in _form(word[:-3]):
        cut = word[:-3]
    if cut is not None:
        if cut.endswith(("at", "bl", "iz")) or (_measure(cut) == 1 and _cvc(cut) and not (_double(cut) and cut[-1] not in "lsz")):
            word = cut + "e"
        else:
            word = cut[:-1] if _double(cut) and cut[-1] not in "lsz" else cut
    if word.endswith("y") and "v" in _form(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, STEP_2), STEP_3)
    for suffix in sorted(STEP_4, key=len, reverse=True):
        if word.endswith(suffix):
            rest = word[: -len(suffix)]
            if _measure(rest) > 1 and (suffix != "ion" or rest[-1:] in ("s", "t")):
                word = rest
            break
    if word.endswith("e"):
        rest = word[:-1]
        if _measure(rest) > 1 or (_measure(rest) == 1 and not _cvc(rest)):
            word = rest
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def fold(text: str) -> str:
    """Lower case without diacritics."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


def index_tokens(text: str | None) -> list[str]:
    return [stem(w) for w in re.findall(r"[^\W_]+", fold(text or ""))]


@F.pandas_udf(ArrayType(StringType()))
def stemmed(texts: pd.Series) -> pd.Series:
    """Index tokens of a text column."""
    return texts.map(index_tokens)


@F.pandas_udf(StringType())
def stem_of(words: pd.Series) -> pd.Series:
    """Stems of a column of words."""
    return words.map(lambda w: stem(fold(w)) if w is not None else None)
