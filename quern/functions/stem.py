"""English word stems by Porter's published algorithm (1980), a word at a time, each distinct word once a batch."""

from __future__ import annotations

import functools
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

#: Suffixes of the algorithm's second, third and fourth steps, with what takes their place.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"),
    ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """v for each vowel and c for each consonant; y is a vowel after a consonant."""
    out: list[str] = []
    for k, letter in enumerate(word):
        vowel = letter in "aeiou" or letter == "y" and k > 0 and out[-1] == "c"
        out.append("v" if vowel else "c")
    return "".join(out)


def _measure(word: str) -> int:
    """How many times vowels are followed by consonants."""
    return len(re.findall("v+c+", _shape(word)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short(word: str) -> bool:
    """Ends in consonant, vowel, consonant, the last not w, x or y."""
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _swapped(word: str, rules) -> str:
    """The longest suffix that fits gives way if something with a vowel and a consonant is left."""
    fits = [(end, new) for end, new in rules if word.endswith(end)]
    if fits:
        end, new = max(fits, key=lambda rule: len(rule[0]))
        left = word[: -len(end)]
        if _measure(left) > 0:
            return left + new
    return word


def _plurals(word: str) -> str:
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(end):
            return word[: -len(end)] + new
    return word


def _past(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for end in ("ed", "ing"):
        left = word[: -len(end)]
        if word.endswith(end) and "v" in _shape(left):
            if left.endswith(("at", "bl", "iz")):
                return left + "e"
            if _double(left) and left[-1] not in "lsz":
                return left[:-1]
            return left + "e" if _measure(left) == 1 and _short(left) else left
    return word


@functools.lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of a word in small letters; words of one or two letters are their own."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    word = _past(_plurals(word))
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swapped(_swapped(word, STEP_2), STEP_3)
    fits = [end for end in STEP_4 if word.endswith(end)]
    if fits:
        left = word[: -len(max(fits, key=len))]
        if _measure(left) > 1 and (not word.endswith("ion") or left.endswith(("s", "t"))):
            word = left
    if word.endswith("e"):
        left = word[:-1]
        if _measure(left) > 1 or _measure(left) == 1 and not _short(left):
            word = left
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


@F.pandas_udf(StringType())
def stems(words: pd.Series) -> pd.Series:
    """The stem of each word, worked out once for each distinct one of a batch."""
    codes, distinct = pd.factorize(words)
    return pd.Series([stem(w) for w in distinct], dtype=object).reindex(codes).reset_index(drop=True)


@F.arrow_udf(StructType().add("terms", ArrayType(StringType())).add("counts", ArrayType(LongType())))
def stem_counts(words: pa.Array) -> pa.Array:
    """The distinct stems of each list of words and how often each occurs; a missing list has none."""
    coded = words.flatten().dictionary_encode()
    terms = pa.array([stem(w) for w in coded.dictionary.to_pylist()], pa.string()).dictionary_encode()
    wide = max(len(terms.dictionary), 1)
    row = np.repeat(np.arange(len(words)), pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))
    own = row * wide + terms.indices.to_numpy()[coded.indices.to_numpy()]
    found, counts = np.unique(own, return_counts=True)
    ends = pa.array(np.searchsorted(found // wide, np.arange(len(words) + 1)), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, x) for x in (terms.dictionary.take(pa.array(found % wide)), pa.array(counts, pa.int64()))]
    return pa.StructArray.from_arrays(lists, ["terms", "counts"])
