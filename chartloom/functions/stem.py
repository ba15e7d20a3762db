"""Porter stemming (M. F. Porter, 1980, with the usual small extensions) as an Arrow function.

The only Python in the text path. Stems are cached per task, so the work per token is one
dictionary look-up and a note never leaves its partition.
"""

import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: words the suffix rules would spoil -----------------------------------------
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "news": "news", "innings": "inning", "inning": "inning", "outings": "outing",
    "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe",
    "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}

# --- fixed values: suffix tables of steps 2 to 4 ----------------------------------------------
STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
         ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
         ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
         ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"),
         ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"), ("logi", "log")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
         ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
         "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

_RUNS = re.compile(r"v+c+")


def _shape(word: str) -> str:
    """The word as v/c letters; y is a vowel after a consonant."""
    shape = ""
    for letter in word:
        vowel = letter in "aeiou" or (letter == "y" and shape[-1:] == "c")
        shape += "v" if vowel else "c"
    return shape


def _measure(stem: str) -> int:
    return len(_RUNS.findall(_shape(stem)))


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _short_end(word: str) -> bool:
    """consonant-vowel-consonant at the end, or a two-letter vowel-consonant word."""
    shape = _shape(word)
    return shape == "vc" or (shape[-3:] == "cvc" and word[-1] not in "wxy")


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _longest(word: str, suffixes) -> str | None:
    hits = [s for s in suffixes if word.endswith(s)]
    return max(hits, key=len) if hits else None


def _plural(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith("ies"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("s") and not word.endswith("ss"):
        return word[:-1]
    return word


def _past(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        stem = word[: -len(suffix)]
        if word.endswith(suffix) and _has_vowel(stem):
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if _doubled(stem):
                return stem if stem[-1] in "lsz" else stem[:-1]
            if _measure(stem) == 1 and _short_end(stem):
                return stem + "e"
            return stem
    return word


def _final_y(word: str) -> str:
    if word.endswith("y") and len(word) > 2 and _shape(word[:-1])[-1] == "c":
        return word[:-1] + "i"
    return word


def _double_suffix(word: str) -> str:
    suffix = _longest(word, [s for s, _ in STEP2])
    if suffix is None:
        return word
    stem = word[: -len(suffix)]
    # `logi` counts its own l; a word cut from `alli` to `al` is looked at again
    if _measure(stem + "l" if suffix == "logi" else stem) == 0:
        return word
    shorter = stem + dict(STEP2)[suffix]
    return _double_suffix(shorter) if suffix == "alli" else shorter


def _inner_suffix(word: str) -> str:
    suffix = _longest(word, [s for s, _ in STEP3])
    if suffix is None or _measure(word[: -len(suffix)]) == 0:
        return word
    return word[: -len(suffix)] + dict(STEP3)[suffix]


def _bare_suffix(word: str) -> str:
    suffix = _longest(word, STEP4)
    if suffix is None:
        return word
    stem = word[: -len(suffix)]
    if _measure(stem) <= 1 or (suffix == "ion" and stem[-1:] not in ("s", "t")):
        return word
    return stem


def _tidy(word: str) -> str:
    if word.endswith("e"):
        stem = word[:-1]
        m = _measure(stem)
        if m > 1 or (m == 1 and not _short_end(stem)):
            word = stem
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def stem_word(word: str) -> str:
    word = word.lower()
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    for step in (_plural, _past, _final_y, _double_suffix, _inner_suffix, _bare_suffix, _tidy):
        word = step(word)
    return word


class _Stems(dict):
    """Word to stem, filled on first sight; starts over when it grows past its limit."""

    limit = 1 << 18

    def __missing__(self, word: str) -> str:
        if len(self) >= self.limit:
            self.clear()
        self[word] = stem_word(word)
        return self[word]


# executors need no installed copy of this module: the function travels with the plan
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@F.pandas_udf(T.StringType())
def stem_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Stem every blank-separated word of each text."""
    stems = _Stems()
    for texts in batches:
        yield texts.map(lambda text: None if text is None else
                        " ".join([stems[w] for w in text.split(" ")]).strip())
