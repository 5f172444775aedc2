"""Porter's suffix stripping (1980), for scores that compare stems."""

from __future__ import annotations

import re
from functools import lru_cache

# Suffixes and what stands for them, by step; the longest that fits is tried alone.
_STEP2 = dict(ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", abli="able", alli="al", entli="ent", eli="e", ousli="ous", ization="ize", ation="ate", ator="ate", alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble")
_STEP3 = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
_STEP4 = dict.fromkeys("al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split(), "")


def _shape(word: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = ""
    for x in word:
        out += "v" if x in "aeiou" or (x == "y" and out.endswith("c")) else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short_end(stem: str) -> bool:
    """consonant, vowel, consonant other than w, x, y at the end."""
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _replaced(word: str, rules: dict[str, str], least: int) -> str:
    for n in range(min(7, len(word)), 1, -1):
        if word[-n:] in rules:
            stem = word[:-n]
            fits = _measure(stem) >= least and (word[-n:] != "ion" or stem.endswith(("s", "t")))
            return stem + rules[word[-n:]] if fits else word
    return word


@lru_cache(200_000)
def porter(word: str) -> str:
    """The stem of a lower-cased word; words of one or two letters and words with other signs stay."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    cut = re.fullmatch("(.*)(eed|ed|ing)", word)
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    elif cut and "v" in _shape(cut[1]):
        word = cut[1]
        if word.endswith(("at", "bl", "iz")) or (_measure(word) == 1 and _short_end(word)):
            word += "e"
        elif len(word) > 1 and word[-1] == word[-2] and _shape(word).endswith("c") and word[-1] not in "lsz":
            word = word[:-1]
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(_replaced(word, _STEP2, 1), _STEP3, 1), _STEP4, 2)
    if word.endswith("e"):
        m = _measure(word[:-1])
        word = word[:-1] if m > 1 or (m == 1 and not _short_end(word[:-1])) else word
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word
