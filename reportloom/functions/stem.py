"""The Porter (1980) stemmer as a table of rules."""

from __future__ import annotations

import re
from functools import cache

#: Suffix and replacement of each step of the published algorithm.
STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize"


def _form(stem: str) -> str:
    """One letter v or c for each letter."""
    out = ""
    for i, ch in enumerate(stem):
        out += "v" if ch in "aeiou" or ch == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _form(stem)))


def _cvc(stem: str) -> bool:
    return _form(stem).endswith("cvc") and stem[-1] not in "wxy"


def _longest(word: str, pairs: list[tuple[str, str]], least: int) -> str:
    """The longest suffix that fits decides; it is replaced if the rest has more than ``least`` measures."""
    for suffix, by in sorted(pairs, key=lambda p: -len(p[0])):
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            return stem + by if _measure(stem) > least else word
    return word


@cache
def _pairs(rules: str) -> list[tuple[str, str]]:
    return [tuple(r.split(":")) for r in rules.split()]


def porter(word: str) -> str:
    """The stem of a lower-case word; words of up to two letters stay."""
    if len(word) < 3:
        return word
    for suffix, by in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            word = word[: len(word) - len(suffix)] + by
            break
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for suffix in ("ed", "ing"):
            stem = word[: len(word) - len(suffix)]
            if word.endswith(suffix) and "v" in _form(stem):
                word = stem
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif len(word) > 1 and word[-1] == word[-2] and _form(word)[-1] == "c" and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _cvc(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in _form(word[:-1]):
        word = word[:-1] + "i"
    word = _longest(word, _pairs(STEP2), 0)
    word = _longest(word, _pairs(STEP3), 0)
    if word.endswith(("sion", "tion")):
        word = word[:-3] if _measure(word[:-3]) > 1 else word
    else:
        word = _longest(word, [(s, "") for s in STEP4.split()], 1)
    if word.endswith("e") and (_measure(word[:-1]) > 1 or _measure(word[:-1]) == 1 and not _cvc(word[:-1])):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word
