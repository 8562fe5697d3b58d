"""The stemmer of ``revsift.functions.stem`` word by word in plain Python, as a
brute-force version for the tests."""

import re

from revsift.functions.stem import STEP2, STEP3, STEP4

_WORD = re.compile(r"^[a-z]+$")


def _cons_flags(w: str) -> list:
    """Whether each letter is a consonant; a y is one at the start or after a
    vowel. One forward pass, so runs of any length are fine."""
    flags = []
    for c in w:
        flags.append((not flags or not flags[-1]) if c == "y" else c not in "aeiou")
    return flags


def _measure(stem: str) -> int:
    """m in [C](VC)^m[V]."""
    m, prev_vowel = 0, False
    for cons in _cons_flags(stem):
        if cons and prev_vowel:
            m += 1
        prev_vowel = not cons
    return m


def _has_vowel(stem: str) -> bool:
    return not all(_cons_flags(stem))


def _double_cons(w: str) -> bool:
    return len(w) >= 2 and w[-1] == w[-2] and _cons_flags(w)[-1]


def _cvc(w: str) -> bool:
    return len(w) >= 3 and _cons_flags(w)[-3:] == [True, False, True] and w[-1] not in "wxy"


def _replace(w: str, rules, min_m: int) -> str:
    for suf, rep in rules:
        if w.endswith(suf):
            stem = w[: len(w) - len(suf)]
            return stem + rep if _measure(stem) > min_m else w
    return w


def porter(word: str) -> str:
    if word is None or len(word) <= 2 or not _WORD.match(word):
        return word
    w = word
    # step 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("ss"):
        pass
    elif w.endswith("s"):
        w = w[:-1]
    # step 1b
    extra = False
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and _has_vowel(w[:-2]):
        w, extra = w[:-2], True
    elif w.endswith("ing") and _has_vowel(w[:-3]):
        w, extra = w[:-3], True
    if extra:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double_cons(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"
    # step 1c
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    # steps 2 and 3
    w = _replace(w, STEP2, 0)
    w = _replace(w, STEP3, 0)
    # step 4
    for suf in sorted(STEP4, key=len, reverse=True):
        if w.endswith(suf):
            stem = w[: len(w) - len(suf)]
            if _measure(stem) > 1 and (suf != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    # step 5a
    if w.endswith("e"):
        stem = w[:-1]
        m = _measure(stem)
        if m > 1 or (m == 1 and not _cvc(stem)):
            w = stem
    # step 5b
    if _measure(w) > 1 and _double_cons(w) and w.endswith("l"):
        w = w[:-1]
    return w
