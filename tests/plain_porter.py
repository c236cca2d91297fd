"""Porter stemmer (M. F. Porter, "An algorithm for suffix stripping", Program 14(3), 1980).

A plain version for tests of ``mailsignal.functions.stemming``.
"""

from __future__ import annotations

from functools import lru_cache

from mailsignal import lexicon as L

_VOWELS = set("aeiou")


def _is_cons(w: str, i: int) -> bool:
    c = w[i]
    if c in _VOWELS:
        return False
    if c == "y":
        return i == 0 or not _is_cons(w, i - 1)
    return True


def _m(stem: str) -> int:
    seq = []
    for i in range(len(stem)):
        k = "c" if _is_cons(stem, i) else "v"
        if not seq or seq[-1] != k:
            seq.append(k)
    return "".join(seq).count("vc")


def _has_vowel(stem: str) -> bool:
    return any(not _is_cons(stem, i) for i in range(len(stem)))


def _double_cons(w: str) -> bool:
    return len(w) >= 2 and w[-1] == w[-2] and _is_cons(w, len(w) - 1)


def _cvc(w: str) -> bool:
    """*o: ends consonant-vowel-consonant, the last not w, x or y."""
    if len(w) < 3:
        return False
    return (_is_cons(w, len(w) - 3) and not _is_cons(w, len(w) - 2) and _is_cons(w, len(w) - 1)
            and w[-1] not in "wxy")


def _replace(w: str, rules, cond) -> str:
    for suf, rep in rules:
        if w.endswith(suf):
            stem = w[: len(w) - len(suf)]
            return stem + rep if cond(stem) else w
    return w


_STEP2, _STEP3, _STEP4 = L.PORTER_STEP2, L.PORTER_STEP3, L.PORTER_STEP4


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    w = word
    if len(w) <= 2:
        return w
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
        if _m(w[:-3]) > 0:
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
        elif _m(w) == 1 and _cvc(w):
            w += "e"
    # step 1c
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    # steps 2 and 3
    w = _replace(w, _STEP2, lambda s: _m(s) > 0)
    w = _replace(w, _STEP3, lambda s: _m(s) > 0)
    # step 4
    for suf in _STEP4:
        if w.endswith(suf):
            s = w[: len(w) - len(suf)]
            if suf == "ion":
                if _m(s) > 1 and s and s[-1] in "st":
                    w = s
            elif _m(s) > 1:
                w = s
            break
    # step 5a
    if w.endswith("e"):
        s = w[:-1]
        if _m(s) > 1 or (_m(s) == 1 and not _cvc(s)):
            w = s
    # step 5b
    if _m(w) > 1 and _double_cons(w) and w.endswith("l"):
        w = w[:-1]
    return w
