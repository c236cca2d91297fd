"""Porter stemming as Column expressions and of one word in Python (M. F. Porter, "An algorithm for suffix stripping", Program 14(3), 1980).

A word's *shape* says for each letter whether it is a consonant (C) or a vowel (V): a, e, i, o, u are vowels, and so is a y behind a
consonant. A prefix of the word has the prefix of the shape, so every condition of the algorithm is a test of a piece of text: a measure
above 0 is a ``VC`` in it, above 1 two of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailsignal import lexicon as L


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), use)[0]


_LETTERS = "abcdefghijklmnopqrstuvwxz"
_KINDS = "".join("V" if c in "aeiou" else "C" for c in _LETTERS)


def shape(word: Column) -> Column:
    def settled(s: Column) -> Column:
        s = F.when(s.rlike("[^CVy]"), F.regexp_replace(s, "[^CVy]", "C")).otherwise(s)
        # a run of y alternates: pairs first, each behind a letter of the kind or behind the pair before, then the odd one
        y = F.regexp_replace(s, "^y", "C")
        y = F.regexp_replace(y, r"(?:(?<=C)|\G(?<!^))yy", "VC")
        y = F.replace(y, F.lit("Cy"), F.lit("CV"))
        y = F.regexp_replace(y, r"(?:(?<=V)|\G(?<!^))yy", "CV")
        y = F.replace(y, F.lit("Vy"), F.lit("VC"))
        return F.when(F.contains(s, F.lit("y")), y).otherwise(s)
    # capitals of the word must not pass for kinds
    return _let(F.translate(word, _LETTERS + "CV", _KINDS + "--"), settled)


class _Word:
    """A word and its shape, as the struct that passes from step to step."""

    def __init__(self, both: Column):
        self.both, self.w, self.s = both, both["w"], both["s"]

    def ends(self, suffix: str) -> Column:
        return self.w.endswith(suffix)

    def last(self, *letters: str) -> Column:
        return F.right(self.w, F.lit(1)).isin(*letters)

    def cut(self, n: int, add: str = "") -> Column:
        """Without its last n letters, with others instead. None of these is a y, so their kinds stand alone."""
        left = [F.left(x, F.length(x) - n) if n else x for x in (self.w, self.s)]
        kinds = add.translate(str.maketrans(_LETTERS, _KINDS))
        return F.struct((F.concat(left[0], F.lit(add)) if add else left[0]).alias("w"), (F.concat(left[1], F.lit(kinds)) if add else left[1]).alias("s"), self.both["short"].alias("short"))

    def part(self, n: int) -> Column:
        """Shape of the word without its last n letters."""
        return F.left(self.s, F.length(self.s) - n)

    def first(self, cases: list[tuple[str, Column]]) -> Column:
        """The result of the first suffix that fits; the word where none does. Tried by last letter, then in order."""
        groups: dict[str, list] = {}
        for suffix, result in cases:
            groups.setdefault(suffix[-1], []).append((suffix, result))
        out = F
        for letter, some in groups.items():
            inner = F
            for suffix, result in some:
                inner = inner.when(self.ends(suffix), result)
            out = out.when(self.ends(letter), inner.otherwise(self.both))
        return out.otherwise(self.both)


def _measure_over(part: Column, n: int) -> Column:
    return F.contains(part, F.lit("VC")) if n == 0 else part.like("%VC%VC%")


def _has_vowel(part: Column) -> Column:
    return F.contains(part, F.lit("V"))


def _plural(x: _Word) -> Column:
    return F.when(x.ends("s"), x.first([("sses", x.cut(2)), ("ies", x.cut(2)), ("ss", x.both), ("s", x.cut(1))])).otherwise(x.both)


def _tidy(x: _Word) -> Column:
    """What follows a removed -ed or -ing."""
    doubled = x.s.endswith("C") & (F.length(x.w) >= 2) & (F.right(x.w, F.lit(1)) == F.substring(x.w, -2, 1))
    short = x.s.endswith("CVC") & ~x.last("w", "x", "y")
    return (F.when(x.ends("at") | x.ends("bl") | x.ends("iz"), x.cut(0, "e")).when(doubled & ~x.last("l", "s", "z"), x.cut(1))
            .when(_measure_over(x.s, 0) & ~_measure_over(x.s, 1) & short, x.cut(0, "e")).otherwise(x.both))


def _past(x: _Word) -> Column:
    def stripped(n: int) -> Column:
        return _let(x.cut(n), lambda y: _tidy(_Word(y)))
    eed = F.when(_measure_over(x.part(3), 0), x.cut(1)).otherwise(x.both)
    return F.when(x.ends("eed"), eed).when(x.ends("ed") & _has_vowel(x.part(2)), stripped(2)).when(x.ends("ing") & _has_vowel(x.part(3)), stripped(3)).otherwise(x.both)


def _final_y(x: _Word) -> Column:
    return F.when(x.ends("y") & _has_vowel(x.part(1)), x.cut(1, "i")).otherwise(x.both)


def _exchange(rules: list[tuple[str, str]]):
    def step(x: _Word) -> Column:
        return x.first([(a, F.when(_measure_over(x.part(len(a)), 0), x.cut(len(a), b)).otherwise(x.both)) for a, b in rules])
    return step


def _drop(x: _Word) -> Column:
    def case(a: str) -> Column:
        fine = _measure_over(x.part(len(a)), 1)
        if a == "ion":
            fine = fine & F.substring(x.w, -4, 1).isin("s", "t")
        return F.when(fine, x.cut(len(a))).otherwise(x.both)
    return x.first([(a, case(a)) for a in L.PORTER_STEP4])


def _final_e(x: _Word) -> Column:
    part = x.part(1)
    short = part.endswith("CVC") & ~F.substring(x.w, -2, 1).isin("w", "x", "y")
    return F.when(x.ends("e") & (_measure_over(part, 1) | (_measure_over(part, 0) & ~short)), x.cut(1)).otherwise(x.both)


def _final_l(x: _Word) -> Column:
    return F.when(x.ends("ll") & _measure_over(x.s, 1), x.cut(1)).otherwise(x.both)


STEPS = (_plural, _past, _final_y, _exchange(L.PORTER_STEP2), _exchange(L.PORTER_STEP3), _drop, _final_e, _final_l)


def _start(word: Column) -> Column:
    """Words of one or two letters stay: they wait in ``short`` while nothing happens to an empty word."""
    long = F.length(word) > 2
    none = F.lit("")
    return F.struct(F.when(long, word).otherwise(none).alias("w"), F.when(long, shape(word)).otherwise(none).alias("s"), F.when(long, F.lit(None)).otherwise(word).alias("short"))


def _on_structs(step) -> Callable[[Column], Column]:
    return lambda both: step(_Word(both))


def stems(tokens) -> Column:
    """Array of lower-case words -> array of their Porter stems, order kept. One pass over the array a step, so that no
    lambda is nested in another."""
    x = F.transform(F.col(tokens) if isinstance(tokens, str) else tokens, _start)
    for step in STEPS:
        x = F.transform(x, _on_structs(step))
    return F.transform(x, lambda both: F.coalesce(both["short"], both["w"]))


# -- one word in Python: the same steps on the word and its shape, for tasks that stem each distinct word once ---------------------

def _kinds_of(word: str) -> str:
    out, before = [], ""
    for c in word:
        before = "V" if c in "aeiou" or (c == "y" and before == "C") else "C"
        out.append(before)
    return "".join(out)


def _changed(w: str, s: str, n: int, add: str = "") -> tuple[str, str]:
    """Without the last n letters, with others (none a y) instead."""
    end = len(w) - n
    return w[:end] + add, s[:end] + add.translate(_KIND_OF)


_KIND_OF = str.maketrans(_LETTERS, _KINDS)


def _over(part: str, n: int) -> bool:
    return part.count("VC") > n


def _word_exchange(w: str, s: str, rules: list[tuple[str, str]]) -> tuple[str, str]:
    for a, b in rules:
        if w.endswith(a):
            return _changed(w, s, len(a), b) if _over(s[:len(s) - len(a)], 0) else (w, s)
    return w, s


def word_stem(word: str) -> str:
    """The Porter stem of one lower-case word, as ``stems`` has it."""
    if len(word) <= 2:
        return word
    w, s = word, _kinds_of(word)
    if w.endswith(("sses", "ies")):
        w, s = _changed(w, s, 2)
    elif w.endswith("s") and not w.endswith("ss"):
        w, s = _changed(w, s, 1)
    n = 2 if w.endswith("ed") else 3 if w.endswith("ing") else 0
    if w.endswith("eed"):
        w, s = _changed(w, s, 1) if _over(s[:-3], 0) else (w, s)
    elif n and "V" in s[:-n]:
        w, s = _changed(w, s, n)
        if w.endswith(("at", "bl", "iz")):
            w, s = _changed(w, s, 0, "e")
        elif s.endswith("C") and len(w) >= 2 and w[-1] == w[-2] and w[-1] not in "lsz":
            w, s = _changed(w, s, 1)
        elif s.count("VC") == 1 and s.endswith("CVC") and w[-1] not in "wxy":
            w, s = _changed(w, s, 0, "e")
    if w.endswith("y") and "V" in s[:-1]:
        w, s = _changed(w, s, 1, "i")
    w, s = _word_exchange(w, s, L.PORTER_STEP2)
    w, s = _word_exchange(w, s, L.PORTER_STEP3)
    for a in L.PORTER_STEP4:
        if w.endswith(a):
            if _over(s[:len(s) - len(a)], 1) and (a != "ion" or w[-4:-3] in ("s", "t")):
                w, s = _changed(w, s, len(a))
            break
    if w.endswith("e"):
        part = s[:-1]
        short = part.endswith("CVC") and w[-2:-1] not in ("w", "x", "y")
        if _over(part, 1) or (_over(part, 0) and not short):
            w, s = _changed(w, s, 1)
    if w.endswith("ll") and _over(s, 1):
        w, s = _changed(w, s, 1)
    return w
