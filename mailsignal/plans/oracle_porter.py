"""Porter's algorithm as DuckDB SQL, one CTE a step over distinct words (independently of the Column expressions)."""

from __future__ import annotations

from mailsignal import lexicon as L

_SHAPE = ("list_reduce(list_prepend('', string_split(w, '')), lambda a, c: a || CASE WHEN c IN ('a', 'e', 'i', 'o', 'u') THEN 'V' "
          "WHEN c = 'y' AND right(a, 1) = 'C' THEN 'V' ELSE 'C' END)")


def _less(x: str, n: int) -> str:
    return f"substr({x}, 1, length({x}) - {n})"


def _m(x: str, over: int) -> str:
    return f"(length({x}) - length(replace({x}, 'VC', ''))) / 2 > {over}"


def _suffixes(rules, result) -> str:
    return "CASE " + " ".join(f"WHEN suffix(w, '{a}') THEN {result(a, b)}" for a, b in rules) + " ELSE w END"


_STAR_O = "suffix({s}, 'CVC') AND right({w}, 1) NOT IN ('w', 'x', 'y')"
_DOUBLE = "suffix(s, 'C') AND length(w) > 1 AND right(w, 1) = substr(w, -2, 1)"


def _swap(rules) -> str:
    return _suffixes(rules, lambda a, b: f"CASE WHEN {_m(_less('s', len(a)), 0)} THEN {_less('w', len(a))} || '{b}' ELSE w END")


def _drop(a: str, _) -> str:
    more = " AND substr(w, -4, 1) IN ('s', 't') AND length(w) > 3" if a == "ion" else ""
    return f"CASE WHEN {_m(_less('s', len(a)), 1)}{more} THEN {_less('w', len(a))} ELSE w END"


def porter_ctes(words: str, name: str = "porter") -> str:
    """CTEs that end in ``name`` (t, stem) for the words of the table ``words`` (t)."""
    steps = [
        f"""CASE WHEN suffix(w, 'eed') THEN CASE WHEN {_m(_less('s', 3), 0)} THEN {_less('w', 1)} ELSE w END
             WHEN suffix(w, 'ed') AND contains({_less('s', 2)}, 'V') THEN {_less('w', 2)} WHEN suffix(w, 'ing') AND contains({_less('s', 3)}, 'V') THEN {_less('w', 3)} ELSE w END""",
        f"""CASE WHEN NOT extra THEN w WHEN right(w, 2) IN ('at', 'bl', 'iz') THEN w || 'e' WHEN {_DOUBLE} AND right(w, 1) NOT IN ('l', 's', 'z') THEN {_less('w', 1)}
             WHEN {_m('s', 0)} AND NOT {_m('s', 1)} AND {_STAR_O.format(s='s', w='w')} THEN w || 'e' ELSE w END""",
        f"CASE WHEN suffix(w, 'y') AND contains({_less('s', 1)}, 'V') THEN {_less('w', 1)} || 'i' ELSE w END",
        _swap(L.PORTER_STEP2), _swap(L.PORTER_STEP3), _suffixes([(a, "") for a in L.PORTER_STEP4], _drop),
        f"""CASE WHEN suffix(w, 'e') AND ({_m(_less('s', 1), 1)} OR ({_m(_less('s', 1), 0)} AND NOT ({_STAR_O.format(s=_less('s', 1), w=_less('w', 1))}))) THEN {_less('w', 1)} ELSE w END""",
        f"CASE WHEN {_m('s', 1)} AND {_DOUBLE} AND suffix(w, 'l') THEN {_less('w', 1)} ELSE w END",
    ]
    out = [f"""{name}0 AS (SELECT t, CASE WHEN suffix(t, 'sses') OR suffix(t, 'ies') THEN {_less('t', 2)} WHEN suffix(t, 'ss') THEN t WHEN suffix(t, 's') THEN {_less('t', 1)} ELSE t END AS w,
  FALSE AS extra FROM {words} WHERE length(t) > 2)"""]
    for i, step in enumerate(steps):
        extra = "NOT suffix(w, 'eed') AND (suffix(w, 'ed') OR suffix(w, 'ing')) AND new <> w" if i == 0 else "FALSE"
        out.append(f"{name}{i + 1} AS (SELECT t, new AS w, {extra} AS extra FROM (SELECT *, {step} AS new FROM (SELECT *, {_SHAPE} AS s FROM {name}{i})))")
    out.append(f"{name} AS (SELECT t, w AS stem FROM {name}{len(steps)} UNION ALL SELECT t, t FROM {words} WHERE length(t) <= 2)")
    return ",\n".join(out)
