"""A byte-level BPE vocabulary: its merges, and which token may follow which.

Greedy merging has a local characterisation: a token sequence is the encoding of its bytes exactly if
every token encodes its own bytes and every neighbouring pair encodes the bytes of both. So the encoding of
a prefix ends in the one token t that fits behind the encoding of what precedes t: the last token of
each prefix is a state from which the next can be computed.
"""

from __future__ import annotations

import functools
import json

_NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in spec["added_tokens"])
        if spec["normalizer"] is not None or not plain or model["type"] != "BPE" or model["ignore_merges"]:
            raise ValueError("not a plain byte-level BPE file")
        raw = lambda s: bytes(letters[c] for c in s)
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        names = {t["content"] for t in spec["added_tokens"]}
        self.ids = {raw(s): i for s, i in model["vocab"].items() if s not in names}
        self.bytes = {i: b for b, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        self.longest = max(map(len, self.ids))
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        for r, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            a, b = self.ids[raw(a)], self.ids[raw(b)]
            whole = self.ids[self.bytes[a] + self.bytes[b]]
            if max(self.made.get(a, -1), self.made.get(b, -1)) >= r or whole in self.parts:
                raise ValueError("merges are not in the order of their parts")
            self.rank[a, b], self.parts[whole], self.made[whole] = r, (a, b), r
        self._spines: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self._real: dict[int, bool] = {}
        self._fits: dict[int, bool] = {}

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stand at one edge of ``token`` while it is merged, each with the merge that ends it."""
        found = self._spines.get((token, side))
        if found is None:
            found, end, t = [], _NEVER, token
            while True:
                found.append((t, end))
                if t not in self.parts:
                    break
                end, t = self.made[t], self.parts[t][side]
            self._spines[token, side] = found
        return found

    def fits(self, a: int, b: int, before: int = _NEVER) -> bool:
        """No merge across the border of a and b comes up (with a rank under ``before``) while their own
        merges go on. At equal rank the left one goes first."""
        rank = self.rank
        for x, x_end in self._spine(a, 1):
            for y, y_end in self._spine(b, 0):
                r = rank.get((x, y))
                if r is not None and r < x_end and r <= y_end and r < before:
                    return False
        return True

    def real(self, token: int) -> bool:
        """The token is the encoding of its own bytes."""
        known = self._real.get(token)
        if known is None:
            todo = [token]
            while todo:
                t = todo[-1]
                if t not in self.parts:
                    self._real[t] = True
                else:
                    a, b = self.parts[t]
                    open_ = [p for p in (a, b) if p not in self._real]
                    if open_:
                        todo += open_
                        continue
                    self._real[t] = self._real[a] and self._real[b] and self.fits(a, b, self.made[t])
                todo.pop()
            known = self._real[token]
        return known

    def last(self, word: bytes, end: int, lasts: list[int]) -> int:
        """The last token of the encoding of ``word[:end]``; ``lasts[i]`` is that of ``word[:i]``, i >= 1."""
        ids, known = self.ids, self._fits
        for start in range(max(0, end - self.longest), end):
            t = ids.get(word[start:end])
            if t is None:
                continue
            a = lasts[start] if start else -1
            good = known.get(a << 32 | t)
            if good is None:
                good = self.real(t) and (a < 0 or self.fits(a, t))
                if len(known) > 200_000:
                    known.clear()
                known[a << 32 | t] = good
            if good:
                return t
        raise ValueError("a byte is missing in the vocabulary")


@functools.lru_cache(maxsize=4)
def load(path: str) -> Merges:
    return Merges(path)
