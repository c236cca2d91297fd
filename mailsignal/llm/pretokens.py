"""Words of byte-level BPE, cut by a finite-state transducer whose chunk maps compose by prefix scan.

The words are those of the pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?[^ white L N]+|white+(?!not white)|white+``
(L letters, N numbers). A text becomes symbols: the class of each character and what the pattern looks
ahead for. The transducer reads symbols and marks where words begin. Where a chunk of
symbols starts in the middle of a word its start state is unknown, so each chunk is first run from
every state at once, which gives a map from start to end states; a parallel prefix scan composes the
maps, and a second run from the now known states emits the marks. All chunks run side by side.

Character classes are asked of the tokenizers library once per character met, so that both agree on
every Unicode version.
"""

from __future__ import annotations

import numpy as np

from mailsignal.llm.textscan import span_hashes

CHUNK = 64
_L, _N, _O, _Q2, _Q3, _SP, _SP_LAST, _WS, _WS_LAST = range(9)  # Q: apostrophe of a 2 or 3 letter suffix; LAST: before a word
_START, _IN_L, _IN_N, _IN_O, _JOIN, _GAP, _ONE, _TWO, _DONE = range(9)  # JOIN: a space that the next word takes along
_ASCII_WHITE = (9, 10, 11, 12, 13, 32)


def _compile() -> tuple[np.ndarray, np.ndarray]:
    """next[state, symbol] and begins[state, symbol]; symbol + 9 is the same at the start of a text."""
    run_of = {_L: _IN_L, _N: _IN_N, _O: _IN_O}
    nxt, begins = np.zeros((9, 18), np.uint8), np.zeros((9, 18), bool)
    for state in range(9):
        for symbol in range(9):
            if state in (_ONE, _TWO):  # inside a suffix, whatever comes
                to, new = (_DONE if state == _ONE else _ONE), False
            elif symbol in (_Q2, _Q3) and state not in (_IN_O, _JOIN):
                to, new = (_ONE if symbol == _Q2 else _TWO), True
            elif symbol <= _Q3:
                to = run_of[_O if symbol in (_Q2, _Q3) else symbol]
                new = state not in (to, _JOIN)
            else:  # white space: one word up to the character before the last
                to = _JOIN if symbol == _SP_LAST else _GAP if symbol in (_SP, _WS) else _START
                new = state != _GAP or symbol in (_SP_LAST, _WS_LAST)
            nxt[state, symbol], begins[state, symbol] = to, new
    nxt[:, 9:], begins[:, 9:] = nxt[_START, :9], True
    return nxt, begins


NEXT, BEGINS = _compile()


class Scanner:
    """Holds the character classes met so far."""

    def __init__(self):
        from tokenizers import pre_tokenizers

        self._ask = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self._class = np.full(0x110000, 255, np.uint8)  # _L, _N, _O, _WS
        for c in range(128):
            s = chr(c)
            self._class[c] = _L if s.isalpha() else _N if s.isdigit() else _WS if c in _ASCII_WHITE else _O

    def _classes(self, points: np.ndarray) -> np.ndarray:
        out = self._class[points]
        if (out == 255).any():
            for c in np.unique(points[out == 255]).tolist():
                alone = lambda head, c=c: len(self._ask.pre_tokenize_str(head + chr(c))) == 1
                self._class[c] = _L if alone("a") else _N if alone("1") else _O if alone("!") else _WS
            out = self._class[points]
        return out

    def _symbols(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        n = len(points)
        symbol = self._classes(points)
        white = symbol == _WS
        ahead = np.ones(n, bool)  # the next character is white, or the text ends
        ahead[:-1] = white[1:] | first[1:]
        symbol = np.where(white, np.where(points == 32, _SP, _WS) + ~ahead, symbol).astype(np.uint8)
        at = np.flatnonzero(points == 39)
        if len(at):
            text_end = np.append(np.flatnonzero(first), n)
            room = text_end[np.searchsorted(text_end, at, side="right")] - at
            padded = np.append(points, [0, 0])
            one, two = padded[at + 1], padded[at + 2]
            pair = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
            symbol[at[(room > 2) & pair]] = _Q3
            symbol[at[(room > 1) & np.isin(one, [ord(c) for c in "stmd"])]] = _Q2
        symbol[first] += 9
        return symbol

    def starts(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Byte positions at which a word begins; ``offs`` bounds the texts."""
        lead = np.flatnonzero((buf & 0xC0) != 0x80)
        n = len(lead)
        if not n:
            return lead
        b = np.append(buf, np.zeros(3, np.uint8))
        points = b[lead].astype(np.int32)
        for low, high, size in ((0xC0, 0xE0, 2), (0xE0, 0xF0, 3), (0xF0, 0x100, 4)):
            at = np.flatnonzero((points >= low) & (points < high))
            if len(at):
                value = points[at] & (0xFF >> (size + 1))
                for j in range(1, size):
                    value = (value << 6) | (b[lead[at] + j] & 0x3F)
                points[at] = np.minimum(value, 0x10FFFF) + (1 << 24)  # kept apart until all sizes are read
        points &= (1 << 24) - 1
        mark = np.zeros(len(buf) + 1, bool)
        mark[offs] = True
        symbol = self._symbols(points, mark[lead])
        return lead[run(symbol)]


def run(symbol: np.ndarray) -> np.ndarray:
    """True where a word begins."""
    n, states = len(symbol), len(NEXT)
    lanes = -(-n // CHUNK)
    grid = np.full(lanes * CHUNK, 9, np.int64)
    grid[:n] = symbol
    grid = np.ascontiguousarray(grid.reshape(lanes, CHUNK).T)
    table, marks = NEXT.reshape(-1).astype(np.int64) * 18, BEGINS.reshape(-1)  # states are held as row offsets
    maps = np.repeat(np.arange(states, dtype=np.int64)[:, None] * 18, lanes, axis=1)
    for j in range(CHUNK):
        maps = table[maps + grid[j]]
    maps = np.ascontiguousarray(maps.T) // 18  # [lane, start state] -> end state
    step = 1
    while step < lanes:  # maps[i] becomes the map of chunks 0 to i
        later = maps[step:]
        maps[step:] = np.take_along_axis(later, maps[:-step].copy(), axis=1)
        step *= 2
    state = np.zeros(lanes, np.int64)
    state[1:] = maps[:-1, _START] * 18
    out = np.empty((CHUNK, lanes), bool)
    for j in range(CHUNK):
        at = state + grid[j]
        out[j] = marks[at]
        state = table[at]
    return out.T.reshape(-1)[:n]


def words(scanner: Scanner, buf: np.ndarray, offs: np.ndarray, special: list[bytes]):
    """(starts, ends, index of the first equal word per distinct word, distinct number of each word, word
    offsets of the texts). Occurrences of ``special`` strings are words of their own and end the text around them."""
    bounds, inner = offs, []
    data = buf.tobytes()
    for s in special:
        at = data.find(s)
        while at >= 0:
            if np.searchsorted(offs, at, side="right") == np.searchsorted(offs, at + len(s) - 1, side="right"):
                inner.append((at, at + len(s)))
                at = data.find(s, at + len(s))
            else:
                at = data.find(s, at + 1)
    if inner:
        bounds = np.unique(np.concatenate([offs, np.array(inner).reshape(-1)]))
    starts = scanner.starts(buf, bounds)
    if inner:
        edge = np.zeros(len(buf) + 1, np.int64)
        for a, e in inner:
            edge[a + 1] += 1
            edge[e] -= 1
        starts = starts[np.cumsum(edge)[starts] == 0]
    ends = np.append(starts[1:], len(buf))[:len(starts)]
    _, first, inverse = np.unique(span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
    return starts, ends, first, inverse, np.searchsorted(starts, offs)
