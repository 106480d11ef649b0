"""Pre-token boundaries of many texts at once, without a regular expression.

The rule is the public one of byte-level BPE vocabularies:
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.

Every byte of the UTF-8 texts, laid end to end, gets a class (looking one character ahead where
the rule does). A class stands for a transition function of a small automaton. Functions form a
finite set closed under composition, so the automaton's state before every byte comes from an
associative scan over function numbers with one composition table; state and class together say
whether a pre-token begins there. The first byte of a text has a constant function, which is how
texts laid end to end don't influence each other.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

CONT, LETTER, NUMBER, OTHER, SPACE_IN, SPACE_LAST, WHITE_IN, WHITE_LAST, APOS_1, APOS_2 = range(10)
_CLASSES = 10
START, IN_L, IN_N, IN_O, AFTER_SPACE, IN_WHITE, AFTER_WHITE, C_1, C_2, C_2B = range(10)
_STATES = 10

#: The characters that the rule reads as white space.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _step(state: int, cls: int) -> tuple[int, bool]:
    """The next state, and whether a pre-token begins at this character."""
    if cls == CONT:
        return state, False
    if cls == LETTER:
        if state in (C_1, C_2, C_2B):  # the letters of a contraction; START follows its last
            return {C_1: START, C_2: C_2B, C_2B: START}[state], False
        return IN_L, state not in (IN_L, AFTER_SPACE)
    if cls == NUMBER:
        return IN_N, state not in (IN_N, AFTER_SPACE)
    if cls in (APOS_1, APOS_2) and state not in (IN_O, AFTER_SPACE):
        return (C_1 if cls == APOS_1 else C_2), True
    if cls in (OTHER, APOS_1, APOS_2):
        return IN_O, state not in (IN_O, AFTER_SPACE)
    if cls in (SPACE_IN, WHITE_IN):
        return IN_WHITE, state != IN_WHITE
    return (AFTER_SPACE if cls == SPACE_LAST else AFTER_WHITE), True


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Function number by class (those of first bytes behind), compositions, state from START, begins, how many."""
    kinds = [tuple(_step(q, c)[0] for q in range(_STATES)) for c in range(_CLASSES)]
    kinds += [(_step(START, c)[0],) * _STATES for c in range(_CLASSES)]
    known = {f: i for i, f in enumerate(dict.fromkeys(kinds))}
    todo = list(known)
    while todo:
        f = todo.pop()
        for g in list(known):
            for h in (tuple(g[q] for q in f), tuple(f[q] for q in g)):
                if h not in known:
                    known[h] = len(known)
                    todo.append(h)
    all_f = list(known)
    n = len(all_f)
    after = np.empty((n, n), np.uint16)  # [later, earlier]
    for i, later in enumerate(all_f):
        for j, earlier in enumerate(all_f):
            after[i, j] = known[tuple(later[q] for q in earlier)]
    begins = np.array([[_step(q, c)[1] for c in range(_CLASSES)] for q in range(_STATES)]).ravel()
    return np.array([known[f] for f in kinds], np.uint16), after.ravel(), np.array([f[START] for f in all_f], np.uint8), begins, n


def _scan(f: np.ndarray, after: np.ndarray, n: int) -> np.ndarray:
    """Composition of every prefix: pairs are composed, scanned, and filled in between. 2 compositions a byte."""
    if len(f) < 2:
        return f
    odd = len(f) & 1
    pairs = after.take(f[1::2].astype(np.int32) * n + f[0 : len(f) - odd : 2])
    done = _scan(pairs, after, n)
    out = np.empty_like(f)
    out[0] = f[0]
    out[1::2] = done
    rest = f[2::2]
    out[2::2] = after.take(rest.astype(np.int32) * n + done[: len(rest)])
    return out


@cache
def _ascii() -> np.ndarray:
    t = np.full(256, OTHER, np.uint8)
    for b in range(128):
        c = chr(b)
        t[b] = WHITE_IN if b in WHITE_SPACE else LETTER if c.isalpha() else NUMBER if c.isdigit() else OTHER
    t[32] = SPACE_IN
    t[0x80:0xC0] = CONT
    return t


@cache
def _unicode() -> np.ndarray:
    kind = {"L": LETTER, "N": NUMBER}
    t = np.fromiter((kind.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    t[WHITE_SPACE] = WHITE_IN
    return t


def _is(data: np.ndarray, at: np.ndarray, letters: bytes) -> np.ndarray:
    return np.isin(data[at], np.frombuffer(letters, np.uint8))


def byte_classes(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The class of every byte of texts laid end to end; ``first``: where each (non-empty) text begins."""
    n = len(data)
    cls = _ascii().take(data)
    wide = np.flatnonzero(data >= 0xC0)
    length = None
    if len(wide):
        lead = data[wide].astype(np.uint32)
        length = 2 + (lead >= 0xE0) + (lead >= 0xF0).astype(np.int64)
        at = [data[np.minimum(wide + i, n - 1)].astype(np.uint32) & 0x3F for i in (1, 2, 3)]
        cp = np.where(
            length == 2, (lead & 0x1F) << 6 | at[0],
            np.where(length == 3, (lead & 0x0F) << 12 | at[0] << 6 | at[1], (lead & 7) << 18 | at[0] << 12 | at[1] << 6 | at[2]),
        )
        cls[wide] = _unicode().take(np.minimum(cp, 0x10FFFF))
    ends = np.zeros(n + 1, bool)
    ends[first] = True
    ends[n] = True
    # a white-space character with something else behind it is the last of its run
    white = np.flatnonzero((cls == SPACE_IN) | (cls == WHITE_IN))
    if len(white):
        size = np.ones(len(white), np.int64)
        if length is not None:
            wide_white = cls[wide] == WHITE_IN
            size[np.searchsorted(white, wide[wide_white])] = length[wide_white]
        behind = white + size
        inside = ~ends[np.minimum(behind, n)]
        other = np.ones(len(white), bool)
        nxt = cls[np.minimum(behind, n - 1)]
        other = inside & (nxt != SPACE_IN) & (nxt != WHITE_IN)
        cls[white[other]] += 1
    apos = np.flatnonzero(data == 0x27)
    if len(apos):
        one, two = np.minimum(apos + 1, n - 1), np.minimum(apos + 2, n - 1)
        near = ~ends[apos + 1]
        cls[apos[near & _is(data, one, b"stmd")]] = APOS_1
        far = near & ~ends[np.minimum(apos + 2, n)]
        a, b = data[one], data[two]
        pair = ((a == 0x72) | (a == 0x76)) & (b == 0x65) | (a == 0x6C) & (b == 0x6C)
        cls[apos[far & pair]] = APOS_2
    return cls


def starts(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Offsets at which pre-tokens begin, of texts laid end to end (the next one's begin is each one's end)."""
    if not len(data):
        return np.empty(0, np.int64)
    number, after, state, begins, n = _tables()
    cls = byte_classes(data, first)
    kind = cls.copy()
    kind[first] += _CLASSES
    states = state.take(_scan(number.take(kind), after, n))
    key = np.empty(len(data), np.uint8)
    key[0] = cls[0]
    np.multiply(states[:-1], _CLASSES, out=key[1:])
    key[1:] += cls[1:]
    key[first] = cls[first]  # the state before a text is START, which is 0
    return np.flatnonzero(begins.take(key))
