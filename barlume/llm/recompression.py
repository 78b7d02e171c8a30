"""Run-length grammars by recompression, and common extensions read off them."""

from __future__ import annotations

import numpy as np

from barlume.llm import text

BLOCKS, PAIRS = 0, 1


class Level:
    """One round: ``symbols`` before it, and the symbol of the next level that each belongs to."""

    def __init__(self, kind: int, symbols: np.ndarray, starts: np.ndarray):
        self.kind, self.symbols = kind, symbols
        self.first = np.append(starts, len(symbols))  # first symbol of each one of the next level
        self.parent = np.repeat(np.arange(len(starts)), np.diff(self.first))


def _named(key: np.ndarray, merged: np.ndarray, symbols: np.ndarray, count: int) -> tuple[np.ndarray, int]:
    """``symbols`` with new names where ``merged``: equal names for equal keys."""
    distinct, name = np.unique(key[merged], return_inverse=True)
    out = symbols.copy()
    out[merged] = count + name
    return out, count + len(distinct)


def grammar(symbols: np.ndarray, count: int) -> list[Level]:
    """Levels of the grammar of a sequence of numbers below ``count``.

    Rounds alternate.  A block round names every maximal block of one symbol by (symbol, length);
    a pair round halves the symbols by a hash of their names and names every pair of a symbol of
    one half with a following one of the other, the half that goes first being the one with more pairs.
    Names are exact: equal ones stand for equal strings.  What a string is cut into depends, but for its ends,
    on the string alone, which is what ``extend`` relies on.
    """
    levels: list[Level] = []
    while len(symbols) > 1:
        new = np.concatenate(([True], symbols[1:] != symbols[:-1]))
        if not new.all():
            starts = np.flatnonzero(new)
            length = np.diff(np.append(starts, len(symbols)))
            levels.append(Level(BLOCKS, symbols, starts))
            heads = symbols[starts]
            symbols, count = _named(heads * (len(symbols) + 1) + length, length > 1, heads, count)
        if len(symbols) == 1:
            break
        half = (text.mix(symbols.astype(np.uint64) + np.uint64(len(levels) * int(text._ODD) % 2**64)) & np.uint64(1)).astype(bool)
        up, down = half[1:] & ~half[:-1], ~half[1:] & half[:-1]
        joins = up if up.sum() >= down.sum() else down
        if not joins.any():  # all in one half: the next round's hash differs
            levels.append(Level(PAIRS, symbols, np.arange(len(symbols))))
            continue
        start = np.concatenate(([True], ~joins))
        starts = np.flatnonzero(start)
        levels.append(Level(PAIRS, symbols, starts))
        double = np.append(joins, False)[starts]
        second = symbols[np.minimum(starts + 1, len(symbols) - 1)]
        symbols, count = _named(symbols[starts] * count + second, double, symbols[starts], count)
    return levels


class Extender:
    """Answers, for many pairs of places of a sequence at once, how far they agree."""

    def __init__(self, levels: list[Level], length: int):
        self.levels, self.n = levels, length

    def extend(self, i: np.ndarray, j: np.ndarray, ahead: bool) -> np.ndarray:
        """Number of equal symbols from ``i`` and ``j`` on (``ahead``), or from them backwards,
        both places included.  ``i < j``; the last symbol (ahead) or the first (backwards) must be one of its kind.

        Climbing, a pair of places moves over the few symbols up to where both stand on the edge of a
        symbol of the next level; where they differ it turns, and going down only the first
        difference is looked for, two steps a level at most.
        """
        out = np.zeros(len(i), np.int64)
        turned: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        a, b, who = i.astype(np.int64), j.astype(np.int64), np.arange(len(i))
        for level in self.levels:
            a, b, who, stop = self._climb(level, a, b, who, ahead)
            turned.append(stop)
            if not len(who):
                break
        assert not len(who), "two places of one symbol at the top"
        x = y = w = np.zeros(0, np.int64)
        for k in range(len(turned) - 1, -1, -1):
            level = self.levels[k]
            if len(w):  # down to the first (or last) parts of the symbols that differ
                edge = level.first[:-1] if ahead else level.first[1:] - 1
                x, y = edge[x], edge[y]
                x, y = self._step(level, x, y, ahead)
            x, y, w = (np.concatenate(z) for z in zip((x, y, w), turned[k], strict=True))
        out[w] = x - i[w] if ahead else i[w] - x
        return out

    def _step(self, level: Level, x: np.ndarray, y: np.ndarray, ahead: bool) -> tuple[np.ndarray, np.ndarray]:
        """Over the parts that the two differing symbols begin with alike."""
        same = level.symbols[x] == level.symbols[y]
        if level.kind == BLOCKS:
            move = np.where(same, np.minimum(self._left(level, x, ahead), self._left(level, y, ahead)), 0)
        else:
            move = same.astype(np.int64)
        move = move if ahead else -move
        return x + move, y + move

    @staticmethod
    def _left(level: Level, x: np.ndarray, ahead: bool) -> np.ndarray:
        """Symbols of its parent from ``x`` on."""
        p = level.parent[x]
        return level.first[p + 1] - x if ahead else x - level.first[p] + 1

    @staticmethod
    def _on_edge(level: Level, x: np.ndarray, ahead: bool) -> np.ndarray:
        p = level.parent[x]
        return level.first[p] == x if ahead else level.first[p + 1] - 1 == x

    def _climb(self, level: Level, a, b, who, ahead: bool):
        """(places one level up, and those that differ on this level)."""
        step = 1 if ahead else -1
        up, stop = [], []
        for _ in range(4):
            if not len(who):
                break
            edge = self._on_edge(level, a, ahead) & self._on_edge(level, b, ahead)
            up.append((a[edge], b[edge], who[edge]))
            a, b, who = a[~edge], b[~edge], who[~edge]
            same = level.symbols[a] == level.symbols[b]
            stop.append((a[~same], b[~same], who[~same]))
            a, b, who = a[same], b[same], who[same]
            if level.kind == BLOCKS:
                left_a, left_b = self._left(level, a, ahead), self._left(level, b, ahead)
                move = np.minimum(left_a, left_b) * step
                a, b = a + move, b + move
                uneven = left_a != left_b
                stop.append((a[uneven], b[uneven], who[uneven]))
                a, b, who = a[~uneven], b[~uneven], who[~uneven]
            else:
                a, b = a + step, b + step
        assert not len(who)
        a, b, who = (np.concatenate(z) for z in zip(*up, strict=True))
        return level.parent[a], level.parent[b], who, tuple(np.concatenate(z) for z in zip(*stop, strict=True))
