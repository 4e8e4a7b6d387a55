"""The exact language of words with bounded GC count and runs: counting, ranking and unranking, and the dispersing map.

A table has, for each position and state (last letter, run, GC count), the number of completions under each next letter as
running totals. The rank of a word is the sum of one entry a letter; unranking picks the letter whose interval holds the rest.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from hashlib import sha256

LETTERS = "ACGT"
_IS_GC = (0, 1, 1, 0)


class Language:
    def __init__(self, length: int = 108, gc_min: int = 49, gc_max: int = 59, max_run: int = 3):
        self.length, self.gc_min, self.gc_max, self.max_run = length, gc_min, gc_max, max_run
        states = [(4, 0), *((a, r) for a in range(4) for r in range(1, max_run + 1))]
        number = {s: i for i, s in enumerate(states)}
        self.next = [[number.get((b, r + 1 if a == b else 1), -1) for b in range(4)] for a, r in states]
        rest = [[int(gc_min <= g <= gc_max) for g in range(length + 2)] for _ in states]
        self.totals: list[list[list[tuple[int, ...]]]] = []
        for _ in range(length):
            layer, new = [], []
            for moves in self.next:
                row, sums = [], []
                for g in range(length + 1):
                    t, run = 0, [0]
                    for b, s in enumerate(moves):
                        t += rest[s][g + _IS_GC[b]] if s >= 0 else 0
                        run.append(t)
                    row.append(tuple(run))
                    sums.append(t)
                layer.append(row)
                new.append([*sums, 0])
            self.totals.append(layer)
            rest = new
        self.totals.reverse()
        self.size = self.totals[0][0][0][4] if length else 1

    def rank(self, word: str | None) -> int | None:
        """Place of the word in lexicographic order; None if it is no word of the language."""
        if word is None or len(word) != self.length:
            return None
        state = gc = total = 0
        for layer, letter in zip(self.totals, word):
            b = LETTERS.find(letter)
            if b < 0:
                return None
            total += layer[state][gc][b]
            state = self.next[state][b]
            if state < 0:
                return None
            gc += _IS_GC[b]
        return total if self.gc_min <= gc <= self.gc_max else None

    def unrank(self, rank: int) -> str | None:
        """The word at this place; None outside the language."""
        if not 0 <= rank < self.size:
            return None
        out, state, gc = [], 0, 0
        for layer in self.totals:
            run = layer[state][gc]
            b = bisect_right(run, rank) - 1
            rank -= run[b]
            out.append(LETTERS[b])
            state, gc = self.next[state][b], gc + _IS_GC[b]
        return "".join(out)


class Dispersal:
    """The affine permutation of ranks that spreads consecutive payloads over the whole language."""

    def __init__(self, size: int, namespace: str):
        draw = lambda part: int.from_bytes(sha256(f"{namespace}|{part}".encode()).digest(), "big") % size
        factor = max(1, draw("factor"))
        while math.gcd(factor, size) != 1:
            factor = factor % size + 1
        self.size, self.factor, self.shift = size, factor, draw("shift")
        self.inverse = pow(factor, -1, size)
        self.bits = size.bit_length() - 1

    def spread(self, logical: int) -> int:
        return (self.factor * logical + self.shift) % self.size

    def gather(self, physical: int) -> int | None:
        """The logical rank; None where it lies beyond the payloads' power of two."""
        logical = self.inverse * (physical - self.shift) % self.size
        return logical if logical < 1 << self.bits else None
