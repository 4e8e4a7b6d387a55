"""A sparse suffix array of many texts on both strands, in sorted partitions.

The texts of a partition lie one after another in a byte array, with their ends as separators. At each chosen place the suffix that
begins there is taken, on the strand on which its first ``k`` letters hash lower, so that a shared stretch gives the same suffixes
whichever strand holds it. A suffix is known by its first 24 letters, five bits each in two words whose order is that of the letters.
Spark cuts the suffixes into ranges at sampled splitters and sorts each range; a range never ends inside a common prefix of ``k``
letters. One pass over a range then compares neighbours: where their common prefix falls below ``k``, a run of suffixes ends.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixmill.llm import hamming
from helixmill.llm.letters import flat, mix, rolling, starts
from helixmill.sources import partitions

#: Letters in a word of a suffix, and bits of a letter.
HALF, BITS = 12, 5
SUFFIX = "tier int, hi long, lo long, id long, hot boolean, tag long"
_POWERS = np.int64(1) << np.arange(HALF * BITS, dtype=np.int64)
_COMPLEMENT = np.arange(256, dtype=np.uint8)
_COMPLEMENT[np.frombuffer(b"ACGT", np.uint8)] = np.frombuffer(b"TGCA", np.uint8)


def reversed_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The bytes of the reverse complements of all texts, in place of the texts."""
    rows, at = starts(offsets, 1)
    return _COMPLEMENT[data[offsets[rows] + offsets[rows + 1] - 1 - at]] if len(at) else data


def strands(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, hash, place) of every ``k``-letter substring: the lesser hash of both strands, and where its suffix begins.

    Places count through the texts and then through their reverse complements.
    """
    rows, at = starts(offsets, k)
    back = offsets[rows] + offsets[rows + 1] - k - at
    own, other = mix(rolling(data, k)[at]), mix(rolling(reversed_rows(data, offsets), k)[back])
    return rows, at, np.minimum(own, other), np.where(own <= other, at, back + len(data))


def minimizers(data: np.ndarray, offsets: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of the suffixes at the least hash among any ``w`` neighbouring places of a text."""
    rows, at, h, place = strands(data, offsets, k)
    n = max(len(h) - w + 1, 0)
    least = h[:n].copy()
    for i in range(1, w):
        np.minimum(least, h[i : i + n], out=least)
    whole = rows[:n] == rows[w - 1 :]
    chosen = np.zeros(len(h), bool)
    for i in range(w):
        chosen[i : i + n] |= whole & (h[i : i + n] == least)
    return rows[chosen], place[chosen]


def words(data: np.ndarray, offsets: np.ndarray, rows: np.ndarray, place: np.ndarray, letters: int = 2 * HALF) -> tuple[np.ndarray, np.ndarray]:
    """The two words of the suffixes of ``rows`` at ``place``; beyond a text's end, or beyond ``letters``, letters are 0."""
    both = np.r_[data, reversed_rows(data, offsets), np.zeros(1, np.uint8)]
    end = offsets[rows + 1] + np.where(place >= len(data), len(data), 0)
    out = []
    for half in range(2):
        word = np.zeros(len(place), np.int64)
        for i in range(half * HALF, (half + 1) * HALF):
            word = word << BITS | (np.where(place + i < end, both[np.minimum(place + i, len(both) - 1)] & 31, 0) if i < letters else 0)
        out.append(word)
    return out[0], out[1]


def common_prefix(hi: np.ndarray, lo: np.ndarray, hi_before: np.ndarray, lo_before: np.ndarray) -> np.ndarray:
    """Letters (up to 24) in which suffixes agree with those before them."""
    first, second = (HALF - (np.searchsorted(_POWERS, x ^ y, "right") + BITS - 1) // BITS for x, y in ((hi, hi_before), (lo, lo_before)))
    return np.where(first < HALF, first, HALF + second)


def sparse(texts: DataFrame, tiers: tuple[tuple[int, int, int], ...], reach: int, cap: int) -> DataFrame:
    """The suffixes of ``texts`` (id long, text string, mask int) for every tier (least length, k, w) that a text belongs to.

    A tier reaches ``reach`` letters beyond the least length of the next. The tag holds mask and length. Of more than ``cap`` suffixes of a batch with
    one common prefix, the rest come out as hot, spread over all ranges.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, mask = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            length = np.diff(flat(batch.column(1))[1])
            tag = (mask.astype(np.int64) << 32) | length
            for tier, (low, k, w) in enumerate(tiers):
                high = tiers[tier + 1][0] + reach if tier + 1 < len(tiers) else 1 << 60
                inside = np.flatnonzero((length >= low) & (length < high))
                if not len(inside):
                    continue
                data, offsets = flat(batch.column(1).take(pa.array(inside)))
                rows, place = minimizers(data, offsets, k, w)
                hi, lo = words(data, offsets, rows, place)
                top, rest = _prefix(hi, k, 0), _prefix(lo, k, HALF)
                order = np.lexsort((rest, top))
                number = np.empty(len(order), np.int64)
                number[order] = np.cumsum(np.r_[True, (np.diff(top[order]) != 0) | (np.diff(rest[order]) != 0)])[: len(order)]
                _, once = np.unique(np.stack([rows, number]), axis=1, return_index=True)  # a text once in a run
                rows, hi, lo, number = rows[once], hi[once], lo[once], number[once]
                over = hamming.beyond(number, cap)
                hi = np.where(over, (mix(ids[inside[rows]].view(np.uint64)) >> np.uint64(4)).view(np.int64), hi)
                cols = [np.full(len(hi), tier, np.int32), hi, lo, ids[inside[rows]], over, tag[inside[rows]]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["tier", "hi", "lo", "id", "hot", "tag"])

    return texts.select("id", "text", "mask").mapInArrow(run, SUFFIX)


def _prefix(word: np.ndarray, k: int, before: int) -> np.ndarray:
    """The letters of a word that are among the first ``k`` of the suffix, ``before`` of them being in earlier words."""
    return word >> BITS * max(0, HALF - max(0, k - before))


def prefix_columns(tiers: tuple[tuple[int, int, int], ...]) -> list[Column]:
    """The first k letters of a suffix of each tier as columns to cut ranges by: equal prefixes fall into one range."""
    parts = [[F.when(F.col("tier") == t, F.shiftright(word, BITS * max(0, HALF - max(0, k - before)))) for t, (_, k, _) in enumerate(tiers)] for word, before in (("hi", 0), ("lo", HALF))]
    return [F.col("tier"), *(F.coalesce(*p) for p in parts)]


def adjacent_pairs(suffixes: DataFrame, tiers: tuple[tuple[int, int, int], ...], cap: int, allow: Callable[..., np.ndarray]) -> DataFrame:
    """(a, b) of the texts in runs of adjacent suffixes with common prefixes of k letters; (id, null) for every row of a run of over ``cap``."""
    least = np.array([k for _, k, _ in tiers])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, last = 0, (np.full(1, -1), np.zeros(1, np.int64), np.zeros(1, np.int64))
        for batch in batches:
            if not batch.num_rows:
                continue
            tier, hi, lo = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            before = [np.r_[x, y[:-1]] for x, y in zip(last, (tier, hi, lo))]
            ends = (tier != before[0]) | (common_prefix(hi, lo, before[1], before[2]) < least[tier])
            group = number + np.cumsum(ends)
            number, last = int(group[-1]), (tier[-1:], hi[-1:], lo[-1:])
            yield pa.RecordBatch.from_arrays([pa.array(group), *batch.columns[3:]], ["key", "id", "hot", "tag"])

    order = ("tier", "hi", "lo")
    ranges = suffixes.repartitionByRange(partitions(suffixes.sparkSession), *prefix_columns(tiers)).sortWithinPartitions(*order)
    return ranges.mapInArrow(lambda batches: hamming.pairs_in_runs(runs(batches), cap, allow), hamming.PAIRS)
