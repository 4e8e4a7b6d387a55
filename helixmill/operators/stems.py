"""Reverse-complement stems of a sequence, and the feature row built on them.

A stem is a stretch of four letters or more whose reverse complement follows it after a loop of three or more. ``stem_burden``
counts them from the stretches of paired places along each diagonal, in numpy, for many sequences of one length at a time; ``stem_burden_join`` says the same as a
join of four-letter words with those of the other strand, extended letter by letter, which SQL can say too; a task joins the words of its own texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.functions import sequence as S
from helixmill.sources import spread

STEM, LOOP = 4, 3
#: Places of texts that are looked at together.
PLACES_AT_ONCE = 1 << 18
_OUT = "pairs int, weighted int, longest int, least_loop int"


def stems_of(texts: list[str]) -> np.ndarray:
    """(stems, letters in them, longest, least loop or -1) of each text over A, C, G and T; all of one length.

    A stem is any part of at least ``STEM`` pairs of a stretch of paired places along a diagonal x + y. With k = L - STEM + 1, a stretch of L pairs has
    k (k + 1) / 2 of them, which hold (STEM - 1) k (k + 1) / 2 + k (k + 1) (k + 2) / 6 letters; its last pair leaves the least loop. A diagonal of all
    texts is a slice of their letters beside a slice of the same letters turned round; only starts of ``STEM`` pairs, which are few, are looked at by themselves.
    """
    n, m = len(texts[0]), len(texts)
    out = np.zeros((m, 4), np.int64)
    out[:, 3] = -1
    if n < 2 * STEM + LOOP:
        return out
    number = np.full(256, 9, np.uint8)  # letters that pair come to 3
    number[np.frombuffer(b"ACGT", np.uint8)] = np.arange(4)
    base = np.ascontiguousarray(number[np.frombuffer("".join(texts).encode(), np.uint8).reshape(m, n)].T)
    back = base[::-1].copy()
    loop = np.full(m, n)
    keys: list[np.ndarray] = []
    held = 0

    def count() -> None:
        key = np.sort(np.concatenate(keys))  # by diagonal, text and place
        edge = np.flatnonzero(np.diff(key, prepend=-2) != 1)
        k = np.diff(np.r_[edge, len(key)])
        last = key[edge] + k - 1
        total, row, x = last // (m * n), last // n % m, last % n + STEM - 1
        out[:, 0] += np.bincount(row, k * (k + 1) // 2, m).astype(np.int64)
        out[:, 1] += np.bincount(row, (STEM - 1) * k * (k + 1) // 2 + k * (k + 1) * (k + 2) // 6, m).astype(np.int64)
        np.maximum.at(out[:, 2], row, k + STEM - 1)
        np.minimum.at(loop, row, total - 2 * x - 1)
        keys.clear()

    for total in range(2 * STEM + LOOP - 1, 2 * n - 2 * STEM - LOOP):
        low, high = max(0, total - n + 1), (total - LOOP - 1) // 2 + 1
        paired = base[low:high] + back[n - 1 - total + low : n - 1 - total + high] == 3
        size = len(paired) - STEM + 1
        if size < 1:
            continue
        whole = paired[:size]
        for i in range(1, STEM):
            whole = whole & paired[i : i + size]
        x, row = np.divmod(np.flatnonzero(whole), m)
        if len(x):
            keys.append((total * m + row) * n + low + x)
            held += len(x)
            if held >= PLACES_AT_ONCE:
                count()
                held = 0
    if keys:
        count()
    out[:, 3] = np.where(out[:, 0] > 0, loop, -1)
    return out


def _stems(texts: list[str | None]) -> list[list[int | None]]:
    out: list[list[int | None]] = [[None] * 4 for _ in texts]
    order = sorted((i for i, t in enumerate(texts) if t is not None), key=lambda i: len(texts[i]))
    begin = 0
    while begin < len(order):
        n = len(texts[order[begin]])
        stop = begin
        while stop < len(order) and stop - begin < max(1, min(2048, PLACES_AT_ONCE // max(1, n))) and len(texts[order[stop]]) == n:
            stop += 1
        for i, row in zip(order[begin:stop], stems_of([texts[i] for i in order[begin:stop]]).tolist()):
            out[i] = row
        begin = stop
    return out


def stem_burden(df: DataFrame, seq: str) -> DataFrame:
    """``df`` with the stems of its sequences over A, C, G and T; a null sequence has nulls."""
    at, names = df.columns.index(seq), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _stems(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int32()) for c in (zip(*rows) if rows else [[]] * 4))], [*names, "pairs", "weighted", "longest", "least_loop"])

    return df.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in df.dtypes) + ", " + _OUT)


def _joined(texts: list[str | None]) -> np.ndarray:
    """The same four numbers of each text, by joining its words with those of its other strand; null has no stems."""
    out = np.zeros((len(texts), 4), np.int64)
    loop = np.full(len(texts), np.iinfo(np.int64).max)
    coded = [(t or "").encode() for t in texts]
    n = np.array([len(t) for t in coded], np.int64)
    base = np.frombuffer(b"".join(coded) + bytes(STEM), np.uint8)
    back = np.arange(256, dtype=np.uint8)  # letters that do not pair stay as they are
    back[np.frombuffer(b"ACGT", np.uint8)] = np.frombuffer(b"TGCA", np.uint8)
    other = back[base]
    counts = np.maximum(n - STEM + 1, 0)
    row = np.repeat(np.arange(len(texts)), counts)
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts - (np.cumsum(n) - n), counts)
    word, end = row.astype(np.uint64), row.astype(np.uint64)
    for k in range(STEM):
        word = word << np.uint64(8) | base[at + k]
        end = end << np.uint64(8) | other[at + STEM - 1 - k]
    order = np.argsort(end, kind="stable")  # by row and word, then by place
    key = end[order]
    first = np.searchsorted(key, word)
    upto = np.cumsum(np.searchsorted(key, word, "right") - first)
    before = np.r_[0, upto[:-1]]
    for low in range(0, int(upto[-1]) if len(upto) else 0, PLACES_AT_ONCE):
        pair = np.arange(low, min(low + PLACES_AT_ONCE, upto[-1]))
        one = np.searchsorted(upto, pair, "right")
        i, q = at[one], at[order[pair - before[one] + first[one]]] + STEM - 1
        far = q - i >= 2 * STEM + LOOP - 1
        i, q, of = i[far], q[far], row[one[far]]
        size, alive = np.full(len(i), STEM), np.flatnonzero((q - i - LOOP + 1) // 2 > STEM)
        while len(alive):
            alive = alive[base[i[alive] + size[alive]] == other[q[alive] - size[alive]]]
            size[alive] += 1
            alive = alive[(q[alive] - i[alive] - LOOP + 1) // 2 > size[alive]]
        k = size - STEM + 1
        np.add.at(out[:, 0], of, k)
        np.add.at(out[:, 1], of, (STEM + size) * k // 2)
        np.maximum.at(out[:, 2], of, size)
        np.minimum.at(loop, of, q - i - 2 * size + 1)
    out[:, 3] = np.where(out[:, 0] > 0, loop, -1)
    return out


def _some(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Texts of together about ``PLACES_AT_ONCE`` letters."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= PLACES_AT_ONCE:
            yield texts[begin : i + 1]
            begin, size = i + 1, 0
    if begin < len(texts):
        yield texts[begin:]


def stem_burden_join(df: DataFrame, seq: str) -> DataFrame:
    """The same, as a join on words; low-complexity texts make it quadratic.

    Both sides are words of one text, so the join is made where the text is: words and pairs never leave the task, which holds ``PLACES_AT_ONCE`` at a time.
    """
    at, names = df.columns.index(seq), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.concatenate([np.zeros((0, 4), np.int64), *map(_joined, _some(batch.column(at).to_pylist()))])
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(rows[:, i], pa.int32()) for i in range(4))], [*names, "pairs", "weighted", "longest", "least_loop"])

    return spread(df).mapInArrow(run, ", ".join(f"{c} {t}" for c, t in df.dtypes) + ", " + _OUT)


def features(df: DataFrame, seq: str = "seq", dealt: bool = False) -> DataFrame:
    """``df`` with the feature row of each sequence of 24 letters or more: composition, runs, stems, adapter complementarity; nulls for a null one.

    Rows that are ``dealt`` over the cluster already are not dealt again.
    """
    own = stem_burden(df if dealt else spread(df), seq).withColumnsRenamed({"pairs": "own_pairs", "weighted": "own_weighted", "longest": "own_longest"}).drop("least_loop")
    full = own.withColumn("_full", F.concat(F.lit(S.LEFT_ADAPTER), F.col(seq), F.lit(S.RIGHT_ADAPTER)))
    full = stem_burden(full, "_full").withColumnsRenamed({"pairs": "full_pairs", "weighted": "full_weighted", "longest": "full_longest"}).drop("least_loop", "_full")
    out = {"gc_deviation": F.abs(S.gc_fraction(seq) - 0.5), "longest_run": S.longest_run(seq)}
    out |= {f"share_{b.lower()}": S.count_of(seq, b) / F.length(seq) for b in "ACGT"}
    for side, part in (("left", S.left_boundary(seq)), ("right", S.right_boundary(seq))):
        for name, adapter in (("left", S.LEFT_ADAPTER), ("right", S.RIGHT_ADAPTER)):
            back = adapter[::-1].translate(str.maketrans("ACGT", "TGCA"))
            out[f"{side}_{name}_tract"] = S.longest_common_with(part, back)
            out[f"{side}_{name}_words"] = S.complement_words(part, adapter)
    return full.withColumns(out)
