"""Pairs of texts that share a stretch of letters, held against each other where they meet.

Every entry of an index travels with a sketch of its text, the classes of its 6-letter substrings. Two texts of a given similarity differ in a bounded number of
substrings and so in no more classes, which makes the sketches a test that loses no pair: those that share a stretch by chance, whose number grows with the
square of the table, end where they meet and are never written. A task packs the entries it makes for one part into one binary, each text's sketch once, so
that Spark moves a few large rows. The parts are dealt over several turns, and the shuffle files of a turn are gone before the next.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from helixmill.llm import hamming
from helixmill.llm.letters import class_sets, flat, mix
from helixmill.sources import materialise
from helixmill.sources.tables import partitions

#: Classes of a sketch. Of two texts of 108 letters that share 15 by chance some 120 classes differ; at a similarity of one half, at most 69.
CLASSES = 320
WORDS = CLASSES // 64
#: Texts a turn, and the most turns: each computes the keys of all texts again.
TURN, TURNS = 300_000, 4
#: Texts packed at a time, which two bytes can number.
PACK = 1 << 15
#: Pairs that a task holds before it gives them out.
PAIRS = 1 << 20
Keys = Callable[[pa.Array], tuple[np.ndarray, np.ndarray, list[np.ndarray]]]


def packed(ids: np.ndarray, texts: pa.Array, keys: Keys, turn: int, turns: int, parts: int, cap: int) -> Iterator[tuple[int, bytes]]:
    """(part, entries) of a batch for a turn. Entries beyond ``cap + 1`` of one key and tag stand in runs that are long in any case: only their ids go on."""
    row, key, (tag,) = keys(texts)
    part = (key.view(np.uint64) >> np.uint64(32)) % np.uint64(turns * parts)
    now = np.flatnonzero(part % np.uint64(turns) == turn)
    row, key, tag, part = row[now], key[now], tag[now].astype(np.uint16), (part[now] // np.uint64(turns)).astype(np.uint16)
    over = hamming.beyond(mix(key.view(np.uint64) ^ tag), cap)
    if over.any():
        marked = ids[np.unique(row[over])]
        yield 0, np.array([len(marked), 0]).tobytes() + marked.tobytes()
        row, key, tag, part = row[~over], key[~over], tag[~over], part[~over]
    data, offsets = flat(texts)
    sketch, most = class_sets(data, offsets, CLASSES), np.maximum(np.diff(offsets) - 5, 0)
    order = np.argsort(part, kind="stable")
    row, key, tag, part = row[order], key[order].astype(np.uint32), tag[order], part[order]  # half of a key is enough within a part: a clash is one more pair to test
    ends = np.r_[np.flatnonzero(part[1:] != part[:-1]) + 1, len(part)] if len(part) else []
    begin = 0
    for end in ends:
        r = row[begin:end]
        new = np.r_[True, r[1:] != r[:-1]]
        own = r[new]
        columns = np.array([len(own), len(r)]), ids[own], sketch[own], most[own].astype(np.int32), key[begin:end], tag[begin:end], (np.cumsum(new) - 1).astype(np.uint16)
        yield int(part[begin]), b"".join(c.tobytes() for c in columns)
        begin = end


def unpacked(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    """(ids, most, sketches) of the texts, (key, tag, text) of the entries of a part, and the ids marked as hot."""
    columns: list[list[np.ndarray]] = [[] for _ in range(6)]
    marked, texts = [np.zeros(0, np.int64)], 0
    for blob in blobs:
        m, e = np.frombuffer(blob, np.int64, 2)
        at = 16
        if not e:
            marked.append(np.frombuffer(blob, np.int64, m, at))
            continue
        for k, (kind, n) in enumerate(((np.int64, m), (np.uint64, m * WORDS), (np.int32, m), (np.uint32, e), (np.uint16, e), (np.uint16, e))):
            columns[k].append(np.frombuffer(blob, kind, n, at))
            at += n * np.dtype(kind).itemsize
        columns[5][-1] = columns[5][-1].astype(np.uint32) + np.uint32(texts)
        texts += int(m)
    ids, sketch, most, key, tag, text = (np.concatenate(c) if c else np.zeros(0, np.uint64) for c in columns)
    return ids.view(np.int64), most, sketch.reshape(-1, WORDS), key, tag, text, np.concatenate(marked)


def near(sketch: list[np.ndarray], most: np.ndarray, i: np.ndarray | int, j: np.ndarray | slice, least: float) -> np.ndarray:
    """May texts i and j be as similar as ``least``? Their substrings differ in (1 - least) / (1 + least) of both numbers at most, and their classes in no more."""
    differ = np.bitwise_count(sketch[0][i] ^ sketch[0][j]).astype(np.uint16)
    for s in sketch[1:]:
        differ += np.bitwise_count(s[i] ^ s[j])
    return differ * (1 + least) <= (1 - least) * (most[i] + most[j])


def _pairs(first: np.ndarray, size: int, cap: int, test: Callable[..., np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs that pass, of the runs of ``size`` rows that begin at ``first``: many short runs at a time, or a long one row by row."""
    if size > cap:
        for begin in first:
            for i in range(begin, begin + size - 1):
                j = i + 1 + np.flatnonzero(test(i, slice(i + 1, begin + size)))
                yield np.full(len(j), i), j
        return
    x, y = np.triu_indices(size, 1)
    step = max(1, (1 << 18) // len(x))
    for k in range(0, len(first), step):
        i, j = (first[k : k + step, None] + x).ravel(), (first[k : k + step, None] + y).ravel()
        good = test(i, j)
        yield i[good], j[good]


def _once(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
    return a[new], b[new]


def meetings(blobs: list[bytes], masks: tuple[int, ...], middle: int, cap: int, least: float) -> Iterator[pa.RecordBatch]:
    """(a, b) of the pairs of a part that share a key and the tag under one of the masks and pass ``near``; (id, null) for rows of runs of over ``middle``."""
    ids, most, sketch, key, tag, text, marked = unpacked(blobs)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = 0
    for mask in masks:
        under = mix(key.astype(np.uint64) ^ mix((tag & np.uint16(mask)).astype(np.uint64) + np.uint64(mask << 16)))
        order = np.argsort(under)
        under = under[order]
        at = np.flatnonzero(np.r_[True, under[1:] != under[:-1]]) if len(under) else np.zeros(0, np.int64)
        n = np.diff(np.r_[at, len(under)])
        marked = np.union1d(marked, ids[text[order[np.repeat(n > middle, n)]]])
        at, n = at[(n > 1) & (n <= middle)], n[(n > 1) & (n <= middle)]
        own = text[order[np.repeat(at, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]]  # rows of these runs only
        at = np.cumsum(n) - n
        words, many = [np.ascontiguousarray(sketch[own, w]) for w in range(WORDS)], most[own]
        for size in np.unique(n):
            for i, j in _pairs(at[n == size], int(size), cap, lambda i, j: near(words, many, i, j, least)):
                x, y = ids[own[i]], ids[own[j]]
                apart = x != y
                found.append((np.minimum(x, y)[apart], np.maximum(x, y)[apart]))
                waiting += int(apart.sum())
                if waiting > PAIRS or len(found) > 1 << 12:
                    found = [_once(*map(np.concatenate, zip(*found)))]
                    waiting = len(found[0][0])
                    if waiting > PAIRS // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in found.pop()], ["a", "b"])
                        waiting = 0
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in _once(*map(np.concatenate, zip(*found)))], ["a", "b"])
    yield pa.RecordBatch.from_arrays([pa.array(marked), pa.nulls(len(marked), pa.int64())], ["a", "b"])


def stretch_pairs(texts: DataFrame, keys: Keys, masks: tuple[int, ...], middle: int, cap: int, least: float) -> DataFrame:
    """(a, b), a < b, of the texts (id long, text string) that share a key and a masked tag with at most ``middle`` rows, but for those that are surely less
    similar than ``least``; (id, null) for every row under a longer run. A pair can come out several times, once a part."""
    spark = texts.sparkSession
    turns = min(TURNS, 1 + texts.count() // TURN)
    parts = max(spark.sparkContext.defaultParallelism, -(-partitions(spark) // turns))

    def pack(turn: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for begin in range(0, batch.num_rows, PACK):
                    some = batch.slice(begin, PACK)
                    for part, blob in packed(some.column(0).to_numpy(zero_copy_only=False), some.column(1), keys, turn, turns, parts, middle):
                        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([blob], pa.binary())], ["part", "entries"])

        return run

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from meetings([b for batch in batches for b in batch.column(1).to_pylist()], masks, middle, cap, least)

    out = []
    for turn in range(turns):
        entries = texts.select("id", "text").mapInArrow(pack(turn), "part int, entries binary")
        out.append(materialise(entries.repartitionById(parts, "part").mapInArrow(meet, hamming.PAIRS), "p1-first"))
        del entries
        gc.collect()
        spark.sparkContext._jvm.System.gc()  # Spark deletes the turn's shuffle files once its driver has dropped them
    return reduce(DataFrame.unionByName, out)
