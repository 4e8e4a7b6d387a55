"""Problem 6: token ids of every text by a public byte-level BPE vocabulary.

Each short word keeps a contiguous array of part boundaries and one of the ranks of adjacent parts; the least rank is found by
a scan, its boundary is deleted, and the ranks beside it are refreshed. Words of over 64 bytes, where the scans would
be quadratic, take the same merges in the same order from a heap. Spark reads and splits the texts; a task keeps the ids of
the words it met, a bounded number of them, so that a common word is merged once a task.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from helixmill.sources import table

#: Where the vocabulary file lies on the driver; its lines are the base64 bytes of a token and its rank.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public word pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHORT, KEPT = 64, 512
CACHED_WORDS = 1 << 19
_NONE = 1 << 60


def read_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}


def merge_short(word: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The merges of a word, least rank first, the leftmost of equal ranks first.

    Equal pairs have equal ranks, so after one scan for the minimum the next places of the same rank follow without another,
    unless a refreshed rank is less.
    """
    get = ranks.get
    bounds = list(range(len(word) + 1))
    near = [get(word[i : i + 2], _NONE) for i in range(len(word) - 1)]
    while near:
        least = min(near)
        if least == _NONE:
            break
        i = near.index(least)
        while True:
            del bounds[i + 1], near[i]
            less = False
            if i:
                near[i - 1] = r = get(word[bounds[i - 1] : bounds[i + 1]], _NONE)
                less = r < least
            if i < len(near):
                near[i] = r = get(word[bounds[i] : bounds[i + 2]], _NONE)
                less = less or r < least
            if less:
                break
            try:
                i = near.index(least, i)
            except ValueError:
                break
    return tuple(ranks[word[a:b]] for a, b in zip(bounds, bounds[1:]))


def merge_long(word: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """As ``merge_short``, in time proportional to n log n: parts in a linked list, candidate merges in a heap."""
    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n))
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, a, b, c = heapq.heappop(heap)
        if a < 0 or after[a] != b or b >= n or after[b] != c or before[b] != a:
            continue
        after[a], after[b] = c, -1
        if c < n:
            before[c] = a
            if (r := ranks.get(word[a : after[c]])) is not None:
                heapq.heappush(heap, (r, a, c, after[c]))
        p = before[a]
        if p >= 0 and (r := ranks.get(word[p:c])) is not None:
            heapq.heappush(heap, (r, p, a, c))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : after[i]]])
        i = after[i]
    return tuple(out)


class WordIds(dict):
    """The ids of the words met so far; a missing word is merged and kept."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, word: str) -> tuple[int, ...]:
        raw = word.encode()
        whole = self.ranks.get(raw)
        if whole is not None:
            ids: tuple[int, ...] = (whole,)
        else:
            ids = merge_short(raw, self.ranks) if len(raw) <= SHORT else merge_long(raw, self.ranks)
        if len(raw) <= KEPT:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = ids
        return ids


def token_ids(docs: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) of every row of ``docs``, repeated keys included; a null or empty text has the empty list.

    Special tokens are never given out: their strings in a text are ordinary text. Other columns are ignored.
    """
    spark = docs.sparkSession
    content = spark.sparkContext.broadcast(Path(vocabulary).read_bytes())  # a fixed public file of about 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        words, split = WordIds(read_ranks(content.value)), regex.compile(PATTERN).findall
        get = words.__getitem__
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                flat: list[int] = []
                ends = [0]
                for t in part.column(1).to_pylist():
                    if t:
                        flat.extend(chain.from_iterable(map(get, split(t))))
                    ends.append(len(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))], [key, "ids"])

    return docs.select(key, text).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, ids array<int>")


def p6_ids(spark: SparkSession, data_dir: str) -> DataFrame:
    return token_ids(table(spark, data_dir, "documents"))
