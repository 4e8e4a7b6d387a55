"""Multi-index Hamming join over chunked signatures.

A signature is a row of symbols (64-bit words, so ``b = 64 * symbols`` bits); the distance of two signatures is the number of
symbols in which they differ, and a symbol that is absent differs from all. To find all pairs within distance ``t``, the
symbols are split into ``m`` chunks: by the pigeonhole principle some chunk of such a pair has at most ``e = t // m`` errors.
So each chunk is indexed once for every set of ``e`` symbols that may be wrong, by the symbols left, and any two rows within
the distance meet under at least one index key. Spark shuffles the keys, sorts them within partitions, and each task reads its
sorted keys as a stream and gives out the pairs of every short run; what it holds at a time is one run of at most ``cap`` rows.

A key shared by more than ``cap`` rows (an adapter, a large family of copies with edits) gives no pairs here. Its rows come
out marked as *hot* instead, so that the caller can hand them to an index with more selective keys, and at the last level
``block_pairs`` compares such a run exhaustively in salted blocks. Within a batch, no more than ``cap + 1`` rows of one key
enter the shuffle: enough for the run to be seen as long, whatever the share of rows with that key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.llm.letters import mix

PAIRS = "a long, b long"
ABSENT = np.uint64(0xFFFFFFFFFFFFFFFF)
Signer = Callable[[pa.Array], np.ndarray]


def chunk_keys(sig: np.ndarray, chunks: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every index entry of the signatures in ``sig`` (rows x symbols) for pairs within ``distance``."""
    n, symbols = sig.shape
    size, errors = symbols // chunks, distance // chunks
    if symbols % chunks or errors >= size:
        raise ValueError("chunks must divide the symbols and leave at least one of each chunk's symbols right")
    rows, keys = [], []
    for c in range(chunks):
        for p, kept in enumerate(combinations(range(c * size, (c + 1) * size), size - errors)):
            there = np.flatnonzero((sig[:, kept] != ABSENT).all(axis=1))
            key = np.full(len(there), np.uint64(c * 1_000_003 + p))
            for s in kept:
                key = mix(key ^ sig[there, s]) + np.uint64(s)
            rows.append(there)
            keys.append(mix(key))
    return np.concatenate(rows), np.concatenate(keys).view(np.int64)


def _ranks(order: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Number of earlier rows with the same key, in the order of ``order``."""
    k = keys[order]
    new = np.r_[True, k[1:] != k[:-1]]
    at = np.flatnonzero(new)
    return np.arange(len(k)) - np.repeat(at, np.diff(np.r_[at, len(k)]))


def short_tags(sig: np.ndarray) -> list[np.ndarray]:
    """Four bits of every symbol, 16 symbols to a word: what the rows of a run are compared by."""
    nibble = (sig >> np.uint64(20)) & np.uint64(15)
    shift = np.uint64(4) * np.arange(16, dtype=np.uint64)
    return [np.bitwise_or.reduce(nibble[:, i : i + 16] << shift[: nibble.shape[1] - i], axis=1).view(np.int64) for i in range(0, sig.shape[1], 16)]


def within_distance(symbols: int, distance: int) -> Callable[..., np.ndarray]:
    """A test of pairs by their short tags that all pairs within the signature distance pass: equal symbols have equal bits."""
    ones = np.uint64(0x1111111111111111)

    def allow(*tags: np.ndarray) -> np.ndarray:
        differ = 0
        for x, y in zip(tags[: len(tags) // 2], tags[len(tags) // 2 :]):
            z = x.view(np.uint64) ^ y.view(np.uint64)
            differ = differ + np.bitwise_count((z | z >> np.uint64(1) | z >> np.uint64(2) | z >> np.uint64(3)) & ones).astype(np.int64)
        return differ <= distance

    if symbols % 16:
        raise ValueError("whole words of 16 symbols are compared")
    return allow


def index_rows(df: DataFrame, sign: Signer, chunks: int, distance: int, cap: int, symbols: int, tags: int = 0) -> DataFrame:
    """(key, id, hot) of ``df`` (id long, text string), and ``tags`` words t0, t1, ... of short tags. Hot rows stand under a key of their own.

    The first ``symbols`` of a signature are split into chunks; the tags are of the others.
    """

    def keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        sig = sign(texts)
        row, key = chunk_keys(sig[:, :symbols], chunks, distance)
        return row, key, [t[row] for t in (short_tags(sig[:, symbols:]) if tags else [])]

    return keyed_rows(df, keys, cap, tags)


def keyed_rows(df: DataFrame, keys: Callable[[pa.Array], tuple[np.ndarray, np.ndarray, list[np.ndarray]]], cap: int, tags: int = 0) -> DataFrame:
    """The same for any index: ``keys`` gives the row, key and tags of every entry of some texts."""
    names = ["key", "id", "hot", *(f"t{i}" for i in range(tags))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            row, key, own = keys(batch.column(1))
            over = beyond(key, cap)
            hot = mix(ids[row[over]].view(np.uint64) ^ key[over].view(np.uint64)).view(np.int64)
            key = np.where(over, 0, key)
            key[over] = hot
            cols = [key, ids[row], over, *own]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)

    return df.mapInArrow(run, ", ".join(["key long, id long, hot boolean", *(f"{n} long" for n in names[3:])]))


def beyond(keys: np.ndarray, cap: int) -> np.ndarray:
    """Which entries have more than ``cap`` earlier ones with the same key."""
    order = np.argsort(keys, kind="stable")
    over = np.zeros(len(keys), bool)
    over[order] = _ranks(order, keys) > cap
    return over


def _runs(batches: Iterator[pa.RecordBatch], cap: int) -> Iterator[list[np.ndarray]]:
    """The columns (key, id, hot, tags...) in pieces that end with a run; the rest of a run that is long already comes as hot."""
    keep: list[np.ndarray] | None = None
    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if keep is not None:
            now = [np.concatenate(x) for x in zip(keep, now)]
        n = len(now[0])
        if not n:
            continue
        first = int(np.searchsorted(now[0], now[0][-1]))
        kept = min(n, first + cap + 1)
        if kept < n:
            tail = [x[kept:] for x in now]
            tail[2] = np.ones(n - kept, bool)
            yield tail
        yield [x[:first] for x in now]
        keep = [x[first:kept] for x in now]
    if keep is not None:
        yield keep


def pairs_in_runs(batches: Iterator[pa.RecordBatch], cap: int, allow: Callable[..., np.ndarray] | None) -> Iterator[pa.RecordBatch]:
    """(a, b) of the pairs in each run of rows with one key, and (id, null) for the rows of long runs; see ``run_pairs``."""
    for key, ids, hot, *tags in _runs(batches, cap):
        if not len(key):
            continue
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        n = np.diff(np.r_[at, len(key)])
        marked = hot | np.repeat(n > cap, n)
        for size in np.unique(n[(n > 1) & (n <= cap)]):
            place = at[n == size][:, None] + np.arange(size)
            x, y = np.triu_indices(size, 1)
            x, y = place[:, x].ravel(), place[:, y].ravel()
            good = ids[x] != ids[y]
            if allow is not None:
                good &= allow(*(t[x] for t in tags), *(t[y] for t in tags))
            a.append(ids[x[good]])
            b.append(ids[y[good]])
        x, y = np.concatenate(a), np.concatenate(b)
        hot_ids = np.unique(ids[marked])
        none = np.r_[np.zeros(len(x), bool), np.ones(len(hot_ids), bool)]
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[np.minimum(x, y), hot_ids]), pa.array(np.r_[np.maximum(x, y), hot_ids], mask=none)], ["a", "b"])


def run_pairs(indexed: DataFrame, cap: int, allow: Callable[..., np.ndarray] | None = None) -> DataFrame:
    """(a, b) of all pairs a < b under a key of at most ``cap`` rows; (id, null) for every row under a longer one.

    ``allow``, of the further columns of the one rows and of the other, keeps only some of the pairs.
    """
    return indexed.repartition("key").sortWithinPartitions("key").mapInArrow(lambda batches: pairs_in_runs(batches, cap, allow), PAIRS)


def block_pairs(keys: DataFrame, texts: DataFrame, cap: int, close: Callable[[pa.Array, pa.Array], np.ndarray], over: int | None = None) -> DataFrame:
    """The pairs under keys of more than ``over`` (``cap``) rows of which the matrix ``close(left texts, right texts)`` is true.

    ``keys``: (key, id); ``texts``: (id, text). A long run is cut into blocks of about ``cap`` rows, and each pair of blocks is
    compared in a task of its own, so that no task holds more than two blocks, however long the run.
    """
    long = keys.groupBy("key").count().where(F.col("count") > (cap if over is None else over)).select("key", F.ceil(F.col("count") / cap).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    rows = (
        keys.join(long, "key")
        .join(texts, "id")
        .select("key", "id", "text", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "text")
    )

    def compare(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        own, i, j = (t.column(c).to_numpy() for c in ("own", "i", "j"))
        ids, text = t.column("id").to_numpy(), t.column("text").combine_chunks()
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        x, y = np.nonzero(close(text.take(pa.array(left)), text.take(pa.array(right))))
        x, y = ids[left[x]], ids[right[y]]
        once = x < y if i[0] == j[0] else x != y
        return pa.table({"a": np.minimum(x, y)[once], "b": np.maximum(x, y)[once]})

    return rows.groupBy("key", "i", "j").applyInArrow(compare, PAIRS)
