"""Problem 7: held-out passages that stand in the documents, by latent semantic retrieval.

Texts become words of their plain text, and words of the held-out items become numbers; all others are 0. A passage is a run of ten
words; its TF-IDF vector counts the held-out vocabulary, weighted over all documents. A randomised SVD of the documents'
passages gives the latent space: each task multiplies its passages with a random matrix and back, Spark sums the products by
word, and the driver keeps matrices of vocabulary times ``RANK``, bounded by the held-out words searched at a time. A window of ten document
words is a candidate for a held-out window if the signs of their latent vectors on random planes and a digest of these vectors
agree and their cosine is high. Each word has its direction in the latent space, whatever its frequency, and a length by its document frequency. These vectors are whole
numbers, so that windows of equal words have exactly equal vectors, and none is lost. Candidates are then checked word by word.

Held-out items are searched in blocks of a bounded number of words; what tasks need of a block is broadcast once.

Paraphrases have no equal vectors, and signs on planes lose most pairs of a cosine near the bound, so they are searched without
signs: every window of a document is counted against the words of every item, and only windows that share too few words with
an item for the common subsequence wanted are dropped. All others are compared by cosine and longest common subsequence.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.llm.plain_text import plain_text
from helixmill.sources import materialise, table

WIDTH = 10
RANK, ROUNDS, SEED = 16, 2, 7
PLANES, COSINE = 24, 0.98
#: Documents whose word rows a task works on at a time, and words of them.
AT_ONCE, WORDS_AT_ONCE = 1000, 250_000
#: Words of held-out items that are searched at a time; more items make more blocks.
ITEM_WORDS_AT_ONCE = 1_000_000
#: Whole units of a latent vector's length.
UNITS = 1 << 20
#: Words in a window for paraphrases; items with fewer than the first are searched by windows of the second.
PARAPHRASE_WIDTH, SHORT_WIDTH, PARAPHRASE_COSINE, PARAPHRASE_SHARE = 20, 10, 0.9, 0.6
#: Document windows and items that are counted at a time, and pairs of windows that are compared at a time (in both searches).
WINDOWS_AT_ONCE, ITEMS_AT_ONCE, PAIRS_AT_ONCE = 8192, 512, 100_000
_WORDS = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall(plain_text(text).lower()) if text else []


class HeldOut:
    """The words of some held-out items, numbered from 1."""

    def __init__(self, ids: list[int], texts: list[list[str]]):
        self.ids = ids
        self.number = {w: i + 1 for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
        self.words = [np.array([self.number[w] for w in t], np.int32) for t in texts]
        self.size = len(self.number) + 1

    def items(self, least: int, most: int) -> list[int]:
        """Places of the items with ``least`` to ``most`` words."""
        return [i for i, w in enumerate(self.words) if least <= len(w) <= most]

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """All runs of ``width`` words of the items, and each one's item (its place in ``ids``)."""
        runs = [np.lib.stride_tricks.sliding_window_view(w, width) for w in self.words if len(w) >= width]
        of = [np.full(len(w) - width + 1, i) for i, w in enumerate(self.words) if len(w) >= width]
        return (np.concatenate(runs), np.concatenate(of)) if runs else (np.zeros((0, width), np.int32), np.zeros(0, np.int64))


def blocks(items: DataFrame) -> Iterator[HeldOut]:
    """The items (item_id, text), each id once, in blocks; a block of no items where there are none."""
    ids, texts, total, some = [], [], 0, False
    for row in items.where(F.col("item_id").isNotNull()).groupBy("item_id").agg(F.min("text").alias("text")).toLocalIterator():
        ids.append(row["item_id"])
        texts.append(words_of(row["text"]))
        total += len(texts[-1])
        if total >= ITEM_WORDS_AT_ONCE:
            yield HeldOut(ids, texts)
            ids, texts, total, some = [], [], 0, True
    if ids or not some:
        yield HeldOut(ids, texts)


def numbered(docs: DataFrame, held: HeldOut) -> DataFrame:
    """(doc_id, words) with the number of every word of every document; null texts have no words."""
    number = docs.sparkSession.sparkContext.broadcast(held.number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = number.value.get
        for batch in batches:
            lists = [[get(w, 0) for w in words_of(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int32()))], ["doc_id", "words"])

    return docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(run, "doc_id long, words array<int>")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        upto = np.cumsum(batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            fits = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + WORDS_AT_ONCE, "right"))
            stop = max(at + 1, min(at + AT_ONCE, fits))
            yield batch.slice(at, stop - at)
            at = stop


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, all words, and the row of each word."""
    lists = batch.column(1)
    n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return batch.column(0).to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(n)), n)


def document_weights(numbers: DataFrame, size: int) -> np.ndarray:
    """Inverse document frequency of each held-out word over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, docs = np.zeros(size, np.int64), 0
        for batch in _pieces(batches):
            ids, words, rows = _flat(batch)
            docs += len(ids)
            seen += np.bincount(np.unique(rows.astype(np.int64) * size + words) % size, minlength=size)
        seen[0] = docs
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(seen)], ["word", "n"])

    rows = numbers.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # one row per held-out word
    n = np.zeros(size)
    for r in rows:
        n[r["word"]] = r["n"]
    return np.log((1 + n[0]) / (1 + n)) + 1


def _product(numbers: DataFrame, matrix: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A^T A M for the TF-IDF matrix A of all passages of ``WIDTH`` words of the documents."""
    size, rank = matrix.shape
    weighted = (matrix * weight[:, None]).astype(np.float32)
    weighted[0] = 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, rank))
        for batch in _pieces(batches):
            _, words, rows = _flat(batch)
            if not len(words):
                continue
            first = np.r_[True, rows[1:] != rows[:-1]]
            place = np.arange(len(rows)) - np.repeat(np.flatnonzero(first), np.diff(np.r_[np.flatnonzero(first), len(rows)]))
            cut = np.cumsum(first | (place % WIDTH == 0)) - 1
            known = words > 0
            words, cut = words[known], cut[known]
            if not len(words):
                continue
            begin = np.flatnonzero(np.r_[True, cut[1:] != cut[:-1]])
            latent = np.add.reduceat(weighted[words], begin, axis=0)
            order = np.argsort(words, kind="stable")
            by = words[order]
            start = np.flatnonzero(np.r_[True, by[1:] != by[:-1]])
            passage = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(words)]))
            total[by[start]] += np.add.reduceat(latent[passage[order]], start, axis=0)
        used = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(list(total[used]), pa.list_(pa.float64()))], ["word", "row"])

    sums = [F.sum(F.col("row")[i]).alias(f"c{i}") for i in range(rank)]
    out = np.zeros((size, rank))
    for r in numbers.mapInArrow(run, "word long, row array<double>").groupBy("word").agg(*sums).collect():  # one row per held-out word
        out[r["word"]] = r[1:]
    return out * weight[:, None]


def latent_words(numbers: DataFrame, weight: np.ndarray) -> np.ndarray:
    """A whole-number vector for each held-out word: TF-IDF weight times its row of the right singular vectors."""
    size = len(weight)
    rank = min(RANK, size)
    basis = np.random.default_rng(SEED).standard_normal((size, rank))
    for _ in range(ROUNDS):
        product = _product(numbers, basis, weight)
        basis, _ = np.linalg.qr(product + 1e-9 * np.random.default_rng(SEED).standard_normal(product.shape))
    length = np.linalg.norm(basis, axis=1, keepdims=True)
    stray = np.random.default_rng(SEED + 2).standard_normal(basis.shape)  # words of no weight in the space still have a direction
    direction = np.where(length > 1e-12, basis / np.maximum(length, 1e-12), stray / np.linalg.norm(stray, axis=1, keepdims=True))
    vectors = direction * (weight / max(weight.max(), 1e-12))[:, None]
    vectors[0] = 0
    return np.rint(vectors * UNITS).astype(np.int64)


def _signs(latent: np.ndarray, planes: np.ndarray) -> np.ndarray:
    return ((latent @ planes) > 0) @ (1 << np.arange(planes.shape[1]))


def _keys(latent: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """The signs, and under them a digest of the whole-number vector: equal vectors have equal keys, others hardly ever."""
    bits = 63 - planes.shape[1]
    factors = np.random.default_rng(SEED + 3).integers(0, 1 << 64, latent.shape[1], np.uint64) | np.uint64(1)
    digest = (latent.view(np.uint64) * factors).sum(axis=1, dtype=np.uint64)
    return _signs(latent, planes) << bits | (digest >> np.uint64(64 - bits)).view(np.int64)


def _unit(latent: np.ndarray) -> np.ndarray:
    return latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)


def _candidates(latent: np.ndarray, code: np.ndarray, order: np.ndarray, codes: np.ndarray, units: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(window, held-out window) with equal codes and a cosine of at least ``cosine``, in parts of ``PAIRS_AT_ONCE`` pairs of equal codes.

    Many held-out windows may share a code, and a code's pairs have no bound.
    """
    lo = np.searchsorted(codes, code, "left")
    upto = np.cumsum(np.searchsorted(codes, code, "right") - lo)
    own, cancelled = _unit(latent), ~units.any(axis=1)
    for low in range(0, int(upto[-1]) if len(upto) else 0, PAIRS_AT_ONCE):
        pair = np.arange(low, min(low + PAIRS_AT_ONCE, upto[-1]))
        window = np.searchsorted(upto, pair, "right")
        place = order[pair - np.r_[0, upto[:-1]][window] + lo[window]]
        near = (np.einsum("ij,ij->i", own[window], units[place]) >= cosine) | cancelled[place]  # vectors may cancel out
        yield window[near], place[near]


def leaked(numbers: DataFrame, held: HeldOut, vectors: np.ndarray) -> DataFrame:
    """(doc_id, item_id) of documents that hold at least ten consecutive words of an item.

    Items of fewer words are never found; a document counts once for an item, however often it holds its words.
    Common words point the same way, so hundreds of held-out windows share their signs. Only equal words count here, so windows meet
    under equal vectors at once.
    """
    runs, of = held.windows(WIDTH)
    planes = np.random.default_rng(SEED + 1).standard_normal((vectors.shape[1], PLANES))
    latent = vectors[runs].sum(axis=1)
    codes = _keys(latent, planes)
    order = np.argsort(codes, kind="stable")
    block = numbers.sparkSession.sparkContext.broadcast((runs, of, order, codes[order], _unit(latent), np.array(held.ids, np.int64), vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, of, order, codes, units, items, vectors = block.value
        for batch in _pieces(batches):
            ids, words, rows = _flat(batch)
            n = len(words) - WIDTH + 1
            if n < 1 or not len(runs):
                continue
            good = np.r_[0, np.cumsum(words > 0)]
            at = np.flatnonzero((good[WIDTH:] - good[:n] == WIDTH) & (rows[:n] == rows[WIDTH - 1 :]))
            known = words[words > 0]  # a window of held-out words is a run of these
            sums = np.zeros((len(known) + 1, vectors.shape[1]), np.int64)
            np.cumsum(vectors[known], axis=0, out=sums[1:])
            doc, item = [], []
            for part in np.array_split(at, len(at) // 50_000 + 1):
                own = sums[good[part] + WIDTH] - sums[good[part]]
                for window, place in _candidates(own, _keys(own, planes), order, codes, units, COSINE):
                    same = (words[part[window][:, None] + np.arange(WIDTH)] == runs[place]).all(axis=1)
                    doc.append(ids[rows[part[window[same]]]])
                    item.append(items[of[place[same]]])
            found = np.unique(np.stack([np.concatenate(doc), np.concatenate(item)], axis=1), axis=0) if doc else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["doc_id", "item_id"])

    return numbers.mapInArrow(run, "doc_id long, item_id long").distinct()


def longest_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of two short word rows, or of each pair of rows of two tables."""
    row = np.zeros((*b.shape[:-1], b.shape[-1] + 1), np.int64)
    for i in range(a.shape[-1]):
        row[..., 1:] = np.maximum.accumulate(np.maximum(row[..., 1:], np.where(b == a[..., i : i + 1], row[..., :-1] + 1, 0)), axis=-1)
    return row[..., -1]


def _window_sums(x: np.ndarray, width: int) -> np.ndarray:
    """Sums of ``width`` consecutive rows, by doubling; ``width`` under 256."""
    out, done, power, size = None, 0, x, 1
    while True:
        if width & size:
            n = len(x) - done - size + 1
            out = power[:n] if out is None else out[:n] + power[done : done + n]
            done += size
        if done == width:
            return out
        power, size = power[:-size] + power[size:], 2 * size


def _sharing(words: np.ndarray, rows: np.ndarray, items: list[np.ndarray], width: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(window, item), in parts: windows of one document of which at least ``least`` words are words of the item."""
    n = len(words) - width + 1
    known = np.r_[0, np.cumsum(words > 0)]
    good = np.zeros(len(words), bool)  # windows with enough held-out words at all; others share them with no item
    good[:n] = (known[width:] - known[:n] >= least) & (rows[:n] == rows[width - 1 :])
    covered = np.zeros(len(words) + 1, np.int64)
    covered[:-1] += good
    covered[width:] -= good[: len(words) + 1 - width]
    place = np.flatnonzero(np.cumsum(covered[:-1]) > 0)
    n = len(place) - width + 1
    for low in range(0, n, WINDOWS_AT_ONCE):
        high = min(n, low + WINDOWS_AT_ONCE)
        local, own = np.unique(words[place[low : high + width - 1]], return_inverse=True)
        whole = good[place[low:high]]
        for begin in range(0, len(items), ITEMS_AT_ONCE):
            some = items[begin : begin + ITEMS_AT_ONCE]
            member = np.zeros((len(local), len(some)), np.uint8)
            for i, item in enumerate(some):
                spot = np.minimum(np.searchsorted(local, item), len(local) - 1)
                member[spot[local[spot] == item], i] = 1
            at = np.flatnonzero((_window_sums(member[own], width) >= least) & whole[:, None])
            yield place[low + at // len(some)], begin + at % len(some)


def paraphrased(numbers: DataFrame, held: HeldOut, vectors: np.ndarray) -> DataFrame:
    """(doc_id, item_id, common_words, item_words, answer): documents with a passage close to one of an item.

    Close: of any twenty words of the document and any twenty of the item (ten of either, for items of ten to nineteen words), the latent vectors have a cosine of at least 0.9, and the
    longest common subsequence is at least 0.6 of the words. ``common_words`` is the longest of all close passages. ``answer``: the
    item's last three words stand in the document.
    """
    long = _paraphrased(numbers, held, vectors, PARAPHRASE_WIDTH, held.items(PARAPHRASE_WIDTH, 1 << 60))
    short = held.items(SHORT_WIDTH, PARAPHRASE_WIDTH - 1)
    return long.unionByName(_paraphrased(numbers, held, vectors, SHORT_WIDTH, short)) if short else long


def _paraphrased(numbers: DataFrame, held: HeldOut, vectors: np.ndarray, width: int, places: list[int]) -> DataFrame:
    """The same for the items at ``places``, by windows of ``width`` words."""
    least = PARAPHRASE_SHARE * width
    some = HeldOut([], [])
    some.ids, some.words = [held.ids[i] for i in places], [held.words[i] for i in places]
    runs, of = some.windows(width)
    count = np.bincount(of, minlength=len(places)).astype(np.int64)
    block = numbers.sparkSession.sparkContext.broadcast((runs, _unit(vectors[runs].sum(axis=1)), some.ids, some.words, count, np.cumsum(count) - count, vectors))

    def close(runs: np.ndarray, units: np.ndarray, count: np.ndarray, first: np.ndarray, words: np.ndarray, own: np.ndarray, at: np.ndarray, window: np.ndarray, item: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(window, item, common words) of the close ones among all windows of each item; ``own``: the units of windows ``at``."""
        parts = np.cumsum(count[item]) // PAIRS_AT_ONCE
        for part in np.split(np.arange(len(item)), np.flatnonzero(np.diff(parts)) + 1):
            n = count[item[part]]
            mine = np.repeat(part, n)
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[item[part]], n)
            near = (own[np.searchsorted(at, window[mine])] * units[place]).sum(axis=1) >= PARAPHRASE_COSINE
            mine, place = mine[near], place[near]
            for some in np.array_split(np.arange(len(mine)), len(mine) // 20_000 + 1):
                m, theirs = mine[some], runs[place[some]]
                text = words[window[m][:, None] + np.arange(width)]
                enough = (text[:, :, None] == theirs[:, None, :]).any(axis=2).sum(axis=1) >= least
                common = longest_common(text[enough], theirs[enough])
                good = common >= least
                yield window[m[enough][good]], item[m[enough][good]], common[good]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, units, ids_of, item_words, count, first, vectors = block.value
        for batch in _pieces(batches):
            ids, words, rows = _flat(batch)
            if len(words) < width or not len(runs):
                continue
            sums = np.zeros((len(words) + 1, vectors.shape[1]), np.int64)
            np.cumsum(vectors[words], axis=0, out=sums[1:])
            best: dict[tuple[int, int], int] = {}
            for window, item in _sharing(words, rows, item_words, width, least):
                at = np.unique(window)
                for w, i, common in close(runs, units, count, first, words, _unit(sums[at + width] - sums[at]), at, window, item):
                    for key in zip(rows[w].tolist(), i.tolist(), common.tolist()):
                        if best.get(key[:2], 0) < key[2]:
                            best[key[:2]] = key[2]
            out = []
            for (row, item), common in best.items():
                text, tail = words[np.searchsorted(rows, row) : np.searchsorted(rows, row, "right")], item_words[item][-3:]
                stands = (np.lib.stride_tricks.sliding_window_view(text, 3) == tail).all(axis=1).any()
                out.append((int(ids[row]), int(ids_of[item]), common, len(item_words[item]), bool(stands)))
            cols = list(zip(*out)) if out else [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()))], ["doc_id", "item_id", "common_words", "item_words", "answer"])

    return numbers.mapInArrow(run, "doc_id long, item_id long, common_words int, item_words int, answer boolean")


Search = Callable[[DataFrame, HeldOut, np.ndarray], DataFrame]


def _searched(spark: SparkSession, data_dir: str, search: Search) -> DataFrame:
    """The rows of ``search`` in the space of each block of held-out items; every item is in one block."""
    out = []
    for held in blocks(table(spark, data_dir, "heldout_items").select("item_id", "text")):
        numbers = materialise(numbered(table(spark, data_dir, "documents"), held), "p7-words")
        out.append(search(numbers, held, latent_words(numbers, document_weights(numbers, held.size))))
    return reduce(DataFrame.unionByName, out)


def p7_found(spark: SparkSession, data_dir: str) -> DataFrame:
    return _searched(spark, data_dir, leaked)


def p7_paraphrases(spark: SparkSession, data_dir: str) -> DataFrame:
    return _searched(spark, data_dir, paraphrased)


def p7_items(spark: SparkSession, data_dir: str) -> DataFrame:
    """Leaked items with their suite and split, and the number of documents that hold them."""
    items = table(spark, data_dir, "heldout_items").select("item_id", "suite", "split")
    counts = p7_found(spark, data_dir).groupBy("item_id").agg(F.count("*").alias("documents"))
    return items.join(counts, "item_id").select("item_id", "suite", "split", "documents")
