"""Array helpers for batches of letter strings: rolling hashes, exact shingle codes, shingle bit sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads close values over the whole range."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array and the offsets of its texts (null counts as empty)."""
    texts = pa.array(texts.fill_null(""), pa.string()) if texts.null_count else texts.cast(pa.string())
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] if len(offsets) else 0 : offsets[-1] if len(offsets) else 0]
    return data, offsets - offsets[0]


def starts(offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and position of every ``k``-letter substring."""
    lengths = np.diff(offsets)
    counts = np.maximum(lengths - k + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return rows, np.arange(counts.sum()) - np.repeat(first - offsets[:-1], counts)


def rolling(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of the ``k`` bytes from each position on (the last ``k - 1`` positions are left out)."""
    n = max(len(data) - k + 1, 0)
    one = data.astype(np.uint64) + np.uint64(1)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h *= _BASE
        h += one[i : i + n]
    return h


def anchored(data: np.ndarray, offsets: np.ndarray, k: int, w: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, position) of the ``k``-letter words at the anchors of the texts.

    Every ``k + w - 1`` letters hold one: the place of their least hashed ``anchor``-letter substring, modulo ``w``. It depends on these letters alone, so
    two texts that share so long a stretch share a word, wherever the stretch stands.
    """
    size = k + w - anchor
    if size >= 64:
        raise ValueError("places are kept in six bits")
    n = len(data) - (k + w - 1) + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # (hash, place) in one word, so that the least of all places is a few passes over windows of doubled length, and the first of equal ones wins
    least = mix(rolling(data, anchor)) & ~np.uint64(63)
    have, rest, done, parts = 1, least, 0, []
    while True:
        if size & have:
            parts.append((done, rest))
            done += have
        if 2 * have > size:
            break
        rest = np.minimum(rest[:-have], rest[have:] + np.uint64(have))
        have *= 2
    out = parts[0][1][:n]
    for shift, more in parts[1:]:
        out = np.minimum(out, more[shift : shift + n] + np.uint64(shift))
    taken = np.zeros(len(data), bool)
    _, at = starts(offsets, k + w - 1)
    place = (out & np.uint64(63)).astype(np.uint8) % np.uint8(w)
    taken[at + place[at]] = True
    chosen = np.flatnonzero(taken)
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[chosen], chosen


def codes6(data: np.ndarray) -> np.ndarray:
    """Exact 30-bit codes of the 6-letter substrings of A to Z from each position on."""
    n = max(len(data) - 5, 0)
    one = (data & 31).astype(np.int64)
    c = np.zeros(n, np.int64)
    for i in range(6):
        c <<= 5
        c |= one[i : i + n]
    return c


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (row << 30 | 6-letter code) of all texts, and the number of distinct ones per row."""
    data, offsets = flat(texts)
    rows, at = starts(offsets, 6)
    both = np.unique((rows.astype(np.int64) << 30) | codes6(data)[at])
    return both, np.bincount(both >> 30, minlength=len(offsets) - 1)


#: Two-bit numbers of A, C, G and T; 4 for all other bytes.
_BASES = np.full(256, 4, np.uint8)
_BASES[np.frombuffer(b"ACGT", np.uint8)] = np.arange(4)


def bit_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bit sets of the 6-letter shingles of texts over A, C, G and T, and which texts hold other letters."""
    base = _BASES[data]
    other = np.zeros(len(offsets) - 1, bool)
    other[np.searchsorted(offsets, np.flatnonzero(base == 4), "right") - 1] = True
    rows, at = starts(offsets, 6)
    code = np.zeros(max(len(data) - 5, 0), np.int32)
    for i in range(6):
        code = (code << 2) | (base[i : i + len(code)] & 3)
    seen = np.zeros((len(offsets) - 1, 4096), bool)
    seen[rows, code[at]] = True
    return np.packbits(seen, axis=1).view(np.uint64), other


def class_sets(data: np.ndarray, offsets: np.ndarray, classes: int) -> np.ndarray:
    """Bit sets (rows x words) of the classes of the 6-letter substrings of texts over any letters; equal substrings have one class."""
    rows, at = starts(offsets, 6)
    spread = (codes6(data).astype(np.uint64) * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF)
    number = ((spread ^ (spread >> np.uint64(15))) * np.uint64(classes)) >> np.uint64(32)
    seen = np.zeros((len(offsets) - 1, classes), bool)
    seen.ravel()[rows * classes + number[at].astype(np.int64)] = True
    return np.packbits(seen, axis=1).view(np.uint64)


def may_share(left: pa.Array, right: pa.Array, least: float) -> np.ndarray:
    """False only for pairs whose similarity is surely under ``least``: from sets of 1,024 shingle classes instead of shingles.

    Classes merge shingles, so two texts share at most as many shingles as classes and those one text has more than classes.
    """
    out = np.ones(len(left), bool)
    for begin in range(0, len(left), 8192):
        bits, size, slack = [], [], []
        for texts in (left.slice(begin, 8192), right.slice(begin, 8192)):
            data, offsets = flat(texts)
            base = _BASES[data] & 3
            code = np.zeros(max(len(data) - 5, 0), np.int32)
            for i in range(6):
                code = (code << 2) | base[i : i + len(code)]
            rows, at = starts(offsets, 6)
            seen = np.zeros((len(texts), 1024), bool)
            seen[rows, ((code * 40503) >> 4)[at] & 1023] = True
            bits.append(np.packbits(seen, axis=1).view(np.uint64))
            size.append(np.bitwise_count(bits[-1]).sum(axis=1).astype(np.int64))
            slack.append(np.maximum(np.diff(offsets) - 5, 0) - size[-1])
        common = np.bitwise_count(bits[0] & bits[1]).sum(axis=1) + np.minimum(*slack)
        out[begin : begin + 8192] = common * (1 + least) >= least * (size[0] + size[1])
    return out


def jaccard6(left: pa.Array, right: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Size of intersection and union of the 6-letter shingle sets of each pair of texts."""
    common, union = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
    slow = [np.zeros(0, np.int64)]
    for begin in range(0, len(left), 4096):
        x, xo = bit_sets(*flat(left.slice(begin, 4096)))
        y, yo = bit_sets(*flat(right.slice(begin, 4096)))
        common[begin : begin + 4096] = np.bitwise_count(x & y).sum(axis=1)
        union[begin : begin + 4096] = np.bitwise_count(x | y).sum(axis=1)
        slow.append(begin + np.flatnonzero(xo | yo))
    rest = np.concatenate(slow)
    if len(rest):
        common[rest], union[rest] = _jaccard6_any(left.take(pa.array(rest)), right.take(pa.array(rest)))
    return common, union


def close_matrix(left: pa.Array, right: pa.Array, least: float) -> np.ndarray:
    """For every text of ``left`` against every one of ``right``: is the similarity of their shingle sets ``least`` or more?"""
    (xd, xs), (yd, ys) = flat(left), flat(right)
    (x, xo), (y, yo) = bit_sets(xd, xs), bit_sets(yd, ys)
    nx, ny = np.bitwise_count(x).sum(axis=1), np.bitwise_count(y).sum(axis=1)
    # Sets of classes first, of which dissimilar texts differ in more than similar ones may: an eighth of the words.
    p, q = class_sets(xd, xs, 512), np.ascontiguousarray(class_sets(yd, ys, 512).T)
    mx, my = np.maximum(np.diff(xs) - 5, 0), np.maximum(np.diff(ys) - 5, 0)
    out = np.zeros((len(left), len(right)), bool)
    others: list[tuple[np.ndarray, np.ndarray]] = []
    for i in range(len(left)):
        differ = np.zeros(len(right), np.uint16)
        for w in range(len(q)):
            differ += np.bitwise_count(p[i, w] ^ q[w])
        j = np.flatnonzero(differ * (1 + least) <= (1 - least) * (mx[i] + my))
        other = yo[j] | xo[i]
        others.append((np.full(other.sum(), i), j[other]))
        j = j[~other]
        common = np.bitwise_count(x[i] & y[j]).sum(axis=1)
        out[i, j] = (common > 0) & (common >= least * (nx[i] + ny[j] - common))
    i, j = (np.concatenate(c) for c in zip(*others)) if others else (np.zeros(0, np.int64),) * 2
    for begin in range(0, len(i), 4096):
        a, b = i[begin : begin + 4096], j[begin : begin + 4096]
        common, union = _jaccard6_any(left.take(pa.array(a)), right.take(pa.array(b)))
        out[a, b] = (common > 0) & (common >= least * union)
    return out


def _jaccard6_any(left: pa.Array, right: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The same for texts over any of the letters A to Z."""
    a, na = shingle_sets(left)
    b, nb = shingle_sets(right)
    both = np.intersect1d(a, b, assume_unique=True)
    common = np.bincount(both >> 30, minlength=len(na))
    return common, na + nb - common
