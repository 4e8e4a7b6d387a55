"""The members of many fibers at once: their words and feature rows, thousands of words beside each other in numpy.

``codec.candidates`` and ``stems.features`` say the same word by word. Here a word is a column of an array of letter numbers (A, C, G, T
from 0, so letters that pair come to 3), or of bit planes of 64 words to a whole number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from helixmill.functions import sequence as S
from helixmill.functions.language import _IS_GC, LETTERS, Dispersal, Language
from helixmill.operators.stems import LOOP, STEM, stems_of
from helixmill.sources import spread

#: Bits of a rank's limb, and of a step of the window that letters are chosen by.
LIMB, STEP = 56, 28
#: Rows of bit planes that are looked at together.
ROWS_AT_ONCE = 400
#: Words that are made and featured together.
WORDS_AT_ONCE = 1 << 14
#: Members of a fiber whose ranks are told from that of the first of them.
MEMBERS_AT_ONCE = 256
#: Stems are counted in bit planes for so many words or more, of so many letters or fewer; others by themselves.
LEAST_WORDS, MOST_LETTERS = 64, 512
_WORD = 8
_LETTERS = np.frombuffer(LETTERS.encode(), np.uint8)


class Words:
    """The words of a language at many ranks at once.

    A letter is chosen by the leading 35 to 62 bits of what is left of the rank; lower limbs are only taken off, and carried over when the window
    moves down. A window that ends near 0 may have chosen wrongly for what lies below it: such words, some in a thousand million, are made one by one.
    """

    def __init__(self, language: Language):
        self.language, self.bytes = language, 7 * max(1, -(-language.size.bit_length() // LIMB))
        wide = language.gc_max + 2  # GC counts beyond the last are no words, and share a place
        states = len(language.next)
        self.next = np.array([max(s, 0) * wide + min(g + _IS_GC[b], wide - 1) for moves in language.next for g in range(wide) for b, s in enumerate(moves)])
        self.steps = []
        k = None
        for layer in language.totals:
            most = max(run[4] for row in layer for run in row[:wide]).bit_length()
            moved = 0
            if k is None:
                k = self.start = max(0, -(-(most - 62) // STEP))
            while k > 0 and most - STEP * (k - 1) <= 62:
                k, moved = k - 1, moved + 1
            runs = [run[:4] for s in range(states) for run in (layer[s] + [layer[s][-1]] * wide)[:wide]]
            low = STEP * k
            top = np.array([[t >> low for t in run] for run in runs], np.int64)
            limbs = [np.array([[(t & (1 << low) - 1) >> at & (1 << LIMB) - 1 for t in run] for run in runs], np.int64).ravel() for at in range(0, low, LIMB)]
            self.steps.append((moved, [top[:, b].copy() for b in (1, 2, 3)], top.ravel(), limbs))

    def limbs(self, ranks: list[int]) -> np.ndarray:
        """Ranks by their limbs, the lowest first, a column a rank."""
        raw = np.frombuffer(b"".join([r.to_bytes(self.bytes, "little") for r in ranks]), np.uint8).reshape(-1, self.bytes // 7, 7)
        eight = np.zeros((len(raw), self.bytes // 7, 8), np.uint8)
        eight[:, :, :7] = raw
        return np.ascontiguousarray(eight.view("<i8")[:, :, 0].T)

    def at(self, limbs: np.ndarray) -> np.ndarray:
        """Letter numbers, a column a word, of the ranks with these limbs, all within the language."""
        m = limbs.shape[1]
        k = self.start
        v = sum(limb << LIMB * (i - k // 2) >> (k % 2 * STEP if i == k // 2 else 0) if i == k // 2 else limb << LIMB * i - STEP * k for i, limb in enumerate(limbs) if i >= k // 2)
        low = [limb.copy() for limb in limbs[: (k + 1) // 2]]
        if k % 2:
            low[-1] &= (1 << STEP) - 1
        out = np.empty((len(self.steps), m), np.uint8)
        place, entry, got = np.zeros(m, np.intp), np.empty(m, np.intp), np.empty(m, np.int64)
        near = np.zeros(m, bool)
        some, more = np.empty(m, bool), np.empty(m, bool)
        for row, (moved, thresholds, top, parts) in zip(out, self.steps):
            for _ in range(moved):
                near |= v <= len(self.steps)
                for i, limb in enumerate(low):
                    bits = STEP if i == len(low) - 1 and k % 2 else LIMB
                    up = low[i + 1] if i + 1 < len(low) else v
                    up += limb >> bits
                    limb &= (1 << bits) - 1
                v <<= STEP
                if k % 2:
                    v |= low.pop()
                else:
                    v |= low[-1] >> STEP
                    low[-1] &= (1 << STEP) - 1
                k -= 1
            for i, t in enumerate(thresholds):
                t.take(place, out=got, mode="clip")
                np.greater_equal(v, got, out=more if i else some)
                np.add(some.view(np.uint8), more.view(np.uint8) if i else 0, out=row) if i < 2 else np.add(row, more.view(np.uint8), out=row)
            np.left_shift(place, 2, out=entry)
            entry += row
            top.take(entry, out=got, mode="clip")
            v -= got
            for limb, part in zip(low, parts):
                part.take(entry, out=got, mode="clip")
                limb -= got
            self.next.take(entry, out=place, mode="clip")
        for i in np.flatnonzero(near):
            word = self.language.unrank(sum(int(x) << LIMB * j for j, x in enumerate(limbs[:, i])))
            out[:, i] = [LETTERS.index(b) for b in word]
        return out


def numbers(text: str) -> np.ndarray:
    number = np.zeros(256, np.uint8)
    number[_LETTERS] = np.arange(4)
    return number[np.frombuffer(text.encode(), np.uint8)]


def _planes(bits: np.ndarray) -> np.ndarray:
    """Bits of a multiple of 64 words, a row a place, as whole numbers of 64 words."""
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def _bits(planes: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(planes).view(np.uint8), axis=-1, bitorder="little")


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u = a ^ b
    one, two = u ^ c, a & b
    u &= c
    two |= u
    return one, two


def _fifteen(planes: np.ndarray) -> list[np.ndarray]:
    """Planes of weight 1, 2, 4 and 8, a fifteenth as many each, with the sums of the given planes, which are a multiple of fifteen."""
    x = planes.reshape(15, -1, planes.shape[1])
    one, two = _add(x[:5], x[5:10], x[10:])
    a, c1 = _add(one[0], one[1], one[2])
    a, c2 = _add(a, one[3], one[4])
    b, d1 = _add(two[0], two[1], two[2])
    b, d2 = _add(b, two[3], two[4])
    b, d3 = _add(b, c1, c2)
    c, d = _add(d1, d2, d3)
    return [a, b, c, d]


class Tally:
    """How many bits each word has set in the planes that are added."""

    def __init__(self):
        self.held: list[list[np.ndarray]] = []

    def add(self, planes: np.ndarray, weight: int = 0) -> None:
        whole = len(planes) // 15 * 15
        if whole:
            for i, p in enumerate(_fifteen(planes[:whole])):
                self._hold(p, weight + i)
        if whole < len(planes):
            self._hold(planes[whole:].copy(), weight)

    def _hold(self, planes: np.ndarray, weight: int) -> None:
        while len(self.held) <= weight:
            self.held.append([])
        self.held[weight].append(planes)

    def counts(self) -> np.ndarray:
        out, weight = 0, 0
        while weight < len(self.held):
            while self.held[weight]:
                planes = np.concatenate(self.held[weight])
                self.held[weight] = []
                if len(planes) < 15:
                    out = out + (_bits(planes).sum(0, dtype=np.int64) << weight)
                else:
                    self.add(planes, weight)
            weight += 1
        return out


def _adapter_words(backs: tuple[str, ...]) -> np.ndarray:
    """For each word of eight letters and each adapter: its longest beginning that the adapter's other strand holds, and 16 if its first four letters are a word of it."""
    table = np.zeros((4**_WORD, 2), np.uint8)
    for i, back in enumerate(backs):
        for k in range(1, _WORD + 1):
            for w in S.words(back, k):
                at, span = int("".join(map(str, numbers(w))), 4) << 2 * (_WORD - k), 1 << 2 * (_WORD - k)
                table[at : at + span, i] = np.maximum(table[at : at + span, i], k)
        for w in S.words(back, S.COMPLEMENT_K):
            at, span = int("".join(map(str, numbers(w))), 4) << 2 * (_WORD - S.COMPLEMENT_K), 1 << 2 * (_WORD - S.COMPLEMENT_K)
            table[at : at + span, i] |= 16
    return table.reshape(-1).view(np.uint16)


class Diagonals:
    """The places of texts of one length that may pair, along each diagonal; and which of them lie in the part from ``begin`` to ``end``."""

    def __init__(self, n: int, begin: int, end: int):
        self.size, self.groups = n, []  # a row without bits follows each diagonal
        plan, own, at = [], [], 0
        for total in range(2 * STEM + LOOP - 1, 2 * n - 2 * STEM - LOOP):
            low, high = max(0, total - n + 1), (total - LOOP - 1) // 2 + 1
            x = np.arange(low, high)
            plan.append((low, high, n - 1 - total, at))
            own.append(np.r_[(x >= begin) & (total - x < end), False])
            at += high - low + 1
            if at >= ROWS_AT_ONCE or total == 2 * n - 2 * STEM - LOOP - 1:
                of = np.concatenate(own)[: at - STEM + 1]
                self.groups.append((plan, at, of, np.flatnonzero(of), np.flatnonzero(~of)))
                plan, own, at = [], [], 0

    def count(self, hi: np.ndarray, lo: np.ndarray, letters: np.ndarray | None = None) -> list[np.ndarray]:
        """(pairs, weighted, longest) of the part and of the whole texts, as ``stems_of`` counts them; ``letters``: where texts have letters, which is from their beginning on.

        A stretch of L pairs has a part of each length from every start that leaves it; so the starts of four pairs are counted in bit planes, and those of five, a quarter, one by one.
        """
        width = hi.shape[1]
        m = 64 * width
        hi_back, lo_back = hi[::-1].copy(), lo[::-1].copy()
        far = None if letters is None else letters[::-1].copy()
        most = max(g[1] for g in self.groups)
        paired, run, other = np.empty((most, width), np.uint64), np.empty((most, width), np.uint64), np.empty((self.size, width), np.uint64)
        four = (Tally(), Tally())
        longer: dict[int, list[np.ndarray]] = {}  # by length: the text of each start of so many pairs, those in the part, then the others
        for plan, size, own, own_at, rest_at in self.groups:
            p = paired[:size]
            for low, high, shift, at in plan:
                span = p[at : at + high - low]
                np.bitwise_xor(hi[low:high], hi_back[shift + low : shift + high], out=span)
                span &= np.bitwise_xor(lo[low:high], lo_back[shift + low : shift + high], out=other[: high - low])
                if far is not None:
                    span &= far[shift + low : shift + high]
                p[at + high - low] = 0
            two = np.bitwise_and(p[:-1], p[1:], out=run[: size - 1])
            starts = np.bitwise_and(two[:-2], two[2:], out=p[: size - 3])
            for tally, at in zip(four, (own_at, rest_at)):
                tally.add(np.take(starts, at, axis=0, out=run[: len(at)], mode="clip"))
            five = np.bitwise_and(starts[:-1], starts[1:], out=run[: size - 4]).ravel()
            at = np.flatnonzero(five != 0)
            values, where, bits = five[at], [], []
            while len(values):
                rest = values & (values - np.uint64(1))  # without the lowest bit
                where.append(at)
                bits.append(np.bitwise_count((values ^ rest) - np.uint64(1)))
                left = np.flatnonzero(rest)
                at, values = at[left], rest[left]
            if not where:
                continue
            at, bit = np.concatenate(where), np.concatenate(bits)
            row, column = np.divmod(at, width)
            text = column * 64 + bit + np.where(own[row], 0, m)
            k = STEM + 1
            while len(at):
                longer.setdefault(k, []).append(text)
                k += 1
                at = at + width
                on = np.flatnonzero(five.take(at, mode="clip") >> bit & np.uint64(1))  # the last row has no bits
                at, bit, text = at[on], bit[on], text[on]
        found = np.concatenate([np.broadcast_to(t.counts(), m) for t in four])
        pairs, weighted, longest = found.copy(), STEM * found, STEM * (found > 0)
        for k, texts in sorted(longer.items()):
            found = np.bincount(np.concatenate(texts), minlength=2 * m)
            pairs += found
            weighted += k * found
            longest[found > 0] = k
        own = [x[:m] for x in (pairs, weighted, longest)]
        return [*own, pairs[m:] + own[0], weighted[m:] + own[1], np.maximum(longest[m:], own[2])]


class Context:
    """The feature rows of words of one length, as ``stems.features`` names and orders them."""

    def __init__(self, length: int, like: Context | None = None):
        """``like``: a context of another length, whose table of adapter words is taken."""
        self.length = length
        left, right = numbers(S.LEFT_ADAPTER), numbers(S.RIGHT_ADAPTER)
        self.around = [np.where(a >> i & 1, ~np.uint64(0), np.uint64(0))[:, None] for i in (1, 0) for a in (left, right)]
        self.diagonals: Diagonals | None = None
        self.backs = tuple(adapter[::-1].translate(str.maketrans("ACGT", "TGCA")) for adapter in (S.LEFT_ADAPTER, S.RIGHT_ADAPTER))
        self.table = like.table if like else _adapter_words(self.backs)

    def _boundary(self, base: np.ndarray) -> list[np.ndarray]:
        """Of one boundary, for each adapter: the longest tract of the adapter's other strand, and the places of its words."""
        m = base.shape[1]
        letters = base.astype(np.uint16) << 14
        word = np.zeros(m, np.uint16)
        tract, found = np.zeros(2 * m, np.uint8), np.zeros(2 * m, np.uint8)
        for i in range(len(base) - 1, -1, -1):
            word >>= 2
            word |= letters[i]
            got = self.table.take(word).view(np.uint8)
            if i <= len(base) - S.COMPLEMENT_K:
                found += got >> 4
            got &= 15
            np.maximum(tract, got if len(base) - i >= _WORD else np.minimum(got, len(base) - i), out=tract)
        tract, found = tract.reshape(m, 2).copy(), found.reshape(m, 2)
        for i, a in zip(*np.nonzero(tract == _WORD)):  # it may be longer
            text = "".join(LETTERS[b] for b in base[:, i])
            while tract[i, a] < len(self.backs[a]) and any(w in text for w in S.words(self.backs[a], int(tract[i, a]) + 1)):
                tract[i, a] += 1
        return [tract[:, 0], found[:, 0], tract[:, 1], found[:, 1]]

    def _stems(self, hi: np.ndarray, lo: np.ndarray) -> list[np.ndarray]:
        if self.diagonals is None:
            begin = len(S.LEFT_ADAPTER)
            self.diagonals = Diagonals(begin + self.length + len(S.RIGHT_ADAPTER), begin, begin + self.length)
        wide = lambda x: np.broadcast_to(x, (len(x), hi.shape[1]))
        return self.diagonals.count(*(np.concatenate([wide(a), p, wide(b)]) for p, a, b in ((hi, *self.around[:2]), (lo, *self.around[2:]))))

    def rows(self, base: np.ndarray, stems: list[np.ndarray] | None = None) -> list[np.ndarray]:
        """The features of the words in the columns, each an array, in order; ``stems`` where they are known."""
        n, m = base.shape
        alone = stems is None and (m < LEAST_WORDS or n > MOST_LETTERS)
        if alone:
            whole = _LETTERS[base].T.tobytes().decode()
            texts = [whole[i : i + n] for i in range(0, n * m, n)]
        if m % 64:
            base = np.concatenate([base, np.repeat(base[:, -1:], -m % 64, axis=1)], axis=1)
        hi, lo = _planes(base >> 1), _planes(base & 1)
        counts = []
        for planes in (lo & ~hi, hi & ~lo, hi & lo):
            tally = Tally()
            tally.add(planes)
            counts.append(tally.counts())
        c, g, t = counts
        same = ~((hi[1:] ^ hi[:-1]) | (lo[1:] ^ lo[:-1]))
        run = np.ones(base.shape[1], np.int64)
        while len(same) and (some := np.bitwise_or.reduce(same, axis=0)).any():
            run += _bits(some)
            same = same[1:] & same[:-1]
        out = [np.abs((c + g) / n - 0.5), run, (n - c - g - t) / n, c / n, g / n, t / n]
        if stems is not None:
            out += stems
        elif alone:
            for around in (("", ""), (S.LEFT_ADAPTER, S.RIGHT_ADAPTER)):
                out += list(np.concatenate([stems_of([x.join(around) for x in texts[i : i + 16]]) for i in range(0, m, 16)]).T[:3])
        else:
            out += self._stems(hi, lo)
        out += self._boundary(base[: S.BOUNDARY]) + self._boundary(base[-S.BOUNDARY :])
        return [x[:m] for x in out]


def _stems_of_mixed(texts: list[str], known: dict[int, Diagonals]) -> np.ndarray:
    """The stems of texts of several lengths and of their amplicons, as six rows."""
    out = []
    for around in (("", ""), (S.LEFT_ADAPTER, S.RIGHT_ADAPTER)):
        whole = [t.join(around) for t in texts]
        n = -(-max(map(len, whole)) // 64) * 64
        raw = np.zeros((n, -(-len(texts) // 64) * 64), np.uint8)
        raw[:, : len(texts)] = np.frombuffer("".join([t.ljust(n) for t in whole]).encode(), np.uint8).reshape(-1, n).T
        number = np.zeros(256, np.uint8)
        number[_LETTERS] = np.arange(4, 8)
        base = number[raw]
        diagonals = known.get(n) or known.setdefault(n, Diagonals(n, 0, n))
        out += [x[: len(texts)] for x in diagonals.count(_planes(base >> 1 & 1), _planes(base & 1), _planes(base >> 2))[:3]]
    return np.array(out)


def features(df: DataFrame, names: list[str], seq: str = "seq") -> DataFrame:
    """``df``, of texts over A, C, G and T of 24 letters or more, with their features under ``names`` as doubles; those of one length together, whatever the order of the rows."""
    columns, at = df.columns, df.columns.index(seq)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts: dict[int, Context] = {}
        first, known = Context(S.LENGTH), {}
        for batch in batches:
            texts = batch.column(at).to_pylist()
            lengths = np.array([len(t) for t in texts], np.int64)
            order, values = np.argsort(lengths, kind="stable"), np.empty((len(names), len(texts)))
            begins = np.flatnonzero(np.diff(lengths[order], prepend=-1))
            ends = np.r_[begins[1:], len(texts)]
            few = np.repeat(ends - begins < LEAST_WORDS, ends - begins) & (lengths[order] <= MOST_LETTERS)
            mixed, stems = order[few], np.empty((6, len(texts)), np.int64)
            for low in range(0, len(mixed), WORDS_AT_ONCE):
                some = mixed[low : low + WORDS_AT_ONCE]
                stems[:, some] = _stems_of_mixed([texts[i] for i in some], known)
            for begin, end in zip(begins, ends):
                n = int(lengths[order[begin]])
                context = contexts.get(n) or contexts.setdefault(n, Context(n, first))
                step = max(1, min(WORDS_AT_ONCE, (1 << 24) // n))
                for low in range(begin, end, step):
                    some = order[low : min(low + step, end)]
                    base = np.ascontiguousarray(numbers("".join([texts[i] for i in some])).reshape(len(some), n).T)
                    values[:, some] = context.rows(base, list(stems[:, some]) if few[begin] else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, values)], [*columns, *names])

    return spread(df).mapInArrow(run, ", ".join(f"{c} {t}" for c, t in [*df.dtypes, *((n, "double") for n in names)]))


def _keys(scores: np.ndarray) -> np.ndarray:
    """Whole-number keys as ``sequence.score_key`` gives them."""
    scaled = scores * 1e12
    if not (np.abs(scaled) < float(1 << 63)).all():
        raise ValueError("score out of range for a whole-number key")
    return np.rint(scaled).astype(np.int64)


class _Ranks:
    """Ranks of members: the rank of a fiber's first member plus so many times its way's factor, modulo the size of the language."""

    def __init__(self, words: Words, ways: list[Dispersal]):
        self.size = words.limbs([words.language.size])[:, 0]
        self.steps = words.limbs([i * way.factor % way.size for way in ways for i in range(MEMBERS_AT_ONCE)])

    def at(self, first: np.ndarray, way: np.ndarray, number: np.ndarray) -> np.ndarray:
        """``first``: limbs, a column a run of at most ``MEMBERS_AT_ONCE`` members of one way."""
        ends = np.cumsum(number)
        step = np.arange(ends[-1]) + np.repeat(way * MEMBERS_AT_ONCE - ends + number, number)
        out = np.repeat(first, number, axis=1)
        less = np.empty_like(out)
        for i, limb in enumerate(out):
            limb += self.steps[i].take(step)
            np.subtract(limb, self.size[i], out=less[i])
        for x in (out, less):
            for i in range(len(x) - 1):
                x[i + 1] += x[i] >> LIMB
                x[i] &= (1 << LIMB) - 1
        return np.where(less[-1] >= 0, less, out)


class _Best:
    """Of each fiber the sum and number of its scores and the best of them: the highest key, the smallest choice on ties."""

    def __init__(self, fibers: int):
        self.total, self.number = np.zeros(fibers), np.zeros(fibers, np.int64)
        self.key, self.choice, self.score = np.zeros(fibers, np.int64), np.full(fibers, -1, np.int64), np.zeros(fibers)

    def add(self, fiber: np.ndarray, choice: np.ndarray, scores: np.ndarray) -> None:
        """Fibers ascend, choices within one too, also from call to call."""
        key, begin = _keys(scores), np.flatnonzero(np.diff(fiber, prepend=-1))
        of, length = fiber[begin], np.diff(np.r_[begin, len(fiber)])
        top = np.maximum.reduceat(key, begin)
        at = np.flatnonzero(key == np.repeat(top, length))
        first = at[np.searchsorted(at, begin)]
        better = (self.number[of] == 0) | (top > self.key[of])
        of_better, first = of[better], first[better]
        self.key[of_better], self.choice[of_better], self.score[of_better] = top[better], choice[first], scores[first]
        self.total[of] += np.add.reduceat(scores, begin)
        self.number[of] += length


def namespace_gains(df: DataFrame, language: Language, namespaces: list[str], fits: dict[str, list[float]]) -> DataFrame:
    """(pool, bits, namespace, gain, fibers): of each namespace's fibers the number, and the sum of what the best score has over the fiber's mean.

    ``df``: (pool, bits, payloads), a row a record, its payload ranks as decimal strings; rows of one pool and width come out once a task and batch, to be
    added up. ``fits``: the intercept and coefficients of each pool; pools without are left out, and so are fibers beyond the domain. A task makes, features
    and scores all members of its records, of which only a block is held.
    """
    words = Words(language)
    ways = [Dispersal(language.size, n) for n in namespaces]
    ranks = _Ranks(words, ways)
    codes = {pool: i for i, pool in enumerate(fits)}
    table = np.array(list(fits.values()), float).T.copy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = Context(language.length)
        for batch in batches:
            pools, widths, payloads = (batch.column(i).to_pylist() for i in range(3))
            fibers = [(i, j, int(p) << r) for i, (pool, r, of) in enumerate(zip(pools, widths, payloads)) if pool in codes for j in range(len(ways)) for p in of if int(p) << r < 1 << ways[j].bits]
            if not fibers:
                continue
            code = np.array([codes[pools[i]] for i, _, _ in fibers])
            best = _Best(len(fibers))
            parts: list[tuple[int, int, int, int, int]] = []  # fiber, way, first choice, members, rank of the first
            held = 0

            def score() -> None:
                number, choice = np.array([p[3] for p in parts]), np.array([p[2] for p in parts])
                fiber = np.repeat([p[0] for p in parts], number)
                choice = np.arange(len(fiber)) + np.repeat(choice - np.cumsum(number) + number, number)
                base = words.at(ranks.at(words.limbs([p[4] for p in parts]), np.array([p[1] for p in parts]), number))
                own = code[fiber]
                scores = table[0].take(own)
                for beta, feature in zip(table[1:], context.rows(base)):
                    scores = scores + beta.take(own) * feature
                best.add(fiber, choice, scores)
                parts.clear()

            for f, (i, j, logical) in enumerate(fibers):
                way, choice = ways[j], 0
                last = min(1 << widths[i], (1 << way.bits) - logical)
                while choice < last:
                    n = min(last - choice, WORDS_AT_ONCE - held, MEMBERS_AT_ONCE)
                    parts.append((f, j, choice, n, way.spread(logical + choice)))
                    held, choice = held + n, choice + n
                    if held == WORDS_AT_ONCE:
                        score()
                        held = 0
            if held:
                score()
            # a record's fibers are one where it has several payloads
            record = np.array([i * len(ways) + j for i, j, _ in fibers])
            order = np.lexsort((best.choice, -best.key, record))
            at, first = np.unique(record[order], return_index=True)
            mean = np.bincount(record, best.total)[at] / np.bincount(record, best.number)[at]
            gain = best.score[order][first] - mean
            row, namespace = np.divmod(at, len(ways))
            kinds: dict[tuple, int] = {}
            kind = np.array([kinds.setdefault((pools[i], widths[i]), len(kinds)) for i in row.tolist()]) * len(ways) + namespace
            total, number = np.bincount(kind, gain, len(kinds) * len(ways)), np.bincount(kind, minlength=len(kinds) * len(ways))
            out = [(pool, r, j, float(total[k * len(ways) + j]), int(number[k * len(ways) + j])) for (pool, r), k in kinds.items() for j in range(len(ways)) if number[k * len(ways) + j]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int64()))], ["pool", "bits", "namespace", "gain", "fibers"])

    return df.select("pool", "bits", "payloads").mapInArrow(run, "pool string, bits int, namespace int, gain double, fibers long")
