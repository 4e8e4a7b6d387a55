"""Single edits of words: all substitutions, insertions and deletions, each operation counted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.functions.language import _IS_GC, LETTERS, Dispersal, Language
from helixmill.functions.sequence import LENGTH, eligible
from helixmill.sources import spread


def single_edits(df: DataFrame, seq: str, kinds: tuple[str, ...] = ("substitution", "insertion", "deletion")) -> DataFrame:
    """``df`` times its edits, with ``kind`` and ``edited``; n letters have 3n, 4(n + 1) and n of them."""
    s, n = F.col(seq), F.length(seq)
    bases = F.array(*[F.lit(b) for b in "ACGT"])
    wide = spread(df).withColumn("_kind", F.explode(F.array(*[F.lit(k) for k in kinds])))
    wide = wide.withColumn("_i", F.explode(F.sequence(F.when(F.col("_kind") == "insertion", 0).otherwise(1), n)))
    wide = wide.withColumn("_b", F.explode(F.when(F.col("_kind") == "deletion", F.array(F.lit(""))).otherwise(bases)))
    i = F.col("_i")
    tail = F.substring(s, i + 1, n)
    head = F.when(F.col("_kind") == "insertion", F.substring(s, F.lit(1), i)).otherwise(F.substring(s, F.lit(1), i - 1))
    wide = wide.where((F.col("_kind") != "substitution") | (F.substring(s, i, F.lit(1)) != F.col("_b")))
    return wide.select(*df.columns, F.col("_kind").alias("kind"), F.concat(head, F.col("_b"), tail).alias("edited"))


def outcomes(df: DataFrame, group: list[str], edited: str) -> DataFrame:
    marked = df.select(*group, (F.length(edited) == LENGTH).alias("_fits"), eligible(edited).alias("_word"))
    return marked.groupBy(*group).agg(
        F.count("*").alias("edits"), F.count_if(~F.col("_fits")).alias("wrong_length"), F.count_if(F.col("_fits") & ~F.col("_word")).alias("no_word"), F.count_if("_word").alias("accepted")
    )


#: Words whose substitutions are looked at together.
WORDS_AT_ONCE = 512


class Substitutions:
    """What a decoder says of every substitution of words of a language, without decoding each.

    A rank is a sum of one entry a letter, and the logical rank is linear in it, so a substitution changes a few entries after it and shifts the GC count of
    the rest. Entries stand here as fractions of the language's size in 64 bits, whose sums wrap as ranks do. A fraction is too small by less than one unit an entry;
    where that could matter, which is all but never, the word is decoded in full.
    """

    def __init__(self, language: Language, namespace: str):
        self.language, self.way = language, Dispersal(language.size, namespace)
        size, n = language.size, language.length
        part = lambda x: (self.way.inverse * x % size << 64) // size
        self.table = np.array([[[[part(x) for x in run[:4]] for run in row[: n + 1]] for row in layer] for layer in language.totals], np.uint64)
        self.start, self.slack = np.uint64(part(-self.way.shift)), n + 2
        self.edge = (1 << self.way.bits + 64) // size  # of the payloads' power of two

    def _beyond(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which fractions lie beyond the domain, and which are too close to its edges to tell."""
        sure_in = at <= np.uint64(max(0, self.edge - self.slack))
        sure_out = (at > np.uint64(min(self.edge, (1 << 64) - 1))) & (at < np.uint64((1 << 64) - self.slack))
        return sure_out, ~(sure_in | sure_out)

    def outcomes(self, words: list[str], widths: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(decoded, counts): is each word of the language in the domain, and how many of its substitutions are no word, beyond, of the same and of another payload."""
        lang, n, m = self.language, self.language.length, len(words)
        code = np.zeros(256, np.int64)
        code[np.frombuffer(LETTERS.encode(), np.uint8)] = np.arange(4)
        w = code[np.frombuffer("".join(words).encode(), np.uint8).reshape(m, n)]
        is_gc = np.array(_IS_GC)
        gc = np.concatenate([np.zeros((m, 1), np.int64), np.cumsum(is_gc[w], axis=1)], axis=1)
        run, right = np.ones((m, n), np.int64), np.ones((m, n), np.int64)  # of equal letters up to and from each place
        for j in range(1, n):
            run[:, j] = np.where(w[:, j] == w[:, j - 1], run[:, j - 1] + 1, 1)
            right[:, n - 1 - j] = np.where(w[:, n - 1 - j] == w[:, n - j], right[:, n - j] + 1, 1)
        state = np.zeros((m, n), np.int64)
        state[:, 1:] = 1 + w[:, :-1] * lang.max_run + run[:, :-1] - 1
        place = np.arange(n)
        with np.errstate(over="ignore"):
            before = np.concatenate([np.full((m, 1), self.start), self.start + np.cumsum(self.table[place, state, gc[:, :n], w], axis=1, dtype=np.uint64)], axis=1)
            after = np.zeros((3, m, n + lang.max_run + 3), np.uint64)  # sums from each place on, with a GC count of one less, as many, one more
            for shift in (-1, 0, 1):
                entries = self.table[place, state, np.clip(gc[:, :n] + shift, 0, n), w]
                after[shift + 1, :, :n] = np.cumsum(entries[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1]
            new = (w[:, :, None] + np.arange(1, 4)) % 4
            shift = is_gc[new] - is_gc[w][:, :, None]
            left = np.zeros((m, n, 3), np.int64)
            left[:, 1:] = np.where(new[:, 1:] == w[:, :-1, None], run[:, :-1, None], 0)
            behind = np.zeros((m, n, 3), np.int64)
            behind[:, :-1] = np.where(new[:, :-1] == w[:, 1:, None], right[:, 1:, None], 0)
            total = gc[:, n:, None] + shift
            good = (left + behind < lang.max_run) & (total >= lang.gc_min) & (total <= lang.gc_max)
            row, i, k = np.nonzero(good)
            letter, off, length = new[row, i, k], shift[row, i, k], left[row, i, k] + 1
            at = before[row, i] + self.table[i, state[row, i], gc[row, i], letter]
            for step in range(1, lang.max_run + 2):  # places whose run may have changed
                j = np.minimum(i + step, n - 1)
                own = w[row, j]
                entry = self.table[j, letter * lang.max_run + np.minimum(length, lang.max_run), np.clip(gc[row, j] + off, 0, n), own]
                at = at + np.where(i + step < n, entry, np.uint64(0))
                length, letter = np.where(own == letter, length + 1, 1), own
            at = at + after[off + 1, row, i + lang.max_run + 2]
            sent = before[:, n]
            width = np.array([max(0, r) for r in widths], np.int64)
            reach = np.array([min((1 << 63) - 1, self.slack + 1 + (1 << min(int(r), lang.size.bit_length()) + 64) // lang.size) for r in width], np.uint64)
            distance = np.minimum(at - sent[row], sent[row] - at)
        outside, unsure = self._beyond(sent)
        decoded = ~outside & np.array([r >= 0 for r in widths], bool)
        for x in np.flatnonzero(unsure):
            decoded[x] = widths[x] >= 0 and self.way.gather(lang.rank(words[x])) is not None
        beyond, unsure = self._beyond(at)
        kind = np.where(beyond, 1, 3)
        for x in np.flatnonzero((unsure | ~beyond & (distance <= reach[row])) & decoded[row]):
            text = words[row[x]]
            logical = self.way.gather(lang.rank(text[: i[x]] + LETTERS[new[row[x], i[x], k[x]]] + text[i[x] + 1 :]))
            r = widths[row[x]]
            kind[x] = 1 if logical is None else 2 if logical >> r == self.way.gather(lang.rank(text)) >> r else 3
        counts = np.bincount(row * 4 + kind, minlength=4 * m).reshape(m, 4)
        counts[:, 0] = 3 * n - counts.sum(axis=1)
        return decoded, counts


def decoded_substitutions(df: DataFrame, language: Language, namespace: str, seq: str = "seq", bits: str = "bits") -> DataFrame:
    """``df``, of words of the language, without ``seq``: the words in the domain, with ``no_word``, ``beyond``, ``same`` and ``wrong``, the numbers of their substitutions that come to that."""
    shape, names = (language.length, language.gc_min, language.gc_max, language.max_run), df.columns
    rest = [c for c in names if c != seq]
    counted = ["no_word", "beyond", "same", "wrong"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = None
        for batch in batches:
            for low in range(0, batch.num_rows, WORDS_AT_ONCE):
                decoder = decoder or Substitutions(Language(*shape), namespace)
                some = batch.slice(low, WORDS_AT_ONCE)
                decoded, counts = decoder.outcomes(some.column(names.index(seq)).to_pylist(), some.column(names.index(bits)).to_pylist())
                cols = [*(some.column(names.index(c)) for c in rest), *(pa.array(c, pa.int64()) for c in counts.T)]
                yield pa.RecordBatch.from_arrays(cols, [*rest, *counted]).filter(pa.array(decoded))

    return df.mapInArrow(run, ", ".join([*(f"{c} {df.schema[c].dataType.simpleString()}" for c in rest), *(f"{c} long" for c in counted)]))
