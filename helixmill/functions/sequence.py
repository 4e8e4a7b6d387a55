"""Sequence features as Catalyst expressions over strings of A, C, G and T."""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F



# Fixed values of the data model: adapters of the amplicon, boundary length and complement word length, and the language.
LEFT_ADAPTER, RIGHT_ADAPTER = "ACACGACGCTCTTCCGATCT", "AGATCGGAAGAGCACACGTCT"
BOUNDARY, COMPLEMENT_K = 24, 4
LENGTH, GC_MIN, GC_MAX, MAX_RUN = 108, 49, 59, 3


def c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def count_of(seq: Column | str, letters: str) -> Column:
    """How many letters of the text are among ``letters``."""
    return F.length(c(seq)) - F.length(F.translate(c(seq), letters, ""))


def gc_fraction(seq: Column | str) -> Column:
    """Share of G and C; 0 for the empty text, null for null."""
    return F.when(F.length(c(seq)) == 0, F.lit(0.0)).otherwise(count_of(seq, "GC") / F.length(c(seq)))


def longest_run(seq: Column | str) -> Column:
    """Length of the longest run of one letter; 0 for the empty text."""
    runs = F.regexp_extract_all(c(seq), F.lit(r"((.)\2*)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.when(c(seq).isNotNull(), F.lit(0)))


def is_dna(seq: Column | str) -> Column:
    """A text of A, C, G and T alone, not empty."""
    return (F.length(c(seq)) > 0) & (F.translate(c(seq), "ACGT", "") == "")


def eligible(seq: Column | str, length: int = LENGTH, gc_min: int = GC_MIN, gc_max: int = GC_MAX, max_run: int = MAX_RUN) -> Column:
    """A word of the language: its length, alphabet, GC count and longest run all within bounds."""
    runs = reduce(or_, [c(seq).contains(b * (max_run + 1)) for b in "ACGT"])
    return (F.length(c(seq)) == length) & is_dna(seq) & count_of(seq, "GC").between(gc_min, gc_max) & ~runs


def words(text: str, k: int) -> list[str]:
    return list(dict.fromkeys(text[i : i + k] for i in range(len(text) - k + 1)))


def complement_words(boundary: Column, adapter: str, k: int = COMPLEMENT_K) -> Column:
    """How many of the boundary's ``k``-letter substrings, repeats counted, lie in the adapter's reverse complement."""
    back = adapter[::-1].translate(str.maketrans("ACGT", "TGCA"))
    places = F.sequence(F.lit(1), F.greatest(F.length(boundary) - k + 1, F.lit(1)))
    return F.size(F.filter(places, lambda i: F.substring(boundary, i, F.lit(k)).isin(words(back, k))))


def longest_common_with(boundary: Column, target: str) -> Column:
    """Length of the longest substring of the fixed ``target`` that occurs in ``boundary``.

    Lengths are tried from one on, up to the first that does not occur: most tracts are short.
    """
    cases = F
    for k in range(1, len(target) + 1):
        cases = cases.when(~boundary.rlike("|".join(words(target, k))), F.lit(k - 1))
    return F.when(boundary.isNotNull(), cases.otherwise(F.lit(len(target))))


def left_boundary(seq: Column | str) -> Column:
    return F.substring(c(seq), 1, BOUNDARY)


def right_boundary(seq: Column | str) -> Column:
    return F.right(c(seq), F.lit(BOUNDARY))


def rate_penalty(fraction: Column | str) -> Column:
    """Bits a sequence lost by keeping only this fraction: minus its binary logarithm."""
    return -F.log2(c(fraction))


def finite(col: Column | str) -> Column:
    return c(col).isNotNull() & ~F.isnan(c(col)) & (F.abs(c(col)) != math.inf)


def score_key(score: Column | str, scale: float = 1e12) -> Column:
    """Whole-number key of a score, halves to even; a score that is not finite or too large is an error, never a null."""
    scaled = c(score) * scale
    ok = finite(score) & (F.abs(scaled) < float(1 << 63))
    return F.when(ok, F.rint(scaled).cast("long")).otherwise(F.raise_error(F.lit("score out of range for a whole-number key")).cast("long"))


def crc16(hex_text: Column | str) -> Column:
    """CRC-16 (polynomial 0x1021, start 0xffff, not reflected) of the bytes written in hexadecimal; an odd count gets a leading 0."""
    padded = F.when(F.length(c(hex_text)) % 2 == 1, F.concat(F.lit("0"), c(hex_text))).otherwise(c(hex_text))
    digits = F.transform(F.split(padded, "(?!^)(?!$)"), lambda d: F.conv(d, 16, 10).cast("int"))

    def nibble(crc: Column, d: Column) -> Column:
        out = crc.bitwiseXOR(F.shiftleft(d, 12))
        for _ in range(4):
            out = F.when(out.bitwiseAND(0x8000) != 0, F.shiftleft(out, 1).bitwiseXOR(0x1021)).otherwise(F.shiftleft(out, 1)).bitwiseAND(0xFFFF)
        return out

    return F.aggregate(digits, F.lit(0xFFFF), nibble)


