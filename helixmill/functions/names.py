"""Canonical spellings of the dirty text keys: pool and direction names, digests, sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANKS = " \t\r\n"


def name_key(col: Column | str) -> Column:
    """Pool or direction name without surrounding blanks, in lower case; blank names are null."""
    c = F.lower(F.btrim(F.col(col) if isinstance(col, str) else col, F.lit(_BLANKS)))
    return F.when(c != "", c)


def digest_key(col: Column | str) -> Column:
    """SHA-256 digest in lower case without surrounding blanks and without a leading ``sha256:`` or ``0x``; blank is null."""
    c = F.lower(F.btrim(F.col(col) if isinstance(col, str) else col, F.lit(_BLANKS)))
    c = F.btrim(F.regexp_replace(c, "^(sha256:|0x)", ""), F.lit(_BLANKS))
    return F.when(c != "", c)


def normal_sequence(col: Column | str) -> Column:
    """Upper case, letters only, U written as T; null stays null, so does a text without letters (as '')."""
    c = F.col(col) if isinstance(col, str) else col
    return F.translate(F.upper(F.regexp_replace(c, "[^A-Za-z]", "")), "U", "T")


def reverse_complement(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.translate(F.reverse(c), "ACGT", "TGCA")
