"""Problem 8: one consistent form for texts that look the same.

Widths and ligatures become ordinary letters, zero-width characters go, blanks become ordinary spaces, accents are composed.
Then the *resolved script set* of each word (run of letters, digits and accents) is the intersection of the script sets of its
letters, digits and accents belonging to every script, and letters that are written together (such as kana and Chinese ones) to a common set. A word
with an empty set is of mixed scripts; if it holds Latin letters, its Cyrillic and Greek letters that look like Latin ones take the Latin spelling. A word wholly in Cyrillic or Greek that could be
spelled with look-alikes alone is a whole-script confusable; it is counted, but stays as it is.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.sources import materialise, table

# Letters of two other scripts that look like a Latin letter.
CYRILLIC = dict(zip("асԁеһіјӏоԛрѕуѵԝхАВСЕНІЈКМОРԚЅТУԜХ", "acdehijloqpsyvwxABCEHIJKMOPQSTYWX"))
GREEK = dict(zip("αινορυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aivopuABEZHIKMNOPTYX"))
LOOK_ALIKE = CYRILLIC | GREEK

_LATIN = "A-Za-zªºÀ-ÖØ-öø-ʯᴀ-ᵿḀ-ỿⱠ-ⱿꜢ-ꟊ"
_OTHER = "Ͱ-ͽΆ-ϿЀ-ԯἀ-῾ᲀ-᲏"
_MARKS = "̀-ͯ"
_LETTER = f"(?:[^\\W_]|[{_MARKS}])"
#: Whole words with a Latin letter and one of the two other scripts, whatever stands between; each word is read once.
_MIXED = re.compile(
    f"(?<![^\\W_])(?<![{_MARKS}])(?:[^\\W_{_LATIN}{_OTHER}]|[{_MARKS}])*+"
    f"(?:[{_LATIN}](?:[^\\W_{_OTHER}]|[{_MARKS}])*+[{_OTHER}]|[{_OTHER}](?:[^\\W_{_LATIN}]|[{_MARKS}])*+[{_LATIN}]){_LETTER}*+"
)
_WORD = re.compile(f"{_LETTER}+")
_HAS_LATIN = re.compile(f"[{_LATIN}]")
_FOREIGN = re.compile(f"[{_OTHER}]+")
_TO_LATIN = str.maketrans(LOOK_ALIKE)


def _forms() -> dict[int, str | None]:
    """What single characters become: by rule over the width and ligature forms, the blanks and the zero-width characters."""
    out: dict[int, str | None] = {}
    for cp in [*range(0x80, 0xFE00), *range(0xFE00, 0xFFF0)]:
        c = chr(cp)
        kind = unicodedata.decomposition(c).split(" ")[0]
        if unicodedata.category(c) == "Zs":
            out[cp] = " "
        elif kind in ("<wide>", "<narrow>") or kind == "<compat>" and "LIGATURE" in unicodedata.name(c, ""):
            out[cp] = unicodedata.normalize("NFKC", c)
    # Other blanks, and characters without width.
    out |= dict.fromkeys((0x09, 0x0B, 0x0C, 0x85), " ")
    out |= dict.fromkeys((0xAD, 0x34F, 0x180E, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0x2061, 0x2062, 0x2063, 0x2064, 0xFEFF))
    return out


def _special() -> re.Pattern[str]:
    """Runs of characters that ``_forms`` changes."""
    codes, spans = sorted(_forms()), []
    for cp in codes:
        if spans and spans[-1][1] == cp - 1:
            spans[-1][1] = cp
        else:
            spans.append([cp, cp])
    return re.compile("[" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in spans) + "]+")


_FORMS, _SPECIAL = _forms(), _special()


def _ordinary(text: str) -> str:
    return unicodedata.normalize("NFC", _SPECIAL.sub(lambda m: m.group().translate(_FORMS), text))


# Scripts that are written together have a common set.
_TOGETHER = {"Hiragana": {"Hiragana", "Japanese"}, "Katakana": {"Katakana", "Japanese"}, "Cjk": {"Cjk", "Japanese", "Korean", "Bopomofo"}, "Hangul": {"Hangul", "Korean"}, "Bopomofo": {"Bopomofo"}}


def _scripts(c: str) -> frozenset[str] | None:
    """The scripts of a letter, from its Unicode name; None for digits, accents and letters of all scripts."""
    if _HAS_LATIN.match(c):
        return frozenset(("Latin",))
    if _FOREIGN.match(c):
        return frozenset(("Cyrillic",) if "Ѐ" <= c <= "ԯ" or "ᲀ" <= c <= "᲏" else ("Greek",))
    if not c.isalpha():
        return None
    name = unicodedata.name(c, "").split(" ")[0].title()
    return frozenset(_TOGETHER.get(name, {name}))


def script_set(word: str) -> frozenset[str]:
    """The scripts in which every letter of the word is at home; all three of the look-alikes if nothing limits them."""
    found = None
    for c in word:
        own = _scripts(c)
        if own is not None:
            found = own if found is None else found & own
    return frozenset(("Latin", "Cyrillic", "Greek")) if found is None else found


def _settle(match: re.Match[str]) -> str:
    word = match.group()
    if script_set(word) or not _HAS_LATIN.search(word):
        return word
    return word.translate(_TO_LATIN)


def plain_text(text: str) -> str:
    """The one form of a text; see above. Idempotent."""
    text = _ordinary(text)
    if not text.isascii() and _FOREIGN.search(text):
        settled = _MIXED.sub(_settle, text)
        if settled != text:
            text = unicodedata.normalize("NFC", settled)
    return text


def confusable_words(text: str) -> tuple[int, int]:
    """Words of mixed scripts with a Latin spelling, and words wholly in look-alikes of another script."""
    mixed = whole = 0
    for word in _WORD.findall(_ordinary(text)):
        if _FOREIGN.search(word):
            if not script_set(word):
                mixed += word.translate(_TO_LATIN) != word and bool(_HAS_LATIN.search(word))
            elif not _FOREIGN.search(word.translate(_TO_LATIN)):
                whole += 1
    return mixed, whole


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def plain_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, plain, form, spelling) of ``docs`` (doc_id long, text string): plain text, its digest and that of the text.

    A null text has a null plain text and null digests; an empty one stays empty. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            plain = [None if t is None else plain_text(t) for t in texts]
            form = [None if t is None else _digest(t) for t in plain]
            spelling = [f if t is p else None if t is None else _digest(t) for t, p, f in zip(texts, plain, form)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(plain, pa.string()), pa.array(form, pa.binary()), pa.array(spelling, pa.binary())], ["doc_id", "plain", "form", "spelling"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, plain string, form binary, spelling binary")


def _filled(docs: DataFrame) -> DataFrame:
    forms = plain_texts(docs.where(F.col("doc_id").isNotNull()))
    return forms.where(F.col("plain").rlike("\\S")).select("doc_id", "form", "spelling")


def same_looking(docs: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b, of documents whose texts differ but whose plain texts are equal.

    Null, empty and blank texts pair with nothing; equal texts do not pair with each other.
    """
    forms = materialise(_filled(docs), "p8-forms")
    varied = forms.groupBy("form").agg(F.min("spelling").alias("lo"), F.max("spelling").alias("hi")).where("lo <> hi").select("form")
    kept = materialise(forms.join(varied, "form", "left_semi").distinct(), "p8-varied")
    spellings = kept.select("form", "spelling").distinct()
    x, y = spellings.withColumnRenamed("spelling", "x"), spellings.withColumnRenamed("spelling", "y")
    differing = x.join(y, "form").where("x < y")
    a = kept.select("form", F.col("spelling").alias("x"), F.col("doc_id").alias("a"))
    b = kept.select("form", F.col("spelling").alias("y"), F.col("doc_id").alias("b"))
    pairs = differing.join(a, ["form", "x"]).join(b, ["form", "y"])
    return pairs.where("a <> b").select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b"))


def p8_found(spark: SparkSession, data_dir: str) -> DataFrame:
    return same_looking(table(spark, data_dir, "documents"))


def p8_plain(spark: SparkSession, data_dir: str) -> DataFrame:
    """Every document's plain text, and the number of its words that are mixed-script and whole-script confusables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            plain = [None if t is None else plain_text(t) for t in texts]
            counts = [(0, 0) if t is None or t.isascii() else confusable_words(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(plain, pa.string()), pa.array([c[0] for c in counts], pa.int32()), pa.array([c[1] for c in counts], pa.int32())], ["doc_id", "plain", "mixed_words", "whole_words"])

    docs = table(spark, data_dir, "documents").select("doc_id", "text")
    return docs.mapInArrow(run, "doc_id long, plain string, mixed_words int, whole_words int")
