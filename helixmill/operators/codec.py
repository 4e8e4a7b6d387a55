"""The codec over tables: ranks are decimal strings, since they need over 200 bits; the tables are built once a task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.functions.language import Dispersal, Language

_DECODED = "rank string, payload string, choice int, status string"


def _shape(language: Language) -> tuple[int, int, int, int]:
    return language.length, language.gc_min, language.gc_max, language.max_run


def decode(df: DataFrame, language: Language, namespace: str, seq: str = "seq", bits: str = "bits") -> DataFrame:
    """``df`` without ``seq``, with ``rank``, ``payload``, ``choice`` and ``status`` of each word.

    Status: ``decoded``; ``no word`` for null, wrong length, alphabet, GC count or run; ``beyond`` for a rank outside the
    payloads' power of two; ``no width`` for null or negative selector bits. The score is not needed.
    """
    shape = _shape(language)
    rest = [c for c in df.columns if c != seq]
    at, wide = df.columns.index(seq), df.columns.index(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang = Language(*shape)
        way = Dispersal(lang.size, namespace)
        for batch in batches:
            out = []
            for word, r in zip(batch.column(at).to_pylist(), batch.column(wide).to_pylist()):
                rank = lang.rank(word)
                if rank is None:
                    out.append((None, None, None, "no word"))
                elif r is None or r < 0:
                    out.append((str(rank), None, None, "no width"))
                elif (logical := way.gather(rank)) is None:
                    out.append((str(rank), None, None, "beyond"))
                else:
                    out.append((str(rank), str(logical >> r), logical & ((1 << r) - 1), "decoded"))
            cols = list(zip(*out)) or [(), (), (), ()]
            more = [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i, c in enumerate(df_columns) if c != seq), *more], [*rest, "rank", "payload", "choice", "status"])

    df_columns = df.columns
    head = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in rest)
    return df.mapInArrow(run, f"{head}, {_DECODED}")


def roundtrip(df: DataFrame, language: Language, seq: str = "seq") -> DataFrame:
    """``df`` with ``again``, the word at the rank of its word; null where it is no word."""
    shape, at = _shape(language), df.columns.index(seq)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang = Language(*shape)
        for batch in batches:
            ranks = [lang.rank(w) for w in batch.column(at).to_pylist()]
            again = [None if r is None else lang.unrank(r) for r in ranks]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(again, pa.string())], [*names, "again"])

    names = df.columns
    return df.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in [*df.dtypes, ("again", "string")]))


def candidates(df: DataFrame, language: Language, namespace: str) -> DataFrame:
    """(record_id, bits, choice, seq, more...): the 2 ** bits members of each payload's fiber, expanded by Spark, one word each.

    ``df``: (record_id, payload_rank decimal string, bits, more...). Payloads beyond the domain have null words.
    """
    shape, more = _shape(language), [c for c in df.columns if c not in ("record_id", "payload_rank", "bits")]
    wide = df.select("record_id", "payload_rank", "bits", F.explode(F.sequence(F.lit(0), F.expr("shiftleft(1, bits)") - 1)).alias("choice"), *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang = Language(*shape)
        way = Dispersal(lang.size, namespace)
        for batch in batches:
            out = []
            for payload, r, choice in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                logical = (int(payload) << r) | choice
                out.append(lang.unrank(way.spread(logical)) if logical < 1 << way.bits else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(out, pa.string()), *batch.columns[4:]], ["record_id", "bits", "choice", "seq", *more])

    kinds = ", ".join(["record_id long, bits int, choice int, seq string", *(f"{c} {df.schema[c].dataType.simpleString()}" for c in more)])
    return wide.mapInArrow(run, kinds)
