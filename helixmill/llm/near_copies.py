"""Problem 1: records whose sequences share most of their 6-letter substrings, by a multi-index Hamming join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.functions.names import normal_sequence
from helixmill.llm import hamming
from helixmill.llm.letters import anchored, close_matrix, codes6, flat, jaccard6, may_share, mix, rolling, starts
from helixmill.llm.stretches import stretch_pairs
from helixmill.sources import materialise, table

SHINGLE = 6
THRESHOLD = 0.5
#: First index: the 13-letter words at anchors; every stretch of 15 letters holds one, with two neighbours left, one on either side, or two right.
WORD, WINDOW, ANCHOR = 13, 3, 4
STRETCHES = (0o7700, 0o0770, 0o0077)
#: Runs of rows with one stretch are compared exhaustively up to ``MIDDLE`` rows (those of up to ``CAP`` many at a time); rows under longer ones go to the second index.
CAP, MIDDLE = 64, 1024
#: Second index, for short sequences and for rows under hot keys: 48 symbols, least hashes of all 6-letter substrings under as many
#: functions; pairs that agree in 3 of 6 symbols of one of 8 chunks (so all that differ in at most 31).
FINE_SYMBOLS, FINE_CHUNKS, FINE_DISTANCE, FINE_CAP = 48, 8, 31, 500
#: Further symbols of which a run compares short tags, and those that may differ: of pairs with a similarity of one half, 18 agree but
#: for some 4 in 100,000.
TAG_SYMBOLS, TAG_DISTANCE = 64, 46
#: Texts in a block where a run of over ``FINE_CAP`` rows is compared exhaustively.
BLOCK = 4096
#: Sequences with fewer 6-letter substrings go to the second index too, as does every row with a stretch of over ``MIDDLE`` rows in the first.
SHORT = 100


def stretch_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(row, key, tag) of the first index: one key for each anchored word of a text, none where a word repeats the one before.

    The tag holds the two letters on either side of the word, three bits each, 0 beyond the text.
    """
    data, offsets = flat(texts)
    row, at = anchored(data, offsets, WORD, WINDOW, ANCHOR)
    if not len(at):
        return row, at, [at]
    key = mix(rolling(data, WORD)[at])
    near = np.zeros(len(at), np.int64)
    for step in (-2, -1, WORD, WORD + 1):
        place = at + step
        inside = (place >= offsets[row]) & (place < offsets[row + 1])
        near = near << 3 | np.where(inside, data[np.where(inside, place, 0)] & 7, 0)
    new = np.r_[True, (key[1:] != key[:-1]) | (row[1:] != row[:-1])]
    return row[new], key[new].view(np.int64), [near[new]]


def same_stretch(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Do two rows with an equal word share one of the three stretches of 15 letters around it? True for all that do."""
    differ = x ^ y
    return np.logical_or.reduce([differ & mask == 0 for mask in STRETCHES])


def shingle_signature(texts: pa.Array) -> np.ndarray:
    """Least hash of the 6-letter substrings under each of 112 functions; absent where there are none."""
    data, offsets = flat(texts)
    rows, at = starts(offsets, SHINGLE)
    base = codes6(data)[at].astype(np.uint64)
    out = np.full((len(offsets) - 1, FINE_SYMBOLS + TAG_SYMBOLS), hamming.ABSENT)
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, np.int64)
    for s in range(out.shape[1] if len(rows) else 0):
        out[rows[first], s] = np.minimum.reduceat(mix(base + np.uint64((s + 1) << 32)), first)
    return out


def _close(left: pa.Array, right: pa.Array) -> np.ndarray:
    out = may_share(left, right, THRESHOLD)
    some = pa.array(np.flatnonzero(out))
    common, union = jaccard6(left.take(some), right.take(some))
    out[out] = common >= THRESHOLD * union
    return out


def similar_pairs(classes: DataFrame) -> DataFrame:
    """(a, b), a < b, of the classes (id long, text string, unique) with a shingle similarity of at least one half.

    Empty texts and those under 6 letters have no shingles and never pair. An empty table gives an empty result.
    """
    first = stretch_pairs(classes, stretch_keys, STRETCHES, MIDDLE, CAP, THRESHOLD)
    hotter = first.where("b is null").select(F.col("a").alias("id")).distinct()
    close = lambda x, y: close_matrix(x, y, THRESHOLD)
    short = F.length("text") - SHINGLE + 1 < SHORT
    fine = materialise(classes.where(short).unionByName(classes.where(~short).join(hotter, "id", "left_semi")), "p1-fine")
    tagged = hamming.index_rows(fine, shingle_signature, FINE_CHUNKS, FINE_DISTANCE, FINE_CAP, FINE_SYMBOLS, TAG_SYMBOLS // 16)
    again = materialise(hamming.run_pairs(tagged, FINE_CAP, hamming.within_distance(TAG_SYMBOLS, TAG_DISTANCE)), "p1-second")
    left = again.where("b is null").select(F.col("a").alias("id")).distinct()
    long = fine.join(left, "id", "left_semi")
    keys = hamming.index_rows(long, shingle_signature, FINE_CHUNKS, FINE_DISTANCE, 1 << 40, FINE_SYMBOLS).select("key", "id")
    rest = hamming.block_pairs(keys, long, BLOCK, close, FINE_CAP)
    pairs = first.where("b is not null").unionByName(again.where("b is not null")).unionByName(rest).distinct()
    both = pairs.join(classes.select(F.col("id").alias("a"), F.col("text").alias("x")), "a").join(classes.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")

    def check(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(_close(batch.column(2), batch.column(3)))).select([0, 1])

    return both.select("a", "b", "x", "y").mapInArrow(check, hamming.PAIRS)


def near_copies(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes of equal normal sequences, members of the classes of several records, and links between classes.

    ``records``: record_id long, sequence string; further columns are ignored. Null sequences, those of fewer than 6 letters
    and null ids are left out; a record delivered again counts once. An id names one sequence. Classes: (id, text, last), id the least record_id. Members:
    (id, record_id), only for classes with more than one record. Links: (a, b) of classes with a similarity of 0.5 or more.
    """
    clean = records.select("record_id", normal_sequence("sequence").alias("text")).where(F.col("record_id").isNotNull() & (F.length("text") >= SHINGLE))
    classes = materialise(clean.groupBy("text").agg(F.min("record_id").alias("id"), F.max("record_id").alias("last")).select("id", "text", "last"), "p1-classes")
    several = classes.where("id < last").select("id", "text")
    members = materialise(clean.join(several, "text").select("id", "record_id").distinct(), "p1-members")
    return classes, members, similar_pairs(classes.select("id", "text"))


def records_of(spark: SparkSession, data_dir: str) -> DataFrame:
    cols = ("record_id", "sequence")
    return table(spark, data_dir, "emitted_crc16_codewords").select(*cols).unionByName(table(spark, data_dir, "generated_selected_samples").select(*cols))


def p1_found(spark: SparkSession, data_dir: str) -> DataFrame:
    """All pairs of record ids: equal sequences, and every pair of records of two linked classes."""
    classes, members, links = near_copies(records_of(spark, data_dir))
    x, y = members.select("id", F.col("record_id").alias("p")), members.select("id", F.col("record_id").alias("q"))
    equal = x.join(y, "id").where("p < q").select("p", "q")
    wide = links.join(x.withColumnRenamed("id", "a"), "a", "left").join(y.withColumnRenamed("id", "b"), "b", "left")
    wide = wide.select(F.coalesce("p", "a").alias("p"), F.coalesce("q", "b").alias("q"))
    return equal.unionByName(wide).select(F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b"))


def p1_groups(spark: SparkSession, data_dir: str) -> DataFrame:
    """One row per record: its class, the records in the class, and the number of classes linked to it."""
    classes, members, links = near_copies(records_of(spark, data_dir))
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
    size = members.groupBy("id").agg(F.count("*").alias("records"))
    alone = classes.where("id = last").select("id", F.col("id").alias("record_id"))
    return (
        members.unionByName(alone)
        .join(size, "id", "left")
        .join(degree, "id", "left")
        .select("record_id", F.col("id").alias("class_id"), F.coalesce("records", F.lit(1).cast("long")).alias("records"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))
    )


_SEQ = "replace(upper(regexp_replace(sequence, '[^A-Za-z]', '', 'g')), 'U', 'T')"
_LINKS = f"""WITH r AS (SELECT DISTINCT record_id, {_SEQ} AS text FROM (SELECT record_id, sequence FROM emitted_crc16_codewords UNION ALL SELECT record_id, sequence FROM generated_selected_samples)
  WHERE record_id IS NOT NULL AND length({_SEQ}) >= 6),
c AS (SELECT text, min(record_id) AS id FROM r GROUP BY text),
k AS (SELECT DISTINCT id, substr(text, i, 6) AS w FROM (SELECT id, text, unnest(range(1, length(text) - 4)) AS i FROM c)),
n AS (SELECT id, count(*) AS n FROM k GROUP BY id),
s AS (SELECT x.id AS a, y.id AS b, count(*) AS i FROM k x JOIN k y ON x.w = y.w AND x.id < y.id GROUP BY x.id, y.id),
links AS (SELECT a, b FROM s JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE 3 * i >= p.n + q.n),
m AS (SELECT id, record_id FROM r JOIN c USING (text))
"""
P1_FOUND_SQL = f"""
{_LINKS}, near AS (SELECT a, b FROM links UNION ALL SELECT id, id FROM c)
SELECT DISTINCT least(x.record_id, y.record_id) AS id_a, greatest(x.record_id, y.record_id) AS id_b FROM near JOIN m x ON x.id = a JOIN m y ON y.id = b WHERE x.record_id <> y.record_id
"""
P1_GROUPS_SQL = f"""
{_LINKS}, d AS (SELECT id, count(*) AS links FROM (SELECT a AS id FROM links UNION ALL SELECT b FROM links) GROUP BY id), z AS (SELECT id, count(*) AS records FROM m GROUP BY id)
SELECT record_id, m.id AS class_id, records, coalesce(links, 0) AS links FROM m JOIN z USING (id) LEFT JOIN d USING (id)
"""
