"""Hamming separation of equally long sequences: pairs within a distance, and nearest neighbours of a query set.

``pairs_within`` never compares all pairs: by the pigeonhole principle two words within ``d`` substitutions agree on one of
``d + 1`` pieces, so an equi-join on piece and place finds every pair. A piece that many words share is cut again over the rest of
the word, and what is hot even then is compared in blocks. ``nearest`` compares a stated query set with all rows, in blocks.
Words travel as numbers of two bits a letter, and the distance is a few XORs and bit counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixmill.sources import materialise, partitions

BLOCK = 4096
HOT = 64
#: Queries and rows of the largest blocks of ``nearest``, and those compared at a time.
ASKED, GIVEN = 1 << 17, 1 << 16
NEAREST_QUERIES, NEAREST_ROWS = 8, 4096
_LOW_BITS = 0x5555555555555555
_LETTERS = 31


def packed(seq: str, length: int) -> dict[str, Column]:
    """Columns ``c0``, ``c1``...: 31 letters over A, C, G and T each, two bits a letter."""
    digits = F.translate(seq, "ACGT", "0123")
    return {f"c{i}": F.conv(F.substring(digits, i * _LETTERS + 1, _LETTERS), 4, 10).cast("long") for i in range(-(-length // _LETTERS))}


def _distance(words: int) -> Column:
    out = F.lit(0)
    for i in range(words):
        x = F.col(f"x{i}").bitwiseXOR(F.col(f"y{i}"))
        out = out + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(_LOW_BITS)))
    return out


def _pieces(seq: Column, length: Column, number: int, at: str, part: str) -> Column:
    edges = [F.floor(length * i / number).cast("int") for i in range(number + 1)]
    return F.array(*[F.struct(F.lit(i).alias(at), F.substring(seq, a + 1, b - a).alias(part)) for i, (a, b) in enumerate(zip(edges, edges[1:]))])


def _counted(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of shared keys only, with ``n``, how many share the key; written, since cold and hot rows go different ways."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return materialise(rows.join(sizes, keys), "pieces")


def _joined(rows: DataFrame, keys: list[str], words: int, most: int) -> DataFrame:
    a = rows.select(*keys, F.col("id").alias("id_a"), *[F.col(f"c{i}").alias(f"x{i}") for i in range(words)])
    b = rows.select(*keys, F.col("id").alias("id_b"), *[F.col(f"c{i}").alias(f"y{i}") for i in range(words)])
    return a.join(b, keys).where("id_a < id_b").select("id_a", "id_b", _distance(words).alias("distance")).where(F.col("distance") <= most)


def _codes(t: pa.Table, words: int) -> np.ndarray:
    return np.stack([t.column(f"c{i}").to_numpy().view(np.uint64) for i in range(words)], axis=1)


def _distances(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    x = many ^ one
    return np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(_LOW_BITS)).sum(axis=1).astype(np.int64)


def _in_blocks(rows: DataFrame, keys: list[str], words: int, most: int, block: int) -> DataFrame:
    """Pairs under hot keys: a key's rows are dealt into blocks, and each pair of blocks is a task's group of its own."""
    m = F.ceil(F.col("n") / block).cast("int")
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("id"), m).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), m - 1)))
    dealt = dealt.select(*keys, "id", *[f"c{i}" for i in range(words)], "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def compare(t: pa.Table) -> pa.Table:
        own, ids, codes = t.column("own").to_numpy(), t.column("id").to_numpy(), _codes(t, words)
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
        out = [np.zeros((0, 3), np.int64)]
        for k in a:
            distance = _distances(codes[k], codes[b])
            near = np.flatnonzero((distance <= most) & ((ids[b] > ids[k]) if i == j else (ids[b] != ids[k])))
            low, high = np.minimum(ids[k], ids[b][near]), np.maximum(ids[k], ids[b][near])
            out.append(np.stack([low, high, distance[near]], axis=1))
        found = np.concatenate(out)
        return pa.table({"id_a": found[:, 0], "id_b": found[:, 1], "distance": found[:, 2].astype(np.int32)})

    spread = dealt.repartition(partitions(rows.sparkSession), *keys, "i", "j")
    return spread.groupBy(*keys, "i", "j").applyInArrow(compare, "id_a long, id_b long, distance int")


def pairs_within(df: DataFrame, id_: str, seq: str, length: int, most: int, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """(id_a, id_b, distance), id_a < id_b, of rows of distinct sequences of ``length`` letters over A, C, G, T within ``most`` substitutions.

    A piece that more than ``hot`` words share does not join by itself: what is left of those words is cut into ``most + 1`` pieces
    too, one of which a pair within the distance must share; keys of two pieces that are hot still are compared in blocks. No pair is lost.
    """
    words = -(-length // _LETTERS)
    codes = [f"c{i}" for i in range(words)]
    rows = df.select(F.col(id_).alias("id"), F.col(seq).alias("seq")).withColumns(packed("seq", length))
    first = _counted(rows.select("id", "seq", *codes, F.inline(_pieces(F.col("seq"), F.lit(length), most + 1, "piece", "part"))), ["piece", "part"])
    found = _joined(first.where(F.col("n") <= hot), ["piece", "part"], words, most)
    at = F.floor(F.col("piece") * length / (most + 1)).cast("int")
    rest = F.concat(F.substring("seq", F.lit(1), at), F.substring("seq", at + F.length("part") + 1, F.lit(length)))  # the word without this piece
    again = first.where(F.col("n") > hot).select("id", *codes, "piece", "part", F.inline(_pieces(rest, F.length(rest), most + 1, "sub", "subpart")))
    keys = ["piece", "part", "sub", "subpart"]
    second = _counted(again, keys)
    found = found.unionByName(_joined(second.where(F.col("n") <= hot), keys, words, most))
    return found.unionByName(_in_blocks(second.where(F.col("n") > hot), keys, words, most, block)).distinct()


def _planes(codes: np.ndarray) -> np.ndarray:
    """Two rows for every two words of ``codes``: the lower and the higher bits of their letters, 62 to a word."""
    low = np.uint64(_LOW_BITS)
    codes = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
    planes = [c & low | (d & low) << np.uint64(1) for x, y in zip(codes.T[::2], codes.T[1::2]) for c, d in ((x, y), (x >> np.uint64(1), y >> np.uint64(1)))]
    return np.ascontiguousarray(planes).reshape(codes.shape[1], len(codes))


def _nearest(asked: np.ndarray, given: np.ndarray, same: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(distance, place) of the first of the nearest of ``given`` for each of ``asked``, both by planes; place ``same`` is the query itself, and -1 none.

    A distance over ``length`` means that there is no other. Some queries and rows at a time, so that what is compared stays in the cache.
    """
    kind = np.uint8 if length < 255 else np.uint16
    distance, place = np.full(asked.shape[1], length + 1, kind), np.zeros(asked.shape[1], np.int64)
    many, few = min(NEAREST_ROWS, given.shape[1]), min(NEAREST_QUERIES, asked.shape[1])
    x, y, d = np.empty((few, many), np.uint64), np.empty((few, many), np.uint64), np.empty((few, many), kind)
    part = np.empty((few, many), np.uint8)
    for low in range(0, given.shape[1], NEAREST_ROWS):
        rows = given[:, low : low + NEAREST_ROWS]
        n = rows.shape[1]
        for first in range(0, asked.shape[1], NEAREST_QUERIES):
            own = asked[:, first : first + NEAREST_QUERIES, None]
            q = own.shape[1]
            u, v, e, f = x[:q, :n], y[:q, :n], d[:q, :n], part[:q, :n]
            for i in range(0, len(rows), 2):
                np.bitwise_xor(own[i], rows[i], out=u)
                np.bitwise_xor(own[i + 1], rows[i + 1], out=v)
                np.bitwise_or(u, v, out=u)
                if i:
                    np.bitwise_count(u, out=f)
                    np.add(e, f, out=e)
                else:
                    np.bitwise_count(u, out=f)
                    e[...] = f
            here = same[first : first + q] - low
            itself = np.flatnonzero((here >= 0) & (here < n))
            e[itself, here[itself]] = length + 1
            at = e.argmin(axis=1)
            least = e[np.arange(q), at]
            better = least < distance[first : first + q]
            distance[first : first + q][better] = least[better]
            place[first : first + q][better] = low + at[better]
    return distance.astype(np.int64), place


def nearest(queries: DataFrame, rows: DataFrame, id_: str, seq: str, length: int, group: tuple[str, ...] = ()) -> DataFrame:
    """(group..., query, distance, neighbour): the nearest other row of each query in its group, the least id on ties.

    Queries and rows, (id long, sequence of ``length`` letters over A, C, G and T), are each cut into blocks of at most some ``ASKED`` and ``GIVEN`` by
    the hash of their id, and every pair of blocks is compared in a task of its own, whose best per query is all it gives out. Every row is
    shuffled once a block of queries, so those are large; blocks of rows are smaller where the cluster can work on more of them.
    """
    words = -(-length // _LETTERS)
    codes, by = [f"c{i}" for i in range(words)], list(group)
    tasks = partitions(queries.sparkSession)
    n, size = max(1, -(-queries.count() // ASKED)), rows.count()
    m = max(1, -(-size // GIVEN), min(-(-size // BLOCK), -(-4 * tasks // n)))
    cut = lambda df, k: df.select(*by, F.col(id_).alias("id"), F.col(seq).alias("seq")).withColumns(packed("seq", length)).select(*by, "id", *codes, F.pmod(F.xxhash64("id"), F.lit(k)).cast("int").alias("own"))
    asked = cut(queries, n).select(*by, F.lit(True).alias("asked"), "id", *codes, F.col("own").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("j"))
    given = cut(rows, m).select(*by, F.lit(False).alias("asked"), "id", *codes, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"), F.col("own").alias("j"))

    def best(t: pa.Table) -> pa.Table:
        asks, ids, coded = t.column("asked").to_numpy(), t.column("id").to_numpy(), _codes(t, words)
        a, b = np.flatnonzero(asks), np.flatnonzero(~asks)
        out = np.zeros((0, 3), np.int64)
        if len(a) and len(b):
            b = b[np.argsort(ids[b])]
            spot = np.minimum(np.searchsorted(ids[b], ids[a]), len(b) - 1)
            distance, at = _nearest(_planes(coded[a]), _planes(coded[b]), np.where(ids[b[spot]] == ids[a], spot, -1), length)
            out = np.stack([ids[a], distance, ids[b[at]]], axis=1)[distance <= length]
        named = {g: pa.array([t.column(g)[0].as_py()] * len(out), t.schema.field(g).type) for g in by}
        return pa.table(named | {c: pa.array(out[:, i]) for i, c in enumerate(("query", "distance", "neighbour"))})

    both = asked.unionByName(given).repartition(min(n * m, 64 * tasks), *by, "i", "j")  # a number of its own: the blocks cost more than their bytes
    head = "".join(f"{g} {queries.schema[g].dataType.simpleString()}, " for g in by)
    found = both.groupBy(*by, "i", "j").applyInArrow(best, head + "query long, distance long, neighbour long")
    top = found.groupBy(*by, "query").agg(F.min(F.struct("distance", "neighbour")).alias("m"))
    return top.select(*by, "query", "m.distance", "m.neighbour")
