"""Problem 3: sequences of one split that occur, exactly or almost, in the other, by a sparse suffix array.

Two texts within four edits share a stretch of at least a fifth of the shorter one's letters (pigeonhole over five pieces). The suffix
array holds the suffixes at the least hash among ``w`` neighbouring places, where ``k + w - 1`` is that stretch, so both texts have the suffix at
one place of it, and the two have a common prefix of ``k`` letters. The array is sorted in ranges; neighbours are compared, and the
texts of different splits in a run of common prefixes of ``k`` letters are candidates, checked by 6-letter counts and a banded edit distance.

Coverage takes the suffix at every place. Neighbours with a common prefix of ``SPAN`` letters or more, from both splits, reveal a shared
span; a longer one is the union of those at its places, and each record's spans are merged.

Lengths are cut into tiers, since the stretch to be shared depends on the length. Texts under 40 letters, which may share next to
nothing, and texts under a prefix that more than ``CAP`` texts share are compared exhaustively, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.functions.names import digest_key, name_key, normal_sequence, reverse_complement
from helixmill.llm import hamming, suffixes
from helixmill.llm.letters import bit_sets, flat
from helixmill.sources import materialise, table

EDITS = 4
#: (least length, k, w) of each tier, with k + w - 1 a fifth of the least length; each reaches to the next one's least.
TIERS = ((40, 6, 3), (80, 12, 5), (100, 16, 5), (145, 22, 8), (300, 24, 37), (1000, 24, 177))
CAP, BLOCK = 64, 500
#: Letters that a shared span has at least, for coverage.
SPAN = 20
#: Splits that are compared at a time, a bit for each in a mask.
SPLITS_AT_ONCE = 30


def within_edits(left: list[bytes], right: list[bytes], most: int = EDITS) -> np.ndarray:
    """For each pair of texts: can ``most`` insertions, deletions and substitutions turn one into the other?"""
    out = np.zeros(len(left), bool)
    la, lb = np.array([len(x) for x in left], np.int64), np.array([len(x) for x in right], np.int64)
    todo = np.flatnonzero(np.abs(la - lb) <= most)
    todo = todo[np.argsort(la[todo], kind="stable")]
    begin = 0
    while begin < len(todo):
        step = max(1, min(8192, 4_000_000 // int(la[todo[min(begin + 8192, len(todo)) - 1]] + 1)))
        part = todo[begin : begin + step]
        begin += len(part)
        wide = int(la[part].max())
        a, b = np.zeros((len(part), wide), np.uint8), np.full((len(part), wide + 2 * most + 1), 1, np.uint8)
        for i, p in enumerate(part):
            a[i, : la[p]] = np.frombuffer(left[p], np.uint8)
            b[i, most : most + lb[p]] = np.frombuffer(right[p], np.uint8)
        d = np.full((len(part), 2 * most + 3), 99, np.int16)
        d[:, most + 1 :] = np.minimum(np.arange(most + 2), 99)
        d[:, -1] = 99
        end, diagonal = la[part], lb[part] - la[part] + most + 1
        out[part[end == 0]] = d[np.flatnonzero(end == 0), diagonal[end == 0]] <= most
        for i in range(wide):
            new = np.full_like(d, 99)
            new[:, 1:-1] = np.minimum(d[:, 1:-1] + (a[:, i : i + 1] != b[:, i : i + 2 * most + 1]), d[:, 2:] + 1)
            for c in range(1, 2 * most + 2):
                column = i + 1 + c - 1 - most  # letters of the right text used on this diagonal
                if column < 0:
                    new[:, c] = 99
                elif column > 0:
                    new[:, c] = np.minimum(new[:, c], new[:, c - 1] + 1)
            d = new
            now = np.flatnonzero(end == i + 1)
            out[part[now]] = d[now, diagonal[now]] <= most
    return out


def _reverse(texts: pa.Array) -> pa.Array:
    data, offsets = flat(texts)
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(suffixes.reversed_rows(data, offsets)))


def almost_equal(left: pa.Array, right: pa.Array) -> np.ndarray:
    """For each pair: at most four edits from one text to the other or to its reverse complement?

    Each edit changes at most six of the 6-letter substrings, so all but 24 of either text's must occur in the other.
    """
    out = np.zeros(len(left), bool)
    for begin in range(0, len(left), 4096):
        x, y = left.slice(begin, 4096), right.slice(begin, 4096)
        a, ao = bit_sets(*flat(x))
        for other in (y, _reverse(y)):
            b, bo = bit_sets(*flat(other))
            common = np.bitwise_count(a & b).sum(axis=1)
            near = ao | bo | ((np.bitwise_count(a).sum(axis=1) - common <= 6 * EDITS) & (np.bitwise_count(b).sum(axis=1) - common <= 6 * EDITS))
            todo = np.flatnonzero(near & ~out[begin : begin + len(x)])
            if len(todo):
                p, q = (t.take(pa.array(todo)).cast(pa.binary()).to_pylist() for t in (x, other))
                out[begin + todo] = within_edits(p, q)
    return out


def _almost_matrix(left: pa.Array, right: pa.Array) -> np.ndarray:
    """The same for every text of ``left`` against every one of ``right``."""
    out = np.zeros((len(left), len(right)), bool)
    (a, ao), la = bit_sets(*flat(left)), np.diff(flat(left)[1])
    na = np.bitwise_count(a).sum(axis=1)
    own = left.cast(pa.binary()).to_pylist()
    for other in (right, _reverse(right)):
        (b, bo), lb = bit_sets(*flat(other)), np.diff(flat(other)[1])
        nb, theirs = np.bitwise_count(b).sum(axis=1), other.cast(pa.binary()).to_pylist()
        todo = np.zeros(out.shape, bool)
        for i in range(len(left)):
            common = np.bitwise_count(a[i] & b).sum(axis=1)
            near = ao[i] | bo | ((na[i] - common <= 6 * EDITS) & (nb - common <= 6 * EDITS))
            todo[i] = near & (np.abs(la[i] - lb) <= EDITS) & ~out[i]
        x, y = np.nonzero(todo)
        out[x, y] = within_edits([own[i] for i in x], [theirs[j] for j in y])
    return out


def close_classes(classes: DataFrame, reach: dict[int, int]) -> DataFrame:
    """(a, b), a < b, of classes (id long, text string, mask int) within four edits on either strand and of joined splits.

    ``mask`` has a bit for each split that holds the text; ``reach`` gives the splits that each split is compared with.
    """

    def allow(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        wide = np.zeros(len(x), np.int64)
        for bit, mask in reach.items():
            wide |= np.where((x >> (32 + bit)) & 1, mask, 0)
        low = (1 << 32) - 1
        return (wide & (y >> 32) != 0) & (np.abs((x & low) - (y & low)) <= EDITS)

    array = suffixes.sparse(classes, TIERS, EDITS, CAP)
    spans = materialise(suffixes.adjacent_pairs(array, TIERS, CAP, allow), "p3-spans")
    hot = classes.join(spans.where("b is null").select(F.col("a").alias("id")).distinct(), "id", "left_semi")
    short = classes.where(F.length("text") < TIERS[0][0] + EDITS)
    lengths = short.select(F.explode(F.sequence(F.lit(0), F.lit(1))).alias("step"), "id", (F.length("text") / (EDITS + 1)).cast("long").alias("group"))
    texts = classes.select("id", "text")
    prefixes = suffixes.sparse(hot, TIERS, EDITS, 1 << 40).select(F.xxhash64(*suffixes.prefix_columns(TIERS)).alias("key"), "id")
    rest = hamming.block_pairs(prefixes, texts, BLOCK, _almost_matrix, CAP)
    few = hamming.block_pairs(lengths.select((F.col("group") + F.col("step")).alias("key"), "id"), texts, BLOCK, _almost_matrix, 1)
    pairs = spans.where("b is not null").unionByName(rest).unionByName(few).distinct()
    both = pairs.join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(almost_equal(batch.column(2), batch.column(3)))).select([0, 1])

    return both.select("a", "b", "x", "y").mapInArrow(check, hamming.PAIRS)


def directions(spark: SparkSession, data_dir: str) -> DataFrame:
    """(direction, name, source, target): each direction once, with the keys of its name and splits."""
    t = table(spark, data_dir, "public_fiber_results")
    return t.select("direction", name_key("direction").alias("name"), name_key("source_pool").alias("source"), name_key("target_pool").alias("target")).na.drop().distinct()


def samples(spark: SparkSession, data_dir: str) -> DataFrame:
    """(record_id, pool, text) of the generated samples, each once, with normal sequences of six letters or more."""
    t = table(spark, data_dir, "generated_selected_samples")
    rows = t.select("record_id", name_key("selector_source_pool").alias("pool"), normal_sequence("sequence").alias("text"))
    return rows.where(F.col("record_id").isNotNull() & F.col("pool").isNotNull() & (F.length("text") >= 6)).distinct()


def cross_split(rows: DataFrame, ways: DataFrame) -> DataFrame:
    """(direction, s, t): record ``s`` of a direction's source split and ``t`` of its target split within four edits.

    ``rows``: (record_id, pool, text), distinct; ``ways``: (direction, source, target), the fixed table of directions. Equal texts
    are gathered into classes first, and only classes are compared.
    """
    groups = split_groups(ways)
    return reduce(DataFrame.unionByName, [_cross_split(rows, ways, group) for group in groups]) if groups else _cross_split(rows, ways, [])


def split_groups(ways: DataFrame) -> list[list[tuple[str, str]]]:
    """The (source, target) pairs of the fixed table of directions, in groups of at most ``SPLITS_AT_ONCE`` splits."""
    groups: list[list[tuple[str, str]]] = []
    for way in sorted((r["source"], r["target"]) for r in ways.select("source", "target").distinct().toLocalIterator()):
        if not groups or len({p for w in [*groups[-1], way] for p in w}) > SPLITS_AT_ONCE:
            groups.append([])
        groups[-1].append(way)
    return groups


def _cross_split(rows: DataFrame, ways: DataFrame, pools: list[tuple[str, str]]) -> DataFrame:
    bit = {p: i for i, p in enumerate(sorted({p for way in pools for p in way}))}
    reach = dict.fromkeys(bit.values(), 0)
    for s, t in pools:
        reach[bit[s]] |= 1 << bit[t]
        reach[bit[t]] |= 1 << bit[s]
    number = F.coalesce(*[F.when(F.col("pool") == p, F.lit(1 << i)) for p, i in bit.items()], F.lit(0))
    inside = rows.where(number > 0)
    classes = materialise(inside.groupBy("text").agg(F.min("record_id").alias("id"), F.bit_or(number).alias("mask")).select("id", "text", "mask"), "p3-classes")
    members = materialise(inside.join(classes.select("text", "id"), "text").select("id", "pool", "record_id"), "p3-members")
    links = close_classes(classes, reach)
    near = links.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("p")).select("p.*")
    pairs = near.unionByName(classes.where(F.bit_count("mask") > 1).select(F.col("id").alias("x"), F.col("id").alias("y")))
    source = members.select(F.col("id").alias("x"), F.col("pool").alias("source"), F.col("record_id").alias("s"))
    target = members.select(F.col("id").alias("y"), F.col("pool").alias("target"), F.col("record_id").alias("t"))
    ways = ways.where(_among(pools))
    return pairs.join(source, "x").join(ways, "source").join(target, ["y", "target"]).where("s <> t").select("direction", "s", "t")


def _among(pools: list[tuple[str, str]]) -> Column:
    return reduce(lambda c, way: c | ((F.col("source") == way[0]) & (F.col("target") == way[1])), pools, F.lit(False))


def digest_overlaps(public: DataFrame, rows: DataFrame, ways: DataFrame) -> DataFrame:
    """(direction, s, t): sample ``s`` of a direction's source split whose normal sequence, or its reverse complement, has the digest of ``t``.

    ``public``: (record_id, name, digest), the name being a direction's; null digests match nothing.
    """
    own = rows.select("record_id", "pool", F.explode(F.array_distinct(F.array(F.sha2("text", 256), F.sha2(reverse_complement("text"), 256)))).alias("digest"))
    source = own.join(ways.select("direction", "name", F.col("source").alias("pool")), "pool").select("direction", "name", "digest", F.col("record_id").alias("s"))
    target = public.select("name", "digest", F.col("record_id").alias("t")).where("digest is not null").distinct()
    return target.join(source, ["name", "digest"]).select("direction", "s", "t")


def overlaps(spark: SparkSession, data_dir: str) -> DataFrame:
    """(direction, kind, s, t) of both kinds of overlaps."""
    ways, rows = directions(spark, data_dir), samples(spark, data_dir)
    public = table(spark, data_dir, "public_fiber_selected_samples").select("record_id", name_key("direction").alias("name"), digest_key("sequence_sha256").alias("digest"))
    near = cross_split(rows, ways.select("direction", "source", "target")).withColumn("kind", F.lit("sequence"))
    return near.unionByName(digest_overlaps(public.where("record_id is not null"), rows, ways).withColumn("kind", F.lit("digest")))


def p3_found(spark: SparkSession, data_dir: str) -> DataFrame:
    return overlaps(spark, data_dir).select("direction", F.least("s", "t").alias("id_a"), F.greatest("s", "t").alias("id_b")).distinct()


def p3_report(spark: SparkSession, data_dir: str) -> DataFrame:
    """For each direction, pool of the evaluation record and kind: the pairs, and the distinct records on either side."""
    ways = directions(spark, data_dir).select("direction", "source", "target")
    found = overlaps(spark, data_dir).join(ways, "direction")
    return found.groupBy("direction", "source", "target", "kind").agg(
        F.count("*").alias("pairs"), F.countDistinct("t").alias("target_records"), F.countDistinct("s").alias("source_records")
    )


def places(classes: DataFrame) -> DataFrame:
    """(hi, lo, id, mask, at, letters) of the suffixes at all places of ``classes`` (id, text, mask), cut to ``SPAN`` letters.

    Texts of fewer letters have one suffix, the whole text, which no longer one equals.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, mask = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            letters = np.minimum(np.diff(flat(batch.column(1))[1]), SPAN)
            for k in np.unique(letters[letters > 0]).tolist():
                inside = np.flatnonzero(letters == k)
                data, offsets = flat(batch.column(1).take(pa.array(inside)))
                rows, at, _, place = suffixes.strands(data, offsets, k)
                hi, lo = suffixes.words(data, offsets, rows, place, k)
                cols = [hi, lo, ids[inside[rows]], mask[inside[rows]].astype(np.int32), (at - offsets[rows]).astype(np.int32), np.full(len(at), k, np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["hi", "lo", "id", "mask", "at", "letters"])

    return classes.select("id", "text", "mask").mapInArrow(run, "hi long, lo long, id long, mask int, at int, letters int")


def coverage(rows: DataFrame, ways: DataFrame) -> DataFrame:
    """(direction, record_id, covered_letters): letters of target samples in spans that a text of the source split holds too.

    A span has ``SPAN`` letters or more, on either strand; a shorter text is covered if the source split has the same text. Only
    covered samples have a row. ``rows`` and ``ways`` as in ``cross_split``.
    """
    groups = split_groups(ways)
    return reduce(DataFrame.unionByName, [_coverage(rows, ways, group) for group in groups]) if groups else _coverage(rows, ways, [])


def _coverage(rows: DataFrame, ways: DataFrame, pools: list[tuple[str, str]]) -> DataFrame:
    bit = {p: i for i, p in enumerate(sorted({p for way in pools for p in way}))}
    number = lambda c: F.coalesce(*[F.when(F.col(c) == p, F.lit(1 << i)) for p, i in bit.items()], F.lit(0))
    inside = rows.where(number("pool") > 0)
    classes = materialise(inside.groupBy("text").agg(F.min("record_id").alias("id"), F.bit_or(number("pool")).alias("mask")).select("id", "text", "mask"), "p3-coverage-classes")
    both = F.lit(False)
    for s, t in pools:
        both = both | (F.col("there").bitwiseAND(1 << bit[s] | 1 << bit[t]) == (1 << bit[s] | 1 << bit[t]))
    all_places = places(classes)
    shared = all_places.groupBy("hi", "lo").agg(F.bit_or("mask").alias("there")).where(both)
    spans = all_places.join(shared, ["hi", "lo"]).groupBy("id", "mask").agg(F.sort_array(F.collect_list(F.struct("at", (F.col("at") + F.col("letters")).alias("to"), "there"))).alias("spans"))  # at most the letters of one text
    way = F.broadcast(ways.where(_among(pools)).select("direction", F.col("target").alias("pool"), number("source").alias("from"), number("target").alias("into")).distinct())
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("covered"))
    add = lambda acc, s: F.struct(F.greatest(acc["end"], s["to"]).alias("end"), (acc["covered"] + F.greatest(s["to"] - F.greatest(acc["end"], s["at"]), F.lit(0))).alias("covered"))
    theirs = F.filter("spans", lambda s: s["there"].bitwiseAND(F.col("from")) != 0)
    covered = spans.join(way, F.col("mask").bitwiseAND(F.col("into")) != 0).select("id", "direction", "pool", F.aggregate(theirs, start, add)["covered"].alias("covered_letters"))
    members = inside.join(classes.select("text", "id"), "text").select("id", "pool", "record_id").distinct()
    return covered.where("covered_letters > 0").join(members, ["id", "pool"]).select("direction", "record_id", "covered_letters")


def p3_coverage(spark: SparkSession, data_dir: str) -> DataFrame:
    """Letters of each target sample that lie in spans shared with the source split, per direction: spans merged, not pairs."""
    return coverage(samples(spark, data_dir), directions(spark, data_dir).select("direction", "source", "target"))


_SEQ = "replace(upper(regexp_replace(sequence, '[^A-Za-z]', '', 'g')), 'U', 'T')"
_NAME = "lower(trim({}, chr(32) || chr(9) || chr(13) || chr(10)))"
_BACK = "translate(reverse({}), 'ACGT', 'TGCA')"
_PAIRS_SQL = f"""WITH ways AS (SELECT DISTINCT direction, {_NAME.format("direction")} AS name, {_NAME.format("source_pool")} AS source, {_NAME.format("target_pool")} AS target FROM public_fiber_results),
r AS (SELECT DISTINCT record_id, {_NAME.format("selector_source_pool")} AS pool, {_SEQ} AS text FROM generated_selected_samples WHERE record_id IS NOT NULL AND length({_SEQ}) >= 6),
t AS (SELECT text, min(record_id) AS id FROM r GROUP BY text),
f AS (SELECT id, 0 AS back, text AS form FROM t UNION ALL SELECT id, 1, {_BACK.format("text")} FROM t),
k AS (SELECT DISTINCT id, back, substr(form, i, 6) AS w FROM (SELECT id, back, form, unnest(range(1, length(form) - 4)) AS i FROM f)),
n AS (SELECT id, count(*) AS n FROM k WHERE back = 0 GROUP BY id),
s AS (SELECT p.id AS x, q.id AS y, q.back, count(*) AS i FROM (SELECT * FROM k WHERE back = 0) p JOIN k q ON p.w = q.w GROUP BY ALL),
c AS (SELECT x, y, back FROM s JOIN n p ON p.id = x JOIN n q ON q.id = y WHERE i >= greatest(p.n, q.n) - 6 * {EDITS}
  UNION SELECT p.id, q.id, back FROM n p JOIN n q ON p.n <= 6 * {EDITS} AND q.n <= 6 * {EDITS} JOIN f ON f.id = q.id),
near AS (SELECT DISTINCT p.text AS x, q.text AS y FROM c JOIN t p ON p.id = x JOIN f ON f.id = y AND f.back = c.back JOIN t q ON q.id = y
  WHERE length(p.text) - length(q.text) BETWEEN -{EDITS} AND {EDITS} AND levenshtein(p.text, f.form) <= {EDITS}),
a AS (SELECT direction, s.record_id AS s, e.record_id AS t FROM near JOIN r s ON s.text = x JOIN r e ON e.text = y JOIN ways ON source = s.pool AND target = e.pool WHERE s.record_id <> e.record_id),
p AS (SELECT DISTINCT record_id, {_NAME.format("direction")} AS name, regexp_replace({_NAME.format("sequence_sha256")}, '^(sha256:|0x)', '') AS digest FROM public_fiber_selected_samples),
b AS (SELECT ways.direction, r.record_id AS s, p.record_id AS t FROM p JOIN ways USING (name) JOIN r ON r.pool = source WHERE p.digest IN (sha256(r.text), sha256({_BACK.format("r.text")})))
"""
P3_FOUND_SQL = f"{_PAIRS_SQL} SELECT DISTINCT direction, least(s, t) AS id_a, greatest(s, t) AS id_b FROM (SELECT * FROM a UNION ALL SELECT * FROM b)"
P3_REPORT_SQL = f"""
{_PAIRS_SQL}, o AS (SELECT *, 'sequence' AS kind FROM a UNION ALL SELECT *, 'digest' FROM b)
SELECT direction, source, target, kind, count(*) AS pairs, count(DISTINCT t) AS target_records, count(DISTINCT s) AS source_records FROM o JOIN ways USING (direction) GROUP BY ALL
"""
P3_COVERAGE_SQL = f"""
{_PAIRS_SQL}, i AS (SELECT *, unnest(range(1, greatest(length(text) - {SPAN}, 0) + 2)) AS pos FROM r),
w AS (SELECT record_id, pool, pos, least(length(text), {SPAN}) AS n, least(substr(text, pos, {SPAN}), {_BACK.format(f"substr(text, pos, {SPAN})")}) AS span FROM i),
h AS (SELECT DISTINCT direction, t.record_id, t.pos, t.n FROM ways JOIN w t ON t.pool = target JOIN (SELECT DISTINCT pool, span FROM w) s ON s.pool = source AND s.span = t.span)
SELECT direction, record_id, CAST(count(DISTINCT p) AS INTEGER) AS covered_letters FROM (SELECT direction, record_id, unnest(range(pos, pos + n)) AS p FROM h) GROUP BY ALL
"""
