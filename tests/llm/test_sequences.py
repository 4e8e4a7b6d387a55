"""Problems 1, 2 and 3: near copies, the stable sample, overlaps between splits."""

import hashlib
import random

import numpy as np
import pyarrow as pa

from helixmill.llm import hamming, letters, near_copies, overlaps, stable_sample, stretches, suffixes
from helixmill.llm.letters import anchored, close_matrix, jaccard6, may_share


def shingles(s):
    return {s[i : i + 6] for i in range(len(s) - 5)}


def similar(a, b):
    x, y = shingles(a), shingles(b)
    return bool(x and y) and 2 * len(x & y) >= len(x | y)


def normal(s):
    return "".join(c for c in s if c.isalpha()).upper().replace("U", "T")


def changed(rng, s, n):
    s = list(s)
    for _ in range(n):
        p = rng.randrange(len(s))
        kind = rng.random()
        if kind < 0.5:
            s[p] = rng.choice("ACGT")
        elif kind < 0.75:
            s.insert(p, rng.choice("ACGTN"))
        else:
            del s[p]
    return "".join(s)


def library(seed, families=25):
    rng = random.Random(seed)
    out = []
    for _ in range(families):
        base = "".join(rng.choice("ACGT") for _ in range(rng.choice((12, 30, 60, 90, 108, 108, 150))))
        out += [base, base, base.lower(), changed(rng, base, 1), changed(rng, base, 4), changed(rng, base, 7)]
        k = len(base) // 2
        out.append(base[k:] + base[:k])
    out += [None, "", "ACG", "---", "ACGTAC", "acgtac", "N" * 40, "N" * 41, "A" * 3000, "A" * 3000 + "C", "ACGUAC-"]
    rng.shuffle(out)
    return [(i + 1, s) for i, s in enumerate(out)]


def pairs_of(spark, rows, extra=""):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "record_id long, sequence string, text string, id int")
    classes, members, links = near_copies.near_copies(df)
    of = {r["id"]: [r["id"]] for r in classes.collect()}
    for r in members.collect():
        of[r["id"]] = sorted({*of[r["id"]], r["record_id"]})
    got = {(a, b) for ids in of.values() for a in ids for b in ids if a < b}
    return got | {(min(p, q), max(p, q)) for r in links.collect() for p in of[r["a"]] for q in of[r["b"]]}


def test_near_copies_match_brute_force(spark):
    rows = library(1)
    rows += [rows[0], rows[5], (None, rows[3][1])]
    clean = sorted({(i, normal(s)) for i, s in rows if i is not None and s and len(normal(s)) >= 6})
    want = {(a, b) for a, x in clean for b, y in clean if a < b and (x == y or similar(x, y))}
    assert pairs_of(spark, rows) == want and len(want) > 150


def test_hot_families_and_shared_adapters_lose_nothing(spark, monkeypatch):
    for name, value in (("CAP", 4), ("MIDDLE", 8), ("FINE_CAP", 6), ("BLOCK", 9)):
        monkeypatch.setattr(near_copies, name, value)
    rng = random.Random(5)
    base, adapter = ("".join(rng.choice("ACGT") for _ in range(n)) for n in (108, 40))
    rows = [(i, changed(rng, base, 2)) for i in range(1, 60)] + [(i, adapter + "".join(rng.choice("ACGT") for _ in range(108))) for i in range(60, 100)]
    clean = [(i, normal(s)) for i, s in rows]
    want = {(a, b) for a, x in clean for b, y in clean if a < b and (x == y or similar(x, y))}
    assert pairs_of(spark, rows) == want and len(want) > 1000


def moved(rng, s, n):
    for _ in range(n):
        if rng.random() < 0.25:
            p = rng.randrange(len(s))
            piece, s = s[p : p + rng.randint(10, 40)], s[:p] + s[p + 40 :]
            q = rng.randrange(len(s) + 1)
            s = s[:q] + piece + s[q:]
        else:
            s = changed(rng, s, 1)
    return s


def all_similar(rows):
    text = pa.array([s for _, s in rows])
    ids = np.array([i for i, _ in rows])
    a, b = np.nonzero(np.triu(close_matrix(text, text, 0.5), 1))
    return {(min(p, q), max(p, q)) for p, q in zip(ids[a].tolist(), ids[b].tolist())}


def test_rows_with_few_hot_keys_keep_their_links(spark):
    rng = random.Random(0)
    base = "".join(rng.choice("ACGT") for _ in range(108))
    rows = [(i, moved(rng, base, rng.randint(4, 6))) for i in range(1, 401)]
    want = all_similar(rows)
    got = pairs_of(spark, rows)
    assert got <= want and not want - got and len(want) > 4000


def test_a_family_of_near_copies_loses_no_pair(spark):
    rng = random.Random(5)
    base = "".join(rng.choice("ACGT") for _ in range(200))
    rows = []
    for i in range(1, 151):
        s = list(base)
        for p in rng.sample(range(200), 7):
            s[p] = rng.choice([c for c in "ACGT" if c != s[p]])
        rows.append((i, "".join(s)))
    want = all_similar(rows)
    assert pairs_of(spark, rows) == want and len(want) > 4000


def test_texts_that_share_a_stretch_by_chance_are_no_candidates(spark):
    rng = random.Random(6)
    word = lambda n, letters="ACGT": "".join(rng.choice(letters) for _ in range(n))
    same = [word(15) for _ in range(5)]
    texts = [word(46) + same[i % 5] + word(46 + i % 3) for i in range(600)]
    texts += [changed(rng, t, 3) for t in texts[:100]] + [word(300, "AN"), "A" * 400, word(20), "", "ACG"]
    rows = list(enumerate(texts, 1))
    df = spark.createDataFrame(rows, "id long, text string")
    for middle, hot in ((1024, 0), (64, 500)):  # runs of some 120 rows
        got = [tuple(r) for r in stretches.stretch_pairs(df, near_copies.stretch_keys, near_copies.STRETCHES, middle, 32, 0.5).distinct().collect()]
        pairs, want = {p for p in got if p[1] is not None}, {p for p in all_similar(rows) if min(len(texts[i - 1]) for i in p) >= 100}
        assert want <= pairs and len(want) >= 95 and len(pairs - want) < 100  # 40,000 pairs share a stretch
        assert len(got) - len(pairs) >= hot and (hot or len(got) == len(pairs))


def test_matrices_of_ambiguous_texts_compare_only_what_may_be_similar(monkeypatch):
    rng = random.Random(7)
    texts = ["".join(rng.choice("ACGTN") for _ in range(108)) for _ in range(40)]
    texts += [changed(rng, t, n % 9) for n, t in enumerate(texts)]
    compared = []
    slow = letters._jaccard6_any
    monkeypatch.setattr(letters, "_jaccard6_any", lambda x, y: compared.append(len(x)) or slow(x, y))
    out = close_matrix(pa.array(texts), pa.array(texts), 0.5)
    assert [[bool(v) for v in r] for r in out] == [[similar(a, b) for b in texts] for a in texts]
    assert sum(compared) < 400


def test_turns_and_parts_lose_no_pair(spark, monkeypatch):
    rng = random.Random(8)
    base = ["".join(rng.choice("ACGT") for _ in range(108)) for _ in range(20)]
    rows = [(i, changed(rng, base[i % 20], rng.randint(1, 4))) for i in range(1, 201)]
    df = spark.createDataFrame(rows, "id long, text string")
    for name, value in (("TURN", 60), ("PACK", 7), ("PAIRS", 50)):
        monkeypatch.setattr(stretches, name, value)
    got = {tuple(r) for r in stretches.stretch_pairs(df, near_copies.stretch_keys, near_copies.STRETCHES, 1024, 4, 0.5).collect()}
    assert all_similar(rows) <= got and len(got) > 800


def test_every_stretch_of_fifteen_letters_shares_a_word():
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("ACGTN") for _ in range(n))
    for _ in range(300):
        same = word(15)
        texts = [word(rng.randint(0, 30)) + same + word(rng.randint(0, 30)) for _ in range(2)]
        row, at = anchored(np.frombuffer("".join(texts).encode(), np.uint8), np.array([0, len(texts[0]), len(texts[0] + texts[1])]), 13, 3, 4)
        words = [{"".join(texts)[p : p + 13] for p in at[row == i]} for i in (0, 1)]
        assert any(w in same for w in words[0] & words[1])
        row, key, (tag,) = near_copies.stretch_keys(pa.array(texts))
        assert any(near_copies.same_stretch(tag[i : i + 1], tag[(row == 1) & (key == key[i])]).any() for i in np.flatnonzero(row == 0))


def test_filter_by_classes_drops_no_similar_pair():
    rng = random.Random(12)
    left = ["".join(rng.choice("ACG") for _ in range(rng.randint(0, 150))) for _ in range(800)]
    right = [moved(rng, s, rng.randint(1, 9)) if len(s) > 60 else s[:-1] for s in left]
    left, right = left + left, right + right[::-1]
    passed = may_share(pa.array(left), pa.array(right), 0.5)
    want = np.array([similar(a, b) for a, b in zip(left, right)])
    assert passed[want].all() and want.sum() > 300 and not passed.all()


def test_short_tags_pass_every_pair_within_the_distance():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 60, (300, 48)).astype(np.uint64)
    b = a.copy()
    errors = rng.integers(0, 49, 300)
    for i, n in enumerate(errors):
        b[i, rng.choice(48, n, replace=False)] = rng.integers(0, 1 << 60, n).astype(np.uint64)
    passed = hamming.within_distance(48, 31)(*hamming.short_tags(a), *hamming.short_tags(b))
    assert passed[errors <= 31].all() and not passed[errors > 40].any()


def test_near_copies_of_an_empty_table(spark):
    assert pairs_of(spark, [(1, None), (2, "")]) == set()
    df = spark.createDataFrame([], "record_id long, sequence string")
    assert near_copies.near_copies(df)[2].count() == 0


def test_every_pair_within_the_signature_distance_shares_a_key():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a = rng.integers(0, 1 << 40, 12).astype(np.uint64)
        b = a.copy()
        b[rng.choice(12, 7, replace=False)] += np.uint64(1)
        row, key = hamming.chunk_keys(np.stack([a, b]), 4, 7)
        assert set(key[row == 0]) & set(key[row == 1])


def test_similarity_of_any_letters():
    left, right = ["ACGTACGTAA", "NNNNNNN", "ACGTAC", ""], ["ACGTACGTAC", "NNNNNNNN", "TTTTTT", ""]
    common, union = jaccard6(pa.array(left), pa.array(right))
    assert [(int(c), int(u)) for c, u in zip(common, union)] == [(len(shingles(a) & shingles(b)), len(shingles(a) | shingles(b))) for a, b in zip(left, right)]
    assert close_matrix(pa.array(left), pa.array(right), 0.5).tolist() == [[similar(a, b) for b in right] for a in left]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_banded_edits_match_the_full_table():
    rng = random.Random(2)
    a, b = [], []
    for _ in range(1500):
        x = "".join(rng.choice("ACG") for _ in range(rng.randint(0, 16)))
        a.append(x)
        b.append(changed(rng, x, rng.randint(0, 6)) if len(x) > 8 else "".join(rng.choice("AC") for _ in range(rng.randint(0, 9))))
    got = overlaps.within_edits([x.encode() for x in a], [x.encode() for x in b])
    assert got.tolist() == [edits(x, y) <= 4 for x, y in zip(a, b)]


def _back(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def _cross(spark, rows, ways):
    df = spark.createDataFrame(sorted(set(rows)), "record_id long, pool string, text string")
    return {tuple(r) for r in overlaps.cross_split(df, spark.createDataFrame(ways, "direction string, source string, target string")).collect()}


def _want(rows, ways):
    near = {(x, y): edits(x, y) <= 4 or edits(x, _back(y)) <= 4 for x in {r[2] for r in rows} for y in {r[2] for r in rows} if abs(len(x) - len(y)) <= 4}
    return {(d, i, j) for d, s, t in ways for i, p, x in rows for j, q, y in rows if p == s and q == t and i != j and near.get((x, y))}


def test_cross_split_overlaps_match_brute_force(spark):
    rng = random.Random(8)
    rows, pools = [], ("a", "b", "c")
    for _ in range(14):
        base = "".join(rng.choice("ACGT") for _ in range(rng.choice((8, 25, 41, 82, 100, 108, 108, 147))))
        for s in (base, base, _back(base), changed(rng, base, 2), _back(changed(rng, base, 4)), changed(rng, base, 9)):
            if len(s) >= 6:
                rows.append((len(rows) + 1, rng.choice(pools), s))
    ways = [("a_to_b", "a", "b"), ("b_to_a", "b", "a"), ("c_to_b", "c", "b")]
    got = _cross(spark, rows, ways)
    assert got == _want(rows, ways) and len(got) > 40


def test_cross_split_with_hot_prefixes(spark, monkeypatch):
    monkeypatch.setattr(overlaps, "CAP", 5)
    monkeypatch.setattr(overlaps, "BLOCK", 7)
    rng = random.Random(9)
    base = "".join(rng.choice("ACGT") for _ in range(108))
    rows = [(i, "ab"[i % 2], changed(rng, base, 3)) for i in range(1, 40)]
    ways = [("a_to_b", "a", "b")]
    assert _cross(spark, rows, ways) == _want(rows, ways)


def test_neighbours_in_the_suffix_array_have_their_common_prefix():
    rng = random.Random(6)
    texts = sorted("".join(rng.choice("ACG") for _ in range(rng.randint(1, 30))) for _ in range(400))
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)])
    hi, lo = suffixes.words(data, offsets, np.arange(400), offsets[:-1])
    assert all((hi[i], lo[i]) <= (hi[i + 1], lo[i + 1]) for i in range(399))
    want = [next((i for i in range(24) if x[i : i + 1] != y[i : i + 1]), 24) if x[:24] != y[:24] else 24 for x, y in zip(texts, texts[1:])]
    assert suffixes.common_prefix(hi[1:], lo[1:], hi[:-1], lo[:-1]).tolist() == want


def test_more_splits_than_a_mask_holds(spark, monkeypatch):
    monkeypatch.setattr(overlaps, "SPLITS_AT_ONCE", 2)
    rng = random.Random(10)
    base = "".join(rng.choice("ACGT") for _ in range(108))
    rows = [(i, "abcd"[i % 4], changed(rng, base, 2)) for i in range(1, 25)]
    ways = [("1", "a", "b"), ("2", "b", "c"), ("3", "d", "a")]
    assert _cross(spark, rows, ways) == _want(rows, ways)


def test_coverage_matches_brute_force(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    rows = []
    for n in (8, 15, 30, 39, 60, 108, 108, 149, 330, 1100):
        base = word(n)
        for s in (base, _back(base), base[: n * 5 // 6], word(25) + base + word(16), base[n // 3 :], changed(rng, base, 4)):
            rows.append((len(rows) + 1, rng.choice("abc"), s))
    rows += [(900, "a", rows[0][2]), (901, "b", rows[0][2]), (902, "a", rows[30][2]), (903, "b", rows[30][2]), (904, "z", rows[30][2])]
    ways = [("a_to_b", "a", "b"), ("b_to_a", "b", "a"), ("c_to_b", "c", "b")]
    want = set()
    for d, source, target in ways:
        texts = [x for _, p, s in rows if p == source for x in (s, _back(s))]
        for i, p, s in rows:
            if p == target:
                k = min(len(s), 20)
                at = [a for a in range(len(s) - k + 1) if any(s[a : a + k] in x if k == 20 else s == x for x in texts)]
                if at:
                    want.add((d, i, len({a + j for a in at for j in range(k)})))
    df = spark.createDataFrame(rows, "record_id long, pool string, text string")
    got = [tuple(r) for r in overlaps.coverage(df, spark.createDataFrame(ways, "direction string, source string, target string")).collect()]
    assert len(got) == len(want) and set(got) == want and len(want) > 30


def test_digest_overlaps(spark):
    seq = "ACGTTACCAGTA"
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = spark.createDataFrame([(1, "a", seq), (2, "b", seq)], "record_id long, pool string, text string")
    ways = spark.createDataFrame([("A_to_B", "a_to_b", "a", "b")], "direction string, name string, source string, target string")
    public = spark.createDataFrame([(11, "a_to_b", digest(seq)), (12, "a_to_b", digest(_back(seq))), (13, "a_to_b", None), (14, None, digest(seq)), (11, "a_to_b", digest(seq))], "record_id long, name string, digest string")
    assert sorted(map(tuple, overlaps.digest_overlaps(public, rows, ways).collect())) == [("A_to_B", 1, 11), ("A_to_B", 1, 12)]


def _records(n, seed=1):
    rng = random.Random(seed)
    keys = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n // 2)]
    return [("t", i, None if i % 50 == 0 else rng.choice(keys), rng.choice(("gcall", "stemrich", None, "x")), rng.randint(1, 6)) for i in range(n)]


SHAPE = "origin string, record_id long, key string, stratum string, batch_no int"


def test_sample_is_stable_and_only_grows(spark):
    rows = _records(4000)
    df = spark.createDataFrame(rows, SHAPE)
    full = {tuple(r)[1]: r["entered"] for r in stable_sample.stable_sample(df).collect()}
    again = {r["record_id"] for r in stable_sample.stable_sample(df.unionByName(df).repartition(7, "stratum")).collect()}
    assert set(full) == again and 300 < len(full) < 1800
    by = {r[1]: r for r in rows}
    picked = {by[i][2] for i in full}
    assert all((r[2] in picked) == (r[1] in full) for r in rows if r[2])
    before = set()
    for b in range(1, 7):
        now = {r["record_id"] for r in stable_sample.stable_sample(df.where(f"batch_no <= {b}")).collect()}
        assert before <= now and now == {i for i, e in full.items() if e <= b}
        before = now
    assert stable_sample.stable_sample(df.where("false")).count() == 0


def test_rates_are_only_raised(spark):
    new = stable_sample.raised({"a": 0.2, "b": 0.1}, {"a": 0.1, "b": 0.3, "c": 0.5})
    assert new == {"a": 0.2, "b": 0.3, "c": 0.5}
    df = spark.createDataFrame(_records(1500, 2), SHAPE)
    ids = lambda rates: {r["record_id"] for r in stable_sample.stable_sample(df, rates, 0.05).collect()}
    assert ids({"gcall": 0.1}) <= ids(stable_sample.raised({"gcall": 0.1}, {"gcall": 0.4}))
