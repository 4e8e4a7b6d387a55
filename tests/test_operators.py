"""Operators against brute force on small tables, with nulls, ties, repeats, skew and empty tables."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixmill.functions.language import Language
from helixmill.operators import codec, edits, fibers, positions, quantiles, ridge, separation, stats, stems, twostage
from helixmill.operators.expect import ExpectationError, expect
from helixmill.plans import sequence_queries


def test_positions_and_ranks_under_skew(spark):
    rng = random.Random(1)
    rows = [(i, "hot" if i % 3 else rng.choice("abc"), rng.randint(0, 40)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, g string, v int").repartition(11)
    got = {r["id"]: (r["place"], r["g"]) for r in positions.positions(df, ["g"], ["v", "id"], "place").collect()}
    for g in "hot", "a", "b", "c":
        order = [i for i, h, _ in sorted(rows, key=lambda r: (r[2], r[0])) if h == g]
        assert [got[i][0] for i in order] == list(range(len(order)))
    ranks = {r["id"]: r["rank"] for r in positions.average_ranks(df, ["g"], "v", "rank").collect()}
    hot = [(v, i) for i, g, v in rows if g == "hot"]
    values = [v for v, _ in hot]
    for v, i in hot[:200]:
        assert ranks[i] == sum(x < v for x in values) + (values.count(v) + 1) / 2
    assert positions.positions(df.where("false"), ["g"], ["v", "id"]).count() == 0


def test_choices_take_the_smaller_index_on_ties(spark):
    rows = [("d", i, f"{i:03d}", s, float(i)) for i, s in enumerate([1.0, 1.0, 0.5, 1.0, 2.0, 2.0 + 1e-14, 0.0, 2.0, 3.0])]
    df = spark.createDataFrame([(d, i, i // 4, i % 4, s, o) for d, i, _, s, o in rows], "direction string, id long, fiber long, choice int, score double, outcome double")
    whole = fibers.whole_fibers(df, ["direction"], 4)
    best = {r["fiber"]: (r["choice"], r["key"]) for r in fibers.chosen(whole, ["direction"], "score").collect()}
    assert best == {0: (0, 10**12), 1: (0, 2 * 10**12)}
    worst = {r["fiber"]: r["choice"] for r in fibers.chosen(whole, ["direction"], "score", lowest=True).collect()}
    assert worst == {0: 2, 1: 2}
    gain = {r["fiber"]: r["gain"] for r in fibers.gains(whole, ["direction"], "score", "outcome").collect()}
    assert gain == {0: -1.5, 1: -1.5}
    first = {r["fiber"]: r["choice"] for r in fibers.first_passing(whole, ["direction"], F.col("score") > 1.5).collect()}
    assert first == {0: None, 1: 0}
    one = {r["fiber"]: r["margin"] for r in fibers.margins(df.where("id in (0, 2, 8)"), ["direction"], "score").collect()}
    assert one == {0: 0.5, 2: math.inf}


def burden(s):
    """Stems by definition: every start, end and length."""
    pair = dict(zip("ACGT", "TGCA"))
    found = []
    for i, q in itertools.combinations(range(len(s)), 2):
        n = 0
        while i + n < q - n and pair[s[i + n]] == s[q - n]:
            n += 1
            if n >= 4 and q - i - 2 * n + 1 >= 3:
                found.append((n, q - i - 2 * n + 1))
    return (len(found), sum(n for n, _ in found), max((n for n, _ in found), default=0), min((x for _, x in found), default=-1))


def test_stem_counts_in_blocks_of_diagonals(monkeypatch):
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("ACGT"), 120)) for _ in range(5)]
    whole = stems.stems_of(texts)
    monkeypatch.setattr(stems, "PLACES_AT_ONCE", 200)
    assert (stems.stems_of(texts) == whole).all() and whole[:, 0].all()


def test_stem_join_stays_in_its_task_and_in_bounded_parts(spark, monkeypatch):
    rng = np.random.default_rng(8)
    texts = ["".join(rng.choice(list("ACGT"), n)) for n in (0, 3, 4, 11, 40, 108, 300)] + ["AT" * 60, "A" * 40 + "T" * 40, None]
    want = [(0, 0, 0, -1) if t is None else tuple(stems.stems_of([t])[0]) for t in texts]
    df = spark.createDataFrame([(t,) for t in texts], "seq string")
    plan = stems.stem_burden_join(df, "seq")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    got = {r["seq"]: tuple(r)[1:] for r in stems.stem_burden_join(df, "seq").collect()}
    assert got == dict(zip(texts, want))
    monkeypatch.setattr(stems, "PLACES_AT_ONCE", 100)
    assert [tuple(r) for part in stems._some(texts) for r in stems._joined(part)] == want


def test_members_are_featured_where_they_are_made(spark, tmp_path):
    from helixmill.plans import context_queries as context

    rows = [(1, "Pool A", 2, "5"), (2, "pool a", 0, "6"), (3, None, 1, "7"), (4, "pool b", 1, None), (5, "pool b", 1, str(1 << 300)), (6, "pool b", 1, "7")]
    wide = ["choice_index", "physical_rank", "gc_count", "max_homopolymer", "variable_candidate_pairs", "variable_weighted_pairs", "source_model_score", "cross_model_score", "rerank", "decoded_payload"]
    df = spark.createDataFrame([(i, p, b, r) for i, p, b, r in rows], "record_id long, selector_source_pool string, selector_bits int, payload_rank string")
    df = df.withColumns({c: F.lit(0) for c in wide} | {c: F.lit("x") for c in ("selector_model", "sequence", "sequence_sha256")})
    df.write.parquet(str(tmp_path / "generated_selected_samples.parquet"))
    models = spark.createDataFrame([(p, 1.0, 0.5, *[0.25 * i for i in range(len(context.FEATURES))]) for p in ("pool a", "pool b")], "pool string, alpha double, intercept double, " + ", ".join(f"b_{f} double" for f in context.FEATURES))
    made = context.scored_members(spark, str(tmp_path), models, "n")
    got = {(r["record_id"], r["choice"]): r for r in made.collect()}
    assert sorted(got) == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 0), (5, 0), (5, 1), (6, 0), (6, 1)] and len(got) == made.count()
    words = spark.createDataFrame([(r["seq"],) for r in got.values() if r["seq"]], "seq string").distinct()
    want = {r["seq"]: r for r in stems.features(words).collect()}
    for r in got.values():
        assert (r["score"] is None) == (r["seq"] is None) == (r["record_id"] == 5)
        if r["seq"]:
            assert [r[f] for f in context.FEATURES] == [want[r["seq"]][f] for f in context.FEATURES]
            assert math.isclose(r["score"], 0.5 + sum(0.25 * i * want[r["seq"]][f] for i, f in enumerate(context.FEATURES)))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "context-members" not in plan  # with the models only


def test_stem_functions_carry_their_code(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle

    (tmp_path / "f").write_bytes(cloudpickle.dumps(stems._stems))
    out = subprocess.run([sys.executable, "-c", "import pickle; print(pickle.load(open('f', 'rb'))(['AAAACCCTTTT', None]))"], cwd=tmp_path, capture_output=True, text=True)
    assert out.stdout.strip() == "[[1, 4, 4, 3], [None, None, None, None]]"


def test_context_folds_keep_copies_together(spark):
    from helixmill.plans.context_queries import fold_of

    rows = spark.createDataFrame([(i, f"ACGT{i % 30:05d}") for i in range(300)], "id int, seq string").withColumn("fold", fold_of("seq"))
    folds = rows.groupBy("seq").agg(F.countDistinct("fold").alias("n")).agg(F.max("n")).first()[0]
    assert folds == 1 and rows.select("fold").distinct().count() == 5


def test_stems_match_the_definition(spark):
    rng = random.Random(3)
    seqs = ["".join(rng.choice("ACGT") for _ in range(rng.choice((5, 11, 30, 60)))) for _ in range(60)] + ["ACGT" * 12, "A" * 30 + "T" * 30, "GGGGCCCC", "GGGGAAACCCC"]
    df = spark.createDataFrame([(s,) for s in dict.fromkeys(seqs)], "seq string")
    cols = ("pairs", "weighted", "longest", "least_loop")
    for out in (stems.stem_burden(df, "seq"), stems.stem_burden_join(df, "seq")):
        for r in out.collect():
            assert tuple(r[c] for c in cols) == burden(r["seq"]), r["seq"]
    assert stems.stem_burden(spark.createDataFrame([(None,)], "seq string"), "seq").first()["pairs"] is None


def test_decoding_states(spark):
    lang = Language(8, 3, 5, 3)
    words = [lang.unrank(i) for i in range(0, lang.size, 301)]
    rows = [(i, w, 2, "clash") for i, w in enumerate(words)] + [(900, None, 2, ""), (901, "AAAAAAAA", 2, ""), (902, words[0], None, ""), (903, words[0], -1, ""), (904, "x", 1, "")]
    got = codec.decode(spark.createDataFrame(rows, "id long, seq string, bits int, extra string"), lang, "n").collect()
    by = {r["id"]: r for r in got}
    assert [by[i]["status"] for i in (900, 901, 902, 903, 904)] == ["no word", "no word", "no width", "no width", "no word"]
    kinds = {by[i]["status"] for i in range(len(words))}
    assert kinds == {"decoded", "beyond"}
    sent = spark.createDataFrame([(i, by[i]["payload"], 2) for i in range(len(words)) if by[i]["status"] == "decoded"], "record_id long, payload_rank string, bits int")
    members = codec.candidates(sent, lang, "n").collect()
    assert len(members) == 4 * sent.count()
    assert {(m["record_id"], m["seq"]) for m in members if m["choice"] == by[m["record_id"]]["choice"]} == {(i, words[i]) for i in range(len(words)) if by[i]["status"] == "decoded"}


def test_round_trip_of_no_word(spark):
    df = spark.createDataFrame([("ACGTACGT",), ("A",), (None,)], "seq string")
    assert [r["again"] for r in codec.roundtrip(df, Language(8, 3, 5, 3)).collect()] == ["ACGTACGT", None, None]


def test_single_edits(spark):
    df = spark.createDataFrame([(1, "ACA")], "id long, seq string")
    got = [(r["kind"], r["edited"]) for r in edits.single_edits(df, "seq").collect()]
    want = [("substitution", "ACA"[:i] + b + "ACA"[i + 1 :]) for i in range(3) for b in "ACGT" if b != "ACA"[i]]
    want += [("insertion", "ACA"[:i] + b + "ACA"[i:]) for i in range(4) for b in "ACGT"] + [("deletion", "ACA"[:i] + "ACA"[i + 1 :]) for i in range(3)]
    assert sorted(got) == sorted(want)


def test_substitutions_are_told_as_the_decoder_tells_them(monkeypatch):
    for shape, step in (((10, 4, 6, 2), 97), ((9, 2, 6, 3), 1301)):
        lang = Language(*shape)
        decoder = edits.Substitutions(lang, "n")
        words = [lang.unrank(i) for i in range(0, lang.size, step)]
        widths = [(0, 1, 3, 8, -1)[i % 5] for i in range(len(words))]

        def told(word, width):
            sent, counts = decoder.way.gather(lang.rank(word)), [0] * 4
            for i, b in itertools.product(range(lang.length), "ACGT"):
                if word[i] != b:
                    rank = lang.rank(word[:i] + b + word[i + 1 :])
                    logical = None if rank is None else decoder.way.gather(rank)
                    counts[0 if rank is None else 1 if logical is None else 2 if sent is not None and logical >> width == sent >> width else 3] += 1
            return sent is not None and width >= 0, counts

        for slack in (lang.length + 2, 1 << 60):  # the second leaves most words to the full decoder
            monkeypatch.setattr(decoder, "slack", slack)
            decoded, counts = decoder.outcomes(words, widths)
            want = [told(w, max(0, r)) if r >= 0 else (False, None) for w, r in zip(words, widths)]
            assert decoded.tolist() == [d for d, _ in want] and 0 < decoded.sum() < len(words)
            assert [c for c, d in zip(counts.tolist(), decoded) if d] == [c for d, c in want if d]


def test_edit_outcomes_match_decoding_every_edit(spark):
    lang, rng = Language(), random.Random(5)
    words = [("p", r, lang.unrank(rng.randrange(lang.size))) for r in (0, 4, 8) for _ in range(12)]
    df = spark.createDataFrame(words, "pool string, bits int, seq string")
    got = {(r["pool"], r["bits"], r["kind"], r["outcome"]): r["edits"] for r in sequence_queries.edit_outcomes(df, lang, "n").collect()}
    sent = codec.decode(df.withColumn("word", F.col("seq")), lang, "n").where("status = 'decoded'").select("pool", "bits", F.col("word").alias("seq"), F.col("payload").alias("sent"))
    all_ = codec.decode(edits.single_edits(sent, "seq").select("pool", "bits", "sent", "kind", F.col("edited").alias("seq"), F.length("edited").alias("n")), lang, "n")
    status = F.when(F.col("n") != 108, "rejected_length").when(F.col("status") == "no word", "rejected_constraint_or_alphabet").when(F.col("status") == "beyond", "rejected_outside_power_of_two_domain")
    status = status.when(F.col("payload") == F.col("sent"), "accepted_same_payload").otherwise("accepted_wrong_payload")
    assert got == {tuple(r)[:4]: r["count"] for r in all_.groupBy("pool", "bits", "kind", status.alias("outcome")).count().collect()} and len(got) > 9


def test_rank_statistics(spark):
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 20, 400), rng.normal(size=400)
    label = (rng.random(400) < 0.2).astype(int)
    df = spark.createDataFrame([("g", float(a), float(b), int(c)) for a, b, c in zip(x, y, label)] + [("one", 1.0, 2.0, 1)], "g string, x double, y double, label int")

    def rank(v):
        return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])

    got = {r["g"]: r["spearman"] for r in stats.spearman(df, ["g"], "x", "y").collect()}
    assert got["g"] == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1], abs=1e-6) and got["one"] is None
    area = {r["g"]: r["auc"] for r in stats.auc(df, ["g"], "x", "label").collect()}
    p, n = x[label == 1], x[label == 0]
    assert area["g"] == pytest.approx(((p[:, None] > n) + 0.5 * (p[:, None] == n)).mean(), abs=1e-6) and area["one"] is None
    ap = {r["g"]: r["average_precision"] for r in stats.average_precision(df, ["g"], "x", "label").collect()}
    want = sum(label[x == t].sum() / label.sum() * label[x >= t].mean() for t in np.unique(x))
    assert ap["g"] == pytest.approx(want, abs=1e-6)
    weighted = stats.weighted_ranks(df.where("g = 'g'").withColumn("w", F.lit(2)), ["g"], "x", "w", "r").collect()
    assert sorted(r["r"] for r in weighted) == pytest.approx(sorted(2 * rank(x) - 0.5))


def test_two_sample_distances(spark):
    a, b = [1.0, 2.0, 2.0, 5.0], [2.0, 3.0, 9.0]
    df = spark.createDataFrame([("g", v, 0) for v in a] + [("g", v, 1) for v in b] + [("half", 1.0, 0)], "g string, v double, side int")
    got = stats.two_sample(df, ["g"], "v", "side").collect()
    grid = sorted({*a, *b})
    gap = [abs(np.mean(np.array(a) <= t) - np.mean(np.array(b) <= t)) for t in grid]
    assert [r["g"] for r in got] == ["g"]
    assert got[0]["ks"] == pytest.approx(max(gap), abs=1e-6)
    assert got[0]["wasserstein"] == pytest.approx(sum(g * (t - s) for g, s, t in zip(gap, grid, grid[1:])), abs=1e-8)
    p = [r["p"] for r in spark.createDataFrame([(0.5, 40.0, 50.0), (0.01, 5.0, 5.0)], "ks double, n double, m double").select(stats.ks_p(F.col("ks"), F.col("n"), F.col("m")).alias("p")).collect()]
    t = 0.5 * math.sqrt(2000 / 90)
    assert p == pytest.approx([2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * t * t) for k in range(1, 101)), 1.0]) and p[0] < 0.001


def test_bootstrap_and_interval(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(1, 1, 200)
    df = spark.createDataFrame([("g", i, float(x)) for i, x in enumerate(v)], "g string, i long, v double")
    means = [r["mean"] for r in stats.bootstrap_means(df, "g", "i", "v", 60, "s").collect()]
    assert len(means) == 60 and abs(np.mean(means) - v.mean()) < 0.05
    again = [r["mean"] for r in stats.bootstrap_means(df.repartition(7), "g", "i", "v", 60, "s").collect()]
    assert sorted(means) == pytest.approx(sorted(again))
    low, high = stats.bca(float(v.mean()), means, 0.0)
    assert low < v.mean() < high


def test_ridge_matches_the_normal_equations(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 3)) * [1, 5, 0.1] + [0, 3, 1]
    y = x @ [0.5, -0.2, 3] + rng.normal(size=300)
    df = spark.createDataFrame([(int(i % 5), *map(float, r), 7.0, float(t)) for i, (r, t) in enumerate(zip(x, y))], "fold int, a double, b double, c double, flat double, y double")
    names = ["a", "b", "c", "flat"]
    g = ridge.gram(ridge.moments(df, [], names, "y").first().asDict(), names, "y")
    intercept, beta = ridge.solve(g, 2.0)
    z = (x - x.mean(0)) / x.std(0)
    want = np.linalg.solve(z.T @ z + 2 * np.eye(3), z.T @ (y - y.mean())) / x.std(0)
    assert beta[:3] == pytest.approx(want) and beta[3] == pytest.approx(0, abs=1e-9)
    assert intercept == pytest.approx(y.mean() - x.mean(0) @ want)
    pred = intercept + np.c_[x, np.full(300, 7.0)] @ beta
    assert ridge.squared_error(g, intercept, beta) == pytest.approx(((y - pred) ** 2).sum())
    folds = [ridge.gram(r.asDict(), names[:3], "y") for r in ridge.moments(df, ["fold"], names[:3], "y").orderBy("fold").collect()]
    assert ridge.best_alpha(folds) in ridge.ALPHAS


def test_hamming_separation(spark, monkeypatch):
    monkeypatch.setattr(separation, "BLOCK", 20)
    rng = random.Random(4)
    base = ["".join(rng.choice("ACGT") for _ in range(108)) for _ in range(30)]
    seqs = list(dict.fromkeys(base + ["".join(rng.choice("ACGT") if rng.random() < 0.06 else c for c in s) for s in base for _ in range(3)]))
    df = spark.createDataFrame(list(enumerate(seqs)), "id long, seq string")
    far = lambda x, y: sum(a != b for a, b in zip(x, y))
    want = {(i, j, far(x, y)) for (i, x), (j, y) in itertools.combinations(enumerate(seqs), 2) if far(x, y) <= 8}
    assert {tuple(r) for r in separation.pairs_within(df, "id", "seq", 108, 8).collect()} == want
    assert {tuple(r) for r in separation.pairs_within(df, "id", "seq", 108, 8, hot=2, block=7).collect()} == want  # a second cut, then blocks
    asked = df.where("id % 20 = 0")
    got = {r["query"]: (r["distance"], r["neighbour"]) for r in separation.nearest(asked, df, "id", "seq", 108).collect()}
    assert got == {i: min((far(seqs[i], y), j) for j, y in enumerate(seqs) if j != i) for i in range(0, len(seqs), 20)}
    assert separation.nearest(asked.where("false"), df, "id", "seq", 108).count() == 0
    two = df.withColumn("g", F.col("id") % 2)
    got = {(r["g"], r["query"]): (r["distance"], r["neighbour"]) for r in separation.nearest(two.where("id % 20 = 1"), two, "id", "seq", 108, ("g",)).collect()}
    assert got == {(1, i): min((far(seqs[i], seqs[j]), j) for j in range(1, len(seqs), 2) if j != i) for i in range(1, len(seqs), 20)}


def test_nearest_in_parts_takes_the_first_of_ties(spark, monkeypatch):
    rng = np.random.default_rng(2)
    for length in (3, 31, 62, 108, 300):
        letters = rng.integers(0, 4, (60, length))
        letters[30:] = letters[:30]  # copies, so ties
        letters[30:, :2] = rng.integers(0, 4, (30, 2))
        seqs = ["".join("ACGT"[x] for x in row) for row in letters]
        df = spark.createDataFrame([(s,) for s in seqs], "seq string").select(*[c.alias(n) for n, c in separation.packed("seq", length).items()])
        planes = separation._planes(np.array(df.collect(), np.int64).view(np.uint64))
        monkeypatch.setattr(separation, "NEAREST_ROWS", 7)
        monkeypatch.setattr(separation, "NEAREST_QUERIES", 3)
        far = (letters[:, None] != letters[None]).sum(axis=2)
        distance, place = separation._nearest(planes[:, :20], planes, np.arange(20), length)
        assert [*zip(distance, place)] == [min((far[i, j], j) for j in range(60) if j != i) for i in range(20)]
        assert (separation._nearest(planes[:, :1], planes[:, :1], np.zeros(1, int), length)[0] > length).all()
    seqs = ["".join(rng.choice(list("ACGT"), 20)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(seqs)), "id long, seq string")
    far = lambda x, y: sum(a != b for a, b in zip(x, y))
    for name, value in (("ASKED", 5), ("GIVEN", 40), ("BLOCK", 16)):
        monkeypatch.setattr(separation, name, value)
    got = {r["query"]: (r["distance"], r["neighbour"]) for r in separation.nearest(df.where("id % 20 = 0"), df, "id", "seq", 20).collect()}
    assert got == {i: min((far(seqs[i], y), j) for j, y in enumerate(seqs) if j != i) for i in range(0, 300, 20)}


def test_pairs_under_a_hot_piece(spark):
    rng = random.Random(8)
    seqs = list(dict.fromkeys("ACGT" * 3 + "".join(rng.choice("ACGT") if rng.random() < 0.05 else c for c in "GATC" * 24) for _ in range(150)))
    df = spark.createDataFrame(list(enumerate(seqs)), "id long, seq string")
    far = lambda x, y: sum(a != b for a, b in zip(x, y))
    want = {(i, j, far(x, y)) for (i, x), (j, y) in itertools.combinations(enumerate(seqs), 2) if far(x, y) <= 8}
    got = [tuple(r) for r in separation.pairs_within(df, "id", "seq", 108, 8).collect()]
    assert set(got) == want and len(got) == len(want) > 100
    assert separation.pairs_within(df.where("false"), "id", "seq", 108, 8).count() == 0


def test_two_stage_resampling(spark, monkeypatch):
    monkeypatch.setattr(twostage, "FIBERS", 10)
    rng = np.random.default_rng(3)
    n, reps, names = 200, 20, ["a", "b"]
    x, fold, keys = rng.normal(size=(n, 2)).round(3), rng.integers(0, 4, n), [f"k{i}" for i in range(n)]
    y = x @ [2.0, -1.0] + rng.normal(size=n).round(3)
    df = spark.createDataFrame([("p", int(f), k, *map(float, r), float(t)) for f, k, r, t in zip(fold, keys, x, y)], "pool string, fold int, key string, a double, b double, y double").repartition(5)
    fitted = twostage.refits(df, "pool", "fold", "key", names, "y", reps, "s")
    got = {r["replicate"]: r for r in fitted.collect()}
    w, beta = twostage._weights("s", keys, reps), []
    full = np.column_stack([np.ones(n), x, y])
    for r in range(reps):
        grams = [(full[fold == f] * w[fold == f, r, None]).T @ full[fold == f] for f in range(4)]
        alpha = ridge.best_alpha(grams)
        beta.append(ridge.solve(sum(grams), alpha)[1])
        assert got[r]["alpha"] == alpha and (got[r]["b_a"], got[r]["b_b"]) == pytest.approx(tuple(beta[-1]))
    members, outcome = rng.normal(size=(50, 4, 2)).round(3), rng.normal(size=(50, 4)).round(3)
    made = [("p", "p_to_q", f"f{i}", m[:, 0].tolist(), m[:, 1].tolist(), o.tolist()) for i, (m, o) in enumerate(zip(members, outcome))]
    fib = spark.createDataFrame(made, "source string, direction string, name string, a array<double>, b array<double>, y array<double>")
    args = ("source", "direction", "name", names, "y", reps, "t")
    gains = {r["replicate"]: r["gain"] for r in twostage.replicate_gains(fib, fitted.withColumnRenamed("pool", "source"), *args).collect()}
    w = twostage._weights("t", [f"f{i}" for i in range(50)], reps)
    for r in range(reps):
        best = (members @ beta[r]).argmax(axis=1)
        g = outcome[np.arange(50), best] - outcome.mean(axis=1)
        assert gains[r] == pytest.approx((w[:, r] * g).sum() / w[:, r].sum())
    assert twostage.replicate_gains(fib.where("false"), fitted.withColumnRenamed("pool", "source"), *args).count() == 0


def test_quantiles_interpolate(spark):
    rng = random.Random(9)
    rows = [(None if i % 5 == 0 else "hot" if i % 3 else rng.choice("ab"), None if i % 11 == 0 else float(rng.randint(-3, 3))) for i in range(700)] + [("one", 2.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    out = quantiles.with_quantiles(df.groupBy("g").agg(F.count("*").alias("n")), df, ["g"], "v", {"low": 0.1, "mid": 0.5, "top": 1.0})
    got = {r["g"]: (r["low"], r["mid"], r["top"]) for r in out.collect()}
    for g in (None, "hot", "a", "b", "one"):
        assert got[g] == pytest.approx(tuple(np.quantile([v for h, v in rows if h == g and v is not None], [0.1, 0.5, 1.0])))
    assert got["none"] == (None, None, None) and len(got) == 6


def test_expectations(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, "b")], "k int, v string")
    assert expect(df, rows=3, at_least=1) is df
    for bad in ({"keys": ["k"]}, {"not_null": ["v"]}, {"rows": 2}, {"at_least": 4}):
        with pytest.raises(ExpectationError):
            expect(df, **bad)
    assert expect(df.where("false"), keys=["k"], not_null=["v"], rows=0).count() == 0


def test_logistic_fit_reaches_the_penalised_optimum(spark):
    from helixmill.operators import logistic

    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 2))
    y = (rng.random(500) < 1 / (1 + np.exp(-(x @ [1.0, -2.0] - 0.5)))).astype(int)
    df = spark.createDataFrame([("g", float(a), float(b), int(c)) for (a, b), c in zip(x, y)] + [("one", 1.0, 1.0, 1)], "g string, a double, b double, y int")
    w = logistic.fit(df, "g", ["a", "b"], "y")
    z = np.c_[np.ones(500), x]
    p = 1 / (1 + np.exp(-(z @ w["g"])))
    assert z.T @ (p - y) + w["g"] == pytest.approx(np.zeros(3), abs=1e-6)
    assert np.isfinite(w["one"]).all()
    got = df.where("g = 'g'").select(logistic.probability(w, "g", ["a", "b"]).alias("p")).collect()
    assert [r["p"] for r in got[:50]] == pytest.approx(list(p[:50]))


def test_bca_interval_has_all_of_the_references_replicates(spark):
    import hashlib
    import math

    import numpy as np

    from helixmill.operators import stats
    from helixmill.plans import stat_queries

    d = "/root/testdata/sf0.001"
    gains: dict = {}
    for r in stat_queries._gains(spark, d).collect():
        gains.setdefault(r["direction"], {})[r["fiber"]] = r["gain"]
    got = {r["direction"]: (r["low"], r["high"]) for r in stat_queries.bca_interval(spark, d).collect()}
    direction = min(got)
    g = np.array([gains[direction][i] for i in range(len(gains[direction]))])
    below = [int(65536 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(8)]
    unit = lambda b, i: int(hashlib.sha256(f"boot|{b // 16}|{direction}|{i}".encode()).hexdigest()[b % 16 * 4 : b % 16 * 4 + 4], 16)
    weights = np.array([[sum(unit(b, i) >= t for t in below) for i in range(len(g))] for b in range(2000)])
    boot = [w @ g / w.sum() for w in weights if w.any()]
    skew = ((g - g.mean()) ** 3).mean() / g.std() ** 3
    want = stats.bca(g.mean(), boot, skew / (6 * len(g) ** 0.5))
    assert np.allclose(got[direction], want, rtol=1e-6, atol=1e-12)
