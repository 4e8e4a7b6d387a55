"""Members of fibers made and scored many at once, against the word-by-word code."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixmill.functions import sequence as S
from helixmill.functions.language import LETTERS, Dispersal, Language
from helixmill.operators import codec, members, stems
from helixmill.plans import context_queries as Q


def columns(texts):
    return np.array([[LETTERS.index(b) for b in t] for t in texts], np.uint8).T.copy()


def texts_of(base):
    return ["".join(LETTERS[b] for b in column) for column in base.T]


def at(words, ranks):
    return texts_of(words.at(words.limbs(ranks)))


@pytest.mark.parametrize("shape", [(108, 49, 59, 3), (7, 2, 5, 2), (20, 0, 20, 3), (31, 0, 9, 4), (45, 20, 25, 1)])
def test_words_at_ranks(shape):
    language, draw = Language(*shape), random.Random(3)
    words = members.Words(language)
    ranks = [0, 1, language.size - 1, *(draw.randrange(language.size) for _ in range(700))]
    for text in at(words, ranks[3:103]):  # the first and last words under a prefix: what is left of the rank is 0, or 1 short of the next
        under = language.rank(text)
        for layer_at in range(1, shape[0]):
            state = gc = left = 0
            for i, b in enumerate(text):
                if i >= layer_at:
                    left += language.totals[i][state][gc][LETTERS.index(b)]
                state, gc = language.next[state][LETTERS.index(b)], gc + (b in "CG")
            ranks += [r for r in (under - left, under - left - 1) if r >= 0]
            if len(ranks) > 4000:
                break
    assert at(words, ranks) == [language.unrank(r) for r in ranks]


def test_words_that_end_a_window_near_zero_are_exact():
    language = Language()
    words = members.Words(language)
    one = language.unrank(language.size // 3)
    state = gc = total = 0
    ranks = []
    for layer, b in zip(language.totals, one):  # the rank of each prefix's first word and those around it
        total += layer[state][gc][LETTERS.index(b)]
        state, gc = language.next[state][LETTERS.index(b)], gc + (b in "CG")
        ranks += [total - 1, total, total + 1]
    assert at(words, ranks) == [language.unrank(r) for r in ranks]


@pytest.mark.parametrize("length", [24, 25, 60, 108, 131])
def test_rows_are_those_of_the_feature_row(spark, length):
    draw = random.Random(length)
    texts = ["".join(draw.choice(LETTERS) for _ in range(length)) for _ in range(150)]
    back = lambda t: t[::-1].translate(str.maketrans("ACGT", "TGCA"))
    half = texts[0][: length // 2]
    left, right = back(S.LEFT_ADAPTER), back(S.RIGHT_ADAPTER)
    texts += [(half + "AAAA" + back(half))[:length], half + half + "A" * (length % 2), "A" * length, "AT" * (length // 2) + "A" * (length % 2), "GC" * (length // 2) + "G" * (length % 2)]
    texts += [(left + texts[1])[:length], (texts[2] + right)[-length:], (right[3:17] + texts[3])[:length], (texts[4] + left[2:11])[-length:], (S.RIGHT_ADAPTER + texts[5])[:length], (texts[6] + S.LEFT_ADAPTER)[-length:]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, seq string")
    wanted = {r["i"]: [r[f] for f in Q.FEATURES] for r in stems.features(df).collect()}
    got = [x.tolist() for x in members.Context(length).rows(columns(texts))]
    assert len(got) == len(Q.FEATURES)
    for i in range(len(texts)):
        assert [x[i] for x in got] == wanted[i], texts[i]


def test_namespace_gains_are_those_of_single_members(spark, monkeypatch):
    monkeypatch.setattr(members, "WORDS_AT_ONCE", 100)  # fibers are cut between blocks
    monkeypatch.setattr(members, "MEMBERS_AT_ONCE", 48)
    language, draw, names = Language(), random.Random(9), ["one", "two"]
    beyond = 1 << Dispersal(language.size, "one").bits
    rows = [(i, draw.choice("abx"), str(draw.randrange(beyond >> 8)), draw.choice([0, 1, 3, 5, 8])) for i in range(60)]
    rows += [(60, "a", "17", 3), (60, "a", "18", 3), (61, "b", str(beyond), 2), (62, "b", str((beyond >> 4) - 1), 4), (63, "a", str(beyond >> 4), 4)]
    fits = {"a": [draw.uniform(-1, 1) for _ in range(21)], "b": [0.5] + [0.0] * 20}  # all scores of b tie
    df = spark.createDataFrame(rows, "record_id long, pool string, payload_rank string, bits int")
    models = spark.createDataFrame([(p, *f) for p, f in fits.items()], "pool string, intercept double, " + ", ".join(f"b_{f} double" for f in Q.FEATURES))
    wanted = {}
    for j, name in enumerate(names):
        one = stems.features(codec.candidates(df, language, name)).join(models, "pool").withColumn("score", Q.linear()).where("score is not null")
        best = F.max_by("score", F.struct(S.score_key("score"), -F.col("choice")))
        fibers = one.groupBy("record_id", "pool", "bits").agg((best - F.avg("score")).alias("gain"))
        wanted |= {(r["pool"], r["bits"], j): (r["gain"], r["fibers"]) for r in fibers.groupBy("pool", "bits").agg(F.sum("gain").alias("gain"), F.count("*").alias("fibers")).collect()}
    records = df.groupBy("record_id", "pool", "bits").agg(F.collect_list("payload_rank").alias("payloads")).coalesce(1)
    got = {(r["pool"], r["bits"], r["namespace"]): (r["gain"], r["fibers"]) for r in members.namespace_gains(records, language, names, fits).collect()}
    assert got.keys() == wanted.keys()
    assert members.namespace_gains(records, language, names, {}).count() == 0
    for k, (gain, number) in got.items():
        assert number == wanted[k][1] and gain == pytest.approx(wanted[k][0], abs=1e-12)


def test_a_word_is_made_and_featured_in_microseconds():
    """Word by word it took over 100 microseconds; a table of 1 GB has tens of millions of members."""
    language, draw = Language(), random.Random(5)
    words, context, m = members.Words(language), members.Context(108), members.WORDS_AT_ONCE
    ranks = words.limbs([draw.randrange(language.size) for _ in range(m)])
    context.rows(words.at(ranks))
    began = time.process_time()
    context.rows(words.at(ranks))
    assert (time.process_time() - began) / m < 40e-6


def test_features_of_texts_of_many_lengths(spark, monkeypatch):
    monkeypatch.setattr(members, "MOST_LETTERS", 140)
    draw = random.Random(11)
    lengths = [108] * 300 + [24, 25, 31, 60, 107, 107, 129, 150, 700]
    draw.shuffle(lengths)
    df = spark.createDataFrame([(i, "".join(draw.choice(LETTERS) for _ in range(n))) for i, n in enumerate(lengths)], "i long, seq string").coalesce(1)
    wanted = {r["i"]: (r["seq"], *[float(r[f]) for f in Q.FEATURES]) for r in stems.features(df).collect()}
    assert {r["i"]: (r["seq"], *[r[f] for f in Q.FEATURES]) for r in members.features(df, Q.FEATURES).collect()} == wanted
    assert members.features(df.where("i < 0"), Q.FEATURES).count() == 0
