"""Sequence functions, the language and key normalisation against plain Python."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixmill.functions import names, sequence
from helixmill.functions.language import Dispersal, Language


def rows(spark, values, name="seq"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def test_names_digests_and_sequences(spark):
    df = rows(spark, [" GCall\t", "GCALL", "", "  ", None], "x")
    assert [r[0] for r in df.select(names.name_key("x")).collect()] == ["gcall", "gcall", None, None, None]
    df = rows(spark, [" SHA256:ABC ", "0xAbC", "abc\n", "", None, "sha256:"], "x")
    assert [r[0] for r in df.select(names.digest_key("x")).collect()] == ["abc", "abc", "abc", None, None, None]
    df = rows(spark, ["ac-gu 12N", "", None, "--"])
    assert [r[0] for r in df.select(names.normal_sequence("seq")).collect()] == ["ACGTN", "", None, ""]


def test_sequence_features(spark):
    rng = random.Random(1)
    seqs = ["".join(rng.choice("ACGT") for _ in range(rng.randint(1, 120))) for _ in range(200)] + ["", "A", "AAAA"]

    def longest(s):
        best = run = 0
        for i, c in enumerate(s):
            run = run + 1 if i and s[i - 1] == c else 1
            best = max(best, run)
        return best

    got = rows(spark, seqs).select("seq", sequence.gc_fraction("seq").alias("gc"), sequence.longest_run("seq").alias("run"), names.reverse_complement("seq").alias("rc")).collect()
    for r in got:
        s = r["seq"]
        assert r["gc"] == (sum(c in "GC" for c in s) / len(s) if s else 0.0)
        assert r["run"] == longest(s)
        assert r["rc"] == s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    assert rows(spark, [None]).select(sequence.gc_fraction("seq"), sequence.longest_run("seq")).first() == (None, None)


def test_common_substring_and_complement_words(spark):
    rng = random.Random(2)
    target = "ACGTTGCAAC"
    seqs = ["".join(rng.choice("ACGT") for _ in range(24)) for _ in range(100)] + [target + "A" * 14, ""]
    best = lambda s: max((k for k in range(1, 11) for i in range(11 - k) if target[i : i + k] in s), default=0)
    got = rows(spark, seqs).select("seq", sequence.longest_common_with(F.col("seq"), target).alias("n"), sequence.complement_words(F.col("seq"), target).alias("w")).collect()
    back = target[::-1].translate(str.maketrans("ACGT", "TGCA"))
    words = {back[i : i + 4] for i in range(7)}
    for r in got:
        assert r["n"] == best(r["seq"])
        assert r["w"] == sum(r["seq"][i : i + 4] in words for i in range(len(r["seq"]) - 3))


def test_score_keys_round_half_even_and_refuse_what_does_not_fit(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,), (-1.5,), (0.0,)], "x double")
    assert [r[0] for r in df.select(sequence.score_key("x", 1.0)).collect()] == [0, 2, 2, 0, -2, 0]
    for bad in (float("nan"), float("inf"), 1e8, -9.3e18, None):
        with pytest.raises(Exception, match="score out of range"):
            spark.createDataFrame([(bad,)], "x double").select(sequence.score_key("x", 1e12)).collect()


def test_crc(spark):
    import binascii

    texts = ["313233343536373839", "0", "ff00", "abcdef0123456789", None]
    got = rows(spark, texts, "h").select(sequence.crc16("h")).collect()
    assert got[0][0] == 0x29B1
    for t, r in zip(texts[:-1], got):
        assert r[0] == binascii.crc_hqx(bytes.fromhex(t if len(t) % 2 == 0 else "0" + t), 0xFFFF)
    assert got[-1][0] is None


def test_language_counts_and_round_trips():
    small = Language(8, 3, 5, 3)
    assert small.size == 45128
    words = [small.unrank(i) for i in range(small.size)]
    assert words == sorted(words) and len(set(words)) == small.size
    assert all(small.rank(w) == i for i, w in enumerate(words))
    assert small.unrank(-1) is None and small.unrank(small.size) is None
    assert [small.rank(w) for w in (None, "", "ACGTACG", "ACGTACGTA", "AAAACCGG", "AAATTTAA", "ACGTACGN")] == [None] * 7
    full = Language()
    assert full.size.bit_length() == 214
    assert full.unrank(0).startswith("AAAC") and full.rank(full.unrank(full.size - 1)) == full.size - 1


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(0, 4), st.integers(1, 4), st.data())
def test_any_language_round_trips(length, gc_min, max_run, data):
    lang = Language(length, gc_min, gc_min + 2, max_run)
    if lang.size:
        rank = data.draw(st.integers(0, lang.size - 1))
        assert lang.rank(lang.unrank(rank)) == rank


def test_dispersal_is_a_permutation():
    way = Dispersal(45128, "x")
    assert sorted(way.spread(i) for i in range(45128)) == list(range(45128))
    assert way.bits == 15 and all(way.gather(way.spread(i)) == (i if i < 1 << 15 else None) for i in range(0, 45128, 7))


def test_hash_rule_of_the_library(spark):
    assert rows(spark, ["ab"], "x").select(F.sha2(F.concat(F.lit("library|"), "x"), 256)).first()[0] == hashlib.sha256(b"library|ab").hexdigest()
