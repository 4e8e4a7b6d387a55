"""Readers, writers, manifests and the stream of words."""

import datetime as dt
import hashlib

import pytest

from helixmill.functions.language import Language
from helixmill.operators.expect import ExpectationError
from helixmill.sources import materialise, sequences, shared_folder, sinks
from helixmill.streaming import decode_stream


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one first\nACG\nt\n\n>two\r\nGG\r\nCC\r\n")
    (tmp_path / "b.fa").write_text(">bad\nACXG\n")
    assert sorted(map(tuple, sequences.read_fasta(spark, f"{tmp_path}/a.fa").collect())) == [("one", "ACGT"), ("two", "GGCC")]
    with pytest.raises(Exception, match="record bad"):
        sequences.read_fasta(spark, f"{tmp_path}/b.fa").collect()
    assert sequences.read_fasta(spark, f"{tmp_path}/b.fa", strict=False).first()["seq"] == "ACXG"


def test_pairs_and_strings(spark, tmp_path):
    (tmp_path / "p.txt").write_text("a,ACG\n# note\nb\tGGT\n\nacc\nc TTT\n")
    assert sorted(map(tuple, sequences.read_pairs(spark, f"{tmp_path}/p.txt").collect())) == [("a", "ACG"), ("b", "GGT"), ("c", "TTT"), ("seq2", "ACC")]
    (tmp_path / "s.tsv").write_text("#name\treads\nx\t01\n")
    assert sequences.read_strings(spark, f"{tmp_path}/s.tsv").collect()[0].asDict() == {"name": "x", "reads": "01"}


def test_ids_and_caches(spark):
    df = spark.createDataFrame([("12.0",), ("1234567",), (None,)], "id string")
    assert [r[0] for r in df.select(sequences.padded_id("id")).collect()] == ["000012", "1234567", None]
    rows, cache = spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("a", 1)], "k string, f int")
    known, missing = sequences.cached_features(rows, cache, "k")
    assert [tuple(r) for r in known.collect()] == [("a", 1)] and [r["k"] for r in missing.collect()] == ["b"]
    with pytest.raises(ExpectationError):
        sequences.cached_features(rows, cache.unionByName(cache), "k")


def test_text_tables_and_manifests(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.5, 1), ("b", 1 / 3, None), ("c", None, 2)], "k string, x double, n int")
    sinks.write_text_table(df.coalesce(1), f"{tmp_path}/out")
    text = next((tmp_path / "out").glob("*.csv")).read_text().splitlines()
    assert text[0] == "k\tx\tn" and "a\t0.5\t1" in text and "b\t0.333333333333\t" in [t.rstrip('"').rstrip('"') for t in text]
    with pytest.raises(ValueError, match="empty"):
        sinks.write_text_table(df.where("false"), f"{tmp_path}/none")
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "x.txt").write_text("hello\n")
    listed = sinks.manifest(spark, f"{tmp_path}/files")
    row = listed.first()
    assert (row["bytes"], row["sha256"]) == (6, hashlib.sha256(b"hello\n").hexdigest()) and row["git_blob"] == "ce013625030ba8dba906f756967f9e9ca394464a"
    kept = materialise(listed, "manifest")
    assert sinks.verify_manifest(spark, kept, f"{tmp_path}/files").count() == 0
    (tmp_path / "files" / "x.txt").write_text("hallo\n")
    (tmp_path / "files" / "y.txt").write_text("new")
    assert sorted(r["problem"] for r in sinks.verify_manifest(spark, kept, f"{tmp_path}/files").collect()) == ["hash", "unexpected"]


def test_json(spark, tmp_path):
    sinks.write_json({"b": 1, "a": [2]}, f"{tmp_path}/j", spark)
    assert next((tmp_path / "j").glob("*.txt")).read_text() == '{"a": [2], "b": 1}\n'


def test_shared_folder_is_the_sessions(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_stream_decodes_each_record_once(spark, tmp_path):
    lang = Language(8, 3, 5, 3)
    words = [lang.unrank(i) for i in (0, 5, 77)]
    at = dt.datetime(2025, 1, 1)
    rows = [(i, w, 1, at) for i, w in enumerate(words)] + [(0, words[0].lower(), 1, at + dt.timedelta(hours=1)), (9, None, 1, at)]
    spark.createDataFrame(rows, "record_id long, sequence string, selector_bits int, ingested_at timestamp").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("record_id long, sequence string, selector_bits int, ingested_at timestamp").parquet(f"{tmp_path}/in")
    query = decode_stream(stream, lang, "n").writeStream.format("memory").queryName("decoded").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.table("decoded").collect()
    assert sorted(r["record_id"] for r in got) == [0, 1, 2, 9]
    assert {r["record_id"]: r["rank"] for r in got}[2] == "77"
