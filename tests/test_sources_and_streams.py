import json

import pytest
from pyspark.sql import functions as F

from dossier.operators import accounting
from dossier.sources import documents
from dossier.streaming import accounting as stream

META = {"document_id": "np1", "source_key": "s", "official_code": "NP 1-2000", "title": "T", "year": 2000, "status": "approved"}


def test_collection_of_folders(spark, tmp_path):
    for folder, meta in (("np1", META), ("bad", META | {"document_id": "np2", "year": 12, "status": "x"}), ("_skip", META)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "metadata.json").write_text(json.dumps(meta), encoding="utf-8-sig" if folder == "np1" else "utf-8")
        (tmp_path / folder / "extracted.txt").write_text("linia 1\nșir\n")
    good, bad = documents.read_collection(spark, str(tmp_path))
    assert [(r.document_id, r.text) for r in good.collect()] == [("np1", "linia 1\nșir\n")]
    assert [(r.folder, r.problems) for r in bad.collect()] == [("bad", ["status", "year"])]


def test_partitions_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "chunks")
    rows = lambda d, n: spark.range(n).select(F.lit(d).alias("document_id"), "id")
    documents.replace_documents(rows("a", 3).unionByName(rows("b", 2)), path)
    documents.replace_documents(rows("a", 1), path)
    counts = {r.document_id: r["count"] for r in spark.read.parquet(path).groupBy("document_id").count().collect()}
    assert counts == {"a": 1, "b": 2}
    documents.append_new(rows("b", 9).unionByName(rows("c", 4)), spark.read.parquet(path), path)
    counts = {r.document_id: r["count"] for r in spark.read.parquet(path).groupBy("document_id").count().collect()}
    assert counts == {"a": 1, "b": 2, "c": 4}


def test_backup_and_restore(spark, tmp_path):
    table = spark.createDataFrame([(1, [0.5, -1.0]), (2, None)], "id int, embedding array<float>")
    assert documents.backup(table, str(tmp_path / "b")) == 2
    back = documents.restore(spark, str(tmp_path / "b"), "id int, embedding string")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, table.collect()))
    with pytest.raises(Exception, match="(?i)exist"):
        documents.backup(table, str(tmp_path / "b"))


def test_gold_sets(spark, tmp_path):
    cases = [
        {"id": "a", "type": "exact", "question": "q", "expected": [{"document_id": "d", "article": "3.1. (A)."}]},
        {"id": "b", "type": "negative", "question": "q", "expected": []},
        {"id": "b", "type": "odd", "question": " ", "expected": []},
        {"id": "c", "type": "negative", "question": "q", "expected": [{"document_id": "d", "article": "a_b"}]},
    ]
    (tmp_path / "gold.json").write_text("\n".join(map(json.dumps, cases)))
    normal, wrong = documents.read_gold(spark, str(tmp_path / "gold.json"))
    assert normal.where("id = 'a'").first().expected[0].article == "3.1.(a)"
    got = sorted((r.id, r.problem) for r in wrong.collect())
    assert got == [("b", "expected"), ("b", "question"), ("b", "repeated"), ("b", "type"), ("c", "article"), ("c", "expected")]
    sized = spark.createDataFrame([("exact",)] * 8 + [("x",)], "category string")
    assert sorted(r.category for r in documents.manifest_violations(sized, {"exact": 8, "semantic": 8}).collect()) == ["semantic", "x"]


def test_glyph_codes(spark):
    codes = spark.createDataFrame([(1, 0, "f", None, "a"), (1, 1, "f", 7, None), (1, 2, "f", 9, None)], "page int, seq int, font string, code int, char string")
    texts, missing = documents.decode_glyphs(codes, spark.createDataFrame([("f", 7, "ș")], "font string, code int, char string"))
    assert texts.first().text == "aș" and [(r.font, r.code, r.n) for r in missing.collect()] == [("f", 9, 1)]


def test_streams_agree_with_batches(spark, tmp_path):
    from conftest import TESTDATA

    rows = spark.read.parquet(f"{TESTDATA}/sf0.001/events.parquet").select(F.col("user_id").cast("string").alias("caller"), "event_id", "ts", (F.col("event_type") != "error").alias("consumes"))
    path = str(tmp_path / "events")
    rows.orderBy("ts").coalesce(1).write.parquet(path)
    source = lambda: stream.events_of(spark, path, rows.schema)
    got = stream.run_available(stream.rate_limited(source().select("caller", "event_id", "ts"), 1, 2, expire=False), "t")
    want = accounting.rate_limited(rows, caller="caller", ts="ts", order=["ts", "event_id"], per_minute=1, per_hour=2)
    key = lambda df: sorted(map(tuple, df.select("event_id", "minute_count", "hour_count", "allowed").collect()))
    assert key(got) == key(want)
    visitors = source().select(F.col("caller").alias("visitor"), "event_id", "ts", "consumes")
    used = stream.run_available(stream.within_quota(visitors, 3), "q").select("event_id", "used", "reserved")
    want = accounting.within_quota(rows, visitor="caller", order=["ts", "event_id"], consumes=F.col("consumes"), quota=3).select("event_id", "used", "reserved")
    assert sorted(map(tuple, used.collect())) == sorted(map(tuple, want.collect()))
