"""Reading and writing collections: folders of texts, backups, reports, gold sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions.normalize import article_key, collapse_spaces, is_article_key
from dossier.operators.lifecycle import metadata_violations

METADATA = "document_id string, source_key string, official_code string, title string, year int, status string"
GOLD = "id string, type string, question string, expected array<struct<document_id:string,article:string>>"
GOLD_KEYS = ("id", "type", "question", "expected")
MAX_CASES = 36


def read_collection(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(documents with text, rejected folders with what is wrong). Each folder under ``root`` whose name does not begin
    with an underscore has a metadata.json and an extracted.txt; one that lacks either is rejected."""
    folder = F.regexp_extract(F.input_file_name(), "([^/]+)/[^/]+$", 1)
    found = spark.read.schema(METADATA).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "metadata.json").json(root)
    found = found.withColumn("folder", folder).where(~F.col("folder").startswith("_"))
    texts = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "extracted.txt").text(root, wholetext=True)
    texts = texts.select(folder.alias("folder"), F.regexp_replace("value", "^﻿", "").alias("text")).where(~F.col("folder").startswith("_"))
    lacking = found.select("folder").join(texts.select("folder"), "folder", "left_anti").select("folder", F.array(F.lit("extracted.txt")).alias("problems"))
    lacking = lacking.unionByName(texts.select("folder").join(found.select("folder"), "folder", "left_anti").select("folder", F.array(F.lit("metadata.json")).alias("problems")))
    rows = found.join(texts, "folder")
    wrong = metadata_violations(rows.withColumn("document_id", F.coalesce("document_id", "folder")))
    bad = wrong.groupBy(F.col("document_id").alias("__id")).agg(F.array_sort(F.collect_list("field")).alias("problems"))
    keyed = rows.withColumn("__id", F.coalesce("document_id", "folder"))
    return keyed.join(bad, "__id", "left_anti").drop("__id"), keyed.join(bad, "__id").select("folder", "problems").unionByName(lacking)


def not_yet_extracted(spark: SparkSession, root: str, done: DataFrame, pattern: str = "*.pdf") -> DataFrame:
    """Rows (path, length, sha256) of files whose folder has no extracted text yet."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    rows = files.select("path", "length", F.sha2("content", 256).alias("sha256"), F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("folder"))
    return rows.join(done.select("folder").distinct(), "folder", "left_anti")


def decode_glyphs(codes: DataFrame, table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(page texts, what is missing by font and code). codes: page, seq, font, code, char, where char is null for a
    glyph code; table: font, code, char."""
    rows = codes.join(table.select("font", "code", F.col("char").alias("__c")), ["font", "code"], "left").withColumn("char", F.coalesce("char", "__c"))
    listed = rows.where("char is not null").groupBy("page").agg(F.array_sort(F.collect_list(F.struct("seq", "char"))).alias("l"))
    missing = rows.where("char is null").groupBy("font", "code").agg(F.count(F.lit(1)).alias("n"))
    return listed.select("page", F.array_join(F.col("l.char"), "").alias("text")), missing


def read_glyph_table(spark: SparkSession, path: str) -> DataFrame:
    """Rows (font, code, char) of a JSON file of fonts, each a map of codes."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,map<string,struct<char:string>>>").alias("m"))
    return raw.select(F.explode("m").alias("font", "codes")).select("font", F.explode("codes").alias("code", "entry")).select("font", "code", "entry.char")


def replace_documents(chunks: DataFrame, path: str, document: str = "document_id") -> None:
    """Write chunks so that each document in them replaces its own partition, and no other one is touched."""
    chunks.repartition(document).write.partitionBy(document).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


PENDING, APPROVED = "indexed_pending_validation", "approved"


def append_new(chunks: DataFrame, existing: DataFrame, path: str, document: str = "document_id") -> DataFrame:
    """Append chunks of documents that are not there yet, and return those rows. A new document is always pending,
    whatever its rows say of their status."""
    fresh = chunks.join(existing.select(document).distinct(), document, "left_anti")
    fresh = fresh.withColumn("status", F.lit(PENDING)) if "status" in fresh.columns else fresh
    fresh.write.partitionBy(document).mode("append").parquet(path)
    return fresh


def replace_pending(chunks: DataFrame, documents: DataFrame, path: str, document: str = "document_id") -> DataFrame:
    """Replace the chunks of documents that are still pending. Returns rows (document, status) of those that were
    refused: not pending, or not known (null)."""
    known = documents.select(document, F.col("status").alias("__now"))
    rows = chunks.join(known, document, "left")
    replace_documents(rows.where(F.col("__now") == PENDING).drop("__now"), path, document)
    return rows.where(~F.col("__now").eqNullSafe(F.lit(PENDING))).select(document, F.col("__now").alias("status")).distinct()


def replace_approved(chunks: DataFrame, current: DataFrame, judged: DataFrame, documents: DataFrame, path: str, backup_path: str, document: str = "document_id") -> DataFrame:
    """Replace the chunks of approved documents that pass the gate (``judged``: document, passes), after the chunks
    they have now were written to ``backup_path``, where nothing may be yet. Returns rows (document, passes, status) of
    those that were refused; without a verdict or without approval a document is refused."""
    verdict = chunks.select(document).distinct().join(judged.select(document, "passes"), document, "left").join(documents.select(document, "status"), document, "left")
    good = F.coalesce(F.col("passes") & (F.col("status") == APPROVED), F.lit(False))
    ready = verdict.where(good).select(document)
    backup(current.join(ready, document, "left_semi"), backup_path)
    replace_documents(chunks.join(ready, document, "left_semi"), path, document)
    return verdict.where(~good)


def backup(table: DataFrame, path: str, as_text: tuple[str, ...] = ("embedding",)) -> int:
    """Write a table as JSON, arrays as text, and return its number of rows. An existing backup is not replaced."""
    rows = table.withColumns({c: F.to_json(c) for c in as_text if c in table.columns})
    rows.write.mode("errorifexists").option("ignoreNullFields", False).json(path)
    return rows.count()


def restore(spark: SparkSession, path: str, schema: str, vectors: tuple[str, ...] = ("embedding",)) -> DataFrame:
    """A backup, with its explicit schema; vectors are read from their text."""
    rows = spark.read.schema(schema).json(path)
    return rows.withColumns({c: F.from_json(c, "array<float>") for c in vectors if c in rows.columns})


def restore_problems(rows: DataFrame, documents: DataFrame, fields: list[str], document: str = "document_id") -> DataFrame:
    """Rows (document, problem) of a backup that may not be restored: a document that is not known, or whose ``fields``
    are not those of the rows (identity), rows without a text or a content hash, and hashes of other texts."""
    now = documents.select(document, *(F.col(f).alias(f"__{f}") for f in fields), F.lit(True).alias("__known"))
    joined = rows.join(now, document, "left")
    differs = F.lit(False)
    for f in fields:
        differs = differs | ~F.col(f).eqNullSafe(F.col(f"__{f}"))
    problem = (
        F.when(F.col("__known").isNull(), "unknown_document")
        .when(differs, "identity")
        .when(F.col("text").isNull() | F.col("content_hash").isNull(), "missing_field")
        .when(F.md5("text") != F.col("content_hash"), "content_hash")
    )
    return joined.select(document, problem.alias("problem")).where("problem is not null").distinct()


def write_report(report: DataFrame, path: str) -> None:
    """A report, once, in one file; the commit protocol makes it appear whole or not at all. Reports are small."""
    report.coalesce(1).write.mode("errorifexists").json(path)


def read_gold(spark: SparkSession, path: str, limit: int = MAX_CASES) -> tuple[DataFrame, DataFrame]:
    """(cases with normalised articles, violations as rows (id, problem)) of a gold set, one JSON case a line."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = F.from_json("value", GOLD + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    cases = lines.select(parsed.alias("c"), F.coalesce(F.array_except(F.json_object_keys("value"), F.array(*map(F.lit, GOLD_KEYS))), F.array().cast("array<string>")).alias("_extra")).select("c.*", "_extra")
    key = lambda e: F.struct(e["document_id"].alias("document_id"), article_key(e["article"]).alias("article"))
    normal = cases.withColumn("expected", F.transform("expected", key))
    negative = F.col("type") == "negative"
    checks = {
        "not_json": F.col("_corrupt").isNotNull(),
        "extra_key": F.size("_extra") > 0,
        "id": F.coalesce(collapse_spaces(F.col("id")) == "", F.lit(True)),
        "type": ~F.coalesce(F.col("type").isin("exact", "semantic", "negative"), F.lit(False)),
        "question": F.coalesce(collapse_spaces(F.col("question")) == "", F.lit(True)),
        "expected": (F.coalesce(F.size("expected"), F.lit(0)) > 0) == negative,
        "article": F.coalesce(F.exists("expected", lambda e: ~is_article_key(e["article"])), F.lit(False)),
    }
    per_case = normal.select("id", F.explode(F.array_compact(F.array(*(F.when(v, F.lit(k)) for k, v in checks.items())))).alias("problem"))
    repeated = normal.groupBy("id").count().where("count > 1").select("id", F.lit("repeated").alias("problem"))
    total = normal.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select(F.lit(None).cast("string").alias("id"), F.lit("too_many").alias("problem"))
    return normal.drop("_corrupt", "_extra"), per_case.unionByName(repeated).unionByName(total)


def manifest_violations(cases: DataFrame, wanted: dict[str, int]) -> DataFrame:
    """Rows (category, n, wanted) of categories that have not exactly as many cases as they should."""
    spark = cases.sparkSession
    rule = spark.createDataFrame(list(wanted.items()), "category string, wanted long")
    found = cases.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return rule.join(found, "category", "full").na.fill(0, ["n", "wanted"]).where("n <> wanted").select("category", "n", "wanted")
