"""Ingestion: metadata, identities, status, change detection, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions.normalize import article_key, collapse_spaces, is_article_key

STATUSES = ("indexed_pending_validation", "approved", "disabled")
YEARS = (1800, 9999)


def metadata_violations(rows: DataFrame) -> DataFrame:
    """Rows (document_id, field) of what is wrong with documents' metadata; a year must be whole and in range."""
    blank = {c: F.coalesce(F.length(collapse_spaces(F.col(c))) == 0, F.lit(True)) for c in ("document_id", "source_key", "official_code", "title")}
    wrong = blank | {"year": F.coalesce(~F.col("year").between(*YEARS), F.lit(True)), "status": F.coalesce(~F.col("status").isin(*STATUSES), F.lit(True))}
    fields = F.array_compact(F.array(*(F.when(v, F.lit(k)) for k, v in wrong.items())))
    return rows.select("document_id", F.explode(fields).alias("field"))


def transition(old: Column, new: Column) -> Column:
    """What a document's change of status is: insert, keep, disable, or error."""
    return (
        F.when(old.isNull() & (new == "indexed_pending_validation"), "insert")
        .when(old == new, "keep")
        .when(old.isin("indexed_pending_validation", "approved") & (new == "disabled"), "disable")
        .otherwise("error")
    )


def identity_conflicts(incoming: DataFrame, existing: DataFrame, keys: list[str], row: str) -> DataFrame:
    """Rows of ``incoming`` that share any of the keys with an existing one: an equi semi-join a key, not an OR-join."""
    found: DataFrame | None = None
    for key in keys:
        hit = incoming.join(existing.select(F.col(key)).distinct(), key, "left_semi").select(row)
        found = hit if found is None else found.unionByName(hit)
    return incoming.join(found.distinct(), row, "left_semi")


def unchanged(left: DataFrame, right: DataFrame, *, key: str, content: str) -> DataFrame:
    """Rows (key, is_unchanged) of all keys on the left: whether both have the same contents, each as often."""
    counted = lambda rows, n: rows.groupBy(key, content).agg(F.count(F.lit(1)).alias(n))
    both = counted(left, "a").join(counted(right, "b"), [key, content], "full")
    same = both.groupBy(key).agg(F.bool_and(F.col("a").eqNullSafe(F.col("b"))).alias("is_unchanged"))
    return left.select(key).distinct().join(same, key)


def orphans(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose parent is missing."""
    return child.join(parent.select(*keys).distinct(), keys, "left_anti")


def with_chunk_order(chunks: DataFrame, *, document: str, order: list[str]) -> DataFrame:
    return chunks.withColumn("chunk_order", F.row_number().over(Window.partitionBy(document).orderBy(*order)))


def chunk_violations(chunks: DataFrame, *, document: str, article: str, text: str, limit: int = 1000) -> DataFrame:
    """Rows (document, article, problem) of chunks that may not be loaded."""
    blank = F.coalesce(F.length(collapse_spaces(F.col(text))) == 0, F.lit(True))
    problem = F.when(~is_article_key(article_key(F.col(article))), "article").when(blank, "blank").when(F.length(text) > limit, "too_long")
    return chunks.select(document, article, problem.alias("problem")).where("problem is not null")


def unique_or_null(found: Column) -> Column:
    """The one distinct value that was found, or null if there are none or several."""
    distinct = F.array_distinct(found)
    return F.when(F.size(distinct) == 1, F.get(distinct, F.lit(0)))


# Where a regulation's first pages name it.
CODE_LINE = r"(?im)^\s*((?:NP|P|I|C|NE|GP|GT|CR|STAS|SR(?:\s+EN(?:\s+ISO)?)?)\s*\d+(?:\s*[./-]\s*\d+){0,3}(?:\s*[-/]\s*\d{4})?)\s*$"
TITLE_LINE = r"(?imu)^\s*((?:NORMATIV(?:UL)?|REGLEMENTARE(?:A)?|GHID(?:UL)?|INSTRUCȚIUNI(?:LE)?|INSTRUCTIUNI(?:LE)?|COD(?:UL)?|METODOLOGIA)\b[^\n]{12,500})\s*$"
YEAR = r"(?:^|[^0-9])(18[0-9]{2}|19[0-9]{2}|20[0-9]{2})(?:$|[^0-9])"


def metadata_candidates(text: Column) -> Column:
    """(codes, titles, years): the distinct ones that a text's lines name, in order; years are those of the codes."""
    found = lambda pattern: F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), collapse_spaces))
    codes = found(CODE_LINE)
    years = F.array_distinct(F.flatten(F.transform(codes, lambda c: F.transform(F.regexp_extract_all(c, F.lit(YEAR), F.lit(1)), lambda y: y.cast("int")))))
    return F.struct(codes.alias("codes"), found(TITLE_LINE).alias("titles"), years.alias("years"))


def discovered_metadata(rows: DataFrame, *, text: str, sha256: str) -> DataFrame:
    """Add document_id, source_key, official_code, title, year and problem. A document is named only by a single dated
    code, a single title and a single year; otherwise all are null and ``problem`` is ambiguous_metadata."""
    found = rows.withColumn("__m", metadata_candidates(F.col(text)))
    dated = F.filter("__m.codes", lambda c: c.rlike(YEAR))
    years = F.transform(F.regexp_extract_all(F.get(dated, F.lit(0)), F.lit(YEAR), F.lit(1)), lambda y: y.cast("int"))
    found = found.withColumn("__code", unique_or_null(dated)).withColumn("__title", unique_or_null(F.col("__m.titles"))).withColumn("__year", unique_or_null(years))
    named = F.col("__code").isNotNull() & F.col("__title").isNotNull() & F.col("__year").isNotNull() & (F.size(F.regexp_extract_all(F.lower("__code"), F.lit("[a-z]+|[0-9]+"), F.lit(0))) >= 3)
    values = {"document_id": document_id_of(F.col("__code")), "source_key": F.concat(F.lit("pdf_"), F.col(sha256)), "official_code": F.col("__code"), "title": F.col("__title"), "year": F.col("__year")}
    found = found.select("*", *(F.when(named, v).alias(k) for k, v in values.items()), F.when(~F.coalesce(named, F.lit(False)), "ambiguous_metadata").alias("problem"))
    return found.drop("__m", "__code", "__title", "__year")


def preflight(extractions: DataFrame, chunks: DataFrame, *, key: str = "source_sha256") -> DataFrame:
    """Rows (key, status, page_count, character_count, chunk_count, official_code, title, year) of extracted files.

    extractions: key, sha256_before, sha256_after, text, pages; chunks: key, problem (null for a sound one). A file is
    ready_for_human_metadata, or in this order: unstable_pdf (it changed meanwhile), invalid_extraction (no text or no
    pages), invalid_chunks (none, or an unsound one), ambiguous_metadata (not just one code, title and year).
    """
    counted = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("chunk_count"), F.count("problem").alias("__wrong"))
    rows = extractions.join(counted, key, "left").withColumn("__m", metadata_candidates(F.col("text")))
    one = {"official_code": "codes", "title": "titles", "year": "years"}
    ready = "ready_for_human_metadata"
    status = (
        F.when(~F.col("sha256_before").eqNullSafe(F.col("sha256_after")), "unstable_pdf")
        .when((F.length(collapse_spaces(F.coalesce("text", F.lit("")))) == 0) | ~F.coalesce(F.col("pages") > 0, F.lit(False)), "invalid_extraction")
        .when((F.coalesce("chunk_count", F.lit(0)) == 0) | (F.col("__wrong") > 0), "invalid_chunks")
        .when(F.greatest(*(F.abs(F.size(F.col(f"__m.{v}")) - 1) for v in one.values())) > 0, "ambiguous_metadata")
        .otherwise(ready)
    )
    rows = rows.withColumn("status", status)
    is_ready = F.col("status") == ready
    facts = {"page_count": F.col("pages"), "character_count": F.length("text"), "chunk_count": F.col("chunk_count")} | {k: F.get(F.col(f"__m.{v}"), F.lit(0)) for k, v in one.items()}
    return rows.select(key, "status", *(F.when(is_ready, v).alias(k) for k, v in facts.items()))


def document_id_of(code: Column) -> Column:
    """Letters and first number together, further numbers after underscores, in lower case."""
    parts = F.regexp_extract_all(F.lower(code), F.lit("[a-z]+|[0-9]+"), F.lit(0))
    head = F.concat(F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)), F.lit("")))
    return F.array_join(F.concat(F.array(head), F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0)))), "_")


def gate(coverage: DataFrame, thresholds: DataFrame, *, key: str) -> DataFrame:
    """Add passes: enough coverage, no header left in a chunk, at least one chunk. ``coverage``: key, coverage,
    header_chunks, chunks. A document without a threshold does not pass."""
    rows = coverage.join(thresholds, key, "left")
    passes = (F.col("coverage") >= F.col("min_coverage")) & (F.col("header_chunks") == 0) & (F.col("chunks") > 0)
    return rows.withColumn("passes", F.coalesce(passes, F.lit(False)))


def missing_articles(wanted: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.select(*keys).distinct().join(found.select(*keys).distinct(), keys, "left_anti")


def reconciled(report: DataFrame, imported: DataFrame, *, key: str, fields: list[str]) -> DataFrame:
    """Add matches: the import has every field as the report says."""
    theirs = imported.select(key, *(F.col(f).alias(f"__{f}") for f in fields), F.lit(True).alias("__seen"))
    rows = report.join(theirs, key, "left")
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"__{f}"))
    return rows.withColumn("matches", F.coalesce("__seen", F.lit(False)) & same).select(*report.columns, "matches")


def approve(documents: DataFrame, wanted: DataFrame, chunk_counts: DataFrame) -> DataFrame:
    """Documents with their new status. ``wanted``: document_id, source_key, chunks. A document is approved if it is
    pending or approved already, has this source, and as many chunks; otherwise nothing changes and ``refused`` is true."""
    rows = documents.join(wanted.select("document_id", F.col("source_key").alias("__source"), F.col("chunks").alias("__wanted")), "document_id", "left")
    rows = rows.join(chunk_counts.select("document_id", F.col("chunks").alias("__has")), "document_id", "left")
    asked = F.col("__source").isNotNull()
    ok = (F.col("source_key") == F.col("__source")) & (F.coalesce("__has", F.lit(0)) == F.col("__wanted")) & F.col("status").isin("indexed_pending_validation", "approved")
    return rows.withColumn("refused", asked & ~ok).withColumn("status", F.when(asked & ok, "approved").otherwise(F.col("status"))).drop("__source", "__wanted", "__has")


def disable(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """Documents with their new status. ``wanted``: document_id, source_key. A document is disabled if it is pending,
    approved or disabled already, and has this source; otherwise nothing changes and ``refused`` is true."""
    rows = documents.join(wanted.select("document_id", F.col("source_key").alias("__source")), "document_id", "left")
    asked = F.col("__source").isNotNull()
    ok = (F.col("source_key") == F.col("__source")) & F.col("status").isin(*STATUSES)
    return rows.withColumn("refused", asked & ~ok).withColumn("status", F.when(asked & ok, "disabled").otherwise(F.col("status"))).drop("__source")


def backfill(chunks: DataFrame, documents: DataFrame, *, on: str, column: str) -> DataFrame:
    """Set ``column`` of chunks from their documents; what has no document keeps null."""
    return chunks.drop(column).join(documents.select(on, column), on, "left")


def still_as_evaluated(now: DataFrame, then: DataFrame, keys: list[str]) -> bool:
    """Whether nothing that was evaluated has changed since: status, source and counts, all in ``keys``."""
    a, b = now.select(*keys), then.select(*keys)
    return a.exceptAll(b).unionByName(b.exceptAll(a)).limit(1).count() == 0
