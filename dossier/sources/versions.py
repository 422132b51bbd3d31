"""Tables whose changes are commits: what a reader sees changes at once or not at all, and a change that was prepared
on another state than the one it meets is refused.

A table is a folder. ``parts/`` has immutable folders of rows, ``index/`` one of rows (document, part, rows) for each
commit, a row a document, and ``commits/`` numbered files that name an index. A commit is the creation of the next
number's file, which only one writer can do; what a failed writer leaves behind is named by nothing. A commit writes the
changed documents' rows and the index, not the table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dossier.sources.documents import APPROVED, PENDING, backup, restore, restore_problems


class Refused(RuntimeError):
    """Nothing was changed; ``problems`` says why, as a number of documents by reason."""

    def __init__(self, problems: dict[str, int]):
        super().__init__(", ".join(f"{k}: {v}" for k, v in sorted(problems.items())))
        self.problems = problems


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def last_commit(spark: SparkSession, table: str) -> int:
    """The number of the newest commit, -1 for a table that has none."""
    files, place = _files(spark, f"{table}/commits")
    if not files.exists(place):
        return -1
    return max((int(f.getPath().getName()) for f in files.listStatus(place)), default=-1)


def _commit(spark: SparkSession, table: str, number: int, index: str) -> None:
    files, place = _files(spark, f"{table}/commits/{number}")
    try:
        out = files.create(place, False)  # fails if it is there
    except Exception as error:
        if files.exists(place):
            raise Refused({"changed_meanwhile": 1}) from error
        raise
    out.write(bytearray(index.encode()))
    out.close()


def index_of(spark: SparkSession, table: str, number: int, document: str = "document_id") -> DataFrame:
    """Rows (document, part, rows) of a commit."""
    if number < 0:
        return spark.createDataFrame([], f"`{document}` string, part string, rows long")
    name = spark.read.text(f"{table}/commits/{number}").first()[0]
    return spark.read.parquet(f"{table}/index/{name}")


def read_table(spark: SparkSession, table: str, schema: StructType | str, number: int | None = None, document: str = "document_id") -> DataFrame:
    """The table's rows as of a commit, by default the newest. Folders without a live document are not read."""
    number = last_commit(spark, table) if number is None else number
    index = index_of(spark, table, number, document)
    names = [r["part"] for r in index.select("part").distinct().collect()]  # a row a commit since the last compaction
    if not names:
        return spark.createDataFrame([], schema)
    part = F.element_at(F.split(F.input_file_name(), "/"), -2)
    rows = spark.read.schema(schema).parquet(*(f"{table}/parts/{n}" for n in names)).withColumn("part", part)
    return rows.join(index.select(document, "part"), [document, "part"], "left_semi").drop("part")


def _problems(rows: DataFrame) -> dict[str, int]:
    return {r["problem"]: r["count"] for r in rows.groupBy("problem").count().collect()}


def write_documents(spark: SparkSession, table: str, chunks: DataFrame, number: int, *, document: str = "document_id", replaces: bool | None = None) -> int:
    """Commit ``number`` + 1: the documents of ``chunks`` with these rows, and all others as they were in ``number``.

    Raises Refused, and changes nothing, if another commit came meanwhile, if rows have no document, if the rows that
    were written are not as many as those given for each document, or if documents are there and should not be
    (``replaces`` False) or the other way round (True); each replaced document had rows. Returns the new number.
    """
    spark_index = index_of(spark, table, number, document)
    part, name = uuid.uuid4().hex, uuid.uuid4().hex
    chunks.repartition(document).write.parquet(f"{table}/parts/{part}")
    written = spark.read.schema(chunks.schema).parquet(f"{table}/parts/{part}").groupBy(document).agg(F.count(F.lit(1)).alias("rows"))
    given = chunks.groupBy(F.col(document).alias("__d")).agg(F.count(F.lit(1)).alias("__given"))
    old = spark_index.select(F.col(document).alias("__o"), F.col("rows").alias("__old"))
    checked = written.join(given, F.col(document).eqNullSafe(F.col("__d")), "full").join(old, F.col(document) == F.col("__o"), "left")
    problem = F.when(F.col(document).isNull(), "no_document").when(~F.col("rows").eqNullSafe(F.col("__given")), "rows_written")
    if replaces is not None:
        there = F.coalesce(F.col("__old") > 0, F.lit(False))
        problem = problem.when(there if not replaces else ~there, "exists" if not replaces else "nothing_to_replace")
    if found := _problems(checked.select(problem.alias("problem")).where("problem is not null")):
        raise Refused(found)
    fresh = written.select(document, F.lit(part).alias("part"), "rows")
    kept = spark_index.join(written.select(document), document, "left_anti").select(document, "part", "rows")
    kept.unionByName(fresh).write.parquet(f"{table}/index/{name}")
    if last_commit(spark, table) != number:
        raise Refused({"changed_meanwhile": 1})
    _commit(spark, table, number + 1, name)
    return number + 1


def unchanged_since(index: DataFrame, documents: DataFrame, evaluated: DataFrame, fields: tuple[str, ...] = ("status", "source_key"), document: str = "document_id") -> DataFrame:
    """Rows (document, problem) of evaluated documents whose number of rows or whose ``fields`` are not what they were.
    evaluated: document, rows and the fields. documents: document and the fields, as they are now."""
    now = documents.select(document, *(F.col(f).alias(f"__{f}") for f in fields)).join(index.select(document, F.col("rows").alias("__rows")), document, "left")
    joined = evaluated.join(now, document, "left")
    problem = F.when(~F.col("rows").eqNullSafe(F.col("__rows")), "rows_changed")
    for f in fields:
        problem = problem.when(~F.col(f).eqNullSafe(F.col(f"__{f}")), f"{f}_changed")
    return joined.select(document, problem.alias("problem")).where("problem is not null")


def replace_in_status(spark: SparkSession, table: str, chunks: DataFrame, documents: DataFrame, number: int, *, status: str = PENDING, document: str = "document_id") -> int:
    """Replace the rows of documents that are all known and in ``status``; otherwise nothing is replaced."""
    known = chunks.select(document).distinct().join(documents.select(document, F.col("status").alias("__now")), document, "left")
    wrong = known.where(~F.col("__now").eqNullSafe(F.lit(status)))
    if found := _problems(wrong.select(F.when(F.col("__now").isNull(), "unknown_document").otherwise("status").alias("problem"))):
        raise Refused(found)
    return write_documents(spark, table, chunks, number, document=document, replaces=True)


def replace_behind_gate(spark: SparkSession, table: str, chunks: DataFrame, judged: DataFrame, evaluated: DataFrame, documents: DataFrame, number: int, backup_path: str, *, fields: tuple[str, ...] = ("status", "source_key"), document: str = "document_id") -> int:
    """Replace approved documents that all pass the gate (judged: document, passes) and are as they were evaluated, after
    their rows as of ``number`` were written to ``backup_path``."""
    named = chunks.select(document).distinct()
    verdict = named.join(judged.select(document, "passes"), document, "left").where(~F.coalesce("passes", F.lit(False)))
    moved = unchanged_since(index_of(spark, table, number, document), documents, evaluated, fields, document)
    unseen = named.join(evaluated.select(document), document, "left_anti").select(F.lit("not_evaluated").alias("problem"))
    found = _problems(verdict.select(F.lit("gate").alias("problem")).unionByName(moved.join(named, document, "left_semi").select("problem")).unionByName(unseen))
    if found:
        raise Refused(found)
    backup(read_table(spark, table, chunks.schema, number, document).join(named, document, "left_semi"), backup_path)
    return replace_in_status(spark, table, chunks, documents, number, status=APPROVED, document=document)


def restore_documents(spark: SparkSession, table: str, backup_path: str, schema: str, documents: DataFrame, fields: list[str], number: int, *, vectors: tuple[str, ...] = ("embedding",), document: str = "document_id") -> int:
    """Put a backup's rows in the place of its documents' rows, if none of them has a problem."""
    rows = restore(spark, backup_path, schema, vectors)
    if found := _problems(restore_problems(rows, documents, fields, document)):
        raise Refused(found)
    return write_documents(spark, table, rows, number, document=document, replaces=True)
