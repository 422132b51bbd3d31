"""Queries on odd rows: what their SQL says of them."""

import duckdb
from pyspark.sql import functions as F

from dossier.plans import catalogue


def by_sql(name: str, folder: str, *tables: str) -> list[tuple]:
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return sorted(con.execute(catalogue.ORACLES[name]).fetchall())


def test_text_keys_of_blank_texts_other_spaces_and_special_cases(spark, tmp_path):
    texts = [None, "", " ", "\n\t", "a  b\r\n c ", " x   y　 ", "a\x0bb\x0b", "\x1cz\x1f", "x  ", "\u0085 q \u0085", "s   \n t", "\U0001f600  \U0001f600 "]
    rows = [(i, t, "src") for i, t in enumerate(texts)]
    rows += [(100 + i, "t", s) for i, s in enumerate([None, "", "straße", "ﬁn", "ŉx", "ǰ", "ıſ", "İK", "ΐ", "Ü9", "\U0001d5d4b"])]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalogue.QUERIES["text_keys"](spark, str(tmp_path)).select("doc_id", "collapsed_md5", "code_key", "alias_key", "content_hash")
    assert sorted(map(tuple, got.collect())) == by_sql("text_keys", str(tmp_path), "documents")


def test_runs_of_words_are_not_moved_to_meet_few_aliases(spark):
    """A question has some hundred runs, each with the question's text."""
    from dossier.functions import codes

    asked = spark.createDataFrame([("a", "NP 010-2022 art. 3 " + "cuvinte multe " * 50), ("b", "fara cod")], "question_id string, text string")
    aliases = spark.createDataFrame([("np10", "NP 010-2022"), ("i7", "I7-2011")], "document_id string, alias string")
    found = codes.alias_spans(asked, aliases, "question_id", "text", "document_id")
    assert [tuple(r) for r in found.collect()] == [("a", "np10", 0, 11)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(__run" not in plan


def test_texts_go_to_python_only_for_targets_that_are_sought_there(spark):
    from dossier.operators import consolidation

    rows = spark.createDataFrame([("1.1. a\n1.2. b\n", "1.2"), (None, "1.2")], "t string, p string")
    null = lambda kind: F.lit(None).cast(kind)
    got = rows.select(consolidation.locate("t", "p", null("string"), null("string"), F.lit(False), null("int")).alias("l")).select("l.*").collect()
    assert [tuple(r) for r in got] == [(7, 14, 1), (None, None, None)]
