"""From hits to evidence: duplicates, ambiguity, order, budget, ids. Rows come with a stable ``seq`` for each question."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CONTEXT_CHARS = 12_000


def first_of_each(hits: DataFrame, question: list[str], same: list[str], seq: str) -> DataFrame:
    """The first hit of each content; ``same`` is the hash, with the document where copies across documents count."""
    w = Window.partitionBy(*question, *same).orderBy(seq)
    return hits.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def ambiguous(hits: DataFrame, keys: list[str], *, content: str, order: str, seq: str) -> DataFrame:
    """Rows (keys, is_ambiguous): an article whose distinct contents do not stand at consecutive, distinct places."""
    firsts = hits.groupBy(*keys, content).agg(F.min_by(order, seq).alias("__at"))
    spread = F.max("__at") - F.min("__at") + 1 != F.count("__at")
    return firsts.groupBy(*keys).agg((spread | (F.countDistinct("__at") != F.count("__at"))).alias("is_ambiguous"))


def grouped_by(hits: DataFrame, question: list[str], group: list[str], *, order: str, seq: str) -> DataFrame:
    """Replace ``seq``: groups by first appearance, inside a group by ``order``."""
    first = F.min(seq).over(Window.partitionBy(*question, *group))
    return hits.withColumn("__first", first).withColumn(seq, F.row_number().over(Window.partitionBy(*question).orderBy("__first", order, seq))).drop("__first")


def within_budget(hits: DataFrame, question: list[str], *, length: str, seq: str, budget: int = CONTEXT_CHARS) -> DataFrame:
    """The longest prefix whose lengths fit; what comes after the first overflow goes, even if it would fit."""
    w = Window.partitionBy(*question).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    return hits.withColumn("__used", F.sum(length).over(w)).where(F.col("__used") <= budget).drop("__used")


def with_citation_ids(hits: DataFrame, question: list[str], seq: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*question).orderBy(seq))
    return hits.withColumn("citation_id", F.concat(F.lit("C"), place))
