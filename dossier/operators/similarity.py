"""Exact vector search over chunks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP_K, MIN_SCORE = 10, 0.50
#: Questions and chunks that one task compares.
QUESTION_BLOCK, CHUNK_BLOCK = 2048, 16_384


def is_valid_vector(v: Column) -> Column:
    """Not empty, and every component finite."""
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)), F.lit(False))


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(_doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """In double precision; null for a zero vector."""
    dot = F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.try_divide(dot, norm(a) * norm(b))


def accepted(hits: DataFrame, threshold: float = MIN_SCORE, score: str = "score") -> DataFrame:
    """Hits at the threshold or above; a null score is none."""
    return hits.where(F.col(score) >= threshold)


def top_k(chunks: DataFrame, query: list[float], *, chunk_id: str, embedding: str = "embedding", k: int = TOP_K, scope: Column | None = None) -> DataFrame:
    """The k chunks nearest to one question, best first, then by id. ``scope`` filters before any score is computed.

    The question is a literal, so there is no join; each task keeps its own k.
    """
    rows = chunks.where(F.col(embedding).isNotNull())
    rows = rows if scope is None else rows.where(scope)
    q = F.array(*(F.lit(float(x)) for x in query))
    return rows.withColumn("score", cosine(F.col(embedding), q)).orderBy(F.desc_nulls_last("score"), chunk_id).limit(k)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the k best, then by id."""
    keep = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(ids, keep, axis=1), np.take_along_axis(scores, keep, axis=1)


def _units(column: pa.ChunkedArray | pa.Array, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of the rows that are not zero."""
    x = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = x.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1) if len(ids) else np.zeros((0, 1))
    size = np.sqrt((x * x).sum(axis=1))
    return ids[size > 0], x[size > 0] / size[size > 0, None]


def _hits(names: np.ndarray, ids: np.ndarray, best: np.ndarray) -> dict:
    n = ids.shape[1]
    return {"q": pa.array(np.repeat(names, n), pa.int64()), "c": pa.array(ids.ravel(), pa.int64()), "score": pa.array(best.ravel(), pa.float64())}


def _near_a_few(asked: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """At most QUESTION_BLOCK questions go to every task; a task gives back its k best for each."""
    got = asked.toArrow()
    names, matrix = _units(got.column("v"), got.column("q").to_numpy())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, best = np.zeros((len(names), 0), np.int64), np.zeros((len(names), 0))
        for batch in batches:
            if batch.num_rows and len(names):
                c, x = _units(batch.column("v"), batch.column("c").to_numpy())
                ids, best = _best(np.hstack([ids, np.broadcast_to(c, (len(names), len(c)))]), np.hstack([best, matrix @ x.T]), k)
        yield pa.RecordBatch.from_pydict(_hits(names, ids, best))

    return pairs.mapInArrow(scan, "q long, c long, score double")


def _near_in_tiles(asked: DataFrame, pairs: DataFrame, n: int, k: int) -> DataFrame:
    """Blocks of questions meet blocks of chunks, each pair of blocks in a task."""
    q_tiles, c_tiles = math.ceil(n / QUESTION_BLOCK), max(1, math.ceil(pairs.count() / CHUNK_BLOCK))
    every = lambda tiles: F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    left = asked.select("q", "v", F.pmod(F.xxhash64("q"), F.lit(q_tiles)).cast("int").alias("qt"), every(c_tiles).alias("ct"))
    right = pairs.select("c", "v", F.pmod(F.xxhash64("c"), F.lit(c_tiles)).cast("int").alias("ct"), every(q_tiles).alias("qt"))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        names, matrix = _units(a.column("v"), a.column("q").to_numpy())
        c, x = _units(b.column("v"), b.column("c").to_numpy())
        if not (len(names) and len(c)):
            return pa.table(_hits(names, np.zeros((len(names), 0), np.int64), np.zeros((len(names), 0))))
        return pa.table(_hits(names, *_best(np.broadcast_to(c, (len(names), len(c))), matrix @ x.T, k)))

    return left.groupBy("qt", "ct").cogroup(right.groupBy("qt", "ct")).applyInArrow(meet, "q long, c long, score double")


def top_k_each(questions: DataFrame, chunks: DataFrame, *, question_id: str, chunk_id: str, embedding: str = "embedding", k: int = TOP_K) -> DataFrame:
    """Rows (question_id, chunk_id, score, rank): the k nearest chunks of every question.

    A task scores chunks against a block of questions by one matrix product and gives back its k best for each, so that
    what is shuffled after it grows with tasks, not with chunks. Up to QUESTION_BLOCK questions travel to all tasks;
    more of them meet the chunks in pairs of blocks. Zero and null vectors are left out.
    """
    asked = questions.where(is_valid_vector(F.col(embedding))).select(F.col(question_id).cast("long").alias("q"), _doubles(F.col(embedding)).alias("v"))
    pairs = chunks.where(is_valid_vector(F.col(embedding))).select(F.col(chunk_id).cast("long").alias("c"), _doubles(F.col(embedding)).alias("v"))
    n = asked.count()
    found = _near_a_few(asked, pairs, k) if n <= QUESTION_BLOCK else _near_in_tiles(asked, pairs, n, k)
    best = Window.partitionBy("q").orderBy(F.desc("score"), "c")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias(question_id), F.col("c").alias(chunk_id), "score", "rank")


def fuse(first: DataFrame, second: DataFrame, *, chunk_id: str, k: int = TOP_K) -> DataFrame:
    """One list of two: each chunk with its best score, the first list's row on a tie; best first, then as they came."""
    both = first.withColumn("list", F.lit(1)).unionByName(second.withColumn("list", F.lit(2)))
    place = Window.partitionBy("list").orderBy(F.desc("score"), chunk_id)
    both = both.withColumn("seq", F.row_number().over(place))
    one = Window.partitionBy(chunk_id).orderBy(F.desc("score"), "list")
    kept = both.withColumn("n", F.row_number().over(one)).where("n = 1").drop("n")
    return kept.orderBy(F.desc("score"), "list", "seq").limit(k).drop("seq")


def embedding_text(turns: DataFrame, *, conversation: str, order: str, text: str, before: int = 3) -> DataFrame:
    """Add ``embedding_text``: up to ``before`` earlier questions and this one, a line each."""
    w = Window.partitionBy(conversation).orderBy(order).rowsBetween(-before, 0)
    return turns.withColumn("embedding_text", F.array_join(F.collect_list(text).over(w), "\n"))


def chosen_question(original: Column, rewritten: Column, limit: int = 1000) -> Column:
    """The rewritten question if it is usable and says something else; the original otherwise."""
    from dossier.functions.normalize import collapse_spaces

    usable = (F.length(collapse_spaces(rewritten)) > 0) & (F.length(rewritten) <= limit)
    return F.when(usable & (collapse_spaces(rewritten) != collapse_spaces(original)), rewritten).otherwise(original)
