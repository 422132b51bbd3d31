"""Joins that spread a hot key, and connected components by star contraction inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.durable import durable

SPREAD = 16


def spread_join(many: DataFrame, one: DataFrame, key: str, spread_by: str | Column, how: str = "inner", spread: int = SPREAD) -> DataFrame:
    """Join many rows a key to one row a key. The rows of a key are dealt over ``spread`` tasks, and the one row is
    copied to each; beyond that, adaptive execution can split what is still too large."""
    salt = "__salt"
    copies = one.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    dealt = many.withColumn(salt, F.pmod(F.xxhash64(spread_by), F.lit(spread)).cast("int"))
    return dealt.join(copies, [key, salt], how).drop(salt)


#: A key of more than one in so many rows is hot.
HOT = 1000


def hot_join(many: DataFrame, one: DataFrame, keys: list[str], spread_by: str | Column, n: str, spread: int = SPREAD, total: int | None = None) -> DataFrame:
    """``spread_join`` for a side ``one`` that knows in ``n`` how many rows of ``many`` have its key: only hot keys are
    spread and copied. There are at most HOT of them, so they are broadcast. ``n`` is dropped; ``total``: all rows."""
    total = (one.agg(F.sum(n)).first()[0] or 0) if total is None else total
    is_hot = F.col(n) > max(HOT, total // HOT)
    hot = F.broadcast(one.where(is_hot).select(*keys, F.lit(True).alias("__hot")))
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(spread - 1))).otherwise(F.array(F.lit(0)))
    copies = one.withColumn("__salt", F.explode(salts)).drop(n)
    dealt = many.join(hot, keys, "left").withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(spread_by), F.lit(spread)).cast("int")).otherwise(0)).drop("__hot")
    return dealt.join(copies, [*keys, "__salt"]).drop("__salt")


#: Up to so many edges, no node is hot: a task can read them all (some 10 MB). Edges that a task contracts at once before they are dealt; a task's
#: share of them after that; tasks that count them.
FEW = 1 << 17
HELD, SHARE, COUNTERS = 1 << 20, 1 << 15, 32


def least_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of the numbers below n the least that edges between a and b reach."""
    label = np.arange(n)
    while (label[a] != label[b]).any():
        x, y = label[a], label[b]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    return label


def _ranked(*columns: pa.Array) -> tuple[pa.Array, list[np.ndarray]]:
    """The distinct nodes of the columns in order, and each column as places among them."""
    coded = pc.dictionary_encode(pa.concat_arrays(columns))
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), np.split(rank[coded.indices.to_numpy()], np.cumsum([len(c) for c in columns])[:-1])


def _held(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batches of a task as one, or as several of about ``most`` rows."""
    held: list = []
    for batch in batches:
        held.append(batch)
        if most and sum(b.num_rows for b in held) >= most:
            yield pa.concat_batches(held)
            held = []
    if sum(b.num_rows for b in held):
        yield pa.concat_batches(held)


def _forest(batch: pa.RecordBatch, is_open: bool = False) -> pa.RecordBatch:
    """From each node of a batch's edges to the least that it reaches there."""
    nodes, (a, b) = _ranked(batch.column("a"), batch.column("b"))
    least = least_reached(len(nodes), a, b)
    moved = np.nonzero(least != np.arange(len(nodes)))[0]
    return pa.RecordBatch.from_arrays([nodes.take(pa.array(moved)), nodes.take(pa.array(least[moved])), pa.array(np.full(len(moved), is_open))], names=["a", "b", "open"])


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _held(batches, HELD):
        yield _forest(batch)


def _large_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, a, b): a key's edges, to its larger neighbours (key = b) and to smaller ones. Each edge goes from its
    larger end to the least that its smaller one reaches here, and so does that one. ``open``: some key has two
    smaller neighbours, or neighbours on both sides, so that the edges are not stars yet."""
    for batch in _held(batches):
        nodes, (key, a, b) = _ranked(*(batch.column(c) for c in ("key", "a", "b")))
        least, up, down = least_reached(len(nodes), a, b), key == a, key == b
        above, below = (np.full(len(nodes), start) for start in (-1, len(nodes)))
        np.maximum.at(above, key[up], b[up])
        np.minimum.at(below, key[up], b[up])
        is_open = bool((above > below).any() or (above[key[down]] >= 0).any())
        x = np.unique(b[down])
        x = x[least[x] != x]
        start, end = np.r_[a[down], x], np.r_[least[b[down]], least[x]]
        yield pa.RecordBatch.from_arrays([nodes.take(pa.array(start)), nodes.take(pa.array(end)), pa.array(np.full(len(start), is_open))], names=["a", "b", "open"])


def _small_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _held(batches):
        yield _forest(batch, bool(pc.any(batch.column("open")).as_py()))


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) of every node that an edge (a, b) names; the component is its smallest node.

    Alternates large-star and small-star contraction until every edge goes from a node to its component's smallest. A task
    contracts all edges that it has at once, so that a round is two shuffles, and most graphs take two or three. There is a
    task for each SHARE of edges, for the driver remembers every task. Edges are kept by checkpoints between rounds. Of more than FEW edges, nodes with over a thousandth of them, at most HOT, are
    named to the driver, and their edges are dealt over SPREAD tasks. Null ends and loops are ignored. Without edges
    the result is empty.
    """
    kind = edges.schema["a"].dataType.simpleString()
    shape = f"a {kind}, b {kind}, open boolean"
    edges = durable(edges.select("a", "b").where("a <> b").mapInArrow(_contracted, shape))
    n = edges.coalesce(COUNTERS).count()
    for _ in range(max_rounds):
        if not n:
            break
        hot = [r["b"] for r in edges.groupBy("b").count().where(F.col("count") > max(HOT, n // HOT)).select("b").collect()] if n > FEW else []
        every, one = F.sequence(F.lit(0), F.lit(SPREAD - 1)), F.array(F.lit(0))
        is_hot = lambda c: F.col(c).isin(hot) if hot else F.lit(False)
        share = F.when(is_hot("b"), F.pmod(F.xxhash64("a"), F.lit(SPREAD)).cast("int")).otherwise(0)
        up = F.transform(F.when(is_hot("a"), every).otherwise(one), lambda s: F.struct(F.col("a").alias("key"), s.alias("salt")))
        tasks = min(-(-n // SHARE), int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        keyed = edges.coalesce(tasks).select(F.explode(F.concat(up, F.array(F.struct(F.col("b").alias("key"), share.alias("salt"))))).alias("k"), "a", "b")
        large = keyed.select("k.key", "k.salt", "a", "b").repartition(tasks, "key", "salt").mapInArrow(_large_stars, shape)
        edges = durable(large.repartition(tasks, "a").mapInArrow(_small_stars, shape))
        n, still = edges.coalesce(COUNTERS).agg(F.count(F.lit(1)), F.max("open")).first()
        if not still:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
