"""Embedding near-duplicates: exact cosine links by PCA-ordered tiles."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.durable import durable
from dossier.llm.graph import connected_components, hot_join

THRESHOLD = 0.95
#: Bytes of the vectors of a tile, and vectors at most; ties may double them. Larger tiles travel less.
TILE_BYTES, TILE = 8 << 20, 16384
#: Leading axes by whose ranges tiles are cut and kept apart.
CUT_AXES = 3
#: Leading dimensions of the first look, and how many more each further look adds.
LEADING, STEP = 16, 16
#: What single precision may be off by in a bound; results never depend on it, for links are decided in double.
SLACK = 1e-4


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of doubles from a list column without nulls and of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    largest = np.abs(x).max(axis=1, keepdims=True)  # before squaring, so that neither large nor small values are lost
    x = x / largest
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal_axes(vectors: DataFrame, dim: int) -> np.ndarray:
    """Columns: orthonormal axes of the unit vectors, the widest first. The driver gets dim x dim sums."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = np.zeros((dim, dim)), np.zeros(dim)
        for batch in batches:
            if batch.num_rows:
                x = _unit(_matrix(batch.column("embedding")))
                total, first = total + x.T @ x, first + x.sum(axis=0)
        values = np.concatenate([total.ravel(), first])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array(values)], names=["at", "value"])

    parts = vectors.select("embedding").mapInArrow(sums, "at int, value double").groupBy("at").agg(F.sum("value").alias("value"))
    values = np.zeros(dim * dim + dim)
    for row in parts.collect():
        values[row["at"]] = row["value"]
    n = max(1.0, np.trace(values[: dim * dim].reshape(dim, dim)))
    mean = values[dim * dim :] / n
    _, axes = np.linalg.eigh(values[: dim * dim].reshape(dim, dim) / n - np.outer(mean, mean))
    return axes[:, ::-1].copy()


def _placed(vectors: DataFrame, axes: np.ndarray) -> DataFrame:
    """Add ``at``: the places on the first CUT_AXES axes."""
    leading = axes[:, :CUT_AXES].copy()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = _unit(_matrix(batch.column("embedding"))) @ leading
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.tolist(), pa.list_(pa.float64()))], names=[*batch.schema.names, "at"])

    return vectors.mapInArrow(project, "one long, two long, rep long, n long, embedding array<double>, at array<double>")


def _cells(placed: DataFrame, wanted: int, axes: int) -> DataFrame:
    """Add ``cell``: about ``wanted`` cells of equal numbers of vectors, cut along one axis after the other."""
    each = max(1, math.ceil(wanted ** (1 / axes)))
    celled = placed.withColumn("cell", F.lit(0))
    for axis in range(axes if each > 1 else 0):
        shares = F.array(*(F.lit(i / each) for i in range(1, each)))
        found = celled.groupBy("cell").agg(F.percentile_approx(F.col("at")[axis], shares, F.lit(100 * each)).alias("cuts")).collect()  # one row a cell
        cuts = F.create_map(*(x for r in found for x in (F.lit(r["cell"]), F.array(*map(F.lit, r["cuts"])))))
        above = F.size(F.filter(F.element_at(cuts, F.col("cell")), lambda c, axis=axis: c < F.col("at")[axis]))
        celled = celled.withColumn("cell", F.col("cell") * each + above) if found else celled
    return celled


def _tile_pairs(placed: DataFrame, threshold: float, dim: int, tile: int | None) -> DataFrame:
    """Rows (pair, own, other, second, rep, n, embedding) of every two tiles whose boxes on the leading axes come near enough.

    A tile that ties make larger than twice the size is cut by a hash. Unit vectors with cosine t are sqrt(2-2t) apart at
    most, so boxes that are farther apart cannot hold links. The driver keeps a few numbers for each tile.
    """
    tile = tile or max(64, min(TILE, TILE_BYTES // (8 * dim)))
    axes = min(CUT_AXES, dim)
    celled = _cells(placed, math.ceil(placed.count() / tile), axes)
    ends = [f(F.col("at")[i]).alias(f"{name}{i}") for i in range(axes) for name, f in (("lo", F.min), ("hi", F.max))]
    cells = celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *ends).orderBy("cell").collect()
    spark, reach = placed.sparkSession, math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    parts = [max(1, math.ceil(r["n"] / (2 * tile))) for r in cells]
    first = np.r_[0, np.cumsum(parts)].astype(int)
    lo, hi = (np.repeat([[r[f"{name}{i}"] for i in range(axes)] for r in cells], parts, axis=0).reshape(-1, axes) for name in ("lo", "hi"))
    near = []
    for i in range(len(lo)):
        gap = np.maximum(0, np.maximum(lo[i] - hi, lo - hi[i]))
        near += [(i, int(j)) for j in np.nonzero((gap * gap).sum(axis=1) <= reach * reach)[0]]
    partners = spark.createDataFrame(near, "own int, other int")
    if len(cells) > 1:
        layout = spark.createDataFrame([(r["cell"], int(f), p) for r, f, p in zip(cells, first, parts, strict=False)], "cell int, first int, parts int")
        owned = celled.join(layout, "cell").withColumn("own", F.col("first") + F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    else:  # a join on the one cell would be a cross join
        owned = celled.withColumn("own", F.pmod(F.xxhash64("rep"), F.lit(parts[0] if parts else 1)).cast("int"))
    rows = owned.select("own", "rep", "n", "embedding").join(partners, "own")
    pair = F.least("own", "other").cast("long") * len(lo) + F.greatest("own", "other")
    return rows.select(pair.alias("pair"), "own", "other", (F.col("own") > F.col("other")).alias("second"), "rep", "n", "embedding")


#: Vectors that are compared with a tile at once, and the share of pairs beyond which all of them are taken to the end.
ROWS, DENSE = 128, 0.02


def _linked(a: np.ndarray, b: np.ndarray, unit_a: np.ndarray, unit_b: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs with cosine at the threshold or above, some at a time. a, b: rotated, widest axis first; unit_a,
    unit_b: not rotated.

    The leading dimensions' products plus the product of the suffix norms bound a cosine from above; pairs whose bound
    is too low stop there, the others take in the next dimensions. Where few pairs stop, a plain product is faster.
    """
    dim = a.shape[1]
    stops = [*range(LEADING, dim, STEP), dim]

    def suffix(x: np.ndarray, d: int) -> np.ndarray:
        return np.sqrt((x[:, d:] ** 2).sum(axis=1))

    d = stops[0]
    left = np.hstack([a[:, :d], suffix(a, d)[:, None]]).astype(np.float32)
    right = np.hstack([b[:, :d], suffix(b, d)[:, None]]).astype(np.float32)
    later = [(lo, hi, suffix(a, hi), suffix(b, hi)) for lo, hi in zip(stops, stops[1:], strict=False)]
    for at in range(0, len(a), ROWS):
        may = left[at : at + ROWS] @ right.T >= threshold - SLACK
        if may.sum() > DENSE * may.size:
            i, j = np.nonzero(unit_a[at : at + ROWS] @ unit_b.T >= threshold)
            yield i + at, j
            continue
        p, q = np.nonzero(may)
        p = p + at
        dots = (a[p, :d] * b[q, :d]).sum(axis=1)
        for lo, hi, rest_a, rest_b in later:
            dots = dots + (a[p, lo:hi] * b[q, lo:hi]).sum(axis=1)
            keep = dots + rest_a[p] * rest_b[q] >= threshold - SLACK
            p, q, dots = p[keep], q[keep], dots[keep]
        keep = (unit_a[p] * unit_b[q]).sum(axis=1) >= threshold
        yield p[keep], q[keep]


def _unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots after the links (i, j): the least index that links reach."""
    while True:
        a, b = root[i], root[j]
        open_ = a != b
        if not open_.any():
            return root
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _compare(axes: np.ndarray, threshold: float):
    """Of a pair of tiles: (rep, links, root) of each vector that has links; root is the least rep that links reach
    here. Links are counted and united as they are found; no list of them is kept."""
    out = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep").combine_chunks()
        rep, n, second = (table.column(c).to_numpy() for c in ("rep", "n", "second"))
        unit = _unit(_matrix(table.column("embedding").combine_chunks()))
        turned = unit @ axes
        one, two = np.nonzero(~second)[0], np.nonzero(second)[0]
        same = table.column("own")[0].as_py() == table.column("other")[0].as_py()
        if same:
            two = one
        links, root = np.zeros(len(rep)), np.arange(len(rep))
        for i, j in _linked(turned[one], turned[two], unit[one], unit[two], threshold):
            i, j = one[i], two[j]
            if same:
                i, j = i[i != j], j[i != j]
            else:
                links += np.bincount(j, weights=n[i], minlength=len(rep))
            links += np.bincount(i, weights=n[j], minlength=len(rep))
            root = _unite(root, i, j)
        some = links > 0
        return pa.Table.from_arrays([pa.array(x[some]) for x in (rep, links.astype(np.int64), rep[root])], schema=out)

    return compare


def cosine_components(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, tile: int | None = None) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Links join vectors whose cosine, in double precision, is at least ``threshold``, equal vectors included; equal
    vectors are one class with a count, so copies are never paired. Vectors that are null, empty, zero, of another
    length than the most common one, or hold null or non-finite components link with nothing and are components of
    their own. Ids should be unique; a repeated id counts as one vector for each row. An empty table gives no rows.
    """
    rows = vectors.select(vectors[vec_id].alias("vec_id"), vectors[embedding].cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(finite, F.lit(False)) & F.col("vec_id").isNotNull())
    lengths = rows.where("ok").groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    alone = F.lit(0).cast("long").alias("n_links")
    if lengths is None:
        return rows.select("vec_id", alone, F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    dim = lengths["dim"]
    rows = rows.withColumn("ok", F.col("ok") & (F.size("embedding") == dim))
    # Equal vectors are told by two hashes, 128 bits, so that no vector is a key of a shuffle.
    rows = rows.withColumns({"one": F.xxhash64("embedding"), "two": F.xxhash64(F.lit("two"), "embedding")})
    classes = rows.where("ok").groupBy("one", "two").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("embedding").alias("embedding"))
    classes = durable(classes.select("one", "two", "rep", "n", "embedding"))
    axes = principal_axes(classes, dim)
    placed = durable(_placed(classes, axes))
    pairs = _tile_pairs(placed, threshold, dim, tile)
    part = durable(pairs.groupBy("pair").applyInArrow(_compare(axes, threshold), "rep long, links long, root long"))
    links = part.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = connected_components(part.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    named = placed.select("one", "two", "rep", "n").join(links, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    named = durable(named.select("one", "two", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    members = hot_join(rows.where("ok").select("vec_id", "one", "two"), named, ["one", "two"], "vec_id", "n")
    result = members.select("vec_id", "n_links", "component_id").unionByName(rows.where("not ok").select("vec_id", alone, F.col("vec_id").alias("component_id")))
    return result.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op10_pca_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cosine_components(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP10_SQL = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a, vectors b WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
roots AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT r.vec_id, (SELECT count(*) FROM links l WHERE l.a = r.vec_id)::BIGINT AS n_links, component_id, r.vec_id = component_id AS kept FROM roots r
"""
