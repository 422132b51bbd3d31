"""SimHash near-duplicates: covering locality-sensitive hashing and components of links."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.durable import durable
from dossier.llm.graph import connected_components, hot_join, spread_join

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Fingerprints that one task compares with each other.
BLOCK = 128
SLICE = 1 << 16


def shingle_hashes(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of each word shingle, repeats included; bytes.split() takes exactly the separators x20 and x09-x0D."""
    words = text.lower().split()
    if 0 < len(words) < shingle:
        words, grams = [], [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(g, seed) for g in grams), dtype=np.uint64)


#: The eight bits of each byte value as the eight bytes of a number, so that sums of 255 of them count bits.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprints_of(hashes: np.ndarray) -> np.ndarray:
    """Signed 64 bits for each column: a bit is set if it is set in over half the column's hashes; without hashes, zero."""
    n, columns = hashes.shape
    counts = np.zeros(64 * columns, dtype=np.int64)
    for at in range(0, n, SLICE):
        lanes = LANES[np.ascontiguousarray(hashes[at : at + SLICE], dtype="<u8").view(np.uint8)]
        whole = len(lanes) // 255 * 255
        counts += lanes[:whole].reshape(-1, 255, 8 * columns).sum(axis=1).view(np.uint8).sum(axis=0, dtype=np.int64) + lanes[whole:].sum(axis=0).view(np.uint8)
    return np.packbits(2 * counts > n, bitorder="little").view("<i8")


def fingerprint_of(hashes: np.ndarray) -> int:
    """The fingerprint of one set of hashes."""
    return int(fingerprints_of(hashes[:, None])[0])


def fingerprints(docs: DataFrame, *, text: str = "text", keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``fp``, the 64-bit SimHash of the text; a null text is an empty one."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint_of(shingle_hashes(t)) if t else 0 for t in batch.column("__text").to_pylist()]
            rest = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "__text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(prints, pa.int64())], names=[*keep, "fp"])

    rows = docs.select(*(docs[c] for c in keep), docs[text].cast("binary").alias("__text"))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(scan, f"{schema}, fp long")


def covering_masks(radius: int = RADIUS, seed: int = 1, bits: int = 64) -> list[int]:
    """2^(r+1)-1 signed masks over the lowest ``bits``. Each bit has a nonzero vector of r+1 bits, and the mask of v holds the bits whose vector
    has an odd product with v. Any r bits leave some v at an even product with all of theirs, so two fingerprints that
    differ in at most r bits agree under some mask."""
    top = 1 << (radius + 1)
    vectors = [1 + i % (top - 1) for i in range(bits)]
    random.Random(seed).shuffle(vectors)
    masks = [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, top)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _buckets(prints: DataFrame, masks: list[int], bucket: str | None) -> DataFrame:
    """Rows (bucket, fp) for every table; a bucket of an earlier level is kept in the new one's name."""
    tables = F.explode(F.array(*(F.struct(F.lit(i).alias("t"), F.lit(m).alias("m")) for i, m in enumerate(masks))))
    rows = prints.withColumn("table", tables).withColumn("part", F.col("fp").bitwiseAND(F.col("table.m")))
    key = F.struct(*([F.col(bucket)] if bucket else []), "table.t", "part")
    return rows.select(F.sha2(F.to_json(key), 256).alias("bucket"), "fp") if bucket else rows.select(F.concat_ws("/", "table.t", "part").alias("bucket"), "fp")


def _sized(rows: DataFrame) -> DataFrame:
    """Rows of buckets with two fingerprints or more, and their number n."""
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return spread_join(rows, sizes, "bucket", "fp", spread=4)


def _forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each fingerprint to the smallest one that it reaches by links inside its block."""
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    label = np.arange(len(fps))
    while True:
        least = np.where(near, label[None, :], len(fps)).min(axis=1)
        if (least == label).all():
            break
        label = least
    moved = label != np.arange(len(fps))
    return fps[moved], fps[label[moved]]


def _links_in_blocks(blocks: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) that span the links inside each block; blocks are small and come in order within a partition."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_keys, held = [], []
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def edges(keys: list, fps: list) -> pa.RecordBatch:
            values, out_a, out_b = np.array(fps, dtype=np.int64), [], []
            starts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for s, e in zip(starts, starts[1:], strict=False):
                if e - s == 2:
                    if ((fps[s] ^ fps[s + 1]) & ((1 << 64) - 1)).bit_count() <= radius:
                        out_a.append(values[s : s + 1])
                        out_b.append(values[s + 1 : e])
                elif e - s > 2:
                    a, b = _forest(values[s:e].view(np.uint64), radius)
                    out_a.append(a.view(np.int64))
                    out_b.append(b.view(np.int64))
            flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_a, out_b)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in flat], schema=schema)

        for batch in batches:
            held_keys += batch.column("block").to_pylist()
            held += batch.column("fp").to_pylist()
            if not held_keys:
                continue
            last = len(held_keys) - 1
            while last and held_keys[last - 1] == held_keys[-1]:
                last -= 1
            if last:
                yield edges(held_keys[:last], held[:last])
                held_keys, held = held_keys[last:], held[last:]
        if held_keys:
            yield edges(held_keys, held)

    dealt = blocks.repartition("block").sortWithinPartitions("block")
    return dealt.select("block", "fp").mapInArrow(scan, "a long, b long")


def fingerprint_links(prints: DataFrame, *, radius: int = RADIUS, block: int = BLOCK, levels: int = 2) -> DataFrame:
    """Edges (a, b) over distinct fingerprints ``fp`` that connect exactly what links of at most ``radius`` bits do.

    Every level has the covering guarantee, so a bucket of more than ``block`` fingerprints is divided again by
    another set of masks. What is still larger after the last level is cut into blocks, and each pair of blocks is
    compared in a task of its own. Tasks give back spanning edges, not all pairs.
    """
    rows = _sized(_buckets(prints, covering_masks(radius), None))
    ready = []
    for level in range(levels):
        rows = durable(rows)
        ready.append(rows.where(F.col("n") <= block).select(F.col("bucket").alias("block"), "fp"))
        rows = rows.where(F.col("n") > block)
        if level + 1 < levels:
            rows = _sized(_buckets(rows.select("bucket", "fp"), covering_masks(radius, seed=2 + level), "bucket"))
    parts = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    pairs = rows.withColumn("parts", parts).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    ready.append(pairs.select(F.concat_ws("/", "bucket", F.least("own", "other"), F.greatest("own", "other")).alias("block"), "fp"))
    blocks = ready[0]
    for more in ready[1:]:
        blocks = blocks.unionByName(more)
    return _links_in_blocks(blocks, radius)


def near_duplicate_components(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, fp and component_id, the smallest doc_id that links reach.

    Null and empty texts, and texts without words, have fingerprint zero and link like any other. Equal fingerprints
    are one node, so copies are never paired. Rows with a null doc_id take part; if a component holds no other rows its
    id is null. Repeated rows stay repeated. An empty table gives no rows.
    """
    prints = durable(fingerprints(docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")), keep=["doc_id"]))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    edges = fingerprint_links(nodes.select("fp"), radius=radius, block=block)
    roots = connected_components(edges).withColumnRenamed("node", "fp")
    rooted = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    rooted = durable(rooted.select("fp", "root", "least", "copies"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    named = hot_join(rooted, least, ["root"], "fp", "n").select("fp", "component_id", "copies")
    return hot_join(prints, named, ["fp"], "doc_id", "copies")


def keep_one_of_each(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, with their columns, whose doc_id is the smallest of its component, where links are
    Jaccard similarities of word shingles (``jaccard``) and not the fingerprints above.

    Of rows that are equal in id and text one stays; rows of one id with different texts are rows of their own, of which
    a component keeps one. Rows without an id cannot be told apart by it, and stay.
    """
    from dossier.llm.jaccard import similar_components, text_key  # takes its shingles from here

    found = similar_components(docs, text=text, doc_id=doc_id, **options).where("doc_id is not null")
    first = found.groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("f")).select(F.col("f.doc_id").alias("__first"), F.col("f.node").alias("__of"))
    named = docs.where(docs[doc_id].isNotNull()).withColumn("__node", text_key(docs[text]))
    kept = named.join(first, (named[doc_id] == F.col("__first")) & (F.col("__node") == F.col("__of")), "left_semi").dropDuplicates([doc_id, "__node"]).drop("__node")
    return kept.unionByName(docs.where(docs[doc_id].isNull()))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicate_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
