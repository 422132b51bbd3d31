"""Sharding by a hierarchical weighted hash tree: region, rack, shard."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.durable import durable
from dossier.llm.ranks import order_digest, running_sums

SHARDS = 40
RACKS, SHARDS_PER_RACK = 2, 5
OVERHEAD = 16

#: {region: {rack: {shard: weight}}}
Tree = dict[str, dict[str, dict[int, float]]]


def shard_tree(shards: int, base: int = SHARDS, racks: int = RACKS, per_rack: int = SHARDS_PER_RACK) -> Tree:
    """``base`` shards in full regions; every shard beyond them is a region of its own, with one rack."""
    tree: Tree = {}
    for shard in range(min(shards, base)):
        region, rack = shard // (racks * per_rack), shard // per_rack % racks
        tree.setdefault(f"r{region}", {}).setdefault(f"r{region}/k{rack}", {})[shard] = 1.0
    for shard in range(base, shards):
        tree[f"x{shard}"] = {f"x{shard}/k0": {shard: 1.0}}
    return tree


def with_one_more(tree: Tree) -> Tree:
    """The tree and one more shard, the next number, in a region of its own. So the trees differ at the root alone, by
    one more child: no draw of another node changes, and rows move into the new shard only."""
    shard = 1 + max((s for racks in tree.values() for shards in racks.values() for s in shards), default=-1)
    return tree | {f"x{shard}": {f"x{shard}/k0": {shard: 1.0}}}


def _weight(node: dict | float) -> float:
    return sum(map(_weight, node.values())) if isinstance(node, dict) else float(node)


def _level(parents: dict[str, dict]) -> Column:
    """Parent name -> its children, as a map literal of (name, weight); what weighs nothing is left out."""
    entries: list[Column] = []
    for parent, children in parents.items():
        named = [F.struct(F.lit(str(n)).alias("name"), F.lit(w).alias("weight")) for n, c in children.items() if (w := _weight(c)) > 0 and math.isfinite(w)]
        if named:
            entries += [F.lit(parent), F.array(*named)]
    return F.create_map(*entries)


def _draw(key: Column, children: Column) -> Column:
    """The child with the least exponential draw of its weight: each wins in proportion to its weight, and a change
    of one weight moves keys only into or out of that child."""

    def wait(child: Column) -> Column:
        bits = F.conv(F.substring(F.md5(F.concat_ws("/", key, child["name"])), 1, 13), 16, 10).cast("double")
        return F.struct((-F.ln((bits + 0.5) / float(1 << 52)) / child["weight"]).alias("wait"), child["name"].alias("name"))

    return F.array_min(F.transform(children, wait))["name"]


def tree_shard(df: DataFrame, key: str, tree: Tree, out: str) -> DataFrame:
    """Add ``out``: the shard that ``key`` (a string, not null) reaches by weighted draws at each level."""
    racks = {k: v for region in tree.values() for k, v in region.items()}
    region, rack = f"__{out}_region", f"__{out}_rack"
    df = df.withColumn(region, _draw(F.col(key), F.element_at(_level({"root": tree}), F.lit("root"))))
    df = df.withColumn(rack, _draw(F.col(key), F.element_at(_level(tree), F.col(region))))
    return df.withColumn(out, _draw(F.col(key), F.element_at(_level(racks), F.col(rack))).cast("int")).drop(region, rack)


def shard_rows(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, tree: Tree | None = None, grown: Tree | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``key``: only doc_id and the tree decide, so equal texts follow their own ids, and repeated rows of an
    id share a shard. Slots number a shard's rows without gaps from 0, in a shuffled order. A null id is a key of its
    own; a null text has 0 bytes, hence size 16 and the checksum of the empty text. An empty table gives no rows.
    ``grown`` is the tree to move to, by default ``tree`` with one more shard.
    """
    tree = tree or shard_tree(shards)
    key = F.coalesce(F.concat(F.lit("d"), docs[doc_id].cast("string")), F.lit("n"))
    content = F.coalesce(docs[text], F.lit(""))
    rows = docs.select(
        docs[doc_id].alias("doc_id"),
        key.alias("key"),
        (F.octet_length(content).cast("long") + OVERHEAD).alias("size"),
        F.crc32(content).alias("text_crc32"),
        order_digest(key, F.md5(content)).alias("digest"),
    )
    rows = tree_shard(rows, "key", tree, "shard")
    rows = durable(tree_shard(rows, "key", grown or with_one_more(tree), "grown_shard").withColumn("one", F.lit(1).cast("long")))
    placed = running_sums(rows, "shard", "digest", "one", "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op9_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
