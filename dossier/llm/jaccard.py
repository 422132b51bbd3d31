"""Near-duplicates by the Jaccard similarity of word shingles: SimHash fingerprints under covering masks propose, exact sets decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.batches import gather
from dossier.llm.debruijn import mixed
from dossier.llm.durable import durable
from dossier.llm.graph import connected_components, hot_join, spread_join
from dossier.llm.simhash import covering_masks, fingerprints_of, shingle_hashes

SHINGLE = 5
SIMILARITY = 0.8
#: SimHashes of a text: those that are cut into parts, each under the covering masks of RADIUS, and those by which texts of a bucket are compared.
KEY_WORDS, CHECK_WORDS = 4, 2
RADIUS, PART_BITS = 2, 21
PARTS = KEY_WORDS * (64 // PART_BITS)
#: Texts that differ in at most PARTS * (RADIUS + 1) - 1 = 35 of the 252 key bits meet for certain. At similarity 0.8
#: the bits differ with probability 0.151, and a pair meets under some mask with probability 0.9998.
MASKS = np.array(covering_masks(RADIUS, bits=PART_BITS), np.int64)
TABLES = PARTS * len(MASKS)
#: Differing bits of the 128 others, beyond which a pair is not compared: 19 are usual at 0.8, and 64 for unlike texts.
NEAR = 40
#: Differing bits of those 128, up to which texts become a family. Of pairs of unlike texts 6e-10 are so near, so that families do not run together.
KIN = 30
#: Texts of TEXT_BYTES of shingle hashes in a pack; packs of one label meet two by two in a task. By how many more fingerprints are compared.
BLOCK, PRINTS = 128, 32
TEXT_BYTES = 1 << 15
#: Entries of lists of shingles' holders that are counted at once.
HELD = 1 << 22
#: Fingerprints of a bucket that are compared side by side with those of other buckets.
SMALL = 256
#: Pairs that one copy of a text serves.
PAIRS = 256
PRINT = ["p0", "p1"]

_rng = np.random.default_rng(42)
TIMES = _rng.integers(0, 1 << 64, KEY_WORDS + CHECK_WORDS, dtype=np.uint64) | np.uint64(1)
PLUS = _rng.integers(0, 1 << 64, KEY_WORDS + CHECK_WORDS, dtype=np.uint64)


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """SimHashes of the same shingles, each by other hashes of them; texts without words have zeros."""
    return fingerprints_of(mixed(hashes[:, None] * TIMES + PLUS))


def covering_keys(words: np.ndarray) -> np.ndarray:
    """The key words of each row, as a number of table and masked bits a table."""
    parts = np.stack([(words >> (PART_BITS * j)) & ((1 << PART_BITS) - 1) for j in range(64 // PART_BITS)], axis=2).reshape(len(words), PARTS)
    return (np.arange(TABLES, dtype=np.int64) << 32) | (parts[:, :, None] & MASKS).reshape(len(words), TABLES)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """The buckets of a text; texts without words share all of theirs."""
    return covering_keys(wide_fingerprint(hashes)[None, :KEY_WORDS])[0]


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether two sorted sets of hashes reach the similarity; two empty ones do."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = len(a) + len(b) - len(np.union1d(a, b))
    return both >= similarity * (len(a) + len(b) - both)


def _prints(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, k0 ... k3, p0, p1): the wide fingerprint of each text, once."""
    names = [*(f"k{i}" for i in range(KEY_WORDS)), *PRINT]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [wide_fingerprint(np.unique(shingle_hashes(t or b"", shingle))) for t in batch.column("text").to_pylist()]
            columns = np.array(found, np.int64).reshape(-1, len(names)).T
            yield pa.RecordBatch.from_arrays([batch.column("node"), *(pa.array(np.ascontiguousarray(c)) for c in columns)], names=["node", *names])

    rows = texts.select("node", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(scan, "node string, " + ", ".join(f"{n} long" for n in names)).dropDuplicates(["node"])


def _bucketed(prints: DataFrame, step: int = 1) -> DataFrame:
    """(bucket, p0, p1) and ``family``, if it is there, for each table, or every ``step``-th of them, and distinct fingerprint."""
    names = [c for c in prints.columns if c in (*PRINT, "family")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                keys = covering_keys(np.stack([batch.column(f"k{i}").to_numpy() for i in range(KEY_WORDS)], axis=1))[:, ::step]
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *(pa.array(np.repeat(batch.column(c).to_numpy(), keys.shape[1])) for c in names)], names=["bucket", *names])

    return prints.drop("node").distinct().mapInArrow(scan, "bucket long, " + ", ".join(f"{c} long" for c in names))


def _reached(prints: np.ndarray, bits: int = NEAR) -> np.ndarray:
    """For each fingerprint the place of the first one that it reaches by steps of at most ``bits``."""
    first, left = np.arange(len(prints)), np.arange(len(prints))
    while len(left):
        root, queue, left = left[0], [left[0]], left[1:]
        while queue and len(left):
            near = np.bitwise_count(prints[left] ^ prints[queue.pop()]).sum(axis=1, dtype=np.int64) <= bits
            queue += left[near].tolist()
            first[left[near]] = root
            left = left[~near]
    return first


def near_in_buckets(bucket: np.ndarray, prints: np.ndarray, bits: int = NEAR) -> np.ndarray:
    """``_reached`` in each of many buckets, which come in order; places are those among all."""
    start = np.nonzero(np.r_[True, bucket[1:] != bucket[:-1]])[0] if len(bucket) else np.zeros(0, int)
    size = np.diff(np.r_[start, len(bucket)])
    first = np.arange(len(bucket))
    for s, n in zip(start[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
        first[s : s + n] = s + _reached(prints[s : s + n], bits)
    behind = np.repeat(start + size, size) - np.arange(len(bucket)) - 1
    at, step, pairs = np.nonzero(np.where(np.repeat(size, size) > SMALL, 0, behind) > 0)[0], 1, []
    while len(at):
        near = np.bitwise_count(prints[at, 0] ^ prints[at + step, 0]) + np.bitwise_count(prints[at, 1] ^ prints[at + step, 1]) <= bits
        pairs.append(np.stack([at[near], at[near] + step]))
        step += 1
        at = at[behind[at] >= step]
    a, b = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), int)
    while (first[a] != first[b]).any():
        least = np.minimum(first[a], first[b])
        np.minimum.at(first, a, least)
        np.minimum.at(first, b, least)
    return first


def _with_families(prints: DataFrame, most: int) -> DataFrame:
    """The fingerprints with their ``family``, the p0 of one of its texts.

    A text follows the least that it reaches by KIN bits in a bucket of one table a part, at most ``most`` at a time, and
    families are who follows whom. They need not be complete: what families are close is found in all tables.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, found = np.zeros(0, np.int64), np.zeros((0, 2), np.uint64)

        def follows(bucket: np.ndarray, found: np.ndarray) -> pa.RecordBatch:
            start = np.nonzero(np.r_[True, bucket[1:] != bucket[:-1]])[0] if len(bucket) else np.zeros(0, int)
            place = np.arange(len(bucket)) - np.repeat(start, np.diff(np.r_[start, len(bucket)]))
            first = near_in_buckets(np.cumsum(place % most == 0), found, KIN)
            own, least = (found[at, 0].view(np.int64) for at in (np.arange(len(first)), first))
            return pa.RecordBatch.from_arrays([pa.array(own[own != least]), pa.array(least[own != least])], names=["a", "b"])

        for batch in batches:
            bucket = np.concatenate([bucket, batch.column("bucket").to_numpy()])
            found = np.concatenate([found, np.stack([batch.column(c).to_numpy().view(np.uint64) for c in PRINT], axis=1)])
            n = int(np.searchsorted(bucket, bucket[-1])) if len(bucket) else 0
            n += (len(bucket) - n) // most * most
            yield follows(bucket[:n], found[:n])
            bucket, found = bucket[n:], found[n:]
        yield follows(bucket, found)

    dealt = _bucketed(prints, len(MASKS)).repartition("bucket").sortWithinPartitions("bucket", *PRINT)
    above = dealt.mapInArrow(scan, "a long, b long").groupBy("a").agg(F.min("b").alias("b"))
    roots = connected_components(above).select(F.col("node").alias("p0"), F.col("component"))
    return prints.join(roots, "p0", "left").select(*prints.columns, F.coalesce("component", "p0").alias("family"))


def leading(group: np.ndarray, family: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the family of which its group has most rows, and whether the group has others."""
    order = np.lexsort((family, group))
    g, f = group[order], family[order]
    start = np.nonzero(np.r_[True, (g[1:] != g[:-1]) | (f[1:] != f[:-1])])[0] if len(g) else np.zeros(0, int)
    size, g, f = np.diff(np.r_[start, len(g)]), g[start], f[start]
    best = np.lexsort((f, -size, g))
    best = best[np.r_[True, g[best][1:] != g[best][:-1]]] if len(best) else best
    lead = np.zeros(group.max(initial=-1) + 1, np.int64)
    lead[g[best]] = f[best]
    return lead[group], (np.bincount(g, minlength=len(lead)) > 1)[group]


def _grouped(rows: DataFrame, most: int | None) -> DataFrame:
    """(band, p0, p1, family, whole) of rows (bucket, p0, p1, family; without the last each is its own): where fingerprints of several
    families reach each other inside a bucket, the others come to the band of the family that has most of them there. Of
    that one only the text that names it is given again. A bucket of over ``most`` is handed on, with ``whole``, and is not held."""
    rows = rows if "family" in rows.columns else rows.withColumn("family", F.col("p0"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["band", *PRINT, "family", "whole"]
        bucket, prints, passing = np.zeros(0, np.int64), np.zeros((0, 3), np.uint64), None

        def out(band: np.ndarray, prints: np.ndarray, whole: bool) -> pa.RecordBatch:
            signed = np.ascontiguousarray(prints.T).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(band), *(pa.array(x) for x in signed), pa.array(np.full(len(band), whole))], names=names)

        def ready(bucket: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
            if most is not None and len(bucket):
                start = np.nonzero(np.r_[True, bucket[1:] != bucket[:-1]])[0]
                size = np.diff(np.r_[start, len(bucket)])
                large = np.repeat(size, size) > most
                if large.any():
                    yield out(bucket[large], prints[large], True)
                    bucket, prints = bucket[~large], prints[~large]
            own, family = (np.ascontiguousarray(prints[:, i]).view(np.int64) for i in (0, 2))
            lead, several = leading(near_in_buckets(bucket, prints[:, :2]), family)
            some = several & ((family != lead) | (own == lead))
            yield out(lead[some], prints[some], False)

        for batch in batches:
            bucket = np.concatenate([bucket, batch.column("bucket").to_numpy()])
            prints = np.concatenate([prints, np.stack([batch.column(c).to_numpy().view(np.uint64) for c in (*PRINT, "family")], axis=1)])
            if passing is not None:
                n = int(np.searchsorted(bucket, passing, side="right"))
                yield out(bucket[:n], prints[:n], True)
                bucket, prints = bucket[n:], prints[n:]
            if not len(bucket):
                continue
            n = int(np.searchsorted(bucket, bucket[-1]))
            yield from ready(bucket[:n], prints[:n])
            bucket, prints, passing = bucket[n:], prints[n:], None
            if most is not None and len(bucket) > most:
                passing = bucket[0]
                yield out(bucket, prints, True)
                bucket, prints = bucket[:0], prints[:0]
        yield from ready(bucket, prints)

    dealt = rows.select("bucket", *PRINT, "family").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(scan, "band long, p0 long, p1 long, family long, whole boolean")


def _banded(texts: DataFrame, shingle: int, most: int) -> DataFrame:
    """(node, band): any two texts whose fingerprints meet under a mask and differ in at most NEAR other bits share a band.

    A band is a family and the texts of others that meet it, so that a text has one row, and one for each family that it
    comes to, but none for each table. Buckets of more than ``most`` fingerprints are cut into parts, each two of which meet in a task.
    """
    prints = durable(_with_families(durable(_prints(texts, shingle)), most))
    found = durable(_grouped(_bucketed(prints), most))
    comers = found.where("not whole")
    if found.where("whole").limit(1).count():
        comers = comers.unionByName(_grouped(_cut(found, most), None))
    comers = comers.where("band <> family").select("band", *PRINT).distinct()
    return prints.select("node", F.col("family").alias("band")).unionByName(prints.join(comers, PRINT).select("node", "band"))


def _cut(found: DataFrame, most: int) -> DataFrame:
    """Rows of ``_grouped`` in large buckets as rows of buckets of two parts of at most about ``most``."""
    large = found.where("whole").select(F.col("band").alias("bucket"), *PRINT, "family")
    sizes = large.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("parts"))
    dealt = spread_join(large, sizes, "bucket", F.xxhash64(*PRINT)).withColumn("own", F.pmod(F.xxhash64(*PRINT), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), *PRINT, "family")


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, grams): the sorted distinct shingle hashes of each text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [np.unique(shingle_hashes(t or b"", shingle)).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(grams, pa.binary())], names=["node", "grams"])

    single = texts.dropDuplicates(["node"])
    return single.select("node", F.col("text").cast("binary").alias("text")).mapInArrow(scan, "node string, grams binary")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = lambda name: (np.frombuffer(x, np.uint64) for x in batch.column(name).to_pylist())  # noqa: B023, E731
            keep = pa.array([similar(x, y, similarity) for x, y in zip(of("x"), of("y"), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    # A text of many pairs is copied once for each PAIRS of them; most are not copied at all.
    copies = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / PAIRS).cast("int").alias("copies"))
    dealt = spread_join(pairs, copies, "b", "a", spread=4).withColumn("salt", F.pmod(F.xxhash64("a"), F.col("copies")).cast("int")).drop("copies")
    one = dealt.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a")
    other = sets.select(F.col("node").alias("b"), F.col("grams").alias("y")).join(copies, "b")
    other = other.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    return one.join(other, ["b", "salt"]).select("a", "b", "x", "y").mapInArrow(scan, "a string, b string")


def links_across(roots: list[str], packs: np.ndarray, grams: list[np.ndarray], similarity: float) -> list[tuple[str, str]]:
    """Edges between roots that join the components of the given texts as all links do: links between two packs, or inside
    a single one. A text's common shingles with all others are counted at once, by the lists of who holds a shingle."""
    n, size = len(grams), np.array([len(g) for g in grams])
    _, place, often = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    start, holders = np.cumsum(often) - often, np.repeat(np.arange(n), size)[np.argsort(place, kind="stable")]
    first = np.r_[0, np.cumsum(size)]
    label = np.unique(roots, return_inverse=True)[1]
    sides, side = np.unique(packs, return_inverse=True)
    largest = int(np.argmax(label == np.argmax(np.bincount(label))))
    asking = side == np.argmin(np.bincount(side)) if len(sides) > 1 else label != label[largest]
    found = []
    for i in np.nonzero(asking)[0].tolist():
        if len(sides) == 1 and label[i] == label[largest]:
            continue  # all that are still apart ask by themselves
        other = side != side[i] if len(sides) > 1 else np.ones(n, bool)
        mine = place[first[i] : first[i + 1]]
        mine = mine[often[mine] > 1]
        if len(mine) < similarity * size[i] or (label[other] == label[i]).all():
            continue
        both, step = np.zeros(n, np.int64), max(1, HELD // n)
        for at in range(0, len(mine), step):
            part = mine[at : at + step]
            both += np.bincount(gather(holders, start[part], often[part]), minlength=n)
        near = other & (label != label[i]) & (both >= similarity * (size[i] + size - both))
        for j in np.nonzero(near)[0].tolist():
            if label[j] != label[i]:
                found.append((roots[i], roots[j]))
                label[label == label[j]] = label[i]
    return found


def _links_in_blocks(blocks: DataFrame, similarity: float) -> DataFrame:
    """``links_across`` of each block's rows (block, pack, root, grams); a block has the texts of one pack or of two."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list) -> pa.RecordBatch:
            _, packs, roots, grams = zip(*rows, strict=True)
            found = links_across(list(roots), np.array(packs), [np.frombuffer(g, np.uint64) for g in grams], similarity)
            return pa.RecordBatch.from_arrays([pa.array([e[i] for e in found], pa.string()) for i in (0, 1)], names=["a", "b"])

        held: list = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("block", "pack", "root", "grams")), strict=True):
                if held and held[0][0] != row[0]:
                    yield out(held)
                    held = []
                held.append(row)
        if held:
            yield out(held)

    dealt = blocks.repartition("block").sortWithinPartitions("block")
    return dealt.select("block", "pack", "root", "grams").mapInArrow(scan, "a string, b string")


def _packed(rooted: DataFrame, most: int) -> DataFrame:
    """(label, pack, parts, node, root) of rows (band, node, size, least, root) whose band has several roots: texts that share such a band have
    the same label. A label of over ``most`` bytes of sets is cut into packs, each two of which are to meet; others share labels of about ``most``.

    The label of a band is the least band that any of its texts has.
    """
    split = rooted.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("least").alias("label")).where("low <> high").select("band", "label")
    met = durable(spread_join(rooted, split, "band", "node", spread=4).select("label", "node", "root", "size").distinct())
    shares = max(1, -(-(met.agg(F.sum("size")).first()[0] or 0) // most))
    parts = met.groupBy("label").agg(F.greatest(F.lit(1), F.ceil(F.sum("size") / most)).cast("int").alias("parts"), F.count(F.lit(1)).alias("n"))
    cut = hot_join(met, parts, ["label"], "node", "n", total=met.count())
    label = F.when(F.col("parts") > 1, F.concat_ws("/", F.lit("cut"), "label")).otherwise(F.pmod(F.xxhash64("label"), F.lit(shares)).cast("string"))
    return cut.select(label.alias("label"), F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("pack"), "parts", "node", "root").distinct()


def similar_texts(texts: DataFrame, *, shingle: int = SHINGLE, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(node, component) of texts (node, text; equal texts share a node) that have links; a link is a Jaccard similarity of at least
    ``similarity`` between the sets of word shingles, and the component is the smallest node.

    Fingerprints that meet share a band. Texts of a band are compared with its first one; what this leaves in several components is compared in full, by
    packs of about ``block * TEXT_BYTES`` of sets (``_packed``): a text goes once to a pack, however many of its bands are in it.
    Tasks give back spanning edges, and no text goes without an exact comparison.
    """
    rows = durable(_banded(texts, shingle, PRINTS * block))
    bands = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("members")).where("n > 1")
    shared = durable(spread_join(rows, bands, "band", "node", spread=4))
    wanted = durable(shared.groupBy("node").agg(F.min("band").alias("least")))
    sets = durable(_sets(texts.join(wanted, "node", "left_semi"), shingle))

    pairs = shared.where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")).distinct()
    near = durable(connected_components(_verified(pairs, sets, similarity)))
    placed = sets.select("node", F.octet_length("grams").alias("size")).join(wanted, "node").join(near, "node", "left").select("node", "size", "least", F.coalesce("component", "node").alias("root"))

    # Bands with the same texts need one comparison; a band of two had it above.
    single = shared.where("n > 2").groupBy("n", "members").agg(F.min("band").alias("band")).select("band")
    rooted = durable(spread_join(shared, single, "band", "node", spread=4).select("band", "node").join(placed, "node"))
    open_rows = _packed(rooted, block * TEXT_BYTES).join(sets, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    blocks = open_rows.select(F.concat_ws("/", "label", F.least("pack", "other"), F.greatest("pack", "other")).alias("block"), "pack", "root", "grams")
    # What is found now joins components, so only these meet again.
    joined = durable(connected_components(_links_in_blocks(blocks, similarity)))
    if not joined.limit(1).count():
        return near
    merged = near.join(joined.select(F.col("node").alias("component"), F.col("component").alias("above")), "component", "left")
    alone = joined.join(near, "node", "left_anti")
    return merged.select("node", F.coalesce("above", "component").alias("component")).unionByName(alone)


def text_key(text: Column) -> Column:
    """The node of a text; null and empty texts are one."""
    return F.md5(F.coalesce(text, F.lit("")))


def similar_components(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """Rows (doc_id, node, root, component_id): each row of ``docs``, its component's node and smallest doc_id.

    Equal texts are one node. Texts without words are alike. Rows with a null doc_id take part. An id whose rows have
    different texts may be the smallest of several components, which their roots tell apart.
    """
    named = durable(docs.select(docs[doc_id].alias("doc_id"), text_key(docs[text]).alias("node")))
    nodes = named.groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    roots = similar_texts(docs.select(text_key(docs[text]).alias("node"), docs[text].alias("text")), **options)
    rooted = durable(nodes.join(roots, "node", "left").select("node", "least", "copies", F.coalesce("component", "node").alias("root")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    ids = hot_join(rooted, least, ["root"], "node", "n", total=rooted.count()).select("node", "root", "component_id", "copies")
    return hot_join(named, ids, ["node"], "doc_id", "copies", total=named.count()).select("doc_id", "node", "root", "component_id")
