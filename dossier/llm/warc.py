"""WARC files of web pages, and a Merkle audit that locates where replicas differ."""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.llm.durable import durable, shared_path

FANOUT = 16
RECORDS_PER_FILE, BYTES_PER_FILE = 1000, 64 << 20
DATE = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"


def _text(column: str | Column) -> Column:
    return F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit(""))


def file_count(pages: DataFrame, per_file: int = RECORDS_PER_FILE, *, html: str = "html", file_bytes: int = BYTES_PER_FILE) -> int:
    """So many files that each has about ``per_file`` records and ``file_bytes`` of pages at most."""
    rows, size = pages.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(_text(pages[html])).cast("long")), F.lit(0))).first()
    return max(1, -(-rows // per_file), -(-size // file_bytes))


def warc_records(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", files: int | None = None, per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """Rows (page_id, file, ordinal, offset, length, key, record_sha256, record): each page as a WARC resource record at
    its place.

    A digest of id and address, the key, deals pages to ``files`` files (by default so that each has about ``per_file``
    records) and orders them there, so that a hot host is spread. Replicas are only comparable if they have the same
    number of files, which ``write_warc`` stores with them. The record includes its closing line ends. Null fields count
    as empty; rows with equal id and address are ordered by their pages. An empty table gives no rows.
    """
    rows = pages.select(pages[page_id].alias("page_id"), _text(pages[url]).alias("url"), _text(pages[html]).alias("html"))
    rows = rows.withColumn("key", F.md5(F.concat_ws("|", _text("page_id"), "url")))
    uuid = F.regexp_replace("key", "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    rows = rows.withColumn("file", F.pmod(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), F.lit(files or file_count(pages, per_file, html=html))))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:"), uuid, F.lit(">\r\nWARC-Date: " + DATE + "\r\nWARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]+", " "), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit(END))
    rows = rows.withColumn("record", F.concat(head, "html", F.lit(END)))
    # Digests and sizes are taken here, so that who needs no records moves none.
    rows = rows.select("page_id", "file", "key", "record", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("record_sha256"), F.md5("record").alias("tie"))
    order = Window.partitionBy("file").orderBy("key", "tie")
    offset = F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    return rows.select("page_id", "file", (F.row_number().over(order) - 1).cast("long").alias("ordinal"), offset.alias("offset"), "length", "key", "record_sha256", "record")


def members(records: DataFrame) -> DataFrame:
    """Rows (page_id, file, ordinal, member): each record as a gzip member of its own, so that one that is spoilt hides no
    other. A member without its last byte is what is kept: that byte, the top of the record's size, is zero, and a record
    of 16 MB or more, whose top byte may not be, has an empty member after it."""

    def pack(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks:
            packed = [gzip.compress(r, 6, mtime=0) + (gzip.compress(b"", mtime=0) if len(r) >= 1 << 24 else b"") for r in block.columns[3].to_pylist()]
            yield pa.RecordBatch.from_arrays([*block.columns[:3], pa.array([m[:-1] for m in packed], pa.binary())], names=["page_id", "file", "ordinal", "member"])

    kind = records.schema["page_id"].dataType.simpleString()
    return records.select("page_id", "file", "ordinal", F.col("record").cast("binary")).mapInArrow(pack, f"page_id {kind}, file long, ordinal long, member binary")


def write_members(packed: DataFrame, path: str, files: int) -> None:
    """One directory per file number, whose files hold the members in order, and the number of files. The text writer puts
    bytes out as they are and ends each with a zero byte, the one that ``members`` leaves to it."""
    ordered = packed.repartition("file").sortWithinPartitions("file", "ordinal")
    ordered.select("file", F.col("member").cast("string").alias("value")).write.partitionBy("file").option("lineSep", "\0").mode("errorifexists").text(f"{path}/records")
    packed.sparkSession.range(1).select(F.lit(files).alias("files")).write.json(f"{path}/layout")


def write_warc(records: DataFrame, path: str, files: int) -> None:
    """WARC files, compressed record by record, below ``path``."""
    write_members(members(records), path, files)


def files_of(spark: SparkSession, path: str) -> int:
    """The number of files that a replica was written with, empty ones included."""
    return spark.read.schema("files long").json(f"{path}/layout").first()["files"]


READ = "file long, ordinal long, offset long, length long, uri string, key string, record_sha256 string, body string, raw binary, damaged boolean"
MEMBER = gzip.compress(b"", mtime=0)[:8]
KEY = re.compile(rb"\r\nWARC-Record-ID: <urn:uuid:([0-9a-f]{8})-([0-9a-f]{4})-([0-9a-f]{4})-([0-9a-f]{4})-([0-9a-f]{12})>\r\n")
STEP = 1 << 16


def _member_at(data: bytes, at: int) -> tuple[bytes, int | None]:
    """What the member that begins at ``at`` holds, and where it ends; no end if it cannot be read, with what could be."""
    reader, out, place = zlib.decompressobj(31), [], at
    try:
        while not reader.eof:
            if place >= len(data):
                return b"".join(out), None
            out.append(reader.decompress(data[place : place + STEP]))
            place += STEP
    except zlib.error:
        return b"".join(out), None
    return b"".join(out), min(place, len(data)) - len(reader.unused_data)


def _record(data: bytes, is_whole: bool) -> tuple[str | None, str | None, str | None, bytes | None, bool]:
    """(uri, key, body, raw, damaged) of what a member held. A body that is no UTF-8 is null, and the record's bytes are
    raw then; so they are if lengths or fields do not fit."""
    key = KEY.search(data)
    stop = data.find(END.encode())
    head = data[: max(stop, 0)]
    uri, size = re.search(rb"\r\nWARC-Target-URI: ([^\r\n]*)", head), re.search(rb"\r\nContent-Length: (\d{1,18})(?:\r\n|$)", head)
    sound = is_whole and data.startswith(b"WARC/1.0\r\n") and stop >= 0 and key and uri and size and stop + len(END) + int(size[1]) + len(END) == len(data) and data.endswith(END.encode())
    name = uri[1].decode(errors="replace") if uri else None
    try:
        body = data[stop + len(END) : -len(END)].decode() if sound else None
    except UnicodeDecodeError:
        body = None
    return name, b"".join(key.groups()).decode() if key else None, body, None if body is not None else data, not sound


def records_of(data: bytes) -> Iterator[tuple]:
    """READ without the file, from a file's bytes. What cannot be read, up to where the next member begins, is one record."""
    at, ordinal, offset = 0, 0, 0
    while at < len(data):
        content, stop = _member_at(data, at)
        is_whole = stop is not None
        if not is_whole:
            place = data.find(MEMBER, at + 1)
            stop = len(data) if place < 0 else place
        if content or not is_whole:
            size = len(content) if is_whole else int.from_bytes(data[max(at, stop - 4) : stop], "little")
            digest = hashlib.sha256(content if is_whole else data[at:stop]).hexdigest()
            uri, key, body, raw, damaged = _record(content, is_whole)
            yield ordinal, offset, size, uri, key, digest, body, raw, damaged
            ordinal, offset = ordinal + 1, offset + size
        at = stop


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Rows of READ, of the files that ``write_warc`` wrote; offsets are those of the uncompressed file.

    Bytes are read as they are. A member that cannot be read, or whose fields or lengths do not fit, is a record of its
    own with ``damaged``, the SHA-256 of its bytes, its key as far as that can be read, and the size that its end tells;
    reading goes on where the next member's first bytes stand. A task reads files whose number of records and bytes the writer bounds.
    """
    types = [pa.int64()] * 4 + [pa.string()] * 4 + [pa.binary(), pa.bool_()]
    names = [c.split()[0] for c in READ.split(", ")]

    def parse(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks:
            for name, data in zip(block.column("path").to_pylist(), block.column("content").to_pylist(), strict=True):
                file = int(re.search(r"file=(\d+)", name)[1])
                rows = [(file, *r) for r in records_of(data)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(f"{path}/records")
    return files.select("path", "content").mapInArrow(parse, READ)


@dataclass
class Tree:
    """files: the levels of each file's tree, records first; roots: those of the tree whose leaves are the files."""

    files: list[DataFrame]
    roots: list[DataFrame]


def _above(level: DataFrame, fanout: int) -> DataFrame:
    children = F.array_sort(F.collect_list(F.struct("node", "hash")))
    parents = level.groupBy("file", F.floor(F.col("node") / fanout).alias("node")).agg(children.alias("c"), F.min("start").alias("start"), F.max("stop").alias("stop"))
    joined = F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["node"], x["hash"])), ",")
    return durable(parents.select("file", "node", "start", "stop", F.sha2(joined, 256).alias("hash")))


def merkle_tree(records: DataFrame, fanout: int = FANOUT) -> Tree:
    """Levels of (file, node, start, stop, hash) from records (file, ordinal, offset, length, key, record_sha256, and
    damaged if there is such a column).

    A leaf hashes its offset range and its record's SHA-256, and keeps the record's key and digest; a node hashes its
    children in order, and spans their ranges. A file's levels end in one node; files are then the leaves of the tree
    above, with file -1. A task holds ``fanout`` hashes a node.
    """
    stop = F.col("offset") + F.col("length")
    leaf = F.sha2(F.concat_ws(":", "offset", stop, "record_sha256"), 256)
    hurt = F.col("damaged") if "damaged" in records.columns else F.lit(False)

    def climb(levels: list[DataFrame]) -> list[DataFrame]:
        while (levels[-1].agg(F.max("node")).first()[0] or 0) > 0:
            levels.append(_above(levels[-1], fanout))
        return levels

    files = climb([durable(records.select("file", F.col("ordinal").alias("node"), F.col("offset").alias("start"), stop.alias("stop"), leaf.alias("hash"), F.coalesce("key", F.lit("")).alias("key"), F.col("record_sha256").alias("content"), hurt.alias("damaged")))])
    top = files[-1].select(F.lit(-1).cast("long").alias("file"), F.col("file").alias("node"), "start", "stop", F.sha2(F.concat_ws(":", "file", "hash"), 256).alias("hash"))
    return Tree(files, climb([top]))


def _differing(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    theirs = theirs.select("file", "node", F.col("hash").alias("other"))
    both = ours.select("file", "node", "hash").join(theirs, ["file", "node"], "full")
    return both.where(~F.col("hash").eqNullSafe(F.col("other")))


def _as_high(low: list[DataFrame], high: list[DataFrame], fanout: int) -> list[DataFrame]:
    """``low`` with nodes of one child each on top, up to the height of ``high``."""
    low = list(low)
    while len(low) < len(high):
        low.append(_above(low[-1], fanout))
    return low


def audit(ours: Tree, theirs: Tree, fanout: int = FANOUT) -> DataFrame:
    """Rows (file, ordinal, status) of records that differ: changed, damaged (there), missing (there) or extra (there).

    Roots are compared first; below, only children of nodes that differ are. In the leaves that differ, records are
    told by their keys: what a lost or added record only moves along its file is not reported. The ordinal is ours, or
    theirs of an extra record. A damaged record is ours of its key or, where none has it, ours at its place if that is
    missing; else it stands at its place there. Trees that were built with different numbers of files have little in common.
    """
    files = [_as_high(a, b, fanout) for a, b in ((ours.files, theirs.files), (theirs.files, ours.files))]
    roots = [_as_high(a, b, fanout) for a, b in ((ours.roots, theirs.roots), (theirs.roots, ours.roots))]
    found, height = None, len(files[0])
    levels = list(zip(files[0] + roots[0], files[1] + roots[1], strict=True))

    def below(level: DataFrame, i: int, found: DataFrame) -> DataFrame:
        parent = (F.lit(-1).cast("long"), F.col("file")) if i == height - 1 else (F.col("file"), F.floor(F.col("node") / fanout))
        up = found.select(F.col("file").alias("pf"), F.col("node").alias("pn"))
        return level.join(up, [parent[0] == F.col("pf"), parent[1] == F.col("pn")], "left_semi")

    for i in reversed(range(len(levels))):
        a, b = levels[i] if found is None else (below(x, i, found) for x in levels[i])
        found = durable(_differing(a, b))
        if not found.limit(1).count():
            break
    at = ["file", "node"]
    mine, other = (side[0].join(found, at, "left_semi").select("file", "node", "key", "content", "damaged") for side in files)

    def numbered(rows: DataFrame, *by: str) -> DataFrame:
        return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy("content", "node")))

    same = ["file", "key", "content", "nth"]
    mine, other = numbered(mine, *same[:3]), numbered(other, *same[:3])
    left, right = (numbered(x.join(y, same, "left_anti"), "file", "key") for x, y in ((mine, other), (other, mine)))
    right = right.select("file", "key", "nth", F.col("node").alias("there"), F.col("damaged").alias("hurt"))
    both = durable(left.select("file", "key", "nth", "node").join(right, ["file", "key", "nth"], "full").select("file", "node", "there", "hurt"))
    lone, lost = both.where("node is null and hurt"), both.where("there is null")
    placed = lone.select("file", F.col("there").alias("node"), F.col("hurt").alias("here"))
    rest = both.join(lost.select("file", F.col("node").alias("there"), F.lit(True).alias("taken")), ["file", "there"], "left").where("not (node is null and hurt and coalesce(taken, false))")
    rest = rest.join(placed, ["file", "node"], "left").withColumn("hurt", F.coalesce("hurt", F.lit(False)) | (F.col("there").isNull() & F.coalesce("here", F.lit(False))))
    status = F.when(F.col("hurt"), "damaged").when(F.col("there").isNull(), "missing").when(F.col("node").isNull(), "extra").otherwise("changed")
    return rest.select("file", F.coalesce("node", "there").alias("ordinal"), status.alias("status"))


def op8_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with its place, and what the audit says of a replica, written to WARC files and read back, in which
    some pages lost a byte's value before they were written, and some records one of their stored bytes."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    files = file_count(pages)
    changed = F.when(F.pmod("page_id", F.lit(97)) == 5, F.overlay("html", F.lit("#"), F.lit(1), F.lit(1))).otherwise(F.col("html"))
    replica = shared_path(spark, "warc")
    packed = members(warc_records(pages.withColumn("html", changed), files=files))
    half = (F.octet_length("member") / 2).cast("int")
    other = F.unhex(F.lpad(F.hex(F.conv(F.hex(F.substring("member", half, F.lit(1))), 16, 10).cast("int").bitwiseXOR(F.lit(85))), 2, "0"))
    spoilt = F.when(F.pmod("page_id", F.lit(89)) == 7, F.concat(F.substring("member", F.lit(1), half - 1), other, F.substring("member", half + 1, F.octet_length("member")))).otherwise(F.col("member"))
    write_members(packed.withColumn("member", spoilt), replica, files)
    ours = durable(warc_records(pages, files=files_of(spark, replica)).drop("record"))
    found = audit(merkle_tree(ours), merkle_tree(read_warc(spark, replica).drop("body", "raw")))
    placed = ours.drop("key")
    return placed.join(found.where("status <> 'extra'"), ["file", "ordinal"], "left").withColumn("status", F.coalesce("status", F.lit("same")))


OP8_SQL = r"""
WITH files AS (SELECT greatest(1, ceil(count(*) / 1000.0), ceil(coalesce(sum(strlen(html)), 0) / 67108864.0))::BIGINT AS n FROM pages),
texts AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, md5(coalesce(page_id::VARCHAR, '') || '|' || coalesce(url, '')) AS digest FROM pages),
records AS (
  SELECT page_id, html, ('0x' || substr(digest, 1, 8))::BIGINT % (SELECT n FROM files) AS file, digest,
    'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:uuid:' || substr(digest, 1, 8) || '-' || substr(digest, 9, 4) || '-' || substr(digest, 13, 4) || '-' || substr(digest, 17, 4) || '-' || substr(digest, 21)
    || '>' || chr(13) || chr(10) || 'WARC-Date: 2024-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html)
    || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM texts)
SELECT page_id, file, row_number() OVER w - 1 AS ordinal, coalesce(sum(strlen(record)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset",
  strlen(record)::BIGINT AS length, sha256(record) AS record_sha256,
  CASE WHEN page_id % 89 = 7 THEN 'damaged' WHEN page_id % 97 = 5 AND html NOT LIKE '#%' AND html <> '' THEN 'changed' ELSE 'same' END AS status
FROM records WINDOW w AS (PARTITION BY file ORDER BY digest, md5(record))
"""
