"""Byte-level BPE: a segment tree over byte positions finds each merge, and ids decode to the bytes they came from."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

Ranks = dict[bytes, int]

#: Distinct pieces whose ids a worker remembers, twice, and bytes of the longest such piece; beyond these pieces are merged again.
REMEMBERED, SHORT = 1 << 19, 64
#: Bytes of a rank file at most, for every executor holds it.
FILE_BYTES = 64 << 20
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> Ranks:
    """Token -> rank, of a file with a base64 token and its rank on each line. The driver reads it: it has a size bound."""
    file = Path(path)
    if file.stat().st_size > FILE_BYTES:
        raise ValueError(f"a rank file of over {FILE_BYTES} bytes: {path}")
    pairs = (line.split() for line in file.read_bytes().splitlines() if line.strip())
    ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"bytes without a rank: {missing[:5]}")
    return ranks


class MergeTree:
    """Leaves are the byte positions of a piece. A position at which a part begins holds the rank of that part joined
    with the next one; a node holds the least of its leaves, leftmost among equals.

    A leaf is the number rank * size + position, so that the least number is the leftmost pair of the least rank. A
    merge changes three leaves at most, the pair's own and those of its two neighbours, each up to the root.
    """

    def __init__(self, piece: bytes, ranks: Ranks, beyond: int):
        """``beyond``: a number above all ranks. Pairs without a rank count as that, so that no leaf from ``none`` on is merged."""
        n = self.n = len(piece)
        self.piece, self.ranks, self.beyond = piece, ranks, beyond
        size = self.size = 1 << max(0, n - 1).bit_length()
        self.none = beyond * size
        self.end = list(range(1, n + 1))  # of the part that begins here
        self.before = list(range(-1, n - 1))  # where the part before this one begins
        rank = ranks.get
        leaves = [rank(piece[i : i + 2], beyond) * size + i for i in range(n - 1)]
        tree = self.tree = [self.none] * size + leaves + [self.none] * (size - len(leaves))
        for i in range(size - 1, 0, -1):
            left, right = tree[2 * i], tree[2 * i + 1]
            tree[i] = left if left < right else right

    def merge_all(self) -> None:
        """Join the leftmost pair of the least rank, as long as there is one. A part is a token, so a pair is no longer than two."""
        piece, rank, beyond, n, size, none = self.piece, self.ranks.get, self.beyond, self.n, self.size, self.none
        tree, ends, before = self.tree, self.end, self.before
        while (leaf := tree[1]) < none:
            at = leaf & (size - 1)
            gone = ends[at]
            ends[at] = middle = ends[gone]
            tree[gone + size] = leaf = none
            if middle < n:
                before[middle] = at
                leaf = rank(piece[at : ends[middle]], beyond) * size + at
            tree[at + size] = leaf
            changed = (gone + size, at + size)
            if (left := before[at]) >= 0:
                tree[left + size] = rank(piece[left:middle], beyond) * size + left
                changed = (gone + size, at + size, left + size)
            for i in changed:
                while i > 1:
                    leaf, other = tree[i], tree[i ^ 1]
                    i >>= 1
                    if other < leaf:
                        leaf = other
                    if tree[i] == leaf:
                        break
                    tree[i] = leaf

    def ids(self) -> list[int]:
        self.merge_all()
        found, at = [], 0
        while at < self.n:
            found.append(self.ranks[self.piece[at : self.end[at]]])
            at = self.end[at]
        return found


class Codec:
    """Encodes and decodes with the ranks of one file. Ids of pieces that come again are remembered; when a memory is full,
    it becomes the old one, from which only pieces that come again move on."""

    def __init__(self, ranks: Ranks, pattern: str):
        self.ranks, self.beyond = ranks, max(ranks.values()) + 1
        self.split = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}  # the collector of garbage does not visit tuples of numbers again and again
        self.old: dict[str, tuple[int, ...]] = {}
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.names = {rank: str(rank) for rank in self.tokens}

    def piece_ids(self, piece: str) -> tuple[int, ...]:
        found = self.old.get(piece)
        data = piece.encode()
        if found is None:
            whole = self.ranks.get(data)  # a whole token is itself, whether or not merges lead there
            found = tuple(MergeTree(data, self.ranks, self.beyond).ids()) if whole is None else (whole,)
        if len(data) <= SHORT:
            if len(self.known) >= REMEMBERED:
                self.known, self.old = {}, self.known
            self.known[piece] = found
        return found

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable([self.known.get(p) or self.piece_ids(p) for p in self.split(text)]))

    def named(self, ids: list[int]) -> str:
        """The ids as decimal numbers, joined by commas."""
        return ",".join(map(self.names.__getitem__, ids))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def shared_ranks(spark: SparkSession, path: str) -> Broadcast:
    """The ranks, sent to each executor once; read_ranks bounds their size. Codecs made of them are kept beside them."""
    return spark.sparkContext.broadcast({"ranks": read_ranks(path), "codecs": {}})


def kept_codec(shared: dict, pattern: str) -> Codec:
    """The codec of a worker, which keeps a broadcast value, and so what the codec remembers, from one task to the next."""
    if pattern not in shared["codecs"]:
        shared["codecs"][pattern] = Codec(shared["ranks"], pattern)
    return shared["codecs"][pattern]


def encode_documents(docs: DataFrame, *, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, ids): the token ids of each whole text, in order.

    Each match of ``pattern`` is encoded by itself and without special tokens; a null or empty text has no ids. Bytes
    that are no UTF-8 count as U+FFFD. Rows stay as they are: repeated ones repeat, and an empty table gives none. No
    shuffle: a row needs only its own text.
    """
    ranks = shared_ranks(docs.sparkSession, path)

    def scan(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = kept_codec(ranks.value, pattern)
        for block in blocks:
            for id_, text_ in zip(block.column("id"), block.column("text"), strict=True):
                ids = codec.encode((text_.as_py() or b"").decode(errors="replace"))
                yield pa.RecordBatch.from_arrays([pa.array([id_.as_py()], pa.int64()), pa.array([ids], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return _texts(docs, doc_id, text).mapInArrow(scan, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, *, path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Rows (doc_id, data): the bytes of each row's ids. Null ids are none; an id without a token is an error."""
    ranks = shared_ranks(encoded.sparkSession, path)

    def scan(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = kept_codec(ranks.value, "")
        for block in blocks:
            data = [codec.decode(x or []) for x in block.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(data, pa.binary())], names=["doc_id", "data"])

    rows = encoded.select(encoded[doc_id].cast("long").alias("doc_id"), encoded[ids].cast("array<int>").alias("ids"))
    return rows.mapInArrow(scan, "doc_id long, data binary")


def round_trips(docs: DataFrame, *, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of RESULT: how many ids each document has, and the digests of its ids (decimal, joined by commas) and of
    what they decode to. Encoding and decoding share a task, so that ids are not shuffled or written."""
    ranks = shared_ranks(docs.sparkSession, path)

    def scan(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = kept_codec(ranks.value, pattern)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for block in blocks:
            rows = []
            for text_ in block.column("text"):
                ids = codec.encode((text_.as_py() or b"").decode(errors="replace"))
                rows.append((len(ids), sha(codec.named(ids).encode()), sha(codec.decode(ids))))
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            types = (pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([block.column("id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _texts(docs, doc_id, text).mapInArrow(scan, RESULT)


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(docs[doc_id].cast("long").alias("id"), docs[text].cast("binary").alias("text"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trips(spark.read.parquet(f"{sf_dir}/documents.parquet"), path=public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern=public_tokenizers.PATTERN)
