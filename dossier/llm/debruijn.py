"""Substring deduplication over words: repeated k-mers, compacted paths, and verified source coordinates."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.batches import LAST, Batch, Columns, Packed, answer, ask, pack_documents, unpack, visit
from dossier.llm.durable import durable
from dossier.llm.graph import HOT

K = 13
U = np.uint64
#: Words of more bytes are hashed one by one: over long texts, sums of powers modulo 2^64 are no good hashes.
LONG_WORD = 64


def _numbers(seed: int) -> tuple[np.ndarray, int, int]:
    """Random numbers of a seed: one for each byte value, and odd multipliers for bytes and for words."""
    rng = np.random.default_rng(7 + seed)
    table = rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
    r, w = (int(x) | 1 for x in rng.integers(1 << 62, 1 << 63, 2))
    return table, r, w


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, length: int) -> np.ndarray:
    """1, base, base^2 ...; a worker keeps the longest table it has needed."""
    if base not in _POWERS or len(_POWERS[base]) < length:
        steps = np.full(1 << max(16, (length - 1).bit_length()), base, np.uint64)
        steps[0] = 1
        _POWERS[base] = np.multiply.accumulate(steps)
    return _POWERS[base][:length]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def running_hash(data: np.ndarray, seed: int = 0) -> tuple[np.ndarray, int]:
    """Prefix sums of byte values times powers of a base, and the base; a difference, times an inverse power, is the
    hash of what is between."""
    table, base, _ = _numbers(seed)
    sums = np.zeros(len(data) + 1, np.uint64)
    sums[1:] = table[data]
    sums[1:] *= powers(base, len(data))
    return np.cumsum(sums, out=sums), base


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    sums, base = running_hash(data, seed)
    found = mixed((sums[end] - sums[start]) * powers(pow(base, -1, 1 << 64), len(sums))[start])
    for i in np.nonzero(end - start > LONG_WORD)[0].tolist():
        found[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes(), seed + 1)
    return found


def word_bounds(batch: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the row that holds it."""
    data = batch.data
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    cut = np.zeros(len(data) + 1, bool)
    cut[batch.starts] = True
    before = np.r_[False, inside[:-1]] if len(data) else inside
    after = np.r_[inside[1:], False] if len(data) else inside
    start = np.nonzero(inside & (~before | cut[:-1]))[0]
    end = np.nonzero(inside & (~after | cut[1:]))[0] + 1
    return start, end, np.searchsorted(batch.starts, start, side="right") - 1


class Words:
    """The words of a batch: start, end, row; first: the first word of each row."""

    def __init__(self, batch: Batch):
        self.batch = batch
        self.start, self.end, self.row = word_bounds(batch)
        self.first = np.searchsorted(self.row, np.arange(batch.rows + 1))

    def text(self, first: int, words: int) -> bytes:
        """Words joined by single spaces."""
        data = self.batch.data
        return b" ".join(data[s:e].tobytes() for s, e in zip(self.start[first : first + words], self.end[first : first + words], strict=True))


class Kmers(Words):
    """The k-mers of a batch too: their hashes, and the word at which each begins."""

    def __init__(self, batch: Batch, k: int, seed: int = 0):
        super().__init__(batch)
        self.k = k
        word = word_hashes(batch.data, self.start, self.end, seed)
        n = max(0, len(word) - k + 1)
        h, times = np.zeros(n, np.uint64), U(_numbers(seed)[2])
        for j in range(k):
            h = h * times + word[j : j + n]
        whole = self.row[:n] == self.row[k - 1 :]
        self.at = np.nonzero(whole)[0]
        self.hash = mixed(h[whole])


def least_by_hash(h: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first entry with the least id for each distinct hash, and whether the hash has other ids too."""
    order = np.lexsort((np.arange(len(h)), ids, h))
    sorted_h, sorted_ids = h[order], ids[order]
    new = np.r_[True, sorted_h[1:] != sorted_h[:-1]] if len(h) else np.zeros(0, bool)
    starts = np.nonzero(new)[0]
    lasts = np.r_[starts[1:], len(h)] - 1
    return order[starts], sorted_ids[starts] != sorted_ids[lasts] if len(h) else np.zeros(0, bool)


# 1: which k-mers may repeat. A key has 32 bits beside its part, whatever the size of the input, for parts hold equal shares.
KEY_FIELDS = {"part": np.uint32, "key": np.uint32, "several": np.uint8}
KEY_ANSWER = {"part": np.uint32, "key": np.uint32}


def key_question(h: np.ndarray, ids: np.ndarray, parts: int, inside: bool = False) -> tuple[np.ndarray, Columns]:
    """Each hash once. ``inside``: also tell whether several ids of this batch have it."""
    part, key = (h % U(parts)).astype(np.int64), (h >> U(32)).astype(np.uint32)
    first, several = least_by_hash(h, ids)
    several = several & inside
    order = np.argsort(key[first], kind="stable")
    first, several = first[order], several[order]
    return part[first], {"part": part[first].astype(np.uint32), "key": key[first], "several": several.astype(np.uint8)}


def key_reply(batch: np.ndarray, asked: Columns) -> tuple[np.ndarray, Columns]:
    order = np.argsort(asked["key"], kind="stable")
    key, batch, several = asked["key"][order], batch[order], asked["several"][order]
    if not len(key):
        return batch, {"part": asked["part"], "key": key}
    starts = np.nonzero(np.r_[True, key[1:] != key[:-1]])[0]
    sizes = np.diff(np.r_[starts, len(key)])
    repeated = np.repeat((sizes > 1) | (np.maximum.reduceat(several, starts) > 0), sizes)
    return batch[repeated], {"part": asked["part"][order][repeated], "key": key[repeated]}


def may_repeat(h: np.ndarray, parts: int, known: Columns, bits: int = 32) -> np.ndarray:
    """Whether a hash's part and key are known; a key is the highest ``bits`` of a hash."""
    wanted = np.unique((known["part"].astype(np.uint64) << U(32)) | known["key"])
    mine = ((h % U(parts)) << U(32)) | (h >> U(64 - bits))
    return np.isin(mine, wanted, kind="sort")


# 2: the source of each k-mer of several batches: its first place in the document with the least id.
EDGE_FIELDS = {"hash": np.uint64, "id": np.int64, "at": np.uint32}
EDGE_ANSWER = {"hash": np.uint64, "batch": np.int64, "at": np.uint32}


def edge_reply(batch: np.ndarray, asked: Columns) -> tuple[np.ndarray, Columns]:
    """Only batches hear of a source whose documents all have larger ids; others know the least id from themselves."""
    order = np.lexsort((asked["at"], batch, asked["id"], asked["hash"]))
    h, ids = asked["hash"][order], asked["id"][order]
    starts = np.nonzero(np.r_[True, h[1:] != h[:-1]])[0] if len(h) else np.zeros(0, int)
    source = np.repeat(starts, np.diff(np.r_[starts, len(h)]))
    later = ids > ids[source]
    source = order[source[later]]
    return batch[order[later]], {"hash": h[later], "batch": batch[source], "at": asked["at"][source]}


SPANS = "batch_id long, at int, windows int, source_batch long, source_at int, digest binary"
CLAIM = ["source_batch", "source_at", "windows", "digest"]
_ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(c.split()[0], _ARROW[c.split()[1]]) for c in ddl.split(", ")])


def paths(kmers: Kmers, known: Columns) -> pa.Table:
    """Compacted paths: runs of k-mers whose sources are consecutive k-mers of one smaller document.

    A run is a path of the graph along which neither text branches off: it ends where the next k-mer is not repeated,
    or where its source is another document or another place. Places are numbers of words in a batch.
    """
    ids = kmers.batch.ids[kmers.row[kmers.at]]
    if not len(ids):
        return _schema(SPANS).empty_table()
    distinct, mine = np.unique(kmers.hash, return_inverse=True)
    first, _ = least_by_hash(kmers.hash, ids)  # in the order of distinct hashes
    s_batch, s_at = np.full(len(distinct), kmers.batch.batch_id), kmers.at[first].astype(np.int64)
    s_id = ids[first]
    to = np.searchsorted(distinct, known["hash"])
    s_batch[to], s_at[to], s_id[to] = known["batch"], known["at"], np.iinfo(np.int64).min
    hit = np.nonzero(s_id[mine] < ids)[0]
    if not len(hit):
        return _schema(SPANS).empty_table()
    at, s_batch, s_at = kmers.at[hit], s_batch[mine[hit]], s_at[mine[hit]]
    row = kmers.row[at]
    goes_on = (np.diff(row) == 0) & (np.diff(at) == 1) & (np.diff(s_batch) == 0) & (np.diff(s_at) == 1)
    start = np.nonzero(np.r_[True, ~goes_on])[0]
    windows = np.diff(np.r_[start, len(hit)])
    digests = [hashlib.blake2b(kmers.text(int(w), int(n) + kmers.k - 1), digest_size=16).digest() for w, n in zip(at[start], windows, strict=True)]
    columns = [np.full(len(start), kmers.batch.batch_id), at[start].astype(np.int32), windows.astype(np.int32), s_batch[start], s_at[start].astype(np.int32)]
    return pa.Table.from_arrays([*map(pa.array, columns), pa.array(digests, pa.binary())], schema=_schema(SPANS))


def claimed_spans(packed: Packed, k: int, seed: int) -> DataFrame:
    """Rows of SPANS: where a document seems to repeat a smaller one, as the k-mers' hashes of this seed say."""
    parts = packed.parts

    def keys(batch: Batch, _: Columns):
        kmers = Kmers(batch, k, seed)
        return key_question(kmers.hash, batch.ids[kmers.row[kmers.at]], parts)

    asked = ask(packed, None, {}, keys, KEY_FIELDS)
    candidates = answer(packed, asked, KEY_FIELDS, key_reply, KEY_ANSWER)

    def edges(batch: Batch, known: Columns):
        kmers = Kmers(batch, k, seed)
        some = np.nonzero(may_repeat(kmers.hash, parts, known))[0]
        h, ids = kmers.hash[some], batch.ids[kmers.row[kmers.at[some]]]
        first, _ = least_by_hash(h, ids)
        columns = {"hash": h[first], "id": ids[first], "at": kmers.at[some][first].astype(np.uint32)}
        return (h[first] % U(parts)).astype(np.int64), columns

    sources = answer(packed, ask(packed, candidates, KEY_ANSWER, edges, EDGE_FIELDS), EDGE_FIELDS, edge_reply, EDGE_ANSWER)
    return durable(visit(packed, sources, EDGE_ANSWER, lambda batch, known: paths(Kmers(batch, k, seed), known), SPANS))


def disproved(packed: Packed, spans: DataFrame, k: int) -> DataFrame:
    """The claims of ``spans`` whose words are not those at the source's coordinates.

    A batch that many claims name is looked at by several tasks, each with about CLAIMS_EACH of the claims, or one in HOT of all.
    """

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        wrong = []
        if left.num_rows and right.num_rows:
            words = Words(unpack(left.column("batch_id")[0].as_py(), left.column("payload")[0].as_py()))
            for c in right.select(CLAIM).to_pylist():
                if hashlib.blake2b(words.text(c["source_at"], c["windows"] + k - 1), digest_size=16).digest() != c["digest"]:
                    wrong.append(c)
        return pa.Table.from_pylist(wrong, schema=_schema(CLAIMS))

    claims = durable(spans.select(*CLAIM).distinct().withColumn("batch_id", F.col("source_batch")))
    each = max(CLAIMS_EACH, claims.count() // HOT)
    hot = F.broadcast(claims.groupBy("batch_id").agg(F.ceil(F.count(F.lit(1)) / each).alias("shares")).where("shares > 1"))  # HOT batches at most
    dealt = claims.join(hot, "batch_id", "left").withColumn("share", F.coalesce(F.pmod(F.xxhash64("digest"), F.col("shares")), F.lit(0)))
    first = packed.table.groupBy("batch_id").cogroup(dealt.where("share = 0").drop("shares", "share").groupBy("batch_id")).applyInArrow(look, CLAIMS)
    copies = packed.table.join(hot, "batch_id").select("batch_id", "payload", F.explode(F.sequence(F.lit(1), F.col("shares") - 1)).alias("share"))
    others = copies.groupBy("batch_id", "share").cogroup(dealt.where("share > 0").drop("shares").groupBy("batch_id", "share"))
    return first.unionByName(others.applyInArrow(look, CLAIMS))


def repeated_spans(packed: Packed, k: int = K) -> DataFrame:
    """Rows (batch_id, at, windows): where a document repeats a smaller one, verified at the source's coordinates.

    If hashes led to a wrong source, another document may still be the right one, so that all are asked again with
    other hashes; what was verified stays.
    """
    found = None
    for seed in range(SEEDS):
        spans = claimed_spans(packed, k, seed)
        wrong = durable(disproved(packed, spans, k))
        sound = not wrong.limit(1).count()
        right = (spans if sound else spans.join(wrong, CLAIM, "left_anti")).select("batch_id", "at", "windows")
        found = right if found is None else found.unionByName(right)
        if sound:
            return found
    raise RuntimeError(f"hashes of {SEEDS} seeds all collide")


#: How many seeds are tried, and claims that one task looks up in a batch.
SEEDS, CLAIMS_EACH = 5, 200
CLAIMS = "source_batch long, source_at int, windows int, digest binary"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text binary"


def without_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """Rows of RESULT: each document without the words that a k-word window repeated from a smaller doc_id covers.

    Kept words are joined by one space. Null texts have no words; texts shorter than k words repeat nothing. Repeated
    rows of an id do not repeat each other, for neither id is smaller; a null id is larger than all others, and so is the
    largest long, which counts as null. Copies of a whole document are removed whole. An empty table gives no rows.
    """
    packed = pack_documents(docs, doc_id=doc_id, text=text)
    spans = repeated_spans(packed, k)

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        words = Words(unpack(left.column("batch_id")[0].as_py(), left.column("payload")[0].as_py()))
        at, windows = (right.column(c).to_numpy().astype(np.int64) for c in ("at", "windows"))
        change = np.zeros(len(words.start) + 1, np.int64)
        np.add.at(change, at, 1)
        np.add.at(change, at + windows + k - 1, -1)
        gone = np.cumsum(change[:-1]) > 0
        data, out = words.batch.data.tobytes(), []
        for r in range(words.batch.rows):
            a, b = words.first[r], words.first[r + 1]
            stay = np.nonzero(~gone[a:b])[0] + a
            kept = b" ".join([data[s:e] for s, e in zip(words.start[stay].tolist(), words.end[stay].tolist(), strict=True)])
            doc = int(words.batch.ids[r])
            out.append((None if doc == LAST else doc, int(b - a), int(b - a) - len(stay), hashlib.sha256(kept).hexdigest(), kept))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in RESULT.split(", ")])

    return packed.table.groupBy("batch_id").cogroup(spans.groupBy("batch_id")).applyInArrow(apply, RESULT)


def op5_word_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept_text")
