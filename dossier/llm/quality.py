"""Quality scores by a byte-level convolutional network, trained and run in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Chunks are two blocks long and start at every block, so neighbours overlap by half.
BLOCK = 256
WIDTH, DIM, FILTERS = 6, 8, 16
#: Bounds of the training sample: labelled documents, and their bytes of text; whole documents beyond either stay out.
SAMPLE, SAMPLE_BYTES = 3000, 16_000_000
THRESHOLD = 0.3
FOLDS = 5


@dataclass
class Network:
    """emb: a vector for each byte; filters: place, vector, filter; weights of the mean and of the maximum over chunks."""

    emb: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    mean: np.ndarray
    top: np.ndarray
    base: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.emb, self.filters, self.bias, self.mean, self.top, self.base]


def _layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after the other, each zero-padded to whole blocks, and the block where each begins (and the end)."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    blocks = (sizes + WIDTH - 1 + BLOCK - 1) // BLOCK
    first = np.r_[0, np.cumsum(np.maximum(blocks, 1))]
    data = np.zeros(first[-1] * BLOCK + WIDTH, np.uint8)
    for t, b in zip(texts, first.tolist(), strict=False):
        data[b * BLOCK : b * BLOCK + len(t)] = np.frombuffer(t, np.uint8)
    return data, first


def _pair_tables(net: Network) -> list[np.ndarray]:
    """For each two neighbouring places of the filters, the responses to each pair of bytes."""
    single = np.einsum("bd,kdf->kbf", net.emb, net.filters)
    return [(single[k][:, None, :] + single[k + 1][None, :, :]).reshape(65536, FILTERS).astype(np.float32) for k in range(0, WIDTH, 2)]


def _block_maxima(data: np.ndarray, last: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """``last``: each text's last block, whose final places would reach into the next text; they see padding only."""
    blocks = int(last[-1]) + 1 if len(last) else 0
    out = np.empty((blocks, FILTERS), np.float32)
    pair = data[:-1].astype(np.int32) * 256 + data[1:]
    for at in range(0, blocks, 256):
        n = min(256, blocks - at)
        s = at * BLOCK
        response = tables[0][pair[s : s + n * BLOCK]]
        for k, table in enumerate(tables[1:], 1):
            response += table[pair[s + 2 * k : s + 2 * k + n * BLOCK]]
        response = response.reshape(n, BLOCK, FILTERS)
        response[last[np.searchsorted(last, at) : np.searchsorted(last, at + n)] - at, 1 - WIDTH :] = -np.inf
        out[at : at + n] = response.max(axis=1)
    return out


def scores(net: Network, tables: list[np.ndarray], texts: list[bytes]) -> np.ndarray:
    """Each text's probability. Every byte is in a chunk, whatever the length; an empty text is one chunk of padding."""
    data, first = _layout(texts)
    sizes, last = np.diff(first), first[1:] - 1
    blocks = _block_maxima(data, last, tables)
    chunk = np.maximum(blocks, np.r_[blocks[1:], blocks[-1:]])
    chunk[last[sizes == 1]] = blocks[last[sizes == 1]]  # a text of one block is one chunk; else the last block starts none
    counted = np.ones(len(blocks), np.float32)
    counted[last[sizes > 1]] = 0
    act = np.maximum(chunk + net.bias, 0) * counted[:, None]
    mean = np.add.reduceat(act.astype(np.float64), first[:-1], axis=0) / np.maximum(sizes - 1, 1)[:, None]
    top = np.maximum.reduceat(act, first[:-1], axis=0)
    return 1 / (1 + np.exp(-np.clip(mean @ net.mean + top @ net.top + net.base, -50, 50)))


def chunks_of(text: bytes) -> list[bytes]:
    """All chunks of the text."""
    data, first = _layout([text])
    return [data[i * BLOCK : (i + 2) * BLOCK + WIDTH].tobytes().ljust(2 * BLOCK + WIDTH, b"\0") for i in range(max(1, int(first[1]) - 1))]


def train(texts: list[bytes], labels: list[int], *, steps: int = 500, batch: int = 48, rate: float = 0.01, seed: int = 3) -> Network:
    """Fit by Adam on the mean logistic loss, in so many steps or up to the end of the pass. One class only: a constant."""
    rng = np.random.default_rng(seed)
    share = (sum(labels) + 1) / (len(labels) + 2)
    net = Network(rng.normal(0, 0.5, (256, DIM)), rng.normal(0, 0.3, (WIDTH, DIM, FILTERS)), np.zeros(FILTERS), np.zeros(FILTERS), np.zeros(FILTERS), np.array(np.log(share / (1 - share))))
    if len(set(labels)) < 2:
        return net
    net.mean, net.top = rng.normal(0, 0.1, FILTERS), rng.normal(0, 0.1, FILTERS)
    order, y = np.arange(len(texts)), np.array(labels, float)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    step, span = 0, 2 * BLOCK
    while step < steps:
        rng.shuffle(order)
        for s in range(0, len(order), batch):
            docs = order[s : s + batch]
            samples = [chunks_of(texts[d]) for d in docs]
            owner = np.repeat(np.arange(len(docs)), [len(c) for c in samples])
            x = np.frombuffer(b"".join(c for s in samples for c in s), np.uint8).reshape(len(owner), -1)
            single = np.einsum("bd,kdf->kbf", net.emb, net.filters).astype(np.float32)
            at, z = np.empty((len(x), FILTERS), np.int64), np.empty((len(x), FILTERS), np.float32)
            for c in range(0, len(x), 256):  # few chunks at a time, however long a document is
                response = single[0][x[c : c + 256, :span]]
                for k in range(1, WIDTH):
                    response += single[k][x[c : c + 256, k : k + span]]
                at[c : c + 256] = response.argmax(axis=1)
                z[c : c + 256] = np.take_along_axis(response, at[c : c + 256, None, :], axis=1)[:, 0]
            z = z + net.bias
            act = np.maximum(z, 0)
            starts = np.searchsorted(owner, np.arange(len(docs)))
            size = np.diff(np.r_[starts, len(owner)])[:, None]
            mean, top = np.add.reduceat(act, starts, axis=0) / size, np.maximum.reduceat(act, starts, axis=0)
            p = 1 / (1 + np.exp(-np.clip(mean @ net.mean + top @ net.top + net.base, -50, 50)))
            d = (p - y[docs]) / len(docs)
            is_top = act == top[owner]
            d_act = d[owner][:, None] * (net.mean / size[owner] + net.top * is_top / np.maximum(1, np.add.reduceat(is_top, starts, axis=0, dtype=int))[owner])
            d_z = d_act * (z > 0)
            seen = x[np.arange(len(x))[:, None, None], at[:, :, None] + np.arange(WIDTH)]  # chunk, filter, place
            d_emb, vectors = np.zeros_like(net.emb), net.emb[seen]
            np.add.at(d_emb, seen, d_z[:, :, None, None] * net.filters.transpose(2, 0, 1)[None])
            grads = [d_emb, np.einsum("cf,cfkd->kdf", d_z, vectors), d_z.sum(0), d @ mean, d @ top, d.sum()]
            step += 1
            for param, grad, (m, v) in zip(net.parameters(), grads, state, strict=True):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                param -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def held_out(doc_id: str | Column) -> Column:
    return F.coalesce(F.crc32(F.coalesce(F.col(doc_id) if isinstance(doc_id, str) else doc_id, F.lit(0)).cast("string")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Network:
    """Train on at most ``sample`` labelled documents outside the held-out fold, the first by a digest of their ids whose
    whole texts fit: one that would bring their sum above ``sample_bytes`` is passed over, and those after it are not.

    Lengths are looked at first, of four times as many documents as are wanted; only the texts that are taken are
    fetched, and only they reach the driver. A document with several labels takes the least, and an id with several
    texts the least text of the shortest; null labels and ids are left out. Without any labelled document the network is
    a constant.
    """
    known = labels.where(labels[label].isNotNull() & labels[doc_id].isNotNull()).groupBy(labels[doc_id].alias("__id")).agg(F.min(labels[label]).cast("int").alias("__label"))
    digest = F.md5(F.col("__id").cast("string"))
    rows = docs.select(docs[doc_id].alias("__id"), F.coalesce(docs[text].cast("binary"), F.lit(b"")).alias("__text"))
    sizes = rows.select("__id", F.octet_length("__text").alias("__size")).join(known.where(~held_out("__id")), "__id").groupBy("__id", "__label").agg(F.min("__size").alias("__size"))
    first = sizes.orderBy(digest, "__id").limit(4 * sample).collect()
    taken, total = {}, 0
    for r in first:
        if len(taken) < sample and total + r["__size"] <= sample_bytes:
            taken[r["__id"]], total = r["__label"], total + r["__size"]
    if not taken:
        return train([], [])
    ids = docs.sparkSession.createDataFrame([(r["__id"], r["__size"]) for r in first if r["__id"] in taken], sizes.select("__id", "__size").schema)
    chosen = rows.withColumn("__size", F.octet_length("__text")).join(F.broadcast(ids), ["__id", "__size"]).groupBy("__id").agg(F.min("__text").alias("__text"))  # at most ``sample`` rows
    got = sorted(chosen.collect(), key=lambda r: r["__id"])
    return train([bytes(r["__text"]) for r in got], [taken[r["__id"]] for r in got])


def score_documents(docs: DataFrame, net: Network, *, keep: list[str], text: str = "text", out: str = "score") -> DataFrame:
    """The columns ``keep`` and ``out``, which is not among them: the probability that the text has label 1."""

    def scan(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _pair_tables(net)
        for block in blocks:
            texts = [t or b"" for t in block.columns[-1].to_pylist()]
            found, start, size = [], 0, 0
            for i, t in enumerate(texts):
                size += len(t) + BLOCK
                if size >= 1 << 21 or i == len(texts) - 1:
                    found.append(scores(net, tables, texts[start : i + 1]))
                    start, size = i + 1, 0
            rest = block.columns[:-1]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(np.concatenate(found) if found else np.zeros(0))], names=[*keep, out])

    name = "__text"
    while name in keep:
        name += "_"
    rows = docs.select(*(docs[c] for c in keep), docs[text].cast("binary").alias(name))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(scan, f"{schema}, `{out}` double")


def keep_good(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with their columns, that score ``threshold`` or more."""
    net = fit(docs, labels, text=text, **options)
    out = "score"
    while out in docs.columns:
        out += "_"
    return score_documents(docs, net, keep=docs.columns, text=text, out=out).where(F.col(out) >= threshold).drop(out)


def op6_byte_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_documents(docs, net, keep=["doc_id"])
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
