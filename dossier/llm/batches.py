"""Documents packed into batches of a few MB, and exchanges between batches by hash parts.

A batch pre-aggregates: whatever many of its documents share, it asks about once and is answered once. So a passage
that a third of all documents hold costs one entry a batch, not one a document, wherever entries meet.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.durable import durable

#: Bytes of text in a batch (a longer text is a batch of its own), and bytes of input text for a part.
BATCH_BYTES = 2_000_000
PART_BYTES = 12 << 20
#: Bytes of text that a task holds, batch by batch.
TASK_BYTES = 8 << 20
LAST = np.iinfo(np.int64).max


@dataclass
class Batch:
    """ids: doc ids, LAST for null. data: all texts' UTF-8 bytes, one after the other; starts: where each begins, and the end."""

    batch_id: int
    ids: np.ndarray
    data: np.ndarray
    starts: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.ids)


def _pack(ids: list, texts: list[bytes]) -> bytes:
    block = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.large_binary())], names=["id", "text"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, block.schema) as out:
        out.write_batch(block)
    return zstandard.compress(sink.getvalue(), 3)


def unpack(batch_id: int, payload: bytes) -> Batch:
    block = pa.ipc.open_stream(zstandard.decompress(payload)).read_all().combine_chunks()
    texts = block.column("text").combine_chunks()
    _, offsets, values = texts.buffers()
    starts = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    return Batch(batch_id, block.column("id").to_numpy(), data[starts[0] : starts[-1]], starts - starts[0])


@dataclass
class Packed:
    """table: rows (batch_id, payload), dealt by batch_id and kept; parts: into how many parts hashes are dealt; tasks:
    how many tasks an exchange takes, so that a task's share does not grow with the input."""

    table: DataFrame
    parts: int
    tasks: int


def pack_documents(docs: DataFrame, *, doc_id: str, text: str, part_bytes: int = PART_BYTES, total: int | None = None) -> Packed:
    """Null texts are packed as empty ones. ``total``: about how many bytes all texts have, if that is known."""

    def pack(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size, made = [], [], 0, 0
        task = TaskContext.get().partitionId() << 32

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([task + made], pa.int64()), pa.array([_pack(ids, texts)], pa.binary())], names=["batch_id", "payload"])

        for block in blocks:
            for i, t in zip(block.column("id").to_pylist(), block.column("text").to_pylist(), strict=True):
                ids.append(LAST if i is None else i)
                texts.append(t or b"")
                size += len(texts[-1])
                if size >= BATCH_BYTES:
                    yield row()
                    ids, texts, size, made = [], [], 0, made + 1
        if ids:
            yield row()

    rows = docs.select(docs[doc_id].cast("long").alias("id"), docs[text].cast("binary").alias("text"))
    if total is None:
        total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    packed = rows.mapInArrow(pack, "batch_id long, payload binary")
    tasks = max(1, math.ceil(total / TASK_BYTES))
    return Packed(_kept_as_dealt(packed.repartition(tasks, "batch_id")), max(1, math.ceil(total / part_bytes)), tasks)


def _kept_as_dealt(df: DataFrame) -> DataFrame:
    """A checkpoint that still knows how its rows are dealt, so that later meetings by that key move the other side
    only. An adaptive plan does not tell its partitioning, hence a fixed one here."""
    conf, name = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return durable(df.select("*"))
    finally:
        conf.set(name, before)


def planes(values: np.ndarray) -> bytes:
    """Sorted or small integers as byte planes, which the shuffle's compression shrinks well."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def unplanes(blob: bytes, dtype: type) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(width, -1).T).view(dtype).ravel()


#: Cells of fewer bytes are not compressed.
SMALL_CELL = 128


def cell(values: np.ndarray) -> bytes:
    """Integers for an exchange: sorted ones as the steps between them, byte planes compressed with the frequencies of
    their bytes, which the shuffle's own compression does not use. The first byte says which."""
    rising = len(values) > 1 and bool((values[1:] >= values[:-1]).all())
    data = planes(np.diff(values, prepend=values.dtype.type(0)) if rising else np.ascontiguousarray(values))
    small = len(data) < SMALL_CELL
    return bytes([rising | small << 1]) + (data if small else zstandard.compress(data, 1))


def uncell(blob: bytes, dtype: type) -> np.ndarray:
    values = unplanes(blob[1:] if blob[0] & 2 else zstandard.decompress(blob[1:]), dtype)
    return np.cumsum(values, dtype=dtype) if blob[0] & 1 else values


Columns = dict[str, np.ndarray]


def _split(keys: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Each key and the places that have it, in order."""
    order = np.argsort(keys, kind="stable")
    cuts = np.nonzero(np.r_[True, keys[order][1:] != keys[order][:-1]])[0] if len(keys) else np.zeros(0, int)
    return [(int(keys[order[s]]), order[s:e]) for s, e in zip(cuts, [*cuts[1:], len(keys)], strict=False)]


def gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of many ranges, one after the other."""
    to = np.cumsum(size)
    return data[np.arange(to[-1] if len(to) else 0) + np.repeat(start - (to - size), size)]


def _read(table: pa.Table, i: int, fields: dict[str, type]) -> Columns:
    """Columns of a row; what a row has not is empty."""
    cells = {n: table.column(n)[i].as_py() for n in fields}
    return {n: uncell(cells[n], t) if cells[n] is not None else np.zeros(0, t) for n, t in fields.items()}


def _row(columns: Columns, at: np.ndarray) -> list[bytes]:
    return [cell(c[at]) for c in columns.values()]


def _table(names: list[str], rows: list[list], numbers: int) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.Table.from_arrays([pa.array(c, pa.int64() if i < numbers else pa.binary()) for i, c in enumerate(columns)], names=names)


def ask(packed: Packed, answers: DataFrame | None, answer_fields: dict[str, type], question: Callable[[Batch, Columns], tuple], fields: dict[str, type], bytes_column: str | None = None) -> DataFrame:
    """Rows (dealt_to, batch_id, fields): what each batch has to ask of each part.

    ``question`` gives part numbers and columns, and with a bytes_column also data, starts and sizes of byte ranges.
    """
    names = ["dealt_to", "batch_id", *fields, *([bytes_column] if bytes_column else [])]
    schema = "dealt_to long, batch_id long, " + ", ".join(f"{n} binary" for n in names[2:])

    def one(batch_id: int, payload: bytes, known: Columns) -> pa.Table:
        parts, columns, *ranges = question(unpack(batch_id, payload), known)
        rows = []
        for part, at in _split(parts):
            rows.append([part, batch_id, *_row(columns, at)])
            rows[-1] += [zstandard.compress(gather(d, s[at], z[at]).tobytes(), 3) for d, s, z in ranges]
        return _table(names, rows, 2)

    return _with_answers(packed, answers, answer_fields, one, schema)


def answer(packed: Packed, questions: DataFrame, fields: dict[str, type], reply: Callable[..., tuple[np.ndarray, Columns]], answer_fields: dict[str, type], bytes_column: str | None = None) -> DataFrame:
    """Rows (batch_id, answer_fields): ``reply`` sees all entries of a part with their batch, and says which batch gets
    what. It also sees as ``entry`` the place of each among those of its batch, by which the batch knows it again."""
    names = ["batch_id", *answer_fields]

    def one(table: pa.Table) -> pa.Table:
        rows = [_read(table, i, fields) for i in range(table.num_rows)]
        sizes = [len(r[next(iter(fields))]) for r in rows]
        batch = np.repeat(table.column("batch_id").to_numpy(), sizes)
        texts = [np.frombuffer(b"".join(map(zstandard.decompress, table.column(bytes_column).to_pylist())), np.uint8)] if bytes_column else []
        entry = np.concatenate([np.arange(n, dtype=np.uint32) for n in sizes])
        keys, columns = reply(batch, {n: np.concatenate([r[n] for r in rows]) for n in fields} | {"entry": entry}, *texts)
        return _table(names, [[b, *_row(columns, at)] for b, at in _split(keys)], 1)

    return questions.repartition(packed.tasks, "dealt_to").groupBy("dealt_to").applyInArrow(one, "batch_id long, " + ", ".join(f"`{n}` binary" for n in answer_fields))


def visit(packed: Packed, answers: DataFrame | None, answer_fields: dict[str, type], work: Callable[[Batch, Columns], pa.Table], schema: str) -> DataFrame:
    """Rows that ``work`` makes of each batch and of what the batch was answered."""
    return _with_answers(packed, answers, answer_fields, lambda b, p, known: work(unpack(b, p), known), schema)


def _with_answers(packed: Packed, answers: DataFrame | None, fields: dict[str, type], one: Callable, schema: str) -> DataFrame:
    if answers is None:

        def scan(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in blocks:
                for b, p in zip(block.column("batch_id").to_pylist(), block.column("payload").to_pylist(), strict=True):
                    yield from one(b, p, {}).to_batches()

        return packed.table.mapInArrow(scan, schema)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = [_read(right, i, fields) for i in range(right.num_rows)]
        known = {n: np.concatenate([r[n] for r in rows]) if rows else np.zeros(0, t) for n, t in fields.items()}
        return one(left.column("batch_id")[0].as_py(), left.column("payload")[0].as_py(), known)

    return packed.table.groupBy("batch_id").cogroup(answers.groupBy("batch_id")).applyInArrow(meet, schema)
