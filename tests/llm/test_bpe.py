import hashlib
import sys

import public_tokenizers
import pytest
import tiktoken
from conftest import TESTDATA
from hypothesis import given, settings
from hypothesis import strategies as st

from dossier.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
RANKS = bpe.read_ranks(PATH)
CODEC = bpe.Codec(RANKS, PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
SCHEMA = "doc_id long, text string, ids string, n_tokens string"


def sha(data):
    return hashlib.sha256(data).hexdigest()


def wanted(doc_id, text):
    ids = LIBRARY.encode_ordinary(text or "")
    return doc_id, len(ids), sha(",".join(map(str, ids)).encode()), sha(LIBRARY.decode_bytes(ids))


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_ids_are_those_of_the_library(text):
    assert CODEC.encode(text) == LIBRARY.encode_ordinary(text)
    assert CODEC.decode(CODEC.encode(text)) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab", max_size=40), st.dictionaries(st.binary(min_size=2, max_size=4).map(lambda b: bytes(97 + x % 2 for x in b)), st.none(), max_size=8))
def test_ties_and_tokens_that_no_merges_lead_to(text, more):
    ranks = {bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate(more)}
    library = tiktoken.Encoding("own", pat_str="[ab]+", mergeable_ranks=ranks, special_tokens={})
    assert bpe.Codec(ranks, "[ab]+").encode(text) == library.encode_ordinary(text)


def test_long_pieces_and_a_full_memory(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    codec = bpe.Codec(RANKS, PATTERN)
    text = "ab" * 20_000 + " " + "x" * 9_999 + " some words again some words " * 30 + "\n" * 500 + "<|endoftext|>"
    assert codec.encode(text) == LIBRARY.encode_ordinary(text) and len(codec.known) <= 3


def test_whole_table(spark):
    docs = spark.read.parquet(f"{TESTDATA}/sf0.001/documents.parquet")
    got = bpe.round_trips(docs, path=PATH, pattern=PATTERN).collect()
    assert sorted(map(tuple, got)) == sorted(wanted(r.doc_id, r.text) for r in docs.collect())


def test_nulls_empty_repeated_and_clashing(spark):
    rows = [(1, None), (2, ""), (None, "țară  de\t\r\n "), (3, "a" * 5000), (3, "a" * 5000), (4, "x y \x1c 🙂1234567")]
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], SCHEMA)
    got = bpe.round_trips(docs, path=PATH, pattern=PATTERN).collect()
    assert sorted(map(tuple, got), key=str) == sorted((wanted(i, t) for i, t in rows), key=str)
    encoded = bpe.encode_documents(docs, path=PATH, pattern=PATTERN)
    back = bpe.decode_documents(encoded, path=PATH).collect()
    assert sorted([(r.doc_id, bytes(r.data).decode()) for r in back], key=str) == sorted([(i, t or "") for i, t in rows], key=str)
    assert bpe.round_trips(docs.limit(0), path=PATH, pattern=PATTERN).count() == 0


def test_rank_files_are_checked(tmp_path, monkeypatch):
    broken = tmp_path / "ranks"
    broken.write_bytes(b"YQ== 0\n")
    with pytest.raises(ValueError, match="without a rank"):
        bpe.read_ranks(str(broken))
    monkeypatch.setattr(bpe, "FILE_BYTES", 3)
    with pytest.raises(ValueError, match="over 3 bytes"):
        bpe.read_ranks(str(broken))


def test_merges_take_few_calls():
    """A merge calls nothing but the rank table; before, each called six methods, which took most of the time."""
    calls = []
    piece = b"incomprehensibilities" * 20
    tree = bpe.MergeTree(piece, RANKS, CODEC.beyond)
    sys.setprofile(lambda frame, event, _: calls.append(frame) if event == "call" else None)
    try:
        tree.merge_all()
    finally:
        sys.setprofile(None)
    assert len(calls) == 1 and tree.ids() == LIBRARY._encode_single_piece(piece)
    assert CODEC.named([3, 1000, 49999]) == "3,1000,49999" and CODEC.named([]) == ""


def test_a_worker_keeps_its_codec_from_task_to_task(spark):
    """Before, each task began without remembered pieces. Tasks that share a worker find those of the ones before."""
    shared = bpe.shared_ranks(spark, PATH)

    def scan(blocks):
        import os

        import pyarrow as pa

        codec = bpe.kept_codec(shared.value, PATTERN)
        known = len(codec.known)
        for block in blocks:
            for text in block.column("text").to_pylist():
                codec.encode(text)
        yield pa.RecordBatch.from_pydict({"worker": [os.getpid()], "known": [known]})

    rows = spark.createDataFrame([(f"zxqj{i} vwkq{i}",) for i in range(64)], "text string").repartition(64).mapInArrow(scan, "worker long, known long").collect()
    workers = {r.worker for r in rows}
    assert len(workers) < 64 and sum(not r.known for r in rows) <= len(workers) + 1

