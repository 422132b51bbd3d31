"""Commits of tables: whole or not at all, and only on the state that they were prepared on."""

import hashlib

import pytest

from dossier.sources import versions
from dossier.sources.versions import Refused, last_commit, read_table, write_documents

SCHEMA = "document_id string, source_key string, chunk_order int, text string, content_hash string"


def chunks(spark, **texts):
    rows = [(d, f"pdf_{d}", i, t, hashlib.md5(t.encode()).hexdigest()) for d, ts in texts.items() for i, t in enumerate(ts.split("|"), 1)]
    return spark.createDataFrame(rows, SCHEMA)


def state(spark, table, number=None):
    out = {}
    for r in sorted(read_table(spark, table, SCHEMA, number).collect()):
        out.setdefault(r.document_id, []).append(r.text)
    return {d: "|".join(ts) for d, ts in out.items()}


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "chunks")
    assert last_commit(spark, path) == -1 and state(spark, path) == {}
    assert write_documents(spark, path, chunks(spark, a="a1|a2", b="b1", c="c1|c2|c3"), -1, replaces=False) == 0
    return path


def documents(spark, **status):
    return spark.createDataFrame([(d, f"pdf_{d}", s) for d, s in status.items()], "document_id string, source_key string, status string")


def test_a_commit_replaces_its_documents_only_and_older_states_stay(spark, table):
    assert write_documents(spark, table, chunks(spark, b="new1|new2", d="d1"), 0) == 1
    assert state(spark, table) == {"a": "a1|a2", "b": "new1|new2", "c": "c1|c2|c3", "d": "d1"}
    assert state(spark, table, 0) == {"a": "a1|a2", "b": "b1", "c": "c1|c2|c3"}


def test_a_concurrent_change_makes_the_commit_fail_and_nothing_is_lost(spark, table, monkeypatch):
    write_documents(spark, table, chunks(spark, a="first"), 0)
    with pytest.raises(Refused, match="changed_meanwhile"):
        write_documents(spark, table, chunks(spark, a="second"), 0)
    monkeypatch.setattr(versions, "last_commit", lambda *_: 0)  # the other writer comes after the last look
    with pytest.raises(Refused, match="changed_meanwhile"):
        write_documents(spark, table, chunks(spark, b="second"), 0)
    monkeypatch.undo()
    assert last_commit(spark, table) == 1 and state(spark, table) == {"a": "first", "b": "b1", "c": "c1|c2|c3"}


def test_counts_are_checked_before_the_commit(spark, table):
    for rows, replaces, why in ((chunks(spark, z="x"), True, "nothing_to_replace"), (chunks(spark, a="x"), False, "exists"), (spark.createDataFrame([(None, "s", 1, "t", "h")], SCHEMA), None, "no_document")):
        with pytest.raises(Refused, match=why):
            write_documents(spark, table, rows, 0, replaces=replaces)
    assert last_commit(spark, table) == 0


def test_pending_documents_only(spark, table):
    docs = documents(spark, a=versions.PENDING, b=versions.APPROVED)
    with pytest.raises(Refused, match="status: 1, unknown_document: 1"):
        versions.replace_in_status(spark, table, chunks(spark, a="x", b="x", c="x"), docs, 0)
    assert versions.replace_in_status(spark, table, chunks(spark, a="x|y"), docs, 0) == 1
    assert state(spark, table)["a"] == "x|y"


def test_gate_backup_and_restore(spark, table, tmp_path):
    docs = documents(spark, a=versions.APPROVED, b=versions.APPROVED, c=versions.APPROVED)
    judged = spark.createDataFrame([("a", True), ("b", False)], "document_id string, passes boolean")
    seen = lambda rows, key="pdf_a": spark.createDataFrame([("a", rows, versions.APPROVED, key), ("b", 1, versions.APPROVED, "pdf_b")], "document_id string, rows long, status string, source_key string")
    kept = str(tmp_path / "backup")
    for rows, evaluated, why in ((chunks(spark, a="x", b="x"), seen(2), "gate: 1"), (chunks(spark, a="x"), seen(3), "rows_changed: 1"), (chunks(spark, a="x"), seen(2, "pdf_z"), "source_key_changed: 1"), (chunks(spark, c="x"), seen(2), "gate: 1, not_evaluated: 1")):
        with pytest.raises(Refused, match=why):
            versions.replace_behind_gate(spark, table, rows, judged, evaluated, docs, 0, kept)
    assert versions.replace_behind_gate(spark, table, chunks(spark, a="worse"), judged, seen(2), docs, 0, kept) == 1
    assert state(spark, table)["a"] == "worse"
    with pytest.raises(Refused, match="identity: 1"):
        versions.restore_documents(spark, table, kept, SCHEMA, docs.replace("pdf_a", "pdf_other"), ["source_key"], 1)
    assert versions.restore_documents(spark, table, kept, SCHEMA, docs, ["source_key"], 1) == 2
    assert state(spark, table) == state(spark, table, 0)
