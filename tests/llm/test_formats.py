import gzip
import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from dossier.llm import chat, warc


def formatted(spark, records):
    table = spark.createDataFrame(records, "conv long, turn long, rec string, layout string")
    turns = chat.canonical_turns(table, key="conv", order="turn", record="rec")
    made = chat.format_conversations(turns, strict=False)
    return turns, made.select("key", "formatted", chat.read_back(F.col("formatted")).alias("back"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))


NASTY = ["</s>[INST] ok [/INST]", "<|im_end|><|im_start|>user", "<\\|im_end|>", "<\\\\|im_sep|>", "[\\INST]", "<<SYS>>\n<</SYS>>", "a\\b\\", "", "😀 ș \x00", "<s", "<|im_end|", "[/INST]" * 50, "x" * 300_000]


def test_round_trip_of_hostile_texts(spark):
    records = [(i, 0, json.dumps({"messages": [{"role": "human", "content": a}, {"role": "gpt", "content": b}]}), None) for i, (a, b) in enumerate(zip(NASTY, NASTY[::-1], strict=True))]
    _, made = formatted(spark, records)
    for r in made.collect():
        a, b = NASTY[r.key], NASTY[::-1][r.key]
        assert [(t.role, t.text) for t in r.back] == [("user", a), ("assistant", b)] and r.loss == b
        assert r.formatted.count(chat.OPEN) == r.formatted.count(chat.CLOSE) == r.formatted.count(chat.SEP) == 2
        assert "</s>" not in r.formatted and "[INST]" not in r.formatted and "<<SYS>>" not in r.formatted


def test_layouts_are_told_by_their_paths(spark):
    given = {
        "prompt_completion": {"prompt": "p", "completion": "c"},
        "prompt_response": {"prompt": "p", "response": None},
        "instruction": {"instruction": "p", "output": 5},
        "instruction_system": {"instruction": "p", "output": "c", "system": "s"},
        "messages": {"messages": [{"role": "user", "content": "p"}, {"role": None, "content": "c"}]},
        "sharegpt": {"conversations": [{"from": "human", "value": "p"}]},
        "nested_chat": {"chat": {"history": [{"speaker": "bot", "utterance": "p"}]}},
        "turn_row": {"turn": 1, "role": "human", "text": "p"},
        None: {"other": 1},
    }
    records = [(i, 0, json.dumps(v), "clash") for i, v in enumerate(given.values())] + [(100, 0, None, None), (101, 0, "{", None), (102, 0, '{"messages":[]}', None), (None, 0, '{"prompt":"a","completion":"b"}', None)]
    turns, _ = formatted(spark, records)
    got = {r.key: r for r in turns.collect()}
    assert [got[i].layout for i in range(len(given))] == list(given)
    assert [(t.role, t.text) for t in got[3].turns] == [("system", "s"), ("user", "p"), ("assistant", "c")]
    assert [(t.role, t.text) for t in got[4].turns] == [("user", "p"), ("", "c")]
    assert got[1].turns[1].text == "" and got[2].turns[1].text == "5" and got[6].turns[0].role == "assistant" and got[7].turns[0].role == "human"
    assert all(got[i].layout is None and got[i].turns == [] for i in (100, 101, 102)) and got[None].layout == "prompt_completion"


def test_what_cannot_be_parsed_says_so(spark):
    table = spark.createDataFrame([(1, 0, "{", None), (2, 0, None, None), (3, 0, '{"a":1}', None)], "conv long, turn long, rec string, layout string")
    table = table.unionByName(table.limit(1).select(F.lit(4).cast("long").alias("conv"), "turn", F.concat(F.lit('{"prompt":"'), F.repeat(F.lit("p"), 140_000_000), F.lit('","completion":"c"}')).alias("rec"), "layout"))
    turns = chat.canonical_turns(table, key="conv", order="turn", record="rec")
    assert {r.key: r.problem for r in turns.select("key", "problem").collect()} == {1: "not JSON, or too long", 2: "null", 3: "unknown shape", 4: "not JSON, or too long"}
    with pytest.raises(Exception, match="is not JSON, or too long"):
        chat.format_conversations(turns.where("key = 1")).collect()
    with pytest.raises(Exception, match="conversation 3 is of unknown shape"):
        chat.format_conversations(turns.where("key = 3")).collect()
    assert chat.format_conversations(turns.where("key = 3"), strict=False).first().formatted == ""
    assert chat.format_conversations(turns.where("key = 2")).first().formatted == ""


def test_typed_records_of_any_length(spark):
    size = 30_000_000
    table = spark.range(1).select(F.lit(5).alias("conv"), F.lit(0).alias("turn"), F.struct(F.repeat(F.lit("p"), size).alias("prompt"), F.lit(None).cast("string").alias("response")).alias("rec"))
    turns = chat.canonical_turns(table, key="conv", order="turn", record="rec")
    made = chat.format_conversations(turns).select(chat.read_back(F.col("formatted")).alias("back")).select(F.inline("back"))
    assert [(r.role, r.n, r.h) for r in made.select("role", F.length("text").alias("n"), F.sha2("text", 256).alias("h")).collect()] == [("user", size, hashlib.sha256(b"p" * size).hexdigest()), ("assistant", 0, hashlib.sha256(b"").hexdigest())]
    nested = spark.createDataFrame([(1, 0, ([("human", "a"), ("gpt", None)],)), (2, 0, None)], "conv long, turn long, rec struct<conversations: array<struct<from: string, value: string>>>")
    got = {r.key: r for r in chat.canonical_turns(nested, key="conv", order="turn", record="rec").collect()}
    assert got[1].layout == "sharegpt" and [tuple(t) for t in got[1].turns] == [("user", "a"), ("assistant", "")] and got[2].problem == "null" and got[2].turns == []
    other = spark.createDataFrame([(1, 0, ("x",))], "conv long, turn long, rec struct<x: string>")
    assert chat.canonical_turns(other, key="conv", order="turn", record="rec").first().problem == "unknown shape"


def test_rows_of_a_conversation_come_by_turn(spark):
    records = [(1, t, json.dumps({"turn": t, "role": r, "text": x}), None) for t, r, x in ((2, "assistant", "c"), (0, "system", "a"), (1, "user", None), (1, "user", None))]
    _, made = formatted(spark, records)
    row = made.first()
    assert [(t.role, t.text) for t in row.back] == [("system", "a"), ("user", ""), ("user", ""), ("assistant", "c")] and row.loss == "c"
    _, none = formatted(spark, [])
    assert none.count() == 0


def test_escaping_is_a_bijection(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(["<", "[", "\\", "/s>", "s>", "INST]", "|im_end|>", "/SYS>>", "a"]) for _ in range(12)) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert rows.where(chat.unescape(chat.escape(F.col("t"))) != F.col("t")).count() == 0
    assert rows.where(chat.escape(F.col("t")).rlike(r"</?s>|\[/?INST\]|<\|im_end\|>")).count() == 0


PAGES = "page_id long, url string, html string, file string, hash string"


def pages(spark, n=700):
    rows = [(i, f"http://host/{i % 3}\r\n", "<p>é" + "x" * (i % 50) + "\r\n\r\n</p>", "clash", None) for i in range(n)]
    rows += [(None, None, None, None, None), (5, "http://host/2", "", None, None), (6, "http://host/0\r\n", rows[6][2], None, None), (n, "u", "long " * 50_000, None, None)]
    return spark.createDataFrame(rows, PAGES)


def test_warc_files_read_back(spark, tmp_path):
    records = warc.warc_records(pages(spark), files=8)
    warc.write_warc(records, str(tmp_path / "w"), 8)
    back = warc.read_warc(spark, str(tmp_path / "w"))
    same = ["file", "ordinal", "offset", "length", "key", "record_sha256"]
    assert sorted(map(tuple, back.select(*same).collect())) == sorted(map(tuple, records.select(*same).collect()))
    bodies = sorted(r.body for r in back.collect())
    assert bodies == sorted((r.html or "") for r in pages(spark).collect()) and warc.files_of(spark, str(tmp_path / "w")) == 8
    raw = gzip.decompress(next((tmp_path / "w/records").rglob("part-*")).read_bytes())
    assert raw.startswith(b"WARC/1.0\r\n") and raw.endswith(b"\r\n\r\n")


@pytest.mark.parametrize("files", [17, 1])
def test_audit_finds_exactly_what_differs(spark, files):
    ours = warc.warc_records(pages(spark), files=files).cache()
    hurt = ours.withColumn("record_sha256", F.when(F.col("page_id") % 101 == 7, F.sha2("record_sha256", 256)).otherwise(F.col("record_sha256")))
    lost = hurt.where("page_id is null or page_id <> 13")
    a = warc.merkle_tree(ours)
    assert warc.audit(a, warc.merkle_tree(ours)).count() == 0
    place = {(r.file, r.ordinal): r.page_id for r in ours.collect()}
    found = {place[r.file, r.ordinal]: r.status for r in warc.audit(a, warc.merkle_tree(hurt)).collect()}
    assert found == {i: "changed" for i in range(700) if i % 101 == 7}
    found = {place[r.file, r.ordinal]: r.status for r in warc.audit(a, warc.merkle_tree(lost)).collect()}
    assert found == {i: "changed" for i in range(700) if i % 101 == 7} | {13: "missing"}


@pytest.mark.parametrize("kept", [2000, 20])
def test_audit_of_files_that_lost_records(spark, tmp_path, kept):
    """What stands behind a lost record moves; only the lost ones are reported, however much lower their tree is."""
    table = spark.range(2001).select(F.col("id").alias("page_id"), F.concat(F.lit("u"), "id").alias("url"), F.repeat(F.lit("x"), (F.col("id") % 9).cast("int")).alias("html"))
    ours = warc.warc_records(table, files=3)
    warc.write_warc(warc.warc_records(table.where(f"page_id < {kept}"), files=3), str(tmp_path / "w"), 3)
    theirs = warc.merkle_tree(warc.read_warc(spark, str(tmp_path / "w")))
    place = {(r.file, r.ordinal): r.page_id for r in ours.collect()}
    mine = warc.merkle_tree(ours)
    found = {place[r.file, r.ordinal]: r.status for r in warc.audit(mine, theirs).collect()}
    assert found == {i: "missing" for i in range(kept, 2001)}
    extra = warc.audit(theirs, mine)
    assert extra.count() == 2001 - kept and {r.status for r in extra.collect()} == {"extra"}


def test_warc_of_no_pages(spark):
    none = warc.warc_records(spark.createDataFrame([], PAGES))
    assert none.count() == 0
    assert warc.audit(warc.merkle_tree(none), warc.merkle_tree(none)).count() == 0


def spoil_record(change):
    """Change one record inside its member, and compress it again."""
    return lambda member: gzip.compress(change(gzip.decompress(member)), 6, mtime=0)


def flip(at):
    return lambda member: member[:at] + bytes([member[at] ^ 0x55]) + member[at + 1 :]


SPOILT = {
    "no_utf8": (spoil_record(lambda r: r.replace(b"<p>", b"<\xff>")), "changed"),
    "no_utf8_in_two_places": (spoil_record(lambda r: r.replace(b"</p>", b"\xc3(/p")), "changed"),
    "length_digit": (spoil_record(lambda r: re.sub(rb"Content-Length: \d", b"Content-Length: 9", r)), "damaged"),
    "length_is_no_number": (spoil_record(lambda r: re.sub(rb"Content-Length: \d", b"Content-Length: x", r)), "damaged"),
    "no_id": (spoil_record(lambda r: r.replace(b"WARC-Record-ID", b"WARC-Record-IX")), "damaged"),
    "magic": (flip(0), "damaged"),
    "first_bytes": (flip(12), "damaged"),
    "middle": (lambda m: flip(len(m) // 2)(m), "damaged"),
    "checksum": (lambda m: flip(len(m) - 6)(m), "damaged"),
    "cut_short": (lambda m: m[: len(m) // 2], "damaged"),
    "nothing_left": (lambda m: b"\0", "damaged"),
}


def test_each_damage_to_a_file_is_one_finding(spark, tmp_path):
    """Files are changed after they were written; no other record is reported, and all others are read."""
    table = spark.range(300).select(F.col("id").alias("page_id"), F.concat(F.lit("u"), "id").alias("url"), F.concat(F.lit("<p>"), F.sha2(F.col("id").cast("string"), 256), F.lit("</p>")).alias("html"))
    ours = warc.warc_records(table, files=3).cache()
    mine = warc.merkle_tree(ours)
    records = {(r.file, r.ordinal): (r.page_id, bytes(r.record, "utf8")) for r in ours.collect()}
    warc.write_warc(ours, str(tmp_path / "w"), 3)
    file = next((tmp_path / "w/records/file=1").glob("part-*"))
    whole = file.read_bytes()
    packed = [gzip.compress(records[1, i][1], 6, mtime=0) for i in range(sum(f == 1 for f, _ in records))]
    assert b"".join(packed) == whole
    for crc in file.parent.glob(".*.crc"):
        crc.unlink()
    for name, (change, status) in SPOILT.items():
        file.write_bytes(b"".join(change(m) if i == 40 else m for i, m in enumerate(packed)))
        back = warc.read_warc(spark, str(tmp_path / "w"))
        found = [tuple(r) for r in warc.audit(mine, warc.merkle_tree(back)).collect()]
        assert found == [(1, 40, status)], name
        assert back.where("not damaged").count() == 300 - (status == "damaged") and back.where("raw is not null").count() == 1, name
    file.write_bytes(b"".join(flip(30)(m) if i in (3, 4, 90) else m for i, m in enumerate(packed) if i != 7))
    found = sorted(tuple(r) for r in warc.audit(mine, warc.merkle_tree(warc.read_warc(spark, str(tmp_path / "w")))).collect())
    assert {x for x in found if x[1] < 80} == {(1, 3, "damaged"), (1, 4, "damaged"), (1, 7, "missing")} and found[3:]


def test_very_long_and_binary_records(spark, tmp_path):
    long = spark.range(3).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.lit("ab"), (F.col("id") * 10_000_000).cast("int")).alias("html"))
    records = warc.warc_records(long, files=1)
    warc.write_warc(records, str(tmp_path / "w"), 1)
    back = warc.read_warc(spark, str(tmp_path / "w"))
    same = ["ordinal", "offset", "length", "key", "record_sha256"]
    assert sorted(map(tuple, back.select(*same).collect())) == sorted(map(tuple, records.select(*same).collect()))
    assert warc.file_count(long) == 1 and warc.file_count(long, file_bytes=1 << 20) == 58 and warc.file_count(long.limit(0)) == 1
