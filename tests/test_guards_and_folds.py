"""Amendments, guards and folds against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.functions import codes
from dossier.operators import accounting, chunking, citations, consolidation, evaluation, lifecycle, similarity
from dossier.sources import documents

ADDRESSES = ["1.2.3.4", "255.255.255.255", "256.1.1.1", "01.2.3.4", "1.2.3", "", "host", "::", "::1", "1::", "2001:db8::8:800:200c:417a", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1::2::3", "::ffff:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "fe80::1%eth0", "g::1", "12345::", ":1", None]


def test_addresses_are_those_of_the_standard_library(spark):
    import ipaddress

    def valid(a):
        try:
            return a is not None and bool(ipaddress.ip_address(a))
        except ValueError:
            return False

    rows = spark.createDataFrame([(i, a) for i, a in enumerate(ADDRESSES)], "i int, a string")
    got = [r.ok for r in rows.orderBy("i").select(accounting.is_ip(F.col("a")).alias("ok")).collect()]
    assert dict(zip(ADDRESSES, got, strict=True)) == {a: valid(a) for a in ADDRESSES}


def test_classes_of_failures(spark):
    cases = [(None, "APITimeoutError timeout", "timeout"), (400, "billing_error", "credit_exhausted"), (429, "x", "rate_limited"), (403, "x", "auth"), (503, "x", "server_error"), (404, "x", "other"), (None, None, "other")]
    rows = spark.createDataFrame(cases, "status int, kind string, want string").select(accounting.failure_class(F.col("status"), F.col("kind")).alias("got"), "want")
    assert all(r.got == r.want for r in rows.collect())


def test_a_word_of_structure_counts_however_far_back(spark):
    rows = spark.createDataFrame([(1, "ANEXA" + " " * 200 + "I 5-2"), (2, "conform" + " " * 200 + "I 5-2"), (3, "I 5-2")], "k int, t string")
    assert {r.k for r in codes.code_spans(rows, "k", "t").collect()} == {2, 3}


def test_colliding_keys_against_all_pairs(spark):
    rng = random.Random(3)
    spans = [(k, a, a + rng.randrange(4), rng.randrange(3)) for k in range(60) for a in (rng.randrange(20) for _ in range(rng.randrange(6)))]
    want = {k for k, s, e, o in spans for k2, s2, e2, o2 in spans if k == k2 and o != o2 and s < e2 and s2 < e and s < e and s2 < e2}
    got = codes.colliding_keys(spark.createDataFrame(spans, "key int, start int, end int, owner int"), "key", "owner")
    assert {r.key for r in got.collect()} == want and 5 < len(want) < 55


def test_aliases_meet_questions(spark):
    questions = spark.createDataFrame([(1, "vezi NP10 si SREN 12831"), (2, "(i-7) sau 0010"), (3, "xNP 10"), (4, None)], "q int, t string")
    aliases = spark.createDataFrame([("a", "NP 010"), ("b", "SR EN 12831"), ("c", "I7"), ("d", "10")], "doc string, alias string")
    got = {(r.q, r.doc) for r in codes.alias_spans(questions, aliases, "q", "t", "doc").collect()}
    assert got == {(1, "a"), (1, "b"), (2, "c"), (2, "d"), (3, "d")}


def test_ingestion_budget_against_a_fold(spark):
    rng = random.Random(4)
    items = [(g, o, rng.choice([1, 2000, 4000, 9000, 12_000])) for g in ("a", "b", None, "c") for o in range(30)] + [("none", 0, 20_000)]
    want, state = {}, {}
    for g, o, t in items:
        n, used = state.get(g, (0, 0))
        ok = n < 5 and used + t <= 10_000
        want[g, o] = ok
        state[g] = (n + ok, used + t * ok)
    rows = spark.createDataFrame(items, "g string, o int, t long").where("g is not null")
    got = {(r.g, r.o): r.accepted for r in accounting.ingestion_budget(rows, group=["g"], order="o", size="t").collect()}
    assert got == {k: v for k, v in want.items() if k[0] is not None} and sum(got.values()) > 6


def test_caps_by_the_last_call_allowed(spark):
    calls = spark.createDataFrame([(i, "error" if i % 3 else "ok", "kept") for i in range(40)] + [(40, None, "kept")], "id int, kind string, other string")
    got = {r.id: r.allowed for r in evaluation.within_cap(calls, order=["id"], kind="kind", caps={"error": 5, "none": 9}).collect()}
    assert {i for i, ok in got.items() if ok} == {1, 2, 4, 5, 7} and len(got) == 41


@pytest.mark.parametrize("block", [2048, 7])
def test_nearest_chunks_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(similarity, "QUESTION_BLOCK", block)
    monkeypatch.setattr(similarity, "CHUNK_BLOCK", 10)
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(60, 8))
    vectors[7] = vectors[3]
    chunks = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(90, [0.0] * 8), (91, None)], "c long, embedding array<double>")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    got = similarity.top_k_each(chunks.where("c < 20 or c > 80").withColumnRenamed("c", "q"), chunks, question_id="q", chunk_id="c", k=4).collect()
    for q in range(20):
        score = unit @ unit[q]
        want = sorted(range(60), key=lambda i: (-round(score[i], 12), i))[:4]
        assert [r.c for r in sorted((r for r in got if r.q == q), key=lambda r: r.rank)] == want
    assert {r.q for r in got} == set(range(20))
    assert similarity.top_k_each(chunks.limit(0).withColumnRenamed("c", "q"), chunks, question_id="q", chunk_id="c").count() == 0


BASE = "Intro\n1.1. Primul punct (1) unu\n(2) a) litera a\nb) litera b\n1.2. Al doilea. [rest]\n1.3. Al treilea\nTabelul 7.10\nputere veche de ardere\nSfarsit tabel\n1.4. Final\n"
TITLE = "Ordinul nr. 5/2020 $1"


def test_eight_kinds_of_amendments(spark):
    asked = [
        (1, "replace_point", {"point": "1.2", "new_text": "1.2. Nou."}),
        (2, "replace_unit", {"point": "1.1", "paragraph": "2", "letter": "b", "new_text": "b) litera noua"}),
        (3, "repeal_point", {"point": "1.3"}),
        (4, "repeal_unit", {"point": "1.1", "paragraph": "2", "letter": "a"}),
        (5, "insert_after", {"point": "1.1", "paragraph": "2", "new_text": "(3) trei"}),
        (6, "renumber", {"point": "1.4", "new_point": "1.5", "new_text": "1.5. Final nou"}),
        (7, "replace_block", {"first": "Tabelul 7.10", "last": "Sfarsit", "new_text": "Tabelul nou"}),
        (8, "replace_phrase", {"first": "Tabelul 7.10", "last": "Sfarsit", "old_phrase": "putere  veche", "new_phrase": "putere $1 noua"}),
        (9, "renumber", {"point": "1.4", "new_point": "1.2", "new_text": "x"}),
        (10, "replace_point", {"point": "7.7", "new_text": "x"}),
        (11, "other", {"point": "1.2"}),
        (12, "replace_phrase", {"first": "Tabelul 7.10", "last": "Sfarsit", "old_phrase": "lipsa", "new_phrase": "x"}),
    ]
    names = ["point", "paragraph", "letter", "introduction", "nth", "first", "last", "new_point", "old_phrase", "new_phrase", "new_text"]
    rows = [("d", nr, kind, 0, *(t.get(n) for n in names), TITLE) for nr, kind, t in asked]
    schema = f"doc string, {consolidation.OPERATION}, new_text string, order_title string"
    texts = spark.createDataFrame([("d", BASE)], "doc string, text string")
    found = {r.nr: r for r in consolidation.operation_edits(texts, spark.createDataFrame(rows, schema), "doc").collect()}
    at = BASE.index
    changed, brought, gone = f"[Text modificat prin {TITLE}]", f"[Text introdus prin {TITLE}]", f"[Abrogat prin {TITLE}]"
    want = {
        1: (at("1.2."), at("1.3."), f"1.2. Nou.\n{changed}"),
        2: (at("b) litera"), at("1.2."), f"b) litera noua\n{changed}"),
        3: (at("1.3."), at("1.4."), f"1.3. Abrogat.\n{gone}"),
        4: (at("a) litera"), at("b) litera"), f"a) Abrogat.\n{gone}"),
        5: (at("1.2."), at("1.2."), f"\n(3) trei\n{brought}"),
        6: (at("1.4."), len(BASE), f"1.5. Final nou\n{changed}"),
        7: (at("Tabelul 7.10"), at("Sfarsit"), f"Tabelul nou\n{changed}"),
        8: (at("Tabelul 7.10"), at("Sfarsit"), "Tabelul 7.10\nputere $1 noua de ardere\n"),
    }
    assert {nr: (r.start, r.stop, r.new_text) for nr, r in found.items() if not r.problem} == want
    assert {nr: r.problem for nr, r in found.items() if r.problem} == {9: "number_exists", 10: "no_place", 11: "unknown_kind", 12: "no_phrase"}
    assert sorted(nr for nr, r in found.items() if not r.is_marked) == [8, 12] and found[1].old_text == "1.2. Al doilea. [rest]\n"


def test_new_text_is_cut_at_its_targets(spark):
    rows = spark.createDataFrame([("„1.2. Unu\nrest\n1.3. Doi”", ["1.2.", "1.3."]), ("1.2. a\n1.2. b\n1.3. c", ["1.2.", "1.3."]), ("1.3. a\n1.2. b", ["1.2.", "1.3."]), ("orice", ["9."])], "t string, m array<string>")
    got = [r[0] for r in rows.select(consolidation.segments_of(F.regexp_replace("t", "^„", ""), F.col("m"))).collect()]
    assert got == [["1.2. Unu\nrest", "1.3. Doi"], None, None, ["orice"]]


def random_lines(rng):
    kinds = ["MONITORUL OFICIAL AL ROMÂNIEI, PARTEA I, Nr. 7", "12", "", "  ", "text de lege", "II. TITLU MARE", "II. titlu mic", "+", "Articolul 7", "Capitolul IV Generale", "Secțiunea a 2-a Altele", "1.2. Titlu", "Cuprins ..... 12", "3. Alt titlu"]
    toc = rng.choice([[], ["Titlu ..... 12", "Alt titlu ........ 7"], ["3.1. Titlu\n12", "3.2. Alt titlu\n 13"]])
    first = [rng.choice(toc if rng.random() < 0.7 else kinds) for _ in range(rng.randrange(40))] if toc else []
    return "\n".join(first + [rng.choice(kinds) for _ in range(rng.randrange(60))]) + rng.choice(["", "\n" + "x" * 9000])


def test_cleaning_in_rows_is_that_of_lines(spark):
    """The array forms that chunking uses say what the operators on rows of lines say."""
    rng = random.Random(6)
    texts = spark.createDataFrame([(i, random_lines(rng)) for i in range(150)], "d int, text string").cache()
    bare = chunking.from_lines(chunking.without_headers(chunking.to_lines(texts, "d"), "d"), "d").withColumn("text", chunking.without_colophon(F.col("text")))
    slow = chunking.from_lines(chunking.without_chapter_lines(chunking.to_lines(chunking.without_toc(bare, "d"), "d"), "d"), "d")
    got = {r.d: r.text for r in chunking.clean_text(texts, "d").collect()}
    want = {r.d: r.text for r in slow.collect()}
    assert {d: t for d, t in got.items() if t} == {d: t for d, t in want.items() if t} and len(got) == 150
    cut = chunking.without_toc(texts, "d").join(texts.withColumnRenamed("text", "old"), "d").where("text <> old").count()
    assert cut > 5


def test_pieces_end_at_words_and_spare_marks():
    rng = random.Random(7)
    mark = "[Text modificat prin Ordinul nr. 5/2018, publicat]"
    for _ in range(200):
        words = [rng.choice(["a" * rng.randrange(1, 30), mark, "b\n", "c" * 90, " "]) for _ in range(rng.randrange(40))]
        text = rng.choice([" ", ""]).join(words)
        pieces = chunking.cut_text(text, 100)
        assert "".join("".join(pieces).split()) == "".join(text.split())
        assert all(0 < len(p) <= 100 for p in pieces) or len(text) <= 100
        spaced = " ".join(words)
        assert sum(p.count(mark) for p in chunking.cut_text(spaced, 100)) == spaced.count(mark)
    assert chunking.cut_text("x" * 250, 100) == ["x" * 100, "x" * 100, "x" * 50] and chunking.cut_text("", 100) == [] and chunking.cut_text(" a ", 100) == [" a "]


def test_long_suffixes_and_blanks_after_numbers(spark):
    suffix = "(" + "a" * 600 + ")"
    rows = spark.createDataFrame([(1, f"1.1.{suffix} Text de lege lung"), (2, "1.2.," + " " * 600 + "text mic"), (3, "1.3.," + " " * 600 + "\nText")], "d int, text string")
    assert {r.d: r.article for r in chunking.segments(rows, "d").collect()} == {1: "1.1." + suffix, 3: "1.3."}


def test_removed_lines_are_counted(spark):
    toc = "\n".join(f"Titlul {i} ........ {i}" for i in range(6))
    text = f"MONITORUL OFICIAL AL ROMÂNIEI, PARTEA I, Nr. 7\n12\n{toc}\n" + "lege\n" * 400
    row = chunking.removed_lines(spark.createDataFrame([(1, text)], "d int, text string"), "d").first()
    assert (row.headers, row.toc_entries) == (2, 6)


def test_metadata_is_named_once_or_not_at_all(spark):
    good = "NP 010-2022\nNormativ privind proiectarea scolilor\nalt text"
    rows = spark.createDataFrame([(1, good, "h"), (2, good + "\nI 7-2011", "h"), (3, "nimic", "h"), (4, None, "h"), (5, good.replace("-2022", ""), "h")], "i int, t string, s string")
    got = {r.i: r for r in lifecycle.discovered_metadata(rows, text="t", sha256="s").collect()}
    assert (got[1].document_id, got[1].source_key, got[1].official_code, got[1].title, got[1].year, got[1].problem) == ("np010_2022", "pdf_h", "NP 010-2022", "Normativ privind proiectarea scolilor", 2022, None)
    assert all(got[i].problem == "ambiguous_metadata" and got[i].document_id is None for i in (2, 3, 4, 5))


def test_preflight_tells_what_is_wrong_first(spark):
    good = "NP 010-2022\nNormativ privind proiectarea scolilor"
    files = spark.createDataFrame([("a", "a", "a", good, 3), ("b", "b", "x", good, 3), ("c", "c", "c", " ", 3), ("d", "d", "d", good, 0), ("e", "e", "e", good, 2), ("f", "f", "f", good, 2), ("g", "g", "g", "x", 2)], "source_sha256 string, sha256_before string, sha256_after string, text string, pages int")
    chunks = spark.createDataFrame([(k, None) for k in "aabcdg"] + [("f", "blank"), ("f", None)], "source_sha256 string, problem string")
    got = {r.source_sha256: r for r in lifecycle.preflight(files, chunks).collect()}
    assert {k: r.status for k, r in got.items()} == {"a": "ready_for_human_metadata", "b": "unstable_pdf", "c": "invalid_extraction", "d": "invalid_extraction", "e": "invalid_chunks", "f": "invalid_chunks", "g": "ambiguous_metadata"}
    assert (got["a"].chunk_count, got["a"].page_count, got["a"].year) == (2, 3, 2022) and got["b"].chunk_count is None


def test_disabling_keeps_to_its_source(spark):
    docs = spark.createDataFrame([("a", "s", "approved"), ("b", "s", "approved"), ("c", "s", "other"), ("d", "s", "approved")], "document_id string, source_key string, status string")
    wanted = spark.createDataFrame([("a", "s"), ("b", "x"), ("c", "s")], "document_id string, source_key string")
    assert {r.document_id: (r.status, r.refused) for r in lifecycle.disable(docs, wanted).collect()} == {"a": ("disabled", False), "b": ("approved", True), "c": ("other", True), "d": ("approved", False)}


def test_generation_is_summed_up(spark):
    rows = [("answered", True, False, True, 1), ("answered", False, True, True, 2), ("not_found", None, None, None, 1), ("generation_error:timeout", None, None, None, 2), (None, None, None, None, None)]
    cases = spark.createDataFrame(rows, "outcome string, cites_expected boolean, says_missing boolean, quotes_literal boolean, calls int")
    row = evaluation.generation_summary(cases).first()
    assert (row.answers, row.cites_expected, row.says_missing, row.quotes_literal, row.calls) == (2, 1, 1, 2, 6)
    assert row.outcomes == {"answered": 2, "not_found": 1, "generation_error:timeout": 1} and row.errors == {"generation_error:timeout": 1}
    assert evaluation.generation_summary(cases.limit(0)).first().answers == 0


def test_tool_responses_and_codes_for_logs(spark):
    call = '{"stop_reason":"%s","content":[{"type":"tool_use","name":"%s","input":%s}]}'
    given = [call % ("tool_use", "publica", '{"a":1}'), call % ("max_tokens", "publica", '{"a":1}'), call % ("tool_use", "alta", "{}"), call % ("tool_use", "publica", "[1]"), '{"content":[]}', "x", None]
    rows = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, r string").orderBy("i").select(citations.tool_input(F.col("r"), "publica").alias("t"))
    assert [tuple(r.t) for r in rows.collect()] == [('{"a":1}', None), (None, "truncated")] + [(None, "invalid_response")] * 5
    payload = '{"raspuns":"%s","pasaje":[],"gasit":true}'
    asked = spark.createDataFrame([(payload % "[C1]",), (payload % "text",), ("{",), ('{"raspuns":"","pasaje":[],"gasit":false}',)], "t string").select(citations.decode_payload("t").alias("p"))
    assert [r[0] for r in asked.select(citations.diagnostic_code(F.col("p"), F.array(F.lit("C1")))).collect()] == ["empty_answer", "missing_citation", "invalid_payload", None]
    again = spark.createDataFrame([("first", ["SR 2", "<NP>"])], "p string, u array<string>").select(citations.retry_prompt(F.col("p"), F.col("u"), "fara"))
    assert again.first()[0] == 'first\n\nfara\n\n["\\u003cNP\\u003e","SR 2"]'


def chunks_of(spark, doc, n, status="approved"):
    return spark.createDataFrame([(doc, i, f"t{i}", status) for i in range(n)], "document_id string, n int, text string, status string")


def test_writes_are_guarded(spark, tmp_path):
    path = str(tmp_path / "chunks")
    chunks_of(spark, "a", 2).write.partitionBy("document_id").parquet(path)
    read = lambda: spark.read.parquet(path)
    documents.append_new(chunks_of(spark, "b", 1), read(), path)
    assert {(r.document_id, r.status) for r in read().collect()} == {("a", "approved"), ("b", documents.PENDING)}
    known = spark.createDataFrame([("a", "approved"), ("b", documents.PENDING)], "document_id string, status string")
    new = chunks_of(spark, "a", 5).unionByName(chunks_of(spark, "b", 3)).unionByName(chunks_of(spark, "x", 1))
    refused = {(r.document_id, r.status) for r in documents.replace_pending(new, known, path).collect()}
    assert refused == {("a", "approved"), ("x", None)} and {r.document_id: r["count"] for r in read().groupBy("document_id").count().collect()} == {"a": 2, "b": 3}
    judged = spark.createDataFrame([("a", True), ("b", True)], "document_id string, passes boolean")
    current = spark.createDataFrame(read().collect(), read().schema)
    refused = documents.replace_approved(new, current, judged, known, path, str(tmp_path / "kept"))
    assert {r.document_id for r in refused.collect()} == {"b", "x"}
    assert {r.document_id: r["count"] for r in read().groupBy("document_id").count().collect()} == {"a": 5, "b": 3} and spark.read.json(str(tmp_path / "kept")).count() == 2
    with pytest.raises(Exception, match="exist"):
        documents.replace_approved(new, current, judged, known, path, str(tmp_path / "kept"))


def test_backups_are_checked_before_they_return(spark):
    import hashlib

    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    rows = [("a", "s", "t", md5("t")), ("a", "s", "t", md5("u")), ("b", "z", "t", md5("t")), ("c", "s", "t", md5("t")), ("a", "s", None, None)]
    table = spark.createDataFrame(rows, "document_id string, source_key string, text string, content_hash string")
    known = spark.createDataFrame([("a", "s"), ("b", "s")], "document_id string, source_key string")
    got = {tuple(r) for r in documents.restore_problems(table, known, ["source_key"]).collect()}
    assert got == {("a", "content_hash"), ("b", "identity"), ("c", "unknown_document"), ("a", "missing_field")}


def test_folders_that_lack_a_file_are_rejected(spark, tmp_path):
    meta = '{"document_id":"%s","source_key":"s","official_code":"c","title":"t","year":2020,"status":"approved"}'
    for name, files in {"ok": ("m", "t"), "bare": ("m",), "mute": ("t",)}.items():
        (tmp_path / name).mkdir()
        if "m" in files:
            (tmp_path / name / "metadata.json").write_text(meta % name)
        if "t" in files:
            (tmp_path / name / "extracted.txt").write_text("text")
    good, bad = documents.read_collection(spark, str(tmp_path))
    assert [r.folder for r in good.collect()] == ["ok"] and {r.folder: r.problems for r in bad.collect()} == {"bare": ["extracted.txt"], "mute": ["metadata.json"]}


def test_gold_cases_have_no_other_keys(spark, tmp_path):
    case = '{"id":"%s","type":"negative","question":"q","expected":[]%s}'
    (tmp_path / "gold.json").write_text(case % ("a", "") + "\n" + case % ("b", ',"note":1') + "\n")
    _, wrong = documents.read_gold(spark, str(tmp_path / "gold.json"))
    assert [tuple(r) for r in wrong.collect()] == [("b", "extra_key")]
