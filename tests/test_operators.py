"""Boundary cases of single operators, on small tables."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from dossier.functions import codes, identity, normalize
from dossier.functions.scope import is_calculation_request
from dossier.operators import accounting, chunking, citations, consolidation, evaluation, evidence, glyphs, lifecycle, routing, similarity


def column(spark, expression, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("c"))).collect()]


def test_article_keys(spark):
    got = column(spark, normalize.article_key, ["3.2. (b).L.", "ANEXA 1.", "a_b", "...", None])
    assert got == ["3.2.(b).l", "anexa1", "a_b", "", None]
    assert column(spark, normalize.is_article_key, ["3.2.(b).l", "a_b", "", None]) == [True, False, False, False]


def test_text_keys(spark):
    assert column(spark, normalize.fix_diacritics, ["ţşŢŞǎǍ", "é"]) == ["țșȚȘăĂ", "é"]
    assert column(spark, normalize.alias_key, ["NP 010-2022", "--"]) == ["np0102022", None]
    assert column(spark, normalize.code_key, ["sr en iso 52016/1"]) == ["SRENISO520161"]
    assert column(spark, normalize.collapse_spaces, [" a \n b ", ""]) == ["a b", ""]
    assert column(spark, normalize.scope_text, ["  Câți ŢĂRI é ", None]) == ["cati tari e", ""]
    assert column(spark, normalize.plain_letters, ["𝑥+ℎ"]) == ["x+h"]
    assert column(spark, normalize.content_hash, ["  ", "a"]) == [None, "0cc175b9c0f1b6a831c399e269772661"]
    assert column(spark, normalize.escape_json, ["<a>&"]) == ["\\u003ca\\u003e\\u0026"]


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("Calculează debitul minim", True),
        ("Cum se calculează debitul?", False),
        ("Cum se calculează? Calculează-l!", True),
        ("Vreau, vă rog, dimensionarea instalației", True),
        ("Ce debit minim este prevăzut?", False),
        ("Câți kW îmi trebuie?", True),
        ("sarcina termică pentru o hală de 200 mp", True),
        ("sarcina termică", False),
        ("În ce articol se descrie calculul?", False),
        ("", False),
        (None, False),
    ],
)
def test_scope(spark, text, wanted):
    assert column(spark, is_calculation_request, [text]) == [wanted]


def spans(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    found = codes.drop_contained(codes.code_spans(rows, "k", "t"), "k").collect()
    return [sorted(texts[r.k][r.start : r.end] for r in found if r.k == i) for i in range(len(texts))]


def test_codes(spark):
    got = spans(spark, ["vezi SR EN ISO 52016-1 si STAS 6648/1-82", "ANEXA I 5-2", "[C1] p. 12-14", "P 118/2-2013, I7-2011", None or ""])
    assert got == [["SR EN ISO 52016-1", "STAS 6648/1-82"], [], [], ["I7-2011", "P 118/2-2013"], []]


def parsed(spark, texts):
    aliases = spark.createDataFrame([("np10", "NP 010-2022"), ("i7", "I7-2011"), ("x", "I7-2011 bis")], "document_id string, alias string")
    articles = spark.createDataFrame([("np10", "3.2.1"), ("i7", "4.1.2.3")], "document_id string, article string")
    asked = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "question_id string, text string")
    rows = {int(r.question_id): (r.document_id, r.article, r.is_marked, r.needs_clarification) for r in routing.parse(asked, aliases, articles).collect()}
    only = {int(r.question_id): r.documents for r in routing.restricted_documents(asked, aliases, articles).collect()}
    return [rows[i] for i in range(len(texts))], [only.get(i) for i in range(len(texts))]


def test_parser(spark):
    got, only = parsed(
        spark,
        [
            "NP10/2022 art. 3.2.1 ce spune",
            "STAS 6648",
            "I7-2011 bis",
            "I7-2011 la 4.1.2",
            "I7-2011 la 9.9.9",
            "art. 1 si articolul 2",
            "I7-2011 si NP 010-2022 art. 5",
            "anexa 3",
            "doar din I7-2011 4.1.2.3",
            "doar din I7-2011 9",
            "nu doar din I7-2011",
            "Doar din I7-2011",
            "doar din XY",
        ],
    )
    assert got[0] == ("np10", "3.2.1", True, False)
    assert got[1] == (None, None, False, True) and got[2] == (None, None, False, True)
    assert got[3] == ("i7", "4.1.2", False, False) and got[4] == ("i7", None, False, False)
    assert got[5][3] and got[6] == (None, None, False, True) and got[7] == (None, "anexa3", True, False)
    assert only[8] == ["i7"] and only[9] == [] and only[10] is None and only[11] is None and only[12] == []


def test_evidence_order_and_limits(spark):
    rows = spark.createDataFrame([(1, "X", 42, "a"), (2, "Y", 10, "b"), (3, "X", 40, "c")], "seq int, art string, ord int, h string").withColumn("q", F.lit(1))
    got = evidence.grouped_by(rows, ["q"], ["art"], order="ord", seq="seq").orderBy("seq").collect()
    assert [r.ord for r in got] == [40, 42, 10]
    sized = spark.createDataFrame([(1, 4), (2, 9), (3, 1)], "seq int, n int").withColumn("q", F.lit(1))
    assert [r.seq for r in evidence.within_budget(sized, ["q"], length="n", seq="seq", budget=8).collect()] == [1]
    places = spark.createDataFrame([("ok", "a", 1), ("ok", "b", 2), ("gap", "a", 1), ("gap", "b", 3), ("twice", "a", 1), ("twice", "b", 1)], "k string, h string, o int").withColumn("s", F.col("o"))
    got = {r.k: r.is_ambiguous for r in evidence.ambiguous(places, ["k"], content="h", order="o", seq="s").collect()}
    assert got == {"ok": False, "gap": True, "twice": True}


def test_fusion_and_thresholds(spark):
    a = spark.createDataFrame([(1, 0.7), (2, 0.6)], "id int, score double")
    b = spark.createDataFrame([(2, 0.9), (3, 0.55)], "id int, score double")
    assert [(r.id, r.score) for r in similarity.fuse(a, b, chunk_id="id", k=2).collect()] == [(2, 0.9), (1, 0.7)]
    scored = spark.createDataFrame([(1, None), (2, 0.49), (3, 0.5)], "id int, score double")
    assert [r.id for r in similarity.accepted(scored).collect()] == [3]
    vectors = spark.createDataFrame([(1, [1.0]), (2, []), (3, None), (4, [float("nan")]), (5, [float("inf")]), (6, [None])], "i int, v array<double>")
    assert [r[0] for r in vectors.orderBy("i").select(similarity.is_valid_vector(F.col("v"))).collect()] == [True] + [False] * 5
    rewrites = spark.createDataFrame([("a b", "a  b"), ("a", "c"), ("a", " "), ("a", None), ("a", "x" * 1001)], "o string, r string")
    assert [r[0] for r in rewrites.select(similarity.chosen_question(F.col("o"), F.col("r"))).collect()] == ["a b", "c", "a", "a", "a"]


def test_limits_at_their_edges(spark):
    at = lambda s: datetime(2024, 1, 1, 0, s // 60, s % 60)
    rows = spark.createDataFrame([(i, "ip", at(i)) for i in range(7)] + [(10 + i, "ip", at(120 + 60 * i)) for i in range(26)], "event_id int, ip string, ts timestamp_ntz")
    got = {r.event_id: r for r in accounting.retry_after(accounting.rate_limited(rows, caller="ip", ts="ts", order=["ts", "event_id"]), ts="ts").collect()}
    assert got[4].allowed and not got[5].allowed and got[5].retry_after == 55 and got[4].retry_after is None
    assert got[32].hour_count == 30 and got[32].allowed and not got[33].allowed and not got[35].allowed
    used = spark.createDataFrame([(i, "v", "answered" if i != 3 else "error") for i in range(13)], "i int, v string, o string")
    quota = {r.i: r.reserved for r in accounting.within_quota(used, visitor="v", order=["i"], consumes=~accounting.is_refunded(F.col("o"))).collect()}
    assert quota[9] and quota[10] and not quota[11]
    sizes = spark.createDataFrame([(0, 9000), (1, 2000), (2, 900), (3, 50), (4, 50), (5, 10), (6, 1)], "i int, n int").withColumn("d", F.lit(1))
    kept = accounting.ingestion_budget(sizes, group=["d"], order="i", size="n").orderBy("i").collect()
    assert [r.accepted for r in kept] == [True, False, True, True, True, False, False] or [r.accepted for r in kept] == [True, False, True, True, True, True, False]
    tokens = spark.createDataFrame([(0, 60), (1, 40), (2, 1), (3, 500), (4, 99)], "i int, t int").withColumn("d", F.lit(1))
    batches = accounting.embedding_batches(tokens, group=["d"], order="i", tokens="t", most=10, most_tokens=100).orderBy("i").collect()
    assert [r.batch for r in batches] == [1, 1, 2, None, 2]
    assert [r[0] for r in spark.createDataFrame([("1.1.1.1, 2.2.2.2 ,3.3.3.3",), (None,), ("9.9.9.9",)], "f string").select(accounting.client_ip(F.col("f"), F.lit("h"), 2)).collect()] == ["2.2.2.2", "h", "h"]


def test_tokens_and_pseudonyms(spark):
    key = b"k" * 32
    rows = spark.createDataFrame([("ab" * 32, 1000)], "id string, t long").withColumn("token", identity.issue_token(F.col("id"), F.col("t"), key))
    valid = lambda now, token="token", k=key: rows.select(identity.token_is_valid(F.expr(token), F.lit(now), k)).first()[0]
    assert valid(1000) and valid(1000 + 365 * 86400) and not valid(999) and not valid(1001 + 365 * 86400) and not valid(1000, k=b"x" * 32)
    assert not valid(1000, "concat(token, 'x')") and not valid(1000, "'v1.a.b'") and not valid(1000, "cast(null as string)")
    assert column(spark, identity.canonical_ip, ["::ffff:1.2.3.4", " 2001:DB8::0:1", "x", None]) == ["1.2.3.4", "2001:db8::1", None, None]
    assert len(column(spark, lambda c: identity.pseudonym(c, key, "ip"), ["1.2.3.4"])[0]) == 64


def test_lines_around_headers(spark):
    text = "a\n12\n\nMONITORUL OFICIAL AL ROMÂNIEI, PARTEA I, Nr. 5\n13\nb\n14\nc"
    lines = chunking.to_lines(spark.createDataFrame([(1, text)], "d int, text string"), "d")
    assert chunking.from_lines(chunking.without_headers(lines, "d"), "d").first().text == "a\n\nb\n14\nc"


def chunks_of(spark, text):
    rows = chunking.chunk(spark.createDataFrame([(1, text)], "d int, text string"), "d").orderBy("chunk_order").collect()
    return [(r.article, r.text) for r in rows]


def test_chunks(spark):
    filler = "Prevederile acestui articol se aplică tuturor."
    text = f"Titlu\n1.1. Domeniul de aplicare\n1.1.1. {filler}\n1.1.2. Conform\n2.1.3. nu este articol nou aici.\n1.2. {filler}\n01.02.2024 data\n1.2. {filler}"
    got = chunks_of(spark, text)
    assert [a for a, _ in got] == ["1.1.1.", "1.1.2.", "1.2."]
    assert got[0][1].startswith("1.1. Domeniul de aplicare\n") and got[2][1].startswith(f"{filler}\n01.02.2024")
    toc = "\n".join(f"{i}.{i}. Ceva ........ {i}" for i in range(1, 7)) + "\n" + f"3.1. {filler * 40}"
    assert all(len(t) <= 1000 for _, t in chunks_of(spark, toc)) and {a for a, _ in chunks_of(spark, toc)} == {"3.1."}
    assert chunks_of(spark, "") == [] and chunks_of(spark, None) == []


def test_pieces_and_marks(spark):
    assert [len(p) for p in chunking.cut_text("x" * 940 + " " + "y" * 200)] == [940, 200]
    mark = "[Text modificat prin Ordinul nr. 1/2018]"
    assert chunking.cut_text("z" * 980 + " " + mark)[1] == mark
    rows = spark.createDataFrame([(1, 0, "3.1.(1)", "a " + mark), (1, 1, "3.1.(2)", "b"), (1, 2, "3.2.", "c")], "d int, n int, article string, text string")
    got = {r.n: r.text for r in chunking.with_article_marks(rows, "d", order=["n"]).collect()}
    assert got == {0: "a " + mark, 1: "b\n[Articol cu text modificat prin Ordinul nr. 1/2018]", 2: "c"}


def test_numbered_split(spark):
    def split(numbers):
        text = "Introducere care nu e titlu." + "".join(f"\n({n}) " + "w" * 900 for n in numbers)
        rows = spark.createDataFrame([(1, 0, "2.1.", text, False)], "d int, n int, article string, text string, has_context boolean")
        return [r.article for r in chunking.split_numbered(rows, "d", order="n").orderBy("piece").collect()]

    assert split([1, 2, 5]) == ["2.1.", "2.1.(1)", "2.1.(2)", "2.1.(5)"] and split([1, 2, 1]) == ["2.1."] and split([]) == ["2.1."]


def test_consolidation(spark):
    base = "1.1. Vechi.\n1.2. Text vechi\nal doilea rând\n1.3. De abrogat.\n2. Capitol"
    order = "Preambul\nArt. I\n1. Punctul 1.2. se modifică și va avea următorul cuprins:\n„1.2. Text nou.”\n2. Punctul 1.3. se abrogă.\nArt. II\nFine"
    items = consolidation.items(spark.createDataFrame([(1, order)], "d int, text string"), "d").orderBy("nr").collect()
    assert [i.nr for i in items] == [1, 2] and items[1].instruction == "Punctul 1.3. se abrogă." and "Text nou" in items[0].new_text
    none = F.lit(None).cast("string")
    place = lambda p, nth=None: spark.createDataFrame([(base, p)], "b string, p string").select(consolidation.locate("b", "p", none, none, F.lit(False), F.lit(nth).cast("int")).alias("l")).first().l
    assert base[place("1.2").start : place("1.2").stop] == "1.2. Text vechi\nal doilea rând\n"
    assert place("9.9").start is None and place("9.9").matches == 0 and place("1.2", 1).start is None
    edits = spark.createDataFrame([(1, 12, 43, "1.2. Nou"), (1, 43, 59, "1.3. Abrogat.\n")], "d int, start int, stop int, new_text string")
    made = consolidation.splice(spark.createDataFrame([(1, base)], "d int, text string"), edits, "d").first().text
    assert made.startswith("1.1. Vechi.\n1.2. Nou\n1.3. Abrogat.\n")
    crossed = spark.createDataFrame([(1, 0, 5), (1, 4, 9), (1, 9, 10)], "d int, start int, stop int")
    assert [r.start for r in consolidation.overlapping(crossed, "d").collect()] == [4]
    names = lambda i, p: spark.range(1).select(consolidation.names_point(F.lit(i), F.lit(p))).first()[0]
    assert names("Punctele 1.2—1.5 se", "1.3") and names("punctul 3.7.13", "3.7.13.1") and not names("Punctele 1.2—1.5", "1.6")


def test_answers(spark):
    good = {"raspuns": "Da [c1] și [C2] [C1].", "pasaje": [{"id": "c1", "citat": "x  y"}, {"id": "C2", "citat": "nu există"}], "gasit": True}
    payloads = [json.dumps(good), json.dumps(good)[:-1] + ', "gasit": true}', json.dumps(good | {"extra": 1}), json.dumps(good).replace("true", "NaN"), json.dumps(good | {"gasit": 1}), json.dumps({"raspuns": 5, "pasaje": None, "gasit": False}), "x", None, json.dumps(good | {"pasaje": [{"id": "C1", "citat": "q" * 601}]})]
    rows = spark.createDataFrame(list(enumerate(payloads)), "question_id int, text string").withColumn("payload", citations.decode_payload("text")).cache()
    assert [r.payload.valid for r in rows.orderBy("question_id").collect()] == [True, False, False, False, False, True, False, False, False]
    proof = spark.createDataFrame([(0, "C1", "P1", "T", "1.1", "aici x y [Text introdus prin Ordinul nr. 1/2018, publicat în Monitorul Oficial nr. 5 din 01.02.2018]"), (0, "C2", "P2", "T", "1.2", "  alt text")], "question_id int, citation_id string, code string, title string, article string, content string")
    got = citations.citations(rows, proof).orderBy("ord").collect()
    assert [(r.citation_id, r.quote) for r in got] == [("C1", "x  y"), ("C2", "alt text")] and len(got[0].amendments) == 1
    known = F.array(F.lit("C1"), F.lit("C2"))
    assert rows.where("question_id = 0").select(citations.problem(F.col("payload"), known)).first()[0] is None
    assert rows.where("question_id = 0").select(citations.problem(F.col("payload"), F.array(F.lit("C1")))).first()[0] == "unknown_citation"
    said = spark.createDataFrame([(0, "conform STAS 6648 și SR EN 12831")], "question_id int, answer string")
    names = spark.createDataFrame([(0, "vezi sr-en 12831", "P1", "T", "1")], "question_id int, content string, code string, title string, article string")
    assert [r.code for r in citations.unsupported_codes(said, names).collect()] == ["STAS 6648"]


def test_scores(spark):
    cases = spark.createDataFrame([("a", "exact", "found"), ("b", "exact", "found"), ("c", "semantic", "found"), ("d", "semantic", "found"), ("e", "negative", "not_found")], "case_id string, type string, status string")
    hits = spark.createDataFrame([("a", "d", "1.1", 1), ("b", "d", "1.10", 1), ("c", "d", "2.1.3", 3), ("d", "d", "2(1)", 6)], "case_id string, document_id string, article string, rank int")
    expected = spark.createDataFrame([("a", "d", "1.1"), ("b", "d", "1.1"), ("c", "d", "2.1"), ("d", "d", "2")], "case_id string, document_id string, article string")
    result = evaluation.judged(cases, evaluation.first_rank(hits, expected))
    row = evaluation.accuracy(result).first()
    assert (row.cases, row.correct, row.accuracy, row.recall_at_1, row.recall_at_5) == (5, 4, 0.8, 0.25, 0.5)
    assert evaluation.accuracy(result.limit(0)).first().accuracy == 0.0
    assert {r.type: r.cases for r in evaluation.accuracy_by_type(result.where("type = 'exact'")).collect()} == {"exact": 2, "semantic": 0, "negative": 0}


def test_lifecycle(spark):
    moves = [(None, "indexed_pending_validation"), (None, "approved"), ("approved", "approved"), ("approved", "disabled"), ("disabled", "approved")]
    rows = spark.createDataFrame(moves, "o string, n string")
    assert [r[0] for r in rows.select(lifecycle.transition(F.col("o"), F.col("n"))).collect()] == ["insert", "error", "keep", "disable", "error"]
    assert column(spark, lifecycle.document_id_of, ["P 118/2-2013", "NP 010", "I7"]) == ["p118_2_2013", "np010", "i7"]
    a = spark.createDataFrame([("x", "1"), ("x", "1"), ("x", "2"), ("y", "1")], "k string, h string")
    b = spark.createDataFrame([("x", "2"), ("x", "1"), ("x", "1"), ("y", "1"), ("y", "1")], "k string, h string")
    assert {r.k: r.is_unchanged for r in lifecycle.unchanged(a, b, key="k", content="h").collect()} == {"x": True, "y": False}
    cover = spark.createDataFrame([("a", 0.9, 0, 5), ("b", 0.9, 1, 5), ("c", 0.9, 0, 0), ("d", 1.0, 0, 5)], "k string, coverage double, header_chunks int, chunks int")
    limits = spark.createDataFrame([("a", 0.9), ("b", 0.5), ("c", 0.5)], "k string, min_coverage double")
    assert {r.k: r.passes for r in lifecycle.gate(cover, limits, key="k").collect()} == {"a": True, "b": False, "c": False, "d": False}


def test_glyphs(spark):
    rows = spark.createDataFrame([(1, 1, 10.0, 0.0), (1, 2, 7.0, 2.0), (1, 3, 7.0, -2.0), (1, 4, 7.0, 0.2), (1, 5, 9.0, 9.0)], "p int, o int, s double, y double")
    assert [r.script for r in glyphs.scripts(rows, page="p", order="o", size="s", y="y").orderBy("o").collect()] == [None, "sub", "sup", None, None]
    known = spark.createDataFrame([(4094, "a"), (4097, "d"), (4099, "z")], "gid long, char string")
    assert {r.gid: r.char for r in glyphs.interpolated(known).collect()} == {4094: "a", 4095: "b", 4096: "c", 4097: "d", 4099: "z"}
    text = spark.createDataFrame([("ab abc a\nb", ["ab", "abc"], ["X", "Y"])], "t string, o array<string>, n array<string>")
    assert text.select(glyphs.apply_replacements("t", "o", "n")).first()[0] == "X Y a\nb"
    twin = spark.createDataFrame([("V_ܸ x", ["ܸ"], ["V"])], "t string, o array<string>, n array<string>")
    assert twin.select(glyphs.drop_fixed_twins("t", "o", "n")).first()[0] == "V_ x"
