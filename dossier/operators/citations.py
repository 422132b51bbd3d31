"""Answers are published only if what they cite is there."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from dossier.functions import codes
from dossier.functions.normalize import code_key, collapse_spaces, escape_json

QUOTE_CHARS = 600
PAYLOAD_KEYS = {"raspuns", "pasaje", "gasit"}
PASSAGE = StructType([StructField("id", StringType()), StructField("quote", StringType())])
PAYLOAD = StructType([StructField("valid", BooleanType()), StructField("found", BooleanType()), StructField("answer", StringType()), StructField("passages", ArrayType(PASSAGE))])
# Marks of amended text, and the notice on a cut answer.
AMENDED = r"\[(?:Articol cu text )?(?:Text modificat|Text introdus|Abrogat|modificat|introdus|abrogat) prin Ordinul nr\. [0-9.]+/\d{4}, publicat în Monitorul Oficial nr\. \d+ din \d{2}\.\d{2}\.\d{4}\]"


def _decode(text: str | None) -> dict:
    def once(pairs: list) -> dict:
        if len({k for k, _ in pairs}) != len(pairs):
            raise ValueError("a key repeats")
        return dict(pairs)

    def no_constant(_: str) -> None:
        raise ValueError("not a JSON number")

    bad = {"valid": False, "found": None, "answer": None, "passages": None}
    try:
        data = json.loads(text or "", object_pairs_hook=once, parse_constant=no_constant)
    except (ValueError, RecursionError):
        return bad
    if not isinstance(data, dict) or set(data) != PAYLOAD_KEYS or type(data["gasit"]) is not bool:
        return bad
    if not data["gasit"]:  # an honest refusal is not looked at further
        return {"valid": True, "found": False, "answer": None, "passages": []}
    answer, rows = data["raspuns"], data["pasaje"]
    if not isinstance(answer, str) or not answer.strip() or not isinstance(rows, list):
        return bad
    for row in rows:
        if not isinstance(row, dict) or set(row) != {"id", "citat"} or not all(isinstance(v, str) for v in row.values()):
            return bad
        if not re.fullmatch("[Cc][1-9][0-9]*", row["id"]) or not row["citat"].strip() or len(row["citat"]) > QUOTE_CHARS:
            return bad
    passages = [{"id": r["id"].upper(), "quote": r["citat"]} for r in rows]
    return {"valid": True, "found": True, "answer": answer, "passages": passages}


@F.pandas_udf(PAYLOAD)
def decode_payload(texts: pd.Series) -> pd.DataFrame:
    """A strictly read answer: no key twice at any depth, no NaN, exact keys, right types. Spark's own reader keeps the
    last of repeated keys, hence Python."""
    return pd.DataFrame([_decode(t) for t in texts], columns=["valid", "found", "answer", "passages"])


def cited_ids(answer: Column) -> Column:
    """Distinct ids in order, in upper case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[([Cc][1-9][0-9]*)\]"), F.lit(1)), F.upper))


def unknown_ids(answer: Column, known: Column) -> Column:
    return F.array_except(cited_ids(answer), known)


def literal(quote: Column, content: Column) -> Column:
    """Whether the quote is in the content, white space aside."""
    return F.contains(collapse_spaces(content), collapse_spaces(quote))


def excerpt(content: Column, limit: int = QUOTE_CHARS) -> Column:
    return F.substring(F.regexp_replace(content, r"(?U)^\s+", ""), 1, limit)


def amendment_marks(content: Column) -> Column:
    """Distinct marks in order, without brackets."""
    return F.transform(F.array_distinct(F.regexp_extract_all(content, F.lit(AMENDED), F.lit(0))), lambda m: F.substring(m, F.lit(2), F.length(m) - 2))


def unsupported_codes(answers: DataFrame, evidence: DataFrame, *, question: str = "question_id", answer: str = "answer") -> DataFrame:
    """Rows (question, code) of codes in an answer that no single field of its evidence names. Fields are never joined:
    a code must be within one. A question's evidence is small, so both meet by the question."""
    spans = codes.drop_contained(codes.code_spans(answers, question, answer), question)
    said = spans.join(answers.select(question, answer), question)
    said = said.select(question, F.expr(f"substring({answer}, start + 1, end - start)").alias("code"))
    said = said.withColumn("__key", code_key(F.col("code"))).distinct()
    fields = F.array(*(code_key(F.coalesce(F.col(c), F.lit(""))) for c in ("content", "code", "title", "article")))
    there = evidence.select(question, F.explode(fields).alias("__field")).where("__field <> ''").distinct()
    return said.join(there, (said[question] == there[question]) & F.contains(F.col("__field"), F.col("__key")), "left_anti").select(question, "code")


def citations(payloads: DataFrame, evidence: DataFrame, *, question: str = "question_id") -> DataFrame:
    """Rows (question, ord, citation_id, document, title, article, quote, amendments) of valid answers.

    A quote that is not in its own evidence is replaced by the start of that evidence. payloads: question, payload.
    """
    used = payloads.where("payload.valid and payload.found").select(question, F.posexplode(cited_ids(F.col("payload.answer"))).alias("ord", "citation_id"), "payload.passages")
    quotes = used.withColumn("quote", F.get(F.filter("passages", lambda p: p["id"] == F.col("citation_id")), F.lit(0))["quote"]).drop("passages")
    rows = quotes.join(evidence, [question, "citation_id"])
    shown = F.when(literal(F.col("quote"), F.col("content")), F.col("quote")).otherwise(excerpt(F.col("content")))
    return rows.select(question, "ord", "citation_id", F.col("code").alias("document"), "title", "article", shown.alias("quote"), amendment_marks(F.col("content")).alias("amendments"))


def problem(payload: Column, known: Column) -> Column:
    """Why an answer may not be published; null if it may, or says honestly that it found nothing."""
    used = cited_ids(payload["answer"])
    named = F.transform(payload["passages"], lambda p: p["id"])
    return (
        F.when(~payload["valid"], "invalid_payload")
        .when(~payload["found"], None)
        .when(F.size(used) == 0, "missing_citation")
        .when(F.size(F.array_except(used, known)) > 0, "unknown_citation")
        .when((F.size(F.array_distinct(named)) != F.size(named)) | (F.array_sort(named) != F.array_sort(used)), "passages_mismatch")
    )


def outcomes(attempts: DataFrame, unsupported: DataFrame, *, question: str = "question_id") -> DataFrame:
    """Rows (question, status, attempt) from up to two attempts: question, attempt, payload, known.

    A refusal or an invalid first answer ends it. A second attempt counts only if the first cited codes that are not in
    the evidence; if it does too, the answer is refused. unsupported: question, attempt.
    """
    bad = unsupported.select(question, "attempt").distinct().withColumn("__bad", F.lit(True))
    rows = attempts.join(bad, [question, "attempt"], "left").withColumn("__problem", problem(F.col("payload"), F.col("known")))
    status = (
        F.when(F.col("__problem").isNotNull(), F.col("__problem"))
        .when(~F.col("payload.found"), "not_found")
        .when(F.col("__bad"), "ungrounded_reference")
        .otherwise("answered")
    )
    rows = rows.withColumn("status", status)
    first = Window.partitionBy(question).orderBy("attempt")
    rows = rows.withColumn("__n", F.row_number().over(first)).withColumn("__retry", F.lag("status").over(first) == "ungrounded_reference")
    ended = rows.where((F.col("__n") == 1) | ((F.col("__n") == 2) & F.col("__retry")))
    last = Window.partitionBy(question).orderBy(F.desc("__n"))
    return ended.withColumn("__last", F.row_number().over(last)).where("__last = 1").select(question, "status", "attempt")


def prompt(evidence: DataFrame, questions: DataFrame, instructions: str, *, question: str = "question_id") -> DataFrame:
    """Rows (question, prompt): instructions, the question, and its evidence as JSON that cannot close a tag."""
    item = F.struct("seq", F.struct("citation_id", "code", "title", "article", "content").alias("e"))
    listed = evidence.groupBy(question).agg(F.array_sort(F.collect_list(item)).alias("items"))
    body = escape_json(F.to_json(F.struct(F.col("text").alias("question"), F.transform("items", lambda i: i["e"]).alias("evidence"))))
    return questions.join(listed, question).select(question, F.concat_ws("\n\n", F.lit(instructions), body).alias("prompt"))


def retry_prompt(first: Column, unsupported: Column, note: str) -> Column:
    """The prompt of the second attempt: the first one, and a note with the codes that the evidence does not name, as
    JSON that cannot close a tag."""
    return F.concat_ws("\n\n", first, F.lit(note), escape_json(F.to_json(F.array_sort(unsupported))))


def tool_input(response: Column, tool: str) -> Column:
    """(payload, problem) of a model's response, a JSON text: the input of its only block, which must be a call of the
    tool with an object as input. ``problem`` is truncated or invalid_response; the payload is null then."""
    blocks = F.from_json(F.get_json_object(response, "$.content"), "array<string>")
    block = F.get(blocks, F.lit(0))
    given = F.get_json_object(block, "$.input")
    called = (F.get_json_object(block, "$.type") == "tool_use") & (F.get_json_object(block, "$.name") == tool) & given.startswith("{")
    problem_ = F.when(F.get_json_object(response, "$.stop_reason") == "max_tokens", "truncated").when(~F.coalesce((F.size(blocks) == 1) & called, F.lit(False)), "invalid_response")
    return F.struct(F.when(problem_.isNull(), given).alias("payload"), problem_.alias("problem"))


def diagnostic_code(payload: Column, known: Column) -> Column:
    """``problem`` with an empty answer told apart, for logs that may hold no text of an answer; null if it is sound."""
    empty = payload["valid"] & payload["found"] & (F.length(collapse_spaces(F.regexp_replace(payload["answer"], r"\[[Cc][1-9][0-9]*\]", ""))) == 0)
    return F.when(empty, "empty_answer").otherwise(problem(payload, known))


def with_notice(answer: Column, truncated: Column, notice: str) -> Column:
    return F.when(truncated, F.concat_ws("\n\n", answer, F.lit(notice))).otherwise(answer)


def _letter_grams(c: Column) -> Column:
    """The distinct runs of one, two and three characters of a word."""
    return F.array_distinct(F.flatten(F.array(*(F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in (1, 2, 3)))))


def _texts_of_short_quotes(words: DataFrame, quotes: DataFrame, *, text_id: str, quote_id: str) -> DataFrame:
    """Rows (text_id, quote_id) of texts with a word that holds a quote of one word, or the longer word of a quote of two.

    words: the distinct words __x of each text. quotes: quote_id and their words __w. The distinct words of all texts are
    an index by runs of three characters (fewer where the quote's word has fewer); of a quote's runs the one that fewest
    words have leads to its words, and only these lead to texts.
    """
    second = F.get("__w", F.lit(1))
    first = F.get("__w", F.lit(0))
    last = F.coalesce(F.length(second) > F.length(first), F.lit(False))
    asked = quotes.select(quote_id, F.when(last, second).otherwise(first).alias("__p"), F.when(second.isNull(), "in").when(last, "start").otherwise("end").alias("__side"))
    size = F.least(F.length("__p"), F.lit(3))
    grams = asked.select(quote_id, "__p", "__side", F.explode(F.filter(_letter_grams(F.col("__p")), lambda g: F.length(g) == size)).alias("__g"))
    index = words.select("__x").distinct().select("__x", F.explode(_letter_grams(F.col("__x"))).alias("__g")).join(grams.select("__g").distinct(), "__g", "left_semi")
    counted = grams.join(index.groupBy("__g").agg(F.count(F.lit(1)).alias("__n")), "__g", "left")
    rarest = counted.groupBy(quote_id, "__p", "__side").agg(F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), F.col("__g"))).alias("r"))
    fits = F.when(F.col("__side") == "in", F.contains("__x", "__p")).when(F.col("__side") == "start", F.startswith("__x", "__p")).otherwise(F.endswith("__x", "__p"))
    found = index.join(rarest.select(quote_id, "__p", "__side", F.col("r.__g").alias("__g")), "__g").where(fits).select(quote_id, "__x")
    return words.join(found, "__x").select(text_id, quote_id)


def containing(texts: DataFrame, quotes: DataFrame, *, text_id: str, text: str, quote_id: str, quote: str) -> DataFrame:
    """Rows (text_id, quote_id) of texts that hold a quote, white space aside.

    The words of a quote but the first and the last are whole words of any text that holds it, so an equi-join on up
    to three of them finds the candidates. Quotes of one or two words find theirs by the words that hold their rarest
    run of characters. The text itself is checked for candidates only; empty quotes are in none.
    """
    t = texts.select(text_id, collapse_spaces(F.col(text)).alias("__t"))
    q = quotes.select(quote_id, collapse_spaces(F.col(quote)).alias("__q")).where("__q <> ''").withColumn("__w", F.split("__q", " "))
    size = F.least(F.size("__w") - 2, F.lit(3))
    anchor = lambda words, start, n: F.xxhash64(F.lit(n), F.slice(words, start, n))
    named = F.when(size == 3, anchor("__w", F.lit(2), 3)).when(size == 2, anchor("__w", F.lit(2), 2)).when(size == 1, anchor("__w", F.lit(2), 1))
    anchored = q.withColumn("__a", named)
    cut = t.select(text_id, F.split("__t", " ").alias("__w"))
    at = cut.select(text_id, "__w", F.posexplode("__w").alias("__i", "__x"))
    grams = at.select(text_id, F.explode(F.array(*(anchor("__w", F.col("__i") + 1, n) for n in (1, 2, 3)))).alias("__a"))
    hits = grams.join(anchored.where("__a is not null").select(quote_id, "__a"), "__a").select(text_id, quote_id)
    words = cut.select(text_id, F.explode(F.array_distinct("__w")).alias("__x")).where("__x <> ''")
    short = _texts_of_short_quotes(words, anchored.where("__a is null").select(quote_id, "__w"), text_id=text_id, quote_id=quote_id)
    checked = hits.unionByName(short).distinct().join(t, text_id).join(anchored.select(quote_id, "__q"), quote_id).where(F.contains("__t", "__q"))
    return checked.select(text_id, quote_id)
