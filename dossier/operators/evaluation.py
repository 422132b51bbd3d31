"""Scores of retrieval and of answers against gold sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TYPES = ("exact", "semantic", "negative")
REFUSALS = ("not_found", "ambiguous_article", "ambiguous_reference")


def matches(article: Column, expected: Column) -> Column:
    """The article itself, or one below it by a dot or a bracket."""
    return (article == expected) | article.startswith(F.concat(expected, F.lit("."))) | article.startswith(F.concat(expected, F.lit("(")))


def first_rank(hits: DataFrame, expected: DataFrame, *, case: str = "case_id") -> DataFrame:
    """Rows (case, rank): the best place of a hit that matches any expectation. hits: case, document_id, article,
    rank; expected: case, document_id, article."""
    e = expected.select(case, "document_id", F.col("article").alias("__e"))
    found = hits.join(e, [case, "document_id"]).where(matches(F.col("article"), F.col("__e")))
    return found.groupBy(case).agg(F.min("rank").alias("rank"))


def judged(cases: DataFrame, ranks: DataFrame, *, case: str = "case_id") -> DataFrame:
    """Add rank, found and correct. A negative case is right if it was refused, any other if it found a match."""
    rows = cases.join(ranks, case, "left").withColumn("found", F.col("rank").isNotNull())
    refused = F.col("status").isin(*REFUSALS)
    return rows.withColumn("correct", F.when(F.col("type") == "negative", refused).otherwise((F.col("status") == "found") & F.col("found")))


def ratio(part: Column, whole: Column) -> Column:
    """0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def accuracy(results: DataFrame) -> DataFrame:
    """One row: cases, correct, accuracy, recall_at_1, recall_at_5 over the cases that have an answer."""
    positive = F.col("type") != "negative"
    return results.agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if("correct").alias("correct"),
        ratio(F.count_if("correct"), F.count(F.lit(1))).alias("accuracy"),
        ratio(F.count_if(positive & (F.col("rank") <= 1)), F.count_if(positive)).alias("recall_at_1"),
        ratio(F.count_if(positive & (F.col("rank") <= 5)), F.count_if(positive)).alias("recall_at_5"),
    )


def accuracy_by_type(results: DataFrame) -> DataFrame:
    """A row for each type, also for those without cases."""
    types = results.sparkSession.createDataFrame([(t,) for t in TYPES], "type string")
    found = results.groupBy("type").agg(F.count(F.lit(1)).alias("cases"), F.count_if("correct").alias("correct"))
    rows = types.join(found, "type", "left").na.fill(0, ["cases", "correct"])
    return rows.withColumn("accuracy", ratio(F.col("correct"), F.col("cases")))


def accuracy_by_document(results: DataFrame, expected: DataFrame, *, case: str = "case_id") -> DataFrame:
    """A case counts once for each of its expectations."""
    rows = expected.select(case, "document_id").join(results.select(case, "correct"), case)
    found = rows.groupBy("document_id").agg(F.count(F.lit(1)).alias("cases"), F.count_if("correct").alias("correct"))
    return found.withColumn("accuracy", ratio(F.col("correct"), F.col("cases")))


def distribution(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


GENERATION_ERROR = "generation_error:"


def generation_summary(cases: DataFrame) -> DataFrame:
    """One row: answers, and of them how many cite what was expected, say that something is missing, and quote
    literally; calls of the model; outcomes and errors (outcomes that begin with GENERATION_ERROR) with their numbers.

    cases: outcome (null ones count nowhere), cites_expected, says_missing, quotes_literal, calls. Outcomes are few.
    """
    answered = F.col("outcome") == "answered"
    totals = cases.agg(F.count_if(answered).alias("answers"), *(F.count_if(answered & F.col(c)).alias(c) for c in ("cites_expected", "says_missing", "quotes_literal")), F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"))
    counted = cases.where("outcome is not null").groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
    entries = F.array_sort(F.collect_list(F.struct("outcome", "n")))
    failed = F.filter(entries, lambda e: e["outcome"].startswith(GENERATION_ERROR))
    maps = counted.agg(F.map_from_entries(entries).alias("outcomes"), F.map_from_entries(failed).alias("errors"))
    return totals.crossJoin(maps)  # one row each


def visible_status(status: Column, outcome: Column) -> Column:
    """What a user sees: the answer only if it was generated and passed; otherwise why not."""
    return F.when(status != "found", status).when(outcome == "answered", "answered").when(outcome == "not_found", "not_found").otherwise("unsupported_answer")


def findings(cases: DataFrame) -> DataFrame:
    """Rows (case_id, finding) where a fixed candidate's outcome is not what was expected, or a required passage is
    missing. cases: case_id, expected_publishable, published, missing_passages."""
    kinds = F.array_compact(
        F.array(
            F.when(F.col("published") & ~F.col("expected_publishable"), "unsupported_accepted"),
            F.when(~F.col("published") & F.col("expected_publishable"), "supported_rejected"),
            F.when(F.col("published") & (F.size("missing_passages") > 0), "missing_passage"),
        )
    )
    return cases.select("case_id", F.explode(kinds).alias("finding"))


#: What may be wrong with a case of a grounding run, by its outcome and its required passages.
OUTCOME_FINDINGS = ("execution_error", "non_publishable_published", "publishable_rejected")
PASSAGE_FINDING = "relevant_passage_missing"


def passage_checks(required: DataFrame, citations: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Rows (case_id, citation_id, text, state), one for each required passage.

    required: case_id, citation_id, text. citations: case_id, id, quote, of published answers. outcomes: case_id, outcome,
    one row a case. A passage is ``present`` if a citation of its id holds its text, ``missing`` if an answer was published
    without, and ``not_observed`` if none was. The quotes of one citation are few, for an answer has few passages.
    """
    quotes = citations.groupBy("case_id", F.col("id").alias("citation_id")).agg(F.collect_list("quote").alias("__quotes"))
    rows = required.select("case_id", "citation_id", "text").join(outcomes.select("case_id", "outcome"), "case_id", "left").join(quotes, ["case_id", "citation_id"], "left")
    held = F.exists(F.coalesce("__quotes", F.array().cast("array<string>")), lambda q: F.coalesce(F.contains(q, F.col("text")), F.lit(False)))
    state = F.when(F.col("outcome") == "published", F.when(held, "present").otherwise("missing")).otherwise("not_observed")
    return rows.select("case_id", "citation_id", "text", state.alias("state"))


def case_findings(cases: DataFrame, checks: DataFrame) -> DataFrame:
    """Rows (case_id, kind, citation_id, text); the last two for missing passages only. cases: case_id, outcome, expected_publishable."""
    published = F.col("outcome") == "published"
    kind = (
        F.when(F.col("outcome") == "execution_error", OUTCOME_FINDINGS[0])
        .when(published & ~F.col("expected_publishable"), OUTCOME_FINDINGS[1])
        .when(~published & F.col("expected_publishable"), OUTCOME_FINDINGS[2])
    )
    none = F.lit(None).cast("string")
    own = cases.select("case_id", kind.alias("kind"), none.alias("citation_id"), none.alias("text")).where("kind is not null")
    lost = checks.where(F.col("state") == "missing").select("case_id", F.lit(PASSAGE_FINDING).alias("kind"), "citation_id", "text")
    return own.unionByName(lost)


def passage_states(cases: DataFrame, checks: DataFrame) -> DataFrame:
    """Rows (case_id, passage_state): the worst of a case's passages; ``not_applicable`` for a case that requires none."""
    worst = checks.groupBy("case_id").agg(F.bool_or(F.col("state") == "not_observed").alias("__unseen"), F.bool_or(F.col("state") == "missing").alias("__lost"))
    state = F.when(F.col("__unseen").isNull(), "not_applicable").when(F.col("__unseen"), "not_observed").when(F.col("__lost"), "missing").otherwise("present")
    return cases.select("case_id").join(worst, "case_id", "left").select("case_id", state.alias("passage_state"))


def grounding_summary(cases: DataFrame, found: DataFrame) -> DataFrame:
    """One row of a run's counts, and its exit code: 2 if a case could not run, else 1 if anything was found, else 0.

    cases: case_id, outcome, calls. found: ``case_findings``. Without cases all counts are 0.
    """
    each = found.groupBy("case_id").agg(F.count(F.lit(1)).alias("__n"), *(F.count_if(F.col("kind") == k).alias(k) for k in (*OUTCOME_FINDINGS, PASSAGE_FINDING)))
    rows = cases.select("case_id", "outcome", "calls").join(each, "case_id", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    counts = rows.agg(
        F.count(F.lit(1)).alias("total_cases"),
        F.count_if(F.col("__n") > 0).alias("cases_with_findings"),
        total("__n").alias("total_findings"),
        total("calls").alias("calls"),
        F.count_if(F.col("outcome") == "published").alias("published"),
        F.count_if(F.col("outcome") == "rejected").alias("typed_refusals"),
        F.count_if(F.col("outcome") == "not_found").alias("not_found"),
        *(total(k).alias(k) for k in (*OUTCOME_FINDINGS, PASSAGE_FINDING)),
    )
    return counts.withColumn("exit_code", F.when(F.col("execution_error") > 0, 2).when(F.col("total_findings") > 0, 1).otherwise(0))


def within_cap(calls: DataFrame, *, order: list[str], kind: str, caps: dict[str, int]) -> DataFrame:
    """Add allowed: whether a call is among the first of its kind, as many as the kind's cap; other kinds have none.

    ``order`` tells calls apart. Only the first calls of a kind are ranked, each task giving its own first ones; the
    last of them then decides for all, so no task holds a kind.
    """
    cap = F.create_map(*(F.lit(x) for pair in caps.items() for x in pair))
    place = F.struct(*order)
    capped = calls.where(F.col(kind).isin(*caps)).select(kind, place.alias("__place"))
    ranked = capped.withColumn("__n", F.row_number().over(Window.partitionBy(kind).orderBy("__place"))).where(F.col("__n") <= max(caps.values(), default=0))
    last = ranked.where(F.col("__n") <= F.try_element_at(cap, F.col(kind))).groupBy(kind).agg(F.max("__place").alias("__last"))
    rows = calls.join(F.broadcast(last), kind, "left")  # a row for each of ``caps`` at most
    return rows.withColumn("allowed", F.coalesce(place <= F.col("__last"), F.lit(False))).drop("__last").select(*calls.columns, "allowed")


def public_view(cases: DataFrame, hidden: tuple[str, ...] = ("question", "text", "chunk_id", "content_hash", "source_key")) -> DataFrame:
    return cases.drop(*hidden)
