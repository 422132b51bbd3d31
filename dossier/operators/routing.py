"""From a question to a route: which documents it names, which article, and how to look it up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions import codes
from dossier.functions.normalize import alias_key, article_key, collapse_spaces

QUESTION_CHARS, CONTEXT_TURNS, CONTEXT_CODES, CODE_CHARS = 1000, 3, 4, 64
#: Asked keys are broadcast up to so many (about 40 bytes each), by their first LEVELS parts and one more.
BROADCAST_KEYS, LEVELS = 100_000, 8


def catalogue(documents: DataFrame, chunks: DataFrame, *, document: str = "document_id", status: str = "status", article: str = "article") -> DataFrame:
    """Rows (document, article) of approved documents, each once."""
    approved = documents.where(F.col(status) == "approved").select(document)
    return chunks.join(approved, document).select(document, article).distinct()


def is_known(candidates: DataFrame, articles: DataFrame, *, article: str = "article", document: str | None = None) -> DataFrame:
    """Candidates that are known articles or have known children. A known article's ancestors are listed once, so the
    prefix test is an equi-join."""
    parts = F.split(F.col(article), r"\.")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    keys = [document] if document else []
    known = articles.select(*keys, F.explode(up).alias(article)).distinct()
    return candidates.join(known, [*keys, article], "left_semi")


def _below(chunks: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """Rows of ``chunks`` with ``__asked``: each asked key that a chunk's key is, or lies below.

    Up to BROADCAST_KEYS asked keys go to every task, a table for each depth they have, so that chunks are read once,
    moved nowhere, and multiplied only by what they meet. Keys of more than LEVELS parts meet by their first ones, and
    then by the whole. More asked keys than that meet the ancestors of chunks by a shuffle.
    """
    keys = asked.where("asked is not null").select(F.col("asked").alias("__asked")).distinct()
    parts = lambda k: F.length(k) - F.length(F.replace(F.col(k), F.lit("."), F.lit(""))) + 1
    is_below = (F.col(key) == F.col("__asked")) | F.startswith(F.col(key), F.concat("__asked", F.lit(".")))
    depth = F.least(parts("__asked"), F.lit(LEVELS + 1))
    keys = keys.withColumn("__depth", depth).withColumn("__start", F.substring_index("__asked", ".", LEVELS + 1))
    if keys.limit(BROADCAST_KEYS + 1).count() > BROADCAST_KEYS:
        ups = F.transform(F.sequence(F.lit(1), F.least(parts(key), F.lit(LEVELS + 1))), lambda n: F.struct(n.alias("n"), F.call_function("substring_index", F.col(key), F.lit("."), n).alias("up")))
        levels = chunks.withColumn("__up", F.explode(ups))
        same = (F.col("__up.up") == F.col("__start")) & (F.col("__up.n") == F.col("__depth"))
        return levels.join(keys, same & is_below).drop("__up", "__depth", "__start")
    found = chunks.withColumn("__met", F.array().cast("array<string>"))
    for (n,) in sorted(keys.select("__depth").distinct().collect()):  # LEVELS + 1 rows at most
        level = keys.where(F.col("__depth") == n).groupBy(F.col("__start").alias("__up")).agg(F.collect_list("__asked").alias("__here"))
        found = found.join(F.broadcast(level), F.substring_index(F.col(key), ".", n) == F.col("__up"), "left")
        found = found.withColumn("__met", F.concat("__met", F.coalesce("__here", F.array().cast("array<string>")))).drop("__up", "__here")
    return found.where(F.size("__met") > 0).withColumn("__asked", F.explode("__met")).drop("__met").where(is_below)


def exact_or_children(chunks: DataFrame, questions: DataFrame, *, key: str, question: str, order: list[str]) -> DataFrame:
    """Chunks of the asked key; only if no document has it, those below it. Rows (question, seq, columns of chunks).

    ``questions`` has (question, asked, document), where a null document means any. A null asked key or chunk key finds
    nothing.
    """
    found = _below(chunks, questions, key)
    asked = questions.select(F.col(question).alias("__q"), F.col("asked").alias("__key"), F.col("document").alias("__doc"))
    found = found.join(asked, (F.col("__asked") == F.col("__key")) & (F.col("__doc").isNull() | (F.col("__doc") == F.col("document"))))
    exact = found.withColumn("__exact", F.col(key) == F.col("__asked"))
    exact = exact.withColumn("__any", F.max("__exact").over(Window.partitionBy("__q")))
    kept = exact.where(F.col("__exact") | ~F.col("__any"))
    kept = kept.withColumn("seq", F.row_number().over(Window.partitionBy("__q").orderBy(*order)))
    return kept.withColumnRenamed("__q", question).drop("__key", "__asked", "__doc", "__exact", "__any")


def valid_question(text: Column, limit: int = QUESTION_CHARS) -> Column:
    return F.coalesce((F.length(collapse_spaces(text)) > 0) & (F.length(text) <= limit), F.lit(False))


def recent_context(turns: Column, n: int = CONTEXT_TURNS) -> Column:
    """The last turns."""
    return F.slice(turns, F.greatest(F.lit(1), F.size(turns) - n + 1), n)


def usable_codes(found: Column, most: int = CONTEXT_CODES, limit: int = CODE_CHARS) -> Column:
    """The first codes of a turn, without those of a wrong length."""
    return F.filter(F.slice(found, 1, most), lambda c: (F.length(c) >= 1) & (F.length(c) <= limit))


def documents_of_codes(found: DataFrame, aliases: DataFrame, *, code: str = "code") -> DataFrame:
    """Rows of ``found`` with ``documents``: all approved documents the code may mean, none for an unknown code."""
    by_key = aliases.groupBy(alias_key(F.col("alias")).alias("__key")).agg(F.array_sort(F.collect_set("document_id")).alias("documents"))
    joined = found.withColumn("__key", alias_key(F.col(code))).join(by_key.where("__key is not null"), "__key", "left").drop("__key")
    return joined.withColumn("documents", F.coalesce("documents", F.array().cast("array<string>")))


def parse(questions: DataFrame, aliases: DataFrame, articles: DataFrame, *, question: str = "question_id", text: str = "text") -> DataFrame:
    """Rows (question, document_id, article, is_marked, needs_clarification).

    In this order: a code that no approved alias covers, or aliases of two documents that overlap, need clarification;
    so do two different marked articles, and one article with two documents. Without a marker, a number of three parts
    or more is an article only if the catalogue knows it. Numbers alone are never guessed at.
    """
    base = questions.select(question, text)
    named = codes.alias_spans(base, aliases, question, text, "document_id")
    spans = codes.drop_contained(codes.code_spans(base, question, text), question)
    unknown = codes.uncovered(spans, named, question).select(question).distinct().withColumn("unknown", F.lit(True))
    collide = codes.colliding_keys(named, question, "document_id").withColumn("collide", F.lit(True))
    docs = named.groupBy(question).agg(F.countDistinct("document_id").alias("n_docs"), F.min("document_id").alias("doc"))
    rows = base.withColumn("cited", codes.cited_articles(F.col(text))).withColumn("loose", codes.unmarked_articles(F.col(text)))
    rows = rows.join(docs, question, "left").join(unknown, question, "left").join(collide, question, "left")
    rows = rows.withColumn("document_id", F.when(F.col("n_docs") == 1, F.col("doc")))
    loose = rows.select(question, "document_id", F.explode("loose").alias("article"))
    inside = is_known(loose.where("document_id is not null"), articles, document="document_id")
    anywhere = is_known(loose.where("document_id is null"), articles)
    known = inside.unionByName(anywhere).groupBy(question).agg(F.collect_set("article").alias("known"))
    rows = rows.join(known, question, "left")
    stop = F.coalesce("unknown", F.lit(False)) | F.coalesce("collide", F.lit(False))
    marked = F.size("cited") > 0
    found = F.when(marked, F.col("cited")).otherwise(F.coalesce("known", F.array().cast("array<string>")))
    many_docs = F.coalesce(F.col("n_docs") > 1, F.lit(False))
    unclear = stop | (F.size(found) > 1) | ((F.size(found) == 1) & many_docs)
    return rows.select(
        question,
        F.when(stop | ((F.size(found) == 1) & many_docs), None).otherwise(F.col("document_id")).alias("document_id"),
        F.when(~unclear, F.get(found, F.lit(0))).alias("article"),
        (marked & ~unclear).alias("is_marked"),
        unclear.alias("needs_clarification"),
    )


def restricted_documents(questions: DataFrame, aliases: DataFrame, articles: DataFrame, *, question: str = "question_id", text: str = "text") -> DataFrame:
    """Rows (question, documents) of questions that ask for one document only, by an alias right after the directive.

    An alias counts if no further number follows, unless that number is a known article of its document. No document
    means the code is not approved.
    """
    asked = questions.select(question, codes.restriction(F.col(text)).alias("rest")).where("rest is not null")
    named = aliases.select("document_id", codes.alias_pattern(F.col("alias")).alias("p"), codes.whole_key(F.col("alias")).alias("run"))
    runs = codes.run_keys(F.col("rest"), codes.most_words(aliases), at_start=True)
    pairs = codes.meet(asked.select("*", F.explode(runs).alias("run")), named, "run").drop("run")
    pairs = pairs.withColumn("hit", F.expr("regexp_extract(rest, concat('^(?:', p, ')'), 0)")).where("hit <> ''")
    pairs = pairs.withColumn("after", F.expr("substring(rest, length(hit) + 1)"))
    number = F.regexp_extract("after", rf"(?iU)^[ \t\n\r\f\x0b  ]+([0-9]+(?:\s*\.\s*{codes.ARTICLE_PART}){{2,}}\s*\.?)(?![0-9a-z.])", 1)
    pairs = pairs.withColumn("article", article_key(number)).withColumn("more", F.col("after").rlike(rf"^{codes.ALIAS_SEPARATOR}[0-9]"))
    plain = pairs.where(~F.col("more")).select(question, "document_id")
    suffixed = is_known(pairs.where("more").select(question, "document_id", "article"), articles, document="document_id").select(question, "document_id")
    found = plain.unionByName(suffixed).groupBy(question).agg(F.array_sort(F.collect_set("document_id")).alias("documents"))
    return asked.select(question).join(found, question, "left").withColumn("documents", F.coalesce("documents", F.array().cast("array<string>")))


def route(restricted: Column, needs_clarification: Column, article: Column) -> Column:
    """``restricted``: null without a directive, else the documents it allows."""
    return (
        F.when(restricted.isNotNull() & (F.size(restricted) != 1), "ambiguous_reference")
        .when(needs_clarification, "ambiguous_reference")
        .when(article.isNotNull(), "exact")
        .otherwise("semantic")
    )
