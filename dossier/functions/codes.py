"""Codes of regulations in free text: spans, aliases, articles."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions.normalize import alias_key

# What counts as a code, and words that make a number a part of a document instead.
TAIL = r"\d+(?:\s?[./-]\s?\d+)*"
CODE_PATTERNS = (
    rf"(?i:\bSTAS\s*-?\s*{TAIL})",
    rf"(?i:\bSR(?:\s+EN)?(?:\s+ISO)?(?:\s+IEC)?\s+{TAIL})",
    rf"(?i:\bEN(?:\s+ISO)?(?:\s+IEC)?\s+{TAIL})",
    rf"(?i:\bNP\s*-?\s*{TAIL})",
    rf"\bP\s*-?\s*\d+\s?[./-]\s?{TAIL}",
    rf"\bI\s*-?\s*\d+\s?[./-]\s?{TAIL}",
    rf"\bC\s*-?\s*\d+\s?[./-]\s?{TAIL}",
    rf"(?i:\bNE\s*-?\s*{TAIL})",
    rf"(?i:\bG[PT]\s*-?\s*{TAIL})",
    rf"(?i:\bMc\s*-?\s*{TAIL})",
)
STRUCTURE_WORDS = ("ANEXA", "ANEXE", "CAPITOLUL", "CAPITOL", "TABELUL", "TABEL", "FIGURA", "PARTEA", "SECTIUNEA", "SECȚIUNEA", "PUNCTUL", "LITERA", "POZITIA", "POZIȚIA")
ARTICLE_PART = r"(?:[0-9a-z]+|\(\s*[0-9a-z]+\s*\))"
MARKED_ARTICLE = rf"(?iU)\b(?:articolul|art\.)\s*([0-9]+(?:\s*\.\s*{ARTICLE_PART})*\s*\.?)"
UNMARKED_ARTICLE = rf"(?iU)(?<![0-9a-z.])([0-9]+(?:\s*\.\s*{ARTICLE_PART}){{2,}}\s*\.?)(?![0-9a-z.])"
ANNEX = r"(?iU)\banexa\s*([0-9]+(?:\s*\.\s*[0-9]+)*\s*\.?)"
ALIAS_SEPARATOR = r"[ \t\n\r\f\x0b\u00a0\u202f/-]*"

#: Aliases go to every task up to so many, so that the runs of words, many times the questions, are not moved.
BROADCAST_ALIASES = 100_000

_PATTERNS = tuple(map(re.compile, CODE_PATTERNS))
_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyzĂÂÎȘȚăâîșț")


def _word_before(text: str, at: int) -> str:
    """The word that ends before a place, whatever white space is between."""
    end = at
    while end and text[end - 1].isspace():
        end -= 1
    start = end
    while start and text[start - 1] in _LETTERS:
        start -= 1
    return text[start:end]


def code_spans(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, start, end) of every match of every pattern, unless a word of structure stands just before it.

    Overlapping matches of different patterns are all here; ``drop_contained`` keeps the widest. An Arrow batch at a
    time: the ten patterns need Python's notion of word characters.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, t in zip(batch["k"], batch["t"], strict=True):
                for m in (m for p in _PATTERNS for m in p.finditer(t or "")):
                    if _word_before(t, m.start()).upper() not in STRUCTURE_WORDS:
                        rows.append((k, m.start(), m.end()))
            yield pd.DataFrame(rows, columns=["k", "start", "end"])

    kind = texts.schema[key].dataType.simpleString()
    found = texts.select(texts[key].alias("k"), texts[text].alias("t")).mapInPandas(scan, f"k {kind}, start int, end int")
    return found.select(F.col("k").alias(key), "start", "end")


def drop_contained(spans: DataFrame, key: str) -> DataFrame:
    """Spans that no other span of the key contains; of equal ones, one. A running maximum of the ends replaces the
    self-join: by start, and longest first, a span is contained if an earlier one reaches its end."""
    earlier = Window.partitionBy(key).orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    seen = spans.withColumn("reach", F.max("end").over(earlier))
    return seen.where(F.col("reach").isNull() | (F.col("reach") < F.col("end"))).drop("reach")


def uncovered(spans: DataFrame, covers: DataFrame, key: str) -> DataFrame:
    """Spans that no cover contains; rows of one key meet by an equi-join."""
    c = covers.select(F.col(key).alias("__k"), F.col("start").alias("__s"), F.col("end").alias("__e"))
    inside = (F.col(key) == F.col("__k")) & (F.col("__s") <= F.col("start")) & (F.col("end") <= F.col("__e"))
    return spans.join(c, inside, "left_anti")


def colliding_keys(spans: DataFrame, key: str, owner: str) -> DataFrame:
    """Keys with two overlapping spans of different owners; empty spans overlap nothing.

    By start, the earlier span with the farthest end tells: if it is of another owner and ends beyond this start, the
    two collide. If it is of the same owner while a shorter one of another owner collides, those two earlier spans
    overlap each other at this start, so the first of all collisions is always seen.
    """
    before = Window.partitionBy(key).orderBy("start", "end", owner).rowsBetween(Window.unboundedPreceding, -1)
    farthest = F.max(F.struct("end", F.col(owner).alias("o"))).over(before)
    rows = spans.where(F.col("end") > F.col("start")).withColumn("__far", farthest)
    return rows.where((F.col("__far.end") > F.col("start")) & (F.col("__far.o") != F.col(owner))).select(key).distinct()


def alias_variants(code: Column) -> Column:
    """The code, its letters and digits, and those without a final year; each once, in this order."""
    compact = F.array_join(F.regexp_extract_all(code, F.lit(r"[A-Za-z]+|\d+"), F.lit(0)), "")
    parts = F.regexp_extract_all(code, F.lit(r"[A-Za-z]+|\d+"), F.lit(0))
    last = F.try_element_at(parts, F.lit(-1))
    short = F.when((F.size(parts) > 1) & last.rlike(r"^\d{4}$"), F.array_join(F.slice(parts, 1, F.size(parts) - 1), ""))
    return F.array_compact(F.array_distinct(F.array(code, compact, short)))


def alias_pattern(alias: Column) -> Column:
    """A Java pattern of the alias: parts with any separators between, numbers with any leading zeros."""
    parts = F.regexp_extract_all(F.lower(alias), F.lit("[a-z]+|[0-9]+"), F.lit(0))
    flexible = F.transform(parts, lambda p: F.when(p.rlike("^0+$"), "0+").when(p.rlike("^[0-9]"), F.concat(F.lit("0*"), F.regexp_replace(p, "^0+", ""))).otherwise(p))
    return F.concat(F.lit("(?i)(?<![a-z0-9])"), F.array_join(flexible, ALIAS_SEPARATOR), F.lit("(?![a-z0-9])"))


def _alias_parts(alias: Column) -> Column:
    return F.regexp_extract_all(F.lower(alias), F.lit("[a-z]+|[0-9]+"), F.lit(0))


def whole_key(alias: Column) -> Column:
    """What an alias and every way to write it have in common: letters and digits in order, without separators and zeros."""
    return F.translate(F.array_join(_alias_parts(alias), ""), "0", "")


def most_words(aliases: DataFrame) -> int:
    """Into how many words the alias of most parts can be written."""
    return aliases.agg(F.max(F.size(_alias_parts(F.col("alias"))))).first()[0] or 0


def run_keys(text: Column, most: int, *, at_start: bool = False) -> Column:
    """The distinct whole keys of all runs of 1 to ``most`` words with nothing but separators between; ``at_start``: of
    those that begin the text. A text of n words has at most n times ``most``."""
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    gap = ALIAS_SEPARATOR.removesuffix("*") + "+"
    found = []
    for n in range(1, most + 1):
        run = rf"([a-z0-9]+(?:{gap}[a-z0-9]+){{{n - 1}}})(?![a-z0-9])"
        found.append(F.regexp_extract_all(lowered, F.lit(f"^{run}" if at_start else f"(?<![a-z0-9])(?={run})"), F.lit(1)))
    runs = F.flatten(F.array(*found)) if found else F.array().cast("array<string>")
    return F.array_distinct(F.transform(runs, lambda r: F.regexp_replace(r, "[^a-z1-9]", "")))


def meet(runs: DataFrame, named: DataFrame, run: str) -> DataFrame:
    """Rows of ``runs`` with the aliases of their whole key. Aliases are counted, for Spark takes tables made of lists as
    larger than any broadcast."""
    few = named.limit(BROADCAST_ALIASES + 1).count() <= BROADCAST_ALIASES
    return runs.join(F.broadcast(named) if few else named, run)


def alias_spans(questions: DataFrame, aliases: DataFrame, key: str, text: str, owner: str) -> DataFrame:
    """Rows (key, owner, start, end) where a question names an alias. A question meets an alias by an equi-join on its
    whole key, so that its candidates are bounded by its own words; the alias's pattern then decides."""
    asked = questions.select(key, text, F.explode(run_keys(F.col(text), most_words(aliases))).alias("__run"))
    named = aliases.select(owner, alias_pattern(F.col("alias")).alias("__p"), whole_key(F.col("alias")).alias("__run"))
    hits = meet(asked, named, "__run").withColumn("__m", F.expr(f"regexp_extract_all({text}, __p, 0)")).where(F.size("__m") > 0)
    # Lengths of what stands before each match give its place.
    split = hits.withColumn("__before", F.expr(f"split({text}, __p)"))
    placed = split.select(key, owner, F.posexplode("__m").alias("__i", "__hit"), "__before", "__m")
    lengths = lambda a: F.aggregate(F.transform(a, F.length), F.lit(0), lambda s, x: s + x)
    start = lengths(F.slice("__before", 1, F.col("__i") + 1)) + lengths(F.slice("__m", 1, F.col("__i")))
    return placed.select(key, owner, start.alias("start"), (start + F.length("__hit")).alias("end"))


def cited_articles(text: Column) -> Column:
    """Distinct keys of articles after a marker, then of annexes."""
    key = lambda a: F.regexp_replace(F.lower(F.translate(a, " \t\n\r\f\v\u00a0\u202f", "")), r"\.+$", "")
    marked = F.transform(F.regexp_extract_all(text, F.lit(MARKED_ARTICLE), F.lit(1)), key)
    annexes = F.transform(F.regexp_extract_all(text, F.lit(ANNEX), F.lit(1)), lambda a: F.concat(F.lit("anexa"), key(a)))
    return F.array_distinct(F.concat(marked, annexes))


def unmarked_articles(text: Column) -> Column:
    key = lambda a: F.regexp_replace(F.lower(F.translate(a, " \t\n\r\f\v\u00a0\u202f", "")), r"\.+$", "")
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(UNMARKED_ARTICLE), F.lit(1)), key))


def restriction(text: Column) -> Column:
    """What follows the first directive to use one document only; null without one or after ``nu doar din``.

    The directive is matched literally: its case and its single spaces count.
    """
    pattern = r"(?Us)(?<!\w)(nu doar din|doar din|numai din|exclusiv din) (.*)$"
    word = F.regexp_extract(text, pattern, 1)
    return F.when((word != "") & (word != "nu doar din"), F.regexp_extract(text, pattern, 2))


__all__ = [n for n in dir() if not n.startswith("_")] + ["alias_key"]
