"""From the text of a regulation to ordered chunks: lines, markers, segments, chunks, coverage.

Rows of one document are ordered by a number; a document is bounded, so windows and folds are per document.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from dossier.functions.normalize import article_key, coverage_text, fix_pdf_substitutions, is_article_key

# Shapes of lines and markers, and limits.
UPPER = "A-ZĂÂÎȘȚŞŢ"
HEADER = r"(?U)^\s*MONITORUL\s+OFICIAL\s+AL\s+ROM[ÂA]NIEI,\s*PARTEA\s+I,\s*Nr\.\s*.+$"
PAGE = r"^\d{1,4}$"
COLOPHON = r"(?mU)^\s*(?:„Monitorul Oficial” R\.A\.,|Tiparul:\s*„Monitorul Oficial” R\.A\.\s*$|Acest număr al Monitorului Oficial al României a fost tipărit în afara abonamentului\.)"
DOTTED_ENTRY = r"\.{4,}\s*\d{1,4}\s*$"
TITLE_ENTRY = r"(?U)^\s*\d+(?:\.\d+)*\.\s+\S.*$"
ROMAN_TITLE = r"(?U)^\s*[IVXLC]{1,6}\.\s+(.+?)\s*$"
CHAPTER_LINE, SECTION_LINE = r"(?U)^\s*Capitolul[ \t]+[IVXLC]+[ \t]+\S", r"(?U)^\s*Sec[țţ]iunea[ \t]+(?:a[ \t]+\d+-a|\d+)[ \t]+\S"
AFTER_PLUS = r"(?U)^\s*(?:Articolul[ \t]+\d|Capitolul[ \t]+[IVXLC]|Sec[țţ]iunea[ \t])"
MARKERS = {
    "dotted": r"\n\s*„?\s*(\d+\.\d+\.\s*\([A-Za-z]\)\.\s*(?:[IVXLl]\.|\d+\.)?(?:\d+\.)?|\d+\.\d+\.(?:\d+\.){0,4})",
    "art": rf"\n\s*„?\s*Art\.\s*(\d+\.\d+\.(?:\d+\.){{0,4}})\s*(?=[{UPPER}]|\()",
    "bare": rf"\n\s*„?\s*(\d+\.\d+(?:\.\d+){{0,4}})[ \t  ]+(?=[{UPPER}„(])",
    "articolul": rf"\n[ \t]*Articolul[ \t]+(\d+)[ \t]+(?=[{UPPER}„(])",
    "chapter": rf"\n\s*(\d{{1,2}}\.)[ \t]+([{UPPER}].*)",
    "annex": rf"(?m)\n[ \t]*ANEXA[ \t]+(?:(?:NR\.|Nr\.)[ \t]*)?(\d+(?:\.\d+)?(?:\.?\([A-Za-z]\))?(?:bis|[A-Za-z])?)\.?[ \t]*(?=[\-–]|[{UPPER}]|$)",
    "inner": rf"\n[ \t]*A\.\d+\.[ \t]*(\d+(?:\.\d+){{1,4}}\.)[ \t]+(?=[{UPPER}„(])",
}
BROKEN_WORDS = ("art.", "articolul", "alin.", "pct.", "lit.", "conform", "punctele", "punctul", "punctelor", "articolele", "articolelor", "prevederile", "prevederilor")
ANNEX_WORDS = ("și", "sau", "din", "la", "în")
LAST_WORD = r"(?:^|[^A-Za-zĂÂÎȘȚăâîșț])([A-Za-zĂÂÎȘȚăâîșț]+\.?)$"
SUBPOINT = r"(?U)\n\s*\((\d+)\)\s+"
PROVENANCE = r"\[(?:Articol cu text )?(Text modificat|Text introdus|Abrogat|modificat|introdus|abrogat) (prin Ordinul nr\. [^\]\n]{1,150})\]"
ART_DOCUMENT, MIN_CHUNK, SPLIT_AT, MAX_CHUNK = 50, 15, 2000, 1000
TOC_SHARE, TOC_ENTRIES, TOC_GAP, HEADER_REACH = 0.20, 5, 3, 3
TITLE_CHARS, CHAPTER_CHARS, COLOPHON_CHARS, MARK_CHARS, COVERAGE_CHARS = 200, 120, 4000, 200, 50


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def to_lines(texts: DataFrame, doc: str, text: str = "text") -> DataFrame:
    """Rows (doc, line_no, line, char_offset)."""
    lines = texts.select(doc, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    w = Window.partitionBy(doc).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("char_offset", F.coalesce(F.sum(F.length("line") + 1).over(w), F.lit(0)))


def from_lines(lines: DataFrame, doc: str) -> DataFrame:
    listed = lines.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    return listed.select(doc, F.array_join(F.col("l.line"), "\n").alias("text"))


def without_headers(lines: DataFrame, doc: str, header: Column | None = None, reach: int = HEADER_REACH) -> DataFrame:
    """No header lines, and no page numbers within ``reach`` lines of one with only blank lines and numbers between."""
    header = F.col("line").rlike(HEADER) if header is None else header
    bare = strip(F.col("line"))
    rows = lines.withColumn("__h", header).withColumn("__page", bare.rlike(PAGE)).withColumn("__other", ~F.col("__h") & (bare != "") & ~bare.rlike(PAGE))
    near = F.lit(False)
    for order in (F.col("line_no").asc(), F.col("line_no").desc()):
        w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("__n", F.sum(F.col("__other").cast("int")).over(w))
        last = F.last(F.when(F.col("__h"), F.struct("line_no", F.col("__n").alias("n"))), ignorenulls=True).over(w)
        name = f"__near{len(rows.columns)}"
        rows = rows.withColumn(name, F.coalesce((F.abs(F.col("line_no") - last["line_no"]) <= reach) & (last["n"] == F.col("__n")), F.lit(False)))
        near = near | F.col(name)
    return rows.where(~F.col("__h") & ~(F.col("__page") & near)).select(*lines.columns)


def without_colophon(text: Column) -> Column:
    """Cut at the printer's notice if one begins in the last characters, from a line's start."""
    at = F.greatest(F.length(text) - COLOPHON_CHARS, F.lit(0))
    tail = F.substring(text, at + 1, F.length(text))
    skip = F.when(F.instr(tail, "\n") > 0, F.instr(tail, "\n")).otherwise(0)
    tail = F.substring(tail, skip + 1, F.length(text))
    found = F.regexp_instr(tail, F.lit(COLOPHON))
    return F.when(found > 0, F.regexp_replace(F.substring(text, F.lit(1), at + skip + found - 1), r"\n+$", "")).otherwise(text)


def toc_blocks(lines: DataFrame, doc: str, entry: Column, span: int = 1, gap: int = TOC_GAP) -> DataFrame:
    """Rows (doc, block, entries, end): runs of entry lines with at most ``gap`` other lines that are not blank between
    one entry and the next. An entry takes ``span`` lines; ``end`` is the offset after the last entry."""
    w = Window.partitionBy(doc).orderBy("line_no")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    filled = F.sum((strip(F.col("line")) != "").cast("int")).over(so_far)
    rows = lines.withColumn("__filled", filled)
    ends = F.lead(F.struct((F.col("char_offset") + F.length("line") + 1).alias("end"), F.col("__filled").alias("filled")), span - 1).over(w)
    own = (strip(F.col("line")) != "").cast("int")
    rows = rows.withColumn("__end", ends).withColumn("__before", F.col("__filled") - own).withColumn("__entry", entry).where("__entry")
    new = F.coalesce((F.col("__before") - F.lag(F.col("__end.filled")).over(w) > gap).cast("int"), F.lit(0))
    rows = rows.withColumn("__new", new).withColumn("block", F.sum("__new").over(so_far))
    return rows.groupBy(doc, "block").agg(F.count(F.lit(1)).alias("entries"), F.max("__end.end").alias("end"))


def without_toc(texts: DataFrame, doc: str, text: str = "text") -> DataFrame:
    """Texts from after the table of contents: the first block of enough entries, of either style, early in the text."""
    lines = to_lines(texts, doc, text).join(texts.select(doc, F.floor(F.length(text) * TOC_SHARE).alias("__limit")), doc)
    early = F.col("char_offset") < F.col("__limit")
    following = F.lead(strip(F.col("line"))).over(Window.partitionBy(doc).orderBy("line_no"))
    lines = lines.withColumn("__next", following)
    dotted = toc_blocks(lines, doc, early & F.col("line").rlike(DOTTED_ENTRY))
    paged = toc_blocks(lines, doc, early & F.col("line").rlike(TITLE_ENTRY) & F.coalesce(F.col("__next").rlike(PAGE), F.lit(False)), span=2)
    cuts = None
    for blocks in (dotted, paged):
        first = blocks.where(F.col("entries") >= TOC_ENTRIES).groupBy(doc).agg(F.min_by("end", "block").alias("cut"))
        cuts = first if cuts is None else cuts.unionByName(first)
    cuts = cuts.groupBy(doc).agg(F.max("cut").alias("cut"))
    return texts.join(cuts, doc, "left").withColumn(text, F.substring(F.col(text), F.coalesce("cut", F.lit(0)).cast("int") + 1, F.length(text))).drop("cut")


def mostly_upper(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\p{Lu}")) * 2 > F.regexp_count(c, F.lit(r"\p{L}"))


def without_chapter_lines(lines: DataFrame, doc: str) -> DataFrame:
    """No Roman chapter titles in capitals, no chapter and section lines, no plus signs before one or an article."""
    after = Window.partitionBy(doc).orderBy("line_no").rowsBetween(1, Window.unboundedFollowing)
    following = F.first(F.when(strip(F.col("line")) != "", F.col("line")), ignorenulls=True).over(after)
    roman = F.col("line").rlike(ROMAN_TITLE) & mostly_upper(F.regexp_extract("line", ROMAN_TITLE, 1))
    kept = lines.where(~roman).withColumn("__next", F.coalesce(following, F.lit("")))
    plus = (strip(F.col("line")) == "+") & F.col("__next").rlike(AFTER_PLUS)
    return kept.where(~plus & ~F.col("line").rlike(CHAPTER_LINE) & ~F.col("line").rlike(SECTION_LINE)).drop("__next")


def _line_kinds(lines: Column) -> Column:
    """A sign for each line: header, blank, page number or other."""
    kind = lambda x: F.when(x.rlike(HEADER), "H").when(x.rlike(r"(?U)^\s*$"), "B").when(x.rlike(r"(?U)^\s*\d{1,4}\s*$"), "P").otherwise("O")
    return F.transform(lines, kind)


def _bare_lines(lines: Column, kinds: Column, reach: int = HEADER_REACH) -> Column:
    """``without_headers`` for an array of lines. ``kinds`` is a column of its own: within the filter it would be made
    anew for each line."""

    at = lambda i: F.get(kinds, i)

    def header_near(i: Column, step: int) -> Column:
        """Whether a header is within reach in one direction, with only blank lines and numbers before it."""
        found, clear = F.lit(False), F.lit(True)
        for k in range(1, reach + 1):
            kind = at(i + step * k)
            found = found | (clear & F.coalesce(kind == "H", F.lit(False)))
            clear = clear & F.coalesce(kind.isin("P", "B"), F.lit(False))
        return found

    def stays(_: Column, i: Column) -> Column:
        return F.when(at(i) == "H", False).when(at(i) == "P", ~(header_near(i, -1) | header_near(i, 1))).otherwise(True)

    return F.filter(lines, stays)


def _toc_end(text: Column, dotted: bool) -> Column:
    """Where the first table of contents of one style ends, as ``without_toc`` says; null without one. A fold over the
    lines, in order, and only of texts that hold enough entries."""
    span = 1 if dotted else 2
    lines = F.split(text, "\n")
    following = F.concat(F.slice(lines, 2, F.size(lines)), F.array(F.lit(None).cast("string")))
    blank = lambda c: c.rlike(r"(?U)^\s*$")
    early = F.floor(F.length(text) * TOC_SHARE).cast("long")  # once, in the state
    zero = F.struct(*(F.lit(0).cast("int").alias(n) for n in ("at", "entries", "end", "others", "skip")), F.lit(None).cast("int").alias("cut"), early.alias("early"))

    def step(a: Column, x: Column) -> Column:
        line, after = x["l"], x["n"]
        entry = line.rlike(DOTTED_ENTRY) if dotted else line.rlike(TITLE_ENTRY) & F.coalesce(after.rlike(r"(?U)^\s*\d{1,4}\s*$"), F.lit(False))
        entry = entry & (a["at"] < a["early"])
        stop = a["at"] + F.length(line) + 1
        end = stop if dotted else stop + F.length(after) + 1
        new = (a["others"] > TOC_GAP) & (a["entries"] > 0)
        closed = F.coalesce(a["cut"], F.when(new & (a["entries"] >= TOC_ENTRIES), a["end"]))
        counts = F.when(blank(line) | (a["skip"] > 0), 0).otherwise(1)
        return F.struct(
            stop.cast("int").alias("at"),
            F.when(entry & new, 1).when(entry, a["entries"] + 1).otherwise(a["entries"]).alias("entries"),
            F.when(entry, end).otherwise(a["end"]).cast("int").alias("end"),
            F.when(entry, 0).otherwise(a["others"] + counts).alias("others"),
            F.when(entry, span - 1).otherwise(F.greatest(a["skip"] - 1, F.lit(0))).alias("skip"),
            F.when(entry, closed).otherwise(a["cut"]).alias("cut"),
            a["early"].alias("early"),
        )

    found = F.aggregate(F.arrays_zip(lines.alias("l"), following.alias("n")), zero, step, lambda a: F.coalesce(a["cut"], F.when(a["entries"] >= TOC_ENTRIES, a["end"])))
    likely = r"(?m)\.{4,}\s*\d{1,4}\s*$" if dotted else r"(?mU)^\s*\d+(?:\.\d+)*\.\s+\S.*\n\s*\d{1,4}\s*$"
    return F.when(F.regexp_count(text, F.lit(likely)) >= TOC_ENTRIES, found)


def _other_lines(lines: Column) -> Column:
    """``without_chapter_lines`` for an array of lines: the text of those that stay. One pass of a pattern takes the plus
    signs, looking ahead over blank lines only."""
    some = F.filter(lines, lambda x: ~(x.rlike(ROMAN_TITLE) & mostly_upper(F.regexp_extract(x, ROMAN_TITLE, 1))))
    after = AFTER_PLUS.removeprefix(r"(?U)^\s*")
    plus = rf"(?mdU)^[^\S\n]*\+[^\S\n]*\n(?=(?:[^\S\n]*+\n)*+[^\S\n]*{after})"
    kept = F.split(F.regexp_replace(F.array_join(some, "\n"), plus, ""), "\n")
    return F.array_join(F.filter(kept, lambda x: ~x.rlike(CHAPTER_LINE) & ~x.rlike(SECTION_LINE)), "\n")


def clean_text(texts: DataFrame, doc: str, text: str = "text") -> DataFrame:
    """Everything that comes before markers are looked for. A document's lines are an array in its row, so that nothing
    is shuffled."""
    rows = texts.select(doc, F.split(fix_pdf_substitutions(F.col(text)), "\n").alias("lines")).withColumn("kinds", _line_kinds(F.col("lines")))
    rows = rows.select(doc, F.array_join(_bare_lines(F.col("lines"), F.col("kinds")), "\n").alias("text")).select(doc, without_colophon(F.col("text")).alias("text"))
    cut = F.greatest(_toc_end(F.col("text"), True), _toc_end(F.col("text"), False))
    rows = rows.select(doc, F.split(F.substring(F.col("text"), F.coalesce(cut, F.lit(0)) + 1, F.length("text")), "\n").alias("lines"))
    return rows.select(doc, _other_lines(F.col("lines")).alias("text"))


MATCH = ArrayType(StructType([StructField(n, IntegerType() if n in ("start", "stop", "num_stop") else StringType()) for n in ("kind", "start", "stop", "num", "num_stop", "title", "before", "after", "next")]))
_COMPILED = {k: re.compile(v) for k, v in MARKERS.items()}


def _reach(source: str, at: int, some: int = 130) -> int:
    """How far to look after a number: a suffix, and blanks after it or after a comma, of any length, and a few more."""
    suffix = re.compile(r"\S*").match(source, at).end()
    blanks = re.compile(r",?[ \t\u00a0\u202f]*").match(source, at).end()
    return max(suffix, blanks, at) + some


@F.pandas_udf(MATCH)
def marker_matches(texts: pd.Series) -> pd.Series:
    """Every match of every marker with what stands around it: the last filled line before, what follows the
    number, the next filled line. Spark has no positions of matches; what they mean is decided in columns."""
    out = []
    for t in texts:
        source, rows = "\n" + (t or ""), []
        starts, lines = [], []
        at = 0
        for line in source.split("\n"):
            if line.strip():
                starts.append(at)
                lines.append(line.strip())
            at += len(line) + 1
        for kind, pattern in _COMPILED.items():
            for m in pattern.finditer(source):
                i = bisect_left(starts, m.start() + 1)
                cut = source.rfind("\n", 0, m.start()) + 1
                partial = source[cut : m.start()].strip()
                newline = source.find("\n", m.end())
                j = bisect_left(starts, newline + 1) if newline >= 0 else len(starts)
                rows.append((kind, m.start(), m.end(), m[1], m.end(1), m[2].rstrip() if kind == "chapter" else None, partial or (lines[i - 1] if i else ""), source[m.end(1) : _reach(source, m.end(1))], lines[j] if j < len(lines) else None))
        out.append([dict(zip(("kind", "start", "stop", "num", "num_stop", "title", "before", "after", "next"), r, strict=True)) for r in rows])
    return pd.Series(out)


def is_broken(base: Column, before: Column, after: Column) -> Column:
    """Whether a number at a line's start is a reference that the extraction broke, not a marker."""
    spaced = F.regexp_replace(after, r"^[ \t  ]*", "")
    word = F.lower(F.regexp_extract(before, LAST_WORD, 1))
    comma = ~F.regexp_replace(F.substring(after, F.lit(2), F.length(after)), r"^[ \t  ]*", "").rlike(r"^(\n|$)")
    one_line = F.substring(F.substring_index(after, "\n", 1), 1, 120)
    return base.rlike(r"^\d+(?:\.\d+)*\.$") & F.when(word.isin(*BROKEN_WORDS), True).when(after.startswith(","), comma).when(spaced.rlike(r"^(\n|$)"), False).when(after.rlike(r"^\d"), True).when(
        spaced.rlike(rf"^[{UPPER}„(0-9]"), False
    ).otherwise(~(spaced.rlike("^[a-zăâîșțşţ]") & one_line.rlike("[-–]")))


def segments(texts: DataFrame, doc: str, text: str = "text") -> DataFrame:
    """Rows (doc, seg_no, article, base, title, text) of accepted markers, in order.

    Of markers that start together the longest number counts. Dates, broken references, annex titles of a table of
    contents or in mid-sentence, and chapter titles without a direct child next are none. In documents with many
    ``Art.`` markers bare numbers are none either, and annexes begin after the first accepted ``Art.``. Inside an
    annex, articles carry its name. A suffix glued to a number joins it, unless a capital begins a word there.
    """
    w = Window.partitionBy(doc).orderBy("start")
    rows = texts.select(doc, F.explode(marker_matches(text)).alias("m")).select(doc, "m.*")
    rows = rows.withColumn("__art", F.count_if(F.col("kind") == "art").over(Window.partitionBy(doc)))
    rows = rows.where((F.col("kind") != "bare") | (F.col("__art") < ART_DOCUMENT))
    base = F.when(strip(F.col("num")).endswith("."), strip(F.col("num"))).otherwise(F.concat(strip(F.col("num")), F.lit(".")))
    date = F.col("own").rlike(r"^(0[1-9]|[12]\d|3[01])\.(0[1-9]|1[0-2])\.$") & F.col("after").rlike(r"^\d{4}(?!\d)")
    rows = rows.withColumn("own", base).withColumn("__no", date | is_broken(F.col("own"), F.col("before"), F.col("after")))
    first_art = F.min(F.when((F.col("kind") == "art") & ~F.col("__no"), F.col("start"))).over(Window.partitionBy(doc))
    rows = rows.withColumn("__first_art", F.when(F.col("__art") >= ART_DOCUMENT, first_art))
    same = Window.partitionBy(doc, "start").orderBy(F.desc(F.length("num")), "kind")
    rows = rows.withColumn("__n", F.row_number().over(same)).where("__n = 1").withColumn("__follow", F.lead("own").over(w))
    word = F.lower(F.regexp_extract("before", LAST_WORD, 1))
    annex_java = MARKERS["annex"].replace(r"(?m)\n", "^")
    not_annex = F.coalesce(F.col("next").rlike(PAGE) | F.col("next").rlike(annex_java), F.lit(False)) | F.col("before").endswith(",") | word.isin(*BROKEN_WORDS, *ANNEX_WORDS) | F.coalesce(F.col("start") < F.col("__first_art"), F.lit(False))
    rest = F.expr("substring(__follow, length(own) + 1)")
    child = F.col("__follow").startswith(F.col("own")) & (F.length(rest) - F.length(F.replace(rest, F.lit("."), F.lit(""))) == 1)
    chapter = (F.length("title") <= CHAPTER_CHARS) & ~F.col("title").rlike("[.;:]$") & F.coalesce(child, F.lit(False))
    keep = F.when(F.col("kind") == "annex", ~not_annex).when(F.col("kind") == "inner", True).when(F.col("kind") == "chapter", ~F.col("__no") & chapter).otherwise(~F.col("__no"))
    rows = rows.where(keep)
    annex = F.last(F.when(F.col("kind") == "annex", F.col("num")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__annex", annex)
    prefix = F.when(F.col("__annex").isNotNull(), F.concat(F.lit("ANEXA "), "__annex", F.lit("."))).otherwise("")
    rows = rows.withColumn("base", F.when(F.col("kind") == "annex", prefix).otherwise(F.concat(prefix, "own")))
    glued = F.regexp_extract("after", r"(?U)^\S+", 0)
    joined = F.concat("base", F.when(F.col("after").rlike(f"^[{UPPER}]"), "").otherwise(glued))
    short = F.regexp_replace(joined, ",$", "")
    article = F.when(F.col("kind") == "annex", F.col("base")).when(is_article_key(article_key(short)), short).otherwise(joined)
    until = F.coalesce(F.lead("start").over(w), F.lit((1 << 31) - 1))
    rows = rows.withColumn("seg_no", F.row_number().over(w) - 1).withColumn("article", article).withColumn("until", until)
    title = F.when(F.col("kind") == "chapter", F.col("title")).alias("title")
    # A document's text meets its markers once; were it carried by each of them, it would be copied as often.
    listed = rows.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("seg_no", "article", "base", title, "stop", "until"))).alias("__s"))
    source = texts.select(doc, F.concat(F.lit("\n"), text).alias("__t")).join(listed, doc)
    body = lambda s: strip(F.substring(F.col("__t"), s["stop"] + 1, s["until"] - s["stop"]))
    cut = F.transform("__s", lambda s: F.struct(*(s[c].alias(c) for c in ("seg_no", "article", "base", "title")), body(s).alias("text")))
    return source.select(doc, F.explode(cut).alias("s")).select(doc, "s.*")


def is_title(text: str) -> bool:
    return bool(text) and "\n" not in text and len(text) <= TITLE_CHARS and not text.endswith((".", ";", ":"))


def title_column(c: Column) -> Column:
    return (c != "") & ~F.contains(c, F.lit("\n")) & (F.length(c) <= TITLE_CHARS) & ~c.rlike("[.;:]$")


def _with_context(segs: list[dict]) -> list[dict]:
    """Of a document's segments, in order: each with its text, is_title and has_context."""
    base, title, text = ([s[c] for s in segs] for c in ("base", "title", "text"))
    dropped, context = [False] * len(segs), [False] * len(segs)

    def give(i: int, line: str) -> None:
        for j in range(i + 1, len(base)):
            if not base[j].startswith(base[i]):
                break
            if base[j][len(base[i]) :].count(".") == 1:
                text[j], context[j] = f"{line}\n{text[j]}", True

    for i, t in enumerate(title):
        if t is not None:
            give(i, f"{base[i]} {t}")
    names = sorted(set(base))
    for i, t in enumerate(text):
        if title[i] is not None or not is_title(t):
            continue
        after = bisect_left(names, base[i] + "\0")
        if after == len(names) or not names[after].startswith(base[i]):
            continue
        dropped[i] = True
        if i + 1 < len(base) and base[i + 1] != base[i] and base[i + 1].startswith(base[i]):
            give(i, f"{base[i]} {t}")
    return [{**s, "text": t, "is_title": d, "has_context": c} for s, t, d, c in zip(segs, text, dropped, context, strict=True)]


SEGMENT = ("seg_no", "article", "base", "title", "text")
TITLED = "array<struct<seg_no: int, article: string, base: string, title: string, text: string, is_title: boolean, has_context: boolean>>"


def with_titles(segs: DataFrame, doc: str) -> DataFrame:
    """Titles become the first line of their direct children. What a title is depends on what it was given itself, so
    this is a fold over a document's segments, in order; no join gives the same at more than one level."""

    kinds = {"seg_no": pa.int32(), "is_title": pa.bool_(), "has_context": pa.bool_()}
    names = (*SEGMENT, "is_title", "has_context")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listing = pa.list_(pa.struct([(n, kinds.get(n, pa.string())) for n in names]))
        for batch in batches:
            made = pa.array([_with_context(s) for s in batch.column("segs").to_pylist()], listing)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), made], names=["doc", "segs"])

    kind = segs.schema[doc].dataType.simpleString()
    listed = segs.groupBy(F.col(doc).alias("doc")).agg(F.array_sort(F.collect_list(F.struct(*SEGMENT))).alias("segs"))
    done = listed.mapInArrow(scan, f"doc {kind}, segs {TITLED}")
    return done.select(F.col("doc").alias(doc), F.explode("segs").alias("s")).select(doc, "s.*")


def longest_at_first_place(segs: DataFrame, doc: str, *, key: Column, order: str, text: str = "text") -> DataFrame:
    """One row a key: the longest text (the first of equal ones), where the key came first."""
    rows = segs.withColumn("__key", key)
    one = Window.partitionBy(doc, "__key")
    rows = rows.withColumn("__first", F.min(order).over(one)).withColumn("__n", F.row_number().over(one.orderBy(F.desc(F.length(text)), order)))
    return rows.where("__n = 1").withColumn(order, F.col("__first")).drop("__key", "__first", "__n")


def split_numbered(chunks: DataFrame, doc: str, *, order: str, text: str = "text", least: int = SPLIT_AT) -> DataFrame:
    """Rows (doc, order, piece, article, text): long chunks cut at ``(n)`` lines if the numbers only grow.

    An introduction that is a title goes before each piece; another one is a piece itself if it is long enough.
    """
    rows = chunks.withColumn("__nums", F.transform(F.regexp_extract_all(text, F.lit(SUBPOINT), F.lit(1)), lambda n: n.cast("decimal(38,0)")))
    rows = rows.withColumn("__parts", F.split(text, SUBPOINT))
    grows = F.forall(F.sequence(F.lit(2), F.greatest(F.size("__nums"), F.lit(2))), lambda i: F.coalesce(F.get("__nums", i - 1) > F.get("__nums", i - 2), F.lit(True)))
    rows = rows.withColumn("__cut", (F.length(text) >= least) & (F.size("__nums") > 0) & grows)
    intro = strip(F.get("__parts", F.lit(0)))
    rows = rows.withColumn("__intro", intro)
    context = F.when(title_column(F.col("__intro")), F.when(F.col("has_context"), F.col("__intro")).otherwise(F.concat("article", F.lit(" "), "__intro")))
    rows = rows.withColumn("__context", context)
    whole = F.array(F.struct(F.lit(0).alias("piece"), F.col("article").alias("article"), F.col(text).alias("text")))
    head = F.array(F.struct(F.lit(0).alias("piece"), F.col("article").alias("article"), F.when(F.col("__context").isNull(), F.col("__intro")).otherwise("").alias("text")))

    def piece(p: Column, i: Column) -> Column:
        body = strip(p)
        full = F.when(F.col("__context").isNotNull() & (body != ""), F.concat("__context", F.lit("\n"), body)).otherwise(body)
        return F.struct((i + 1).alias("piece"), F.concat("article", F.lit("("), F.get("__nums", i).cast("string"), F.lit(")")).alias("article"), full.alias("text"))

    cut = F.filter(F.concat(head, F.transform(F.slice("__parts", 2, F.greatest(F.size("__parts") - 1, F.lit(0))), piece)), lambda p: F.length(p["text"]) >= MIN_CHUNK)
    rows = rows.withColumn("__p", F.explode(F.when(F.col("__cut"), cut).otherwise(whole)))
    return rows.select(doc, order, "__p.piece", "__p.article", "__p.text")


def cut_text(text: str, limit: int = MAX_CHUNK) -> list[str]:
    """Pieces of at most ``limit`` characters, cut at a line's or word's end, never inside a provenance mark.

    All places where a cut may be, and all marks, are listed first; each piece then takes the last place within reach.
    """
    gaps = [m.start() for m in re.finditer("[ \n]", text)]
    marks = [m.span() for m in re.finditer(PROVENANCE, text)]
    cuts, at = [], 0
    end = len(text.rstrip()) if len(text) > limit else len(text)
    while end - at > limit:
        reach = at + limit
        last = bisect_right(gaps, reach) - 1
        place = gaps[last] if last >= 0 and gaps[last] >= at + MIN_CHUNK else reach
        mark = bisect_left(marks, (place,)) - 1  # the last that begins before the place
        if mark >= 0 and marks[mark][0] >= at + MIN_CHUNK and marks[mark][1] > place:
            place = marks[mark][0]
        cuts.append((at, place))
        at = _BLANKS.match(text, place).end()
    if len(text) <= limit:
        return [text] if text else []
    return [p for p in (text[a:b].strip() for a, b in [*cuts, (at, end)]) if p]


_BLANKS = re.compile(r"\s*")


@F.pandas_udf(ArrayType(StringType()))
def limited(texts: pd.Series) -> pd.Series:
    return pd.Series([cut_text(t or "") for t in texts])


@F.pandas_udf(ArrayType(StringType()))
def limited_with_marks(texts: pd.Series) -> pd.Series:
    """Pieces within the limit together with the article marks, which every piece keeps."""
    out = []
    for t in texts:
        if len(t) <= MAX_CHUNK:
            out.append([t])
            continue
        marks = [m[0] for m in re.finditer(PROVENANCE, t) if m[0].startswith("[Articol cu text ")]
        for m in marks:
            t = t.replace("\n" + m, "")
        tail = "\n" + "\n".join(marks)
        out.append([p if any(m in p for m in marks) else p + tail for p in cut_text(t, MAX_CHUNK - len(tail))])
    return pd.Series(out)


def with_article_marks(chunks: DataFrame, doc: str, *, order: list[str], text: str = "text") -> DataFrame:
    """Every chunk of an article that has a provenance mark somewhere gets the marks that it lacks, a line each."""
    kinds = F.transform(F.regexp_extract_all(text, F.lit(PROVENANCE), F.lit(1)), lambda k: F.lower(F.element_at(F.split(k, " "), -1)))
    orders = F.regexp_extract_all(text, F.lit(PROVENANCE), F.lit(2))
    rows = chunks.withColumn("__marks", F.array_distinct(F.transform(F.arrays_zip(kinds.alias("k"), orders.alias("o")), lambda z: F.concat_ws(" ", z["k"], z["o"]))))
    rows = rows.withColumn("__base", F.regexp_replace("article", r"(?:\(\d+\))+$", ""))
    marked = F.when(F.size("__marks") > 0, F.struct(*order, "__marks"))
    listed = F.array_sort(F.collect_list(marked).over(Window.partitionBy(doc, "__base")))
    rows = rows.withColumn("__all", listed).withColumn("__all", F.array_distinct(F.flatten(F.col("__all.__marks"))))
    added = F.transform(F.array_except("__all", "__marks"), lambda m: F.concat(F.lit("\n[Articol cu text "), m, F.lit("]")))
    return rows.withColumn(text, F.concat(text, F.coalesce(F.array_join(added, ""), F.lit("")))).drop("__marks", "__base", "__all")


def chunk(texts: DataFrame, doc: str, text: str = "text") -> DataFrame:
    """Rows (doc, chunk_order, article, article_key, text, content_hash) of whole documents."""
    segs = with_titles(segments(clean_text(texts, doc, text), doc), doc)
    usable = segs.where(~F.col("is_title") & (F.length("text") >= MIN_CHUNK))
    ones = longest_at_first_place(usable, doc, key=article_key(F.col("article")), order="seg_no")
    pieces = split_numbered(ones, doc, order="seg_no")
    pieces = pieces.select(doc, "seg_no", "piece", "article", F.posexplode(limited("text")).alias("part", "text"))
    marked = with_article_marks(pieces, doc, order=["seg_no", "piece", "part"])
    final = marked.select(doc, "seg_no", "piece", "part", "article", F.posexplode(limited_with_marks("text")).alias("bit", "text"))
    place = F.row_number().over(Window.partitionBy(doc).orderBy("seg_no", "piece", "part", "bit"))
    return final.select(doc, place.alias("chunk_order"), "article", article_key(F.col("article")).alias("article_key"), "text", F.md5("text").alias("content_hash"))


def chunk_statistics(segs: DataFrame, doc: str) -> DataFrame:
    """Rows (doc, segments, titles, duplicates) of titled segments."""
    usable = ~F.col("is_title") & (F.length("text") >= MIN_CHUNK)
    return segs.groupBy(doc).agg(
        F.count(F.lit(1)).alias("segments"),
        F.count_if("is_title").alias("titles"),
        (F.count_if(usable) - F.countDistinct(F.when(usable, article_key(F.col("article"))))).alias("duplicates"),
    )


def removed_lines(texts: DataFrame, doc: str, text: str = "text") -> DataFrame:
    """Rows (doc, headers, toc_entries): header and page lines that cleaning drops, and lines of the table of contents."""
    rows = texts.select(doc, F.split(fix_pdf_substitutions(F.col(text)), "\n").alias("lines")).withColumn("kinds", _line_kinds(F.col("lines")))
    rows = rows.select(doc, F.size("lines").alias("__all"), _bare_lines(F.col("lines"), F.col("kinds")).alias("bare"))
    rows = rows.select(doc, (F.col("__all") - F.size("bare")).alias("headers"), without_colophon(F.array_join("bare", "\n")).alias("text"))
    cut = F.coalesce(F.greatest(_toc_end(F.col("text"), True), _toc_end(F.col("text"), False)), F.lit(0))
    before = F.split(F.substring(F.col("text"), F.lit(1), cut), "\n")
    return rows.select(doc, "headers", F.size(F.filter(before, lambda x: x.rlike(DOTTED_ENTRY) | x.rlike(TITLE_ENTRY))).alias("toc_entries"))


@F.pandas_udf(LongType())
def _held(starts: pd.Series, texts: pd.Series) -> pd.Series:
    """How many of the starts, empty ones aside, are in the text: one pass over it for all, by an automaton."""
    out = []
    for wanted, text in zip(starts, texts, strict=True):
        wanted = Counter(x for x in wanted if x)
        automaton = ahocorasick.Automaton()
        for x in wanted:
            automaton.add_word(x, x)
        automaton.make_automaton()
        found = {x for _, x in automaton.iter(text or "")} if wanted else set()
        out.append(sum(wanted[x] for x in found))
    return pd.Series(out, dtype="int64")


def line_coverage(texts: DataFrame, chunks: DataFrame, doc: str, *, text: str = "text", order: str = "chunk_order") -> DataFrame:
    """Rows (doc, coverage): the share of a text's long lines whose start is in its chunks; 1 without such lines."""
    whole = chunks.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("l"))
    whole = whole.select(doc, coverage_text(F.array_join(F.col(f"l.{text}"), " ")).alias("__all"))
    lines = F.transform(F.split(fix_pdf_substitutions(F.col(text)), "\n"), strip)
    long = F.filter(lines, lambda x: (F.length(x) >= COVERAGE_CHARS) & ~F.contains(x, F.lit("MONITORUL OFICIAL")))
    starts = F.transform(long, lambda x: F.substring(coverage_text(x), 1, 45))
    rows = texts.select(doc, starts.alias("__starts")).join(whole, doc, "left")
    held = _held("__starts", F.coalesce("__all", F.lit("")))
    return rows.select(doc, F.coalesce(F.try_divide(held.cast("double"), F.nullif(F.size("__starts"), F.lit(0)).cast("double")), F.lit(1.0)).alias("coverage"))
