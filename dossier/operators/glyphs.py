"""Repair of glyphs that a PDF shows as wrong characters: tables of observed spans, not PDF files."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Thresholds of size, baseline, line and gap.
SCRIPT_RATIO, BASELINE, SAME_LINE, GAP = 0.85, 0.5, 6.0, 8


def scripts(spans: DataFrame, *, page: str, order: str, size: str, y: str) -> DataFrame:
    """Add script: null, sub or sup. A span at least SCRIPT_RATIO as large as the current reference becomes the
    reference; a smaller one is judged by its baseline against it. The reference depends on all spans before, so this
    is a fold over a page's spans in order, over arrays, inside the JVM."""
    listed = spans.groupBy(page).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("double").alias("s"), F.col(y).cast("double").alias("y")))).alias("l"))
    start = F.struct(F.lit(None).cast("double").alias("s"), F.lit(None).cast("double").alias("y"), F.from_json(F.lit("[]"), "array<string>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        full = a["s"].isNull() | (x["s"] >= a["s"] * SCRIPT_RATIO)
        kind = F.when(full, F.lit("")).when(x["y"] > a["y"] + BASELINE, "sub").when(x["y"] < a["y"] - BASELINE, "sup").otherwise("")
        return F.struct(F.when(full, x["s"]).otherwise(a["s"]).alias("s"), F.when(full, x["y"]).otherwise(a["y"]).alias("y"), F.concat(a["out"], F.array(kind)).alias("out"))

    done = listed.withColumn("k", F.aggregate("l", start, step, lambda a: a["out"]))
    kinds = done.select(page, F.explode(F.arrays_zip("l", "k")).alias("z")).select(page, F.col("z.l.o").alias(order), F.nullif(F.col("z.k"), F.lit("")).alias("script"))
    return spans.join(kinds, [page, order])


def learned(observed: DataFrame, *, gid: str = "gid", char: str = "char") -> DataFrame:
    """Rows (gid, char) of glyphs that always showed the same character."""
    found = observed.groupBy(gid).agg(F.min(char).alias("__a"), F.max(char).alias("__b"))
    return found.where("__a = __b").select(gid, F.col("__a").alias(char))


def interpolated(known: DataFrame, *, gid: str = "gid", char: str = "char", gap: int = GAP) -> DataFrame:
    """Known glyphs, and those in gaps of 2 to ``gap`` where characters go up exactly as glyph numbers do. Numbers are
    dealt to ranges of equal width, each with the first known glyph after it, so no window sees the whole table."""
    width = 4096
    rows = known.select(F.col(gid).alias("g"), F.ascii(char).alias("c")).withColumn("b", F.floor(F.col("g") / width))
    firsts = rows.groupBy("b").agg(F.min_by(F.struct("g", "c"), "g").alias("f")).select((F.col("b") - 1).alias("b"), "f.g", "f.c", F.lit(True).alias("edge"))
    both = rows.withColumn("edge", F.lit(False)).unionByName(firsts.select("g", "c", "b", "edge"))
    w = Window.partitionBy("b").orderBy("g")
    nexts = both.withColumn("ng", F.lead("g").over(w)).withColumn("nc", F.lead("c").over(w)).where("not edge")
    fits = F.col("ng").isNotNull() & F.col("ng").between(F.col("g") + 2, F.col("g") + gap) & (F.col("nc") - F.col("c") == F.col("ng") - F.col("g"))
    filled = nexts.where(fits).select(F.explode(F.sequence(F.col("g") + 1, F.col("ng") - 1)).alias("x"), "g", "c")
    more = filled.select(F.col("x").alias(gid), _character(F.col("c") + F.col("x") - F.col("g")).alias(char))
    return known.select(gid, char).unionByName(more)


def _character(code: Column) -> Column:
    """The character of a code point; Spark's chr knows bytes only."""
    hexed = F.lpad(F.hex(code.cast("long")), 8, "0")
    return F.decode(F.unhex(hexed), "UTF-32")


def readable(gids: DataFrame, table: DataFrame, *, gid: str = "gid") -> DataFrame:
    """Add char; what the table lacks shows as <?glifN?>, easy to search for."""
    rows = gids.join(table.select(F.col(gid), F.col("char").alias("__c")), gid, "left")
    return rows.withColumn("char", F.coalesce("__c", F.concat(F.lit("<?glif"), F.col(gid).cast("string"), F.lit("?>")))).drop("__c")


def nearest_span(points: DataFrame, boxes: DataFrame, *, page: str, point: str, box: str, same_line: float = SAME_LINE) -> DataFrame:
    """Rows (page, point, box): each point's box, on its line if one is: the least distance to the box, then to its
    centre, then the box's number. points: x, y; boxes: x0, y0, x1, y1. Pages hold few spans and meet by equi-join."""
    b = boxes.select(page, F.col(box), "x0", "y0", "x1", "y1", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))
    far = lambda v, lo, hi: F.greatest(lo - v, F.lit(0.0), v - hi)
    rows = points.join(b, page)
    dx, dy = far(F.col("x"), F.col("x0"), F.col("x1")), far(F.col("y"), F.col("y0"), F.col("y1"))
    rank = F.struct((F.abs(F.col("y") - F.col("cy")) > same_line).alias("other_line"), (dx * dx + dy * dy).alias("d"), (F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2)).alias("c"), F.col(box))
    return rows.groupBy(page, point).agg(F.min_by(box, rank).alias(box))


def _apply(text: str, old: list[str], new: list[str]) -> str:
    taken: list[tuple[int, int, str]] = []
    for a, b in sorted(zip(old, new, strict=True), key=lambda p: -len(p[0])):
        pattern, at = re.compile(r"\s*".join(map(re.escape, a))), 0
        while a and (m := pattern.search(text, at)):
            if all(m.start() >= e or m.end() <= s for s, e, _ in taken):
                taken.append((m.start(), m.end(), b))
                break
            at = m.start() + 1
    out, at = [], 0
    for s, e, b in sorted(taken):
        out += [text[at:s], b]
        at = e
    return "".join([*out, text[at:]])


@F.pandas_udf(StringType())
def apply_replacements(texts: pd.Series, old: pd.Series, new: pd.Series) -> pd.Series:
    """Each replacement, the longest first, at its first place that none before it took, white space aside. Which
    place is free depends on those taken before, page by page."""
    return pd.Series([_apply(t or "", list(a), list(b)) for t, a, b in zip(texts, old, new, strict=True)])


@F.pandas_udf(StringType())
def drop_fixed_twins(texts: pd.Series, broken: pd.Series, fixed: pd.Series) -> pd.Series:
    """Without broken characters that stand next to their own fixed form, markup and spaces aside. Greek letters stay."""
    skip, out = set("_{}^ \n\x03̇"), []
    for t, a, b in zip(texts, broken, fixed, strict=True):
        want = {x: y for x, y in zip(a, b, strict=True) if not (0x391 <= ord(x) < 0x3AA or 0x3B1 <= ord(x) < 0x3CA)}
        kept = []
        for i, ch in enumerate(t or ""):
            if ch in want:
                j = next((x for x in reversed(t[:i]) if x not in skip), None)
                k = next((x for x in t[i + 1 :] if x not in skip), None)
                if want[ch] in (j, k):
                    continue
            kept.append(ch)
        out.append("".join(kept))
    return pd.Series(out)
