"""Benchmark decontamination by template canonicalisation, also of questions with other numbers, names or units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOW = 5
SIMILARITY = 0.8
#: Rows of benchmark windows are broadcast up to so many (about 40 bytes each); beyond that they are joined by a shuffle,
#: in which a hash's rows are dealt over SPREAD tasks.
BROADCAST_WINDOWS = 1_000_000
SPREAD = 16
#: Units and currencies that may follow a number.
UNITS = (
    "nm|mm|cm|dm|km|m|mi|ft|yd|in|mg|kg|g|t|lb|lbs|oz|ml|cl|dl|l|gal|kwh|wh|kw|mw|gw|w|v|mv|kv|ma|a|hz|khz|mhz|ghz|pa|kpa|bar|psi|j|kj|cal|kcal|n|k|c|f|ns|ms|s|sec|min|h|hr|hrs|km/h|kmh|mph|m/s|rpm|b|kb|mb|gb|tb|%|"
    "eur|usd|gbp|jpy|chf|ron|lei|cents?|dollars?|euros?|pounds?|pesos?|yen|yuan|rupees?|francs?|marks?|crowns?|"
    "meters?|metres?|centimeters?|centimetres?|millimeters?|millimetres?|kilometers?|kilometres?|miles?|feet|foot|inch|inches|yards?|acres?|hectares?|"
    "grams?|kilograms?|kilos?|milligrams?|tons?|tonnes?|ounces?|liters?|litres?|milliliters?|millilitres?|gallons?|"
    "seconds?|minutes?|hours?|days?|weeks?|months?|years?|decades?|centuries|century|percent|degrees?|volts?|watts?|joules?|newtons?|amps?|amperes?|"
    "bytes?|bits?|kilobytes?|megabytes?|gigabytes?"
)
NUMBER, UNIT, NAME = "\ue000", "\ue001", "\ue002"
SLOTS = f"[{NUMBER}{UNIT}{NAME}]+"
_MARKS = ".,;:!?\"'()[]{}«»“”„*_" + NUMBER + UNIT + NAME + "\t\n\v\f\r"


def _plain(text: Column) -> Column:
    """The text with a space for each mark and white space, except that a number's marks go: 1,200.5 is one number."""
    return F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), r"(\d)[.,](?=\d)", "$1"), _MARKS, " " * len(_MARKS))


def _split(text: Column) -> Column:
    low = F.trim(F.lower(text))
    return F.when(low == "", F.array().cast("array<string>")).otherwise(F.split(low, " +"))


def words(text: Column) -> Column:
    """The words of a text in lower case, without the punctuation around and inside them; words of punctuation vanish."""
    return _split(_plain(text))


def template(text: Column) -> Column:
    """``words`` with a typed placeholder for each number, each unit after one (apart or glued to it), and each word
    that is capitalised; as many as there are words, so that positions agree."""
    plain = F.concat(F.lit(" "), _plain(text))
    plain = F.regexp_replace(plain, r" [$€£¥₹+-]?\d[\d/]*+(?![^ ])", f" {NUMBER}")
    plain = F.regexp_replace(plain, rf" [$€£¥₹+-]?\d[\d/]*(?i:{UNITS})(?![^ ])", f" {NUMBER}{UNIT}")
    plain = F.regexp_replace(plain, rf"{NUMBER} +(?i:{UNITS})(?![^ ])", f"{NUMBER} {UNIT}")
    return _split(F.regexp_replace(plain, r" \p{Lu}\p{Ll}*+(?![^ ])", f" {NAME}"))


def _key(row_id: Column, text: Column) -> Column:
    """A key for each row: rows that are equal in id and text, null or not, are one."""
    return F.md5(F.concat_ws(":", F.coalesce(F.concat(F.lit("i"), row_id.cast("string")), F.lit("n")), F.md5(F.coalesce(text, F.lit("")))))


#: What a window is made of: typed placeholders, or plain words.
TEMPLATE, PLAIN = 0, 1


def _at(size: int, tokens: str, way: int) -> Column:
    """The hash of the window of ``size`` tokens at ``at``."""
    return F.xxhash64(F.lit(way), F.lit(size), F.slice(tokens, F.col("at") + 1, size))


def benchmark_windows(items: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """Rows (h, way, width, item, at, n) of items (item, plain, template): their windows, and n, how many the item has.

    Template windows count if at least half of their words are literal; an item shorter than ``window`` is one
    template window, matched by texts of its length only. Plain windows all count, and a shorter item is one of its
    own length, found anywhere.
    """
    size = F.size("plain")
    rows = items.select("item", "plain", "template", F.posexplode("plain").alias("at", "word"))
    literal = F.size(F.filter(F.slice("template", F.col("at") + 1, window), lambda t: ~t.rlike(f"^{SLOTS}$"))) * 2 >= F.least(size, F.lit(window))
    typed = rows.where((F.col("at") <= F.greatest(size - window, F.lit(0))) & literal).select(_at(window, "template", TEMPLATE).alias("h"), F.lit(TEMPLATE).alias("way"), F.lit(window).alias("width"), "item", "at")
    width = F.least(size, F.lit(window))
    hashed = None
    for w in range(1, window + 1):
        hashed = (F if hashed is None else hashed).when(width == w, _at(w, "plain", PLAIN))
    plain = rows.where(F.col("at") <= size - width).select(hashed.alias("h"), F.lit(PLAIN).alias("way"), width.alias("width"), "item", "at")
    found = typed.unionByName(plain)
    n = found.groupBy("item", "way").agg(F.count(F.lit(1)).alias("n"))
    return found.join(n, ["item", "way"]).select("h", "way", "width", "item", "at", "n")


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    window: int = WINDOW,
    similarity: float = SIMILARITY,
    ways: tuple[int, ...] = (TEMPLATE,),
    by_row: bool = False,
) -> DataFrame:
    """Rows (doc_id, item_id, n_windows, n_item_windows, reparameterised): the benchmark items that a document holds.

    By template, a document holds an item if, counting only places where slots are consistent, it has at least
    ``similarity`` of the item's template windows of ``window`` words. A place is a shift between the two texts; its
    slots are consistent if every value of the item stands for one value of the document throughout. By plain words
    (``ways`` names PLAIN), it holds an item if it has that share of the windows of lower-cased words. A pair found both
    ways is told as by template.

    Null and empty texts hold nothing and match nothing. Each row is a document of its own, and each benchmark row an
    item, whatever its id, null included; rows that share both ids are told once, with the most windows. ``by_row``
    gives instead the keys of the rows that hold an item.
    """
    items = benchmark.select(_key(benchmark[item_id], benchmark[text]).alias("item"), benchmark[item_id].alias("item_id"), words(benchmark[text]).alias("plain"), template(benchmark[text]).alias("template")).dropDuplicates(["item"])
    parts = benchmark_windows(items, window=window).where(F.col("way").isin(*ways))
    few = parts.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    widths = sorted(r["width"] for r in parts.where(F.col("way") == PLAIN).select("width").distinct().collect())  # ``window`` numbers at most

    named = docs.select(_key(docs[doc_id], docs[text]).alias("doc"), docs[doc_id].alias("doc_id"), words(docs[text]).alias("plain"), template(docs[text]).alias("template"))
    rows = named.select("doc", "doc_id", "plain", "template", F.posexplode("plain").alias("at", "word"))
    size = F.size("plain")
    hashes = [F.when(F.col("at") <= F.greatest(size - window, F.lit(0)), _at(window, "template", TEMPLATE))] if TEMPLATE in ways else []
    hashes += [F.when(F.col("at") <= size - w, _at(w, "plain", PLAIN)) for w in widths]
    here = rows.select("doc", "doc_id", "plain", F.col("at").alias("doc_at"), F.explode(F.array(*hashes, F.lit(None).cast("long"))).alias("h"))
    parts = parts.drop("width")
    said = F.slice("plain", F.col("doc_at") + 1, window).alias("said")
    if few:
        met = here.where("h is not null").join(F.broadcast(parts), "h").select("*", said)
    else:
        salt = F.pmod(F.xxhash64("doc", "doc_at"), F.lit(SPREAD)).cast("int")
        dealt = here.where("h is not null").select("doc", "doc_id", "doc_at", "h", salt.alias("salt"), said)
        met = dealt.join(parts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))), ["h", "salt"])
    typed = F.col("way") == TEMPLATE
    spot = F.struct("at", F.when(typed, F.col("said")).alias("said"))
    places = met.groupBy("doc", "doc_id", "item", "way", "n", F.when(typed, F.col("doc_at") - F.col("at")).alias("shift")).agg(F.collect_set(spot).alias("spots"))
    held = places.groupBy("doc", "doc_id", "item", "way", "n").agg(F.collect_list("spots").alias("places"))
    seen = lambda ps: F.size(F.array_distinct(F.flatten(F.transform(ps, lambda p: F.transform(p, lambda s: s["at"])))))
    enough = lambda count: count >= F.lit(similarity) * F.col("n")
    both = held.where(enough(seen(F.col("places")))).join(items, "item")

    def values(place: Column) -> Column:
        pairs = F.flatten(F.transform(place, lambda s: F.transform(s["said"], lambda w, j: F.struct(F.get("template", s["at"] + j).alias("slot"), F.get("plain", s["at"] + j).alias("item"), w.alias("doc")))))
        return F.array_distinct(F.filter(pairs, lambda v: v["slot"].rlike(f"^{SLOTS}$")))

    valued = both.withColumn("places", F.transform("places", lambda p: F.struct(p.alias("spots"), F.coalesce(values(p), F.array().cast("array<struct<slot:string,item:string,doc:string>>")).alias("pairs"))))
    consistent = F.filter("places", lambda p: F.size(F.array_distinct(F.transform(p["pairs"], lambda v: v["item"]))) == F.size(p["pairs"]))
    judged = valued.withColumn("places", consistent)
    changed = F.exists("places", lambda p: F.exists(p["pairs"], lambda v: ~v["item"].eqNullSafe(v["doc"])))
    found = judged.select("doc", "doc_id", "item_id", "way", seen(F.col("places.spots")).cast("long").alias("n_windows"), F.col("n").cast("long").alias("n_item_windows"), changed.alias("reparameterised"), "n").where(enough(F.col("n_windows")))
    if by_row:
        return found.select("doc").distinct()
    first = F.min_by(F.struct("n_windows", "n_item_windows", "reparameterised"), F.struct("way", -F.col("n_windows"), "reparameterised"))
    return found.groupBy("doc_id", "item_id").agg(first.alias("r")).select("doc_id", "item_id", "r.n_windows", "r.n_item_windows", "r.reparameterised")


def verbatim_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``leaks`` by plain words alone."""
    return leaks(docs, benchmark, ways=(PLAIN,), **options).drop("reparameterised")


def all_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``leaks`` by template or by plain words; one for each document and item."""
    return leaks(docs, benchmark, ways=(TEMPLATE, PLAIN), **options)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", verbatim: bool = False, **options) -> DataFrame:
    """The rows of ``docs``, with their columns, that hold no benchmark item; ``verbatim`` looks for plain words too.

    Rows are judged one by one: a row stays even if another of its id, or another without an id, goes.
    """
    ways = (TEMPLATE, PLAIN) if verbatim else (TEMPLATE,)
    bad = leaks(docs, benchmark, doc_id=doc_id, text=text, ways=ways, by_row=True, **options).select(F.col("doc").alias("__leak"))
    return docs.join(bad, _key(docs[doc_id], docs[text]) == F.col("__leak"), "left_anti")


def op4_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
