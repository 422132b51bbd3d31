"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.llm.durable import durable
from dossier.llm.graph import spread_join
from dossier.llm.ranks import order_digest, running_sums

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
BUDGET = 1.5
REPEATS = 2
#: Words of a packet: longer documents queue in several, so that none of them holds up its source or overshoots a target.
PACKET = 256
#: Packets that one task sorts.
BIN = 50_000


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS) -> DataFrame:
    """Words to take of each source. ``sizes``: one row per source with ``key``, ``source`` and ``source_size``.

    Sources in code point order, null last, get ``weights`` in turn and share ``budget`` times all words. A source
    stops at ``repeats`` times its own words, and what it leaves is shared again by weight. Sorted by the level at
    which they stop, the stopped sources are a prefix, so one pass over the sources finds the common level. Sources
    are a dimension with one row each: the windows below see no documents.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn.cast("int") + 1).cast("long"))
    weighed = weighed.withColumn("cap", F.col("source_size") * repeats)
    every = Window.partitionBy()
    by_stop = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    level = weighed.select(
        "*",
        (F.sum("source_size").over(every) * budget - F.coalesce(F.sum("cap").over(by_stop), F.lit(0))).alias("left"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by_stop), F.lit(0))).alias("share"),
    ).withColumn("level", F.col("left") / F.col("share"))
    stops_later = F.col("cap") / F.col("weight") > F.col("level")
    common = F.min(F.when(stops_later, F.struct(F.col("cap") / F.col("weight"), "level"))).over(every)["level"]
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("weight") * common, F.col("cap").cast("double")))
    return level.select("key", "source_size", target.alias("target"))


def _sized(docs: DataFrame, columns: list[Column], text: str, source: str, doc_id: str, seed: int) -> DataFrame:
    """The columns, and key (the source, never null), source, size and digest (the place in the shuffle)."""
    return docs.select(
        *columns,
        F.coalesce(F.concat(F.lit("s"), docs[source]), F.lit("n")).alias("key"),
        docs[source].alias("source"),
        word_count(docs[text]).alias("size"),
        order_digest(F.lit(seed), docs[doc_id], F.md5(F.coalesce(docs[text], F.lit("")))).alias("digest"),
    )


def queued(placed: DataFrame, repeats: int = REPEATS, packet: int = PACKET, bin_size: int = BIN) -> DataFrame:
    """Rows (key, digest, before, turn, packet, words, finish, taken): every packet in the queue, and the words of it
    that the mix takes.

    A packet's virtual finish is the words of its source up to and with it, divided by the source's target. All packets
    are sorted by it and the queue is cut at the total budget, within a packet if need be. The sort is by ranges:
    sources are served at equal virtual speed, so no stretch of virtual time holds more than its share of words.
    """
    some = placed.where((F.col("size") > 0) & (F.col("target") > 0))
    turns = some.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    rows = turns.withColumn("packet", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / packet))))
    rows = rows.withColumn("words", F.least(F.lit(packet).cast("long"), F.col("size") - F.col("packet") * packet))
    finish = (F.col("before") + F.col("turn") * F.col("source_size") + F.col("packet") * packet + F.col("words")) / F.col("target")
    rows = rows.select("key", "digest", "before", "turn", "packet", "words", finish.alias("finish"))
    counts = some.agg(F.sum(F.floor((F.col("size") - 1) / packet) + 1)).first()[0] or 0
    budget = placed.groupBy("key").agg(F.max("target").alias("target")).agg(F.floor(F.sum(F.col("target").cast("decimal(30,6)")) + F.lit(0.001))).first()[0] or 0
    bins = max(1, math.ceil(counts / bin_size))
    binned = rows.withColumn("bin", F.floor(F.col("finish") * bins))
    earlier = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    ahead = binned.groupBy("bin").agg(F.sum("words").alias("inside")).select("bin", F.coalesce(F.sum("inside").over(earlier), F.lit(0)).alias("ahead"))
    local = Window.partitionBy("bin").orderBy("finish", "key", "digest", "before", "turn", "packet").rowsBetween(Window.unboundedPreceding, -1)
    sent = F.col("ahead") + F.coalesce(F.sum("words").over(local), F.lit(0))
    taken = F.greatest(F.lit(0), F.least(F.col("words"), F.lit(int(budget)) - sent))
    return binned.join(ahead, "bin").select("key", "digest", "before", "turn", "packet", "words", "finish", taken.cast("long").alias("taken"))


def _serve(rows: DataFrame, **rules) -> DataFrame:
    """Add source_size, target, before and served: the words that the queue takes in each pass over the source."""
    repeats = rules.get("repeats", REPEATS)
    sizes = rows.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    placed = durable(spread_join(running_sums(rows, "key", "digest", "size", "before"), source_targets(sizes, **rules), "key", "digest"))
    passes = [F.sum(F.when(F.col("turn") == k, F.col("taken")).otherwise(0)) for k in range(repeats)]
    served = queued(placed, repeats).groupBy("key", "digest", "before").agg(F.array(*passes).alias("served"))
    # Rows equal in source, id and text differ in ``before``, unless they are empty and take none.
    back = placed.join(served, ["key", "digest", "before"], "left")
    return back.withColumn("served", F.coalesce("served", F.array(*[F.lit(0).cast("long")] * repeats)))


def mix(docs: DataFrame, *, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: int = 42, **rules) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken.

    Documents are shuffled by a seeded digest and queue in packets of words, once a pass over their source; ``taken``
    are the words of those packets that the globally sorted queue lets through before the total budget is spent. So each
    source gets its target to within a packet. Null and empty texts have no words and take none. A null source is a
    source of its own. Rows that are equal in id and text are interchangeable. An empty table gives an empty mix.
    """
    rows = durable(_sized(docs, [docs[doc_id].alias("doc_id")], text, source, doc_id, seed))
    mixed = _serve(rows, **rules).withColumn("taken", F.aggregate("served", F.lit(0).cast("long"), lambda a, x: a + x))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def first_words(text: Column, n: Column) -> Column:
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), 1, n), " ")


def mix_stream(docs: DataFrame, *, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: int = 42, **rules) -> DataFrame:
    """The mix itself: the columns of ``docs``, a row per copy taken, globally sorted by virtual finish.

    Whole copies are unchanged; a copy that the end of the budget cuts holds its first words, as many as are taken of
    it. Rows that are equal in source, id and text are served together, one after the other. Texts are dealt once to
    meet their share of the mix and once to be sorted.
    """
    named = _sized(docs, [F.struct(*docs.columns).alias("row")], text, source, doc_id, seed)
    units = named.groupBy("key", "digest").agg(F.first("source").alias("source"), F.sum("size").alias("size"), F.max("size").alias("words"))
    served = _serve(durable(units), **rules).where(F.exists("served", lambda w: w > 0)).select("key", "digest", "size", "words", "before", "source_size", "target", "served")
    texts = named.select("row", "key", "digest").groupBy("key", "digest").agg(F.first("row").alias("row"))
    turns = texts.join(served, ["key", "digest"]).select("*", F.posexplode("served").alias("turn", "left")).where("left > 0")
    copies = turns.select("*", F.explode(F.sequence(F.lit(1), F.ceil(F.col("left") / F.col("words")))).alias("copy"))
    taken = F.least(F.col("words"), F.col("left") - (F.col("copy") - 1) * F.col("words"))
    finish = (F.col("before") + F.col("turn") * F.col("source_size") + F.least(F.col("size"), F.col("copy") * F.col("words"))) / F.col("target")
    ready = copies.withColumn("taken", taken).withColumn("finish", finish)
    cut = F.when(F.col("taken") < F.col("words"), first_words(F.col("row")[text], F.col("taken").cast("int"))).otherwise(F.col("row")[text])
    ordered = ready.select("row", "words", "taken", "finish", "digest").orderBy("finish", "digest")
    return ordered.select(*((cut.alias(c) if c == text else F.col("row")[c].alias(c)) for c in docs.columns))


def op3_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, text FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, source_size * 2 AS cap,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM sources),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM weighed WINDOW w AS (ORDER BY cap / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
common AS (SELECT min_by(level, cap / weight::DOUBLE) FILTER (cap / weight::DOUBLE > level) AS level FROM levels),
targets AS (SELECT source, source_size, least(cap::DOUBLE, coalesce(weight * (SELECT level FROM common), cap::DOUBLE)) AS target FROM weighed),
keyed AS (SELECT doc_id, source, size, md5('42:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS digest FROM sized),
placed AS (
  SELECT k.*, t.source_size, t.target, row_number() OVER () AS row,
    (coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY digest, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS before
  FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source),
packets AS (
  SELECT p.*, turn, packet, least(256, size - packet * 256)::BIGINT AS words
  FROM placed p, (VALUES (0), (1)) AS turns(turn), unnest(range(0, (size + 255) // 256)) AS packets(packet) WHERE size > 0 AND target > 0),
queue AS (
  SELECT row, words, sum(words) OVER (ORDER BY (before + turn * source_size + packet * 256 + words) / target, coalesce('s' || source, 'n'), digest, before, turn, packet ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - words AS sent FROM packets),
served AS (SELECT row, sum(greatest(0, least(words, (SELECT floor(sum(target::DECIMAL(30, 6)) + 0.001) FROM targets) - sent))) AS taken FROM queue GROUP BY row)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM placed LEFT JOIN served USING (row)
"""
