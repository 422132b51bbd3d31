"""Phrase collocation mining: pieces with multiplicities, n-grams counted in duckdb by hash bucket, parts looked up by shuffle."""

from __future__ import annotations

import tempfile
from collections import Counter
from collections.abc import Callable, Iterator

import duckdb
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.llm.batches import Batch, Columns, Packed, answer, ask, gather, pack_documents, uncell, visit
from dossier.llm.debruijn import KEY_ANSWER, Words, may_repeat, mixed, word_hashes
from dossier.llm.durable import durable, stored
from dossier.llm.graph import hot_join, spread_join

U = np.uint64
LONGEST, LEAST, TOP = 5, 100, 2000
#: Beyond this a bucket's counting goes to the task's disk.
BUCKET_MEMORY = "400MB"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAKS = r"[.,;:!?\x0A-\x0D]"


#: Bytes of pieces whose copies a task counts together.
STRETCH = 32 << 20


def pieces_of(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, piece): each piece as words joined by single spaces."""
    rows = docs.select(F.coalesce(docs[lang], F.lit("und")).alias("lang"), F.translate(docs[text], UPPER, LOWER).alias("text"))
    pieces = rows.select("lang", F.explode(F.split("text", BREAKS)).alias("piece"))
    tidy = F.trim(F.regexp_replace("piece", r"[\x20\x09]+", " "))
    return pieces.select("lang", tidy.alias("piece")).where("piece <> ''")


def weighted(pieces: DataFrame) -> DataFrame:
    """(piece, weight): each distinct piece of a stretch of a partition once, and how often it occurs there. Weights of
    several stretches are summed wherever n-grams are counted, so that pieces themselves are not shuffled. A stretch is
    sorted, so that a batch has few languages and like beginnings side by side: it asks about fewer n-grams."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times, size = Counter(), 0

        def out() -> pa.RecordBatch:
            pieces = sorted(times)
            return pa.RecordBatch.from_arrays([pa.array(pieces, pa.binary()), pa.array(map(times.__getitem__, pieces), pa.int64())], names=["piece", "weight"])

        for batch in batches:
            times.update(batch.column("piece").to_pylist())
            size += batch.nbytes
            if size >= STRETCH:
                yield out()
                times, size = Counter(), 0
        yield out()

    return pieces.select(F.col("piece").cast("binary").alias("piece")).mapInArrow(scan, "piece binary, weight long")


def _tag(lang: Column) -> Column:
    """A language as one word, which stands before each piece in a batch."""
    return F.concat(F.lit("L"), F.hex(F.encode(lang, "UTF-8")))


def _untagged(tag: Column) -> Column:
    return F.decode(F.unhex(F.substring(tag, 2, 1 << 30)), "UTF-8")


class Grams(Words):
    """Hashes of the n-grams of a batch whose rows are pieces, each after the tag of its language; ids are weights."""

    def __init__(self, batch: Batch, seed: int = 0):
        super().__init__(batch)
        self.word = word_hashes(batch.data, self.start, self.end, seed)
        self.tag = self.first[self.row]  # the tag's place, for each word
        self.inside = np.arange(len(self.word)) != self.tag

    def places(self, n: int) -> np.ndarray:
        """Where n-grams begin: words that are no tag and have n - 1 more behind them in their piece."""
        last = len(self.word) - n + 1
        if last <= 0:
            return np.zeros(0, np.int64)
        return np.nonzero(self.inside[:last] & (self.row[:last] == self.row[n - 1 :]))[0]

    def hashes(self, at: np.ndarray, n: int) -> np.ndarray:
        h = self.word[self.tag[at]] * U(0x9E3779B97F4A7C15) + U(n)
        for j in range(n):
            h = mixed(h) + self.word[at + j]
        return mixed(h)

    def weights(self, at: np.ndarray) -> np.ndarray:
        return self.batch.ids[self.row[at]]


def summed(h: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each hash once, in order, with the sum of its weights."""
    order = np.argsort(h, kind="stable")
    h = h[order]
    starts = np.nonzero(np.r_[True, h[1:] != h[:-1]])[0] if len(h) else np.zeros(0, int)
    return h[starts], np.add.reduceat(weight[order], starts) if len(h) else weight[order]


#: Bits of a key beside its bucket. A bucket has the n-grams of PART_BYTES of texts, about a million, whatever the input, and few frequent ones.
KEY_BITS = 24
COUNT_FIELDS = {"part": np.uint32, "key": np.uint32, "weight": np.int64}


def count_question(h: np.ndarray, weight: np.ndarray, parts: int) -> tuple[np.ndarray, Columns]:
    """A key has KEY_BITS beside its bucket; keys that collide are only counted too high, and texts are counted at the end."""
    h, weight = summed(h, weight)
    part, key = (h % U(parts)).astype(np.int64), (h >> U(64 - KEY_BITS)).astype(np.uint32)
    return part, {"part": part.astype(np.uint32), "key": key, "weight": weight}


def _in_duckdb(rows: pa.Table, query: str, least: int) -> pa.Table:
    """A query over the table ``asked``; duckdb spills what exceeds its memory to the task's disk, and clears it away."""
    with tempfile.TemporaryDirectory() as spill, duckdb.connect(config={"memory_limit": BUCKET_MEMORY, "threads": 1, "temp_directory": spill, "preserve_insertion_order": False}) as db:
        db.register("asked", rows)
        return db.sql(query, params=[least]).to_arrow_table()


def frequent_keys(asked: Columns, least: int) -> np.ndarray:
    """The keys of a bucket whose weights sum up to ``least``."""
    rows = pa.table({"key": asked["key"], "weight": asked["weight"]})
    return _in_duckdb(rows, "SELECT key FROM asked GROUP BY key HAVING sum(weight) >= ?", least)["key"].to_numpy()


def _ask_counts(packed: Packed, known: DataFrame | None, grams: Callable, least: int) -> DataFrame:
    """Rows (batch_id, KEY_ANSWER): to each batch the keys of its n-grams that are frequent over all batches.
    ``grams`` gives hashes and weights of what a batch asks for."""

    parts = packed.parts

    def question(batch: Batch, answers: Columns):
        return count_question(*grams(batch, answers), parts)

    def reply(batch: np.ndarray, asked: Columns) -> tuple[np.ndarray, Columns]:
        often = np.isin(asked["key"], frequent_keys(asked, least))
        return batch[often], {n: asked[n][often] for n in KEY_ANSWER}

    questions = ask(packed, known, KEY_ANSWER if known is not None else {}, question, COUNT_FIELDS)
    return durable(answer(packed, questions, COUNT_FIELDS, reply, KEY_ANSWER))


PHRASES = "tag string, phrase string, a long"
TEXT_FIELDS = {"size": np.uint32, "weight": np.int64}


def _tagged(grams: Grams, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts of n-grams, each after its tag and a space: bytes, starts and sizes."""
    tag = grams.tag[at]
    start = np.stack([grams.start[tag], grams.start[at]], axis=1)
    end = np.stack([grams.end[tag] + 1, grams.end[at + n - 1]], axis=1)
    size = end - start
    both = size.sum(axis=1)
    return gather(grams.batch.data, start.ravel(), size.ravel()), np.cumsum(both) - both, both


def counted_texts(bucket: pa.Table, least: int) -> pa.Table:
    """PHRASES of a bucket, by their texts: those that occur ``least`` times."""
    sizes = np.concatenate([uncell(b, np.uint32) for b in bucket.column("size").to_pylist()])
    weight = np.concatenate([uncell(b, np.int64) for b in bucket.column("weight").to_pylist()])
    texts = b"".join(map(zstandard.decompress, bucket.column("text").to_pylist()))
    offsets = np.r_[0, np.cumsum(sizes, dtype=np.int64)]
    rows = pa.table({"text": pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(texts)]), "weight": weight})
    query = "SELECT text, sum(weight)::BIGINT AS a FROM asked GROUP BY text HAVING sum(weight) >= ?"
    found = _in_duckdb(rows, f"SELECT text[:strpos(text, ' ') - 1] AS tag, text[strpos(text, ' ') + 1:] AS phrase, a FROM ({query})", least)
    return found.cast(pa.schema([("tag", pa.string()), ("phrase", pa.string()), ("a", pa.int64())]))


def frequent_phrases(packed: Packed, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """(tag, phrase, words, a): all phrases of 1 to ``longest`` words that occur ``least`` times, and how often.

    Words are counted first, then pairs of frequent words, then longer runs of frequent pairs, for no phrase is more
    frequent than its parts. Batches ask by hashes; what may be frequent is then counted by its text.
    """
    parts = packed.parts

    def words(batch: Batch, _: Columns):
        grams = Grams(batch)
        at = grams.places(1)
        return grams.hashes(at, 1), grams.weights(at)

    def pairs(batch: Batch, known: Columns):
        grams = Grams(batch)
        at = grams.places(1)
        often = np.zeros(len(grams.word) + 1, bool)
        often[at] = may_repeat(grams.hashes(at, 1), parts, known, KEY_BITS)
        at = grams.places(2)
        at = at[often[at] & often[at + 1]]
        return grams.hashes(at, 2), grams.weights(at)

    def runs(grams: Grams, pair: np.ndarray, n: int) -> np.ndarray:
        at = grams.places(n)
        for j in range(n - 1):
            at = at[pair[at + j]]
        return at

    def longer(batch: Batch, known: Columns):
        grams = Grams(batch)
        pair = np.zeros(len(grams.word), bool)
        at = grams.places(2)
        pair[at] = may_repeat(grams.hashes(at, 2), parts, known, KEY_BITS)
        found = [(runs(grams, pair, n), n) for n in range(3, longest + 1)]
        return np.concatenate([np.zeros(0, U), *(grams.hashes(at, n) for at, n in found)]), np.concatenate([np.zeros(0, np.int64), *(grams.weights(at) for at, _ in found)])

    def named(batch: Batch, known: Columns):
        grams, other = Grams(batch), Grams(batch, 1)
        pair = np.zeros(len(grams.word), bool)
        found = []
        for n in range(1, longest + 1):
            at = grams.places(n) if n < 3 else runs(grams, pair, n)
            at = at[may_repeat(grams.hashes(at, n), parts, known, KEY_BITS)]
            if n == 2:
                pair[at] = True
            h, g = grams.hashes(at, n), other.hashes(at, n)  # phrases of a batch are told by 128 bits
            order = np.lexsort((g, h))
            h, g, at = h[order], g[order], at[order]
            starts = np.nonzero(np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])])[0] if len(h) else np.zeros(0, int)
            weight = np.add.reduceat(grams.weights(at), starts) if len(h) else np.zeros(0, np.int64)
            found.append((h[starts], at[starts], np.full(len(starts), n), weight))
        h, at, n, weight = (np.concatenate(x) for x in zip(*found, strict=True))
        by = np.lexsort((grams.word[np.minimum(at + 1, len(grams.word) - 1)], grams.word[at], grams.tag[at]))  # like ones side by side compress well
        h, at, n, weight = h[by], at[by], n[by], weight[by]
        texts = _tagged(grams, at, n)
        return (h % U(parts)).astype(np.int64), {"size": texts[2].astype(np.uint32), "weight": weight}, texts

    answers = [_ask_counts(packed, None, words, least)]
    if longest > 1:
        answers.append(_ask_counts(packed, answers[0], pairs, least))
    if longest > 2:
        answers.append(_ask_counts(packed, answers[1], longer, least))
    known = answers[0]
    for more in answers[1:]:
        known = known.unionByName(more)
    texts = ask(packed, known, KEY_ANSWER, named, TEXT_FIELDS, "text")
    counted = texts.repartition(packed.tasks, "dealt_to").groupBy("dealt_to").applyInArrow(lambda bucket: counted_texts(bucket, least), PHRASES)
    return counted.select("tag", "phrase", F.size(F.split("phrase", " ")).alias("words"), "a")


def word_totals(packed: Packed) -> DataFrame:
    """(tag, n): the words of each language."""

    def count(batch: Batch, _: Columns) -> pa.Table:
        words = Words(batch)
        tags, n = {}, (np.diff(words.first) - 1) * batch.ids
        data = batch.data.tobytes()
        for at, size in zip(words.first[:-1].tolist(), n.tolist(), strict=True):
            tag = data[words.start[at] : words.end[at]]
            tags[tag] = tags.get(tag, 0) + size
        return pa.table({"tag": pa.array([t.decode() for t in tags], pa.string()), "n": pa.array(list(tags.values()), pa.int64())})

    return visit(packed, None, {}, count, "tag string, n long").groupBy("tag").agg(F.sum("n").alias("n"))


def _parts(phrase: Column, words: Column, longest: int) -> Column:
    """The shorter phrases of two words or more that lie contiguously in a phrase."""
    cut = F.split(phrase, " ")
    inside = [F.when((words > n) & (words >= first + n - 1), F.array_join(F.slice(cut, first, n), " ")) for n in range(2, longest) for first in range(1, longest - n + 2)]
    return F.array_compact(F.array_distinct(F.array(*inside))) if inside else F.array().cast("array<string>")


def scored(phrases: DataFrame, totals: DataFrame, longest: int) -> DataFrame:
    """Candidates (tag, phrase, words, a, l, r, n, score) by the lowest-scoring cut. ``totals``: (tag, n).

    Each candidate asks for the counts of its parts, two a cut; requests meet the counts by the part. Requests for a
    part that very many ask for are dealt over several tasks.
    """
    some = phrases.where("words > 1")
    cuts = [(k, side) for k in range(1, longest) for side in (0, 1)]
    part = [F.when(F.col("words") > k, F.call_function("substring_index", F.col("phrase"), F.lit(" "), F.lit(k) - (F.col("words") if side else 0))) for k, side in cuts]
    asked = some.select("tag", "phrase", "words", "a", F.posexplode(F.array(*part)).alias("cut", "part")).where("part is not null")
    counts = phrases.select("tag", F.col("phrase").alias("part"), F.col("a").alias("f"))
    wanted = asked.groupBy("tag", "part").agg(F.count(F.lit(1)).alias("times")).join(counts, ["tag", "part"])
    met = hot_join(asked, wanted, ["tag", "part"], "phrase", "times")
    found = met.groupBy("tag", "phrase", "words", "a").agg(*(F.max(F.when(F.col("cut") == i, F.col("f"))).alias(f"c{i}") for i in range(len(cuts))))
    with_n = spread_join(found, totals, "tag", "phrase")
    exact = lambda name: F.col(name).cast("decimal(19,0)")

    def score(i: int) -> Column:
        over = (exact("a") * F.lit(1000).cast("decimal(4,0)")).cast("decimal(22,0)") * exact("n")
        return F.call_function("div", over.cast("decimal(38,0)"), (exact(f"c{i}") * exact(f"c{i + 1}")).cast("decimal(38,0)"))

    each = [F.when(F.col(f"c{i}").isNotNull(), F.struct(score(i).alias("score"), F.lit(k).alias("k"), F.col(f"c{i}").alias("l"), F.col(f"c{i + 1}").alias("r"))) for i, (k, side) in enumerate(cuts) if side == 0]
    lowest = F.array_min(F.array_compact(F.array(*each)))
    return with_n.withColumn("least", lowest).select("tag", "phrase", "words", "a", "least.l", "least.r", "n", "least.score")


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, top: int = TOP, covered: int = 100) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``longest`` words.

    Candidates occur ``least`` times, as a says; n are the language's words, l and r the occurrences of the two parts at
    the lowest-scoring cut, score is floor(1000 * a * n / (l * r)), in decimals of 38 digits. A candidate inside a longer one of at least
    ``covered`` percent of its occurrences goes. Null texts are empty, a null language is ``und``; repeated rows count
    repeatedly, and an empty table gives no rows. All counts are over all rows.
    """
    if longest < 2:
        raise ValueError("phrases have two words at least")
    pieces = weighted(pieces_of(docs, text, lang).select(F.concat_ws(" ", _tag(F.col("lang")), "piece").alias("piece")))
    total = docs.agg(F.sum(F.octet_length(docs[text]))).first()[0] or 0
    packed = pack_documents(pieces, doc_id="weight", text="piece", total=total)
    phrases = stored(frequent_phrases(packed, longest, least))
    totals = word_totals(packed)
    some = phrases.where("words > 1")
    inside = some.where("words > 2").select("tag", F.col("a").alias("around"), F.explode(_parts(F.col("phrase"), F.col("words"), longest)).alias("phrase"))
    around = inside.groupBy("tag", "phrase").agg(F.max("around").alias("around"))
    kept = scored(phrases, totals, longest).join(around, ["tag", "phrase"], "left").where(F.coalesce(100 * F.col("around") < covered * F.col("a"), F.lit(True)))
    by_score = Window.partitionBy("tag").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(by_score).cast("long")).where(F.col("rank") <= top)
    return ranked.select(_untagged(F.col("tag")).alias("lang"), "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents WHERE text IS NOT NULL
), cut AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
weighted AS (SELECT lang, w, count(*) AS m FROM cut WHERE len(w) > 0 GROUP BY lang, w),
totals AS (SELECT lang, sum(len(w) * m)::BIGINT AS n FROM weighted GROUP BY lang),
starts AS (SELECT lang, w, m, unnest(range(1, len(w) + 1)) AS i FROM weighted),
grams AS (
    SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k, sum(m)::BIGINT AS a
    FROM starts, (SELECT unnest(range(1, 6)) AS k) AS sizes WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING sum(m) >= 100
), found AS (SELECT *, string_split(phrase, ' ') AS w FROM grams WHERE k > 1),
cuts AS (
    SELECT lang, phrase, a, c AS cut, array_to_string(w[1:c], ' ') AS before, array_to_string(w[c + 1:k], ' ') AS after
    FROM found, (SELECT unnest(range(1, 5)) AS c) AS places WHERE c < k
), scored AS (
    SELECT cuts.lang, cuts.phrase, cuts.a, one.a AS l, two.a AS r, n, cut,
           ((1000::HUGEINT * cuts.a * n) // (one.a::HUGEINT * two.a))::BIGINT AS score
    FROM cuts JOIN grams AS one ON cuts.lang = one.lang AND before = one.phrase
    JOIN grams AS two ON cuts.lang = two.lang AND after = two.phrase JOIN totals ON cuts.lang = totals.lang
), lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
    SELECT lang, array_to_string(w[s:s + z - 1], ' ') AS phrase, max(a) AS around
    FROM found, (SELECT unnest(range(2, 5)) AS z) AS sizes, (SELECT unnest(range(1, 5)) AS s) AS places
    WHERE z < k AND s + z - 1 <= k GROUP BY ALL
), kept AS (
    SELECT lowest.* FROM lowest LEFT JOIN inside ON lowest.lang = inside.lang AND lowest.phrase = inside.phrase
    WHERE around IS NULL OR 100 * around < 100 * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000
"""
