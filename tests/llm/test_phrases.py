import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest import TESTDATA

from dossier.llm import batches, phrases
from dossier.llm.phrases import OP11_SQL, collocations, op11_collocations

SCHEMA = "doc_id long, text string, lang string, phrase string, tag string, weight string"


def brute(rows, longest=5, least=100, top=2000, covered=100):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(str.maketrans(phrases.UPPER, phrases.LOWER))):
            w = re.findall("[^ \t]+", piece)
            totals[lang] += len(w)
            counts.update((lang, tuple(w[i : i + n])) for n in range(1, longest + 1) for i in range(len(w) - n + 1))
    found = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    around = Counter()
    for (lang, p), a in found.items():
        for n in range(2, len(p)):
            for i in range(len(p) - n + 1):
                around[lang, p[i : i + n]] = max(around[lang, p[i : i + n]], a)
    out = {}
    for (lang, p), a in found.items():
        if 100 * around[lang, p] < covered * a:
            n = totals[lang]
            score, _, l, r = min((1000 * a * n // (counts[lang, p[:k]] * counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p)))
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r, n))
    return sorted((lang, i, p.decode(), -a, l, r, n, -s) for lang, ps in out.items() for i, (s, a, p, l, r, n) in enumerate(sorted(ps)[:top], 1))


def sample(seed):
    rng = random.Random(seed)
    words = ["the", "THE", "of", "ţară", "Ţară", "New", "york", "\x1c", "a b", "w" * 90] + [f"w{i}" for i in range(12)]
    passages = ["new york stock exchange today", "of the", "the the the the", "x1 x2 x3 x4 x5 x6"]
    rows = []
    for _ in range(150):
        parts = [rng.choice([rng.choice(passages), " ".join(rng.choices(words, k=rng.randrange(1, 9)))]) + rng.choice([".", ", ", "\n", "\t", "  ", " "]) for _ in range(rng.randrange(12))]
        rows.append(("".join(parts), rng.choice(["en", "en", "en", None, "", "de x", "und"])))
    return rows + [(None, "en"), ("", "en"), (" .,\t;", None), ("la " * 3000, "fr"), ("one two", "lonely")] + rows[:20] * 2


def made(spark, rows):
    return spark.createDataFrame([(i, t, lang, "clash", "clash", "clash") for i, (t, lang) in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize("batch_bytes,part_bytes,options", [(1 << 20, 12 << 20, {"least": 5}), (600, 2000, {"least": 5}), (600, 2000, {"least": 3, "covered": 60, "top": 9}), (5000, 2000, {"longest": 3, "least": 8}), (5000, 2000, {"longest": 2, "least": 8})])
def test_phrases_are_those_of_plain_counting(spark, monkeypatch, batch_bytes, part_bytes, options):
    monkeypatch.setattr(batches, "BATCH_BYTES", batch_bytes)
    monkeypatch.setattr(batches, "TASK_BYTES", 4 * batch_bytes)
    monkeypatch.setattr(batches.pack_documents, "__kwdefaults__", {"part_bytes": part_bytes, "total": None})
    rows = sample(batch_bytes)
    got = sorted(map(tuple, collocations(made(spark, rows), **options).collect()))
    assert got == brute(rows, **options) and len(got) > 5


def test_empty_tables(spark):
    assert collocations(made(spark, [])).count() == 0 and collocations(made(spark, [(None, None)])).count() == 0


def test_products_beyond_64_bits_are_exact(spark):
    a, n, left, right = 4 * 10**12, 9 * 10**14, 5 * 10**12 + 1, 6 * 10**12 + 7
    rows = spark.createDataFrame([("t", "x y", 2, a), ("t", "x", 1, left), ("t", "y", 1, right)], "tag string, phrase string, words int, a long")
    got = phrases.scored(rows, spark.createDataFrame([("t", n)], "tag string, n long"), 5).collect()
    assert [tuple(r) for r in got] == [("t", "x y", 2, a, left, right, n, 1000 * a * n // (left * right))]


def test_a_bucket_beyond_memory_is_counted_on_disk(monkeypatch):
    rng = np.random.default_rng(1)
    key = rng.integers(0, 3_000_000, 4_000_000).astype(np.uint32)
    monkeypatch.setattr(phrases, "BUCKET_MEMORY", "60MB")
    got = phrases.frequent_keys({"key": key, "weight": np.full(len(key), 2)}, 10)
    assert sorted(got.tolist()) == np.nonzero(np.bincount(key) >= 5)[0].tolist()


def test_query_agrees_with_its_sql(spark, oracle, same):
    same(op11_collocations(spark, f"{TESTDATA}/sf0.01").toPandas(), oracle(OP11_SQL, "sf0.01"))


def test_pieces_are_weighted_without_a_shuffle(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "One two.  one TWO;three", "en"), (2, "one two! x", None), (3, None, "en")], "doc_id long, text string, lang string").coalesce(1)
    pieces = phrases.pieces_of(docs, "text", "lang")
    assert sorted(map(tuple, pieces.collect())) == [("en", "one two"), ("en", "one two"), ("en", "three"), ("und", "one two"), ("und", "x")]
    for stretch, want in ((1 << 20, [(b"one two", 3), (b"three", 1), (b"x", 1)]), (1, None)):
        monkeypatch.setattr(phrases, "STRETCH", stretch)
        found = phrases.weighted(pieces)
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        rows = sorted((bytes(r.piece), r.weight) for r in found.collect())
        assert sum(n for _, n in rows) == 5 and (want is None or rows == want)


def test_sorted_stretches_and_short_keys_ask_with_fewer_bytes(spark):
    """Before, pieces came as they were met and keys had 32 bits: the cells of this stretch took over a third more bytes."""
    rows = spark.read.parquet(f"{TESTDATA}/sf0.01/documents.parquet").coalesce(1)
    found = phrases.weighted(phrases.pieces_of(rows, "text", "lang").select(phrases.F.concat_ws(" ", phrases._tag(phrases.F.col("lang")), "piece").alias("piece"))).collect()
    texts = [bytes(r.piece) for r in found]
    assert texts == sorted(set(texts))

    def asked(pieces, bits):
        data = b"".join(pieces)
        batch = batches.Batch(0, np.ones(len(pieces), np.int64), np.frombuffer(data, np.uint8), np.r_[0, np.cumsum([len(p) for p in pieces])])
        grams = phrases.Grams(batch)
        at = grams.places(2)
        part, columns = phrases.count_question(grams.hashes(at, 2), grams.weights(at), 43)
        assert int(columns["key"].max()).bit_length() == phrases.KEY_BITS == bits
        return sum(len(c) for _, places in batches._split(part) for c in batches._row(columns, places))

    short = asked(texts[: len(texts) // 2], 24)
    mixed = random.Random(1).sample(texts, len(texts))[: len(texts) // 2]
    phrases.KEY_BITS = 32
    try:
        assert 4 * short < 3 * asked(mixed, 32)
    finally:
        phrases.KEY_BITS = 24


def test_keys_that_collide_change_no_result(spark, monkeypatch):
    monkeypatch.setattr(phrases, "KEY_BITS", 4)
    rows = sample(7)
    assert sorted(map(tuple, collocations(made(spark, rows), least=5).collect())) == brute(rows, least=5)
