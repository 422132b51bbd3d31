"""Cleaning and coverage of whole documents: equal to the rules line by line, and linear in the lines."""

import random
import time

from pyspark.sql import functions as F

from dossier.operators import chunking

HEADER = "MONITORUL OFICIAL AL ROMÂNIEI, PARTEA I, Nr. 7/1.I.2020"


def test_headers_and_plus_signs_as_line_by_line(spark):
    rng = random.Random(3)
    kinds = [HEADER, "", " ", "12", " 3 ", "text", "12345", "+", " + ", "Articolul 4 x", "Capitolul II Titlu", "Secțiunea 2 x", "IV. TITLU MARE", "IV. Titlu mic", "a +", "\r"]
    texts = ["\n".join(rng.choice(kinds) for _ in range(rng.randrange(40))) for _ in range(300)]
    texts += ["+", "+\n\n\nArticolul 1 x", "+\n+\nArticolul 1 x", "+\nIV. TITLU\nCapitolul I x", "+\nx\nArticolul 1 x", "", "\n", HEADER]
    df = spark.createDataFrame(list(enumerate(texts)), "d int, text string").repartition(4)
    arrays = df.select("d", F.split("text", "\n").alias("lines")).withColumn("kinds", chunking._line_kinds(F.col("lines")))
    bare = arrays.select("d", F.array_join(chunking._bare_lines(F.col("lines"), F.col("kinds")), "\n").alias("text"))
    joined = lambda rows: {r.d: r.text for r in rows.collect()}
    lines = chunking.without_headers(chunking.to_lines(df, "d"), "d")
    want = joined(chunking.from_lines(lines, "d"))
    assert joined(bare) == {d: want.get(d, "") for d in range(len(texts))}
    other = joined(df.select("d", chunking._other_lines(F.split("text", "\n")).alias("text")))
    want = joined(chunking.from_lines(chunking.without_chapter_lines(chunking.to_lines(df, "d"), "d"), "d"))
    assert other == {d: want.get(d, "") for d in range(len(texts))}


def test_a_document_of_many_lines_is_cleaned_in_linear_time(spark):
    block = [HEADER, "", "17", "un rând de text obișnuit cu cifre 12", "+", "alt rând", "", "+", "", "Articolul 3 text"]
    seconds = []
    for lines in (8_000, 80_000):
        df = spark.createDataFrame([(1, "\n".join(block * (lines // len(block))))], "d int, text string")
        began = time.time()
        got = chunking.clean_text(df, "d").collect()[0].text.split("\n")
        seconds.append(time.time() - began)
        assert len(got) == lines // len(block) * 7  # a header, the number after it and one plus sign go
    assert seconds[1] < 10 * seconds[0] + 6


def test_coverage_is_the_share_of_line_starts_held(spark):
    rng = random.Random(1)
    word = lambda: rng.choice(["alfa", "beta", "gama", "delta", "1.2.3.", "(4)", "Articolul 7", "țară"])
    texts, chunks = [], []
    for d in range(40):
        lines = [" ".join(word() for _ in range(rng.randrange(1, 25))) for _ in range(rng.randrange(30))]
        texts.append((d, "\n".join(lines)))
        chunks += [(d, i, x) for i, x in enumerate(lines) if rng.random() < 0.6]
    texts += [(90, "scurt"), (91, "x" * 60 + "\n" + "x" * 60), (92, "1.2.3. " * 20), (93, ("z" * 50 + " MONITORUL OFICIAL"))]
    t, c = spark.createDataFrame(texts, "d int, text string"), spark.createDataFrame(chunks, "d int, chunk_order int, text string")
    got = {r.d: r.coverage for r in chunking.line_coverage(t, c, "d").collect()}
    key = lambda rows: {(r[0], r[1]): r[2] for r in rows.select("d", "k", chunking.coverage_text(F.col("text")).alias("n")).collect()}
    split = [(d, k, x.strip()) for d, text in texts for k, x in enumerate(text.split("\n"))]
    long = [(d, k, x) for d, k, x in split if len(x) >= 50 and "MONITORUL OFICIAL" not in x]
    starts = key(spark.createDataFrame(long, "d int, k int, text string"))
    whole = key(spark.createDataFrame([(d, 0, " ".join(x for e, _, x in chunks if e == d)) for d, _ in texts], "d int, k int, text string"))
    for d, _ in texts:
        mine = [n[:45] for (e, _), n in starts.items() if e == d]
        assert got[d] == (sum(bool(n) and n in whole[d, 0] for n in mine) / len(mine) if mine else 1.0)
