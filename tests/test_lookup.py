import random

import pytest
from pyspark.sql import functions as F

from dossier.operators import routing


def brute(chunks, questions):
    found = []
    for q, asked, doc in questions:
        near = [(d, k) for k, d in chunks if None not in (asked, k) and doc in (None, d) and (k == asked or k.startswith(asked + "."))]
        near = [x for x in near if x[1] == asked] or near
        found += [(q, n, d, k) for n, (d, k) in enumerate(sorted(near), 1)]
    return sorted(found)


@pytest.mark.parametrize("most", [100_000, 0])
def test_exact_or_children_against_brute_force(spark, monkeypatch, most):
    """With asked keys broadcast or shuffled; keys of up to fifteen parts, empty parts, nulls and repeated questions."""
    monkeypatch.setattr(routing, "BROADCAST_KEYS", most)
    rng = random.Random(3)
    key = lambda n: ".".join(rng.choice(["1", "2", "10", "(a)"]) for _ in range(n))
    deep = ["1.2." * 6 + end for end in ("1", "1.2", "2", "1.2.10")]
    chunks = sorted({(key(rng.randrange(1, 5)), rng.choice("ABC")) for _ in range(300)}) + [(k, "A") for k in deep] + [(None, "A"), ("", "B"), ("7..1", "C")]
    asked = ["1", "1.2", "10.(a).2", "2.2.2.2", "99", "7", "7.", "", None, *deep, "1.2." * 4 + "1", "1.2." * 5 + "1.2"] + [key(3) for _ in range(20)]
    questions = [(n, a, rng.choice([None, "A", "B"])) for n, a in enumerate(asked)]
    rows = spark.createDataFrame(chunks, "key string, document string")
    got = routing.exact_or_children(rows, spark.createDataFrame(questions, "question int, asked string, document string"), key="key", question="question", order=["document", "key"])
    assert sorted(map(tuple, got.select("question", "seq", "document", "key").collect())) == brute(chunks, questions)


def test_chunks_are_read_once_and_not_multiplied(spark, tmp_path):
    spark.range(2000).select(F.concat_ws(".", F.col("id") % 40, F.col("id")).alias("key"), F.lit("A").alias("document")).write.parquet(str(tmp_path / "c"))
    asked = spark.createDataFrame([(1, "3", None), (2, "5.45", None)], "question int, asked string, document string")
    found = routing.exact_or_children(spark.read.parquet(str(tmp_path / "c")), asked, key="key", question="question", order=["document", "key"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    kinds = [line.lstrip(" :+-*()0123456789").split(" ")[0] for line in plan.splitlines()]
    below = kinds[kinds.index("Generate") + 1 :]
    assert kinds.count("FileScan") == 1 and kinds.count("Generate") == 1
    assert below.index("Filter") < below.index("BroadcastHashJoin") < below.index("FileScan")
    assert found.count() == 51
