"""The stages of the pipeline against plain Python, each on what the one before it kept; and all queries against their SQL."""

import random
from collections import Counter

import plain
import pytest
from conftest import TESTDATA
from pyspark.sql import functions as F
from test_neardup import brute_components

import corpus_pipeline
from dossier.llm import quality, queries, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long, component_id string, label string, key string"


def tables():
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(3, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(12) + f" Anna pays {i + 3} euros " + prose(6)) for i in range(5)] + [(None, prose(14))]
    texts = [prose(rng.randrange(30, 200)) for _ in range(110)]
    for i in range(0, 30, 3):
        words = texts[i].split()
        words[rng.randrange(len(words))] = "altered"
        texts += [texts[i + 1], " ".join(words)]
    texts += [prose(20) + " " + t + " " + prose(20) for _, t in items]
    texts += [prose(20) + " " + items[1][1].replace("Anna", "Maria").replace("4", "17").replace("euros", "pesos") + " " + prose(9)]
    texts += [prose(6000)]
    junk = [" ".join(word() + "$$#" for _ in range(60)) for _ in range(60)]
    rows = [(i, t, "en", rng.choice(["a", "b", "c", None, "hot", "hot", "hot"]), len(t), "clash", None, "k") for i, t in enumerate(texts + junk)]
    labels = [(i, int(i < len(texts)), 0) for i in range(0, len(rows)) if i % 4] + [(None, 1, 0), (5, None, 0)]
    rows += [(None, None, None, None, None, None, None, None), (None, texts[4], "en", "a", 1, None, None, None), (3, texts[3], "en", "a", 1, None, None, None), (900, "", "en", "a", 0, None, None, None), (901, None, "en", "b", 0, None, None, None)]
    return rows, labels, items


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, labels, items = tables()
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, items


def test_stages_against_plain_python(spark, folder):
    path, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    rows = lambda df: sorted(((r.doc_id, r.source, r.text) for r in df.collect()), key=str)

    before, kept = rows(docs), stages["quality"](spark, docs, path).cache()
    net = quality.fit(docs, spark.read.parquet(f"{path}/labels.parquet"))
    scored = [quality.scores(net, quality._pair_tables(net), [(t or "").encode()])[0] for *_, t in before]
    assert kept.columns == docs.columns and rows(kept) == [r for r, s in zip(before, scored, strict=True) if s >= 0.3]
    assert sum("$$#" in (r[2] or "") for r in rows(kept)) < 5 and len(rows(kept)) > 130

    before, one = rows(kept), stages["near_duplicates"](spark, kept, path).cache()
    root = brute_components({i: plain.grams(t) for i, _, t in before if i is not None}, lambda a, b: len(a & b) >= 0.8 * len(a | b))
    assert one.columns == docs.columns
    got = rows(one)
    assert sorted(i for i, *_ in got if i is not None) == sorted(set(root.values())) and len(root) - len(set(root.values())) >= 19
    assert [r for r in got if r[0] is None] == [r for r in before if r[0] is None]

    before, clean = got, stages["decontamination"](spark, one, path).cache()
    holds = lambda t: any(plain.template_leak(t, i) or plain.plain_leak(t, i) for _, i in items)
    assert clean.columns == docs.columns and rows(clean) == [r for r in before if not holds(r[2])] and len(before) - clean.count() == 7

    before, mixed = rows(clean), stages["mixing"](spark, clean, path).cache()
    taken = plain.queue(before)
    want = Counter()
    for (k, _), n in taken.items():
        if n:
            want[before[k][0], before[k][1], plain.size_of(before[k][2]), n] += 1
    text_of = {(i, s): t for i, s, t in before}
    found = Counter((r.doc_id, r.source, plain.size_of(text_of[r.doc_id, r.source]), plain.size_of(r.text)) for r in mixed.collect())
    assert mixed.columns == docs.columns and found == want

    last = stages["sharding"](spark, mixed, path).collect()
    tree = sharding.shard_tree(sharding.SHARDS)
    assert len(last) == mixed.count() and all(r.shard == plain.shard("n" if r.doc_id is None else f"d{r.doc_id}", tree) for r in last)
    whole = corpus_pipeline.run(spark, path)
    assert sorted(map(str, whole.collect())) == sorted(map(str, last))


def test_stages_take_empty_tables(spark, folder, tmp_path):
    path, _ = folder
    none = spark.read.parquet(f"{path}/documents.parquet").where(F.lit(False))
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, none, path)
        assert made.count() == 0 and (name == "sharding" or made.columns == none.columns)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_agrees_with_its_sql(name, spark, oracle, same):
    same(queries.QUERIES[name](spark, f"{TESTDATA}/sf0.001").toPandas(), oracle(queries.ORACLES[name]))
