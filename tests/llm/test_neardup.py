import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from dossier.llm import graph, simhash, vectors

DOCS = "doc_id long, text string, source string, fp string, component_id string"


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, linked):
    """values: {id: value}. The smallest id that links reach."""
    label = {i: i for i in values}
    changed = True
    while changed:
        changed = False
        for a in values:
            for b in values:
                if label[b] < label[a] and (a == b or linked(values[a], values[b])):
                    label[a], changed = label[b], True
    return label


def texts():
    rng = random.Random(5)
    words = ["ala", "Bala", "ÎN", "port", "o", "cal", "mare", "x1"]
    base = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(4)]
    rows = [(None, "null id"), (1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "one"), (6, "two words")]
    for i in range(40):
        t = base[i % 4].split()
        t[rng.randrange(200)] = "changed"
        rows.append((10 + i, "\n".join(t)))
    rows += [(60, base[0]), (61, base[0]), (61, base[0]), (62, "long " * 70_000)]
    return [(i, t, None, "a", "b") for i, t in rows]


def test_simhash_against_brute_force(spark):
    rows = texts()
    got = simhash.near_duplicate_components(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    want = {i: brute_fingerprint(t) for i, t, *_ in rows if i is not None}
    assert all(r.fp % (1 << 64) == want[r.doc_id] for r in got if r.doc_id is not None)
    label = brute_components(want, lambda a, b: (a ^ b).bit_count() <= 3)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == label
    assert label[2] == label[3] == 1  # texts without words are alike


def test_simhash_empty_table(spark):
    assert simhash.near_duplicate_components(spark.createDataFrame([], DOCS)).count() == 0


def test_every_pair_within_the_radius_shares_a_bucket():
    masks = [m % (1 << 64) for m in simhash.covering_masks()]
    rng = random.Random(1)
    for _ in range(2000):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 3):
            b ^= 1 << bit
        assert any(a & m == b & m for m in masks)


def test_small_blocks_find_the_same_links(spark):
    """Hot buckets are divided by more masks and then by pairs of blocks; no link is lost on the way."""
    rng = random.Random(2)
    centre = rng.getrandbits(63)
    fps = {centre}
    while len(fps) < 150:
        fps.add(rng.choice(sorted(fps)) ^ (1 << rng.randrange(20)))
    prints = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = brute_components({f: f for f in fps}, lambda a, b: (a ^ b).bit_count() <= 3)
    for block, levels in ((4, 1), (8, 2), (500, 2)):
        edges = simhash.fingerprint_links(prints, block=block, levels=levels)
        got = {r.node: r.component for r in graph.connected_components(edges).collect()}
        assert {f: got.get(f, f) for f in fps} == want


def test_one_of_each_stays(spark):
    kept = simhash.keep_one_of_each(spark.createDataFrame(texts(), DOCS))
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == ["doc_id", "text", "source", "fp", "component_id"]
    assert ids.count(None) == 1 and len(set(ids)) == len(ids) and 1 in ids and 2 not in ids


def test_rows_of_one_id_with_different_texts_stay(spark):
    words = lambda w: " ".join(f"{w}{i}" for i in range(40))
    rows = [(1, words("a")), (1, words("b")), (1, words("a")), (2, words("b")), (3, words("c"))]
    kept = simhash.keep_one_of_each(spark.createDataFrame([(i, t, None, "a", "b") for i, t in rows], DOCS))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, words("a")), (1, words("b")), (3, words("c"))]


def test_components_of_paths_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(31)) and all(got[i] == 100 for i in range(100, 140)) and len(got) == 71
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors_table(spark):
    rng = np.random.default_rng(3)
    rows = [(1, None), (2, []), (3, [0.0] * 40), (4, [1.0] * 39 + [None]), (5, [float("nan")] * 40), (6, [1.0]), (None, [1.0] * 40)]
    centre = rng.normal(size=40)
    for i in range(120):
        v = rng.normal(size=40) if i % 3 == 0 else centre + rng.normal(size=40) * 0.2 * (i % 5)
        rows.append((10 + i, v.tolist()))
    rows += [(200, centre.tolist()), (201, centre.tolist()), (202, (centre * 1e30).tolist()), (203, (centre * 1e-30).tolist())]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_cosine_links_against_brute_force(spark):
    rows, table = vectors_table(spark)
    good = {i: np.array(v) for i, v in rows if i is not None and i >= 10}
    cos = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.95
    label = brute_components(good, cos)
    for tile in (4096, 16):
        got = {r.vec_id: r for r in vectors.cosine_components(table, tile=tile).collect()}
        assert len(got) == len(rows)
        for i, v in good.items():
            assert got[i].n_links == sum(cos(v, w) for j, w in good.items() if j != i)
            assert got[i].component_id == label[i] and got[i].kept == (i == label[i])
        assert all(got[i].n_links == 0 and got[i].kept and got[i].component_id == i for i in range(1, 7))


@pytest.mark.parametrize("dense", [0.0, 2.0])
def test_a_dense_cluster_is_linked_in_full(spark, monkeypatch, dense):
    """Whether or not products are taken to the end at once, and over several tiles."""
    monkeypatch.setattr(vectors, "DENSE", dense)
    rng = np.random.default_rng(4)
    centre = rng.normal(size=24)
    x = np.vstack([centre + rng.normal(size=(900, 24)) * 0.02, rng.normal(size=(300, 24))])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    got = {r.vec_id: r for r in vectors.cosine_components(table, tile=200).collect()}
    assert [got[i].n_links for i in range(1200)] == want.tolist()
    assert {got[i].component_id for i in range(900)} == {0} and len({r.component_id for r in got.values()}) > 290


def test_hot_keys_alone_are_copied(spark):
    many = spark.range(5000).select(F.when(F.col("id") < 3000, 7).otherwise(F.col("id")).alias("k"), "id")
    one = many.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("v"))
    joined = graph.hot_join(many, one, ["k"], "id", "n")
    assert joined.count() == 5000 and set(joined.columns) == {"k", "id", "v"} and joined.where("k = 7 and v <> 0").count() == 0


def test_cosine_empty_table(spark):
    assert vectors.cosine_components(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_hot_keys_are_spread(spark):
    many = spark.range(1000).select(F.lit(7).alias("k"), "id")
    one = spark.createDataFrame([(7, "x"), (8, "y")], "k int, v string")
    joined = graph.spread_join(many, one, "k", "id")
    assert joined.count() == 1000 and joined.columns == ["k", "id", "v"]
