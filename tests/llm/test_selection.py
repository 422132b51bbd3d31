import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from dossier.llm import decontam, mixing, quality, ranks, sharding

DOCS = "doc_id long, text string, source string, key string, digest string, size string"


def docs(spark, n=400):
    rng = random.Random(6)
    rows = [(i, " ".join("w" * rng.randrange(1, 5) for _ in range(rng.randrange(60))), rng.choice(["b", "ă", "B", "zz", None] + ["hot"] * 4), "k", None, "1") for i in range(n)]
    rows += [(None, None, None, None, None, None), (n, "", "b", None, None, None), (n + 1, "v " * 20_000, "b", None, None, None), (7, rows[7][1], rows[7][2], None, None, None), (n + 2, "", "empty", None, None, None)]
    return rows, spark.createDataFrame(rows, DOCS)


def brute_targets(rows):
    return plain.targets([(s, plain.size_of(t)) for _, t, s, *_ in rows])


def test_mix_meets_targets(spark):
    rows, table = docs(spark)
    got = mixing.mix(table.repartition(5)).collect()
    sizes, target = brute_targets(rows)
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in got)
    source = {(i, len((t or "").split())): s for i, t, s, *_ in rows}
    taken = Counter()
    for r in got:
        s = source[r.doc_id, r.size]
        taken[s] += r.taken
        assert r.source_size == sizes[s] and abs(r.target - target[s]) < 1e-6
    assert all(abs(taken[s] - target[s]) <= mixing.PACKET for s in sizes)
    queue = plain.queue([(i, s, t) for i, t, s, *_ in rows])
    want = sorted((i if i is not None else -1, plain.size_of(t), queue[k, 0] + queue[k, 1]) for k, (i, t, *_) in enumerate(rows))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.taken) for r in got) == want
    again = mixing.mix(table.repartition(2)).collect()
    assert sorted((r.doc_id or -1, r.size, r.taken) for r in got) == sorted((r.doc_id or -1, r.size, r.taken) for r in again)


def test_mix_stream_holds_what_the_mix_took(spark):
    rows, table = docs(spark)
    stream = mixing.mix_stream(table)
    assert stream.columns == table.columns
    words = defaultdict(int)
    for r in stream.collect():
        words[r.source] += len((r.text or "").split())
    _, target = brute_targets(rows)
    assert all(abs(words[s] - target[s]) <= mixing.PACKET for s in target)
    copies = Counter(r.doc_id for r in stream.collect())
    assert max(n for i, n in copies.items() if i != 7) == 2 and copies[7] <= 4  # two passes, and one document is there twice
    texts = {i: t for i, t, *_ in rows}
    assert sum(r.text != texts[r.doc_id] for r in stream.collect()) <= len(target)  # one cut copy a source at most


def test_mix_of_nothing(spark):
    none = spark.createDataFrame([], DOCS)
    assert mixing.mix(none).count() == 0 and mixing.mix_stream(none).count() == 0
    wordless = spark.createDataFrame([(1, "", "a", None, None, None), (2, None, None, None, None, None)], DOCS)
    assert [(r.size, r.target, r.taken) for r in mixing.mix(wordless).collect()] == [(0, 0.0, 0)] * 2


def test_running_sums(spark):
    rows = [(g, f"{random.Random(i).getrandbits(128):032x}", i % 7) for i, g in enumerate(["hot"] * 300 + ["cold"] * 5)]
    got = ranks.running_sums(spark.createDataFrame(rows, "g string, d string, v long"), "g", "d", "v", "before").collect()
    for r in got:
        assert r.before == sum(v for g, d, v in rows if g == r.g and d < r.d)


def test_shards_follow_the_key_alone(spark):
    rows, table = docs(spark, 3000)
    got = sharding.shard_rows(table).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"key"} and {r.shard for r in got} <= set(range(40))
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(r.grown_shard in (r.shard, 40) for r in got) and 30 < sum(r.grown_shard == 40 for r in got) < 150
    text = {i: t for i, t, *_ in rows}
    assert all(r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode()) and r.size == len((text[r.doc_id] or "").encode()) + 16 for r in got)
    tree = sharding.shard_tree(40)
    keys = {None: "n"} | {i: f"d{i}" for i, *_ in rows if i is not None}
    assert all(r.shard == plain.shard(keys[r.doc_id], tree) and r.grown_shard == plain.shard(keys[r.doc_id], sharding.with_one_more(tree)) for r in got)
    some = sharding.shard_rows(table.where("doc_id % 3 = 0")).collect()
    whole = {r.doc_id: r.shard for r in got}
    assert all(whole[r.doc_id] == r.shard for r in some)
    assert sharding.shard_rows(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("shards", [1, 7, 31, 43])
def test_one_more_shard_takes_rows_only_into_itself(spark, shards):
    _, table = docs(spark, 3000)
    got = sharding.shard_rows(table, shards=shards).collect()
    assert {r.shard for r in got} <= set(range(shards)) and all(r.grown_shard in (r.shard, shards) for r in got)
    assert sum(r.grown_shard == shards for r in got) > 0


def test_a_changed_weight_moves_rows_in_its_subtree_only(spark):
    tree = sharding.shard_tree(40)
    heavier = {r: {k: dict(s) for k, s in v.items()} for r, v in tree.items()}
    heavier["r1"]["r1/k0"][12] = 6.0
    keys = spark.range(6000).select(F.col("id").cast("string").alias("k"))
    both = sharding.tree_shard(sharding.tree_shard(keys, "k", tree, "a"), "k", heavier, "b").where("a <> b").collect()
    region = lambda s: s // 10
    assert both and all(region(r.b) == 1 for r in both)  # rows come into the region that grew, and none moves elsewhere
    inside = [r for r in both if region(r.a) == 1]
    assert all(r.b // 5 == 2 for r in inside)  # within it, into the rack that grew
    counts = Counter(r.b for r in sharding.tree_shard(keys, "k", heavier, "b").collect())
    assert counts[12] > 3 * np.median(list(counts.values()))


QUESTION = "A train leaves Berlin at 12 km per hour and meets Alice after 30 minutes while the river bank stays quiet today"


def test_leaks_and_reparameterised_leaks(spark):
    other = QUESTION.replace("Berlin", "Madrid").replace("12", "95").replace("Alice", "Bob").replace("30", "7").replace("km", "miles")
    mixed = "A train leaves Berlin at 12 km per hour and then Alice went home because nothing else could be said of this river at all"
    rows = [(1, f"start of a text. {QUESTION}, and more"), (2, f"words before {other} words after"), (3, mixed), (4, None), (5, ""), (None, QUESTION), (6, " ".join(QUESTION.split()[:9])), (7, "clean text " * 5000)]
    rows += [(8, QUESTION.replace(" ", "\n").upper().replace("A TRAIN", "A train"))]
    table = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, item_id string, h string")
    items = spark.createDataFrame([(1, QUESTION), (2, None), (3, ""), (4, "Alice Bob Carl Dan Eve Fay")], "item_id long, text string")
    got = {r.doc_id: r for r in decontam.leaks(table, items).collect()}
    assert set(got) == {1, 2, None} and not got[1].reparameterised and got[2].reparameterised
    kept = decontam.decontaminate(table, items)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {3, 4, 5, 6, 7, 8}
    assert decontam.leaks(table.limit(0), items).count() == 0 and decontam.leaks(table, items.limit(0)).count() == 0


def test_inconsistent_slots_are_no_leak(spark):
    item = "Alice gave 5 pears to Bob and then Alice took 5 pears back from Bob in the garden behind the house"
    same = item.replace("Alice", "Zoe").replace("Bob", "Tim").replace("5", "8")
    wrong = "Zoe gave 8 pears to Tim and then Max took 3 pears back from Ann in the garden behind the house"
    table = spark.createDataFrame([(1, same), (2, wrong)], "doc_id long, text string")
    found = decontam.leaks(table, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert [r.doc_id for r in found.collect()] == [1]


def test_classifier_reads_every_byte_and_learns(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    good = lambda: " ".join(word() for _ in range(rng.randrange(20, 300)))
    rows = [(i, good() if i % 2 else " ".join(word() + "$$$" for _ in range(100)), i % 2) for i in range(300)]
    table = spark.createDataFrame([(i, t, None) for i, t, _ in rows] + [(500, None, "s"), (501, "", "s"), (502, "x" * 400_000, "s"), (7, rows[7][1], "s")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    net = quality.fit(table, labels)
    got = quality.score_documents(table, net, keep=["doc_id", "score"], out="found").collect()
    assert len(got) == 304 and all(0 <= r["found"] <= 1 for r in got)
    fold = [r for r in got if r.doc_id < 300 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([(r["found"] >= 0.3) == (r.doc_id % 2 == 1) for r in fold]) > 0.95
    kept = quality.keep_good(table, labels)
    assert kept.columns == table.columns and 250 > kept.count() > 140


def test_classifier_is_exact_over_chunks():
    """Scores do not depend on how texts are put together, and match a plain convolution over every place."""
    rng = np.random.default_rng(1)
    net = quality.Network(rng.normal(size=(256, 8)), rng.normal(size=(6, 8, 16)), rng.normal(size=16), rng.normal(size=16), rng.normal(size=16), np.array(0.1))
    texts = [b"", b"a", b"b" * 250, b"c" * 251, bytes(rng.integers(0, 256, 3000, dtype=np.uint8))]
    tables = quality._pair_tables(net)
    together = quality.scores(net, tables, texts)
    for t, s in zip(texts, together, strict=True):
        assert abs(quality.scores(net, tables, [t])[0] - s) < 1e-6
        blocks = max(1, -(-(len(t) + 5) // 256))
        padded = np.frombuffer(t + b"\0" * (blocks * 256 + 6 - len(t)), np.uint8)
        response = np.array([sum(net.emb[padded[p + k]] @ net.filters[k] for k in range(6)) for p in range(blocks * 256 - 5)])
        chunks = [response[b * 256 : (b + 2) * 256].max(axis=0) for b in range(max(1, blocks - 1))]
        act = np.maximum(np.array(chunks) + net.bias, 0)
        z = act.mean(axis=0) @ net.mean + act.max(axis=0) @ net.top + net.base
        assert abs(1 / (1 + np.exp(-z)) - s) < 1e-4


def test_classifier_without_labels(spark):
    table = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    net = quality.fit(table, none)
    assert quality.score_documents(table, net, keep=["doc_id"]).count() == 1
    assert quality.score_documents(table.limit(0), net, keep=["doc_id"]).count() == 0


def test_one_long_labelled_text_does_not_end_the_sample(spark):
    """The text that does not fit is passed over; those after it are learnt from as before."""
    ids = sorted((i for i in range(200) if zlib.crc32(str(i).encode()) % 5), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())[:60]
    words = {0: "zzzz xxxx qqqq ", 1: "the good text of it "}
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, quality int")
    rows = [(i, words[k % 2] * 12) for k, i in enumerate(ids)]
    for texts in (rows, [(ids[0], words[0] * 3000), *rows[1:]]):
        docs = spark.createDataFrame(texts, "doc_id long, text string")
        net = quality.fit(docs, labels, sample_bytes=20_000)
        got = {r.doc_id: r.score for r in quality.score_documents(docs, net, keep=["doc_id"]).collect()}
        assert all((got[i] > 0.5) == bool(k % 2) for k, i in enumerate(ids))
