"""Connected components: equal to a plain union-find on graphs of many forms, in few jobs."""

import random
import uuid

from pyspark.sql import functions as F

from dossier.llm import graph


def united(edges):
    above = {}

    def root(x):
        while above.setdefault(x, x) != x:
            x = above[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            low, high = sorted((root(a), root(b)))
            above[high] = low
    return {x: root(x) for x in list(above)}


def test_components_of_random_graphs_with_hot_nodes(spark, monkeypatch):
    rng = random.Random(5)
    name = lambda i: f"{i * 7919 % 100_003:05d}"
    edges = [(rng.randrange(900), rng.randrange(900)) for _ in range(700)]  # near the size at which one component takes all
    edges += [(1000 + i, 1001 + i) for i in range(200)] + [(2000, 2000 + i) for i in range(1, 300)] + [(2300 + i, 2600) for i in range(300)]
    edges += [(3000 + i, 3000 + (i * 37 + 5) % 101) for i in range(101)]
    named = [(name(a), name(b)) for a, b in edges] + [(None, "x"), ("y", None)]
    for few, hot in ((graph.FEW, graph.HOT), (0, 100), (0, 20)):
        monkeypatch.setattr(graph, "FEW", few)
        monkeypatch.setattr(graph, "HOT", hot)
        for rows, kind in ((edges, "long"), (named, "string")):
            frame = spark.createDataFrame(rows, f"a {kind}, b {kind}").repartition(5)
            got = graph.connected_components(frame).collect()
            assert len(got) == len({r.node for r in got})
            assert {r.node: r.component for r in got} == united(rows)


def test_components_take_few_jobs(spark):
    """The driver keeps each job's stages and tasks: contraction a neighbour at a time took some sixty jobs for this graph."""
    edges = spark.range(2000).select(F.col("id").alias("a"), (F.col("id") - F.col("id") % 40 + F.pmod(F.xxhash64("id"), F.lit(40))).alias("b")).repartition(8)
    group = f"components-{uuid.uuid4().hex}"
    spark.sparkContext.setJobGroup(group, "components")
    try:
        graph.connected_components(edges)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) <= 20
