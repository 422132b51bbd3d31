import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest import TESTDATA

from dossier.llm import ranking
from dossier.llm.ranking import OP12_SQL, op12_treap_search, rank_documents

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top=20):
    cut = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    n, total = len(cut), sum(c[2] for c in cut)
    df = Counter(t for _, c, _ in cut for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, size in cut:
            m = 75 + 25 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if s:
                scores.append((-s, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return sorted(out, key=str)


def ask(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, score int, item_id string")
    q = spark.createDataFrame([(i, t, 2, "y") for i, t in items], "item_id long, text string, rank int, doc_id string")
    return sorted(map(tuple, rank_documents(d, q, **options).collect()), key=str)


def corpus(seed, n=400):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["the", "The", "țară", "ÉCOLE", "École", "a1b2"]
    weights = [1 / (1 + i) for i in range(len(words))]
    docs = [(rng.randrange(10**6) - 5 * 10**5, rng.choice([" ", ", ", "-"]).join(rng.choices(words, weights, k=rng.randrange(1, 60)))) for _ in range(n)]
    docs += [(7, docs[0][1])] * 3 + [(8, None), (9, ""), (None, docs[1][1]), (None, docs[1][1]), (10, " .,;! "), (11, "the " * 20_000), (12, docs[0][1]), (-3, docs[0][1])]
    items = [(k, " ".join(rng.choices(words, k=rng.randrange(1, 12)))) for k in range(25)] + [(90, None), (91, ""), (92, "unknown words"), (93, docs[0][1]), (93, "the the w3"), (None, "w5")]
    return docs, items


@pytest.mark.parametrize("step,block_docs,slice_bytes", [(256, 1 << 15, 1 << 21), (3, 1 << 15, 50), (16, 40, 300)])
def test_ranks_are_those_of_a_full_scan(spark, monkeypatch, step, block_docs, slice_bytes):
    for name, value in (("STEP", step), ("BLOCK_DOCS", block_docs), ("SLICE_BYTES", slice_bytes)):
        monkeypatch.setattr(ranking, name, value)
    docs, items = corpus(step)
    assert ask(spark, docs, items) == brute(docs, items)
    assert ask(spark, docs, items, top=3) == brute(docs, items, 3)


def test_questions_in_several_blocks_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(ranking, "QUESTIONS", 7)
    docs, items = corpus(9, 60)
    assert ask(spark, docs, items) == brute(docs, items)
    assert ask(spark, [], items) == [] and ask(spark, docs, []) == [] and ask(spark, [(1, None)], items) == []


def test_terms_of_one_hash_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(ranking, "word_hashes", lambda data, start, end, seed: (end - start).astype(np.uint64))
    docs, items = corpus(4, 80)
    assert ask(spark, docs, items) == brute(docs, items)


def test_subtrees_are_pruned():
    rng = np.random.default_rng(1)
    n = 20_000
    postings = [(t, np.sort(rng.choice(n, size, replace=False))) for t, size in ((0, n), (1, n // 2), (2, 40), (3, 15))]
    term = np.concatenate([np.full(len(d), t) for t, d in postings])
    doc = np.concatenate([d for _, d in postings])
    impact = rng.integers(400_000, 500_000, len(doc))
    treaps = ranking.build_treaps(term, doc, impact)
    weights = [5, 700, 6000, 7000]
    best = ranking.Best(20)
    scored = ranking.traverse(treaps, np.arange(n) * 3, [0, 1, 2, 3], weights, best)
    full = np.zeros(n, np.int64)
    np.add.at(full, doc, impact * np.array(weights)[term])
    order = np.lexsort((np.arange(n), -full))[:20]
    assert (best.id == order * 3).all() and (best.score == full[order]).all()
    assert scored < n // 20


def test_products_beyond_64_bits_are_exact():
    counts, sizes = np.array([3, 1]), np.array([10**9, 5])
    n, total = 10**12, 10**15
    assert ranking.impacts(counts, sizes, n, total).tolist() == [10**9 * c // (1000 * c + 12 * (75 + 25 * s * n // total)) for c, s in ((3, 10**9), (1, 5))]


def test_query_agrees_with_its_sql(spark, oracle, same):
    same(op12_treap_search(spark, f"{TESTDATA}/sf0.001").toPandas(), oracle(OP12_SQL))
