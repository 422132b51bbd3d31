import hashlib
import random

import numpy as np
import pytest
import zstandard

from dossier.llm import batches, debruijn, suffixes

SCHEMA = "doc_id long, text string, n_words string, batch_id string"


def sample():
    rng = random.Random(4)
    word = lambda: rng.choice(["a", "be", "ñandú", "word", "longer", "Ț"])
    passage = [" ".join(word() + str(rng.randrange(99)) for _ in range(40)) for _ in range(3)]
    rows = [(5, None), (6, ""), (7, "few words here"), (7, passage[0]), (None, passage[0] + " end")]
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.randrange(60))) for _ in range(3)]
        parts.insert(rng.randrange(3), passage[rng.randrange(3)][rng.randrange(20) :])
        rows.append((100 - i, rng.choice([" ", "\n", "  "]).join(parts)))
    rows += [(200, rows[10][1]), (201, rows[10][1]), (201, rows[10][1]), (202, "la " * 3000), (203, "x" + "la " * 2000), (204, "z" * 5000), (205, "y" + "z" * 4000)]
    return [(i, t, None, "clash") for i, t in rows]


def order(i):
    return float("inf") if i is None else i


def brute(rows, units, size):
    """(id, units, removed flags) of each row."""
    first = {}
    cut = {k: units(t) for k, (_, t, *_) in enumerate(rows)}
    for k, (i, *_) in enumerate(rows):
        u = cut[k]
        for j in range(len(u) - size + 1):
            key = tuple(u[j : j + size]) if isinstance(u, list) else u[j : j + size]
            first[key] = min(first.get(key, float("inf")), order(i))
    for k, (i, *_) in enumerate(rows):
        u, gone = cut[k], [False] * len(cut[k])
        for j in range(len(u) - size + 1):
            key = tuple(u[j : j + size]) if isinstance(u, list) else u[j : j + size]
            if first[key] < order(i):
                gone[j : j + size] = [True] * size
        yield i, u, gone


@pytest.fixture(params=[1 << 20, 3000])
def batch_bytes(request, monkeypatch):
    """One batch for all, and many small ones."""
    from dossier.llm import batches

    monkeypatch.setattr(batches, "BATCH_BYTES", request.param)
    monkeypatch.setattr(batches, "PART_BYTES", request.param)
    monkeypatch.setattr(suffixes, "PART_BYTES", request.param)
    return request.param


def test_words_against_brute_force(spark, batch_bytes):
    rows = sample()
    got = sorted((order(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in debruijn.without_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect())
    want = []
    for i, u, gone in brute(rows, lambda t: (t or "").encode().split(), 13):
        kept = b" ".join(x for x, g in zip(u, gone, strict=True) if not g)
        want.append((order(i), len(u), sum(gone), hashlib.sha256(kept).hexdigest()))
    assert got == sorted(want)


def test_bytes_against_brute_force(spark, batch_bytes):
    rows = sample()
    got = sorted((order(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.without_repeated_bytes(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect())
    want = []
    for i, u, gone in brute(rows, lambda t: (t or "").encode(), 50):
        kept = bytes(x for x, g in zip(u, gone, strict=True) if not g)
        spans = sum(g and not p for g, p in zip(gone, [False, *gone], strict=False))
        want.append((order(i), len(u), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    assert got == sorted(want)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert debruijn.without_repeats(empty).count() == 0
    assert suffixes.without_repeated_bytes(empty).count() == 0


def test_deep_shallow_order_is_that_of_equal_strings():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    data[1000:1200] = data[200:400]
    data[2000:2130] = data[230:360]
    data[2040] = 120
    at = np.arange(len(data) - 50)
    label = suffixes.equal_suffixes(data, at, 50)
    seen = {}
    for a in at:
        seen.setdefault(data[a : a + 50].tobytes(), []).append(int(label[a]))
    groups = [set(v) for v in seen.values() if len(v) > 1]
    assert groups and all(len(g) == 1 for g in groups) and len({g.pop() for g in map(set, groups)}) == len(groups)
    for key, labels in seen.items():
        if len(labels) == 1 and labels[0] >= 0:  # a trie's leaf of one string has a number of its own
            assert sum(labels[0] in v for v in seen.values()) == 1


def test_blind_trie_sorts():
    rng = random.Random(3)
    strings = [bytes(rng.choice(b"ab") for _ in range(6)) for _ in range(60)]
    trie = suffixes.BlindTrie(6)
    for i, s in enumerate(strings):
        trie.insert(s, i)
    found = [sorted({strings[i] for i in g}) for g in trie.groups()]
    assert all(len(f) == 1 for f in found) and [f[0] for f in found] == sorted(set(strings))


def words_removed(spark, rows):
    return {r.doc_id: (r.n_words, r.n_removed) for r in debruijn.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_words_whose_power_sums_collide(spark):
    """Two Thue-Morse words have equal sums of powers modulo 2^64, whatever the base."""
    one = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{i}" for i in range(12))
    assert words_removed(spark, [(1, f"{one} {rest}"), (2, f"{two} {rest}"), (3, f"{two} {rest}")]) == {1: (13, 0), 2: (13, 0), 3: (13, 13)}


@pytest.mark.parametrize("each", [1000, 2])
def test_colliding_hashes_are_asked_again(spark, monkeypatch, each):
    """Hashes of two bits a word lead to wrong sources, which their words disprove; the next seed finds the right ones."""
    real = debruijn.word_hashes
    monkeypatch.setattr(debruijn, "word_hashes", lambda d, s, e, seed: real(d, s, e, seed) & np.uint64(3 if not seed else (1 << 64) - 1))
    monkeypatch.setattr(debruijn, "CLAIMS_EACH", each)
    rows = [(i, t) for i, t, *_ in sample() if i is not None]
    want = {}
    for i, u, gone in brute(rows, lambda t: (t or "").encode().split(), 13):
        want.setdefault(i, []).append((len(u), sum(gone)))
    got = {}
    for r in debruijn.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_removed))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


@pytest.mark.parametrize("dtype", [np.uint8, np.uint32, np.uint64, np.int64])
def test_cells_keep_their_numbers_and_are_small(dtype):
    rng = np.random.default_rng(6)
    info = np.iinfo(dtype)
    for n in (1, 2, 50, 8000):
        x = rng.integers(info.min, info.max, n, dtype=dtype, endpoint=True)
        for values in (x, np.sort(x), np.full(n, info.max, dtype), np.sort(x)[::-1]):
            found = batches.uncell(batches.cell(values), dtype)
            assert found.dtype == dtype and (found == values).all()
    keys = np.sort(rng.integers(0, 1 << 32, 8000, dtype=np.uint32))
    assert len(batches.cell(keys)) < 0.75 * len(batches.planes(keys)) and len(batches.cell(keys)) < 0.95 * len(zstandard.compress(batches.planes(keys), 3))
