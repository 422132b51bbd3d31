import random

import numpy as np
import pytest
from test_neardup import DOCS, brute_components

from dossier.llm import jaccard, simhash


def grams(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)) if words)


def near(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def texts():
    """Texts of 300 words with a block of others in place of theirs, at similarities about 0.8, and chains of them."""
    rng = random.Random(11)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows = [(None, "null id"), (1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "one"), (6, "two words")]
    for i in range(30):
        base = words(300)
        rows.append((100 + 10 * i, " ".join(base)))
        for j in range(1, 5):
            n = rng.randrange(2, 60)
            if j == 4:
                base = rows[-1][1].split()
            at = rng.randrange(300 - n)
            rows.append((100 + 10 * i + j, " ".join(base[:at] + words(n) + base[at + n :]).upper()))
    rows += [(900, rows[7][1]), (901, rows[7][1]), (901, rows[7][1])]
    return [(i, t, None, "a", "b") for i, t in rows]


@pytest.mark.parametrize("block", [128, 3])
def test_near_duplicates_against_brute_force(spark, block):
    rows = texts()
    want = brute_components({i: grams(t) for i, t, *_ in rows if i is not None}, near)
    kept = simhash.keep_one_of_each(spark.createDataFrame(rows, DOCS), block=block)
    assert kept.columns == ["doc_id", "text", "source", "fp", "component_id"]
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(want.values())) and ids.count(None) == 1
    assert want[2] == want[3] == 1 and want[5] == 4
    far = [(simhash.fingerprint_of(simhash.shingle_hashes((t or "").encode())), i) for i, t, *_ in rows if i is not None and 100 <= i < 900]
    assert sum((a ^ b).bit_count() > 3 for a, i in far for b, j in far if i < j and want[i] == want[j]) > 20


def test_a_family_around_the_similarity_is_compared_in_full(spark):
    """Each text is like its neighbours only; the first of a band does not stand for the others."""
    rng = random.Random(12)
    line = [f"w{rng.randrange(9000)}" for _ in range(900)]
    rows = [(i, " ".join(line[10 * i : 10 * i + 200]), None, "a", "b") for i in range(60) if i != 30 and i != 31]
    want = brute_components({r[0]: grams(r[1]) for r in rows}, near)
    for block in (128, 4):
        got = {r.doc_id: r.component_id for r in jaccard.similar_components(spark.createDataFrame(rows, DOCS), block=block).collect()}
        assert got == want and len(set(want.values())) == 2


def test_bands_reach_the_similarity():
    rng = np.random.default_rng(3)
    met = 0
    for _ in range(400):
        x = rng.integers(0, 1 << 64, 220, dtype=np.uint64)
        a, b = np.unique(x[:200]), np.unique(np.concatenate([x[:178], x[200:]]))
        assert jaccard.similar(a, b) == (len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)))
        met += bool(np.isin(jaccard.band_keys(a), jaccard.band_keys(b)).any())
    assert met >= 398
    assert (jaccard.band_keys(np.zeros(0, np.uint64)) == jaccard.band_keys(np.zeros(0, np.uint64))).all()


def test_nothing_to_compare(spark):
    assert jaccard.similar_components(spark.createDataFrame([], DOCS)).count() == 0


def flipped(rng, prints, bits, n):
    """The same words with n of the given bits turned."""
    out = prints.copy()
    for b in rng.choice(bits, n, replace=False):
        out[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    return out


def test_candidates_come_from_simhashes_under_covering_masks():
    rng = np.random.default_rng(4)
    bits = np.array([64 * w + b for w in range(jaccard.KEY_WORDS) for b in range(64 // jaccard.PART_BITS * jaccard.PART_BITS)])
    for _ in range(300):
        x = rng.integers(0, 1 << 64, jaccard.KEY_WORDS, dtype=np.uint64)
        y = flipped(rng, x, bits, jaccard.PARTS * (jaccard.RADIUS + 1) - 1)
        one, other = jaccard.covering_keys(np.stack([x, y]).view(np.int64))
        assert (one == other).any()
    hashes = rng.integers(0, 1 << 64, 700, dtype=np.uint64)
    words = jaccard.wide_fingerprint(hashes)
    assert len(set(words.tolist())) == len(words) == jaccard.KEY_WORDS + jaccard.CHECK_WORDS
    for word, t, p in zip(words, jaccard.TIMES, jaccard.PLUS, strict=True):
        assert simhash.fingerprint_of(jaccard.mixed(hashes * t + p)) == word
    assert not jaccard.wide_fingerprint(np.zeros(0, np.uint64)).any()


@pytest.mark.parametrize("most", [None, 1000, 7])
def test_groups_in_small_large_and_divided_buckets(spark, most):
    rng = np.random.default_rng(5)
    rows = []
    for bucket, n in ((5, 900), (-3, 40), (8, 2), (9, 1), (2, 300)):
        prints = [rng.integers(0, 1 << 64, 2, dtype=np.uint64)]
        while len(prints) < n:
            prints.append(flipped(rng, prints[rng.integers(len(prints))], np.arange(128), 20) if rng.random() < 0.5 else rng.integers(0, 1 << 64, 2, dtype=np.uint64))
        rows += [(bucket, *map(int, p.view(np.int64))) for p in prints]
    got = jaccard._grouped(spark.createDataFrame(rows, "bucket long, p0 long, p1 long"), most).collect()
    sizes = {b: sum(r[0] == b for r in rows) for b in (5, -3, 8, 9, 2)}
    large = {b for b, n in sizes.items() if most and n > most}
    assert sorted((r.band, r.p0, r.p1) for r in got if r.whole) == sorted(r for r in rows if r[0] in large)
    bits = lambda a, b: sum((x ^ y).bit_count() for x, y in zip((a[0] % 2**64, a[1] % 2**64), (b[0] % 2**64, b[1] % 2**64), strict=True))
    want = set()
    for b in set(sizes) - large:
        root = brute_components({r[1:]: r[1:] for r in rows if r[0] == b}, lambda x, y: bits(x, y) <= jaccard.NEAR)
        want |= {frozenset(k for k, v in root.items() if v == top) for top in set(root.values())}
    bands = {}
    for r in got:
        if not r.whole:
            bands.setdefault(r.band, set()).add((r.p0, r.p1))
    assert set(map(frozenset, bands.values())) == {g for g in want if len(g) > 1}


def test_divided_buckets_lose_no_pair(spark):
    """With seven fingerprints a task at most, texts without words and their likes share buckets that are cut into parts."""
    rng = random.Random(13)
    base = [f"w{rng.randrange(9000)}" for _ in range(400)]
    rows = [(i, " ".join(base[: 5 * i] + [f"x{i}"] + base[5 * i :])) for i in range(60)]
    texts = spark.createDataFrame([(str(i), t) for i, t in rows], "node string, text string")
    bands = {}
    for r in jaccard._banded(texts, 5, 7).collect():
        bands.setdefault(r.band, set()).add(r.node)
    met = {(a, b) for nodes in bands.values() for a in nodes for b in nodes if a < b}
    assert met == {(a, b) for a, _ in texts.collect() for b, _ in texts.collect() if a < b}


@pytest.mark.parametrize("packs", [1, 2])
def test_links_across_packs_join_what_all_pairs_do(packs):
    rng = np.random.default_rng(6)
    for _ in range(40):
        base = rng.integers(0, 1 << 64, 60, dtype=np.uint64)
        sets = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
        for _ in range(30):
            sets.append(np.unique(np.r_[base[rng.random(60) < 0.9], rng.integers(0, 1 << 64, rng.integers(0, 8), dtype=np.uint64)]))
        pack, root = rng.integers(0, packs, len(sets)), [f"r{i % 27}" for i in range(len(sets))]
        near = {i: {j for j in range(len(sets)) if root[i] == root[j] or ((packs == 1 or pack[i] != pack[j]) and jaccard.similar(sets[i], sets[j]))} for i in range(len(sets))}
        want = brute_components({i: i for i in near}, lambda i, j: j in near[i])
        found = jaccard.links_across(root, pack, sets, jaccard.SIMILARITY)
        got = brute_components({i: i for i in near}, lambda i, j: root[i] == root[j] or (root[i], root[j]) in found or (root[j], root[i]) in found)
        assert got == want and len(found) < len(set(root))


def test_a_text_meets_a_pack_once_however_many_bands_they_share(spark, monkeypatch):
    """Rows that tasks compare grow with a family and not with its square; before, each band had a row for each text and block."""
    rng = random.Random(14)
    base = [f"w{rng.randrange(9000)}" for _ in range(150)]
    rows = [(i, " ".join(f"x{rng.randrange(10**6)}" if rng.random() < 0.035 else w for w in base), None, "a", "b") for i in range(300)]
    made, through = [], jaccard._links_in_blocks
    monkeypatch.setattr(jaccard, "_links_in_blocks", lambda blocks, similarity: made.append(blocks.count()) or through(blocks, similarity))
    got = {r.doc_id: r.component_id for r in jaccard.similar_components(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == brute_components({r[0]: grams(r[1]) for r in rows}, near)
    assert made[0] <= len(rows) and len(set(got.values())) > 1


def test_a_family_has_a_row_for_each_text_and_not_for_each_table(spark):
    """Rows that joins carry for a text of a large family are few; before, it had one for nearly each of its 84 tables."""
    rng = random.Random(15)
    base = [f"w{rng.randrange(9000)}" for _ in range(300)]
    rows = [(i, " ".join(f"x{rng.randrange(10**6)}" if rng.random() < 0.01 else w for w in base), None, "a", "b") for i in range(200)]
    texts = spark.createDataFrame([(str(r[0]), r[1]) for r in rows], "node string, text string")
    found = jaccard._banded(texts, 5, 4096).collect()
    assert len({tuple(r) for r in found}) == len(found) <= 2 * len(rows)
    got = {r.doc_id: r.component_id for r in jaccard.similar_components(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == brute_components({r[0]: grams(r[1]) for r in rows}, near)


def test_a_label_of_several_packs_loses_no_link(spark, monkeypatch):
    """Neighbours along a line of texts are in different packs of about 32 kB, each two of which meet."""
    rng = random.Random(16)
    line = [f"w{rng.randrange(9000)}" for _ in range(1200)]
    rows = [(i, " ".join(line[10 * i : 10 * i + 200]), None, "a", "b") for i in range(90) if i not in (30, 31, 60, 61)]
    packs, through = [], jaccard._packed
    monkeypatch.setattr(jaccard, "_packed", lambda rooted, most: packs.append(through(rooted, most)) or packs[0])
    got = {r.doc_id: r.component_id for r in jaccard.similar_components(spark.createDataFrame(rows, DOCS), block=1).collect()}
    assert got == brute_components({r[0]: grams(r[1]) for r in rows}, near) and len(set(got.values())) == 3
    assert max(r.parts for r in packs[0].collect()) > 1


def test_others_come_to_the_family_that_has_most():
    group, family = np.array([0, 4, 0, 0, 4, 2, 6, 6]), np.array([9, 7, 9, -3, 5, 1, 8, 8])
    lead, several = jaccard.leading(group, family)
    assert lead.tolist() == [9, 5, 9, 9, 5, 1, 8, 8] and several.tolist() == [True, True, True, True, True, False, False, False]
    assert all(len(x) == 0 for x in jaccard.leading(group[:0], family[:0]))
