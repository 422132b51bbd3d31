"""Leaks against a matcher that reads every document for every item."""

import random

import plain
import pytest

from dossier.llm import decontam

def brute(docs, items):
    return {(d, i): found for i, item in items for d, text in docs if (found := plain.plain_leak(text, item))}


def brute_templates(docs, items):
    return {(d, i): found for i, item in items for d, text in docs if (found := plain.template_leak(text, item))}


def tables(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(rng.randrange(15, 40)).capitalize() + f" in {i} km.") for i in range(8)]
    items += [(20, "Alice Bob Carl Dan Eve Fay"), (21, "The Old Man And The Sea"), (22, "12 7 9 33 81 5 60"), (23, "Quokka zebu"), (24, "Gnu"), (25, None), (26, "?!")]
    docs = [(0, None), (1, ""), (2, "Gnus quokka. Zebra")]
    for i, t in items:
        for form in (str, str.upper, str.lower, str.title):
            docs.append((len(docs), f"{prose(30)} {form(t or '')} {prose(30)}"))
        docs += [(len(docs), t), (len(docs) + 1, prose(9) + " " + " ".join((t or "").split()[: len((t or "").split()) * 9 // 10]) + " " + prose(9))]
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_verbatim_leaks_against_brute_force(spark):
    docs, items, table, bench = tables(spark)
    want = brute(docs, items)
    got = {(r.doc_id, r.item_id): (r.n_windows, r.n_item_windows) for r in decontam.verbatim_leaks(table, bench).collect()}
    assert got == want and {i for _, i in want} == {*range(8), 20, 21, 22, 23, 24}
    everything = decontam.all_leaks(table, bench)
    pairs = [(r.doc_id, r.item_id) for r in everything.collect()]
    assert len(set(pairs)) == len(pairs) and set(pairs) >= set(want)
    assert everything.columns == decontam.leaks(table, bench).columns
    assert set(pairs) == set(want) | {(r.doc_id, r.item_id) for r in decontam.leaks(table, bench).collect()}
    kept = {r.doc_id for r in decontam.decontaminate(table, bench, verbatim=True).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in pairs}


def test_verbatim_leaks_of_nothing(spark):
    *_, table, bench = tables(spark)
    assert decontam.all_leaks(table.limit(0), bench).count() == 0 and decontam.all_leaks(table, bench.limit(0)).count() == 0


QUIZ = [
    "A train leaves Berlin at 12 km per hour and meets Alice after 30 minutes while the river bank stays quiet",
    "Ben has 5kg of flour and $1,200.50 in his drawer, so how much more than 3 pounds would he need for a cake?",
    "the sum of 3 and 4 is given to the first of 7 boys who asks for it before noon",
    "Alice Bob Carl Dan Eve Fay",
    "short one",
    "",
    None,
]


def reworded(rng, item):
    """The item with other numbers, names and units, mostly the same one for the same."""
    swap = {"Berlin": "Oslo", "Alice": "Zoe", "Ben": "Tim", "12": "95", "30": "7.5", "5kg": "8lbs", "$1,200.50": "$9", "3": "44", "4": "5", "7": "2", "km": "miles", "pounds": "pesos"}
    words = []
    for w in (item or "").split():
        w = swap.get(w, w)
        words.append(rng.choice(["Max", "x"]) if rng.random() < 0.04 else w)
    return " ".join(words)


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_template_leaks_against_brute_force(spark, monkeypatch, few):
    """Broadcast or not, the places and the values of slots are those that a plain matcher finds."""
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", few)
    rng = random.Random(5)
    items = list(enumerate(QUIZ)) + [(None, "Nobody knows that Carl ran 5 miles on the 3rd day of the week in the old town")]
    docs = [(0, None), (1, ""), (2, "short one"), (3, "Short One more")]
    for _, item in items * 6:
        said = rng.choice([item or "", reworded(rng, item), (item or "").upper(), " ".join((item or "").split()[3:])])
        docs.append((len(docs), rng.choice(["", "He said: "]) + said + rng.choice(["", " And then 5 more.", "\n" + said])))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_templates(docs, items)
    got = {(r.doc_id, r.item_id): (r.n_windows, r.n_item_windows, r.reparameterised) for r in decontam.leaks(table, bench).collect()}
    assert got == want and {i for _, i in want} >= {0, 1, 2, None} and {c for *_, c in want.values()} == {True, False}
    both = {(r.doc_id, r.item_id) for r in decontam.all_leaks(table, bench).collect()}
    assert both == set(want) | set(brute(docs, items))


def test_rows_are_judged_one_by_one(spark):
    """Null and repeated ids, of documents and items, lose no row and taint no other."""
    item = "the quick brown fox jumps over the lazy dog near the river bank at dawn"
    docs = [(None, f"see {item}"), (None, "clean text of no use"), (None, None), (7, "another clean text here"), (7, f"again {item} ok"), (7, f"again {item} ok")]
    table = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], "doc_id long, text string, doc string, h string")
    bench = spark.createDataFrame([(None, item), (3, "zebras eat more grass than lions do on any summer day"), (3, item)], "item_id long, text string")
    found = decontam.all_leaks(table, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(None, None), (None, 3), (7, None), (7, 3)} and len(found) == 4
    for verbatim in (True, False):
        kept = decontam.decontaminate(table, bench, verbatim=verbatim)
        assert kept.columns == table.columns
        assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, ""), (0, "clean text of no use"), (7, "another clean text here")]
