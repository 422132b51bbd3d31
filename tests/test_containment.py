"""Quotes in texts, against a plain search of all pairs."""

import random

from dossier.operators import citations


def test_quotes_of_any_length_are_found_without_a_nested_loop(spark):
    rng = random.Random(2)
    word = lambda: rng.choice(["a", "ab", "abc", "țară", "codul", "np010", "x.y", "🙂🙂", "cod", "zabcz", "q" * 300])
    texts = [(i, rng.choice([" ", "  ", "\n"]).join(word() for _ in range(rng.randrange(40)))) for i in range(150)] + [(900, None), (901, ""), (902, "abc"), (903, "xab cdx")]
    pieces = [" ".join((t or "").split()) for _, t in texts]
    quotes = []
    for k in range(200):
        source = rng.choice(pieces)
        at = rng.randrange(len(source) + 1)
        quotes.append((k, source[at : at + rng.randrange(1, 30)]))
    quotes += [(500, None), (501, " "), (502, "a"), (503, "ab cd"), (504, "b c"), (505, "unknown"), (506, "🙂 🙂"), (507, "qqq"), (508, "abc zz")]
    t, q = spark.createDataFrame(texts, "d int, text string"), spark.createDataFrame(quotes, "k int, quote string")
    found = citations.containing(t, q, text_id="d", text="text", quote_id="k", quote="quote")
    plain = lambda x: " ".join((x or "").split())
    want = sorted((d, k) for d, x in texts for k, y in quotes if plain(y) and plain(y) in plain(x))
    assert sorted(map(tuple, found.collect())) == want and len(want) > 2000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
