"""Aliases in questions: found as plain patterns find them, by whole keys."""

import random
import re

from pyspark.sql import functions as F

from dossier.functions import codes
from dossier.operators import routing

SEPARATOR = "[ \t\n\r\f\x0b  /-]*"


def pattern(alias):
    parts = [("0+" if not p.strip("0") else "0*" + p.lstrip("0")) if p.isdigit() else p for p in re.findall("[a-z]+|[0-9]+", alias.lower())]
    return re.compile("(?<![a-z0-9])" + SEPARATOR.join(parts) + "(?![a-z0-9])", re.I | re.A)


def sample(n, seed):
    rng = random.Random(seed)
    part = lambda: rng.choice(["np", "P", "i", "STAS", "sr", "EN", str(rng.randrange(30)), "0" + str(rng.randrange(12)), "00", "118", "2022"])
    sep = lambda: rng.choice(["", " ", "-", "/", " - ", " ", "\t"])
    alias = lambda k: "".join(part() + sep() for _ in range(k)) or "x"
    aliases = [(f"d{i % 7}", alias(rng.randrange(1, 5)).strip() or "x") for i in range(n)]
    aliases = [(d, a) for d, a in aliases if re.search("[A-Za-z0-9]", a)]
    near = lambda a: "".join(rng.choice([c, c.upper(), c.lower()]) if c.isalpha() else sep() if not c.isalnum() else c for c in a)
    filler = lambda: rng.choice(["ce spune", ".", ",", "ș", "É", "art. 3.2.1", "x1", "K", "și", alias(2)])
    texts = [rng.choice(["", " "]).join(rng.choice([filler(), near(rng.choice(aliases)[1]), " "]) for _ in range(rng.randrange(9))) for _ in range(n)]
    return aliases, [*enumerate(texts), (n, None), (n + 1, "İ I 7")]


def test_spans_are_those_of_the_patterns(spark):
    aliases, texts = sample(150, 5)
    a, q = spark.createDataFrame(aliases, "doc string, alias string"), spark.createDataFrame(texts, "q int, t string")
    got = sorted(map(tuple, codes.alias_spans(q, a, "q", "t", "doc").collect()))
    want = sorted((i, d, m.start(), m.end()) for i, t in texts if t for d, alias in aliases for m in pattern(alias).finditer(t))
    assert got == want and len(want) > 200
    assert codes.alias_spans(q, a.limit(0), "q", "t", "doc").count() == 0


def test_directives_name_aliases_at_their_start(spark):
    aliases, texts = sample(80, 8)
    rests = [(i, f"doar din {t}") for i, t in texts if t]
    a, q = spark.createDataFrame(aliases, "document_id string, alias string"), spark.createDataFrame(rests, "question_id int, text string")
    got = {r.question_id: r.documents for r in routing.restricted_documents(q, a, spark.createDataFrame([], "document_id string, article string")).collect()}
    for i, text in rests:
        rest = text.removeprefix("doar din ")
        hits = [(d, m.end()) for d, alias in aliases if (m := pattern(alias).match(rest))]
        plain = {d for d, end in hits if not re.match(SEPARATOR + "[0-9]", rest[end:])}
        assert got[i] == sorted(plain), rest


def test_many_questions_meet_many_aliases_by_whole_keys(spark):
    n = 100_000
    number = F.col("id").cast("string")
    aliases = spark.range(n).select(number.alias("doc"), F.concat(F.lit("NP "), number, F.lit("-2022")).alias("alias"))
    questions = spark.range(n).select("id", F.concat(F.lit("ce cere np"), number, F.lit("/2022 la art. 3?")).alias("t"))
    keys = questions.select(F.explode(codes.run_keys(F.col("t"), codes.most_words(aliases))).alias("k"))
    assert keys.count() < 20 * n
    assert aliases.groupBy(codes.whole_key(F.col("alias"))).count().agg(F.max("count")).first()[0] < 50  # zeros aside, no key is hot
    spans = codes.alias_spans(questions, aliases, "id", "t", "doc")
    assert spans.where("doc = cast(id as string) and start = 8").count() == n
    others = {(r.id, r.doc) for r in spans.where("doc <> cast(id as string)").collect()}
    assert others == {(int(f"{d}2022"), str(d)) for d in range(1, 10)}  # "np 12022" is one way to write "NP 1-2022"
