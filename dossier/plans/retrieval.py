"""Queries of search, evidence and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions import codes, scope
from dossier.functions.normalize import article_key, is_article_key
from dossier.operators import citations, evidence, routing, similarity
from dossier.plans.registry import query, table

SCORE = "list_cosine_similarity(e.embedding::DOUBLE[], q.v)"
Q0 = "q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0)"


def _vector(rows: DataFrame, vec_id: int) -> list[float]:
    return [float(x) for x in rows.where(F.col("vec_id") == vec_id).first()["embedding"]]


@query(f"WITH {Q0}, best AS (SELECT vec_id, {SCORE} AS s FROM embeddings e, q ORDER BY s DESC, vec_id LIMIT 10) SELECT vec_id, round(s, 6) AS score FROM best WHERE s >= 0.2")
def semantic_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    hits = similarity.accepted(similarity.top_k(rows, _vector(rows, 0), chunk_id="vec_id"), 0.2)
    return hits.select("vec_id", F.round("score", 6).alias("score"))


@query(f"WITH {Q0}, best AS (SELECT vec_id, label, {SCORE} AS s FROM embeddings e, q WHERE label IN (0, 2) ORDER BY s DESC, vec_id LIMIT 10) SELECT vec_id, label, round(s, 6) AS score FROM best WHERE s >= 0.1")
def semantic_topk_scoped(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    hits = similarity.top_k(rows, _vector(rows, 0), chunk_id="vec_id", scope=F.col("label").isin(0, 2))
    return similarity.accepted(hits, 0.1).select("vec_id", "label", F.round("score", 6).alias("score"))


@query("""SELECT question_id, vec_id, round(s, 6) AS score, rank::INTEGER AS rank FROM (
  SELECT a.vec_id AS question_id, b.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS rank
  FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0) WHERE rank <= 5""")
def semantic_topk_batch(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("question_id"), "embedding")
    return similarity.top_k_each(asked, rows, question_id="question_id", chunk_id="vec_id", k=5).withColumn("score", F.round("score", 6))


@query("""WITH q AS (SELECT vec_id AS list, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IN (0, 1)),
hits AS (SELECT e.vec_id, list, list_cosine_similarity(e.embedding::DOUBLE[], v) AS s, row_number() OVER (PARTITION BY list ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], v) DESC, e.vec_id) AS n FROM embeddings e, q)
SELECT vec_id, round(s, 6) AS score, (list + 1)::INTEGER AS list FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, list) AS k FROM hits WHERE n <= 10) WHERE k = 1 ORDER BY s DESC, list, n LIMIT 10""")
def semantic_fusion_max(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    one, two = (similarity.top_k(rows, _vector(rows, i), chunk_id="vec_id").select("vec_id", "score") for i in (0, 1))
    return similarity.fuse(one, two, chunk_id="vec_id").select("vec_id", F.round("score", 6).alias("score"), "list")


@query(f"WITH {Q0} SELECT d.doc_id, round({SCORE}, 6) AS score FROM documents d LEFT JOIN (SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN embedding END AS embedding FROM embeddings) e ON d.doc_id = e.vec_id, q WHERE {SCORE} >= 0.05")
def score_threshold_null(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    q = F.array(*map(F.lit, _vector(rows, 0)))
    some = F.when(F.col("vec_id") % 2 == 0, F.col("embedding"))
    scored = rows.select(F.col("vec_id").alias("doc_id"), similarity.cosine(some, q).alias("score"))
    joined = table(spark, d, "documents").select("doc_id").join(scored, "doc_id", "left")
    return similarity.accepted(joined, 0.05).withColumn("score", F.round("score", 6))


@query("SELECT vec_id, len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AS is_valid FROM embeddings")
def vector_valid(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", similarity.is_valid_vector(F.col("embedding")).alias("is_valid"))


@query("SELECT min(doc_id) AS doc_id, md5(text) AS content_hash FROM documents GROUP BY md5(text)")
def evidence_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.md5("text").alias("content_hash"))
    return evidence.first_of_each(rows, [], ["content_hash"], "doc_id")


@query("SELECT min(doc_id) AS doc_id, source, md5(text) AS content_hash FROM documents GROUP BY source, md5(text)")
def evidence_dedup_per_source(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "source", F.md5("text").alias("content_hash"))
    return evidence.first_of_each(rows, [], ["source", "content_hash"], "doc_id")


@query("SELECT conv_id, turn, 'C' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS citation_id FROM (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS used FROM conversations) WHERE used <= 1000")
def context_budget(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("chars"))
    kept = evidence.within_budget(rows, ["conv_id"], length="chars", seq="turn", budget=1000)
    return evidence.with_citation_ids(kept, ["conv_id"], "turn").drop("chars")


@query("SELECT conv_id, role, turn, row_number() OVER (PARTITION BY conv_id ORDER BY first_seen, chars, turn)::INTEGER AS place FROM (SELECT *, length(text) AS chars, min(turn) OVER (PARTITION BY conv_id, role) AS first_seen FROM conversations)")
def group_by_article(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "role", "turn", F.length("text").alias("chars"), F.col("turn").alias("place"))
    return evidence.grouped_by(rows, ["conv_id"], ["role"], order="chars", seq="place").drop("chars")


@query("""SELECT conv_id, role, max(place) - min(place) + 1 <> count(*) OR count(DISTINCT place) <> count(*) AS is_ambiguous
FROM (SELECT conv_id, role, md5(text) AS h, min(turn) AS place FROM conversations GROUP BY ALL) GROUP BY conv_id, role""")
def ambiguous_sequence(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").withColumn("h", F.md5("text"))
    return evidence.ambiguous(rows, ["conv_id", "role"], content="h", order="turn", seq="turn")


@query("""WITH chunks AS (SELECT l_orderkey || '.' || l_linenumber AS key, l_returnflag AS document FROM lineitem UNION ALL SELECT o_orderkey || '.0', 'O' FROM orders),
asked(question, a, doc) AS (VALUES (1, '1.0', NULL), (2, '2', NULL), (3, '3.1', NULL), (4, '999999999', NULL), (5, '4', 'N')),
found AS (SELECT question, key, document, key = a AS exact FROM chunks, asked WHERE (key = a OR key LIKE a || '.%') AND (doc IS NULL OR doc = document)),
kept AS (SELECT *, bool_or(exact) OVER (PARTITION BY question) AS hit FROM found)
SELECT question, key, document, row_number() OVER (PARTITION BY question ORDER BY document, key)::INTEGER AS seq FROM kept WHERE exact OR NOT hit""")
def exact_or_children(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.concat_ws(".", "l_orderkey", "l_linenumber").alias("key"), F.col("l_returnflag").alias("document"))
    orders = table(spark, d, "orders").select(F.concat(F.col("o_orderkey").cast("string"), F.lit(".0")).alias("key"), F.lit("O").alias("document"))
    asked = spark.createDataFrame([(1, "1.0", None), (2, "2", None), (3, "3.1", None), (4, "999999999", None), (5, "4", "N")], "question int, asked string, document string")
    return routing.exact_or_children(lines.unionByName(orders), asked, key="key", question="question", order=["document", "key"])


@query("SELECT DISTINCT doc_id, lang FROM documents JOIN labels USING (doc_id) WHERE quality = 1")
def catalog_load(spark: SparkSession, d: str) -> DataFrame:
    status = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "approved").otherwise("disabled").alias("status"))
    return routing.catalogue(status, table(spark, d, "documents"), document="doc_id", article="lang")


@query("""WITH c AS (SELECT p_partkey, p_brand || '-' || (2000 + p_size) AS code, regexp_extract_all(p_brand || '-' || (2000 + p_size), '[A-Za-z]+|[0-9]+') AS parts FROM part)
SELECT p_partkey, code AS alias FROM c UNION SELECT p_partkey, array_to_string(parts, '') FROM c UNION SELECT p_partkey, array_to_string(parts[:-2], '') FROM c WHERE len(parts) > 1 AND regexp_full_match(parts[-1], '[0-9]{4}')""")
def alias_variants(spark: SparkSession, d: str) -> DataFrame:
    code = F.concat("p_brand", F.lit("-"), (F.col("p_size") + 2000).cast("string"))
    return table(spark, d, "part").select("p_partkey", F.explode(codes.alias_variants(code)).alias("alias"))


@query("""WITH raw AS (SELECT l_orderkey, l_linenumber, l_orderkey || '. ' || l_linenumber || chr(160) || '.(' || l_returnflag || ')' || CASE WHEN l_linenumber % 2 = 0 THEN '..' ELSE '' END || CASE WHEN l_orderkey % 5 = 0 THEN '!' ELSE '' END AS raw FROM lineitem)
SELECT l_orderkey, l_linenumber, rtrim(lower(regexp_replace(raw, '[ \\t\\n\\r\\f\\v\\x{00a0}\\x{202f}]', '', 'g')), '.') AS article, regexp_full_match(rtrim(lower(regexp_replace(raw, '[ \\t\\n\\r\\f\\v\\x{00a0}\\x{202f}]', '', 'g')), '.'), '[a-z0-9().-]+') AS is_valid FROM raw""")
def article_normalize(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.col("l_orderkey").cast("string"), F.lit(". "), F.col("l_linenumber").cast("string"), F.lit(" .("), "l_returnflag", F.lit(")"), F.when(F.col("l_linenumber") % 2 == 0, "..").otherwise(""), F.when(F.col("l_orderkey") % 5 == 0, "!").otherwise(""))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", article_key(raw).alias("article"))
    return rows.withColumn("is_valid", is_article_key(F.col("article")))


@query("SELECT conv_id, turn, string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS embedding_text FROM conversations WHERE role = 'user'")
def context_window_text(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").where("role = 'user'")
    return similarity.embedding_text(turns, conversation="conv_id", order="turn", text="text").select("conv_id", "turn", "embedding_text")


@query("SELECT conv_id, turn, array_to_string(list_filter(string_split(text, ' ')[:4], lambda c: length(c) BETWEEN 1 AND 64), '|') AS codes FROM conversations")
def context_codes_filter(spark: SparkSession, d: str) -> DataFrame:
    found = routing.usable_codes(F.split("text", " "))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(found, "|").alias("codes"))


@query()
def normative_refs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.concat("text", F.lit(" conform SR EN "), F.col("doc_id") + 1000, F.lit("-1 si NP 0"), F.col("doc_id") % 100, F.lit("-2013 ANEXA I 5-2")).alias("text"))
    return codes.drop_contained(codes.code_spans(rows, "doc_id", "text"), "doc_id")


SPANS = "spans AS (SELECT DISTINCT user_id, event_id % 97 AS s, event_id % 97 + 1 + event_id % 23 AS e FROM events)"


def _spans(spark: SparkSession, d: str) -> DataFrame:
    start = (F.col("event_id") % 97).cast("int")
    return table(spark, d, "events").select("user_id", start.alias("start"), (start + 1 + F.col("event_id") % 23).cast("int").alias("end")).distinct()


@query(f"WITH {SPANS} SELECT user_id, s::INTEGER AS start, e::INTEGER AS \"end\" FROM spans a WHERE NOT EXISTS (SELECT 1 FROM spans b WHERE a.user_id = b.user_id AND b.s <= a.s AND a.e <= b.e AND (b.s < a.s OR a.e < b.e))")
def contained_span_prune(spark: SparkSession, d: str) -> DataFrame:
    return codes.drop_contained(_spans(spark, d), "user_id")


@query(f"WITH {SPANS} SELECT user_id, s::INTEGER AS start, e::INTEGER AS \"end\" FROM spans a WHERE s % 2 = 1 AND NOT EXISTS (SELECT 1 FROM spans b WHERE b.s % 2 = 0 AND a.user_id = b.user_id AND b.s <= a.s AND a.e <= b.e)")
def uncovered_span_guard(spark: SparkSession, d: str) -> DataFrame:
    rows = _spans(spark, d)
    return codes.uncovered(rows.where("start % 2 = 1"), rows.where("start % 2 = 0"), "user_id")


@query(f"WITH {SPANS} SELECT DISTINCT a.user_id FROM spans a JOIN spans b ON a.user_id = b.user_id AND a.s < b.e AND b.s < a.e AND a.s % 3 <> b.s % 3")
def colliding_aliases(spark: SparkSession, d: str) -> DataFrame:
    rows = _spans(spark, d).withColumn("owner", F.col("start") % 3)
    return codes.colliding_keys(rows, "user_id", "owner")


@query("""WITH t AS (SELECT conv_id, turn, CASE conv_id % 5 WHEN 0 THEN 'Ce spune doar din NP-1 ' WHEN 1 THEN 'nu doar din NP-1 ' WHEN 2 THEN 'Doar din NP-1 ' WHEN 3 THEN 'te rog exclusiv din I7 ' ELSE '' END || text AS text FROM conversations),
m AS (SELECT *, regexp_extract(text, '(?s)(?:^|[^\\pL\\pN_])(nu doar din|doar din|numai din|exclusiv din) (.*)$', 1) AS word, regexp_extract(text, '(?s)(?:^|[^\\pL\\pN_])(nu doar din|doar din|numai din|exclusiv din) (.*)$', 2) AS rest FROM t)
SELECT conv_id, turn, md5(rest) AS rest_md5 FROM m WHERE word <> '' AND word <> 'nu doar din'""")
def restriction_directive(spark: SparkSession, d: str) -> DataFrame:
    which = F.col("conv_id") % 5
    lead = F.when(which == 0, "Ce spune doar din NP-1 ").when(which == 1, "nu doar din NP-1 ").when(which == 2, "Doar din NP-1 ").when(which == 3, "te rog exclusiv din I7 ").otherwise("")
    rows = table(spark, d, "conversations").select("conv_id", "turn", codes.restriction(F.concat(lead, "text")).alias("rest"))
    return rows.where("rest is not null").select("conv_id", "turn", F.md5("rest").alias("rest_md5"))


def _re2(pattern: str) -> str:
    return pattern.replace("'", "''")


@query(
    f"""WITH p AS (SELECT conv_id, turn, CASE (conv_id + turn) % 8 WHEN 0 THEN 'Calculează debitul ' WHEN 1 THEN 'Cum se calculează sarcina ' WHEN 2 THEN 'Ce debit minim prevăzut ' WHEN 3 THEN 'Solicit vă rog dimensionarea ' WHEN 4 THEN 'Câți kW îmi trebuie ' WHEN 5 THEN 'necesarul de răcire pentru 120 mp ' WHEN 6 THEN 'În ce articol ' ELSE '' END || text AS t FROM conversations),
n AS (SELECT conv_id, turn, trim(regexp_replace(strip_accents(lower(t)), '\\s+', ' ', 'g')) AS t FROM p)
SELECT conv_id, turn, CASE WHEN regexp_matches(regexp_replace(t, '{_re2(scope.METHOD_FORM)}', '', 'g'), '{_re2(scope.REQUEST)}') OR regexp_matches(regexp_replace(t, '{_re2(scope.METHOD_FORM)}', '', 'g'), '{_re2(scope.NOMINAL)}') THEN true
  WHEN regexp_matches(t, '{_re2(scope.PRESCRIBED)}') OR regexp_matches(t, '{_re2(scope.PRESCRIPTION)}') OR regexp_matches(t, '{_re2(scope.DOCUMENTARY)}') THEN false
  WHEN regexp_matches(t, '{_re2(scope.METHOD_FORM)}') OR regexp_matches(t, '{_re2(scope.METHOD)}') THEN false
  WHEN regexp_matches(t, '{_re2(scope.EXECUTION)}') THEN true
  WHEN regexp_matches(t, '{_re2(scope.POWER)}') OR regexp_matches(t, '{_re2(scope.CAPACITY)}') THEN true
  ELSE regexp_matches(t, '{_re2(scope.COOLING)}') AND regexp_matches(t, '{_re2(scope.PROJECT)}') END AS is_calculation FROM n"""
)
def scope_gate(spark: SparkSession, d: str) -> DataFrame:
    leads = ["Calculează debitul ", "Cum se calculează sarcina ", "Ce debit minim prevăzut ", "Solicit vă rog dimensionarea ", "Câți kW îmi trebuie ", "necesarul de răcire pentru 120 mp ", "În ce articol ", ""]
    lead = F.get(F.array(*map(F.lit, leads)), ((F.col("conv_id") + F.col("turn")) % 8).cast("int"))
    return table(spark, d, "conversations").select("conv_id", "turn", scope.is_calculation_request(F.concat(lead, "text")).alias("is_calculation"))


@query("SELECT doc_id, item_id FROM documents d, benchmark b WHERE contains(trim(regexp_replace(d.text, '\\s+', ' ', 'g')), trim(regexp_replace(b.text, '\\s+', ' ', 'g')))")
def literal_quote_check(spark: SparkSession, d: str) -> DataFrame:
    return citations.containing(table(spark, d, "documents"), table(spark, d, "benchmark"), text_id="doc_id", text="text", quote_id="item_id", quote="text").distinct()


@query("""WITH t AS (SELECT conv_id, turn, text || ' [C' || (turn + 1) || '] [c2] [C0] [C' || (turn + 1) || ']' AS text FROM conversations)
SELECT conv_id, turn, CASE WHEN turn = 1 THEN 'C2' ELSE 'C' || (turn + 1) || ',C2' END AS ids FROM t""")
def cited_ids(spark: SparkSession, d: str) -> DataFrame:
    n = (F.col("turn") + 1).cast("string")
    text = F.concat("text", F.lit(" [C"), n, F.lit("] [c2] [C0] [C"), n, F.lit("]"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(citations.cited_ids(text), ",").alias("ids"))


@query("""WITH p AS (SELECT event_id, event_id % 4 = 0 OR event_id % 4 = 3 AND json_valid(props) AND list_sort(json_keys(props)) = ['gasit', 'pasaje', 'raspuns'] AS valid FROM events)
SELECT event_id, valid, valid AS found, valid::INTEGER AS passages FROM p""")
def strict_json(spark: SparkSession, d: str) -> DataFrame:
    good = F.to_json(F.struct(F.lit("vezi [C1]").alias("raspuns"), F.array(F.struct(F.lit("c1").alias("id"), F.lit("x").alias("citat"))).alias("pasaje"), F.lit(True).alias("gasit")))
    which = F.col("event_id") % 4
    payload = F.when(which == 0, good).when(which == 1, F.replace(good, F.lit('"gasit"'), F.lit('"gasit":false,"gasit"'))).when(which == 2, F.replace(good, F.lit("true"), F.lit("NaN"))).otherwise(F.col("props"))
    rows = table(spark, d, "events").select("event_id", citations.decode_payload(payload).alias("p"))
    return rows.select("event_id", "p.valid", F.coalesce("p.found", F.lit(False)).alias("found"), F.coalesce(F.nullif(F.size("p.passages"), F.lit(-1)), F.lit(0)).alias("passages"))


@query()
def question_route(spark: SparkSession, d: str) -> DataFrame:
    """Questions made of conversations: a route for each, by the whole parser."""
    aliases = spark.createDataFrame([("np10", "NP 010-2022"), ("i7", "I7-2011"), ("p118", "P 118/2-2013")], "document_id string, alias string")
    articles = spark.createDataFrame([("np10", "3.2.1"), ("i7", "4.1.2.3"), ("p118", "5.1")], "document_id string, article string")
    leads = ["NP10-2022 art. 3.2.1 ", "I7-2011 ce spune 4.1.2 ", "SR EN 12831 ", "I7-2011 si NP 010-2022 art. 5 ", "doar din P 118/2-2013 ", "art. 1 si art. 2 ", "", "doar din XY 12 "]
    lead = F.get(F.array(*map(F.lit, leads)), ((F.col("conv_id") + F.col("turn")) % 8).cast("int"))
    asked = table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("question_id"), F.concat(lead, "text").alias("text"))
    parsed = routing.parse(asked, aliases, articles)
    only = routing.restricted_documents(asked, aliases, articles)
    rows = parsed.join(only, "question_id", "left")
    return rows.select("question_id", "document_id", "article", routing.route(F.col("documents"), F.col("needs_clarification"), F.col("article")).alias("route"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document nearest to a question, to its citations: search, threshold, duplicates, budget, ids."""
    rows = table(spark, sf_dir, "embeddings").where(similarity.is_valid_vector(F.col("embedding")))
    hits = similarity.accepted(similarity.top_k(rows, _vector(rows, 0), chunk_id="vec_id"), 0.2).select(F.col("vec_id").alias("doc_id"), "score")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.md5("text").alias("content_hash"), "n_chars")
    found = hits.join(docs, "doc_id").withColumn("question", F.lit(0)).withColumn("seq", F.row_number().over(_by_score()))
    kept = evidence.first_of_each(found, ["question"], ["content_hash"], "seq")
    return evidence.with_citation_ids(evidence.within_budget(kept, ["question"], length="n_chars", seq="seq"), ["question"], "seq").drop("question")


def _by_score():
    from pyspark.sql import Window

    return Window.partitionBy("question").orderBy(F.desc("score"), "doc_id")
