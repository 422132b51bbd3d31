"""Queries of accounting, ingestion and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.operators import accounting, evaluation, lifecycle, similarity
from dossier.plans.registry import query, table
from dossier.streaming import accounting as stream
from dossier.streaming import settled

COUNTS = """c AS (SELECT event_id, user_id, ts, count(*) OVER (PARTITION BY user_id, date_trunc('minute', ts) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS minute_count,
  count(*) OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS hour_count FROM events)"""


def _limited(spark: SparkSession, d: str, per_minute: int, per_hour: int) -> DataFrame:
    return accounting.rate_limited(table(spark, d, "events"), caller="user_id", ts="ts", order=["ts", "event_id"], per_minute=per_minute, per_hour=per_hour)


@query(f"WITH {COUNTS} SELECT event_id, minute_count, hour_count, minute_count <= 5 AND hour_count <= 30 AS allowed FROM c")
def rate_limit(spark: SparkSession, d: str) -> DataFrame:
    return _limited(spark, d, 5, 30).select("event_id", "minute_count", "hour_count", "allowed")


@query(f"WITH {COUNTS} SELECT event_id, minute_count, hour_count, minute_count <= 1 AND hour_count <= 1 AS allowed FROM c")
def rate_limit_tight(spark: SparkSession, d: str) -> DataFrame:
    return _limited(spark, d, 1, 1).select("event_id", "minute_count", "hour_count", "allowed")


@query(f"""WITH {COUNTS} SELECT event_id, CASE WHEN minute_count > 1 OR hour_count > 1 THEN greatest(1, ceil(greatest(CASE WHEN minute_count > 1 THEN 60 - (epoch(ts) - epoch(date_trunc('minute', ts))) ELSE 0 END, CASE WHEN hour_count > 1 THEN 3600 - (epoch(ts) - epoch(date_trunc('hour', ts))) ELSE 0 END)))::BIGINT ELSE 0 END AS retry_after FROM c""")
def retry_after(spark: SparkSession, d: str) -> DataFrame:
    rows = accounting.retry_after(_limited(spark, d, 1, 1), ts="ts", per_minute=1, per_hour=1)
    return rows.select("event_id", F.coalesce("retry_after", F.lit(0)).alias("retry_after"))


@query("""WITH b AS (SELECT user_id, 'minute' AS kind, date_trunc('minute', ts) AS bucket_start FROM events UNION ALL SELECT user_id, 'hour', date_trunc('hour', ts) FROM events)
SELECT user_id, kind, bucket_start, count(*) AS request_count, bucket_start + INTERVAL 24 HOURS AS expires_at FROM b GROUP BY ALL HAVING bucket_start + INTERVAL 24 HOURS > TIMESTAMP '2024-01-20 12:00:00'""")
def bucket_expiry(spark: SparkSession, d: str) -> DataFrame:
    buckets = accounting.rate_buckets(table(spark, d, "events"), caller="user_id", ts="ts")
    return accounting.unexpired(buckets, F.expr("timestamp_ntz'2024-01-20 12:00:00'"))


@query("""SELECT event_id, least(10, coalesce(sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS used,
  coalesce(sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 10 AS reserved FROM events""")
def quota_lifetime(spark: SparkSession, d: str) -> DataFrame:
    consumes = ~accounting.is_refunded(F.col("event_type"))
    rows = accounting.within_quota(table(spark, d, "events"), visitor="user_id", order=["ts", "event_id"], consumes=consumes)
    return rows.select("event_id", "used", "reserved")


@query("SELECT event_id, ts::DATE AS day, count(*) OVER w AS day_count, count(*) OVER w <= 200 AS reserved FROM events WINDOW w AS (PARTITION BY ts::DATE ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def daily_budget(spark: SparkSession, d: str) -> DataFrame:
    rows = accounting.within_daily_budget(table(spark, d, "events"), ts="ts", order=["ts", "event_id"])
    return rows.select("event_id", "day", "day_count", "reserved")


@query("""WITH i AS (SELECT *, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events),
s AS (SELECT *, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS streak FROM i)
SELECT event_id, streak::BIGINT AS streak, streak >= 3 AND ts >= TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 15 MINUTES AS degraded FROM s""")
def provider_health(spark: SparkSession, d: str) -> DataFrame:
    now = F.expr("timestamp_ntz'2024-01-15 00:00:00'")
    rows = accounting.provider_health(table(spark, d, "events"), provider="user_id", ts="ts", order=["ts", "event_id"], ok=F.col("event_type") != "error", now=now)
    return rows.select("event_id", "streak", "degraded")


@query(f"WITH {COUNTS} SELECT event_id, minute_count, hour_count, minute_count <= 1 AND hour_count <= 1 AS allowed FROM c")
def rate_limit_stream(spark: SparkSession, d: str) -> DataFrame:
    """The limiter as a stream over all events; the answer is that of ``rate_limit_tight``."""
    events = stream.events_of(spark, f"{d}/event[s].parquet", table(spark, d, "events").schema)
    callers = events.select(F.col("user_id").cast("string").alias("caller"), "event_id", "ts")
    done = stream.run_available(stream.rate_limited(callers, 1, 1, expire=False), "rate_limit")
    return done.select("event_id", "minute_count", "hour_count", "allowed")


ARRIVED = """a AS (SELECT *, ts + to_seconds((event_id * 7919) % 500) AS arrived FROM events),
done AS (SELECT * FROM a WHERE date_trunc('minute', ts) + INTERVAL 11 MINUTES <= (SELECT max(arrived) FROM a))"""


def _arriving(spark: SparkSession, d: str, *more) -> DataFrame:
    """The events as a stream, each up to 500 seconds after its time, in a session whose state is kept as settling needs."""
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", settled.STORE)
    events = stream.events_of(session, f"{d}/event[s].parquet", table(spark, d, "events").schema)
    return events.select(F.col("user_id").cast("string").alias("key"), "event_id", "ts", F.expr("ts + make_dt_interval(0, 0, 0, (event_id * 7919) % 500)").alias("arrived"), *more)


@query(f"""WITH {ARRIVED} SELECT event_id, count(*) OVER (PARTITION BY user_id, date_trunc('minute', ts) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS minute_count,
  count(*) OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS hour_count, false AS is_late FROM done""")
def rate_limit_settled(spark: SparkSession, d: str) -> DataFrame:
    """Counts of a stream whose requests arrive out of order, of all that are settled at its end."""
    rows = _arriving(spark, d).withColumnRenamed("key", "caller")
    return stream.run_available(settled.rate_limited(rows), "settled").select("event_id", "minute_count", "hour_count", "is_late")


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 OR event_id % 7 IN (1, 2) THEN 'host' WHEN event_id % 7 = 3 THEN '2001:db8::' || (event_id % 10) WHEN event_id % 2 = 0 THEN '10.0.0.' || (event_id % 250) ELSE '10.1.1.1' END AS ip FROM events""")
def client_address(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    mine = F.concat(F.lit("10.0.0."), (e % 250).cast("string"))
    forged = F.when(e % 7 == 1, "10.0.0.256, 10.2.2.2").when(e % 7 == 2, "admin, 10.2.2.2").when(e % 7 == 3, F.concat(F.lit("2001:db8::"), (e % 10).cast("string"), F.lit(", 10.2.2.2")))
    plain = F.when(e % 2 == 0, F.concat(F.lit("9.9.9.9, "), mine, F.lit(", 10.2.2.2"))).otherwise("10.1.1.1, 10.2.2.2")
    forwarded = F.when(e % 3 == 0, None).otherwise(F.coalesce(forged, plain))
    return table(spark, d, "events").select("event_id", accounting.client_ip(forwarded, F.lit("host"), 2).alias("ip"))


@query("""SELECT doc_id, CASE WHEN quality = 0 AND toxic = 0 THEN 'keep' WHEN quality = 1 AND toxic = 1 THEN 'disable' WHEN toxic = 1 THEN 'error' ELSE 'insert' END AS change FROM labels""")
def status_transitions(spark: SparkSession, d: str) -> DataFrame:
    q, t = F.col("quality"), F.col("toxic")
    old = F.when(q == 0, F.when(t == 0, "approved").otherwise("disabled")).when(t == 1, "approved")
    new = F.when(q == 0, "approved").when(t == 1, "disabled").otherwise("indexed_pending_validation")
    return table(spark, d, "labels").select("doc_id", lifecycle.transition(old, new).alias("change"))


@query("SELECT a.doc_id FROM documents a WHERE a.doc_id % 2 = 1 AND (EXISTS (SELECT 1 FROM documents b WHERE b.doc_id % 2 = 0 AND md5(b.text) = md5(a.text)) OR EXISTS (SELECT 1 FROM documents b WHERE b.doc_id % 2 = 0 AND b.n_chars = a.n_chars))")
def identity_conflict(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.md5("text").alias("hash"), "n_chars")
    found = lifecycle.identity_conflicts(rows.where("doc_id % 2 = 1"), rows.where("doc_id % 2 = 0"), ["hash", "n_chars"], "doc_id")
    return found.select("doc_id")


@query("""WITH a AS (SELECT source, list(md5(text) ORDER BY md5(text)) AS h FROM documents GROUP BY source), b AS (SELECT source, list(md5(text) ORDER BY md5(text)) AS h FROM documents WHERE doc_id % 40 <> 3 GROUP BY source)
SELECT a.source, a.h IS NOT DISTINCT FROM b.h AS is_unchanged FROM a LEFT JOIN b ON a.source = b.source""")
def unchanged_multiset(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "source", F.md5("text").alias("hash"))
    return lifecycle.unchanged(rows.drop("doc_id"), rows.where("doc_id % 40 <> 3").drop("doc_id"), key="source", content="hash")


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INTEGER AS chunk_order FROM conversations")
def chunk_order(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.with_chunk_order(table(spark, d, "conversations").select("conv_id", "turn"), document="conv_id", order=["turn"])


@query("SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0)")
def fk_violations(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.orphans(table(spark, d, "labels"), table(spark, d, "documents").where("doc_id % 3 <> 0"), ["doc_id"]).select("doc_id")


@query("""SELECT doc_id, field FROM (SELECT doc_id, unnest(list_filter([CASE WHEN trim(source) = '' OR doc_id % 9 = 0 THEN 'title' END, CASE WHEN n_chars NOT BETWEEN 1800 AND 9999 THEN 'year' END, CASE WHEN lang NOT IN ('en', 'fr', 'de') THEN 'status' END], lambda x: x IS NOT NULL)) AS field FROM documents)""")
def metadata_problems(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("lang").isin("en", "fr", "de"), "approved").otherwise("unknown")
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.col("source").alias("source_key"), F.col("lang").alias("official_code"), F.when(F.col("doc_id") % 9 == 0, " ").otherwise(F.col("source")).alias("title"), F.col("n_chars").alias("year"), status.alias("status"))
    return lifecycle.metadata_violations(rows).select(F.col("document_id").cast("long").alias("doc_id"), "field")


@query("""SELECT doc_id, CASE WHEN NOT regexp_full_match(rtrim(lower(replace(source || CASE WHEN doc_id % 4 = 0 THEN '_' ELSE '' END, ' ', '')), '.'), '[a-z0-9().-]+') THEN 'article' WHEN trim(text) = '' THEN 'blank' ELSE 'too_long' END AS problem FROM documents
WHERE doc_id % 4 = 0 OR trim(text) = '' OR length(text) > 1000""")
def chunk_problems(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").withColumn("article", F.concat("source", F.when(F.col("doc_id") % 4 == 0, "_").otherwise("")))
    return lifecycle.chunk_violations(rows, document="doc_id", article="article", text="text").drop("article")


@query("""WITH RECURSIVE items AS (SELECT conv_id, turn, ceil(length(coalesce(text, '')) / 4.0)::BIGINT AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
fold(conv_id, k, b, n, used, batch) AS (
  SELECT conv_id, 0::BIGINT, 1, 0, 0::BIGINT, NULL::INT FROM (SELECT DISTINCT conv_id FROM items)
  UNION ALL SELECT f.conv_id, i.k, CASE WHEN t > 120 THEN b WHEN n >= 3 OR used + t > 120 THEN b + 1 ELSE b END, CASE WHEN t > 120 THEN n WHEN n >= 3 OR used + t > 120 THEN 1 ELSE n + 1 END,
    CASE WHEN t > 120 THEN used WHEN n >= 3 OR used + t > 120 THEN t ELSE used + t END, CASE WHEN t > 120 THEN NULL WHEN n >= 3 OR used + t > 120 THEN b + 1 ELSE b END
  FROM fold f JOIN items i ON i.conv_id = f.conv_id AND i.k = f.k + 1)
SELECT i.conv_id, i.turn, i.t AS tokens, coalesce(f.batch, 0) AS batch FROM fold f JOIN items i ON f.conv_id = i.conv_id AND f.k = i.k""")
def embed_batches(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.ceil(F.length(F.coalesce("text", F.lit(""))) / 4).alias("tokens"))
    batches = accounting.embedding_batches(rows, group=["conv_id"], order="turn", tokens="tokens", most=3, most_tokens=120)
    return batches.withColumn("batch", F.coalesce("batch", F.lit(0)))


@query("""WITH RECURSIVE items AS (SELECT source, doc_id, n_chars AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
fold(source, k, n, used, ok) AS (
  SELECT source, 0::BIGINT, 0, 0::BIGINT, NULL::BOOLEAN FROM (SELECT DISTINCT source FROM items)
  UNION ALL SELECT f.source, i.k, n + (n < 5 AND used + t <= 10000)::INT, used + CASE WHEN n < 5 AND used + t <= 10000 THEN t ELSE 0 END, n < 5 AND used + t <= 10000 FROM fold f JOIN items i ON i.source = f.source AND i.k = f.k + 1)
SELECT i.source, i.doc_id, i.t AS n_chars, f.ok AS accepted FROM fold f JOIN items i ON f.source = i.source AND f.k = i.k""")
def daily_ingest_budget(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    return accounting.ingestion_budget(rows, group=["source"], order="doc_id", size="n_chars")


RANKS = """hits AS (SELECT a.vec_id AS case_id, a.label AS want, b.label AS got, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS rank
  FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
results AS (SELECT case_id, CASE WHEN case_id // 50 % 7 = 0 THEN 'negative' WHEN case_id // 50 % 2 = 0 THEN 'exact' ELSE 'semantic' END AS type, min(rank) FILTER (rank <= 8 AND want = got) AS rank FROM hits GROUP BY case_id),
judged AS (SELECT *, CASE WHEN type = 'negative' THEN case_id // 50 % 14 = 0 ELSE rank IS NOT NULL END AS correct FROM results)"""


def _judged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "embeddings")
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("case_id"), "embedding")
    near = similarity.top_k_each(asked, rows, question_id="case_id", chunk_id="vec_id", k=9).where("case_id <> vec_id")
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("case_id").orderBy("rank"))
    near = near.withColumn("rank", place).where("rank <= 8")
    label = rows.select("vec_id", F.col("label").cast("string").alias("article"))
    hits = near.join(label, "vec_id").withColumn("document_id", F.lit("d"))
    expected = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("case_id"), F.lit("d").alias("document_id"), F.col("label").cast("string").alias("article"))
    number = F.floor(F.col("case_id") / 50)
    kind = F.when(number % 7 == 0, "negative").when(number % 2 == 0, "exact").otherwise("semantic")
    status = F.when(number % 14 == 0, "not_found").otherwise("found")
    cases = asked.select("case_id", kind.alias("type"), status.alias("status"))
    return evaluation.judged(cases, evaluation.first_rank(hits, expected)), expected


@query(f"WITH {RANKS} SELECT count(*) AS cases, count(*) FILTER (correct) AS correct, round(avg(correct::INT::DOUBLE), 6) AS accuracy, round(count(*) FILTER (type <> 'negative' AND rank <= 1) / count(*) FILTER (type <> 'negative')::DOUBLE, 6) AS recall_at_1, round(count(*) FILTER (type <> 'negative' AND rank <= 5) / count(*) FILTER (type <> 'negative')::DOUBLE, 6) AS recall_at_5 FROM judged")
def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    rows = evaluation.accuracy(_judged(spark, d)[0])
    return rows.select("cases", "correct", *(F.round(c, 6).alias(c) for c in ("accuracy", "recall_at_1", "recall_at_5")))


@query(f"WITH {RANKS} SELECT t.type, count(case_id) AS cases, count(*) FILTER (correct) AS correct, coalesce(round(count(*) FILTER (correct) / nullif(count(case_id), 0)::DOUBLE, 6), 0) AS accuracy FROM (VALUES ('exact'), ('semantic'), ('negative')) t(type) LEFT JOIN judged j ON j.type = t.type GROUP BY t.type")
def accuracy_by_type(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.accuracy_by_type(_judged(spark, d)[0]).withColumn("accuracy", F.round("accuracy", 6))


@query(f"WITH {RANKS} SELECT want::VARCHAR AS document_id, count(*) AS cases, count(*) FILTER (correct) AS correct, round(avg(correct::INT::DOUBLE), 6) AS accuracy FROM (SELECT DISTINCT case_id, want FROM hits) JOIN judged USING (case_id) GROUP BY want")
def accuracy_by_document(spark: SparkSession, d: str) -> DataFrame:
    results, expected = _judged(spark, d)
    by_label = expected.select("case_id", F.col("article").alias("document_id"))
    return evaluation.accuracy_by_document(results, by_label).withColumn("accuracy", F.round("accuracy", 6))


@query("SELECT role, count(*) AS n FROM conversations GROUP BY role")
def outcome_distribution(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.distribution(table(spark, d, "conversations"), "role")


@query("SELECT event_id, event_type = 'error' AND row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= 50 AS allowed FROM events")
def cost_caps(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", "event_type")
    return evaluation.within_cap(rows, order=["event_id"], kind="event_type", caps={"error": 50}).drop("event_type")


@query("""SELECT doc_id AS case_id, f AS finding FROM (SELECT doc_id, unnest(list_filter([CASE WHEN toxic = 1 AND quality = 0 THEN 'unsupported_accepted' END, CASE WHEN toxic = 0 AND quality = 1 THEN 'supported_rejected' END, CASE WHEN toxic = 1 AND doc_id % 2 = 0 THEN 'missing_passage' END], lambda x: x IS NOT NULL)) AS f FROM labels)""")
def grounding_findings(spark: SparkSession, d: str) -> DataFrame:
    missing = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("C1"))).otherwise(F.array().cast("array<string>"))
    cases = table(spark, d, "labels").select(F.col("doc_id").alias("case_id"), (F.col("quality") == 1).alias("expected_publishable"), (F.col("toxic") == 1).alias("published"), missing.alias("missing_passages"))
    return evaluation.findings(cases)


RUN = """cases AS (SELECT doc_id AS case_id, text, ['published', 'published', 'rejected', 'not_found', 'execution_error'][1 + doc_id % 5] AS outcome, doc_id % 3 <> 0 AS expected FROM documents),
required AS (SELECT case_id, outcome, i AS citation_id, substring(text, 5, 20) AS wanted, substring(text, CASE i WHEN 'C1' THEN 1 ELSE 61 END, 60) AS quote FROM cases, (VALUES ('C1'), ('C2')) ids(i) WHERE case_id % 4 <> 0),
checks AS (SELECT case_id, citation_id, CASE WHEN outcome <> 'published' THEN 'not_observed' WHEN contains(quote, wanted) THEN 'present' ELSE 'missing' END AS state FROM required)"""


def _run(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(cases, passage checks) of a run made of documents: a third should not be published, and two passages are required of most."""
    docs = table(spark, d, "documents")
    outcome = F.get(F.array(*map(F.lit, ("published", "published", "rejected", "not_found", "execution_error"))), (F.col("doc_id") % 5).cast("int"))
    cases = docs.select(F.col("doc_id").alias("case_id"), outcome.alias("outcome"), (F.col("doc_id") % 3 != 0).alias("expected_publishable"), F.lit(1).alias("calls"))
    ids = lambda f: F.explode(F.array(*(F.struct(F.lit(i).alias("id"), f(at).alias("text")) for i, at in (("C1", 1), ("C2", 61))))).alias("p")
    cited = docs.select(F.col("doc_id").alias("case_id"), ids(lambda at: F.substring("text", at, 60))).select("case_id", "p.id", F.col("p.text").alias("quote"))
    required = docs.where("doc_id % 4 <> 0").select(F.col("doc_id").alias("case_id"), ids(lambda at: F.substring("text", 5, 20))).select("case_id", F.col("p.id").alias("citation_id"), "p.text")
    return cases, evaluation.passage_checks(required, cited, cases)


@query(f"""WITH {RUN}, worst AS (SELECT case_id, max(CASE state WHEN 'not_observed' THEN 2 WHEN 'missing' THEN 1 ELSE 0 END) AS w FROM checks GROUP BY case_id)
SELECT case_id, coalesce(['present', 'missing', 'not_observed'][w + 1], 'not_applicable') AS passage_state FROM cases LEFT JOIN worst USING (case_id)""")
def grounding_passages(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.passage_states(*_run(spark, d))


@query(f"""WITH {RUN}, found AS (
SELECT case_id, CASE WHEN outcome = 'execution_error' THEN outcome WHEN outcome = 'published' AND NOT expected THEN 'non_publishable_published' WHEN outcome <> 'published' AND expected THEN 'publishable_rejected' END AS kind FROM cases
UNION ALL SELECT case_id, 'relevant_passage_missing' FROM checks WHERE state = 'missing'),
kinds AS (SELECT count(DISTINCT case_id) AS cases_with_findings, count(*) AS total_findings, count(*) FILTER (kind = 'execution_error') AS execution_error, count(*) FILTER (kind = 'non_publishable_published') AS non_publishable_published,
count(*) FILTER (kind = 'publishable_rejected') AS publishable_rejected, count(*) FILTER (kind = 'relevant_passage_missing') AS relevant_passage_missing FROM found WHERE kind IS NOT NULL)
SELECT count(*) AS total_cases, count(*) AS calls, count(*) FILTER (outcome = 'published') AS published, count(*) FILTER (outcome = 'rejected') AS typed_refusals, count(*) FILTER (outcome = 'not_found') AS not_found,
any_value(kinds), CASE WHEN any_value(execution_error) > 0 THEN 2 WHEN any_value(total_findings) > 0 THEN 1 ELSE 0 END::INTEGER AS exit_code FROM cases, kinds""".replace("any_value(kinds)", ", ".join(f"any_value({c}) AS {c}" for c in ("cases_with_findings", "total_findings", "execution_error", "non_publishable_published", "publishable_rejected", "relevant_passage_missing"))))
def grounding_run(spark: SparkSession, d: str) -> DataFrame:
    cases, checks = _run(spark, d)
    return evaluation.grounding_summary(cases, evaluation.case_findings(cases, checks))


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in TABLES))
def backup_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = None
    for name in TABLES:
        one = table(spark, d, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        counts = one if counts is None else counts.unionByName(one)
    return counts
