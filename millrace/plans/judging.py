"""Queries of evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import evaluation as E
from millrace.plans.registry import query
from millrace.plans.search import corpus, fused, questions
from millrace.plans.views import VIEWS, table, view

VIEWS["v_first"] = """
SELECT q.qa_id, min(t.rank) AS best_rank FROM v_qa q JOIN v_expected e ON q.qa_id = e.qa_id JOIN v_top t ON t.qa_id = q.qa_id JOIN v_corpus c ON c.chunk_id = t.chunk_id AND c.source_url = e.url GROUP BY q.qa_id"""
VIEWS["v_found"] = """
SELECT q.qa_id, q.domain, e.n IS NULL AS is_fallback_expected, f.best_rank, coalesce(f.best_rank <= 1, false) AS hit_1, coalesce(f.best_rank <= 5, false) AS hit_5, coalesce(f.best_rank <= 10, false) AS hit_10,
  coalesce(f.best_rank <= 20, false) AS hit_20 FROM v_qa q LEFT JOIN v_first f ON q.qa_id = f.qa_id LEFT JOIN (SELECT qa_id, count(*) AS n FROM v_expected GROUP BY qa_id) e ON q.qa_id = e.qa_id"""


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fused hits with their addresses."""
    return fused(spark, sf_dir).join(corpus(spark, sf_dir).select("chunk_id", F.array("source_url").alias("urls")), "chunk_id")


@query("SELECT qa_id, best_rank, hit_1, hit_5, hit_10, hit_20 FROM v_found")
def hits_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.hits_at_k(questions(spark, sf_dir), hits(spark, sf_dir)).withColumn("best_rank", F.col("best_rank").cast("long"))


@query("""SELECT domain, count(*) AS n, round(avg(CAST(hit_1 AS INT)), 6) AS recall_1, round(avg(CAST(hit_5 AS INT)), 6) AS recall_5, round(avg(CAST(hit_10 AS INT)), 6) AS recall_10, round(avg(CAST(hit_20 AS INT)), 6) AS recall_20
FROM v_found WHERE NOT is_fallback_expected GROUP BY ROLLUP (domain)""")
def recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = questions(spark, sf_dir)
    found = E.recall(rows, E.hits_at_k(rows, hits(spark, sf_dir)))
    return found.select("domain", "n", *[F.round(f"recall_{k}", 6).alias(f"recall_{k}") for k in E.KS])


@query("""SELECT f.qa_id, f.domain, t.chunk_id AS top_chunk, round(t.rrf_score, 9) AS top_score FROM v_found f JOIN v_qa q ON q.qa_id = f.qa_id LEFT JOIN v_top t ON f.qa_id = t.qa_id AND t.rank = 1 WHERE NOT is_fallback_expected AND (q.item_id % 2 = 0 OR NOT hit_20)""")
def hard_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions without a hit; those of even items name an address that no document has."""
    rows, found = questions(spark, sf_dir), hits(spark, sf_dir)
    absent = (F.col("item_id") % 2 == 0) & ~F.col("is_fallback_expected")
    rows = rows.withColumn("expected_source_urls", F.when(absent, F.array(F.lit("https://none.example.org/"))).otherwise(F.col("expected_source_urls")))
    missed = E.hard_misses(rows, E.hits_at_k(rows, found), found)
    return missed.withColumn("top_score", F.round("top_score", 9))


# answers: the assistant's turns, with expected and used fallbacks and scores by rule
VIEWS["v_answers"] = """
SELECT 'a' || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS qa_id, CAST(1 + conv_id % 9 AS INT) AS domain, CASE WHEN turn % 4 = 1 THEN 'A' WHEN turn % 4 = 3 THEN 'B' ELSE 'C' END AS question_type,
  conv_id % 5 = 0 AS is_fallback_expected, (conv_id + turn) % 3 = 0 AS used_fallback, text AS generated_answer, CAST((conv_id * 7 + turn) % 40 AS DOUBLE) / 100 AS top_rerank_score,
  CASE WHEN conv_id % 6 = 0 THEN '' ELSE 'u' || CAST(conv_id % 4 AS STRING) END AS expected, 'u' || CAST(turn % 4 AS STRING) AS s1, 'u' || CAST((turn + 1) % 4 AS STRING) AS s2, conv_id, turn
FROM conversations WHERE role = 'assistant'"""
VIEWS["v_judged"] = """
SELECT *, CASE WHEN is_fallback_expected AND used_fallback THEN 2 WHEN is_fallback_expected OR used_fallback THEN 0 WHEN (conv_id + 2 * turn) % 7 > 2 THEN -1 ELSE CAST((conv_id + 2 * turn) % 7 AS INT) END AS judge_score,
  CASE WHEN is_fallback_expected OR used_fallback THEN 'auto' ELSE 'llm' END AS judge_source FROM v_answers"""


def raw() -> Column:
    """A judge's raw output, by rule."""
    return F.concat(F.lit("\n score "), ((F.col("conv_id") + 2 * F.col("turn")) % 7).cast("string"), F.lit("\n\n because \n of it"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_answers")
    sources = F.array(F.struct(F.col("s1").alias("source_url")), F.struct(F.col("s2").alias("source_url")))
    return rows.withColumn("sources", sources).withColumn("expected_source_urls", F.when(F.col("expected") != "", F.array("expected")).otherwise(F.array().cast("array<string>")))


def judged(spark: SparkSession, sf_dir: str, done: str = "false") -> DataFrame:
    """Answers judged, but for those that a condition says to be done."""
    rows = answers(spark, sf_dir)
    return E.judge_rows(rows, rows.select("qa_id", raw().alias("judge_raw")), rows.where(done))


@query("""SELECT qa_id, judge_score, judge_source, CASE WHEN judge_source = 'llm' THEN 'because of it' END AS judge_reason FROM v_judged WHERE conv_id % 8 <> 3""")
def judge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All answers judged, but for those of every eighth conversation, which have been before."""
    found = judged(spark, sf_dir, "conv_id % 8 = 3")
    return found.select("qa_id", "judge_score", "judge_source", "judge_reason")


@query("""SELECT qa_id, CASE WHEN conv_id % 3 = 0 THEN -1 ELSE CAST(conv_id % 3 AS INT) END AS score, CASE WHEN conv_id % 3 = 0 THEN 'none' ELSE 'it is so and so' END AS reason FROM v_answers""")
def parse_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("conv_id") % 3).cast("string")
    raw = F.when(F.col("conv_id") % 3 == 0, "12 points\nnone\n").otherwise(F.concat(F.lit("\n  \nrated "), n, F.lit(" of 12\n it is so \n\n and so ")))
    return view(spark, sf_dir, "v_answers").select("qa_id", T.judged_score(raw).alias("score"), T.judged_reason(raw).alias("reason"))


SQL_RATES = """count(*) AS n, count(*) FILTER (judge_score >= 0) AS n_valid, round(avg(judge_score) FILTER (judge_score >= 0), 3) AS mean_score, round(count(*) FILTER (judge_score = 2) / greatest(1, count(*) FILTER (judge_score >= 0)), 3) AS correct_rate,
  count(*) FILTER (judge_score = 0) AS n_0, count(*) FILTER (judge_score = 1) AS n_1, count(*) FILTER (judge_score = 2) AS n_2 FROM v_judged"""


@query(f"""SELECT 'all' AS facet, 'all' AS value, {SQL_RATES} UNION ALL SELECT 'domain', CAST(domain AS STRING), {SQL_RATES} GROUP BY domain
UNION ALL SELECT 'source', judge_source, {SQL_RATES} GROUP BY judge_source UNION ALL SELECT 'type', question_type, {SQL_RATES} GROUP BY question_type""")
def judge_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.judge_aggregate(judged(spark, sf_dir))


@query("SELECT qa_id, domain, judge_source FROM v_judged WHERE judge_score = 0 ORDER BY qa_id LIMIT 30")
def low_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.low_scores(judged(spark, sf_dir)).select("qa_id", "domain", "judge_source")


@query("""SELECT tp, fp, fn, tn, round(tp / greatest(1, tp + fp), 6) AS precision, round(tp / greatest(1, tp + fn), 6) AS recall FROM (SELECT count(*) FILTER (is_fallback_expected AND used_fallback) AS tp,
  count(*) FILTER (NOT is_fallback_expected AND used_fallback) AS fp, count(*) FILTER (is_fallback_expected AND NOT used_fallback) AS fn, count(*) FILTER (NOT is_fallback_expected AND NOT used_fallback) AS tn FROM v_answers)""")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.confusion(answers(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


SQL_ELIGIBLE = "NOT is_fallback_expected AND expected <> ''"


@query(f"""SELECT domain, count(*) AS n, count(*) FILTER (NOT is_fallback_expected) AS n_standard, CAST(floor(avg(length(generated_answer))) AS BIGINT) AS mean_length, CAST(max(length(generated_answer)) AS BIGINT) AS max_length,
  round(avg(CAST(used_fallback AS INT)), 6) AS fallback_rate, round(avg(CASE WHEN {SQL_ELIGIBLE} THEN CAST(s1 = expected AS INT) END), 6) AS p_at_1,
  round(avg(CASE WHEN {SQL_ELIGIBLE} THEN CAST(s1 = expected OR s2 = expected AS INT) END), 6) AS p_at_3 FROM v_answers GROUP BY domain""")
def answer_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = E.answer_metrics(answers(spark, sf_dir))
    return found.withColumns({c: F.round(c, 6) for c in ("fallback_rate", "p_at_1", "p_at_3")})


@query("SELECT qa_id FROM v_answers WHERE NOT used_fallback")
def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answers(spark, sf_dir)
    return E.pending(rows, rows.where("used_fallback")).select("qa_id")


SQL_T = "(VALUES (0.01), (0.05), (0.1), (0.15), (0.2), (0.25), (0.3), (0.9)) AS x(t)"


@query(f"""SELECT CAST(t AS DOUBLE) AS t, count(j.qa_id) AS unblocked, count(*) FILTER (j.judge_score = 0 AND (s1 = expected OR s2 = expected)) AS recovery, count(*) FILTER (j.is_fallback_expected) AS regression,
  count(*) FILTER (j.judge_score = 0 AND (s1 = expected OR s2 = expected)) - count(*) FILTER (j.is_fallback_expected) AS net FROM {SQL_T} LEFT JOIN (SELECT * FROM v_judged WHERE used_fallback) j ON j.top_rerank_score >= t GROUP BY t""")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answers(spark, sf_dir).join(judged(spark, sf_dir).select("qa_id", "judge_score"), "qa_id")
    rows = rows.withColumn("gold_in_sources", F.arrays_overlap(F.transform("sources", lambda s: s["source_url"]), "expected_source_urls"))
    return E.threshold_sweep(rows, spark.createDataFrame([(x,) for x in (0.01, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.9)], "t double"))


@query("""SELECT grp, CAST(n AS BIGINT) AS n, """ + ", ".join(f"s[1 + least(n - 1, n * {p} // 100)] AS p{p}" for p in (10, 25, 50, 75)) + """, s[1] AS least, s[n] AS most, round(low / n, 6) AS share_low
FROM (SELECT question_type AS grp, count(*) AS n, list_sort(list(top_rerank_score)) AS s, count(*) FILTER (top_rerank_score < 0.3) AS low FROM v_answers WHERE NOT used_fallback GROUP BY question_type)""")
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answers(spark, sf_dir).where("not used_fallback").select(F.col("question_type").alias("grp"), F.col("top_rerank_score").alias("score"))
    return E.score_percentiles(rows).withColumn("share_low", F.round("share_low", 6))


# questions with mistakes put in by rule; ids repeat
VIEWS["v_drafts"] = """
SELECT doc_id AS seq, 'd' || CAST(doc_id % 600 AS STRING) AS qa_id, CASE WHEN doc_id % 17 = 0 THEN '' ELSE text END AS question, CAST(doc_id % 11 AS INT) AS domain,
  CASE WHEN doc_id % 13 = 0 THEN 'E' WHEN doc_id % 2 = 0 THEN 'A' ELSE 'B' END AS question_type, doc_id % 19 = 0 AS untagged, doc_id % 10 = 0 AS is_fallback_expected
FROM documents"""


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_drafts")
    return rows.withColumn("tags", F.when(F.col("untagged"), F.array().cast("array<string>")).otherwise(F.array(F.lit("x"))))


@query("""SELECT seq, qa_id, CASE WHEN own = '' AND (nth > 1 OR qa_id IN ('d3', 'd5')) THEN 'repeated id' ELSE own END AS errors FROM (
  SELECT seq, qa_id, own, row_number() OVER (PARTITION BY qa_id, own = '' ORDER BY seq) AS nth FROM (
  SELECT seq, qa_id, concat_ws(';', CASE WHEN question = '' THEN 'no question' END, CASE WHEN domain NOT BETWEEN 1 AND 9 THEN 'domain' END, CASE WHEN question_type = 'E' THEN 'type' END, CASE WHEN untagged THEN 'no tag' END) AS own FROM v_drafts))""")
def validate_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = E.validate_questions(drafts(spark, sf_dir), spark.createDataFrame([("d3",), ("d5",)], "qa_id string"))
    return found.select("seq", "qa_id", F.array_join("errors", ";").alias("errors"))


# the drafts as JSON, with fields left out, added, or of a wrong type by rule
VIEWS["v_raw"] = """
SELECT seq, '{"qa_id":"' || qa_id || '","question":"q","answer_gold":"a","domain":' || CAST(domain AS STRING) || ',"categories":' || CASE WHEN seq % 23 = 0 THEN '"1.2"' ELSE '["1.2"]' END || ',"question_type":"' || question_type || '","expected_source_urls":[],"is_fallback_expected":'
  || CASE WHEN seq % 29 = 0 THEN '"yes"' ELSE 'false' END || ',"tags":' || CASE WHEN untagged THEN '[]' ELSE '["x"]' END || ',"created_by":"r","reviewed_by":null,"created_at":null,"reviewed_at":null,'
  || CASE WHEN seq % 7 = 3 THEN '"other":1,' WHEN seq % 7 = 5 THEN '"gen_prompt_version":1,' ELSE '"gen_prompt_version":null,' END || '"notes":' || CASE WHEN seq % 31 = 0 THEN '"n","more":2' ELSE 'null' END || '}' AS raw
FROM v_drafts"""


@query("""SELECT seq, qa_id, CASE WHEN own = '' AND (nth > 1 OR qa_id IN ('d3', 'd5')) THEN 'repeated id' ELSE own END AS errors FROM (
  SELECT seq, qa_id, own, row_number() OVER (PARTITION BY qa_id, own = '' ORDER BY seq) AS nth FROM (
  SELECT seq, json_extract_string(raw, '$.qa_id') AS qa_id, concat_ws(';', CASE WHEN NOT json_exists(raw, '$.gen_prompt_version') THEN 'missing gen_prompt_version' END,
    nullif('extra ' || concat_ws(',', CASE WHEN json_exists(raw, '$.more') THEN 'more' END, CASE WHEN json_exists(raw, '$.other') THEN 'other' END), 'extra '), CASE WHEN CAST(json_extract(raw, '$.domain') AS INT) NOT BETWEEN 1 AND 9 THEN 'domain' END,
    CASE WHEN json_extract_string(raw, '$.question_type') = 'E' THEN 'type' END, CASE WHEN json_type(raw, '$.categories') <> 'ARRAY' THEN 'categories no list' END, CASE WHEN json_array_length(raw, '$.tags') = 0 THEN 'no tag' END,
    CASE WHEN json_type(raw, '$.is_fallback_expected') <> 'BOOLEAN' THEN 'fallback' END) AS own FROM v_raw))""")
def validate_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = E.validate_raw(view(spark, sf_dir, "v_raw"), spark.createDataFrame([("d3",), ("d5",)], "qa_id string"))
    return found.select("seq", "qa_id", F.array_join("errors", ";").alias("errors"))


@query("SELECT e.qa_id, count(*) AS n_expected, count(c.url) AS n_known FROM (SELECT * FROM v_expected UNION ALL SELECT qa_id, 'https://none.example.org/' FROM v_qa) e LEFT JOIN (SELECT DISTINCT source_url AS url FROM v_corpus) c ON e.url = c.url GROUP BY e.qa_id")
def url_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses that questions name, one of each absent from the corpus."""
    rows = questions(spark, sf_dir).withColumn("expected_source_urls", F.array_append("expected_source_urls", F.lit("https://none.example.org/")))
    return E.url_coverage(rows, corpus(spark, sf_dir).select(F.col("source_url").alias("url")))


@query("""SELECT domain, """ + ", ".join(f"count(*) FILTER (question_type = '{t}') AS {t}" for t in "ABCD") + """, count(*) FILTER (NOT is_fallback_expected) AS n_standard, count(*) FILTER (is_fallback_expected) AS n_fallback, count(*) AS n FROM v_drafts GROUP BY domain""")
def qa_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.question_matrix(drafts(spark, sf_dir))


VIEWS["v_decisions"] = """
SELECT qa_id, CASE WHEN item_id % 4 = 0 THEN 'Accept' WHEN item_id % 4 = 1 THEN 'Edit' ELSE 'Reject' END AS decision, CASE WHEN item_id % 8 = 1 THEN 'new ' || question END AS edited_question, CAST(NULL AS STRING) AS edited_answer, 'why' AS edit_note
FROM v_qa WHERE item_id % 4 <> 3"""


def reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_qa").select("qa_id", "domain", "question", F.lit("gold").alias("answer_gold"))
    return E.apply_review(rows, view(spark, sf_dir, "v_decisions"))


@query("""SELECT q.qa_id, q.domain, coalesce(CASE WHEN decision = 'Edit' THEN edited_question END, q.question) AS question, 'gold' AS answer_gold, CASE WHEN decision = 'Edit' THEN edit_note END AS notes,
  CASE WHEN decision IS NULL THEN 'open' WHEN decision = 'Reject' THEN 'rejected' ELSE 'accepted' END AS status FROM v_qa q LEFT JOIN v_decisions d ON q.qa_id = d.qa_id""")
def apply_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviewed(spark, sf_dir)


@query("""SELECT domain, count(decision) AS n_decided, count(*) FILTER (decision <> 'Reject') AS n_accepted, round(count(*) FILTER (decision <> 'Reject') / greatest(1, count(decision)), 6) AS accept_rate,
  count(*) FILTER (decision <> 'Reject') / greatest(1, count(decision)) >= 0.6 AS reached FROM v_qa q LEFT JOIN v_decisions d ON q.qa_id = d.qa_id GROUP BY domain""")
def accept_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.accept_rates(reviewed(spark, sf_dir)).withColumn("accept_rate", F.round("accept_rate", 6))


@query()
def truncate_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant texts as answers, every third one cut before its end."""
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    done = (F.col("conv_id") + F.col("turn")) % 3 != 0
    text = F.when(done, F.col("text")).otherwise(F.substring("text", 1, 90))
    return rows.select("conv_id", "turn", T.truncate_answer(text, done, " (see the sources)").alias("answer"))
