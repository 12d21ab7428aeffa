"""Queries of coverage reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import coverage as C
from millrace.operators import dedup
from millrace.plans.corpus import chunks
from millrace.plans.registry import query
from millrace.plans.views import VIEWS, view
from millrace.sources.files import retrieval_group

SQL_SUMS = "count(*) AS n_chunks, CAST(sum(length(text)) AS BIGINT) AS n_chars"
SQL_BY_DOMAIN = f"SELECT tag, {SQL_SUMS} FROM (SELECT d1 AS tag, text FROM v_chunks UNION ALL SELECT d2, text FROM v_chunks WHERE d2 <> d1) GROUP BY tag"


@query(SQL_BY_DOMAIN)
def coverage_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.by_tag(chunks(spark, sf_dir), "domains")


@query(f"SELECT category AS tag, {SQL_SUMS} FROM v_chunks GROUP BY category")
def coverage_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.by_tag(chunks(spark, sf_dir), "categories")


@query(f"SELECT source_type, {SQL_SUMS} FROM v_chunks GROUP BY source_type")
def coverage_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.by_column(chunks(spark, sf_dir), "source_type")


@query(f"SELECT source_file, {SQL_SUMS} FROM v_chunks GROUP BY source_file")
def coverage_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.by_column(chunks(spark, sf_dir), "source_file")


@query(f"SELECT category AS tag, {SQL_SUMS} FROM v_chunks GROUP BY category ORDER BY n_chars DESC, tag LIMIT 10")
def top_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.top_categories(chunks(spark, sf_dir))


@query("""SELECT source_type, CAST(n AS BIGINT) AS n, CAST(floor(total / n) AS BIGINT) AS mean_chars, s[1 + n // 2] AS median_chars, s[1] AS min_chars, s[n] AS max_chars, CAST(floor(100 * short / n) AS BIGINT) AS percent_short, n_attachments
FROM (SELECT source_type, count(*) AS n, sum(length(text)) AS total, list_sort(list(length(text))) AS s, count(*) FILTER (length(text) < 300) AS short, count(*) FILTER (seq % 5 = 0) AS n_attachments FROM v_chunks GROUP BY source_type)""")
def length_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir).withColumn("notes", F.when(F.col("seq") % 5 == 0, '{"attachments": []}'))
    return C.length_profile(rows)


MATRIX = [(1, "one", 10, 10, 5, 5), (2, "two", 10, 3, 3, 0), (9, "nine", 10, 5, 0, 0), (10, "ten", 1, 0, 0, 0)]


@query(f"""SELECT m.domain, m.name, m.n_questions, coalesce(h.n_chunks, 0) AS n_chunks, coalesce(h.n_chars, 0) AS n_chars, CASE WHEN coalesce(h.n_chars, 0) < 2000 THEN 'sparse' WHEN h.n_chars < 10000 THEN 'thin' ELSE 'ok' END AS flag
FROM (VALUES (1, 'one', 30), (2, 'two', 16), (9, 'nine', 15), (10, 'ten', 1)) AS m(domain, name, n_questions) LEFT JOIN ({SQL_BY_DOMAIN}) h ON h.tag = m.domain""")
def coverage_vs_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.against_questions(chunks(spark, sf_dir), spark.createDataFrame(MATRIX, "domain int, name string, a int, b int, c int, d int"))


@query("""SELECT CAST(sum(length(text)) AS BIGINT) AS n_chars, round(100.0 * sum(length(text)) / 3000000, 1) AS percent, round(100.0 * sum(length(text)) / 3000000, 1) >= 70 AND sum(length(text)) >= 100000 AS passed, '10' AS sparse_domains FROM v_chunks""")
def exit_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.exit_check(chunks(spark, sf_dir), 3_000_000, 10)


VIEWS["v_enriched"] = """
SELECT CASE WHEN t.seq % 10 = 0 THEN 'almi_cell' ELSE 'general' END AS _retrieval_group, t.chunk_id, t.text AS _passage, coalesce(l.n, 0) AS n_alias FROM v_by_text t LEFT JOIN (SELECT winner, count(*) AS n FROM v_lost GROUP BY winner) l ON l.winner = t.chunk_id"""


@query("""SELECT _retrieval_group, count(*) AS n, count(*) FILTER (n_alias > 0) AS n_alias, count(*) - count(DISTINCT chunk_id) AS n_repeated, min(length(_passage)) AS min_passage, max(length(_passage)) AS max_passage,
  CAST(floor(avg(length(_passage))) AS BIGINT) AS mean_passage FROM v_enriched GROUP BY _retrieval_group""")
def enrich_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir)
    urls = dedup.alias_urls(dedup.aliases(rows))
    kept = dedup.dedup_by_text(rows).join(urls, "chunk_id", "left")
    kept = kept.select("chunk_id", F.when(F.col("seq") % 10 == 0, "almi_cell").otherwise("general").alias("_retrieval_group"), F.col("text").alias("_passage"), F.coalesce("urls", F.array().cast("array<string>")).alias("_alias_urls"))
    return C.enrich_stats(kept)


@query("""SELECT CASE WHEN seq % 4 = 0 THEN 'UNKNOWN' ELSE lang END AS dept, count(*) AS n_chunks, CAST(sum(length(text)) AS BIGINT) AS n_chars, count(DISTINCT source_url) AS n_urls FROM v_chunks GROUP BY 1""")
def dept_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.when(F.col("seq") % 4 == 0, F.col("source_title")).otherwise(F.concat(F.lit("["), F.col("lang"), F.lit("] page")))
    return C.bracket_summary(chunks(spark, sf_dir).withColumn("source_title", title))


FIELDS = "categories,category,char_count,chunk_id,d1,d2,domains,freshness,lang,parent_post_id,posted_at,section_path,seq,source_title,source_type,source_url,text"


@query(f"""SELECT a.*, d.domains, CASE WHEN a.source_file = 'day0.jsonl' THEN replace('{FIELDS}', 'freshness,', '') ELSE '{FIELDS}' END AS fields FROM (SELECT source_file, CAST(sum(k) AS BIGINT) AS n, CAST(sum(c) AS BIGINT) AS n_chars, CAST(floor(sum(c) / sum(k)) AS BIGINT) AS mean_chars, max(mx) AS max_chars, min(mn) AS min_chars, string_agg(source_type || '=' || CAST(k AS STRING), ',' ORDER BY source_type) AS types
FROM (SELECT source_file, source_type, count(*) AS k, sum(length(text)) AS c, max(length(text)) AS mx, min(length(text)) AS mn FROM v_chunks GROUP BY source_file, source_type) GROUP BY source_file) a
JOIN (SELECT source_file, string_agg(CAST(d AS STRING) || '=' || CAST(k AS STRING), ',' ORDER BY d) AS domains FROM (SELECT source_file, unnest(list_distinct([d1, d2])) AS d, count(*) AS k FROM v_chunks GROUP BY 1, 2) GROUP BY source_file) d ON a.source_file = d.source_file""")
def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.inventory(chunks(spark, sf_dir))


@query("SELECT unnest(list_distinct([d1, d2])) AS domain, count(*) AS n FROM v_by_text GROUP BY 1")
def enrich_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enriched records of each domain."""
    return C.by_tag(dedup.dedup_by_text(chunks(spark, sf_dir)), "domains").select(F.col("tag").alias("domain"), F.col("n_chunks").alias("n"))


@query("SELECT source_file, CASE WHEN source_file = 'day1.jsonl' THEN 'almi_cell' ELSE 'general' END AS _retrieval_group, count(*) AS n FROM v_by_text GROUP BY source_file")
def group_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup.dedup_by_text(chunks(spark, sf_dir))
    return C.group_files(rows.withColumn("_retrieval_group", retrieval_group(F.col("source_file"), {"day1": "almi_cell"})))


@query("""SELECT seq, concat_ws(';', CASE WHEN source_type = 'T9' THEN 'source_type' END, CASE WHEN seq % 8 = 0 THEN 'domains' END, CASE WHEN trim(text) = '' THEN 'text' END) AS errors FROM v_chunks""")
def validate_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir).withColumn("domains", F.when(F.col("seq") % 8 == 0, F.array(F.lit(12))).otherwise(F.col("domains")))
    return C.validate_chunks(rows).select("seq", F.array_join("errors", ";").alias("errors"))


SQL_FLAGSHIP = """
SELECT tag AS domain, count(*) AS n_chunks, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM (SELECT d1 AS tag, text FROM v_by_text UNION ALL SELECT d2, text FROM v_by_text WHERE d2 <> d1) GROUP BY tag"""


@query(SQL_FLAGSHIP)
def corpus_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records, without repeats, and what each domain then holds."""
    kept = dedup.dedup_by_text(chunks(spark, sf_dir))
    return C.by_tag(kept, "domains").select(F.col("tag").alias("domain"), "n_chunks", "n_chars")
