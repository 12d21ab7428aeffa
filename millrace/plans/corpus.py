"""Queries of cleaning, de-duplication, chunking and tagging."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import chunking, dedup, tagging
from millrace.plans.registry import query
from millrace.plans.views import VIEWS, view
from millrace.sources import files
from millrace.sources.tables import shared_folder, staged


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_chunks with its two domains and its category as arrays."""
    rows = view(spark, sf_dir, "v_chunks")
    return rows.select("*", F.array_sort(F.array_distinct(F.array("d1", "d2"))).alias("domains"), F.array("category").alias("categories"))


STRIP = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
LINES = lambda x: f"array_to_string(list_transform(string_split({x}, chr(10)), lambda l: {STRIP('l')}), chr(10))"
SQL_PLAIN = "regexp_replace(replace(text, chr(160), ' '), '<표>|<그림>|<도형>|<수식>', '', 'g')"
SQL_PAGED = f"regexp_replace({SQL_PLAIN}, '\\n\\s*-\\s*\\d+\\s*-\\s*\\n', chr(10), 'g')"
SQL_TIGHT = f"regexp_replace(regexp_replace({SQL_PAGED}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g')"
SQL_CLEAN = STRIP(LINES(SQL_TIGHT))


@query(f"SELECT seq, md5({SQL_CLEAN}) AS clean_md5, CAST(length({SQL_CLEAN}) AS BIGINT) AS n_chars FROM v_chunks")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = T.clean_text(F.col("text"))
    return view(spark, sf_dir, "v_chunks").select("seq", F.md5(clean).alias("clean_md5"), F.length(clean).cast("long").alias("n_chars"))


@query(f"""SELECT source_type, CAST(sum(len(regexp_extract_all(text, chr(160)))) AS BIGINT) AS n_nbsp,
  CAST(sum(len(regexp_extract_all(replace(text, chr(160), ' '), '<표>|<그림>|<도형>|<수식>'))) AS BIGINT) AS n_placeholder,
  CAST(sum(len(regexp_extract_all({SQL_PLAIN}, '\\n\\s*-\\s*\\d+\\s*-\\s*\\n'))) AS BIGINT) AS n_page_line,
  CAST(sum(len(regexp_extract_all({SQL_PAGED}, '\\n{{3,}}'))) AS BIGINT) AS n_blank_run,
  CAST(sum(length(text)) AS BIGINT) AS chars_before, CAST(sum(length({SQL_CLEAN})) AS BIGINT) AS chars_after, count(*) AS n_rows
FROM v_chunks GROUP BY source_type""")
def clean_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = T.clean_counts(F.col("text"))
    names = [n for n in counts if n != "n_control"]
    return view(spark, sf_dir, "v_chunks").groupBy("source_type").agg(
        *[F.sum(counts[n]).cast("long").alias(n) for n in names],
        F.sum(F.length("text")).alias("chars_before"), F.sum(F.length(T.clean_text(F.col("text")))).alias("chars_after"), F.count("*").alias("n_rows"),
    )


SQL_NORMAL = STRIP("regexp_replace(" + LINES("regexp_replace(replace(text, chr(13), ''), '[ \\t\\x{00A0}]+', ' ', 'g')") + ", '\\n{3,}', chr(10) || chr(10), 'g')")


@query(f"SELECT seq, md5({SQL_NORMAL}) AS normal_md5, CAST(length({SQL_NORMAL}) AS BIGINT) AS n_chars FROM v_chunks")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    normal = T.normalize_text(F.col("text"))
    return view(spark, sf_dir, "v_chunks").select("seq", F.md5(normal).alias("normal_md5"), F.length(normal).cast("long").alias("n_chars"))


@query("SELECT seq, regexp_replace(regexp_replace(source_url, '#.*$', ''), '&GotoPage=[^&]*&q=$', '') AS url FROM v_chunks")
def normalize_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_chunks").select("seq", T.normalize_url(F.col("source_url")).alias("url"))


@query("""SELECT seq, substring(sha1(source_url || '|' || CAST(seq % 11 AS STRING) || '|' || substring(text, 1, 256)), 1, 16) AS id,
  substring(sha1(chunk_id || '|p' || lpad(CAST(seq % 11 AS STRING), 2, '0')), 1, 16) AS piece FROM v_chunks""")
def chunk_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("seq") % 11
    return view(spark, sf_dir, "v_chunks").select("seq", T.chunk_id(F.col("source_url"), n, F.col("text")).alias("id"), T.piece_id(F.col("chunk_id"), n).alias("piece"))


SQL_TITLE = "rtrim(substring(regexp_replace(regexp_replace(trim(source_title), '(?i)(\\s*>\\s*home\\s*)+$', ''), '[ \\t]+', ' ', 'g'), 1, 200))"


@query(f"SELECT seq, {SQL_TITLE} AS title FROM v_chunks")
def normalize_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_chunks").select("seq", T.normalize_title(F.col("source_title")).alias("title"))


SQL_PASSAGE = STRIP(f"""(CASE WHEN source_type = 'T9' THEN text
  WHEN regexp_matches(section_path, '^제\\s*\\d+\\s*조') THEN section_path || ' | ' || {SQL_TITLE} || chr(10) || text
  WHEN section_path = 'body' THEN {SQL_TITLE} || chr(10) || text
  ELSE {SQL_TITLE} || ' | ' || section_path || chr(10) || text END)""")


@query(f"SELECT seq, md5({SQL_PASSAGE}) AS passage_md5 FROM v_chunks")
def passage(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = F.when(F.col("source_type") == "T9", "almi_cell").otherwise("general")
    text = T.passage(T.normalize_title(F.col("source_title")), F.col("section_path"), F.col("text"), group)
    return view(spark, sf_dir, "v_chunks").select("seq", F.md5(text).alias("passage_md5"))


@query("""SELECT seq, md5(array_to_string(list_transform(string_split(regexp_replace(text, '([A-Za-z][A-Za-z0-9_]+)', chr(1) || '\\1' || chr(1), 'g'), chr(1)),
  lambda x, i: CASE WHEN i % 2 = 0 THEN lower(x) ELSE x END), '')) AS text_md5 FROM v_chunks""")
def bm25_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_chunks").select("seq", F.md5(T.bm25_text(F.col("text"))).alias("text_md5"))


@query("""SELECT seq, seq % 6 <> 0 AS dated, CASE WHEN seq % 6 = 1 THEN '2019-01-02' WHEN seq % 6 <> 0 THEN posted_at END AS iso, CAST(seq % 97 AS STRING) AS post FROM v_chunks""")
def posted_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.when(F.col("seq") % 6 == 1, "No. 7 (2019/01/02)").otherwise(F.col("lang"))
    second = F.when(F.col("seq") % 6 == 0, F.expr("substring(posted_at, 1, 7)")).otherwise(F.translate("posted_at", "-", "."))
    iso = T.first_date(first, second)
    return view(spark, sf_dir, "v_chunks").select("seq", iso.isNotNull().alias("dated"), iso.alias("iso"), T.post_id(F.col("source_url"), ("no", "id")).alias("post"))


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN CAST(100 + page_id AS STRING) WHEN page_id % 3 = 1 THEN CAST(1000 + page_id AS STRING) END AS item FROM pages""")
def item_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    onclick = F.when(n % 3 == 0, F.concat(F.lit("fnView('"), (n + 100).cast("string"), F.lit("')"))).when(n % 3 == 2, "fnSearch('GotoPage', 1234)")
    href = F.when(n % 3 == 1, F.concat(F.lit("?mng_no="), (n + 1000).cast("string"))).otherwise("javascript:void(0)")
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", T.item_id(F.lit(None).cast("string"), href, onclick).alias("item"))


@query("""SELECT page_id, url || CASE WHEN url LIKE '%?%' THEN '&' ELSE '?' END || 'GotoPage=' || CAST(n AS STRING) AS page_url FROM (SELECT page_id, url, unnest(range(1, 4)) AS n FROM pages)""")
def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.operators.pages import list_pages

    return list_pages(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), 3)


SQL_SCORE = """CASE WHEN length(text) < 80 THEN 0 ELSE
  CASE WHEN regexp_matches(text, '\\d{4}') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(text, '\\d+(시간|일|원|만원|점|학점|학기|년)') THEN 2 ELSE 0 END
  + CASE WHEN regexp_matches(text, '(\\d+\\.|①|②|③|첫째|둘째|단계)') THEN 2 ELSE 0 END
  - CASE WHEN contains(text, 'TAB MENU') THEN 1 ELSE 0 END - CASE WHEN contains(text, '본문 바로가기') THEN 1 ELSE 0 END
  - CASE WHEN contains(text, '주메뉴 바로가기') THEN 1 ELSE 0 END - CASE WHEN contains(text, '검색분류선택') THEN 1 ELSE 0 END
  + CASE WHEN length(text) BETWEEN 200 AND 1500 THEN 3 WHEN length(text) > 1500 THEN 1 ELSE 0 END END"""


@query(f"SELECT seq, CAST({SQL_SCORE} AS BIGINT) AS score FROM v_chunks")
def text_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_chunks").select("seq", T.text_score(F.col("text")).cast("long").alias("score"))


SQL_CUE = "'\\?$|어떻게|어디서|문의|FAQ|Q\\.|Q:|얼마|언제|무엇|왜'"
VIEWS["v_faq"] = """
SELECT seq, CASE WHEN seq % 11 = 0 THEN trim(source_title) || '?' ELSE source_title END AS title,
  CASE WHEN seq % 11 = 1 THEN 'Q: ' || substring(text, 1, 40) || ' A: ' || text WHEN seq % 11 = 2 THEN '문의 ' || text ELSE text END AS body
FROM v_chunks"""
SQL_REASON = f"""CASE WHEN regexp_matches(title, {SQL_CUE}) THEN 'title_question'
  WHEN regexp_matches(body, '(?s)(Q\\.|Q:|문\\s*:|문의\\s*:).{{5,200}}?(A\\.|A:|답\\s*:)') THEN 'body_qa_pattern'
  WHEN length(body) < 600 AND regexp_matches(substring(body, 1, 200), {SQL_CUE}) THEN 'short_body_question' END"""


@query(f"SELECT seq, reason, md5(substring(body, 1, 1500)) AS text_md5 FROM (SELECT *, {SQL_REASON} AS reason FROM v_faq) WHERE reason IS NOT NULL")
def faq_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_faq").withColumn("reason", T.faq_reason(F.col("title"), F.col("body")))
    return rows.where("reason is not null").select("seq", "reason", F.md5(F.substring("body", 1, 1500)).alias("text_md5"))


@query(f"SELECT reason, count(*) AS n FROM (SELECT {SQL_REASON} AS reason FROM v_faq) WHERE reason IS NOT NULL GROUP BY reason")
def faq_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faq_seed(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("n"))


SQL_KEY = "CASE source_type WHEN 'T1' THEN 0 WHEN 'T2' THEN 1 WHEN 'T3' THEN 2 WHEN 'T6' THEN 3 ELSE 99 END, CASE WHEN freshness IS NULL THEN 1 ELSE 0 END, -CASE WHEN char_count > 0 THEN char_count ELSE length(text) END"
VIEWS["v_by_id"] = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY {SQL_KEY}, seq) AS nth, min(seq) OVER (PARTITION BY chunk_id) AS first_seq FROM v_chunks) WHERE nth = 1"
VIEWS["v_by_text"] = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sha1(text) ORDER BY {SQL_KEY}, first_seq) AS nth2 FROM v_by_id) WHERE nth2 = 1"


@query("SELECT seq, chunk_id FROM v_by_id")
def dedup_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dedup_by_id(chunks(spark, sf_dir)).select("seq", "chunk_id")


@query("SELECT seq, chunk_id FROM v_by_text")
def dedup_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dedup_by_text(chunks(spark, sf_dir)).select("seq", "chunk_id")


VIEWS["v_lost"] = """
SELECT c.seq, c.chunk_id, c.source_url, t.chunk_id AS winner FROM v_chunks c JOIN v_by_id i ON c.chunk_id = i.chunk_id
JOIN v_by_text t ON sha1(i.text) = sha1(t.text) WHERE c.seq <> t.seq"""


@query("SELECT winner AS winner_chunk_id, count(*) AS alias_count, string_agg(chunk_id, ',' ORDER BY seq) AS lost_ids FROM v_lost GROUP BY winner")
def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup.aliases(chunks(spark, sf_dir))
    return found.select("winner_chunk_id", F.col("alias_count").cast("long").alias("alias_count"), F.array_join(F.transform("aliases", lambda a: a["chunk_id"]), ",").alias("lost_ids"))


# what the second pass holds when each id's winner comes: the best key of its text so far
SQL_RANK = "CAST(CASE source_type WHEN 'T1' THEN 0 WHEN 'T2' THEN 1 WHEN 'T3' THEN 2 WHEN 'T6' THEN 3 ELSE 99 END AS BIGINT) * 100000000000 + CASE WHEN freshness IS NULL THEN 10000000000 ELSE 0 END - CASE WHEN char_count > 0 THEN char_count ELSE length(text) END"
VIEWS["v_pass2"] = f"""
SELECT *, held IS NULL AS is_first, held IS NULL OR r < held AS was_best FROM (SELECT *, min(r) OVER (PARTITION BY sha1(text) ORDER BY first_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM (SELECT *, {SQL_RANK} AS r FROM v_by_id))"""
VIEWS["v_pass1"] = f"""
SELECT *, held IS NULL AS is_first, held IS NULL OR r < held AS was_best FROM (SELECT *, min(r) OVER (PARTITION BY chunk_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM (SELECT *, {SQL_RANK} AS r FROM v_chunks))"""


@query("""SELECT to_id AS winner_chunk_id, count(*) AS alias_count, string_agg(chunk_id, ',' ORDER BY seq) AS lost_ids FROM (
  SELECT c.seq, c.chunk_id, CASE WHEN c.seq = i.seq OR i.was_best THEN t.seq ELSE i.seq END AS to_seq, CASE WHEN c.seq = i.seq OR i.was_best THEN t.chunk_id ELSE i.chunk_id END AS to_id
  FROM v_chunks c JOIN v_pass2 i ON c.chunk_id = i.chunk_id JOIN v_by_text t ON sha1(i.text) = sha1(t.text) WHERE c.seq <> t.seq) WHERE seq <> to_seq GROUP BY to_id""")
def aliases_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases where a loser that never was the best of its text keeps its own."""
    found = dedup.aliases(chunks(spark, sf_dir), exact=True)
    return found.select("winner_chunk_id", F.col("alias_count").cast("long").alias("alias_count"), F.array_join(F.transform("aliases", lambda a: a["chunk_id"]), ",").alias("lost_ids"))


@query("""SELECT (SELECT count(*) FILTER (NOT is_first AND NOT was_best) FROM v_pass1) AS id_keep, (SELECT count(*) FILTER (NOT is_first AND was_best) FROM v_pass1) AS id_swap,
  (SELECT count(*) FILTER (NOT is_first AND NOT was_best) FROM v_pass2) AS text_keep, (SELECT count(*) FILTER (NOT is_first AND was_best) FROM v_pass2) AS text_swap""")
def dedup_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dedup_counts(chunks(spark, sf_dir))


SQL_URL = "regexp_replace(regexp_replace(source_url, '#.*$', ''), '&GotoPage=[^&]*&q=$', '')"


@query(f"""SELECT seq, source_url AS url, md5(text) AS text_md5, CAST(char_count AS BIGINT) AS char_count FROM v_by_text WHERE source_file <> 'day2.jsonl'
UNION ALL SELECT seq, {SQL_URL}, md5({SQL_CLEAN}), CAST(length({SQL_CLEAN}) AS BIGINT) FROM v_chunks WHERE source_file = 'day2.jsonl' AND {SQL_CLEAN} <> ''""")
def bypass_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without repeats, but those of one file, which passes by de-duplication and is only cleaned."""
    rows = chunks(spark, sf_dir)
    kept = dedup.dedup_by_text(rows).where("source_file <> 'day2.jsonl'")
    found = dedup.with_bypass(kept, rows.where("source_file = 'day2.jsonl'"))
    return found.select("seq", F.col("source_url").alias("url"), F.md5("text").alias("text_md5"), F.col("char_count").cast("long").alias("char_count"))


@query("""SELECT winner AS chunk_id, string_agg(source_url, ' ' ORDER BY seq) AS urls
FROM (SELECT winner, source_url, min(seq) AS seq FROM v_lost GROUP BY winner, source_url) GROUP BY winner""")
def alias_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.alias_urls(dedup.aliases(chunks(spark, sf_dir))).select("chunk_id", F.array_join("urls", " ").alias("urls"))


@query("""SELECT hash, n, preview FROM (SELECT substring(sha1(text), 1, 16) AS hash, count(*) AS n, min(substring(text, 1, 160)) AS preview
  FROM v_chunks GROUP BY sha1(text) ORDER BY n DESC, hash LIMIT 8) WHERE n >= 2""")
def dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.duplicate_groups(chunks(spark, sf_dir))


@query("""SELECT c.chunk_id, c.text_md5, c.n_rows, d.domains, g.categories, s.sections FROM
  (SELECT chunk_id, md5(arg_min(text, CASE WHEN section_path LIKE '%cross_tag%' THEN seq ELSE 1000000000 + seq END)) AS text_md5, count(*) AS n_rows FROM v_cross GROUP BY chunk_id) c
  JOIN (SELECT chunk_id, string_agg(CAST(d AS STRING), ',' ORDER BY d) AS domains FROM (SELECT DISTINCT chunk_id, d1 AS d FROM v_cross UNION SELECT DISTINCT chunk_id, d2 FROM v_cross) GROUP BY chunk_id) d USING (chunk_id)
  JOIN (SELECT chunk_id, string_agg(category, ',' ORDER BY category) AS categories FROM (SELECT DISTINCT chunk_id, category FROM v_cross) GROUP BY chunk_id) g USING (chunk_id)
  JOIN (SELECT chunk_id, string_agg(s, ' | ' ORDER BY s) AS sections FROM (SELECT DISTINCT chunk_id, replace(section_path, 'cross_tag/', '') AS s FROM v_cross) GROUP BY chunk_id) s USING (chunk_id)""")
def merge_same_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_cross")
    rows = rows.select("*", F.array_sort(F.array_distinct(F.array("d1", "d2"))).alias("domains"), F.array("category").alias("categories"), F.lit(None).cast("string").alias("notes"))
    merged = dedup.merge_same_id(rows)
    return merged.select(
        "chunk_id", F.md5("text").alias("text_md5"), "n_rows", F.array_join(F.array_sort("domains").cast("array<string>"), ",").alias("domains"),
        F.array_join(F.array_sort("categories"), ",").alias("categories"), F.col("section_path").alias("sections"),
    )


VIEWS["v_cross"] = """
SELECT seq, chunk_id, text, d1, d2, category, CASE WHEN seq % 3 = 1 THEN 'cross_tag/' || section_path ELSE section_path END AS section_path FROM v_chunks"""

VIEWS["v_long"] = """
SELECT doc_id AS seq, substring(sha1(CAST(doc_id AS STRING)), 1, 16) AS chunk_id,
  CASE WHEN doc_id % 4 = 1 THEN replace(text, '. ', '.' || chr(10) || chr(10)) WHEN doc_id % 4 = 2 THEN replace(text, '. ', '.' || chr(10) || ' ' || chr(10))
    WHEN doc_id % 4 = 3 THEN replace(replace(text, chr(10), ' '), '. ', '.' || chr(10) || CAST(doc_id % 20 AS STRING) || ') ') ELSE text END AS text
FROM documents"""
SQL_WINDOWS = lambda x: f"CASE WHEN length({x}) <= 2000 THEN [{x}] ELSE list_transform(range(0, CAST(ceil((length({x}) - 1500) / 1300.0) AS BIGINT) + 1), lambda k: substring({x}, k * 1300 + 1, 1500)) END"
SQL_PARTS = lambda x, sep: f"list_filter(list_transform({sep.format(x=x)}, lambda e: {STRIP('e')}), lambda e: e <> '')"
SQL_PARAGRAPHS = lambda x: SQL_PARTS(x, "regexp_split_to_array({x}, '\\n{{2,}}')")
# the items begin at a line of one or two digits, a point or bracket, and white space, however many blank lines stand before it
SQL_NUMBERS = lambda x: SQL_PARTS(x, "string_split(regexp_replace({x}, '(\\n\\s*\\d{{1,2}}[.)]\\s)', chr(1) || '\\1', 'g'), chr(1))")
SQL_ARTICLES = lambda x: SQL_PARTS(x, "string_split(regexp_replace({x}, '(제\\s*\\d+\\s*조(의\\s*\\d+)?\\s*[(（])', chr(1) || '\\1', 'g'), chr(1))")
SQL_FIT = lambda x: f"(len({x}) >= 2 AND len(list_filter({x}, lambda e: length(e) > 2000)) = 0)"


def sql_pieces(source: str) -> str:
    """seq, chunk_id, text, the pieces w and the strategy of a view's records, by the splitting rules."""
    flat = f"flatten(list_transform(paragraphs, lambda p: CASE WHEN length(p) <= 2000 THEN [p] WHEN {SQL_FIT(SQL_NUMBERS('p'))} THEN {SQL_NUMBERS('p')} ELSE {SQL_WINDOWS('p')} END))"
    return f"""SELECT *, CASE WHEN length(text) <= 2000 THEN [text] WHEN marks >= 3 THEN CASE WHEN len(articles) < 3 THEN {SQL_WINDOWS('text')} ELSE flatten(list_transform(articles, lambda x: {SQL_WINDOWS('x')})) END
    WHEN len(paragraphs) >= 2 THEN {flat} WHEN {SQL_FIT('numbers')} THEN numbers ELSE {SQL_WINDOWS('text')} END AS w,
  CASE WHEN length(text) <= 2000 THEN 'none' WHEN marks >= 3 THEN 'article' WHEN len(paragraphs) >= 2 OR {SQL_FIT('numbers')} THEN 'separator' ELSE 'window' END AS strategy
FROM (SELECT *, {SQL_PARAGRAPHS('text')} AS paragraphs, {SQL_NUMBERS('text')} AS numbers, {SQL_ARTICLES('text')} AS articles,
  coalesce(list_sum(list_transform(regexp_extract_all(chr(10) || text, '(\\s*)제\\s*\\d+\\s*조(의\\s*\\d+)?\\s*[(（]', 1), lambda m: length(m) + 1)), 0) AS marks FROM {source})"""


@query(f"SELECT seq, CAST(unnest(range(len(w))) AS BIGINT) AS piece, md5(unnest(w)) AS piece_md5 FROM (SELECT seq, {SQL_WINDOWS('text')} AS w FROM v_long)")
def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = view(spark, sf_dir, "v_long").select("seq", F.posexplode(chunking.windows(F.col("text"))).alias("piece", "t"))
    return cut.select("seq", F.col("piece").cast("long").alias("piece"), F.md5("t").alias("piece_md5"))


@query(f"SELECT seq, strategy, CAST(len(w) AS BIGINT) AS n_pieces, md5(array_to_string(w, chr(1))) AS pieces_md5 FROM ({sql_pieces('v_long')})")
def general_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    short = F.struct(F.array(text).alias("pieces"), F.lit("none").alias("strategy"))
    cut = view(spark, sf_dir, "v_long").select("seq", F.when(F.length(text) <= chunking.MAX_LENGTH, short).otherwise(chunking.general_cut(text)).alias("cut"))
    pieces, strategy = F.col("cut.pieces"), F.col("cut.strategy")
    return cut.select("seq", strategy.alias("strategy"), F.size(pieces).cast("long").alias("n_pieces"), F.md5(F.array_join(pieces, "\u0001")).alias("pieces_md5"))


# regulations with brackets of both widths, marked or not, paragraphs, plain texts, and cells of one report
VIEWS["v_rules"] = """
SELECT doc_id AS seq, substring(sha1(CAST(doc_id AS STRING)), 1, 16) AS chunk_id, CASE WHEN doc_id % 10 = 8 THEN 'day1/dept_info.jsonl' ELSE 'day' || CAST(doc_id % 3 AS STRING) || '/rules.jsonl' END AS source_file,
  CASE WHEN doc_id % 4 = 0 THEN replace(text, '. ', '.' || chr(10) || '제' || CAST(doc_id % 40 AS STRING) || '조(')
    WHEN doc_id % 4 = 1 THEN replace(text, '. ', '. ' || chr(10) || ' 제 ' || CAST(doc_id % 40 AS STRING) || '조의2 （')
    WHEN doc_id % 4 = 2 THEN replace(text, '. ', '.' || chr(10) || chr(10)) ELSE text END AS text,
  CASE WHEN doc_id % 5 = 0 THEN 'p' || CAST(doc_id - doc_id % 15 AS STRING) WHEN doc_id % 5 = 1 THEN '' END AS parent_post_id, CASE WHEN doc_id % 7 = 0 THEN 'seen' END AS notes, CAST(doc_id % 15 AS INT) AS chunk_index,
  CAST(1 + doc_id % 9 AS INT) AS d1, CAST(1 + doc_id % 6 AS INT) AS d2, CAST(1 + doc_id % 9 AS STRING) || '.' || CAST(doc_id % 6 AS STRING) AS category,
  'c' || CAST(doc_id % 3 AS STRING) || CASE WHEN doc_id % 20 = 8 THEN '' ELSE ' >d' || CAST(doc_id % 70 AS STRING) || ' > ' || lang END AS section_path, source AS source_url, '2024-01-0' || CAST(1 + doc_id % 9 AS STRING) AS posted_at
FROM documents"""
CELLS = "source_file LIKE '%dept_info%'"


def rules_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_rules")
    return rows.select("*", F.array_sort(F.array_distinct(F.array("d1", "d2"))).alias("domains"), F.array("category").alias("categories"))


@query(f"SELECT seq, CAST(len(w) AS BIGINT) AS n_pieces, md5(array_to_string(w, chr(1))) AS pieces_md5 FROM (SELECT seq, CASE WHEN len(p) < 3 THEN {SQL_WINDOWS('text')} ELSE flatten(list_transform(p, lambda x: {SQL_WINDOWS('x')})) END AS w FROM (SELECT seq, text, {SQL_ARTICLES('text')} AS p FROM v_rules))")
def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = chunking.articles(F.col("text"))
    return view(spark, sf_dir, "v_rules").select("seq", F.size(pieces).cast("long").alias("n_pieces"), F.md5(F.array_join(pieces, "\u0001")).alias("pieces_md5"))


def sql_split(source: str, more: str = "") -> str:
    """The pieces of a view's records, as records."""
    return f"""
SELECT seq, source_file, strategy, d1, d2, category, section_path, source_url, posted_at, i, n,{more} CASE WHEN n > 1 THEN i ELSE chunk_index END AS chunk_index, piece AS text,
  CASE WHEN n > 1 THEN substring(sha1(chunk_id || '|p' || CASE WHEN i < 10 THEN '0' ELSE '' END || CAST(i AS STRING)), 1, 16) ELSE chunk_id END AS chunk_id,
  CASE WHEN n > 1 THEN coalesce(nullif(parent_post_id, ''), chunk_id) ELSE parent_post_id END AS parent_post_id,
  CASE WHEN n > 1 THEN CASE WHEN coalesce(notes, '') = '' THEN '' ELSE notes || ' | ' END || 'split_from=' || chunk_id ELSE notes END AS notes
FROM (SELECT *, len(w) AS n, CAST(unnest(range(len(w))) AS INT) AS i, unnest(w) AS piece FROM ({sql_pieces(source)}))"""


VIEWS["v_pieces"] = sql_split("v_rules")


@query("SELECT seq, chunk_id, parent_post_id, CAST(chunk_index AS BIGINT) AS chunk_index, CAST(length(text) AS BIGINT) AS char_count, strategy, notes, md5(text) AS text_md5 FROM v_pieces")
def rechunk_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = chunking.split_records(rules_view(spark, sf_dir))
    return cut.select("seq", "chunk_id", "parent_post_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("char_count").cast("long").alias("char_count"), "strategy", "notes", F.md5("text").alias("text_md5"))


VIEWS["v_lines"] = """
SELECT 'f' || CAST(doc_id % 3 AS STRING) AS source_file, CASE WHEN doc_id % 4 = 1 THEN 'kept' END AS notes, @DS@ AS @DOMAINS@, @CS@ AS @CATEGORIES@, CASE WHEN doc_id % 10 = 9 THEN NULL ELSE 'p' || CAST(doc_id AS STRING) END AS parent_post_id,
  i AS chunk_index, substring(sha1(CAST(doc_id AS STRING) || '|' || CAST(i AS STRING)), 1, 16) AS chunk_id, line AS text
FROM (SELECT doc_id, CAST(i AS INT) AS i, line FROM (@LINES@))"""
SPARK_LINES = "SELECT doc_id, posexplode(split(text, chr(10))) AS (i, line) FROM documents"
DUCK_LINES = "SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS line FROM documents"
_LINES = VIEWS["v_lines"]
VIEWS["v_lines"] = _LINES.replace("@LINES@", DUCK_LINES).replace("@DS@", "[CAST(1 + i % 9 AS INT)]").replace("@CS@", "[CAST(i % 7 AS STRING)]").replace("@DOMAINS@", "ds").replace("@CATEGORIES@", "cs")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/documents.parquet").createOrReplaceTempView("documents")
    text = _LINES.replace("@LINES@", SPARK_LINES).replace("@DS@", "array(CAST(1 + i % 9 AS INT))").replace("@CS@", "array(CAST(i % 7 AS STRING))")
    return spark.sql(text.replace("@DOMAINS@", "domains").replace("@CATEGORIES@", "categories"))


def sql_merged(source: str, ties: str = "") -> str:
    """Common tables up to g: the outputs of the left-to-right joining of a view's records that have a parent."""
    return f"""
WITH RECURSIVE o AS (
  SELECT *, row_number() OVER (PARTITION BY source_file, parent_post_id ORDER BY chunk_index, {ties}chunk_id) AS k, count(*) OVER (PARTITION BY source_file, parent_post_id) AS n_rows
  FROM {source} WHERE coalesce(parent_post_id, '') <> ''
), r AS (
  SELECT source_file, parent_post_id, n_rows, k, chunk_index, chunk_id, text, notes, ds, cs, 1 AS n_merged, 1 AS part FROM o WHERE k = 1
  UNION ALL
  SELECT o.source_file, o.parent_post_id, o.n_rows, o.k, CASE WHEN length(r.text) < 50 THEN r.chunk_index ELSE o.chunk_index END,
    CASE WHEN length(r.text) < 50 THEN substring(sha1(r.chunk_id || '|m+' || o.chunk_id), 1, 16) ELSE o.chunk_id END,
    CASE WHEN length(r.text) < 50 THEN r.text || CASE WHEN r.text LIKE '%' || chr(10) THEN '' ELSE chr(10) || chr(10) END || o.text ELSE o.text END,
    CASE WHEN length(r.text) < 50 THEN CASE WHEN coalesce(r.notes, '') = '' THEN '' ELSE r.notes || ' | ' END || 'merged_with=' || o.chunk_id ELSE o.notes END,
    CASE WHEN length(r.text) < 50 THEN list_sort(list_distinct(list_concat(r.ds, o.ds))) ELSE o.ds END, CASE WHEN length(r.text) < 50 THEN list_sort(list_distinct(list_concat(r.cs, o.cs))) ELSE o.cs END,
    CASE WHEN length(r.text) < 50 THEN r.n_merged + 1 ELSE 1 END, CASE WHEN length(r.text) < 50 THEN r.part ELSE r.part + 1 END
  FROM r JOIN o ON r.source_file = o.source_file AND r.parent_post_id = o.parent_post_id AND o.k = r.k + 1
), e AS (
  SELECT *, row_number() OVER (PARTITION BY source_file, parent_post_id, part ORDER BY k DESC) AS z, max(part) OVER (PARTITION BY source_file, parent_post_id) AS parts FROM r
), f AS (
  SELECT * FROM e WHERE z = 1
), g AS (
  SELECT a.source_file, a.parent_post_id, a.n_rows, a.chunk_index, CASE WHEN b.chunk_id IS NOT NULL THEN substring(sha1(a.chunk_id || '|m+' || b.chunk_id), 1, 16) ELSE a.chunk_id END AS chunk_id,
    CASE WHEN b.chunk_id IS NOT NULL THEN a.text || CASE WHEN a.text LIKE '%' || chr(10) THEN '' ELSE chr(10) || chr(10) END || b.text ELSE a.text END AS text,
    CASE WHEN b.chunk_id IS NOT NULL THEN CASE WHEN coalesce(a.notes, '') = '' THEN '' ELSE a.notes || ' | ' END || 'merged_with=' || b.chunk_id ELSE a.notes END AS notes,
    CASE WHEN b.chunk_id IS NOT NULL THEN list_sort(list_distinct(list_concat(a.ds, b.ds))) ELSE a.ds END AS ds, CASE WHEN b.chunk_id IS NOT NULL THEN list_sort(list_distinct(list_concat(a.cs, b.cs))) ELSE a.cs END AS cs,
    a.n_merged + coalesce(b.n_merged, 0) AS n_merged
  FROM f a LEFT JOIN f b ON a.source_file = b.source_file AND a.parent_post_id = b.parent_post_id AND b.part = a.part + 1 AND b.part = b.parts AND length(b.text) < 50
  WHERE NOT (a.part = a.parts AND a.parts > 1 AND length(a.text) < 50)
)"""


LINES_SQL = sql_merged("v_lines")


@query(LINES_SQL + """
SELECT source_file, parent_post_id, CAST(chunk_index AS BIGINT) AS chunk_index, chunk_id, md5(text) AS text_md5, CAST(n_merged AS BIGINT) AS n_merged, notes, array_to_string(ds, ',') AS domains, array_to_string(cs, ',') AS categories FROM g
UNION ALL SELECT source_file, parent_post_id, CAST(chunk_index AS BIGINT), chunk_id, md5(text), 1, notes, array_to_string(ds, ','), array_to_string(cs, ',') FROM v_lines WHERE parent_post_id IS NULL""")
def merge_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = chunking.merge_small(lines(spark, sf_dir))
    return merged.select(
        "source_file", "parent_post_id", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk_id", F.md5("text").alias("text_md5"), F.col("n_merged").cast("long").alias("n_merged"),
        "notes", F.array_join(F.col("domains").cast("array<string>"), ",").alias("domains"), F.array_join("categories", ",").alias("categories"),
    )


@query(LINES_SQL + """, z AS (SELECT text, n_merged FROM g UNION ALL SELECT text, 1 FROM v_lines WHERE parent_post_id IS NULL)
SELECT (SELECT count(*) FROM v_lines) AS n_before, (SELECT count(*) FROM v_lines WHERE length(text) < 50) AS short_before, count(*) AS n_after, count(*) FILTER (n_merged > 1) AS n_joined,
  count(*) FILTER (length(text) < 50) AS short_after, round(avg(length(text)), 6) AS mean_chars, CAST(max(length(text)) AS BIGINT) AS max_chars FROM z""")
def merge_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir)
    found = chunking.merge_stats(rows, chunking.merge_small(rows))
    return found.withColumn("mean_chars", F.round("mean_chars", 6)).withColumn("max_chars", F.col("max_chars").cast("long"))


# what is joined, the cells and their sections, of a view of pieces
SQL_OTHERS = lambda pieces: f"SELECT *, list_sort(list_distinct([d1, d2])) AS ds, [category] AS cs FROM {pieces} WHERE NOT {CELLS}"
SQL_CELLS = lambda pieces: f"""SELECT *, CASE WHEN contains(section_path, '>') THEN trim(string_split(section_path, '>')[1]) || ' > ' || trim(string_split(section_path, '>')[2]) ELSE section_path END AS section FROM {pieces} WHERE {CELLS}"""
SQL_SECTIONS = lambda cells: f"""SELECT section, substring('[' || section || ']' || chr(10) || string_agg(text, chr(10) ORDER BY section_path, chunk_id), 1, 2000) AS text, count(*) AS n_rows,
  arg_min(source_url, section_path || chr(1) || chunk_id) AS source_url, arg_min(posted_at, section_path || chr(1) || chunk_id) AS posted_at FROM {cells} GROUP BY section"""  # noqa: E731
VIEWS["v_uncelled"], VIEWS["v_celled"], VIEWS["v_sections"] = SQL_OTHERS("v_pieces"), SQL_CELLS("v_pieces"), SQL_SECTIONS("v_celled")


def sql_rechunked(others: str, cells: str, ties: str = "") -> str:
    """Common tables up to m: the joined records of a view, those without a parent, and the cells."""
    return sql_merged(others, ties) + f""", m AS (
  SELECT source_file, parent_post_id, chunk_id, text, notes, ds, cs, n_merged, true AS parted, false AS cell FROM g
  UNION ALL SELECT source_file, parent_post_id, chunk_id, text, notes, ds, cs, 1, false, false FROM {others} WHERE coalesce(parent_post_id, '') = ''
  UNION ALL SELECT source_file, parent_post_id, chunk_id, text, notes, list_sort(list_distinct([d1, d2])), [category], 1, false, true FROM {cells}
)"""


RULES_SQL = sql_rechunked("v_uncelled", "v_celled")


def rechunked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    rows = rules_view(spark, sf_dir)
    return rows, *chunking.rechunk(rows, F.expr(CELLS))


@query(RULES_SQL + " SELECT source_file, parent_post_id, chunk_id, md5(text) AS text_md5, notes, array_to_string(ds, ',') AS domains, CAST(n_merged AS BIGINT) AS n_merged FROM m")
def rechunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = rechunked(spark, sf_dir)[2]
    return merged.select("source_file", "parent_post_id", "chunk_id", F.md5("text").alias("text_md5"), "notes", F.array_join(F.col("domains").cast("array<string>"), ",").alias("domains"), F.col("n_merged").cast("long").alias("n_merged"))


@query("""SELECT CASE WHEN source_file LIKE '%dept_info%' THEN 'cells' ELSE 'others' END AS route, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM v_pieces GROUP BY 1
UNION ALL SELECT 'sections', count(*), CAST(sum(length(text)) AS BIGINT) FROM v_sections""")
def route_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is joined, what stays as cells, and what the cells give by section."""
    split = staged(chunking.split_records(rules_view(spark, sf_dir)))
    others, cells = chunking.route_cells(split, F.expr(CELLS))
    parts = {"others": others, "cells": cells, "sections": chunking.merge_by_section(cells)}
    counted = [df.groupBy(F.lit(k).alias("route")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars")) for k, df in parts.items()]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


# the rules by posts: a post's records stand in one file, some posts have one record, and some texts are numbered items
VIEWS["v_posts"] = """
SELECT seq, chunk_id, CASE WHEN source_file LIKE '%dept_info%' THEN source_file ELSE 'day' || CAST((seq % 45 - seq % 15) % 7 AS STRING) || '/rules.jsonl' END AS source_file,
  CASE WHEN seq % 8 = 3 THEN replace(replace(text, chr(10), ' '), '. ', '.' || chr(10) || CAST(seq % 20 AS STRING) || ') ') ELSE text END AS text,
  CASE WHEN seq % 35 = 0 THEN 'q' || CAST(seq AS STRING) ELSE parent_post_id END AS parent_post_id, notes, chunk_index, d1, d2, category, section_path, source_url, posted_at
FROM v_rules"""
SQL_SHOWN = "regexp_replace(text, '[\\x00\\x{200B}\\x{200D}\\x{FEFF}]', '', 'g') AS text"
VIEWS["v_clean_posts"] = f"SELECT * FROM (SELECT * REPLACE ({SQL_CLEAN} AS text) FROM (SELECT * REPLACE ({SQL_SHOWN}) FROM v_posts)) WHERE text <> ''"
VIEWS["v_post_pieces"] = sql_split("v_clean_posts", " coalesce(parent_post_id, '') AS of_parent, coalesce(chunk_index, 0) AS of_index, coalesce(chunk_id, '') AS of_id,")
VIEWS["v_post_others"], VIEWS["v_post_cells"], VIEWS["v_post_sections"] = SQL_OTHERS("v_post_pieces"), SQL_CELLS("v_post_pieces"), SQL_SECTIONS("v_post_cells")


def clean_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that splitting and joining are given: of clean text, made once, with its length; those left without text go."""
    rows = view(spark, sf_dir, "v_posts")
    clean = F.explode_outer(F.array(T.clean_text(F.col("text")))).alias("text")
    rows = rows.select(*[c for c in rows.columns if c != "text"], clean).where("text <> ''")
    domains = F.array_sort(F.array_distinct(F.array_compact(F.array("d1", "d2"))))
    rows = rows.select("*", F.length("text").alias("char_count"), domains.alias("domains"), F.array("category").alias("categories"))
    return rows.drop("seq", "d1", "d2", "category")


@query(sql_rechunked("v_post_others", "v_post_cells", "of_parent, of_index, of_id, ") + """, i AS (SELECT count(*) AS n_in, round(avg(length(text)), 6) AS mean_in, CAST(max(length(text)) AS BIGINT) AS max_in FROM v_clean_posts),
c AS (SELECT count(*) FILTER (i = 0 AND strategy <> 'none') AS split_sources, count(*) FILTER (i = 0 AND strategy = 'article') AS split_article, count(*) FILTER (i = 0 AND strategy = 'separator') AS split_separator,
  count(*) FILTER (i = 0 AND strategy = 'window') AS split_window, count(*) FILTER (strategy <> 'none') AS split_pieces FROM v_post_pieces),
p AS (SELECT CAST(coalesce(sum(n_merged - 1 + CASE WHEN length(text) < 50 AND n_merged > 1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS merge_sources, count(*) AS merge_results, count(*) FILTER (length(text) < 50) AS orphans FROM m WHERE parted),
t AS (SELECT length(text) AS n, 0 AS s FROM m UNION ALL SELECT length(text), 1 FROM v_post_sections),
u AS (SELECT CAST(sum(s) AS BIGINT) AS n_sections, count(*) AS n_out, round(avg(n), 6) AS mean_out, CAST(max(n) AS BIGINT) AS max_out, count(*) FILTER (n < 50 AND s = 0) AS short_out, count(*) FILTER (n > 2000 AND s = 0) AS long_out FROM t),
b AS (SELECT 'file' AS scope, source_file AS name, 1 AS i, 0 AS o FROM v_clean_posts UNION ALL SELECT 'file', source_file, 0, 1 FROM m UNION ALL SELECT 'file', 'day1/dept_merged.jsonl', 0, 1 FROM v_post_sections
  UNION ALL SELECT 'domain', CAST(unnest(list_distinct([d1, d2])) AS VARCHAR), 1, 0 FROM v_clean_posts UNION ALL SELECT 'domain', CAST(unnest(ds) AS VARCHAR), 0, 1 FROM m
  UNION ALL SELECT 'domain', CAST(domain AS VARCHAR), 0, 1 FROM (SELECT DISTINCT section, unnest(list_distinct([d1, d2])) AS domain FROM v_post_cells))
SELECT 'all' AS scope, CAST(NULL AS VARCHAR) AS name, i.*, c.*, p.*, (SELECT count(*) FROM v_post_cells) AS n_cells, u.* FROM i, c, p, u
UNION ALL BY NAME SELECT scope, name, CAST(sum(i) AS BIGINT) AS n_in, CAST(sum(o) AS BIGINT) AS n_out FROM b GROUP BY scope, name""")
def rechunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean records split, joined and put together by section: the figures of the whole, and records in and out of each file and domain."""
    done = chunking.rechunk(clean_posts(spark, sf_dir), F.expr(CELLS), fields=("source_file", "parent_post_id", "text", "char_count", "domains"))
    found = chunking.rechunk_report(*done, F.expr(CELLS), "day1/dept_merged.jsonl")
    kept = ("scope", "name")
    return found.select(*kept, *[F.round(c, 6).alias(c) if c.startswith("mean") else F.col(c).cast("long").alias(c) for c in found.columns if c not in kept])


@query(RULES_SQL + """, b AS (SELECT unnest(list_distinct([d1, d2])) AS domain, 1 AS i, 0 AS o FROM v_rules UNION ALL SELECT unnest(ds), 0, 1 FROM m
  UNION ALL SELECT DISTINCT ON (section, domain) domain, 0, 1 FROM (SELECT section, unnest([d1, d2]) AS domain FROM v_celled))
SELECT domain, CAST(sum(i) AS BIGINT) AS n_in, CAST(sum(o) AS BIGINT) AS n_out FROM b GROUP BY domain""")
def domain_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of each domain before and after splitting, joining and the sections."""
    rows, _, merged, sections = rechunked(spark, sf_dir)
    return chunking.domain_flow(rows, merged, sections)


VIEWS["v_stats"] = """
SELECT r_name AS college, n_name AS dept, o_orderpriority AS stat, year(o_orderdate) AS y, count(*) AS val, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS val2
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY r_name, n_name, o_orderpriority, year(o_orderdate)"""
SQL_SENTENCE = """college || ' ' || dept || ' (daily) ' || CAST(y AS STRING) || '년 ' || stat || ' ' || CAST(val AS STRING) || '명' || CASE WHEN val2 > 0 THEN ' (val2=' || CAST(val2 AS STRING) || ')' ELSE '' END || ' [출처: orders, flag=' || substring(stat, 1, 1) || ']'"""
VIEWS["v_cells"] = f"SELECT college || ' > ' || dept || ' > ' || stat AS section_path, substring(sha1(dept || stat || CAST(y AS STRING)), 1, 16) AS chunk_id, {SQL_SENTENCE} AS text, 'u' || CAST(y AS STRING) AS source_url, CAST(substring(stat, 1, 1) AS INT) AS domain, stat AS category, CAST(y AS STRING) || '-01-01' AS posted_at, CASE WHEN y % 2 = 0 THEN 'dated' ELSE 'static' END AS freshness FROM v_stats"


@query("""SELECT section, md5(substring('[' || section || ']' || chr(10) || string_agg(text, chr(10) ORDER BY section_path, chunk_id), 1, 2000)) AS text_md5, count(*) AS n_rows,
  arg_min(source_url, section_path || chr(1) || chunk_id) AS source_url, substring(sha1(section || '|dept_merged'), 1, 16) AS chunk_id, 'dept_merged_' || substring(sha1(section || '|dept_merged'), 1, 16) AS parent_post_id,
  'dept_merged from ' || CAST(count(*) AS STRING) || ' cells' AS notes, array_to_string(list_sort(list(DISTINCT domain)), ',') AS domains, array_to_string(list_sort(list(DISTINCT category)), ',') AS categories,
  arg_min(posted_at, section_path || chr(1) || chunk_id) AS posted_at, arg_min(freshness, section_path || chr(1) || chunk_id) AS freshness
FROM (SELECT *, string_split(section_path, ' > ')[1] || ' > ' || string_split(section_path, ' > ')[2] AS section FROM v_cells) GROUP BY section""")
def dept_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_cells").select("*", F.array("domain").alias("domains"), F.array("category").alias("categories"))
    found = chunking.merge_by_section(rows)
    return found.select("section", F.md5("text").alias("text_md5"), "n_rows", "source_url", "chunk_id", "parent_post_id", "notes", F.array_join(F.col("domains").cast("array<string>"), ",").alias("domains"), F.array_join("categories", ",").alias("categories"), "posted_at", "freshness")


@query("""SELECT chunk_id, md5(context) AS context_md5 FROM (SELECT chunk_id,
  CASE WHEN lag(text) OVER w IS NULL THEN '' ELSE lag(text) OVER w || chr(10) END || text || CASE WHEN lead(text) OVER w IS NULL THEN '' ELSE chr(10) || lead(text) OVER w END AS context
  FROM v_lines WHERE parent_post_id IS NOT NULL WINDOW w AS (PARTITION BY parent_post_id ORDER BY chunk_index, chunk_id)) UNION ALL SELECT chunk_id, md5(text) FROM v_lines WHERE parent_post_id IS NULL""")
def neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir)
    return chunking.neighbour_context(rows, rows).select("chunk_id", F.md5("context").alias("context_md5"))


RULES = [("1.5 also 8.3", "1.5", [8], ["8.3"]), ("2.1 also 2.4", "2.1", [], ["2.4"]), ("2.2 also 2.4", "2.2", [], ["2.4"]), ("6.1 also 6.6", "6.1", [], ["6.6"]), ("6 also 9", "6", [9], []), ("none", "77", [], [])]
SQL_RULES = "(VALUES ('1.5 also 8.3', '1.5', [8], ['8.3']), ('2.1 also 2.4', '2.1', [], ['2.4']), ('2.2 also 2.4', '2.2', [], ['2.4']), ('6.1 also 6.6', '6.1', [], ['6.6']), ('6 also 9', '6', [9], []), ('none', '77', [], [])) AS r(rule, prefix, ad, ac)"


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "rule string, prefix string, add_domains array<int>, add_categories array<string>")


@query(f"""SELECT seq, rule, array_to_string(list_sort(list_distinct(list_concat([d1, d2], ad))), ',') AS domains, array_to_string(list_sort(list_distinct(list_concat([category], ac))), ',') AS categories,
  'cross_tag/' || section_path AS section_path FROM v_chunks JOIN {SQL_RULES} ON category = prefix OR category LIKE prefix || '.%'""")
def cross_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tagging.cross_tag(chunks(spark, sf_dir), rules(spark))
    return found.select("seq", "rule", F.array_join(F.col("domains").cast("array<string>"), ",").alias("domains"), F.array_join("categories", ",").alias("categories"), "section_path")


@query(f"""SELECT rule, count(seq) AS n_chunks, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS n_chars
FROM {SQL_RULES} LEFT JOIN v_chunks ON category = prefix OR category LIKE prefix || '.%' GROUP BY rule""")
def cross_tag_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagging.cross_tag_summary(chunks(spark, sf_dir), rules(spark))


DOMAINS = [(1, ["src1.example.org"], ["/en/"], ["page 3"]), (2, [], ["id=42"], []), (5, ["src5.example.org", "src6.example.org"], [], ["fr page 1"]), (9, [], [], ["es page"])]
SQL_DOMAINS = "(VALUES (1, ['src1.example.org'], ['/en/'], ['page 3']), (2, [], ['id=42'], []), (5, ['src5.example.org', 'src6.example.org'], [], ['fr page 1']), (9, [], [], ['es page'])) AS r(domain, hosts, uw, tw)"
SQL_MATCH = f"""SELECT DISTINCT c.chunk_id, c.seq, r.domain, CASE WHEN d1 = domain OR d2 = domain THEN 1 ELSE 0 END + CASE WHEN list_contains(hosts, regexp_extract(source_url, '^[a-z]+://([^/?#]+)', 1))
  OR len(list_filter(uw, lambda w: contains(source_url, w))) > 0 OR len(list_filter(tw, lambda w: contains(source_title, w))) > 0 THEN 2 ELSE 0 END AS match FROM v_by_id c, {SQL_DOMAINS}"""


def domain_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DOMAINS, "domain int, hosts array<string>, url_words array<string>, title_words array<string>")


@query(f"SELECT chunk_id, domain, match FROM ({SQL_MATCH}) WHERE match > 0")
def domain_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagging.domain_matches(dedup.dedup_by_id(chunks(spark, sf_dir)), domain_rules(spark))


POOL_EXTRA = ("src3.example.org", ("the ", "zzzz"), 7, 20)
VIEWS["v_candidates"] = f"""
SELECT domain, chunk_id, max(score) AS score FROM (
  SELECT m.domain, m.chunk_id, 5 * m.match + s.ts AS score FROM ({SQL_MATCH}) m JOIN (SELECT seq, {SQL_SCORE} AS ts FROM v_chunks) s USING (seq) WHERE m.match > 0 AND s.ts > 0
  UNION ALL SELECT 7, chunk_id, 20 FROM v_by_id WHERE regexp_extract(source_url, '^[a-z]+://([^/?#]+)', 1) = 'src3.example.org' AND (contains(text, 'the ') OR contains(text, 'zzzz'))) GROUP BY domain, chunk_id"""


def candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = dedup.dedup_by_id(chunks(spark, sf_dir))
    return rows, tagging.pool_candidates(rows, domain_rules(spark), POOL_EXTRA)


@query("""SELECT domain, c.chunk_id, CAST(score AS BIGINT) AS score, md5(CASE WHEN length(text) > 1500 THEN substring(text, 1, 1500) || ' ...[truncated]' ELSE text END) AS text_md5
FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY score DESC, chunk_id) AS nth FROM v_candidates) c JOIN v_by_id i ON c.chunk_id = i.chunk_id WHERE c.nth <= 80""")
def sample_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, found = candidates(spark, sf_dir)
    return tagging.sample_pool(found, rows).select("domain", "chunk_id", F.col("score").cast("long").alias("score"), F.md5("text").alias("text_md5"))


@query("SELECT domain, count(*) AS n_candidates, least(count(*), 80) AS n_pool FROM v_candidates GROUP BY domain")
def pool_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagging.pool_summary(candidates(spark, sf_dir)[1])


WORDS = [("insult", "idiot"), ("insult", "stupid"), ("licence", "rights reserved"), ("rare", "zzzz")]
SQL_WORDS = "(VALUES ('insult', 'idiot'), ('insult', 'stupid'), ('licence', 'rights reserved'), ('rare', 'zzzz')) AS w(tag, word)"


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), "text")
    return tagging.keyword_tags(rows, spark.createDataFrame(WORDS, "tag string, word string"))


@query(f"SELECT DISTINCT doc_id AS chunk_id, tag FROM documents JOIN {SQL_WORDS} ON contains(text, word)")
def keyword_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags(spark, sf_dir)


SQL_HITS = "count(DISTINCT CASE WHEN t.doc_id IS NOT NULL THEN f.doc_id END)"


@query(f"""SELECT g.tag, {SQL_HITS} AS hits, count(f.doc_id) AS n_found, any_value(n.n) AS n_true, round({SQL_HITS} / greatest(count(f.doc_id), 1), 6) AS precision, round({SQL_HITS} / greatest(any_value(n.n), 1), 6) AS recall
FROM (SELECT DISTINCT tag FROM {SQL_WORDS} WHERE tag <> 'rare') g LEFT JOIN (SELECT DISTINCT doc_id, tag FROM documents JOIN {SQL_WORDS} ON contains(text, word)) f ON f.tag = g.tag
LEFT JOIN (SELECT DISTINCT doc_id, CASE WHEN toxic = 1 THEN 'insult' END AS tag FROM labels WHERE toxic = 1 UNION SELECT DISTINCT doc_id, 'licence' FROM labels WHERE quality = 0) t ON t.doc_id = f.doc_id AND t.tag = f.tag
LEFT JOIN (SELECT 'insult' AS tag, count(DISTINCT doc_id) AS n FROM labels WHERE toxic = 1 UNION ALL SELECT 'licence', count(DISTINCT doc_id) FROM labels WHERE quality = 0) n ON n.tag = g.tag GROUP BY g.tag""")
def tag_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    truth = labels.where("toxic = 1").select(F.col("doc_id").alias("chunk_id"), F.lit("insult").alias("tag")).unionByName(labels.where("quality = 0").select(F.col("doc_id").alias("chunk_id"), F.lit("licence").alias("tag")))
    found = tagging.tag_quality(tags(spark, sf_dir), truth)
    return found.select("tag", "hits", "n_found", "n_true", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("SELECT seq FROM v_chunks WHERE CAST(posted_at AS DATE) >= DATE '2023-06-01' OR contains(source_title, 'page 7')")
def recent_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagging.recent(chunks(spark, sf_dir), "2025-06-01", 2, "page 7").select("seq")


@query("SELECT seq, CAST(posted_at AS DATE) + CASE freshness WHEN 'static' THEN 365 ELSE 30 END AS due FROM v_chunks WHERE CAST(posted_at AS DATE) + CASE freshness WHEN 'static' THEN 365 WHEN 'dated' THEN 30 END <= DATE '2024-01-01'")
def stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir).withColumn("crawled_at", F.col("posted_at"))
    return tagging.stale(rows, {"static": 365, "dated": 30}, "2024-01-01").select("seq", "due")


VIEWS["v_fresh"] = f"""
SELECT seq, n, i, CASE WHEN n > 1 THEN substring(sha1(chunk_id || '|p' || CASE WHEN i < 10 THEN '0' ELSE '' END || CAST(i AS STRING)), 1, 16) ELSE chunk_id END AS chunk_id, piece AS text, source_url, lang,
  CASE WHEN n > 1 THEN chunk_id END AS parent_post_id, CASE WHEN n > 1 THEN 'split_from=' || chunk_id || '|added' ELSE 'added' END AS notes, source_title || chr(10) || piece AS passage
FROM (SELECT *, len(w) AS n, unnest(range(len(w))) AS i, unnest(w) AS piece FROM (SELECT *, {SQL_WINDOWS('text')} AS w FROM v_chunks WHERE source_type = 'T2' AND NOT contains(source_url, 'id=42&')))"""
VIEWS["v_upserted"] = """
SELECT seq, chunk_id, text, source_url, lang, parent_post_id, CAST(NULL AS STRING) AS notes, CAST(NULL AS STRING) AS passage FROM v_chunks WHERE source_type <> 'T2' AND source_url NOT IN (SELECT source_url FROM v_fresh)
UNION ALL SELECT seq, chunk_id, text, source_url, lang, parent_post_id, notes, passage FROM v_fresh"""


def upserted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Records before, and after those of one type came in as new ones."""
    rows = chunks(spark, sf_dir)
    old = rows.where("source_type <> 'T2'").withColumn("notes", F.lit(None).cast("string"))
    return old, dedup.upsert(old, dedup.prepare_new(rows.where("source_type = 'T2'"), noise="id=42&"))


@query("SELECT seq, chunk_id, md5(text) AS text_md5, source_url, parent_post_id, notes, md5(passage) AS passage_md5 FROM v_upserted")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = upserted(spark, sf_dir)[1]
    return done.select("seq", "chunk_id", F.md5("text").alias("text_md5"), "source_url", "parent_post_id", "notes", F.md5("_passage").alias("passage_md5"))


@query("SELECT seq, chunk_id, md5(text) AS text_md5, source_url, parent_post_id, notes, md5(passage) AS passage_md5 FROM v_upserted")
def upsert_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """upsert() of a written table, of which only the parts that hold a new address are written again."""
    rows = chunks(spark, sf_dir)
    new = dedup.prepare_new(rows.where("source_type = 'T2'"), noise="id=42&")
    old = rows.where("source_type <> 'T2'").withColumns({c: F.lit(None).cast(new.schema[c].dataType) for c in new.columns if c not in rows.columns})
    path = f"{shared_folder(spark)}/records-{uuid.uuid4().hex}"
    files.write_by_address(old, path)
    files.upsert_by_address(spark, path, new)
    done = files.read_by_address(spark, path)
    return done.select("seq", "chunk_id", F.md5("text").alias("text_md5"), "source_url", "parent_post_id", "notes", F.md5("_passage").alias("passage_md5"))


SQL_HOST = "regexp_extract(source_url, '^[a-z]+://([^/?#]+)', 1)"


@query(f"""SELECT facet, value, CAST(sum(b) AS BIGINT) AS n_before, CAST(sum(a) AS BIGINT) AS n_after FROM (
  SELECT 'lang' AS facet, lang AS value, 1 AS b, 0 AS a FROM v_chunks WHERE source_type <> 'T2' UNION ALL SELECT 'lang', lang, 0, 1 FROM v_upserted
  UNION ALL SELECT 'host', {SQL_HOST}, 1, 0 FROM v_chunks WHERE source_type <> 'T2' UNION ALL SELECT 'host', {SQL_HOST}, 0, 1 FROM v_upserted) GROUP BY facet, value""")
def upsert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = (df.withColumn("host", tagging.url_host(F.col("source_url"))) for df in upserted(spark, sf_dir))
    return dedup.upsert_counts(before, after, "lang", "host")


VIEWS["v_questions"] = "SELECT 'q' || CAST(item_id AS STRING) AS qa_id, text AS question FROM benchmark"
ALIASES = [(1, "the", "definite article"), (2, "and", "conjunction"), (3, "th", "definite article"), (4, "_x", "comment"), (5, "of", "of")]
SQL_ALIASES = "(VALUES (1, 'the', 'definite article'), (2, 'and', 'conjunction'), (3, 'th', 'definite article'), (5, 'of', 'of')) AS a(ord, alias, form)"


def alias_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ALIASES, "ord int, alias string, full string")


@query(f"""SELECT q.qa_id, question || coalesce(' ' || forms, '') AS expanded FROM v_questions q LEFT JOIN (SELECT qa_id, string_agg(form, ' ' ORDER BY ord) AS forms FROM
  (SELECT qa_id, form, min(ord) AS ord FROM v_questions JOIN {SQL_ALIASES} ON contains(question, alias) AND NOT contains(question, form) GROUP BY qa_id, form) GROUP BY qa_id) f ON q.qa_id = f.qa_id""")
def expand_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagging.expand_queries(view(spark, sf_dir, "v_questions"), alias_table(spark))


@query(f"""SELECT q.qa_id, question || coalesce(' ' || forms, '') AS expanded FROM v_questions q LEFT JOIN (SELECT qa_id, string_agg(form, ' ' ORDER BY ord) AS forms FROM
  v_questions JOIN {SQL_ALIASES} ON contains(question, alias) GROUP BY qa_id) f ON q.qa_id = f.qa_id""")
def expand_query_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagging.expand_queries(view(spark, sf_dir, "v_questions"), alias_table(spark), guarded=False)


@query("""SELECT qa_id, CASE WHEN contains(question, 'thing') THEN 'first' WHEN contains(question, 'and') AND NOT contains(question, 'tion') THEN 'second' END AS tool FROM v_questions""")
def route_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    tools = spark.createDataFrame([("first", 1, ["thing"], []), ("second", 2, ["and"], ["tion"])], "tool string, priority int, include array<string>, exclude array<string>")
    return tagging.route_queries(view(spark, sf_dir, "v_questions"), tools)
