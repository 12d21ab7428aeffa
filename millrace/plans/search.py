"""Queries of retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import retrieval as R
from millrace.plans.registry import query
from millrace.plans.views import VIEWS, table, view
from millrace.sources.tables import exists, kept, kept_path, remove, staged

VIEWS["v_corpus"] = """
SELECT 't' || CAST(doc_id % 2 AS STRING) AS track, 'c' || CAST(doc_id AS STRING) AS chunk_id, text, lang || ' ' || source AS title,
  CASE WHEN doc_id % 11 = 5 THEN 'http://go.example.net/?to=' ELSE '' END || 'https://' || source || '.example.org/' || CAST(doc_id % 200 AS STRING) || CASE WHEN doc_id % 13 = 4 THEN '// ' ELSE '/' END AS source_url, CAST(1 + doc_id % 9 AS INT) AS domain
FROM documents"""
VIEWS["v_qa"] = """
SELECT 'q' || CAST(item_id AS STRING) AS qa_id, text AS question, CAST(1 + item_id % 9 AS INT) AS domain,
  CASE WHEN item_id % 4 = 0 THEN 'A' WHEN item_id % 4 = 1 THEN 'B' WHEN item_id % 4 = 2 THEN 'C' ELSE 'D' END AS question_type, item_id
FROM benchmark"""
VIEWS["v_expected"] = "SELECT DISTINCT q.qa_id, c.source_url AS url FROM v_qa q JOIN v_corpus c ON contains(c.text, q.question)"
VIEWS["v_vectors"] = "SELECT 't' || CAST(vec_id % 2 AS STRING) AS track, 'c' || CAST(vec_id AS STRING) AS chunk_id, embedding AS emb, vec_id FROM embeddings"


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_corpus")


def expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qa_id, url): addresses of the documents that hold a question."""
    found = lambda: R.holders(corpus(spark, sf_dir), view(spark, sf_dir, "v_qa")).select("qa_id", F.col("source_url").alias("url")).distinct()
    return kept(spark, "expected", sf_dir, found)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_qa with its expected addresses; a question whose passage no document has expects a fallback."""
    urls = expected(spark, sf_dir).groupBy("qa_id").agg(F.array_sort(F.collect_list("url")).alias("urls"))
    rows = view(spark, sf_dir, "v_qa").join(urls, "qa_id", "left")
    return rows.select("qa_id", "question", "domain", "question_type", "item_id", F.coalesce("urls", F.array().cast("array<string>")).alias("expected_source_urls"), F.col("urls").isNull().alias("is_fallback_expected"))


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector for every question."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), R.l2_normalized(F.col("embedding")).alias("emb"))
    return view(spark, sf_dir, "v_qa").join(vectors, "item_id").select("qa_id", "emb")


SQL_TOKENS = lambda x: f"list_filter(regexp_extract_all(lower({x}), '\\p{{L}}+|[0-9]+'), lambda t: NOT regexp_matches(t, '^[0-9]$'))"


@query(f"SELECT chunk_id, CAST(len(t) AS BIGINT) AS n, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT chunk_id, {SQL_TOKENS('text')} AS t FROM v_corpus)")
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.regex_tokens(F.col("text"))
    return corpus(spark, sf_dir).select("chunk_id", F.size(found).cast("long").alias("n"), F.md5(F.array_join(found, " ")).alias("tokens_md5"))


@query(f"""SELECT track, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens, round(avg(n), 6) AS mean_tokens, CAST(min(n) AS BIGINT) AS min_tokens, CAST(max(n) AS BIGINT) AS max_tokens
FROM (SELECT track, len({SQL_TOKENS('text')}) AS n FROM v_corpus) GROUP BY track""")
def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.token_stats(corpus(spark, sf_dir))
    return found.select("track", "n_docs", "n_tokens", F.round("mean_tokens", 6).alias("mean_tokens"), F.col("min_tokens").cast("long").alias("min_tokens"), F.col("max_tokens").cast("long").alias("max_tokens"))


VIEWS["v_postings"] = f"SELECT track, chunk_id, term, count(*) AS tf FROM (SELECT track, chunk_id, unnest({SQL_TOKENS('text')}) AS term FROM v_corpus) GROUP BY track, chunk_id, term"
VIEWS["v_lengths"] = f"SELECT track, chunk_id, len({SQL_TOKENS('text')}) AS dl FROM v_corpus"
VIEWS["v_terms"] = """
SELECT track, term, df, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER (PARTITION BY track) ELSE raw END AS idf FROM (
  SELECT p.track, term, count(*) AS df, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM v_postings p JOIN (SELECT track, count(*) AS n FROM v_lengths GROUP BY track) l ON p.track = l.track GROUP BY p.track, term, n)"""
VIEWS["v_bm25"] = f"""
SELECT qa_id, chunk_id, max(score) AS score, arg_max(track, score) AS track FROM (
  SELECT q.qa_id, p.track, p.chunk_id, sum(t.idf * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * l.dl / a.avgdl)) * q.times) AS score
  FROM (SELECT qa_id, term, count(*) AS times FROM (SELECT qa_id, unnest({SQL_TOKENS('question')}) AS term FROM v_qa) GROUP BY qa_id, term) q
  JOIN v_postings p ON p.term = q.term JOIN v_terms t ON t.track = p.track AND t.term = p.term JOIN v_lengths l ON l.track = p.track AND l.chunk_id = p.chunk_id
  JOIN (SELECT track, avg(dl) AS avgdl FROM v_lengths GROUP BY track) a ON a.track = p.track GROUP BY q.qa_id, p.track, p.chunk_id HAVING sum(t.idf * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * l.dl / a.avgdl)) * q.times) > 0) GROUP BY qa_id, chunk_id"""
VIEWS["v_bm25_pool"] = "SELECT * FROM (SELECT qa_id, chunk_id, score, row_number() OVER (PARTITION BY qa_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM v_bm25) WHERE rank <= 100"
VIEWS["v_unit"] = "SELECT track, chunk_id, vec_id, list_transform(CAST(emb AS DOUBLE[]), lambda x: x / sqrt(list_inner_product(CAST(emb AS DOUBLE[]), CAST(emb AS DOUBLE[])))) AS emb FROM v_vectors"
VIEWS["v_dense_pool"] = """
SELECT * FROM (SELECT qa_id, chunk_id, score, row_number() OVER (PARTITION BY qa_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM (
  SELECT q.qa_id, u.chunk_id, list_inner_product(e.emb, u.emb) AS score FROM v_qa q JOIN v_unit e ON e.vec_id = q.item_id JOIN v_unit u ON true)) WHERE rank <= 50"""
VIEWS["v_hits"] = """
SELECT qa_id, chunk_id, rrf_score, bm25_rank, dense_rank, row_number() OVER (PARTITION BY qa_id ORDER BY rrf_score DESC, chunk_id) AS rank FROM (
  SELECT coalesce(b.qa_id, d.qa_id) AS qa_id, coalesce(b.chunk_id, d.chunk_id) AS chunk_id, b.rank AS bm25_rank, d.rank AS dense_rank, coalesce(1.0::DOUBLE / (60 + b.rank), 0) + coalesce(1.0::DOUBLE / (60 + d.rank), 0) AS rrf_score
  FROM v_bm25_pool b FULL JOIN v_dense_pool d ON b.qa_id = d.qa_id AND b.chunk_id = d.chunk_id)"""
VIEWS["v_top"] = "SELECT * FROM v_hits WHERE rank <= 30"


def index(spark: SparkSession, sf_dir: str) -> R.Bm25Index:
    """The written index of v_corpus; the first query that needs it builds it."""
    path = kept_path(spark, "bm25", sf_dir)
    if exists(spark, f"{path}/term_stats"):  # the last table that is written
        return R.Bm25Index.open(spark, path)
    remove(spark, path)
    return R.Bm25Index.build(corpus(spark, sf_dir), path)


@query("SELECT track, term, df, round(idf, 6) AS idf FROM v_terms")
def bm25_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).term_stats.select("track", "term", "df", F.round("idf", 6).alias("idf"))


def bm25_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked pool of v_qa by block maxima."""
    return kept(spark, "bm25_pool", sf_dir, lambda: index(spark, sf_dir).top(view(spark, sf_dir, "v_qa"))[0])


@query("SELECT qa_id, chunk_id, round(score, 5) AS score, track FROM v_bm25")
def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).scores(view(spark, sf_dir, "v_qa")).withColumn("score", F.round("score", 5))


@query("SELECT qa_id, chunk_id, round(round(score, 9), 6) AS score, rank FROM v_bm25_pool")
def bm25_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool of each question, without scoring blocks that cannot hold a part of it."""
    return bm25_pool(spark, sf_dir).select("qa_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("SELECT chunk_id, round(emb[1], 9) AS first, round(emb[64], 9) AS last, round(list_sum(emb), 6) AS total FROM v_unit")
def l2norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = view(spark, sf_dir, "v_vectors").select("chunk_id", R.l2_normalized(F.col("emb")).alias("emb"))
    return v.select("chunk_id", F.round(F.get("emb", F.lit(0)), 9).alias("first"), F.round(F.get("emb", F.lit(63)), 9).alias("last"), F.round(F.aggregate("emb", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def dense_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    def found() -> DataFrame:
        vectors = view(spark, sf_dir, "v_vectors").select("track", "chunk_id", R.l2_normalized(F.col("emb")).alias("emb"))
        return R.ranked_pool(R.dense_topk(query_vectors(spark, sf_dir), vectors).withColumn("score", F.round("score", 9)), R.DENSE_POOL)

    return kept(spark, "dense_pool", sf_dir, found)


@query("SELECT qa_id, chunk_id, round(round(score, 9), 6) AS score, rank FROM v_dense_pool")
def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_pool(spark, sf_dir).select("qa_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def fused(spark: SparkSession, sf_dir: str, top_k: int = 30) -> DataFrame:
    hits = kept(spark, "fused", sf_dir, lambda: R.rrf_fuse(bm25_pool(spark, sf_dir), dense_pool(spark, sf_dir), top_k=30))
    return hits if top_k == 30 else hits.where(F.col("rank") <= top_k)


@query("SELECT qa_id, chunk_id, round(rrf_score, 9) AS rrf_score, bm25_rank, dense_rank, rank FROM v_hits WHERE rank <= 10")
def rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = fused(spark, sf_dir, R.TOP_K)
    return hits.select("qa_id", "chunk_id", F.round("rrf_score", 9).alias("rrf_score"), *[F.col(c).cast("long").alias(c) for c in ("bm25_rank", "dense_rank", "rank")])


SQL_PAIR = "round(((CAST(substring(chunk_id, 2) AS BIGINT) * 37 + CAST(substring(qa_id, 2) AS BIGINT) * 11) % 101) / 101.0, 6)"
VIEWS["v_reranked"] = f"SELECT * FROM (SELECT qa_id, chunk_id, pair AS rerank_score, row_number() OVER (PARTITION BY qa_id ORDER BY pair DESC, chunk_id) AS rank FROM (SELECT *, CAST({SQL_PAIR} AS DOUBLE) AS pair FROM v_top)) WHERE rank <= 20"


def pair_scores(hits: DataFrame) -> DataFrame:
    """Scores of questions and chunks by rule, as a model would give them."""
    pair = F.round(((F.substring("chunk_id", 2, 20).cast("long") * 37 + F.substring("qa_id", 2, 20).cast("long") * 11) % 101) / 101.0, 6)
    return hits.select("qa_id", "chunk_id", pair.alias("rerank_score"))


def reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fused pool in the order of given pair scores."""
    hits = fused(spark, sf_dir)
    return kept(spark, "reranked", sf_dir, lambda: R.rerank(hits, pair_scores(hits), 20))


@query("SELECT qa_id, chunk_id, rerank_score, rank FROM v_reranked")
def rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reranked(spark, sf_dir).select("qa_id", "chunk_id", "rerank_score", F.col("rank").cast("long").alias("rank"))


VIEWS["v_fallback"] = """
SELECT q.qa_id, h.top AS top_rerank_score, coalesce(h.top < 0.99, true) AS used_fallback FROM v_qa q LEFT JOIN (SELECT qa_id, max(rerank_score) AS top FROM v_reranked GROUP BY qa_id) h ON q.qa_id = h.qa_id"""


@query("SELECT * FROM v_fallback")
def fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fallback(view(spark, sf_dir, "v_qa"), reranked(spark, sf_dir), 0.99)


@query("""SELECT r.qa_id, count(*) AS n_sources, md5(coalesce(string_agg(CASE WHEN trim(c.text) <> '' THEN '[' || CAST(rank AS STRING) || '] ' || title || ': ' || c.text END, chr(10) || chr(10) ORDER BY rank), '')) AS context_md5
FROM v_reranked r JOIN v_corpus c ON r.chunk_id = c.chunk_id WHERE rank <= 8 GROUP BY r.qa_id""")
def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.context(reranked(spark, sf_dir), corpus(spark, sf_dir)).select("qa_id", "n_sources", F.md5("context").alias("context_md5"))


VIEWS["v_gold"] = """
SELECT DISTINCT e.qa_id, c.chunk_id FROM (SELECT chunk_id, regexp_replace(trim(source_url), '/$', '') AS u FROM v_corpus) c JOIN (SELECT qa_id, regexp_replace(trim(url), '/$', '') AS e FROM v_expected) e ON contains(u, e) OR contains(e, u)"""


@query("SELECT * FROM v_gold")
def gold_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, "gold", sf_dir, lambda: R.gold_chunks(corpus(spark, sf_dir), expected(spark, sf_dir)))


@query("""SELECT s.qa_id, stage, count(*) AS n_scored, count(g.chunk_id) AS n_gold, min(CASE WHEN g.chunk_id IS NOT NULL THEN rank END) AS best_rank, string_agg(CASE WHEN rank <= 5 THEN s.chunk_id END, ',' ORDER BY rank) AS top, CAST(NULL AS STRING) AS error FROM (
  SELECT 'bm25' AS stage, qa_id, chunk_id, rank FROM v_bm25_pool UNION ALL SELECT 'dense', qa_id, chunk_id, rank FROM v_dense_pool
  UNION ALL SELECT 'rrf', qa_id, chunk_id, rank FROM v_top UNION ALL SELECT 'rerank', qa_id, chunk_id, rank FROM v_reranked) s
LEFT JOIN v_gold g ON s.qa_id = g.qa_id AND s.chunk_id = g.chunk_id WHERE s.qa_id IN (SELECT qa_id FROM v_gold) GROUP BY s.qa_id, stage
UNION ALL SELECT qa_id, NULL, NULL, NULL, NULL, NULL, 'no gold' FROM v_qa WHERE qa_id NOT IN (SELECT qa_id FROM v_gold)""")
def stage_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {"bm25": bm25_pool(spark, sf_dir), "dense": dense_pool(spark, sf_dir), "rrf": fused(spark, sf_dir), "rerank": reranked(spark, sf_dir)}
    stages = None
    for name, rows in parts.items():
        part = rows.select("qa_id", F.lit(name).alias("stage"), "chunk_id", F.col("rank").cast("long").alias("rank"))
        stages = part if stages is None else stages.unionByName(part)
    addresses = kept(spark, "gold_addresses", sf_dir, lambda: R.gold_addresses(corpus(spark, sf_dir), expected(spark, sf_dir)))
    gold = R.gold_hits(stages, corpus(spark, sf_dir), addresses)
    ranks = R.stage_ranks(stages, gold, view(spark, sf_dir, "v_qa"), answered=addresses)
    return ranks.withColumn("top", F.array_join("top", ","))


@query("SELECT q.qa_id, coalesce(bool_or(q.domain = c.domain), false) AS answerable FROM v_qa q LEFT JOIN v_top t ON q.qa_id = t.qa_id LEFT JOIN v_corpus c ON t.chunk_id = c.chunk_id GROUP BY q.qa_id")
def domain_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus(spark, sf_dir).select("chunk_id", F.array("domain").alias("domains"))
    return R.domain_gate(view(spark, sf_dir, "v_qa"), fused(spark, sf_dir), rows)


# a question as it is, and with words added; the second asks with the vector of the next item
VIEWS["v_variants"] = """
SELECT qa_id || '/original' AS variant_id, qa_id, question AS text, item_id AS vec FROM v_qa
UNION ALL SELECT qa_id || '/more', qa_id, question || ' of the and more', item_id + 1 FROM v_qa"""
VIEWS["v_vbm25"] = VIEWS["v_bm25"].replace("q.qa_id", "q.variant_id").replace("SELECT qa_id, chunk_id, max(score)", "SELECT variant_id, chunk_id, max(score)").replace(
    f"(SELECT qa_id, term, count(*) AS times FROM (SELECT qa_id, unnest({SQL_TOKENS('question')}) AS term FROM v_qa) GROUP BY qa_id, term) q", f"(SELECT variant_id, term, count(*) AS times FROM (SELECT variant_id, unnest({SQL_TOKENS('text')}) AS term FROM v_variants) GROUP BY variant_id, term) q"
).replace("GROUP BY qa_id, chunk_id", "GROUP BY variant_id, chunk_id")


@query(f"""SELECT variant_id, qa_id, chunk_id, CAST({SQL_PAIR} AS DOUBLE) AS rerank_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY variant_id ORDER BY CAST({SQL_PAIR} AS DOUBLE) DESC, chunk_id) AS rank FROM (
  SELECT v.variant_id, v.qa_id, h.chunk_id FROM v_variants v JOIN (SELECT *, row_number() OVER (PARTITION BY variant_id ORDER BY rrf DESC, chunk_id) AS place FROM (
    SELECT coalesce(b.variant_id, d.variant_id) AS variant_id, coalesce(b.chunk_id, d.chunk_id) AS chunk_id, coalesce(1.0::DOUBLE / (60 + b.rank), 0) + coalesce(1.0::DOUBLE / (60 + d.rank), 0) AS rrf FROM
    (SELECT * FROM (SELECT variant_id, chunk_id, row_number() OVER (PARTITION BY variant_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM v_vbm25) WHERE rank <= 100) b FULL JOIN
    (SELECT * FROM (SELECT w.variant_id, u.chunk_id, row_number() OVER (PARTITION BY w.variant_id ORDER BY round(list_inner_product(e.emb, u.emb), 9) DESC, u.chunk_id) AS rank FROM v_variants w JOIN v_unit e ON e.vec_id = w.vec JOIN v_unit u ON true) WHERE rank <= 50) d
    ON b.variant_id = d.variant_id AND b.chunk_id = d.chunk_id)) h ON h.variant_id = v.variant_id WHERE h.place <= 30)) WHERE rank <= 3""")
def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hits of each of two texts of every question, reranked against the question itself."""
    rows = view(spark, sf_dir, "v_variants")
    one, _ = index(spark, sf_dir).top(rows.select(F.col("variant_id").alias("qa_id"), F.col("text").alias("question")))
    unit = view(spark, sf_dir, "v_vectors").select("vec_id", "track", "chunk_id", R.l2_normalized(F.col("emb")).alias("emb"))
    asked = rows.select(F.col("variant_id").alias("qa_id"), F.col("vec").alias("vec_id")).join(unit.select("vec_id", "emb"), "vec_id").select("qa_id", "emb")
    dense_ = R.dense_topk(asked, unit.drop("vec_id")).withColumn("score", F.round("score", 9))
    one, two = staged(one), staged(R.ranked_pool(dense_, R.DENSE_POOL))
    ids = rows.select("variant_id", "qa_id")
    pairs = pair_scores(one.select("qa_id", "chunk_id").unionByName(two.select("qa_id", "chunk_id")).distinct().withColumnRenamed("qa_id", "variant_id").join(ids, "variant_id").select("qa_id", "chunk_id").distinct())
    return R.compare_variants(one, two, ids, pairs, keep=3).withColumn("rank", F.col("rank").cast("long"))
