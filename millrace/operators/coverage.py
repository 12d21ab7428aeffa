"""How much of what a corpus holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import empty_if_null

# fixed values
SPARSE, THIN = 2_000, 10_000


def chars() -> Column:
    return F.length(empty_if_null(F.col("text")))


def by_tag(rows: DataFrame, tags: str) -> DataFrame:
    """Rows and characters of each tag of an array column; a row counts once in every tag that it carries."""
    spread = rows.select(chars().alias("c"), F.explode(F.array_distinct(tags)).alias("tag"))
    return spread.groupBy("tag").agg(F.count("*").alias("n_chunks"), F.sum("c").alias("n_chars"))


def by_column(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n_chunks"), F.sum(chars()).alias("n_chars"))


def top_categories(rows: DataFrame, n: int = 10) -> DataFrame:
    """The n categories with most characters."""
    return by_tag(rows, "categories").orderBy(F.desc("n_chars"), "tag").limit(n)


def length_profile(rows: DataFrame) -> DataFrame:
    """Per source_type: rows, truncated mean, upper median, least and most characters, percent (truncated) below 300, and rows with attachments in their notes.

    Lengths are counted before they are ordered, so an order holds distinct lengths only.
    """
    from pyspark.sql import Window

    counted = rows.groupBy("source_type", chars().alias("c")).agg(F.count("*").alias("k"), F.count_if(F.contains(empty_if_null(F.col("notes")), F.lit("attachments"))).alias("a"))
    up = Window.partitionBy("source_type").orderBy("c").rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumn("upto", F.sum("k").over(up)).withColumn("n", F.sum("k").over(Window.partitionBy("source_type")))
    median = F.min(F.when(F.col("upto") > F.expr("n div 2"), F.col("c")))
    return placed.groupBy("source_type").agg(
        F.sum("k").alias("n"), F.floor(F.sum(F.col("c") * F.col("k")) / F.sum("k")).alias("mean_chars"), median.cast("long").alias("median_chars"), F.min("c").cast("long").alias("min_chars"),
        F.max("c").cast("long").alias("max_chars"), F.floor(100 * F.sum(F.when(F.col("c") < 300, F.col("k")).otherwise(0)) / F.sum("k")).alias("percent_short"), F.sum("a").alias("n_attachments"),
    )


def against_questions(rows: DataFrame, matrix: DataFrame) -> DataFrame:
    """Per domain of a question matrix(domain, name, a, b, c, d): questions, chunks, characters and how thin that is."""
    have = by_tag(rows, "domains").withColumnRenamed("tag", "domain")
    n = F.coalesce("n_chars", F.lit(0))
    flag = F.when(n < SPARSE, "sparse").when(n < THIN, "thin").otherwise("ok")
    return matrix.join(have, "domain", "left").select("domain", "name", (F.col("a") + F.col("b") + F.col("c") + F.col("d")).alias("n_questions"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), n.alias("n_chars"), flag.alias("flag"))


def exit_check(rows: DataFrame, target: int, domains: int = 9, least_percent: int = 70, least_chars: int = 100_000) -> DataFrame:
    """One row: characters, percent of the target, whether both goals are reached, and the domains below SPARSE."""
    have = by_tag(rows, "domains")
    wanted = rows.sparkSession.range(1, domains + 1).select(F.col("id").cast("int").alias("tag"))
    thin = wanted.join(have, "tag", "left").where(F.coalesce("n_chars", F.lit(0)) < SPARSE).agg(F.array_join(F.array_sort(F.collect_list("tag")).cast("array<string>"), ",").alias("sparse_domains"))
    whole = rows.agg(F.coalesce(F.sum(chars()), F.lit(0)).alias("n_chars"))
    percent = F.round(100 * F.col("n_chars") / target, 1)
    return whole.join(F.broadcast(thin), F.lit(True)).select("n_chars", percent.alias("percent"), ((percent >= least_percent) & (F.col("n_chars") >= least_chars)).alias("passed"), "sparse_domains")


def enrich_stats(rows: DataFrame) -> DataFrame:
    """Per retrieval group: rows, rows with aliases, ids that repeat, and length of passages."""
    n = F.length("_passage")
    return rows.groupBy("_retrieval_group").agg(
        F.count("*").alias("n"), F.count_if(F.size("_alias_urls") > 0).alias("n_alias"), (F.count("*") - F.countDistinct("chunk_id")).alias("n_repeated"),
        F.min(n).cast("long").alias("min_passage"), F.max(n).cast("long").alias("max_passage"), F.floor(F.avg(n)).alias("mean_passage"),
    )


def group_files(rows: DataFrame) -> DataFrame:
    """(source_file, _retrieval_group, n): the group that each file's records are in."""
    return rows.groupBy("source_file", "_retrieval_group").agg(F.count("*").alias("n"))


def bracket_summary(rows: DataFrame) -> DataFrame:
    """Rows, characters and distinct addresses by the key in a title's leading brackets; UNKNOWN without one."""
    found = F.regexp_extract(empty_if_null(F.col("source_title")), r"^\s*\[([^\]]+)\]", 1)
    key = F.when(found == "", "UNKNOWN").otherwise(found)
    return rows.groupBy(key.alias("dept")).agg(F.count("*").alias("n_chunks"), F.sum(chars()).alias("n_chars"), F.countDistinct("source_url").alias("n_urls"))


def _counts(rows: DataFrame, key: Column, name: str) -> DataFrame:
    """(source_file, name): how often each key stands in a file, as text."""
    counted = rows.groupBy("source_file", key.cast("string").alias("key")).agg(F.count("*").alias("k")).where("key is not null")
    return counted.groupBy("source_file").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "key", F.col("k").cast("string")))), ",").alias(name))


def inventory(rows: DataFrame) -> DataFrame:
    """Per file: records, characters in all, truncated mean, most and least, fields that any record fills, and counts of
    types and domains as text; a record counts once in each of its domains."""
    n = chars()
    used = [F.when(F.count(c) > 0, c) for c in sorted(rows.columns) if c != "source_file"]
    totals = rows.groupBy("source_file").agg(
        F.count("*").alias("n"), F.sum(n).alias("n_chars"), F.floor(F.avg(n)).alias("mean_chars"), F.max(n).cast("long").alias("max_chars"), F.min(n).cast("long").alias("min_chars"), F.concat_ws(",", *used).alias("fields")
    )
    domains = _counts(rows.select("source_file", F.explode(F.array_distinct("domains")).alias("d")), F.col("d"), "domains")
    return totals.join(_counts(rows, F.col("source_type"), "types"), "source_file", "left").join(domains, "source_file", "left")


def validate_chunks(rows: DataFrame) -> DataFrame:
    """(seq, errors): unknown types or freshness, domains missing or outside 1 to 9, blank texts."""
    wrong = lambda test, name: F.when(F.coalesce(test, F.lit(True)), name)
    errors = F.array_compact(F.array(
        wrong(~F.col("source_type").isin("T1", "T2", "T3", "T4", "T5", "T6"), "source_type"),
        F.when(F.col("freshness").isNotNull() & ~F.col("freshness").isin("static", "dated", "rolling"), "freshness"),
        wrong((F.size("domains") == 0) | ~F.forall("domains", lambda x: x.between(1, 9)), "domains"), wrong(F.trim("text") == "", "text"),
    ))
    return rows.select("seq", errors.alias("errors"))
