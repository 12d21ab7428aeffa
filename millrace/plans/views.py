"""Input views over the given tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {}

# documents as records: noise of every kind put in by rule, repeated ids, addresses with fragments and empty keys
VIEWS["v_chunks"] = """
SELECT doc_id AS seq, substring(sha1(lang || '|' || CAST(doc_id - doc_id % 3 AS STRING)), 1, 16) AS chunk_id,
  CASE WHEN doc_id % 5 = 0 THEN replace(text, '. ', '. <표> ')
       WHEN doc_id % 5 = 1 THEN replace(text, ', ', ',' || chr(160) || '  ')
       WHEN doc_id % 5 = 2 THEN replace(text, '. ', '.' || chr(10) || ' - 3 - ' || chr(10))
       WHEN doc_id % 5 = 3 THEN replace(text, '. ', '.' || chr(10) || chr(10) || chr(10) || chr(10))
       ELSE text END AS text,
  CASE WHEN doc_id % 4 = 0 THEN 'T1' WHEN doc_id % 4 = 1 THEN 'T2' WHEN doc_id % 4 = 2 THEN 'T6' ELSE 'T9' END AS source_type,
  'https://' || source || '.example.org/' || lang || '/page?id=' || CAST(doc_id % 97 AS STRING) || '&GotoPage=' || CAST(doc_id % 7 AS STRING) || '&q=#top' AS source_url,
  '  ' || lang || ' page ' || CAST(doc_id % 13 AS STRING) || CASE WHEN doc_id % 3 = 0 THEN ' > Home > home' ELSE '  of   text' END AS source_title,
  CAST(1 + doc_id % 9 AS INT) AS d1, CASE WHEN doc_id % 7 = 0 THEN 9 ELSE CAST(1 + doc_id % 9 AS INT) END AS d2,
  CAST(1 + doc_id % 9 AS STRING) || '.' || CAST(doc_id % 6 AS STRING) AS category,
  CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN 'static' ELSE 'dated' END AS freshness,
  '20' || CAST(20 + doc_id % 6 AS STRING) || '-0' || CAST(1 + doc_id % 9 AS STRING) || '-1' || CAST(doc_id % 9 AS STRING) AS posted_at,
  CASE WHEN doc_id % 4 = 3 THEN NULL ELSE 'post' || CAST(doc_id % 50 AS STRING) END AS parent_post_id,
  CASE WHEN doc_id % 4 = 0 THEN 'body' WHEN doc_id % 4 = 1 THEN '제 ' || CAST(doc_id % 30 AS STRING) || '조 (x)'
       ELSE source || ' > part' || CAST(doc_id % 5 AS STRING) || ' > ' || lang END AS section_path,
  'day' || CAST(doc_id % 3 AS STRING) || '.jsonl' AS source_file, lang, CAST(length(text) AS INT) AS char_count
FROM documents"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; the tables and views that it names are read under the given folder."""
    text = VIEWS[name]
    for other in [*VIEWS, *TABLES]:
        if f" {other}" in text and other != name:
            (view if other in VIEWS else table)(spark, sf_dir, other).createOrReplaceTempView(other)
    return spark.sql(text)


TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations", "orders", "customer", "nation", "region", "lineitem", "part", "supplier")


def with_views(sql: str) -> str:
    """The SQL with the views that it names, and those that they name, before it."""
    used: list[str] = []

    def need(text: str) -> None:
        for name in VIEWS:
            if name in text and name not in used:
                need(VIEWS[name])
                if name not in used:
                    used.append(name)

    need(sql)
    if not used:
        return sql
    recursive = "RECURSIVE " if "RECURSIVE" in sql else ""
    return "WITH " + recursive + ", ".join(f"{n} AS ({VIEWS[n]})" for n in used) + (", " + sql.split("WITH ", 1)[1].replace("RECURSIVE ", "", 1) if sql.lstrip().startswith("WITH ") else " " + sql)
