"""Corpus files: JSON lines in, stage and group folders out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.dedup import upsert, upsert_counts
from millrace.schemas import CHUNK, CHUNK_FIELDS
from millrace.sources.tables import staged

# fixed values
LEFT_OUT = ("faq_seeds.jsonl", "dept_grad_candidates.jsonl")
BYPASS = "cross_tag.jsonl"


def read_chunks(spark: SparkSession, paths: str | Sequence[str], strict: bool = True) -> DataFrame:
    """Records of JSON lines files with source_file, the name of each one's file; blank lines are passed over.

    A broken line fails the job if strict, else it is left out. Files are found by pattern in all folders below.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl")
    if strict:
        rows = reader.schema(CHUNK).option("mode", "FAILFAST").json(paths)
    else:
        rows = reader.schema(f"{CHUNK}, _broken string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(paths)
        rows = rows.where("_broken is null").drop("_broken")
    return rows.withColumn("source_file", F.regexp_extract("_metadata.file_path", r"([^/]+)$", 1))


def select_inputs(rows: DataFrame, left_out: Sequence[str] = LEFT_OUT, bypass: str = BYPASS) -> tuple[DataFrame, DataFrame]:
    """Records to clean and de-duplicate, and those of the file that is only cleaned."""
    kept = rows.where(~F.col("source_file").isin(*left_out))
    return kept.where(F.col("source_file") != bypass), kept.where(F.col("source_file") == bypass)


def retrieval_group(source_file: Column, groups: dict[str, str]) -> Column:
    """The group of the first mark that the file's name holds, else general."""
    group = None
    for mark, name in groups.items():
        test = source_file.contains(mark)
        group = F.when(test, name) if group is None else group.when(test, name)
    return group.otherwise("general") if group is not None else F.lit("general")


def write_stage(rows: DataFrame, path: str) -> None:
    """One folder a source file, its records in the order of parent, index and id."""
    order = [F.coalesce("parent_post_id", F.lit("")), F.coalesce("chunk_index", F.lit(0)), F.col("chunk_id")]
    rows.repartition(F.col("source_file")).sortWithinPartitions("source_file", *order).write.partitionBy("source_file").mode("overwrite").parquet(path)


def write_groups(rows: DataFrame, path: str) -> None:
    """One folder a retrieval group; their parent folder is the combined corpus."""
    rows.write.partitionBy("_retrieval_group").mode("overwrite").parquet(path)


def _parted(rows: DataFrame, parts: int) -> DataFrame:
    """rows with url_part; adaptive execution splits a part that one address makes large, and joins small ones."""
    return rows.withColumn("url_part", F.pmod(F.xxhash64("source_url"), F.lit(parts)).cast("int")).hint("rebalance", "url_part")


def write_by_address(rows: DataFrame, path: str, parts: int = 256) -> None:
    """A table laid out by a hash of source_url, one folder a part, for upsert_by_address() with the same `parts`."""
    _parted(rows, parts).write.partitionBy("url_part").mode("overwrite").parquet(path)


def read_by_address(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("url_part")


def upsert_by_address(spark: SparkSession, path: str, new: DataFrame, *facets: str, parts: int = 256) -> DataFrame:
    """dedup.upsert() of a table of write_by_address(): only parts that hold a new address are read and written, other files stay.

    Returns upsert_counts() by the facets, of the parts written alone: rows elsewhere do not change. The new parts are written beside the table first, and
    replace the old ones when that is done. Rows without an address are never replaced. No new rows change nothing; columns that new rows lack are null
    there, and columns that the table lacks are an error.
    """
    table = spark.read.parquet(path)
    absent = [c for c in new.columns if c not in table.columns]
    if absent:
        raise ValueError("the table lacks: " + ", ".join(absent))
    new = staged(new.withColumn("url_part", F.pmod(F.xxhash64("source_url"), F.lit(parts)).cast("int")))
    touched = [r.url_part for r in new.select("url_part").distinct().collect()]  # at most `parts` numbers
    before = table.where(F.col("url_part").isin(touched))
    after = staged(upsert(before, new).select(*table.columns))
    counts = staged(upsert_counts(before, after, *facets)) if facets else None
    if touched:
        after.hint("rebalance", "url_part").write.partitionBy("url_part").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    return counts


def write_chunks(rows: DataFrame, path: str) -> None:
    rows.select(*[c for c in CHUNK_FIELDS if c in rows.columns]).write.mode("overwrite").json(path)


def require_fields(rows: DataFrame, fields: Sequence[str] = CHUNK_FIELDS) -> DataFrame:
    """The rows, if they have all fields; else an error that names the absent ones."""
    absent = [f for f in fields if f not in rows.columns]
    if absent:
        raise ValueError("absent fields: " + ", ".join(absent))
    return rows


def write_grid_csv(grid: DataFrame, path: str, columns: int) -> None:
    """A grid(report_id, page, row, col, text) as CSV with columns c0, c1, ..., one folder a report."""
    cells = F.map_from_entries(F.collect_list(F.struct("col", "text")))
    rows = grid.groupBy("report_id", "page", "row").agg(cells.alias("m"))
    wide = rows.select("report_id", "page", "row", *[F.coalesce(F.try_element_at("m", F.lit(k).cast(grid.schema["col"].dataType)), F.lit("")).alias(f"c{k}") for k in range(columns)])
    wide.sortWithinPartitions("report_id", "page", "row").write.partitionBy("report_id").mode("overwrite").option("header", "true").csv(path)
