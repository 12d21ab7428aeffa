"""Sharding: proportional stratified interleaving with DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.staging import staged

UNIT = 1 << 40


def interleaved_shards(docs: DataFrame, shards: int = 16, seed: int = 17) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, source, shard, slot, fraction.

    Within each source rows are ranked in the order of a seeded hash; a row's fraction is (rank - 1 + offset) over the
    rows of its source, the offset being a seeded hash of the source from 0 to 1, so that small sources of one size do not
    fall together. Rows sorted by fraction are cut into `shards` runs whose row counts differ by at most one,
    so every shard holds each source in proportion, give or take one row at either end.

    Ranks are summed from counts of hash ranges: a range holds about sqrt(rows) rows and a source about sqrt(rows)
    ranges, so neither a large source nor the global order meets in one task. The hash is of doc_id and text; ties
    are ordered by doc_id and checksum, and rows equal in all of these are interchangeable.

    A null source is a source of its own; a null text has size 1 and the checksum of no bytes; a null doc_id is
    allowed. Fewer rows than shards leave some shards empty; an empty table gives no rows. Other columns are not read.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    crc = F.crc32(text.cast("binary"))
    rows = staged(
        docs.select(
            docs["doc_id"].cast("long").alias("doc_id"),
            docs["source"].alias("source"),
            F.coalesce(F.concat(F.lit("="), docs["source"]), F.lit("")).alias("stratum"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            crc.alias("text_crc32"),
            F.pmod(F.xxhash64(F.lit(seed), docs["doc_id"], crc), F.lit(UNIT)).alias("u"),
        )
    )
    n = rows.count()
    cells = 4 * math.isqrt(n) + 1
    tie = ["doc_id", "text_crc32", "size"]

    rows = rows.withColumn("cell", F.floor(F.col("u") * cells / UNIT).cast("int"))
    counts = rows.groupBy("stratum", "cell").agg(F.count("*").alias("k"))
    within = Window.partitionBy("stratum")
    starts = counts.select(
        "stratum", "cell", F.sum("k").over(within).alias("n_source"),
        (F.sum("k").over(within.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("k")).alias("before"),
    )
    rank = F.col("before") + F.row_number().over(Window.partitionBy("stratum", "cell").orderBy("u", *tie))
    offset = F.pmod(F.xxhash64(F.lit(seed), "stratum"), F.lit(UNIT)) / UNIT
    ranked = rows.join(starts, ["stratum", "cell"]).withColumn("fraction", (rank - 1 + offset) / F.col("n_source"))

    ranked = staged(ranked.withColumn("run", F.floor(F.col("fraction") * cells).cast("int")).select("doc_id", "source", "stratum", "size", "text_crc32", "u", "fraction", "run"))
    runs = ranked.groupBy("run").agg(F.count("*").alias("k"))
    # about 4 * sqrt(rows) rows stand in this one ordered window
    runs = runs.select("run", (F.sum("k").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, 0)) - F.col("k")).alias("before"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("run").orderBy("fraction", "stratum", "u", *tie)) - 1
    placed = ranked.join(runs, "run").withColumn("place", place)
    placed = placed.withColumn("shard", F.expr(f"cast(place * {shards} div {max(n, 1)} as int)"))
    first = F.expr(f"(shard * cast({n} as bigint) + {shards - 1}) div {shards}")
    return placed.select("doc_id", "size", "text_crc32", "source", "shard", (F.col("place") - first).cast("long").alias("slot"), "fraction")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = interleaved_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

