"""Nearest neighbours by inner product: shifted Hilbert orderings, windows of keys, and an exact completion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.staging import staged

BITS = 7
DIMS = 8


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places of integer cells (rows of coordinates below 2**bits) on the Hilbert curve through all cells.

    By the public transpose method: undo the excess rotations from the highest bit down, then Gray encode and
    interleave the coordinates' bits.
    """
    x = cells.T.astype(np.int64).copy()
    n = len(x)
    for bit in range(bits - 1, 0, -1):
        q, low = 1 << bit, (1 << bit) - 1
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & low
            x[0] ^= np.where(flip, low, swap)
            if i:
                x[i] ^= np.where(flip, 0, swap)
    for i in range(1, n):
        x[i] ^= x[i - 1]
    last = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        last ^= np.where(x[n - 1] & (1 << bit), (1 << bit) - 1, 0)
    x ^= last
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def _matrix(column: pa.Array, kind=np.float64) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1), kind)


def usable(vector: Column) -> Column:
    """Whether a vector has components, all of them finite numbers and one of them not zero."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def _gather(keep: int):
    """Equal vectors of a batch as one row with the least ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, m = batch.column(0).to_numpy(), _matrix(batch.column(1), np.float64) + 0.0
            _, first, back = np.unique(m.view(np.dtype((np.void, m.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
            order = np.lexsort((ids, back))
            cut = np.searchsorted(back[order], np.arange(len(first) + 1))
            lists = [ids[order[a : min(b, a + keep)]] for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.int64())), batch.column(1).take(pa.array(first))], ["ids", "v"])

    return run


def _order(curves: int, dim: int, top: float, seed: int):
    """Keys of vectors on several shifted curves. Vectors get one more component, so that all are as long as the
    longest and nearness by inner product is nearness by distance."""
    rng = np.random.default_rng(seed)
    turn = [np.linalg.qr(rng.standard_normal((dim + 1, dim + 1)))[0][:, : min(DIMS, dim + 1)] for _ in range(curves)]
    shift = rng.uniform(-0.25, 0.25, (curves, min(DIMS, dim + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m = _matrix(batch.column(1)) / top
            m = np.hstack([m, np.sqrt(np.maximum(1 - (m * m).sum(axis=1), 0))[:, None]])
            for c in range(curves):
                spread = 2.5 / np.sqrt(dim + 1)  # a unit vector's component on a random axis is about 1 / sqrt(dim)
                at = (m @ turn[c] / spread + shift[c] + 1.5) / 3
                key = hilbert_keys(np.clip(at * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), c, np.int32)), pa.array(key), batch.column(0), batch.column(2)], ["curve", "key", "rep", "asked"])

    return run


def _best(score: np.ndarray, keep: int, rep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the `keep` largest of each row; of equal scores those with the smaller rep."""
    n, m = score.shape
    if m <= keep:
        at = np.broadcast_to(np.arange(m), (n, m))
        return np.repeat(np.arange(n), m), at.ravel()
    at = np.argpartition(-score, keep - 1, axis=1)[:, :keep]
    cut = np.take_along_axis(score, at, axis=1).min(axis=1)
    for row in np.flatnonzero((score >= cut[:, None]).sum(axis=1) > keep):
        col = np.flatnonzero(score[row] >= cut[row])
        at[row] = col[np.lexsort((rep[col], -score[row, col]))[:keep]]
    return np.repeat(np.arange(n), keep), at.ravel()


FOUND = pa.schema([("asked", pa.int64()), ("rep", pa.int64()), ("score", pa.float64())])


def _search(keep: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return FOUND.empty_table()
        q, v = _matrix(left.column("q").combine_chunks()), _matrix(right.column("v").combine_chunks())
        score = q @ v.T
        asked, rep = left.column("asked").to_numpy(), right.column("rep").to_numpy()
        row, col = _best(score, keep, rep)
        return pa.table([asked[row], rep[col], score[row, col]], schema=FOUND)

    return run


def _complete(keep: int):
    """Scores of packed queries against a packed block, for queries that its centre and radius do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                asked, floor, q, rep, v = (batch.column(c).slice(k, 1).flatten().to_numpy(zero_copy_only=False) for c in range(5))
                q, v = q.reshape(len(asked), -1), v.reshape(len(rep), -1)
                centre = v.mean(axis=0)
                radius = np.sqrt(((v - centre) ** 2).sum(axis=1).max())
                open_ = q @ centre + np.sqrt((q * q).sum(axis=1)) * radius >= floor - 1e-9
                if not open_.any():
                    continue
                score = q[open_] @ v.T
                row, col = _best(score, keep, rep)
                good = score[row, col] >= floor[open_][row] - 1e-9
                row, col = row[good], col[good]
                yield pa.RecordBatch.from_arrays([pa.array(asked[open_][row]), pa.array(rep[col]), pa.array(score[row, col])], schema=FOUND)

    return run


def _nearest(found: DataFrame, keep: int) -> DataFrame:
    order = Window.partitionBy("asked").orderBy(F.desc("score"), "rep")
    return found.dropDuplicates(["asked", "rep"]).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= keep)


def nearest(
    vectors: DataFrame, asked: Column, k: int = 20, curves: int = 4, window: int = 256, exact: bool = True, pack: int = 1024, block: int = 4096, seed: int = 5
) -> DataFrame:
    """The k nearest vectors of each query: query_id, rank, vec_id, score; nearest first, ties to the smaller vec_id.

    vectors has vec_id and embedding; `asked` is a condition on its rows that names the queries. Nearness is the
    inner product of the original vectors, summed in double precision. Equal vectors are one point with its k + 1
    least ids, so that copies do not crowd a window.

    Every point has a key on each of `curves` Hilbert curves, each through another random projection to 8 axes with another
    shift. Keys are range-partitioned and sorted; runs of `window` successive points are blocks; a query is scored
    against its own block and those on either side, on each curve, and the results merge. That alone is
    approximate. With exact = true, blocks of about `block` points successive on the first curve are scored too,
    unless their centre and radius rule out any score above the query's k-th best so far; the result is then
    exact, whatever the vectors.

    Vectors that are null, empty or zero, or hold null or non-finite components take no part, nor do null ids. Vectors
    of several lengths meet as if the shorter ones ended in zeros. Rows that repeat an id and a vector count once; an id with
    several vectors can be returned for each. Columns other than vec_id and embedding are not read, unless
    `asked` names them. Fewer candidates than k give them all; an empty table gives no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), asked.alias("asked")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    facts = rows.agg(F.max(F.size("v")).alias("dim"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("top")).first()
    spark = vectors.sparkSession
    if facts["dim"] is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, top = facts["dim"], float(facts["top"]) ** 0.5
    rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), dim - F.size("v"))))
    keep = k + 1
    key = F.xxhash64("v"), F.xxhash64(F.lit(seed), "v")
    local = rows.select("vec_id", "v").mapInArrow(_gather(keep), "ids array<long>, v array<double>")
    points = local.groupBy(key[0].alias("h1"), key[1].alias("h2")).agg(F.flatten(F.collect_list("ids")).alias("ids"), F.first("v").alias("v"))
    points = staged(points.select("h1", "h2", F.slice(F.array_sort(F.array_distinct("ids")), 1, keep).alias("ids"), "v").withColumn("rep", F.element_at("ids", 1)))
    normal = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    queries = normal.where("asked").select("vec_id", key[0].alias("h1"), key[1].alias("h2")).distinct()
    queries = staged(queries.join(points.select("h1", "h2", "rep"), ["h1", "h2"]).select(F.col("vec_id").alias("query_id"), F.col("rep").alias("asked")))
    wanted = queries.select(F.col("asked").alias("rep")).distinct().withColumn("asked", F.lit(True))
    marked = points.select("rep", "v").join(wanted, "rep", "left").select("rep", "v", F.coalesce("asked", F.lit(False)).alias("asked"))

    keyed = marked.mapInArrow(_order(curves, dim, top, seed), "curve int, key long, rep long, asked boolean")
    ranged = staged(keyed.repartitionByRange(F.col("curve"), F.col("key"), F.col("rep")).sortWithinPartitions("curve", "key", "rep").withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    tile = F.floor(F.col("place").bitwiseAND((1 << 33) - 1) / window).cast("long")
    ranged = ranged.select("curve", "rep", "asked", part.alias("part"), tile.alias("tile"))
    # one row for each partition of the ranges
    tiles = ranged.groupBy("part").agg((F.max("tile") + 1).alias("n"))
    tiles = tiles.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("base"))
    blocks = ranged.join(F.broadcast(tiles), "part").select("curve", "rep", "asked", (F.col("base") + F.col("tile")).alias("block"))
    body = points.select("rep", "v")
    inside = blocks.select("block", "rep").join(body, "rep")
    near = blocks.where("asked").select(F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)).alias("at"), "rep").join(body, "rep").select("at", F.col("rep").alias("asked"), F.col("v").alias("q"))
    found = near.groupBy("at").cogroup(inside.groupBy("block")).applyInArrow(_search(keep), "asked long, rep long, score double")
    found = staged(_nearest(found, keep).select("asked", "rep", "score", "nth"))

    if exact:
        floor = found.groupBy("asked").agg(F.when(F.count("*") >= keep, F.min("score")).alias("floor"))
        open_ = wanted.select(F.col("rep").alias("asked")).join(floor, "asked", "left").join(body.withColumnRenamed("rep", "asked"), "asked")
        open_ = open_.select("asked", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"), "v")
        n_open = open_.count()
        packs = open_.groupBy(F.pmod(F.xxhash64("asked"), F.lit(max(1, n_open // pack))).alias("pack")).agg(F.collect_list(F.struct("asked", "floor", "v")).alias("x"))
        packs = packs.select("pack", F.col("x.asked").alias("asked"), F.col("x.floor").alias("floor"), F.flatten("x.v").alias("q"))
        group = max(1, block // window)
        wide = blocks.where("curve = 0").select(F.floor(F.col("block") / group).alias("wide"), "rep").join(body, "rep")
        wide = staged(wide.groupBy("wide").agg(F.collect_list(F.struct("rep", "v")).alias("x")).select("wide", F.col("x.rep").alias("rep"), F.flatten("x.v").alias("v")))
        last = wide.agg(F.max("wide")).first()[0] or 0
        # the stated queries against all rows, a pack of queries and a block of rows at a time
        each = packs.withColumn("wide", F.explode(F.sequence(F.lit(0), F.lit(last)))).join(wide, "wide").select("asked", "floor", "q", "rep", "v")
        more = each.mapInArrow(_complete(keep), "asked long, rep long, score double")
        found = staged(_nearest(found.select("asked", "rep", "score").unionByName(more), keep).select("asked", "rep", "score", "nth"))

    one, two = body.select(F.col("rep").alias("asked"), F.col("v").alias("q")), points.select("rep", "ids", "v")
    dot = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    scored = found.select("asked", "rep").join(one, "asked").join(two, "rep").select("asked", dot.alias("score"), F.explode("ids").alias("vec_id"))
    first = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    lists = scored.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= keep)
    lists = lists.groupBy("asked").agg(F.sort_array(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("x"))
    others = queries.join(lists, "asked").select("query_id", F.posexplode(F.slice(F.filter("x", lambda e: e["vec_id"] != F.col("query_id")), 1, k)).alias("pos", "e"))
    return others.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("vec_id"), F.col("e.score").alias("score"))


def op4_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
