"""Hard negatives: rows of another label whose score lies in a window below a positive's, by an inverted multi-index."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.staging import release, staged

HIGHEST = (1 << 62) - 1
WINDOWS = "array<struct<w:int,lo:bigint,hi:bigint,floor:bigint>>"
FOUND = pa.schema([("anchor", pa.int64()), ("w", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _vectors(column: pa.ChunkedArray | pa.Array, kind: np.dtype, dim: int) -> np.ndarray:
    """Packed vectors as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), dim)


def _packer(kind: np.dtype, dim: int):
    """Lists of integers, padded with zeros, as bytes; the list is the last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            sizes = np.diff(lists.offsets.to_numpy())
            m = np.zeros((len(lists), dim), kind)
            m[np.arange(dim) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([r.tobytes() for r in m], pa.binary())], [*batch.schema.names[:-1], "v"])

    return run


def codebook(points: np.ndarray, k: int, rounds: int = 12, seed: int = 13) -> np.ndarray:
    """At most k centroids of the points, by Lloyd's method from a random start."""
    points = np.unique(points, axis=0)
    centres = points[np.random.default_rng(seed).permutation(len(points))[:k]].astype(float)
    for _ in range(rounds):
        near = _assign(points, centres)[0]
        n = np.bincount(near, minlength=len(centres))
        moved = np.stack([np.bincount(near, weights=points[:, d], minlength=len(centres)) for d in range(points.shape[1])], axis=1)
        centres = np.where(n[:, None] > 0, moved / np.maximum(n, 1)[:, None], centres)
    return centres


def _assign(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each point and the distance to it."""
    near = np.argmin((centres * centres).sum(axis=1)[None] - 2 * (points @ centres.T), axis=1)
    return near, np.sqrt(((points - centres[near]) ** 2).sum(axis=1))


@dataclass
class MultiIndex:
    """Two codebooks with radii, and the cells that hold rows: number, rows, radii in either half, and blocks."""

    books: list[np.ndarray]
    radii: list[np.ndarray]
    cell: np.ndarray  # number of the cell of two codes, -1: no rows
    rows: np.ndarray
    reach: np.ndarray
    blocks: list[list[int]]
    kind: np.dtype
    dim: int

    def visits(self, a: np.ndarray, windows: list[dict], probe: int, complete: bool) -> list[int]:
        """Cells to score for an anchor with windows of scores, in falling order of their bound.

        The bound of a code is the centroid's half score plus the anchor's half norm times the radius; a heap walks over the pairs
        of codes by the sum of two bounds. The probe takes cells until they hold `probe` rows; `complete` takes
        those after the probe's, until the bound is below what every window is certain of by now. Cells whose own radii put all
        scores outside the windows are passed over.
        """
        half = len(self.books[0][0])
        halves = (a[:half], a[half:])
        mid = [b @ h for b, h in zip(self.books, halves, strict=True)]
        norm = [float(np.sqrt(h @ h)) for h in halves]
        slack = 0.5  # scores are integers, so that rounding of bounds does no harm
        bound = [m + n * r for m, n, r in zip(mid, norm, self.radii, strict=True)]
        order = [np.argsort(-b, kind="stable").tolist() for b in bound]
        x, y = ([b[i] for i in o] for b, o in zip((bound[0].tolist(), bound[1].tolist()), order, strict=True))
        highest = max(w["hi"] for w in windows)
        lowest, certain = min(w["lo"] for w in windows) - slack, min(w["floor"] for w in windows) - slack
        heap, taken, before, probing = [(-(x[0] + y[0]), 0, 0)], [], 0, True
        while heap:
            top, i, j = heapq.heappop(heap)
            if -top < (lowest if probing else certain):
                break
            if j + 1 < len(y):
                heapq.heappush(heap, (-(x[i] + y[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(x):
                heapq.heappush(heap, (-(x[i + 1] + y[0]), i + 1, 0))
            c, d = order[0][i], order[1][j]
            cell = self.cell[c, d]
            if cell < 0:
                continue
            middle, spread = mid[0][c] + mid[1][d], norm[0] * self.reach[cell, 0] + norm[1] * self.reach[cell, 1]
            if middle - spread > highest + slack or middle + spread < (lowest if probing else certain):
                continue
            if probing:
                before += self.rows[cell]
                if not complete:
                    taken.append(cell)
                if before >= probe:
                    if not complete:
                        break
                    probing = False
            else:
                taken.append(cell)
        return taken


def _visit(index, probe: int, complete: bool):
    """Anchors (anchor, pack, vec_id, label, windows, v) as one row for each block that they visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = index.value
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            a = _vectors(batch.column(at["v"]), found.kind, found.dim).astype(float)
            windows = batch.column(at["windows"]).to_pylist()
            for start in range(0, batch.num_rows, 256):
                row, block, cells = [], [], []
                for i in range(start, min(start + 256, batch.num_rows)):
                    by_block: dict[int, list[int]] = {}
                    for cell in found.visits(a[i], windows[i], probe, complete) if windows[i] else ():
                        for b in found.blocks[cell]:
                            by_block.setdefault(b, []).append(int(cell))
                    row += [i] * len(by_block)
                    block += by_block
                    cells += by_block.values()
                take = pa.array(row, pa.int64())
                rest = [batch.column(at[n]).take(take) for n in ("pack", "anchor", "vec_id", "label", "windows", "v")]
                yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(cells, pa.list_(pa.int32())), *rest], ["block", "cells", "pack", "anchor", "vec_id", "label", "windows", "v"])

    return run


def _scored(kind: np.dtype, dim: int, exact_floats: bool, keep: int, same: bool, complete: bool):
    """Scores of the anchors that visit a block against the rows of their cells there: the first `keep` of each window."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return FOUND.empty_table()
        ids, label, cell = (right.column(n).to_numpy() for n in ("vec_id", "label", "cell"))
        rows = _vectors(right.column("v"), kind, dim)
        order = np.lexsort((ids, cell))
        if len(np.unique(ids)) < len(ids):  # rows that repeat an id, a label and a vector count once
            _, first = np.unique(np.rec.fromarrays([ids, label, np.ascontiguousarray(rows).view(np.dtype((np.void, rows.dtype.itemsize * dim))).ravel()]), return_index=True)
            order = first[np.lexsort((ids[first], cell[first]))]
        ids, label, cell, rows = ids[order], label[order], cell[order], rows[order].astype(float if exact_floats else np.int64)
        cells, begin = np.unique(cell, return_index=True)
        end = np.append(begin[1:], len(cell))
        out = []
        step = max(1, (2 << 20) // len(ids))
        for at in range(0, left.num_rows, step):
            part = left.slice(at, step)
            score = _vectors(part.column("v"), kind, dim).astype(rows.dtype) @ rows.T
            columns = [part.column(n).to_pylist() for n in ("anchor", "vec_id", "label", "cells", "windows")]
            for s, anchor, own, mine, visited, windows in zip(score, *columns, strict=True):
                low = min(w["floor"] if complete else w["lo"] for w in windows)
                fit = (s >= low) & ((label == mine) if same else (label != mine))
                if len(visited) < len(cells):
                    seen = np.zeros(len(ids), bool)
                    for k in np.searchsorted(cells, visited):
                        seen[begin[k] : end[k]] = True
                    fit &= seen
                fit = np.flatnonzero(fit)
                fit = fit[ids[fit] != own]
                for w in windows:
                    inside = fit[(s[fit] >= (w["floor"] if complete else w["lo"])) & (s[fit] <= w["hi"])]
                    if len(inside) > keep:
                        cut = np.partition(s[inside], len(inside) - keep)[len(inside) - keep]
                        inside = inside[s[inside] >= cut]
                        inside = inside[np.lexsort((ids[inside], -s[inside]))[:keep]]
                    if len(inside):
                        n = len(inside)
                        out.append((np.full(n, anchor), np.full(n, w["w"], np.int32), ids[inside], s[inside].astype(np.int64)))
        return pa.table([np.concatenate(c) for c in zip(*out, strict=True)], schema=FOUND) if out else FOUND.empty_table()

    return run


def _build(spark: SparkSession, rows: DataFrame, n: int, kind: np.dtype, dim: int, cell_rows: int, block_rows: int, most_codes: int, sample: int) -> tuple[MultiIndex, DataFrame]:
    """The index over packed rows(vec_id, label, v), and the rows with their cell and block."""
    share = min(1.0, sample / n)
    drawn = rows.where(F.pmod(F.xxhash64(F.lit(13), "vec_id", "v"), F.lit(1 << 30)) < int(share * (1 << 30))).select("v").limit(2 * sample).toArrow() if share < 1 else rows.select("v").limit(sample).toArrow()
    points = _vectors(drawn.column("v"), kind, dim).astype(float) if drawn.num_rows else np.zeros((1, dim))
    half = (dim + 1) // 2
    codes = int(np.clip(np.ceil(np.sqrt(n / cell_rows)), 1, most_codes))
    points = points[np.lexsort(points.T)] if dim else points
    books = [codebook(np.ascontiguousarray(p), codes) for p in (points[:, :half], points[:, half:])]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _vectors(batch.column(2), kind, dim).astype(float)
            found = [_assign(p, b) for p, b in zip((m[:, :half], m[:, half:]), books, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(f[0].astype(np.int32)) for f in found), *(pa.array(f[1]) for f in found)], ["vec_id", "label", "v", "c1", "c2", "d1", "d2"])

    coded = staged(rows.mapInArrow(code, "vec_id long, label long, v binary, c1 int, c2 int, d1 double, d2 double"))
    # at most most_codes squared rows
    held = coded.groupBy("c1", "c2").agg(F.count("*").alias("n"), F.max("d1").alias("d1"), F.max("d2").alias("d2")).orderBy("c1", "c2").collect()
    cell = np.full((len(books[0]), len(books[1])), -1, np.int64)
    radii = [np.zeros(len(b)) for b in books]
    blocks: list[list[int]] = []
    block, filled, plan = 0, 0, []
    for k, r in enumerate(held):
        cell[r["c1"], r["c2"]] = k
        radii[0][r["c1"]] = max(radii[0][r["c1"]], r["d1"])
        radii[1][r["c2"]] = max(radii[1][r["c2"]], r["d2"])
        parts = -(-r["n"] // block_rows)
        if filled and filled + r["n"] > block_rows:
            block, filled = block + 1, 0
        blocks.append(list(range(block, block + parts)))
        plan.append((r["c1"], r["c2"], k, block, parts))
        block, filled = (block + parts, 0) if parts > 1 else (block, filled + r["n"])
    index = MultiIndex(books, radii, cell, np.array([r["n"] for r in held]), np.array([(r["d1"], r["d2"]) for r in held]).reshape(-1, 2), blocks, kind, dim)
    places = spark.createDataFrame(plan, "c1 int, c2 int, cell int, first int, parts int")
    placed = coded.join(F.broadcast(places), ["c1", "c2"])
    return index, placed.select((F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("int").alias("block"), "cell", "vec_id", "label", "v")


def hard_negatives(
    vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
    cell_rows: int = 512, block_rows: int = 16_384, most_codes: int = 256, sample: int = 8_192, probe: int = 4_096, pack: int = 16_384,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its positives the
    first negatives whose score is between `low` and `high` per cent of the positive's.

    vectors has vec_id, label (an integer) and embedding; `anchor` is a condition on its columns. Components are floor(scale * x), scores
    integer inner products; higher scores come first, ties by the smaller vec_id. Positives are the first rows of the anchor's label with another id,
    negatives have another label. Fewer are all; a positive with a negative score has an empty window.

    Either half of the components has a codebook, fitted on about `sample` rows (at most twice as many); two codes are
    a cell; all rows are indexed. An anchor scores cells in falling order of their bound, see MultiIndex.visits: a probe of `probe` rows
    first, then all cells whose bound could still change a window, so that the result is exact. Positives are
    found first, since they set the windows. Cells lie in blocks of `block_rows` rows at most, a large cell in several; anchors meet
    blocks in packs of about `pack`, so no task holds more than a block and a pack.

    Rows with a null id, label or vector, or a null or non-finite component take no part; an empty vector does, with scores of 0.
    Shorter vectors count as padded with zeros. Rows that repeat id, label and vector count once; an id with several vectors or labels is
    several rows. Components beyond 2**62 / scale, and products beyond 64 bits, have no defined score. An empty table, or no anchor, gives no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    x = F.col("embedding")
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    whole = F.transform(x, lambda e: F.floor(e.cast("double") * scale))
    rows = vectors.where(F.coalesce(sound, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), anchor.alias("anchor"), whole.alias("x"))
    facts = rows.agg(
        F.count("*").alias("n"), F.max(F.size("x")).alias("dim"), F.max(F.aggregate("x", F.lit(0.0), lambda a, e: a + e.cast("double") * e)).alias("square"),
        F.max(F.array_max("x")).alias("most"), F.min(F.array_min("x")).alias("least"),
    ).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not facts["n"]:
        return spark.createDataFrame([], schema)
    n, dim = facts["n"], max(2, facts["dim"])
    most = max(facts["most"] or 0, -(facts["least"] or 0))
    kind = np.dtype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)
    exact_floats = (facts["square"] or 0) < float(1 << 52)
    packed = staged(rows.mapInArrow(_packer(kind, dim), "vec_id long, label long, anchor boolean, v binary"))
    cores = max(1, spark.sparkContext.defaultParallelism)
    index, placed = _build(spark, packed.select("vec_id", "label", "v"), n, kind, dim, cell_rows, int(np.clip(n // (2 * cores), 512, block_rows)), most_codes, sample)
    placed = staged(placed)
    asked = packed.where("anchor").select("vec_id", "label", "v").distinct()
    asked = staged(asked.select(F.monotonically_increasing_id().alias("anchor"), "vec_id", "label", "v"))
    n_asked = asked.count()
    packs, spread = max(1, -(-n_asked // pack)), max(2 * cores, n_asked // 2_048)
    asked = asked.withColumn("pack", F.pmod(F.xxhash64("anchor"), F.lit(packs)).cast("int"))
    shared = spark.sparkContext.broadcast(index)
    spent = [packed, placed]

    def search(state: DataFrame, keep: int, same: bool, complete: bool) -> DataFrame:
        """Scores of state(anchor, pack, vec_id, label, v, windows) in one round of visits."""
        shape = f"block int, cells array<int>, pack int, anchor long, vec_id long, label long, windows {WINDOWS}, v binary"
        visits = staged(state.repartition(spread, "anchor").mapInArrow(_visit(shared, probe, complete), shape))
        spent.append(visits)
        pairs = visits.select(F.col("block").alias("at"), F.col("pack").alias("packed")).distinct()
        met = placed.join(pairs, placed["block"] == pairs["at"]).drop("block")
        scored = visits.groupBy("block", "pack").cogroup(met.groupBy("at", "packed"))
        return scored.applyInArrow(_scored(kind, dim, exact_floats, keep, same, complete), "anchor long, w int, vec_id long, score long")

    def first(found: DataFrame, keep: int) -> DataFrame:
        order = Window.partitionBy("anchor", "w").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)

    def both_rounds(windows: DataFrame, keep: int, same: bool) -> DataFrame:
        """The first rows of all windows(anchor, w, lo, hi): a probe, then what its results leave open."""
        window = F.sort_array(F.collect_list(F.struct("w", "lo", "hi", F.coalesce("floor", "lo").alias("floor")))).alias("windows")
        begun = windows.withColumn("floor", F.col("lo")).groupBy("anchor").agg(window)
        some = staged(first(search(asked.join(begun, "anchor"), keep, same, False), keep))
        floors = some.where(F.col("rank") == keep).select("anchor", "w", F.col("score").alias("floor"))
        going = windows.join(floors, ["anchor", "w"], "left").groupBy("anchor").agg(window)
        more = search(asked.join(going, "anchor"), keep, same, True)
        spent.append(some)
        return staged(first(some.drop("rank").unionByName(more), keep))

    every = asked.select("anchor", F.lit(0).alias("w"), F.lit(-HIGHEST).cast("long").alias("lo"), F.lit(HIGHEST).cast("long").alias("hi"))
    near = both_rounds(every, positives, True)
    near = near.select("anchor", F.col("rank").alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    windows = near.where("positive_score >= 0").select("anchor", "w", F.expr(f"({low} * positive_score + 99) div 100").alias("lo"), F.expr(f"({high} * positive_score) div 100").alias("hi"))
    far = both_rounds(windows.where("lo <= hi"), negatives, False)
    release(*spent)
    result = far.join(near, ["anchor", "w"]).join(asked.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
    return result.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_multi_index_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_inner_product(a.e, r.e) AS BIGINT) AS score
  FROM v a JOIN v r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
