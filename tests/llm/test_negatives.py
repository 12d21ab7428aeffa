import math
import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from millrace.llm.negatives import OP13_SQL, MultiIndex, _assign, codebook, hard_negatives, op13_multi_index_negatives

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
SCHEMA = "vec_id long, label int, embedding array<double>, anchor int, block string, cell int, v int, w int, score double, windows int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 3, 4, 5.0, 6) for r in rows], SCHEMA)


def brute(rows, every=10, positives=5, negatives=10):
    usable = {(i, c, tuple(math.floor(256 * x) for x in v)) for i, c, v in rows if None not in (i, c, v) and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, c, v in usable:
        if i % every:
            continue
        scored = sorted(((sum(a * b for a, b in zip(v, u, strict=False)), j, d) for j, d, u in usable if j != i), key=lambda s: (-s[0], s[1]))
        for ps, p in [(s, j) for s, j, d in scored if d == c][:positives]:
            fit = [(s, j) for s, j, d in scored if d != c and 30 * ps <= 100 * s <= 90 * ps][:negatives]
            out += [(i, p, k, j, ps, s) for k, (s, j) in enumerate(fit, 1)]
    return sorted(out)


def result(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def vectors(rng, n, dim=6, copies=True):
    rows = []
    for i in range(n):
        v = [rng.gauss(0, 0.4) for _ in range(dim)]
        if copies and i % 3 == 0:
            v = [0.5, 0.25, -0.5, 0.125, 0.0, 0.5][:dim]
        rows.append((i, rng.randrange(3), v))
    return rows


def test_query_against_sql(spark):
    folder = "/root/testdata/sf0.01"
    duckdb.sql(f"create or replace view embeddings as from '{folder}/embeddings.parquet'")
    want = sorted(duckdb.sql(OP13_SQL).fetchall())
    assert want and result(op13_multi_index_negatives(spark, folder)) == want


def test_copies_small_blocks_and_packs(spark):
    """A third of the rows are one vector: one cell in several blocks, met by several packs of anchors, after a probe of few rows."""
    rows = vectors(random.Random(1), 500)
    got = hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0, cell_rows=10, block_rows=40, probe=30, pack=7, sample=100)
    want = brute(rows)
    assert len(want) > 500 and result(got) == want


def test_odd_rows(spark):
    rng = random.Random(2)
    rows = vectors(rng, 60)
    rows += rows[:20] + [(10, 1, [0.9] * 6), (10, 2, rows[10][2]), (70, 0, [1.0]), (80, 0, []), (90, 1, [0.0] * 6), (None, 1, [1.0] * 6), (100, None, [1.0] * 6), (110, 1, None)]
    rows += [(120, 1, [1.0, None]), (130, 1, [float("nan")] * 6), (140, 1, [float("inf")] * 6), (150, 2, [300.0, -300.0, 1e5, 0.0, 0.0, 0.0]), (160, 9, [0.1] * 6), (-10, 1, [0.2] * 6)]
    assert result(hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0, cell_rows=4, probe=5)) == brute(rows)
    assert result(hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0, positives=2, negatives=3)) == brute(rows, positives=2, negatives=3)


def test_nothing_to_find(spark):
    for rows, every in (([], 1), ([(1, 1, [0.5, 0.5])], 1), ([(1, 1, [0.5]), (2, 1, [0.5])], 1), ([(1, 1, [0.5]), (2, 2, [0.5])], 7), ([(1, None, [0.5])], 1)):
        got = hard_negatives(frame(spark, rows), F.col("vec_id") % every == 0)
        assert got.columns == COLUMNS and got.count() == 0


def test_bounds_hold_and_rule_out_most_cells_of_clustered_rows():
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 100, (40, 16))
    rows = np.floor(centres[rng.integers(0, 40, 4000)] + rng.normal(0, 4, (4000, 16)))
    books = [codebook(rows[:1000, :8], 24), codebook(rows[:1000, 8:], 24)]
    codes = [_assign(rows[:, :8], books[0]), _assign(rows[:, 8:], books[1])]
    pairs, cell = np.unique(np.stack([c[0] for c in codes], axis=1), axis=0, return_inverse=True)
    number = np.full((len(books[0]), len(books[1])), -1)
    number[pairs[:, 0], pairs[:, 1]] = np.arange(len(pairs))
    radii = [np.array([d[c == k].max(initial=0) for k in range(len(b))]) for (c, d), b in zip(codes, books, strict=True)]
    reach = np.array([[d[cell == k].max() for _, d in codes] for k in range(len(pairs))])
    index = MultiIndex(books, radii, number, np.bincount(cell), reach, [[0]] * len(pairs), np.dtype(np.int16), 16)
    visited = 0
    for a in rows[:50]:
        score = rows @ a
        floor = int(np.sort(score)[-10])
        window = [{"w": 0, "lo": -(1 << 60), "hi": 1 << 60, "floor": floor}]
        some, more = index.visits(a, window, 200, False), index.visits(a, window, 200, True)
        assert not set(some) & set(more)
        assert set(cell[score >= floor]) <= set(some) | set(more)
        visited += len(some) + len(more)
    assert visited < 0.2 * 50 * len(pairs)
