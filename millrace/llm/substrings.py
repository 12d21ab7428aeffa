"""Substring dedup: word windows that occur in more than one document, found level by level."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.arrays import mix, prefix, ranges, words_of
from millrace.llm.quality import covered
from millrace.llm.staging import bounded_batches, release, staged, sweep


def local_minima(hashes: np.ndarray, offs: np.ndarray, size: int) -> np.ndarray:
    """Starts of the size-word windows with the least hash among any size + 1 successive ones of a text.

    Two texts that share 2 * size words share such a window inside them, wherever it lies.
    """
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    start = np.arange(n)
    value = ranges(prefix(hashes), start, start + size)
    text_end = np.repeat(offs[1:], np.diff(offs))
    bad = start + size > text_end[:n]
    value[bad] = np.uint64(2**64 - 1)
    span = size + 1
    least, width = value.copy(), 1
    while width < span:
        move = min(width, span - width)
        if move < len(least):
            least = np.minimum(least[:-move], least[move:])
        else:
            least = least[:0]
        width += move
    frames = np.arange(len(least))
    whole = frames + 2 * size <= text_end[: len(frames)]
    frames = frames[whole]
    if not len(frames):
        return np.zeros(0, np.int64)
    # the first place of each frame's least value: carry the places of minima through equal values
    target = least[frames]
    place = np.full(len(frames), -1, np.int64)
    open_ = np.arange(len(frames))
    for k in range(span):
        hit = value[frames[open_] + k] == target[open_]
        place[open_[hit]] = frames[open_[hit]] + k
        open_ = open_[~hit]
        if not len(open_):
            break
    return np.unique(place)


SEEN = "doc_id long, text_key binary, n_words long, joined_sha256 string, anchor array<long>, at array<int>"


def _anchors(half: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, w in words_of(batch.column(2)):
                at = local_minima(w.hash, w.word_offs, half)
                value = ranges(prefix(w.hash), at, at + half).view(np.int64)
                cuts = np.searchsorted(at, w.word_offs)
                start = at - np.repeat(w.word_offs[:-1], np.diff(cuts))
                lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(v)) for v in (value, start.astype(np.int32))]
                texts = batch.column(2).slice(i, j - i).cast(pa.binary()).to_pylist()
                digest = [hashlib.sha256(b" ".join((x or b"").split())).hexdigest() for x in texts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(np.diff(w.word_offs), pa.int64()), pa.array(digest), *lists],
                    [c.split()[0] for c in SEEN.split(", ")],
                )

    return run


def _windows(size: int):
    """Windows of `size` words that hold one of the given half windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hot = batch.column(3)
            for i, j, w in words_of(batch.column(2)):
                part = hot.slice(i, j - i)
                at = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                at = at + np.repeat(w.word_offs[:-1], np.diff(part.offsets.to_numpy()))
                text = np.searchsorted(w.word_offs, at, "right") - 1
                low = np.maximum(at - (size - size // 2), w.word_offs[text])
                high = np.minimum(at, w.word_offs[text + 1] - size)
                fit = high >= low
                start = np.flatnonzero(covered(low[fit], (high - low + 1)[fit], len(w.hash)))
                text = np.searchsorted(w.word_offs, start, "right") - 1
                p, q = prefix(w.hash), prefix(mix(w.hash, 11))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i).take(pa.array(text)),
                        batch.column(1).slice(i, j - i).take(pa.array(text)),
                        pa.array((start - w.word_offs[text]).astype(np.int32)),
                        pa.array(ranges(p, start, start + size).view(np.int64)),
                        pa.array(ranges(q, start, start + size).view(np.int64)),
                    ],
                    ["doc_id", "text_key", "at", "h1", "h2"],
                )

    return run


WINDOW = "doc_id long, text_key binary, at int, h1 long, h2 long"
KEY = ["doc_id", "text_key"]
BASE = 25
EMPTY_SHA256 = hashlib.sha256().hexdigest()


def _shared(rows: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """Window rows whose hash occurs in two documents, with the least doc_id that has it.

    The hashes are staged, so that the rows meet a plain table, and adaptive execution can split the rows of a frequent one.
    """
    return rows.join(_repeated(rows) if repeated is None else repeated, ["h1", "h2"])


def _repeated(rows: DataFrame) -> DataFrame:
    """(h1, h2, first_doc): hashes that occur in two documents, staged."""
    least = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    return staged(least.where("first_doc < last_doc").drop("last_doc"))


def _survivors(rows: DataFrame) -> DataFrame:
    """_shared() of a staged level, staged; the level's own rows are deleted."""
    repeated = _repeated(rows)
    kept = staged(_shared(rows, repeated))
    release(rows, repeated)
    sweep(rows.sparkSession, 0)
    return kept


def _widened(rows: DataFrame, size: int, to: int) -> DataFrame:
    """Windows of `to` words, twice `size` at most, whose first and last `size` words are given windows of the text; the rows move once."""
    later = Window.partitionBy(*KEY).orderBy("at").rangeBetween(to - size, to - size)
    met = rows.select(*KEY, "at", "h1", "h2", F.first("h1").over(later).alias("g1"), F.first("h2").over(later).alias("g2")).where("g1 is not null")
    return met.select(*KEY, "at", F.xxhash64("h1", "g1").alias("h1"), F.xxhash64("h2", "g2", F.lit(to)).alias("h2"))


def ladder(size: int, base: int) -> list[int]:
    """The levels up to `size`, each at most twice the one before; the first has `base` words at most, and two at least if size has."""
    levels = [size]
    while levels[0] > max(base, 2):
        levels.insert(0, -(-levels[0] // 2))
    return levels


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and text; the key is short, and only tells apart texts that repeat a doc_id."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.unhex(F.md5(F.coalesce(docs["text"], F.lit("")))).alias("text_key"), docs["text"])


class RepeatedWindows:
    """Where words of a table's documents repeat.

    seen: every document's doc_id, text_key, n_words and joined_sha256; copies: those whose whole text stands in a
    smaller doc_id; texts: the texts that hold a repeated half window; starts: first words, ascending, of the windows
    to remove; levels (if asked for): the longest level at which a window of the document is repeated.

    Levels climb by doubling: `base` words or fewer, then about twice as many each time up to `size` (25, 50), then 2 * size,
    4 * size, ... Before the first, local minima of half its length stand for all windows (any repeated window of the first level holds one
    that is repeated), and only places of repeated ones are read as windows of the first level. From there on no text is
    read: windows repeated in several documents alone meet those that end a window of the next level, until none survives or
    max_level is passed. Equal texts are one text at all levels.
    """

    def __init__(self, docs: DataFrame, size: int, max_level: int | None, base: int = BASE):
        first, *higher = ladder(size, base)
        keyed = _keyed(bounded_batches(docs))
        self.seen = seen = staged(keyed.mapInArrow(_anchors(first // 2), SEEN))
        used = seen.where("doc_id is not null")
        least = used.where(F.col("n_words") >= size).groupBy("text_key").agg(F.min("doc_id").alias("rep"))
        self.copies = used.select(*KEY, "n_words").where(F.col("n_words") >= size).join(least, "text_key").where("doc_id > rep").select(*KEY).distinct()
        reps = used.where(F.size("anchor") > 0).join(least.withColumnRenamed("rep", "doc_id"), KEY, "left_semi").dropDuplicates(KEY)
        spread = reps.select(*KEY, F.explode(F.arrays_zip("anchor", "at")).alias("x")).select(*KEY, "x.anchor", "x.at")
        hot = staged(spread.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor"))
        places = staged(spread.join(hot, "anchor", "left_semi").groupBy(*KEY).agg(F.sort_array(F.collect_list("at")).alias("hot")))
        self.texts = staged(keyed.join(places, KEY).dropDuplicates(KEY))
        release(hot, places)
        windows = staged(self.texts.mapInArrow(_windows(first), WINDOW))
        for level in higher:
            shared = _survivors(windows)
            windows = staged(_widened(shared, first, level))
            release(shared)
            sweep(docs.sparkSession, 0)
            first = level
        self.levels = None
        if max_level == size:
            shared = _shared(windows)
        else:
            shared = _survivors(windows)
            self._climb(shared, size, max_level)
        self.starts = shared.where("first_doc < doc_id").groupBy(*KEY).agg(F.sort_array(F.collect_list("at")).alias("starts"))

    def _climb(self, rows: DataFrame, size: int, max_level: int | None) -> None:
        found = rows.groupBy(*KEY).agg(F.lit(size).alias("level"))
        while max_level is None or size * 2 <= max_level:
            rows = _survivors(staged(_widened(rows, size, 2 * size)))
            size *= 2
            if rows.isEmpty():
                break
            found = found.unionByName(rows.groupBy(*KEY).agg(F.lit(size).alias("level")))
        self.levels = found.groupBy(*KEY).agg(F.max("level").alias("longest_level"))


def _cut(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, digest, kept = [], [], []
            for text, starts in zip(batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3), strict=True):
                words = text.split()
                at = starts.values.to_numpy().astype(np.int64)
                drop = covered(at, np.full(len(at), size), len(words))
                joined = b" ".join([x for x, d in zip(words, drop.tolist(), strict=True) if not d])
                removed.append(int(drop.sum()))
                digest.append(hashlib.sha256(joined).hexdigest())
                kept.append(joined)
            columns = [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(digest), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in CUT.split(", ")])

    return run


CUT = "doc_id long, text_key binary, n_cut long, cut_sha256 string, cut_text string"


def substring_dedup(docs: DataFrame, size: int = 50, max_level: int | None = None, keep_text: bool = True, base: int = BASE) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 and, on request, kept_text; longest_level (the
    longest level of RepeatedWindows at which a window of it is repeated) unless max_level is size.

    A word is removed if a window of `size` words over it also starts in a document with a smaller doc_id; all
    windows are judged on the input, and found by doubling from `base` words or fewer. kept_text, null where nothing is removed, is the kept words joined by one
    space; kept_sha256 is always of the joined words.

    A null text has no words; a text shorter than `size` words loses nothing. A row whose doc_id is
    null is neither earlier nor later than any other and loses nothing. Rows that repeat a doc_id are one document
    for the comparison: they lose only words that also stand in a smaller doc_id. An empty table gives no rows;
    other columns of docs are not read.
    """
    found = RepeatedWindows(docs, size, max_level, base)
    cut = found.texts.join(found.starts, KEY).select(*KEY, "text", "starts").mapInArrow(_cut(size), CUT)
    whole = found.copies.withColumn("whole", F.lit(True))
    cut = staged(cut) if keep_text else cut.drop("cut_text")
    rows = found.seen.join(whole, KEY, "left").join(cut, KEY, "left")
    out = [
        F.coalesce("n_words", F.lit(0)).cast("long").alias("n_words"),
        F.when(F.col("whole"), F.col("n_words")).otherwise(F.coalesce("n_cut", F.lit(0))).alias("n_removed"),
        F.when(F.col("whole"), EMPTY_SHA256).otherwise(F.coalesce("cut_sha256", "joined_sha256")).alias("kept_sha256"),
    ]
    if keep_text:
        out += [F.when(F.col("whole"), "").otherwise(F.col("cut_text")).alias("kept_text"), F.col("text_key")]
    if found.levels is not None:
        rows = rows.join(found.levels, KEY, "left")
        out.append(F.col("longest_level"))
    return rows.select("doc_id", *out)


def without_repeats(docs: DataFrame, size: int = 50) -> DataFrame:
    """The rows of docs, with all their columns, their texts cut by substring_dedup; rows of which no word is left go.

    Unchanged texts stay as they are, null and empty ones too. A column n_chars, if there is one, follows the text.
    """
    cut = substring_dedup(docs, size, max_level=size).where("n_removed > 0").select(F.col("doc_id").alias("cut_id"), F.col("text_key").alias("cut_key"), "kept_text").distinct()
    key = F.unhex(F.md5(F.coalesce(docs["text"], F.lit(""))))
    joined = docs.join(cut, (docs["doc_id"] == cut["cut_id"]) & (key == cut["cut_key"]), "left").where(cut["kept_text"].isNull() | (cut["kept_text"] != ""))
    changed = {"text": F.coalesce(cut["kept_text"], docs["text"])}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(cut["kept_text"].isNull(), docs["n_chars"]).otherwise(F.length(cut["kept_text"]).cast(docs.schema["n_chars"].dataType))
    return joined.select(*[changed.get(c, docs[c]).alias(c) for c in docs.columns])


OP10_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), p AS (
  SELECT doc_id, words, i, sha256(array_to_string(list_slice(words, i, i + 49), ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50)
), f AS (
  SELECT h, min(doc_id) AS first_doc FROM p GROUP BY h
), r AS (
  SELECT DISTINCT p.doc_id, unnest(range(p.i, p.i + 50)) AS k FROM p JOIN f USING (h) WHERE f.first_doc < p.doc_id
), s AS (
  SELECT doc_id, list(k) AS ks FROM r GROUP BY doc_id
), k AS (
  SELECT w.doc_id, len(w.words) AS n_words, coalesce(len(s.ks), 0) AS n_removed,
    CASE WHEN s.ks IS NULL THEN w.words
         ELSE list_transform(list_filter(list_zip(w.words, range(1, len(w.words) + 1)), lambda z: NOT list_contains(s.ks, z[2])), lambda z: z[1]) END AS kept
  FROM w LEFT JOIN s ON w.doc_id = s.doc_id
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256
FROM k
"""


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return substring_dedup(docs, max_level=50, keep_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")
