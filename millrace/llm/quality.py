"""Quality rules: base counts and suffix-array repetition of every text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from millrace.llm.arrays import Words, ranges, mix, sums, words_of
from millrace.llm.staging import bounded_batches

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True

#: Texts that are judged at once, and rows of a batch: a worker keeps what its largest run took, and later stages share it.
RUN_BYTES, BATCH_ROWS = 1 << 19, 500
REPORT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_covered_words long, longest_repeat long, base_failed boolean, kept boolean"
)


def longest_shared(hashes: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest word sequence from there that occurs again in its text.

    A suffix array over the words of all given texts is built by prefix doubling; a suffix drops out as soon
    as it is alone. Suffixes are ordered by (text, hash), so equal words of two texts never meet. The longest
    common prefix with the neighbours in the array, found by descending through the levels, bounds the
    LCP interval of each suffix.
    """
    n = len(hashes)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    text = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    key = mix(hashes + mix(text.astype(np.uint64), 7))
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    head = np.ones(n, bool)
    head[1:] = sorted_key[1:] != sorted_key[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    levels, step = [rank.copy()], 1
    text_end = offs[1:][text]
    while True:
        single = head & np.append(head[1:], True)
        slots = np.flatnonzero(~single)
        if not len(slots):
            break
        suffix = order[slots]
        after = suffix + step
        inside = after < text_end[suffix]
        follow = np.where(inside, rank[np.minimum(after, n - 1)], n + suffix)
        by = np.argsort(rank[suffix] * (2 * n + 1) + follow, kind="stable")
        suffix, follow, group = suffix[by], follow[by], rank[suffix[by]]
        new = np.ones(len(slots), bool)
        new[1:] = (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])
        order[slots], head[slots] = suffix, new
        rank[suffix] = np.maximum.accumulate(np.where(new, slots, 0))
        levels.append(rank.copy())
        step *= 2
    a, b = order[:-1], order[1:]
    near = levels[0][a] == levels[0][b]
    a, b = a[near], b[near]
    shared = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = np.minimum(a + shared, n - 1), np.minimum(b + shared, n - 1)
        same = (levels[k][x] == levels[k][y]) & (a + shared < text_end[a]) & (b + shared < text_end[b])
        shared += same * (1 << k)
    np.maximum.at(lcp, a, shared)
    np.maximum.at(lcp, b, shared)
    return lcp


def covered(start: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in the union of the spans."""
    edge = np.bincount(start, minlength=n + 1) - np.bincount(start + length, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def repeated_lines(w: Words) -> np.ndarray:
    """Per text, the lines with a word that equal an earlier line."""
    n = len(w.buf)
    breaks = np.flatnonzero(w.buf == 0x0A)
    start = np.unique(np.concatenate([w.offs[:-1][w.offs[:-1] < n], breaks[breaks + 1 < n] + 1]))
    if not len(start):
        return np.zeros(len(w.offs) - 1, np.int64)
    end = np.append(start[1:], n)
    end = end - (w.buf[end - 1] == 0x0A)
    inside = np.zeros(n + 1, np.int64)
    np.cumsum(~w.space, out=inside[1:])
    used = inside[end] > inside[start]
    start, end = start[used], end[used]
    text = np.searchsorted(w.offs, start, "right") - 1
    key = mix(ranges(w.prefix, start, end) + mix(text.astype(np.uint64), 3))
    _, first = np.unique(key, return_index=True)
    again = np.ones(len(start), bool)
    again[first] = False
    return np.bincount(text[again], minlength=len(w.offs) - 1)


def _reports(column: pa.Array, min_words: int, max_repeat_percent: int, min_repeat: int, max_covered: float, max_longest: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """For runs of texts the columns of REPORT after doc_id."""
    for i, j, w in words_of(column, RUN_BYTES):
        n_words = np.diff(w.word_offs)
        lcp = longest_shared(w.hash, w.word_offs)
        total = len(lcp)
        three, long = np.flatnonzero(lcp >= 3), np.flatnonzero(lcp >= min_repeat)
        n_repeat = sums(covered(three, np.full(len(three), 3), total), w.word_offs)
        n_covered = sums(covered(long, lcp[long], total), w.word_offs)
        longest = np.zeros(j - i, np.int64)
        np.maximum.at(longest, np.repeat(np.arange(j - i), n_words), lcp)
        failed = (n_words < min_words) | (100 * n_repeat > max_repeat_percent * n_words)
        kept = ~failed & (n_covered <= max_covered * n_words) & (longest <= max_longest)
        chars = sums(~w.space & ((w.buf & 0xC0) != 0x80), w.offs)
        yield i, j, [n_words, chars, sums(SYMBOL[w.buf], w.offs), repeated_lines(w), n_repeat, n_covered, longest, failed, kept]


def quality_report(docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, min_repeat: int = 16, max_covered: float = 0.3, max_longest: int = 50) -> DataFrame:
    """One row per document with base counts, repetition and the verdict (columns of REPORT).

    Words are `[^\\x20\\x09-\\x0D]+`. n_covered_words counts the words in the union of all maximal repeated
    substrings of at least min_repeat words; longest_repeat is the longest repeated substring of any length. A
    text is kept if it passes the base rules, at most max_covered of its words are covered and its longest repeat
    has at most max_longest words.

    A null or empty text has no words, so it fails the base rules. A text of any length is one unit of work in a
    task; equal rows give equal reports, null ids too. Other columns of docs are not read. An empty table gives no rows.
    """
    limits = (min_words, max_repeat_percent, min_repeat, max_covered, max_longest)
    names = [c.split()[0] for c in REPORT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, columns in _reports(batch.column(1), *limits):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *map(pa.array, columns)], names)

    return bounded_batches(docs, BATCH_ROWS).select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, REPORT)


def quality_filter(docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, min_repeat: int = 16, max_covered: float = 0.3, max_longest: int = 50) -> DataFrame:
    """The rows of docs that quality_report keeps, with all their columns; each row is judged by itself, without a shuffle."""
    limits = (min_words, max_repeat_percent, min_repeat, max_covered, max_longest)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [columns[-1] for _, _, columns in _reports(batch.column(at), *limits)]
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    return bounded_batches(docs, BATCH_ROWS).mapInArrow(run, docs.schema)


OP5_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), p AS (
  SELECT doc_id, s.size, unnest(range(1, len(words) - s.size + 2)) AS i, words FROM w, (VALUES (3), (16), (51)) AS s(size) WHERE len(words) >= s.size
), k AS (
  SELECT doc_id, size, i, md5(array_to_string(list_slice(words, i, i + size - 1), ' ')) AS h FROM p
), r AS (
  SELECT doc_id, size, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, size, h) AS n FROM k) WHERE n > 1
), c AS (
  SELECT doc_id, count(DISTINCT CASE WHEN size = 3 THEN pos END) AS c3, count(DISTINCT CASE WHEN size = 16 THEN pos END) AS c16, count(*) FILTER (size = 51) AS c51
  FROM (SELECT doc_id, size, unnest(range(i, i + size)) AS pos FROM r) GROUP BY doc_id
), b AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines,
    coalesce(c3, 0) AS n_repeat_words, coalesce(c16, 0) AS n_covered_words, coalesce(c51, 0) AS c51
  FROM w LEFT JOIN c ON w.doc_id = c.doc_id
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b
)
SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_repeat_words, n_covered_words, base_failed,
  NOT base_failed AND n_covered_words <= 0.3 * n_words AND c51 = 0 AS kept FROM f
"""


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("longest_repeat")
