"""Language identification by interpolated Kneser-Ney character models.

Texts are dealt to blocks by a hash. Each block's distinct n-grams are counted in its task; counts, contexts and
probabilities of all orders are tables that Spark groups and joins; a block then gets the probabilities of its own n-grams
as sorted hash arrays, by which its texts are scored. Neither the driver nor a task holds the models.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.arrays import Words, mix, prefix, ranges, sums, words_of
from millrace.llm.staging import bounded_batches, release, staged

TALLY = "block int, key long, gram string, n array<int>"
SCORED = "doc_id long, text_key binary, labelled boolean, lang int, score double, cross_entropy double, n_grams long, squares double"
BLOCK_BYTES = 32 << 20
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For every code point, whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _letters[0]


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


class Padded:
    """The chosen words as code points, each after order - 1 spaces and before one; grams: starts of all n-grams."""

    def __init__(self, w: Words, which: np.ndarray, order: int):
        data, offs = w.texts(which)
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        first = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=first[1:])
        offs = first[offs]
        self.size = np.diff(offs)
        n = len(which)
        self.points = np.full(len(points) + n * order, 32, np.uint32)
        word = np.repeat(np.arange(n), self.size)
        self.points[np.arange(len(points)) + (word + 1) * order - 1] = points
        self.letter = sums(letters()[points], offs) > 0
        self.offs = np.zeros(n + 1, np.int64)
        np.cumsum(self.size + 1, out=self.offs[1:])
        word = np.repeat(np.arange(n), self.size + 1)
        self.grams = np.arange(self.offs[-1]) + word * (order - 1)
        self.prefix = prefix(mix(self.points.astype(np.uint64)))


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, texts, compressed one by one, since a shuffle's own compression leaves half as much again."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        for i in range(0, batch.num_rows, 1000):
            part = batch.slice(i, 1000)
            texts = part.columns[-1].fill_null("").cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([squeeze(x.as_buffer()) for x in texts], pa.binary())], part.schema.names)


def _squeezed(rows: DataFrame) -> DataFrame:
    return rows.mapInArrow(_squeeze, ", ".join(f"{f.name} {f.dataType.simpleString() if f.name != 'text' else 'binary'}" for f in rows.schema))


def _texts(column: pa.Array) -> pa.Array:
    """Compressed texts in lower case."""
    open_ = zstandard.ZstdDecompressor().decompress
    return pc.utf8_lower(pa.array([open_(x.as_buffer()) for x in column], pa.binary()).cast(pa.string()))


def _merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, code points and counts of n-grams, of several lists of them, each n-gram once."""
    key, points, count = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(key, kind="stable")
    key = key[order]
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[head], points[order[head]], np.add.reduceat(count[order], head, axis=0) if len(head) else count[:0]


def _tally(order: int, langs: int):
    """The distinct n-grams of each block (columns of TALLY), with their counts in the texts of each language to be counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            block = batch.column(0).to_numpy()
            for b in np.unique(block).tolist():
                own = batch.filter(pa.array(block == b))
                code = own.column(1).to_numpy()
                parts = held.setdefault(b, [])
                for i, j, w in words_of(_texts(own.column(2))):
                    lang = np.repeat(code[i:j], np.diff(w.word_offs))
                    _, at, n = np.unique(w.hash + mix(lang.astype(np.uint64)), return_index=True, return_counts=True)
                    if not len(at):
                        continue
                    p = Padded(w, at, order)
                    of, times = np.repeat(lang[at], p.size + 1), np.repeat(n, p.size + 1)
                    key, first, back = np.unique(ranges(p.prefix, p.grams, p.grams + order), return_index=True, return_inverse=True)
                    used = of >= 0
                    count = np.bincount(back[used] * langs + of[used], times[used], len(key) * langs).reshape(len(key), langs).astype(np.int32)
                    parts.append((key, p.points[p.grams[first][:, None] + np.arange(order)], count))
                    if sum(len(x[0]) for x in parts[1:]) > max(200_000, len(parts[0][0])):
                        parts[:] = [_merged(parts)]
        for b, parts in held.items():
            if not parts:
                continue
            key, points, count = _merged(parts)
            for i in range(0, len(key), 20_000):
                text = points[i : i + 20_000].tobytes().decode("utf-32-le")
                n = len(key[i : i + 20_000])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * langs, pa.int32()), pa.array(count[i : i + 20_000].ravel().astype(np.int32)))
                grams = pa.array([text[k * order : (k + 1) * order] for k in range(n)], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, b, np.int32)), pa.array(key[i : i + 20_000].view(np.int64)), grams, lists], ["block", "key", "gram", "n"])

    return run


@dataclass
class Tally:
    """Texts dealt to blocks: rows of TALLY, the names behind the places in n, and how a table is dealt."""

    rows: DataFrame
    langs: list[str]
    order: int
    blocks: int

    def dealt(self, rows: DataFrame) -> DataFrame:
        return rows.repartitionById(self.blocks, F.col("block"))


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"], docs["lang"].cast("string").alias("lang")) if "lang" in docs.columns else docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"], F.lit(None).cast("string").alias("lang"))


def tally(docs: DataFrame, counted: Column | None = None, order: int = 5, block_bytes: int = BLOCK_BYTES) -> Tally:
    """All n-grams of docs(doc_id, text, lang) by block, counted by lang where `counted` holds and lang is not null.

    A block has about block_bytes of text, or less so that each core has one; rows of one doc_id and text share one.
    """
    rows = _keyed(docs)
    rows = rows.withColumn("label", F.when(F.lit(True) if counted is None else counted, F.col("lang")))
    langs = sorted(r[0] for r in rows.where("label is not null").select("label").distinct().collect())
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(docs.sparkSession.sparkContext.defaultParallelism, math.ceil(size / block_bytes))
    code = F.coalesce(F.array_position(F.array(*map(F.lit, langs)), F.col("label")) - 1 if langs else F.lit(-1), F.lit(-1)).cast("int")
    out = Tally(rows, langs, order, blocks)
    texts = bounded_batches(rows).where("text is not null").select(_block(blocks), code.alias("code"), "text")
    out.rows = staged(out.dealt(_squeezed(texts)).mapInArrow(_tally(order, len(langs)), TALLY))
    return out


def _each(columns: list[Column]) -> Column:
    return F.array(*columns)


class Model:
    """Interpolated Kneser-Ney models of all languages as tables.

    counts[k]: (gram, n) of order k, n having a place a language: counts in the highest order, below it the number of
    n-grams that the gram ends; contexts[k]: (context, total, types). A language's discount of an order is n1 / (n1 + 2 n2)
    there, between 0.1 and 0.9.
    """

    def __init__(self, tallied: Tally):
        self.order, self.langs = tallied.order, tallied.langs
        places = range(len(self.langs))
        top = tallied.rows.groupBy("gram").agg(*[F.sum(F.col("n")[k]).alias(f"n{k}") for k in places])
        self.counts, self.discounts = {}, {}
        for k in range(self.order, 0, -1):
            some = F.greatest(*[F.col(f"n{i}") for i in places], F.lit(0)) > 0
            table = staged(top.where(some).select("gram", _each([F.col(f"n{i}") for i in places]).alias("n")))
            self.counts[k] = table
            found = table.agg(*[F.count_if(F.col("n")[i] == v) for v in (1, 2) for i in places], *[F.sum(F.col("n")[i]) for i in places], *[F.count_if(F.col("n")[i] > 0) for i in places], F.count("*")).first()
            n1, n2, total, types = (found[len(places) * j : len(places) * (j + 1)] for j in range(4))
            self.discounts[k] = [min(max(a / max(a + 2 * b, 1), 0.1), 0.9) for a, b in zip(n1, n2, strict=True)]
            if k == 1:
                self.one = [x or 0 for x in total], list(types)
                self.alphabet = 1 + found[-1]
            top = table.groupBy(F.substring("gram", 2, k - 1).alias("gram")).agg(*[F.count_if(F.col("n")[i] > 0).alias(f"n{i}") for i in places])

    def contexts(self, k: int) -> DataFrame:
        places = range(len(self.langs))
        table = self.counts[k].groupBy(F.substring("gram", 1, k - 1).alias("context"))
        return table.agg(_each([F.sum(F.col("n")[i]) for i in places]).alias("total"), _each([F.count_if(F.col("n")[i] > 0) for i in places]).alias("types"))

    def probabilities(self, grams: DataFrame, k: int | None = None) -> DataFrame:
        """(gram, p) for distinct n-grams of order k, p having a place a language."""
        k = k or self.order
        places, cut = range(len(self.langs)), self.discounts[k]
        known = grams.select("gram").join(self.counts[k], "gram", "left")
        if k == 1:
            total, types = ([F.lit(x) for x in xs] for xs in self.one)
            below = [F.lit(1 / self.alphabet)] * len(places)
        else:
            suffix = F.substring("gram", 2, k - 1)
            lower = self.probabilities(grams.select(suffix.alias("gram")).distinct(), k - 1).select(F.col("gram").alias("suffix"), F.col("p").alias("below"))
            known = known.join(self.contexts(k), F.substring("gram", 1, k - 1) == F.col("context"), "left").join(lower, suffix == F.col("suffix"))
            total, types, below = ([F.col(c)[i] for i in places] for c in ("total", "types", "below"))
        p = []
        for i in places:
            n = F.coalesce(F.col("n")[i], F.lit(0))
            seen = F.coalesce(total[i], F.lit(0)) > 0
            p.append(F.when(seen, (F.greatest(n - cut[i], F.lit(0.0)) + cut[i] * types[i] * below[i]) / total[i]).otherwise(below[i]))
        return known.select("gram", _each(p).alias("p"))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a block in a batch as one row of arrays."""
    for batch in batches:
        order = np.argsort(batch.column(0).to_numpy(), kind="stable")
        block = batch.column(0).to_numpy()[order]
        cut = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(block)).astype(np.int32) if len(block) else np.zeros(1, np.int32)
        logs = batch.column(2).take(pa.array(order)).flatten()
        width = len(logs) // max(len(block), 1)
        keys = pa.ListArray.from_arrays(pa.array(cut), batch.column(1).take(pa.array(order)))
        yield pa.RecordBatch.from_arrays([pa.array(block[cut[:-1]]), keys, pa.ListArray.from_arrays(pa.array(cut * width), logs)], ["block", "keys", "logs"])


PACKED = "block int, keys array<long>, logs array<float>"


def _score(order: int, langs: int):
    """Scores of texts (columns of SCORED), of rows sorted by block and kind: first those of its sorted hash arrays, then texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, key, logs = None, [], None, None
        for batch in batches:
            numbers, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cut = [0, *(np.flatnonzero((numbers[1:] != numbers[:-1]) | (kinds[1:] != kinds[:-1])) + 1).tolist(), len(kinds)]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if a == b:
                    continue
                if numbers[a] != block:
                    block, parts, key = numbers[a], [], None
                own = batch.slice(a, b - a)
                if kinds[a] == 0:
                    parts.append((own.column(2).flatten().to_numpy().view(np.uint64), own.column(3).flatten().to_numpy().reshape(-1, langs)))
                    continue
                if key is None:
                    key = np.concatenate([np.zeros(0, np.uint64), *(x for x, _ in parts)])
                    by = np.argsort(key)
                    key, logs, parts = key[by], np.concatenate([np.zeros((0, langs), np.float32), *(x for _, x in parts)])[by], []
                for i, j, w in words_of(_texts(own.column(7))):
                    yield pa.RecordBatch.from_arrays([*(own.column(c).slice(i, j - i) for c in (4, 5, 6)), *_scores(w, j - i, key, logs, order)], [c.split()[0] for c in SCORED.split(", ")])

    return run


def _scores(w: Words, n: int, key: np.ndarray, logs: np.ndarray, order: int) -> list[pa.Array]:
    """The columns of SCORED after labelled, of n texts."""
    langs = logs.shape[1]
    total, squares = np.zeros((n, langs)), np.zeros((n, langs))
    size, letter = np.zeros(n, np.int64), np.zeros(n, bool)
    _, at, back = np.unique(w.hash, return_index=True, return_inverse=True)
    if len(at):
        p = Padded(w, at, order)
        want = ranges(p.prefix, p.grams, p.grams + order)
        place = np.minimum(np.searchsorted(key, want), max(len(key) - 1, 0))
        if not len(key) or (key[place] != want).any():
            raise ValueError("the table gave other rows when it was read again; write it down first")
        cost = -logs[place].astype(np.float64)
        for out, values in ((total, cost), (squares, cost * cost)):
            words = np.add.reduceat(values, p.offs[:-1], axis=0)
            for k in range(langs):
                upto = np.zeros(len(back) + 1)
                np.cumsum(words[back, k], out=upto[1:])
                out[:, k] = upto[w.word_offs[1:]] - upto[w.word_offs[:-1]]
        size = sums((p.size + 1)[back], w.word_offs)
        letter = sums(p.letter[back], w.word_offs) > 0
    entropy = total / np.maximum(size, 1)[:, None]
    best = entropy.argmin(axis=1)
    least = entropy[np.arange(n), best]
    share = 1 / np.exp(-(entropy - least[:, None]) * np.minimum(size, 64)[:, None]).sum(axis=1)
    return [pa.array(np.where(letter, best, -1).astype(np.int32)), pa.array(np.where(letter, share, 0.0)), pa.array(least), pa.array(size), pa.array(squares[np.arange(n), best])]


def _text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def scores(docs: DataFrame, tallied: Tally, model: Model, labelled: Column) -> DataFrame:
    """One row per document (columns of SCORED, lang being a place in model.langs or -1), of the docs that were tallied.

    The tables of the tally and the model are deleted, once the blocks have what they need of them.
    """
    wanted = tallied.rows.select("block", "key", "gram")
    logs = model.probabilities(wanted.select("gram").distinct()).select("gram", F.transform("p", lambda x: F.log(x).cast("float")).alias("logs"))
    tables = staged(wanted.join(logs, "gram").select("block", "key", "logs").mapInArrow(_pack, PACKED))
    release(tallied.rows, *model.counts.values())
    texts = bounded_batches(_keyed(docs)).select(_block(tallied.blocks), F.lit(1).alias("kind"), "doc_id", _text_key(F.col("text")).alias("text_key"), labelled.alias("labelled"), "text")
    rows = tables.withColumn("kind", F.lit(0)).unionByName(_squeezed(texts), allowMissingColumns=True).select("block", "kind", "keys", "logs", "doc_id", "text_key", "labelled", "text")
    scored = staged(tallied.dealt(rows).sortWithinPartitions("block", "kind").mapInArrow(_score(model.order, len(model.langs)), SCORED))
    release(tables)
    return scored


def _calibrated(scored: DataFrame, langs: list[str], share: float, few: int = 30) -> DataFrame:
    """scored with lang_pred, surprise and rejected.

    Of the labelled rows predicted as each language: the mean cost of an n-gram, its variance, and the variance of texts
    beyond that of their n-grams; those of all languages together for one with fewer than `few` such rows. A text's
    surprise is how far its cross-entropy lies above the mean, in standard deviations of a text of its length; the limit
    is the surprise that `share` of all labelled rows stay below.
    """
    rows = scored.where("labelled and lang >= 0")
    e, n = F.col("cross_entropy"), F.col("n_grams")
    sums_ = F.sum(e * n), F.sum("squares"), F.sum(n), F.sum(e * e), F.sum(e), F.sum(1 / n), F.count("*")
    facts = {r[0]: np.array([x or 0 for x in r[1:]], float) for r in rows.rollup("lang").agg(*sums_).collect()}
    every = facts.get(None, np.zeros(7))
    stats = []
    for k in range(len(langs)):
        cost, squares, grams, e2, e1, inverse, docs = facts[k] if k in facts and facts[k][-1] >= few else every
        mean = cost / max(grams, 1)
        once = max(squares / max(grams, 1) - mean**2, 1e-9)
        stats.append((mean, once, max((e2 - 2 * mean * e1 - once * inverse) / max(docs, 1) + mean**2, 0.0)))
    of = lambda values: F.get(F.array(*map(F.lit, values)), F.col("lang"))
    mean, once, beyond = (of([float(x) for x in v]) for v in zip(*stats, strict=True))
    surprise = (e - mean) / F.sqrt(once / n + beyond)
    limit = rows.select(surprise.alias("s")).agg(F.percentile_approx("s", share, 10_000)).first()[0]
    rejected = (F.col("lang") < 0) | (surprise > F.lit(float("inf") if limit is None else limit))
    names = F.coalesce(of(langs), F.lit("und"))
    return scored.select("doc_id", "text_key", names.alias("lang_pred"), "score", "cross_entropy", surprise.alias("surprise"), rejected.alias("rejected"))


def identify(docs: DataFrame, order: int = 5, share: float = 0.999, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, text_key (MD5 of the text), lang_pred, score, cross_entropy, surprise, rejected.

    The language is that of least cross-entropy per character. Models are learned from the rows with a lang whose
    crc32(doc_id as text) mod 5 is not 0; rows without a doc_id are not learned from. One learned row in ten, by another hash
    class of doc_id, is not counted but calibrates the rejection: `share` of those rows are not rejected. score is the
    language's share of the likelihoods, over at most 64 characters' worth of text.

    Null texts, empty texts and texts without a letter get `und`, score 0, and are rejected. Very long texts, repeated
    rows and repeated ids each give a row. Without any labelled row every text is `und`, and none is rejected, since
    nothing is known. An empty table gives no rows; columns other than doc_id, text and lang are not read.
    """
    learned = F.coalesce(remainder(F.col("doc_id"), 5) != 0, F.lit(False))
    calibration = learned & (F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(10)) == 0)
    tallied = tally(docs, learned & ~calibration, order, block_bytes)
    if not tallied.langs:
        nothing = F.lit(0.0)
        return _keyed(docs).select("doc_id", _text_key(F.col("text")).alias("text_key"), F.lit("und").alias("lang_pred"), nothing.alias("score"), nothing.alias("cross_entropy"), nothing.alias("surprise"), F.lit(False).alias("rejected"))
    scored = scores(docs, tallied, Model(tallied), calibration & F.col("lang").isNotNull())
    return _calibrated(scored, tallied.langs, share)


def language_filter(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that identify() does not reject, with all their columns; all of them if no row is labelled.

    Null and empty texts and those without a letter go. Rows of equal texts are kept or go together, repeated ids and
    null ids too. An empty table gives no rows.
    """
    gone = identify(docs, **options).where("rejected").select(F.col("text_key").alias("gone_key")).distinct()
    return docs.join(gone, _text_key(docs["text"]) == gone["gone_key"], "left_anti")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    held_out = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
