"""Packing: order-preserving dynamic programming over sentence and document boundaries."""

from __future__ import annotations

import os
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from millrace.llm.arrays import Words, ranges, words_of
from millrace.llm.staging import bounded_batches

SENTENCE_END = np.zeros(256, bool)
SENTENCE_END[list(b".!?")] = True

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def best_cuts(place: np.ndarray, penalty: np.ndarray, capacity: int) -> np.ndarray:
    """Which of the boundaries to cut at, for the least sum of padding and penalties.

    place holds ascending token places, the first 0 and the last the end; no two neighbours are further apart
    than capacity. With f(j) = capacity + penalty(j) - place(j) + min over i of (f(i) + place(i)), i ranging over
    the boundaries at most capacity before j, a queue of ascending values gives each minimum in constant time.
    """
    at, cost = place.tolist(), (capacity + penalty).tolist()
    came = [0] * len(at)
    queue = deque([(0, 0, 0)])
    for j in range(1, len(at)):
        p = at[j]
        low = p - capacity
        while queue[0][1] < low:
            queue.popleft()
        value, _, came[j] = queue[0]
        value += cost[j]
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, p, j))
    cuts, j = [], len(at) - 1
    while j:
        cuts.append(at[j])
        j = came[j]
    return np.array([0, *reversed(cuts)])


def boundaries(ends: np.ndarray, doc_ends: np.ndarray, capacity: int, sentence_penalty: int, hard_penalty: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending boundary places and penalties: document ends, sentence ends, and places inside overlong sentences."""
    place = np.union1d(ends, doc_ends)
    place = np.append(0, place[place > 0])
    hard = []
    for k in np.flatnonzero(np.diff(place) > capacity // 2):
        hard.append(np.arange(place[k] + capacity // 16, place[k + 1], capacity // 16))
    cut = np.concatenate(hard) if hard else np.zeros(0, np.int64)
    both = np.concatenate([place, cut])
    penalty = np.concatenate([np.where(np.isin(place, doc_ends), 0, sentence_penalty), np.full(len(cut), hard_penalty)])
    penalty[0] = 0
    order = np.argsort(both, kind="stable")
    return both[order], penalty[order]


# the vocabulary lowers all letters, and parts a full stop or comma from the letter before it
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
LETTER = np.zeros(256, bool)
LETTER[ord("a") : ord("z") + 1] = True
STOP = np.zeros(256, bool)
STOP[list(b".,")] = True


class _Tokens:
    """Ids of all words of a run of texts; each distinct word is encoded once while it is among those held."""

    def __init__(self, vocabulary: str, held: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.held = Tokenizer.from_str(vocabulary), held
        self.tokenizer.encode_special_tokens = True
        self.forget()

    def forget(self) -> None:
        self.key, self.begin, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def learn(self, w: Words, key: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Encodes new words, given by their hashes and bytes."""
        if len(self.key) + len(key) > self.held:
            self.forget()
        data = w.buf.tobytes()
        texts = [data[s:e].decode() for s, e in zip(start.tolist(), end.tolist(), strict=True)]
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((x for i in ids for x in i), np.uint32, int(size.sum()))
        begin = np.cumsum(size) - size + len(self.pool)
        self.pool = np.concatenate([self.pool, flat])
        keys = np.concatenate([self.key, key])
        order = np.argsort(keys, kind="stable")
        self.key, self.begin, self.size = keys[order], np.concatenate([self.begin, begin])[order], np.concatenate([self.size, size])[order]

    def __call__(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Ids end to end, and the number of ids of each word. The words' bytes are in lower case (LOWER)."""
        tail = (w.end - w.start > 1) & STOP[w.buf[w.end - 1]]
        tail[tail] = LETTER[w.buf[w.end[tail] - 2]]
        word = np.repeat(np.arange(len(w.start)), 1 + tail)
        last = np.append(word[1:] != word[:-1], True)[: len(word)]
        second = last & tail[word]
        start, end = np.where(second, w.end[word] - 1, w.start[word]), np.where(tail[word] & ~second, w.end[word] - 1, w.end[word])
        kinds, first, which = np.unique(ranges(w.prefix, start, end), return_index=True, return_inverse=True)
        for _ in range(2):
            at = np.minimum(np.searchsorted(self.key, kinds), max(len(self.key) - 1, 0))
            new = self.key[at] != kinds if len(self.key) else np.ones(len(kinds), bool)
            if not new.any():
                break
            if len(self.key) + new.sum() > self.held:
                new[:] = True
            self.learn(w, kinds[new], start[first[new]], end[first[new]])
        else:
            at = np.searchsorted(self.key, kinds)
        begin, size = self.begin[at][which], self.size[at][which]
        stop = np.cumsum(size)
        flat = self.pool[np.arange(stop[-1] if len(stop) else 0) + np.repeat(begin - stop + size, size)]
        return flat, np.bincount(word, size, minlength=len(w.start)).astype(np.int64)


_held: dict[int, _Tokens] = {}


def _tokens(vocabulary: str) -> _Tokens:
    """The encoder of this worker, kept between its tasks."""
    key = zlib.crc32(vocabulary.encode())
    if key not in _held:
        _held.clear()
        _held[key] = _Tokens(vocabulary)
    return _held[key]


def pack(
    docs: DataFrame,
    vocabulary: str,
    capacity: int = 2048,
    end_id: int = 1,
    sentence_penalty: int = 16,
    hard_penalty: int = 256,
    block_tokens: int = 2_000_000,
) -> DataFrame:
    """One row per piece (columns of PIECE): a run of a document's ids and its place in a sequence.

    vocabulary is the text of a tokenizers file. A document's ids are those of its text without special tokens,
    then end_id. Documents keep the order of the table within each of its partitions; each run of about
    block_tokens ids is cut into sequences of at most capacity ids by dynamic programming, at document ends (no
    penalty), sentence ends (sentence_penalty) or, in sentences longer than half a sequence, every 1/16 sequence
    (hard_penalty), so that padding plus penalties is least. There is no shuffle. sequence_id is unique but not
    gapless.

    The vocabulary must lower letters and part tokens at white space; then each distinct word is encoded once
    while it is among those a worker holds.
    A null or empty text has end_id alone; a null or repeated doc_id is kept as it is; a document of any length
    is cut like others (one longer than block_tokens is a block of its own). An empty table gives no rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(shared.value)
        sequence = TaskContext.get().partitionId() << 40
        held: list[tuple[list, np.ndarray, np.ndarray, np.ndarray]] = []
        amount = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence, held, amount
            names = [x for h in held for x in h[0]]
            sizes = np.concatenate([h[1] for h in held])
            ids = np.concatenate([h[2] for h in held])
            base = np.cumsum([0, *(len(h[2]) for h in held[:-1])])
            ends = np.concatenate([h[3] + b for h, b in zip(held, base, strict=True)])
            held, amount = [], 0
            doc_end = np.cumsum(sizes)
            cuts = best_cuts(*boundaries(ends, doc_end, capacity, sentence_penalty, hard_penalty), capacity)
            edge = np.union1d(cuts, doc_end)
            begin, stop = np.append(0, edge[edge > 0][:-1]), edge[edge > 0]
            doc = np.searchsorted(doc_end, begin, "right")
            seq = np.searchsorted(cuts, begin, "right") - 1
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), stop.tolist(), strict=True)]
            numbers = (begin - (doc_end - sizes)[doc], stop - begin, np.array(crc, np.int64), sizes[doc], seq + sequence, begin - cuts[seq])
            sequence += len(cuts)
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()).take(pa.array(doc)), *(pa.array(x, pa.int64()) for x in numbers)], [c.split()[0] for c in PIECE.split(", ")])

        for batch in batches:
            for i, j, w in words_of(batch.column(1), table=LOWER):
                flat, count = tokens(w)
                before = np.zeros(len(count) + 1, np.int64)
                np.cumsum(count, out=before[1:])
                n = np.arange(j - i)
                doc_of = np.repeat(n, np.diff(w.word_offs))
                ids = np.full(len(flat) + j - i, end_id, np.uint32)
                ids[np.arange(len(flat)) + np.repeat(doc_of, count)] = flat
                last = SENTENCE_END[w.buf[w.end - 1]] if len(w.end) else np.zeros(0, bool)
                ends = (before[1:] + doc_of)[last]
                held.append((batch.column(0).slice(i, j - i).to_pylist(), np.diff(before[w.word_offs]) + 1, ids, ends))
                amount += len(ids)
                if amount >= block_tokens:
                    yield flush()
        if held:
            yield flush()

    return bounded_batches(docs).select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, PIECE)


def op9_vocabulary() -> str:
    """The text of the public vocabulary that the query packs with."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), op9_vocabulary())
