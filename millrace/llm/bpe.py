"""Byte-level BPE: a shuffle of distinct words, each encoded once; decoding joins the token-byte table."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.arrays import chunks, utf8
from millrace.llm.staging import bounded_batches

PART = "block string, kind int, bucket int, payload binary"
ENCODED = "doc_id long, ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a vocabulary file in base64 lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def token_bytes(ranks: dict[bytes, int]) -> list[bytes]:
    """The token-byte table: bytes by id."""
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def _pack(*parts: bytes) -> bytes:
    size = np.array([len(parts), *map(len, parts)], "<u8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(size + b"".join(parts))


def _unpack(payload: bytes) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(payload)
    n = int(np.frombuffer(data[:8], "<u8")[0])
    cuts = 8 + 8 * n + np.append(0, np.cumsum(np.frombuffer(data[8 : 8 + 8 * n], "<u8"))).astype(np.int64)
    return [data[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def _explode(pattern: str, buckets: int, block_bytes: int, kind: int):
    """Of each block of texts: its documents with the places of their pre-tokens (kind 0), or its distinct
    pre-tokens (kind 1) by bucket of their hash, in the order in which the places number them.

    A block is named by its place in the scan and a digest of its documents, so that both kinds of another block never meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).findall
        task, serial = TaskContext.get().partitionId(), 0
        for batch in batches:
            _, offs = utf8(batch.column(1))
            for i, j in chunks(offs, block_bytes):
                seen: dict[str, int] = {}
                number = seen.setdefault
                codes, size = [], []
                for text in batch.column(1).slice(i, j - i).to_pylist():
                    found = find(text) if text else []
                    size.append(len(found))
                    if kind == 0:
                        codes.append(np.fromiter([number(x, len(seen)) for x in found], np.uint32, len(found)))
                    else:
                        seen.update(dict.fromkeys(found, 0))
                words = [x.encode() for x in seen]
                # a stable hash by which all blocks deal a word to the same bucket
                to = np.array([zlib.crc32(x) for x in words], np.int64) % buckets
                order = np.argsort(to, kind="stable")
                renumber = np.empty(len(words), np.uint32)
                renumber[order] = np.arange(len(words), dtype=np.uint32)
                ids = batch.column(0).slice(i, j - i).fill_null(0).to_numpy()
                counts = np.array(size, np.int64)
                block = f"{task}-{serial}-{hashlib.blake2b(ids.tobytes() + counts.tobytes(), digest_size=8).hexdigest()}"
                serial += 1
                if kind == 0:
                    valid = batch.column(0).slice(i, j - i).is_valid().to_numpy(zero_copy_only=False)
                    flat = renumber[np.concatenate(codes)] if words else np.zeros(0, np.uint32)
                    planes = flat.view(np.uint8).reshape(-1, 4).T.copy()  # one plane a byte, for compression
                    rows = [(0, _pack(ids.tobytes(), valid.tobytes(), counts.tobytes(), np.array([len(words)]).tobytes(), planes.tobytes()))]
                else:
                    cut, rows = np.searchsorted(to[order], np.arange(buckets + 1)), []
                    for b in np.flatnonzero(np.diff(cut)).tolist():
                        part = [words[k] for k in order[cut[b] : cut[b + 1]].tolist()]
                        rows.append((b, _pack(b"".join(part), np.array([len(x) for x in part], np.uint32).tobytes())))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block] * len(rows)), pa.array([kind] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["block", "kind", "bucket", "payload"]
                    )

    return run


def _encode(vocabulary, held: int = 200_000):
    """Encodes the words of a bucket; a word that several blocks have is encoded once while it is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encoding = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=vocabulary.value, special_tokens={})  # each word is one match
        encode = encoding.encode_ordinary
        known: OrderedDict[bytes, list[int]] = OrderedDict()
        for batch in batches:
            out = []
            for payload in batch.column(3):
                data, size = _unpack(payload.as_py())
                end = np.cumsum(np.frombuffer(size, np.uint32), dtype=np.int64)
                ids = []
                for a, b in zip([0, *end[:-1].tolist()], end.tolist(), strict=True):
                    word = data[a:b]
                    got = known.get(word)
                    if got is None:
                        got = known[word] = encode(word.decode())
                        if len(known) > held:
                            known.popitem(last=False)
                    ids.append(got)
                count = np.fromiter(map(len, ids), np.uint16 if max(map(len, ids)) < 65536 else np.uint32)
                flat = np.fromiter((x for i in ids for x in i), np.uint32, int(count.sum()))
                out.append(_pack(flat.tobytes(), count.astype(np.uint32).tobytes()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], batch.schema.names)

    return run


def _reassemble(table, keep_ids: bool):
    """Ids of the documents of each block from the ids of its words; and their bytes by the token-byte table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = table.value
        for block in _blocks(batches):
            ids, valid, size, n_words, planes = _unpack(block[0])
            ids, valid, size = np.frombuffer(ids, np.int64), np.frombuffer(valid, bool), np.frombuffer(size, np.int64)
            n = int(size.sum())
            flat = np.frombuffer(planes, np.uint8).reshape(4, n).T.copy().view(np.uint32).ravel() if n else np.zeros(0, np.uint32)
            parts = [_unpack(x) for x in block[1:]]
            count = np.concatenate([np.frombuffer(c, np.uint32) for _, c in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)
            word_ids = np.concatenate([np.frombuffer(x, np.uint32) for x, _ in parts]) if parts else np.zeros(0, np.uint32)
            if len(count) != int(np.frombuffer(n_words, np.int64)[0]):
                raise ValueError("the table gave other rows when it was read again; write it down first")
            del parts, block
            end = np.cumsum(count).tolist()
            texts = [str(x) for x in word_ids.tolist()]
            raw = [tokens[x] for x in word_ids.tolist()]
            start = [0, *end[:-1]]
            spelt = [" ".join(texts[a:b]) for a, b in zip(start, end, strict=True)]
            spelled = [b"".join(raw[a:b]) for a, b in zip(start, end, strict=True)]
            begin, at, rows = np.array(start, np.int64), 0, []
            for doc_id, ok, k in zip(ids.tolist(), valid.tolist(), size.tolist(), strict=True):
                code = flat[at : at + k]
                at += k
                total = int(count[code].sum())
                listed = code.tolist()
                sha = hashlib.sha256(" ".join([spelt[c] for c in listed]).encode()).hexdigest()
                back = hashlib.sha256(b"".join([spelled[c] for c in listed])).hexdigest()
                own = None
                if keep_ids:
                    stop = np.cumsum(count[code])
                    own = word_ids[np.arange(total) + np.repeat(begin[code] - stop + count[code], count[code])].astype(np.int32)
                rows.append((doc_id if ok else None, own, total, sha, back))
                if len(rows) == 256:
                    yield _encoded(rows)
                    rows = []
            if rows:
                yield _encoded(rows)

    return run


def _encoded(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.list_(pa.int32()), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [c.split()[0] for c in ENCODED.split(", ")])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """The payloads of each block, of rows sorted by block, kind and bucket."""
    name, held = None, []
    for batch in batches:
        for block, payload in zip(batch.column(0).to_pylist(), batch.column(3), strict=True):
            if block != name and held:
                yield held
                held = []
            name = block
            held.append(payload.as_py())
    if held:
        yield held


def encode(docs: DataFrame, ranks_path: str, pattern: str, block_bytes: int = 8 << 20, keep_ids: bool = True) -> DataFrame:
    """One row per document (columns of ENCODED): its ids, and digests of the ids and of the bytes decoded from them.

    Texts are cut into pre-tokens by the pattern, each match separately, without special tokens. Each block of
    about block_bytes of text sends its distinct pre-tokens to the bucket of their hash, where each is encoded
    once for all blocks (while it is among those held last); its documents, as numbers of pre-tokens by position, come
    from a second reading of the table, which costs less than moving them along. Both meet by block, where ids are
    put in place of the numbers; if the table gives other rows when read again, that is an error. Rows of a block
    and bucket travel packed and compressed. Decoding looks every id up in the token-byte table, which is broadcast:
    its size is that of the vocabulary.

    A null or empty text has no ids. Null and repeated ids keep their rows; a text longer than a block is a block;
    an empty table gives no rows; columns other than doc_id and text are not read. ids is null unless keep_ids.
    """
    spark = docs.sparkSession
    ranks = read_ranks(ranks_path)
    vocabulary, table = spark.sparkContext.broadcast(ranks), spark.sparkContext.broadcast(token_bytes(ranks))
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = bounded_batches(docs).select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    places, words = (rows.mapInArrow(_explode(pattern, buckets, block_bytes, kind), PART) for kind in (0, 1))
    coded = words.repartition(F.col("bucket")).mapInArrow(_encode(vocabulary), PART)
    return places.unionByName(coded).repartition(F.col("block")).sortWithinPartitions("block", "kind", "bucket").mapInArrow(_reassemble(table, keep_ids), ENCODED)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    coded = encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)
    return coded.drop("ids")
