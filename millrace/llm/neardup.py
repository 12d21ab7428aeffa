"""Near duplicates: order MinHash candidates, verified by banded alignment."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.arrays import mix, prefix, ranges, words_of
from millrace.llm.components import components
from millrace.llm.staging import bounded_batches, release, staged

TOP = np.uint64(2**64 - 1)
BLOCK = 2048
#: shingles of one side that are aligned in one task
WEIGHT = 2_000_000


def labelled(hashes: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the occurrence-labelled k-word shingles of each text, and each text's first.

    A text of 1 to k - 1 words has one shingle, all of it.
    """
    size = np.diff(offs)
    count = np.where(size >= k, size - k + 1, np.minimum(size, 1))
    cuts = np.zeros(len(offs), np.int64)
    np.cumsum(count, out=cuts[1:])
    text = np.repeat(np.arange(len(size)), count)
    start = np.arange(cuts[-1]) - cuts[:-1][text] + offs[:-1][text]
    value = ranges(prefix(hashes), start, np.minimum(start + k, offs[1:][text]))
    key = mix(value + mix(text.astype(np.uint64), 5))
    order = np.argsort(key, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    place = np.arange(len(order))
    nth = np.empty(len(order), np.uint64)
    nth[order] = (place - np.maximum.accumulate(np.where(new, place, 0))).astype(np.uint64)
    return mix(value + nth * np.uint64(0xC2B2AE3D27D4EB4F)), cuts


def sketches(value: np.ndarray, cuts: np.ndarray, repeats: int, keep: int) -> np.ndarray:
    """Order MinHash: per text and repeat, a hash of the `keep` least shingles in text order.

    Texts without a shingle must not be given.
    """
    n = len(cuts) - 1
    seeds = mix(np.arange(1, repeats + 1, dtype=np.uint64), 99) | np.uint64(1)
    bands = np.empty((n, repeats), np.uint64)
    text = np.repeat(np.arange(n), np.diff(cuts))
    for r, seed in enumerate(seeds):
        v = value * seed
        v ^= v >> np.uint64(31)
        places = np.full((n, keep), len(value), np.int64)
        for t in range(keep):
            low = np.minimum.reduceat(v, cuts[:-1])
            at = np.flatnonzero(v == low[text])
            at = at[v[at] != TOP]
            owner, first = np.unique(text[at], return_index=True)
            places[owner, t] = at[first]
            v[at[first]] = TOP
        places.sort(axis=1)
        picked = np.append(value, np.uint64(0))[places]
        h = np.full(n, seed, np.uint64)
        for t in range(keep):
            h = mix(h + picked[:, t], t + 1)
        bands[:, r] = h
    return bands


def signature(value: np.ndarray, cuts: np.ndarray, size: int) -> np.ndarray:
    """One byte of the least shingle under each of `size` hashes: two texts agree in a share of about their similarity."""
    seeds = (mix(np.arange(1, size + 1, dtype=np.uint64), 98) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    short = (value >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(cuts) - 1, size), np.uint8)
    for r, seed in enumerate(seeds):
        least = np.minimum.reduceat(short * seed, cuts[:-1])
        out[:, r] = (least * np.uint32(0x9E3779B1)) >> np.uint32(24)
    return out


SKETCH = "doc_id long, text_key binary, n_shingles int, bands array<long>, least binary"


def _sketch(k: int, repeats: int, keep: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, w in words_of(batch.column(1)):
                used = np.flatnonzero(np.diff(w.word_offs))
                if not len(used):
                    continue
                value, cuts = labelled(w.hash, w.word_offs, k)
                whole = prefix(w.hash), prefix(mix(w.hash, 17))
                key = np.stack([ranges(p, w.word_offs[used], w.word_offs[used + 1]) for p in whole], axis=1)
                part = np.append(cuts[used], cuts[-1])
                bands, least = sketches(value, part, repeats, keep), signature(value, part, size)
                n = len(used)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i).take(pa.array(used)),
                        _bytes(key),
                        pa.array(np.diff(cuts)[used].astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * repeats, pa.int32()), pa.array(bands.ravel().view(np.int64))),
                        _bytes(least),
                    ],
                    [c.split()[0] for c in SKETCH.split(", ")],
                )

    return run


def _bytes(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    width = rows.shape[1] * rows.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows).tobytes())]).cast(pa.binary())


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of rows that agree in the first column, of batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and held[-1].column(0)[-1].as_py() != key[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _signatures(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("least").to_pylist()), np.uint8).reshape(t.num_rows, -1)


def _alike(sig: np.ndarray, size: np.ndarray, row: int, rest: np.ndarray, estimate: float, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Those of rest whose length and estimated similarity to the row allow a link, and the estimates."""
    rest = rest[np.minimum(size[rest], size[row]) >= least * np.maximum(size[rest], size[row])]
    near = (sig[rest] == sig[row]).mean(axis=1)
    return rest[near >= estimate], near[near >= estimate]


def _lead(estimate: float, least: float):
    """Leaders of each block of a bucket and the members that look like them: (bucket, leader, doc_id, parts); leader rows name themselves.

    The next leader is the text nearest to what most of the rest have in each place of the signature, so that a text from
    which others were made leads them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            ids, size, sig = t.column("doc_id").to_numpy(), t.column("n_shingles").to_numpy(), _signatures(t)
            rest = np.arange(len(ids))
            leader, member = [], []
            while len(rest):
                at = 0
                if len(rest) > 2:
                    common = np.array([np.bincount(c).argmax() for c in sig[rest].T], np.uint8)
                    at = int((sig[rest] == common).sum(axis=1).argmax())
                row, rest = rest[at], np.delete(rest, at)
                hit, _ = _alike(sig, size, row, rest, estimate, least)
                rest = np.setdiff1d(rest, hit, assume_unique=True)
                leader.append(np.full(len(hit) + 1, ids[row]))
                member.append(np.append(ids[row], ids[hit]))
            a, b = np.concatenate(leader), np.concatenate(member)
            same = [pa.array(np.full(len(a), t.column(c)[0].as_py())) for c in ("bucket", "parts")]
            yield pa.RecordBatch.from_arrays([same[0], pa.array(a), pa.array(b), same[1]], ["bucket", "leader", "doc_id", "parts"])

    return run


def _apart(t: pa.Table, estimate: float, least: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row of a tile the rows of other components that look like it, and the estimates. Rows of side 0 meet each
    other, those of side 1 meet those of side 2. A pair is given in the first of the sketches that it shares; all
    buckets that hold both have tiles for it."""
    size, sig, part = t.column("n_shingles").to_numpy(), _signatures(t), t.column("component").to_numpy()
    side, band = t.column("side").to_numpy(), t.column("band")[0].as_py()
    bands = t.column("bands").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)[:, :band]
    other = np.flatnonzero(side == 2)
    for row in np.flatnonzero(side < 2):
        rest = other if side[row] else np.arange(row + 1, t.num_rows)
        hit, near = _alike(sig, size, row, rest[part[rest] != part[row]], estimate, least)
        first = ~(bands[hit] == bands[row]).any(axis=1)
        yield row, hit[first], near[first]


def _rest(estimate: float, least: float, most: int):
    """Pairs of a tile's rows of different components that look alike: for each two components the `most` nearest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            ids, part, parts = t.column("doc_id").to_numpy(), t.column("component").to_numpy(), t.column("parts")[0].as_py()
            one, two, close, held = [], [], [], 0
            for row, hit, near in _apart(t, estimate, least):
                if len(hit) > most:
                    order = np.lexsort((-near, part[hit]))
                    own = part[hit][order]
                    order = order[np.arange(len(own)) - np.searchsorted(own, own) < most]
                    hit, near = hit[order], near[order]
                one.append(np.full(len(hit), row))
                two.append(hit)
                close.append(near)
                held += len(hit)
            if held > most:
                x, y, near = np.concatenate(one), np.concatenate(two), np.concatenate(close)
                low, high = np.minimum(part[x], part[y]), np.maximum(part[x], part[y])
                order = np.lexsort((-near, high, low))
                new = np.ones(held, bool)
                new[1:] = (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])
                place = np.arange(held)
                order = order[place - np.maximum.accumulate(np.where(new, place, 0)) < most]
                one, two = [x[order]], [y[order]]
            if held:
                yield _pairs(ids, one, two, parts)

    return run


MARKED = ["tile", "side", "doc_id", "component", "n_shingles"]


def _marked(estimate: float, least: float):
    """The rows of a tile, not their pairs, that look like a row of another component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            marked = np.zeros(t.num_rows, bool)
            for row, hit, _ in _apart(t, estimate, least):
                marked[hit] = True
                marked[row] |= len(hit) > 0
            yield from t.select(MARKED).filter(pa.array(marked)).to_batches()

    return run


def _shingles(k: int):
    """(doc_id, shingles): the labelled shingles of each text in text order, 8 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, w in words_of(batch.column(1)):
                value, cuts = labelled(w.hash, w.word_offs, k)
                rows = [value[cuts[x] : cuts[x + 1]].tobytes() for x in range(j - i)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(rows, pa.binary())], ["doc_id", "shingles"])

    return run


def _sliced(marked: DataFrame) -> DataFrame:
    """marked, dealt to slices of its tiles of about WEIGHT shingles on each side, every two that must meet under one
    `tile`; nearly all tiles are one slice."""
    weight = marked.groupBy("tile", "side").agg(F.ceil(F.sum("n_shingles") / WEIGHT).cast("int").alias("slices"))
    slices = weight.groupBy("tile").agg(*(F.coalesce(F.max(F.when(F.col("side") == x, F.col("slices"))), F.lit(1)).alias(f"s{x}") for x in range(3)))

    def of(number: str) -> Column:
        return F.pmod(F.xxhash64("doc_id"), F.col(number)).cast("int")

    def to(number: str) -> Column:
        return F.sequence(F.lit(0), F.col(number) - 1)

    mine = F.when(F.col("side") == 0, of("s0")).when(F.col("side") == 1, of("s1")).otherwise(of("s2"))
    meets = F.when(F.col("side") == 0, to("s0")).when(F.col("side") == 1, to("s2")).otherwise(to("s1"))
    rows = marked.join(slices, "tile").withColumn("mine", mine).withColumn("its", F.explode(meets))
    first = F.when(F.col("side") == 0, F.least("mine", "its")).when(F.col("side") == 1, F.col("mine")).otherwise(F.col("its"))
    second = F.when(F.col("side") == 0, F.greatest("mine", "its")).when(F.col("side") == 1, F.col("its")).otherwise(F.col("mine"))
    side = F.when(F.col("side") > 0, F.col("side")).when(F.col("mine") == F.col("its"), 0).when(F.col("mine") < F.col("its"), 1).otherwise(2)
    return rows.select(F.xxhash64("tile", first, second).alias("tile"), side.alias("side"), "doc_id", "component")


def joining(ids: np.ndarray, side: np.ndarray, part: np.ndarray, shingles: list[np.ndarray], least: float) -> list[tuple[int, int, float]]:
    """Links of `least` or more that join the components of a tile wherever any link does: at most one less than there
    are components. Shared shingles are counted over all rows at once; only pairs whose unordered similarity reaches
    `least`, and whose components no link has joined so far, are aligned, nearest first."""
    size = np.array([len(x) for x in shingles])
    text = np.repeat(np.arange(len(ids)), size)
    value = np.concatenate(shingles)
    order = np.argsort(value, kind="stable")
    value, text = value[order], text[order]
    label, out = part.copy(), []
    for row in np.flatnonzero(side < 2):
        low, high = np.searchsorted(value, shingles[row], "left"), np.searchsorted(value, shingles[row], "right")
        count = high - low
        first = np.repeat(low - np.cumsum(count) + count, count)
        shared = np.bincount(text[first + np.arange(len(first))], minlength=len(ids))
        fit = (side == 2) if side[row] else (np.arange(len(ids)) > row)
        near = shared / (size + size[row] - shared)
        hit = np.flatnonzero(fit & (label != label[row]) & (near >= least))
        for x in hit[np.argsort(-near[hit], kind="stable")].tolist():
            if label[x] != label[row]:
                similarity = aligned_similarity(shingles[row], shingles[x], least)
                if similarity >= least:
                    out.append((int(ids[row]), int(ids[x]), similarity))
                    label[label == label[x]] = label[row]
    return out


def _joining(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            shingles = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("shingles")]
            links = joining(t.column("doc_id").to_numpy(), t.column("side").to_numpy(), t.column("component").to_numpy(), shingles, least)
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in links], d) for c, d in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["a", "b", "similarity"])

    return run


def _pairs(ids: np.ndarray, one: list[np.ndarray], two: list[np.ndarray], parts: int) -> pa.RecordBatch:
    a, b = ids[np.concatenate(one)], ids[np.concatenate(two)]
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), parts))], ["leader", "doc_id", "parts"])


def _tiles(rows: DataFrame) -> DataFrame:
    """(bucket, doc_id, component, tile, side, parts) for staged rows(bucket, doc_id, component): every two rows of a bucket
    and of different components meet in a tile of about two BLOCKs of rows at most, or one. A component of BLOCK rows or
    more has blocks of its own; smaller ones share blocks, each in one. parts is the bucket's number of blocks."""
    sizes = staged(rows.groupBy("bucket", "component").agg(F.count("*").alias("c")))
    own = F.col("c") >= BLOCK
    whole = sizes.groupBy("bucket").agg(F.sum(F.when(~own, F.col("c"))).alias("n"), F.ceil(F.sum("c") / BLOCK).cast("long").alias("parts"))
    sizes = sizes.join(whole, "bucket").withColumn("own", own)
    nth = F.when(F.col("own"), F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("c") / BLOCK))).otherwise(F.pmod(F.xxhash64("component"), F.ceil(F.col("n") / BLOCK)))
    owner = F.when(F.col("own"), F.col("component"))
    block = F.xxhash64("bucket", F.coalesce(owner.cast("string"), F.lit("")), nth.cast("long"))
    rows = staged(rows.join(sizes, ["bucket", "component"]).select("bucket", "doc_id", "component", "parts", owner.alias("owner"), block.alias("block")))
    blocks = staged(rows.groupBy("block", "bucket", "owner").agg((F.min("component") < F.max("component")).alias("mixed")))
    alone = blocks.where("mixed").select("block", F.col("block").alias("tile"), F.lit(0).alias("side"))
    other = blocks.select("bucket", F.col("block").alias("to"), F.col("owner").alias("its"))
    # a row for every two blocks of a bucket, without their texts
    two = blocks.join(other, "bucket").where("block < to and (owner is null or its is null or owner <> its)").select("block", "to", F.xxhash64("block", "to").alias("tile"))
    two = two.select(F.explode(F.array(F.struct("block", "tile", F.lit(1).alias("side")), F.struct(F.col("to").alias("block"), "tile", F.lit(2).alias("side")))).alias("x")).select("x.*")
    return rows.drop("owner").join(staged(alone.unionByName(two)), "block").drop("block")


def aligned_similarity(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """Shared labelled shingles on an order-keeping alignment, over all of both.

    Only matches within the band that a similarity of `least` leaves are aligned: the places of a matched shingle
    differ by at most the unmatched shingles of both sides.
    """
    total = len(a) + len(b)
    band = total - 2 * int(np.ceil(least * total / (1 + least)))
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    inside = np.abs(i - j) <= band
    i, j = i[inside], j[inside]
    j = j[np.argsort(i)]
    if (j[1:] > j[:-1]).all():
        n = len(j)
    else:
        tails: list[int] = []
        for x in j.tolist():
            at = bisect_left(tails, x)
            tails[at : at + 1] = [x]
        n = len(tails)
    return n / (total - n) if total > n else 1.0


def _verify(k: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.zeros(batch.num_rows)
            shingles = []
            for c in (2, 3):
                rows: list[np.ndarray] = []
                for i, j, w in words_of(batch.column(c), 1 << 20):
                    value, cuts = labelled(w.hash, w.word_offs, k)
                    rows += [value[cuts[x] : cuts[x + 1]].copy() for x in range(j - i)]
                shingles.append(rows)
            for x, (a, b) in enumerate(zip(*shingles, strict=True)):
                score[x] = aligned_similarity(a, b, least)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], ["a", "b", "similarity"])

    return run


def _led(rows: DataFrame, estimate: float, least: float) -> DataFrame:
    """(bucket, leader, doc_id, parts) over rows(bucket, doc_id, n_shingles, least); large buckets are led in blocks, then
    their leaders among themselves, as long as that makes them fewer. No task holds more than a block; parts is the
    number of blocks of the bucket in that turn."""
    out, turn = None, 0
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"))
    schema = "bucket long, leader long, doc_id long, parts long"
    while True:
        parts = F.ceil(F.col("n") / BLOCK).cast("long")
        part = F.pmod(F.xxhash64("doc_id", F.lit(turn)), parts)
        keyed = rows.join(sizes, "bucket").withColumn("block", F.xxhash64("bucket", part)).select("block", "bucket", "doc_id", "n_shingles", "least", parts.alias("parts"))
        led = staged(keyed.repartition("block").sortWithinPartitions("block", "doc_id").mapInArrow(_lead(estimate, least), schema))
        out = led if out is None else out.unionByName(led)
        heads = led.where("leader = doc_id").select("bucket", "doc_id")
        fewer = heads.groupBy("bucket").agg(F.count("*").alias("k")).join(sizes.where(F.col("n") > BLOCK), "bucket")
        sizes = staged(fewer.where(F.col("k") <= 0.9 * F.col("n")).select("bucket", F.col("k").alias("n")))
        if sizes.isEmpty():
            return out
        rows, turn = staged(rows.join(heads.join(sizes.select("bucket"), "bucket"), ["bucket", "doc_id"], "left_semi")), turn + 1


def near_duplicates(docs: DataFrame, k: int = 5, least: float = 0.8, repeats: int = 24, keep: int = 4, size: int = 160, margin: float = 0.09) -> DataFrame:
    """One row per document: doc_id and class_id, the least doc_id of its class.

    Texts of equal words are one text. Each distinct text has `repeats` sketches: its `keep` least
    occurrence-labelled k-word shingles under a hash order, in text order. Texts that agree in a sketch share a
    bucket; in a bucket, texts are compared with leaders by a signature of `size` hashes, and pairs whose estimate is at
    least `least - margin` are verified by aligning their shingles. Then all texts of a bucket that are not linked
    otherwise are compared, in tiles of blocks; first the nearest few of every two classes are verified, and then the
    texts that still look like one of another class meet as shingles, tile by tile, and only links that join classes
    are laid down, no pairs. Links join texts to classes.

    At a similarity of 0.8 a pair shares no sketch with a probability below 1e-5, and is estimated too low with one of
    about 2e-3; both fall steeply above.

    A text that is null, empty or without a word, and a row without a doc_id, is a class of its own (class_id is
    its doc_id). A text of fewer than k words is near only to equal ones. Rows repeating a doc_id give one row
    each; their class is that of any of their texts. Other columns are not read; an empty table gives no rows.
    """
    estimate = least - margin
    rows = bounded_batches(docs).select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    seen = staged(rows.where("doc_id is not null").mapInArrow(_sketch(k, repeats, keep, size), SKETCH))
    texts = seen.groupBy("text_key").agg(F.min("doc_id").alias("rep"))
    member = staged(seen.select("doc_id", "text_key").distinct().join(texts, "text_key").select("doc_id", "rep"))
    reps = staged(seen.join(texts.select(F.col("rep").alias("doc_id"), "text_key"), ["doc_id", "text_key"], "left_semi").dropDuplicates(["doc_id"]).drop("text_key"))
    release(seen)
    spread = reps.select("doc_id", F.posexplode("bands").alias("band", "value")).select("doc_id", F.xxhash64("band", "value").alias("bucket"), "band")
    full = spread.groupBy("bucket").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("bucket")
    hits = spread.join(full, "bucket", "left_semi")
    bucketed = staged(hits.join(reps.select("doc_id", "n_shingles", "least"), "doc_id").select("bucket", "band", "doc_id", "n_shingles", "least"))
    led = _led(bucketed.drop("band"), estimate, least)

    def pairs_of(found: DataFrame) -> DataFrame:
        return found.groupBy(F.least("leader", "doc_id").alias("a"), F.greatest("leader", "doc_id").alias("b")).agg(F.max("parts").alias("parts"))

    pairs = pairs_of(led.where("leader <> doc_id"))
    # texts meet ids by a merge at every size, so that the plan does not change as the table grows
    found = rows.join(bucketed.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")
    body = staged(found.groupBy("doc_id").agg(F.min("text").alias("text")))

    def verified(pairs: DataFrame) -> DataFrame:
        """Pairs with their similarity. A text that is in many pairs of a large bucket is laid down once for each of the
        bucket's parts, so that its pairs meet it in as many tasks."""
        slots = (F.pmod(F.xxhash64(other), F.col("parts")).alias(f"slot_{end}") for end, other in ("ab", "ba"))
        both = pairs = staged(pairs.select("a", "b", "parts", *slots))
        for end in "ab":
            key = [end, "parts", f"slot_{end}"]
            heads = pairs.select(*key).distinct().join(body.select(F.col("doc_id").alias(end), F.col("text").alias(f"t{end}")), end)
            both = both.join(heads, key)
        return staged(both.select("a", "b", "ta", "tb").mapInArrow(_verify(k, least), "a long, b long, similarity double"))

    tried = verified(pairs)
    near = F.col("similarity") >= least
    parts = components(tried.where(near))
    # a bucket whose texts all lead has had all its pairs compared, if it was led in one block
    sizes = bucketed.groupBy("bucket").agg(F.count("*").alias("n"))
    partly = led.where("leader <> doc_id").select("bucket").unionByName(sizes.where(F.col("n") > BLOCK).select("bucket")).distinct()
    inside = staged(bucketed.select("bucket", "doc_id").join(partly, "bucket", "left_semi"))

    def apart() -> DataFrame | None:
        """Tiles of the buckets that hold texts of several components, sorted by tile; None if there are none."""
        label = inside.join(parts, inside["doc_id"] == parts["id"], "left").select("bucket", "doc_id", F.coalesce("component", "doc_id").alias("component"))
        label = staged(label)
        mixed = staged(label.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket"))
        if mixed.isEmpty():
            return None
        again = _tiles(staged(label.join(mixed, "bucket", "left_semi"))).join(bucketed, ["bucket", "doc_id"]).join(reps.select("doc_id", "bands"), "doc_id")
        again = again.select("tile", "side", "band", "parts", "doc_id", "n_shingles", "least", "component", "bands")
        return again.repartition("tile").sortWithinPartitions("tile", "doc_id")

    links = tried.where(near).select("a", "b")
    again = apart()
    if again is not None:
        more = staged(again.mapInArrow(_rest(estimate, least, 4), "leader long, doc_id long, parts long"))
        links = links.unionByName(verified(pairs_of(more).join(tried, ["a", "b"], "left_anti")).where(near).select("a", "b"))
        parts = components(links)
        again = apart()
    if again is not None:
        marked = staged(again.mapInArrow(_marked(estimate, least), "tile long, side int, doc_id long, component long, n_shingles int"))
        wanted = body.join(marked.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")
        values = staged(wanted.mapInArrow(_shingles(k), "doc_id long, shingles binary"))
        met = staged(_sliced(marked)).join(values.hint("merge"), "doc_id").select("tile", "side", "doc_id", "component", "shingles")
        met = met.repartition("tile").sortWithinPartitions("tile", "doc_id")
        links = links.unionByName(staged(met.mapInArrow(_joining(least), "a long, b long, similarity double")).select("a", "b"))
        parts = components(links)
        release(marked, values)
    release(reps, bucketed, body, inside)
    named = member.join(parts, member["rep"] == parts["id"], "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("class_id"))
    return rows.select("doc_id").join(named, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs whose doc_id names its class, with all their columns; of each class one document stays."""
    gone = near_duplicates(docs, **options).where("class_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
