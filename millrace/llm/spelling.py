"""Spelling variants: words at one edit from a much more frequent one, found by pivotal bigrams."""

from __future__ import annotations

import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.staging import release, staged


def corpus_words(docs: DataFrame, every: int = 199, length: int = 6, least: int = 5) -> DataFrame:
    """(word, n) for each word of at least `length` code points that stands at least `least` times in all texts.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF with only A-Z lower-cased. Where `every` divides the crc32 h of
    `<doc_id>:<run>`, its code point h % length of the run is taken out first (0: never), so that a corpus holds misspelt
    words at known places. Null texts have no words, a null doc_id is written as nothing; repeated rows count again;
    other columns are not read. Only partial counts are shuffled, whatever one word's share.
    """
    text = F.translate(docs["text"], string.ascii_uppercase, string.ascii_lowercase)
    runs = docs.select(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all(text, F.lit(f"[a-zÀ-ÿ]{{{length},}}"), F.lit(0))).alias("run"))
    word = F.col("run")
    if every:
        h = F.crc32(F.concat_ws(":", "doc", "run"))
        at = (h % F.length("run")).cast("int")
        cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        word = F.when(h % every == 0, cut).otherwise(word)
    counted = runs.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where((F.length("word") >= length) & (F.col("n") >= least))


def pivots(word: str, rank: dict[str, int]) -> tuple[list[int], tuple[int, int]]:
    """Places of a word's gram prefix, and its two pivots.

    The prefix has the three rarest bigrams and all that are equal to the third; one edit destroys at most two successive
    bigrams, so three places always hold two that do not overlap. The pivots are the rarest such two, by dynamic
    programming over the places: the best single gram that ends before, and this one.
    """
    grams = [rank[word[k : k + 2]] for k in range(len(word) - 1)]
    last = sorted(grams)[2]
    places = [k for k, g in enumerate(grams) if g <= last]
    best, before, pair, behind = None, None, (0, 0), 0
    for k in places:
        while places[behind] + 2 <= k:
            j = places[behind]
            if before is None or grams[j] < grams[before]:
                before = j
            behind += 1
        if before is not None and (best is None or grams[before] + grams[k] < best):
            best, pair = grams[before] + grams[k], (before, k)
    return places, pair


def pivot_keys(word: str, pair: tuple[int, int]) -> set[tuple[int, int]]:
    """Ranges of the five parts that two pivots cut a word into. One edit touches one part only."""
    a, b = pair
    return {(0, a), (a, a + 2), (a + 2, b), (b, b + 2), (b + 2, len(word))}


def prefix_keys(word: str, places: list[int]) -> set[tuple[int, int]]:
    """Ranges that such a part of a near word can take up in this word, if the pivots left are in this word's gram prefix:
    up to a gram, from a gram on, between two grams, or one to three code points beside a gram."""
    n, first, last = len(word), places[0], places[-1]
    found = {(0, k) for k in places} | {(k + 2, n) for k in places} | {(a + 2, b) for a in places for b in places if a + 2 <= b}
    return found | {(i, i + x) for x in (1, 2, 3) for i in range(n - x + 1) if first + 2 <= i or last >= i + x}


def _keys(rank: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                row, asks, key = [], [], []
                for i, word in enumerate(part.column(0).to_pylist()):
                    places, pair = pivots(word, rank)
                    for asking, ranges in ((True, pivot_keys(word, pair)), (False, prefix_keys(word, places))):
                        for a, b in ranges:
                            row.append(i)
                            asks.append(asking)
                            key.append(f"{word[:a]} {word[b:]}")
                take = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(asks, pa.bool_()), pa.array(key, pa.string()), part.column(0).take(take), part.column(1).take(take)], ["asks", "key", "word", "n"])

    return run


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, an, b, bn), a < b: all pairs of words(word, n) at exactly one inserted, deleted or replaced code point.

    Words are distinct and hold three code points or more. Bigrams are ranked by the number of words they stand in, rarest first. If the pivots of one of two
    near words are no rarer than the other's gram prefix reaches, a pivot that the edit leaves whole is in
    that prefix, at a place that one edit allows; the other direction holds otherwise. An edit lies in one of the five parts that
    the pivots cut a word into, and the other four are equal: they are the key, so that words meet by a pivot, its place and the
    text around it. Every candidate is verified. A key that many words share holds words that differ in
    one part only. No words give no pairs.
    """
    gram = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda k: F.substring("word", k, F.lit(2)))))
    # no more rows than pairs of letters of the words' alphabet
    counts = words.select(gram.alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).orderBy("n", "gram").collect()
    rank = {r["gram"]: i for i, r in enumerate(counts)}
    keys = staged(words.mapInArrow(_keys(rank), "asks boolean, key string, word string, n long").withColumn("key", F.xxhash64("key")))
    one = keys.where("asks").select("key", F.col("word").alias("p"), F.col("n").alias("pn"))
    two = keys.where("not asks").select("key", F.col("word").alias("q"), F.col("n").alias("qn"))
    met = one.join(two, "key").where((F.abs(F.length("p") - F.length("q")) <= 1) & (F.levenshtein("p", "q", 1) == 1))
    ahead = F.col("p") < F.col("q")
    a, b = F.struct(F.col("p").alias("w"), F.col("pn").alias("n")), F.struct(F.col("q").alias("w"), F.col("qn").alias("n"))
    pairs = met.select(F.when(ahead, a).otherwise(b).alias("x"), F.when(ahead, b).otherwise(a).alias("y"))
    pairs = staged(pairs.select(F.col("x.w").alias("a"), F.col("x.n").alias("an"), F.col("y.w").alias("b"), F.col("y.n").alias("bn")).distinct())
    release(keys)
    return pairs


def variants(words: DataFrame, times: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n for each row of words(word, n).

    n_near counts the near words; form is the one with the largest n (ties: the smallest in code-point order) if that is at least `times`
    the word's n, else null; root is where following forms ends. n grows at each step, so there are
    no cycles, and labels that double their reach need a number of rounds that grows with the logarithm of the
    longest chain. An empty table gives no rows.
    """
    words = staged(words)
    pairs = near_pairs(words)
    back = pairs.select(F.col("b").alias("a"), F.col("bn").alias("an"), F.col("a").alias("b"), F.col("an").alias("bn"))
    near = pairs.unionByName(back).groupBy("a", "an").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("bn")).alias("less"), F.col("b").alias("w"))).alias("best"))
    more = -F.col("best.less")
    strong = more >= times * F.col("an")
    near = staged(near.select(F.col("a").alias("word"), "n_near", F.when(strong, F.col("best.w")).alias("form"), F.when(strong, more).alias("form_n")))
    release(pairs)
    roots = near.where("form is not null").select("word", F.col("form").alias("root"))
    kept = None
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = staged(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if kept is not None:
            release(kept)
        roots, kept = moved.select("word", "root"), moved
        if moved.where("moved").isEmpty():
            break
    rows = words.join(near, "word", "left").join(roots, "word", "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def op11_pivotal_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(corpus_words(spark.read.parquet(f"{sf_dir}/documents.parquet")))
