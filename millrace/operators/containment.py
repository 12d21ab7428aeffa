"""Which texts hold which words, anywhere in them: a join on character grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import empty_if_null
from millrace.sources.tables import staged


def grams(text: Column, size: int) -> Column:
    """The distinct runs of `size` characters of a text, found in one pass over it."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def keyed(words: DataFrame, word: str, size: int) -> DataFrame:
    """words with `__key`: the gram that stands in the fewest other words; a word of fewer than `size` characters is its own key."""
    found = F.when(F.length(word) >= size, grams(F.col(word), size)).otherwise(F.array(word))
    spread = words.select(word).distinct().select(word, F.explode(found).alias("__key"))
    rare = spread.groupBy("__key").agg(F.count("*").alias("__n"))
    best = spread.join(rare, "__key").groupBy(word).agg(F.min(F.struct("__n", "__key"))["__key"].alias("__key"))
    return words.join(best, word)


def holding(texts: DataFrame, text: str, words: DataFrame, word: str, size: int = 4, most_bytes: int = 32 << 20) -> DataFrame:
    """Rows of texts beside each row of words whose word its text holds; all columns of both, whose names must differ.

    A text that holds a word holds each gram of it, so they meet on the word's rarest gram, and what meets is
    looked through. Texts have as many grams as characters: where the words come to no more than `most_bytes`, counted first, they go to
    every task and no gram is shuffled; more words meet hashes of texts in a shuffled join, and the texts
    join what met. Null and empty words are in no text, null texts hold none; repeated rows on either side stay repeated.
    """
    words = staged(words.where(F.length(word) > 0))
    line = F.octet_length(F.to_json(F.struct(*words.columns))) + F.octet_length(word) + 64
    facts = words.agg(F.collect_set(F.least(F.length(word), F.lit(size))).alias("sizes"), F.sum(line).alias("bytes")).first()
    if not facts["sizes"]:
        return texts.join(words, F.lit(False))
    keys = keyed(words, word, size)
    parts = F.explode(F.concat(*(grams(empty_if_null(F.col(text)), n) for n in sorted(facts["sizes"])))).alias("__gram")
    if facts["bytes"] <= most_bytes:
        met = texts.select("*", parts).join(F.broadcast(keys), (F.col("__gram") == F.col("__key")) & F.contains(text, word))
        return met.drop("__gram", "__key")
    hashed = texts.withColumn("__text", F.xxhash64(text))
    pairs = hashed.select("__text", parts).join(keys.select("__key", word), F.col("__gram") == F.col("__key")).select("__text", F.col(word).alias("__word")).distinct()
    met = hashed.join(pairs, "__text").where(F.contains(text, "__word")).drop("__text")
    return met.join(words, F.col("__word") == F.col(word)).drop("__word")
