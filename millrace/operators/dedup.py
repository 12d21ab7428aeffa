"""Removing repeated records while keeping the addresses of dropped copies.

A record is a row with chunk_id, text, source_type, source_url, freshness, char_count and seq, its place of arrival.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import clean_text, empty_if_null, normalize_url, null_if_empty, piece_id, sha16, strip
from millrace.operators.chunking import windows

# fixed values
TYPE_RANK = {"T1": 0, "T2": 1, "T3": 2, "T6": 3}
OTHER_RANK = 99


def priority() -> Column:
    """Smaller is better: rank of the type, freshness given, longer text, earlier arrival."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in TYPE_RANK.items() for x in kv])[F.col("source_type")], F.lit(OTHER_RANK))
    length = F.when(F.coalesce(F.col("char_count"), F.lit(0)) > 0, F.col("char_count")).otherwise(F.length(empty_if_null(F.col("text"))))
    return F.struct(rank.alias("rank"), F.when(empty_if_null(F.col("freshness")) != "", 0).otherwise(1).alias("stale"), (-length).alias("short"), F.col("seq").alias("seq"))


def _winners(rows: DataFrame, key: str) -> DataFrame:
    """(key, win): the seq of the best row of each key, by a partial aggregate of short columns."""
    return rows.groupBy(key).agg(F.min("best").alias("best")).select(key, F.col("best.seq").alias("win"))


def _ranked(rows: DataFrame) -> DataFrame:
    """Keys and priorities only; rows without an id stand for themselves."""
    own = F.when(empty_if_null(F.col("chunk_id")) != "", F.col("chunk_id")).otherwise(F.concat(F.lit("#"), F.col("seq").cast("string")))
    return rows.select("seq", own.alias("id_key"), sha16(empty_if_null(F.col("text"))).alias("hash_key"), priority().alias("best"))


def duplicate_map(rows: DataFrame) -> DataFrame:
    """(seq, id_win, text_win): for every row the seq of its id's best row, and of the best row with that row's text.

    The second pass visits ids in the order of their first rows, which breaks its ties. Only keys, hashes and
    priorities are shuffled, not texts. seq must be unique.
    """
    ranked = _ranked(rows)
    by_id = ranked.groupBy("id_key").agg(F.min("best").alias("best"), F.min("seq").alias("first_seq")).select("id_key", F.col("best.seq").alias("id_win"), "first_seq", "best")
    texts = by_id.join(ranked.select(F.col("seq").alias("id_win"), "hash_key"), "id_win")
    second = F.struct("best.rank", "best.stale", "best.short", F.col("first_seq").alias("seq"), F.col("id_win").alias("win"))
    by_text = texts.groupBy("hash_key").agg(F.min(second).alias("b")).select("hash_key", F.col("b.win").alias("text_win"))
    won = texts.join(by_text, "hash_key").select("id_key", "id_win", "text_win")
    return ranked.select("seq", "id_key").join(won, "id_key").select("seq", "id_win", "text_win")


def dedup_by_id(rows: DataFrame) -> DataFrame:
    """The best row of each chunk_id; rows without one all pass."""
    wins = _winners(_ranked(rows), "id_key").select(F.col("win").alias("seq"))
    return rows.join(wins, "seq", "left_semi")


def dedup_by_text(rows: DataFrame) -> DataFrame:
    """After dedup_by_id, the best row of each text."""
    wins = duplicate_map(rows).select(F.col("text_win").alias("seq")).distinct()
    return rows.join(wins, "seq", "left_semi")


def alias_pieces(rows: DataFrame, exact: bool = False, span: int = 4096) -> DataFrame:
    """(winner_seq, winner_chunk_id, piece, place, aliases): for each final winner the rows that it replaced, by arrival, in pieces.

    A piece holds those of `span` successive arrivals, so however many copies a text has, no row and no task holds more of
    them than that; place is the number of aliases in the winner's pieces before it. With exact, the rows that an id's winner replaced follow it
    to the winner of its text only if it was the best of that text so far when it came; else they stay with it, so that a row that is no winner of
    its text may be listed too.
    """
    mapped = duplicate_map(rows)
    lost = mapped.where("seq <> text_win")
    to = F.col("text_win")
    if exact:
        best = _text_pass(rows).select(F.col("seq").alias("id_win"), "best_so_far")
        lost = lost.join(best, "id_win")
        to = F.when((F.col("seq") == F.col("id_win")) | F.col("best_so_far"), F.col("text_win")).otherwise(F.col("id_win"))
    lost = lost.where(F.col("seq") != to).select("seq", to.alias("winner_seq"))
    alias = F.struct("seq", "source_url", "parent_post_id", "chunk_id", "source_type", "source_file")
    winner = rows.select(F.col("seq").alias("winner_seq"), F.col("chunk_id").alias("winner_chunk_id"))
    pieces = lost.join(rows, "seq").groupBy("winner_seq", F.floor(F.col("seq") / span).alias("piece")).agg(F.sort_array(F.collect_list(alias)).alias("aliases"))
    before = Window.partitionBy("winner_seq").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = pieces.join(winner, "winner_seq").withColumn("place", F.coalesce(F.sum(F.size("aliases")).over(before), F.lit(0)))
    return sizes.select("winner_seq", "winner_chunk_id", "piece", "place", "aliases")


def aliases(rows: DataFrame, exact: bool = False) -> DataFrame:
    """(winner_chunk_id, alias_count, aliases): alias_pieces() put together, a row for each winner; for texts with few copies."""
    pieces = alias_pieces(rows, exact).groupBy("winner_seq", "winner_chunk_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("piece", "aliases"))), lambda p: p["aliases"])).alias("aliases"))
    return pieces.select("winner_chunk_id", F.size("aliases").alias("alias_count"), "aliases")


def _text_pass(rows: DataFrame) -> DataFrame:
    """The rows of the second pass (seq, key, best, place), and whether each was better than all earlier ones of its text."""
    ranked = _ranked(rows)
    by_id = ranked.groupBy("id_key").agg(F.min("best").alias("best"), F.min("seq").alias("place"))
    first = by_id.select(F.col("best.seq").alias("seq"), "best", "place").join(ranked.select("seq", F.col("hash_key").alias("key")), "seq")
    return running_best(first)


def dedup_counts(rows: DataFrame) -> DataFrame:
    """One row: of each pass how often a repeated row was dropped (keep) and how often it took the place of the one held (swap)."""
    by_id = running_best(_ranked(rows).select("seq", F.col("id_key").alias("key"), "best", F.col("seq").alias("place")))
    both = by_id.select(F.lit("id").alias("pass_"), "first", "best_so_far").unionByName(_text_pass(rows).select(F.lit("text").alias("pass_"), "first", "best_so_far"))
    of = lambda name, test: F.count_if((F.col("pass_") == name) & ~F.col("first") & test)
    swap = F.col("best_so_far")
    return both.agg(of("id", ~swap).alias("id_keep"), of("id", swap).alias("id_swap"), of("text", ~swap).alias("text_keep"), of("text", swap).alias("text_swap"))


def with_bypass(kept: DataFrame, bypass: DataFrame) -> DataFrame:
    """The kept rows and those that pass by de-duplication: cleaned, their addresses normalised, empty ones dropped."""
    text = clean_text(F.col("text"))
    clean = bypass.withColumns({"text": text, "source_url": normalize_url(empty_if_null(F.col("source_url")))}).withColumn("char_count", F.length("text")).where("text <> ''")
    return kept.unionByName(clean, allowMissingColumns=True)


def alias_urls(aliased: DataFrame) -> DataFrame:
    """(chunk_id, urls): the distinct addresses that are not empty, in order."""
    urls = F.array_distinct(F.filter(F.transform("aliases", lambda a: strip(empty_if_null(a["source_url"]))), lambda u: u != ""))
    return aliased.select(F.col("winner_chunk_id").alias("chunk_id"), urls.alias("urls")).where(F.size("urls") > 0)


def duplicate_groups(rows: DataFrame, top: int = 8, preview: int = 160) -> DataFrame:
    """The largest groups of equal texts, of which those of two rows or more are shown: hash, rows, start of the text."""
    groups = rows.groupBy(sha16(empty_if_null(F.col("text"))).alias("hash")).agg(F.count("*").alias("n"), F.min(F.substring(empty_if_null(F.col("text")), 1, preview)).alias("preview"))
    return groups.orderBy(F.desc("n"), "hash").limit(top).where("n >= 2")


def merge_same_id(rows: DataFrame, mark: str = "cross_tag") -> DataFrame:
    """Rows of one chunk_id become one: the first whose section holds the mark, else the first, gives the single
    fields; domains, categories and notes are united in order; sections are listed once each without `mark/`."""
    marked = F.when(F.instr(empty_if_null(F.col("section_path")), mark) > 0, 0).otherwise(1)
    ordered = lambda c: F.transform(F.sort_array(F.collect_list(F.struct(F.col("seq"), F.col(c).alias("v")))), lambda s: s["v"])
    sections = F.array_sort(F.array_distinct(F.filter(F.collect_list(F.regexp_replace(empty_if_null(F.col("section_path")), f"^{mark}/", "")), lambda s: s != "")))
    return rows.groupBy("chunk_id").agg(
        F.min_by("text", F.struct(marked, F.col("seq"))).alias("text"),
        F.array_distinct(F.flatten(ordered("domains"))).alias("domains"),
        F.array_distinct(F.flatten(ordered("categories"))).alias("categories"),
        F.array_join(F.array_distinct(F.filter(ordered("notes"), lambda n: empty_if_null(n) != "")), " | ").alias("notes"),
        F.array_join(sections, " | ").alias("section_path"),
        F.count("*").alias("n_rows"),
    )


def prepare_new(new: DataFrame, noise: str = "articleNo=", note: str = "added") -> DataFrame:
    """New records for upsert(): noisy addresses dropped, long texts in windows, ids, notes and passages of the pieces.

    A record of one piece keeps its chunk_id and has no parent; pieces of one are named by their number, and its id is
    their parent. The passage is the title, if there is one, and the text.
    """
    text, many = empty_if_null(F.col("text")), F.col("n_pieces") > 1
    cut = new.where(~empty_if_null(F.col("source_url")).contains(noise)).withColumn("pieces", windows(text)).withColumn("n_pieces", F.size("pieces"))
    cut = cut.select("*", F.posexplode("pieces").alias("piece", "piece_text")).drop("pieces")
    title = null_if_empty(empty_if_null(F.col("source_title")))
    passage = F.concat(F.coalesce(F.concat(title, F.lit("\n")), F.lit("")), F.col("piece_text"))
    return cut.withColumns(
        {
            "text": F.col("piece_text"), "chunk_index": F.col("piece"), "char_count": F.length("piece_text"), "parent_post_id": F.when(many, F.col("chunk_id")),
            "notes": F.when(many, F.concat(F.lit("split_from="), F.col("chunk_id"), F.lit(f"|{note}"))).otherwise(F.lit(note)),
            "chunk_id": F.when(many, piece_id(F.col("chunk_id"), F.col("piece"))).otherwise(F.col("chunk_id")), "_passage": passage, "_text_for_bm25": passage,
        }
    ).drop("piece", "piece_text", "n_pieces")


def upsert(rows: DataFrame, new: DataFrame) -> DataFrame:
    """Rows whose source_url is among the new ones are replaced by those; columns that one side lacks are null there."""
    return rows.join(new.select("source_url").distinct(), "source_url", "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_counts(before: DataFrame, after: DataFrame, *columns: str) -> DataFrame:
    """(facet, value, n_before, n_after): rows by each column, before and after."""
    out = None
    for name in columns:
        for df, side in ((before, 0), (after, 1)):
            part = df.groupBy(F.lit(name).alias("facet"), F.col(name).cast("string").alias("value")).agg(*[(F.count("*") if side == k else F.lit(0).cast("long")).alias(c) for k, c in enumerate(("n_before", "n_after"))])
            out = part if out is None else out.unionByName(part)
    return out.groupBy("facet", "value").agg(F.sum("n_before").alias("n_before"), F.sum("n_after").alias("n_after"))


def running_best(rows: DataFrame, span: int = 65_536) -> DataFrame:
    """rows(key, place, best, ...) with first and best_so_far: whether a row is the first of its key, and better than all before.

    best is a priority(), of which the last field, the arrival, does not count; place orders the rows. Minima are taken
    over spans of places first, so that no task goes through a whole key.
    """
    rank = F.col("best").dropFields("seq")
    cut = rows.withColumn("span", F.floor(F.col("place") / span)).withColumn("rank", rank)
    spans = cut.groupBy("key", "span").agg(F.min("rank").alias("low"))
    upto = Window.partitionBy("key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("key", "span", F.min("low").over(upto).alias("earlier"))
    inside = Window.partitionBy("key", "span").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.join(spans, ["key", "span"]).withColumn("inside", F.min("rank").over(inside))
    known = F.when(F.col("earlier").isNull(), F.col("inside")).when(F.col("inside").isNull() | (F.col("earlier") <= F.col("inside")), F.col("earlier")).otherwise(F.col("inside"))
    return cut.withColumn("before", known).withColumns({"first": F.col("before").isNull(), "best_so_far": F.col("before").isNull() | (F.col("rank") < F.col("before"))}).drop("span", "rank", "earlier", "inside", "before")
