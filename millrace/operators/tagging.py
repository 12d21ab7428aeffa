"""Tagging records and queries by rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import empty_if_null, text_score
from millrace.operators.containment import holding
from millrace.sources.tables import staged


def has_any(text: Column, words: Column) -> Column:
    return F.exists(words, lambda w: F.contains(text, w))


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://([^/?#]+)", 1)


def cross_tag(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """A copy of a row for every rule whose prefix is one of its categories or a dotted start of one.

    rules has rule, prefix, add_domains and add_categories. Copies have the united, sorted domains and categories, and the
    rule in section_path. Rows meet rules on the dotted starts of their categories, each start once.
    """
    starts = F.transform("categories", lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, r"\."))), lambda n: F.array_join(F.slice(F.split(c, r"\."), 1, n), ".")))
    return rows.withColumn("prefix", F.explode(F.array_distinct(F.flatten(starts)))).join(rules, "prefix").select(
        *[c for c in rows.columns if c not in ("domains", "categories", "section_path")],
        "rule",
        F.array_sort(F.array_union("domains", "add_domains")).alias("domains"),
        F.array_sort(F.array_union("categories", "add_categories")).alias("categories"),
        F.concat(F.lit("cross_tag/"), empty_if_null(F.col("section_path"))).alias("section_path"),
    )


def cross_tag_summary(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows and characters that each rule tags; rules without any are kept."""
    found = cross_tag(rows, rules).groupBy("rule").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    return rules.select("rule").join(found, "rule", "left").select("rule", F.coalesce("n", F.lit(0)).alias("n_chunks"), F.coalesce("chars", F.lit(0)).alias("n_chars"))


def domain_matches(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """(chunk_id, domain, match): 1 if the row carries the domain, plus 2 if host, address or title hold a rule's word.

    rules (one a domain) has domain, hosts, url_words and title_words, and may be as many as they like. Domains and hosts
    meet by equality, words by containment.holding(); only short columns take part. Rows alike in id, domains, address and
    title count once.
    """
    short = rows.select("chunk_id", "domains", empty_if_null(F.col("source_url")).alias("url"), empty_if_null(F.col("source_title")).alias("title")).distinct()
    short = staged(short.withColumn("row", F.xxhash64("chunk_id", "domains", "url", "title")))
    kind = lambda k, c: F.struct(F.lit(k).alias("kind"), c.cast("string").alias("value"))
    named = short.select("chunk_id", "row", F.explode(F.concat(F.transform(F.coalesce("domains", F.array()), lambda d: kind("domain", d)), F.array(kind("host", url_host(F.col("url")))))).alias("x"))
    names = rules.select("domain", F.explode(F.concat(F.array(kind("domain", F.col("domain"))), F.transform("hosts", lambda h: kind("host", h)))).alias("x"))
    equal = named.select("chunk_id", "row", "x.*").join(names.select("domain", "x.*"), ["kind", "value"]).select("chunk_id", "row", "domain", F.when(F.col("kind") == "domain", 1).otherwise(2).alias("match"))
    told = short.select("chunk_id", "row", F.explode(F.array(kind("url", F.col("url")), kind("title", F.col("title")))).alias("x")).select("chunk_id", "row", F.col("x.kind").alias("where"), "x.value")
    words = rules.select("domain", F.explode(F.concat(F.transform("url_words", lambda w: kind("url", w)), F.transform("title_words", lambda w: kind("title", w)))).alias("x")).select("domain", "x.kind", F.col("x.value").alias("word"))
    held = holding(told, "value", words, "word").where("where = kind").select("chunk_id", "row", "domain", F.lit(2).alias("match"))
    return equal.unionByName(held).groupBy("chunk_id", "row", "domain").agg(F.bit_or("match").alias("match")).drop("row")


def pool_candidates(rows: DataFrame, rules: DataFrame, extra: tuple[str, tuple[str, ...], int, int] | None = None) -> DataFrame:
    """(domain, chunk_id, seq, score): each record's best score in each domain: five times the match plus the text's score.

    extra (host, words, domain, score) adds the records of a host whose texts hold one of the words to a domain, at that score.
    """
    scored = rows.select("chunk_id", "seq", text_score(F.col("text")).alias("text_score"))
    found = domain_matches(rows, rules).distinct().join(scored, "chunk_id").where("text_score > 0").select("domain", "chunk_id", "seq", (5 * F.col("match") + F.col("text_score")).alias("score"))
    if extra:
        host, words, domain, score = extra
        told = (url_host(empty_if_null(F.col("source_url"))) == host) & has_any(empty_if_null(F.col("text")), F.array(*map(F.lit, words)))
        found = found.unionByName(rows.where(told).select(F.lit(domain).alias("domain"), "chunk_id", "seq", F.lit(score).alias("score")))
    best = Window.partitionBy("domain", "chunk_id").orderBy(F.desc("score"), "seq")
    return found.withColumn("nth", F.row_number().over(best)).where("nth = 1").drop("nth")


def sample_pool(candidates: DataFrame, rows: DataFrame, size: int = 80, cut: int = 1500, mark: str = " ...[truncated]") -> DataFrame:
    """Per domain the `size` best of pool_candidates() for question writing, with the starts of their texts."""
    top = Window.partitionBy("domain").orderBy(F.desc("score"), "chunk_id")
    best = candidates.withColumn("nth", F.row_number().over(top)).where(F.col("nth") <= size)
    text = F.when(F.length("text") > cut, F.concat(F.substring("text", 1, cut), F.lit(mark))).otherwise(F.col("text"))
    return best.join(rows.select("seq", text.alias("text")), "seq").select("domain", "chunk_id", "score", "text")


def pool_summary(candidates: DataFrame, size: int = 80) -> DataFrame:
    """(domain, n_candidates, n_pool): what each domain has to choose from, and what is chosen."""
    return candidates.groupBy("domain").agg(F.count("*").alias("n_candidates"), F.least(F.count("*"), F.lit(size)).alias("n_pool"))


def keyword_tags(rows: DataFrame, words: DataFrame) -> DataFrame:
    """(chunk_id, tag) for every tag one of whose words is in the text; words has tag and word."""
    return holding(rows.select("chunk_id", "text"), "text", words.select("tag", "word"), "word").select("chunk_id", "tag").distinct()


def tag_quality(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Precision and recall of (chunk_id, tag) pairs against true ones, by tag."""
    both = found.distinct().withColumn("f", F.lit(1)).join(truth.distinct().withColumn("t", F.lit(1)), ["chunk_id", "tag"], "full")
    hit, f, t = F.count_if((F.col("f") == 1) & (F.col("t") == 1)), F.count("f"), F.count("t")
    return both.groupBy("tag").agg(hit.alias("hits"), f.alias("n_found"), t.alias("n_true"), (hit / F.greatest(f, F.lit(1))).alias("precision"), (hit / F.greatest(t, F.lit(1))).alias("recall"))


def recent(rows: DataFrame, today: str, years: int = 2, exempt: str | None = None) -> DataFrame:
    """Rows posted in the last `years` years, undated rows, and those whose title matches the exempt pattern."""
    keep = F.to_date("posted_at").isNull() | (F.to_date("posted_at") >= F.add_months(F.lit(today).cast("date"), -12 * years))
    return rows.where(keep | empty_if_null(F.col("source_title")).rlike(exempt) if exempt else keep)


def stale(rows: DataFrame, periods: dict[str, int], today: str) -> DataFrame:
    """Rows due for another crawl: crawled longer ago than their freshness allows, in days; with their due date."""
    days = F.create_map(*[F.lit(x) for kv in periods.items() for x in kv])[F.col("freshness")]
    due = F.date_add(F.to_date("crawled_at"), days)
    return rows.withColumn("due", due).where(F.col("due") <= F.lit(today).cast("date"))


def expand_queries(queries: DataFrame, aliases: DataFrame, guarded: bool = True) -> DataFrame:
    """(qa_id, expanded): the question and each full form whose alias is in it, by the order of the dictionary.

    aliases has ord, alias and full; those that begin with an underscore are comments, and an empty one is in no question. Guarded, a full form
    that is in the question, or was added, is left out.
    """
    asked = queries.select("qa_id", "question")
    used = holding(asked, "question", aliases.select("ord", "alias", "full").where(~F.col("alias").startswith("_")), "alias")
    if guarded:
        used = used.where(~F.contains(F.col("question"), F.col("full")))
    pair = asked.select("*", F.lit(None).alias("ord"), F.lit(None).alias("full")).unionByName(used.select("qa_id", "question", "ord", "full"))
    forms = F.filter(F.transform(F.sort_array(F.collect_list(F.struct("ord", "full"))), lambda s: s["full"]), lambda f: f.isNotNull())
    forms = F.array_distinct(forms) if guarded else forms
    return pair.groupBy("qa_id").agg(F.array_join(F.concat(F.array(F.first("question")), forms), " ").alias("expanded"))


def route_queries(queries: DataFrame, tools: DataFrame) -> DataFrame:
    """(qa_id, tool): the tool of least priority one of whose words is in the question and none of whose exclusions is.

    tools has tool, priority, include and exclude; tool is null if none fits.
    """
    asked = queries.select("qa_id", "question")
    word = lambda c, out: F.transform(c, lambda w: F.struct(w.alias("word"), F.lit(out).alias("out")))
    words = tools.select("tool", "priority", F.explode(F.concat(word("include", False), word("exclude", True))).alias("x")).select("tool", "priority", "x.*")
    found = holding(asked, "question", words, "word").groupBy("qa_id", "question", "tool", "priority").agg(F.bool_or("out").alias("out")).where("not out")
    every = asked.select("qa_id", F.lit(None).cast("string").alias("tool"), F.lit(None).cast("int").alias("priority"))
    return every.unionByName(found.select("qa_id", "tool", "priority")).groupBy("qa_id").agg(F.min_by("tool", "priority").alias("tool"))
