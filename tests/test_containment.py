import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import retrieval, tagging
from millrace.operators.containment import holding


@pytest.mark.parametrize("most_bytes", [0, 1 << 25])
def test_against_every_pair(spark, most_bytes):
    rng = random.Random(7)
    some = lambda n: "".join(rng.choice("abcé𝒳\n") for _ in range(n))
    texts = [some(rng.randint(0, 60)) for _ in range(150)] + [None, "", "𝒳𝒳𝒳𝒳𝒳", "ab" * 3000]
    words = sorted({some(rng.choice([1, 2, 3, 4, 5, 7, 9])) for _ in range(200)}) + ["ab", "", None, "b.b", "𝒳𝒳𝒳"]
    t = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, text string")
    w = spark.createDataFrame([(i, x) for i, x in enumerate(words)], "j int, word string")
    got = sorted((r.i, r.j) for r in holding(t, "text", w, "word", most_bytes=most_bytes).collect())
    assert got == sorted((i, j) for i, x in enumerate(texts) for j, y in enumerate(words) if x and y and y in x)
    assert holding(t, "text", w.limit(0), "word").count() == 0 and holding(t.limit(0), "text", w, "word").count() == 0


def test_addresses_hold_one_another_across_hosts(spark):
    urls = ["https://a.org/go?u=https://b.org/y", "http://x.org.kr/a", "https://b.org/y//", " https://b.org/y ", "https://b.org", "https://c.org/y", "", None, "/"]
    rows = spark.createDataFrame([(f"c{i}", u) for i, u in enumerate(urls)], "chunk_id string, source_url string")
    expected = spark.createDataFrame([("q1", "https://b.org/y/"), ("q2", "http://x.org"), ("q3", None), ("q3", ""), ("q4", "http://none.org/"), ("q5", "https://b.org/y//")], "qa_id string, url string")
    bare = lambda u: (u or "").strip()[:-1] if (u or "").strip().endswith("/") else (u or "").strip()
    want = {(q, f"c{i}") for q, e in [tuple(r) for r in expected.collect()] for i, u in enumerate(urls) if bare(u) and bare(e) and (bare(e) in bare(u) or bare(u) in bare(e))}
    got = {tuple(r) for r in retrieval.gold_chunks(rows, expected).collect()}
    assert got == want and {("q1", "c0"), ("q2", "c1"), ("q1", "c4"), ("q5", "c3")} <= got


def test_many_addresses_of_one_host_meet_few(spark):
    """A host with many pages: an address meets those that share its rarest run of characters, not all of the host."""
    rows = spark.range(20_000).select(F.concat(F.lit("c"), "id").alias("chunk_id"), F.format_string("https://one.example.org/page/%05d/view", "id").alias("source_url"))
    expected = rows.where(F.col("chunk_id").endswith("7")).select(F.col("chunk_id").alias("qa_id"), F.col("source_url").alias("url"))
    assert sorted(tuple(r) for r in retrieval.gold_chunks(rows, expected).collect()) == sorted((f"c{i}", f"c{i}") for i in range(7, 20_000, 10))


def test_fifty_thousand_aliases(spark):
    aliases = spark.range(50_000).select(F.col("id").cast("int").alias("ord"), F.format_string("alias%05d", "id").alias("alias"), F.format_string("full form %d", "id").alias("full"))
    asked = spark.createDataFrame([("q1", "what is alias00017 or alias49999?"), ("q2", "alias1"), ("q3", None), ("q4", "alias00017 full form 17")], "qa_id string, question string")
    found = tagging.expand_queries(asked, aliases)
    assert {r.qa_id: r.expanded for r in found.collect()} == {"q1": "what is alias00017 or alias49999? full form 17 full form 49999", "q2": "alias1", "q3": "", "q4": "alias00017 full form 17"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_routes_and_rules(spark):
    tools = spark.createDataFrame([("a", 2, ["menu", "lunch"], ["price"]), ("b", 1, ["price"], []), ("c", 3, ["e"], ["never"]), ("d", 0, [], [])], "tool string, priority int, include array<string>, exclude array<string>")
    asked = spark.createDataFrame([("q1", "lunch today"), ("q2", "lunch price"), ("q3", "fee"), ("q4", "xyz"), ("q5", None), ("q6", "lunch never")], "qa_id string, question string")
    assert {r.qa_id: r.tool for r in tagging.route_queries(asked, tools).collect()} == {"q1": "a", "q2": "b", "q3": "c", "q4": None, "q5": None, "q6": "a"}
    rows = spark.createDataFrame([("c1", [1], "https://h.org/en/x", "t"), ("c2", [], "https://h.org/", None), ("c3", None, None, "a title"), ("c1", [1], "https://h.org/en/x", "t")], "chunk_id string, domains array<int>, source_url string, source_title string")
    rules = spark.createDataFrame([(1, ["h.org"], ["/en/"], []), (2, [], [], ["title"]), (3, [], ["title"], ["/en/"])], "domain int, hosts array<string>, url_words array<string>, title_words array<string>")
    found = tagging.domain_matches(rows, rules)
    assert sorted(tuple(r) for r in found.collect()) == [("c1", 1, 3), ("c2", 1, 2), ("c3", 2, 2)]
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
