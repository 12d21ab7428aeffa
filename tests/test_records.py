import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import chunking, dedup, evaluation, retrieval, tagging
from millrace.plans import corpus
from millrace.sources import files

CHUNK = "seq int, chunk_id string, text string, source_type string, freshness string, char_count int, source_url string, parent_post_id string, source_file string"


def chunk(spark, rows):
    return spark.createDataFrame([(*r, f"u{r[0]}", None, "f") for r in rows], CHUNK)


def test_dedup_by_id_then_text(spark):
    rows = chunk(spark, [
        (0, "a", "long text", "T2", None, 9), (1, "a", "other", "T1", None, 5), (2, "b", "other", "T1", "static", 5), (3, None, "x", "T1", None, 1), (4, None, "x", "T1", None, 1),
        (5, "c", "tie", "T1", None, 3), (6, "c", "eit", "T1", None, 3), (7, "d", None, "T9", None, None),
    ])
    assert sorted(r["seq"] for r in dedup.dedup_by_id(rows).collect()) == [1, 2, 3, 4, 5, 7]
    assert sorted(r["seq"] for r in dedup.dedup_by_text(rows).collect()) == [2, 3, 5, 7]
    again = dedup.dedup_by_text(rows)
    assert sorted(r["seq"] for r in dedup.dedup_by_text(again).collect()) == [2, 3, 5, 7]
    listed = {r["winner_chunk_id"]: [a["seq"] for a in r["aliases"]] for r in dedup.aliases(rows).collect()}
    assert listed == {"b": [0, 1], None: [4], "c": [6]}
    urls = {r["chunk_id"]: r["urls"] for r in dedup.alias_urls(dedup.aliases(rows)).collect()}
    assert urls["b"] == ["u0", "u1"]


def test_running_best(spark):
    rows = chunk(spark, [(0, "a", "x", "T2", None, 1), (1, "a", "x", "T6", None, 9), (2, "a", "x", "T1", None, 1), (3, "a", "x", "T1", None, 1)])
    assert [r["best_so_far"] for r in dedup.running_best(rows.withColumns({"key": F.col("chunk_id"), "place": F.col("seq"), "best": dedup.priority()})).orderBy("seq").collect()] == [True, False, True, False]


@pytest.mark.parametrize(("n", "pieces"), [(0, 1), (2000, 1), (2001, 2), (2800, 2), (2801, 2), (3300, 3), (81437, 63)])
def test_windows_rebuild_the_text(spark, n, pieces):
    text = "".join(chr(97 + i % 26) for i in range(n))
    row = spark.createDataFrame([(text,)], "t string").select(chunking.windows(F.col("t")).alias("w")).first()["w"]
    assert len(row) == pieces or n == 2801 and len(row) == 3
    assert row[0] + "".join(w[200:] for w in row[1:]) == text and all(len(w) <= (1500 if n > 2000 else 2000) for w in row)


def test_split_records_strategies(spark):
    article = "".join(f"\n제{i}조(뜻) " + "가" * 900 for i in range(1, 4))
    paragraphs = "\n\n".join(["나" * 900] * 3)
    plain = "다" * 2001
    rows = [("a", article, None, None, 0), ("p", paragraphs, "up", "n", 4), ("w", plain, None, None, 0), ("s", "short", None, None, 9)]
    got = {}
    for r in chunking.split_records(spark.createDataFrame(rows, "chunk_id string, text string, parent_post_id string, notes string, chunk_index int").withColumn("orig", F.col("chunk_id"))).collect():
        got.setdefault(r["orig"], []).append(r)
    assert [len(got[k]) for k in "apws"] == [3, 3, 2, 1]
    assert {r["strategy"] for r in got["a"]} == {"article"} and {r["strategy"] for r in got["p"]} == {"separator"}
    assert got["a"][0]["parent_post_id"] == "a" and got["p"][0]["parent_post_id"] == "up" and got["p"][0]["notes"] == "n | split_from=p"
    assert got["s"][0]["chunk_index"] == 9 and got["s"][0]["chunk_id"] == "s"
    assert sorted(r["chunk_index"] for r in got["p"]) == [0, 1, 2]


def merge_by_hand(texts):
    out, acc = [], None
    for t in texts:
        acc = t if acc is None else acc + ("" if acc.endswith("\n") else "\n\n") + t
        if len(acc) >= 50:
            out.append(acc)
            acc = None
    if acc is not None:
        if out:
            out[-1] = out[-1] + ("" if out[-1].endswith("\n") else "\n\n") + acc
        else:
            out.append(acc)
    return out


def test_merge_small_against_a_fold(spark):
    groups = {"p1": ["x"], "p2": ["x", "y" * 60], "p3": ["y" * 60, "x"], "p4": ["a" * 20, "b" * 20, "c" * 20, "d"], "p5": ["a" * 49 + "\n", "b"], "p6": ["z" * 80] * 3, "p7": ["q"] * 30, None: ["tiny", "tiny"]}
    rows = [("f", p, i, f"{p}{i}", t) for p, ts in groups.items() for i, t in enumerate(ts)]
    table = spark.createDataFrame(rows, "source_file string, parent_post_id string, chunk_index int, chunk_id string, text string")
    got = {}
    for r in chunking.merge_small(table).orderBy("chunk_index").collect():
        got.setdefault(r["parent_post_id"], []).append(r["text"])
    assert got == {p: ts if p is None else merge_by_hand(ts) for p, ts in groups.items()}
    assert chunking.merge_small(table.limit(0)).count() == 0


def test_cross_tag_takes_dotted_prefixes(spark):
    rows = spark.createDataFrame([(1, "c", [2], ["6.1"], "s"), (2, "c", [2], ["6.10"], None), (3, "c", [2], ["6.1.2"], "s")], "seq int, text string, domains array<int>, categories array<string>, section_path string")
    rules = spark.createDataFrame([("r", "6.1", [9, 2], ["6.6"]), ("n", "7", [], [])], "rule string, prefix string, add_domains array<int>, add_categories array<string>")
    got = {r["seq"]: (r["domains"], r["categories"], r["section_path"]) for r in tagging.cross_tag(rows, rules).collect()}
    assert got == {1: ([2, 9], ["6.1", "6.6"], "cross_tag/s"), 3: ([2, 9], ["6.1.2", "6.6"], "cross_tag/s")}
    assert {r["rule"]: r["n_chunks"] for r in tagging.cross_tag_summary(rows, rules).collect()} == {"r": 2, "n": 0}


def test_expand_queries(spark):
    queries = spark.createDataFrame([("q1", "컴공 졸업"), ("q2", "기계과 and 기계공학과"), ("q3", "none")], "qa_id string, question string")
    aliases = spark.createDataFrame([(1, "컴공", "컴퓨터공학"), (2, "기계과", "기계공학과"), (3, "기공", "기계공학과"), (4, "_comment", "x")], "ord int, alias string, full string")
    got = {r["qa_id"]: r["expanded"] for r in tagging.expand_queries(queries, aliases).collect()}
    assert got == {"q1": "컴공 졸업 컴퓨터공학", "q2": "기계과 and 기계공학과", "q3": "none"}
    raw = {r["qa_id"]: r["expanded"] for r in tagging.expand_queries(queries, aliases, guarded=False).collect()}
    assert raw["q2"] == "기계과 and 기계공학과 기계공학과"


def test_articles_of_both_brackets_and_exact_blank_lines(spark):
    long = "가" * 400
    article = "\n".join(f"제{k}조（x） {long}" for k in range(1, 7))
    loose = ("a" * 1200) + "\n \n" + ("b" * 1200)
    strict = ("a" * 1200) + "\n\n\n" + ("b" * 1200)
    items = "\n".join(f"{k}. {long}" for k in range(1, 7))
    rows = [("r", article), ("l", loose), ("s", strict), ("n", items), ("w", "w" * 2001), ("k", "short")]
    table = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], "chunk_id string, text string, parent_post_id string, notes string, chunk_index int")
    got = {}
    for r in chunking.split_records(table).orderBy("chunk_index").collect():
        got.setdefault(r["notes"][-1] if r["notes"] else r["chunk_id"], []).append((r["strategy"], r["char_count"]))
    assert [x for x, _ in got["r"]] == ["article"] * 6 and got["s"] == [("separator", 1200)] * 2
    assert got["l"] == [("window", 1500), ("window", 1103)] and [x for x, _ in got["n"]] == ["separator"] * 6
    assert got["w"] == [("window", 1500), ("window", 701)] and got["k"] == [("none", 5)]


def test_merged_records_unite_what_they_carry(spark):
    rows = [("f", "p", 0, "a", "x", [3], ["1.2"], None), ("f", "p", 1, "b", "y" * 60, [1, 3], ["1.1"], "seen"), ("f", "p", 2, "c", "z", [9], [], None), ("f", "", 0, "d", "alone", [1], [], None), (None, "q", 0, "e", "", [2], [], None)]
    table = spark.createDataFrame(rows, "source_file string, parent_post_id string, chunk_index int, chunk_id string, text string, domains array<int>, categories array<string>, notes string")
    got = {(r["parent_post_id"], r["text"][:1]): r for r in chunking.merge_small(table).collect()}
    one = got["p", "x"]
    assert (one["n_merged"], one["domains"], one["categories"], one["chunk_index"]) == (3, [1, 3, 9], ["1.1", "1.2"], 0)
    assert one["notes"] == "merged_with=b | merged_with=c" and one["text"] == "x\n\n" + "y" * 60 + "\n\nz"
    assert got["", "a"]["n_merged"] == 1 and got["q", ""]["chunk_id"] == "e" and len(got) == 3


def test_sections_take_loose_separators(spark):
    rows = [("a>b > c", "2", "two", [2], ["y"], "u2"), (" a > b", "1", "one", [1], ["x"], "u1"), ("alone", "3", "three", [1], [], "u3"), (None, "4", "x" * 3000, [1], [], "u4")]
    table = spark.createDataFrame(rows, "section_path string, chunk_id string, text string, domains array<int>, categories array<string>, source_url string")
    got = {r["section"]: r for r in chunking.merge_by_section(table).collect()}
    assert got["a > b"]["text"] == "[a > b]\none\ntwo" and got["a > b"]["source_url"] == "u1" and got["a > b"]["domains"] == [1, 2]
    assert got["alone"]["text"] == "[alone]\nthree" and got[""]["char_count"] == 2000
    others, cells = chunking.route_cells(table, F.col("section_path").contains(">"))
    assert (others.count(), cells.count()) == (2, 2)


def test_running_best_over_spans(spark):
    rng = random.Random(5)
    rows = [(k, str(rng.randint(0, 3)), rng.choice(["T1", "T2", "T9"]), rng.choice([None, "static"]), rng.randint(1, 5)) for k in range(400)]
    table = spark.createDataFrame(rows, "place long, key string, source_type string, freshness string, char_count int").withColumns({"seq": F.col("place"), "text": F.lit("")})
    got = {r["place"]: (r["first"], r["best_so_far"]) for r in dedup.running_best(table.withColumn("best", dedup.priority()), span=16).collect()}
    held = {}
    for place, key, kind, fresh, n in rows:
        rank = (dedup.TYPE_RANK.get(kind, 99), 0 if fresh else 1, -n)
        assert got[place] == (key not in held, key not in held or rank < held[key])
        held[key] = min(rank, held.get(key, rank))


def test_holders_meet_on_inner_tokens(spark):
    rows = spark.createDataFrame([("c1", "say the quick brown fox jumps"), ("c2", "quick brown"), ("c3", None), ("c4", "The Quick Brown fox")], "chunk_id string, text string")
    asked = spark.createDataFrame([("q1", "e quick brown fo"), ("q2", "quick"), ("q3", "brown fox never")], "qa_id string, question string")
    got = {(r["qa_id"], r["chunk_id"]) for r in retrieval.holders(rows, asked).collect()}
    assert got == {("q1", "c1"), ("q2", "c1"), ("q2", "c2")}
    assert evaluation.validate_raw(spark.createDataFrame([(1, "no json")], "seq int, raw string"), spark.createDataFrame([], "qa_id string")).first()["errors"][1:3] == ["no id", "domain"]


@pytest.mark.parametrize("index", ["own", "null", "equal"])
def test_merge_small_of_a_parent_over_many_ranges(spark, index):
    """One parent takes up several ranges of rows; tiny rows leave outputs open from one range to the next."""
    rng = random.Random(8)
    texts = [rng.choice(["a", "bb\n", "", "c" * 30, "d" * 70, "e" * 49]) for _ in range(600)] + ["f"] * 900 + [""] * 40 + ["g"]
    at = {"own": lambda i: i, "null": lambda i: None, "equal": lambda i: 5}[index]
    rows = [("f", "hot", at(i), f"{i:05d}", t) for i, t in enumerate(texts)] + [("f", f"p{i}", 0, "x", "tiny") for i in range(50)]
    table = spark.createDataFrame(rows, "source_file string, parent_post_id string, chunk_index int, chunk_id string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = chunking.merge_small(table).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r["text"] for r in got if r["parent_post_id"] == "hot") == sorted(merge_by_hand(texts))
    assert sum(r["n_merged"] for r in got) == len(rows) and sum(r["parent_post_id"] != "hot" for r in got) == 50


def test_neighbours_in_runs_and_without_a_parent(spark):
    rows = [("p", i, f"c{i:03d}", f"t{i}") for i in range(100)] + [("q", None, f"n{i}", f"n{i}") for i in range(9)] + [(None, 1, "x", "x"), (None, 2, "y", None), ("r", 7, "z", "z")]
    table = spark.createDataFrame(rows, "parent_post_id string, chunk_index int, chunk_id string, text string")
    for reach in (1, 2):
        got = {r["chunk_id"]: r["context"] for r in chunking.neighbour_context(table, table, reach, span=8).collect()}
        own = [f"t{i}" for i in range(100)]
        assert all(got[f"c{i:03d}"] == "\n".join(own[max(0, i - reach) : i + reach + 1]) for i in range(100))
        assert got["n4"] == "\n".join(f"n{i}" for i in range(4 - reach, 5 + reach)) and (got["x"], got["y"], got["z"]) == ("x", "", "z")
    assert chunking.neighbour_context(table, table.limit(0)).count() == 0


def test_alias_pieces_of_a_text_with_many_copies(spark):
    rows = chunk(spark, [(k, f"id{k}", "same" if k % 3 else f"own {k}", "T1", None, 4) for k in range(300)])
    pieces = dedup.alias_pieces(rows, span=16).orderBy("piece").collect()
    assert {r["winner_chunk_id"] for r in pieces} == {"id1"} and all(len(r["aliases"]) <= 16 for r in pieces) and len(pieces) == 19
    assert [a["seq"] for r in pieces for a in r["aliases"]] == [k for k in range(2, 300) if k % 3]
    assert [r["place"] for r in pieces] == [sum(len(q["aliases"]) for q in pieces[:i]) for i in range(len(pieces))]


def test_upsert_by_address(spark, tmp_path):
    path = str(tmp_path / "table")
    old = [(f"c{i}", f"http://a/{i % 50}", "x", "ko") for i in range(200)] + [("n", None, "x", "ko")]
    fields = "chunk_id string, source_url string, text string, lang string"
    files.write_by_address(spark.createDataFrame(old, fields), path, parts=16)
    listed = lambda: {str(p) for p in (tmp_path / "table").rglob("*.parquet")}
    was = listed()
    new = [("d1", "http://a/3", "y"), ("d2", "http://a/3", "y"), ("d3", "http://new", "y"), ("d4", None, "y")]
    counts = files.upsert_by_address(spark, path, spark.createDataFrame(new, "chunk_id string, source_url string, text string"), "text", parts=16)
    want = {r[:3] for r in old if r[1] != "http://a/3"} | set(new)
    got = files.read_by_address(spark, path)
    assert {tuple(r) for r in got.select("chunk_id", "source_url", "text").collect()} == want and got.count() == len(want)
    now, part = listed(), lambda f: f.split("url_part=")[1].split("/")[0]
    touched = {part(f) for f in now - was}
    assert 1 <= len(touched) <= 3 and {part(f) for f in was - now} <= touched and len(was & now) >= 10
    change = {r.value: r.n_after - r.n_before for r in counts.collect()}
    assert change == {"x": -4, "y": 4}
    files.upsert_by_address(spark, path, spark.createDataFrame([], fields), parts=16)
    assert listed() == now
    with pytest.raises(ValueError, match="other"):
        files.upsert_by_address(spark, path, spark.createDataFrame([("c", "u", 1)], "chunk_id string, source_url string, other int"), parts=16)


def test_threshold_sweep_by_brute_force(spark):
    """More thresholds than rows, repeated and null ones, scores equal to thresholds, rows that count for nothing."""
    from millrace.operators.evaluation import threshold_sweep

    rows = [(k % 5 > 0, None if k % 11 == 0 else (k * 37 % 400) / 400, k % 3 // 2, k % 2 == 0, None if k % 13 == 0 else k % 7 == 0) for k in range(500)]
    asked = [k / 12_000 for k in range(12_000)] + [0.25, 0.25, 2.0, -1.0, None]
    schema = "used_fallback boolean, top_rerank_score double, judge_score int, gold_in_sources boolean, is_fallback_expected boolean, x int, range string"
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], schema)
    got = sorted(map(tuple, threshold_sweep(table, spark.createDataFrame([(t,) for t in asked], "t double")).collect()), key=repr)

    def swept(t):
        freed = [r for r in rows if t is not None and r[0] and r[1] is not None and r[1] >= t]
        won, lost = sum(r[2] == 0 and r[3] for r in freed), sum(bool(r[4]) for r in freed)
        return t, len(freed), won, lost, won - lost

    few = {t: swept(t) for t in set(asked)}
    assert got == sorted((few[t] for t in asked), key=repr)
    empty = spark.createDataFrame([], schema)
    assert [tuple(r) for r in threshold_sweep(empty, spark.createDataFrame([(0.5,)], "t double")).collect()] == [(0.5, 0, 0, 0, 0)]
    assert threshold_sweep(table, spark.createDataFrame([], "t double")).count() == 0


def test_merge_small_deals_ranges_by_their_rows(spark, monkeypatch):
    """Ranges hold about `span` rows whatever Spark coalesces, and outputs go on across them."""
    kind, asked = type(spark.range(1)), []
    deal = kind.repartitionByRange
    monkeypatch.setattr(kind, "repartitionByRange", lambda self, *by: asked.append(by[0]) or deal(self, *by))
    rng = random.Random(9)
    texts = [rng.choice(["a", "bb\n", "", "d" * 70, "e" * 49]) for _ in range(500)]
    rows = [("f", "hot", i, f"{i:05d}", t) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "source_file string, parent_post_id string, chunk_index int, chunk_id string, text string")
    got = chunking.merge_small(table, span=40).orderBy("chunk_index").collect()
    assert asked == [13] and [r["text"] for r in got] == merge_by_hand(texts)


def test_rechunk_splits_once(spark):
    rows = [("c1", "day/dept_info", "a > b > c", "x\n\n" * 900, None, None, 0), ("c2", "f", "s", "tiny", "p", None, 0)]
    table = spark.createDataFrame(rows, "chunk_id string, source_file string, section_path string, text string, parent_post_id string, notes string, chunk_index int")
    table = table.selectExpr("*", "array(1) AS domains", "array('1') AS categories", "'u' AS source_url", "'2024' AS posted_at")
    for part in chunking.rechunk(table, F.expr("source_file LIKE '%dept_info%'")):
        plan = part._jdf.queryExecution().optimizedPlan().toString()
        assert "piece_text" not in plan and part.count() > 0


def test_rechunk_joins_pieces_in_the_order_of_their_records(spark):
    """Two records of one post give pieces of equal indexes: the earlier record's come first, whatever their ids are."""
    rows = [(f"{post}-{who}", "f", "s", who * 4 + "\n\n" + who.upper() * 2000, f"p{post}", None, i) for post in range(8) for i, who in enumerate("ab")]
    table = spark.createDataFrame(rows, "chunk_id string, source_file string, section_path string, text string, parent_post_id string, notes string, chunk_index int")
    table = table.selectExpr("*", "array(1) AS domains", "array('1') AS categories", "'u' AS source_url", "'2024' AS posted_at")
    merged = chunking.rechunk(table, F.expr("false"))[1]
    got = {(r["parent_post_id"], r["text"]): r["n_merged"] for r in merged.collect()}
    assert got == {(f"p{post}", text): n for post in range(8) for text, n in (("aaaa\n\nbbbb\n\n" + "A" * 2000, 3), ("B" * 2000, 1))}
    assert not {"record_place", "uid"} & set(merged.columns)


def test_rechunk_stats_takes_every_step(spark, tmp_path):
    """Cleaning, numbered items, joining of a post's records, an orphan, a cell and its section, and the figures of each file and domain."""
    items = ". ".join("i" * 100 for _ in range(40))
    texts = {0: "tiny", 15: "short one", 20: "short two", 25: "y" * 60, 11: items, 8: "cell\u00a0 text<표>", 4: "\u200b \n", 5: None}
    docs = [(k, t, "en", "web", len(t or "")) for k, t in texts.items()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {(r["scope"], r["name"]): r for r in corpus.rechunk_stats(spark, str(tmp_path)).collect()}
    whole = rows["all", None].asDict()
    want = {"n_in": 6, "split_sources": 1, "split_article": 0, "split_separator": 1, "split_window": 0, "split_pieces": 40, "merge_sources": 2, "merge_results": 42, "orphans": 1, "n_cells": 1, "n_sections": 1, "n_out": 44, "short_out": 2, "long_out": 0}
    assert {k: whole[k] for k in want} == want
    assert whole["mean_in"] == round((4 + 9 + 9 + 60 + len("i" * 101 + "\n11) ") * 39 + 100 + 9) / 6, 6)
    files = {k[1]: (r["n_in"], r["n_out"]) for k, r in rows.items() if k[0] == "file"}
    assert files == {"day0/rules.jsonl": (2, 41), "day1/rules.jsonl": (3, 1), "day1/dept_info.jsonl": (1, 1), "day1/dept_merged.jsonl": (0, 1)}
    domains = {k[1]: (r["n_in"], r["n_out"]) for k, r in rows.items() if k[0] == "domain"}
    assert domains == {"1": (1, 1), "3": (3, 43), "4": (1, 1), "6": (1, 40), "7": (1, 1), "8": (1, 1), "9": (1, 2), "2": (1, 1)}
