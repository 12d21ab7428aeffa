import random
import time

from pyspark.sql import functions as F

from millrace.operators import grids, html, pages
from millrace.schemas import CELL
from millrace.sources import files


def test_sections_and_chunks(spark):
    html = "<html><head><title>T</title><script>var a='</p>'</script></head><body><nav>menu</nav><div id='content'><h2>A</h2><p>first <b>bold<p>second long enough to stay in<h3>B</h3><p>under b, long enough to be kept here</div><footer>f</footer></body></html>"
    rows = spark.createDataFrame([(1, "https://h/a/b", html), (2, "u", None), (3, "u", "<p>plain text with no heading, long enough")], "page_id long, url string, html string")
    parsed = pages.parse_pages(rows)
    got = {(r["page_id"], r["section_path"]): r["text"] for r in pages.page_sections(parsed).collect()}
    assert got[1, "h2:A"] == "first\nbold\nsecond long enough to stay in"
    assert got[1, "h2:A > h3:B"].startswith("under b") and got[3, "body"].startswith("plain text")
    assert {k[0] for k in got} == {1, 3}
    assert pages.page_chunks(parsed).count() == 3
    seen = {r["page_id"]: r for r in pages.inspect(parsed).collect()}
    assert seen[1]["container"] == "id=content" and seen[1]["n_h2"] == 1 and seen[2]["n_raw"] == 0
    assert {r["page_id"]: r["cms"] for r in pages.detect_cms(parsed, {"id=content": "plus"}).collect()} == {1: "plus", 2: "unknown", 3: "unknown"}


def test_links_tables_and_attachments(spark):
    html = "<body><table><tr><td>a<td>b<tr><td>c<td>d<tr><td>e<td>f</table><a href='/x?download=1'>plan.pdf</a><a href='javascript:go()'>졸업요건</a><a href='c'>교과과정</a><a href='c'>교과과정 again</a><a href='d'>졸업 요건</a><a href='e'>학위수여식</a></body>"
    parsed = pages.parse_pages(spark.createDataFrame([(1, "https://h/p/", html), (2, "https://h/", "<p>x")], "page_id long, url string, html string"))
    assert [r["cells"] for r in pages.table_rows(parsed).orderBy("row").collect()] == [["a", "b"], ["c", "d"], ["e", "f"]]
    links = [(r["href"], r["score"], r["status"]) for r in pages.link_candidates(parsed).orderBy("page_id", F.desc("score")).collect()]
    assert links == [("https://h/p/d", 10, "ok"), ("https://h/p/c", 8, "ok"), (None, None, "no_candidate")]
    found = {r["page_id"]: r["attachments"] for r in pages.attachments(parsed).collect()}
    assert [(a["name"], a["url"], a["kind"]) for a in found[1]] == [("plan.pdf", "https://h/x?download=1", "pdf")] and found[2] == []
    posts = {r["page_id"]: r["text"] for r in pages.post_chunks(parsed, least=500).collect()}
    assert posts == {1: pages.SHORT_BODY}


def test_attachment_queue(spark):
    notes = '{"attachments":[{"name":"a","url":"https://h/a.pdf","ext":"pdf","kind":"pdf"},{"name":"z","url":"https://h/z.zip","kind":"other"}]}'
    rows = spark.createDataFrame([(2, None, notes), (1, "p", notes), (3, "p", "not json"), (4, "p", None)], "seq int, parent_post_id string, notes string")
    rows = rows.select("*", F.array(F.lit(1)).alias("domains"), F.array(F.lit("1.1")).alias("categories"), F.lit("2024-01-01").alias("posted_at"))
    got = pages.attachment_queue(rows).collect()
    assert [(r["seq"], r["url"], r["parent_post_id"]) for r in got] == [(1, "https://h/a.pdf", "p")]


def test_grid_with_merged_and_overlapping_cells(spark):
    cells = [("r", 1, 0, 0, 0, 10, 10, "학교명"), ("r", 1, 1, 10, 0, 10, 10, "학생수"), ("r", 1, 2, 0, 10, 10, 20, "A"), ("r", 1, 3, 10, 10, 10, 10, "5"), ("r", 1, 4, 10, 20, 10, 10, "6"), ("r", 1, 5, 10, 20, 10, 10, "late"), ("r", 2, 6, 0, 0, 10, 10, "other page")]
    table = spark.createDataFrame([(*c, None) for c in cells], CELL)
    grid = grids.build_grid(table)
    got = {(r["page"], r["row"], r["col"]): r["text"] for r in grid.collect()}
    assert got == {(1, 0, 0): "학교명", (1, 0, 1): "학생수", (1, 1, 0): "A", (1, 1, 1): "5", (1, 2, 0): "A", (1, 2, 1): "6", (2, 0, 0): "other page"}
    assert {(r["page"], r["header"]) for r in grids.header_rows(grid).collect()} == {(1, 0), (2, 0)}
    records = grids.grid_records(grid)
    assert [r["record"] for r in records.orderBy("row").collect()] == [{"학교명": "A", "학생수": "5"}, {"학교명": "A", "학생수": "6"}]
    said = records.orderBy("row").select(grids.record_sentence(F.col("record"), F.lit("2024"), F.lit("L")).alias("s")).first()["s"]
    assert said == "A 2024년 학생수 5 [출처: L]"


def test_header_like_and_numeric_items(spark):
    rows = spark.createDataFrame([({"a": "a", "b": "x"},), ({"a": "", "b": " "},), ({"a": "1", "b": "x"},)], "m map<string, string>")
    assert [r["h"] for r in rows.select(grids.header_like(F.col("m")).alias("h")).collect()] == [True, True, False]
    items = spark.createDataFrame([(["작성자 x", "name", "1,234", "5 %", " "],)], "i array<string>").select(grids.split_numeric_items(F.col("i")).alias("p")).first()["p"]
    assert (items["heads"], items["values"]) == (["name"], ["1,234", "5 %"])


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "day1.jsonl").write_text('{"text": "a", "chunk_id": "1", "domains": [1]}\n\n{"text": "b", "chunk_id": "2"}\n')
    (tmp_path / "in" / "cross_tag.jsonl").write_text('{"text": "c", "chunk_id": "3"}\n{broken\n')
    (tmp_path / "in" / "faq_seeds.jsonl").write_text('{"text": "d", "chunk_id": "4"}\n')
    rows = files.read_chunks(spark, str(tmp_path / "in"), strict=False)
    main, bypass = files.select_inputs(rows)
    assert sorted(r["chunk_id"] for r in main.collect()) == ["1", "2"] and [r["chunk_id"] for r in bypass.collect()] == ["3"]
    files.require_fields(main)
    files.write_stage(main, str(tmp_path / "stage"))
    back = spark.read.parquet(str(tmp_path / "stage"))
    assert {(r["chunk_id"], r["source_file"]) for r in back.collect()} == {("1", "day1.jsonl"), ("2", "day1.jsonl")}
    grouped = main.withColumn("_retrieval_group", files.retrieval_group(F.col("source_file"), {"day1": "almi_cell"}))
    files.write_groups(grouped, str(tmp_path / "groups"))
    assert spark.read.parquet(str(tmp_path / "groups")).select("_retrieval_group").distinct().first()[0] == "almi_cell"
    grid = spark.createDataFrame([("r", 1, 0, 0, "x"), ("r", 1, 0, 2, "y")], "report_id string, page int, row int, col int, text string")
    files.write_grid_csv(grid, str(tmp_path / "csv"), 3)
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).select("c0", "c1", "c2").first().asDict() == {"c0": "x", "c1": None, "c2": "y"}


def test_sizes_by_one_traversal():
    """As walking each element gives them, and in time that grows with the elements, however deep they lie."""
    source = "<body><div id=a>one<div><a href=x>two <b>bold</b></a><nav>menu<a>three</a><h3>n</h3></nav></div><h2>head</h2></div><div> </div></body>"
    root = html.parse(source)
    nodes = [root, *root.walk()]
    sizes = html.measure(nodes)
    for n in nodes:
        got = sizes[id(n)]
        below = list(n.walk())
        assert (got.length, got.linked, got.h2, got.h3) == (len(n.text()), sum(len(x.text()) for x in below if x.tag == "a"), sum(x.tag == "h2" for x in below), sum(x.tag == "h3" for x in below))
    took = []
    for depth in (1_000, 4_000):
        nodes = [root := html.parse("<div>word " * depth), *root.walk()]
        began = time.perf_counter()
        assert max(s.length for s in html.measure(nodes).values()) == 5 * depth - 1
        took.append(time.perf_counter() - began)
    assert took[1] < 16 * took[0]


def test_large_pages_are_split_to_the_same_grid(spark):
    rng = random.Random(9)
    words = [*grids.HEADER_WORDS[:4], "", "v"]
    rows = [(r, 1, k, x * 10, y * 10, rng.choice([10, 10, 20]), rng.choice([10, 10, 20]), rng.choice(words) if y < 2 else f"{r}{k}") for r in ("a", "b", None) for k, (y, x) in enumerate((y, x) for y in range(6) for x in range(5))]
    cells = spark.createDataFrame(rows, "report_id string, page int, ord int, x int, y int, w int, h int, text string")
    whole, cut = grids.build_grid(cells), grids.build_grid(cells, large=0)
    told = lambda df: sorted((repr(tuple(r)) for r in df.collect()))
    assert told(whole) == told(cut) and whole.count() > 90
    assert told(grids.grid_records(whole).where("report_id is not null")) == told(grids.grid_records(whole, large=0).where("report_id is not null"))
    assert told(grids.grid_records(whole)) == told(grids.grid_records(whole, large=0))


def test_records_of_cells_deal_pages_once(spark, monkeypatch):
    """The records of written grids, from one deal by page, to a task for each DEAL cells; pages split or not."""
    rng = random.Random(6)
    words = [*grids.HEADER_WORDS[:4], "", "v"]
    rows = [(r, p, i, 10 * rng.randint(0, 5), 10 * rng.randint(0, 7), 10 * rng.randint(0, 3), 10 * rng.randint(1, 3), rng.choice(words)) for r in ("a", "b", None) for p in range(4) for i in range(30)]
    cells = spark.createDataFrame(rows, "report_id string, page int, ord int, x int, y int, w int, h int, text string")
    told = lambda df: sorted((str(r["report_id"]), r["page"], r["row"], sorted(r["record"].items())) for r in df.collect())
    want = told(grids.grid_records(grids.build_grid(cells)))
    monkeypatch.setattr(grids, "DEAL", 50)
    once = grids.cell_records(cells)
    plan = once._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange") == 1 and "hashpartitioning(report_id" in plan and ", 8)" in plan
    assert want and told(once) == want == told(grids.cell_records(cells, large=0))
