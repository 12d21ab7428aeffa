"""Queries of pages, reports and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from millrace.operators import grids, pages
from millrace.plans.registry import query
from millrace.plans.views import VIEWS, table, view


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.parse_pages(table(spark, sf_dir, "pages"))


# the given pages as SQL reads them: their elements are known, so texts are what stands between tags
SQL_DECODED = lambda x: f"replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '\"', 'g'), '&amp;?', chr(2), 'g'), '&nbsp;', chr(160)), chr(2), '&')"
SQL_TEXTS = lambda x: f"list_filter(list_transform(regexp_split_to_array({x}, '<[^>]*>'), lambda t: trim({SQL_DECODED('t')})), lambda t: t <> '')"
VIEWS["v_pages"] = f"""
SELECT page_id, url, html, array_to_string({SQL_TEXTS("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}, ' ') AS title, {SQL_TEXTS("regexp_extract(html, '(?s)<article>(.*)</article>', 1)")} AS said,
  {SQL_TEXTS("regexp_replace(regexp_extract(html, '(?s)<body>(.*)', 1), '(?s)<nav>.*?</nav>|<footer>.*?</footer>|<!--.*?-->', '', 'g')")} AS shown,
  list_transform(regexp_extract_all(html, '(?s)<h1>(.*?)</h1>', 1), lambda h: array_to_string({SQL_TEXTS('h')}, ' ')) AS h1,
  list_transform(regexp_extract_all(html, '(?s)<div[^>]*>(.*?)</div>', 1), lambda d: length(array_to_string({SQL_TEXTS('d')}, ' '))) AS divs
FROM pages"""


@query("""SELECT page_id, title, CASE WHEN contains(html, '<article>') THEN 'article' ELSE 'body' END AS container, CAST(length(html) AS INT) AS n_raw, CAST(length(array_to_string(shown, ' ')) AS INT) AS n_text, array_to_string(h1[1:10], '|') AS h1,
  '' AS h2, '' AS h3, 0 AS n_boxes, CAST(len(h1) AS INT) AS n_h1, 0 AS n_h2, 0 AS n_h3, array_to_string(list_transform(list_reverse_sort(list_filter(divs, lambda n: n >= 100))[1:15], lambda n: CAST(n AS STRING) || ':0.0'), ',') AS divs FROM v_pages""")
def page_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.inspect(parsed(spark, sf_dir))
    divs = F.array_join(F.transform("divs", lambda d: F.concat_ws(":", d["n"].cast("string"), d["link_ratio"].cast("string"))), ",")
    return found.select("page_id", "title", "container", "n_raw", "n_text", *[F.array_join(h, "|").alias(h) for h in ("h1", "h2", "h3")], F.size("boxes").alias("n_boxes"), "n_h1", "n_h2", "n_h3", divs.alias("divs"))


@query("""SELECT page_id, url, CASE WHEN title = '' THEN url ELSE title END AS title, 0 AS chunk_index, 'body' AS section_path, array_to_string(said, chr(10)) AS text FROM v_pages WHERE len(said) > 0""")
def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_sections(parsed(spark, sf_dir))


@query("""SELECT page_id, url AS source_url, CASE WHEN title = '' THEN url ELSE title END AS source_title, 'T1' AS source_type, 0 AS chunk_index, 'body' AS section_path, text, CAST(length(text) AS INT) AS char_count, 'static' AS freshness,
  substring(sha1(url || '|0|' || substring(text, 1, 256)), 1, 16) AS chunk_id FROM (SELECT *, array_to_string(said, chr(10)) AS text FROM v_pages) WHERE length(text) >= 30""")
def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_chunks(parsed(spark, sf_dir))


@query()
def post_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = pages.parse_pages(table(spark, sf_dir, "pages"), pages.POST_CONTAINERS)
    listed = table(spark, sf_dir, "pages").where("page_id % 2 = 0").select("url", F.concat(F.lit("listed "), F.col("page_id").cast("string")).alias("list_title"), F.lit("2024-05-26").alias("list_posted_at"))
    return pages.post_chunks(read, listed, mark="/the")


@query("""SELECT page_id, i AS row, CASE WHEN page_id % 3 = 0 THEN 'a' || CAST(i AS STRING) || ',' || CAST(page_id AS STRING) ELSE 'item ' || CAST(i AS STRING) END AS cells FROM (SELECT page_id, unnest(range(CASE WHEN page_id % 3 = 0 THEN 4 ELSE 2 END)) AS i FROM pages WHERE page_id % 3 < 2)""")
def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a table, or of a list where the table has too few rows, set before the text of two pages in three."""
    n = F.col("page_id")
    table_ = F.concat(F.lit("<table>"), *[F.concat(F.lit(f"<tr><td>a{k}<td>"), n.cast("string")) for k in range(4)], F.lit("</table>"))
    list_ = F.lit("<table><tr><td>x</table><ul class='board'><li>item 0<li>item 1</ul>")
    html = F.concat(F.when(n % 3 == 0, table_).when(n % 3 == 1, list_).otherwise(""), "html")
    found = pages.table_rows(pages.parse_pages(table(spark, sf_dir, "pages").select("page_id", "url", html.alias("html"))))
    return found.where("page_id % 3 < 2").select("page_id", F.col("row").cast("long").alias("row"), F.array_join("cells", ",").alias("cells"))


# each page's links in order, the first of each address
VIEWS["v_links"] = f"""
SELECT page_id, url, any_value(text ORDER BY ord) AS text, href, min(ord) AS ord FROM (SELECT page_id, url, ord, array_to_string({SQL_TEXTS('said')}, ' ') AS text, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || {SQL_DECODED('place')} AS href FROM (
  SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS place, unnest(regexp_extract_all(html, '(?s)<a [^>]*>(.*?)</a>', 1)) AS said, unnest(range(len(regexp_extract_all(html, '<a href='))))  AS ord FROM pages)) WHERE length(text) > 0 GROUP BY page_id, url, href"""


@query("""SELECT page_id, substring(text, 1, 80) AS text, href, CAST(length(text) AS INT) AS score, 'ok' AS status FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(text) DESC, ord) AS nth FROM v_links WHERE page_id % 5 <> 0) WHERE nth <= 3
UNION ALL SELECT page_id, NULL, NULL, NULL, 'no_candidate' FROM pages WHERE page_id % 5 <> 0 AND page_id NOT IN (SELECT page_id FROM v_links) UNION ALL SELECT page_id, '[direct_url]', url, 10, 'ok_direct' FROM pages WHERE page_id % 5 = 0""")
def link_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    direct = table(spark, sf_dir, "pages").where("page_id % 5 = 0").select("page_id", F.array("url").alias("urls"))
    return pages.link_candidates(parsed(spark, sf_dir), F.length("text"), direct=direct)


@query()
def host_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to a page's own host that its words or addresses make likely."""
    return pages.link_candidates(parsed(spark, sf_dir), pages.wide_link_score(F.col("text"), F.col("href")) + 1, same_host=True)


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/_prog/rule/view_pop.php?mng_no=' || CAST(page_id AS STRING) ELSE regexp_extract(url, '^([^?#]*)', 1) || '?code=b1&mode=view&ntt_no=' || CAST(page_id AS STRING) END AS view_url,
  regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/_prog/_board/common/download.php?code=' || CASE WHEN page_id % 3 = 0 THEN 'rule' ELSE 'b1' END || '&ntt_no=' || CAST(page_id AS STRING) || '&atch_no=1' AS first_file, 2 AS n_files FROM pages""")
def item_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the items of a rule book or a board are, and their attachments."""
    rows = table(spark, sf_dir, "pages").select("page_id", "url")
    bare, item = F.regexp_extract("url", "^([^?#]*)", 1), F.col("page_id").cast("string")
    listing = F.when(F.col("page_id") % 3 == 0, F.concat(F.regexp_extract("url", "^([a-z]+://[^/?#]*)", 1), F.lit("/_prog/rule/?site=1"))).otherwise(F.concat(bare, F.lit("?code=b1&mode=list")))
    files = pages.download_urls(listing, item)
    return rows.select("page_id", pages.view_url(listing, item).alias("view_url"), F.get(files, F.lit(0)).alias("first_file"), F.size(files).alias("n_files"))


@query()
def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.attachments(parsed(spark, sf_dir), mark="/th")


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'static' WHEN 1 THEN 'plus' ELSE 'unknown' END AS cms FROM pages")
def detect_cms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Systems of pages, the article element of which is exchanged for another container in two of three."""
    n = F.col("page_id")
    html = F.when(n % 3 == 1, F.regexp_replace("html", "<article", "<div id='content'")).when(n % 3 == 2, F.regexp_replace("html", "<article", "<div")).otherwise(F.col("html"))
    read = pages.parse_pages(table(spark, sf_dir, "pages").select("page_id", "url", html.alias("html")))
    return pages.detect_cms(read, {"article": "static", "id=content": "plus"}).select("page_id", "cms")


VIEWS["v_notes"] = """
SELECT doc_id AS seq, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'parent' || CAST(doc_id % 90 AS STRING) END AS parent_post_id, CAST(1 + doc_id % 9 AS INT) AS domain,
  '{"attachments":[{"name":"a","url":"https://example.org/files/' || CAST(doc_id % 300 AS STRING) || '","kind":"pdf"},{"name":"b","url":"https://example.org/other/' || CAST(doc_id AS STRING) || '","kind":"' || CASE WHEN doc_id % 3 = 0 THEN 'hwp' ELSE 'other' END || '"}]}' AS notes
FROM documents"""


@query("""SELECT seq, url, kind, coalesce(parent_post_id, right(url, 32)) AS parent_post_id FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq) AS nth FROM (
  SELECT seq, parent_post_id, json_extract_string(notes, '$.attachments[0].url') AS url, 'pdf' AS kind FROM v_notes
  UNION ALL SELECT seq, parent_post_id, json_extract_string(notes, '$.attachments[1].url'), 'hwp' FROM v_notes WHERE json_extract_string(notes, '$.attachments[1].kind') = 'hwp')) WHERE nth = 1""")
def attachment_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_notes").select("*", F.array("domain").alias("domains"), F.array().cast("array<string>").alias("categories"), F.lit(None).cast("string").alias("posted_at"))
    return pages.attachment_queue(rows).select("seq", "url", "kind", "parent_post_id")


@query("""SELECT substring(sha1(source || '|' || CAST(doc_id % 5 AS STRING) || '|' || substring(text, 1, 256)), 1, 16) AS chunk_id, 'page:' || CAST(doc_id % 5 AS STRING) AS section_path,
  CASE WHEN doc_id % 2 = 0 THEN 'dated' ELSE 'static' END AS freshness, length(text) AS char_count FROM documents WHERE length(text) >= 30""")
def text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_url"), (F.col("doc_id") % 5).alias("page"), "text", F.when(F.col("doc_id") % 2 == 0, "2024-01-01").alias("posted_at"))
    return pages.text_page_chunks(rows).select("chunk_id", "section_path", "freshness", "char_count")


# a report an order: a header row, a row of four cells a line, one cell of two rows' height
VIEWS["v_line"] = "SELECT l_orderkey, l_linenumber, max(l_linestatus) AS status, max(l_quantity) AS quantity, max(l_returnflag) AS flag FROM lineitem GROUP BY l_orderkey, l_linenumber"
VIEWS["v_report"] = """
SELECT CAST(l_orderkey AS STRING) AS report_id, CAST(1 AS INT) AS page, 0 AS ord, 0 AS x, 40 AS y, 100 AS w, 20 AS h, '기준연도' AS text FROM (SELECT DISTINCT l_orderkey FROM v_line)
UNION ALL SELECT CAST(l_orderkey AS STRING), 1, 1, 100, 40, 100, 20, '학과명' FROM (SELECT DISTINCT l_orderkey FROM v_line)
UNION ALL SELECT CAST(l_orderkey AS STRING), 1, 2, 200, 40, 100, 20, '학생수' FROM (SELECT DISTINCT l_orderkey FROM v_line)
UNION ALL SELECT CAST(l_orderkey AS STRING), 1, 3, 300, 40, 100, 20, 'rate' FROM (SELECT DISTINCT l_orderkey FROM v_line)
UNION ALL SELECT CAST(l_orderkey AS STRING), 1, CAST(4 * l_linenumber AS INT), 0, CAST(40 + 20 * l_linenumber AS INT), 100, CASE WHEN l_linenumber = 2 THEN 40 ELSE 20 END, CAST(1992 + l_linenumber AS STRING) FROM v_line WHERE l_linenumber <> 3
UNION ALL SELECT CAST(l_orderkey AS STRING), 1, CAST(4 * l_linenumber + 1 AS INT), 100, CAST(40 + 20 * l_linenumber AS INT), 100, 20, status FROM v_line
UNION ALL SELECT CAST(l_orderkey AS STRING), 1, CAST(4 * l_linenumber + 2 AS INT), 200, CAST(40 + 20 * l_linenumber AS INT), 100, 20, CAST(CAST(quantity AS INT) AS STRING) FROM v_line
UNION ALL SELECT CAST(l_orderkey AS STRING), 1, CAST(4 * l_linenumber + 3 AS INT), 300, CAST(40 + 20 * l_linenumber AS INT), 100, 20, CASE WHEN l_linenumber % 2 = 0 THEN ' ' ELSE flag END FROM v_line"""
VIEWS["v_grid"] = """
SELECT report_id, page, y_no AS row, x_no AS col, arg_min(text, CASE WHEN cx = x AND cy = y THEN ord ELSE 1000000 * (1 + cy) + cx END) AS text FROM (
  SELECT r.report_id, r.page, r.y, r.y_no, c.x, c.x_no, k.ord, k.x AS cx, k.y AS cy, k.text FROM
  (SELECT report_id, page, line AS y, (line + next) / 2.0 AS mid, no AS y_no FROM (SELECT *, lead(line) OVER w AS next, row_number() OVER w - 1 AS no FROM (SELECT DISTINCT report_id, page, unnest([y, y + h]) AS line FROM v_report) WINDOW w AS (PARTITION BY report_id, page ORDER BY line)) WHERE next IS NOT NULL) r
  JOIN (SELECT report_id, page, line AS x, (line + next) / 2.0 AS mid, no AS x_no FROM (SELECT *, lead(line) OVER w AS next, row_number() OVER w - 1 AS no FROM (SELECT DISTINCT report_id, page, unnest([x, x + w]) AS line FROM v_report) WINDOW w AS (PARTITION BY report_id, page ORDER BY line)) WHERE next IS NOT NULL) c ON r.report_id = c.report_id AND r.page = c.page
  JOIN v_report k ON k.report_id = r.report_id AND k.page = r.page AND k.x <= c.mid AND c.mid < k.x + k.w AND k.y <= r.mid AND r.mid < k.y + k.h) GROUP BY report_id, page, y_no, x_no"""


def report_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of v_report, from one reading of the lines, which move once."""
    most = lambda c, of: F.max(of).alias(c)
    lines = table(spark, sf_dir, "lineitem").repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(most("status", "l_linestatus"), most("quantity", "l_quantity"), most("flag", "l_returnflag"))
    report = lines.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "status", "quantity", "flag")).alias("lines"))
    cell = "named_struct('ord', CAST({0} AS INT), 'x', {1}, 'y', CAST({2} AS INT), 'w', 100, 'h', {3}, 'text', {4})".format
    heads = ", ".join(cell(i, 100 * i, 40, 20, f"'{t}'") for i, t in enumerate(("기준연도", "학과명", "학생수", "rate")))
    no, y = "l.l_linenumber", "40 + 20 * l.l_linenumber"
    year = cell(f"4 * {no}", 0, y, f"CASE WHEN {no} = 2 THEN 40 ELSE 20 END", f"CAST(1992 + {no} AS STRING)")
    rest = ["l.status", "CAST(CAST(l.quantity AS INT) AS STRING)", f"CASE WHEN {no} % 2 = 0 THEN ' ' ELSE l.flag END"]
    rest = ", ".join(cell(f"4 * {no} + {i + 1}", 100 * (i + 1), y, 20, t) for i, t in enumerate(rest))
    of_line = f"IF({no} <=> 3 OR {no} IS NULL, array({rest}), array({year}, {rest}))"
    cells = report.select(F.col("l_orderkey").cast("string").alias("report_id"), F.lit(1).alias("page"), F.expr(f"explode(concat(array({heads}), flatten(transform(lines, l -> {of_line}))))").alias("c"))
    return cells.select("report_id", "page", "c.*")


def grid_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.build_grid(report_cells(spark, sf_dir))


def records_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.cell_records(report_cells(spark, sf_dir))


@query("SELECT report_id, page, row, col, text FROM v_grid")
def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_of(spark, sf_dir).select("report_id", "page", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "text")


@query("SELECT report_id, page, coalesce(max(row) FILTER (hits = 3), 0) AS header FROM (SELECT report_id, page, row, count(*) FILTER (text IN ('기준연도', '학과명', '학생수')) AS hits FROM v_grid GROUP BY report_id, page, row) GROUP BY report_id, page")
def grid_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.header_rows(grid_of(spark, sf_dir)).select("report_id", "page", F.col("header").cast("long").alias("header"))


VIEWS["v_records"] = """
SELECT report_id, page, row, max(CASE WHEN col = 0 THEN text END) AS y, max(CASE WHEN col = 1 THEN text END) AS name, max(CASE WHEN col = 2 THEN text END) AS n, max(CASE WHEN col = 3 THEN text END) AS rate FROM v_grid WHERE row > 0 GROUP BY report_id, page, row"""


@query("SELECT report_id, page, row, concat_ws(';', 'rate=' || rate, '기준연도=' || y, '학과명=' || name, '학생수=' || n) AS record FROM v_records")
def grid_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records_of(spark, sf_dir)
    entries = F.array_sort(F.transform(F.map_entries("record"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return rows.select("report_id", "page", F.col("row").cast("long").alias("row"), F.array_join(entries, ";").alias("record"))


@query("SELECT report_id, row, concat_ws(' ', name, y || '년', nullif(concat_ws(', ', 'rate ' || nullif(trim(rate), ''), '학생수 ' || n), '')) || ' [출처: lines]' AS sentence FROM v_records")
def record_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records_of(spark, sf_dir)
    sentence = grids.record_sentence(F.col("record"), F.lit(None).cast("string"), F.lit("lines"))
    return rows.select("report_id", F.col("row").cast("long").alias("row"), sentence.alias("sentence"))


VIEWS["v_heads"] = """
SELECT CAST(o_orderkey AS STRING) AS report_id, 0 AS ord, 5 AS x, 5 AS y, CAST(year(o_orderdate) AS STRING) || '년_ [report]' AS text FROM orders
UNION ALL SELECT CAST(o_orderkey AS STRING), 1, 5, 20, '작성자 : ' || trim(o_orderpriority) || ' / 확인자 : c' || CAST(o_custkey AS STRING) FROM orders
UNION ALL SELECT CAST(o_orderkey AS STRING), 2, 50, 20, '최종확인일자 : ' || CAST(CAST(o_orderdate AS DATE) AS STRING) FROM orders
UNION ALL SELECT CAST(o_orderkey AS STRING), 3, 50, 90, '작성자 : nobody' FROM orders"""


def metas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.report_meta(view(spark, sf_dir, "v_heads"))


@query("""SELECT CAST(o_orderkey AS STRING) AS report_id, CAST(year(o_orderdate) AS STRING) || '년_ [report]' AS title, string_split(trim(o_orderpriority), ' ')[1] AS author, 'c' || CAST(o_custkey AS STRING) AS verifier,
  CAST(CAST(o_orderdate AS DATE) AS STRING) AS last_verified FROM orders""")
def report_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metas(spark, sf_dir).withColumn("author", F.split("author", " ")[0])


@query("""SELECT r.report_id, row_number() OVER (PARTITION BY r.report_id ORDER BY page, row) - 1 AS chunk_index, coalesce(CAST(CAST(o_orderdate AS DATE) AS STRING), y || '-01-01') AS posted_at,
  coalesce(CAST(year(o_orderdate) AS STRING) || '년_ [report]', 'lines') AS source_title, substring(sha1(r.report_id || '|' || text), 1, 16) AS chunk_id, text
FROM (SELECT *, concat_ws(' ', name, y || '년', nullif(concat_ws(', ', 'rate ' || nullif(trim(rate), ''), '학생수 ' || n), '')) || ' [출처: lines]' AS text FROM v_records) r LEFT JOIN orders ON CAST(o_orderkey AS STRING) = r.report_id""")
def record_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grids.record_chunks(records_of(spark, sf_dir), metas(spark, sf_dir), "lines")
    return rows.select("report_id", F.col("chunk_index").cast("long").alias("chunk_index"), "posted_at", "source_title", "chunk_id", "text")


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_stats").select(
        F.concat_ws(" ", "college", "dept").alias("entity"), F.lit("daily").alias("qualifiers"), F.trim("stat").alias("flag"), F.col("y").cast("string").alias("year"),
        F.col("val").cast("string").alias("val"), F.col("val2").cast("string").alias("val2"), F.lit(None).cast("string").alias("val3"), F.lit("").alias("val4"), F.lit("orders").alias("source"),
    )
    kinds = spark.createDataFrame([("1-URGENT", "urgent", "명", 1, "1.7"), ("5-LOW", "low", "", 6, "6.1")], "flag string, name string, unit string, domain int, category string")
    return grids.stat_sentences(rows, kinds)


SQL_STAT = """college || ' ' || dept || ' (daily) ' || CAST(y AS STRING) || '년 ' || CASE trim(stat) WHEN '1-URGENT' THEN 'urgent' WHEN '5-LOW' THEN 'low' ELSE trim(stat) END || ' ' || CAST(val AS STRING) || CASE WHEN trim(stat) = '1-URGENT' THEN '명' ELSE '' END
  || CASE WHEN val2 > 0 THEN ' (val2=' || CAST(val2 AS STRING) || ')' ELSE '' END || ' [출처: orders, flag=' || trim(stat) || ']'"""


@query(f"SELECT college || ' ' || dept AS entity, trim(stat) AS flag, CAST(y AS STRING) AS year, {SQL_STAT} AS sentence FROM v_stats")
def stat_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats(spark, sf_dir).select("entity", "flag", "year", "sentence")


@query(f"""SELECT {SQL_STAT} AS text, row_number() OVER (PARTITION BY college, dept, stat ORDER BY y) - 1 AS chunk_index, CAST(y AS STRING) || '-01-01' AS posted_at, college || ' ' || dept || ' > ' || trim(stat) AS section_path,
  'https://stats.example.org/doInit.do#flag=' || trim(stat) AS source_url, 'orders - ' || college || ' ' || dept || ' ' || trim(stat) AS source_title, CASE trim(stat) WHEN '1-URGENT' THEN '1.7' WHEN '5-LOW' THEN '6.1' ELSE '' END AS categories FROM v_stats""")
def stat_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    url, title = F.concat(F.lit("https://stats.example.org/doInit.do#flag="), "flag"), F.concat_ws(" ", F.lit("orders -"), "entity", "flag")
    rows = grids.stat_chunks(stats(spark, sf_dir), url, title)
    return rows.select("text", F.col("chunk_index").cast("long").alias("chunk_index"), "posted_at", "section_path", "source_url", "source_title", F.array_join("categories", ",").alias("categories"))


@query("SELECT trim(o_orderpriority) AS flag, count(*) AS n_tried, count(*) FILTER (o_orderkey % 3 > 0) AS n_with_data, count(*) FILTER (o_orderkey % 5 = 0) AS n_errors FROM orders GROUP BY trim(o_orderpriority)")
def stat_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.trim("o_orderpriority").alias("flag"), (F.col("o_orderkey") % 3).alias("n_entries"), F.when(F.col("o_orderkey") % 5 == 0, "e").alias("error"))
    return grids.stat_manifest(rows)


@query("""SELECT CAST(n_nationkey AS STRING) AS pid, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_custkey % 4 <> 0) AS n_chunks FROM nation""")
def report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of each report, by the number in their notes."""
    notes = F.when(F.col("c_custkey") % 4 != 0, F.concat(F.lit("source f, pid="), F.col("c_nationkey").cast("string"), F.lit(" year=2024")))
    return grids.report_counts(table(spark, sf_dir, "customer").select(notes.alias("notes")), table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("pid")))


VIEWS["v_labels"] = "SELECT n_regionkey AS pid, 2000 + n_nationkey % 7 AS year, min(n_name) AS label FROM nation GROUP BY n_regionkey, 2000 + n_nationkey % 7"
VIEWS["v_wanted"] = "SELECT DISTINCT CAST(c_nationkey % 7 AS INT) AS pid, CAST(2000 + c_custkey % 9 AS BIGINT) AS year, 'hint' AS hint FROM customer"


@query("""SELECT w.pid, w.year, coalesce(e.label, f.label, w.hint) AS label FROM v_wanted w LEFT JOIN v_labels e ON e.pid = w.pid AND e.year = w.year LEFT JOIN (SELECT pid, arg_min(label, year) AS label FROM v_labels GROUP BY pid) f ON f.pid = w.pid""")
def label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.label_lookup(view(spark, sf_dir, "v_wanted"), view(spark, sf_dir, "v_labels"))


@query("""SELECT o_orderkey, 'status ' || o_orderstatus || ',' || trim(o_orderpriority) AS heads, CAST(o_custkey AS STRING) || ',' || CAST(o_orderkey AS STRING) AS vals FROM orders""")
def numeric_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.array(F.lit("작성자 x"), F.concat(F.lit("status "), "o_orderstatus"), F.col("o_custkey").cast("string"), F.lit(" "), F.trim("o_orderpriority"), F.col("o_orderkey").cast("string"))
    parts = grids.split_numeric_items(items)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(parts["heads"], ",").alias("heads"), F.array_join(parts["values"], ",").alias("vals"))


@query("""SELECT conv_id, count(*) AS n, count(*) FILTER (length(text) > 200) AS n_long, md5(string_agg(role || ' says' || CASE WHEN length(text) > 200 THEN ' much' ELSE '' END, '|' ORDER BY turn)) AS texts_md5 FROM conversations GROUP BY conv_id""")
def template_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("pid"), F.col("turn").alias("seq"), "role", "text")
    told = grids.template_chunks(rows, F.concat("role", F.lit(" says")), [(F.length("text") > 200, F.lit("much"))])
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "text"))), lambda s: s["text"]), "|")
    return told.groupBy(F.col("pid").alias("conv_id")).agg(F.count("*").alias("n"), F.count_if(F.col("text").contains("much")).alias("n_long"), F.md5(listed).alias("texts_md5"))
