import duckdb
import pytest

from millrace.llm.extraction import OP12_SQL, article, blocks, extract_text, path_ratios
from millrace.operators.html import parse

LONG = "A long sentence of the story, with commas, follows here. It goes on, and on, until it ends."
PAGE = f"""<!DOCTYPE html><html><head><title>Title</title><style>p{{}}</style><script>var t = "</p>";</script></head><body class="has-sidebar">
<header><a href="/">Home</a> The site</header><nav><ul><li><a href="/a">First menu</a></li><li>Second</li></ul></nav>
<div class="cookie-notice">We use cookies, and more. Accept them all, please.</div>
<div id="wrap"><div class="sidebar"><p>{LONG}</p></div>
<div class="content"><h1>Fish &amp; chips&nbsp;&mdash; today</h1><p>{LONG}</p><p>Be.</p><div class="ad">{LONG}</div><p>Two
   lines<br>of <b>bold</b><i>face</i> &lt;text&gt;<form><input value="x"><p>Your name</p></form>
<ul><li>One</li><li>Two</li></ul><table><tr><td>a</td><td>b</td></tr></table><p>{LONG}</p></div>
<div id="comments"><p>Reader: {LONG}</p></div></div><footer>&copy; 2020, all rights. Reserved, all.</footer></body></html>"""


def test_article_without_the_furniture_of_its_page():
    assert article(PAGE) == ["Fish & chips — today", LONG, "Be.", "Two lines of boldface <text>", "One", "Two", "a", "b", LONG]


def test_short_paragraphs_and_headings_of_an_article_stay():
    page = f"<body><div class=menu><a>x</a></div><article><header><h1>Name</h1></header><p>Be.</p><p>{LONG * 20}</p><h2>Sub</h2><p>So</p><footer>by me</footer></article><p>Reply</p></body>"
    assert article(page) == ["Name", "Be.", LONG * 20, "Sub", "So"]


def test_content_by_ratio_alone():
    """No names: short link lists beside long paragraphs."""
    links = "".join(f"<li><a href='/{i}'>Item {i}</a></li>" for i in range(30))
    page = f"<body><div><ul>{links}</ul></div><div><p>{LONG}</p><p>{LONG}</p><p>ok</p></div></body>"
    assert article(page) == [LONG, LONG, "ok"]
    found, n = blocks(parse(page))
    ratio = path_ratios(found, n)
    assert min(ratio[-3:]) > max(ratio[:20]) and len({b.path for b in found[:30]}) == 1


@pytest.mark.parametrize("page", ["", "<p>", "<html></html>", "</p></div>", "<nav>a</nav>", "<script>x</script>", "   \n "])
def test_pages_without_text(page):
    assert article(page) == []


def test_open_and_odd_markup():
    assert article("plain words") == ["plain words"]
    assert article("<p><b>Open<br><p>next &am &amp;amp; <a href=x>in</a>line") == ["Open", "next &am &amp; inline"]
    assert article("<div>" * 3000 + LONG) == [LONG]
    assert article("<body>" + f"<p>{LONG}</p>" * 5000) == [LONG] * 5000


def test_extract_text_on_odd_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars long, path int"
    rows = [(1, "u", "<p>" + "Word, word. " * 50_000, "x", 5, 1), (None, None, "<p>a b</p>", None, None, None), (2, "u", None, "x", 1, 1), (2, "u", None, "x", 1, 1), (3, "v", "", None, None, None)]
    got = {(r.page_id, r.n_chars) for r in extract_text(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(1, 12 * 50_000 - 1), (None, 3), (2, 0), (3, 0)}
    assert extract_text(spark.createDataFrame(rows, schema)).count() == 5
    empty = extract_text(spark.createDataFrame([], schema))
    assert empty.columns == ["page_id", "url", "text", "n_chars"] and empty.count() == 0


def test_against_sql_of_the_given_template(spark):
    folder = "/root/testdata/sf0.01"
    duckdb.sql(f"create or replace view pages as from '{folder}/pages.parquet'")
    want = {(r[0], r[1], r[2], r[3]) for r in duckdb.sql(OP12_SQL).fetchall()}
    got = {tuple(r) for r in extract_text(spark.read.parquet(f"{folder}/pages.parquet")).collect()}
    assert got == want
