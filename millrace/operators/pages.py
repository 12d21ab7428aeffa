"""Web pages to records; every page is parsed once, and all outputs come from what that gives."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import attachment_kind, chunk_id, empty_if_null, null_if_empty, post_id
from millrace.operators import html

# fixed values
LINK_GROUPS = (
    (10, r"(?i)졸업\s*요건|졸업요건"),
    (9, r"(?i)이수\s*기준|학위\s*수여|학위수여"),
    (8, r"(?i)교육\s*과정|교과\s*과정|교과과정"),
    (7, r"(?i)graduation|requirement"),
    (6, r"(?i)curriculum|coursework"),
    (5, r"(?i)학과\s*교육|전공\s*과목"),
)
BAD_LINK = r"(?i)인사말|연혁|역사|소개|찾아오는|위치|수여식|시상식|행사\s*안내|개최|모집\s*안내|공고|articleNo="

PARSED = (
    "page_id long, url string, title string, container string, n_raw int, n_text int, h1 array<string>, h2 array<string>, h3 array<string>, "
    "sections array<struct<path: string, text: string>>, links array<struct<text: string, href: string>>, table_rows array<array<string>>, "
    "divs array<struct<n: int, link_ratio: double>>, body string, boxes array<struct<name: string, n: int, h2: int, h3: int>>"
)
_SECTIONS = pa.list_(pa.struct([("path", pa.string()), ("text", pa.string())]))
_LINKS = pa.list_(pa.struct([("text", pa.string()), ("href", pa.string())]))
_DIVS = pa.list_(pa.struct([("n", pa.int32()), ("link_ratio", pa.float64())]))
_BOXES = pa.list_(pa.struct([("name", pa.string()), ("n", pa.int32()), ("h2", pa.int32()), ("h3", pa.int32())]))
_STRINGS = pa.list_(pa.string())
_KINDS = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), _STRINGS, _STRINGS, _STRINGS, _SECTIONS, _LINKS, pa.list_(_STRINGS), _DIVS, pa.string(), _BOXES]
# fixed values: where the text of a post stands, in the order of trying
POST_CONTAINERS = ("id=txt", "id=contents", "id=content", "id=jwxe_main_content", "class=detail_con", "id=divContent", "class=content")
SHORT_BODY = "(본문 짧음 - 첨부 참조)"


def _read(page_id: int, url: str, source: str, wanted: tuple[str, ...]) -> tuple:
    root = html.parse(source)
    name, box = html.container(root, wanted)
    nodes = [root, *root.walk()]
    sizes = html.measure(nodes)
    by_tag: dict[str, list[html.Node]] = {}
    for n in nodes:
        by_tag.setdefault(n.tag, []).append(n)
    heads = {tag: [n.text(" ") for n in by_tag.get(tag, ())[:most]] for tag, most in (("h1", 10), ("h2", 20), ("h3", 30))}
    links = []
    for n in by_tag.get("a", ()):
        if n.attrs.get("href"):
            links.append({"text": n.text(" "), "href": urljoin(url or "", n.attrs["href"]) if not n.attrs["href"].startswith(("javascript:", "mailto:", "tel:", "#")) else n.attrs["href"]})
    long = [s for s in (sizes[id(n)] for n in by_tag.get("div", ())) if s.length >= 100]
    title, body = by_tag.get("title", [None])[0], by_tag.get("body", [root])[0]
    return (
        page_id, url, title.text(" ") if title else None, name, len(source or ""), sizes[id(body)].length, heads["h1"], heads["h2"], heads["h3"],
        [{"path": p, "text": t} for p, t in html.sections(box)], links, html.table_rows(root), [{"n": s.length, "link_ratio": s.linked / s.length} for s in long], box.text(), _boxes(nodes, sizes, wanted),
    )


def _boxes(nodes: list[html.Node], sizes: dict[int, html.Sizes], wanted: tuple[str, ...]) -> list[dict]:
    """All elements of the wanted ids and classes: length of text, and headings inside."""
    named: dict[str, list[html.Sizes]] = {}
    for n in nodes:
        for kind in ("id", "class"):
            for value in dict.fromkeys((n.attrs.get(kind) or "").split()):
                named.setdefault(f"{kind}={value}", []).append(sizes[id(n)])
    return [{"name": name, "n": s.length, "h2": s.h2, "h3": s.h3} for name in wanted for s in named.get(name, ())]


def _parse(wanted: tuple[str, ...]):
    names = ["page_id", "url", "title", "container", "n_raw", "n_text", "h1", "h2", "h3", "sections", "links", "table_rows", "divs", "body", "boxes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                rows = [_read(*x, wanted) for x in zip(*(c.to_pylist() for c in part.columns), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_KINDS)], names)

    return run


def parse_pages(pages: DataFrame, containers: tuple[str, ...] = html.CONTAINERS) -> DataFrame:
    """What is read from pages(page_id, url, html), one row a page (columns of PARSED). A null page is an empty one.

    containers are the ids and classes that may hold the text, in the order of trying; POST_CONTAINERS for posts.
    """
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(_parse(containers), PARSED)


def inspect(parsed: DataFrame, top: int = 15) -> DataFrame:
    """Title, headings, lengths, container, all elements that could be one, and the longest divs, those that are mostly links last."""
    order = F.transform("divs", lambda d: F.struct((d["link_ratio"] > 0.8).alias("linky"), (-d["n"]).alias("m"), d["link_ratio"].alias("r")))
    divs = F.transform(F.slice(F.array_sort(order), 1, top), lambda d: F.struct((-d["m"]).alias("n"), F.round(d["r"], 4).alias("link_ratio")))
    return parsed.select("page_id", "title", "container", "n_raw", "n_text", "h1", "h2", "h3", "boxes", F.size("h1").alias("n_h1"), F.size("h2").alias("n_h2"), F.size("h3").alias("n_h3"), divs.alias("divs"))


def page_sections(parsed: DataFrame) -> DataFrame:
    return parsed.select("page_id", "url", F.coalesce(null_if_empty(F.col("title")), "url").alias("title"), F.posexplode("sections").alias("chunk_index", "s")).select("page_id", "url", "title", "chunk_index", F.col("s.path").alias("section_path"), F.col("s.text").alias("text"))


def page_chunks(parsed: DataFrame, least: int = 30) -> DataFrame:
    """Sections of `least` characters or more as records of type T1."""
    rows = page_sections(parsed).where(F.length("text") >= least)
    return rows.select(chunk_id(F.col("url"), F.col("chunk_index"), F.col("text")).alias("chunk_id"), "page_id", F.col("url").alias("source_url"), F.col("title").alias("source_title"), F.lit("T1").alias("source_type"), "chunk_index", "section_path", "text", F.length("text").alias("char_count"), F.lit("static").alias("freshness"))


def attachments(parsed: DataFrame, mark: str = "download", fold: bool = False) -> DataFrame:
    """(page_id, attachments): links whose address holds the mark, once each, with the kind of file."""
    found = F.filter("links", lambda x: F.contains(x["href"], F.lit(mark)))
    ending = lambda x: attachment_kind(x["text"], x["href"], fold)
    listed = F.transform(found, lambda x: F.struct(F.substring(x["text"], 1, 160).alias("name"), x["href"].alias("url"), ending(x).alias("kind")))
    return parsed.select("page_id", F.array_distinct(listed).alias("attachments"))


def post_chunks(parsed: DataFrame, listed: DataFrame | None = None, mark: str = "download", least: int = 30, placeholder: str = SHORT_BODY) -> DataFrame:
    """One record a post: its text if long enough, else a placeholder if it has attachments; attachments as JSON in notes.

    parsed is of parse_pages(posts, POST_CONTAINERS). listed(url, list_title, list_posted_at) is what a listing told of
    the posts: its title comes before the page's own, and its date is the record's.
    """
    rows = parsed.join(attachments(parsed, mark).withColumnRenamed("page_id", "at"), F.col("page_id") == F.col("at"))
    if listed is None:
        rows = rows.withColumns({"list_title": F.lit(None).cast("string"), "list_posted_at": F.lit(None).cast("string")})
    else:
        rows = rows.join(listed.select("url", "list_title", "list_posted_at").dropDuplicates(["url"]), "url", "left")
    text = F.when(F.length("body") >= least, F.col("body")).when(F.size("attachments") > 0, placeholder)
    notes = F.when(F.size("attachments") > 0, F.to_json(F.struct("attachments")))
    title = F.coalesce(null_if_empty(F.col("list_title")), null_if_empty(F.col("title")), "url")
    return rows.select(
        "page_id", F.col("url").alias("source_url"), title.alias("source_title"), text.alias("text"), F.lit("T2").alias("source_type"), F.lit("dated").alias("freshness"), F.col("list_posted_at").alias("posted_at"),
        post_id(F.col("url")).alias("parent_post_id"), F.lit("post_body").alias("section_path"), notes.alias("notes"),
    ).where("text is not null")


def table_rows(parsed: DataFrame) -> DataFrame:
    return parsed.select("page_id", F.posexplode("table_rows").alias("row", "cells"))


def link_score(text: Column) -> Column:
    """The score of the best group that a link's text names; 0 for none, and for texts that name something else."""
    score = F.when(empty_if_null(text).rlike(BAD_LINK), 0)
    for points, pattern in LINK_GROUPS:
        score = score.when(text.rlike(pattern), points)
    return score.otherwise(0)


def link_candidates(parsed: DataFrame, score: Column | None = None, top: int = 3, direct: DataFrame | None = None, same_host: bool = False) -> DataFrame:
    """(page_id, href, text, score, status): of each page the best distinct links that score; no_candidate without one.

    score is an expression over the link's text and href, link_score() of the text if none is given. direct(page_id, urls)
    names pages whose addresses are known: those take the place of what the page links to, as they are listed, repeats too, at score 10 (ok_direct). Texts are
    scored whole and shown up to 80 characters. With same_host only links to the page's own host count.
    """
    links = parsed.select("page_id", "url", F.posexplode("links").alias("ord", "link")).select("page_id", "url", "ord", "link.text", "link.href").where(~F.col("href").rlike("^(javascript:|mailto:|tel:|#)"))
    if same_host:
        links = links.where(F.try_parse_url("href", F.lit("HOST")) == F.try_parse_url("url", F.lit("HOST")))
    scored = links.drop("url").withColumn("score", link_score(F.col("text")) if score is None else score).where("score > 0")
    once = scored.withColumn("nth", F.row_number().over(Window.partitionBy("page_id", "href").orderBy("ord"))).where("nth = 1")
    best = once.withColumn("nth", F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("score"), "ord"))).where(F.col("nth") <= top)
    pages, known = parsed.select("page_id"), None
    if direct is not None:
        known = direct.select("page_id", F.explode("urls").alias("href"))
        pages = pages.join(known.select("page_id").distinct(), "page_id", "left_anti")
    best = best.select("page_id", F.substring("text", 1, 80).alias("text"), "href", "score")
    found = pages.join(best, "page_id", "left").withColumn("status", F.when(F.col("href").isNull(), "no_candidate").otherwise("ok"))
    if known is None:
        return found
    return found.unionByName(known.select("page_id", "href", F.lit("[direct_url]").alias("text"), F.lit(10).alias("score"), F.lit("ok_direct").alias("status")))


# fixed values
WIDE_LINK = r"(?i)졸업|이수|학위|교과|교육과정|커리큘럼|curriculum|graduation|requirement|학사|학부|학과\s*소개"
WIDE_BAD_LINK = r"(?i)인사말|연혁|찾아오는|위치|로그인|articleNo="


def wide_link_score(text: Column, href: Column) -> Column:
    """1 for a link whose text or address names what is sought, and neither names something else; else 0."""
    said = empty_if_null(text)
    return F.when(said.rlike(WIDE_BAD_LINK) | href.rlike(WIDE_BAD_LINK), 0).when(said.rlike(WIDE_LINK) | href.rlike(WIDE_LINK), 1).otherwise(0)


def attachment_queue(chunks: DataFrame, kinds: tuple[str, ...] = ("pdf", "hwp", "hwpx")) -> DataFrame:
    """Attachments in the JSON notes of records, of the given kinds, each address once (the first by seq), with what they take over."""
    listed = F.from_json("notes", "attachments array<struct<name: string, url: string, kind: string>>")["attachments"]
    rows = chunks.select("seq", "domains", "categories", "posted_at", "parent_post_id", F.posexplode(listed).alias("ord", "a"))
    rows = rows.where(F.col("a.kind").isin(*kinds)).select("seq", "ord", "domains", "categories", "posted_at", "parent_post_id", F.col("a.name").alias("name"), F.col("a.url").alias("url"), F.col("a.kind").alias("kind"))
    nth = F.row_number().over(Window.partitionBy("url").orderBy("seq", "ord"))
    parent = F.coalesce(null_if_empty(F.col("parent_post_id")), F.expr("right(url, 32)"))
    return rows.withColumn("nth", nth).where("nth = 1").drop("nth", "ord").withColumn("parent_post_id", parent)


def detect_cms(parsed: DataFrame, names: dict[str, str]) -> DataFrame:
    """(page_id, cms, n_text): the system that a page's container tells of, else unknown."""
    found = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("container")]
    return parsed.select("page_id", F.coalesce(found, F.lit("unknown")).alias("cms"), "n_text")


def text_page_chunks(rows: DataFrame, least: int = 30) -> DataFrame:
    """Pages of extracted text (doc_url, page, text, posted_at) of `least` characters or more as records of type T3."""
    kept = rows.where(F.length("text") >= least)
    freshness = F.when(F.col("posted_at").isNotNull(), "dated").otherwise("static")
    return kept.select(chunk_id(F.col("doc_url"), F.col("page"), F.col("text")).alias("chunk_id"), "doc_url", F.concat(F.lit("page:"), F.col("page").cast("string")).alias("section_path"), F.lit("T3").alias("source_type"), freshness.alias("freshness"), F.length("text").cast("long").alias("char_count"))


def list_pages(lists: DataFrame, pages: int) -> DataFrame:
    """(page_id, page_url): the addresses of the first pages of each list, by its GotoPage key."""
    page = F.explode(F.sequence(F.lit(1), F.lit(pages))).alias("n")
    bare = F.regexp_replace("url", r"([?&])GotoPage=\d+&?", "$1")
    glue = F.when(F.col("url").contains("?"), "&").otherwise("?")
    return lists.select("page_id", page, F.concat(F.rtrim(bare, F.lit("?&")), glue).alias("base")).select("page_id", F.concat("base", F.lit("GotoPage="), F.col("n").cast("string")).alias("page_url"))


def _site(url: Column) -> Column:
    return F.regexp_extract(url, r"^([a-z]+://[^/?#]*)", 1)


def view_url(list_url: Column, item: Column) -> Column:
    """The address of an item's own page, from that of its listing: rule books open it by number, other lists by mode=view."""
    path = F.regexp_extract(list_url, r"^([^?#]*)", 1)
    query = F.regexp_replace(F.regexp_extract(list_url, r"\?([^#]*)", 1), r"(^|&)(?:mode|ntt_no)=[^&]*", "")
    rest = F.concat_ws("&", null_if_empty(F.regexp_replace(query, "^&", "")), F.concat(F.lit("mode=view&ntt_no="), item))
    return F.when(path.contains("/_prog/rule/"), F.concat(_site(list_url), F.lit("/_prog/rule/view_pop.php?mng_no="), item)).otherwise(F.concat(path, F.lit("?"), rest))


def download_urls(list_url: Column, item: Column, numbers: tuple[int, ...] = (1, 2)) -> Column:
    """Addresses at which an item's attachments may be had: by each code of the listing's query, `rule` without one."""
    codes = F.filter(F.array(*[F.try_parse_url(list_url, F.lit("QUERY"), F.lit(k)) for k in ("code", "menu_dvs_cd")]), lambda c: c.isNotNull() & (c != ""))
    codes = F.when(F.size(codes) == 0, F.array(F.lit("rule"))).otherwise(codes)
    start = F.concat(_site(list_url), F.lit("/_prog/_board/common/download.php?code="))
    return F.flatten(F.transform(codes, lambda c: F.array(*[F.concat(start, c, F.lit("&ntt_no="), item, F.lit(f"&atch_no={n}")) for n in numbers])))
