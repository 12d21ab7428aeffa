"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from millrace.llm.staging import bounded_batches
from millrace.operators.html import INLINE as STYLED
from millrace.operators.html import Node, parse

#: elements that do not end a block of text
INLINE = STYLED | frozenset("abbr bdi bdo big br cite code data del dfn img ins kbd label mark q s samp strike sub sup time tt var wbr".split())
#: elements that are never part of an article, by name
FURNITURE = frozenset("head nav footer aside form script style noscript template button select textarea iframe svg object dialog menu".split())
#: words of a class, an id or a role that say the same
SAYS_SO = frozenset(
    "ad ads adv advert adverts advertisement banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar sidebars aside "
    "complementary contentinfo footer header masthead topbar notice notices cookie cookies consent popup modal alert comment comments reply replies disqus respond share "
    "sharing social related recommended newsletter subscribe signup login search pager pagination widget".split()
)
#: names of an article's own box, and what takes the meaning from a name
BOX = frozenset("article content contents main post entry story".split())
BUT = frozenset("has no not with without".split())
LARGE = frozenset("html body main article section div td center".split())
NAME = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
PUNCTUATION = re.compile(r"[.,;:!?…、。，！？]")


def _furniture(node: Node, inside: bool) -> bool:
    """Whether an element is furniture of the page; `inside` says that it stands in an article or main element."""
    if node.tag in FURNITURE or "hidden" in node.attrs:
        return True
    if node.tag == "header":
        return not inside
    if node.tag in ("html", "body", "main", "article", "h1"):
        return False
    names = f"{node.attrs.get('class', '')} {node.attrs.get('id', '')} {node.attrs.get('role', '')}".split()
    if not names or any(n.lower() in BOX for n in names):
        return False
    for name in names:
        words = [w.lower() for w in NAME.findall(name)]
        if words and words[0] not in BUT and (words[0] in SAYS_SO or words[-1] in SAYS_SO) and not (inside and "header" in words):
            return True
    return False


class Block:
    """A run of text without a block element's edge inside: its text, its element, that element's path, and the characters in links."""

    __slots__ = ("text", "node", "path", "linked")

    def __init__(self, text: str, node: Node, path: int, linked: int):
        self.text, self.node, self.path, self.linked = text, node, path, linked


def blocks(root: Node) -> tuple[list[Block], int]:
    """Blocks outside the furniture in the order of the page, and the number of different paths. A path is the names of the
    elements from the root down, with the first class of each."""
    names: dict[tuple[int, str], int] = {}
    found: list[Block] = []
    parts: list[str] = []
    linked = 0

    def flush(node: Node, path: int) -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            found.append(Block(text, node, path, linked))
        parts.clear()
        linked = 0

    # element, its next item, its nearest block element and that one's path, whether in a link, whether in an article
    stack = [[root, 0, root, -1, False, False]]
    while stack:
        frame = stack[-1]
        node, at, box, path, link, inside = frame
        if at == len(node.items):
            stack.pop()
            if node.tag not in INLINE:
                flush(box, path)
            continue
        frame[1] += 1
        item = node.items[at]
        if not isinstance(item, Node):
            parts.append(item)
            if link:
                linked += len(item.strip())
        elif item.tag in INLINE:
            if item.tag in ("br", "img", "wbr"):
                parts.append(" " if item.tag == "br" else "")
            elif not _furniture(item, inside):
                stack.append([item, 0, box, path, link or item.tag == "a", inside])
        else:
            flush(box, path)
            if not _furniture(item, inside):
                kind = (item.attrs.get("class") or "").split()[:1]
                step = names.setdefault((path, ".".join([item.tag, *kind])), len(names))
                stack.append([item, 0, item, step, link, inside or item.tag in ("article", "main")])
    return found, len(names)


def path_ratios(found: list[Block], n_paths: int, spread: float = 1.0) -> np.ndarray:
    """For each block the fused ratio of its path, smoothed over its neighbours on the page.

    A path's text ratio is characters a block, its punctuation ratio is punctuation marks a block; the fused ratio is
    their product, less the share of characters in links. The kernel is a Gaussian over the order of blocks.
    """
    path = np.array([b.path for b in found]) + 1
    size = np.array([len(b.text) for b in found], float)
    marks = np.array([len(PUNCTUATION.findall(b.text)) for b in found], float)
    linked = np.array([min(b.linked, len(b.text)) for b in found], float)
    n, chars, points, links = (np.bincount(path, weights=w, minlength=n_paths + 1) for w in (None, size, marks, linked))
    n = np.maximum(n, 1)
    fused = (chars / n) * (1 + points / n) * (1 - links / np.maximum(chars, 1))
    reach = int(np.ceil(3 * spread))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / spread) ** 2)
    value = fused[path]
    return np.convolve(value, kernel)[reach : reach + len(value)] / np.convolve(np.ones(len(value)), kernel)[reach : reach + len(value)]


def article(html: str, strictness: float = 0.5, share: float = 0.8) -> list[str]:
    """Texts of the blocks of a page's article, in order.

    Blocks whose smoothed ratio reaches `strictness` standard deviations, and at least a tenth of the highest, are content nodes. The article is the
    smallest large element (article, main, section, div, cell, body) that holds `share` of their text, or the
    article or main element around it; all its blocks outside the furniture are kept, whatever their ratio, and so are
    first-level headings and, unless the page itself names its article, content nodes elsewhere that are not links for the
    most part.
    """
    found, n_paths = blocks(parse(html))
    if not found:
        return []
    ratio = path_ratios(found, n_paths)
    chosen = ratio >= max(min(strictness * ratio.std(), ratio.max()), 0.1 * ratio.max())
    held: dict[int, int] = {}
    depth: dict[int, tuple[int, Node]] = {}
    total = 0
    for block, ok in zip(found, chosen, strict=True):
        if ok:
            total += len(block.text)
            chain, node = [], block.node
            while node is not None:
                chain.append(node)
                node = node.parent
            for level, node in enumerate(reversed(chain)):
                held[id(node)] = held.get(id(node), 0) + len(block.text)
                depth[id(node)] = (level, node)
    boxes = [x for key, x in depth.items() if held[key] >= share * total and x[1].tag in LARGE]
    box = max(boxes, key=lambda x: x[0])[1] if boxes else None
    node, named = box, False
    while node is not None:
        if node.tag in ("article", "main"):
            box, named = node, True
            break
        node = node.parent
    keep = []
    known: dict[int, bool] = {}
    for block, ok in zip(found, chosen, strict=True):
        ok = ok and not named and 2 * block.linked < len(block.text)
        if not ok and box is not None and block.node.tag != "h1":
            node, seen = block.node, []
            while node is not None and node is not box and id(node) not in known:
                seen.append(id(node))
                node = node.parent
            ok = node is box or (node is not None and known[id(node)])
            known.update(dict.fromkeys(seen, ok))
        if ok or box is None or block.node.tag == "h1":
            keep.append(block.text)
    return keep


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Articles of a batch; its last column is the html, the others are passed on."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            texts = ["\n".join(article(h or "")) for h in part.column(part.num_columns - 1).to_pylist()]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), sizes], [*part.schema.names[:-1], "text", "n_chars"])


def extract_text(pages: DataFrame, keys: tuple[str, ...] = ("page_id", "url"), html: str = "html") -> DataFrame:
    """The keys of each page, the main text of its html, and that text's code points (n_chars).

    Character references are decoded, white space inside a block becomes one space, blocks are joined by one line feed in
    page order; a page is read whole. A null or empty page, and one without any text outside its furniture, gives an
    empty text. Null keys are passed on; repeated rows give repeated rows; an empty table gives no rows; other
    columns are not read, so that their names do not matter. Map-only: no row meets another.
    """
    kept = pages.select(*keys, pages[html].cast("string").alias("__html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return bounded_batches(kept, 1_000).mapInArrow(_extract, f"{schema}, text string, n_chars long")


def op12_tag_path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


#: The given pages have one template: the article is one element, its blocks begin at <h1> or <p>, and references are few.
OP12_SQL = r"""
WITH a AS (
  SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS body FROM pages
), b AS (
  SELECT page_id, url, unnest(string_split(regexp_replace(regexp_replace(body, '</?(h1|p)>', chr(1), 'g'), '<[^>]*>', ' ', 'g'), chr(1))) AS block,
    generate_subscripts(string_split(regexp_replace(regexp_replace(body, '</?(h1|p)>', chr(1), 'g'), '<[^>]*>', ' ', 'g'), chr(1)), 1) AS i FROM a
), c AS (
  SELECT page_id, url, i, trim(regexp_replace(
    replace(replace(replace(replace(regexp_replace(regexp_replace(block, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;', '"'), '&quot', '"'), '&amp;', chr(2)), '&amp', chr(2)), '\s+', ' ', 'g')) AS block FROM b
), t AS (
  SELECT page_id, url, coalesce(string_agg(replace(block, chr(2), '&'), chr(10) ORDER BY i) FILTER (block <> ''), '') AS text FROM c GROUP BY page_id, url
)
SELECT p.page_id, p.url, coalesce(t.text, '') AS text, CAST(length(coalesce(t.text, '')) AS BIGINT) AS n_chars
FROM pages p LEFT JOIN t ON t.page_id IS NOT DISTINCT FROM p.page_id AND t.url IS NOT DISTINCT FROM p.url
"""
