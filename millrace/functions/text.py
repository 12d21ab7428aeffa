"""Cleaning, normalising, identifying and scoring of text columns.

Patterns use Java's Unicode classes where white space or digits of any script count. Null texts are taken as empty
unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
DROPPED_QUERY_KEYS = ("GotoPage", "skey", "sval", "site_dvs")
PLACEHOLDERS = "<표>|<그림>|<도형>|<수식>"
PAGE_LINE = r"(?U)\n\s*-\s*\d+\s*-\s*\n"
POST_ID_KEYS = ("no", "board_seq", "seq", "bbs_seq", "idx", "board_no")
QUESTION_CUE = r"\?$|어떻게|어디서|문의|FAQ|Q\.|Q:|얼마|언제|무엇|왜"
QUESTION_AND_ANSWER = r"(?s)(Q\.|Q:|문\s*:|문의\s*:).{5,200}?(A\.|A:|답\s*:)"
NUMBER_WITH_UNIT = r"\d+(시간|일|원|만원|점|학점|학기|년)"
STEP_MARK = r"(\d+\.|①|②|③|첫째|둘째|단계)"
NAVIGATION = ("TAB MENU", "본문 바로가기", "주메뉴 바로가기", "검색분류선택")
SENTENCE_TAILS = ("다.", "요.", "까?", ".", "?", "!", ".)", '."', "요.)", "다.)")
LAST_SENTENCE = r"""(?s)^(.*(?:다\.|요\.|까\?|[.?!]))(?=\s|$|["')\]])"""
PAGING_CONTEXT = r"(?i)GotoPage|page_no|searchCnt"
NAMED_ITEM = r"""(?i)(?:ntt_?no|mng_?no|seq_?no)\s*[=:]\s*['"]?(\d{3,})"""
QUOTED_ITEM = r"""(?:['"(])(\d{3,})(?:['")])"""


def empty_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def null_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def strip(c: Column) -> Column:
    """Without white space of any kind at either end; only texts that have some there are searched."""
    ends = lambda x: F.concat(F.substring(x, 1, 1), F.substring(x, -1, 1)).rlike(r"(?U)\s")
    return F.get(F.transform(F.array(c), lambda x: F.when(ends(x), F.regexp_replace(x, r"(?U)^\s+|\s+$", "")).otherwise(x)), F.lit(0))


def strip_lines(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, "\n"), strip), "\n")


def _cleaning(c: Column) -> list[tuple[str, Column]]:
    """The text before each cleaning step that is counted, by the name of the count; and last the clean text."""
    c = empty_if_null(c)
    shown = c
    for mark in ("\x00", "\u200b", "\u200d", "\ufeff"):
        shown = F.replace(shown, F.lit(mark), F.lit(""))
    spaced = F.replace(shown, F.lit("\u00a0"), F.lit(" "))
    plain = F.regexp_replace(spaced, PLACEHOLDERS, "")
    paged = F.regexp_replace(plain, PAGE_LINE, "\n")
    tight = F.regexp_replace(F.regexp_replace(paged, r"\n{3,}", "\n\n"), r"[ \t]+", " ")
    return [("n_control", c), ("n_nbsp", shown), ("n_placeholder", spaced), ("n_page_line", plain), ("n_blank_run", paged), ("text", strip(strip_lines(tight)))]


def clean_text(c: Column) -> Column:
    """Without control characters, placeholders, page number lines, runs of blank lines and of spaces.

    Runs of blank lines are cut before lines are stripped, so lines of spaces can leave more than two breaks.
    """
    return _cleaning(c)[-1][1]


def clean_counts(c: Column) -> dict[str, Column]:
    """How often each cleaning step applies, each counted on the text that it is given."""
    patterns = {"n_control": "[\\x00\\u200B\\u200D\\uFEFF]", "n_nbsp": "\\u00A0", "n_placeholder": PLACEHOLDERS, "n_page_line": PAGE_LINE, "n_blank_run": r"\n{3,}"}
    return {name: F.regexp_count(before, F.lit(patterns[name])) for name, before in _cleaning(c)[:-1]}


def normalize_text(c: Column) -> Column:
    """Line ends, spaces, line ends' white space and blank lines in one form; lines are stripped before blank runs are cut."""
    c = F.regexp_replace(empty_if_null(c), "\r\n?", "\n")
    return strip(F.regexp_replace(strip_lines(F.regexp_replace(c, "[ \\t\\u00A0]+", " ")), r"\n{3,}", "\n\n"))


def normalize_url(c: Column, dropped: tuple[str, ...] = DROPPED_QUERY_KEYS) -> Column:
    """Without fragment, dropped query keys and keys of empty value; the other pairs are encoded again."""
    whole = F.substring_index(c, "#", 1)
    base, query = F.substring_index(whole, "?", 1), F.when(F.instr(whole, "?") > 0, F.regexp_replace(whole, r"^[^?]*\?", "")).otherwise("")
    pairs = F.transform(F.split(query, "&"), lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.when(F.instr(p, "=") > 0, F.regexp_replace(p, "^[^=]*=", "")).otherwise("").alias("v")))
    kept = F.filter(pairs, lambda p: (p["v"] != "") & ~F.try_url_decode(p["k"]).isin(*dropped))
    again = F.transform(kept, lambda p: F.concat(F.url_encode(F.try_url_decode(p["k"])), F.lit("="), F.url_encode(F.try_url_decode(p["v"]))))
    joined = F.array_join(again, "&")
    return F.coalesce(F.concat(base, F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise("")), c)


def sha16(c: Column) -> Column:
    """The first 16 hex digits of the SHA-1."""
    return F.substring(F.sha1(c.cast("binary")), 1, 16)


def chunk_id(url: Column, index: Column, text: Column) -> Column:
    return sha16(F.concat_ws("|", empty_if_null(url), index.cast("string"), F.substring(empty_if_null(text), 1, 256)))


def piece_id(original: Column, index: Column) -> Column:
    """The id of the index-th piece of a record; the index has at least two digits."""
    return sha16(F.concat(original, F.lit("|p"), F.when(index < 10, F.concat(F.lit("0"), index.cast("string"))).otherwise(index.cast("string"))))


def normalize_title(c: Column, tails: tuple[str, ...] = ("Home",), most: int = 200) -> Column:
    """Without up to four trailing breadcrumbs ("> tail"), with single spaces, cut to `most` characters."""
    pattern = "(?iU)\\s*>\\s*(?:" + "|".join(f"\\Q{t}\\E" for t in tails) + ")\\s*$"
    c = strip(empty_if_null(c))
    for _ in range(4):
        c = F.regexp_replace(c, pattern, "")
    return F.rtrim(F.substring(F.regexp_replace(c, r"[ \t]+", " "), 1, most))


def passage(title: Column, section: Column, text: Column, group: Column) -> Column:
    """The text with a head of title and section; statistic groups stand alone, article sections come first."""
    section, text = strip(empty_if_null(section)), empty_if_null(text)
    shown = F.when((section != "") & (F.lower(section) != "body"), section)
    head = F.concat_ws(" | ", null_if_empty(title), shown)
    article = F.concat_ws(" | ", section, null_if_empty(title))
    head = F.when(section.rlike(r"(?U)^제\s*\d+\s*조"), article).otherwise(head)
    return strip(F.when(group.isin("almi_cell", "almi_dept") | (head == ""), text).otherwise(F.concat(head, F.lit("\n"), text)))


def bm25_text(c: Column) -> Column:
    """With ASCII words of two or more characters in lower case; anything else stays."""
    marked = F.regexp_replace(empty_if_null(c), "([A-Za-z][A-Za-z0-9_]+)", "\u0001$1\u0001")
    return F.array_join(F.transform(F.split(marked, "\u0001"), lambda x, i: F.when(i % 2 == 1, F.lower(x)).otherwise(x)), "")


def first_date(*columns: Column) -> Column:
    """The first year-month-day of the columns, in their order, in ISO form; null without one."""
    found = F.transform(F.array(*columns), lambda x: F.regexp_extract(empty_if_null(x), r"(\d{4}[-./]\d{2}[-./]\d{2})", 1))
    return F.regexp_replace(F.get(F.filter(found, lambda x: x != ""), F.lit(0)), "[./]", "-")


def post_id(url: Column, keys: tuple[str, ...] = POST_ID_KEYS) -> Column:
    """The first query value that is not empty, by the order of the keys."""
    return F.coalesce(*[null_if_empty(F.regexp_extract(url, rf"[?&]{k}=([^&#]*)", 1)) for k in keys])


def item_id(data: Column, href: Column, onclick: Column) -> Column:
    """A numeric item id from a data attribute, a link or a click handler, in this order; null in paging contexts."""
    named = null_if_empty(F.regexp_extract(empty_if_null(href), NAMED_ITEM, 1))
    clicked = F.coalesce(null_if_empty(F.regexp_extract(onclick, NAMED_ITEM, 1)), null_if_empty(F.regexp_extract(onclick, QUOTED_ITEM, 1)))
    return F.coalesce(
        F.when(data.rlike(r"^\d{3,}$"), data),
        F.when(~empty_if_null(href).startswith("javascript"), named),
        F.when(~onclick.rlike(PAGING_CONTEXT), clicked),
    )


def attachment_kind(name: Column, href: Column, fold: bool = False) -> Column:
    """pdf, hwp, hwpx or other by the ending of the name, else of the link; hwpx counts as hwp on request."""
    ending = F.coalesce(*[null_if_empty(F.lower(F.regexp_extract(empty_if_null(c), r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1))) for c in (name, href)], F.lit(""))
    kind = F.when(ending.isin("pdf", "hwp", "hwpx"), ending).otherwise("other")
    return F.when(kind == "hwpx", "hwp").otherwise(kind) if fold else kind


def text_score(c: Column) -> Column:
    """How well a text suits question writing: years, units, steps and a middle length raise it, navigation lowers it."""
    c = empty_if_null(c)
    n, one = F.length(c), lambda test, points: F.when(test, points).otherwise(0)
    marks = sum((one(c.contains(m), 1) for m in NAVIGATION[1:]), one(c.contains(NAVIGATION[0]), 1))
    score = one(c.rlike(r"\d{4}"), 2) + one(c.rlike(NUMBER_WITH_UNIT), 2) + one(c.rlike(STEP_MARK), 2) - marks
    return one(n >= 80, score + F.when((n >= 200) & (n <= 1500), 3).when(n > 1500, 1).otherwise(0))


def faq_reason(title: Column, text: Column) -> Column:
    """Why a record may be a question with its answer; null if nothing says so."""
    text = empty_if_null(text)
    return (
        F.when(empty_if_null(title).rlike(QUESTION_CUE), "title_question")
        .when(text.rlike(QUESTION_AND_ANSWER), "body_qa_pattern")
        .when((F.length(text) < 600) & F.substring(text, 1, 200).rlike(QUESTION_CUE), "short_body_question")
    )


def judged_score(raw: Column) -> Column:
    """The first lone 0, 1 or 2 in the first line that is not blank; -1 without one."""
    lines = F.filter(F.split(empty_if_null(raw), "\n"), lambda x: strip(x) != "")
    found = F.regexp_extract(F.coalesce(F.get(lines, F.lit(0)), F.lit("")), r"\b([012])\b", 1)
    return F.coalesce(null_if_empty(found).cast("int"), F.lit(-1))


def judged_reason(raw: Column) -> Column:
    """The further lines that are not blank, in one line of at most 200 characters."""
    lines = F.transform(F.filter(F.split(empty_if_null(raw), "\n"), lambda x: strip(x) != ""), strip)
    return F.substring(F.array_join(F.slice(lines, 2, 1_000_000), " "), 1, 200)


def truncate_answer(answer: Column, finished: Column, notice: str) -> Column:
    """The answer if it is finished and ends like a sentence; else up to its last sentence, with the notice once."""
    tail = F.rtrim(answer)
    ends = F.lit(False)
    for t in SENTENCE_TAILS:
        ends = ends | tail.endswith(t)
    cut = F.rtrim(F.coalesce(null_if_empty(F.regexp_extract(answer, LAST_SENTENCE, 1)), answer))
    return F.when(finished & ends, answer).when(cut.contains(notice.strip()), cut).otherwise(F.concat(cut, F.lit(notice)))
