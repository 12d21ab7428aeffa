"""Report cells to grids, records and sentences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import empty_if_null, null_if_empty, sha16, strip
from millrace.operators.sizes import hinted
from millrace.sources.tables import staged

# fixed values
HEADER_WORDS = (
    "기준연도", "학교명", "학과명", "단과대학", "구분", "학과특성", "학생수", "비율", "등급", "만점평점", "기숙사", "수용인원",
    "졸업자", "취업자", "취업률", "진학자", "년도", "성별", "학기", "정원", "충원", "신입생", "재적학생", "재학생",
)
PLACE_KEYS = ("학교명", "단과대학", "학과명")
QUALIFIER_KEYS = ("구분", "학과특성", "학기", "성별")
YEAR_KEY = "기준연도"
PAGE = ["report_id", "page"]


LARGE_PAGE = 200_000
LARGE_RECORDS = 2_000
DEAL = 250_000


def _by_page(rows: DataFrame, large: int, usual: Callable[[DataFrame], DataFrame], split: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """usual() of the rows dealt by page once, which all its windows and groups then share; split() of the pages with more than `large` rows, counted first.

    Pages are dealt to a task for each DEAL rows, so that none grows with the table.
    """
    rows = staged(rows)
    counts = rows.groupBy(*PAGE).agg(F.count("*").alias("n"))
    many = staged(counts.where(F.col("n") > large).drop("n"))
    dealt = lambda part: part.repartition(max(1, -(-rows.count() // DEAL)), *PAGE)
    if many.isEmpty():
        return usual(dealt(rows))
    same = [rows[c].eqNullSafe(many[c]) for c in PAGE]
    return usual(dealt(rows.join(many, same, "left_anti"))).unionByName(split(rows.join(many, same, "left_semi")))


def _placed(cells: DataFrame) -> DataFrame:
    """Cells with the numbers of their edges among the lines of their page, which one window gathers."""
    page = Window.partitionBy(*PAGE)
    lines = lambda at, size: F.sort_array(F.array_union(F.collect_set(at).over(page), F.collect_set(at + size).over(page)))
    cells = cells.withColumns({"text": empty_if_null(F.col("text")), "xs": lines(F.col("x"), F.col("w")), "ys": lines(F.col("y"), F.col("h"))})
    no = lambda all_, at: F.array_position(all_, at) - 1
    numbers = {"x0": no(F.col("xs"), F.col("x")), "x1": no(F.col("xs"), F.col("x") + F.col("w")), "y0": no(F.col("ys"), F.col("y")), "y1": no(F.col("ys"), F.col("y") + F.col("h"))}
    return cells.select(*PAGE, "ord", "x", "y", "text", *[c.alias(k) for k, c in numbers.items()])


def _placed_split(cells: DataFrame) -> DataFrame:
    """As _placed(): the distinct lines alone are numbered, and edges join them, so that a page is split over tasks."""
    own = [*PAGE, "ord", "x", "y", "w", "h"]
    edge = lambda axis, end, at: F.struct(F.lit(axis).alias("axis"), F.lit(end).alias("end"), at.alias("line"))
    ends = F.array(edge("x", "from", F.col("x")), edge("x", "to", F.col("x") + F.col("w")), edge("y", "from", F.col("y")), edge("y", "to", F.col("y") + F.col("h")))
    edges = cells.select(*own, empty_if_null(F.col("text")).alias("text"), F.explode(ends).alias("e")).select(*own, "text", "e.*")
    lines = edges.select(*[F.col(c).alias(f"of_{c}") for c in (*PAGE, "axis", "line")]).distinct()
    lines = lines.withColumn("no", F.dense_rank().over(Window.partitionBy(*[f"of_{c}" for c in (*PAGE, "axis")]).orderBy("of_line")) - 1)
    numbered = edges.join(lines, [edges[c].eqNullSafe(lines[f"of_{c}"]) for c in (*PAGE, "axis", "line")]).select(*edges.columns, "no")
    at = lambda axis, end: F.max(F.when((F.col("axis") == axis) & (F.col("end") == end), F.col("no")))
    return numbered.groupBy(*own).agg(F.min("text").alias("text"), at("x", "from").alias("x0"), at("x", "to").alias("x1"), at("y", "from").alias("y0"), at("y", "to").alias("y1"))


def _laid(cells: DataFrame, split: bool) -> DataFrame:
    """The first cell on each slot between the numbers of cells' edges."""
    placed = (_placed_split if split else _placed)(cells).where("x0 < x1 and y0 < y1")
    rows = placed.withColumn("row", F.explode(F.sequence("y0", F.col("y1") - 1))).withColumn("col", F.explode(F.sequence("x0", F.col("x1") - 1)))
    other = F.when((F.col("col") == F.col("x0")) & (F.col("row") == F.col("y0")), 0).otherwise(1)
    rank = F.struct(other, F.when(other == 0, F.col("ord")), "y", "x", "ord")
    return rows.groupBy(*PAGE, "row", "col").agg(F.min_by("text", rank).alias("text"))


def build_grid(cells: DataFrame, large: int = LARGE_PAGE) -> DataFrame:
    """(report_id, page, row, col, text): what covers the middle of each slot between the lines of a page's cells.

    A cell whose corner is the slot's comes first (the first in document order), then the uppermost, leftmost one.
    Every edge of a cell is a line of its page, so the lines are numbered, and each cell is laid on the slots between the
    numbers of its own edges; the work grows with the grid, not with cells times slots. Cells of no width or height cover nothing. Cells are dealt
    by page once; pages of more than `large` cells are split over tasks.
    """
    return _by_page(cells, large, lambda c: _laid(c, False), lambda c: _laid(c, True))


def _headed(grid: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """The grid with its page's header row; all windows are of whole pages, one of them over the cells of the same row."""
    hits = F.sum(F.col("text").isin(*words).cast("int")).over(Window.partitionBy(*PAGE).orderBy("row").rangeBetween(0, 0))
    best = F.max(F.when(F.col("hits") >= 2, F.struct("hits", (-F.col("row")).alias("up")))).over(Window.partitionBy(*PAGE))
    return grid.withColumn("hits", hits).withColumn("header", F.coalesce(-best["up"], F.lit(0))).drop("hits")


def _headers(grid: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """(report_id, page, header) by sums of rows, and the best of a page."""
    hits = grid.groupBy(*PAGE, "row").agg(F.sum(F.col("text").isin(*words).cast("int")).alias("hits"))
    best = F.max(F.when(F.col("hits") >= 2, F.struct("hits", (-F.col("row")).alias("up"))))
    return hits.groupBy(*PAGE).agg(F.coalesce(-best["up"], F.lit(0)).alias("header"))


def header_rows(grid: DataFrame, words: tuple[str, ...] = HEADER_WORDS) -> DataFrame:
    """(report_id, page, header): the row with most header words, two at least, the first of equal ones; else row 0."""
    return _headers(grid, words)


def _named(grid: DataFrame, words: tuple[str, ...], split: bool) -> DataFrame:
    if split:
        on = [f"of_{c}" for c in PAGE]
        heads = _headers(grid, words).toDF(*on, "header")
        cells = grid.join(heads, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in PAGE]).drop(*on)
        names = cells.where("row = header").select(*[F.col(c).alias(f"of_{c}") for c in (*PAGE, "col")], F.col("text").alias("name"))
        cells = cells.join(names, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in (*PAGE, "col")]).drop(*on, "of_col")
    else:
        name = F.max(F.when(F.col("row") == F.col("header"), F.col("text"))).over(Window.partitionBy(*PAGE, "col"))
        cells = _headed(grid, words).withColumn("name", name)
    last = cells.where("row > header and name <> ''").groupBy(*PAGE, "row", "name").agg(F.max_by("text", "col").alias("value"))
    record = F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value"))))
    rows = last.groupBy(*PAGE, "row").agg(record.alias("record"), F.max(strip(F.col("value")) != "").alias("told"))
    return rows.where("told").drop("told")


def grid_records(grid: DataFrame, words: tuple[str, ...] = HEADER_WORDS, large: int = LARGE_PAGE) -> DataFrame:
    """(report_id, page, row, record): rows below the header as maps; empty heads are left out, of equal ones the last holds, blank rows go.

    As in build_grid(), a page is dealt out once, and split if it has more than `large` slots.
    """
    return _by_page(grid, large, lambda g: _named(g, words, False), lambda g: _named(g, words, True))


def cell_records(cells: DataFrame, words: tuple[str, ...] = HEADER_WORDS, large: int = LARGE_RECORDS) -> DataFrame:
    """grid_records(build_grid(cells)), for which pages are dealt out once: their grids are neither written nor dealt again.

    A page of n cells has at most 4 * n * n slots, and those of its tasks' windows; pages of more than `large` cells are split over tasks.
    """
    return _by_page(cells, large, lambda c: _named(_laid(c, False), words, False), lambda c: _named(_laid(c, True), words, True))


def report_meta(cells: DataFrame, above: int = 40) -> DataFrame:
    """(report_id, title, author, verifier, last_verified) from the top cells: the first title, the last of the others."""
    top = cells.where((F.col("y") < above) & (empty_if_null(F.col("text")) != ""))
    order = F.struct("y", "x", "ord")
    pick = lambda pattern: null_if_empty(F.regexp_extract("text", pattern, 1))
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), order))
    title = F.when(F.col("text").rlike(r"^\d{4}년") | F.col("text").contains("["), F.col("text"))
    return top.groupBy("report_id").agg(
        F.min_by(title, F.when(title.isNotNull(), order)).alias("title"), last(pick(r"작성자\s*:\s*([^/\s]+)")).alias("author"),
        last(pick(r"확인자\s*:\s*([^/\s]+)")).alias("verifier"), last(pick(r"최종확인일자\s*:\s*([\d\-./]+)")).alias("last_verified"),
    )


def record_sentence(record: Column, year: Column, label: Column) -> Column:
    """A record as one sentence: place, qualifiers in brackets, year, other keys with their values, source."""
    value = lambda k: null_if_empty(strip(empty_if_null(F.try_element_at(record, F.lit(k)))))
    qualifiers = F.concat_ws(", ", *[value(k) for k in QUALIFIER_KEYS])
    when = F.coalesce(F.try_element_at(record, F.lit(YEAR_KEY)), year)
    rest = F.filter(F.map_entries(record), lambda e: ~e["key"].isin(*PLACE_KEYS, *QUALIFIER_KEYS, YEAR_KEY) & (strip(empty_if_null(e["value"])) != ""))
    pairs = F.array_join(F.transform(rest, lambda e: F.concat(e["key"], F.lit(" "), strip(e["value"]))), ", ")
    parts = F.concat_ws(" ", null_if_empty(F.concat_ws(" ", *[value(k) for k in PLACE_KEYS])), F.when(qualifiers != "", F.concat(F.lit("("), qualifiers, F.lit(")"))), F.concat(null_if_empty(when), F.lit("년")), null_if_empty(pairs))
    return F.concat(parts, F.coalesce(F.concat(F.lit(" [출처: "), null_if_empty(label), F.lit("]")), F.lit("")))


def record_chunks(records: DataFrame, meta: DataFrame, label: str = "") -> DataFrame:
    """One record of text for each row of a report, dated by its last check or its year."""
    year = F.try_element_at("record", F.lit(YEAR_KEY))
    rows = records.join(meta, "report_id", "left").withColumn("text", record_sentence(F.col("record"), F.lit(None).cast("string"), F.lit(label)))
    nth = F.row_number().over(Window.partitionBy("report_id").orderBy("page", "row")) - 1
    posted = F.coalesce("last_verified", F.concat(year, F.lit("-01-01")))
    return rows.where("text <> ''").select("report_id", nth.alias("chunk_index"), "text", posted.alias("posted_at"), F.coalesce("title", F.lit(label or "report")).alias("source_title"), sha16(F.concat("report_id", F.lit("|"), "text")).alias("chunk_id"))


def stat_sentences(rows: DataFrame, kinds: DataFrame) -> DataFrame:
    """(entity, flag, year, sentence): one sentence for each value that is not empty.

    rows has entity, qualifiers, flag, year, val and val2..val4; kinds (few) has flag, name, unit, domain and category.
    """
    extras = F.concat_ws(", ", *[F.when((empty_if_null(F.col(v)) != "") & (F.col(v) != "0"), F.concat(F.lit(f"{v}="), F.col(v))) for v in ("val2", "val3", "val4")])
    label = F.concat_ws(" ", "entity", F.concat(F.lit("("), null_if_empty(F.col("qualifiers")), F.lit(")")))
    value = F.concat_ws(" ", F.concat(strip(F.col("val")), F.coalesce("unit", F.lit(""))), F.when(extras != "", F.concat(F.lit("("), extras, F.lit(")"))))
    sentence = F.concat(F.concat_ws(" ", label, F.concat(F.col("year"), F.lit("년")), F.coalesce("name", "flag"), value), F.lit(" [출처: "), F.col("source"), F.lit(", flag="), F.col("flag"), F.lit("]"))
    told = rows.where(strip(empty_if_null(F.col("val"))) != "").join(hinted(kinds), "flag", "left")
    return told.select("entity", "flag", "year", sentence.alias("sentence"), "domain", "category")


def stat_chunks(sentences: DataFrame, url: Column | None = None, title: Column | None = None) -> DataFrame:
    """Sentences as records, numbered within each entity and flag by year.

    url and title are expressions over entity and flag; an address has the flag in its fragment, so that addresses that
    lose their fragments fall together.
    """
    nth = F.row_number().over(Window.partitionBy("entity", "flag").orderBy("year")) - 1
    url = F.concat(F.lit("#flag="), F.col("flag")) if url is None else url
    title = F.concat_ws(" ", "entity", "flag") if title is None else title
    return sentences.select(
        F.col("sentence").alias("text"), "entity", "flag", nth.alias("chunk_index"), url.alias("source_url"), title.alias("source_title"), F.array(F.coalesce("domain", F.lit(9))).alias("domains"),
        F.filter(F.array("category"), lambda c: c.isNotNull()).alias("categories"), F.concat(F.col("year"), F.lit("-01-01")).alias("posted_at"), F.concat_ws(" > ", "entity", "flag").alias("section_path"), F.lit("T6").alias("source_type"), F.lit("dated").alias("freshness"),
    )


def stat_manifest(rows: DataFrame) -> DataFrame:
    """Per flag: entities tried, those with data, errors."""
    return rows.groupBy("flag").agg(F.count("*").alias("n_tried"), F.count_if(F.col("n_entries") > 0).alias("n_with_data"), F.count_if(empty_if_null(F.col("error")) != "").alias("n_errors"))


def report_counts(chunks: DataFrame, pids: DataFrame) -> DataFrame:
    """(pid, n_chunks): records whose notes name each report as pid=..., none for one without."""
    named = chunks.select(F.explode(F.array_distinct(F.regexp_extract_all("notes", F.lit(r"pid=(\w+)"), 1))).alias("pid")).groupBy("pid").agg(F.count("*").alias("n"))
    wanted = pids.select(F.col("pid").cast("string").alias("pid")).distinct()
    return wanted.join(named, "pid", "left").select("pid", F.coalesce("n", F.lit(0)).alias("n_chunks"))


def label_lookup(wanted: DataFrame, labels: DataFrame) -> DataFrame:
    """(pid, year, label): the label of that year, else of the first other year of the pid, else the hint."""
    met = wanted.join(labels.select("pid", F.col("year").alias("of"), F.col("label").alias("named")), "pid", "left")
    return met.groupBy("pid", "year", "hint").agg(F.min_by("named", F.struct(F.col("of") != F.col("year"), F.col("of"))).alias("named")).select("pid", "year", F.coalesce("named", "hint").alias("label"))


def split_numeric_items(items: Column, skipped: tuple[str, ...] = ("작성자", "확인자")) -> Column:
    """Items of a report as a struct of heads and values, which are never paired; items of a skipped prefix are left out."""
    kept = F.filter(items, lambda x: ~F.startswith(x, F.lit(skipped[0])) & ~F.startswith(x, F.lit(skipped[-1])) & (strip(x) != ""))
    number = r"^[\d.,%\s-]*\d[\d.,%\s-]*$"
    return F.struct(F.filter(kept, lambda x: ~x.rlike(number)).alias("heads"), F.filter(kept, lambda x: x.rlike(number)).alias("values"))


def header_like(record: Column) -> Column:
    """Whether half or more of a record's values that are not empty equal one of its keys, or none has a value."""
    told = F.filter(F.map_values(record), lambda v: strip(empty_if_null(v)) != "")
    same = F.filter(told, lambda v: F.array_contains(F.map_keys(record), v))
    return (F.size(told) == 0) | (F.size(same) * 2 >= F.size(told))


def template_chunks(rows: DataFrame, head: Column, clauses: list[tuple[Column, Column]]) -> DataFrame:
    """(pid, chunk_index, text, chunk_id): a head and those clauses whose condition holds; ids are of pid, number and the start of the text."""
    text = F.concat_ws(" ", head, *[F.when(test, clause) for test, clause in clauses])
    nth = F.row_number().over(Window.partitionBy("pid").orderBy("seq")) - 1
    told = rows.select("pid", nth.alias("chunk_index"), text.alias("text"))
    return told.withColumn("chunk_id", sha16(F.concat(F.lit("dstat_pid"), F.col("pid").cast("string"), F.lit("_"), F.col("chunk_index").cast("string"), F.lit("_"), F.substring("text", 1, 50))))
