"""Cutting long records into pieces and joining tiny ones."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import empty_if_null, null_if_empty, piece_id, sha16, strip
from millrace.sources.tables import staged

# fixed values
MAX_LENGTH, WINDOW_SIZE, OVERLAP, MIN_LENGTH = 2000, 1500, 200, 50
RANGE_ROWS = 50_000
ARTICLE = r"(?U)(?=제\s*\d+\s*조(?:의\s*\d+)?\s*[(（])"
ARTICLE_MARK = r"(?U)(?=\s*제\s*\d+\s*조(?:의\s*\d+)?\s*[(（])"
PARAGRAPH = r"\n{2,}"
NUMBERED = r"(?U)(?=\n\s*\d{1,2}[.)]\s)"


def windows(text: Column, most: int = MAX_LENGTH, size: int = WINDOW_SIZE, overlap: int = OVERLAP) -> Column:
    """The text, or if it is longer than `most` its overlapping windows, as an array."""
    n, step = F.length(text), size - overlap
    last = F.ceil((n - size) / step).cast("int") * step
    return F.when(n <= most, F.array(text)).otherwise(F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda s: F.substring(text, s + 1, F.lit(size))))


def _pieces(text: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(text, pattern), strip), lambda p: p != "")


def articles(text: Column, pattern: str = ARTICLE) -> Column:
    """Pieces that begin at articles, over-long ones as windows; fewer than three pieces: windows of the whole."""
    each = lambda pieces: F.flatten(F.transform(pieces, lambda p: windows(p)))
    return _let(_pieces(text, pattern), lambda pieces: F.when(F.size(pieces) < 3, windows(text)).otherwise(each(pieces)))


def _let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _numbered(text: Column) -> Column:
    """(pieces, strategy): numbered items, if there are two or more and none is over-long, else windows."""
    of = lambda pieces, kind: F.struct(pieces.alias("pieces"), F.lit(kind).alias("strategy"))
    fits = lambda items: (F.size(items) >= 2) & F.forall(items, lambda p: F.length(p) <= MAX_LENGTH)
    return _let(_pieces(text, NUMBERED), lambda items: F.when(fits(items), of(items, "separator")).otherwise(of(windows(text), "window")))


def general_pieces(text: Column) -> tuple[Column, Column]:
    """Paragraphs, over-long ones by numbered items or windows; a text of one paragraph by numbered items or windows.

    The second column is the strategy: window where the whole text falls into windows, else separator.
    """
    found = general_cut(text)
    return found["pieces"], found["strategy"]


def general_cut(text: Column) -> Column:
    """general_pieces() as one struct (pieces, strategy)."""
    each = lambda paragraphs: F.flatten(F.transform(paragraphs, lambda p: F.when(F.length(p) <= MAX_LENGTH, F.array(p)).otherwise(_numbered(p)["pieces"])))
    return _let(_pieces(text, PARAGRAPH), lambda p: F.when(F.size(p) >= 2, F.struct(each(p).alias("pieces"), F.lit("separator").alias("strategy"))).otherwise(_numbered(text)))


def split_records(rows: DataFrame) -> DataFrame:
    """Records of over MAX_LENGTH characters in pieces; shorter ones as they are. strategy is none, article, separator or window.

    Three or more marks of articles, counted at every white space before them too, choose articles. Pieces take over the
    record's fields, but for chunk_id, chunk_index, parent_post_id (the record's, else its id) and notes. record_chars is the
    record's length at its first piece, and null at the others.
    """
    text = empty_if_null(F.col("text"))
    article = F.regexp_count(F.concat(F.lit("\n"), text), F.lit(ARTICLE_MARK)) >= 3
    short = F.length(text) <= MAX_LENGTH
    cut = F.when(short, F.struct(F.array(text).alias("pieces"), F.lit("none").alias("strategy"))).when(article, F.struct(articles(text).alias("pieces"), F.lit("article").alias("strategy"))).otherwise(general_cut(text))
    cut = rows.withColumn("cut", cut).withColumn("strategy", F.col("cut.strategy")).withColumn("n_pieces", F.size("cut.pieces")).withColumn("record_chars", F.length(text))
    # no record is without a piece; the outer form keeps Spark from looking for such ones by splitting all a second time
    cut = cut.select("*", F.posexplode_outer("cut.pieces").alias("piece", "piece_text")).drop("cut")
    many = F.col("n_pieces") > 1
    return cut.withColumns(
        {
            "text": F.col("piece_text"),
            "parent_post_id": F.when(many, F.coalesce(null_if_empty(F.col("parent_post_id")), F.col("chunk_id"))).otherwise(F.col("parent_post_id")),
            "notes": F.when(many, _noted(F.col("notes"), F.concat(F.lit("split_from="), F.col("chunk_id")))).otherwise(F.col("notes")),
            "chunk_index": F.when(many, F.col("piece")).otherwise(F.col("chunk_index")),
            "char_count": F.length("piece_text"),
            "record_chars": F.when(F.col("piece") == 0, F.col("record_chars")),
            "chunk_id": F.when(many, piece_id(F.col("chunk_id"), F.col("piece"))).otherwise(F.col("chunk_id")),
        }
    ).drop("piece", "piece_text", "n_pieces")


def _noted(notes: Column, addition: Column) -> Column:
    return F.concat_ws(" | ", null_if_empty(notes), addition)


def _glue(a: Column, b: Column) -> Column:
    return F.concat(a, F.when(a.endswith("\n"), "").otherwise("\n\n"), b)


def _step(state: int, n: int, newline: bool, least: int) -> tuple[int, int]:
    """State of the output behind a row of n characters, and whether the row begins one. 0: full; else 1 + 2 * length + (ends in a line feed)."""
    begins = state == 0
    size, ends = (n, newline) if begins else ((state - 1) // 2 + (0 if (state - 1) % 2 else 2) + n, newline or n == 0)
    return (0 if size >= least else 1 + 2 * size + ends), int(begins)


SUMMARY = "pid int, whole boolean, first_file string, first_parent string, last_file string, last_parent string, states array<int>, begun array<bigint>"
ASSIGNED = "uid long, pos long, file string, parent string, out long"


def _columns(table: pa.Table) -> list[list]:
    table = table.sort_by("pos")
    return [table.column(c).to_pylist() for c in ("file", "parent", "n_chars", "ends", "uid", "pos")]


def _summary(least: int):
    """What a range of rows does to the state that its first parent comes in with: the state and the outputs begun for each
    such state, if all of the range is one parent; else those of its last parent alone."""

    def run(table: pa.Table) -> pa.Table:
        file, parent, n, ends, _, _ = _columns(table)
        key = list(zip(file, parent, strict=True))
        whole = key[0] == key[-1]
        at = 0 if whole else len(key) - next(k for k, x in enumerate(reversed(key)) if x != key[-1])
        into = list(range(1 + 2 * least)) if whole else [0]
        states, begun = into, [0] * len(into)
        while at < len(key) and len(set(states)) > 1:
            stepped = [_step(s, n[at], ends[at], least) for s in states]
            states, begun, at = [s for s, _ in stepped], [b + c for b, (_, c) in zip(begun, stepped, strict=True)], at + 1
        state, more = states[0], 0
        for k in range(at, len(key)):
            state, c = _step(state, n[k], ends[k], least)
            more += c
        if at < len(key):
            states = [state] * len(into)
        row = (table.column("pid")[0].as_py(), whole, *key[0], *key[-1], states, [b + more for b in begun])
        names = ["pid", "whole", "first_file", "first_parent", "last_file", "last_parent", "states", "begun"]
        kinds = [pa.int32(), pa.bool_(), *[pa.string()] * 4, pa.list_(pa.int32()), pa.list_(pa.int64())]
        return pa.table([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

    return run


def _assign(least: int, incoming: dict[int, tuple[int, int, bool]]):
    """The output of each row, and as a row without uid each parent's last output if that is short and not its first."""

    def run(table: pa.Table) -> pa.Table:
        file, parent, n, ends, uid, pos = _columns(table)
        state, begun, goes_on = incoming[table.column("pid")[0].as_py()]
        out, tails = [], []
        for k in range(len(n)):
            if k and (file[k] != file[k - 1] or parent[k] != parent[k - 1]):
                if state and begun > 1:
                    tails.append((None, None, file[k - 1], parent[k - 1], begun - 1))
                state, begun = 0, 0
            state, c = _step(state, n[k], ends[k], least)
            begun += c
            out.append(begun - 1)
        if not goes_on and state and begun > 1:
            tails.append((None, None, file[-1], parent[-1], begun - 1))
        rows = list(zip(uid, pos, file, parent, out, strict=True)) + tails
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["uid", "pos", "file", "parent", "out"])

    return run


def merge_small(rows: DataFrame, least: int = MIN_LENGTH, span: int = RANGE_ROWS, ties: tuple[str, ...] = (), stored: bool = False, fields: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a (source_file, parent_post_id), by chunk_index and chunk_id, joined until each has `least` characters.

    A short row at the end joins the output before it; alone it stays (an orphan). A joined row has the fields of its leftmost
    row, but for text, chunk_id (the SHA-1 start of "left|m+right", chained), and, where rows has them, char_count,
    domains and categories (sorted unions) and notes (merged_with=, chained); n_merged counts its rows. Rows without a parent
    (null or empty) pass untouched; ties in chunk_index go by the columns `ties`, which are then left out, then chunk_id, then a hash of the text.

    Which rows join depends on lengths alone: those are dealt to ranges of the order, so that one parent may take up many ranges, whatever its
    indexes; there is a range for each `span` rows, counted first, so that no range grows with the table. The length of the open output and whether it ends in a line feed are all that passes from a row to the next, so each range first
    says what it makes of every such state; composed in order (a row for each range, on the driver), those give the state
    in which each range begins, and the ranges then number their outputs side by side. The input is computed once, and texts are shuffled to meet
    their numbers and, in outputs of several rows, each other. With `stored`, rows are a written table and `uid` numbers them; they are not written again. With `fields` (text among them), only those are made, and n_merged.
    """
    names, key = [c for c in fields or rows.columns if c not in ties and not (stored and c == "uid")], ["file", "parent"]
    text = empty_if_null(F.col("text"))
    base = rows if stored else staged(rows.withColumn("uid", F.monotonically_increasing_id()))
    parent = null_if_empty(F.col("parent_post_id"))
    alone = base.where(parent.isNull()).select(*names, F.lit(1).alias("n_merged"))
    order = ["file", "parent", "at", *ties, "chunk_id", "h", "uid"]
    narrow = base.where(parent.isNotNull()).select(
        empty_if_null(F.col("source_file").cast("string")).alias("file"), F.col("parent_post_id").cast("string").alias("parent"), F.coalesce(F.col("chunk_index"), F.lit(0)).alias("at"),
        *ties, F.col("chunk_id"), F.xxhash64(text).alias("h"), "uid", F.length(text).alias("n_chars"), text.endswith("\n").alias("ends"),
    )
    ranged = narrow.repartitionByRange(max(1, -(-narrow.count() // span)), *order).sortWithinPartitions(*order)
    ranged = staged(ranged.select(*key, "n_chars", "ends", "uid", F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().alias("pos")))
    incoming, state, begun, last = {}, 0, 0, None
    found = sorted(ranged.groupBy("pid").applyInArrow(_summary(least), SUMMARY).collect(), key=lambda r: r["pid"])  # a row for each range
    for r, after in zip(found, [*found[1:], None][: len(found)], strict=True):
        first = (r["first_file"], r["first_parent"])
        if first != last:
            state, begun = 0, 0
        last = (r["last_file"], r["last_parent"])
        incoming[r["pid"]] = (state, begun, after is not None and (after["first_file"], after["first_parent"]) == last)
        state, begun = (r["states"][state], begun + r["begun"][state]) if r["whole"] else (r["states"][0], r["begun"][0])
    assigned = staged(ranged.groupBy("pid").applyInArrow(_assign(least, incoming), ASSIGNED))
    tails = assigned.where("uid is null").select(*key, "out", F.lit(1).alias("back"))
    outs = assigned.where("uid is not null").join(tails, [*key, "out"], "left").select("uid", "pos", *key, F.coalesce("back", F.lit(0)).alias("back"), (F.col("out") - F.coalesce("back", F.lit(0))).alias("out"))
    outs = outs.withColumn("n_merged", F.count("*").over(Window.partitionBy(*key, "out")).cast("int"))
    met = base.withColumn("text", F.when(parent.isNull(), F.col("text")).otherwise(text)).join(outs, "uid")
    single = met.where("n_merged = 1").select(*names, "n_merged")
    places = F.struct("back", "pos", F.struct(*names).alias("row"))
    several = met.where("n_merged > 1").groupBy(*key, "out").agg(F.sort_array(F.collect_list(places)).alias("x"), F.first("n_merged").alias("n_merged"))
    part = lambda back: F.expr(f"transform(filter(x, e -> e.back = {back}), e -> e.row)")
    several = several.select("n_merged", part(0).alias("head"), part(1).alias("tail"))
    # what joins the output before it is one row by then
    first, rest = (lambda c: F.col(c)[0]), (lambda c: F.slice(c, 2, F.greatest(F.size(c), F.lit(1))))
    end = F.transform(F.slice("tail", 1, 1), lambda t: F.struct(*[_joined(c, t, rest("tail")).alias(c) for c in names]))
    several = several.select("n_merged", first("head").alias("first"), F.concat(rest("head"), end).alias("rest"))
    made = several.select(*[_joined(c, F.col("first"), F.col("rest")).alias(c) for c in names], "n_merged")
    return alone.unionByName(single).unionByName(made)


def _joined(name: str, first: Column, rest: Column) -> Column:
    """A field of the row that joins `first` and the rows of the array `rest`."""
    if name == "text":
        return F.aggregate(rest, first["text"], lambda a, r: _glue(a, r["text"]))
    if name == "char_count":
        return F.length(_joined("text", first, rest))
    if name == "chunk_id":
        return F.aggregate(rest, first["chunk_id"], lambda a, r: sha16(F.concat(empty_if_null(a), F.lit("|m+"), empty_if_null(r["chunk_id"]))))
    if name == "notes":
        return F.aggregate(rest, first["notes"], lambda a, r: _noted(a, F.concat(F.lit("merged_with="), r["chunk_id"])))
    if name in ("domains", "categories"):
        all_ = F.concat(F.array(first[name]), F.transform(rest, lambda r: r[name]))
        return F.when(F.size(rest) == 0, first[name]).otherwise(F.array_sort(F.array_distinct(F.flatten(F.filter(all_, lambda x: x.isNotNull())))))
    return first[name]


def merge_stats(rows: DataFrame, merged: DataFrame, least: int = MIN_LENGTH) -> DataFrame:
    """One row: records before and after merge_small, joined ones, short ones before and after, mean and longest after."""
    n = F.length(empty_if_null(F.col("text")))
    before = rows.agg(F.count("*").alias("n_before"), F.count_if(n < least).alias("short_before"))
    after = merged.agg(F.count("*").alias("n_after"), F.count_if(F.col("n_merged") > 1).alias("n_joined"), F.count_if(n < least).alias("short_after"), F.avg(n).alias("mean_chars"), F.max(n).alias("max_chars"))
    return before.join(F.broadcast(after), F.lit(True))


def merge_by_section(rows: DataFrame, depth: int = 2, most: int = MAX_LENGTH, title: str = "") -> DataFrame:
    """One record for the rows of one section: the first `depth` parts of section_path, parted by ">" and stripped.

    A path of fewer parts is taken as it is. The text is "[section]" and the texts, a line each, by section_path and
    chunk_id, cut at `most` characters; of a section only the first `most` rows can show in it, and no more are gathered. domains and
    categories are sorted unions of all rows; source_url, posted_at, crawled_at and freshness are those of the first.
    """
    path = empty_if_null(F.col("section_path"))
    parts = F.transform(F.split(path, ">"), strip)
    rows = rows.withColumn("section", F.when(F.size(parts) >= depth, F.array_join(F.slice(parts, 1, depth), " > ")).otherwise(path)).withColumn("path", path)
    order = F.struct(F.col("path").alias("s"), empty_if_null(F.col("chunk_id")).alias("id"))
    of_first = [c for c in ("source_url", "posted_at", "crawled_at", "freshness") if c in rows.columns]
    facts = rows.groupBy("section").agg(
        *[F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in ("domains", "categories")],
        F.min_by(F.struct(*of_first), order).alias("first"),
        F.count("*").alias("n_rows"),
    )
    nth = F.row_number().over(Window.partitionBy("section").orderBy("path", "chunk_id", "text"))
    shown = rows.select("section", "path", "chunk_id", F.substring(empty_if_null(F.col("text")), 1, most).alias("text")).withColumn("nth", nth).where(F.col("nth") <= most)
    texts = shown.groupBy("section").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "text"))), lambda r: r["text"]), "\n").alias("text"))
    whole = F.substring(F.concat(F.lit("["), F.col("section"), F.lit("]\n"), F.col("text")), 1, most)
    chunk = sha16(F.concat(F.col("section"), F.lit("|dept_merged")))
    return facts.join(texts, "section").select(
        chunk.alias("chunk_id"), F.lit(0).alias("chunk_index"), F.concat(F.lit("dept_merged_"), chunk).alias("parent_post_id"), F.concat(F.lit(title), F.col("section")).alias("source_title"), F.lit("T6").alias("source_type"),
        "section", F.col("section").alias("section_path"), whole.alias("text"), F.length(whole).alias("char_count"), F.lit("ko").alias("lang"), *[F.col(f"first.{c}").alias(c) for c in of_first],
        "domains", "categories", F.concat(F.lit("dept_merged from "), F.col("n_rows").cast("string"), F.lit(" cells")).alias("notes"), "n_rows",
    )


def route_cells(rows: DataFrame, is_cell: Column) -> tuple[DataFrame, DataFrame]:
    """(all but cells, cells); a null condition is false."""
    cell = F.coalesce(is_cell, F.lit(False))
    return rows.where(~cell), rows.where(cell)


def rechunk(rows: DataFrame, is_cell: Column, title: str = "", fields: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(split, merged, sections): all records split, once for all that follows; small ones joined but for cells, which stay; and cells by section too.

    Pieces of one index under one parent are joined in the order of their records: one without a parent of its own first, then by chunk_index and chunk_id.
    With `fields` (text among them), merged has only those, and n_merged.
    """
    place = F.struct(null_if_empty(F.col("parent_post_id")).isNotNull().alias("has_parent"), F.coalesce(F.col("chunk_index"), F.lit(0)).alias("at"), empty_if_null(F.col("chunk_id")).alias("id"))
    split = staged(split_records(rows.withColumn("record_place", place)).withColumn("uid", F.monotonically_increasing_id()))
    others, cells = route_cells(split, is_cell)
    cells = cells.drop("record_place", "uid", "record_chars")
    merged = merge_small(others.drop("record_chars"), ties=("record_place",), stored=True, fields=fields).unionByName(cells.select(*(fields or cells.columns), F.lit(1).alias("n_merged")))
    return split.drop("record_place", "uid"), merged, merge_by_section(cells, title=title)


def rechunk_stats(rows: DataFrame, split: DataFrame, merged: DataFrame, sections: DataFrame, is_cell: Column, least: int = MIN_LENGTH, most: int = MAX_LENGTH) -> DataFrame:
    """One row of counts and lengths over what rechunk() took and gave: inputs, records split, by strategy too, and their pieces,
    short records joined and what came of their parents, orphans, cells, sections, and outputs with their lengths."""
    n = F.col("char_count")
    cell, parted = F.coalesce(is_cell, F.lit(False)), null_if_empty(F.col("parent_post_id")).isNotNull()
    before = rows.agg(F.count("*").alias("n_in"), F.avg(n).alias("mean_in"), F.max(n).alias("max_in"))
    cut, first = F.col("strategy") != "none", F.col("chunk_index") == 0
    by = [F.count_if((F.col("strategy") == k) & first).alias(f"split_{k}") for k in ("article", "separator", "window")]
    cut = split.agg(F.count_if(cut & first).alias("split_sources"), *by, F.count_if(cut).alias("split_pieces"))
    grouped, short = ~cell & parted, n < least
    joined = F.when(grouped, F.col("n_merged") - 1 + (short & (F.col("n_merged") > 1)).cast("int")).otherwise(0)
    after = merged.agg(F.coalesce(F.sum(joined), F.lit(0)).alias("merge_sources"), F.count_if(grouped).alias("merge_results"), F.count_if(grouped & short).alias("orphans"), F.count_if(cell).alias("n_cells"))
    out = merged.select(n.alias("n"), F.lit(0).alias("s")).unionByName(sections.select(n.alias("n"), F.lit(1).alias("s")))
    out = out.agg(F.sum("s").alias("n_sections"), F.count("*").alias("n_out"), F.avg("n").alias("mean_out"), F.max("n").alias("max_out"), F.count_if((F.col("n") < least) & (F.col("s") == 0)).alias("short_out"), F.count_if((F.col("n") > most) & (F.col("s") == 0)).alias("long_out"))
    for one in (cut, after, out):  # one row each
        before = before.join(F.broadcast(one), F.lit(True))
    return before


def rechunk_report(split: DataFrame, merged: DataFrame, sections: DataFrame, is_cell: Column, section_file: str) -> DataFrame:
    """What rechunk() took and gave: a row of scope all with rechunk_stats(), and for each file and each domain a row with n_in and n_out.

    Sections count as a file of their own. Lengths, domains and files of the outputs are written once; texts are not. What was
    taken is read from the first pieces: each record has one.
    """
    rows = split.where("record_chars is not null").select("source_file", "domains", F.col("record_chars").alias("char_count"))
    merged = staged(merged.select("source_file", "parent_post_id", "domains", "n_merged", "char_count", F.coalesce(is_cell, F.lit(False)).alias("cell")))
    sections = staged(sections.select("domains", "char_count"))
    whole = rechunk_stats(rows, split, merged, sections, F.col("cell"))
    files = file_flow(rows, merged, sections.select(F.lit(section_file).alias("source_file")))
    flows = {"file": files.withColumnRenamed("source_file", "name"), "domain": domain_flow(rows, merged, sections).withColumnRenamed("domain", "name")}
    whole = whole.select(F.lit("all").alias("scope"), F.lit(None).cast("string").alias("name"), "*")
    for scope, flow in flows.items():
        whole = whole.unionByName(flow.select(F.lit(scope).alias("scope"), F.col("name").cast("string").alias("name"), "n_in", "n_out"), allowMissingColumns=True)
    return whole


def file_flow(rows: DataFrame, *after: DataFrame) -> DataFrame:
    """(source_file, n_in, n_out): records of each file before and after."""
    counted = rows.select("source_file", F.lit(1).alias("i"), F.lit(0).alias("o"))
    for df in after:
        counted = counted.unionByName(df.select("source_file", F.lit(0).alias("i"), F.lit(1).alias("o")))
    return counted.groupBy("source_file").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def domain_flow(rows: DataFrame, *after: DataFrame) -> DataFrame:
    """(domain, n_in, n_out): records of each domain before and after; a record of several domains counts in each."""
    counted = rows.select(F.explode("domains").alias("domain"), F.lit(1).alias("i"), F.lit(0).alias("o"))
    for df in after:
        counted = counted.unionByName(df.select(F.explode("domains").alias("domain"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    return counted.groupBy("domain").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def neighbour_context(rows: DataFrame, hits: DataFrame, reach: int = 1, span: int = 4096) -> DataFrame:
    """(chunk_id, context): for each hit the texts of its parent from `reach` rows before to `reach` after, by chunk_index and chunk_id.

    A row without a parent (null) has no neighbours. Rows of a parent are counted over ranges of `span` indexes, and then dealt
    to runs of about `span` rows, each with copies of `reach` rows of the runs on either side, so that no task sorts a large parent's texts.
    """
    text, span = empty_if_null(F.col("text")), max(span, 2 * reach + 1)
    alone = rows.where("parent_post_id is null").select("chunk_id", text.alias("context"))
    rows = rows.where("parent_post_id is not null").select("parent_post_id", F.coalesce(F.col("chunk_index"), F.lit(-1)).alias("at"), "chunk_id", text.alias("text"))
    part = F.floor(F.col("at") / span)
    counts = rows.groupBy("parent_post_id", part.alias("part")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("parent_post_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("parent_post_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("parent_post_id", "part").orderBy("at", "chunk_id")
    placed = rows.withColumn("part", part).withColumn("nth", F.row_number().over(inside)).join(counts, ["parent_post_id", "part"]).withColumn("place", F.col("base") + F.col("nth"))
    runs = F.array_distinct(F.transform(F.array(F.lit(-reach), F.lit(0), F.lit(reach)), lambda d: F.floor((F.col("place") + d) / span)))
    copied = placed.select("parent_post_id", "place", "chunk_id", "text", F.explode(runs).alias("run"))
    around = Window.partitionBy("parent_post_id", "run").orderBy("place").rowsBetween(-reach, reach)
    seen = copied.withColumn("context", F.array_join(F.collect_list("text").over(around), "\n")).where(F.floor(F.col("place") / span) == F.col("run")).select("chunk_id", "context")
    return seen.unionByName(alone).join(hits.select("chunk_id").distinct(), "chunk_id", "left_semi")
