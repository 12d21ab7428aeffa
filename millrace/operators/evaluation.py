"""Scores of retrieval, answers and judges, and checks of the questions themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import empty_if_null, judged_reason, judged_score
from millrace.sources.tables import staged

# fixed values
KS = (1, 5, 10, 20)
QUESTION_FIELDS = (
    "qa_id", "question", "answer_gold", "domain", "categories", "question_type", "expected_source_urls", "is_fallback_expected",
    "tags", "created_by", "reviewed_by", "created_at", "reviewed_at", "gen_prompt_version", "notes",
)


def rate(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def hits_at_k(questions: DataFrame, hits: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """(qa_id, best_rank, hit_1, ...): whether an expected address is among those of the first k hits.

    questions has qa_id and expected_source_urls; hits has qa_id, rank and urls (all addresses of the hit).
    """
    wanted = questions.select("qa_id", F.explode("expected_source_urls").alias("url")).distinct()
    best = hits.select("qa_id", "rank", F.explode("urls").alias("url")).join(wanted, ["qa_id", "url"]).groupBy("qa_id").agg(F.min("rank").alias("best_rank"))
    found = questions.join(best, "qa_id", "left")
    return found.select("qa_id", "best_rank", *[F.coalesce(F.col("best_rank") <= k, F.lit(False)).alias(f"hit_{k}") for k in ks])


def recall(questions: DataFrame, found: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """Mean recall at each k over questions that expect an answer, in all (domain null) and by domain."""
    rows = questions.where("not is_fallback_expected").join(found, "qa_id")
    return rows.rollup("domain").agg(F.count("*").alias("n"), *[F.avg(F.col(f"hit_{k}").cast("int")).alias(f"recall_{k}") for k in ks])


def confusion(rows: DataFrame) -> DataFrame:
    """One row: expected against used fallbacks, precision and recall with denominators of at least 1."""
    e, u = F.col("is_fallback_expected"), F.col("used_fallback")
    tp, fp, fn, tn = F.count_if(e & u), F.count_if(~e & u), F.count_if(e & ~u), F.count_if(~e & ~u)
    return rows.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), rate(tp, tp + fp).alias("precision"), rate(tp, tp + fn).alias("recall"))


def hard_misses(questions: DataFrame, found: DataFrame, hits: DataFrame, k: int = 20) -> DataFrame:
    """Questions that expect an answer and have no hit in the first k, with the first hit that they got."""
    missed = questions.where("not is_fallback_expected").join(found.where(f"not hit_{k}").select("qa_id"), "qa_id", "left_semi")
    return missed.join(hits.where("rank = 1").select("qa_id", F.col("chunk_id").alias("top_chunk"), F.col("rrf_score").alias("top_score")), "qa_id", "left").select("qa_id", "domain", "top_chunk", "top_score")


def auto_score(expected: Column, used: Column) -> Column:
    """2 for a rightly used fallback, 0 for a wrong use or a missing one, null where a judge must read."""
    return F.when(expected & used, 2).when(expected | used, 0)


def judge_rows(answers: DataFrame, raw: DataFrame, done: DataFrame) -> DataFrame:
    """Scores of answers that are not among `done`: by rule where that decides, else from a judge's raw output(qa_id, judge_raw); -1 without a readable one."""
    rows = answers.join(done.select("qa_id").distinct(), "qa_id", "left_anti").join(raw, "qa_id", "left")
    auto = auto_score(F.col("is_fallback_expected"), F.col("used_fallback"))
    return rows.select(
        "qa_id", "domain", "question_type", "is_fallback_expected", "used_fallback",
        F.coalesce(auto, judged_score(F.col("judge_raw"))).alias("judge_score"),
        F.when(auto.isNotNull(), "auto").otherwise("llm").alias("judge_source"),
        F.when(auto.isNull(), judged_reason(F.col("judge_raw"))).alias("judge_reason"),
    )


def judge_aggregate(judged: DataFrame) -> DataFrame:
    """Rates over valid scores (0 or more): overall, by domain, by source and by type of question, in one pass.

    facet names the grouping and value its key.
    """
    s = F.col("judge_score")
    valid = F.count_if(s >= 0)
    measures = [
        F.count("*").alias("n"), valid.alias("n_valid"), F.round(F.avg(F.when(s >= 0, s)), 3).alias("mean_score"), F.round(rate(F.count_if(s == 2), valid), 3).alias("correct_rate"),
        F.count_if(s == 0).alias("n_0"), F.count_if(s == 1).alias("n_1"), F.count_if(s == 2).alias("n_2"),
    ]
    columns = [F.col("domain"), F.col("judge_source"), F.col("question_type")]
    grouped = judged.groupingSets([[], *[[c] for c in columns]], *columns).agg(F.grouping_id().alias("g"), *measures)
    facet = F.when(F.col("g") == 7, "all").when(F.col("g") == 3, "domain").when(F.col("g") == 5, "source").otherwise("type")
    return grouped.withColumn("facet", facet).withColumn("value", F.coalesce(F.col("domain").cast("string"), "judge_source", "question_type", F.lit("all"))).drop("g", "domain", "judge_source", "question_type")


def low_scores(judged: DataFrame, most: int = 30) -> DataFrame:
    """The first rows by qa_id with score 0 (a report of fixed length)."""
    return judged.where("judge_score = 0").orderBy("qa_id").limit(most)


def answer_metrics(answers: DataFrame) -> DataFrame:
    """Per domain: answers, standard questions, length of answers, rate of fallbacks, precision at 1 and 3.

    Precision counts standard questions that name addresses; sources are in rank order and only their own address counts.
    """
    standard = ~F.col("is_fallback_expected")
    eligible = standard & (F.size("expected_source_urls") > 0)
    at = lambda k: F.avg(F.when(eligible, F.arrays_overlap(F.transform(F.slice("sources", 1, k), lambda s: s["source_url"]), F.col("expected_source_urls")).cast("int")))
    n = F.length(empty_if_null(F.col("generated_answer")))
    return answers.groupBy("domain").agg(
        F.count("*").alias("n"), F.count_if(standard).alias("n_standard"), F.floor(F.avg(n)).alias("mean_length"), F.max(n).cast("long").alias("max_length"),
        F.avg(F.col("used_fallback").cast("int")).alias("fallback_rate"), at(1).alias("p_at_1"), at(3).alias("p_at_3"),
    )


def pending(questions: DataFrame, answers: DataFrame) -> DataFrame:
    return questions.join(answers.select("qa_id").distinct(), "qa_id", "left_anti")


def threshold_sweep(rows: DataFrame, thresholds: DataFrame) -> DataFrame:
    """For each threshold what it would unblock: fallback rows of at least that score, answers won, fallbacks lost.

    rows has used_fallback, top_rerank_score, judge_score, gold_in_sources and is_fallback_expected. Rows are counted by
    score; scores and thresholds are dealt to ranges, and a threshold gets what lies above it in its range and the sums of
    the ranges above. A null threshold unblocks nothing; a repeated one gives a row each time.
    """
    names = ["unblocked", "recovery", "regression"]
    won, lost = F.count_if((F.col("judge_score") == 0) & F.col("gold_in_sources")), F.count_if(F.col("is_fallback_expected"))
    blocked = rows.where("used_fallback and top_rerank_score is not null").groupBy(F.col("top_rerank_score").cast("double").alias("x"))
    counts = blocked.agg(F.count("*").alias("unblocked"), won.alias("recovery"), lost.alias("regression"))
    asked = thresholds.where("t is not null").select(F.col("t").cast("double").alias("x"), *[F.lit(0).cast("long").alias(c) for c in names])
    points = counts.unionByName(asked).groupBy("x").agg(*[F.sum(c).alias(c) for c in names])
    points = staged(points.repartitionByRange("x").withColumn("range", F.spark_partition_id()))
    # a row for each range
    sums = points.groupBy("range").agg(F.max("x").alias("top"), *[F.sum(c).alias(f"{c}_range") for c in names])
    above = Window.orderBy(F.desc("top")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("range", *[F.coalesce(F.sum(f"{c}_range").over(above), F.lit(0)).alias(f"{c}_above") for c in names])
    upto = Window.partitionBy("range").orderBy(F.desc("x")).rowsBetween(Window.unboundedPreceding, 0)
    freed = points.join(F.broadcast(sums), "range").select("x", *[(F.sum(c).over(upto) + F.col(f"{c}_above")).alias(c) for c in names])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    placed = thresholds.select("t").join(freed, F.col("t").cast("double") == F.col("x"), "left")
    return placed.select("t", *[zero(c).alias(c) for c in names], (zero("recovery") - zero("regression")).alias("net"))


def score_percentiles(rows: DataFrame, percents: tuple[int, ...] = (10, 25, 50, 75)) -> DataFrame:
    """Per group the scores at place floor(n * p / 100) of their order, least, most, and the share below 0.3.

    Counts of equal scores are summed first, so that only distinct scores are ordered within a group.
    """
    counted = rows.where("score is not null").groupBy("grp", "score").agg(F.count("*").alias("k"))
    up, whole = Window.partitionBy("grp").orderBy("score").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("grp")
    placed = counted.withColumn("upto", F.sum("k").over(up)).withColumn("n", F.sum("k").over(whole))
    at = lambda p: F.min(F.when(F.col("upto") > F.least(F.col("n") - 1, F.floor(F.col("n") * p / 100)), F.col("score"))).alias(f"p{p}")
    return placed.groupBy("grp").agg(F.sum("k").alias("n"), *[at(p) for p in percents], F.min("score").alias("least"), F.max("score").alias("most"), (F.sum(F.when(F.col("score") < 0.3, F.col("k")).otherwise(0)) / F.sum("k")).alias("share_low"))


def validate_questions(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """(qa_id, errors): what is wrong with each question; an id is taken by the first row (by seq) without other errors, or by an existing one."""
    wrong = lambda test, name: F.when(F.coalesce(test, F.lit(True)), name)
    own = F.array_compact(F.array(
        wrong(empty_if_null(F.col("qa_id")) == "", "no id"), wrong(empty_if_null(F.col("question")) == "", "no question"), wrong(~F.col("domain").between(1, 9), "domain"),
        wrong(~F.col("question_type").isin("A", "B", "C", "D"), "type"), wrong(F.size(F.coalesce("tags", F.array())) == 0, "no tag"), wrong(F.col("is_fallback_expected").isNull(), "fallback"),
    ))
    return _taken(rows.withColumn("own", own), existing)


def validate_raw(rows: DataFrame, existing: DataFrame, fields: tuple[str, ...] = QUESTION_FIELDS) -> DataFrame:
    """(seq, qa_id, errors) for questions as JSON text, rows(seq, raw): fields that are missing or too many, fields of a
    wrong type, values out of range, and ids taken as in validate_questions()."""
    typed = F.from_json("raw", "qa_id string, domain int, question_type string, is_fallback_expected boolean, expected_source_urls array<string>, categories array<string>, tags array<string>").alias("q")
    keys = F.coalesce(F.json_object_keys("raw"), F.array().cast("array<string>"))
    parsed = rows.select("seq", typed, keys.alias("keys"))
    wanted = F.array(*map(F.lit, fields))
    missing, extra = (F.array_join(F.array_sort(x), ",") for x in (F.array_except(wanted, "keys"), F.array_except("keys", wanted)))
    q = lambda c: F.col(f"q.{c}")
    wrong = lambda test, name: F.when(F.coalesce(test, F.lit(True)), name)
    own = F.array_compact(F.array(
        F.when(missing != "", F.concat(F.lit("missing "), missing)), F.when(extra != "", F.concat(F.lit("extra "), extra)), wrong(empty_if_null(q("qa_id")) == "", "no id"),
        wrong(~q("domain").between(1, 9), "domain"), wrong(~q("question_type").isin("A", "B", "C", "D"), "type"), F.when(q("expected_source_urls").isNull(), "urls no list"), F.when(q("categories").isNull(), "categories no list"),
        wrong(F.size(q("tags")) < 1, "no tag"), F.when(q("is_fallback_expected").isNull(), "fallback"),
    ))
    return _taken(parsed.select("seq", q("qa_id").alias("qa_id"), own.alias("own")), existing)


def _taken(checked: DataFrame, existing: DataFrame) -> DataFrame:
    """(seq, qa_id, errors): an id belongs to the first row without an error, or to an existing question."""
    nth = F.row_number().over(Window.partitionBy("qa_id", F.size("own") == 0).orderBy("seq"))
    known = existing.select("qa_id").distinct().withColumn("known", F.lit(True))
    again = checked.withColumn("nth", nth).join(known, "qa_id", "left")
    repeat = F.when((F.size("own") == 0) & ((F.col("nth") > 1) | F.coalesce("known", F.lit(False))), F.array(F.lit("repeated id"))).otherwise(F.array().cast("array<string>"))
    return again.select("seq", "qa_id", F.concat("own", repeat).alias("errors"))


def url_coverage(questions: DataFrame, corpus_urls: DataFrame) -> DataFrame:
    """Per question: expected addresses, and those that the corpus has."""
    wanted = questions.select("qa_id", F.explode("expected_source_urls").alias("url"))
    known = corpus_urls.select("url").distinct().withColumn("known", F.lit(1))
    return wanted.join(known, "url", "left").groupBy("qa_id").agg(F.count("*").alias("n_expected"), F.count("known").alias("n_known"))


def question_matrix(questions: DataFrame) -> DataFrame:
    """Per domain: questions of each type, standard and fallback ones, and all."""
    types = [F.count_if(F.col("question_type") == t).alias(t) for t in "ABCD"]
    return questions.groupBy("domain").agg(*types, F.count_if(~F.col("is_fallback_expected")).alias("n_standard"), F.count_if("is_fallback_expected").alias("n_fallback"), F.count("*").alias("n"))


def apply_review(questions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Reviewed questions: Edit puts its question, answer and note in place, Accept and Edit stay, Reject goes to its own status."""
    rows = questions.join(decisions.select("qa_id", "decision", "edited_question", "edited_answer", "edit_note"), "qa_id", "left")
    edit = F.col("decision") == "Edit"
    put = lambda new, old: F.when(edit, F.coalesce(F.col(new), F.col(old))).otherwise(F.col(old)).alias(old)
    status = F.when(F.col("decision").isNull(), "open").when(F.col("decision") == "Reject", "rejected").otherwise("accepted")
    return rows.select("qa_id", "domain", put("edited_question", "question"), put("edited_answer", "answer_gold"), F.when(edit, F.col("edit_note")).alias("notes"), status.alias("status"))


def accept_rates(reviewed: DataFrame, goal: float = 0.6) -> DataFrame:
    """Per domain the share of accepted among decided questions, and whether it reaches the goal."""
    decided, yes = F.count_if(F.col("status") != "open"), F.count_if(F.col("status") == "accepted")
    return reviewed.groupBy("domain").agg(decided.alias("n_decided"), yes.alias("n_accepted"), rate(yes, decided).alias("accept_rate"), (rate(yes, decided) >= goal).alias("reached"))
