"""Chat formatting: reply trees, their ranked branches, and reversible templates."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.staging import Rounds, staged

OPEN, CLOSE = "<|turn|>", "<|end|>"
# what could be read as control loses its first character to an escape; no control string is left in a text
_CONTROL = re.compile(r"\\|[<\[](?=\||/?s>|/?INST\])")
_NAME = {"\\": "\\\\", "<": "\\l", "[": "\\b"}
_CHARACTER = {"\\": "\\", "l": "<", "b": "[", "n": "\n"}
_ESCAPE = re.compile(r"\\([\\lbn])")
_TURN = re.compile(r"<\|turn\|>([^\n]*)\n(.*?)<\|end\|>\n", re.S)

FORMATTED = "tree_id long, leaf_id long, branch int, formatted string, loss array<struct<start: long, stop: long>>"


def escape(text: str) -> str:
    """The text with backslashes doubled and the first characters of control strings escaped."""
    return _CONTROL.sub(lambda m: _NAME[m[0]], text)


def unescape(text: str) -> str:
    """What escape() was given."""
    return _ESCAPE.sub(lambda m: _CHARACTER[m[1]], text)


def format_turns(turns: list[tuple[str, str]], loss_roles: frozenset[str]) -> tuple[str, list[dict[str, int]]]:
    """One text for the turns and the code point spans of the texts that the loss covers."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = OPEN + escape(role).replace("\n", "\\n") + "\n", escape(text)
        if role in loss_roles and body:
            spans.append({"start": at + len(head), "stop": at + len(head) + len(body)})
        parts += [head, body, CLOSE, "\n"]
        at += len(head) + len(body) + len(CLOSE) + 1
    return "".join(parts), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def _formatter(loss_roles: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [format_turns([(t["role"], t["text"]) for t in turns], loss_roles) for turns in batch.column(3).to_pylist()]
            spans = pa.array([s for _, s in done], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([f for f, _ in done], pa.string()), spans], ["tree_id", "leaf_id", "branch", "formatted", "loss"])

    return run


def tree_paths(nodes: DataFrame) -> DataFrame:
    """(tree_id, leaf_id, node_id, up, score): every node of every root-to-leaf path, its distance from the leaf and its score.

    nodes has tree_id, node_id, parent_id and score. Round k joins the paths found so far with the ancestors 2**k above
    each node, and those with themselves, so that the rounds grow with the logarithm of the depth. All rounds are one
    table, so that no plan grows with the depth; what is known of an ancestor travels with the step that leads to it,
    so that the many paths below a node never meet that node's row again. A node whose parent is null or missing is a
    root. Paths that never reach a root, as in a loop of parents, are left out.
    """
    key = ["tree_id", "node_id"]
    nodes = nodes.select(*key, "parent_id", "score").where("tree_id is not null and node_id is not null").dropDuplicates(key)
    above = nodes.select("tree_id", F.col("node_id").alias("parent_id"), F.col("score").alias("above_score"))
    up = staged(nodes.join(above, ["tree_id", "parent_id"]).select(*key, F.col("parent_id").alias("above"), "above_score"))
    inner = up.select(*key).withColumn("inner", F.lit(True))
    parents = up.select("tree_id", F.col("above").alias("node_id")).distinct().withColumn("parent", F.lit(True))
    roles = nodes.join(inner, key, "left").join(parents, key, "left")
    roles = staged(roles.select(*key, "score", F.col("inner").isNull().alias("root"), F.col("parent").isNull().alias("leaf")))
    roots = roles.where("root").select("tree_id", F.col("node_id").alias("above")).withColumn("root", F.lit(True))
    up = staged(up.join(roots, ["tree_id", "above"], "left").select(*key, "above", "above_score", F.coalesce("root", F.lit(False)).alias("root")))
    most = roles.groupBy("tree_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    paths = Rounds(nodes.sparkSession)
    paths.add(roles.where("leaf").select("tree_id", F.col("node_id").alias("leaf_id"), "node_id", F.lit(0).cast("long").alias("up"), "score", "root"))
    step = 1
    while step < most:
        below = paths.rows().where("not root").select("tree_id", "leaf_id", "node_id", "up").join(up, key)
        more = paths.add(below.select("tree_id", "leaf_id", F.col("above").alias("node_id"), (F.col("up") + step).alias("up"), F.col("above_score").alias("score"), "root"))
        if more.isEmpty():
            break
        step *= 2
        if step < most:
            next_ = up.select("tree_id", F.col("node_id").alias("above"), F.col("above").alias("far"), F.col("above_score").alias("far_score"), F.col("root").alias("far_root"))
            up = staged(up.where("not root").drop("root", "above_score").join(next_, ["tree_id", "above"]).select(*key, F.col("far").alias("above"), F.col("far_score").alias("above_score"), F.col("far_root").alias("root")))
    whole = paths.rows().where("root").select("tree_id", "leaf_id")
    return staged(paths.rows().join(whole, ["tree_id", "leaf_id"], "left_semi").select("tree_id", "leaf_id", "node_id", "up", "score"))


def format_trees(nodes: DataFrame, branches: int = 1, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per chosen branch (columns of FORMATTED): its turns as one text, and the spans that the loss covers.

    nodes has tree_id, node_id, parent_id, role, text and score. A branch is a root-to-leaf path; branches of a tree
    are ranked by the mean score of their nodes (null: 0), ties by the smaller leaf_id, and the first `branches`
    are formatted from the root down. Null roles and texts are empty; control strings inside either are escaped,
    and parse_turns() gives back what went in. Of rows that repeat a tree_id and node_id one is taken (the least
    role, text). A conversation is one row of output and is put together in one task. An empty table gives no rows.
    """
    first = Window.partitionBy("tree_id", "node_id").orderBy("parent_id", "role", "text", "score")
    rows = nodes.select("tree_id", "node_id", "parent_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"))
    rows = staged(rows.where("tree_id is not null and node_id is not null").withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth"))
    paths = tree_paths(rows)
    scored = paths.groupBy("tree_id", "leaf_id").agg(F.avg("score").alias("score"))
    best = Window.partitionBy("tree_id").orderBy(F.desc("score"), "leaf_id")
    chosen = staged(scored.withColumn("branch", F.row_number().over(best)).where(F.col("branch") <= branches).select("tree_id", "leaf_id", "branch"))
    turns = paths.join(chosen, ["tree_id", "leaf_id"]).join(rows.select("tree_id", "node_id", "role", "text"), ["tree_id", "node_id"])
    down = F.struct((-F.col("up")).alias("down"), "role", "text")
    grouped = turns.groupBy("tree_id", "leaf_id", "branch").agg(F.sort_array(F.collect_list(down)).alias("turns"))
    return grouped.mapInArrow(_formatter(frozenset(loss_roles)), FORMATTED)


def linear_trees(conversations: DataFrame) -> DataFrame:
    """Conversations(conv_id, turn, role, text) as trees in which every row answers the one before it.

    Rows of a conversation are ordered by turn (null first), role and text; rows without a conv_id are left out.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("tree_id"), F.row_number().over(order).cast("long").alias("node_id"), "role", "text")
    return rows.select("tree_id", "node_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


READ_BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            turns = parse_turns(text)
            loss = "".join(unescape(text[s["start"] : s["stop"]]) for s in spans)
            digest = hashlib.sha256("".join(f"{role}\n{said}\n" for role, said in turns).encode())
            rows.append((len(turns), digest.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], [c.split()[0] for c in READ_BACK.split(", ")])


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests (columns of READ_BACK) of what stands in formatted texts and under their loss spans."""
    return formatted.select("tree_id", "formatted", "loss").mapInArrow(_read_back, READ_BACK)


OP8_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, regexp_replace(replace(text, '\', '\\'), '<(\||/?s>)', '\\l\1', 'g') AS a FROM t
), f AS (
  SELECT conv_id, turn, role, text, regexp_replace(a, '\[(/?INST\])', '\\b\1', 'g') AS escaped FROM e
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(17 + length(role) + length(escaped)) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""


def op8_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(format_trees(linear_trees(conversations.unionByName(extra))))
