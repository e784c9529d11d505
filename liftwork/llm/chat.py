"""Chat formatting of reply trees (native: DataFrame functions only).

Messages are nodes of trees. Iterative self-joins double the reach of every node's ancestor
pointer, so paths of depth d need log2(d) joins; path scores add up on the way. Leaves are ranked
by the score of their path, and the nodes of each chosen path are enumerated from the same
pointer tables, nearest first.

Template: `<s>`, then for each turn `[role]text</s>`. In texts and roles the characters that can
open a mark are replaced (see ESCAPES), so that no text can form one; `unescape` undoes it. The
loss mask is a list of character spans of the formatted text that cover the assistant's texts.

Defined cases: null text and null role count as empty; a parent that does not exist makes a root;
of rows with one node id the least (parent, role, text) counts; nodes on or behind a cycle have no
root and are left out; equal scores are ranked by leaf id; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch

#: Fixed values of the template, in the order of replacement.
ESCAPES = [("\\", "\\0"), ("<", "\\1"), ("[", "\\2"), ("]", "\\3")]
BEGIN, END, ASSISTANT = "<s>", "</s>", "assistant"


def escape(c: Column) -> Column:
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ESCAPES, c)


def unescape(c: Column) -> Column:
    return reduce(lambda x, e: F.replace(x, F.lit(e[1]), F.lit(e[0])), reversed(ESCAPES), c)


def tree_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, leaf, rank, node, dist) of each tree's best `branches` root-to-leaf paths, dist counted from the leaf.

    nodes: tree, node, parent, score. The number of rounds is bounded by log2 of the row count, beyond
    which only cycles are left.
    """
    there = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    first = nodes.join(there, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("known"), F.col("parent")).alias("up"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    first = scratch(first, "jump0")
    rooted, climbing = first.filter("up IS NULL"), first.filter("up IS NOT NULL")
    jumps, rounds = [], max(1, nodes.count()).bit_length() + 1
    while len(jumps) < rounds and not climbing.isEmpty():
        jumps.append(climbing.select("tree", "node", "up"))
        above = rooted.unionByName(climbing).select("tree", F.col("node").alias("up"), F.col("up").alias("next"), F.col("score").alias("more"))
        moved = climbing.join(above, ["tree", "up"]).select("tree", "node", F.col("next").alias("up"), (F.col("score") + F.col("more")).alias("score"))
        moved = scratch(moved, f"jump{len(jumps)}")  # only nodes that are not at their root yet go on
        rooted, climbing = rooted.unionByName(moved.filter("up IS NULL")), moved.filter("up IS NOT NULL")
    parents = first.filter("up IS NOT NULL").select("tree", F.col("up").alias("node")).distinct()
    leaves = rooted.join(parents, ["tree", "node"], "left_anti")
    best = Window.partitionBy("tree").orderBy(F.desc("score"), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= branches)
    paths = scratch(chosen.select("tree", F.col("node").alias("leaf"), "rank", "node", F.lit(0).alias("dist")), "paths")
    for k, jump in enumerate(jumps):
        more = paths.join(jump, ["tree", "node"]).select("tree", "leaf", "rank", F.col("up").alias("node"), (F.col("dist") + 2**k).alias("dist"))
        paths = scratch(paths.unionByName(more), f"paths{k}")
    return paths


def format_trees(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, leaf, rank, formatted, loss_spans) of the best branches.

    messages: tree, node, parent, role, text, score.
    """
    one = Window.partitionBy("tree", "node").orderBy("parent", "role", "text")
    messages = scratch(
        messages.select("tree", "node", "parent", "score", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("nth", F.row_number().over(one)).filter("nth = 1").drop("nth"),
        "messages",
    )
    paths = tree_paths(messages.select("tree", "node", "parent", "score"), branches)
    before = Window.partitionBy("tree", "leaf").orderBy(F.desc("dist")).rowsBetween(Window.unboundedPreceding, -1)
    head = F.concat(F.lit("["), escape(F.col("role")), F.lit("]"))
    body = escape(F.col("text"))
    turns = (
        paths.join(messages.select("tree", "node", "role", "text"), ["tree", "node"])
        .select("tree", "leaf", "rank", "dist", F.col("role"), head.alias("head"), body.alias("body"))
        .withColumn("at", F.coalesce(F.sum(F.length("head") + F.length("body") + len(END)).over(before), F.lit(0)) + len(BEGIN) + F.length("head"))
    )
    turn = F.struct((-F.col("dist")).alias("nth"), F.concat("head", "body", F.lit(END)).alias("piece"), F.when(F.col("role") == ASSISTANT, F.struct(F.col("at").alias("start"), (F.col("at") + F.length("body")).alias("end"))).alias("span"))
    return (
        turns.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
        .select(
            "tree", "leaf", "rank",
            F.concat(F.lit(BEGIN), F.array_join("turns.piece", "")).alias("formatted"),
            F.filter("turns.span", lambda s: s.isNotNull()).alias("loss_spans"),
        )
    )


def read_turns(formatted: Column) -> Column:
    """The (role, text) pairs of a formatted conversation."""
    pieces = F.split(F.substr(formatted, F.lit(len(BEGIN) + 1)), END, -1)
    mark = r"(?s)^\[([^\]]*)\](.*)$"
    return F.transform(
        F.slice(pieces, F.lit(1), F.size(pieces) - 1),
        lambda x: F.struct(unescape(F.regexp_extract(x, mark, 1)).alias("role"), unescape(F.regexp_extract(x, mark, 2)).alias("text")),
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def conversation_messages(turns: DataFrame) -> DataFrame:
    """Turn tables as trees: each turn replies to the one before it. Rows with equal turns follow each other by role and text."""
    nth = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    n = F.row_number().over(nth)
    return turns.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("tree"), n.alias("node"), (n - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    done = format_trees(conversation_messages(turns.unionByName(probe)))
    text = F.col("formatted")
    read = done.select("tree", "formatted", read_turns(text).alias("turns"), read_loss(text, F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.when(F.col("tree") != "", F.col("tree")).cast("long").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP4_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(role) + length(regexp_replace(role, '[^\\<\[\]]', '', 'g'))
          + length(text) + length(regexp_replace(text, '[^\\<\[\]]', '', 'g')) + 6 AS chars FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(3 + sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
