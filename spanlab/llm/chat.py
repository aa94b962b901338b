"""Chat formatting of reply trees (operator 9).  DataFrame functions only.

Messages form trees by their parent.  Children are ranked by score; paths from
a root to a leaf that pass only children of rank <= ``branches`` are chosen.
Iterative self-joins double the distance they look up at each round, so a tree
of depth d takes log2(d) rounds, and each chosen path becomes one conversation.

Format: ``[INST]role[/INST]text</s>`` for each turn.  Inside roles and texts a
control string gets one backslash after its first character (and one more if
backslashes stand there already); reading removes one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import shared

OPEN, CLOSE, END = "[INST]", "[/INST]", "</s>"
_RAW = r"([<\[])(\\*)(/?s>|/?INST\])"
_ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _RAW, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """messages (node, parent, score, ...) -> (leaf, node, depth): the nodes of each chosen root-to-leaf path.

    node: unique and not null.  A null or unknown parent makes a root.  Ties in
    score go to the smaller node.  Nodes on a cycle or below one have no root and
    are left out.  Other columns are ignored; an empty table gives none.
    """
    base = messages.select("node", "parent", "score")
    known = base.select(F.col("node").alias("_p"))
    tree = base.join(known, base["parent"] == known["_p"], "left").select("node", F.col("_p").alias("parent"), "score")
    place = F.row_number().over(W.partitionBy("parent").orderBy(F.col("score").desc_nulls_last(), "node"))
    # only the best children go on, so a parent of very many meets few of them; roots are not siblings of each other
    best = tree.where("parent is not null").withColumn("_r", place).where(F.col("_r") <= branches).select("node", "parent")
    kept = best.unionByName(tree.where("parent is null").select("node", "parent"))
    inner = tree.where("parent is not null").select(F.col("parent").alias("_c")).distinct()
    now = shared.put(kept.join(inner, kept["node"] == inner["_c"], "left").select(
        "node", F.col("parent").alias("up"), F.col("_c").isNull().alias("leaf"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("bigint").alias("steps")), "tree")
    longest = now.count().bit_length()  # rounds after which only nodes on a cycle, or below one, can be short of a root
    jumps = []
    while len(jumps) <= longest and not now.where("up is not null").isEmpty():
        jumps.append(now.select("node", "up").where("up is not null"))
        far = now.select(F.col("node").alias("_n"), F.col("up").alias("_u"), F.col("steps").alias("_s"))
        # only nodes that haven't reached their root look further up; below a node that was not chosen there is nothing
        moved = now.where("up is not null").join(far, F.col("up") == F.col("_n")).select(
            "node", F.col("_u").alias("up"), "leaf", (F.col("steps") + F.col("_s")).alias("steps"))
        now = shared.put(now.where("up is null").unionByName(moved), "tree")
    out = now.where("up is null and leaf").select(F.col("node").alias("leaf"), "node", F.col("steps").alias("depth"))
    for k in range(len(jumps) - 1, -1, -1):
        j = jumps[k].select(F.col("node").alias("_n"), "up")
        # written at each round: the plan would double with every union
        out = shared.put(out.unionByName(out.join(j, out["node"] == j["_n"]).select("leaf", F.col("up").alias("node"), (F.col("depth") - (1 << k)).alias("depth"))), "paths")
    return out


def format_paths(messages: DataFrame, chosen: DataFrame) -> DataFrame:
    """One conversation per leaf: leaf, formatted.  Null roles and texts count as empty."""
    m = messages.select(F.col("node").alias("_n"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turn = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(CLOSE), escape(F.col("text")), F.lit(END))
    rows = chosen.join(m, chosen["node"] == m["_n"]).select("leaf", "depth", turn.alias("turn"))
    whole = rows.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("depth", "turn"))).alias("turns"))
    return whole.select("leaf", F.array_join(F.col("turns.turn"), "").alias("formatted"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> from a formatted conversation."""
    parts = F.filter(F.split(formatted, F.lit(r"</s>"), -1), lambda x: x.startswith(OPEN))
    return F.transform(parts, lambda x: F.struct(
        unescape(F.substring(F.substring_index(x, CLOSE, 1), len(OPEN) + 1, 1 << 30)).alias("role"),
        unescape(F.substr(x, F.length(F.substring_index(x, CLOSE, 1)) + len(CLOSE) + 1)).alias("text")))


def loss_mask(formatted: Column) -> Column:
    """array<struct<start, length>>: code points of the assistant texts, 0-based."""
    parts = F.filter(F.split(formatted, F.lit(r"</s>"), -1), lambda x: x.startswith(OPEN))
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.slice(F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("length"))), 1, 0).alias("mask"))

    def step(s, x):
        head = F.length(F.substring_index(x, CLOSE, 1)) + len(CLOSE)
        mine = F.array(F.struct((s["at"] + head).cast("bigint").alias("start"), (F.length(x) - head).cast("bigint").alias("length")))
        return F.struct((s["at"] + F.length(x) + len(END)).cast("bigint").alias("at"),
                        F.when(x.startswith(OPEN + "assistant" + CLOSE), F.concat(s["mask"], mine)).otherwise(s["mask"]).alias("mask"))

    return F.aggregate(parts, zero, step)["mask"]


def chains(turns: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) as trees: each turn replies to the one before.

    Equal turns are ordered by role and text; repeated rows stay.  Node: conv_id and place.
    """
    place = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = turns.select("conv_id", "role", "text", place.cast("bigint").alias("place"))
    return rows.select(F.struct("conv_id", "place").alias("node"),
                       F.when(F.col("place") > 1, F.struct("conv_id", (F.col("place") - 1).alias("place"))).alias("parent"),
                       F.lit(0.0).alias("score"), "role", "text")
