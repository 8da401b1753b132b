"""Chat formatting of reply trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm._shared import Scratch

#: The template's marks: <|turn|>role, a line feed, the text, <|end|>, a line feed.
TURN, END = "<|turn|>", "<|end|>\n"
#: Control strings, as a first character and the rest: those of this template and of common others. Inside roles and
#: texts a backslash goes between the two, and one more where backslashes stand there already, so it can be undone.
_HEAD, _REST = r"([<\[])", r"(\||s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, _HEAD + r"(\\*)" + _REST, r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, _HEAD + r"\\(\\*)" + _REST, r"$1$2$3")


def escape_role(c: Column) -> Column:
    """Also keeps a role on its line."""
    return escape(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(c: Column) -> Column:
    return F.replace(F.replace(unescape(c), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def linear_replies(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, node, parent, score, role, text): each row replies to the one before it by turn.

    Rows of one turn follow each other by role, then text, null turns first; null roles and texts are empty; repeated
    rows are turns of their own.
    """
    own = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    k = F.row_number().over(Window.partitionBy("conv").orderBy("turn", "role", "text")).cast("bigint") - 1
    own = own.withColumn("node", k)
    return own.select("conv", "node", F.when(F.col("node") > 0, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def branches(scratch: Scratch, nodes: DataFrame, keep: int | None = None) -> DataFrame:
    """(conv, leaf, rank, depth, node) of root-to-leaf paths of the trees nodes(conv, node, parent, score): all, or the
    `keep` best of each tree.

    Self-joins that double in reach: after step k a node knows its ancestor 2^k above, so paths of any length take
    log2(length) joins. First the scores along the paths are summed so, in one row per node; then only the leaves that
    are kept are followed up to their roots. A path's rank is by the sum of its scores, the highest first, then the
    smaller leaf. A parent that isn't there is a root's; nodes on a cycle reach no root and have no path. A conversation's
    nodes have numbers of their own. Null conv is one conversation.
    """
    same = lambda a, b: F.col(f"{a}.conv").eqNullSafe(F.col(f"{b}.conv"))
    own = nodes.select("conv", "node", F.col("parent").alias("up"), "score").alias("n")
    there = nodes.select("conv", F.col("node").alias("p")).distinct().alias("p")
    up = own.join(there, same("n", "p") & (F.col("n.up") == F.col("p.p")), "left").select("n.conv", "n.node", F.col("p.p").alias("up"), "n.score")
    up = scratch.keep(up, "replies")
    parents = up.where("up is not null").select("conv", F.col("up").alias("p")).distinct().alias("p")
    leaves = up.alias("n").join(parents, same("n", "p") & (F.col("n.node") == F.col("p.p")), "left_anti").select("conv", "node")
    # jumps[k]: (conv, node, up, sum, hops) of nodes that have an ancestor `up` 2^k replies above, with the scores below it;
    # done: (conv, node, sum, hops) of nodes whose way to the root is less than that, with the root's score.
    jumps = [scratch.keep(up.where("up is not null").select("conv", "node", "up", F.col("score").alias("sum")), "jump")]
    done = scratch.keep(up.where("up is null").select("conv", "node", F.col("score").alias("sum"), F.lit(0).cast("bigint").alias("hops")), "done")
    limit, k = up.count(), 0
    while not jumps[k].isEmpty() and (1 << k) <= limit:
        a, d, b = jumps[k].alias("a"), done.alias("d"), jumps[k].alias("b")
        ends = a.join(d, same("a", "d") & (F.col("a.up") == F.col("d.node"))).select("a.conv", "a.node", (F.col("a.sum") + F.col("d.sum")).alias("sum"), (F.col("d.hops") + (1 << k)).alias("hops"))
        ends = scratch.keep(ends, "done")
        twice = a.join(b, same("a", "b") & (F.col("a.up") == F.col("b.node"))).select("a.conv", "a.node", F.col("b.up").alias("up"), (F.col("a.sum") + F.col("b.sum")).alias("sum"))
        jumps.append(scratch.keep(twice, "jump"))
        done, k = done.union(ends), k + 1
    l, d = leaves.distinct().alias("l"), done.alias("d")
    paths = l.join(d, same("l", "d") & (F.col("l.node") == F.col("d.node"))).select("d.conv", F.col("d.node").alias("leaf"), "sum", "hops")
    if keep == 1:
        best = paths.groupBy("conv").agg(F.min_by(F.struct("leaf", "hops"), F.struct((-F.col("sum")).alias("s"), "leaf")).alias("p"))
        paths = best.select("conv", "p.leaf", "p.hops", F.lit(0).alias("rank"))
    else:
        paths = paths.withColumn("rank", F.row_number().over(Window.partitionBy("conv").orderBy(F.col("sum").desc(), "leaf")) - 1)
        paths = paths if keep is None else paths.where(F.col("rank") < keep)
    # Follow the kept leaves up, the longest jumps first: after step k all ancestors at multiples of 2^k are there.
    reached = paths.select("conv", "leaf", "rank", F.col("hops").alias("depth"), F.col("leaf").alias("node"))
    for jump in reversed(jumps[:-1] if jumps[-1].isEmpty() else jumps):
        reached = scratch.keep(reached, "reached")
        step = 1 << jumps.index(jump)
        r, j = reached.alias("r"), jump.alias("j")
        more = r.join(j, same("r", "j") & (F.col("r.node") == F.col("j.node"))).select("r.conv", "leaf", "rank", (F.col("depth") - step).alias("depth"), F.col("j.up").alias("node"))
        reached = reached.union(more)
    return reached


def format_branches(nodes: DataFrame, keep: int = 1, learn: str = "assistant") -> DataFrame:
    """(conv, leaf, rank, formatted, mask): the `keep` best branches of each tree, each as one conversation.

    mask lists the spans (start, length, in code points) of formatted that a loss counts: texts of the role `learn`.
    nodes has (conv, node, parent, score, role, text); null roles and texts are empty; conv may be null. Of rows
    that repeat (conv, node) the least counts. A conversation's turns meet in one row, as its text does. Other columns
    don't matter.
    """
    scratch = Scratch(nodes.sparkSession, "chat")
    nodes = nodes.groupBy("conv", "node").agg(F.min(F.struct("parent", "score", "role", "text")).alias("n")).select("conv", "node", "n.*")
    nodes = scratch.keep(nodes, "nodes")
    chosen = branches(scratch, nodes.select("conv", "node", "parent", "score"), keep)
    c, n = chosen.alias("c"), nodes.alias("n")
    rows = c.join(n, F.col("c.conv").eqNullSafe(F.col("n.conv")) & (F.col("c.node") == F.col("n.node")))
    head = F.concat(F.lit(TURN), escape_role(F.coalesce("role", F.lit(""))), F.lit("\n"))
    turn = F.struct("depth", head.alias("head"), escape(F.coalesce("text", F.lit(""))).alias("body"), (F.col("role") == learn).alias("learn"))
    out = rows.groupBy("c.conv", "leaf", "rank").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    # Where each turn starts, then the spans of the learnt bodies.
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def walk(acc, t):
        body = acc["at"] + F.length(t["head"])
        span = F.struct(body.alias("start"), F.length(t["body"]).alias("length"))
        return F.struct(
            (body + F.length(t["body"]) + len(END)).alias("at"),
            F.when(t["learn"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"),
        )

    return out.select("conv", "leaf", "rank", formatted.alias("formatted"), F.aggregate("turns", zero, walk)["spans"].alias("mask"))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    parts = F.split(formatted, r"<\|end\|>\n")
    parts = F.slice(parts, 1, F.size(parts) - 1)

    def turn(p):
        at = F.instr(p, "\n")
        role = F.substring(p, len(TURN) + 1, at - len(TURN) - 1)
        return F.struct(unescape_role(role).alias("role"), unescape(F.substring(p, at + 1, F.length(p))).alias("text"))

    return F.transform(parts, turn)


def masked_texts(formatted: Column, mask: Column) -> Column:
    """The texts under the mask, unescaped."""
    return F.transform(mask, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"])))
