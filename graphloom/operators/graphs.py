"""Reachability, cycles, paths and contraction of dependency graphs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.sources.scratch import settled


def reachable(edges: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame:
    """(root, node): what each start reaches over edges(src, dst), itself included, in at most `most` steps."""
    seen = settled(starts.select(F.col("node").alias("root"), "node").distinct())
    new, step = seen, 0
    while most is None or step < most:
        found = new.join(edges, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
        new = settled(found.join(seen, ["root", "node"], "left_anti"))
        if new.isEmpty():
            break
        seen, step = settled(seen.union(new)), step + 1
    return seen


def reached(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(node): what any of the starts reaches, themselves included; rows don't multiply by starts."""
    seen = settled(starts.select("node").distinct())
    new = seen
    while True:
        found = new.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        new = settled(found.join(seen, "node", "left_anti"))
        if new.isEmpty():
            return seen
        seen = settled(seen.union(new))


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of edges(src, dst): component is the smallest node of the strongly connected component.

    Forward-colouring rounds: the largest-known colour floods forward along edges, then each colour's root is followed
    back inside its colour; what it meets is a component and leaves the graph. Rows stay in proportion to the graph.
    """
    edges = settled(edges.select("src", "dst").distinct())
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    left, live, out = settled(nodes), edges, None
    while not left.isEmpty():
        colour = settled(left.select("node", F.col("node").alias("c")))
        while True:  # each node takes the smallest colour among those that reach it
            come = live.join(colour, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.min("c").alias("d"))
            next_ = settled(colour.join(come, "node", "left").select("node", F.least("c", F.coalesce("d", "c")).alias("c"), (F.col("d") < F.col("c")).alias("moved")))
            colour, moved = next_.select("node", "c"), next_.where("moved").isEmpty()
            if moved:
                break
        a, b = colour.select(F.col("node").alias("src"), F.col("c").alias("cs")), colour.select(F.col("node").alias("dst"), F.col("c").alias("cd"))
        inside = settled(live.join(a, "src").join(b, "dst").where("cs = cd").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        component = reachable_in_colour(inside, colour.where("node = c").select("node"))
        found = component.select("node", F.col("root").alias("component"))
        out = found if out is None else out.union(found)
        left = settled(left.join(found, "node", "left_anti"))
        keep = left.withColumnRenamed("node", "k")
        live = settled(live.join(keep, F.col("src") == F.col("k"), "left_semi").join(keep, F.col("dst") == F.col("k"), "left_semi"))
    return out if out is not None else nodes.select("node", F.col("node").alias("component"))


def reachable_in_colour(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Each node has one colour, so at most one root reaches it here."""
    return reachable(edges, roots)


def cyclic(edges: DataFrame) -> DataFrame:
    """The edges on cycles, self-loops too: those with both ends in one strong component."""
    part = strong_components(edges)
    a = part.select(F.col("node").alias("src"), F.col("component").alias("cs"))
    b = part.select(F.col("node").alias("dst"), F.col("component").alias("cd"))
    return edges.join(a, "src").join(b, "dst").where("cs = cd").drop("cs", "cd")


def simple_paths(edges: DataFrame, starts: DataFrame, ends: DataFrame, most: int) -> DataFrame:
    """(src, dst, path): paths of 1 to `most` edges from a start to an end that repeat no node, save back to the start."""
    at = starts.select(F.col("node").alias("start"), F.col("node").alias("at"), F.array("node").alias("path"))
    out = None
    for _ in range(most):
        at = at.join(edges.select("src", "dst").distinct(), F.col("at") == F.col("src"))
        at = at.select("start", F.col("dst").alias("at"), F.array_append("path", F.col("dst")).alias("path"), F.array_contains("path", F.col("dst")).alias("back"))
        hit = at.where("not back or at = start").join(ends.select(F.col("node").alias("at")), "at", "left_semi").select(F.col("start").alias("src"), F.col("at").alias("dst"), "path")
        out = hit if out is None else out.union(hit)
        at = at.where("not back").drop("back")
    return out


def contracted(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """(src, dst, n): edges between blocks with multiplicity, intra-block ones too. blocks(node, block) may list a node
    in several; one that it doesn't list is in block 0."""
    a = blocks.select(F.col("node").alias("src"), F.col("block").alias("bs"))
    b = blocks.select(F.col("node").alias("dst"), F.col("block").alias("bd"))
    rows = edges.select("src", "dst").join(a, "src", "left").join(b, "dst", "left")
    zero = F.lit(0)
    return rows.groupBy(F.coalesce("bs", zero).alias("src"), F.coalesce("bd", zero).alias("dst")).agg(F.count("*").alias("n"))


@dataclass
class Drawing:
    """A dependency graph under the options of a drawing: vertices(id, kind, name), edges(src, dst, type).

    Filters apply in a fixed order: level, selected connections or starting nodes, excluded children, excluded nodes,
    library nodes, cycles, and last modules without functions.
    """

    vertices: DataFrame
    edges: DataFrame
    level: str = "func"  # func, mod
    starting: list | None = None
    exclude_children: list = field(default_factory=list)
    exclude: list = field(default_factory=list)
    exclude_lib: list = field(default_factory=list)
    cycles: bool = False

    def nodes(self, ids: list) -> DataFrame:
        spark = self.vertices.sparkSession
        kind = self.vertices.schema["id"].dataType.simpleString()
        return spark.createDataFrame([(i,) for i in ids], f"node {kind}")

    def filtered(self) -> tuple[DataFrame, DataFrame]:
        v, e = self.vertices, self.edges
        if self.level == "mod":
            v, e = v.where("kind = 'module'"), e.where("type = 'modcall'")
        calls = e.where("type <> 'contain'" if self.level == "mod" else "type not in ('contain', 'modcall')")
        keep = v.select(F.col("id").alias("node"))
        contain = self.edges.where("type = 'contain'").select("src", "dst")
        if self.starting:
            keep = reached(calls, self.nodes(self.starting))
            if self.level == "func":
                keep = keep.union(contain.join(keep, F.col("dst") == F.col("node")).select(F.col("src").alias("node"))).distinct()
        if self.exclude_children:
            roots = self.nodes(self.exclude_children)
            gone = reached(calls, roots).join(roots, "node", "left_anti")
            keep = keep.join(gone, "node", "left_anti")
        if self.exclude:
            keep = keep.join(reached(calls, self.nodes(self.exclude)), "node", "left_anti")
        if self.exclude_lib:
            gone = self.nodes(self.exclude_lib)
            if self.level == "func":
                gone = gone.union(e.where("type <> 'modcall'").join(gone, F.col("src") == F.col("node")).select(F.col("dst").alias("node")))
            keep = keep.join(gone.distinct(), "node", "left_anti")
        keep = settled(keep.distinct())
        ends = lambda d: d.join(keep, F.col("src") == F.col("node"), "left_semi").join(keep, F.col("dst") == F.col("node"), "left_semi")
        e = ends(e)
        if self.cycles:
            on = cyclic(ends(calls))
            stay = on.select(F.col("src").alias("node")).union(on.select("dst")).distinct()
            if self.level == "func":
                stay = stay.union(contain.join(stay, F.col("dst") == F.col("node")).select(F.col("src").alias("node"))).distinct()
            keep = settled(stay)
            e = ends(e)
        v = v.join(keep.withColumnRenamed("node", "id"), "id", "left_semi")
        if self.level == "func":
            full = e.where("type = 'contain'").select(F.col("src").alias("id"))
            v = v.where("kind <> 'module'").unionByName(v.where("kind = 'module'").join(full, "id", "left_semi"))
        return v, e

    def terms(self) -> DataFrame:
        """(node, successors): adjacency, each successor as (dst, type)."""
        v, e = self.filtered()
        out = e.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set(F.struct("dst", "type"))).alias("successors"))
        return v.join(out, "id", "left").select(F.col("name").alias("node"), F.coalesce("successors", F.array()).alias("successors"))

    def dot(self) -> DataFrame:
        """(line): a Graphviz text, a line per vertex and edge, in order."""
        v, e = self.filtered()
        quoted = lambda c: F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('\\"')), F.lit('"'))
        head = v.sparkSession.createDataFrame([(0, "digraph dependencies {"), (3, "}")], "k int, line string")
        nodes = v.select(F.lit(1).alias("k"), F.concat(quoted("id"), F.lit(" [label="), quoted("name"), F.lit("];")).alias("line"))
        arcs = e.select(F.lit(2).alias("k"), F.concat(quoted("src"), F.lit(" -> "), quoted("dst"), F.lit(" [type="), quoted("type"), F.lit("];")).alias("line")).distinct()
        return head.union(nodes).union(arcs).orderBy("k", "line").select("line")


def module_calls(vertices: DataFrame, calls: DataFrame) -> DataFrame:
    """modcall edges of calls(src, dst) between functions of different modules; vertices has (id, module)."""
    a = vertices.select(F.col("id").alias("src"), F.col("module").alias("ms"))
    b = vertices.select(F.col("id").alias("dst"), F.col("module").alias("md"))
    return calls.join(a, "src").join(b, "dst").where("ms <> md").select(F.col("ms").alias("src"), F.col("md").alias("dst"), F.lit("modcall").alias("type"))


def matching(vertices: DataFrame, pattern: str) -> DataFrame:
    """vertices(module, name, arity, ...) whose parts fit `Module:Name/Arity` as whole strings; an empty part fits all."""
    module, _, rest = pattern.rpartition(":")
    name, _, arity = rest.rpartition("/") if "/" in rest else (rest, "", "")
    for column, part in (("module", module), ("name", name), ("arity", arity)):
        if part:
            vertices = vertices.where(F.col(column).cast("string").rlike(f"^(?:{part})$"))
    return vertices


def node_of(vertices: DataFrame, label: str) -> DataFrame:
    """The vertex (id, label, ...) of this label; an error if there is none."""
    found = vertices.where(F.col("label") == label)
    if found.isEmpty():
        raise LookupError(f"no node {label}")
    return found


def connections(edges: DataFrame, chosen: DataFrame, most: int = 1) -> DataFrame:
    """(src, dst, label): the chosen nodes(node) that paths of at most `most` edges join, each path as a label a->b->c."""
    paths = simple_paths(edges, chosen, chosen, most)
    return paths.select("src", "dst", F.array_join(F.transform("path", lambda x: x.cast("string")), "->").alias("label"))


def indirect_connections(edges: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, arcs): all nodes on walks between chosen nodes(node), kind chosen or pnode; and arcs (src, dst, type) among
    them, with an icallarc from each chosen node to each that it reaches only through others.

    A node is on such a walk if a chosen one reaches it and it reaches a chosen one, so walks are never listed.
    """
    chosen = settled(chosen.select("node").distinct())
    edges = settled(edges.select("src", "dst").distinct())
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    on = settled(reached(edges, chosen).join(reached(back, chosen), "node", "left_semi"))
    nodes = on.join(chosen.withColumn("kind", F.lit("chosen")), "node", "left").select("node", F.coalesce("kind", F.lit("pnode")).alias("kind"))
    arcs = edges.join(on, F.col("src") == F.col("node"), "left_semi").join(on, F.col("dst") == F.col("node"), "left_semi")
    far = reachable(arcs, chosen).select(F.col("root").alias("src"), F.col("node").alias("dst")).where("src <> dst")
    far = far.join(chosen, F.col("dst") == F.col("node"), "left_semi").join(edges, ["src", "dst"], "left_anti")
    return nodes, arcs.select("src", "dst", F.lit("callarc").alias("type")).union(far.select("src", "dst", F.lit("icallarc")))


def save_graph(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """Writes a graph's two tables below path."""
    vertices.write.mode("overwrite").parquet(f"{path}/vertices")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def load_graph(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges")
