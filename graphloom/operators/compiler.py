"""From a query's tree to one DataFrame plan."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.statistics import NAMES, statistic
from graphloom.plans import syntax as S
from graphloom.plans.lexer import QueryError
from graphloom.sources.catalog import Catalog, Property, Selector
from graphloom.sources.scratch import settled

#: Edits within which `like` takes two names for alike.
LIKE_EDITS = 2
NUMBERS = ("int", "float")


@dataclass(frozen=True)
class Frontier:
    """Rows where evaluation stands: the column `cur` with ids of `entity` (or values, if a property ended the path),
    and carried columns (groups, variables, roots). Rows are distinct in carried and cur. With attached, the columns of
    the entity's own table are there too, prefixed, so that its properties need no join."""

    df: DataFrame
    entity: str | None
    carried: tuple[str, ...] = ()
    kind: str | None = None  # a property's type
    attached: bool = False
    types: tuple[tuple[str, str], ...] = ()  # of variables: an entity, or value:<property type>

    def keys(self) -> list[str]:
        return [*self.carried, "cur"]

    def type_of(self, var: str) -> str | None:
        return dict(self.types).get(var)


@dataclass(frozen=True)
class Result:
    """rows of (group, node) or (group, value); (group, path, cyclic) of chains; (value) of a statistic."""

    df: DataFrame
    shape: str  # nodes, values, chains, statistic, help
    entity: str | None
    kind: str | None = None

    def grouped(self) -> DataFrame:
        """(group, values): sorted distinct values of each group, as an array."""
        column = "node" if self.shape == "nodes" else "value"
        return self.df.groupBy("group").agg(F.array_sort(F.collect_set(column)).alias("values"))

    def labelled(self) -> DataFrame:
        """grouped(), with kind: list for nodes, eq if all groups have one value, else propertylist."""
        out = self.grouped()
        if self.shape == "nodes":
            return out.withColumn("kind", F.lit("list"))
        most = out.agg(F.max(F.size("values")).alias("most"))
        return out.join(F.broadcast(most)).withColumn("kind", F.when(F.col("most") > 1, "propertylist").otherwise("eq")).drop("most")


class Compiler:
    def __init__(self, catalog: Catalog, like_edits: int = LIKE_EDITS, start: dict | None = None):
        self.catalog, self.like_edits, self.start = catalog, like_edits, start or {}
        self.fresh = itertools.count()

    # --- whole queries

    def run(self, query: str, groupby: int | None = None, output: str | None = None) -> Result:
        """groupby: the number of the step whose entities group the result, 1 for the first; without, the step before
        the last one (of a property, the one that has it). output: "nodes" gives a final closure's ends, not its chains.
        """
        tree = S.parse(query, set(self.catalog.initial()))
        if isinstance(tree, S.Path) and isinstance(tree.steps[-1], S.Help):
            ends = None if len(tree.steps) == 1 else self.path(replace(tree, steps=tree.steps[:-1]), None).entity
            return Result(self.catalog.help(ends), "help", ends)
        if isinstance(tree, S.SetOp):
            f = self.set_op(tree, None)
            return self.result(f, None)
        steps, stat = tree.steps, None
        if steps and isinstance(steps[-1], S.Statistic):
            steps, stat = steps[:-1], steps[-1].name
            if stat not in NAMES:
                raise QueryError(f"unknown statistic {stat}")
        chains = isinstance(steps[-1], (S.Closure, S.Iteration)) and output != "nodes" and stat is None
        moves = [k for k, s in enumerate(steps) if isinstance(s, (S.Step, S.Closure, S.Iteration, S.Branches))]
        ends_value = self.ends_in_value(steps)
        last = len(moves) - (2 if ends_value else 1)
        g = (groupby - 1) if groupby is not None else last - (0 if ends_value else 1)
        if groupby is not None and not 0 <= g < len(moves):
            raise QueryError(f"there is no step {groupby} to group by")
        f: Frontier | None = None
        for k, step in enumerate(steps):
            if chains and k == len(steps) - 1:
                return self.chains(f, step, k)
            f = self.step(f, step, first=k == 0)
            if stat is None and g >= 0 and g < len(moves) and k == moves[g] and f.kind is None:
                f = self.carry(f, "g_", F.col("cur"))
        if stat is not None:
            if f.kind not in NUMBERS:
                raise QueryError("statistics take a numeric property")
            return Result(f.df.agg(statistic(stat, F.col("cur")).alias("value")), "statistic", None, "float")
        return self.result(f, "g_" if "g_" in f.carried else None)

    def result(self, f: Frontier, group: str | None) -> Result:
        name = "node" if f.kind is None else "value"
        columns = [F.col(group).alias("group") if group else F.lit(None).cast("string").alias("group"), F.col("cur").alias(name)]
        return Result(f.df.select(*columns).distinct(), name + "s", f.entity, f.kind)

    def ends_in_value(self, steps) -> bool:
        """Whether the last move gives values, by types alone."""
        f = self.types_of(steps)
        return f[1] is not None

    def types_of(self, steps) -> tuple[str | None, str | None]:
        """(entity, property kind) where steps end; steps from an initial selector."""
        f = self.path(S.Path(tuple(s for s in steps if not isinstance(s, S.Statistic)), False), None, dry=True)
        return f.entity, f.kind

    # --- paths

    def path(self, p: S.Path, f: Frontier | None, dry: bool = False) -> Frontier:
        for k, step in enumerate(p.steps):
            if dry and isinstance(step, (S.Filter, S.Match)):
                continue
            if dry and isinstance(step, (S.Closure, S.Iteration)):
                step = S.Branches(step.body)
            if dry and isinstance(step, S.Step) and step.name[0].isupper() and f"v_{step.name}" not in f.carried:
                # A variable that a filter binds: by a comparison to a value, by an arrow to an entity.
                value = f"Compare(op='=', left=Variable(name='{step.name}')" in repr(p) or f"right=Variable(name='{step.name}')" in repr(p)
                return replace(f, kind="string" if value else None)
            f = self.step(f, step, first=k == 0 and not p.relative)
        return f

    def query(self, q, f: Frontier | None) -> Frontier:
        """q from f if it is relative; else from its start, once per carried row of f if there is one."""
        if isinstance(q, S.SetOp):
            return self.set_op(q, f)
        if q.relative:
            if f is None:
                raise QueryError("a relative query needs an entity to start from")
            return self.path(q, f)
        own = self.path(q, self.outer(f))
        return own

    def outer(self, f: Frontier | None) -> Frontier | None:
        """The carried columns alone, for a start of its own: its variables stay known."""
        if f is None or not f.carried:
            return None
        return Frontier(f.df.select(*f.carried).distinct(), None, f.carried, types=f.types)

    def step(self, f: Frontier | None, step, first: bool) -> Frontier:
        match step:
            case S.Step(name):
                return self.initial(f, name) if first else self.named(f, name)
            case S.Branches(query):
                return self.query(query, f)
            case S.Filter(cond):
                return self.filter(f, cond)
            case S.Bind(var):
                return self.bind(f, var, F.col("cur"), f.entity or f"value:{f.kind}")
            case S.Match(var, equal):
                bound = f"v_{var}"
                if bound not in f.carried:
                    return replace(f, df=f.df.where(F.lit(not equal)))
                same = F.col("cur").eqNullSafe(F.col(bound))
                return replace(f, df=f.df.where(same if equal else ~same))
            case S.Closure(body, times):
                return self.closure(f, body, times)
            case S.Iteration(body, times):
                for _ in range(times):
                    f = self.query(body, f)
                return f
        raise QueryError(f"{type(step).__name__} cannot stand here")

    def initial(self, f: Frontier | None, name: str) -> Frontier:
        names = self.catalog.initial()
        if name not in names:
            raise QueryError(f"unknown initial selector {name}")
        entity = self.catalog.entity(names[name])
        if name in self.catalog.starts:
            out = Frontier(self.catalog.starts[name][1](**self.start).select(F.col("id").alias("cur")).distinct(), entity.name)
        else:
            out = Frontier(self.attachment(entity), entity.name, attached=True)
        if f is None:
            return out
        return replace(out, df=f.df.crossJoin(out.df), carried=f.carried, types=f.types)

    def attachment(self, entity) -> DataFrame:
        table = entity.table()
        return table.select(F.col(entity.key).alias("cur"), *[F.col(c).alias(f"a_{c}") for c in table.columns])

    def attach(self, f: Frontier) -> Frontier:
        if f.attached:
            return f
        return replace(f, df=f.df.join(self.attachment(self.catalog.entity(f.entity)), "cur"), attached=True)

    def named(self, f: Frontier, name: str) -> Frontier:
        if f.entity is None and f.kind is not None:
            raise QueryError(f"nothing follows a property, as .{name} does")
        if f"v_{name}" in f.carried:
            type_ = f.type_of(name)
            df = f.df.select(*f.carried, F.col(f"v_{name}").alias("cur")).distinct()
            value = type_ is not None and type_.startswith("value:")
            return replace(f, df=df, entity=None if value else type_, kind=type_[6:] if value else None, attached=False)
        found = self.catalog.resolve(f.entity, name)
        return self.select(f, found) if isinstance(found, Selector) else self.value(f, found)

    def select(self, f: Frontier, s: Selector) -> Frontier:
        if s.child:
            right = self.attachment(self.catalog.entity(s.result)).withColumnRenamed("cur", "to_")
            df = f.df.select(*f.keys()).join(right, F.col("cur") == F.col(f"a_{s.child}")).drop("cur").withColumnRenamed("to_", "cur")
            return replace(f, df=df, entity=s.result, attached=True)
        if s.parent:
            f = self.attach(f)
            df = f.df.where(F.col(f"a_{s.parent}").isNotNull()).select(*f.carried, F.col(f"a_{s.parent}").alias("cur"))
        else:
            df = f.df.select(*f.keys()).join(s.pairs().select("src", "dst"), F.col("cur") == F.col("src")).select(*f.carried, F.col("dst").alias("cur"))
        return replace(f, df=df.distinct(), entity=s.result, attached=False)

    def value_column(self, f: Frontier, p: Property) -> tuple[Frontier, Column]:
        if p.expr is not None:
            f = self.attach(f)
            table = self.catalog.entity(f.entity).table()
            named = f"p{next(self.fresh)}_"
            shown = f.df.select("*", *[F.col(f"a_{c}").alias(c) for c in table.columns if c not in f.df.columns])
            own = shown.withColumn(named, F.expr(p.expr)).drop(*[c for c in table.columns if c not in f.df.columns])
            return replace(f, df=own), F.col(named)
        named = f"p{next(self.fresh)}_"
        pairs = p.pairs().select(F.col("id").alias("cur"), F.col("value").alias(named))
        df = f.df.join(pairs, "cur", "left")
        column = F.col(named) if p.default is None else F.coalesce(F.col(named), F.lit(p.default))
        return replace(f, df=df), column

    def value(self, f: Frontier, p: Property) -> Frontier:
        """Values stay one per entity here; sets of values are made where results are."""
        g, column = self.value_column(f, p)
        df = g.df.select(*f.carried, F.col("cur").alias("of_"), column.alias("value_"))
        return replace(f, df=df.select(*f.carried, F.col("value_").alias("cur")).where("cur is not null"), entity=None, kind=p.kind, attached=False)

    def carry(self, f: Frontier, name: str, column: Column, type_: tuple[str, str] | None = None) -> Frontier:
        types = f.types if type_ is None else (*f.types, type_)
        return replace(f, df=f.df.withColumn(name, column), carried=(*f.carried, name), types=types)

    def bind(self, f: Frontier, var: str, column: Column, type_: str) -> Frontier:
        """A first use binds; another keeps the rows that agree."""
        name = f"v_{var}"
        if name in f.carried:
            return replace(f, df=f.df.where(F.col(name).eqNullSafe(column)))
        return self.carry(f, name, column, (var, type_))

    # --- set operators

    def set_op(self, q: S.SetOp, f: Frontier | None) -> Frontier:
        """Over nodes or values, with the variables that both sides know: those must agree."""
        a, b = self.query(q.left, f), self.query(q.right, f)
        if (a.kind is None) != (b.kind is None) or a.kind is None and a.entity != b.entity:
            raise QueryError(f"{q.op} of {a.entity or a.kind} and {b.entity or b.kind}")
        a, b = (replace(x, df=x.df.select(*x.keys()).distinct(), attached=False) for x in (a, b))
        if a.kind is not None and (a.kind in NUMBERS) != (b.kind in NUMBERS):
            a, b = (replace(x, df=x.df.withColumn("cur", F.col("cur").cast("string")), kind="string") for x in (a, b))
        common = [c for c in a.carried if c in b.carried]
        if q.op == "union":
            carried = tuple(dict.fromkeys((*a.carried, *b.carried)))
            df = a.df.unionByName(b.df, allowMissingColumns=True).distinct()
            types = tuple(dict(a.types + b.types).items())
            return replace(a, df=df.select(*carried, "cur"), carried=carried, types=types)
        on = self.same("l", "r", [*common, "cur"])
        left, right = a.df.alias("l"), b.df.alias("r")
        if q.op == "except":
            return replace(a, df=left.join(right, on, "left_anti"))
        more = [c for c in b.carried if c not in a.carried]
        if not more:
            return replace(a, df=left.join(right, on, "left_semi"))
        df = left.join(right, on).select("l.*", *[f"r.{c}" for c in more]).distinct()
        return replace(a, df=df, carried=(*a.carried, *more), types=tuple(dict(a.types + b.types).items()))

    @staticmethod
    def same(left: str, right: str, columns: list[str]) -> Column:
        out = F.lit(True)
        for c in columns:
            out = out & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
        return out

    # --- repetition

    def closure(self, f: Frontier, body, times: int | None) -> Frontier:
        """The starts and all that repetitions reach: each round extends only what is new."""
        if times is not None:
            out = new = replace(f, df=f.df.select(*f.keys()), attached=False)
            for _ in range(times):
                new = self.query(body, new)
                out = self.joined(out, new)
            return out
        out = replace(f, df=settled(f.df.select(*f.keys()).distinct()), attached=False)
        new = out
        while True:
            new = self.aligned(self.query(body, new), out)
            fresh = settled(new.df.alias("l").join(out.df.alias("r"), self.same("l", "r", out.keys()), "left_anti"))
            if fresh.isEmpty():
                return out
            new = replace(new, df=fresh)
            out = replace(out, df=settled(out.df.union(fresh)))

    def aligned(self, f: Frontier, like: Frontier) -> Frontier:
        """Keeps the columns of `like`: variables bound in a body for the first time don't leave it."""
        return replace(f, df=f.df.select(*like.keys()).distinct(), carried=like.carried, types=like.types, attached=False)

    def joined(self, a: Frontier, b: Frontier) -> Frontier:
        return replace(a, df=a.df.unionByName(self.aligned(b, a).df).distinct())

    def chains(self, f: Frontier, step, k: int, most: int = 64) -> Result:
        """Maximal paths of a final closure or iteration: (path, cyclic); a path is cyclic if its last node is in it
        before. Variables first bound in the body keep their value along a path."""
        if f is None:
            raise QueryError("a closure needs a start")
        entity = f.entity
        start = self.carry(replace(f, df=f.df.select(*f.keys()), attached=False), "path_", F.array("cur"))
        if isinstance(step, S.Iteration):
            for _ in range(step.times):
                start = self.query(step.body, start)
                start = replace(start, df=start.df.withColumn("path_", F.array_append("path_", F.col("cur"))))
            out = start.df.select(F.col("path_").alias("path"), F.lit(False).alias("cyclic")).distinct()
            return Result(out, "chains", entity)
        ended, live, length = [], replace(start, df=settled(start.df)), 0
        limit = step.times if step.times is not None else most
        while length < limit:
            more = self.query(step.body, live)
            more = replace(more, df=settled(more.df.select(*more.keys()).withColumn("from_", F.col("path_")).withColumn("path_", F.array_append("path_", F.col("cur")))))
            ended.append(live.df.join(more.df.select(F.col("from_").alias("path_")).distinct(), "path_", "left_anti").select(F.col("path_").alias("path"), F.lit(False).alias("cyclic")))
            back = F.array_contains(F.slice("path_", 1, F.size("path_") - 1), F.col("cur"))
            ended.append(more.df.where(back).select(F.col("path_").alias("path"), F.lit(True).alias("cyclic")))
            live = replace(more, df=more.df.where(~back).drop("from_"))
            length += 1
            if live.df.isEmpty():
                break
        else:
            if step.times is None:
                raise QueryError(f"chains longer than {most} steps; ask for nodes instead")
            ended.append(live.df.select(F.col("path_").alias("path"), F.lit(False).alias("cyclic")))
        out = ended[0]
        for e in ended[1:]:
            out = out.union(e)
        return Result(out.distinct(), "chains", entity)

    # --- filters

    def filter(self, f: Frontier, cond) -> Frontier:
        match cond:
            case S.Logic("and", (a, b)):
                return self.filter(self.filter(f, a), b)
            case S.Logic("or", (a, b)):
                if self.pure(f, cond):
                    return self.where(f, cond)
                base = replace(f, df=f.df.select(*f.keys()), attached=False)
                x, y = self.filter(base, a), self.filter(base, b)
                carried = tuple(dict.fromkeys((*x.carried, *y.carried)))
                df = x.df.select(*x.keys()).unionByName(y.df.select(*y.keys()), allowMissingColumns=True).distinct()
                return replace(f, df=df.select(*carried, "cur"), carried=carried, attached=False, types=tuple(dict(x.types + y.types).items()))
            case S.Logic("not", (a,)):
                if self.pure(f, cond):
                    return self.where(f, cond)
                held = self.filter(replace(f, df=f.df.select(*f.keys()), attached=False), a).df
                return replace(f, df=f.df.alias("l").join(held.alias("r"), self.same("l", "r", f.keys()), "left_anti").select("l.*"))
            case S.Compare("=", left, right) if self.unbound(f, left) or self.unbound(f, right):
                var, other = (left, right) if self.unbound(f, left) else (right, left)
                if self.unbound(f, other):
                    return replace(f, df=f.df.where(F.lit(False)))
                g, column, kind = self.scalar(f, other, bare=True)
                return self.bind(g, var.name, column, f"value:{kind}")
            case S.Compare(op, left, right) if op in ("in", "all_in", "any_in") and not self.pure(f, cond):
                return self.membership(f, op, left, right)
            case S.Path() | S.SetOp():
                return self.exists(f, cond)
        if self.pure(f, cond):
            return self.where(f, cond)
        if isinstance(cond, S.Compare) and isinstance(cond.left, (S.Logic, S.Compare)) or isinstance(cond, S.Compare) and isinstance(cond.right, (S.Logic, S.Compare)):
            return self.equal_truths(f, cond)
        return self.exists_compare(f, cond)

    def equal_truths(self, f: Frontier, cond: S.Compare) -> Frontier:
        a, b = cond.left, cond.right
        both = S.Logic("or", (S.Logic("and", (a, b)), S.Logic("and", (S.Logic("not", (a,)), S.Logic("not", (b,))))))
        return self.filter(f, both if cond.op in ("==", "=") else S.Logic("not", (both,)))

    def exists_compare(self, f: Frontier, cond: S.Compare) -> Frontier:
        """A comparison with a query: true if one of its values compares so."""
        g = self.rooted(f)
        q, flip = (cond.right, False) if isinstance(cond.right, (S.Path, S.SetOp)) else (cond.left, True)
        sub = self.query(q, g)
        if sub.kind is None:
            raise QueryError("a comparison takes values")
        name = f"q{next(self.fresh)}_"
        rows = sub.df.select(*sub.keys()).withColumnRenamed("cur", name).withColumnRenamed("root_", "cur")
        joined = f.df.join(rows, [c for c in [*f.carried, "cur"]])
        h, column, kind = self.scalar(replace(f, df=joined), cond.left if not flip else cond.right)
        left, right = (column, kind), (F.col(name), sub.kind)
        ok = self.compared(cond.op, *(right if flip else left), *(left if flip else right))
        held = h.df.where(ok).select(*f.keys()).distinct()
        return replace(f, df=f.df.alias("l").join(held.alias("r"), self.same("l", "r", f.keys()), "left_semi").select("l.*"))

    def rooted(self, f: Frontier) -> Frontier:
        """f from which a sub-query starts: the current entity is carried as root_."""
        df = f.df.select(*f.keys()).distinct()
        if "root_" in f.carried:
            df = df.drop("root_")
        carried = tuple(c for c in f.carried if c != "root_")
        return Frontier(df.withColumn("root_", F.col("cur")), f.entity, (*carried, "root_"), f.kind, False, f.types)

    def exists(self, f: Frontier, q) -> Frontier:
        """Rows for which q is not empty, with the variables that q binds."""
        sub = self.query(q, self.rooted(f))
        keys = [c for c in f.carried if c != "root_"]
        more = [c for c in sub.carried if c not in f.carried and c.startswith("v_")]
        if "root_" not in sub.carried:  # nothing of the row is in it
            return replace(f, df=f.df.join(sub.df.select(F.lit(1).alias("any_")).limit(1), how="cross").drop("any_"))
        rows = sub.df.select(*keys, *more, F.col("root_").alias("cur")).distinct()
        left, right = f.df.alias("l"), rows.alias("r")
        on = self.same("l", "r", [*keys, "cur"])
        if not more:
            return replace(f, df=left.join(right, on, "left_semi"))
        df = left.join(right, on).select("l.*", *[f"r.{c}" for c in more])
        new = [(c[2:], sub.type_of(c[2:])) for c in more]
        return replace(f, df=df, carried=(*f.carried, *more), types=(*f.types, *new))

    def membership(self, f: Frontier, op: str, left, right) -> Frontier:
        """in and all_in: left is not empty and all in right; any_in: one is."""
        a = self.values_of(f, left)
        kind_a, correlated = a.kind, "root_" in a.carried
        rows = a.df.select(*[c for c in a.carried if c in (*f.carried, "root_")], F.col("cur").cast("string").alias("x_"))
        if not correlated:
            rows = self.rooted(f).df.select(*[c for c in f.carried if c != "root_"], "root_").crossJoin(rows.select("x_"))
        rows = rows.withColumnRenamed("root_", "cur").distinct()
        keys = [c for c in f.carried if c != "root_"] + ["cur"]
        keys = [k for k in keys if k in rows.columns]
        if isinstance(right, S.Listed):
            hit = rows.withColumn("hit_", F.col("x_").isin([str(v) for v in right.values]) if right.values else F.lit(False))
        else:
            b = self.values_of(f, right)
            if "root_" in b.carried:
                have = b.df.select(*[c for c in b.carried if c in keys], F.col("root_").alias("cur"), F.col("cur").cast("string").alias("x_")).distinct()
                on = self.same("l", "r", [*keys, "x_"])
            else:
                have = b.df.select(F.col("cur").cast("string").alias("x_")).distinct()
                on = F.col("l.x_") == F.col("r.x_")
            hit = rows.alias("l").join(have.withColumn("in_", F.lit(True)).alias("r"), on, "left").select("l.*", F.col("in_").isNotNull().alias("hit_"))
        del kind_a
        test = F.max("hit_") if op == "any_in" else F.min("hit_")
        held = hit.groupBy(*keys).agg(test.alias("ok_")).where("ok_").drop("ok_")
        return replace(f, df=f.df.alias("l").join(held.alias("r"), self.same("l", "r", keys), "left_semi").select("l.*"))

    def values_of(self, f: Frontier, x) -> Frontier:
        if isinstance(x, (S.Path, S.SetOp)):
            absolute = isinstance(x, S.Path) and not x.relative
            return self.path(x, None) if absolute and not self.mentions(x, f) else self.query(x, self.rooted(f))
        if isinstance(x, S.Listed):
            values = self.catalog.spark.createDataFrame([(str(v),) for v in x.values], "cur string")
            return Frontier(values, None, (), "string")
        g, column, kind = self.scalar(self.rooted(f), x)
        return Frontier(g.df.select(*g.carried, column.alias("cur")), None, g.carried, kind, types=g.types)

    def mentions(self, x, f: Frontier) -> bool:
        return any(f"'{v}'" in repr(x) for v, _ in f.types)

    def pure(self, f: Frontier, cond) -> bool:
        """Whether a condition is one column expression: no sub-query, no binding."""
        match cond:
            case S.Logic(_, args):
                return all(self.pure(f, a) for a in args)
            case S.Compare(op, left, right):
                if op == "=" and (self.unbound(f, left) or self.unbound(f, right)):
                    return False
                if op in ("in", "all_in", "any_in"):
                    return not isinstance(left, (S.Path, S.SetOp, S.Listed)) and isinstance(right, S.Listed)
                return self.pure(f, left) and self.pure(f, right)
            case S.Path() | S.SetOp():
                return False
        return True

    def unbound(self, f: Frontier, x) -> bool:
        return isinstance(x, S.Variable) and f"v_{x.name}" not in f.carried

    def where(self, f: Frontier, cond) -> Frontier:
        g, column = self.truth(f, cond)
        return replace(g, df=g.df.where(column).drop(*[c for c in g.df.columns if c[0] == "p" and c.endswith("_") and c != "path_"]))

    def truth(self, f: Frontier, cond) -> tuple[Frontier, Column]:
        false = F.lit(False)
        match cond:
            case S.Logic("not", (a,)):
                f, x = self.truth(f, a)
                return f, ~x
            case S.Logic(op, (a, b)):
                f, x = self.truth(f, a)
                f, y = self.truth(f, b)
                return f, x & y if op == "and" else x | y
            case S.Compare(op, left, S.Listed(values)):
                f, x, kind = self.scalar(f, left)
                if kind in NUMBERS and all(str(v).lstrip("-").isdigit() for v in values) and values:
                    return f, F.coalesce(x.isin([int(v) for v in values]), false)
                return f, F.coalesce(x.cast("string").isin([str(v) for v in values]), false) if values else false
            case S.Compare(op, left, right):
                if isinstance(left, (S.Logic, S.Compare)) or isinstance(right, (S.Logic, S.Compare)):
                    f, x = self.truth(f, left)
                    f, y = self.truth(f, right)
                    return f, x == y if op in ("==", "=") else x != y
                if self.unbound(f, left) or self.unbound(f, right):
                    return f, false
                f, x, a = self.scalar(f, left, bare=not isinstance(right, S.Variable) or True)
                f, y, b = self.scalar(f, right)
                return f, self.compared(op, x, a, y, b)
        f, x, kind = self.scalar(f, cond)
        if kind == "bool":
            return f, F.coalesce(x, false)
        return f, F.coalesce(x.cast("string") == "true", false)

    def scalar(self, f: Frontier, x, bare: bool = True) -> tuple[Frontier, Column, str]:
        """A value of each row: a property of the current entity where a bare name is one, a variable, or a literal."""
        match x:
            case S.Variable(name):
                if f"v_{name}" not in f.carried:
                    return f, F.lit(None), "string"
                type_ = f.type_of(name) or "string"
                return f, F.col(f"v_{name}"), type_[6:] if type_.startswith("value:") else "id"
            case S.Literal(value, quoted):
                if isinstance(value, str) and not quoted and bare and f.entity is not None:
                    found = self.catalog.entity(f.entity).find(value)
                    if isinstance(found, Property):
                        g, column = self.value_column(f, found)
                        return g, column, found.kind
                kind = "bool" if isinstance(value, bool) else "int" if isinstance(value, int) else "string"
                return f, F.lit(value), kind
        raise QueryError(f"{type(x).__name__} is not a value")

    def compared(self, op: str, x: Column, a: str, y: Column, b: str) -> Column:
        """Numbers compare as numbers, all else as text; null compares as false."""
        if op == "~":
            out = F.regexp_like(x.cast("string"), y.cast("string"))
        elif op == "like":
            s, t = x.cast("string"), y.cast("string")
            out = F.contains(s, t) | (F.levenshtein(s, t) <= self.like_edits)
        else:
            if not (a in NUMBERS and b in NUMBERS):
                x, y = x.cast("string"), y.cast("string")
            out = {"==": x == y, "=": x == y, "/=": x != y, "<": x < y, "=<": x <= y, ">": x > y, ">=": x >= y}[op]
        return F.coalesce(out, F.lit(False))


def run(catalog: Catalog, query: str, groupby: int | None = None, output: str | None = None, **start) -> Result:
    """Compiles a query against a catalog; nothing runs until its rows are asked for, save the rounds of a closure."""
    return Compiler(catalog, start=start).run(query, groupby, output)
