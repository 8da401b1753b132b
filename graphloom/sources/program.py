"""The catalog of program graphs: typed nodes and tagged, ordered links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import program_metrics as M
from graphloom.functions.layout import layout_expressions
from graphloom.plans.lexer import QueryError
from graphloom.sources.catalog import Catalog, Entity, Property, Selector
from graphloom.sources.scratch import settled


class Paths:
    """Paths over edges(src_id, tag, idx, dst_id), as (src, dst) rows. Closures are computed once for each tag."""

    def __init__(self, edges: DataFrame, nodes: DataFrame | None = None):
        self.edges, self.nodes, self.closures = edges, nodes, {}

    def step(self, step: str) -> DataFrame:
        name, _, test = step.partition("[")
        tag, _, index = name.removeprefix("^").removesuffix("*").partition("#")
        if name.endswith("*"):
            pairs = self.closure(tag)
        else:
            link = self.edges.where(F.col("tag") == tag)
            if index == "-1":
                last = link.groupBy("src_id").agg(F.max_by("dst_id", "idx").alias("dst_id"))
                link = last
            elif index:
                link = link.where(F.col("idx") == int(index))
            pairs = link.select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"))
        if name.startswith("^"):
            pairs = pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        if test:
            if self.nodes is None:
                raise QueryError(f"no columns to test in {step}")
            kept = self.nodes.where(F.expr(test.removesuffix("]"))).select(F.col("id").alias("dst"))
            pairs = pairs.join(kept, "dst", "left_semi").select("src", "dst")
        return pairs

    def closure(self, tag: str) -> DataFrame:
        """Any number of steps, none too. Rounds start from the ends of the tag's own links only."""
        from graphloom.operators.graphs import reachable

        if tag not in self.closures:
            link = self.edges.where(F.col("tag") == tag).select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"))
            more = reachable(link, link.select(F.col("src").alias("node")).distinct()).select(F.col("root").alias("src"), F.col("node").alias("dst"))
            every = self.edges.select(F.col("src_id").alias("src"), F.col("src_id").alias("dst")).union(self.edges.select("dst_id", "dst_id"))
            self.closures[tag] = settled(more.union(every).distinct())
        return self.closures[tag]

    def follow(self, path: str) -> DataFrame:
        """`a/b` is a, then b; `a|b` either; `a?b` is a, and b where a gives nothing; `^a` is a backwards; `a#2` the second
        link only, `a#-1` the last; `a[TEST]` ends at nodes whose columns pass the test; `a*` any number of steps, none
        too. `/` binds closest, then `|`, then `?`."""
        first, _, rest = path.partition("?")
        out = None
        for option in first.split("|"):
            pairs = None
            for step in option.split("/"):
                link = self.step(step)
                pairs = link if pairs is None else pairs.select("src", F.col("dst").alias("mid")).join(link.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst")
            out = pairs if out is None else out.union(pairs)
        out = out.distinct()
        return out.union(self.follow(rest).join(out.select("src").distinct(), "src", "left_anti")) if rest else out


def follow(edges: DataFrame, path: str) -> DataFrame:
    """(src, dst) of a path; see Paths.follow."""
    return Paths(edges).follow(path)


_ARGS = "arguments argument args arg parameters parameter params param"
_DYN = "dynamic_calls dyncalls dyncall"
#: Types of specs and fields: atoms are left out.
_NAMED = "typeref[name <> 'atom']"
#: Entity, names, result, path over link tags; with a minus sign, without the node itself.
SELECTORS = (
    ("file", "functions function funs fun", "function", "func"), ("file", "records record recs rec", "record", "record"), ("file", "macros macro", "macro", "macro"),
    ("file", "includes", "file", "incl -"), ("file", "included_by", "file", "^incl -"), ("file", "imports", "function", "funimp"), ("file", "exports", "function", "funexp"),
    ("file", "typedef typedefs types type", "type", "type"), ("file", "spec specs", "spec", "spec"), ("file", "typerefs", "type", "record/field/fielddef/typeref|type/typeref|spec/specclause/specpar/typeref|spec/specclause/specret/typeref"),
    ("function", "calls", "function", "funcall|dyncall"), ("function", "called_by", "function", "^funcall|^dyncall"), ("function", _DYN, "function", "dyncall|ambcall"),
    ("function", "dynamic_called_by dyncalled_by", "function", "^dyncall|^ambcall"), ("function", "references reference refs ref", "expression", "^funeref|^funlref|^dynref"),
    ("function", "dynamic_references dynrefs dynref", "expression", "^dynref|^ambref"), ("function", _ARGS, "expression", "funcl/pattern"), ("function", "body", "expression", "funcl/body"),
    ("function", "expressions expression exprs expr", "expression", "funcl/pattern|funcl/guard|funcl/body"), ("function", "variables variable vars var", "variable", "funcl/vardef"),
    ("function", "file", "file", "^func"), ("function", "clause clauses", "clause", "funcl"), ("function", "spec", "spec", "specref"), ("function", "returntype returntypes rettype", "type", f"specref/specclause/specret/{_NAMED}"),
    ("clause", "calls", "function", "|".join(f"{a}/esub*/{b}" for a in ("pattern", "guard", "body") for b in ("funeref", "dynref"))), ("clause", _DYN, "function", "body/esub*/dynref|body/esub*/ambref"), ("clause", _ARGS, "expression", "pattern"), ("clause", "body", "expression", "body"),
    ("clause", "expressions expression exprs expr", "expression", "pattern|guard|body"), ("clause", "variables variable vars var", "variable", "vardef"), ("clause", "file module", "file", "^funcl/^func"),
    ("clause", "function func", "function", "^funcl"), ("clause", "spec", "spec", "^funcl/specref"), ("clause", "returntypes returntype", "type", f"^funcl/specref/specclause/specret/{_NAMED}"),
    ("variable", "references reference refs ref", "expression", "^varref"), ("variable", "bindings", "expression", "^varbind"), ("variable", "function_definition function_def fun_def fundef", "function", "^vardef/^funcl"),
    ("spec", "fun func function", "function", "^specref"), ("spec", "file deffile", "file", "^specdef"), ("spec", "modref refmod", "file", "^spec"), ("spec", _ARGS, "specparam", "specclause/specpar"),
    ("spec", "guardtype guardtypes", "type", f"specclause/specguard/{_NAMED}"), ("spec", "returntype returntypes", "type", f"specclause/specret/{_NAMED}"), ("specparam", "type", "type", _NAMED),
    ("type", "file", "file", "^type"), ("type", "params param typeparams typeparam namedtypeparams namedtypeparam par pars", "type", "typeparamdef"), ("type", "subtype subtypes sub", "type", "typebody/tsub"),
    ("type", "refs ref references", "type", "^typeref"), ("type", "paramsrefs paramsref", "type", "typeparamdef/^typeparamref"), ("type", "specref specrefs refspec refspecs", "spec", "^typeref/^specpar/^specclause|^typeref/^specguard/^specclause"),
    ("record", "references reference refs ref", "expression", "^recref"), ("record", "fields field", "field", "field"), ("record", "file", "file", "^record"),
    ("field", "references reference refs ref", "expression", "^fieldref"), ("field", "record rec", "record", "^field"), ("field", "type types", "type", f"fielddef/{_NAMED}"), ("field", "file", "file", "^field/^record"),
    ("macro", "references reference refs ref", "expression", "^mref"), ("macro", "clause_references clause_reference clause_refs clause_ref", "clause", "^cmref"), ("macro", "all_references all_reference all_refs all_ref", "expression", "^mref|^cmref"), ("macro", "file", "file", "^macro"),
    ("expression", "fundef", "function", "^esub*/^body/^funcl|^esub*/^pattern/^funcl|^esub*/^guard/^funcl"), ("expression", "functions function funs fun", "function", "esub*/funeref"), ("expression", "dynamic_functions dynamic_function dynfuns dynfun", "function", "esub*/dynref|esub*/ambref"),
    ("expression", "variables variable vars var", "variable", "esub*/varref|esub*/varbind"), ("expression", "records record recs rec", "record", "esub*/recref"), ("expression", "macros macro", "macro", "esub*/mref"),
    ("expression", "subexpression subexpr esub sub", "expression", "esub*"), ("expression", "parameter param", "expression", "esub"), ("expression", "top_expression top_expr top", "expression", "top"),
    ("expression", "reach", "expression", "flow*"), ("expression", "origin", "expression", "^flow*"), ("expression", "file", "file", "^esub*/^body/^funcl/^func|^esub*/^pattern/^funcl/^func|^esub*/^guard/^funcl/^func"),
)

_COUNT = {
    "file": (("number_of_fun num_of_fun num_of_funs num_of_functions number_of_functions funnum", "func"), ("number_of_macros num_of_macros num_of_mac macnum", "macro"), ("number_of_records num_of_records num_of_rec recnum", "record"),
             ("included_files inc_files", "incl"), ("number_of_funclauses num_of_funclauses number_of_funclaus num_of_funclaus funclnum", "func/funcl")),
    "function": (("number_of_funclauses num_of_funclauses number_of_funclaus num_of_funclaus", "funcl"), ("calls_for_function calls_for_fun call_for_function call_for_fun", "^funcall"), ("calls_from_function calls_from_fun call_from_function call_from_fun", "funcall")),
}
#: Entity, its initial selectors, and (names, type) of its properties that are columns.
ENTITIES = {
    "file": ("files modules mods", "name:atom path:string filename:string directory,dir:string is_module,is_mod,module,mod:bool is_header,header:bool"),
    "function": ("", "name:atom arity:int exported:bool dirty,is_dirty:bool defined:bool opaque:bool module,mod:atom"), "clause": ("", "name:atom arity:int index:int"),
    "variable": ("", "name:string"), "record": ("", "name:atom"), "field": ("", "name:atom"), "macro": ("", "name:string arity:int body:string"),
    "spec": ("", "name,funname:atom arity:int text:string returntext:string guardtext:string"), "specparam": ("", "name:string text:string index:int"),
    "type": ("", "name:atom arity,number_of_parameters:int isopaque,opaque,is_opaque:bool isbuiltin,is_builtin,is_built_in,builtin:bool exported,remote_type:bool"),
    "expression": ("", "type:atom value,val:string class:atom index:int is_last,last:bool has_side_effect:bool text:string"),
}


#: Names of the metrics that call paths and expression trees give.
_NAMES = {
    "longest": "max_depth_of_calling max_depth_calling max_depth_of_call max_depth_call maxcalldepth", "shortest": "min_depth_of_calling min_depth_calling min_depth_of_call min_depth_call mincalldepth",
    "paths": "number_of_funpath number_of_funpaths num_of_funpath num_of_funpaths funpathnum", "application": "max_application_depth max_app_depth maxappdepth",
    "cases": "max_depth_of_cases max_depth_cases maxcasedepth", "structs": "max_depth_of_structs max_depth_structs max_depth_of_structures max_depth_structures maxstrdepth", "min_cases": "min_depth_of_cases min_depth_cases mincasedepth",
    "in": "function_calls_in fun_calls_in callsin", "out": "function_calls_out fun_calls_out callsout", "within": "cohesion coh", "imported": "imported_modules imp_modules imported_mod imp_mod impmods",
    "recursion": "branches_of_recursion branches_of_rec branch_of_recursion branch_of_rec recbranches", "funexpr": "number_of_funexpr num_of_funexpr funexprnum", "messages": "number_of_messpass num_of_messpass messpassnum",
    "returns": "fun_return_points fun_return_point funretpoints function_return_points function_return_point", "mccabe": "mcCabe mccabe", "tail": "is_tail_recursive is_tail_rec",
}
#: Initial selectors by position, and the entity of each.
POSITIONAL = {
    "@function": "function", "@fun": "function", "@variable": "variable", "@var": "variable", "@macro": "macro", "@record": "record", "@rec": "record", "@recfield": "field", "@field": "field",
    "@module": "file", "@mod": "file", "@expression": "expression", "@expr": "expression", "@clause": "clause", "@spec": "spec", "@type": "type",
}


def _metrics(name: str, tables: dict[str, DataFrame], edges: DataFrame) -> list[Property]:
    """Properties of files, functions and clauses by call paths and expression trees; plans are made when one is named."""
    expressions, functions = tables["expression"], tables["function"]
    up = {"clause": (), "function": ("funcl",), "file": ("func", "funcl")}[name]

    def of(key: str, rows, how=F.sum, kind: str = "int") -> Property:
        return Property(tuple(_NAMES[key].split()), kind, pairs=rows if how is None else (lambda: _raise(rows(), how)), default=0 if kind == "int" else None)

    def _raise(values: DataFrame, how) -> DataFrame:
        for tag in reversed(up):
            values = M.raised(values, M.links(edges, tag), how)
        return values

    def of_functions(column: str, how) -> DataFrame:
        values = M.call_depths(edges).select("id", F.col(column).alias("value"))
        return values if name == "function" else M.raised(values.where("value > 0"), M.links(edges, "func"), how)

    deep = lambda k: lambda: M.nesting(edges, expressions).select("id", F.col(k).alias("value"))
    out = [of("application", deep("application"), F.max), of("cases", deep("cases"), F.max), of("structs", deep("structs"), F.max), of("min_cases", deep("cases"), F.min)]
    out += [of("funexpr", lambda: M.counted(M.inside(edges, expressions, "fun_expr"))), of("messages", lambda: M.counted(M.inside(edges, expressions, "send_expr")))]
    # A clause has one return point and one path; each further branch of a decision inside adds a path.
    clauses = lambda: M.links(edges, "funcl").select(F.col("dst").alias("id"), F.lit(1).alias("value"))
    decisions = lambda: M.inside(edges, expressions, "case_expr", "if_expr", "receive_expr", "try_expr").toDF("src", "e").join(M.counted(M.links(edges, "exprcl")), F.col("e") == F.col("id")).select(F.col("src").alias("id"), (F.col("value") - 1).alias("value"))
    out += [of("returns", clauses), of("mccabe", lambda: clauses().union(decisions()).groupBy("id").agg(F.sum("value").alias("value")))]
    if name == "clause":
        return out
    if name == "function":
        own = lambda: M.counted(M.links(edges, "funcall", "dyncall").where("src = dst"))
        out += [of("longest", lambda: of_functions("longest", F.max), None), of("shortest", lambda: of_functions("shortest", F.min), None), of("recursion", own, None)]
        return [*out, of("tail", lambda: M.tail_recursion(edges, functions, expressions), None, "atom")]
    own = lambda: M.counted(M.module_crossings(edges)[2].join(M.links(edges, "funcall", "dyncall").where("src = dst").select("dst").distinct(), "dst", "left_semi").select("src", "dst"))
    imported = lambda: M.counted(follow(edges, "funimp/^func"))
    out += [of("longest", lambda: of_functions("longest", F.max), None), of("shortest", lambda: of_functions("shortest", F.min), None), of("paths", lambda: of_functions("paths", F.sum), None)]
    out += [of(k, lambda i=i: M.counted(M.module_crossings(edges)[i]), None) for i, k in enumerate(("in", "out", "within"))]
    return [*out, of("recursion", own, None), of("imported", imported, None)]


def _positional(spans: DataFrame, kind: str):
    """The narrowest span of the kind that holds the position; spans(file, entity, id, start, end), ends included."""

    def rows(file: str | None = None, position: int | None = None) -> DataFrame:
        if file is None or position is None:
            raise QueryError("a selector by position needs a file and a position")
        hit = spans.where((F.col("entity") == kind) & (F.col("file") == file) & F.lit(position).between(F.col("start"), F.col("end")))
        return hit.orderBy(F.col("end") - F.col("start"), "id").limit(1).select("id")

    return rows


def program_catalog(tables: dict[str, DataFrame], edges: DataFrame, snapshot: str = "", spans: DataFrame | None = None) -> Catalog:
    """tables: per entity its nodes (id, and columns of ENTITIES); entities without a table have no nodes. edges has
    (src_id, tag, idx, dst_id), ids unique over all entities. Missing columns are null properties. With
    spans(file, entity, id, start, end), queries may start where a position is: run(catalog, "@fun", file=, position=)."""
    spark = edges.sparkSession
    catalog = Catalog(spark, snapshot=snapshot, edges=edges)
    full = {}
    for name, (_, columns) in ENTITIES.items():
        table = tables.get(name)
        if table is None:
            table = spark.createDataFrame([], "id bigint")
        for names, kind in ((c.split(":")[0].split(","), c.split(":")[1]) for c in columns.split()):
            if names[0] not in table.columns:
                table = table.withColumn(names[0], F.lit(None).cast({"int": "bigint", "bool": "boolean"}.get(kind, "string")))
        full[name] = table if "text" in table.columns else table.withColumn("text", F.lit(None).cast("string"))
    paths = Paths(edges, full["type"].select("id", "name"))

    def selected(path: str) -> DataFrame:
        path, other, _ = path.partition(" -")
        pairs = paths.follow(path)
        return pairs.where("src <> dst") if other else pairs

    for name, (starts, columns) in ENTITIES.items():
        specs = [(c.split(":")[0].split(","), c.split(":")[1]) for c in columns.split()]
        table = full[name]
        selectors = [Selector(tuple(n.split()), r, pairs=(lambda p=p: selected(p))) for e, n, r, p in SELECTORS if e == name]
        properties = [Property(tuple(names), kind, names[0]) for names, kind in specs]
        properties += [Property(tuple(n.split()), "int", pairs=(lambda p=p: M.counted(paths.follow(p))), default=0) for n, p in _COUNT.get(name, ())]
        if name in ("file", "function", "clause"):
            properties += [Property(names, "int", e) for names, e in layout_expressions("text")] + _metrics(name, full, edges)
        if name == "function":
            properties.append(Property(("pure",), "bool", "not dirty"))
        if name == "expression":
            properties.append(Property(("is_tailcall", "tailcall"), "bool", "coalesce(is_last, false) and type = 'application'"))
        catalog.add(Entity(name, "id", (lambda t=table: t), tuple(starts.split()), selectors, properties))
    if spans is not None:
        catalog.starts |= {n: (kind, _positional(spans, kind)) for n, kind in POSITIONAL.items()}
        named = lambda file=None, position=None: full["file"].where(F.col("path") == file).select("id")
        catalog.starts["@file"] = ("file", named)
    return catalog
