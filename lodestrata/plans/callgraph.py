"""What a call of Python may reach: what names hold and what calls reach, evaluated together.

Sources give facts, one row each; names are variables such as ``module.f`` or ``module.f:x``, objects are functions (``f:``), classes (``c:``),
instances (``i:``), parents of a class (``s:``) and modules (``m:``). Nothing is executed. The answer is an upper bound within what is
read: containers, decorators' results and computed attributes hold nothing.
"""

from __future__ import annotations

import ast

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.lineage import Grown, written
from lodestrata.operators.graph import fixpoint
from lodestrata.sources.manifests import _rows


class _Reader(ast.NodeVisitor):
    """The facts of one module, as ``(kind, a, b, c)``."""

    def __init__(self, module: str):
        self.module, self.rows, self.scopes, self.owner, self.temps = module, [("hold", module, f"m:{module}", None)], [(module, set())], None, 0

    def fact(self, kind: str, a: str | None, b: str | None = None, c: str | None = None) -> None:
        if a is not None:
            self.rows.append((kind, a, b, c))

    def temp(self) -> str:
        self.temps += 1
        return f"{self.module}#{self.temps}"

    def var(self, name: str) -> str:
        """The variable that a name means here: the nearest function's that binds it, else the module's."""
        for prefix, bound in reversed(self.scopes[1:]):
            if name in bound:
                return f"{prefix}:{name}"
        return f"{self.module}.{name}"

    def target(self, name: str) -> str:
        return f"{self.owner}.{name}" if self.owner else self.var(name)

    # ---- expressions: the variable that holds an expression's value, or none

    def value(self, node: ast.AST | None) -> str | None:
        if isinstance(node, ast.Name):
            return self.var(node.id)
        if isinstance(node, ast.Attribute):
            out, base = self.temp(), self.value(node.value)
            if base:
                self.fact("load", out, base, node.attr)
            return out
        if isinstance(node, ast.Call):
            return self.call(node)
        if isinstance(node, ast.IfExp | ast.BoolOp):
            out = self.temp()
            for child in [node.body, node.orelse] if isinstance(node, ast.IfExp) else node.values:
                self.copy(out, self.value(child))
            if isinstance(node, ast.IfExp):
                self.value(node.test)
            return out
        if isinstance(node, ast.NamedExpr | ast.Await):
            out = self.value(node.value)
            if isinstance(node, ast.NamedExpr):
                self.copy(self.var(node.target.id), out)
            return out
        if isinstance(node, ast.Lambda):
            out, name = self.temp(), f"{self.scopes[-1][0]}.<lambda:{node.lineno}>"
            self.fact("hold", out, f"f:{name}")
            self.function(name, node.args, [ast.Return(node.body)], None)
            return out
        for child in ast.iter_child_nodes(node) if node is not None else ():
            self.value(child) if isinstance(child, ast.expr) else self.visit(child)
        return None

    def copy(self, to: str | None, source: str | None) -> None:
        if to and source:
            self.fact("copy", to, source)

    def call(self, node: ast.Call) -> str:
        site = self.temp()
        if isinstance(node.func, ast.Name) and node.func.id == "super" and not node.args and self.scopes[-1][0] != self.module and self.method:
            self.fact("hold", site, f"s:{self.method}")
            return site
        callee = self.value(node.func)
        if callee:
            self.fact("call", site, callee, self.scopes[-1][0])
        for place, arg in [(str(i), a) for i, a in enumerate(node.args)] + [(k.arg, k.value) for k in node.keywords]:
            held = self.value(arg)
            if held and place and callee:
                self.fact("arg", site, place, held)
        return site

    # ---- statements

    method: str | None = None

    def function(self, name: str, args: ast.arguments, body: list[ast.stmt], owner: str | None, static: bool = False) -> None:
        names = [a.arg for a in args.posonlyargs + args.args]
        bound = set(names) | {a.arg for a in args.kwonlyargs} | {a.arg for a in (args.vararg, args.kwarg) if a}
        todo = list(body)
        while todo:  # names bound in this function, not in those within it
            node = todo.pop()
            if isinstance(node, ast.Name) and isinstance(node.ctx, ast.Store):
                bound.add(node.id)
            elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                bound.add(node.name)
                continue
            elif isinstance(node, ast.Import | ast.ImportFrom):
                bound |= {(a.asname or a.name).split(".")[0] for a in node.names}
            elif isinstance(node, ast.Lambda):
                continue
            todo.extend(ast.iter_child_nodes(node))
        bound -= {n for node in ast.walk(ast.Module(body, [])) if isinstance(node, ast.Global) for n in node.names}
        outer, method, self.owner = self.owner, self.method, None
        self.method = owner or self.method
        self.scopes.append((name, bound))
        for default, arg in zip(reversed(args.defaults), reversed(names), strict=False):
            self.copy(f"{name}:{arg}", self.value(default))
        if owner and not static and names:
            self.fact("self", owner, name.rsplit(".", 1)[-1], f"{name}:{names.pop(0)}")
        for i, arg in enumerate(names):
            self.fact("param", f"f:{name}", str(i), f"{name}:{arg}")
        for arg in names + [a.arg for a in args.kwonlyargs]:
            self.fact("param", f"f:{name}", arg, f"{name}:{arg}")
        for node in body:
            self.visit(node)
        self.scopes.pop()
        self.owner, self.method = outer, method

    def visit_FunctionDef(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        name = f"{self.owner or self.scopes[-1][0]}.{node.name}"
        marks = {d.id for d in node.decorator_list if isinstance(d, ast.Name)}
        for d in node.decorator_list:
            self.value(d)
        if self.owner:
            self.fact("member", self.owner, node.name)
        self.fact("hold", self.target(node.name), f"f:{name}")
        self.function(name, node.args, node.body, self.owner, "staticmethod" in marks)

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        name = f"{self.owner or self.scopes[-1][0]}.{node.name}"
        self.fact("hold", self.target(node.name), f"c:{name}")
        for i, base in enumerate(node.bases):
            held = self.value(base)
            if held:
                self.fact("base", name, f"{i:04d}", held)
        outer, self.owner = self.owner, name
        for child in node.body:
            self.visit(child)
        self.owner = outer

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            top = a.asname or a.name.split(".")[0]
            self.fact("hold", self.target(top), f"m:{a.name if a.asname else top}")
            parts = a.name.split(".")
            for i in range(1, len(parts)):
                self.fact("hold", ".".join(parts[: i + 1]), f"m:{'.'.join(parts[: i + 1])}")

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        home = self.module.split(".")[: -node.level] if node.level else []
        source = ".".join([*home, *([node.module] if node.module else [])])
        for a in node.names:
            if a.name != "*":
                self.copy(self.target(a.asname or a.name), f"{source}.{a.name}" if source else a.name)

    def assign(self, to: ast.expr, source: ast.expr) -> None:
        if isinstance(to, ast.Tuple | ast.List) and isinstance(source, ast.Tuple | ast.List) and len(to.elts) == len(source.elts):
            for t, s in zip(to.elts, source.elts, strict=True):
                self.assign(t, s)
            return
        held = self.value(source)
        if isinstance(to, ast.Name):
            if self.owner:
                self.fact("member", self.owner, to.id)
            self.copy(self.target(to.id), held)
        elif isinstance(to, ast.Attribute):
            base = self.value(to.value)
            if self.method and isinstance(to.value, ast.Name) and to.value.id == "self":
                self.fact("member", self.method, to.attr)
            if base and held:
                self.fact("store", base, to.attr, held)

    def visit_Assign(self, node: ast.Assign) -> None:
        for to in node.targets:
            self.assign(to, node.value)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        if node.value:
            self.assign(node.target, node.value)

    def visit_Return(self, node: ast.Return) -> None:
        held = self.value(node.value)
        if held and len(self.scopes) > 1:
            self.fact("return", f"f:{self.scopes[-1][0]}", held)

    def generic_visit(self, node: ast.AST) -> None:
        for child in ast.iter_child_nodes(node):
            self.value(child) if isinstance(child, ast.expr) else self.visit(child)


def _facts(text: str) -> list[tuple]:
    path, source = text.split("\n", 1)
    module = path.removesuffix(".py").removesuffix("/__init__").replace("/", ".")
    reader = _Reader(module)
    reader.visit(ast.parse(source))
    return sorted(set(reader.rows), key=repr)


def facts(files: DataFrame) -> DataFrame:
    """``(path, kind, a, b, c, problem)`` of ``files(path, text)``; a file that doesn't parse gives its problem alone, null texts and paths none."""
    named = files.where("path is not null and text is not null").select("path", F.concat_ws("\n", F.regexp_replace("path", r"^\./", ""), "text").alias("text"))
    return _rows(named, "kind string, a string, b string, c string", ["kind", "a", "b", "c"], _facts)


def _ancestors(rows, holds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(owner, attr, home)``: of each class's members those of the nearest class by steps, then by order of bases; and the same without its own."""
    copies = rows("copy").select(F.col("b").alias("source"), F.col("a").alias("target"))
    links = copies.unionByName(rows("load").join(holds.where("o like 'm:%'").hint("merge"), F.col("b") == F.col("v")).select(F.concat(F.expr("substring(o, 3)"), F.lit("."), "c").alias("source"), F.col("a").alias("target")))
    named, _ = fixpoint(links, holds.where("o like 'c:%'").select(F.col("v").alias("node"), F.col("o").alias("fact")))
    bases = written(rows("base").join(named.hint("merge"), F.col("c") == F.col("node")).select(F.col("a").alias("class"), F.expr("substring(fact, 3)").alias("parent"), F.col("b").alias("place")).distinct())
    front = written(holds.where("o like 'c:%'").select(F.expr("substring(o, 3)").alias("owner")).distinct().select("owner", F.col("owner").alias("class"), F.lit("").alias("place"), F.lit(0).alias("steps")))
    seen, steps = Grown(front), 0
    while True:  # a class is met once, by its fewest steps, so cycles of bases end
        steps += 1
        met = front.join(bases.hint("merge"), "class").groupBy("owner", F.col("parent").alias("class")).agg(F.min(F.concat(front["place"], bases["place"])).alias("place")).withColumn("steps", F.lit(steps))
        front = written(met.join(seen.rows().select("owner", "class").hint("merge"), ["owner", "class"], "left_anti").select("owner", "class", "place", "steps"))
        if front.isEmpty():
            break
        seen.add(front)
    members = seen.rows().join(rows("member").select(F.col("a").alias("class"), F.col("b").alias("attr")).distinct().hint("merge"), "class")
    nearest = lambda df: df.groupBy("owner", "attr").agg(F.min_by("class", F.struct("steps", "place")).alias("home"))
    return written(nearest(members)), written(nearest(members.where("steps > 0")))


def reach(found: DataFrame, rounds: int = 64) -> tuple[DataFrame, DataFrame, bool]:
    """``holds(v, o)``, ``calls(caller, callee)`` of ``facts``, and whether nothing new came within ``rounds``.

    Copies between variables and the calls that add copies (arguments to parameters, results to calls, attributes) depend on each other; each
    round joins new objects with all uses of variables, copies among them, and new copies with all objects. A module's own code is the caller
    named after the module. An inherited member is its nearest class's; ``self`` holds an instance of every class that has the method. Calls of
    what isn't read reach nothing. Joins are merges (see ``fixpoint``): facts are many for each row that their files come from, so an estimate
    by that table's size would broadcast them, whole, to each task.
    """
    found = written(found.where("problem is null").select("kind", "a", "b", "c").distinct(), "kind")
    rows = lambda kind: found.where(F.col("kind") == kind)
    first = rows("hold").select(F.col("a").alias("v"), F.col("b").alias("o"))
    members, above = _ancestors(rows, first)
    own = members.join(rows("self").select(F.col("a").alias("home"), F.col("b").alias("attr"), F.col("c").alias("v")).hint("merge"), ["home", "attr"]).select("v", F.concat(F.lit("i:"), "owner").alias("o"))
    # an attribute of an object is a variable: of its nearest class, of its module
    at = members.select(F.concat(F.lit("i:"), "owner").alias("o"), F.col("attr").alias("name"), "home").unionByName(members.select(F.concat(F.lit("c:"), "owner").alias("o"), F.col("attr").alias("name"), "home")).unionByName(above.select(F.concat(F.lit("s:"), "owner").alias("o"), F.col("attr").alias("name"), "home")).hint("merge")
    # what is done with a variable's objects: an attribute loaded to or stored from another variable, a call at a site by its caller, a copy
    use = lambda kind, v, name, to: rows(kind).select(F.col(v).alias("v"), F.lit(kind).alias("use"), F.col(name).alias("name"), F.col(to).alias("to"))
    uses = written(use("load", "b", "c", "a").union(use("store", "a", "b", "c")).union(use("call", "b", "c", "a")))
    args = rows("arg").select(F.col("a").alias("site"), F.col("b").alias("place"), F.col("c").alias("source")).hint("merge")
    params = rows("param").select(F.col("a").alias("f"), F.col("b").alias("place"), F.col("c").alias("to")).hint("merge")
    returns = rows("return").select(F.col("a").alias("f"), F.col("b").alias("source")).hint("merge")
    init = members.where("attr = '__init__'").select(F.concat(F.lit("c:"), "owner").alias("o"), F.concat(F.lit("f:"), "home", F.lit(".__init__")).alias("f")).hint("merge")
    place = F.when(F.col("o").startswith("m:"), F.concat_ws(".", F.expr("substring(o, 3)"), "name")).when(F.col("home").isNotNull(), F.concat_ws(".", "home", "name"))

    new_holds = written(first.unionByName(own).distinct())
    new_copies = written(rows("copy").select(F.col("b").alias("source"), F.col("a").alias("to")).distinct())
    holds, copies, reached = Grown(new_holds), Grown(new_copies), Grown(written(rows("call").limit(0).select(F.col("a").alias("site"), F.col("c").alias("caller"), F.lit("").alias("f"))))
    for _ in range(rounds):
        copied = copies.rows().select(F.col("source").alias("v"), F.lit("copy").alias("use"), F.lit(None).cast("string").alias("name"), "to")
        met = written(uses.union(copied).join(new_holds.hint("merge"), "v").where("use = 'copy' or case when use = 'call' then o like 'f:%' or o like 'c:%' else o not like 'f:%' end").select("use", "name", "to", "o"))
        called = met.where("use = 'call'").select(F.col("to").alias("site"), F.col("name").alias("caller"), "o")
        entered = called.where("o like 'f:%'").select("site", "caller", F.col("o").alias("f")).unionByName(called.where("o like 'c:%'").join(init, "o").select("site", "caller", "f")).distinct()
        entered = written(entered.join(reached.rows().hint("merge"), ["site", "caller", "f"], "left_anti"))
        reached.add(entered)
        placed = met.where("use in ('load', 'store')").join(at, ["o", "name"], "left").withColumn("place", place).where("place is not null")
        more = (
            placed.select(F.when(F.col("use") == "load", F.col("place")).otherwise(F.col("to")).alias("source"), F.when(F.col("use") == "load", F.col("to")).otherwise(F.col("place")).alias("to"))
            .unionByName(entered.join(args, "site").join(params, ["f", "place"]).select("source", "to"))
            .unionByName(entered.join(returns, "f").select("source", F.col("site").alias("to")))
        ).distinct()
        more = written(more.join(copies.rows().hint("merge"), ["source", "to"], "left_anti"))
        made = called.where("o like 'c:%'").select(F.col("site").alias("v"), F.concat(F.lit("i:"), F.expr("substring(o, 3)")).alias("o"))
        carried = met.where("use = 'copy'").select(F.col("to").alias("v"), "o").unionByName(more.join(holds.rows().hint("merge"), F.col("v") == F.col("source")).select(F.col("to").alias("v"), "o"))
        new_holds = written(carried.unionByName(made).distinct().join(holds.rows().hint("merge"), ["v", "o"], "left_anti"))
        if not more.isEmpty():
            copies.add(more)
        if new_holds.isEmpty():
            break
        holds.add(new_holds)
    done = new_holds.isEmpty()
    return holds.rows(), reached.rows().select("caller", F.expr("substring(f, 3)").alias("callee")).distinct(), done
