"""Calls over two generated modules for each part, in five forms chosen by its key; the SQL says who reaches whom."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.lineage import spread

from . import callgraph
from .driver_queries import ORACLE, QUERIES, _t

#: Each form: the text of module ``a{k}``, of module ``b{k}``, and who reaches whom.
FORMS = [
    ("def f{m}(): pass\n", "from a{k} import f{m} as g\ndef main():\n    x, y = g, None\n    x()\n", [("b.main", "a.f{m}")]),
    (
        "class Base:\n    def run(self):\n        return self.step()\n    def step(self): pass\n",
        "import a{k}\nclass Child(a{k}.Base):\n    def step(self):\n        super().step()\ndef main():\n    c = Child()\n    c.run()\n",
        [("b.main", "a.Base.run"), ("a.Base.run", "a.Base.step"), ("a.Base.run", "b.Child.step"), ("b.Child.step", "a.Base.step")],
    ),
    (
        "def outer{m}(g):\n    def inner(): g()\n    return inner\n", "import a{k} as m\ndef cb(): pass\ndef main():\n    m.outer{m}(g=cb)()\n",
        [("b.main", "a.outer{m}"), ("b.main", "a.outer{m}.inner"), ("a.outer{m}.inner", "b.cb")],
    ),
    (
        "class C{m}:\n    def __init__(self, f):\n        self.f = f\n    def go(self):\n        self.f()\n", "from a{k} import C{m}\ndef cb(): pass\nC{m}(cb).go()\n",
        [("b", "a.C{m}.__init__"), ("b", "a.C{m}.go"), ("a.C{m}.go", "b.cb")],
    ),
    ("def even(n):\n    return odd\ndef odd(n):\n    even(n)()\n    return even\nx = even(0)\nx(1)\nlost{m}()\n", "def (\n", [("a", "a.even"), ("a", "a.odd"), ("a.odd", "a.even"), ("a.odd", "a.odd")]),
]


def call_graph(spark, sf_dir):
    key = F.col("p_partkey")
    pick = lambda i: F.element_at(F.array(*[F.lit(f[i]) for f in FORMS]), (key % len(FORMS) + 1).cast("int"))
    file = lambda name, i: F.struct(F.concat(F.lit(name), key.cast("string"), F.lit(".py")).alias("path"), F.replace(F.replace(pick(i), F.lit("{k}"), key.cast("string")), F.lit("{m}"), (key % 7).cast("string")).alias("text"))
    files = spread(_t(spark, sf_dir, "part").select("p_partkey")).select(F.inline(F.array(file("a", 0), file("b", 1))))
    return callgraph.reach(callgraph.facts(files))[1]


def _sql(name: str) -> str:
    home, _, rest = name.partition(".")
    return f"'{home}' || k || '{'.' + rest if rest else ''}'".replace("{m}", "' || m || '")


QUERIES["call_graph"] = call_graph
ORACLE["call_graph"] = "with p as (select p_partkey k, p_partkey % 7 m from part) " + " union all ".join(
    f"select {_sql(a)} as caller, {_sql(b)} as callee from p where k % {len(FORMS)} = {i}" for i, (_, _, rows) in enumerate(FORMS) for a, b in rows
)
