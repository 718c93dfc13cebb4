"""What calls reach: names through imports, arguments, results, attributes and bases; cycles and cut-off rounds."""

from lodestrata.plans import callgraph

from .test_sources import rows, table

BASE = """
class Base:
    def run(self):
        return self.step()
    def step(self):
        return helper
    def __init__(self, f):
        self.f = f
    @staticmethod
    def make(f):
        return Child(f)

def helper(): pass
def outer(g):
    def inner(): g()
    return inner
"""
MAIN = """
from p.base import Base as B, helper
import p.base as pb
import p.base

class Child(B):
    def step(self):
        x = super().step()
        x()
        self.f()

def cb(): pass
def main():
    c = Child(cb)
    c.run()
    pb.outer(helper)()
    p.base.helper()
    k = cb if c else (lambda: main())
    k()
    nothing()
    each(f=cb)
def each(n=None, f=None):
    f()
main()
"""


def test_names_and_calls_together(spark):
    files = table(spark, **{"p/base.py": BASE, "q.py": MAIN, "bad.py": "def ("})
    found = callgraph.facts(files).cache()
    assert rows(found.where("problem is not null"), "path") == [("bad.py",)]
    holds, calls, done = callgraph.reach(found)
    assert done
    assert {(a, b) for a, b in rows(calls, "caller", "callee")} == {
        ("q", "q.main"), ("q.main", "p.base.Base.__init__"), ("q.main", "p.base.Base.run"), ("p.base.Base.run", "p.base.Base.step"), ("p.base.Base.run", "q.Child.step"), ("q.Child.step", "p.base.Base.step"), ("q.Child.step", "p.base.helper"),
        ("q.Child.step", "q.cb"), ("q.main", "p.base.outer"), ("q.main", "p.base.outer.inner"), ("p.base.outer.inner", "p.base.helper"), ("q.main", "p.base.helper"), ("q.main", "q.cb"), ("q.main", "q.main.<lambda:18>"), ("q.main.<lambda:18>", "q.main"),
        ("q.main", "q.each"), ("q.each", "q.cb"),
    }
    assert not callgraph.reach(found, 2)[2]
    none = callgraph.reach(callgraph.facts(files.limit(0)))
    assert none[0].count() == none[1].count() == 0 and none[2]
