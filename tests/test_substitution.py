import re

from lodestrata.operators import substitution
from lodestrata.sources import manifests


def brute(values):
    def go(k, seen):
        if k in seen:
            raise RecursionError
        lost = False

        def one(m):
            nonlocal lost
            if m[1] not in values:
                lost = True
                return m[0]
            text, inner = go(m[1], seen | {k})
            lost |= inner
            return text

        return re.sub(r"\$\{([^${}]*)\}", one, values[k]), lost

    out = {}
    for k, v in values.items():
        try:
            text, lost = go(k, frozenset())
            out[k] = (text, "unresolved" if lost else "resolved")
        except RecursionError:
            out[k] = (v, "cycle")
    return out


VALUES = {"a": "1", "b": "${a}.${a}", "c": "x${b}y${gone}", "d": "${c}", "e": "${f}", "f": "${e}", "g": "${e}!", "h": "$ ${ ${a", "i": "${}", "j": "", "k": "${j}${j}", "self": "${self}", "odd": "${a$b}", "deep": "${${a}}"} | {f"n{i}": f"${{n{i - 1}}}+{i}" if i else "0" for i in range(12)}


def test_equals_brute_force(spark):
    rows = [("s", k, v) for k, v in VALUES.items()] + [("t", "a", "other"), ("t", "b", "${a}-${c}"), ("s", "a", "1"), ("t", "nothing", None)]
    got = substitution.resolve(spark.createDataFrame(rows, "scope string, key string, value string")).collect()
    assert {r.key: (r.value, r.status) for r in got if r.scope == "s"} == brute(VALUES)
    assert {r.key: (r.value, r.status) for r in got if r.scope == "t"} == {"a": ("other", "resolved"), "b": ("other-${c}", "unresolved"), "nothing": ("", "resolved")}
    assert len(got) == len(VALUES) + 3


def test_texts_that_would_explode_are_left(spark):
    rows = [("s", f"x{i}", f"${{x{i - 1}}}" * 8 if i else "ha") for i in range(9)]
    got = {r.key: (len(r.value), r.status) for r in substitution.resolve(spark.createDataFrame(rows, "scope string, key string, value string")).collect()}
    assert got["x5"] == (2 * 8**5, "resolved") and got["x6"] == (40, "too-long") and got["x8"][1] == "too-long"
    assert substitution.resolve(spark.createDataFrame([], "scope string, key string, value string")).count() == 0


def test_pom_texts(spark):
    parent = "<project><groupId>g</groupId><artifactId>p</artifactId><version>7</version><properties><major>1</major><lib.version>${major}.${minor}</lib.version><minor>0</minor><loop>${loop2}</loop><loop2>${loop}</loop2></properties><dependencyManagement><dependencies><dependency><groupId>g</groupId><artifactId>m</artifactId><version>${lib.version}-${project.version}</version><scope>${sc}</scope></dependency></dependencies></dependencyManagement><build><pluginManagement><plugins><plugin><artifactId>jar</artifactId><version>3.${major}</version></plugin></plugins></pluginManagement></build></project>"
    child = "<project><parent><groupId>g</groupId><artifactId>p</artifactId><version>7</version></parent><artifactId>c</artifactId><version>8</version><properties><minor>${project.parent.version}</minor><sc>test</sc></properties><dependencies><dependency><groupId>g</groupId><artifactId>m</artifactId></dependency><dependency><groupId>${project.groupId}.x</groupId><artifactId>a-${major}</artifactId><version>[${lib.version},${loop})</version></dependency></dependencies><build><plugins><plugin><artifactId>jar</artifactId></plugin><plugin><groupId>o</groupId><artifactId>own</artifactId><version>${gone}.1</version></plugin></plugins></build></project>"
    got = manifests.pom(spark.createDataFrame([("p/pom.xml", parent), ("c/pom.xml", child)], "path string, text string")).where("path = 'c/pom.xml'").collect()
    assert sorted(map(tuple, got)) == sorted([("c/pom.xml", "g:m", "1.7-8", "test", "dependency"), ("c/pom.xml", "g.x:a-1", "[1.7,${loop})", "runtime", "dependency"), ("c/pom.xml", "org.apache.maven.plugins:jar", "3.1", "build", "plugin"), ("c/pom.xml", "o:own", "${gone}.1", "build", "plugin")])
    states = {(r.key, r.status): r.value for r in manifests.pom_properties(spark.createDataFrame([("p/pom.xml", parent)], "path string, text string")).collect()}
    assert states[("lib.version", "resolved")] == "1.0" and states[("loop", "cycle")] == "${loop2}" and states[("project.version", "resolved")] == "7"
