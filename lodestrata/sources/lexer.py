"""A table-driven lexer with a stack of states, and the tables of JavaScript (with and without JSX), Gradle and CMake.

A language is a table: for each state, rules of (kind, pattern, action, place). The action puts a state on the stack, leaves
one (``-``) or replaces the top one (``=state``); the place says whether a rule holds only where an operand may begin. What tells
a regular expression from a division, a template's substitution from a block and text between tags from code is thus
in the tables. A text is read once, from the left; a character that no rule takes is a token of its own.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache
from typing import NamedTuple


class Token(NamedTuple):
    kind: str
    text: str
    line: int
    depth: int  # states below it on the stack
    joined: bool  # nothing stands between it and the token before


class Rule(NamedTuple):
    kind: str
    pattern: str
    action: str = ""
    operand: bool = False


#: Opening marks and what closes them.
_CLOSES = {"}": "{", ")": "(", "]": "["}

_CODE = (Rule("open", r"[({\[]", "code"), Rule("close", r"[)}\]]", "-"))
_C_COMMENT = Rule("comment", r"//[^\n]*|/\*.*?(?:\*/|\Z)")
_QUOTED = r'"(?:\\.|[^"\\\n])*"|' + r"'(?:\\.|[^'\\\n])*'"

_JS_CODE = (
    Rule("comment", r"\A\#![^\n]*"), _C_COMMENT, Rule("string", _QUOTED), Rule("start", "`", "template"),
    Rule("regex", r"/(?:\\.|\[(?:\\.|[^\]\\\n])*+\]|[^/\\\[\n])++/\w*+", "", True),
    Rule("number", r"\.?\d[\w.]*"), Rule("word", r"[#@]?[\w$]+"), *_CODE, Rule("operator", r"\+\+|--|=>|\?\.(?!\d)|\.\.\."),
)
_TEMPLATE = (Rule("text", r"(?:\\.|\$(?!\{)|[^`\\$])+"), Rule("open", r"\$\{", "code"), Rule("end", "`", "-"))
JAVASCRIPT = {"code": _JS_CODE, "template": _TEMPLATE}
JSX = {
    "code": (Rule("start", r"<(?=>|[A-Za-z_$][\w$.:-]*[\s/>])(?!\w+\s+extends\b)", "tag", True), *_JS_CODE),
    "template": _TEMPLATE,
    "tag": (_C_COMMENT, Rule("value", r"\"[^\"]*\"|'[^']*'"), Rule("open", r"\{", "code"), Rule("end", "/>", "-"), Rule("text", ">", "=children"), Rule("name", r"[\w$.:-]+")),
    "children": (Rule("text", r"[^<{]+"), Rule("open", r"\{", "code"), Rule("end", r"</[^>]*>", "-"), Rule("start", "<", "tag")),
}
GRADLE = {"code": (_C_COMMENT, Rule("string", r'"""(?:.*?)"""|' + r"'''(?:.*?)'''|" + _QUOTED), Rule("number", r"\d[\w.]*"), Rule("word", r"[A-Za-z_$][\w$]*"), *_CODE)}
CMAKE = {
    "code": (
        Rule("comment", r"\#\[(?P<c>=*)\[.*?(?:\](?P=c)\]|\Z)|\#[^\n]*"), Rule("bracket", r"\[(?P<b>=*)\[.*?(?:\](?P=b)\]|\Z)"), Rule("string", r'"(?:\\.|[^"\\])*"'),
        Rule("open", r"\(", "code"), Rule("close", r"\)", "-"), Rule("word", r'(?:\\.|[^\s()#"\\])+'),
    )
}

#: Words of JavaScript behind which an operand begins, and those whose parentheses end before one.
_BEFORE_OPERAND = frozenset("await case default delete do else extends in instanceof new of return throw typeof void yield".split())
_CONTROL = frozenset({"if", "while", "for", "with"})


@cache
def _compiled(language: str) -> dict[tuple[str, bool], tuple[re.Pattern, dict[str, Rule]]]:
    out = {}
    for state, rules in globals()[language].items():
        for operand in (False, True):
            held = {f"r{i}": r for i, r in enumerate(rules) if operand or not r.operand}
            out[state, operand] = (re.compile("|".join(f"(?P<{n}>{r.pattern})" for n, r in held.items()), re.S), held)
    return out


def tokens(text: str, language: str) -> Iterator[Token]:
    """Tokens of ``text`` but comments, white space, and text of templates and between tags. ``language`` names a table of this module."""
    table = _compiled(language)
    stack: list[tuple[str, str, bool]] = [("code", "", True)]  # state, what opened it, whether an operand may follow its end
    places: dict[str, list[int]] = {"{": [], "(": [], "[": [], "": []}  # where on the stack each mark stands, and what isn't code's
    at, line, operand, last, before, joined = 0, 1, True, None, None, False
    while at < len(text):
        pattern, rules = table[stack[-1][0], operand]
        m = pattern.match(text, at)
        if m is None:
            if text[at].isspace():
                line, at, joined = line + (text[at] == "\n"), at + 1, False
                continue
            rule, piece = Rule("operator", ""), text[at]
        else:
            rule, piece = next(rules[n] for n in rules if m[n] is not None), m[0]
        if rule.kind not in ("comment", "text"):
            yield Token(rule.kind, piece, line, len(stack) - 1, joined)
        line, at, joined = line + piece.count("\n"), at + len(piece), rule.kind != "comment"
        if rule.kind == "comment":
            continue
        if rule.action == "-":
            operand = _leave(stack, places, piece, rule.kind)
        elif rule.action.startswith("="):
            stack[-1] = (rule.action[1:], *stack[-1][1:])
        elif rule.action:
            places[piece[-1] if rule.kind == "open" else ""].append(len(stack))
            stack.append((rule.action, piece[-1], _after(rule.kind, piece, last, before, operand)))
            operand = True
        elif piece not in ("++", "--"):
            operand = rule.kind == "operator" or (rule.kind == "word" and piece in _BEFORE_OPERAND and last != ".")
        if rule.kind != "text":
            before, last = last, piece


def _after(kind: str, piece: str, last: str | None, before: str | None, operand: bool) -> bool:
    """Whether an operand may begin behind what ``piece`` opens: behind blocks and conditions, not behind values."""
    if piece == "(":
        return last in _CONTROL and before != "."
    return kind == "open" and piece == "{" and (not operand or last in (None, ";", "{", "}", ")", "=>", "else", "do"))


def _leave(stack: list[tuple[str, str, bool]], places: dict[str, list[int]], piece: str, kind: str) -> bool:
    """Leaves the state that ``piece`` ends; a stray closing mark ends nothing, one that skips others ends them too."""
    at = len(stack) - 1
    if kind == "close":
        own, other = places[_CLOSES[piece]], places[""]
        at = own[-1] if own and (not other or own[-1] > other[-1]) else 0
    if not at:
        return False
    after = stack[at][2]
    del stack[at:]
    for held in places.values():
        while held and held[-1] >= at:
            held.pop()
    return after


def literal(token: Token) -> str:
    """The value of a string token; marks behind a backslash stand for themselves."""
    width = 3 if token.text[:3] in ('"""', "'''") and len(token.text) >= 6 else 1
    return re.sub(r"\\(.)", r"\1", token.text[width:-width], flags=re.S)


def module_loads(text: str, language: str) -> list[tuple]:
    """``(line, reference, kind)`` of JavaScript: regular, dynamic, resolve; computed loads have no reference."""
    own = list(tokens(text, language))
    end = Token("end", "", 0, 0, False)
    at: Callable[[int], Token] = lambda i: own[i] if 0 <= i < len(own) else end
    out: list[tuple] = []

    def called(i: int, line: int, kind: str) -> None:
        """A call whose parenthesis is token ``i``: literal where a string is all of its first argument."""
        if at(i + 1).kind == "string" and at(i + 2).text in (")", ","):
            out.append((line, literal(at(i + 1)), kind))
        else:
            out.append((line, None, "computed"))

    for i, t in enumerate(own):
        if t.kind != "word" or t.text not in ("import", "export", "require") or at(i - 1).text in (".", "?."):
            continue
        if t.text == "require":
            if at(i + 1).text == "(":
                called(i + 1, t.line, "regular")
            elif at(i + 1).text == "." and at(i + 2).text == "resolve" and at(i + 3).text == "(":
                called(i + 3, t.line, "resolve")
        elif t.text == "import" and at(i + 1).text == "(":
            called(i + 1, t.line, "dynamic")
        elif t.text == "import" and at(i + 1).kind == "string":
            out.append((t.line, literal(at(i + 1)), "regular"))
        else:
            j = i + 1  # names in braces, stars and commas up to the word before a string
            while at(j).kind in ("word", "string") and (at(j).depth > t.depth or at(j).text not in ("import", "export")) or at(j).text in ("}", ",", "*") or (at(j).text == "{" and at(j).depth == t.depth):
                if at(j).text == "from" and at(j).depth == t.depth and at(j + 1).kind == "string":
                    out.append((t.line, literal(at(j + 1)), "regular"))
                    break
                j += 1
    return sorted({x for x in out if x[1] != ""}, key=repr)


#: What brings in a coordinate within a configuration's call.
_WRAPPERS = ("platform", "enforcedPlatform", "testFixtures")
#: Gradle's configurations by scope; others are unknown.
GRADLE_SCOPES = {
    "api": "runtime", "implementation": "runtime", "compile": "runtime", "runtime": "runtime", "runtimeOnly": "runtime", "compileOnly": "optional", "compileOnlyApi": "optional", "annotationProcessor": "build", "kapt": "build", "ksp": "build",
    "classpath": "build", "testImplementation": "test", "testCompile": "test", "testCompileOnly": "test", "testRuntimeOnly": "test", "testAnnotationProcessor": "test", "androidTestImplementation": "test",
}
_COORDINATE = re.compile(r"([\w.\-]+):([\w.\-]+)(?::([^:@]*))?(?::[^:@]*)?(?:@[\w.]+)?\Z")


def gradle_calls(text: str) -> list[tuple]:
    """``(line, package, constraint_raw, configuration, scope, kind, literal, context)`` of literal calls within ``dependencies`` blocks.

    ``kind``: dependency, constraint, or the wrapper's name. ``context``: the blocks around it, outermost first. A version with a ``$`` in a
    double-quoted string isn't literal; a coordinate whose names hold one gives no row.
    """
    own, out = list(tokens(text, "GRADLE")), []
    blocks: list[str] = []
    calls: dict[int, int] = {}  # the last opening parenthesis by depth

    def values(i: int) -> Iterator[tuple[str, bool]]:
        """Coordinates from token ``i`` on: strings with commas between, or ``group``, ``name`` and ``version`` by name."""
        named: dict[str, tuple[str, bool]] = {}
        while i < len(own) and (own[i].kind == "string" or own[i].text in (",", "group", "name", "version")):
            if own[i].kind == "word":
                if not (i + 2 < len(own) and own[i + 1].text in (":", "=") and own[i + 2].kind == "string"):
                    break
                named[own[i].text] = (literal(own[i + 2]), plain(own[i + 2]))
                i += 3
            else:
                if own[i].kind == "string":
                    yield literal(own[i]), plain(own[i])
                i += 1
        if "group" in named and "name" in named:
            parts = [named[n] for n in ("group", "name", "version") if n in named]
            yield ":".join(p for p, _ in parts), all(ok for _, ok in parts)

    def plain(t: Token) -> bool:
        return t.text[0] == "'" or "$" not in t.text

    for i, t in enumerate(own):
        if t.text == "(":
            calls[t.depth] = i
        elif t.text == "{":
            j = i - 1
            if j >= 0 and own[j].text == ")":  # a block behind a call's arguments has the call's name
                j = calls.get(t.depth, 0) - 1
            blocks.append(own[j].text if j >= 0 and own[j].kind == "word" else "")
        elif t.text == "}" and blocks:
            blocks.pop()
        elif t.kind == "word" and "dependencies" in blocks and (i == 0 or own[i - 1].text in ("{", "}", ";") or own[i - 1].line < t.line):
            j, wrapper = i + 1, None
            if j < len(own) and own[j].text == "(":
                j += 1
            name = t.text
            if name == "add" and j + 1 < len(own) and own[j].kind == "string" and own[j + 1].text == ",":
                name, j = literal(own[j]), j + 2
            if j + 1 < len(own) and own[j].text in _WRAPPERS and own[j + 1].text == "(":
                wrapper, j = own[j].text, j + 2
            for value, fixed in values(j) if j < len(own) and (own[j].line == t.line or own[j - 1].text == "(") else ():
                found = _COORDINATE.match(value)
                if found:
                    constraint = "constraints" in blocks
                    scope = "build" if constraint or wrapper in ("platform", "enforcedPlatform") else GRADLE_SCOPES.get(name, "unknown")
                    out.append((t.line, f"{found[1]}:{found[2]}", found[3] or None, name, scope, wrapper or ("constraint" if constraint else "dependency"), str(fixed).lower(), "/".join(blocks)))
    return out


def cmake_calls(text: str) -> list[tuple]:
    """``(line, package, version, kind, required, components, conditional)`` of ``find_package``, ``find_dependency`` and ``FetchContent_Declare``.

    Nothing is evaluated: a call within a block (``if``, loops, functions) is conditional; a name or a version with a reference in it isn't known.
    """
    own, out, open_blocks, i = list(tokens(text, "CMAKE")), [], 0, 0
    bare = lambda t: literal(t) if t.kind == "string" else t.text
    known = lambda v: v if v and "$" not in v else None
    while i + 1 < len(own):
        name = own[i].text.lower()
        if own[i].kind != "word" or own[i + 1].text != "(" or own[i].depth:
            i += 1
            continue
        end = i + 2
        while end < len(own) and own[end].depth > own[i].depth and not (own[end].text == ")" and own[end].depth == 1):
            end += 1
        args = [bare(t) for t in own[i + 2 : end] if t.kind in ("word", "string")]
        if name in ("if", "foreach", "while", "function", "macro", "block"):
            open_blocks += 1
        elif name in ("endif", "endforeach", "endwhile", "endfunction", "endmacro", "endblock"):
            open_blocks = max(0, open_blocks - 1)
        elif end < len(own) and args and re.fullmatch(r"[\w.+\-]+", args[0]):
            inside = str(open_blocks > 0).lower()
            if name in ("find_package", "find_dependency"):
                version = args[1] if len(args) > 1 and re.fullmatch(r"\d[\d.]*(\.\.\.<?\d[\d.]*)?", args[1]) else None
                wanted: list[str] = []
                for k, a in enumerate(args):
                    if a in ("COMPONENTS", "REQUIRED"):
                        for c in args[k + 1 :]:
                            if re.fullmatch(r"[A-Z_]+", c):
                                break
                            wanted.append(c)
                out.append((own[i].line, args[0], version, name, str("REQUIRED" in args).lower(), ",".join(wanted) or None, inside))
            elif name == "fetchcontent_declare":
                tag = next((args[k + 1] for k in range(len(args) - 1) if args[k].upper() == "GIT_TAG"), None)
                out.append((own[i].line, args[0], known(tag), "fetch_content", "true", None, inside))
        i = end
    return out
