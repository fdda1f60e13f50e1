"""Facts of source files: definitions, imports, exports, calls, assignments.

Python is read by its own parser, the other languages by rules over their
tokens with matched brackets. ``parse_tier`` says which. A file that can't be
parsed comes back with its error and no facts. A call's ``callee`` is the whole
expression before the bracket where the language's names are plain (TypeScript,
JavaScript, Python, Go, Rust), and the last name of it in the others.
"""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from .lexer import Source

SCHEMA = (
    "path string, language string, definitions array<struct<name:string,kind:string,start_line:int,end_line:int>>, "
    "imports array<struct<source:string,names:array<struct<name:string,alias:string>>,is_default:boolean,is_namespace:boolean,line:int>>, "
    "exports array<struct<name:string,is_default:boolean,is_reexport:boolean,source:string,line:int>>, "
    "call_sites array<struct<callee:string,line:int,containing_function:string,arguments:array<string>>>, "
    "assignments array<struct<variable:string,callee:string,line:int,containing_function:string>>, "
    "bases array<struct<type:string,base:string,line:int>>, parse_tier string, error string"
)
COLUMNS = ("path", "language", "definitions", "imports", "exports", "call_sites", "assignments", "bases", "parse_tier", "error")

# fixed values: the keywords with which each language begins a definition, and the kind of what follows
KEYWORD_KINDS = {
    "TypeScript": {"function": "Function", "class": "Class", "interface": "Interface", "type": "TypeAlias"},
    "Go": {"func": "Function"},
    "Rust": {"fn": "Function", "struct": "Class", "enum": "Class", "trait": "Interface", "type": "TypeAlias", "const": "Constant", "static": "Constant"},
    "Java": {"class": "Class", "enum": "Class", "interface": "Interface", "@interface": "Interface"},
    "CSharp": {"class": "Class", "struct": "Class", "enum": "Class", "record": "Class", "interface": "Interface", "delegate": "Interface"},
    "Php": {"function": "Function", "class": "Class", "interface": "Interface", "trait": "Interface", "enum": "TypeAlias", "const": "Constant"},
    "Ruby": {"def": "Function", "class": "Class", "module": "Module"},
    "Kotlin": {"fun": "Function", "class": "Class", "interface": "Class", "object": "Class", "val": "Constant", "var": "Constant", "typealias": "TypeAlias"},
    "Swift": {"func": "Function", "class": "Class", "struct": "Class", "enum": "Class", "actor": "Class", "protocol": "Interface", "let": "Constant",
        "var": "Constant", "typealias": "TypeAlias"},
    "Scala": {"def": "Function", "class": "Class", "object": "Class", "trait": "Interface", "val": "Constant", "var": "Constant", "type": "TypeAlias"},
    "C": {"struct": "Class", "enum": "Class", "union": "Class"},
    "Cpp": {"class": "Class", "struct": "Class", "enum": "Class", "namespace": "Module", "using": "TypeAlias"},
}
# fixed values: words that stand before a bracket and call nothing
NO_CALLS = frozenset((
    "if", "for", "while", "switch", "return", "catch", "function", "sizeof", "match", "def", "fn", "func", "fun", "elif", "elsif", "unless", "until",
        "when", "super", "async",
    "await", "import", "using", "typeof", "foreach", "lock", "synchronized", "and", "or", "not", "in", "do", "else", "try", "case", "yield", "throw",
        "guard", "where", "let", "var",
    "val", "const", "new", "defined", "alignof", "decltype", "static_assert", "isset", "empty", "list", "array", "echo", "include", "include_once",
        "require_once", "constructor", "base", "this",
))
#: languages whose callee is the whole expression before the bracket
WHOLE_CALLEE = ("TypeScript", "Go", "Rust")
#: languages in which ``new T(..)`` calls T
NEW_CALLS = ("Java", "CSharp", "Php")
_TYPE_KINDS = ("Class", "Interface", "Module")


def _empty(path, language, tier, error=None):
    return {c: [] for c in COLUMNS} | {"path": path, "language": language, "parse_tier": tier, "error": error}


def _named(*names, source, line, default=False, namespace=False):
    return {"source": source, "names": [{"name": n, "alias": a} for n, a in names], "is_default": default, "is_namespace": namespace, "line": line}


# --- Python -----------------------------------------------------------------------


def parse_python(path: str, source: str) -> dict:
    out = _empty(path, "Python", "ast")
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError) as e:
        return out | {"error": type(e).__name__}

    def callee(node):
        node = node.value if isinstance(node, ast.Await) else node
        return ast.unparse(node.func) if isinstance(node, ast.Call) else None

    def visit(node, owner):
        for x in ast.iter_child_nodes(node):
            inner = owner
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                first = min([x.lineno, *(d.lineno for d in x.decorator_list)])
                out["definitions"].append({"name": x.name, "kind": "Class" if isinstance(x, ast.ClassDef) else "Function", "start_line": first, "end_line": x.end_lineno})
                inner = owner if isinstance(x, ast.ClassDef) else x.name
                if isinstance(x, ast.ClassDef):
                    out["bases"] += [{"type": x.name, "base": ast.unparse(b), "line": x.lineno} for b in x.bases]
            elif isinstance(x, ast.Import):
                for a in x.names:
                    out["imports"].append(_named((a.name, a.asname), source=a.name, line=x.lineno, namespace=True))
            elif isinstance(x, ast.ImportFrom):
                names = [(a.name, a.asname) for a in x.names]
                out["imports"].append(_named(*names, source="." * x.level + (x.module or ""), line=x.lineno, namespace=any(a.name == "*" for a in x.names)))
            elif isinstance(x, ast.Call):
                arguments = [ast.unparse(a) for a in x.args] + [ast.unparse(k.value) for k in x.keywords]
                out["call_sites"].append({"callee": ast.unparse(x.func), "line": x.lineno, "containing_function": owner, "arguments": arguments})
            elif isinstance(x, ast.Assign) and callee(x.value) and len(x.targets) == 1 and isinstance(x.targets[0], ast.Name):
                out["assignments"].append({"variable": x.targets[0].id, "callee": callee(x.value), "line": x.lineno, "containing_function": owner})
            visit(x, inner)

    visit(tree, None)
    return out


# --- the others: definitions ------------------------------------------------------------


class _Definitions:
    """Definitions with the token range that each spans."""

    def __init__(self, src: Source, language: str):
        self.src, self.language, self.found, self.bases = src, language, [], []
        self.bodies: dict[int, str] = {}  # opening bracket -> kind of the definition it belongs to
        self.ruby_end = _ruby_ends(src) if language == "Ruby" else {}
        self.seen: set = set()
        i = 0
        while i < len(src):
            if src.tokens[i].kind == "word":
                self._at(i)
            i += 1

    def add(self, name: str, kind: str, start: int, end: int, body: int = -1):
        if name and (start, name) not in self.seen:
            self.seen.add((start, name))
            self.found.append((name, kind, start, min(end, self.src.last), body))
            if body >= 0:
                self.bodies[body] = kind

    def scope(self, i: int) -> str:
        """The kind of the definition whose body directly holds token ``i``; nothing at the top, ``block`` elsewhere."""
        at = self.src.inside[i]
        return "" if at < 0 else self.bodies.get(at, "block")

    def body(self, i: int, stops=(";",)) -> tuple[int, int]:
        """``(opening brace or -1, last token)`` of what begins before ``i``."""
        src, k = self.src, i
        while k <= src.last:
            x = src.at(k)
            if x == "{":
                return k, src.close(k)
            if x in ("(", "["):
                k = src.close(k)
            elif x in stops or x == "}":
                return -1, k if x in stops else k - 1
            k += 1
        return -1, src.last

    def statement(self, i: int) -> int:
        """The last token of the statement at ``i``: at a semicolon, or a line's end that nothing goes on after."""
        src, k = self.src, i
        while k < src.last:
            x = src.at(k)
            if x == ";":
                return k
            if x in ("(", "[", "{"):
                k = src.close(k)
            nxt = src.tokens[min(k + 1, src.last)]
            if src.inside[min(k + 1, src.last)] != src.inside[i] or nxt.text in (")", "]", "}"):
                return k
            if nxt.line > src.tokens[k].line and nxt.text[:1] not in ".?:&|=+-*/<" and src.at(k) not in ("=", "=>", ",", "+", "&&", "||", "?", ":", "->", "."):
                return k
            k += 1
        return src.last

    def _at(self, i: int):
        src, lang = self.src, self.language
        word = src.tokens[i].text
        prev = src.at(i - 1)
        kind = KEYWORD_KINDS[lang].get(word)
        if prev in (".", "?.", "->") or (prev == "::" and lang != "Cpp") or (prev == ":" and lang == "Ruby"):
            return
        if lang == "Go":
            return self._go(i, word)
        if lang == "Ruby":
            return self._ruby(i, word, kind)
        if lang in ("C", "Cpp") and self._c(i, word):
            return
        if lang == "TypeScript" and self._typescript(i, word):
            return
        if lang in ("Java", "CSharp") and kind is None:
            return self._member(i, word)
        if lang == "Rust" and word == "macro_rules" and src.at(i + 1) == "!":
            body, end = self.body(i + 3)
            return self.add(src.word(i + 2), "Function", i, end, body)
        if kind is None or (lang in ("C", "Cpp") and kind in _TYPE_KINDS + ("TypeAlias",)):
            return
        self._keyword(i, word, kind)

    def _keyword(self, i: int, word: str, kind: str):
        src, lang = self.src, self.language
        k = i + 1
        if word == "function" and src.at(k) in ("*", "&"):
            k += 1
        if lang == "Rust" and word == "const" and src.word(k) == "fn":
            return
        if lang == "Rust" and word in ("const", "static") and src.word(k) == "mut":
            k += 1
        if word == "class" and src.word(k) in ("func", "var", "struct", "class"):  # a modifier
            return
        if word == "record" and src.word(k) in ("class", "struct"):
            k += 1
        if lang == "Kotlin" and kind in ("Function", "Constant"):
            k = src.angle(k)
            while src.word(k) and src.at(k + 1) == ".":  # the receiver of an extension
                k += 2
        if word == "delegate":
            while k < src.last and src.at(k + 1) not in ("(", ";"):
                k = src.angle(k + 1) if src.at(k + 1) == "<" else k + 1
        if lang == "Scala" and word == "type" and src.at(k) == "=":
            return
        name = src.word(k)
        if not name or (word in ("class", "type") and src.at(i + 1) in (":", "=", ",", ")", ";")):
            return
        start = self._first(i)
        if kind == "Constant":
            if lang == "Php":
                return self._constants(i)
            if lang in ("Kotlin", "Swift", "Scala") and src.at(i - 1) in ("(", ","):  # a parameter
                return
            if lang in ("Swift", "Kotlin") and src.at(src.inside[i]) == "(":
                return
            return self.add(name, kind, start, self.statement(i))
        if kind == "TypeAlias" and not (lang == "Php"):
            if lang == "TypeScript" and src.at(src.angle(k + 1)) != "=":
                return
            return self.add(name, kind, start, self.statement(i))
        stops = (";",) if lang not in ("Kotlin", "Scala", "Swift") else (";", "=")
        body, end = self._bodied(k + 1, stops) if lang in ("Kotlin", "Scala", "Swift") else self.body(k + 1, stops)
        if lang in ("Java", "CSharp", "Php") and kind == "Function" and src.at(k + 1) != "(":
            return
        self.add(name, kind, start, end, body)
        if kind in _TYPE_KINDS:
            self._extends(name, k + 1, body if body >= 0 else end + 1)

    def _bodied(self, i: int, stops) -> tuple[int, int]:
        """As ``body``, where a body may be an expression after ``=`` or missing."""
        src, k = self.src, i
        line = src.tokens[i - 1].line
        while k <= src.last:
            x, t = src.at(k), src.tokens[k]
            if x == "{":
                return k, src.close(k)
            if x == "=":
                if src.at(k + 1) == "{":
                    return k + 1, src.close(k + 1)
                return -1, self.statement(k + 1)
            if x in ("(", "["):
                k = src.close(k)
                line = src.tokens[k].line
            elif x == "}" or x == ";":
                return -1, k - 1
            elif t.line > line and src.at(k - 1) not in (":", ",", "->", "extends", "with") and x not in (":", "->", "extends", "with", "where"):
                return -1, k - 1
            else:
                line = t.line
            k += 1
        return -1, src.last

    def _extends(self, name: str, i: int, end: int):
        """Names after ``extends``, ``implements``, ``with`` or a colon."""
        src, k, on = self.src, i, False
        line = src.tokens[i - 1].line if i else 0
        while k < end:
            x = src.at(k)
            if x in ("extends", "implements", "with", ":"):
                on = True
            elif x in ("(", "["):
                k = src.close(k)
            elif x == "<":
                k = max(k, src.angle(k) - 1)
            elif x in ("where", "permits"):
                return
            elif on and src.word(k) and x not in ("public", "private", "protected", "virtual") and src.at(k + 1) not in (".", "::", "\\"):
                self.bases.append((name, x, line))
            k += 1

    def _first(self, i: int) -> int:
        """The first token of the declaration: modifiers of the same statement stand before the keyword."""
        src, k = self.src, i
        while k > 0 and src.word(k - 1) in (
            "export", "default", "async", "abstract", "declare", "public", "private", "protected", "internal", "static", "final", "open", "override",
                "sealed", "pub", "unsafe",
            "extern", "virtual", "partial", "data", "inline", "suspend", "lazy", "implicit", "case", "mut", "readonly", "fileprivate", "mutating", "operator", "enum",
        ) and src.tokens[k - 1].kind == "word":
            k -= 1
        return self._annotated(k)

    def _annotated(self, k: int) -> int:
        """The first of the annotations that stand before token ``k``."""
        src = self.src
        while k > 0:
            at = src.partner[k - 1] if src.at(k - 1) in (")", "]") and src.partner[k - 1] >= 0 else k - 1
            if self.language in ("Java", "Kotlin", "Scala", "Swift") and src.word(at - (src.at(at) == "("))[:1] == "@" and src.at(k - 1) != "]":
                k = at - (src.at(at) == "(")
            elif self.language == "CSharp" and src.at(k - 1) == "]" and src.at(at - 1) in ("", "{", "}", ";", "]", ")") and src.at(at) == "[":
                k = at
            else:
                break
        return k

    def _constants(self, i: int):
        src, k, end = self.src, i + 1, self.statement(i)
        while k < end:
            if src.at(k + 1) == "=" and src.word(k):
                self.add(src.word(k), "Constant", k, end)
            k = src.close(k) + 1 if src.at(k) in ("(", "[", "{") else k + 1

    def _typescript(self, i: int, word: str) -> bool:
        src = self.src
        if word in ("const", "let", "var") and src.word(i + 1) != "enum":
            end = self.statement(i)
            k = i + 1
            while src.word(k):
                at = k + 1
                if src.at(at) == ":":  # a type, up to the value
                    while at < end and src.at(at) not in ("=", ",", ";"):
                        at = src.close(at) + 1 if src.at(at) in ("(", "[", "{") else (src.angle(at) if src.angle(at) > at else at + 1)
                last, value = at, at + 1
                while last < end and src.at(last + 1) not in (",", ";") and not (src.inside[last + 1] != src.inside[k]):
                    last = src.close(last + 1) if src.at(last + 1) in ("(", "[", "{") else last + 1
                    if last > end:
                        break
                last = min(max(last, at), end)
                if src.at(at) == "=":
                    body = self._function_value(value)
                    if body is not None:
                        self.add(src.word(k), "Function", k, last, body)
                    else:
                        self.add(src.word(k), "Constant", k, last)
                if src.at(last + 1) != ",":
                    break
                k = last + 2
            return True
        inside = src.inside[i]
        if inside >= 0 and self.bodies.get(inside) == "Class" and word not in ("if", "for", "while", "switch", "catch", "return", "function"):
            k = src.angle(i + 1)
            if src.at(k) == "(" and src.at(i - 1) not in (".", "new", "=", "=>", "@", ":", ",", "("):
                after = src.close(k) + 1
                if src.at(after) == ":":
                    after = self._past_type(after + 1)
                if src.at(after) == "{":
                    start = i
                    while src.word(start - 1) in ("async", "static", "public", "private", "protected", "get", "set", "override", "readonly",
                        "abstract") and src.inside[start - 1] == inside:
                        start -= 1
                    self.add(word, "Function", start, src.close(after), after)
                    return True
        return False

    def _past_type(self, k: int) -> int:
        src = self.src
        if src.at(k) == "{":  # an object type
            k = src.close(k) + 1
        while k < src.last and src.at(k) not in ("{", ";", "=>", "="):
            k = src.close(k) + 1 if src.at(k) in ("(", "[") else (src.angle(k) if src.angle(k) > k else k + 1)
        return k

    def _function_value(self, k: int):
        """The body's bracket (or -1) if a function expression or an arrow function begins at ``k``, else None."""
        src = self.src
        if src.word(k) == "async":
            k += 1
        if src.word(k) == "function":
            return self.body(k)[0]
        k = src.angle(k)
        if src.at(k) == "(":
            after = src.close(k) + 1
            if src.at(after) == ":":
                after = self._past_type(after + 1)
        elif src.word(k):
            after = k + 1
        else:
            return None
        if src.at(after) != "=>":
            return None
        return after + 1 if src.at(after + 1) == "{" else -1

    def _go(self, i: int, word: str):
        src = self.src
        if word == "func":
            k = i + 1
            if src.at(k) == "(":
                k = src.close(k) + 1
            name = src.word(k)
            if name:
                k = k + 1
                if src.at(k) == "[":
                    k = src.close(k) + 1
                k = src.close(k) + 1 if src.at(k) == "(" else k
                while k < src.last and src.at(k) not in ("{", ";", "func", "type", "var", "const", "}") and src.tokens[k].line == src.tokens[k - 1].line:
                    k = src.close(k) + 1 if src.at(k) in ("(", "[") or (src.at(k) == "{" and src.word(k - 1) in ("interface", "struct")) else k + 1
                body = k if src.at(k) == "{" else -1
                self.add(name, "Function", i, src.close(k) if body >= 0 else k - 1, body)
        elif word in ("type", "const", "var") and src.at(i - 1) not in (".", ":="):
            if src.at(i + 1) == "(":
                line, k, end = -1, i + 2, src.close(i + 1)
                while k < end:
                    if src.tokens[k].line > line and src.word(k):
                        self._go_spec(word, k, i)
                    line = src.tokens[k].line
                    if src.at(k) in ("(", "[", "{"):
                        k = src.close(k)
                        line = src.tokens[k].line
                    k += 1
            else:
                self._go_spec(word, i + 1, i)

    def _go_spec(self, word: str, k: int, node: int):
        src = self.src
        name = src.word(k)
        end = self.statement(k)
        if word != "type":
            while name:
                self.add(name, "Constant", k if src.at(node + 1) == "(" else node, end)
                k += 2
                name = src.word(k) if src.at(k - 1) == "," else ""
            return
        at = src.close(k + 1) + 1 if src.at(k + 1) == "[" else k + 1
        at += src.at(at) == "="
        kind = {"struct": "Class", "interface": "Interface"}.get(src.word(at), "TypeAlias")
        body = at + 1 if kind != "TypeAlias" and src.at(at + 1) == "{" else -1
        self.add(name, kind, k if src.at(node + 1) == "(" else node, src.close(body) if body >= 0 else end, body)

    def _ruby(self, i: int, word: str, kind: str | None):
        src = self.src
        if kind is None:
            if word[:1].isupper() and src.at(i + 1) == "=" and src.at(i - 1) not in (",", "(", "|"):
                self.add(word, "Constant", i, self.statement(i))
            return
        if i not in self.ruby_end:
            return
        k = i + 1
        if word == "class" and src.at(k) == "<":  # the singleton's body
            return
        while src.at(k + 1) in (".", "::"):
            k += 2 + (src.at(k + 2) == ":")
        self.add(src.word(k), kind, i, self.ruby_end[i])
        if word == "class" and src.at(k + 1) == "<" and src.word(k + 2):
            self.bases.append((src.word(k), src.word(k + 2), src.tokens[i].line))

    def _member(self, i: int, word: str):
        """Methods, constructors, properties and fields of a class body in Java and C#."""
        src, lang = self.src, self.language
        if self.scope(i) not in ("Class", "Interface") or word in NO_CALLS:
            return
        before = src.at(i - 1)
        typed = (src.word(i - 1) and src.word(i - 1) not in ("return", "new", "throw", "else", "package", "import")) or before in (">", "]", "?")
        start = i
        while start > 0 and src.inside[start - 1] == src.inside[i] and src.at(start - 1) not in ("{", "}", ";",
            ")") and (src.tokens[start - 1].kind == "word" or src.at(start - 1) in ("<", ">", ",", "[", "]", ".", "?", "@")):
            start -= 1
        start = self._annotated(start)
        k = src.angle(i + 1)
        if src.at(k) == "(":
            after = src.close(k) + 1
            owner = src.word(src.inside[i] - 1) == word or any(f[0] == word and f[4] == src.inside[i] for f in self.found)
            if not (typed or owner):
                return
            body, end = self.body(after, (";", "=>") if lang == "CSharp" else (";",))
            if src.at(end) == "=>":
                end = self.statement(end + 1)
            if src.at(after) in ("{", ";", "=>", ":", "throws", "where", "default"):
                self.add(word, "Function", start, end, body)
        elif typed and lang == "CSharp" and src.at(i + 1) == "{" and src.word(i - 1) not in KEYWORD_KINDS[lang]:
            self.add(word, "Constant", start, src.close(i + 1))
        elif typed and src.at(i + 1) in ("=", ";", ",", "=>") and src.word(i - 1) not in KEYWORD_KINDS[lang]:
            if "=" not in [src.at(x) for x in range(start, i)]:
                self.add(word, "Constant", start, self.statement(i))

    def _c(self, i: int, word: str) -> bool:
        """Functions, types, aliases and globals of C and C++."""
        src, lang = self.src, self.language
        kind = KEYWORD_KINDS[lang].get(word)
        if kind == "TypeAlias":
            if src.word(i + 1) and src.at(i + 2) == "=":
                self.add(src.word(i + 1), kind, i, self.statement(i))
            return True
        if kind:
            k = i + 1
            if word == "enum" and src.word(k) in ("class", "struct"):
                return True
            while src.word(k) == "final" or (src.word(k) and src.word(k + 1)):
                k += 1
            if src.word(k) and src.at(k + 1) in ("{", ":"):
                body, end = self.body(k + 1)
                self.add(src.word(k), kind, i, end, body)
                self._extends(src.word(k), k + 1, body if body >= 0 else end)
            return True
        if word == "typedef":
            k, end = i + 1, i + 1
            while end < src.last and src.at(end) != ";":
                end = src.close(end) + 1 if src.at(end) in ("(", "[", "{") else end + 1
            if src.word(end - 1):
                self.add(src.word(end - 1), "TypeAlias", i, end)
            return False
        if self.scope(i) not in ("", "Module"):
            return False
        if src.at(i + 1) == "(" and word not in NO_CALLS and (src.word(i - 1) or src.at(i - 1) in ("*", "&", ">", "::", "~")):
            k = src.close(i + 1) + 1
            while src.word(k) in ("const", "override", "noexcept", "final") or src.at(k) == "->":
                k += 1 + (src.at(k) == "->")
            if src.at(k) == ":":  # initialisers of a constructor
                while k < src.last and src.at(k) != "{":
                    k = src.close(k) + 1 if src.at(k) == "(" else k + 1
            if src.at(k) == "{":
                start = i
                while start > 0 and src.inside[start - 1] == src.inside[i] and src.at(start - 1) not in ("}", ";", "{",
                    ")") and src.tokens[start - 1].kind != "text" and not (
                        src.tokens[start - 1].line < src.tokens[start].line - 1) and src.at(start - 1) != "#":
                    start -= 1
                self.add(word, "Function", start, src.close(k), k)
                return True
        elif src.at(i + 1) == "=" and (src.word(i - 1) or src.at(i - 1) in ("*", "&")) and src.word(i - 1) != "using":
            self.add(word, "Constant", i, self.statement(i))
        return False


# fixed values: the words of Ruby that an ``end`` closes
_RUBY_OPEN = ("def", "class", "module", "do", "begin", "case")
_RUBY_MAYBE = ("if", "unless", "while", "until", "for")


def _ruby_ends(src: Source) -> dict[int, int]:
    out, open_ = {}, []
    loops_do = False
    for i, t in enumerate(src.tokens):
        if t.kind != "word" or src.at(i - 1) in (".", "::", ":") or (src.at(i + 1) == ":" and src.at(i + 2) != ":"):
            continue
        first = i == 0 or src.tokens[i - 1].line < t.line or src.at(i - 1) in ("=", ";", "(", "then", "else")
        if t.text in _RUBY_OPEN and not (t.text == "do" and loops_do and src.tokens[open_[-1]].line == t.line if open_ else False):
            if t.text == "def" and (end := _endless(src, i)):
                out[i] = end
                continue
            open_.append(i)
            loops_do = False
        elif t.text in _RUBY_MAYBE and first:
            open_.append(i)
            loops_do = t.text in ("while", "until", "for")
        elif t.text == "end" and open_:
            out[open_.pop()] = i
    return out


def _endless(src: Source, i: int) -> int:
    """The last token of a method that is an expression after ``=``, or 0."""
    k = i + 2
    while src.at(k) == ".":
        k += 2
    k = src.close(k) + 1 if src.at(k) == "(" else k
    if src.at(k) != "=" or src.tokens[k].line != src.tokens[i].line:
        return 0
    while k < src.last and src.tokens[k + 1].line == src.tokens[i].line:
        k += 1
    return k


# --- the others: imports and exports -----------------------------------------------------


def _string(src: Source, i: int) -> str | None:
    return src.tokens[i].text.strip("\"'`") if 0 <= i <= src.last and src.tokens[i].kind == "text" else None


def _listed(src: Source, i: int, alias: str = "as") -> list[tuple]:
    """``{a, b as c}`` -> [(a, None), (b, c)]; a leading ``type`` is skipped."""
    out, k, end = [], i + 1, src.close(i)
    while k < end:
        k += src.word(k) == "type" and src.word(k + 1) not in ("", alias)
        if src.word(k):
            named = src.word(k + 1) == alias or src.at(k + 1) == alias
            out.append((src.word(k), src.word(k + 2) if named else None))
            k += 2 * named
        k += 1
    return out


def _typescript_modules(src: Source, defs: _Definitions):
    imports, exports = [], []

    def source_after(k):
        return _string(src, k + 1) if src.word(k) == "from" else None

    for i, t in enumerate(src.tokens):
        if t.kind != "word" or src.inside[i] >= 0 and t.text == "import":
            continue
        line = t.line
        if t.text == "import" and src.at(i + 1) not in ("(", "."):
            k, names, default, namespace = i + 1, [], False, False
            if _string(src, k) is not None:
                imports.append(_named(source=_string(src, k), line=line))
                continue
            k += src.word(k) == "type" and src.at(k + 1) != "from" and (src.at(k + 1) in ("{", "*") or bool(src.word(k + 1)))
            while True:
                if src.at(k) == "{":
                    names += _listed(src, k)
                    k = src.close(k) + 1
                elif src.at(k) == "*":
                    names, namespace, k = [*names, (src.word(k + 2), None)], True, k + 3
                elif src.word(k) and src.word(k) != "from" or src.word(k) == "from" and src.word(k + 1) == "from":
                    names, default, k = [*names, (src.word(k), None)], True, k + 1
                if src.at(k) != ",":
                    break
                k += 1
            if (source := source_after(k)) is not None:
                imports.append(_named(*names, source=source, line=line, default=default, namespace=namespace))
        elif t.text == "export" and src.at(i - 1) not in (".", "?."):
            k = i + 1
            add = lambda name, default=False, source=None: exports.append(
                {"name": name, "is_default": default, "is_reexport": source is not None, "source": source, "line": line})
            k += src.word(k) == "type" and src.at(k + 1) in ("{", "*")
            if src.at(k) == "*":
                named = src.word(k + 1) == "as"
                source = source_after(k + 3 if named else k + 1)
                add(src.word(k + 2) if named else "*", source=source)
            elif src.at(k) == "{":
                source = source_after(src.close(k) + 1)
                for name, alias in _listed(src, k):
                    add(alias or name, default=(alias or name) == "default", source=source)
            elif src.word(k) == "default":
                k += 1
                while src.word(k) in ("async", "abstract"):
                    k += 1
                if src.word(k) in ("function", "class"):
                    k += 1 + (src.at(k + 1) == "*")
                    add(src.word(k) if src.word(k) != "extends" and src.word(k) else "default", default=True)
                elif src.word(k) and src.at(k + 1) in (";", "") or src.word(k) and src.tokens[min(k + 1, src.last)].line > src.tokens[k].line:
                    add(src.word(k), default=True)
                else:
                    add("default", default=True)
            else:
                while src.word(k) in ("async", "abstract", "declare"):
                    k += 1
                if src.word(k) in ("function", "class", "interface", "type", "enum"):
                    k += 1 + (src.at(k + 1) == "*")
                    if src.word(k):
                        add(src.word(k))
                elif src.word(k) in ("const", "let", "var"):
                    end = defs.statement(k)
                    for name, _, start, _, _ in defs.found:
                        if k < start <= end and src.inside[start] == src.inside[k]:
                            add(name)
    # a name of one line once, a re-export before others
    best: dict = {}
    for e in exports:
        key = (e["name"], e["line"])
        if key not in best or (e["is_reexport"] and not best[key]["is_reexport"]):
            best[key] = e
    return imports, list(best.values())


def _go_modules(src: Source):
    out = []

    def spec(k):
        source = _string(src, k)
        line = src.tokens[k].line
        name = source.rsplit("/", 1)[-1]
        before = src.tokens[k - 1]
        mark = before.text if before.line == line and before.text not in ("import", "(", ";") else None
        if mark == "_":
            out.append(_named(source=source, line=line))
        elif mark == ".":
            out.append(_named(("*", None), source=source, line=line))
        else:
            out.append(_named((name, mark), source=source, line=line, namespace=True))

    for i, t in enumerate(src.tokens):
        if t.text == "import" and t.kind == "word" and src.inside[i] < 0:
            if src.at(i + 1) == "(":
                for k in range(i + 2, src.close(i + 1)):
                    if _string(src, k) is not None:
                        spec(k)
            else:
                k = i + 1 if _string(src, i + 1) is not None else i + 2
                if _string(src, k) is not None:
                    spec(k)
    return out


def _rust_modules(src: Source):
    out = []

    def tree(k, end, prefix, names, line):
        """Paths within ``k..end``: names of one list under ``prefix``; nested lists are imports of their own."""
        while k < end:
            path = []
            while k < end and (src.word(k) or src.at(k) == "::"):
                if src.word(k) == "as":
                    break
                if src.word(k):
                    path.append(src.word(k))
                k += 1
            if src.at(k) == "{":
                inner: list = []
                tree(k + 1, src.close(k), prefix + path, inner, line)
                if inner:
                    out.append(_named(*inner, source="::".join(prefix + path), line=line))
                k = src.close(k) + 1
            elif src.at(k) == "*":
                if names is None:
                    out.append(_named((path[-1] if path else "*", None), source="::".join(prefix + path), line=line, namespace=True))
                else:
                    names.append(("*", None))
                k += 1
            elif path:
                alias = src.word(k + 1) if src.word(k) == "as" else None
                k += 2 * (alias is not None)
                if names is None:
                    out.append(_named((path[-1], alias), source="::".join(prefix + path), line=line, namespace=True))
                elif len(path) > 1:
                    out.append(_named((path[-1], alias), source="::".join(prefix + path[:-1]), line=line))
                else:
                    names.append((path[-1], alias))
            while k < end and src.at(k) == ",":
                k += 1
            if k < end and not src.word(k) and src.at(k) not in ("{", "*", "::"):
                k += 1

    for i, t in enumerate(src.tokens):
        if t.text == "use" and t.kind == "word" and src.at(i - 1) in ("", ";", "}", "{", "pub", ")", "]"):
            end = i + 1
            while end <= src.last and src.at(end) != ";":
                end = src.close(end) + 1 if src.at(end) == "{" else end + 1
            tree(i + 1, end, [], None, t.line)
    return out


def _dotted(src: Source, k: int, joint=(".",)) -> tuple[list[str], int]:
    """The words of a path from ``k`` on, and the place behind it."""
    parts = []
    while src.word(k) and src.word(k) not in ("as",):
        parts.append(src.word(k))
        if src.at(k + 1) not in joint or src.tokens[k + 1].line > src.tokens[k].line:
            return parts, k + 1
        k += 2
    return parts, k


def _dotted_modules(src: Source, language: str):
    """Java, Kotlin, Scala, Swift and C#."""
    out = []
    keyword = "using" if language == "CSharp" else "import"
    for i, t in enumerate(src.tokens):
        if t.text != keyword or t.kind != "word" or src.at(i - 1) in (".", "?."):
            continue
        k, line = i + 1, t.line
        if language == "CSharp":
            if src.at(k) == "(" or src.word(k) == "var" or src.word(k) and src.at(k + 1) == "=":
                continue
            k += src.word(k) == "static"
            parts, k = _dotted(src, k)
            if parts and src.at(k) == ";":
                out.append(_named(("*", None), source=".".join(parts), line=line, namespace=True))
            continue
        k += language == "Java" and src.word(k) == "static"
        if language == "Swift":
            k += src.word(k) in ("class", "struct", "enum", "func", "protocol", "typealias", "let", "var") and bool(src.word(k + 1))
            parts, _ = _dotted(src, k)
            if parts:
                out.append(_named((parts[-1], None), source=".".join(parts), line=line, namespace=True))
            continue
        while True:
            parts, k = _dotted(src, k)
            star = src.at(k) in ("*", "_") or (parts and parts[-1] == "_")
            if parts and parts[-1] == "_":
                parts = parts[:-1]
            if star and parts:
                out.append(_named(("*", None), source=".".join(parts), line=line, namespace=True))
                k += src.at(k) == "*"
            elif src.at(k) == "{" and parts:
                names = _listed(src, k, "=>") if language == "Scala" else _listed(src, k)
                out.append(_named(*[(n, a) for n, a in names], source=".".join(parts), line=line))
                k = src.close(k) + 1
            elif parts:
                alias = src.word(k + 1) if src.word(k) == "as" else None
                out.append(_named((parts[-1], alias), source=".".join(parts[:-1]) or parts[-1], line=line))
                k += 2 * (alias is not None)
            if language != "Scala" or src.at(k) != "," or not parts:
                break
            k += 1
    return out


def _php_modules(src: Source, defs: _Definitions):
    out = []
    for i, t in enumerate(src.tokens):
        if t.kind != "word":
            continue
        if t.text == "use" and defs.scope(i) not in _TYPE_KINDS and src.at(i - 1) not in (")", "->", "::") and src.at(i + 1) != "(":
            k = i + 1
            k += src.word(k) in ("function", "const")
            while k < src.last:
                k += src.at(k) == "\\"
                parts, k = _dotted(src, k, ("\\",))
                if src.at(k) == "{":
                    for name, alias in _listed(src, k):
                        out.append(_named((name, alias), source="\\".join([*parts, name]), line=t.line))
                    break
                if not parts:
                    break
                alias = src.word(k + 1) if src.word(k) == "as" else None
                out.append(_named((parts[-1], alias), source="\\".join(parts), line=t.line))
                k += 2 * (alias is not None)
                if src.at(k) != ",":
                    break
                k += 1
        elif t.text in ("require", "require_once", "include", "include_once") and src.at(i - 1) not in ("->", "::"):
            k = i + 1 + (src.at(i + 1) == "(")
            if _string(src, k) is not None:
                out.append(_named(source=_string(src, k), line=t.line))
    return out


def _ruby_modules(src: Source):
    out = []
    for i, t in enumerate(src.tokens):
        if t.kind != "word" or src.at(i - 1) == ".":
            continue
        k = i + 1 + (src.at(i + 1) == "(")
        if t.text in ("require", "require_relative") and _string(src, k) is not None:
            out.append(_named(source=_string(src, k), line=t.line))
        elif t.text in ("include", "extend") and src.word(k)[:1].isupper() and src.tokens[k].line == t.line:
            parts = [src.word(k)]
            while src.at(k + 1) == "::" and src.word(k + 2):
                k += 2
                parts.append(src.word(k))
            out.append(_named((parts[-1], None), source="::".join(parts), line=t.line))
    return out


_INCLUDE = re.compile(r"^[ \t]*#[ \t]*include[ \t]*[<\"]([^>\"\n]+)[>\"]", re.M)


def _c_modules(src: Source):
    out = []
    for m in _INCLUDE.finditer(src.text):
        name = re.sub(r"(\.h|\.hpp|\.hxx)+$", "", m[1].rsplit("/", 1)[-1])
        out.append(_named((name, None), source=m[1], line=src.text.count("\n", 0, m.start(1)) + 1, namespace=True))
    return out


def _modules(src: Source, language: str, defs: _Definitions) -> tuple[list, list]:
    if language == "TypeScript":
        return _typescript_modules(src, defs)
    if language == "Go":
        public = [{"name": n, "is_default": False, "is_reexport": False, "source": None, "line": src.tokens[s].line} for n, _, s, _, _ in defs.found if n[:1].isupper()]
        return _go_modules(src), public
    read = {"Rust": _rust_modules, "Ruby": _ruby_modules, "C": _c_modules, "Cpp": _c_modules}.get(language)
    if language == "Php":
        return _php_modules(src, defs), []
    return (read(src) if read else _dotted_modules(src, language)), []


# --- the others: calls ----------------------------------------------------------------


def _chain_start(src: Source, i: int, joints) -> int:
    """The first token of the expression that ends with the word at ``i``."""
    k = i
    while k > 0 and src.at(k - 1) in joints:
        k -= 2
        while k > 0 and src.at(k) in (")", "]") and src.partner[k] >= 0:
            k = src.partner[k]
            if src.word(k - 1) and src.word(k - 1) not in NO_CALLS or src.at(k - 1) in (")", "]"):
                k -= 1
            elif src.at(k) == "(":
                break
    return max(k, 0)


def _calls(src: Source, language: str, defs: _Definitions) -> tuple[list, list]:
    sites, assigned = [], []
    functions = sorted(((s, e, n) for n, k, s, e, _ in defs.found if k == "Function"), key=lambda x: x[0])
    heads = set()  # names that are defined, not called
    for name, kind, s, e, body in defs.found:
        if kind != "Constant":
            heads.update(k for k in range(s, min(s + 60, e + 1, body if body >= 0 else e + 1)) if src.word(k) == name)
    joints = (".", "?.", "::", "->") if language != "Scala" else (".",)
    open_: list = []
    at = 0
    for i, t in enumerate(src.tokens):
        while at < len(functions) and functions[at][0] <= i:
            open_.append(functions[at])
            at += 1
        while open_ and open_[-1][1] < i:
            open_.pop()
        if t.kind != "word" or i in heads:
            continue
        k = i + 1
        if language in ("TypeScript", "Rust", "Java", "CSharp", "Kotlin", "Scala", "Swift", "Cpp"):
            k += language == "Rust" and src.at(k) == "::" and src.at(k + 1) == "<"
            k = src.angle(k)
        k += language == "TypeScript" and src.at(k) == "?." and src.at(k + 1) == "("
        bare = language == "Ruby" and src.at(k) != "(" and _ruby_command(src, i)
        if not bare and (src.at(k) != "(" or (language in ("Kotlin", "Swift", "Scala", "Ruby") and src.tokens[k].line > t.line)):
            continue
        if language == "Rust" and src.at(i + 1) == "!":
            continue
        start = _chain_start(src, i, joints)
        dotted = start < i
        new = src.word(start - 1) == "new"
        if (t.text in NO_CALLS and not dotted and not (language == "TypeScript" and t.text in ("super", "import"))) or (new and language not in NEW_CALLS):
            continue
        if src.word(start - 1) in ("function", "fn", "func", "def", "fun", "class"):
            continue
        held_by = defs.scope(start)
        if language == "TypeScript" and (held_by == "Interface" or held_by == "Class" and (src.at(start - 1) in ("{", ";", "}") or src.word(start - 1)) and not dotted):
            continue
        if (language in ("Rust", "Go") and held_by in ("Class", "Interface")) or (language == "Kotlin" and src.at(start - 1) in (":",
            ",") and not dotted and held_by != "block" and src.inside[start] < 0):
            continue
        if t.text[:1] == "@" and language != "TypeScript" and language != "Ruby":
            continue
        # the grammars of C and C++ name no function that holds a call
        owner = next((n for s, e, n in reversed(open_) if e >= i), None) if language not in ("C", "Cpp") else None
        callee = "".join(src.slice(start, i + 1).split()).lstrip("@") if language in WHOLE_CALLEE else t.text.lstrip("$")
        if bare:
            end = i + 1
            while end < src.last and src.tokens[end + 1].line == t.line and src.at(end + 1) not in ("do", "if", "unless", "}", "end", "|", "{"):
                end += 1
            arguments = [" ".join(a.split()) for a in src.slice(i + 1, end + 1).split(",")]
        else:
            arguments = src.arguments(k)
        sites.append({"callee": callee, "line": src.tokens[start].line, "containing_function": owner, "arguments": arguments})
        first = start - 1 if new else start
        first -= language == "TypeScript" and src.word(first - 1) == "await"
        if src.at(first - 1) in ("=", ":="):
            v = first - 2
            if src.at(v - 1) == ":" or (src.word(v) and src.at(v - 1) in (":", "<")):  # a declared type between name and value
                while v > 0 and src.at(v) != ":" and src.tokens[v].line == src.tokens[first - 2].line:
                    v -= 1
                v -= 1
            if language == "Go" and src.at(first - 1) == ":=":
                names = [v]
                while src.at(names[-1] - 1) == "," and src.word(names[-1] - 2):
                    names.append(names[-1] - 2)
                assigned += [{"variable": src.word(x), "callee": callee, "line": src.tokens[x].line, "containing_function": owner} for x in names[::-1] if src.word(x)]
            elif src.word(v) and src.at(v - 1) not in (".", "->", "::", ",") and not (language in ("Java", "CSharp") and held_by in _TYPE_KINDS):
                declared = src.at(first - 1) == ":=" or language in ("Ruby", "Php") or _declared(src, v, language)
                if declared:
                    assigned.append({"variable": src.word(v).lstrip("$@"), "callee": callee, "line": src.tokens[v].line, "containing_function": owner})
    return sites, assigned


def _declared(src: Source, v: int, language: str) -> bool:
    """Whether the word at ``v`` is declared there: behind a keyword, or a type in languages that put one first."""
    before = src.word(v - 1)
    if before in ("const", "let", "var", "val", "auto", "mut", "final"):
        return True
    return language in ("Java", "CSharp", "C", "Cpp") and (bool(before) and before not in NO_CALLS or src.at(v - 1) in (">", "]", "*", "&"))


def _ruby_command(src: Source, i: int) -> bool:
    """A call without brackets: a name at the start of a line (or behind a dot) with a string or symbol after it."""
    t = src.tokens[i]
    if i >= src.last or src.tokens[i + 1].line > t.line or t.text in NO_CALLS or t.text in _RUBY_OPEN or t.text in ("end", "then", "rescue", "ensure",
        "module", "include", "extend"):
        return False
    first = i == 0 or src.tokens[i - 1].line < t.line or src.at(i - 1) == "."
    nxt = src.tokens[i + 1]
    return first and (nxt.kind == "text" or (nxt.text == ":" and src.word(i + 2) != "" and src.tokens[i + 2].start == nxt.end))


# --- files -----------------------------------------------------------------------------


LIKE = {"JavaScript": "TypeScript"}


def parse_tokens(path: str, language: str, source: str) -> dict:
    out = _empty(path, language, "tokens")
    kind = LIKE.get(language, language)
    src = Source(source, kind)
    defs = _Definitions(src, kind)
    out["definitions"] = [
        {"name": n, "kind": k, "start_line": src.tokens[s].line, "end_line": src.tokens[e].line + src.tokens[e].text.count("\n")} for n, k, s, e,
            _ in sorted(defs.found, key=lambda f: f[2])
    ]
    out["imports"], out["exports"] = _modules(src, kind, defs)
    out["call_sites"], out["assignments"] = _calls(src, kind, defs)
    out["bases"] = [{"type": t, "base": b, "line": n} for t, b, n in defs.bases]
    return out


def parse_one(path: str, language: str, source: str | None) -> dict:
    if source is None:
        return _empty(path, language, "none", "no source")
    if language == "Python":
        return parse_python(path, source)
    return parse_tokens(path, language, source) if LIKE.get(language, language) in KEYWORD_KINDS else _empty(path, language, "none")


def parse(files: DataFrame) -> DataFrame:
    """``files(path, source)`` -> one row of nested facts a file."""

    def run(frames):
        for f in frames:
            yield pd.DataFrame([parse_one(*row) for row in zip(f["path"], f["language"], f["source"])], columns=list(COLUMNS))

    return files.select("path", paths.language("path").alias("language"), F.col("source")).mapInPandas(run, SCHEMA)


def data_flow_tables(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The assignments and calls of parsed files as ``operators.graph.data_flow`` takes them."""
    a = parsed.select(F.col("path").alias("file"), F.inline("assignments")).select("file", F.col("containing_function").alias("scope"), "variable", "callee")
    c = parsed.select(F.col("path").alias("file"), F.inline("call_sites")).select("file", F.col("containing_function").alias("scope"), "callee", "arguments", "line")
    return a, c


def symbols(parsed: DataFrame) -> DataFrame:
    """Definitions as rows, by kind: functions, types, constants."""
    d = parsed.select("path", F.posexplode("definitions").alias("pos", "d")).select("path", "pos", "d.*")
    return d.withColumn("family", F.when(F.col("kind").isin("Function"), "function").when(F.col("kind") == "Constant",
        "constant").otherwise("type")).withColumn("lines", F.greatest(F.col("end_line") - F.col("start_line"), F.lit(0)) + 1)


def outline(parsed: DataFrame) -> DataFrame:
    """Symbols in the order of a file."""
    return symbols(parsed).orderBy("path", "start_line", "pos")
