"""Tokens of source text, for languages that are read without a grammar."""

from __future__ import annotations

import re
from typing import NamedTuple

_WORD = r"[A-Za-z_$@\u0080-￿][\w$]*"
_NUMBER = r"\d[\w.]*"
_OPERATOR = r"=>|->|<-|::|\?\.|:=|\.\.\.|==|!=|<=|>=|&&|\|\||[-+*/%&|^!=<>?:;,.~#\\()\[\]{}@$]"
_TEXT = {
    '"': r'"(?:\\.|[^"\\\n])*"?', "'": r"'(?:\\.|[^'\\\n])*'?", "`": r"`(?:\\.|[^`\\])*`?", '"""': r'"""(?s:.*?)(?:"""|\Z)',
    # a character, and not the mark of a lifetime or a symbol
    "char": r"'(?:\\[^\n]{1,10}?|[^'\\\n])'",
    "raw": r'r#*"(?s:.*?)"#*',
}
_SLASHES, _HASH = r"//[^\n]*|/\*(?s:.*?)(?:\*/|\Z)", r"\#[^\n]*"
# how each language writes comments and strings, tried in this order
_RULES = {
    "TypeScript": (_SLASHES, ('"', "'", "`")), "Go": (_SLASHES, ("`", '"', "char")), "Rust": (_SLASHES, ("raw", '"', "char")),
    "Java": (_SLASHES, ('"""', '"', "char")), "CSharp": (_SLASHES, ('"""', '"', "char")), "Php": (_SLASHES + r"|\#(?!\[)[^\n]*|<\?php|<\?=?|\?>", ('"', "'")),
    "Ruby": (_HASH + r"|^=begin(?s:.*?)^=end", ('"', "'")), "Kotlin": (_SLASHES, ('"""', '"', "char")), "Swift": (_SLASHES, ('"""', '"')),
    "Scala": (_SLASHES, ('"""', '"', "char")), "C": (_SLASHES, ('"', "char")), "Cpp": (_SLASHES, ('"', "char")),
}
_PAIRS = {"(": ")", "[": "]", "{": "}"}
_BEFORE_REGEX = frozenset("( , = : [ ! & | ? { } ; => && || return typeof case".split())


class Token(NamedTuple):
    kind: str  # word, text, number, op
    text: str
    start: int
    end: int
    line: int


class Source:
    """The tokens of a text, the partner of each bracket, and the bracket each token lies in."""

    def __init__(self, text: str, language: str):
        self.text = text
        self.tokens = list(_tokens(text, language))
        n = len(self.tokens)
        self.partner, self.inside = [-1] * n, [-1] * n
        open_: list[int] = []
        for i, t in enumerate(self.tokens):
            if t.kind == "op" and t.text in ")]}":
                # brackets that don't match are left alone; a closing brace ends what stands open within it
                at = next((k for k in range(len(open_) - 1, -1, -1) if _PAIRS[self.tokens[open_[k]].text] == t.text), None)
                if at is not None and (at == len(open_) - 1 or t.text == "}"):
                    self.partner[open_[at]], self.partner[i] = i, open_[at]
                    del open_[at:]
            self.inside[i] = open_[-1] if open_ else -1
            if t.kind == "op" and t.text in _PAIRS:
                open_.append(i)
        self.last = n - 1

    def __len__(self) -> int:
        return len(self.tokens)

    def word(self, i: int) -> str:
        """The text at ``i`` if it is a word, else nothing."""
        return self.tokens[i].text if 0 <= i <= self.last and self.tokens[i].kind == "word" else ""

    def at(self, i: int) -> str:
        """The text at ``i``, strings aside."""
        return self.tokens[i].text if 0 <= i <= self.last and self.tokens[i].kind != "text" else ""

    def close(self, i: int) -> int:
        """The partner of the bracket at ``i``, or the last token."""
        return self.partner[i] if self.partner[i] >= 0 else self.last

    def slice(self, i: int, j: int) -> str:
        """The text from token ``i`` up to and without ``j``."""
        return self.text[self.tokens[i].start:self.tokens[j - 1].end] if j > i else ""

    def angle(self, i: int) -> int:
        """The place after ``<..>`` that opens at ``i``, or ``i`` if it is none."""
        if self.at(i) != "<":
            return i
        depth, k = 0, i
        while k <= self.last and k < i + 200:
            x = self.at(k)
            if x in ("(", "[", "{"):
                k = self.close(k)
            elif x == "<":
                depth += 1
            elif x == ">":
                depth -= 1
                if not depth:
                    return k + 1
            elif x in (";", "&&", "||") or x == ")":
                return i
            k += 1
        return i

    def arguments(self, i: int) -> list[str]:
        """Texts of what commas part within the bracket at ``i``."""
        out, start, k, end = [], i + 1, i + 1, self.close(i)
        while k < end:
            if self.tokens[k].kind == "op" and self.tokens[k].text in _PAIRS:
                k = self.close(k)
            elif self.tokens[k].kind == "op" and self.tokens[k].text == ",":
                out.append(self.slice(start, k))
                start = k + 1
            k += 1
        out.append(self.slice(start, end))
        return [" ".join(a.split()) for a in out if a.strip()]


_patterns: dict[str, re.Pattern] = {}


def _pattern(language: str) -> re.Pattern:
    if language not in _patterns:
        comment, kinds = _RULES[language]
        word = _WORD[:-len(r"[\w$]*")] + r"[\w$]*[?!]?(?!=)|" + _WORD if language == "Ruby" else _WORD
        texts = "|".join(_TEXT[k] for k in kinds)
        _patterns[language] = re.compile(rf"(?P<skip>{comment}|\s+)|(?P<text>{texts})|(?P<word>{word})|(?P<number>{_NUMBER})|(?P<op>{_OPERATOR})|(?P<other>.)", re.M)
    return _patterns[language]


_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*")


def _tokens(text: str, language: str):
    pattern, i, line, before = _pattern(language), 0, 1, ""
    while i < len(text):
        if language == "TypeScript" and text[i] == "/" and (not before or before in _BEFORE_REGEX) and (m := _REGEX.match(text, i)):
            kind = "text"
        else:
            m = pattern.match(text, i)
            kind = m.lastgroup
        if kind in ("text", "word", "number", "op"):
            yield Token(kind, m[0], i, m.end(), line)
            before = m[0]
        line += m[0].count("\n")
        i = m.end()
