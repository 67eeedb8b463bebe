"""A tokenizer for JavaScript, TypeScript and Go, and cursor helpers over its tokens."""

from __future__ import annotations

import re
from dataclasses import dataclass

_JS = re.compile(
    r"(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<str>\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)|(?P<tmpl>`(?:\\.|[^`\\])*`?)"
    r"|(?P<num>\d[\w.]*)|(?P<id>[A-Za-z_$][\w$]*)|(?P<op>=>|===|!==|==|!=|<=|>=|\+\+|--|\+=|-=|\*=|/=|%=|\*\*=|&&=|\|\|=|\?\?=|&&|\|\||\?\?|\?\.|\.\.\.|.)",
    re.S,
)
_GO = re.compile(
    r"(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<str>\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])+')|(?P<tmpl>`[^`]*`?)"
    r"|(?P<num>\d[\w.]*)|(?P<id>[^\W\d]\w*)|(?P<op>:=|==|!=|<=|>=|\+\+|--|\+=|-=|\*=|/=|%=|&&|\|\||<-|\.\.\.|.)",
    re.S,
)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
#: After one of these a slash begins a regular expression.
_BEFORE_REGEX = set("(,=:[!&|?{};+-*%<>~^") | {"=>", "==", "===", "!=", "!==", "&&", "||", "??", "return", "typeof", "case", "in", "of"}
CLOSING = {"(": ")", "[": "]", "{": "}"}


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    line: int
    start: int
    end: int


class Tokens:
    """Tokens without space and comments. docs holds, for each token, the comments right before it; match the partner of
    each bracket (the last token if it has none)."""

    def __init__(self, source: str, go: bool = False):
        self.source, self.items, self.docs = source, [], {}
        pattern, at, line, comments = (_GO if go else _JS), 0, 1, []
        while at < len(source):
            m = pattern.match(source, at)
            kind, text = m.lastgroup, m.group()
            if not go and text == "/" and (not self.items or self.items[-1].text in _BEFORE_REGEX):
                r = _REGEX.match(source, at)
                if r:
                    kind, text = "regex", r.group()
            if kind == "comment":
                comments.append(text.strip())
            elif kind != "space":
                if comments:
                    self.docs[len(self.items)] = comments
                    comments = []
                self.items.append(Token(kind, text, line, at, at + len(text)))
            line += text.count("\n")
            at += len(text)
        self.match, stack = {}, []
        for i, t in enumerate(self.items):
            if t.kind != "op":
                continue
            if t.text in CLOSING:
                stack.append(i)
            elif t.text in (")", "]", "}"):
                while stack:
                    j = stack.pop()
                    self.match[j] = i
                    if CLOSING[self.items[j].text] == t.text:
                        break
        for j in stack:
            self.match[j] = len(self.items) - 1
        self.opened = {j: i for i, j in self.match.items()}

    def __len__(self) -> int:
        return len(self.items)

    def text(self, i: int) -> str:
        return self.items[i].text if 0 <= i < len(self.items) else ""

    def kind(self, i: int) -> str:
        return self.items[i].kind if 0 <= i < len(self.items) else ""

    def span(self, i: int, j: int) -> str:
        """Source text of tokens i to j - 1."""
        return self.source[self.items[i].start : self.items[j - 1].end] if j > i else ""

    def split(self, i: int, j: int) -> list[tuple[int, int]]:
        """Token ranges between the commas of i to j - 1, outside nested brackets."""
        out, begin, k = [], i, i
        while k < j:
            if self.text(k) == "," and self.kind(k) == "op":
                out.append((begin, k))
                begin = k + 1
            k = self.match[k] + 1 if k in self.match else k + 1
        return out + [(begin, j)] if j > begin else out

    def literal(self, i: int) -> str | None:
        """The text of a string or template token without its quotes."""
        return self.text(i).strip("'\"`") if self.kind(i) in ("str", "tmpl") else None

    def doc(self, i: int, wrappers: frozenset[str]) -> str:
        """Comments before token i or before the wrapper keywords that precede it, without comment marks."""
        while i not in self.docs and self.text(i - 1) in wrappers:
            i -= 1
        text = "\n".join(self.docs.get(i, []))
        text = re.sub(r"^/\*\*?|\*/$", "", text)
        text = re.sub(r"(?m)^\s*\*(?!/)\s?|\*/", "", text)
        return re.sub(r"(?m)^\s*//\s?", "", text).strip()
