"""Facts of Go sources (X14, X15, X18, X25 to X28), by a scan over tokens."""

from __future__ import annotations

from codeloom.extract.emit import MODULE, Emitter
from codeloom.extract.tokens import Tokens

KEYWORDS = frozenset("if for switch select func return go defer range case type struct interface map chan var const import package else".split())
ASSIGN = frozenset("= += -= *= /= %= ++ --".split())
NONE: frozenset[str] = frozenset()


def imports(t: Tokens) -> list[tuple[str, str]]:
    """(alias, path) of imports, alone and in blocks: a path may have a name, a dot or an underscore before it."""
    out, i = [], 0
    while i < len(t):
        if t.text(i) != "import":
            i = t.match.get(i, i) + 1
            continue
        block = i + 1 in t.match
        at, end, alias = (i + 2, t.match[i + 1], "") if block else (i + 1, i + 3, "")
        while at < end:
            if t.kind(at) in ("str", "tmpl"):
                path = t.literal(at)
                out.append((alias or path.rpartition("/")[2], path))
                alias, end = "", end if block else at
            elif t.kind(at) == "id" or t.text(at) == ".":
                alias = t.text(at)
            at += 1
        i = end + 1
    return out


def within(name: str, head: str, tail: str) -> str:
    """What stands between head and tail in a name; '' if the name is not made so."""
    return name[len(head) : len(name) - len(tail)] if name.startswith(head) and name.endswith(tail) else ""


def path_of(url: str) -> str:
    """The path of a literal URL with or without its host; '' if it has none but the root."""
    _, scheme, rest = url.partition("://")
    path = "/" + rest.partition("/")[2] if scheme else url
    return path if path[:1] == "/" and len(path) > 1 else ""


class _Scan:
    def __init__(self, e: Emitter, t: Tokens):
        self.e, self.t = e, t

    def top(self) -> None:
        t, i = self.t, 0
        while i < len(t):
            word = t.text(i)
            if word == "func":
                i = self.func(i)
            elif word == "type":
                i = self.types(i)
            else:
                i = t.match.get(i, i) + 1 if t.text(i) in ("(", "{") else i + 1

    def types(self, i: int) -> int:
        t = self.t
        if t.text(i + 1) == "(" and i + 1 in t.match:
            j, end = i + 2, t.match[i + 1]
            while j < end:
                if t.kind(j) == "id":
                    self.e.define(t.text(j), "class", t.items[j].line, t.doc(j, NONE) or t.doc(i, NONE))
                    line = t.items[j].line
                    while j < end and t.items[j].line == line:
                        j = t.match.get(j, j) + 1
                else:
                    j += 1
            return end + 1
        if t.kind(i + 1) != "id":
            return i + 1
        self.e.define(t.text(i + 1), "class", t.items[i + 1].line, t.doc(i, NONE))
        j = i + 2
        while j < len(t) and t.items[j].line == t.items[i].line and t.text(j) != "{":
            j += 1
        return t.match.get(j, j) + 1 if t.text(j) == "{" else j

    def receiver(self, paren: int) -> str | None:
        names = [self.t.text(k) for k in range(paren + 1, self.t.match[paren]) if self.t.kind(k) == "id"]
        return names[1] if len(names) > 1 else names[0] if names else None

    def func(self, i: int) -> int:
        t, e, at = self.t, self.e, i + 1
        owner = None
        if t.text(at) == "(" and at in t.match:
            owner = self.receiver(at)
            at = t.match[at] + 1
        if t.kind(at) != "id":
            return at
        name, paren = t.text(at), at + 1
        while paren < len(t) and t.text(paren) != "(":
            paren = t.match.get(paren, paren) + 1
        if paren not in t.match:
            return paren
        if owner:
            if e.id_of(owner) not in e.seen:
                e.define(owner, "class", t.items[i].line)
            e.enter(owner)
        id_ = e.define(name, "function", t.items[i].line, t.doc(i, NONE))
        for a, b in t.split(paren + 1, t.match[paren]):
            if b > a and t.kind(a) == "id":
                e.variable(id_, t.text(a), t.items[a].line, "PASSES_ARG")
        j = t.match[paren] + 1
        while j < len(t) and t.text(j) != "{":
            if t.text(j) in ("func", "type") or t.items[j].line > t.items[j - 1].line:
                break
            j = t.match.get(j, j) + 1 if t.text(j) == "(" else j + 1
        end = j
        if t.text(j) == "{" and j in t.match:
            e.enter(name)
            self.walk(j + 1, t.match[j])
            e.leave()
            end = t.match[j] + 1
        if owner:
            e.leave()
        return max(end, paren + 1)

    def walk(self, i: int, end: int) -> None:
        t, e = self.t, self.e
        while i < end:
            word = t.text(i)
            if t.kind(i) != "id" or t.text(i - 1) == ".":
                i += 1
            elif word == "var" and t.kind(i + 1) == "id":
                e.variable(e.scope_id(), t.text(i + 1), t.items[i + 1].line)
                i += 2
            elif word == "return":
                self.ret(i, end)
                i += 1
            elif word in KEYWORDS:
                i += 1
            else:
                i = self.names(i, end)

    def names(self, i: int, end: int) -> int:
        """A comma list of names before := or =, or a single expression."""
        t, e = self.t, self.e
        names, j = [i], i + 1
        while t.text(j) == "," and t.kind(j + 1) == "id":
            names.append(j + 1)
            j += 2
        scope = e.scope_id()
        if t.text(j) == ":=":
            for k in names:
                if t.text(k) != "_":
                    e.variable(scope, t.text(k), t.items[k].line)
            self.bind([t.text(k) for k in names], j + 1)
            return j + 1
        if t.text(j) in ASSIGN and (len(names) > 1 or j == i + 1):
            for k in names:
                if v := e.local(t.text(k)):
                    e.edge(scope, v, "MUTATES", "Lflow")
                    e.edge(scope, v, "USES", "Lflow")
            return j + 1
        return self.reference(i, end)

    def bind(self, names: list[str], v: int) -> None:
        """What := gives its names: service clients and concrete types."""
        t, e = self.t, self.e
        service = within(t.text(v + 2), "New", "Client") if t.text(v + 1) == "." and t.text(v + 3) == "(" else ""
        for name in names:
            if service:
                e.add("client_var", name, service)
            elif t.text(v) == "new" and t.text(v + 1) == "(":
                e.add("go_type_var", name, t.span(v + 2, t.match[v + 1]))
            elif t.text(v) == "&" and t.kind(v + 1) == "id":
                last = v + 1
                while t.text(last + 1) == "." and t.kind(last + 2) == "id":
                    last += 2
                if t.text(last + 1) == "{":
                    e.add("go_type_var", name, t.span(v + 1, last + 1))

    def ret(self, i: int, end: int) -> None:
        t, e, line, first = self.t, self.e, self.t.items[i].line, None
        j = i + 1
        while j < end and t.items[j].line == line and first is None:
            if t.kind(j) == "id" and t.text(j - 1) != ".":
                first = e.local(t.text(j))
            j += 1
        e.returns(line, first)

    def reference(self, i: int, end: int) -> int:
        t, e = self.t, self.e
        if v := e.local(t.text(i)):
            e.edge(e.scope_id(), v, "USES", "Lflow")
        j = i + 1
        while True:
            while t.text(j) == "." and t.kind(j + 1) == "id":
                j += 2
            if t.text(j) != "(" or j not in t.match:
                break
            self.call(i, j)
            self.walk(j + 1, t.match[j])
            j = t.match[j] + 1
            if t.text(j) != ".":
                break
        return j

    def call(self, i: int, paren: int) -> None:
        """A call whose callee is the tokens from i to its parenthesis."""
        t, e = self.t, self.e
        scope, spelled = e.scope_id(), t.span(i, paren)
        args = t.split(paren + 1, t.match[paren])
        owner, name = t.text(i), t.text(i + 2) if t.text(i + 1) == "." else ""
        if name and paren == i + 3:
            e.add("attr_call", scope, owner, name)
            if (service := within(name, "Register", "Server")) and len(args) > 1:
                e.add("go_register", service, t.span(*args[1]).strip("& "), scope)
            if owner == "http" and args:
                self.net_http(name, args, scope)
        elif name and t.text(i + 3) == "(" and paren == t.match.get(i + 3, -1) + 3 and (service := within(name, "New", "Client")):
            method = t.text(paren - 1)  # on the client that the call before made
            e.add("rpc_call", scope, service, method)
            spelled = f"grpc.{service}.{method}"
        e.add("call", scope, spelled, n=e.depth)

    def net_http(self, name: str, args: list[tuple[int, int]], scope: str) -> None:
        t, e = self.t, self.e
        said = t.literal(args[0][0]) or ""
        if name == "HandleFunc" and len(args) > 1 and said[:1] == "/":
            for method in ("GET", "POST"):
                e.add("route", method, said, None, t.text(args[1][1] - 1))
        elif name in ("Get", "Post") and (path := path_of(said)):
            e.add("http_call", scope, path, name.upper())


def extract(e: Emitter, text: str) -> None:
    lines = len(text.splitlines())
    e.node(e.file_id, "file", "Lsyn", e.path.rsplit("/", 1)[-1], 1, "", f"// File: {e.path}\n// Lines: {lines}")
    e.add("loc", n=lines)
    t = Tokens(text, go=True)
    for alias, path in imports(t):
        e.add("import", alias, path)
        e.module(MODULE, path, path)
    _Scan(e, t).top()
