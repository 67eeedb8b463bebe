"""Facts of JavaScript and TypeScript sources (X14 to X24), by a scan over tokens."""

from __future__ import annotations

import re

from codeloom.extract.emit import Emitter, stem
from codeloom.extract.tokens import Tokens

WRAPPERS = frozenset("export default async abstract const let var declare public private protected static readonly".split())
#: What routes hang on, and the verbs of routes and of the axios client; fixed values.
ROUTERS, VERBS = frozenset(("app", "router")), frozenset(("get", "post", "put", "delete", "patch"))
DECLARE = frozenset(("const", "let", "var"))
MUTATING = frozenset("= += -= *= /= %= **= &&= ||= ??= ++ --".split())
NO_CALL = frozenset("if for while switch catch function return typeof await new in of do else class super import require constructor".split()) - {"require", "super", "import"}


def _bindings(t: Tokens, brace: int, sign: str) -> list[tuple[str, str]]:
    """(alias, name) of the items between braces, where a sign (`as` or `:`) stands before an alias."""
    out = []
    for a, b in t.split(brace + 1, t.match.get(brace, brace)):
        if t.text(a) == "type" and t.kind(a + 1) == "id" and a + 1 < b and t.text(a + 1) != "as":
            a += 1
        if b > a:
            out.append((t.text(a + 2) if a + 2 < b and t.text(a + 1) == sign else t.text(a), t.text(a)))
    return out


def _imported(t: Tokens, i: int) -> list[tuple[str, str, str]]:
    """What an import statement at token i binds; nothing for type imports and those without names."""
    stop = i + 1
    while stop < len(t) and t.kind(stop) != "str" and t.text(stop) not in (";", "("):
        stop += 1
    spec, out = t.literal(stop), []
    if spec is None or t.text(stop - 1) != "from" or t.text(i + 1) == "type":
        return out
    for a, _ in t.split(i + 1, stop - 1):
        if t.text(a) == "{":
            out += [(alias, spec, name) for alias, name in _bindings(t, a, "as")]
        else:
            out.append((t.text(a + 2) if t.text(a) == "*" else t.text(a), spec, ""))
    return out


def _required(t: Tokens, i: int) -> list[tuple[str, str, str]]:
    """What a declaration binds whose value is the require call at token i."""
    spec = t.literal(i + 2) if t.text(i + 1) == "(" and t.text(i + 3) == ")" else None
    if spec is None or t.text(i - 1) != "=":
        return []
    if t.kind(i - 2) == "id" and t.text(i - 3) in DECLARE:
        return [(t.text(i - 2), spec, "")]
    brace = t.opened.get(i - 2, -1)
    if t.text(i - 2) == "}" and t.text(brace - 1) in DECLARE:
        return [(alias, spec, name) for alias, name in _bindings(t, brace, ":")]
    return []


def imports(t: Tokens) -> list[tuple[str, str, str]]:
    """(alias, specifier, source name or '' for a module) of ES imports and CommonJS requires, in their order."""
    reads = {"import": _imported, "require": _required}
    return [x for i in range(len(t)) if t.kind(i) == "id" and t.text(i) in reads and t.text(i - 1) != "." for x in reads[t.text(i)](t, i)]


class _Scan:
    def __init__(self, e: Emitter, t: Tokens):
        self.e, self.t = e, t

    def walk(self, i: int, end: int, members: bool = False) -> None:
        while i < end:
            i = self.step(i, end, members)

    def step(self, i: int, end: int, members: bool) -> int:
        t, e, word, kind = self.t, self.e, self.t.text(i), self.t.kind(i)
        if kind == "tmpl":
            self.template(i)
            return i + 1
        if kind != "id":
            if kind == "op" and word in t.match and members:
                self.walk(i + 1, t.match[i])
                return t.match[i] + 1
            return i + 1
        after_dot = t.text(i - 1) in (".", "?.")
        if not after_dot and word in ("class", "interface", "enum") and t.kind(i + 1) == "id":
            return self.type_body(i, end)
        if not after_dot and word == "type" and t.kind(i + 1) == "id" and t.text(i + 2) in ("=", "<"):
            e.define(t.text(i + 1), "type", t.items[i].line, t.doc(i, WRAPPERS))
            return i + 2
        if not after_dot and word == "function":
            at = i + 2 if t.text(i + 1) == "*" else i + 1
            if t.kind(at) == "id":
                return self.function(t.text(at), at + 1, i, i)
            return at
        if members and not after_dot and word not in WRAPPERS:
            at = i + 1
            if t.text(at) == "<":
                while at < end and t.text(at) != ">":
                    at += 1
                at += 1
            if t.text(at) == "(" and self.body(at) is not None:
                return self.function(word, at, i, i)
        if not after_dot and word in DECLARE:
            return self.declare(i, end)
        if word == "return" and not after_dot:
            return self.ret(i, end)
        if word == "new" and not after_dot and t.kind(i + 1) == "id":
            return self.construct(i)
        if after_dot or word in WRAPPERS:
            return i + 1
        if t.text(i + 1) == ":" and t.text(i - 1) in ("{", ",") or members:
            return i + 1
        return self.reference(i, end)

    def template(self, i: int) -> None:
        """Expressions inside a template literal are scanned as code of the same scope."""
        for m in re.finditer(r"\$\{([^}]*)\}", self.t.text(i)):
            inner = Tokens(m.group(1))
            _Scan(self.e, inner).walk(0, len(inner))

    def body(self, paren: int) -> int | None:
        """The opening brace of a function whose parameters begin at paren, past a return type."""
        i = self.t.match.get(paren, paren) + 1
        if self.t.text(i) == ":":
            i, angle = i + 1, 0
            while i < len(self.t):
                x = self.t.text(i)
                if x in ("(", "[") or x == "{" and (angle or self.t.text(i - 1) in (":", "|", "&")):  # a bracket of the type
                    i = self.t.match.get(i, i) + 1
                    continue
                if x in (")", "]", "}", ";") or not angle and x in ("{", "=>"):
                    break
                angle = max(0, angle + (x == "<") - (x == ">"))
                i += 1
        return i if self.t.text(i) == "{" else None

    def function(self, name: str, paren: int, start: int, doc_at: int, arrow: int | None = None) -> int:
        """A function with parameters at paren (or a single one, for an arrow) and its body. Returns the token after it."""
        t, e = self.t, self.e
        if t.text(paren) == "<":
            while t.text(paren) not in ("(", ""):
                paren += 1
        id_ = e.define(name, "function", t.items[start].line, t.doc(doc_at, WRAPPERS))
        ranges = t.split(paren + 1, t.match[paren]) if t.text(paren) == "(" else [(paren, paren + 1)]
        for a, b in ranges:
            while a < b and t.text(a) in WRAPPERS:
                a += 1
            if a < b and t.kind(a) == "id":
                e.variable(id_, t.text(a), t.items[a].line, "PASSES_ARG")
        e.enter(name)
        if arrow is not None:
            begin = arrow + 1
        else:
            begin = self.body(paren)
        if begin is None:
            end = t.match.get(paren, paren) + 1
        elif t.text(begin) == "{" and begin in t.match:
            end = t.match[begin] + 1
            self.walk(begin + 1, end - 1)
        else:  # an expression body: up to the end of the statement
            end = begin
            while end < len(t) and t.text(end) not in (";", ",", ")", "}", "]"):
                nxt = t.match.get(end, end) + 1
                if nxt < len(t) and t.items[nxt].line > t.items[nxt - 1].line and t.text(nxt) not in (".", "?.", "+", "?", ":", "&&", "||"):
                    end = nxt
                    break
                end = nxt
            self.walk(begin, end)
        e.leave()
        return max(end, paren + 1)

    def type_body(self, i: int, end: int) -> int:
        t, e, word, name = self.t, self.e, self.t.text(i), self.t.text(i + 1)
        kind = "type" if word == "enum" else "class"
        id_ = e.define(name, kind, t.items[i].line, t.doc(i, WRAPPERS))
        j = i + 2
        while j < end and t.text(j) != "{":
            if t.text(j) == "extends" and word == "class" and t.text(i - 1) != "abstract":
                k = j + 1
                while t.kind(k) == "id" and t.text(k) != "implements" or t.text(k) == ".":
                    k += 1
                if k > j + 1:
                    e.add("base", id_, t.span(j + 1, k), n=e.depth)
            j += 1
        if j not in t.match:
            return j + 1
        e.enter(name)
        if word == "class":
            self.walk(j + 1, t.match[j], members=True)
        e.leave()
        return t.match[j] + 1

    def declare(self, i: int, end: int) -> int:
        """One declarator after const, let or var; more of them are met as the scan goes on."""
        t, e, at = self.t, self.e, i + 1
        if t.kind(at) != "id":
            return at
        name, j = t.text(at), at + 1
        if t.text(j) == ":":  # a type annotation
            while j < end and t.text(j) not in ("=", ";", ",") and t.items[j].line == t.items[at].line:
                j = t.match.get(j, j) + 1
        if t.text(j) == "=":
            v = j + 1
            if t.text(v) == "async":
                v += 1
            if t.text(v) == "function":
                p = v + 1
                while p < end and t.text(p) != "(":
                    p += 1
                return self.function(name, p, at, i)
            if t.text(v) == "(" and v in t.match:
                a = t.match[v] + 1
                if t.text(a) == ":":
                    while a < end and t.text(a) not in ("=>", ";"):
                        a = t.match.get(a, a) + 1
                if t.text(a) == "=>":
                    return self.function(name, v, at, i, arrow=a)
            if t.kind(v) == "id" and t.text(v + 1) == "=>":
                return self.function(name, v, at, i, arrow=v + 1)
            if t.text(v) == "new":
                last = v + 1
                while t.text(last + 1) == "." and t.kind(last + 2) == "id":
                    last += 2
                if stem(t.text(last), "Service"):
                    e.add("client_var", name, t.text(last))
        if e.scope and e.types.get(e.scope_id()) == "function":
            e.variable(e.scope_id(), name, t.items[at].line)
        return j

    def ret(self, i: int, end: int) -> int:
        t, e = self.t, self.e
        if not e.scope:
            return i + 1
        line, j, first = t.items[i].line, i + 1, None
        while j < end and t.text(j) not in (";", "}") and first is None and not (j == i + 1 and t.items[j].line > line):
            if t.kind(j) == "id" and t.text(j - 1) not in (".", "?.") and not (t.text(j + 1) == ":" and t.text(j - 1) in ("{", ",")):
                first = e.local(t.text(j))
            j += 1
        e.returns(line, first)
        return i + 1

    def construct(self, i: int) -> int:
        t, e, last = self.t, self.e, i + 1
        while t.text(last + 1) == "." and t.kind(last + 2) == "id":
            last += 2
        if e.scope:
            e.add("call", e.scope_id(), t.text(last), n=e.depth)
            for k in range(i + 1, i + 2):
                if v := e.local(t.text(k)):
                    e.edge(e.scope_id(), v, "USES", "Lflow")
        return last + 1

    def reference(self, i: int, end: int) -> int:
        """An identifier that begins an expression: reads, mutations and calls, through chains of members and calls."""
        t, e, scope = self.t, self.e, self.e.scope_id()
        v = e.local(t.text(i))
        if v:
            if t.text(i + 1) in MUTATING or t.text(i - 1) in ("++", "--"):
                e.edge(scope, v, "MUTATES", "Lflow")
            e.edge(scope, v, "USES", "Lflow")
        j = i + 1
        while t.text(j) in (".", "?.") and t.kind(j + 1) == "id":
            j += 2
        if t.text(j) == "(" and j in t.match and t.text(i) not in NO_CALL:
            self.call(i, j)
            self.walk(j + 1, t.match[j])
            j = t.match[j] + 1
            while t.text(j) in (".", "?.") and t.kind(j + 1) == "id":  # a call on what a call returned
                j += 2
                if t.text(j) == "(" and j in t.match:
                    self.call(i, j)
                    self.walk(j + 1, t.match[j])
                    j = t.match[j] + 1
        return j

    def call(self, i: int, paren: int) -> None:
        t, e = self.t, self.e
        raw = t.span(i, paren)
        args = t.split(paren + 1, t.match[paren])
        owner, _, verb = raw.partition(".")
        known = verb in VERBS
        if known and owner in ROUTERS and len(args) >= 2:
            path = t.literal(args[0][0])
            if path and path.startswith("/"):
                a, b = args[1]
                named = b == a + 1 and t.kind(a) == "id"
                e.add("route", verb.upper(), path, None if named else e.scope_id(), t.text(a) if named else None)
        if not e.scope:
            return
        scope = e.scope_id()
        if (raw == "fetch" or known and owner == "axios") and args and t.kind(args[0][0]) == "str":
            method = verb if known else self.option(args[1:], "method") or "get"
            e.add("http_call", scope, t.literal(args[0][0]), method.upper())
        spelled = raw.replace("this.", "self.")
        if spelled.startswith("super."):
            spelled = "super()." + spelled[6:]
        e.add("call", scope, spelled, n=e.depth)
        if raw.count(".") >= 1:
            var, _, method = raw.partition(".")
            e.add("attr_call", scope, var, method)
        if t.text(paren - 1) == "addService" and len(args) >= 2:
            self.add_service(args)

    def option(self, args: list[tuple[int, int]], name: str) -> str | None:
        """The literal that an object literal among the arguments gives to a name."""
        t = self.t
        for brace, _ in args:
            for a, _ in t.split(brace + 1, t.match[brace]) if t.text(brace) == "{" else ():
                if (t.literal(a) or t.text(a)) == name and t.text(a + 1) == ":":
                    return t.literal(a + 2)
        return None

    def add_service(self, args: list[tuple[int, int]]) -> None:
        """The handlers of `pkg.Name.service` that an object literal gives, by rpc name."""
        t, (_, end), (brace, _) = self.t, args[0], args[1]
        if [t.text(end - 1), t.text(end - 2), t.kind(end - 3), t.text(end - 4)] != ["service", ".", "id", "."] or t.text(brace) != "{":
            return
        pairs = {}
        for a, b in t.split(brace + 1, t.match[brace]):
            rpc = t.literal(a) or t.text(a)
            if t.text(a + 1) == ":":
                call = t.opened.get(b - 1, -1)  # a method bound to its object counts as the method
                bound = t.text(b - 1) == ")" and t.text(call - 1) == "bind" and t.text(call - 2) == "."
                pairs[rpc] = t.span(a + 2, call - 2 if bound else b)
            elif b == a + 1 and t.kind(a) == "id":
                pairs[rpc] = rpc
        self.e.add("js_service", t.text(end - 3), self.e.scope_id(), pairs=pairs)


def extract(e: Emitter, text: str) -> None:
    lines = len(text.splitlines())
    e.node(e.file_id, "file", "Lsyn", e.path.rsplit("/", 1)[-1], 1, "", f"// File: {e.path}\n// Lines: {lines}")
    e.add("loc", n=lines)
    t = Tokens(text)
    for alias, spec, name in imports(t):
        e.add("import_spec", alias, spec, name)
    _Scan(e, t).walk(0, len(t))
