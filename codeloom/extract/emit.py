"""The facts of one file, with the identifier grammar of the graph."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

#: Fact rows of a batch.
BATCH = 2000

#: Kinds of facts, and relations of edges, that a file's expressions make; all others come from its statements. Each sort is numbered by
#: itself, so the numbers of statements are the same whether expressions are walked or not.
SAID, LATER = frozenset(("call", "attr_call", "literal_call", "http_call", "rpc_call", "USES")), 1 << 40

#: Prefixes of ids of things without a place in a source file; fixed by the id grammar.
FILE, MODULE, SYMBOL, EXTERNAL, CONTRACT = "file::", "module::", "symbol::", "external::", "contract::"


def stem(spelling: str, tail: str) -> str:
    """The last part of a dotted name without its tail; '' if it does not end so or is nothing else."""
    last = spelling.rpartition(".")[2]
    return last.removesuffix(tail) if last.endswith(tail) else ""


class Emitter:
    """Collects fact rows of a file and keeps the scope while it is walked.

    Kinds and their columns: node (a id, b type, c layer, d name, n line), edge (a src, b dst, c relation, d layer, n
    scope depth), symbol (a name, b id, c type), call (a caller, b spelling, n depth), attr_call (a caller, b variable,
    c method), route (a method, b path, c handler id, d handler name), decorator (a handler id, b spelling, c handler
    name, d strings of the first argument, pairs: strings of the named ones; JSON lists), http_call (a caller, b path, c
    method), literal_call (a caller, b spelling, c strings of the first argument), import (a
    alias, b target), import_spec (a alias, b specifier, c source name), base (a class, b spelling, n depth), var_type (a
    scope, b variable, c type), client_var (a variable, b service), rpc_call (a caller, b service, c method),
    go_type_var (a variable, b type), go_register (a service, b argument, c scope), servicer (a class, b service),
    js_service (a service, b scope, pairs), service (a service, b file id, c sha256), rpc (a service, b rpc, c request,
    d response, doc sha256), loc (n lines), problem (a message).
    """

    def __init__(self, repo: str, path: str, pack: Callable[[list[tuple]], Any] | None = None, want: frozenset[str] | None = None):
        """With `pack`, every BATCH rows are turned by it into a table of `packed`, so a large file is not held as Python rows.
        With `want`, rows of other kinds, and edges of other relations, are numbered but not kept."""
        self.repo, self.path, self.pack, self.want = repo, path, pack, want
        self.packed: list[Any] = []
        self.count, self.said = 0, LATER
        self.ctx = f"{repo}/{path}" if repo else path
        self.file_id = FILE + self.ctx
        self.scope: list[str] = []
        self.depth = 0
        self.rows: list[tuple] = []
        self.vars: dict[str, set[str] | frozenset[str]] = {}
        self.alike: dict[frozenset[str], frozenset[str]] = {}
        self.seen: set[str] = set()
        self.types: dict[str, str] = {}

    def add(self, kind: str, a=None, b=None, c=None, d=None, n=None, doc=None, code=None, pairs=None, seq: int | None = None) -> None:
        of = c if kind == "edge" else kind
        if of in SAID:
            seq, self.said = self.said, self.said + 1
        elif seq is None:
            seq = self.place()
        if self.want is not None and of not in self.want:
            return
        self.rows.append((self.repo, self.path, self.ctx, kind, seq, a, b, c, d, n, None, doc, code, pairs))
        if self.pack and len(self.rows) >= BATCH:
            self.packed.append(self.pack(self.rows))
            self.rows = []

    def wants(self, *kinds: str) -> bool:
        return self.want is None or not self.want.isdisjoint(kinds)

    def place(self) -> int:
        """The place of the next row, which a row that is added later can be given."""
        self.count += 1
        return self.count - 1

    def scope_id(self) -> str:
        return f"{self.ctx}:{'.'.join(self.scope)}" if self.scope else self.file_id

    def id_of(self, name: str) -> str:
        return f"{self.ctx}:{'.'.join([*self.scope, name])}"

    def node(self, id_: str, type_: str, layer: str, name: str, line: int = 0, doc: str = "", code: str = "", seq: int | None = None) -> None:
        self.seen.add(id_)
        self.types[id_] = type_
        self.add("node", id_, type_, layer, name, line, doc or "", code or "", seq=seq)

    def edge(self, src: str, dst: str, relation: str, layer: str, depth: int | None = None) -> None:
        self.add("edge", src, dst, relation, layer, self.depth if depth is None else depth)

    def define(self, name: str, type_: str, line: int, doc: str = "", code: str = "") -> str:
        """A class, type or function of the current scope: node, symbol and containment."""
        id_ = self.id_of(name)
        self.node(id_, type_, "Lsyn", name, line, doc, code)
        return self.declare(id_, name, type_)

    def declare(self, id_: str, name: str, type_: str) -> str:
        """Symbol and containment of a node of the current scope."""
        self.add("symbol", name, id_, type_)
        self.edge(self.scope_id(), id_, "CONTAINS", "Lsyn")
        return id_

    def variable(self, scope: str, name: str, line: int, relation: str = "DEFINES", depth: int | None = None) -> str:
        id_, names = f"{scope}.var::{name}", self.vars.get(scope, frozenset())
        if name not in names:
            self.add("node", id_, "variable", "Lflow", name, line, "", "")
            if isinstance(names, frozenset):
                names = self.vars[scope] = set(names)
            names.add(name)
        self.edge(scope, id_, relation, "Lflow", depth)
        return id_

    def local(self, name: str) -> str | None:
        """The id of a variable of the current scope."""
        scope = self.scope_id() if self.scope else ""
        return f"{scope}.var::{name}" if name in self.vars.get(scope, ()) else None

    def returns(self, line: int, variable: str | None) -> None:
        scope = self.scope_id()
        id_ = f"{scope}.return::{line}"
        if id_ not in self.seen:
            self.seen.add(id_)
            self.add("node", id_, "return", "Lflow", "return", line, "", "")
        self.edge(scope, id_, "RETURNS", "Lflow")
        if variable:
            self.edge(variable, id_, "FLOWS_TO", "Lflow")

    def enter(self, name: str) -> None:
        self.scope.append(name)
        self.depth += 1

    def leave(self) -> None:
        """Scopes that are left share their sets of names, as those of a large file are much alike."""
        scope = self.scope_id()
        if names := self.vars.get(scope):
            names = frozenset(names)
            self.vars[scope] = self.alike.setdefault(names, names)
        self.scope.pop()
        self.depth -= 1

    def module(self, prefix: str, target: str, name: str) -> None:
        """An imported module or symbol and the IMPORTS edge to it."""
        if prefix + target not in self.seen:
            self.node(prefix + target, "module" if prefix == MODULE else "symbol_ref", "Ldep", name)
        self.edge(self.file_id, prefix + target, "IMPORTS", "Ldep", 0)
