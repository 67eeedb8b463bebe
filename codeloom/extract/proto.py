"""Service contracts of protobuf sources (S6), by a scan over tokens."""

from __future__ import annotations

import hashlib

from codeloom.extract.emit import CONTRACT, Emitter
from codeloom.extract.tokens import Tokens


class Contract:
    """Package and services of one source; services: [(name, [(rpc, request, response)])] in their order."""

    def __init__(self, text: str):
        self.t = Tokens(text, go=True)
        self.package, self.services = "", []
        i = 0
        while i < len(self.t):
            i = self._statement(i)

    def _statement(self, i: int) -> int:
        """Reads the statement or block that begins at token i and returns the token after what was read."""
        t, word = self.t, self.t.text(i)
        if word == "package" and not self.package and t.kind(i + 1) == "id":
            end = i + 1
            while t.kind(end) == "id" or t.text(end) == ".":
                end += 1
            if t.text(end) == ";":
                self.package = t.span(i + 1, end).replace(" ", "")
            return end
        if word == "service" and t.kind(i + 1) == "id" and t.text(i + 2) == "{":
            end = t.match[i + 2]
            self.services.append((t.text(i + 1), [r for k in range(i + 3, end) if t.text(k) == "rpc" and (r := self._rpc(k))]))
            return end + 1
        return i + 1

    def _rpc(self, i: int) -> tuple[str, str, str] | None:
        """rpc Name (Request) returns (Response) at token i. Streams and dotted types are no rpcs of the graph."""
        t = self.t
        shape = [t.kind(i + 1), t.text(i + 2), t.kind(i + 3), t.text(i + 4), t.text(i + 5), t.text(i + 6), t.kind(i + 7), t.text(i + 8)]
        if shape != ["id", "(", "id", ")", "returns", "(", "id", ")"]:
            return None
        return t.text(i + 1), t.text(i + 3), t.text(i + 7)


def services(text: str) -> list[tuple[str, list[tuple[str, str, str]]]]:
    return Contract(text).services


def extract(e: Emitter, raw: bytes) -> None:
    sha, found = hashlib.sha256(raw).hexdigest(), Contract(raw.decode("utf-8", "replace"))
    e.node(e.file_id, "file", "Lsyn", e.path.rsplit("/", 1)[-1], 1, "", f"// Proto contract file: {e.path}")
    for name, rpcs in found.services:
        id_ = CONTRACT + name
        e.node(id_, "service_contract", "Lcontract", name)
        e.edge(e.file_id, id_, "CONTAINS", "Lsyn", 0)
        e.add("service", name, e.file_id, sha, found.package)
        for rpc, request, response in rpcs:
            e.node(f"{id_}.{rpc}", "rpc_contract", "Lcontract", rpc)
            e.edge(id_, f"{id_}.{rpc}", "DEFINES_RPC", "Lcontract", 0)
            e.add("rpc", name, rpc, request, response, doc=sha)
