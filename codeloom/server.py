"""A read-only HTTP interface to one graph (K6): / , /api/graph, /api/nhop?node=&depth=, /api/rag_nhop?q=&depth=."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from codeloom.api import CodeGraph


def respond(g: CodeGraph, url: str) -> tuple[int, dict]:
    """Status and body of a request."""
    at = urlparse(url)
    q = {k: v[0] for k, v in parse_qs(at.query).items()}
    layers = q["layers"].split(",") if q.get("layers") else None
    try:
        depth = min(4, max(1, int(q.get("depth", 2))))
        if at.path == "/":
            return 200, {"paths": ["/api/graph", "/api/nhop", "/api/rag_nhop"]}
        if at.path == "/api/graph":
            return 200, g.overview()
        if at.path == "/api/nhop":
            return 200, g.nhop(q.get("node", ""), depth, layers)
        if at.path == "/api/rag_nhop":
            hits = g.rag_query(q.get("q", ""), graft=False)
            best = hits["top_matches"][0]["id"] if hits["top_matches"] else None
            return 200, hits | ({"subgraph": g.nhop(best, depth, layers)} if best else {})
    except LookupError as e:
        return 404, {"error": str(e)}
    except ValueError as e:
        return 400, {"error": str(e)}
    return 404, {"error": f"no such path: {at.path}"}


def serve(g: CodeGraph, port: int = 0, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            status, body = respond(g, self.path)
            raw = json.dumps(body, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *args: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
