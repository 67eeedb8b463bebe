"""Command line: build a graph of a repository or workspace and ask it.

python -m codeloom.cli PATH [--workspace] [--explain N] [--rag TEXT] [--adjacency N] [--blast N] [--consumers C]
[--implements C] [--contract-of N] [--graft N] [--verify] [--diagnose] [--remediate] [--export FILE] [--save DIR] [--serve PORT] [--shell]
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from codeloom.api import CodeGraph
from codeloom.storage import save_graph


def commands(g: CodeGraph) -> dict:
    return {
        "explain": g.explain_node, "rag": g.rag_query, "adj": g.adjacency_query, "blast": g.blast_radius, "consumers": g.downstream_consumers,
        "implements": g.who_implements, "contract-of": g.contract_of, "graft": g.budget_graft, "nhop": g.nhop,
        "verify": lambda *_: g.verify_graph(), "stats": lambda *_: g.verify_graph(), "diagnose": lambda *_: g.diagnose(),
    }


def answer(g: CodeGraph, line: str) -> object:
    """One line of the shell: a verb and its argument."""
    verb, _, rest = line.strip().partition(" ")
    known = commands(g)
    if verb not in known:
        return {"error": f"unknown command {verb!r}", "commands": sorted(known)}
    try:
        return known[verb](rest.strip())
    except LookupError as e:
        return {"error": str(e)}


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="codeloom")
    p.add_argument("path")
    p.add_argument("--workspace", action="store_true")
    for name in ("explain", "rag", "adjacency", "blast", "consumers", "implements", "contract-of", "graft", "export", "save"):
        p.add_argument(f"--{name}")
    p.add_argument("--serve", type=int)
    for name in ("verify", "diagnose", "remediate", "shell"):
        p.add_argument(f"--{name}", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("codeloom").getOrCreate()
    g = (CodeGraph.of_workspace if a.workspace else CodeGraph.of_repo)(spark, a.path)
    asked = {"explain": a.explain, "rag": a.rag, "adj": a.adjacency, "blast": a.blast, "consumers": a.consumers, "implements": a.implements, "contract-of": a.contract_of, "graft": a.graft, "verify": "" if a.verify else None, "diagnose": "" if a.diagnose else None}
    for verb, value in asked.items():
        if value is not None:
            print(json.dumps(answer(g, f"{verb} {value}"), indent=2, default=str))
    if a.remediate:
        print(json.dumps(g.remediate(), indent=2, default=str))
    if a.export:
        g.export(a.export)
    if a.save:
        save_graph(g.g.nodes, g.g.edges, a.save)
    if a.serve:
        from codeloom.server import serve

        serve(g, a.serve).serve_forever()
    while a.shell:
        try:
            print(json.dumps(answer(g, input("> ")), indent=2, default=str))
        except EOFError:
            break


if __name__ == "__main__":
    main()
