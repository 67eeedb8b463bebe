"""Workspaces of several repositories: one build with a repository column, shared contracts, cross-repository bindings."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.text import is_ignored
from codeloom.operators import relational
from codeloom.plans.build import SHARED, Graph, build
from codeloom.sources.manifest import Workspace
from codeloom.sources.repo import RepoConfig, files_table, read_config, scan
from codeloom.storage import content_key, load_graph, save_graph


def shared_contracts(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """S7. Protobuf files of the manifest's shared contracts, files or folders, under a repository of their own."""
    rows = []
    for top in paths:
        found = [top] if os.path.isfile(top) else sorted(os.path.join(d, n) for d, _, names in os.walk(top) for n in names)
        base = os.path.dirname(top) if os.path.isfile(top) else top
        for path in found:
            if path.endswith(".proto"):
                with open(path, "rb") as f:
                    rows.append((SHARED, os.path.relpath(path, base).replace(os.sep, "/"), f.read()))
    return files_table(spark, rows) if rows else None


def scan_workspace(spark: SparkSession, ws: Workspace) -> tuple[DataFrame, dict[str, RepoConfig]]:
    """The files of all repositories and of the shared contracts, and each repository's configuration. The manifest's
    ignore patterns hold besides the default ones and those of each repository."""
    files, configs = None, {}
    for r in ws.repositories:
        one = scan(spark, r.path, r.id, ws.ignore_patterns)
        files = one if files is None else files.unionByName(one)
        configs[r.id] = read_config(r.path, spark)
    shared = shared_contracts(spark, [s for s in ws.shared_contracts if not is_ignored(s, ws.ignore_patterns)])
    if shared is not None:
        files = shared if files is None else files.unionByName(shared)
    if files is None:
        raise ValueError("the workspace has no repositories")
    return files, configs


def build_workspace(spark: SparkSession, ws: Workspace) -> Graph:
    files, configs = scan_workspace(spark, ws)
    return build(files, configs, workspace=True)


def build_repo(spark: SparkSession, root: str, repo: str = "", extra_ignores: list[str] | None = None) -> Graph:
    return build(scan(spark, root, repo, extra_ignores), {repo: read_config(root, spark)})


def union_graphs(graphs: list[tuple[str, DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """U1. Graphs (repo, nodes, edges) that were built apart: the first graph that has a node gives its attributes, its
    definitions are those of all, and every edge is kept under a key with its repository."""
    nodes = relational.first_wins([n for _, n, _ in graphs])
    every = None
    for _, n, _ in graphs:
        d = n.select("id", F.explode("definitions").alias("d"))
        every = d if every is None else every.unionByName(d)
    merged = every.groupBy("id").agg(F.array_sort(F.collect_set("d")).alias("merged"))
    cols = nodes.columns
    nodes = nodes.join(merged, "id", "left").withColumn("definitions", F.coalesce("merged", "definitions")).select(*cols)
    edges = None
    for repo, _, e in graphs:
        e = e.withColumn("edge_id", F.concat(F.lit(f"w_{repo}_"), "edge_id"))
        edges = e if edges is None else edges.unionByName(e)
    return nodes, edges


def cached_graph(files: DataFrame, folder: str, configs: dict[str, RepoConfig] | None = None, workspace: bool = False) -> tuple[DataFrame, DataFrame]:
    """S12. (nodes, edges) of a file table, kept under a digest of its content: sources that did not change are not built
    again, and a change of any file makes another entry."""
    spark = files.sparkSession
    path = f"{folder.rstrip('/')}/{content_key(files)}"
    try:
        nodes, edges = load_graph(spark, path)
        if not nodes.isEmpty():
            return nodes, edges
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    g = build(files, configs, workspace)
    save_graph(g.nodes, g.edges, path)
    return load_graph(spark, path)
