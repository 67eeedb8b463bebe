"""Facades over a built graph: one set of queries for repositories and workspaces, with plain Python results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.text import service_of, space_tokens, word_tokens
from codeloom.operators import heal, lookup, relational, traverse
from codeloom.operators import text as T
from codeloom.plans.build import Graph
from codeloom.plans.workspace import build_repo, build_workspace
from codeloom.sources import manifest, sinks
from codeloom.sources.repo import scan

SCOPES = {"downstream": "out", "upstream": "in", "both": "both"}


def _dicts(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


class CodeGraph:
    """Queries on a built graph. Results are small by nature: neighbourhoods, top-k lists, summaries. The DataFrame behind
    each is in operators/."""

    def __init__(self, graph: Graph, workspace: bool = False, files: DataFrame | None = None):
        self.g, self.workspace, self.files = graph, workspace, files
        self.spark: SparkSession = graph.nodes.sparkSession

    @classmethod
    def of_repo(cls, spark: SparkSession, root: str, repo: str = "") -> CodeGraph:
        return cls(build_repo(spark, root, repo), files=scan(spark, root, repo))

    @classmethod
    def of_workspace(cls, spark: SparkSession, path: str) -> CodeGraph:
        from codeloom.plans.workspace import scan_workspace

        ws = manifest.load(path)
        return cls(build_workspace(spark, ws), True, scan_workspace(spark, ws)[0])

    def _root(self, found: DataFrame, name: str) -> DataFrame:
        ids = [r.id for r in found.collect()]
        if not ids:
            raise LookupError(f"{name!r} is not in the graph")
        return traverse.roots(self.spark, ids[0])

    def resolve(self, name: str) -> str:
        return self._root(lookup.by_name(self.g.nodes, name), name).first().id

    def adjacency_query(self, node_id: str, layers: Sequence[str] | None = None, direction: str = "both", depth: int = 1) -> list[dict]:
        rows = traverse.adjacency(self.g.edges, traverse.roots(self.spark, node_id), layers, direction, depth)
        return _dicts(rows.withColumn("metadata", F.struct("d_scope", "f_call", "c_type", "id_ctx")).drop("d_scope", "f_call", "c_type", "id_ctx").orderBy("hop", "source", "target", "relation"))

    def nhop(self, name: str, depth: int = 2, layers: Sequence[str] | None = None) -> dict:
        root = self._root(lookup.fuzzy(self.g.nodes, name, ignore_case=True), name)
        nodes = traverse.nhop(self.g.nodes, self.g.edges, root, depth, layers=layers).select("id", "name", "type", "layer", "file", "hop").orderBy("hop", "name", "id")
        edges = traverse.adjacency(self.g.edges, root, layers, "both", depth).select("source", "target", "relation", "layer", F.col("d_scope").alias("scope"), F.col("c_type").alias("confidence"), "hop").distinct()
        return {"root": root.first().id, "nodes": _dicts(nodes), "edges": _dicts(edges.orderBy("hop", "source", "target", "relation"))}

    def explain_node(self, name: str) -> dict:
        root = self._root(lookup.fuzzy(self.g.nodes, name), name).first().id
        near = self.g.edges.filter((F.col("src") == root) | (F.col("dst") == root))
        sections = _dicts(traverse.explain(near).filter(F.col("id") == root))
        node = self.g.nodes.filter(F.col("id") == root).select("id", "name", "type", "file", "line_no", "docstring").first().asDict()
        return node | (sections[0] if sections else {})

    def blast_radius(self, name: str, max_depth: int = 2, direction: str = "both", layers: Sequence[str] | None = None) -> dict:
        root = self._root(lookup.by_name(self.g.nodes, name), name)
        way = SCOPES[direction]
        total = traverse.blast_radius(self.g.nodes, self.g.edges, root, max_depth, way, layers).first().asDict()
        reached = traverse.nhop(self.g.nodes, self.g.edges, root, max_depth, way, layers)
        impacted = reached.select("id", "type", "name", "file", F.col("line_no").alias("line"), service_of(F.coalesce("file", F.lit(""))).alias("service"))
        edges = traverse.blast_edges(self.g.edges, root, max_depth, way, layers)
        return {"root": root.first().id, **total, "nodes": _dicts(impacted.orderBy("id")), "edges": _dicts(edges.orderBy("depth", "source", "target", "relation"))}

    def downstream_consumers(self, name: str) -> list[dict]:
        root = self._root(lookup.contract(self.g.nodes, name), name)
        return _dicts(traverse.downstream_consumers(self.g.nodes, self.g.edges, root).orderBy("consumer_node"))

    def contract_of(self, name: str) -> dict:
        root = self._root(lookup.by_name(self.g.nodes, name), name)
        rows = _dicts(traverse.contract_of(self.g.nodes, self.g.edges, root).orderBy("contract_node"))
        pick = lambda role: [r for r in rows if r["role"] == role]
        return {"node_id": root.first().id, "implements": pick("implements"), "consumes": pick("consumes"), "is_contract_bound": bool(rows)}

    def who_consumes(self, name: str) -> list[dict]:
        return _dicts(traverse.bound_entities(self.g.edges, self._root(lookup.contract(self.g.nodes, name), name), "CONSUMES").orderBy("contract", "entity"))

    def who_implements(self, name: str) -> list[dict]:
        return _dicts(traverse.bound_entities(self.g.edges, self._root(lookup.contract(self.g.nodes, name), name), "IMPLEMENTS").orderBy("contract", "entity"))

    def subtree_graft(self, name: str, max_depth: int = 2) -> dict:
        root = self._root(lookup.by_name(self.g.nodes, name), name)
        nodes, edges = traverse.subtree(self.g.edges, root, max_depth)
        return {"root": root.first().id, "total_nodes": nodes.count(), "relations": _dicts(edges.select("source", "target", "relation", "layer")), "context": traverse.subtree_text(self.g.nodes, nodes).first().context}

    def budget_graft(self, name: str, max_tokens: int = 2048, layers: Sequence[str] | None = None) -> dict:
        root = self._root(lookup.by_name(self.g.nodes, name), name)
        blocks = traverse.budget_graft(self.g.nodes, self.g.edges, root, max_tokens, layers).orderBy("running").collect()
        return {"root": root.first().id, "approx_tokens": int(blocks[-1].running), "token_budget": max_tokens, "nodes": [b.id for b in blocks], "context": "\n\n".join(b.block for b in blocks)}

    def _query_tokens(self, text: str) -> DataFrame:
        one = self.spark.createDataFrame([(text,)], "t string")
        rows = one.select(F.explode(T.terms(F.col("t"), T.stop_words(self.spark), 1 if self.workspace else 2)).alias("term"))
        return rows.groupBy("term").agg(F.count(F.lit(1)).alias("qtf"))

    def rag_query(self, text: str, top_k: int = 5, graft: bool = True) -> dict:
        """Cosine retrieval for a repository, hybrid with BM25 for a workspace; the best hit's slice goes with it."""
        scores = T.cosine(self.g.weights, self.g.vocabulary, self._query_tokens(text))
        if self.workspace:
            tokens = space_tokens(F.lower("text"))
            scores = T.hybrid(scores, T.bm25(T.postings(self.g.corpus, tokens), T.query_terms(self.spark, text.lower().split())))
        hits = T.top_k(scores.join(self.g.nodes, "id"), top_k, tie=[F.desc("ord")]).select("id", "name", "score", "file", F.col("line_no").alias("line"), "docstring", F.substring("code", 1, 300).alias("code_snippet"))
        found = _dicts(hits)
        return {"query": text, "hits": len(found), "top_matches": found} | ({"graft": self.subtree_graft(found[0]["id"])} if found and graft else {})

    def bm25_query(self, text: str, top_k: int = 5) -> list[dict]:
        posts = T.postings(self.g.corpus, word_tokens(F.col("text")))
        return _dicts(T.top_k(T.bm25(posts, T.query_terms(self.spark, T.driver_tokens(text))), top_k))

    def verify_graph(self) -> dict:
        out = relational.verify(self.g.nodes, self.g.edges).first().asDict() | {"total_loc": self.g.loc}
        if self.workspace:
            out |= {"repositories": _dicts(relational.verify_workspace(self.g.nodes, self.g.edges).orderBy("repo")), "skews": _dicts(self.g.skews.select("service", "rpc", "variants"))}
        return out

    def diagnose(self) -> list[dict]:
        return _dicts(heal.diagnose(self.g).orderBy("type", "service", "rpc", "old"))

    def remediate(self) -> list[dict]:
        if self.files is None:
            raise ValueError("remediation needs the source files")
        return _dicts(heal.remediate(self.g, self.files).orderBy("path"))

    def overview(self) -> dict:
        nodes, edges = traverse.overview(self.g.nodes, self.g.edges)
        return {"nodes": _dicts(nodes.select("id", "name", "type", "layer", "file", "degree")), "edges": _dicts(edges.select("src", "dst", "relation", "layer"))}

    def export(self, path: str) -> None:
        """Writes by the path's ending: .graphml, .gexf, .json, .html; any other path is a folder of CSV files."""
        ending = path.rsplit(".", 1)[-1]
        write = {"graphml": sinks.write_graphml, "gexf": sinks.write_gexf, "json": sinks.write_node_link, "html": sinks.write_html}.get(ending, sinks.write_csv)
        write(self.g.nodes, self.g.edges, path)
