"""The build lifecycle: files to facts, facts to a layered graph, for one repository or a workspace of them.

Per-file facts are the only state. All derived edges are functions of the fact table, so building after an incremental
change of some files' facts gives what a build from scratch gives. A repository is a column; a workspace is one build.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from threading import RLock
from typing import Any, ClassVar

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.extract.facts import JS, extract_facts
from codeloom.operators import resolve
from codeloom.operators import text as T
from codeloom.schema import as_edges, as_nodes
from codeloom.sources.modules import resolve_imports
from codeloom.sources.repo import RepoConfig
from codeloom.storage import numbered, stored

SHARED = "shared_contracts"


#: Steps of resolution with the layer and the relations of the edges that each makes; all others are declared by files, or similar texts.
STEPS = {"extended": ("Ldep", ("EXTENDS",)), "called": ("Ldep", ("CALLS", "POLYMORPHIC_CALL")), "requested": ("Ldep", ("HTTP_CALLS",)), "produced": ("Lcontract", ("IMPLEMENTS",)), "used": ("Lcontract", ("CONSUMES",))}


#: Relations that files declare, by layer.
DECLARED = {"Lsyn": ("CONTAINS",), "Ldep": ("IMPORTS",), "Lflow": ("DEFINES", "PASSES_ARG", "RETURNS", "FLOWS_TO", "MUTATES", "USES"), "Lcontract": ("DEFINES_RPC",)}

#: Kinds of facts, and relations of edges, that are extracted together: what files declare, and what each sort of query asks besides.
FAMILIES = {
    "outline": ("loc", "problem", "symbol", "base", "servicer", "service", "rpc", "import", "import_spec", "decorator", "route", "client_var", "js_service", "go_type_var", "go_register", "CONTAINS", "IMPORTS", "DEFINES_RPC"),
    "flow": ("DEFINES", "PASSES_ARG", "RETURNS", "FLOWS_TO", "MUTATES", "var_type"),
    "requests": ("literal_call", "http_call"),
    "clients": ("attr_call", "rpc_call"),
    "calls": ("call", "USES"),
    "nodes": ("node",),
}
FAMILY = {kind: name for name, kinds in FAMILIES.items() for kind in kinds}

#: Kinds of facts that a step of resolution reads, besides those of the outline.
READS = {"called": ("call", "var_type", "node"), "requested": FAMILIES["requests"], "used": FAMILIES["clients"]}


class Table:
    """Facts of files, stored by families when they are first asked for, or all at once. All passes give a fact the same number."""

    def __init__(self, files: DataFrame | None, facts: DataFrame | None = None):
        self.files, self.whole = files, facts
        self.parts: dict[str, DataFrame] = {}
        self.lock = RLock()

    def all(self) -> DataFrame:
        with self.lock:
            if self.whole is None:
                self.whole = stored(extract_facts(self.files), "facts")
            return self.whole

    def having(self, *kinds: str) -> DataFrame:
        """A table with the facts of these kinds, each once, and maybe others. What is missing is extracted in one pass."""
        with self.lock:
            names = sorted({FAMILY[k] for k in kinds})
            missing = [name for name in names if name not in self.parts]
            if self.whole is not None or len(missing) > 2:  # nearly all; one pass is less than two
                return self.all()
            if missing:
                made = stored(extract_facts(self.files, [k for name in missing for k in FAMILIES[name]]), "facts")
                self.parts |= dict.fromkeys(missing, made)
            tables = list({id(self.parts[name]): self.parts[name] for name in names}.values())
            return functools.reduce(DataFrame.unionByName, tables)


@dataclass
class Graph:
    """A built graph: the facts of its files, and what follows from them, made once each when first asked for."""

    table: Table
    made: dict[str, Callable[[], Any]]
    kept: dict[str, Any] = field(default_factory=dict)
    locks: dict[str, RLock] = field(default_factory=lambda: defaultdict(RLock))

    def get(self, name: str) -> Any:
        with self.locks[name]:
            if name not in self.kept:
                self.kept[name] = self.made[name]()
            return self.kept[name]

    def related(self, *relations: str) -> DataFrame:
        """The edges of these relations; no other step of resolution is taken."""
        return self.some("relation", relations, {part for part, (_, made) in STEPS.items() if set(made) & set(relations)})

    def layered(self, *layers: str) -> DataFrame:
        """The edges of these layers; no other step of resolution is taken."""
        return self.some("layer", layers, {part for part, (layer, _) in STEPS.items() if layer in layers})

    def some(self, column: str, values: Sequence[str], parts: set[str]) -> DataFrame:
        if "edges" in self.kept:
            return self.get("edges").filter(F.col(column).isin(*values))
        declared = [r for layer, made in DECLARED.items() for r in made if (r if column == "relation" else layer) in values]
        facts = self.table.having("symbol", *declared, *[k for part in parts for k in READS.get(part, ())])  # in one pass for all steps
        made = resolve.at_once(*[functools.partial(self.get, name) for name in sorted(parts)]) if parts else []
        edges = functools.reduce(DataFrame.unionByName, [declared_edges(facts), *made])
        return edges.filter(F.col(column).isin(*values))

    facts: ClassVar = property(lambda self: self.table.all())
    edges: ClassVar = property(lambda self: self.get("edges"))
    unresolved: ClassVar = property(lambda self: self.get("uses")[1])
    dangling_http: ClassVar = property(lambda self: self.get("requests")[1])
    skews: ClassVar = property(lambda self: self.get("skews"))
    nodes: ClassVar = property(lambda self: self.get("nodes"))
    corpus: ClassVar = property(lambda self: self.get("corpus"))
    postings: ClassVar = property(lambda self: self.get("postings"))
    vocabulary: ClassVar = property(lambda self: self.get("vocabulary"))
    weights: ClassVar = property(lambda self: self.get("weights"))
    loc: ClassVar = property(lambda self: self.get("loc"))


def with_js_imports(facts: DataFrame, sources: DataFrame, configs: dict[str, RepoConfig]) -> DataFrame:
    """facts with the import rows, nodes and edges that module specifiers stand for."""
    specs = facts.filter("kind = 'import_spec'").select("repo", "file", "ctx", "seq", F.col("a").alias("alias"), F.col("b").alias("spec"), F.coalesce("c", F.lit("")).alias("name"))
    found = resolve_imports(specs, resolve.Facts(lambda *kinds: facts, sources).module_files(), configs)
    base = facts.filter("kind <> 'import_spec'")

    def rows(kind, **cols):
        at = {**{c: F.lit(None) for c in ("a", "b", "c", "d", "n", "x", "doc", "code", "pairs")}, **cols}
        return found.select(*[(F.lit(kind) if f.name == "kind" else F.col(f.name) if f.name in ("repo", "file", "ctx", "seq") else at[f.name]).cast(f.dataType).alias(f.name) for f in facts.schema.fields])

    symbol = F.concat(F.lit("symbol::"), "target")
    out = base.unionByName(rows("import", a=F.col("alias"), b=F.col("target")))
    out = out.unionByName(rows("node", a=symbol, b=F.lit("symbol_ref"), c=F.lit("Ldep"), d=F.col("alias"), n=F.lit(0), doc=F.lit(""), code=F.lit("")))
    return out.unionByName(rows("edge", a=F.concat(F.lit("file::"), "ctx"), b=symbol, c=F.lit("IMPORTS"), d=F.lit("Ldep"), n=F.lit(0)))


def declared_edges(facts: DataFrame) -> DataFrame:
    """The edges that files declare."""
    return as_edges(facts.filter("kind = 'edge'").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("c").alias("relation"), F.col("d").alias("layer"), F.col("n").alias("d_scope"), F.col("ctx").alias("id_ctx"), "seq"))


def fact_nodes(facts: DataFrame) -> DataFrame:
    """Nodes that files declare. The last declaration in file order gives the attributes; contracts have no file of their
    own and keep all their definitions."""
    rows = facts.filter("kind = 'node'").select(F.col("a").alias("id"), F.col("b").alias("type"), F.col("c").alias("layer"), F.col("d").alias("name"), "repo", "ctx", "seq", F.col("n").alias("line_no"), F.col("doc").alias("docstring"), "code")
    place = F.struct("ctx", "seq")
    attrs = F.struct("type", "layer", "name", "repo", "ctx", "line_no", "docstring", "code")
    last = rows.groupBy("id").agg(F.max_by(attrs, place).alias("n"), F.min(place).alias("first"))
    contract = F.col("id").startswith("contract::") | F.col("id").startswith("module::") | F.col("id").startswith("symbol::")
    return last.select("id", "n.type", "n.layer", "n.name", F.when(contract, "").otherwise(F.col("n.ctx")).alias("file"), F.when(contract, "").otherwise(F.col("n.repo")).alias("repo"), "n.line_no", "n.docstring", "n.code", "first")


def definitions(facts: DataFrame) -> DataFrame:
    """(id, definitions, request_type, response_type) of contracts."""
    empty = F.lit(None).cast("string")
    service = facts.filter("kind = 'service'").select(F.concat(F.lit("contract::"), "a").alias("id"), "ctx", F.struct(F.col("file"), F.col("b").alias("file_id"), F.col("repo").alias("repo_id"), F.col("c").alias("sha256"), empty.alias("request_type"), empty.alias("response_type")).alias("d"))
    rpc = facts.filter("kind = 'rpc'").select(F.concat(F.lit("contract::"), "a", F.lit("."), "b").alias("id"), "ctx", F.struct(F.col("file"), F.concat(F.lit("file::"), "ctx").alias("file_id"), F.col("repo").alias("repo_id"), F.col("doc").alias("sha256"), F.col("c").alias("request_type"), F.col("d").alias("response_type")).alias("d"))
    every = service.unionByName(rpc).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ctx", "d"))).alias("all"))
    last = F.element_at("all", -1)["d"]
    return every.select("id", F.transform("all", lambda x: x["d"]).alias("definitions"), last["request_type"].alias("request_type"), last["response_type"].alias("response_type"))


def contract_skews(facts: DataFrame) -> DataFrame:
    """A5. Services and rpcs that repositories define differently; shared contracts do not count."""
    own = facts.filter(F.col("repo") != SHARED)
    service = own.filter("kind = 'service'").select(F.col("a").alias("service"), F.lit("").alias("rpc"), "repo", F.col("c").alias("value"))
    rpc = own.filter("kind = 'rpc'").select(F.col("a").alias("service"), F.col("b").alias("rpc"), "repo", F.concat(F.lit("("), "c", F.lit(")->("), "d", F.lit(")")).alias("value"))
    agg = service.unionByName(rpc).groupBy("service", "rpc").agg(F.count(F.lit(1)).alias("definitions"), F.array_sort(F.collect_set("value")).alias("variants"), F.array_sort(F.collect_set(F.struct("repo", "value"))).alias("by_repo"))
    return agg.filter("definitions > 1 and size(variants) > 1").withColumn("versions", F.map_from_entries(F.array_distinct(F.transform("by_repo", lambda x: F.struct(x["repo"], F.lit(""))))))


def lines_of_code(facts: DataFrame) -> DataFrame:
    """A7. One row: loc, the lines of all parsed sources."""
    return facts.filter("kind = 'loc'").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("loc"))


def build(files: DataFrame, configs: dict[str, RepoConfig] | None = None, workspace: bool = False, semantic: bool = True, by_need: bool = False) -> Graph:
    """A graph of a file table (repo, path, ext, content). With `by_need`, which is for tables that do not change, facts of Python,
    Go and protobuf sources are extracted by families, as queries ask for them."""
    sources = files.select("repo", "path", "ext")
    if by_need and not semantic and sources.filter(F.col("ext").isin(*JS)).isEmpty():  # specifiers of modules add facts of several kinds
        return from_table(Table(files), sources, workspace, semantic)
    return from_facts(stored(extract_facts(files), "facts"), sources, configs, workspace, semantic)


def from_facts(facts: DataFrame, sources: DataFrame, configs: dict[str, RepoConfig] | None = None, workspace: bool = False, semantic: bool = True) -> Graph:
    """A graph of a fact table; see build()."""
    sources = stored(sources.distinct(), "sources")
    if not facts.filter("kind = 'import_spec'").isEmpty():
        facts = stored(with_js_imports(facts, sources, configs or {}), "facts")
    return from_table(Table(None, facts), sources, workspace, semantic)


def from_table(table: Table, sources: DataFrame, workspace: bool, semantic: bool) -> Graph:
    f = resolve.Facts(table.having, sources)

    def hierarchy() -> tuple[DataFrame, DataFrame]:
        known, extends = resolve.hierarchy(f)
        return known, as_edges(extends)

    def requests() -> tuple[DataFrame, DataFrame]:
        http, dangling = resolve.http(f, across=workspace)
        return stored(as_edges(http), "requested"), dangling

    def uses() -> tuple[DataFrame, DataFrame]:
        used, unresolved = resolve.consumers(f)
        return stored(as_edges(used), "used"), unresolved

    def all_edges() -> DataFrame:
        table.all()
        # What does not follow from one another is derived at once: on a small repository a build is waiting for small jobs.
        names = ["called", "produced", "requested", "used", "skews"]
        resolve.at_once(*[functools.partial(g.get, name) for name in names])
        return functools.reduce(DataFrame.unionByName, [g.get(name) for name in ("declared_edges", "extended", "called", "produced", "requested", "used")])

    def nodes() -> DataFrame:
        facts, declared, skews = table.all(), g.get("declared"), g.skews
        ends = g.edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(declared, "id", "left_anti")
        kind = F.when(F.col("id").startswith("external::"), "external_func").when(F.col("id").startswith("symbol::"), "symbol_ref").when(F.col("id").startswith("module::"), "module").otherwise("unknown")
        stubs = ends.select("id", kind.alias("type"), F.lit("Ldep").alias("layer"), F.element_at(F.split("id", "::"), -1).alias("name"), F.lit(0).alias("line_no"))
        routed = resolve.routes(f).groupBy(F.col("handler").alias("id")).agg(F.min("path").alias("http_path"), F.array_sort(F.collect_set("method")).alias("http_methods"))
        skewed = skews.select(F.explode(F.array(F.concat(F.lit("contract::"), "service"), F.when(F.col("rpc") != "", F.concat(F.lit("contract::"), "service", F.lit("."), "rpc")))).alias("id")).filter("id is not null").distinct().withColumn("skew", F.lit(True))
        rows = declared.join(definitions(facts), "id", "left").join(routed, "id", "left").join(skewed, "id", "left")
        rows = rows.withColumn("tier", F.lit(0)).unionByName(stubs.withColumn("tier", F.lit(1)), allowMissingColumns=True)
        return stored(as_nodes(numbered(rows, ["tier", "first", "id"], "ord")), "nodes")

    def postings() -> DataFrame:
        stop = T.stop_words(g.corpus.sparkSession)
        return stored(T.postings(g.corpus, T.terms(F.col("text"), stop, 1 if workspace else 2)), "postings")

    g = Graph(table, {
        "declared": lambda: stored(fact_nodes(table.having("node")), "declared"),
        "declared_edges": lambda: declared_edges(table.all()),
        "hierarchy": hierarchy,
        "extended": lambda: g.get("hierarchy")[1],
        "called": lambda: stored(as_edges(resolve.calls(f, g.get("hierarchy")[0], lambda: g.get("declared"))), "called"),
        "produced": lambda: stored(as_edges(resolve.producers(f, g.get("hierarchy")[0])), "produced"),
        "requests": requests,
        "requested": lambda: g.get("requests")[0],
        "uses": uses,
        "used": lambda: g.get("uses")[0],
        "skews": lambda: stored(contract_skews(table.having("service", "rpc")), "skews"),
        "edges": all_edges,
        "nodes": nodes,
        "corpus": lambda: stored(T.corpus(g.nodes, workspace), "corpus"),
        "postings": postings,
        "vocabulary": lambda: stored(T.vocabulary(g.postings, g.corpus.count(), max_features=2500 if workspace else None), "vocabulary"),
        "weights": lambda: stored(T.weights(g.postings, g.vocabulary), "weights"),
        "loc": lambda: lines_of_code(table.having("loc")).first()[0],
    })
    if semantic:
        g.get("nodes")  # of the edges without the similar ones, which add no end
        if workspace:
            similar = T.semantic_band_edges(g.corpus, g.weights)
        else:
            similar = T.semantic_edges(g.weights.join(g.corpus.filter("length(trim(docstring)) > 10").select("id"), "id", "left_semi"))
        g.kept["edges"] = stored(g.edges.unionByName(as_edges(similar)), "edges")
    return g
