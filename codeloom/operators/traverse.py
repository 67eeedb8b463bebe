"""Graph traversal as iterated frontier joins over an edge DataFrame (src, dst, relation, layer, ...).

A traversal of bounded depth is a chain of joins between a small frontier and the edges. Edges that many queries ask are
stored as an Adjacency, whose hops read the frontier's row groups only. Unbounded closures double their paths and write each
round to the shared folder.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from codeloom.functions.text import approx_tokens, service_of
from codeloom.storage import ROW_GROUP, clustered, running, shared_dir, stored

DOWN, UP, BOTH = "out", "in", "both"
#: What a graft follows; fixed values of the graph's vocabulary.
GRAFT_RELATIONS = ("CALLS", "DEFINES", "PASSES_ARG", "CONTAINS")
GRAFT_LAYERS = ("Ldep", "Lflow", "Lsyn")
BUDGET_OUT = ("CALLS", "POLYMORPHIC_CALL", "CONSUMES", "IMPLEMENTS", "EXTENDS", "MUTATES", "RETURNS", "HTTP_CALLS", "SEMANTIC_SIMILAR", "DEFINES_RPC")
BUDGET_IN = ("IMPLEMENTS", "CONSUMES", "CONTAINS", "DEFINES_RPC", "SEMANTIC_SIMILAR", "CALLS")


def checkpoint_dir(spark: SparkSession) -> None:
    """Makes sure that checkpoints go to the folder the cluster names."""
    sc, base = spark.sparkContext, shared_dir(spark)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)


def roots(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id string")


def steps(edges: DataFrame, direction: str, layers: Sequence[str] | None = None, relations: Sequence[str] | None = None) -> DataFrame:
    """edges as moves (at, to, direction, ...): forward for 'out', backward for 'in', both for 'both'."""
    if layers is not None:
        edges = edges.filter(F.col("layer").isin(*layers))
    if relations is not None:
        edges = edges.filter(F.col("relation").isin(*relations))
    out = edges.withColumns({"at": F.col("src"), "to": F.col("dst"), "direction": F.lit("out")})
    back = edges.withColumns({"at": F.col("dst"), "to": F.col("src"), "direction": F.lit("in")})
    return {DOWN: out, UP: back}.get(direction) if direction != BOTH else out.unionByName(back)


#: Nodes of a frontier that go into a scan's filter as values, and ranges of them that its statistics are asked for.
FRONTIER, RANGES = 1000, 16


@dataclass(frozen=True)
class Adjacency:
    """Edges stored twice, ordered by their source and by their target. A hop from a frontier of at most FRONTIER nodes reads
    the row groups that hold them, both ways; a larger one filters by a join."""

    out: DataFrame
    back: DataFrame

    @staticmethod
    def of(edges: DataFrame, row_group: int = ROW_GROUP) -> Adjacency:
        return Adjacency(clustered(edges, "edges-out", "src", "dst", row_group=row_group), clustered(edges, "edges-in", "dst", "src", row_group=row_group))

    @property
    def columns(self) -> list[str]:
        return self.out.columns

    def at(self, ids: list[str] | DataFrame, direction: str, layers: Sequence[str] | None = None, relations: Sequence[str] | None = None) -> DataFrame:
        """The moves that begin at these nodes."""
        found = []
        for way, edges, end in ((DOWN, self.out, "src"), (UP, self.back, "dst")):
            if direction in (way, BOTH):
                if isinstance(ids, list):
                    edges = edges.filter(in_ranges(F.col(end), ids))
                else:
                    edges = edges.join(ids.select(F.col("id").alias(end)), end, "left_semi").select(*edges.columns)
                found.append(steps(edges, way, layers, relations))
        return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def in_ranges(column: Column, ids: list[str]) -> Column:
    """Whether a column is one of the ids, said twice: as values, and as a few ranges that file statistics can rule out."""
    ids = sorted(ids)
    if not ids:
        return F.lit(False)
    step = -(-len(ids) // RANGES)
    ranges = [column.between(ids[i], ids[min(i + step, len(ids)) - 1]) for i in range(0, len(ids), step)]
    return functools.reduce(Column.__or__, ranges) & column.isin(*ids)


def bfs(edges: DataFrame | Adjacency, start: DataFrame, depth: int, direction: str = DOWN, layers: Sequence[str] | None = None, relations: Sequence[str] | None = None) -> DataFrame:
    """(id, dist): nodes within depth moves of the start ids, each with its least distance. edges: moves, or an Adjacency,
    whose small frontiers are looked up and whose large ones are joined."""
    if isinstance(edges, Adjacency):
        return _looked_up(edges, start, depth, [(direction, layers, relations)])
    return _joined(edges, start.select("id").distinct().withColumn("dist", F.lit(0)), 1, depth)


def _joined(moves: DataFrame, reached: DataFrame, first: int, depth: int) -> DataFrame:
    frontier = reached.filter(F.col("dist") == first - 1)
    pairs = moves.select("at", "to")
    for hop in range(first, depth + 1):  # the frontier filters the stored edges before anything is made distinct
        near = pairs.join(frontier.select(F.col("id").alias("at")), "at", "left_semi").select(F.col("to").alias("id")).distinct()
        frontier = near.join(reached, "id", "left_anti").withColumn("dist", F.lit(hop))
        reached = reached.unionByName(frontier)
    return reached


def _looked_up(edges: Adjacency, start: DataFrame, depth: int, ways: list[tuple]) -> DataFrame:
    """bfs over an Adjacency along any of the ways (direction, layers, relations)."""
    spark = edges.out.sparkSession
    dist: dict[str, int] = {}
    near = start.select("id").distinct()
    for hop in range(depth + 1):
        taken = [r[0] for r in near.limit(FRONTIER + len(dist) + 1).collect()]
        new = [i for i in taken if i not in dist]
        if len(taken) > FRONTIER + len(dist) or len(new) > FRONTIER:
            known = spark.createDataFrame(list(dist.items()), "id string, dist int")
            frontier = near.join(known, "id", "left_anti").withColumn("dist", F.lit(hop))
            moves = functools.reduce(DataFrame.unionByName, [steps(e, way, layers, relations) for d, layers, relations in ways for way, e in ((DOWN, edges.out), (UP, edges.back)) if d in (way, BOTH)])
            return _joined(moves, known.unionByName(frontier), hop + 1, depth)
        dist |= dict.fromkeys(new, hop)
        if hop == depth or not new:
            break
        near = functools.reduce(DataFrame.unionByName, [edges.at(new, *way) for way in ways]).select(F.col("to").alias("id")).distinct()
    return spark.createDataFrame(list(dist.items()), "id string, dist int")


def closure(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(src, dst, dist): all pairs with a path over the given edges, with the least number of moves.

    Paths double: with all pairs up to distance k known, a pair at up to 2k is one at just k and one at up to k, so rounds
    grow with the logarithm of the longest distance. Each round writes what is new; what was found is not written again.
    Cycles end, as a round without new pairs is the last.
    """
    base = edges.select("src", "dst").filter("src is not null and dst is not null").distinct().withColumn("dist", F.lit(1))
    found, last, k = stored(base, "closure"), None, 1
    last = found
    for _ in range(max_rounds):
        ahead = found.select(F.col("src").alias("mid"), "dst", (F.col("dist") + k).alias("dist"))
        longer = last.select("src", F.col("dst").alias("mid")).join(ahead, "mid").groupBy("src", "dst").agg(F.min("dist").alias("dist"))
        new = stored(longer.join(found.select("src", "dst"), ["src", "dst"], "left_anti"), "closure")
        if new.isEmpty():
            return found
        found, k = found.unionByName(new), 2 * k
        last = new.filter(F.col("dist") == k)
    raise RuntimeError(f"the closure did not end within {max_rounds} rounds")


def reachable(edges: DataFrame, start: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Ids that the start ids reach over the edges, themselves included. Each round writes its frontier alone."""
    seen = start.select("id").distinct()
    frontier = seen
    for _ in range(max_rounds):
        step = frontier.join(edges, frontier["id"] == edges["src"]).select(F.col("dst").alias("id")).distinct()
        frontier = stored(step.join(seen, "id", "left_anti"), "frontier")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
    raise RuntimeError(f"more than {max_rounds} rounds")


def adjacency(edges: DataFrame | Adjacency, start: DataFrame, layers: Sequence[str] | None = None, direction: str = BOTH, depth: int = 1, relations: Sequence[str] | None = None) -> DataFrame:
    """Every incident edge of every node nearer than depth, once for each direction in which it is met: (source, target,
    direction, relation, layer, d_scope, f_call, c_type, id_ctx, hop)."""
    meta = [F.col(c) for c in ("d_scope", "f_call", "c_type", "id_ctx") if c in edges.columns]
    if isinstance(edges, Adjacency):
        inner = bfs(edges, start, depth - 1, direction, layers, relations)
        ids = [r[0] for r in inner.select("id").limit(FRONTIER + 1).collect()]
        moves = edges.at(ids if len(ids) <= FRONTIER else inner, direction, layers, relations)
    else:
        moves = steps(edges, direction, layers, relations)
        inner = bfs(moves, start, depth - 1)
    return inner.join(moves, inner["id"] == moves["at"]).select(F.col("src").alias("source"), F.col("dst").alias("target"), "direction", "relation", "layer", *meta, (F.col("dist") + 1).alias("hop"))


def within(edges: DataFrame | Adjacency, start: DataFrame, depth: int, direction: str, layers: Sequence[str] | None = None, relations: Sequence[str] | None = None) -> DataFrame:
    """bfs over edges in any form."""
    return bfs(edges, start, depth, direction, layers, relations) if isinstance(edges, Adjacency) else bfs(steps(edges, direction, layers, relations), start, depth)


def nhop(nodes: DataFrame, edges: DataFrame | Adjacency, start: DataFrame, depth: int, direction: str = BOTH, layers: Sequence[str] | None = None) -> DataFrame:
    """Nodes within depth moves with their hop."""
    reached = within(edges, start, depth, direction, layers).withColumnRenamed("dist", "hop")
    return nodes.join(reached, "id")


def blast_edges(edges: DataFrame | Adjacency, start: DataFrame, depth: int = 2, direction: str = BOTH, layers: Sequence[str] | None = None, relations: Sequence[str] | None = None) -> DataFrame:
    tag = F.when(F.col("direction") == "out", "downstream").otherwise("upstream")
    return adjacency(edges, start, layers, direction, depth, relations).select("source", "target", "relation", "layer", tag.alias("direction"), F.col("hop").alias("depth"))


def blast_radius(nodes: DataFrame, edges: DataFrame | Adjacency, start: DataFrame, depth: int = 2, direction: str = BOTH, layers: Sequence[str] | None = None, relations: Sequence[str] | None = None) -> DataFrame:
    """One row: impacted nodes, traversed edges, affected files and services, and the impact score
    nodes + 2 * files + 5 * services."""
    reached = within(edges, start, depth, direction, layers, relations).join(nodes.select("id", "file"), "id", "left")
    file = F.when(F.col("file") != "", F.col("file"))
    contract = F.when(F.col("id").startswith("contract::") & (F.col("dist") > 0), F.split_part(F.split_part("id", F.lit("::"), F.lit(2)), F.lit("."), F.lit(1)))
    totals = reached.agg(F.count(F.lit(1)).alias("impacted_nodes"), F.count_distinct(file).alias("affected_files"), F.count_distinct(F.coalesce(F.when(file.isNotNull(), service_of(file)), contract)).alias("affected_services"))
    traversed = adjacency(edges, start, layers, direction, depth, relations).agg(F.count(F.lit(1)).alias("traversed_edges"))
    score = F.col("impacted_nodes") * 1.0 + F.col("affected_files") * 2.0 + F.col("affected_services") * 5.0
    return totals.crossJoin(F.broadcast(traversed)).withColumn("impact_score", F.round(score, 2))  # one row with one row


def downstream_consumers(nodes: DataFrame, edges: DataFrame, contract: DataFrame) -> DataFrame:
    """Consumers of contracts (id) and of the rpcs that these services define; one row for each consumer, with the
    smallest contract it uses."""
    rpcs = edges.filter(F.col("relation") == "DEFINES_RPC").join(contract, F.col("src") == F.col("id"), "left_semi").select(F.col("dst").alias("id"))
    targets = contract.select("id").unionByName(rpcs).distinct()
    use = edges.filter(F.col("relation").isin("CONSUMES", "HTTP_CALLS")).join(targets, F.col("dst") == F.col("id"), "left_semi")
    first = use.groupBy("src").agg(F.min(F.struct("dst", "relation")).alias("first"))
    who = nodes.select(F.col("id").alias("src"), "name", "file", "line_no", F.substring("code", 1, 200).alias("code_snippet"))
    return first.join(who, "src", "left").select(F.col("src").alias("consumer_node"), F.coalesce("name", "src").alias("caller_name"), "file", F.col("line_no").alias("line"), service_of(F.coalesce("file", F.lit(""))).alias("service"), F.col("first.dst").alias("target_contract"), F.col("first.relation").alias("relation"), "code_snippet")


def bound_entities(edges: DataFrame, contract: DataFrame, relation: str) -> DataFrame:
    """(entity, contract) pairs that consume or implement the contracts or the rpcs of the services among them."""
    rpcs = edges.filter(F.col("relation") == "DEFINES_RPC").join(contract, F.col("src") == F.col("id"), "left_semi").select(F.col("dst").alias("id"))
    targets = contract.select("id").unionByName(rpcs).distinct()
    return edges.filter(F.col("relation") == relation).join(targets, F.col("dst") == F.col("id"), "left_semi").select(F.col("src").alias("entity"), F.col("dst").alias("contract"))


def contract_of(nodes: DataFrame, edges: DataFrame, symbol: DataFrame) -> DataFrame:
    """Contracts of symbols (id): (id, contract_node, role, relation, type, request_type, response_type, file)."""
    hold = {"IMPLEMENTS": "implements", "CONSUMES": "consumes", "HTTP_CALLS": "consumes"}
    out = edges.filter(F.col("relation").isin(*hold)).join(symbol, F.col("src") == F.col("id")).select("id", F.col("dst").alias("contract_node"), F.when(F.col("relation") == "IMPLEMENTS", "implements").otherwise("consumes").alias("role"), "relation")
    back = edges.filter(F.col("relation") == "IMPLEMENTS").join(symbol, F.col("dst") == F.col("id")).select("id", F.col("src").alias("contract_node"), F.lit("implements").alias("role"), F.lit("IMPLEMENTED_BY").alias("relation"))
    info = nodes.select(F.col("id").alias("contract_node"), *[F.col(c) for c in ("type", "request_type", "response_type", "file") if c in nodes.columns])
    return out.unionByName(back).join(info, "contract_node", "left")


def explain(edges: DataFrame) -> DataFrame:
    """Of each node the four sections: syntactic parents and children, dependencies out and in, dataflow variables, and
    semantic neighbours by falling similarity. One pass over incident edges."""
    out = edges.select(F.col("src").alias("id"), F.col("dst").alias("other"), "relation", "layer", "c_type", F.lit("out").alias("way"))
    back = edges.select(F.col("dst").alias("id"), F.col("src").alias("other"), "relation", "layer", "c_type", F.lit("in").alias("way"))
    both = out.unionByName(back.filter(F.col("layer").isin("Lsyn", "Ldep")))
    pick = lambda layer, way: F.sort_array(F.collect_list(F.when((F.col("layer") == layer) & (F.col("way") == way), F.struct("other", "relation"))))
    similar = F.sort_array(F.collect_list(F.when((F.col("layer") == "Lsem") & (F.col("way") == "out"), F.struct((-F.col("c_type")).alias("rank"), "other"))))
    return both.groupBy("id").agg(
        pick("Lsyn", "in").alias("parents"), pick("Lsyn", "out").alias("children"), pick("Ldep", "out").alias("outward_calls"), pick("Ldep", "in").alias("inward_callers"), pick("Lflow", "out").alias("variables"),
        F.transform(similar, lambda s: F.struct(s["other"].alias("target"), (-s["rank"]).alias("similarity"))).alias("similar"),
    )


def explain_pages(edges: DataFrame, size: int = 1000) -> DataFrame:
    """explain() in bounded rows: (id, section, page, items) with items of (other, relation, similarity) in the section's order,
    `size` to a page from 0. Rows are moved once, by ranges, and pages are cut from them as they come, so neither a task nor a row holds
    a hub's section whole."""
    way = lambda name, layer, own, other: edges.filter(F.col("layer") == layer).select(F.col(own).alias("id"), F.lit(name).alias("section"), F.col(other).alias("other"), "relation", F.when(F.lit(layer == "Lsem"), F.col("c_type")).alias("similarity"), "edge_id")
    sections = [way("parents", "Lsyn", "dst", "src"), way("children", "Lsyn", "src", "dst"), way("outward_calls", "Ldep", "src", "dst"), way("inward_callers", "Ldep", "dst", "src"), way("variables", "Lflow", "src", "dst"), way("similar", "Lsem", "src", "dst")]
    rows = functools.reduce(DataFrame.unionByName, sections).withColumn("least", -F.coalesce("similarity", F.lit(0.0)))
    keys = ["id", "section", "least", "other", "relation", "similarity"]
    made = stored(cut_pages(rows.repartitionByRange(*keys).sortWithinPartitions(*keys), size), "pages")
    # Only a section that ends a range of rows can go on in the next one; its pieces are counted on from range to range.
    ends = made.groupBy("task").agg(F.min_by(F.struct("id", "section"), "seq").alias("first"), F.max_by(F.struct("id", "section"), "seq").alias("last"))
    shared = F.broadcast(ends.select(F.explode(F.array("first", "last")).alias("k")).select("k.*").distinct())  # two for each task
    same = lambda other: made["id"].eqNullSafe(other["id"]) & (made["section"] == other["section"])
    whole = made.join(shared, same(shared), "left_anti").select("id", "section", "page", "items")
    pieces = running(made.join(shared, same(shared), "left_semi"), ["id", "section"], ["task", "seq"], F.size("items").cast("long"), "upto")
    each = pieces.select("id", "section", F.posexplode("items").alias("at", "item"), (F.col("upto") - F.size("items")).alias("before")).withColumn("place", F.col("before") + F.col("at"))
    joined = each.groupBy("id", "section", F.floor(F.col("place") / size).cast("int").alias("page")).agg(F.array_sort(F.collect_list(F.struct("place", "item"))).alias("items"))
    return whole.unionByName(joined.withColumn("items", F.transform("items", lambda x: x["item"])))


def cut_pages(rows: DataFrame, size: int) -> DataFrame:
    """(task, seq, id, section, page, items) of rows that tasks hold in order: each section of a task cut into pages of `size`, counted from
    its first row there. A task holds a batch of rows and the page that is not full."""
    items = T.ArrayType(T.StructType([T.StructField(c, rows.schema[c].dataType) for c in ("other", "relation", "similarity")]))
    schema = T.StructType([T.StructField("task", T.IntegerType()), T.StructField("seq", T.LongType()), *(rows.schema[c] for c in ("id", "section")), T.StructField("page", T.IntegerType()), T.StructField("items", items)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq, waiting, skip = TaskContext.get().partitionId(), 0, None, 0

        def cut(table: pa.Table, last: bool) -> tuple[pa.RecordBatch, pa.Table, int]:
            code = lambda c: table.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy()
            n, cols = table.num_rows, [code(c) for c in ("id", "section")]
            new = np.append(True, np.any([c[1:] != c[:-1] for c in cols], axis=0))
            place = np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0))
            place += np.where(np.cumsum(new) == 1, skip, 0)  # rows of the first section that went before
            starts = np.nonzero(new | (place % size == 0))[0]
            full = n if last else starts[-1]
            ends = np.append(starts if last else starts[:-1], full)
            at = pa.array(ends[:-1])
            item = pa.StructArray.from_arrays([table.column(c).slice(0, full) for c in ("other", "relation", "similarity")], ["other", "relation", "similarity"])
            out = [pa.array(np.full(len(at), task)), pa.array(np.arange(seq, seq + len(at))), table.column("id").take(at), table.column("section").take(at), pa.array(place[ends[:-1]] // size), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), item)]
            return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(out, arrow)], schema=arrow), table.slice(starts[-1]), int(place[starts[-1]])

        for batch in batches:
            if batch.num_rows:
                table = pa.RecordBatch.from_struct_array(pa.concat_arrays([x.to_struct_array() for x in (waiting, batch) if x is not None]))
                done, waiting, skip = cut(table, False)
                seq += done.num_rows
                yield done
        if waiting is not None:
            yield cut(waiting, True)[0]

    return rows.select("id", "section", "other", "relation", "similarity").mapInArrow(run, schema)


def explain_counts(edges: DataFrame) -> DataFrame:
    """Sizes of the sections of explain() for each node, by partial aggregation only."""
    flag = lambda layer: (F.col("layer") == layer).cast("long")
    out = edges.groupBy(F.col("src").alias("id")).agg(F.sum(flag("Lsyn")).alias("children"), F.sum(flag("Ldep")).alias("outward_calls"), F.sum(flag("Lflow")).alias("variables"), F.sum(flag("Lsem")).alias("similar"))
    back = edges.groupBy(F.col("dst").alias("id")).agg(F.sum(flag("Lsyn")).alias("parents"), F.sum(flag("Ldep")).alias("inward_callers"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.join(back, "id", "full").select("id", *[zero(c) for c in ("parents", "children", "outward_calls", "inward_callers", "variables", "similar")])


def subtree(edges: DataFrame | Adjacency, start: DataFrame, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """Grafted nodes (id, dist) and edges of an outward slice over calls, definitions, arguments and containment."""
    return within(edges, start, depth, DOWN, GRAFT_LAYERS, GRAFT_RELATIONS), adjacency(edges, start, GRAFT_LAYERS, DOWN, depth, GRAFT_RELATIONS)


def subtree_text(nodes: DataFrame, grafted: DataFrame) -> DataFrame:
    """One row (context): the code of the grafted nodes by id."""
    block = F.concat(F.lit("["), F.upper("type"), F.lit("] "), F.col("id"), F.lit(" (Line "), F.col("line_no").cast("string"), F.lit("):\n"), F.col("code"))
    with_code = nodes.join(grafted.select("id"), "id", "left_semi").filter("code <> ''")
    blocks = F.sort_array(F.collect_list(F.struct("id", block.alias("block"))))
    return with_code.agg(F.array_join(F.transform(blocks, lambda b: b["block"]), "\n\n").alias("context"))


def budget_selection(edges: DataFrame | Adjacency, start: DataFrame, layers: Sequence[str] | None = None, depth: int = 2) -> DataFrame:
    """Ids within depth of the start over dependencies outward and bindings inward."""
    if isinstance(edges, Adjacency):
        return _looked_up(edges, start, depth, [(DOWN, layers, BUDGET_OUT), (UP, layers, BUDGET_IN)])
    out = steps(edges, DOWN, layers, BUDGET_OUT)
    back = steps(edges, UP, layers, BUDGET_IN)
    return bfs(out.unionByName(back), start, depth)


def within_budget(blocks: DataFrame, order: Sequence[str], tokens: str, budget: float, used: float = 0.0, partition: Sequence[str] = ()) -> DataFrame:
    """Rows, in a total order, until the first whose tokens would exceed the budget. As tokens are not negative this is a bound
    on the running sum, which storage.running() makes without a task that holds a context. Give partition columns where
    there is more than one context to fill."""
    return running(blocks, partition, order, F.col(tokens), "running", budget - used)


def budget_blocks(nodes: DataFrame, selected: DataFrame) -> DataFrame:
    """(id, dist, block, tokens) of selected nodes; contracts without code show their signature."""
    e = lambda c: F.coalesce(F.col(c), F.lit(""))
    rpc = F.concat(F.lit("rpc "), e("name"), F.lit("("), e("request_type"), F.lit(") returns ("), e("response_type"), F.lit(")"))
    code = F.when((e("code") == "") & F.col("type").endswith("_contract"), rpc).otherwise(e("code"))
    block = F.concat(F.lit("--- ["), F.upper(e("type")), F.lit("] "), F.col("id"), F.lit(" ---\n"), F.substring(code, 1, 400))
    focus = F.concat(F.lit("=== TARGET FOCUS ["), F.upper(e("type")), F.lit("] "), F.col("id"), F.lit(" ===\nFile: "), e("file"), F.lit(":"), F.coalesce(F.col("line_no").cast("string"), F.lit("?")), F.lit("\nDocstring: "), e("docstring"), F.lit("\n"), F.when(e("code") != "", F.col("code")).otherwise(F.concat(F.lit("# Symbol: "), e("name"), F.lit(" (type: "), e("type"), F.lit(")"))))
    rows = nodes.join(selected, "id").withColumn("block", F.when(F.col("dist") == 0, focus).otherwise(block))
    return rows.select("id", "dist", "block", approx_tokens(F.col("block")).alias("tokens"))


def budget_graft(nodes: DataFrame, edges: DataFrame | Adjacency, start: DataFrame, max_tokens: int = 2048, layers: Sequence[str] | None = None) -> DataFrame:
    """Blocks of a token-budgeted context: the root always, then neighbours by id while they fit. (id, block, tokens, running)"""
    blocks = stored(budget_blocks(nodes, budget_selection(edges, start, layers)).withColumn("other", F.col("dist") != 0), "blocks")
    # The roots are kept whatever their size, so what they use leaves the budget of the rest.
    roots = running(blocks.filter("not other"), [], ["id"], F.col("tokens"), "running")
    used = roots.agg(F.coalesce(F.max("running"), F.lit(0.0))).first()[0]
    rest = within_budget(blocks.filter("other"), ["id"], "tokens", max_tokens, used).withColumn("running", F.col("running") + used)
    return roots.unionByName(rest).drop("other")


def ast_graft(edges: DataFrame | Adjacency, start: DataFrame, depth: int = 2) -> DataFrame:
    """Baseline: nodes within depth over containment, both ways."""
    return within(edges, start, depth, BOTH, None, ("CONTAINS",))


#: Edges of one side of a middle node that a task of two_hop_pairs holds.
SIDE = 2000


def two_hop_pairs(pairs: DataFrame, side: int = SIDE) -> DataFrame:
    """Distinct (src, dst) joined by one edge or by two.

    A middle node with many edges on both sides makes their product. Its incoming and outgoing edges are dealt to parts of
    about `side`, each incoming part meets each outgoing part in a key of its own, and light nodes have one part each.
    """
    base = pairs.select("src", "dst").distinct()
    into = base.groupBy(F.col("dst").alias("mid")).agg(F.ceil(F.count(F.lit(1)) / side).alias("ins"))
    out = base.groupBy(F.col("src").alias("mid")).agg(F.ceil(F.count(F.lit(1)) / side).alias("outs"))
    parts = into.join(out, "mid")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = base.select("src", F.col("dst").alias("mid")).join(parts, "mid").withColumns({"i": F.pmod(F.xxhash64("src"), F.col("ins")), "o": each("outs")})
    right = base.select(F.col("src").alias("mid"), "dst").join(parts, "mid").withColumns({"o": F.pmod(F.xxhash64("dst"), F.col("outs")), "i": each("ins")})
    second = left.select("src", "mid", "i", "o").join(right.select("mid", "i", "o", "dst"), ["mid", "i", "o"]).select("src", "dst")
    return base.unionByName(second).distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree) of all nodes; a self-loop counts twice."""
    ends = edges.select(F.col("src").alias("id")).unionAll(edges.select(F.col("dst").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("id").join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def isolates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges, nodes["id"] == edges["src"], "left_anti").join(edges, nodes["id"] == edges["dst"], "left_anti")


def overview(nodes: DataFrame, edges: DataFrame, keep: int = 450, large: int = 600, max_edges: int = 800, core: Sequence[str] = ("file", "class", "module")) -> tuple[DataFrame, DataFrame]:
    """A display subgraph: above `large` nodes variables go; above `keep`, files, classes and modules stay first and the
    rest fills up by falling degree. Edges among them, `max_edges` at most."""
    shown = nodes
    if nodes.limit(large + 1).count() > large:
        shown = nodes.filter(F.col("type") != "variable")
    ranked = shown.join(degrees(nodes, edges), "id").withColumn("tier", F.when(F.col("type").isin(*core), 0).otherwise(1))
    best = ranked.orderBy("tier", F.desc("degree"), "id").limit(keep)
    inside = edges.join(F.broadcast(best.select(F.col("id").alias("src"))), "src", "left_semi").join(F.broadcast(best.select(F.col("id").alias("dst"))), "dst", "left_semi")
    return best, inside.orderBy("src", "dst", "relation", *(["edge_id"] if "edge_id" in edges.columns else [])).limit(max_edges)
