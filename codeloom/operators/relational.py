"""Aggregates, set operations and window-like operators (A, U, W) over graphs and facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.similarity import sequence_ratio
from codeloom.schema import LAYERS


def call_frequency(calls: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Call sites with the same key as one row with f_call."""
    return calls.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("f_call"))


def histogram(rows: DataFrame, column: str, domain: Sequence[str]) -> DataFrame:
    """(column, n) over a fixed domain, zeros kept. The domain joins as literals."""
    keys = rows.sparkSession.createDataFrame([(d,) for d in domain], f"{column} string")
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(keys).join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def layer_histogram(edges: DataFrame, missing: str | None = None) -> DataFrame:
    rows = edges.withColumn("layer", F.coalesce("layer", F.lit(missing))) if missing else edges
    return histogram(rows, "layer", LAYERS)


def count_where(condition: Column) -> Column:
    return F.coalesce(F.count_if(condition), F.lit(0)).cast("long")


def verify(nodes: DataFrame, edges: DataFrame, services: int | None = None) -> DataFrame:
    """One row of counts and rates over a graph; a rate over nothing is 100 for calls and 0 for docstrings."""
    calls = F.col("relation") == "CALLS"
    e = edges.agg(
        F.count(F.lit(1)).alias("total_edges"), *[count_where(F.col("layer") == layer).alias(f"edges_{layer.lower()}") for layer in LAYERS], count_where(calls).alias("total_calls"),
        count_where(calls & F.col("dst").startswith("external::")).alias("external_library_calls"), count_where(F.col("relation") == "IMPLEMENTS").alias("contract_producer_edges"), count_where(F.col("relation") == "CONSUMES").alias("contract_consumer_edges"),
    )
    n = nodes.agg(F.count(F.lit(1)).alias("total_nodes"), count_where(F.col("type") == "variable").alias("variable_nodes_count"), count_where(F.col("type").isin("function", "class")).alias("symbols"), count_where(F.coalesce("docstring", F.lit("")) != "").alias("documented"), count_where(F.col("type") == "service_contract").alias("contract_services"))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    lone = nodes.join(ends, "id", "left_anti").agg(F.count(F.lit(1)).alias("isolated_nodes_count"))
    linked = def_use(edges).agg(F.count(F.lit(1)).alias("dataflow_def_use_linked_vars"))
    one = e.crossJoin(F.broadcast(n)).crossJoin(F.broadcast(lone)).crossJoin(F.broadcast(linked))  # four tables of one row
    rate = F.when(F.col("total_calls") > 0, (F.col("total_calls") - F.col("external_library_calls")) * 100.0 / F.col("total_calls")).otherwise(100.0)
    doc = F.when(F.col("symbols") > 0, F.col("documented") * 100.0 / F.col("symbols")).otherwise(0.0)
    full = F.least(*[F.col(f"edges_{layer.lower()}") for layer in LAYERS]) > 0
    return one.withColumns({"internal_resolved_calls": F.col("total_calls") - F.col("external_library_calls"), "call_graph_resolution_rate_pct": F.round(rate, 2), "docstring_coverage_pct": F.round(doc, 2), "health_status": F.when(full, "all layers populated").otherwise("structure verified")})


def def_use(edges: DataFrame) -> DataFrame:
    """Variables that are both defined or passed and used."""
    defined = edges.filter(F.col("relation").isin("DEFINES", "PASSES_ARG")).select(F.col("dst").alias("id"))
    return defined.intersect(edges.filter(F.col("relation") == "USES").select(F.col("dst").alias("id")))


def verify_workspace(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, nodes, edges out, implements, consumes, http_calls): a summary for each repository."""
    n = nodes.groupBy("repo").agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct(F.when(F.col("skew"), F.col("id"))).alias("skewed"))
    home = nodes.select(F.col("id").alias("src"), "repo")
    e = edges.join(home, "src").groupBy("repo").agg(F.count(F.lit(1)).alias("edges"), *[count_where(F.col("relation") == r).alias(r.lower()) for r in ("IMPLEMENTS", "CONSUMES", "HTTP_CALLS")])
    return n.join(e, "repo", "left").na.fill(0)


def divergence(definitions: DataFrame, key: Sequence[str], owner: str, values: Sequence[str]) -> DataFrame:
    """Keys with two definitions or more that differ in one of the values across owners: (key, definitions, owners, one
    distinct count for each value)."""
    agg = definitions.groupBy(*key).agg(F.count(F.lit(1)).alias("definitions"), F.count_distinct(owner).alias("owners"), *[F.count_distinct(v).alias(f"distinct_{v}") for v in values])
    differs = F.lit(False)
    for v in values:
        differs = differs | (F.col(f"distinct_{v}") > 1)
    return agg.filter((F.col("definitions") > 1) & differs)


def first_wins(tables: Sequence[DataFrame], key: str = "id") -> DataFrame:
    """Union in which the first table that has a key gives its row."""
    if not tables:
        raise ValueError("no tables")
    cols = tables[0].columns
    all_rows = None
    for rank, t in enumerate(tables):
        t = t.select(*cols).withColumn("_rank", F.lit(rank))
        all_rows = t if all_rows is None else all_rows.unionByName(t)
    best = all_rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in cols if c != key]), "_rank").alias("row"))
    return best.select(*[F.col(key) if c == key else F.col(f"row.{c}").alias(c) for c in cols])


def lost(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.subtract(after)


def collisions(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    return a.select(key).intersect(b.select(key))


def share(rows: DataFrame, partition: Sequence[str], name: str = "confidence") -> DataFrame:
    """1 / k for each of the k rows of a partition."""
    return rows.withColumn(name, 1.0 / F.count(F.lit(1)).over(Window.partitionBy(*partition)))


def first_rule(candidates: DataFrame, partition: Sequence[str], priority: str) -> DataFrame:
    """Candidates of the first rule that has any: the rows with the least priority of each partition."""
    return candidates.withColumn("_r", F.rank().over(Window.partitionBy(*partition).orderBy(priority))).filter("_r = 1").drop("_r")


def best(candidates: DataFrame, partition: Sequence[str], score: str, tie: Sequence[str]) -> DataFrame:
    """The best-scored row of each partition; ties by the given columns."""
    w = Window.partitionBy(*partition).orderBy(F.desc(score), *tie)
    return candidates.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def renames(lost: DataFrame, names: DataFrame, group: Sequence[str]) -> DataFrame:
    """(*group, old, candidate, score): for each distinct lost name (*group, old) the most similar one of names (*group, candidate)."""
    pairs = lost.distinct().join(names.distinct(), list(group))
    return best(pairs.withColumn("score", F.round(sequence_ratio("old", "candidate"), 2)), [*group, "old"], "score", ["candidate"])


def max_normal(rows: DataFrame, column: str) -> DataFrame:
    """column over its maximum, or over 1 if that is not positive."""
    top = rows.agg(F.max(column).alias("_top"))
    return rows.crossJoin(F.broadcast(top)).withColumn(column, F.col(column) / F.when(F.col("_top") > 0, F.col("_top")).otherwise(1.0)).drop("_top")
