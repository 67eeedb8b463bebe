"""Evaluation metrics (M1 to M4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators.traverse import two_hop_pairs


def ranked_retrieval(hits: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """One row (queries, mrr, hits1, hitsk): hits (query, id, rank), relevant (query, id); percentages of all queries."""
    first = hits.filter(F.col("rank") <= k).join(relevant, ["query", "id"]).groupBy("query").agg(F.min("rank").alias("first"))
    per = relevant.select("query").distinct().join(first, "query", "left")
    pct = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)) * 100, 1)
    return per.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 4).alias("mrr"), pct(F.col("first") == 1).alias("hits1"), pct(F.col("first").isNotNull()).alias("hitsk"))


def rank_hits(scores: DataFrame) -> DataFrame:
    """(query, id, rank) of (query, id, score), ties by id."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).select("query", "id", "rank")


def set_quality(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row (tp, found, truth, precision, recall, f1) of two sets of equal columns; an empty side counts as 0."""
    cols = truth.columns
    f, t = found.select(*cols).distinct(), truth.distinct()
    tp = f.intersect(t).agg(F.count(F.lit(1)).alias("tp"))
    counts = tp.crossJoin(F.broadcast(f.agg(F.count(F.lit(1)).alias("found")))).crossJoin(F.broadcast(t.agg(F.count(F.lit(1)).alias("truth"))))  # one row each
    p = F.when(F.col("found") > 0, F.col("tp") / F.col("found")).otherwise(0.0)
    r = F.when(F.col("truth") > 0, F.col("tp") / F.col("truth")).otherwise(0.0)
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return counts.select("tp", "found", "truth", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f1, 4).alias("f1"))


def label_quality(bindings: DataFrame, labels: DataFrame) -> DataFrame:
    """Precision and recall of bindings (entity, contract) against labels (entity, contract) that name a part of the
    entity. Labels are joined on their contract, so only bindings of that contract are compared."""
    pairs = labels.select(F.col("entity").alias("label"), "contract").join(bindings, "contract").filter(F.contains("entity", F.col("label")))
    tp_l = pairs.select("label", "contract").distinct().agg(F.count(F.lit(1)).alias("matched_labels"))
    tp_b = pairs.select("entity", "contract").distinct().agg(F.count(F.lit(1)).alias("matched_bindings"))
    n = labels.agg(F.count(F.lit(1)).alias("labels")).crossJoin(F.broadcast(bindings.distinct().agg(F.count(F.lit(1)).alias("bindings"))))
    one = n.crossJoin(F.broadcast(tp_l)).crossJoin(F.broadcast(tp_b))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 4)).otherwise(0.0)
    return one.select("labels", "bindings", ratio("matched_bindings", "bindings").alias("precision"), ratio("matched_labels", "labels").alias("recall"))


def context_recall(context: DataFrame, required: DataFrame) -> DataFrame:
    """(query, required, covered, recall): required (query, id) that a query's context (query, id) holds."""
    hit = required.join(context, ["query", "id"], "left_semi").groupBy("query").agg(F.count(F.lit(1)).alias("covered"))
    return required.groupBy("query").agg(F.count(F.lit(1)).alias("required")).join(hit, "query", "left").select("query", "required", F.coalesce("covered", F.lit(0)).alias("covered"), F.round(F.coalesce("covered", F.lit(0)) / F.col("required"), 4).alias("recall"))


def token_ratio(contexts: DataFrame, whole: DataFrame) -> DataFrame:
    """One row (queries, tokens, baseline, ratio): tokens of the contexts (query, tokens) of all queries as a percentage of those of
    the baseline (query, tokens); a query without a context has none. An empty baseline gives 0."""
    rows = whole.select("query", F.col("tokens").alias("b")).join(contexts.select("query", "tokens"), "query", "left")
    sums = rows.agg(F.count(F.lit(1)).alias("queries"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("b"), F.lit(0)).alias("baseline"))
    return sums.withColumn("ratio", F.when(F.col("baseline") > 0, F.round(F.col("tokens") * 100.0 / F.col("baseline"), 1)).otherwise(0.0))


def layer_ablation(edges: DataFrame, recall_of, layers=("Lsyn", "Ldep", "Lflow", "Lsem", "Lcontract")) -> dict[str, float]:
    """Change of a recall figure when one layer's edges are missing. recall_of maps edges to a number."""
    full = recall_of(edges)
    return {layer: recall_of(edges.filter(F.col("layer") != layer)) - full for layer in layers}


def trace_quality(static: DataFrame, dynamic: DataFrame) -> DataFrame:
    """Static against observed call pairs (src, dst): direct, and within two hops (prefix hop2_)."""
    direct = set_quality(static, dynamic)
    hop2 = set_quality(two_hop_pairs(static), two_hop_pairs(dynamic)).select(*[F.col(c).alias(f"hop2_{c}") for c in ("tp", "precision", "recall", "f1")])
    return direct.crossJoin(F.broadcast(hop2))
