"""Names to nodes (J16 to J18): prioritised filters, the first by rule and node order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.grams import GramIndex

#: What an index of nodes holds of each: all that the rules compare with a name.
NODE_TEXT = "concat(id, '\n', coalesce(name, ''))"


def _first(candidates: DataFrame, k: int = 1) -> DataFrame:
    return candidates.orderBy("rule", "ord", "id").limit(k).select("id")


def _among(nodes: DataFrame, text: str, index: GramIndex | None) -> DataFrame:
    """nodes that may hold the text: by an index of NODE_TEXT, those that it names."""
    found = index.candidates(text) if index is not None else None
    return nodes if found is None else nodes.join(found, "id", "left_semi")


def by_name(nodes: DataFrame, name: str, index: GramIndex | None = None) -> DataFrame:
    """J16. The node with that id, a contract of that name, the first symbol, or the first id that ends in the name after
    :: or a dot or holds it after a colon."""
    rule = (
        F.when(F.col("id") == name, 1).when(F.col("id") == f"contract::{name}", 2)
        .when((F.col("name") == name) & F.col("type").isin("function", "class", "type"), 3)
        .when(F.col("id").endswith(f"::{name}") | F.col("id").endswith(f".{name}") | F.contains("id", F.lit(f":{name}")), 4)
    )
    return _first(_among(nodes, name, index).select("id", "ord", rule.alias("rule")).filter("rule is not null"))


def fuzzy(nodes: DataFrame, text: str, ignore_case: bool = False, index: GramIndex | None = None) -> DataFrame:
    """J17. The node with that id, else the first whose id contains the text."""
    id_, t = (F.lower("id"), text.lower()) if ignore_case else (F.col("id"), text)
    rule = F.when(F.col("id") == text, 1).when(F.contains(id_, F.lit(t)), 2)
    return _first(_among(nodes, text, index).select("id", "ord", rule.alias("rule")).filter("rule is not null"))


def contract(nodes: DataFrame, name: str, index: GramIndex | None = None) -> DataFrame:
    """J18. The contract with that id or name, else an rpc of that name in any case."""
    bare = F.element_at(F.split("id", r"\."), -1)
    rule = F.when(F.col("id") == name, 1).when(F.col("id") == f"contract::{name}", 2).when((F.col("type") == "rpc_contract") & (F.lower(bare) == name.lower()), 3)
    return _first(_among(nodes, name, index).select("id", "ord", "type", rule.alias("rule")).filter("rule is not null"))
