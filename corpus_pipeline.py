"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

run(spark, sf_dir) applies STAGES to the documents table. Files go to the folder in spark.checkpoint.dir.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import fresh, join_on_hot_key, read_table, stored
from codeloom.llm.decontaminate import OUTPUTS, contaminated, find_benchmark
from codeloom.llm.exact_dedup import first_copies, located_rows
from codeloom.llm.jaccard_join import jaccard_components
from codeloom.llm.language_id import UNKNOWN, identify, train, with_letter
from codeloom.llm.piece_codec import encoded


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in one of the learned languages: those without a letter, null texts among them, go. If no row has a
    language to learn from (all null or 'und'), every document with a letter stays."""
    model = train(docs)
    if not model.languages:
        return with_letter(docs)
    lang, score = fresh("_lang", docs.columns), fresh("_score", docs.columns)
    kept = identify(docs, model, pred_col=lang, score_col=score).filter(F.col(lang) != UNKNOWN)
    return kept.drop(lang, score)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised texts, keeps the one with the smallest id."""
    return first_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that near-duplicate links connect, keeps the row with the smallest id, null ids last; of repeated rows
    with that id, the one that comes first by file and row. Rows are told apart by file and row, not by id."""
    _, located, (file, row) = located_rows(docs)
    files = sorted(r[0] for r in located.select(file).distinct().collect())
    number, key = fresh("_number", docs.columns), fresh("_key", docs.columns)
    numbers = F.broadcast(spark.createDataFrame(list(enumerate(files)), f"{number} long, {file} string"))
    keyed = located.join(numbers, file).withColumn(key, F.shiftleft(number, 40) + F.col(row))
    slim = keyed.select(F.col(key).alias("key"), "doc_id", "text")
    found = jaccard_components(slim, "key").filter(F.col("key") != F.col("component_id"))
    linked = stored(found.select("key", F.col("component_id").alias("group")), "linked")
    heads = linked.select(F.col("group").alias("key"), "group").distinct()
    order = F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id").alias("id"), F.col("key").alias("key"))
    members = stored(linked.unionByName(heads).join(slim.select("key", order.alias("order")), "key"), "members")
    least = members.groupBy("group").agg(F.min("order").alias("least"), F.count(F.lit(1)).alias("n"))
    gone = join_on_hot_key(members, least, "group", "n", max(1, members.count())).filter(F.col("order.key") != F.col("least.key")).select(F.col("key").alias(key))
    return keyed.join(gone, key, "left_anti").select(*(f"`{c}`" for c in docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that are not contaminated with benchmark passages."""
    prefix = "_"
    while {f"{prefix}{c}" for c in OUTPUTS} & {c.lower() for c in docs.columns}:
        prefix += "_"
    found = find_benchmark(docs, read_table(spark, sf_dir, "benchmark"), prefix=prefix)
    clean = found.filter(~contaminated(F.col(f"{prefix}n_words"), F.col(f"{prefix}n_hit")))
    return clean.drop(*(f"{prefix}{c}" for c in OUTPUTS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip of each document that is left."""
    return encoded(docs)


STAGES = [("language", language), ("exact", exact), ("near", near), ("decontaminated", decontaminated), ("tokens", tokens)]

#: The language stage is a trained model and the last stage a tokenizer; SQL has neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
