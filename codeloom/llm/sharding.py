"""Operator 4: weighted rendezvous hashing of stable record keys over shards.

Each (key, shard) pair has a uniform number u in (0, 1) from MD5; a row goes to the shard with the largest
-weight / ln(u). A new shard only takes rows that score highest there, so growth moves rows into it and nowhere else.
Everything is a DataFrame expression; the only shuffle is the one that numbers the rows of a shard.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.llm.common import read_table, text_bytes

#: Rows of one shard that one window partition numbers, on average.
ROWS_PER_BUCKET = 20_000


def uniform52(key: Column, shard: int) -> Column:
    """52 bits of MD5('key:shard') as a long; a null key hashes as an empty one."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{shard}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key. Equal scores go to the lower shard; a shard of weight 0 takes nothing."""
    if not weights or max(weights) <= 0 or min(weights) < 0:
        raise ValueError("weights must be non-negative, one at least positive")
    live = [(s, float(w)) for s, w in enumerate(weights) if w > 0]
    if len({w for _, w in live}) == 1:  # with equal weights the score only orders u itself
        scored = [F.struct(uniform52(key, s).alias("score"), F.lit(-s).alias("s")) for s, _ in live]
    else:
        scored = [F.struct((-F.lit(w) / F.log((uniform52(key, s) + 0.5) / float(1 << 52))).alias("score"), F.lit(-s).alias("s")) for s, w in live]
    best = F.greatest(*scored) if len(scored) > 1 else scored[0]
    return (-best["s"]).cast("int")


def shard_rows(docs: DataFrame, weights: Sequence[float], id_col: str = "doc_id", text_col: str = "text", grown_weight: float = 1.0) -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard.

    size is the UTF-8 bytes of the text plus 1 (null text: 1). slot numbers the rows of a shard from 0 without gaps:
    hash buckets of bounded size are numbered apart and shifted by the rows of the buckets before them, so no task holds
    a shard. Null ids share one key and one shard; repeated ids share a shard and get different slots. An empty table
    gives no rows; further columns are not read. grown_shard is the shard after one more of grown_weight is added.
    """
    key = F.col(id_col).cast("long")
    rows = docs.select(
        key.alias("id"),
        (text_bytes(F.col(text_col).cast("string")) + 1).alias("size"),
        F.crc32(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")).alias("text_crc32"),
        rendezvous(key, weights).alias("shard"),
        rendezvous(key, [*weights, grown_weight]).alias("grown_shard"),
    )
    n = docs.select(F.lit(1)).count()
    buckets = max(1, -(-n // (ROWS_PER_BUCKET * max(1, len(weights)))))
    # Repeated ids may be hot, so the bucket also depends on the content.
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("id", "text_crc32", "size"), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("id", "text_crc32", "size")) - 1
    numbered = rows.withColumn("within", within).join(offsets, ["shard", "bucket"])
    return numbered.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("within")).cast("long").alias("slot"), "grown_shard")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(read_table(spark, sf_dir, "documents"), [1.0] * 8)


def oracle() -> str:
    def best(n: int) -> str:
        u = [f"CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':{s}'), 1, 13) AS BIGINT)" for s in range(n)]
        return f"CAST(list_position([{', '.join(u)}], greatest({', '.join(u)})) - 1 AS INTEGER)"

    # CRC-32 (reflected polynomial 0xEDB88320): a table entry is eight shift-and-xor steps on its index.
    entry = "list_reduce(list_prepend(CAST(i AS BIGINT), [CAST(0 AS BIGINT) FOR _ IN range(8)]), lambda a, _: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)"
    return f"""
WITH tbl AS (SELECT list({entry} ORDER BY i) AS t FROM range(256) r(i)),
d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
h AS (SELECT doc_id, octet_length(b) AS n, hex(b) AS x FROM d),
c AS (SELECT doc_id, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST('0x' || substr(x, 2 * k + 1, 2) AS BIGINT) FOR k IN range(n)]),
             lambda a, v: xor(a >> 8, t[(xor(a, v) & 255) + 1])), 4294967295) AS crc FROM h, tbl),
s AS (SELECT doc_id, CAST(n + 1 AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, {best(8)} AS shard, {best(9)} AS grown_shard FROM c)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, grown_shard FROM s
"""
