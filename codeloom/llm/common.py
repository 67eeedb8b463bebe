"""Helpers shared by the training-data operators: shared storage, UTF-8 access, block layout, hot-key joins."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A digest or cluster with more than 1/HOT_SHARE of all rows is hot; there are fewer than HOT_SHARE such keys.
HOT_SHARE = 64
#: UTF-8 bytes of text in one block, so that a worker's tables for a block stay at tens of MB. A longer document is a
#: block of its own.
BLOCK_BYTES = 1_900_000
#: Null ids sort after every other id.
NULL_ID = np.iinfo(np.int64).max


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir as the cluster names it. Where it is unset, a local master gets
    a new local folder; on a cluster, whose machines would each write to their own, it is an error."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="codeloom-"))
        base = sc.getCheckpointDir()
    return base.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/codeloom/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df written to the shared folder and read back: its lineage is cut and lost executors cost nothing that is not on disk."""
    path = work_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Frees disk that later steps do not need: the files of tables made by stored(), and shuffle files of plans that
    nothing refers to any more, which Spark deletes once the driver's heap is collected. Call it only when what was made
    from them is stored itself."""
    for t in tables:
        for folder in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(name: str, taken: list[str]) -> str:
    """name, with underscores before it until no column of `taken` has it; Spark's names do not tell cases apart."""
    known = {c.lower() for c in taken}
    while name.lower() in known:
        name = "_" + name
    return name


def with_outputs(docs: DataFrame, outputs: str) -> tuple[list[int], T.StructType]:
    """Positions of the columns of docs that stay, and the schema of those followed by outputs (a DDL string). A column of
    docs with the name of an output gives way to it."""
    made = T.StructType.fromDDL(outputs)
    names = {f.name.lower() for f in made}
    kept = [i for i, c in enumerate(docs.columns) if c.lower() not in names]
    return kept, T.StructType([*(docs.schema.fields[i] for i in kept), *made.fields])


def text_bytes(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long")


def crc_of_id(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_on_hot_key(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with table (unique by key), where a few keys may hold most rows.

    A key whose weight exceeds total / HOT_SHARE goes by broadcast; fewer than HOT_SHARE keys can, whatever the size of
    the input. All other keys go by a shuffled join, in which no key has more than total / HOT_SHARE rows.
    """
    limit = max(total // HOT_SHARE, 1)
    hot = table.filter(F.col(weight) > limit)
    keys = [r[0] for r in hot.select(key).limit(HOT_SHARE).collect()]
    if not keys:
        return rows.join(table, key, how)
    is_hot = F.coalesce(F.col(key).isin(keys), F.lit(False))
    return rows.filter(~is_hot).join(table.filter(~is_hot), key, how).unionByName(rows.filter(is_hot).join(F.broadcast(hot), key, how))


BLOCK_SCHEMA = "block long, ids binary, ends binary, text binary"


def _pack(ids: list, parts: list[bytes]) -> tuple[int, bytes, bytes, bytes]:
    ids_a = np.array([NULL_ID if i is None else i for i in ids], np.int64)
    ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
    text = b"".join(parts)
    return ids_a.tobytes(), ends.tobytes(), zstandard.ZstdCompressor(level=1).compress(text)


def blocks_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents packed into blocks, written once to the shared folder: (block, ids, ends, text).

    ids and ends are int64 arrays, text is the zstd-compressed concatenation of the documents' UTF-8 bytes; null text is
    empty. Every document is in exactly one block. Operators that need the text twice reread blocks, which are smaller
    than the texts and have a key that later steps can join on.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, size = [], [], 0

        def out():
            a, e, t = _pack(ids, parts)
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65]), pa.array([a]), pa.array([e]), pa.array([t])], ["block", "ids", "ends", "text"])

        for batch in batches:
            for i, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                b = b or b""
                if parts and size + len(b) > block_bytes:
                    yield out()
                    ids, parts, size = [], [], 0
                ids.append(i)
                parts.append(b)
                size += len(b)
        if parts:
            yield out()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return stored(rows.mapInArrow(pack, BLOCK_SCHEMA), "blocks", "uncompressed")


def unpack(ids: bytes, ends: bytes, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, starts (with one more entry: the end of the last document) and the bytes of a block."""
    e = np.frombuffer(ends, np.int64)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(text) if text else b"", np.uint8)
    return np.frombuffer(ids, np.int64), np.concatenate([np.zeros(1, np.int64), e]), raw


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in batch.columns)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads all bits (splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
