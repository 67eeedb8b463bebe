"""Similarity joins of dense vectors in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.storage import stored

#: Vectors in one block. A task multiplies two blocks at a time, in slices of SLICE rows of the first.
BLOCK, SLICE = 2048, 256


def block_of(ids: pa.Array, vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids and the matrix of their vectors from Arrow's buffers, without a Python object for each number."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return ids.to_numpy(zero_copy_only=False), flat.reshape(len(ids), len(flat) // max(1, len(ids)))


def blocks_of(rows: DataFrame, id_col: str, vector_col: str, block: int) -> DataFrame:
    """(block, part, n, ids, vectors): the rows of a task packed into blocks as bytes, stored. Vectors keep their type. A task numbers
    its blocks after its own number, so no row is moved."""
    kind = rows.schema[vector_col].dataType.elementType.simpleString()
    kept = kind if kind in ("float", "double") else "double"
    packed = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{kept}>").alias("v")).filter("id is not null and v is not null")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, waiting, n = TaskContext.get().partitionId() << 32, [], 0

        def packs(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal first, waiting, n
            while n and n >= least:
                table = pa.Table.from_batches(waiting)
                head = table.slice(0, block).combine_chunks()
                waiting, n = table.slice(block).to_batches(), max(0, n - block)
                ids, vectors = block_of(*(head.column(c).combine_chunks() for c in ("id", "v")))
                yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([len(ids)]), pa.array([ids.tobytes()]), pa.array([vectors.tobytes()])], ["block", "n", "ids", "vectors"])
                first += 1

        for batch in batches:
            waiting, n = [*waiting, batch], n + batch.num_rows
            yield from packs(block)
        yield from packs(0)

    return stored(packed.mapInArrow(pack, "block long, n long, ids binary, vectors binary"), f"blocks-{kept}")


def dense_pairs(rows: DataFrame, id_col: str, vector_col: str, threshold: float, block: int = BLOCK) -> DataFrame:
    """(a, b, score), a < b, of vectors whose dot product, in double precision, is at least threshold.

    Exact. Vectors are packed into blocks, which are stored once; a task reads the blocks of two parts of that table, and of every
    two blocks makes one matrix product, of which only pairs at the threshold leave it. Nothing is shuffled: the time grows with
    the square of the rows, but the disk with the rows alone.
    """
    blocks = blocks_of(rows, id_col, vector_col, block)
    kind = rows.schema[vector_col].dataType.elementType.simpleString()
    number = np.float32 if kind == "float" else np.float64
    side = lambda p: blocks.select(*[F.col(c).alias(f"{p}_{c}") for c in blocks.columns])
    # Of two blocks either may be the first; taking turns, all tasks have as much to do.
    turn = (F.col("l_block") < F.col("r_block")) == (F.pmod(F.col("l_block") + F.col("r_block"), F.lit(2)) == 0)
    pairs = side("l").join(side("r"), (F.col("l_block") == F.col("r_block")) | ((F.col("l_block") != F.col("r_block")) & turn))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read(batch: pa.RecordBatch, row: int, at: int) -> tuple[np.ndarray, np.ndarray]:
            n, ids, vectors = (batch.column(c)[row] for c in range(at + 1, at + 4))
            return np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(vectors.as_buffer(), number).reshape(n.as_py(), -1).astype(np.float64)

        for batch in batches:
            for row in range(batch.num_rows):
                same = batch.column(0)[row].as_py() == batch.column(4)[row].as_py()
                (li, lv), (ri, rv) = read(batch, row, 0), read(batch, row, 4)
                for start in range(0, len(li), SLICE):
                    ids = li[start : start + SLICE]
                    scores = lv[start : start + SLICE] @ rv.T
                    x, y = np.nonzero(scores >= threshold)
                    keep = ids[x] < ri[y] if same else ids[x] != ri[y]
                    x, y = x[keep], y[keep]
                    a, b = np.minimum(ids[x], ri[y]), np.maximum(ids[x], ri[y])
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(scores[x, y])], ["a", "b", "score"])

    return pairs.mapInArrow(products, "a long, b long, score double")
