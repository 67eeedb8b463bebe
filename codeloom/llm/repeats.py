"""Which keys of which blocks occur in more than one document, over all blocks.

Every block sends its distinct keys as packed arrays to hash buckets, one entry for each key however many of its
documents hold it; a bucket sums the document counts and answers each block with the keys that occur in two documents or
more. Hot keys cost one entry for each block; the number of buckets grows with the data, so a bucket stays bounded.

Document counts travel as one byte each, exact up to 127 and rounded down by less than a tenth above (see coded).

Keys travel as a bucket number of `bits` bits and a 32-bit fingerprint. Two keys that share both are taken for one and
may be reported as repeated: an answer can hold too many keys, never too few.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import rows_of, unpack

#: Keys that one bucket gets, on average.
BUCKET_KEYS = 400_000
#: (ids, starts, raw, and any further column of the blocks as an int64 array) of a block to keys and the number of its documents that hold each, both by ascending key.
KeysOf = Callable[..., tuple[np.ndarray, np.ndarray]]


def bucket_bits(total_keys: int) -> int:
    return max(7, min(24, (max(1, total_keys) // BUCKET_KEYS).bit_length()))


def prefixes(keys: np.ndarray, bits: int) -> np.ndarray:
    """Bucket and fingerprint of keys as one integer."""
    return keys >> np.uint64(32 - bits)


#: Counts that the codes 0 to 255 stand for: exact up to 127, then eight to an octave, up to 7.7 million.
CODES = np.r_[np.arange(128), np.ceil(128 * 2 ** (np.arange(128) / 8))].astype(np.int64)


def coded(n: np.ndarray) -> np.ndarray:
    """The uint8 code of each count, whose value in CODES is the largest that is not above it."""
    return (np.searchsorted(CODES, n, "right") - 1).astype(np.uint8)


def repeated_keys(blocks: DataFrame, keys_of: KeysOf, bits: int, hot: int | None = None, packed: bool = True) -> DataFrame:
    """(block, found): for each block with any, a list of structs (bucket, prints, counts) of its repeated keys.

    prints: ascending uint32 fingerprints; counts: uint8 numbers of documents, up to 255. With `hot`, a row with a null
    block lists the keys that blocks count more than `hot` times together. Not packed: keys_of gets the columns after
    block as they are.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, *own in rows_of(batches):
            keys, n = keys_of(*unpack(*own[:3]), *(np.array(x or [], np.int64) for x in own[3:])) if packed else keys_of(*own)
            fp = prefixes(keys, bits)
            if not len(fp):
                continue
            head = np.flatnonzero(np.r_[True, fp[1:] != fp[:-1]])
            fp, n = fp[head], coded(np.add.reduceat(n.astype(np.int64), head))
            bucket = (fp >> np.uint64(32)).astype(np.int64)
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
            low = fp.astype(np.uint32)
            spans = list(zip(cuts[:-1], cuts[1:]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[cuts[:-1]], pa.int32()), pa.array([block] * len(spans), pa.int64()), pa.array([low[a:b].tobytes() for a, b in spans]), pa.array([n[a:b].tobytes() for a, b in spans])],
                ["bucket", "block", "prints", "counts"],
            )

    def answer(table: pa.Table) -> pa.Table:
        bucket, block, prints, counts = (table.column(c).to_pylist() for c in ("bucket", "block", "prints", "counts"))
        arrays = [np.frombuffer(p, np.uint32) for p in prints]
        every, n = np.concatenate(arrays), CODES[np.concatenate([np.frombuffer(c, np.uint8) for c in counts])]
        order = np.argsort(every, kind="stable")
        ranked = every[order]
        head = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
        total = np.add.reduceat(n[order], head)
        many = ranked[head[total > hot]] if hot is not None else ranked[:0]
        total = np.repeat(np.minimum(total, 255), np.diff(np.r_[head, len(ranked)]))
        back = np.zeros(len(every), np.uint8)
        back[order] = np.where(total > 1, total, 0)
        out, at = [(None, bucket[0], many.tobytes(), bytes([255]) * len(many))] if len(many) else [], 0
        for b, a in zip(block, arrays):
            mine = back[at : at + len(a)]
            at += len(a)
            hit = mine > 0
            if hit.any():
                out.append((b, bucket[0], a[hit].tobytes(), mine[hit].tobytes()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else ([], [], [], []), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["block", "bucket", "prints", "counts"])

    sent = blocks.mapInArrow(send, "bucket int, block long, prints binary, counts binary")
    found = sent.groupBy("bucket").applyInArrow(answer, "block long, bucket int, prints binary, counts binary")
    return found.groupBy("block").agg(F.collect_list(F.struct("bucket", "prints", "counts")).alias("found"))


def with_repeated(blocks: DataFrame, found: DataFrame) -> DataFrame:
    return blocks.join(found, "block", "left").select("block", "ids", "ends", "text", "found")


def ranges(found: list[dict] | None) -> tuple[np.ndarray, np.ndarray]:
    """Ascending prefixes of a block's repeated keys, and their document counts."""
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint8)
    parts = sorted(found, key=lambda f: f["bucket"])
    keys = [np.frombuffer(f["prints"], np.uint32).astype(np.uint64) | np.uint64(f["bucket"]) << np.uint64(32) for f in parts]
    return np.concatenate(keys), np.concatenate([np.frombuffer(f["counts"], np.uint8) for f in parts])


def look_up(keys: np.ndarray, bits: int, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Document counts of keys; 1 for those that are not repeated."""
    if not len(known):
        return np.ones(len(keys), np.uint8)
    fp = prefixes(keys, bits)
    at = np.minimum(np.searchsorted(known, fp), len(known) - 1)
    return np.where(known[at] == fp, counts[at], 1).astype(np.uint8)
