"""Operator 7: removal of repeated 50-byte strings by suffix arrays of shards.

Every 50-byte window of a document belongs to the shard of its minimiser, the least hash of the 16-byte strings in it, so
equal windows of all documents meet in one shard, whatever surrounds them.
1. Documents are packed into blocks; copies of a whole document with a smaller id are settled by digest.
2. Blocks learn which minimisers occur in more than one document (repeats.py); all other windows are unique.
3. Maximal runs of windows with the same repeated minimiser are chunks of text. A block folds equal ones and sends each
   distinct chunk once to the minimiser's shard, with the places where it stands.
4. A shard builds the suffix array of its distinct chunks by induced sorting, and the permuted common prefixes. Windows
   with 50 bytes in common are neighbours there; each group of them takes its smallest document id, and every occurrence
   in a document with a larger id is answered with its byte span.
   A minimiser with more than HOT runs would make its shard too large. Its windows do not go to shards: each block folds
   equal ones, those whose fingerprint is repeated get their smallest document id by a partial aggregation on their
   bytes, and blocks are answered through join_on_hot_key.
5. Blocks merge the spans of each document and drop those bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import NULL_ID, blocks_of, join_on_hot_key, mix, read_table, release, rows_of, stored, unpack
from codeloom.llm.repeats import bucket_bits, look_up, prefixes, ranges, repeated_keys
from codeloom.llm.suffix import induced, permuted_lcp

LENGTH = 50
GRAM = 16
#: Longer runs of windows with one minimiser are cut, as in text of one repeated byte.
RUN = 256
#: Shards for each bucket of repeats.py, as a power of two; keeps a shard at a few MB of text.
SHARD_BITS = 2
#: Runs of one minimiser that its shard takes; those of more frequent ones are settled window by window.
HOT = 4096
#: Hot minimisers at most (8 bytes each, broadcast); with more than HOT times as many runs in a table, HOT rises.
HOT_KEYS = 4_000_000
#: Windows of occurrences that a shard expands at a time.
SLICE = 1 << 20


def window_runs(raw: np.ndarray, starts: np.ndarray, length: int, gram: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of windows with the same minimiser: its hash, the document, the first window, the number of windows."""
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none.astype(np.uint64), none, none, none
    h = raw.astype(np.uint64)
    done = 1
    while done * 2 <= 8:  # eight bytes as one integer
        h = h[:-done] | h[done:] << np.uint64(8 * done)
        done *= 2
    if gram != 16:
        raise ValueError("minimisers are strings of 16 bytes")
    h = h[:-8] * np.uint64(0x9E3779B97F4A7C15) ^ h[8:] * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    width, low = 1, h
    while width * 2 <= length - gram + 1:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = length - gram + 1 - width
    if rest:
        low = np.minimum(low[:-rest], low[rest:])
    # Windows that cross a document's end, and those of skipped documents, are none.
    valid = np.zeros(len(low) + 1, np.int8)
    size = np.diff(starts)
    use = size >= length
    if skip is not None:
        use[skip] = False
    a, b = starts[:-1][use], starts[1:][use] - length + 1
    np.add.at(valid, a, 1)
    np.add.at(valid, b, -1)
    valid = np.cumsum(valid[:-1], dtype=np.int8) > 0
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (low[1:] != low[:-1])
    first = np.flatnonzero(new)
    if not len(first):
        return none.astype(np.uint64), none, none, none
    last = np.flatnonzero(valid & np.r_[~valid[1:] | (low[1:] != low[:-1]), True])
    n = last - first + 1
    if n.max() > RUN:
        parts = -(-n // RUN)
        base = np.repeat(first, parts)
        step = (np.arange(len(base)) - np.repeat(np.cumsum(parts) - parts, parts)) * RUN
        n = np.minimum(np.repeat(n, parts) - step, RUN)
        first = base + step
    return low[first], np.searchsorted(starts, first, "right") - 1, first, n


def _skips(found: list[int] | None) -> np.ndarray:
    return np.array(found or [], np.int64)


def _copies(blocks: DataFrame) -> DataFrame:
    """(block, skip): in each block the documents whose whole bytes equal those of a document with a smaller id."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, ends, text in rows_of(batches):
            ids, starts, raw = unpack(ids, ends, text)
            view = memoryview(raw)
            sha = [hashlib.sha256(view[a:b]).digest() for a, b in zip(starts[:-1], starts[1:])]
            k = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array([block] * k), pa.array(range(k), pa.int32()), pa.array(ids), pa.array(sha, pa.binary())], ["block", "doc", "id", "sha"])

    rows = stored(blocks.mapInArrow(digests, "block long, doc int, id long, sha binary"), "digests")
    least = rows.groupBy("sha").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return join_on_hot_key(rows, least, "sha", "n", max(1, rows.count())).filter("id > least").groupBy("block").agg(F.collect_list("doc").alias("skip"))


def windows_at(raw: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """raw[i:i + length] for each i of at, as an array of fixed byte strings that compare as bytes."""
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, length)[at]).view(f"V{length}").ravel()


def numbered(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each data[start:end]; equal strings, and only they, have equal numbers."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(data[a:b], len(seen)) for a, b in zip(starts.tolist(), ends.tolist())), np.int64, len(starts))


def _among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


PACKED = "text binary, sizes binary, times binary, ids binary, firsts binary"


def _packed(raw: np.ndarray, group: np.ndarray, ids: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, dict[str, list[bytes]]]:
    """Chunks raw[first:first + size] by group: the groups, and for each its distinct chunks (text and sizes), the number of
    places of each, and the document id and first byte of each place, in order of id."""
    zip_ = zstandard.ZstdCompressor(level=1)
    body = numbered(raw.tobytes(), first, first + size)
    order = np.lexsort((ids, body, group))
    group, body, ids, place, size = group[order], body[order], ids[order], first[order].astype(np.int64), size[order]
    lead = np.flatnonzero(np.r_[True, (body[1:] != body[:-1]) | (group[1:] != group[:-1])])
    times = np.diff(np.r_[lead, len(body)]).astype(np.uint32)
    group, first, size = group[lead], place[lead], size[lead].astype(np.int64)
    cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
    offset = np.cumsum(size) - size
    text = raw[np.repeat(first, size) + np.arange(int(size.sum())) - np.repeat(offset, size)]
    edge, places = np.r_[offset, len(text)], np.r_[lead, len(ids)]
    out: dict[str, list[bytes]] = {"text": [], "sizes": [], "times": [], "ids": [], "firsts": []}
    for a, b in zip(cuts[:-1], cuts[1:]):
        out["text"].append(zip_.compress(text[edge[a] : edge[b]].tobytes()))
        out["sizes"].append(size[a:b].astype(np.uint16).tobytes())
        out["times"].append(times[a:b].tobytes())
        out["ids"].append(ids[places[a] : places[b]].tobytes())
        out["firsts"].append(place[places[a] : places[b]].tobytes())
    return group[cuts[:-1]], out


def _windows(text: bytes, sizes: bytes, times: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of packed chunks: the text, the first byte of each window in it, its chunk, its place in the chunk, and the first of
    the chunk's places (with one more entry: the number of places)."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(text), np.uint8)
    size = np.frombuffer(sizes, np.uint16).astype(np.int64)
    n = size - length + 1
    chunk = np.repeat(np.arange(len(size)), n)
    step = np.arange(len(chunk)) - np.repeat(np.cumsum(n) - n, n)
    return raw, (np.cumsum(size) - size)[chunk] + step, chunk, step, np.r_[0, np.cumsum(np.frombuffer(times, np.uint32).astype(np.int64))]


def _hot_spans(blocks: DataFrame, hot, bits: int, length: int) -> DataFrame:
    """(block, starts, ends): spans of windows of hot minimisers that occur in a document with a smaller id. hot: a
    broadcast array of ascending prefixes.

    The blocks are read once for the chunks of these minimisers. What follows works on those: fingerprints of their
    windows tell which are repeated at all, and only these meet by their bytes.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, ends, text, skip in rows_of(batches):
            ids, starts, raw = unpack(ids, ends, text)
            h, doc, first, n = window_runs(raw, starts, length, GRAM, _skips(skip))
            own = np.flatnonzero(_among(prefixes(h, bits), hot.value))
            if len(own):
                _, cols = _packed(raw, np.zeros(len(own), np.int64), ids[doc[own]], first[own], n[own] + length - 1)
                yield pa.RecordBatch.from_pydict({"block": [block], **cols})

    held = stored(blocks.select("block", "ids", "ends", "text", "skip").mapInArrow(chunks, f"block long, {PACKED}"), "hot")

    def bounds(ids: np.ndarray, chunk: np.ndarray, of: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The smallest and the largest document of each of n windows; w: the number of each window."""
        lo, hi = np.full(n, NULL_ID, np.int64), np.full(n, np.iinfo(np.int64).min, np.int64)
        np.minimum.at(lo, w, ids[of[:-1]][chunk])
        np.maximum.at(hi, w, ids[of[1:] - 1][chunk])
        return lo, hi

    def prints_of(text: bytes, sizes: bytes, times: bytes, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
        raw, at, chunk, _, of = _windows(text, sizes, times, length)
        keys, w = np.unique(window_prints(raw, at, length), return_inverse=True)
        lo, hi = bounds(np.frombuffer(ids, np.int64), chunk, of, w, len(keys))
        return keys, np.where(lo < hi, 2, 1)

    few = bucket_bits(held.agg(F.sum(F.octet_length("sizes"))).first()[0] or 0)
    found = repeated_keys(held.select("block", "text", "sizes", "times", "ids"), prints_of, few, packed=False)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, text, sizes, times, ids, firsts, found in rows_of(batches):
            raw, at, chunk, step, of = _windows(text, sizes, times, length)
            own = np.flatnonzero(look_up(window_prints(raw, at, length), few, *ranges(found)) > 1)
            if not len(own):
                continue
            ids, firsts, chunk, step = np.frombuffer(ids, np.int64), np.frombuffer(firsts, np.int64), chunk[own], step[own]
            values, w = np.unique(windows_at(raw, at[own], length), return_inverse=True)
            lo, hi = bounds(ids, chunk, of, w, len(values))
            # All places of each distinct window.
            times = (of[1:] - of[:-1])[chunk]
            place = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times) + np.repeat(of[chunk], times)
            which, start = np.repeat(w, times), firsts[place] + np.repeat(step, times)
            order = np.argsort(which, kind="stable")
            edge = np.searchsorted(which[order], np.arange(len(values) + 1))
            own, start = ids[place][order], start[order]
            for a in range(0, len(values), 50_000):
                part = range(a, min(a + 50_000, len(values)))
                spans = [(edge[i], edge[i + 1]) for i in part]
                yield pa.RecordBatch.from_pydict({
                    "w": pa.array([values[i].tobytes() for i in part], pa.binary()), "block": np.full(len(part), block), "lo": lo[a : part.stop], "hi": hi[a : part.stop],
                    "own": pa.array([own[x:y].tobytes() for x, y in spans], pa.binary()), "starts": pa.array([start[x:y].tobytes() for x, y in spans], pa.binary()),
                })

    asked = held.join(found, "block").select("block", "text", "sizes", "times", "ids", "firsts", "found")
    rows = stored(asked.mapInArrow(windows, "w binary, block long, lo long, hi long, own binary, starts binary"), "windows")
    least = rows.groupBy("w").agg(F.min("lo").alias("least"), F.max("hi").alias("most"), F.count(F.lit(1)).alias("n")).filter("least < most").select("w", "least", "n")
    hit = join_on_hot_key(rows, least, "w", "n", max(1, rows.count())).filter("least < hi").select("block", "least", "own", "starts")

    def late(table: pa.Table) -> pa.Table:
        own, starts = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.int64) for c in ("own", "starts"))
        times = [len(x) // 8 for x in table.column("own").to_pylist()]
        starts = np.sort(starts[own > np.repeat(table.column("least").to_numpy(), times)])
        return pa.table({"block": table.column("block")[:1], "starts": [starts.tobytes()], "ends": [(starts + length).tobytes()]})

    return hit.groupBy("block").applyInArrow(late, "block long, starts binary, ends binary")


def window_prints(raw: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes of raw[i:i + length] for each i of at; they only choose which windows are compared."""
    eight = raw.astype(np.uint64)
    for done in (1, 2, 4):  # eight bytes as one integer
        eight = eight[:-done] | eight[done:] << np.uint64(8 * done)
    out = np.zeros(len(at), np.uint64)
    for off in [*range(0, length - 8, 8), length - 8]:
        out = mix((out ^ eight[at + off]) * np.uint64(0x9E3779B97F4A7C15))
    return out


def _shard(table: pa.Table, length: int) -> pa.Table:
    """Spans of bytes to remove, by block, from all chunks of a shard. A row has the distinct chunks of a block: text and
    sizes, the number of places of each, and the document id and first byte of each place."""
    block = np.array(table.column("block").to_pylist())
    unzip = zstandard.ZstdDecompressor().decompress
    texts = [np.frombuffer(unzip(t), np.uint8) for t in table.column("text").to_pylist()]
    sizes = [np.frombuffer(s, np.uint16).astype(np.int64) for s in table.column("sizes").to_pylist()]
    times = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("times").to_pylist()]).astype(np.int64)
    ids = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("ids").to_pylist()])
    firsts = [np.frombuffer(x, np.int64) for x in table.column("firsts").to_pylist()]
    row = np.repeat(np.arange(len(block)), [len(f) for f in firsts])
    firsts = np.concatenate(firsts)
    raw, size = np.concatenate(texts), np.concatenate(sizes)
    end = np.cumsum(size)
    # Distinct chunks of all blocks, each with its smallest document; places are in order of id.
    chunk = numbered(raw.tobytes(), end - size, end)
    lead = np.unique(chunk, return_index=True)[1]
    owner = np.full(len(lead), NULL_ID, np.int64)
    np.minimum.at(owner, chunk, ids[np.cumsum(times) - times])
    # One text: chunks as byte + 2 with a 1 after each, and a 0 at the end.
    csize, cbegin = size[lead], (end - size)[lead]
    at = np.cumsum(csize + 1) - (csize + 1)
    text = np.ones(int((csize + 1).sum()) + 1, np.uint16)
    inside = np.arange(int(csize.sum())) - np.repeat(np.cumsum(csize) - csize, csize)
    text[np.repeat(at, csize) + inside] = raw[np.repeat(cbegin, csize) + inside].astype(np.uint16) + 2
    text[-1] = 0
    sa = induced(text, 258)
    plcp = permuted_lcp(text, sa, stop=1)
    same = plcp[sa] >= length
    # Windows: suffixes with `length` bytes left in their chunk.
    whose = np.repeat(np.arange(len(lead)), csize + 1)
    offset = np.arange(len(text) - 1) - at[whose]
    window = np.r_[offset <= csize[whose] - length, False]
    head = np.flatnonzero(~same)
    least = np.minimum.reduceat(np.where(window, np.r_[owner[whose], NULL_ID], NULL_ID)[sa], head)
    smallest = np.empty(len(text), np.int64)
    smallest[sa] = np.repeat(least, np.diff(np.r_[head, len(sa)]))
    smallest[~window] = NULL_ID
    # Every place of a chunk against the smallest document of each of its windows, a bounded number at a time.
    of = np.repeat(chunk, times)
    late = np.flatnonzero(np.minimum.reduceat(smallest, at)[of] < ids)
    found = []
    total = np.cumsum(csize[of[late]] - length + 1)
    for part in np.split(late, np.searchsorted(total, np.arange(SLICE, total[-1] if len(total) else 0, SLICE))):
        n = csize[of[part]] - length + 1
        occ = np.repeat(part, n)
        step = np.arange(len(occ)) - np.repeat(np.cumsum(n) - n, n)
        hit = smallest[at[of[occ]] + step] < ids[occ]
        edge = np.r_[True, occ[1:] != occ[:-1]] if len(occ) else hit
        begin = np.flatnonzero(hit & (edge | ~np.r_[False, hit[:-1]])) if len(occ) else occ
        stop = np.flatnonzero(hit & (np.r_[edge[1:], True] | ~np.r_[hit[1:], False])) if len(occ) else occ
        found.append((row[occ[begin]], firsts[occ[begin]] + step[begin], firsts[occ[stop]] + step[stop] + length))
    r, s, e = (np.concatenate(c) for c in zip(*found))
    out = []
    cuts = np.flatnonzero(np.r_[True, r[1:] != r[:-1], True]) if len(r) else []
    for a, b in zip(cuts[:-1], cuts[1:]):
        out.append((int(block[r[a]]), s[a:b].tobytes(), e[a:b].tobytes()))
    cols = zip(*out) if out else ([], [], [])
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.binary()))], ["block", "starts", "ends"])


def repeated_spans(blocks: DataFrame, total_bytes: int, length: int = LENGTH) -> DataFrame:
    """(block, skip, spans): whole copies, and packed spans (starts, ends; relative to the block) to remove."""
    spark = blocks.sparkSession
    runs = total_bytes // 18  # a run for about 18 bytes; only sets the number of buckets
    bits = bucket_bits(runs)
    skips = stored(_copies(blocks), "copies")
    blocks = blocks.join(skips, "block", "left").select("block", "ids", "ends", "text", "skip")

    def keys_of(ids: np.ndarray, starts: np.ndarray, raw: np.ndarray, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Counts are runs, or 1 for a minimiser of a single document."""
        h, doc, _, _ = window_runs(raw, starts, length, GRAM, skip)
        order = np.argsort(h, kind="stable")
        h, doc = h[order], doc[order]
        if not len(h):
            return h, doc
        at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        stop = np.r_[at[1:], len(h)]
        return h[at], np.where(doc[at] == doc[stop - 1], 1, stop - at)

    found = stored(repeated_keys(blocks, keys_of, bits, max(HOT, runs // HOT_KEYS)), "repeated")
    release(spark)
    listed = found.filter("block is null").select("found").first()
    known = ranges(listed and [r.asDict() for r in listed.found])[0]
    found = found.filter("block is not null")
    hot = spark.sparkContext.broadcast(known)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, ends, text, skip, found in rows_of(batches):
            known, counts = ranges(found)
            if not len(known):
                continue
            ids, starts, raw = unpack(ids, ends, text)
            h, doc, first, n = window_runs(raw, starts, length, GRAM, _skips(skip))
            keep = np.flatnonzero((look_up(h, bits, known, counts) > 1) & ~_among(prefixes(h, bits), hot.value))
            if not len(keep):
                continue
            shard = (mix(prefixes(h[keep], bits)) >> np.uint64(64 - bits - SHARD_BITS)).astype(np.int64)
            shards, cols = _packed(raw, shard, ids[doc[keep]], first[keep], n[keep] + length - 1)
            yield pa.RecordBatch.from_pydict({"shard": shards, "block": np.full(len(shards), block), **cols})

    sent = blocks.join(found, "block", "left").select("block", "ids", "ends", "text", "skip", "found").mapInArrow(send, f"shard long, block long, {PACKED}")
    spans = sent.groupBy("shard").applyInArrow(lambda t: _shard(t, length), "block long, starts binary, ends binary")
    if len(known):
        spans = spans.unionByName(_hot_spans(blocks, hot, bits, length))
    return spans.groupBy("block").agg(F.collect_list(F.struct("starts", "ends")).alias("spans")).join(skips, "block", "full").select("block", "skip", "spans")


def cut_spans(raw: np.ndarray, starts: np.ndarray, length: int, skip: np.ndarray, spans: list[dict] | None) -> list[tuple[int, int, int, bytes]]:
    """For each document of a block: bytes, bytes removed, maximal removed runs, and what is left."""
    gone = np.zeros(len(raw) + 1, np.int32)
    for part in spans or []:
        np.add.at(gone, np.frombuffer(part["starts"], np.int64), 1)
        np.add.at(gone, np.frombuffer(part["ends"], np.int64), -1)
    gone = np.cumsum(gone[:-1]) > 0
    for d in skip:  # each byte of a whole copy is in a window of the copy, if it is long enough
        if starts[d + 1] - starts[d] >= length:
            gone[starts[d] : starts[d + 1]] = True
    out = []
    for a, b in zip(starts[:-1], starts[1:]):
        g = gone[a:b]
        runs = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum())
        out.append((int(b - a), int(g.sum()), runs, raw[a:b][~g].tobytes()))
    return out


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes).

    A byte goes if it lies in a string of `length` bytes that also starts in a document with a smaller id. Null texts are
    empty; shorter texts keep everything; null ids sort after all others and equal ids do not count as smaller. Strings
    are judged on the input and never cross documents. An empty table gives no rows; further columns are not read.
    """
    blocks = blocks_of(docs, id_col, text_col)
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    marked = stored(repeated_spans(blocks, size, length), "spans")
    release(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, ends, text, skip, spans in rows_of(batches):
            ids, starts, raw = unpack(ids, ends, text)
            rows = cut_spans(raw, starts, length, _skips(skip), spans)
            for at in range(0, len(rows), 256):
                n, removed, runs, kept = zip(*rows[at : at + 256])
                own = [None if i == NULL_ID else i for i in ids[at : at + 256].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), *(pa.array(c, pa.int64()) for c in (n, removed, runs)), pa.array([hashlib.sha256(k).hexdigest() for k in kept]), pa.array(kept, pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    rows = blocks.join(marked, "block", "left").select("block", "ids", "ends", "text", "skip", "spans")
    return rows.mapInArrow(cut, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary").withColumnRenamed("id", id_col)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(read_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


ORACLE = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
h AS (SELECT doc_id, octet_length(b) AS n, hex(b) AS x FROM d),
w AS (SELECT doc_id, i, hash(substr(x, 2 * i + 1, 100)) AS a, substr(x, 2 * i + 1, 100) AS s FROM (SELECT doc_id, x, unnest(range(n - 49)) AS i FROM h WHERE n >= 50)),
m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT w.doc_id, i FROM w JOIN m ON w.s = m.s WHERE m.least < w.doc_id),
marks AS (SELECT doc_id, list_sort(list(i)) AS p FROM hit GROUP BY doc_id),
runs AS (SELECT doc_id, unnest(p) AS i, unnest(list_prepend(CAST(-1000 AS BIGINT), p[1:len(p) - 1])) AS before FROM marks),
g AS (SELECT doc_id, i, sum(CASE WHEN i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM runs),
spans AS (SELECT doc_id, g, min(i) AS s, max(i) + 50 AS e FROM g GROUP BY doc_id, g),
per AS (SELECT doc_id, count(*) AS k, sum(e - s) AS removed, list(s ORDER BY s) AS ss, list(e ORDER BY s) AS es FROM spans GROUP BY doc_id)
SELECT h.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(k, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN k IS NULL THEN x ELSE array_to_string(list_transform(range(k + 1), lambda j: substr(x, 2 * (CASE WHEN j = 0 THEN 0 ELSE es[j] END) + 1,
              2 * ((CASE WHEN j = k THEN n ELSE ss[j + 1] END) - (CASE WHEN j = 0 THEN 0 ELSE es[j] END)))), '') END)) AS kept_sha256
FROM h LEFT JOIN per ON h.doc_id = per.doc_id
"""
