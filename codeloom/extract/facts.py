"""extract_facts: files to fact rows, one Arrow-backed pass over a file table."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from codeloom.extract import golike, jslike, proto, python
from codeloom.extract.emit import BATCH, Emitter
from codeloom.schema import FACTS

JS = (".js", ".jsx", ".ts", ".tsx")
EXTENSIONS = (".py", *JS, ".go", ".proto")


def file_facts(repo: str, path: str, raw: bytes, pack: Callable[[list[tuple]], Any] | None = None, want: frozenset[str] | None = None) -> tuple[list[Any], list[tuple]]:
    """Facts of one file: what pack() made of most rows of a large file, and the other rows. A file that cannot be parsed gives its file node and
    a problem row."""
    e = Emitter(repo or "", path, pack, want)
    ext = "." + path.rsplit(".", 1)[-1] if "." in path else ""
    try:
        if ext == ".proto":
            proto.extract(e, raw)
        else:
            text = raw.decode("utf-8", "replace")
            {".py": python.extract, ".go": golike.extract}.get(ext, jslike.extract)(e, text)
    except (SyntaxError, ValueError, RecursionError) as error:
        e = Emitter(repo or "", path, want=want)
        e.node(e.file_id, "file", "Lsyn", path.rsplit("/", 1)[-1], 1, "", "")
        e.add("problem", f"{type(error).__name__}: {error}")
    return e.packed, e.rows


#: Bits of monotonically_increasing_id() that count the rows of a partition.
ROW_BITS = 33


def dealt(files: DataFrame) -> DataFrame:
    """files dealt to all cores one by one, the largest first: stored tables of small texts are a few blocks, which few tasks would read,
    and a hash of their paths would bring some of the largest together."""
    spark = files.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    rows = files.sortWithinPartitions(F.desc(F.length("content"))).withColumn("_at", F.monotonically_increasing_id())
    place = F.col("_at").bitwiseAND((1 << ROW_BITS) - 1) + F.shiftright("_at", ROW_BITS)
    return rows.repartitionById(parts, F.pmod(place, F.lit(parts)).cast("int")).drop("_at")


def extract_facts(files: DataFrame, want: Iterable[str] | None = None) -> DataFrame:
    """files (repo, path, content, ...) to FACTS rows; with `want`, to those of these kinds, and edges of these relations. Every
    file is parsed alone, so a lost task repeats only its files."""
    schema, want = to_arrow_schema(FACTS), None if want is None else frozenset(want)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        arrays = [pa.array([list(p.items()) if p else None for p in c] if f.name == "pairs" else c, f.type) for c, f in zip(zip(*rows), schema)]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def pack(rows: list[tuple]) -> pa.Buffer:
        """Facts of one file wait until all of it is parsed, and say much the same: compressed, they take a tenth or less."""
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_batch(table(rows))
        return sink.getvalue()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for i in range(batch.num_rows):  # one text at a time
                repo, path, raw = (c[i].as_py() for c in batch.columns)
                packed, more = file_facts(repo, path, raw or b"", pack, want)
                for one in packed:
                    yield from pa.ipc.open_stream(one)
                rows += more
                if len(rows) >= BATCH:  # small files share a batch
                    yield table(rows)
                    rows = []
        if rows:
            yield table(rows)

    return dealt(files.select(F.coalesce("repo", F.lit("")).alias("repo"), "path", "content")).mapInArrow(run, FACTS)
