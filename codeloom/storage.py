"""Tables in the shared folder: reliable cuts of lineage, and saved graphs."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.schema import EDGES, NODES


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Where none is set, a local master gets a new local one; on a cluster, whose machines
    would each write to their own, it is an error."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="codeloom-"))
        base = sc.getCheckpointDir()
    return base.rstrip("/")


def stored(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """df written to the shared folder as Parquet and read back."""
    path = f"{shared_dir(df.sparkSession)}/codeloom/{name}-{uuid.uuid4().hex}"
    if by:
        by_folder(df, path, *by)
    else:
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Folders that a task writes to at once; rows of more are sorted by folder.
FOLDERS = 16


def by_folder(df: DataFrame, path: str, *by: str) -> None:
    """df written as Parquet in a folder for each value of `by`. A task keeps a file of each of a few folders open, where Spark
    would otherwise sort all its rows by folder."""
    conf, key = df.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(key)
    conf.set(key, str(FOLDERS))
    try:
        df.write.mode("overwrite").partitionBy(*by).parquet(path)
    finally:
        conf.set(key, before)


#: Bytes of a row group of a clustered table: what a look-up reads at least.
ROW_GROUP = 1 << 20


def clustered(df: DataFrame, name: str, *by: str, row_group: int = ROW_GROUP) -> DataFrame:
    """df written to the shared folder in the order of `by`, in small row groups, and read back: a filter on these columns
    reads the row groups whose least and largest values admit it, and of those the pages."""
    path = f"{shared_dir(df.sparkSession)}/codeloom/{name}-{uuid.uuid4().hex}"
    df.repartitionByRange(*by).sortWithinPartitions(*by).write.option("parquet.block.size", row_group).option("parquet.page.row.count.limit", 2000).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def signature(spark: SparkSession, *paths: str) -> str:
    """A digest of names, sizes and times of the files at these paths: another one once any of them is written again."""
    sc, seen = spark.sparkContext, []
    for path in paths:
        place = sc._jvm.org.apache.hadoop.fs.Path(path)
        fs = place.getFileSystem(sc._jsc.hadoopConfiguration())
        if fs.exists(place):
            seen += [f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in fs.listStatus(place)]
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()


_KEPT: dict[tuple[str, ...], DataFrame] = {}


def kept(spark: SparkSession, key: tuple[str, ...], make: Callable[[], DataFrame], by: tuple[str, ...] = (), inputs: Sequence[str] = (), write: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """The table that make() gives, stored once for an application, key and state of the input files, as a graph is that
    many queries ask. write(df, name) stores it, if not plainly."""
    key = (spark.sparkContext.applicationId, signature(spark, *inputs), *key)
    found = _KEPT.get(key)
    if found is not None:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(found.inputFiles()[0]) if found.inputFiles() else None
        if place is None or place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            return found
    _KEPT[key] = write(make(), key[-1]) if write else stored(make(), key[-1], by)
    return _KEPT[key]


def running(df: DataFrame, partition: Sequence[str], order: Sequence[str], value: Column, name: str, upto: float | None = None) -> DataFrame:
    """df with `name`, the sum of value over the rows of its partition up to and with each row, in an order that must be total.

    Rows are range-partitioned by partition and order; sums of the pieces give what stands before each, and only pieces are
    summed row by row, so no task holds a partition. With `upto`, and no value negative, rows with a larger sum are left
    out, and of pieces that begin beyond it no row is read again.
    """
    keys = [*partition, *order]
    rows = df.withColumn("_value", value)
    rows = stored(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_piece", F.spark_partition_id()), "running")
    rows = rows.withColumn("_at", F.to_json(F.struct(*partition, "_piece")))
    sums = rows.groupBy(*partition, "_piece", "_at").agg(F.sum("_value").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy(*partition).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("_at", before.alias("_before"))
    if upto is not None:
        starts = starts.filter(F.col("_before") <= upto)
    within = F.sum("_value").over(Window.partitionBy("_at").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = rows.join(starts, "_at").withColumn(name, F.col("_before") + within)
    out = out if upto is None else out.filter(F.col(name) <= upto)
    return out.drop("_at", "_piece", "_value", "_before")


def numbered(df: DataFrame, by: Sequence[str], column: str, first: int = 1) -> DataFrame:
    """df with a gapless number in the order of the given columns, which must order its rows totally.

    Rows are range-partitioned and sorted in parallel; a row's number is its place in its partition plus the rows of the
    partitions before, so no task holds more than its range.
    """
    mark = F.monotonically_increasing_id()
    rows = stored(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_mark", mark), "numbered")
    part, place = F.shiftright("_mark", 33), F.col("_mark").bitwiseAND((1 << 33) - 1)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    offsets = sizes.select("_part", before.alias("_before"))
    out = rows.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return out.withColumn(column, (F.col("_before") + place + first).cast("long")).drop("_mark", "_part", "_before")


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph as two Parquet tables, edges by layer, so that a traversal of some layers reads only their files."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    by_folder(edges, f"{path}/edges", "layer")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema(NODES).parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges").select(*EDGES.names)


def content_key(files: DataFrame) -> str:
    """A digest of a file table: equal for equal repositories, paths and contents, in any order."""
    h = files.select(F.sha2(F.concat_ws("\x1f", "repo", "path", F.sha2("content", 256)), 256).alias("h"))
    parts = [F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")) for i in range(4)]
    return "-".join(str(x) for x in h.agg(F.count(F.lit(1)), *parts).first())
