"""Operator 8: exact deduplication as a stateful stream.

Main path: DataFrame and Structured Streaming functions only. A streaming aggregation keyed by the SHA-256 of the
normalised text keeps, in RocksDB state without watermark or expiry, the digest, the smallest stable identifier with its
content locator, and the number of rows. Each micro-batch writes the state rows that changed. Groups that were hit twice
or more are then checked on their full bytes: the smallest and the largest text of a digest must be the same bytes, which
a partial aggregation finds without bringing a group together. A digest that fails is split by its texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import fresh, join_on_hot_key, read_table, shared_dir, stored, work_path

#: One space for each run of these characters; fixed by the operator's definition of equality.
SPACES = r"[\x20\x09-\x0D]+"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LAST = 2**63 - 1


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACES, " ").cast("binary")


def sha256(raw: Column) -> Column:
    return F.sha2(raw, 256)


def _located(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, ord, file, row, text): ord orders ids with nulls last; file and row locate the content where the source has files."""
    ident = [F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("ord")]
    text = F.col(text_col).alias("text")
    try:
        return docs.select(*ident, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), text)
    except Exception as e:  # a DataFrame that isn't a plain file scan has no such columns
        if "UNRESOLVED_COLUMN" not in str(e) and "FIELD_NOT_FOUND" not in str(e):
            raise
        return docs.select(*ident, F.lit("").alias("file"), F.monotonically_increasing_id().alias("row"), text)


class DedupState:
    """Streaming state in a folder of the shared store: digests seen so far, each with its keeper and row count.

    ingest() runs all files of a folder that the state has not seen yet through the stream and ends. Restarting after a
    failure continues from the stream's checkpoint.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or work_path(spark, "dedup")

    def ingest(self, folder: str, schema) -> None:
        own = self.spark.newSession()
        for k, v in {
            "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
            "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
            "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
            "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "300",
            "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
            "spark.sql.shuffle.partitions": self.spark.conf.get("spark.sql.shuffle.partitions"),
        }.items():
            own.conf.set(k, v)
        rows = own.readStream.schema(schema).parquet(folder)
        state = rows.groupBy("digest").agg(F.min(F.struct("ord", "file", "row")).alias("keeper"), F.count(F.lit(1)).alias("n"))
        out = f"{self.path}/changes"

        def write(batch: DataFrame, number: int) -> None:
            batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number:09d}")

        query = state.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()

    def table(self) -> DataFrame:
        """(digest, keeper, n): of each digest the row of its last change."""
        rows = self.spark.read.option("recursiveFileLookup", "true").schema("digest string, keeper struct<ord:long,file:string,row:long>, n long, batch int").parquet(f"{self.path}/changes")
        if rows.agg(F.max("batch")).first()[0] in (None, 0):
            return rows.select("digest", "keeper", "n")
        last = rows.groupBy("digest").agg(F.max(F.struct("batch", "keeper", "n")).alias("last"))
        return last.select("digest", "last.keeper", "last.n")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, keep_file, keep_row, file, row.

    Texts are equal when identical after each run of white space is replaced by one space; null counts as empty. Of equal
    texts the row with the smallest id is kept, null ids last; of repeated rows with that id, the one that comes first by
    file and row. An empty table gives no rows. Other columns of docs are not read. `digest` maps normalised bytes to the
    state's key; any function is safe, since hits are checked on full bytes.
    """
    spark = docs.sparkSession
    rows = _located(docs, id_col, text_col).withColumn("raw", normalised(F.col("text")))
    slim = stored(rows.select("id", "ord", "file", "row", digest(F.col("raw")).alias("digest"), sha256(F.col("raw")).alias("sha")), "digests")
    total = slim.count()
    if not total:
        return slim.select(F.col("id").alias(id_col), F.col("id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"), F.col("file").alias("keep_file"), F.col("row").alias("keep_row"), "file", "row")
    state = DedupState(spark)
    state.ingest(slim.inputFiles()[0].rsplit("/", 1)[0], slim.schema)
    groups = stored(state.table(), "groups")

    # Full bytes of every hit: rows whose digest was in the state before.
    hits = groups.filter("n > 1").select("digest", "n")
    texts = rows.select(digest(F.col("raw")).alias("digest"), "raw")
    checked = join_on_hot_key(texts, hits, "digest", "n", total).groupBy("digest").agg(F.min("raw").alias("a"), F.max("raw").alias("b"))
    clash = stored(checked.filter("a <> b").select("digest"), "clashes")

    whole = groups
    if clash.limit(1).count():  # digests that differ in bytes, however many: their rows are keyed by the text itself
        clash = stored(clash.join(hits, "digest").withColumn("split", F.lit(True)), "clashes")
        known = rows.select("id", "ord", "file", "row", digest(F.col("raw")).alias("digest"), sha256(F.col("raw")).alias("sha"), "raw")
        marked = join_on_hot_key(known, clash.withColumnRenamed("n", "weight"), "digest", "weight", total, "left")
        by_text = F.when(F.col("split"), F.concat_ws(":", "digest", F.col("raw").cast("string"))).otherwise(F.col("digest"))
        slim = stored(marked.withColumn("digest", by_text).drop("weight", "raw"), "digests")
        split = slim.filter("split").groupBy("digest").agg(F.min(F.struct("ord", "file", "row")).alias("keeper"), F.count(F.lit(1)).alias("n"))
        slim = slim.drop("split")
        whole = stored(groups.join(clash.select("digest"), "digest", "left_anti").unionByName(split.select("digest", "keeper", "n")), "groups")
    joined = join_on_hot_key(slim, whole, "digest", "n", total)
    keep = F.when(F.col("keeper.ord") == LAST, F.lit(None).cast("long")).otherwise(F.col("keeper.ord"))
    return joined.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.struct("ord", "file", "row") == F.col("keeper")).alias("kept"),
        F.col("sha").alias("text_sha256"),
        F.col("keeper.file").alias("keep_file"),
        F.col("keeper.row").alias("keep_row"),
        "file",
        "row",
    )


def located_rows(docs: DataFrame) -> tuple[DataFrame, DataFrame, tuple[str, str]]:
    """docs as a plain file scan; the same with two more columns, the file and the row number, which tell rows apart; and
    the names of the two, which no column of docs has. What is no such scan is written first."""
    rows, file, row = docs, fresh("_file", docs.columns), fresh("_row", docs.columns)
    if not rows.inputFiles() or any(not x.lower().endswith(".parquet") for x in rows.inputFiles()[:1]):
        rows = stored(docs, "docs")
    place = [F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row)]
    try:
        return rows, rows.select("*", *place), (file, row)
    except Exception as e:
        if "UNRESOLVED_COLUMN" not in str(e) and "FIELD_NOT_FOUND" not in str(e):
            raise
        rows = stored(docs, "docs")
        return rows, rows.select("*", *place), (file, row)


def first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns, whatever their names. Rows are met again by file
    and row number, so null and repeated ids are safe; docs that are no plain file scan are written first."""
    rows, located, place = located_rows(docs)
    gone = exact_dedup(rows, id_col, text_col).filter(~F.col("kept")).select(F.col("file").alias(place[0]), F.col("row").alias(place[1]))
    return located.join(gone, list(place), "left_anti").select(*(f"`{c}`" for c in docs.columns))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS s FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS keep_id, CAST(count(*) OVER (PARTITION BY s) AS BIGINT) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY s) AS kept, s AS text_sha256
FROM t
"""
