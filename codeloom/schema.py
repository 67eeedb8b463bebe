"""Schemas of the property graph and of the facts that it is derived from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LAYERS = ("Lsyn", "Ldep", "Lflow", "Lsem", "Lcontract")

_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "strings": T.ArrayType(T.StringType()), "pairs": T.MapType(T.StringType(), T.StringType())}


def struct(fields: str, **more: T.DataType) -> T.StructType:
    """A struct type from 'name type, ...'. It needs no session, so workers can import it."""
    known = _TYPES | more
    return T.StructType([T.StructField(n, known[t]) for n, t in (f.split() for f in fields.split(","))])


_DEFINITION = struct("file string, file_id string, repo_id string, sha256 string, request_type string, response_type string")

NODES = struct(
    "id string, ord long, type string, layer string, name string, file string, repo string, line_no int, docstring string, code string, "
    "http_path string, http_methods strings, request_type string, response_type string, definitions definitions, skew boolean",
    definitions=T.ArrayType(_DEFINITION),
)
EDGES = struct("edge_id string, src string, dst string, relation string, layer string, d_scope int, f_call double, c_type double, id_ctx string")

#: One wide row type for all facts of a file. kind selects which columns have a meaning; see extract/emit.py.
FACTS = struct("repo string, file string, ctx string, kind string, seq long, a string, b string, c string, d string, n int, x double, doc string, code string, pairs pairs")


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def as_nodes(df: DataFrame) -> DataFrame:
    """df with exactly the node columns; those that it lacks are null (texts empty)."""
    blank = {"docstring", "code", "file", "repo"}
    cols = [F.col(f.name).cast(f.dataType) if f.name in df.columns else (F.lit("") if f.name in blank else F.lit(None).cast(f.dataType)).alias(f.name) for f in NODES.fields]
    return df.select(*cols)


def as_edges(df: DataFrame) -> DataFrame:
    """df with exactly the edge columns: scope 0, one call and full confidence unless given, and a deterministic key."""
    default = {"d_scope": F.lit(0), "f_call": F.lit(1.0), "c_type": F.lit(1.0), "id_ctx": F.lit("")}
    for c, v in default.items():
        df = df.withColumn(c, F.coalesce(F.col(c), v) if c in df.columns else v)
    if "edge_id" not in df.columns:
        seq = F.col("seq") if "seq" in df.columns else F.lit(0)
        df = df.withColumn("edge_id", F.sha2(F.concat_ws("\x1f", "src", "dst", "relation", "id_ctx", seq.cast("string"), F.col("f_call").cast("string")), 256))
    return df.select(*[F.col(f.name).cast(f.dataType) for f in EDGES.fields])


def with_metadata(edges: DataFrame) -> DataFrame:
    """edges with the metadata vector as one struct."""
    return edges.withColumn("metadata", F.struct("d_scope", "f_call", "c_type", "id_ctx"))
