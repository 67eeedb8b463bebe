"""Scans of source repositories (S1 to S5) into one table of files."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.extract.facts import EXTENSIONS
from codeloom.functions.text import ignored, is_ignored, utf8

#: Paths that are left out unless a caller says otherwise; fixed values.
DEFAULT_IGNORES = [
    "*_pb2.py", "*_pb2_grpc.py", "*.pb.go", "*_grpc_pb.js", "*_pb.js", "*_grpc_pb.d.ts",
    "genproto/*", "vendor/*", "node_modules/*", ".git/*", "__pycache__/*", "venv/*", ".venv/*", "dist/*", "build/*",
]
FILES = "repo string, path string, ext string, content binary"


@dataclass
class RepoConfig:
    """What module resolution needs from a repository's configuration files."""

    ts_paths: list[tuple[str, list[str]]] = field(default_factory=list)
    packages: dict[str, dict] = field(default_factory=dict)


def is_local(root: str) -> bool:
    return urlparse(root).scheme in ("", "file")


def local_path(root: str) -> str:
    return unquote(urlparse(root).path) if root.startswith("file:") else root


def remote_texts(spark: SparkSession, root: str, names: tuple[str, ...]) -> dict[str, str]:
    """Texts of the files with these names below a root that only Spark's readers open, by path from the root."""
    out = {}
    for name in names:
        glob = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name)
        for path, raw in glob.load(root).select("path", "content").collect():  # configuration files, few and small
            out[unquote(urlparse(path).path).removeprefix(unquote(urlparse(root).path).rstrip("/") + "/")] = bytes(raw).decode("utf-8", "replace")
    return out


def ignore_patterns(root: str, extra: list[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    """Default patterns, those of the repository's .ckgignore, and the caller's. A root that is not local is read through
    Spark; its readers hide names that begin with a dot, so the file is asked for by its whole path."""
    out, text = list(DEFAULT_IGNORES), ""
    path = os.path.join(local_path(root), ".ckgignore")
    if not is_local(root):
        if spark is None:
            raise ValueError("a repository that is not local needs a session")
        text = _hidden_text(spark, f"{root.rstrip('/')}/.ckgignore")
    elif os.path.isfile(path):
        with open(path, encoding="utf-8") as f:
            text = f.read()
    out += [line.strip() for line in text.splitlines() if line.strip() and not line.lstrip().startswith("#")]
    return out + list(extra or [])


def _hidden_text(spark: SparkSession, path: str) -> str:
    """The text of one small file that Spark's listing hides; '' if there is none."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(conf)
    if not system.exists(place):
        return ""
    stream = system.open(place)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _unlisted(root: str, patterns: list[str]) -> list[tuple[str, bytes]]:
    """Files below a folder or with a name that begins with _ or ., which Spark's readers do not list."""
    top, out = local_path(root), []
    for folder, names, files in os.walk(top):
        rel = os.path.relpath(folder, top).replace(os.sep, "/")
        rel = "" if rel == "." else rel + "/"
        names[:] = sorted(n for n in names if not is_ignored(rel + n, patterns))
        for name in sorted(files):
            path = rel + name
            if any(p[:1] in "_." for p in path.split("/")) and path.endswith(EXTENSIONS) and not is_ignored(path, patterns):
                with open(os.path.join(folder, name), "rb") as f:
                    out.append((path, f.read()))
    return out


def scan(spark: SparkSession, root: str, repo: str = "", extra_ignores: list[str] | None = None) -> DataFrame:
    """(repo, path, ext, content) of the supported files of a folder, without ignored ones.

    Content is read by the binaryFile source on the executors. The filter looks at paths only, so ignored files are not
    read. Names that Spark hides are read on the driver from a local folder.
    """
    patterns = ignore_patterns(root, extra_ignores, spark)
    base = root if not is_local(root) else "file://" + os.path.abspath(local_path(root))
    prefix = base.rstrip("/") + "/"
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    rel = F.expr(f"substring(url_decode(replace(replace(path, 'file:///', 'file:/'), '+', '%2B')), {len(prefix.replace('file:///', 'file:/')) + 1})")
    files = listed.select(F.lit(repo).alias("repo"), rel.alias("path"), "content")
    files = files.filter(F.col("path").rlike(r"\.(" + "|".join(e[1:] for e in EXTENSIONS) + ")$") & ~ignored(F.col("path"), patterns))
    hidden = _unlisted(root, patterns) if is_local(root) else []
    if hidden:
        files = files.unionByName(spark.createDataFrame([(repo, p, bytearray(c)) for p, c in hidden], "repo string, path string, content binary"))
    return files.select("repo", "path", F.concat(F.lit("."), F.element_at(F.split("path", r"\."), -1)).alias("ext"), "content")


def files_table(spark: SparkSession, rows: list[tuple[str, str, str | bytes]]) -> DataFrame:
    """A file table from (repo, path, text), as for sources that are already in a table or in tests."""
    out = [(r, p, "." + p.rsplit(".", 1)[-1], bytearray(c.encode() if isinstance(c, str) else c)) for r, p, c in rows]
    return spark.createDataFrame(out, FILES)


def config_of(texts: dict[str, str]) -> RepoConfig:
    """Configuration from the texts of tsconfig.json at the root and of package.json files, by path."""
    out = RepoConfig()
    for path in sorted(texts):
        try:
            data = json.loads(texts[path])
        except ValueError:
            continue
        if path == "tsconfig.json":
            out.ts_paths = list((data.get("compilerOptions") or {}).get("paths", {}).items())
        elif path.rsplit("/", 1)[-1] == "package.json" and data.get("name"):
            out.packages[data["name"]] = {"directory": path.rpartition("/")[0], "exports": data.get("exports"), "main": data.get("module") or data.get("main") or data.get("types")}
    return out


def read_config(root: str, spark: SparkSession | None = None) -> RepoConfig:
    """Configuration files of a repository; folders node_modules and .git are passed over."""
    texts, top = {}, local_path(root)
    if not is_local(root):
        if spark is None:
            raise ValueError("a repository that is not local needs a session")
        found = remote_texts(spark, root, ("package.json", "tsconfig.json"))
        skip = {"node_modules", ".git"}
        return config_of({p: t for p, t in found.items() if not skip & set(p.split("/")) and (p == "tsconfig.json" or p.endswith("package.json"))})
    for folder, names, files in os.walk(top):
        names[:] = [n for n in names if n not in ("node_modules", ".git")]
        rel = os.path.relpath(folder, top).replace(os.sep, "/")
        for name in files:
            if name == "package.json" or (name == "tsconfig.json" and rel == "."):
                with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
                    texts[name if rel == "." else f"{rel}/{name}"] = f.read()
    return config_of(texts)


def lines_of(files: DataFrame) -> DataFrame:
    """(repo, path, text, lines): decoded texts (bad bytes replaced) with their number of lines (S3)."""
    text = utf8(F.col("content"))
    n = F.when(F.length("text") == 0, 0).otherwise(F.size(F.split(F.regexp_replace("text", r"\r\n?|\n|\x0b|\x0c|\x{85}|\x{2028}|\x{2029}", "\n"), "\n")) - F.when(F.col("text").rlike(r"(\n|\r|\x0b|\x0c|\x{85}|\x{2028}|\x{2029})\z"), 1).otherwise(0))
    return files.select("repo", "path", text.alias("text")).withColumn("lines", n.cast("long"))
