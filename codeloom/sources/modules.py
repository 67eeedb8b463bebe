"""JavaScript and TypeScript module specifiers to module keys."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.sources.repo import RepoConfig


def key(path: str) -> str:
    """A path as a module key: no extension, no trailing index or __init__, parts joined by dots."""
    parts = [p for p in path.replace("\\", "/").strip("/").split("/") if p not in ("", ".")]
    if parts:
        stem = parts[-1].rsplit(".", 1)
        parts[-1] = stem[0] if stem[0] else parts[-1]
        if parts[-1] in ("__init__", "index"):
            parts.pop()
    return ".".join(parts)


def _export(exports: object, sub: str) -> str | None:
    if isinstance(exports, str):
        return exports if sub == "." else None
    value = exports.get(sub) if isinstance(exports, dict) else None
    if isinstance(value, dict):
        value = next((value[c] for c in ("types", "import", "require", "default") if isinstance(value.get(c), str)), None)
    return value if isinstance(value, str) else None


def candidates(file: str, spec: str, config: RepoConfig) -> list[str]:
    """Module keys that a specifier may stand for, the first that exists wins. Relative ones are final."""
    if spec.startswith("."):
        parts = file.split("/")[:-1]
        for p in spec.split("/"):
            if p == "..":
                parts = parts[:-1]
            elif p not in ("", "."):
                parts.append(p)
        return [key("/".join(parts))]
    out = []
    for pattern, targets in config.ts_paths:
        head, star, tail = pattern.partition("*")
        if spec.startswith(head) and spec.endswith(tail) and len(spec) >= len(head) + len(tail) and (star or spec == pattern):
            wild = spec[len(head) : len(spec) - len(tail)]
            out += [key(t.replace("*", wild)) for t in targets]
    for name in sorted(config.packages, key=len, reverse=True):
        if spec == name or spec.startswith(name + "/"):
            pkg, sub = config.packages[name], spec[len(name) :].lstrip("/")
            target = _export(pkg["exports"], f"./{sub}" if sub else ".") or (sub if sub else pkg["main"])
            if target:
                out.append(key(f"{pkg['directory']}/{target.lstrip('./')}"))
    return out


def resolve_imports(specs: DataFrame, module_files: DataFrame, configs: dict[str, RepoConfig]) -> DataFrame:
    """specs (repo, file, ctx, seq, alias, spec, name) with target: the module (and its symbol) that each alias stands for.
    Unknown packages stay as they are written."""
    shared = specs.sparkSession.sparkContext.broadcast(configs)  # configuration files of the repositories, small by nature

    @F.pandas_udf("array<string>")
    def options(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known = shared.value
        for repo, file, spec in parts:
            yield pd.Series([candidates(f, s, known.get(r, RepoConfig())) for r, f, s in zip(repo, file, spec)])

    rows = specs.withColumn("options", options("repo", "file", "spec"))
    each = rows.select("repo", "ctx", "seq", F.posexplode("options").alias("pos", "module"))
    first = each.join(module_files.select("repo", "module"), ["repo", "module"]).groupBy("ctx", "seq").agg(F.min_by("module", "pos").alias("found"))
    out = rows.join(first, ["ctx", "seq"], "left")
    module = F.coalesce("found", F.when(F.col("spec").startswith("."), F.get("options", F.lit(0))), "spec")
    return out.withColumn("target", F.when(F.col("name") != "", F.concat(module, F.lit("."), "name")).otherwise(module)).drop("options", "found")
