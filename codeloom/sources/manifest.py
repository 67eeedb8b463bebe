"""Workspace manifests in YAML or JSON."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Repository:
    id: str
    path: str
    language: str = ""
    role: str = ""


@dataclass
class Workspace:
    name: str = "workspace"
    version: str = "1.0"
    repositories: list[Repository] = field(default_factory=list)
    shared_contracts: list[str] = field(default_factory=list)
    ignore_patterns: list[str] = field(default_factory=list)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(self.name, self.version, r.id, r.path, r.language, r.role) for r in self.repositories]
        return spark.createDataFrame(rows, "workspace string, version string, id string, path string, language string, role string")


def _lines(text: str) -> dict:
    """A reader for the block style that manifests use: scalars, lists of scalars, and lists of flat mappings."""
    out: dict = {}
    current, item = None, None
    for line in text.splitlines():
        line = line.split(" #")[0].rstrip() if not line.lstrip().startswith("#") else ""
        if not line.strip():
            continue
        word = line.strip()
        scalar = lambda v: v.strip().strip("'\"")
        if not line[0].isspace() and not word.startswith("- "):
            key, _, value = word.partition(":")
            out[key.strip()] = scalar(value) if value.strip() else []
            current, item = key.strip(), None
        elif word.startswith("- "):
            body = word[2:]
            item = {body.partition(":")[0].strip(): scalar(body.partition(":")[2])} if ": " in body or body.endswith(":") else scalar(body)
            out[current].append(item)
        elif isinstance(item, dict):
            key, _, value = word.partition(":")
            item[key.strip()] = scalar(value)
    return out


def parse(text: str, base: str = ".", is_json: bool = False) -> Workspace:
    """A manifest's text. Repositories may be mappings or bare paths, whose base name is their id. Relative paths are
    taken from the manifest's folder."""
    if is_json:
        data = json.loads(text)
    else:
        try:
            import yaml

            data = yaml.safe_load(text) or {}
        except ImportError:
            data = _lines(text)
    data = data.get("workspace", data) if isinstance(data.get("workspace"), dict) else data
    place = lambda p: p if os.path.isabs(p) else os.path.normpath(os.path.join(base, p))
    repos = []
    for r in data.get("repositories") or data.get("repos") or []:
        r = {"path": r} if isinstance(r, str) else r
        path = place(r["path"])
        repos.append(Repository(r.get("id") or r.get("name") or os.path.basename(path), path, r.get("language", ""), r.get("role", "")))
    name = data.get("name") or (data.get("workspace") if isinstance(data.get("workspace"), str) else None) or "workspace"
    shared = [s if isinstance(s, str) else s.get("path", "") for s in data.get("shared_contracts") or []]
    return Workspace(str(name), str(data.get("version", "1.0")), repos, [place(s) for s in shared], list(data.get("ignore_patterns") or []))


def load(path: str) -> Workspace:
    with open(path, encoding="utf-8") as f:
        return parse(f.read(), os.path.dirname(os.path.abspath(path)), path.endswith(".json"))
