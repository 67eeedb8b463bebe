"""Diagnosis and repair (R1 to R11): anti-joins for defects, ranked candidates for causes, patches as text functions."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.similarity import python_parses, sequence_ratio, unified_diff
from codeloom.functions.text import balanced, utf8
from codeloom.operators.relational import best
from codeloom.plans.build import Graph
from codeloom.storage import stored

#: Variable names that are taken for clients when there is exactly one service; fixed values.
CLIENT_NAMES = ("stub", "client", "shipping_client", "order_client")
DEFECT = "type string, severity string, service string, rpc string, caller string, file string, ctx string, var string, old string, valid array<string>"


def _listed(df: DataFrame, kind: str, severity: str, **cols) -> DataFrame:
    names = ("service", "rpc", "caller", "file", "ctx", "var", "old", "valid")
    types = {"valid": "array<string>"}
    given = {n: cols.get(n, F.lit(None)) for n in names}
    return df.select(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), *[given[n].cast(types.get(n, "string")).alias(n) for n in names])


def _rows(df: DataFrame, kind: str, severity: str, **cols) -> DataFrame:
    return _listed(df, kind, severity, **cols).distinct()


def valid_rpcs(facts: DataFrame) -> DataFrame:
    return facts.filter("kind = 'rpc'").groupBy(F.col("a").alias("service")).agg(F.array_sort(F.collect_set("b")).alias("valid"))


def skewed(g: Graph) -> DataFrame:
    """R1"""
    return _rows(g.skews, "CONTRACT_SKEW", "CRITICAL", service=F.col("service"), rpc=F.col("rpc"), valid=F.col("variants"))


def missing(g: Graph) -> DataFrame:
    """R2: rpcs that nothing implements."""
    made = g.edges.filter("relation = 'IMPLEMENTS'").select(F.col("dst").alias("id"))
    rows = g.nodes.filter("type = 'rpc_contract'").join(made, "id", "left_anti")
    return _rows(rows, "MISSING_IMPLEMENTATION", "HIGH", service=F.split_part(F.split_part("id", F.lit("::"), F.lit(2)), F.lit("."), F.lit(1)), rpc=F.col("name"))


def renamed_calls(g: Graph) -> DataFrame:
    """Client calls (service, caller, ctx, old) to a service that has rpcs, but not this one."""
    f = g.table.having("client_var", "service", "attr_call", "rpc_call", "rpc")  # in one pass
    return g.unresolved.join(f.filter("kind = 'rpc'").select(F.col("a").alias("service")).distinct(), "service", "left_semi").select("service", "caller", "ctx", F.col("method").alias("old")).distinct()


def renamed(g: Graph) -> DataFrame:
    """R3, with what the service has. A caller's id begins with its file. Calls are made distinct before each gets the list."""
    rows = renamed_calls(g).join(valid_rpcs(g.table.having("rpc")), "service")
    return _listed(rows, "RENAMED_RPC", "CRITICAL", service=F.col("service"), caller=F.col("caller"), file=F.col("ctx"), ctx=F.col("ctx"), old=F.col("old"), valid=F.col("valid"))


def dangling_calls(g: Graph) -> DataFrame:
    """Calls through a variable that is bound to a service, or has a client's name while there is one service, whose
    method no rpc matches in any case. One for each file and method."""
    f = g.table.having("client_var", "service", "attr_call", "rpc")
    bound = f.filter("kind = 'client_var'").select("ctx", F.col("a").alias("var"), F.col("b").alias("bound")).distinct()
    only = f.filter("kind = 'service'").select(F.col("a").alias("service")).distinct().agg(F.count(F.lit(1)).alias("n"), F.min("service").alias("only"))
    calls = f.filter("kind = 'attr_call'").select("ctx", F.col("a").alias("caller"), F.col("b").alias("var"), F.col("c").alias("method"))
    named = F.when(F.col("var").isin(*CLIENT_NAMES) & (F.col("n") == 1), F.col("only"))
    rows = calls.join(bound, ["ctx", "var"], "left").crossJoin(F.broadcast(only)).withColumn("service", F.coalesce("bound", named)).filter("service is not null")  # only is one row
    rpcs = f.filter("kind = 'rpc'").select(F.col("a").alias("service"), F.lower("b").alias("low")).distinct()
    lost = rows.withColumn("low", F.lower("method")).join(rpcs, ["service", "low"], "left_anti").join(valid_rpcs(f), "service")
    one = lost.groupBy("ctx", "method").agg(F.min(F.struct("caller", "service", "var", "valid")).alias("c"))
    return _rows(one, "RENAMED_RPC", "CRITICAL", service=F.col("c.service"), caller=F.col("c.caller"), file=F.col("ctx"), ctx=F.col("ctx"), var=F.col("c.var"), old=F.col("method"), valid=F.col("c.valid"))


def dangling_http(g: Graph) -> DataFrame:
    """R5"""
    return _rows(g.dangling_http, "DANGLING_HTTP", "MEDIUM", caller=F.col("caller"), file=F.col("ctx"), ctx=F.col("ctx"), old=F.concat_ws(" ", "method", "path"))


def diagnose(g: Graph) -> DataFrame:
    """All defects; a renamed rpc that both rules find is listed once."""
    found = renamed(g).unionByName(dangling_calls(g))
    once = found.groupBy("ctx", "old").agg(F.min_by(F.struct(*[c for c in found.columns if c not in ("ctx", "old")]), F.coalesce("var", F.lit("~"))).alias("d")).select("d.*", "ctx", "old").select(found.columns)
    return skewed(g).unionByName(missing(g)).unionByName(once).unionByName(dangling_http(g))


def attribute(defects: DataFrame) -> DataFrame:
    """R6. defects with target and confidence: for renamed rpcs the most similar valid one, else 1.0 or 0.8."""
    key = F.sha2(F.to_json(F.struct(*defects.columns)), 256)
    d = stored(defects.withColumn("defect", key), "defects")
    pairs = d.filter("type = 'RENAMED_RPC'").select("defect", "old", F.explode("valid").alias("target"))
    top = best(pairs.withColumn("confidence", F.round(sequence_ratio("old", "target"), 2)), ["defect"], "confidence", ["target"]).select("defect", "target", "confidence")
    rest = F.when(F.col("type").isin("CONTRACT_SKEW", "MISSING_IMPLEMENTATION"), 1.0).otherwise(0.8)
    return stored(d.join(top, "defect", "left").withColumn("confidence", F.coalesce("confidence", rest)), "causes")


#: Characters of a stem by which it first looks for paths.
HEAD = 3


def homes(absent: DataFrame, files: DataFrame) -> DataFrame:
    """absent (defect, rpc, stem) with path, ctx and ext of the first of files (path, ctx, ext, base) by path whose base holds
    the stem. Every place of a base whose first characters begin some stem gives its cuts of the lengths of these stems, and
    cuts meet stems as equals, so no stem is held against all paths."""
    head = F.substring("stem", 1, HEAD)
    heads = absent.groupBy(head.alias("head")).agg(F.collect_set(F.length("stem")).alias("lengths"))
    places = F.explode(F.sequence(F.lit(1), F.length("base")))
    at = files.filter("base <> ''").select("path", "ctx", "ext", "base", places.alias("i")).withColumn("head", F.explode(F.array_distinct(F.array(*[F.substr("base", F.col("i"), F.lit(n)) for n in range(1, HEAD + 1)]))))
    cuts = at.join(F.broadcast(heads), "head").select("path", "ctx", "ext", "base", "i", F.explode("lengths").alias("n"))  # heads are three characters at most
    cuts = cuts.filter(F.col("i") + F.col("n") <= F.length("base") + 1).select("path", "ctx", "ext", F.substr("base", F.col("i"), F.col("n")).alias("stem"))
    first = cuts.join(absent.select("stem").distinct(), "stem", "left_semi").groupBy("stem").agg(F.min(F.struct("path", "ctx", "ext")).alias("h"))
    return absent.distinct().join(first, "stem").select("defect", "rpc", "h.path", "h.ctx", "h.ext")


def patches(causes: DataFrame, files: DataFrame) -> DataFrame:
    """R7. (defect, path, old_code, new_code, diff): renames of calls in the file of a renamed rpc, and stub methods for
    missing implementations, in the first file by path whose path holds the service's stem."""
    ctx = F.when(F.col("repo") != "", F.concat_ws("/", "repo", "path")).otherwise(F.col("path"))
    text = files.select(ctx.alias("ctx"), "path", "ext", utf8(F.col("content")).alias("old_code"))
    e = lambda c: F.concat(F.lit(r"\Q"), F.col(c), F.lit(r"\E"))
    rename = causes.filter("type = 'RENAMED_RPC' and target is not null").join(text, "ctx")
    exact = F.concat(F.lit(r"\b"), e("var"), F.lit(r"\s*\.\s*"), e("old"), F.lit(r"\b"))
    by_var = F.regexp_replace(F.col("old_code"), exact, F.concat("var", F.lit("."), "target"))
    by_dot = F.replace("old_code", F.concat(F.lit("."), "old", F.lit("(")), F.concat(F.lit("."), "target", F.lit("(")))
    new = F.when(F.col("var").isNotNull() & (by_var != F.col("old_code")), by_var).otherwise(by_dot)
    out = rename.select("defect", "path", "ctx", "ext", "old_code", new.alias("new_code"))
    stem = F.lower(F.regexp_replace("service", "Service$", ""))
    absent = causes.filter("type = 'MISSING_IMPLEMENTATION'").select("defect", "rpc", stem.alias("stem")).filter("stem <> ''")
    bases = text.filter("ext in ('.py', '.js', '.ts', '.go')").select("path", "ctx", "ext", F.lower(F.regexp_replace("path", "[-_]", "")).alias("base"))
    home = homes(absent, bases)
    stub = F.when(F.col("ext") == ".py", F.concat(F.lit("\n    def "), "rpc", F.lit("(self, request, context):\n        raise NotImplementedError(\""), "rpc", F.lit("\")\n"))).when(F.col("ext") == ".go", F.concat(F.lit("\n// "), "rpc", F.lit(" is not implemented.\nfunc "), "rpc", F.lit("() error {\n\treturn nil\n}\n"))).otherwise(F.concat(F.lit("\nfunction "), "rpc", F.lit("(call, callback) {\n  callback(new Error(\"not implemented\"));\n}\n")))
    add = home.join(text.select("ctx", "old_code"), "ctx").select("defect", "path", "ctx", "ext", "old_code", F.concat("old_code", stub).alias("new_code"))
    both = out.unionByName(add).filter("old_code <> new_code")
    return both.withColumn("diff", unified_diff("path", "old_code", "new_code"))


def validate(changes: DataFrame) -> DataFrame:
    """R8. changes with status: Python must parse, other languages balance their brackets. verify_repair() also builds."""
    ok = F.when(F.col("ext") == ".py", python_parses("new_code")).otherwise(balanced(F.col("new_code")))
    return changes.withColumn("status", F.when(ok, "VALID").otherwise("SYNTAX_ERROR"))


def apply_to(files: DataFrame, changes: DataFrame) -> DataFrame:
    """files with valid changes in place, the first by defect where several touch a file."""
    ctx = F.when(F.col("repo") != "", F.concat_ws("/", "repo", "path")).otherwise(F.col("path"))
    new = changes.filter("status = 'VALID'").groupBy("ctx").agg(F.min_by("new_code", "defect").alias("new_code"))
    rows = files.withColumn("ctx", ctx).join(new, "ctx", "left")
    return rows.select("repo", "path", "ext", F.coalesce(F.encode("new_code", "UTF-8"), "content").alias("content"))


def proposals(g: Graph, causes: DataFrame, changes: DataFrame) -> DataFrame:
    """R9. One row for each valid change, with the neighbourhood of its caller."""
    ends = g.edges.select(F.col("src").alias("caller"), F.col("dst").alias("other")).unionByName(g.edges.select(F.col("dst").alias("caller"), F.col("src").alias("other")))
    reach = ends.join(causes.select("caller").distinct(), "caller", "left_semi").groupBy("caller").agg((F.count_distinct("other") + 1).alias("impacted_nodes"))
    title = F.when(F.col("type") == "RENAMED_RPC", F.concat(F.lit("Rename call "), "old", F.lit(" to "), "target")).otherwise(F.concat(F.lit("Implement "), "rpc"))
    rows = causes.join(changes.filter("status = 'VALID'").select("defect", "path", "diff"), "defect").join(reach, "caller", "left")
    return rows.select("defect", "type", "severity", title.alias("title"), "confidence", "path", "diff", F.coalesce("impacted_nodes", F.lit(0)).cast("long").alias("impacted_nodes"), F.lit("READY_FOR_HUMAN_REVIEW").alias("status"))


def remediate(g: Graph, files: DataFrame) -> DataFrame:
    """R10. Defects to proposals; nothing is written."""
    causes = attribute(diagnose(g))
    return proposals(g, causes, validate(patches(causes, files)))


def write_changes(changes: DataFrame, root: str) -> list[str]:
    """K8. Writes valid changes below a local folder. Opt-in; the rows are files of one repository, taken one at a time."""
    done = []
    for r in changes.filter("status = 'VALID'").select("path", "new_code").toLocalIterator():
        target = os.path.normpath(os.path.join(root, r.path))
        if not target.startswith(os.path.abspath(root) + os.sep):
            raise ValueError(f"{r.path} lies outside {root}")
        with open(target, "w", encoding="utf-8") as f:
            f.write(r.new_code)
        done.append(r.path)
    return done


def inject(files: DataFrame, fault: str, old: str, new: str = "") -> DataFrame:
    """R11. files with a fault in their contracts: rename-rpc, remove-rpc or rename-service."""
    text = utf8(F.col("content"))
    q = rf"\Q{old}\E"
    changed = {
        "rename-rpc": F.regexp_replace(text, rf"\brpc\s+{q}\b", f"rpc {new}"),
        "remove-rpc": F.regexp_replace(text, rf"(?m)^\s*rpc\s+{q}\s*\([^)]*\)\s*returns\s*\([^)]*\)\s*(\{{[^}}]*\}}|;)\s*$", ""),
        "rename-service": F.regexp_replace(text, rf"\bservice\s+{q}\b", f"service {new}"),
    }[fault]
    return files.withColumn("content", F.when(F.col("ext") == ".proto", F.encode(changed, "UTF-8")).otherwise(F.col("content")))


def bindings(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("relation").isin("IMPLEMENTS", "CONSUMES")).select("src", "dst", "relation").distinct()
