"""Resolution of facts into derived edges (J1 to J15): prioritised equi-joins over fact tables.

Every function takes fact DataFrames and returns edges or bindings; nothing is kept between calls, so an incremental
update that rewrites some files' facts and resolves again equals a rebuild. Facts carry the repository, and names resolve
inside one repository; contracts and cross-repository routes are global.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from threading import RLock
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.extract.emit import EXTERNAL, SYMBOL
from codeloom.functions.text import module_key, url_path
from codeloom.operators import text as T
from codeloom.operators.relational import first_rule
from codeloom.storage import stored

TAU = 0.2


def at_once(*steps: Callable[[], Any]) -> list[Any]:
    """The results of steps that do not depend on one another, run by a thread each; the first failure is raised."""
    with ThreadPoolExecutor(len(steps)) as pool:
        return [f.result() for f in [pool.submit(step) for step in steps]]


@dataclass
class Facts:
    """Views over the wide fact table. having(*kinds): a table with the facts of these kinds, and maybe others; sources: (repo, path,
    ext, ord) of scanned files."""

    having: Callable[..., DataFrame]
    sources: DataFrame
    kept: dict[str, DataFrame] = field(default_factory=dict)
    kinds: dict[int, tuple[DataFrame, set[str]]] = field(default_factory=dict)
    locks: dict[str, RLock] = field(default_factory=lambda: defaultdict(RLock))

    def keep(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A table that several joins read: written once to the shared folder, whichever thread asks first."""
        with self.locks[name]:
            if name not in self.kept:
                self.kept[name] = stored(make(), name)
            return self.kept[name]

    def of(self, kind: str, *cols: Column | str) -> DataFrame:
        return self.having(kind).filter(F.col("kind") == kind).select(*cols)

    def has(self, kind: str) -> bool:
        """Whether there is any fact of a kind; one pass over a table tells it of all its kinds."""
        table = self.having(kind)
        with self.locks["kinds"]:
            if id(table) not in self.kinds:
                self.kinds[id(table)] = table, {r[0] for r in table.select("kind").distinct().collect()}  # some twenty at most
            return kind in self.kinds[id(table)][1]

    def symbols(self) -> DataFrame:
        """(repo, file, name, id, type): distinct ids."""
        return self.keep("symbols", lambda: self.of("symbol", "repo", "file", F.col("a").alias("name"), F.col("b").alias("id"), F.col("c").alias("type")).distinct())

    def module_files(self) -> DataFrame:
        """(repo, module, target): dotted module to file, the last file by path."""
        rows = self.sources.filter(F.col("ext").isin(".py", ".js", ".jsx", ".ts", ".tsx")).select("repo", module_key(F.col("path")).alias("module"), "path")
        return self.keep("modules", lambda: rows.filter("module <> ''").groupBy("repo", "module").agg(F.max("path").alias("target")))

    def imports(self) -> DataFrame:
        """(repo, file, alias, target): the last import of an alias in a file."""
        rows = self.of("import", "repo", "file", F.col("a").alias("alias"), F.col("b").alias("target"), "seq")
        return self.keep("imports", lambda: rows.groupBy("repo", "file", "alias").agg(F.max_by("target", "seq").alias("target")))

    def calls(self) -> DataFrame:
        """(call, repo, file, ctx, caller, callee, d_scope, f_call): call sites with the same spelling as one."""
        rows = self.of("call", "repo", "file", "ctx", F.col("a").alias("caller"), F.col("b").alias("callee"), F.col("n").alias("d_scope"))
        grouped = rows.groupBy("repo", "file", "ctx", "caller", "callee", "d_scope").agg(F.count(F.lit(1)).cast("double").alias("f_call"))
        return grouped.withColumn("call", F.sha2(F.concat_ws("\x1f", "ctx", "caller", "callee", F.col("d_scope").cast("string")), 256))


def unit(path: Column) -> Column:
    """The first folder of a path; '' for files at the root."""
    return F.when(path.contains("/"), F.split_part(path, F.lit("/"), F.lit(1))).otherwise("")


def references(refs: DataFrame, facts: Facts) -> DataFrame:
    """J2. refs (key, repo, file, spelling) to (key, id, type), none for references that stay external.

    Rules in order: the file that an import alias or the spelling itself names as a module holds the symbol; an alias that
    was imported but not found stays external; a bare name of the same file; a name that is unique in the repository, if
    both are in the same top folder or one is at the root.
    """
    symbols, modules, imports = at_once(facts.symbols, facts.module_files, facts.imports)
    base = F.split_part("spelling", F.lit("."), F.lit(1))
    dotted = F.contains("spelling", F.lit("."))
    rest = F.when(dotted, F.expr("substring(spelling, length(split_part(spelling, '.', 1)) + 1)")).otherwise("")
    r = refs.withColumn("base", base).join(imports.withColumnRenamed("alias", "base"), ["repo", "file", "base"], "left")
    r = r.withColumn("imported", F.col("target").isNotNull()).withColumn("full", F.concat(F.coalesce("target", "base"), rest)).drop("target")
    last = F.element_at(F.split("full", r"\."), -1)
    r = r.withColumn("symbol", last).withColumn("module", F.expr("substring(full, 1, greatest(length(full) - length(element_at(split(full, '[.]'), -1)) - 1, 0))"))

    in_module = r.filter("module <> ''").join(modules, ["repo", "module"]).select("key", "repo", F.col("target").alias("file"), F.col("symbol").alias("name"))
    found = in_module.join(symbols, ["repo", "file", "name"]).select("key", "id", "type", F.lit(1).alias("rule"))
    bare = r.filter(~F.col("imported") & ~dotted).select("key", "repo", "file", F.col("spelling").alias("name"))
    found = found.unionByName(bare.join(symbols, ["repo", "file", "name"]).select("key", "id", "type", F.lit(2).alias("rule")))
    unique = symbols.groupBy("repo", "name").agg(F.count(F.lit(1)).alias("k"), F.min_by(F.struct("id", "type", "file"), "id").alias("s")).filter("k = 1")
    free = r.filter(~F.col("imported") | (F.col("module") == "")).select("key", "repo", F.col("file").alias("from"), F.col("symbol").alias("name"))
    near = (unit(F.col("from")) == unit(F.col("s.file"))) | (unit(F.col("from")) == "") | (unit(F.col("s.file")) == "")
    found = found.unionByName(free.join(unique, ["repo", "name"]).filter(near).select("key", "s.id", "s.type", F.lit(3).alias("rule")))
    return first_rule(found, ["key"], "rule").select("key", "id", "type").distinct()


def hierarchy(facts: Facts) -> tuple[DataFrame, DataFrame]:
    """J3. (class, base, pos, k) of resolved bases, and EXTENDS edges with stubs for the rest. All bases count, in order."""
    rows = facts.of("base", "repo", "file", "ctx", "seq", F.col("a").alias("class"), F.col("b").alias("spelling"), F.col("n").alias("d_scope"))
    rows = rows.withColumn("key", F.concat_ws("\x1f", "ctx", F.col("seq").cast("string")))
    found = references(rows.select("key", "repo", "file", "spelling"), facts).filter("type = 'class'")
    pairs = facts.keep("bases", lambda: rows.join(found.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("key"))), "key", "left"))
    known = pairs.filter(F.col("id").isNotNull()).select("class", F.col("id").alias("base"), F.col("seq").alias("pos"), "k")
    edges = pairs.select(F.col("class").alias("src"), F.coalesce("id", F.concat(F.lit(SYMBOL), "spelling")).alias("dst"), F.lit("EXTENDS").alias("relation"), F.lit("Ldep").alias("layer"), "d_scope", F.coalesce(1.0 / F.col("k"), F.lit(0.0)).alias("c_type"), F.col("ctx").alias("id_ctx"))
    return known, edges


def up_and_down(facts: Facts, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ancestors() of a hierarchy, made once, and the same pairs from above (src, dst: a base and a class below it)."""
    up = facts.keep("ancestors", lambda: ancestors(known))
    return up, up.filter("path <> ''").select(F.col("base").alias("src"), F.col("class").alias("dst"))


def ancestors(known: DataFrame, max_levels: int = 1000) -> DataFrame:
    """(class, base, path): every class with itself (path '') and its bases, path ordering them depth first by position.

    Of each class and base the least path is kept, and only pairs whose path got less go on, so a level holds no more rows than
    there are pairs, however many paths lead to a base. A path does not come back to a class on it. Raises RuntimeError
    if there are more than max_levels levels.
    """
    step = known.groupBy("class", "base").agg(F.min("pos").alias("pos"))
    own = step.select("class").unionByName(step.select(F.col("base").alias("class"))).distinct()
    at = F.format_string("%010d.", "pos")
    best = own.select("class", F.col("class").alias("base"), F.lit("").alias("path"), F.array("class").alias("seen"), F.lit(False).alias("new"))
    other = step.filter(F.col("class") != F.col("base"))
    best = best.unionByName(other.select("class", "base", at.alias("path"), F.array("class", "base").alias("seen"), F.lit(True).alias("new")))
    if other.join(other.select(F.col("class").alias("base")), "base", "left_semi").isEmpty():  # no base has a base
        return best.select("class", "base", "path")
    best = stored(best, "ancestors")
    up = stored(step.select(F.col("class").alias("base"), F.col("base").alias("up"), "pos"), "bases")
    for _ in range(max_levels):
        nxt = best.filter("new").join(up, "base").filter(~F.array_contains("seen", F.col("up")))
        nxt = nxt.select("class", F.col("up").alias("base"), F.concat("path", at).alias("path"), F.array_append("seen", F.col("up")).alias("seen"), F.lit(True).alias("new"))
        every = best.withColumn("new", F.lit(False)).unionByName(nxt)
        best = stored(every.groupBy("class", "base").agg(F.min_by(F.struct("path", "seen", "new"), F.struct("path", "new")).alias("b")).select("class", "base", "b.*"), "ancestors")
        if best.filter("new").isEmpty():
            return best.select("class", "base", "path")
    raise RuntimeError(f"a class hierarchy has more than {max_levels} levels")


def methods(facts: Facts) -> DataFrame:
    """(owner, method, id): functions whose id is another symbol's id and a name."""
    s = facts.symbols().filter("type = 'function'")
    return s.select(F.expr("substring(id, 1, greatest(length(id) - length(name) - 1, 0))").alias("owner"), F.col("name").alias("method"), "id")


def find_methods(wanted: DataFrame, up: DataFrame, facts: Facts) -> DataFrame:
    """J4. wanted (key, class, method) to (key, id): the class's own method, else the first base's that has it."""
    m = methods(facts)
    own = wanted.join(m, (F.col("class") == F.col("owner")) & (wanted["method"] == m["method"])).select("key", "id", F.lit("").alias("path"))
    inherited = wanted.join(up.filter("path <> ''"), "class").join(m.withColumnRenamed("method", "m"), (F.col("base") == F.col("owner")) & (F.col("method") == F.col("m"))).select("key", "id", "path")
    return own.unionByName(inherited).groupBy("key").agg(F.min_by("id", F.struct("path", "id")).alias("id"))


def implementations(wanted: DataFrame, below: DataFrame, up: DataFrame, facts: Facts) -> DataFrame:
    """J5. wanted (key, repo, type_name, method) to (key, id): the method as found from each class of that name, and every
    override in its transitive subclasses."""
    classes = facts.symbols().filter("type = 'class'").select("repo", F.col("name").alias("type_name"), F.col("id").alias("class"))
    at = wanted.join(classes, ["repo", "type_name"])
    base = at.withColumn("k2", F.concat_ws("\x1f", "key", "class"))
    found = find_methods(base.select(F.col("k2").alias("key"), "class", "method"), up, facts).withColumnRenamed("key", "k2").join(base.select("k2", "key"), "k2").select("key", "id")
    sub = at.join(below, F.col("class") == F.col("src")).select("key", F.col("dst").alias("owner"), "method")
    return found.unionByName(sub.join(methods(facts), ["owner", "method"]).select("key", "id")).distinct()


def calls(facts: Facts, known: DataFrame, nodes: Callable[[], DataFrame]) -> DataFrame:
    """J7, J8. CALLS and POLYMORPHIC_CALL edges of all call sites, stubs for those that stay external. nodes() is asked only where a
    call has several overrides.

    Ladder: self methods, super methods, methods of the receiver's inferred type with its overrides, references. One
    target gives full confidence, k targets 1/k; several overrides give softmax confidences over text similarity.
    """
    c = facts.keep("calls", facts.calls)
    up, below = up_and_down(facts, known)
    base, last = F.split_part("callee", F.lit("."), F.lit(1)), F.element_at(F.split("callee", r"\."), -1)
    dots = F.length("callee") - F.length(F.replace("callee", F.lit("."), F.lit("")))
    c = c.withColumns({"base": F.when(F.col("callee").startswith("super()."), F.lit("super()")).otherwise(base), "method": last, "dots": dots, "owner": F.expr("regexp_replace(caller, '[.][^.]*$', '')")})

    own = c.filter("base = 'self' and dots = 1").select(F.col("call").alias("key"), F.col("owner").alias("class"), "method")
    by_self = find_methods(own, up, facts).select(F.col("key").alias("call"), "id", F.lit(1).alias("rule"))
    sup = c.filter("base = 'super()' and dots = 1").select("call", F.col("owner").alias("class"), "method").join(known.select("class", F.col("base").alias("parent"), "pos"), "class")
    each = sup.select(F.concat_ws("\x1f", "call", F.format_string("%010d", "pos"), "parent").alias("key"), F.col("parent").alias("class"), "method", "call", "pos")
    by_super = find_methods(each.select("key", "class", "method"), up, facts).join(each.select("key", "call", "pos"), "key").groupBy("call").agg(F.min_by("id", F.struct("pos", "id")).alias("id")).select("call", "id", F.lit(2).alias("rule"))

    types = facts.of("var_type", F.col("a").alias("caller"), F.col("b").alias("base"), F.col("c").alias("type_name"), "seq").groupBy("caller", "base").agg(F.max_by("type_name", "seq").alias("type_name"))
    typed = c.filter("dots > 0 and base not in ('self', 'super()')").join(types, ["caller", "base"])
    impl = implementations(typed.select(F.col("call").alias("key"), "repo", "type_name", "method"), below, up, facts).select(F.col("key").alias("call"), "id", F.lit(3).alias("rule"))
    refs = references(c.select(F.col("call").alias("key"), "repo", "file", F.col("callee").alias("spelling")), facts).select(F.col("key").alias("call"), "id", F.lit(4).alias("rule"))

    ladder = first_rule(by_self.unionByName(by_super).unionByName(impl).unionByName(refs), ["call"], "rule")
    found = facts.keep("call_targets", lambda: ladder.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("call"))))
    several = found.filter("rule = 3 and k > 1").select("call", "id")
    none = several.isEmpty()  # then no text of a node is read
    meta = c.select("call", "caller", "callee", "ctx", "file", "repo", "d_scope", "f_call")
    one = found.filter("not (rule = 3 and k > 1)").join(meta, "call").select(F.col("caller").alias("src"), F.col("id").alias("dst"), F.lit("CALLS").alias("relation"), "d_scope", "f_call", (1.0 / F.col("k")).alias("c_type"), F.col("ctx").alias("id_ctx"), F.col("call").alias("seq"))
    if not none:
        poly = polymorphic(several, c.select("call", "caller"), nodes())
        many = poly.join(meta, "call").select(F.col("caller").alias("src"), F.col("id").alias("dst"), F.lit("POLYMORPHIC_CALL").alias("relation"), "d_scope", "f_call", F.col("confidence").alias("c_type"), F.col("ctx").alias("id_ctx"), F.col("call").alias("seq"))
    stub = meta.join(found, "call", "left_anti").select(F.col("caller").alias("src"), F.concat(F.lit(EXTERNAL), "callee").alias("dst"), F.lit("CALLS").alias("relation"), "d_scope", "f_call", F.lit(0.5).alias("c_type"), F.col("ctx").alias("id_ctx"), F.col("call").alias("seq"))
    edges = one.unionByName(stub) if none else one.unionByName(many).unionByName(stub)

    # A module alias with exactly one function of that name, where no such call edge exists yet.
    alias = c.filter("dots > 0 and base not in ('self', 'super()')").withColumn("alias", F.expr("regexp_replace(callee, '[.][^.]*$', '')"))
    alias = alias.join(facts.imports().withColumnRenamed("target", "module"), ["repo", "file", "alias"]).join(facts.module_files().withColumnRenamed("target", "home"), ["repo", "module"])
    functions = facts.symbols().filter("type = 'function'").select("repo", F.col("file").alias("home"), F.col("name").alias("method"), "id")
    single = functions.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("repo", "home", "method"))).filter("k = 1").drop("k")
    extra = alias.join(single, ["repo", "home", "method"]).select(F.col("caller").alias("src"), F.col("id").alias("dst"), F.lit("CALLS").alias("relation"), "d_scope", "f_call", F.lit(1.0).alias("c_type"), F.col("ctx").alias("id_ctx"), F.col("call").alias("seq"))
    extra = extra.join(edges.filter("relation = 'CALLS'").select("src", "dst"), ["src", "dst"], "left_anti").dropDuplicates(["src", "dst"])
    return edges.unionByName(extra).withColumn("layer", F.lit("Ldep"))


def polymorphic(candidates: DataFrame, callers: DataFrame, nodes: DataFrame, tau: float = TAU) -> DataFrame:
    """T13. (call, id, confidence): softmax over the cosine of each candidate's text with its caller's."""
    e = lambda c: F.coalesce(F.col(c), F.lit(""))
    text = nodes.select("id", F.trim(F.concat_ws(" ", e("name"), e("docstring"), F.substring(e("code"), 1, 200))).alias("text"))
    stop = T.stop_words(nodes.sparkSession)
    cand = candidates.join(text, "id", "left").select(F.col("call").alias("g"), "id", F.lit(False).alias("is_caller"), F.coalesce("text", F.lit("")).alias("text"))
    call = candidates.select("call").distinct().join(callers, "call").join(text.withColumnRenamed("id", "caller"), "caller", "left").select(F.col("call").alias("g"), F.col("caller").alias("id"), F.lit(True).alias("is_caller"), F.coalesce("text", F.lit("")).alias("text"))
    return T.softmax(T.group_cosine(cand.unionByName(call), stop), "score", ["g"], tau).select(F.col("g").alias("call"), "id", "confidence")


#: Verbs of route decorators and of the requests library; fixed values.
VERBS = ("get", "post", "put", "patch", "delete")


def listed(json: Column) -> Column:
    return F.from_json(json, "array<string>")


def decorated(facts: Facts) -> DataFrame:
    """X6. Routes of Python decorators: the last part of the spelling is a verb or `route`, which means GET; a list of
    methods that has any takes their place. One row for each path and method."""
    action, methods = F.lower(F.element_at(F.split("b", r"\."), -1)), listed(F.element_at("pairs", "methods"))
    rows = facts.having("decorator").filter("kind = 'decorator'").withColumn("action", action).filter(F.col("action").isin(*VERBS, "route"))
    own = F.when(F.col("action") == "route", "GET").otherwise(F.col("action"))
    rows = rows.withColumn("path", F.explode(listed(F.col("d")))).withColumn("method", F.explode(F.when(F.size(methods) > 0, methods).otherwise(F.array(own))))
    return rows.select("repo", "file", "ctx", "seq", F.upper("method").alias("method"), "path", F.col("a").alias("handler"), F.col("c").alias("name"))


def requests(facts: Facts) -> DataFrame:
    """X8. Calls requests.<verb>("literal") whose literal has a path, without its host."""
    verb, path = F.element_at(F.split("b", r"\."), -1), url_path(F.get(listed(F.col("c")), F.lit(0)))
    rows = facts.of("literal_call", "repo", "ctx", "file", "seq", F.col("a").alias("caller"), path.alias("path"), F.upper(verb).alias("method"), "b")
    return rows.filter(F.col("b").startswith("requests.") & F.lower("method").isin(*VERBS) & F.col("path").startswith("/")).drop("b")


def routes(facts: Facts) -> DataFrame:
    """(repo, method, path, handler): routes whose handler was named are resolved as references, else by its scope."""
    rows = facts.of("route", "repo", "file", "ctx", "seq", F.upper("a").alias("method"), F.col("b").alias("path"), F.col("c").alias("handler"), F.col("d").alias("name"))
    rows = rows.unionByName(decorated(facts))
    rows = rows.withColumn("key", F.concat_ws("\x1f", "ctx", F.col("seq").cast("string")))
    if not facts.has("route"):  # decorators have their handlers
        return rows.filter("handler is not null").select("repo", "method", "path", "handler").distinct()
    named = rows.filter("handler is null and name is not null")
    found = references(named.select("key", "repo", "file", F.col("name").alias("spelling")), facts).select("key", F.col("id").alias("found"))
    # A handler method of a receiver in the same file counts when its name is unique there.
    local = facts.symbols().filter("type = 'function'").groupBy("repo", "file", "name").agg(F.min("id").alias("local"), F.count(F.lit(1)).alias("k")).filter("k = 1").drop("k")
    resolved = named.join(found, "key", "left").join(local, ["repo", "file", "name"], "left").select("repo", "method", "path", F.coalesce("found", "local").alias("handler"))
    return rows.filter("handler is not null").select("repo", "method", "path", "handler").unionByName(resolved).filter("handler is not null").distinct()


def http(facts: Facts, across: bool = False) -> tuple[DataFrame, DataFrame]:
    """J9, J14. HTTP_CALLS edges of literal calls to routes of the same repository, and if asked for, of calls that none
    of its own routes answers to routes of other repositories. Also the calls that no route answers (R5)."""
    made = facts.of("http_call", "repo", "ctx", "file", "seq", F.col("a").alias("caller"), F.col("b").alias("path"), F.upper("c").alias("method")).unionByName(requests(facts))
    r = routes(facts)
    own = made.join(r, ["repo", "method", "path"])
    bound = own
    if across:
        left = made.join(r, ["repo", "method", "path"], "left_anti")
        other = left.join(r.withColumnRenamed("repo", "there"), ["method", "path"]).filter((F.col("repo") != F.col("there")) & (F.col("caller") != F.col("handler"))).drop("there")
        bound = own.unionByName(other.select(own.columns))
    edges = bound.select(F.col("caller").alias("src"), F.col("handler").alias("dst"), F.lit("HTTP_CALLS").alias("relation"), F.lit("Ldep").alias("layer"), F.lit(0).alias("d_scope"), F.col("ctx").alias("id_ctx"), F.col("seq"))
    return edges, made.join(bound.select("ctx", "seq"), ["ctx", "seq"], "left_anti")


def contracts(facts: Facts) -> DataFrame:
    """(service, rpc, low): the rpcs of all services."""
    return facts.of("rpc", F.col("a").alias("service"), F.col("b").alias("rpc")).distinct().withColumn("low", F.lower("rpc"))


def match_rpc(wanted: DataFrame, rpcs: DataFrame) -> DataFrame:
    """J18. wanted (key, service, name) to (key, rpc_id): the rpc of that name, else the first that differs in case only."""
    low = wanted.withColumn("low", F.lower("name")).join(rpcs, ["service", "low"])
    pick = F.min_by("rpc", F.struct(F.col("rpc") != F.col("name"), "rpc"))
    return low.groupBy("key", "service").agg(pick.alias("rpc")).select("key", F.concat(F.lit("contract::"), "service", F.lit("."), "rpc").alias("rpc_id"))


def producers(facts: Facts, known: DataFrame) -> DataFrame:
    """J10 to J12. IMPLEMENTS edges of Python servicers and their subclasses, Go registrations and JavaScript services."""
    rpcs = contracts(facts)
    services = facts.of("service", F.col("a").alias("service")).distinct()
    up, closed = up_and_down(facts, known)
    edge = lambda df, src, dst: df.select(F.col(src).alias("src"), F.col(dst).alias("dst"))
    service_id = F.concat(F.lit("contract::"), F.col("service"))
    rpc_id = F.concat(F.lit("contract::"), F.col("service"), F.lit("."), F.col("rpc"))

    py = facts.of("servicer", F.col("a").alias("class"), F.col("b").alias("service")).join(services, "service").distinct()
    below = closed.select(F.col("src").alias("class"), F.col("dst").alias("owner"))
    family = py.select("service", F.col("class").alias("owner")).unionByName(py.join(below, "class").select("service", "owner")).distinct()
    made = family.join(rpcs, "service").join(methods(facts).withColumnRenamed("method", "rpc"), ["owner", "rpc"]).withColumn("dst", rpc_id)
    out = edge(py.withColumn("dst", service_id), "class", "dst").unionByName(edge(made, "id", "dst"))

    if facts.has("go_register"):
        go = facts.of("go_register", "repo", "file", "ctx", F.col("a").alias("service"), F.col("b").alias("var")).join(services, "service")
        var_type = facts.of("go_type_var", "ctx", F.col("a").alias("var"), F.col("b").alias("t"), "seq").groupBy("ctx", "var").agg(F.max_by("t", "seq").alias("t"))
        bare = F.regexp_replace(F.regexp_replace("var", r"\{.*$", ""), r"[&\s]", "")
        go = go.join(var_type, ["ctx", "var"], "left").withColumn("type", F.coalesce("t", bare))
        classes = facts.symbols().filter("type = 'class'")
        here = classes.select("repo", "file", F.col("name").alias("type"), F.col("id").alias("here"))
        only = classes.groupBy("repo", F.col("name").alias("type")).agg(F.min("id").alias("only"), F.count(F.lit(1)).alias("k")).filter("k = 1").drop("k")
        impl = go.join(here, ["repo", "file", "type"], "left").join(only, ["repo", "type"], "left").withColumn("class", F.coalesce("here", "only")).filter("class is not null").select("service", "class").distinct()
        wanted = impl.join(rpcs, "service").withColumn("key", F.concat(F.col("class"), F.lit("\x1f"), rpc_id)).withColumn("dst", rpc_id)
        found = find_methods(wanted.select("key", "class", F.col("rpc").alias("method")), up, facts).join(wanted.select("key", "dst"), "key")
        out = out.unionByName(edge(impl.withColumn("dst", service_id), "class", "dst")).unionByName(edge(found, "id", "dst"))

    if facts.has("js_service"):
        js = facts.of("js_service", "repo", "file", "ctx", "seq", F.col("a").alias("service"), F.col("b").alias("scope"), "pairs").join(services, "service")
        each = js.select("repo", "file", "ctx", "seq", "service", F.explode("pairs").alias("name", "spelling")).withColumn("key", F.concat_ws("\x1f", "ctx", F.col("seq").cast("string"), "name"))
        target = match_rpc(each.select("key", "service", "name"), rpcs)
        handler = references(each.select("key", "repo", "file", "spelling"), facts)
        out = out.unionByName(edge(js.withColumn("dst", service_id), "scope", "dst")).unionByName(edge(handler.join(target, "key"), "id", "rpc_id"))
    return out.distinct().select("src", "dst", F.lit("IMPLEMENTS").alias("relation"), F.lit("Lcontract").alias("layer"))


def consumers(facts: Facts) -> tuple[DataFrame, DataFrame]:
    """J13, J15. CONSUMES edges of calls through service clients, and the calls (caller, service, method, ctx) that no
    contract has. Contracts are global, so a client binds to services of any repository."""
    client = facts.of("client_var", "ctx", F.col("a").alias("var"), F.col("b").alias("service"), "seq").groupBy("ctx", "var").agg(F.max_by("service", "seq").alias("service"))
    attr = facts.of("attr_call", "ctx", F.col("a").alias("caller"), F.col("b").alias("var"), F.col("c").alias("method"))
    direct = facts.of("rpc_call", "ctx", F.col("a").alias("caller"), F.col("b").alias("service"), F.col("c").alias("method"))
    used = attr.join(client, ["ctx", "var"]).select("ctx", "caller", "service", "method").unionByName(direct).groupBy("caller", "service", "method").agg(F.min("ctx").alias("ctx"))
    used = used.withColumn("key", F.concat_ws("\x1f", "caller", "service", "method"))
    hit = match_rpc(used.select("key", "service", F.col("method").alias("name")), contracts(facts))
    edges = used.join(hit, "key").select(F.col("caller").alias("src"), F.col("rpc_id").alias("dst"), F.lit("CONSUMES").alias("relation"), F.lit("Lcontract").alias("layer"), F.col("ctx").alias("id_ctx")).dropDuplicates(["src", "dst"])
    return edges, used.join(hit, "key", "left_anti").select("caller", "service", "method", "ctx")
