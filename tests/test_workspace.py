"""Workspaces, manifests, scans, sinks, facades and the incremental store (S, U, A, K, I)."""

import json
import os
import threading
import urllib.request

import pytest
from fixtures import PROTO, SHOP

from codeloom import cli, server
from codeloom.api import CodeGraph
from codeloom.operators import relational
from codeloom.plans.build import build
from codeloom.plans.workspace import build_workspace, cached_graph, scan_workspace, union_graphs
from codeloom.sources import manifest, sinks
from codeloom.sources.modules import candidates
from codeloom.sources.repo import config_of, files_table, lines_of, read_config, scan
from codeloom.storage import content_key, load_graph, save_graph
from codeloom.streaming.incremental import FactStore, change_rows


def write(root, files):
    for path, text in files.items():
        full = os.path.join(root, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "w", encoding="utf-8") as f:
            f.write(text)


@pytest.fixture(scope="module")
def shop(tmp_path_factory):
    root = tmp_path_factory.mktemp("shop")
    write(root, {p: t for _, p, t in SHOP} | {".ckgignore": "# generated\ngen/*\n", "gen/x.py": "a = 1\n", "services/web/app_pb.js": "var a;\n", "with space/ü+.py": "def f():\n    pass\n"})
    return str(root)


@pytest.fixture(scope="module")
def places(tmp_path_factory):
    top = tmp_path_factory.mktemp("ws")
    changed = PROTO.replace("(QuoteRequest)", "(OtherRequest)")
    write(top, {
        "front/src/main.go": 'package main\n\nfunc main() {\n\thttp.Get("http://api/items")\n}\n',
        "front/protos/shop.proto": PROTO,
        "back/src/main.go": "package main\n\nfunc main() {}\n",
        "back/protos/shop.proto": changed,
        "back/api.py": '@app.get("/items")\ndef items():\n    """All the items of the shop catalogue."""\n    return stub.GetCart(1)\n\nstub = g.CartServiceStub(c)\n',
        "shared/common.proto": "service Audit { rpc Log(Entry) returns (Ack); }\n",
        "workspace.yaml": "name: demo\nversion: 2\nrepositories:\n  - id: front\n    path: front\n    language: go\n  - back\nshared_contracts:\n  - shared\nignore_patterns:\n  - skipped/*\n",
        "back/skipped/no.py": "def no():\n    pass\n",
    })
    return str(top)


@pytest.fixture(scope="module")
def ws(spark, places):
    return build_workspace(spark, manifest.load(f"{places}/workspace.yaml"))


def test_scan_ignores_and_finds_hidden_names(spark, shop):
    paths = {r.path for r in scan(spark, shop).select("path").collect()}
    assert {"services/order/__init__.py", "protos/shop.proto", "services/web/client.ts", "with space/ü+.py"} <= paths
    assert not paths & {"vendor/x/lib.py", "gen/x.py", "services/web/app_pb.js"}


def test_lines(spark):
    files = files_table(spark, [("", "a.py", "x\ny\r\nz"), ("", "b.py", ""), ("", "c.py", "x\n"), ("", "d.py", b"\xff\n\n")])
    assert {r.path: r.lines for r in lines_of(files).collect()} == {p: len(t.splitlines()) for p, t in {"a.py": "x\ny\r\nz", "b.py": "", "c.py": "x\n", "d.py": "?\n\n"}.items()}


def test_manifest_forms():
    text = "name: demo\nrepositories:\n  - id: a\n    path: x/a\n  - x/b\nignore_patterns:\n  - gen/*\n"
    for m in (manifest.parse(text, "/w"), manifest.parse(json.dumps({"workspace": {"name": "demo", "repos": [{"id": "a", "path": "x/a"}, "x/b"], "ignore_patterns": ["gen/*"]}}), "/w", True)):
        assert m.name == "demo" and [(r.id, r.path) for r in m.repositories] == [("a", "/w/x/a"), ("b", "/w/x/b")] and m.ignore_patterns == ["gen/*"]
    assert manifest._lines(text) == {"name": "demo", "repositories": [{"id": "a", "path": "x/a"}, "x/b"], "ignore_patterns": ["gen/*"]}


def test_module_specifiers():
    c = config_of({
        "tsconfig.json": json.dumps({"compilerOptions": {"paths": {"@lib/*": ["src/lib/*"], "exact": ["src/one"]}}}),
        "packages/ui/package.json": json.dumps({"name": "@w/ui", "main": "./src/index.ts", "exports": {"./button": {"import": "./src/button.ts"}}}),
    })
    assert candidates("a/b/c.ts", "../x/y", c) == ["a.x.y"] and candidates("a/b.ts", "./index", c) == ["a"]
    assert candidates("a.ts", "@lib/k", c) == ["src.lib.k"] and candidates("a.ts", "exact", c) == ["src.one"]
    assert candidates("a.ts", "@w/ui", c) == ["packages.ui.src"] and candidates("a.ts", "@w/ui/button", c) == ["packages.ui.src.button"]
    assert candidates("a.ts", "react", c) == []


def test_ids_do_not_collide(ws):
    ids = {r.id for r in ws.nodes.collect()}
    assert {"front/src/main.go:main", "back/src/main.go:main", "file::shared_contracts/common.proto"} <= ids
    assert not any("skipped" in i for i in ids)


def test_contracts_unify_and_skew_is_found(ws):
    nodes = {r.id: r for r in ws.nodes.filter("layer = 'Lcontract'").collect()}
    assert {d.repo_id for d in nodes["contract::ShippingService"].definitions} == {"front", "back"}
    assert nodes["contract::ShippingService.GetQuote"].skew and not nodes["contract::ShippingService.ShipOrder"].skew
    assert {(r.service, r.rpc) for r in ws.skews.collect()} == {("ShippingService", ""), ("CartService", ""), ("ShippingService", "GetQuote")}


def test_bindings_across_repositories(ws):
    got = {(r.src, r.relation, r.dst) for r in ws.edges.filter("relation in ('HTTP_CALLS', 'CONSUMES')").collect()}
    assert ("front/src/main.go:main", "HTTP_CALLS", "back/api.py:items") in got
    assert ("back/api.py:items", "CONSUMES", "contract::CartService.GetCart") in got


def test_union_of_graphs(spark, ws):
    a, b = ws.nodes.filter("repo = 'front'"), ws.nodes.filter("repo = 'back' or layer = 'Lcontract'")
    nodes, edges = union_graphs([("front", a, ws.edges.limit(3)), ("back", b, ws.edges.limit(2))])
    assert nodes.count() == a.unionByName(b).select("id").distinct().count() and edges.count() == 5
    assert relational.collisions(a, b).count() == 0
    assert all(r.edge_id.startswith("w_") for r in edges.collect())


def test_incremental_equals_rebuild(spark, tmp_path):
    """A changed, an added and a deleted file by a stream of changes give the graph of a build from scratch."""
    base = {p: t for _, p, t in SHOP if p.startswith("services/order") or p.endswith(".proto")}
    store, inbox = FactStore(spark, str(tmp_path / "store")), str(tmp_path / "in")
    change_rows(spark, 1, base).coalesce(1).write.mode("append").parquet(inbox)
    store.stream(inbox).awaitTermination()
    new = {"services/order/helpers.py": "def price(cart):\n    return other(cart)\n\n\ndef other(x):\n    return x\n", "services/order/extra.py": "from .helpers import price\n\n\ndef again(c):\n    return price(c)\n"}
    change_rows(spark, 2, new, ("services/order/base.py",)).coalesce(1).write.mode("append").parquet(inbox)
    store.stream(inbox).awaitTermination()
    now = {k: v for k, v in (base | new).items() if k != "services/order/base.py"}
    want = build(files_table(spark, [("", p, t) for p, t in now.items()]))
    got = store.graph()
    key = lambda g: sorted((r.src, r.relation, r.dst, round(r.c_type, 4), r.f_call) for r in g.edges.collect())
    assert key(got) == key(want)
    assert sorted(r.id for r in got.nodes.collect()) == sorted(r.id for r in want.nodes.collect())


@pytest.fixture(scope="module")
def api(spark, shop):
    return CodeGraph.of_repo(spark, shop)


def test_facade(api):
    place = "services/order/order.py:OrderService.place"
    assert api.resolve("OrderService") == "services/order/order.py:OrderService"
    assert {r["relation"] for r in api.adjacency_query(place, ["Lcontract"])} == {"CONSUMES"}
    assert api.adjacency_query("nothing") == []
    blast = api.blast_radius("place", 1)
    assert blast["root"] == place and blast["impact_score"] == blast["impacted_nodes"] + 2 * blast["affected_files"] + 5 * blast["affected_services"]
    assert api.explain_node(place)["name"] == "place"
    assert api.who_implements("CartService")[0]["entity"] == "services/cart/cart.py:Cart"
    assert api.contract_of("place")["is_contract_bound"]
    assert api.budget_graft("place", 200)["approx_tokens"] <= 200
    hits = api.rag_query("quote of a customer's order", 3)
    assert "order" in hits["top_matches"][0]["id"] and hits["graft"]["total_nodes"] >= 1
    assert api.bm25_query("price cart")[0]["score"] > 0
    assert api.verify_graph()["total_loc"] > 50
    with pytest.raises(LookupError):
        api.blast_radius("no such thing")
    assert [d["type"] for d in api.diagnose()] == ["MISSING_IMPLEMENTATION"]
    assert api.remediate()[0]["status"] == "READY_FOR_HUMAN_REVIEW"


def test_shell_and_server(api):
    assert cli.answer(api, "nope")["error"] and "error" in cli.answer(api, "explain nothing-like-it")
    assert cli.answer(api, "consumers ShippingService")[0]["service"] == "order"
    s = server.serve(api)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    get = lambda p: json.load(urllib.request.urlopen(f"http://127.0.0.1:{s.server_port}{p}"))
    assert get("/api/nhop?node=RedisCart&depth=1")["root"] == "services/cart/cart.py:RedisCart"
    assert server.respond(api, "/api/nhop?node=zzzz")[0] == 404 and server.respond(api, "/x")[0] == 404
    assert len(server.respond(api, "/api/graph")[1]["nodes"]) > 50
    s.shutdown()


def test_sinks_round_trip(spark, api, tmp_path):
    n, e = api.g.nodes, api.g.edges
    for name in ("g.graphml", "g.gexf", "g.json", "g.html", "csv"):
        api.export(str(tmp_path / name))
    back_n, back_e = sinks.read_graphml(spark, str(tmp_path / "g.graphml"))
    assert sorted(r.id for r in back_n.collect()) == sorted(r.id for r in n.collect()) and back_e.count() == e.count()
    doc = json.load(open(tmp_path / "g.json"))
    assert len(doc["nodes"]) == n.count() and len(doc["links"]) == e.count() and doc["multigraph"]
    assert spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "csv/nodes")).count() == n.count()
    save_graph(n, e, str(tmp_path / "saved"))
    n2, e2 = load_graph(spark, str(tmp_path / "saved"))
    assert n2.count() == n.count() and e2.filter("layer = 'Ldep'").count() == e.filter("layer = 'Ldep'").count()


def test_content_key(spark):
    a = files_table(spark, [("", "a.py", "x"), ("", "b.py", "y")])
    assert content_key(a) == content_key(a.orderBy("path", ascending=False)) != content_key(files_table(spark, [("", "a.py", "x"), ("", "b.py", "z")]))


def test_graphs_are_kept_by_content(spark, tmp_path):
    files = files_table(spark, [("", "a.py", "def f():\n    return 1\n")])
    first = cached_graph(files, str(tmp_path))[0].count()
    made = os.listdir(tmp_path)
    assert cached_graph(files, str(tmp_path))[0].count() == first and os.listdir(tmp_path) == made == [content_key(files)]


def test_workspace_facade(spark, places):
    ws, _ = manifest.load(f"{places}/workspace.yaml"), None
    assert scan_workspace(spark, ws)[0].select("repo").distinct().count() == 3
    g = CodeGraph.of_workspace(spark, f"{places}/workspace.yaml")
    report = g.verify_graph()
    assert {r["repo"] for r in report["repositories"]} >= {"front", "back"} and report["skews"]
    assert g.rag_query("items of the shop catalogue")["top_matches"][0]["id"] == "back/api.py:items"


def test_repositories_that_only_spark_can_open(spark, tmp_path):
    root = tmp_path / "remote"
    for path, said in {
        "a.ts": "import { x } from '@lib/k';\n", "src/lib/k.ts": "export function x() {}\n", "gen/b.ts": "let y = 1;\n", ".ckgignore": "# made\ngen/*\n",
        "tsconfig.json": json.dumps({"compilerOptions": {"paths": {"@lib/*": ["src/lib/*"]}}}), "ui/package.json": json.dumps({"name": "@w/ui", "main": "m.ts"}), "node_modules/z/package.json": json.dumps({"name": "z"}),
    }.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(said)
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.far.link./in", f"file://{root}")
    assert {r.path for r in scan(spark, "viewfs://far/in").select("path").collect()} == {"a.ts", "src/lib/k.ts"}
    config = read_config("viewfs://far/in", spark)
    assert config.ts_paths == [("@lib/*", ["src/lib/*"])] and set(config.packages) == {"@w/ui"} and config.packages["@w/ui"]["directory"] == "ui"
    with pytest.raises(ValueError):
        read_config("viewfs://far/in")


def test_imports_by_tokens():
    from codeloom.extract import jslike
    from codeloom.extract.proto import services
    from codeloom.extract.tokens import Tokens

    text = "import d, { a as b, type T, c } from 'm'; import * as n from \"k\"; import type { Z } from 'z'; import 's';\nconst { p: q, r } = require('x'), one = require(`y`); // import no from 'no'\nlet { e } = require('f').g; foo(require('h'));"
    assert jslike.imports(Tokens(text)) == [("d", "m", ""), ("b", "m", "a"), ("T", "m", "T"), ("c", "m", "c"), ("n", "k", ""), ("q", "x", "p"), ("r", "x", "r"), ("e", "f", "e")]
    proto = "package a.b ; service S { rpc A(X) returns (Y) { option (o) = { k: 1 }; } rpc B(stream X) returns (Y); rpc C(X) returns (a.Y); /* rpc D(X) returns (Y); */ rpc E ( X )\n returns ( Y ); }"
    assert services(proto) == [("S", [("A", "X", "Y"), ("E", "X", "Y")])]
