"""Extraction and resolution on a small repository in four languages (S, X, J)."""

import pytest
from fixtures import SHOP

from codeloom.operators import heal, lookup, relational, resolve, traverse
from codeloom.plans.build import build
from codeloom.sources.repo import files_table


@pytest.fixture(scope="module")
def files(spark):
    return files_table(spark, [r for r in SHOP if not r[1].startswith("vendor/")])


@pytest.fixture(scope="module")
def graph(files):
    return build(files)


@pytest.fixture(scope="module")
def edges(graph):
    rows = graph.edges.select("src", "relation", "dst").collect()
    return {(r.src, r.relation, r.dst) for r in rows}


@pytest.fixture(scope="module")
def nodes(graph):
    return {r.id: r for r in graph.nodes.collect()}


ORDER = "services/order/order.py:OrderService"


def test_every_edge_ends_at_a_node(edges, nodes):
    assert {e for s, _, d in edges for e in (s, d)} <= set(nodes)


def test_ids_and_types(nodes):
    assert nodes["file::services/order/order.py"].type == "file"
    assert nodes[f"{ORDER}.place"].type == "function"
    assert nodes[f"{ORDER}.place.var::items"].type == "variable"
    assert nodes["services/web/client.ts:Color"].type == "type"
    assert nodes["services/web/client.ts:Shape"].type == "class"
    assert nodes["contract::ShippingService.GetQuote"].request_type == "QuoteRequest"
    assert nodes["contract::ShippingService"].file == "" and len(nodes["contract::ShippingService"].definitions) == 1
    assert sorted(n.ord for n in nodes.values()) == list(range(1, len(nodes) + 1))


def test_docstrings(nodes):
    assert nodes["services/web/client.ts:CartPage"].docstring == "Loads the cart of a customer."
    assert nodes["services/shipping/main.go:ShippingServer"].docstring == "ShippingServer answers quotes."


@pytest.mark.parametrize("name", ["cart", "items", "key", "rest", "self"])
def test_parameters_of_all_kinds(edges, name):
    assert (f"{ORDER}.place", "PASSES_ARG", f"{ORDER}.place.var::{name}") in edges


def test_contains(edges):
    assert ("file::services/order/order.py", "CONTAINS", ORDER) in edges
    assert (ORDER, "CONTAINS", f"{ORDER}.place") in edges
    assert ("services/shipping/main.go:ShippingServer", "CONTAINS", "services/shipping/main.go:ShippingServer.GetQuote") in edges
    assert ("file::protos/shop.proto", "CONTAINS", "contract::CartService") in edges


def test_imports(edges):
    assert ("file::services/order/order.py", "IMPORTS", "module::requests") in edges
    assert ("file::services/order/order.py", "IMPORTS", "symbol::services.order.helpers.price") in edges
    assert ("file::services/web/client.ts", "IMPORTS", "symbol::services.web.net.request") in edges
    assert ("file::services/shipping/main.go", "IMPORTS", "module::net/http") in edges


def test_inheritance_and_super(edges):
    assert (ORDER, "EXTENDS", "services/order/base.py:BaseOrder") in edges
    assert ("services/cart/cart.py:RedisCart", "EXTENDS", "services/cart/cart.py:Cart") in edges
    assert ("services/web/client.ts:CartPage", "EXTENDS", "symbol::Page") in edges
    assert (f"{ORDER}.audit", "CALLS", "services/order/base.py:BaseOrder.audit") in edges
    assert (f"{ORDER}.place", "CALLS", f"{ORDER}.audit") in edges


def test_calls_through_imports(edges):
    assert (f"{ORDER}.place", "CALLS", "services/order/helpers.py:price") in edges
    assert ("services/web/client.ts:CartPage.load", "CALLS", "services/web/net.ts:request") in edges
    assert ("services/web/client.ts:start", "CALLS", "services/web/client.ts:CartPage.load") in edges
    assert (f"{ORDER}.place", "CALLS", "external::requests.post") in edges


def test_dataflow(edges):
    p = f"{ORDER}.place"
    assert (p, "DEFINES", f"{p}.var::total") in edges
    assert (p, "MUTATES", f"{p}.var::total") in edges
    assert (p, "USES", f"{p}.var::total") in edges
    assert any(r == "FLOWS_TO" and s == f"{p}.var::total" for s, r, _ in edges)
    h = "services/order/helpers.py:price"
    assert {(h, "DEFINES", f"{h}.var::{v}") for v in ("line", "f", "amount")} <= edges
    g = "services/shipping/main.go:ShippingServer.GetQuote"
    assert {(g, "DEFINES", f"{g}.var::{v}") for v in ("cart", "got", "err", "fee")} | {(g, "MUTATES", f"{g}.var::fee")} <= edges


def test_http(edges, nodes):
    assert (f"{ORDER}.place", "HTTP_CALLS", "services/shipping/main.go:shipHandler") in edges
    assert ("services/web/client.ts:CartPage.load", "HTTP_CALLS", "services/cart/cart.py:cart_view") in edges
    assert nodes["services/cart/cart.py:cart_view"].http_methods == ["GET", "POST"]
    assert nodes["services/pay/server.js:getCart"].http_path == "/pay"


def test_contract_producers(edges):
    assert ("services/cart/cart.py:Cart", "IMPLEMENTS", "contract::CartService") in edges
    assert ("services/cart/cart.py:RedisCart.GetCart", "IMPLEMENTS", "contract::CartService.GetCart") in edges
    assert ("services/shipping/main.go:ShippingServer", "IMPLEMENTS", "contract::ShippingService") in edges
    assert ("services/shipping/main.go:ShippingServer.GetQuote", "IMPLEMENTS", "contract::ShippingService.GetQuote") in edges
    assert ("services/pay/server.js:main", "IMPLEMENTS", "contract::CartService") in edges
    assert ("services/pay/server.js:getCart", "IMPLEMENTS", "contract::CartService.GetCart") in edges


def test_contract_consumers(edges):
    assert (f"{ORDER}.place", "CONSUMES", "contract::ShippingService.GetQuote") in edges
    assert ("services/shipping/main.go:ShippingServer.GetQuote", "CONSUMES", "contract::CartService.GetCart") in edges


def test_who_and_downstream(spark, graph):
    c = traverse.roots(spark, "contract::ShippingService")
    assert [r.entity for r in traverse.bound_entities(graph.edges, c, "CONSUMES").collect()] == [f"{ORDER}.place"]
    got = traverse.downstream_consumers(graph.nodes, graph.edges, c).collect()
    assert [(r.consumer_node, r.service, r.target_contract) for r in got] == [(f"{ORDER}.place", "order", "contract::ShippingService.GetQuote")]
    bound = traverse.contract_of(graph.nodes, graph.edges, traverse.roots(spark, f"{ORDER}.place")).collect()
    assert {(r.contract_node, r.role) for r in bound} == {("contract::ShippingService.GetQuote", "consumes"), ("services/shipping/main.go:shipHandler", "consumes")}


def test_lookup(graph):
    first = lambda df: [r.id for r in df.collect()]
    assert first(lookup.by_name(graph.nodes, "ShippingService")) == ["contract::ShippingService"]
    assert first(lookup.by_name(graph.nodes, "price")) == ["services/order/helpers.py:price"]
    assert first(lookup.contract(graph.nodes, "getquote")) == ["contract::ShippingService.GetQuote"]
    assert first(lookup.fuzzy(graph.nodes, "REDISCART", ignore_case=True)) == ["services/cart/cart.py:RedisCart"]
    assert first(lookup.fuzzy(graph.nodes, "nothing like this")) == []


def test_explain_and_grafts(spark, graph):
    row = traverse.explain(graph.edges).filter(f"id = '{ORDER}.place'").first()
    assert [p.other for p in row.parents] == [ORDER]
    assert f"{ORDER}.audit" in [c.other for c in row.outward_calls]
    found, inside = traverse.subtree(graph.edges, traverse.roots(spark, ORDER))
    assert f"{ORDER}.place.var::total" in {r.id for r in found.collect()}
    assert "def place" in traverse.subtree_text(graph.nodes, found).first().context
    blocks = traverse.budget_graft(graph.nodes, graph.edges, traverse.roots(spark, f"{ORDER}.place"), 300).orderBy("running").collect()
    assert blocks[0].dist == 0 and blocks[0].block.startswith("=== TARGET FOCUS [FUNCTION]") and len(blocks) > 1 and blocks[-1].running <= 300
    assert traverse.budget_graft(graph.nodes, graph.edges, traverse.roots(spark, f"{ORDER}.place"), 1).count() == 1
    assert traverse.ast_graft(graph.edges, traverse.roots(spark, ORDER)).count() >= 3


def test_verify(graph):
    r = relational.verify(graph.nodes, graph.edges).first()
    assert r.total_nodes == graph.nodes.count() and r.contract_services == 2
    assert r.isolated_nodes_count == 1  # the empty __init__.py
    assert 0 < r.call_graph_resolution_rate_pct < 100 and r.dataflow_def_use_linked_vars > 0


def test_no_false_alarms_but_missing_rpc(graph):
    kinds = {(r.type, r.rpc) for r in heal.diagnose(graph).collect()}
    assert kinds == {("MISSING_IMPLEMENTATION", "ShipOrder")}


def test_repair_loop(files):
    """A renamed rpc is found, attributed, patched, validated, and the patched sources build without it."""
    broken = heal.inject(files, "rename-rpc", "GetQuote", "GetQuotes")
    g = build(broken, semantic=False)
    causes = heal.attribute(heal.diagnose(g))
    row = causes.filter("type = 'RENAMED_RPC'").collect()
    assert [(r.old, r.target, r.service) for r in row] == [("GetQuote", "GetQuotes", "ShippingService")] and row[0].confidence >= 0.85
    changes = heal.validate(heal.patches(causes, broken))
    done = {r.path: r for r in changes.collect()}
    assert "-        quote = client.GetQuote(cart)" in done["services/order/order.py"].diff
    assert all(r.status == "VALID" for r in done.values())
    assert heal.proposals(g, causes, changes).filter("type = 'RENAMED_RPC'").first().title == "Rename call GetQuote to GetQuotes"
    healed = build(heal.apply_to(broken, changes), semantic=False)
    assert heal.diagnose(healed).filter("type = 'RENAMED_RPC'").count() == 0
    lost = relational.lost(heal.bindings(g.edges), heal.bindings(healed.edges))
    assert lost.count() == 0


def test_polymorphic_dispatch_sums_to_one(spark):
    rows = [("", "m.py", '''class Base:
    def run(self):
        """Runs a base job."""
        return 1

class A(Base):
    def run(self):
        """Runs an alpha job."""
        return 2

class B(Base):
    def run(self):
        """Runs a beta job."""
        return 3

def go(x: Base):
    """Runs an alpha job for a caller."""
    return x.run()
''')]
    g = build(files_table(spark, rows), semantic=False)
    poly = g.edges.filter("relation = 'POLYMORPHIC_CALL'").collect()
    assert {e.dst for e in poly} == {"m.py:Base.run", "m.py:A.run", "m.py:B.run"}
    assert abs(sum(e.c_type for e in poly) - 1) < 0.01 and max(poly, key=lambda e: e.c_type).dst == "m.py:A.run"


def test_same_named_functions_do_not_cross_services(spark):
    rows = [("", "a/x.py", "def f():\n    return shared()\n"), ("", "b/y.py", "def shared():\n    return 1\n")]
    g = build(files_table(spark, rows), semantic=False)
    assert [e.dst for e in g.edges.filter("relation = 'CALLS'").collect()] == ["external::shared"]


def test_long_return_types_keep_the_body(spark):
    union = " | ".join(f'"k{i}"' for i in range(40))
    rows = [("", "m.ts", f"function g() {{ return 1; }}\nfunction f(a: number): {union} {{ return g(); }}\nfunction h(): Promise<{{ a: {union}; b: () => void }}> {{ return g(); }}\n")]
    g = build(files_table(spark, rows), semantic=False)
    assert {(e.src, e.dst) for e in g.edges.filter("relation = 'CALLS'").collect()} >= {("m.ts:f", "m.ts:g"), ("m.ts:h", "m.ts:g")}


def test_ancestors_over_many_levels(spark):
    known = spark.createDataFrame([(f"c{i}", f"c{i - 1}", 0, 1) for i in range(1, 37)], "class string, base string, pos int, k long")
    up = {(r["class"], r.base) for r in resolve.ancestors(known).collect()}
    assert len(up) == 37 * 38 // 2 and ("c36", "c0") in up
    with pytest.raises(RuntimeError):
        resolve.ancestors(known.limit(4), max_levels=2)


def test_problem_files_do_not_stop_a_build(spark):
    rows = [("", "bad.py", "def f(:\n"), ("", "good.py", "def g():\n    return 1\n"), ("", "bad.js", "function ( { [ `"), ("", "bad.go", "func (")]
    g = build(files_table(spark, rows), semantic=False)
    assert g.facts.filter("kind = 'problem'").count() == 1
    assert {"file::bad.py", "good.py:g", "file::bad.js"} <= {r.id for r in g.nodes.collect()}
