"""Queries on a workspace of two repositories in four languages, generated out of the suppliers, with the SQL of what must
come out: class hierarchies and dispatch, Go and JavaScript services, bindings across repositories, defects and their repair.

Every supplier is some files of its own, so the number of files grows with the table and no file does. Repository `back`
has the services, `front` their clients.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.text import utf8
from codeloom.operators import heal, relational
from codeloom.plans.build import Graph, build
from codeloom.plans.commerce import files, table
from codeloom.storage import kept, signature, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Files of a supplier; {} stands for its key.
TEXTS = {
    "back/svc{}/model.py": """class Root{}:
    def run(self, x):
        return x

    def stop(self):
        return None


class Left{}(Root{}):
    def run(self, x):
        return super().run(x)


class Right{}(Root{}):
    pass


class Leaf{}(Left{}, Right{}):
    def run(self, x):
        self.stop()
        self.stop()
        return x
""",
    "back/svc{}/tools.py": "def ping(x):\n    return x\n",
    "back/svc{}/use.py": """import svc{}.tools as kit
from svc{}.model import Root{}, Leaf{}


def poly{}():
    obj = Root{}()
    return obj.run(1)


def mono{}():
    obj = Leaf{}()
    return obj.run(1)


def alias{}():
    return kit.ping(2)
""",
    "back/svc{}/web.py": """from flask import Flask

app = Flask(__name__)


@app.route('/x/s{}')
def serve{}():
    return 1
""",
    "back/quote{}/main.go": """package main

import (
    pb "example.com/genproto"
)

type Server{} struct{ n int }

func (s *Server{}) Quote{}(ctx context.Context, req *pb.Req) (*pb.Res, error) {
    return nil, nil
}

func main() {
    srv := new(Server{})
    pb.RegisterQuote{}ServiceServer(server, srv)
}
""",
    "back/pay{}/server.js": """function pay{}(call, cb) { cb(null, 1); }
function main() { server.addService(proto.Pay{}Service.service, { Pay{}: pay{} }); }
""",
    "back/protos/x{}.proto": """syntax = "proto3";
service Quote{}Service { rpc Quote{}(Req) returns (Res); }
service Pay{}Service {
  rpc Pay{}(Req) returns (Res);
}
""",
    "front/client{}.py": """import requests
import x_pb2_grpc

stub = x_pb2_grpc.Quote{}ServiceStub(None)


def ask{}(x):
    return stub.Quote{}(x)


def fetch{}(x):
    return requests.get('http://back/x/s{}')
""",
    "front/web/app{}.ts": """import { send{} as post } from "./net{}";
export function load{}(id) { return post(id); }
""",
    "front/web/net{}.ts": "export function send{}(url) { return url; }\n",
}
#: Files of every third supplier (a client of an rpc that is not there), of every fourth (an rpc that nothing implements)
#: and of every fifth (a contract that the other repository has otherwise).
LOST = {"front/lost{}.py": "import x_pb2_grpc\n\nstub = x_pb2_grpc.Quote{}ServiceStub(None)\n\n\ndef lost{}(x):\n    return stub.Quot{}(x)\n"}
SPARE = {"back/protos/y{}.proto": "syntax = \"proto3\";\nservice Svc{}Service { rpc Spare{}(Req) returns (Res); }\n"}
SKEW = {"front/protos/x{}.proto": "syntax = \"proto3\";\nservice Pay{}Service {\n  rpc Pay{}(New) returns (Res);\n}\n"}


def sources(spark: SparkSession, sf: str) -> DataFrame:
    """(repo, path, ext, content): the files of both repositories."""
    x = F.col("s_suppkey").cast("string")
    some = [(TEXTS, 1), (LOST, 3), (SPARE, 4), (SKEW, 5)]
    each = [F.when(F.col("s_suppkey") % n == 0, F.struct(F.replace(F.lit(p), F.lit("{}"), x).alias("path"), F.replace(F.lit(t), F.lit("{}"), x).alias("text"))) for texts, n in some for p, t in texts.items()]
    rows = table(spark, sf, "supplier").select(F.explode(F.array_compact(F.array(*each))).alias("f")).select("f.path", "f.text")
    repo, path = F.split_part("path", F.lit("/"), F.lit(1)), F.expr("substring(path, instr(path, '/') + 1)")
    return rows.select(repo.alias("repo"), path.alias("path"), F.concat(F.lit("."), F.element_at(F.split("path", r"\."), -1)).alias("ext"), F.col("text").cast("binary").alias("content"))


@dataclass
class Built:
    graph: Graph
    files: DataFrame


_BUILT: dict[tuple[str, str, str], Built] = {}


def built(spark: SparkSession, sf: str) -> Built:
    """The graph of the workspace, built once for an application and state of the table."""
    inputs = files(sf, "supplier")
    key = (spark.sparkContext.applicationId, sf, signature(spark, *inputs))
    if key not in _BUILT:
        made = kept(spark, (sf, "polyglot-files"), lambda: sources(spark, sf), inputs=inputs)
        _BUILT[key] = Built(build(made, workspace=True, semantic=False), made)
    return _BUILT[key]


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def edges_of(spark: SparkSession, sf: str, *relations: str) -> DataFrame:
    """Edges with their metadata and how often each is there."""
    e = built(spark, sf).graph.related(*relations)
    return e.groupBy("src", "dst", "relation", "layer", "d_scope", "f_call", "c_type").agg(F.count(F.lit(1)).alias("n"))


def edges_sql(*rows: tuple) -> str:
    """SQL of edges (src, dst, relation, layer, d_scope, f_call, c_type, condition), {} standing for a supplier's key."""
    lit = lambda s: "replace('" + s + "', '{}', x)"
    each = [f"SELECT {lit(a)} AS src, {lit(b)} AS dst, '{rel}' AS relation, '{layer}' AS layer, CAST({scope} AS INTEGER) AS d_scope, CAST({f} AS DOUBLE) AS f_call, CAST({c} AS DOUBLE) AS c_type, CAST(1 AS BIGINT) AS n FROM s WHERE {where}" for a, b, rel, layer, scope, f, c, where in rows]
    return f"WITH {S} " + " UNION ALL ".join(each)


S = "s AS (SELECT CAST(s_suppkey AS VARCHAR) AS x, s_suppkey AS k FROM supplier)"
MODEL, USE = "back/svc{}/model.py:", "back/svc{}/use.py:"


def call(src: str, dst: str, scope: int = 1, f: int = 1, c: float = 1, where: str = "true") -> tuple:
    return src, dst, "CALLS", "Ldep", scope, f, c, where


@query(edges_sql(
    call(MODEL + "Leaf{}.run", MODEL + "Root{}.stop", 2, 2), call(MODEL + "Left{}.run", MODEL + "Root{}.run", 2), call(MODEL + "Left{}.run", "external::super", 2, 1, 0.5), call(USE + "alias{}", "back/svc{}/tools.py:ping"),
    call(USE + "mono{}", MODEL + "Leaf{}"), call(USE + "mono{}", MODEL + "Leaf{}.run"), call(USE + "poly{}", MODEL + "Root{}"), call("back/svc{}/web.py:serve{}", "external::app.route", 1, 1, 0.5),
    call("front/web/app{}.ts:load{}", "front/web/net{}.ts:send{}"), call("back/pay{}/server.js:main", "external::server.addService", 1, 1, 0.5), call("back/pay{}/server.js:pay{}", "external::cb", 1, 1, 0.5),
    call("back/quote{}/main.go:main", "external::pb.RegisterQuote{}ServiceServer", 1, 1, 0.5), call("back/quote{}/main.go:main", "external::new", 1, 1, 0.5), call("front/client{}.py:ask{}", "external::stub.Quote{}", 1, 1, 0.5),
    call("front/client{}.py:fetch{}", "external::requests.get", 1, 1, 0.5), call("front/lost{}.py:lost{}", "external::stub.Quot{}", 1, 1, 0.5, "k % 3 = 0"),
))
def poly_calls(spark, sf):
    """Inherited through a diamond, super, receiver, alias and specifier calls with their metadata;
    two call sites of one method are one edge."""
    return edges_of(spark, sf, "CALLS")


@query(f"WITH {S}, o AS (SELECT unnest(['Root', 'Left', 'Leaf']) AS o) SELECT 'back/svc' || x || '/use.py:poly' || x AS src, 'back/svc' || x || '/model.py:' || o || x || '.run' AS dst, CAST(1 AS BIGINT) AS n, 1.0::DOUBLE AS total FROM s, o")
def poly_dispatch(spark, sf):
    """A receiver's method and its overrides in all subclasses, with confidences that sum to one."""
    total = edges_of(spark, sf, "POLYMORPHIC_CALL").groupBy("src").agg(F.round(F.sum("c_type"), 3).alias("total"))
    return edges_of(spark, sf, "POLYMORPHIC_CALL").select("src", "dst", "n").join(total, "src")


@query(edges_sql(*[(MODEL + a, MODEL + b, "EXTENDS", "Ldep", 0, 1, 1, "true") for a, b in (("Left{}", "Root{}"), ("Right{}", "Root{}"), ("Leaf{}", "Left{}"), ("Leaf{}", "Right{}"))]))
def poly_extends(spark, sf):
    """J3 with two bases."""
    return edges_of(spark, sf, "EXTENDS")


@query(edges_sql(*[(a, b, "IMPLEMENTS", "Lcontract", 0, 1, 1, "true") for a, b in (
    ("back/quote{}/main.go:Server{}", "contract::Quote{}Service"), ("back/quote{}/main.go:Server{}.Quote{}", "contract::Quote{}Service.Quote{}"),
    ("back/pay{}/server.js:main", "contract::Pay{}Service"), ("back/pay{}/server.js:pay{}", "contract::Pay{}Service.Pay{}"))]))
def poly_implements(spark, sf):
    """Registrations of Go servers and of JavaScript services."""
    return edges_of(spark, sf, "IMPLEMENTS")


@query(edges_sql(("front/client{}.py:ask{}", "contract::Quote{}Service.Quote{}", "CONSUMES", "Lcontract", 0, 1, 1, "true"), ("front/client{}.py:fetch{}", "back/svc{}/web.py:serve{}", "HTTP_CALLS", "Ldep", 0, 1, 1, "true")))
def poly_across(spark, sf):
    """Requests and calls that another repository answers."""
    return edges_of(spark, sf, "CONSUMES", "HTTP_CALLS")


@query(f"WITH {S}, n AS (SELECT CAST(count(*) AS BIGINT) AS n FROM s) SELECT 'front' AS repo, CAST(0 AS BIGINT) AS implements, n AS consumes, n AS http_calls FROM n WHERE n > 0 UNION ALL SELECT 'back', 4 * n, 0, 0 FROM n WHERE n > 0")
def poly_verify(spark, sf):
    """A4"""
    g = built(spark, sf).graph
    return relational.verify_workspace(g.nodes, g.edges).filter("repo in ('front', 'back')").select("repo", "implements", "consumes", "http_calls")


@query(f"WITH {S} SELECT 'Pay' || x || 'Service' AS service, unnest(['', 'Pay' || x]) AS rpc, 'CRITICAL' AS severity FROM s WHERE k % 5 = 0")
def heal_skewed(spark, sf):
    """Contracts that the repositories have otherwise."""
    return heal.skewed(built(spark, sf).graph).select("service", "rpc", "severity")


@query(f"""WITH {S} SELECT 'RENAMED_RPC' AS type, 'Quote' || x || 'Service' AS service, 'Quote' || x AS target, round(2 * (4 + length(x))::DOUBLE / (2 * (4 + length(x)) + 1), 2) AS confidence FROM s WHERE k % 3 = 0
UNION ALL SELECT 'MISSING_IMPLEMENTATION', 'Svc' || x || 'Service', NULL, 1.0 FROM s WHERE k % 4 = 0 UNION ALL SELECT 'CONTRACT_SKEW', 'Pay' || x || 'Service', NULL, 1.0 FROM s WHERE k % 5 = 0 UNION ALL SELECT 'CONTRACT_SKEW', 'Pay' || x || 'Service', NULL, 1.0 FROM s WHERE k % 5 = 0""")
def heal_causes(spark, sf):
    """What each defect comes from; a misspelt rpc has the one that is most like it."""
    return heal.attribute(heal.diagnose(built(spark, sf).graph)).select("type", "service", "target", "confidence")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_LOST = f"replace({quoted(LOST['front/lost{}.py'])}, '{{}}', x)"
_STUB = quoted('\n    def Spare{}(self, request, context):\n        raise NotImplementedError("Spare{}")\n')
_MODEL = f"replace({quoted(TEXTS['back/svc{}/model.py'])} || {_STUB}, '{{}}', x)"


@query(f"WITH {S} SELECT 'lost' || x || '.py' AS path, 'VALID' AS status, replace({_LOST}, 'stub.Quot' || x || '(', 'stub.Quote' || x || '(') AS new_code FROM s WHERE k % 3 = 0 UNION ALL SELECT 'svc' || x || '/model.py', 'VALID', {_MODEL} FROM s WHERE k % 4 = 0")
def heal_patches(spark, sf):
    """Calls renamed and stubs added, with the check of their syntax."""
    b = built(spark, sf)
    return heal.validate(heal.patches(heal.attribute(heal.diagnose(b.graph)), b.files)).select("path", "status", "new_code")


@query(f"""WITH {S} SELECT 'Rename call Quot' || x || ' to Quote' || x AS title, 'lost' || x || '.py' AS path, 'READY_FOR_HUMAN_REVIEW' AS status, CAST(5 AS BIGINT) AS impacted_nodes FROM s WHERE k % 3 = 0
UNION ALL SELECT 'Implement Spare' || x, 'svc' || x || '/model.py', 'READY_FOR_HUMAN_REVIEW', 0 FROM s WHERE k % 4 = 0""")
def heal_proposals(spark, sf):
    """From defects to proposals with the neighbourhood that each touches."""
    b = built(spark, sf)
    return heal.remediate(b.graph, b.files).select("title", "path", "status", "impacted_nodes")


@query(f"""WITH {S}, f AS (SELECT 'back' AS repo, 'protos/x' || x || '.proto' AS path, replace({quoted(TEXTS['back/protos/x{}.proto'])}, '{{}}', x) AS text FROM s UNION ALL SELECT 'back', 'protos/y' || x || '.proto', replace({quoted(SPARE['back/protos/y{}.proto'])}, '{{}}', x) FROM s WHERE k % 4 = 0
UNION ALL SELECT 'front', 'protos/x' || x || '.proto', replace({quoted(SKEW['front/protos/x{}.proto'])}, '{{}}', x) FROM s WHERE k % 5 = 0) SELECT repo, path, replace(text, 'rpc Pay5(', 'rpc Settle(') AS text FROM f""")
def fault_rename(spark, sf):
    """A fault put into the contracts of all files."""
    broken = heal.inject(built(spark, sf).files, "rename-rpc", "Pay5", "Settle").filter("ext = '.proto'")
    return broken.select("repo", "path", utf8(F.col("content")).alias("text"))


@query(f"WITH {S} SELECT src, dst, relation FROM (SELECT 'back/pay' || x || '/server.js:pay' || x AS src, 'contract::Pay' || x || 'Service.Pay' || x AS dst, 'IMPLEMENTS' AS relation, k FROM s) WHERE k = 5")
def fault_lost_bindings(spark, sf):
    """The bindings that a graph loses by a fault; only the files with contracts and their JavaScript services are built."""
    b = built(spark, sf)
    some = b.files.filter("repo = 'back' and ext in ('.proto', '.js')")
    after = build(stored(heal.inject(some, "rename-rpc", "Pay5", "Settle"), "broken"), workspace=True, semantic=False)
    mine = heal.bindings(b.graph.edges).filter(F.col("src").startswith("back/pay"))
    return relational.lost(mine, heal.bindings(after.edges))
