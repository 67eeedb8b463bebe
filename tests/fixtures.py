"""Small repositories as (repo, path, text) rows."""

PROTO = """syntax = "proto3";
package shop.v1;
// A comment with service Fake { rpc No(A) returns (B); }
service ShippingService {
  rpc GetQuote(QuoteRequest) returns (QuoteResponse) {}
  rpc ShipOrder(ShipRequest) returns (ShipResponse);
}
/* service Gone { } */
service CartService { rpc GetCart(CartRequest) returns (Cart); }
"""

SHOP = [
    ("", "protos/shop.proto", PROTO),
    ("", "services/order/order.py", '''"""Orders."""
import requests
import shop_pb2_grpc
from services.order.base import BaseOrder
from .helpers import price as cost


class OrderService(BaseOrder):
    """Places the orders of customers and asks shipping for a quote."""

    def place(self, cart, *items, key=None, **rest):
        """Place an order of a customer."""
        total = cost(cart)
        self.audit(total)
        requests.post("http://gateway/api/ship", json=cart)
        total += 1
        quote = client.GetQuote(cart)
        return total

    def audit(self, x):
        return super().audit(x)


client = shop_pb2_grpc.ShippingServiceStub(channel)
'''),
    ("", "services/order/base.py", '''class BaseOrder:
    def audit(self, x):
        return x

    def cancel(self):
        return None
'''),
    ("", "services/order/helpers.py", '''def price(cart):
    """Price of a cart of a customer."""
    for line in cart:
        with open(line) as f:
            amount: int = f.read()
    return amount


def helper(a):
    return a
'''),
    ("", "services/order/__init__.py", ""),
    ("", "services/cart/cart.py", '''import shop_pb2_grpc
from flask import Flask
app = Flask(__name__)


class Cart(shop_pb2_grpc.CartServiceServicer):
    pass


class RedisCart(Cart):
    def GetCart(self, request, context):
        return request


@app.route("/api/cart", methods=["GET", "POST"])
def cart_view():
    return RedisCart().GetCart(1, 2)
'''),
    ("", "services/shipping/main.go", '''package main

import (
    "net/http"
    pb "example.com/genproto"
)

// ShippingServer answers quotes.
type ShippingServer struct{ n int }

func (s *ShippingServer) GetQuote(ctx context.Context, req *pb.QuoteRequest) (*pb.QuoteResponse, error) {
    cart := pb.NewCartServiceClient(conn)
    got, err := cart.GetCart(ctx, req)
    var fee int
    fee = 3
    return got, err
}

func shipHandler(w http.ResponseWriter, r *http.Request) {}

func main() {
    srv := new(ShippingServer)
    pb.RegisterShippingServiceServer(server, srv)
    http.HandleFunc("/api/ship", shipHandler)
}
'''),
    ("", "services/web/client.ts", '''import { request as send } from "./net";
/** Loads the cart of a customer. */
export class CartPage extends Page {
  load(id: string) { const cart = send(id); fetch("/api/cart"); return cart; }
}
export const start = (id) => { const page = new CartPage(id); page.load(id); };
interface Shape { area(): number }
enum Color { Red }
type Id = string;
'''),
    ("", "services/web/net.ts", "export function request(url) { return url; }\n"),
    ("", "services/pay/server.js", '''const impl = require("./impl");
function getCart(call, cb) { cb(null, 1); }
function main() { server.addService(proto.CartService.service, { getCart, other: impl.other.bind(impl) }); }
app.get("/pay", getCart);
'''),
    ("", "vendor/x/lib.py", "def vendored():\n    pass\n"),
]
