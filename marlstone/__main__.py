"""``python -m marlstone``: clusters, traces, workloads and servers from a command line."""

from __future__ import annotations

import argparse
import json
import sys

from marlstone.model import StoreError
from marlstone.sources.cluster import Cluster


def _spark(master: str):
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master(master).appName("marlstone").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="marlstone")
    p.add_argument("--master", default="local[*]", help="Spark's master")
    sub = p.add_subparsers(dest="what", required=True)
    sub.add_parser("version")
    c = sub.add_parser("cluster").add_subparsers(dest="do", required=True)
    for name in ("validate", "print", "health"):
        c.add_parser(name).add_argument("config")
    for name in ("example-local-3node", "example-read-replica-3node"):
        c.add_parser(name)
    s = c.add_parser("simulate-failure")
    s.add_argument("config")
    s.add_argument("--down", action="append", default=[], required=True)
    s.add_argument("--key", action="append", default=[], required=True)
    r = c.add_parser("plan-rebalance")
    r.add_argument("config")
    r.add_argument("new_config")
    r.add_argument("--key", action="append", default=[], required=True)
    e = sub.add_parser("explain")
    e.add_argument("do", choices=("put", "get", "delete", "scan"))
    e.add_argument("path")
    e.add_argument("--key", default="")
    e.add_argument("--value", default="")
    e.add_argument("--start", default="")
    e.add_argument("--end", default="")
    g = sub.add_parser("gateway")
    g.add_argument("do", choices=("route", "put", "get", "delete", "scan-node", "flush-all", "compact-all", "health"))
    g.add_argument("config")
    g.add_argument("path")
    g.add_argument("--key", default="")
    g.add_argument("--value", default="")
    g.add_argument("--node", default="")
    for name in ("node", "proxy", "dashboard"):
        n = sub.add_parser(name)
        n.add_argument("path")
        n.add_argument("--config", default="")
        n.add_argument("--id", default="node-1")
        n.add_argument("--host", default="127.0.0.1")
        n.add_argument("--port", type=int, default=7890)
    b = sub.add_parser("bench")
    b.add_argument("path")
    b.add_argument("--workload", action="append", default=[])
    b.add_argument("--scale", default="small", choices=("small", "medium"))
    return p


def _cluster(a: argparse.Namespace) -> str:
    if a.do == "example-local-3node":
        return Cluster.default().to_json()
    if a.do == "example-read-replica-3node":
        return Cluster.read_replicas().to_json()
    c = Cluster.load(a.config).validate()
    if a.do == "validate":
        return f"ok  {a.config!r} is valid (version={c.version}, name={c.name!r}, nodes={len(c.nodes)})"
    if a.do == "print":
        return c.to_json()
    if a.do == "health":
        from urllib.request import urlopen

        out = []
        for n in sorted(c.nodes, key=lambda n: n.id):
            try:
                with urlopen(f"{n.base_url}/healthz", timeout=5) as answer:
                    healthy = 200 <= answer.status < 300 and json.loads(answer.read()).get("status") == "ok"
                out.append({"node": n.id, "healthy": healthy})
            except (OSError, ValueError) as e:
                out.append({"node": n.id, "healthy": False, "error": str(e)})
        return json.dumps({"healthy": sum(n["healthy"] for n in out), "nodes": out}, indent=2)
    if a.do == "simulate-failure":
        full, rest = c.ring(), c.ring().without(*a.down)
        rows = [{"key": k, "origin": full.owner(k), "node": rest.owner(k) if rest.points else None, "origin_down": full.owner(k) in a.down} for k in a.key]
        return json.dumps({"down": a.down, "keys": rows, "affected_keys": sum(r["origin"] != r["node"] for r in rows)}, indent=2)
    from marlstone.operators.ops import STEPS

    new = Cluster.load(a.new_config).validate().ring()
    rows = [{"key": k, "from": c.ring().owner(k), "to": new.owner(k)} for k in a.key]
    return json.dumps({"keys": rows, "moved_keys": sum(r["from"] != r["to"] for r in rows), "steps": list(STEPS)}, indent=2)


def _explain(a: argparse.Namespace) -> str:
    from marlstone.operators import explain
    from marlstone.sources.store import Store

    store = Store(_spark(a.master), a.path)
    if a.do == "put":
        return str(explain.explain_put(store, a.key.encode(), a.value.encode()))
    if a.do == "scan":
        return str(explain.explain_scan(store, a.start.encode(), a.end.encode()))
    return str((explain.explain_get if a.do == "get" else explain.explain_delete)(store, a.key.encode()))


def _gateway(a: argparse.Namespace) -> str:
    from marlstone.operators.gateway import Gateway, Proxy

    proxy = Proxy(Gateway.of(_spark(a.master), Cluster.load(a.config), a.path))
    requests = {
        "route": ("GET", f"/route/{a.key}"), "put": ("PUT", f"/kv/{a.key}"), "get": ("GET", f"/kv/{a.key}"), "delete": ("DELETE", f"/kv/{a.key}"), "scan-node": ("GET", f"/scan-node/{a.node}"),
        "flush-all": ("POST", "/flush-all"), "compact-all": ("POST", "/compact-all"), "health": ("GET", "/nodes/health"),
    }
    status, answer = proxy.handle(*requests[a.do], {"value": a.value})
    if status != 200:
        raise StoreError(f"{status}: {answer['error']}")
    return json.dumps(answer, indent=2)


def _serve(a: argparse.Namespace) -> str:
    from marlstone.operators.dashboard import Dashboard, collect
    from marlstone.operators.gateway import Gateway, Proxy
    from marlstone.operators.node import Node
    from marlstone.serve import server
    from marlstone.sources.store import Store

    spark = _spark(a.master)
    if a.what == "node":
        target = Node(spark, a.path, a.id)
    elif a.what == "proxy":
        target = Proxy(Gateway.of(spark, Cluster.load(a.config), a.path))
    else:
        target = Dashboard("marlstone", lambda: collect({a.path: Store(spark, a.path)}))
    http = server(target, a.host, a.port)
    print(f"listening on {http.server_address[0]}:{http.server_address[1]}", flush=True)
    http.serve_forever()
    return ""


def _bench(a: argparse.Namespace) -> str:
    from marlstone.operators import workload

    spark = _spark(a.master)
    return workload.report([workload.run(spark, f"{a.path}/{name}", name, a.scale) for name in a.workload or workload.WORKLOADS])


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    try:
        work = {"cluster": _cluster, "explain": _explain, "gateway": _gateway, "node": _serve, "proxy": _serve, "dashboard": _serve, "bench": _bench}
        print("marlstone 1" if a.what == "version" else work[a.what](a))
    except (StoreError, OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
