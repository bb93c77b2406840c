"""A static cluster description: loading, defaults, validation, and the rings that follow from it."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

from marlstone.functions.ring import VIRTUAL_NODES, Ring, node_ring
from marlstone.model import InvalidOptions

VERSION, ALGORITHM = "v1", "fnv1a-consistent-hash"
ROLES = ("", "standalone", "primary", "follower")


def _take(kind: type, raw: dict) -> dict:
    """Fields that the type knows; others are ignored."""
    return {f.name: raw[f.name] for f in fields(kind) if f.name in raw}


@dataclass
class Replication:
    enabled: bool = False
    role: str = ""
    primary: str = ""


@dataclass
class Node:
    id: str = ""
    base_url: str = ""
    addr: str = ""
    data_dir: str = ""
    weight: int = 1
    replication: Replication = field(default_factory=Replication)


@dataclass
class Scope:
    """What the cluster must say it doesn't do."""

    static_membership: bool = True
    no_raft: bool = True
    no_automatic_failover: bool = True
    no_rebalancing: bool = True


@dataclass
class Cluster:
    version: str = VERSION
    name: str = ""
    algorithm: str = ALGORITHM
    virtual_nodes: int = VIRTUAL_NODES
    proxy_addr: str = ""
    nodes: list[Node] = field(default_factory=list)
    scope: Scope = field(default_factory=Scope)

    @classmethod
    def parse(cls, text: str) -> Cluster:
        raw = json.loads(text)
        nodes = [Node(**_take(Node, n) | {"replication": Replication(**_take(Replication, n.get("replication", {})))}) for n in raw.get("nodes", [])]
        routing, proxy = raw.get("routing", {}), raw.get("proxy", {})
        out = cls(raw.get("version", VERSION), raw.get("name", ""), routing.get("algorithm") or ALGORITHM, routing.get("virtual_nodes") or VIRTUAL_NODES, proxy.get("addr", ""), nodes, Scope(**_take(Scope, raw.get("scope", {}))))
        return out.normalised()

    @classmethod
    def load(cls, path: str) -> Cluster:
        return cls.parse(Path(path).read_text())

    @classmethod
    def default(cls, nodes: int = 3) -> Cluster:
        return cls(name="local", nodes=[Node(f"node-{i}", f"http://127.0.0.1:{9000 + i}", f"127.0.0.1:{9000 + i}", f"data/node-{i}") for i in range(1, nodes + 1)])

    @classmethod
    def read_replicas(cls, nodes: int = 3) -> Cluster:
        """A primary whose other nodes follow it."""
        out = cls.default(nodes)
        for n in out.nodes:
            first = n is out.nodes[0]
            n.replication = Replication(True, "primary" if first else "follower", "" if first else out.nodes[0].id)
        return out

    def normalised(self) -> Cluster:
        for n in self.nodes:
            n.weight, n.base_url = max(1, n.weight), n.base_url.rstrip("/")
        return self

    def validate(self) -> Cluster:
        problems = []
        if self.version != VERSION:
            problems.append(f"version {self.version!r}")
        if self.algorithm != ALGORITHM:
            problems.append(f"algorithm {self.algorithm!r}")
        if self.virtual_nodes < 1 or not self.nodes:
            problems.append("no points or no nodes")
        for what in ("id", "base_url"):
            values = [getattr(n, what) for n in self.nodes]
            if not all(values) or len(set(values)) != len(values):
                problems.append(f"{what}s are missing or repeat")
        ids = {n.id for n in self.nodes}
        for n in self.nodes:
            if n.replication.role not in ROLES:
                problems.append(f"{n.id}: no such role {n.replication.role!r}")
            if n.replication.enabled and n.replication.role == "follower" and (n.replication.primary not in ids or n.replication.primary == n.id):
                problems.append(f"{n.id}: follows no other node")
        problems += [f"{k} must hold" for k, v in asdict(self.scope).items() if not v]
        if problems:
            raise InvalidOptions("; ".join(problems))
        return self

    def to_json(self) -> str:
        return json.dumps({"version": self.version, "name": self.name, "routing": {"algorithm": self.algorithm, "virtual_nodes": self.virtual_nodes}, "proxy": {"enabled": bool(self.proxy_addr), "addr": self.proxy_addr}, "nodes": [asdict(n) for n in self.nodes], "scope": asdict(self.scope)}, indent=2)

    def ring(self, *down: str) -> Ring:
        return node_ring([(n.id, n.weight) for n in self.nodes if n.id not in down], self.virtual_nodes)
