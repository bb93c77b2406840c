"""Snapshots of components and the three chaos scenarios."""

from __future__ import annotations

import html
import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators.replica import ReplicaSet


def replica_health(status: DataFrame) -> DataFrame:
    """(status, replicas, least_applied, commit): degraded if any replica is behind the leader."""
    rows = status.agg(F.count(F.lit(1)).alias("replicas"), F.min("applied").alias("least_applied"), F.max(F.when(F.col("leader"), F.col("applied"))).alias("commit"))
    return rows.withColumn("status", F.when(F.col("least_applied") < F.col("commit"), "degraded").otherwise("ok"))


def replica_set_health(replicas: DataFrame) -> DataFrame:
    """(name, status, replicas, least_applied, commit) for each set of rows (name, leader, applied)."""
    rows = replicas.groupBy("name").agg(F.count(F.lit(1)).alias("replicas"), F.min("applied").alias("least_applied"), F.max(F.when(F.col("leader"), F.col("applied"))).alias("commit"))
    return rows.withColumn("status", F.when(F.col("least_applied") < F.col("commit"), "degraded").otherwise("ok"))


def component(kind: str, name: str, stats: dict, status: str = "ok") -> dict:
    return {"kind": kind, "name": name, "status": status, "stats": {k: str(v) for k, v in stats.items()}}


def snapshot(spark: SparkSession, components: list[dict]) -> DataFrame:
    rows = [(c["kind"], c["name"], c["status"], c["stats"]) for c in components]
    return spark.createDataFrame(rows, "kind string, name string, status string, stats map<string,string>")


def collect(stores: dict | None = None, shards: dict | None = None, replicas: dict | None = None, scenarios: list[dict] | None = None) -> list[dict]:
    """Components of what is there: stores and shards are ok, a set of replicas is degraded while a follower is behind, a scenario if it failed."""
    out = [component("engine", name, s.stats()) for name, s in (stores or {}).items()]
    out += [component("shard", name, s.stats()["total"]) for name, s in (shards or {}).items()]
    for name, r in (replicas or {}).items():
        stats = r.stats()
        out.append(component("replica", name, stats, "degraded" if stats["applied_index"] < stats["commit_index"] else "ok"))
    return out + [component("scenario", s["scenario"], s["checks"], "ok" if s["passed"] else "degraded") for s in scenarios or []]


class Dashboard:
    """GET / as a page, /status, /healthz and /events as JSON; other methods are refused."""

    def __init__(self, title: str, components: Callable[[], list[dict]]) -> None:
        self.title, self.components, self.events = title, components, []

    def page(self) -> str:
        return render(self.title, self.components(), self.events)

    def handle(self, method: str, path: str, body: dict | None = None, query: dict | None = None) -> tuple[int, dict]:
        if method != "GET":
            return 405, {"error": "method not allowed"}
        answers = {"/": lambda: {"html": self.page()}, "/status": lambda: {"title": self.title, "components": self.components()}, "/healthz": lambda: {"status": "ok"}, "/events": lambda: {"events": list(self.events)}}
        return (200, answers[path]()) if path in answers else (404, {"error": f"not found: {path}"})


def render(title: str, components: list[dict], events: list[str]) -> str:
    """A page without scripts."""
    body = "".join(f"<tr><td>{html.escape(c['kind'])}</td><td>{html.escape(c['name'])}</td><td>{c['status']}</td><td>{html.escape(json.dumps(c['stats']))}</td></tr>" for c in components)
    told = "".join(f"<li>{html.escape(e)}</li>" for e in events)
    return f"<!DOCTYPE html><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table>{body}</table><ul>{told}</ul>"


def _result(name: str, checks: dict[str, bool], since: float) -> dict:
    return {"scenario": name, "passed": all(checks.values()), "checks": checks, "seconds": time.time() - since}


def pause_scenario(spark: SparkSession) -> dict:
    """A paused follower misses a write and has it after it goes on."""
    began, s = time.time(), ReplicaSet(spark, 3)
    s.pause(1)
    s.put("k", "v")
    s.replicate_all()
    missing = s.get("k", "follower", 1) is None
    s.pause(1, False)
    s.replicate_all()
    return _result("follower_pause", {"missing_while_paused": missing, "there_afterwards": s.get("k", "follower", 1) == "v"}, began)


def lag_scenario(spark: SparkSession) -> dict:
    """A follower with batches of two is behind after one round over six writes, and not after all."""
    began, s = time.time(), ReplicaSet(spark, 3)
    s.set_batch(1, 2)
    for i in range(6):
        s.put(f"k{i}", str(i))
    s.replicate_once()
    behind = s.replicas[1].applied <= 2
    s.replicate_all()
    return _result("follower_lag", {"behind_after_one_round": behind, "caught_up": s.replicas[1].applied == 6}, began)


def catchup_scenario(spark: SparkSession) -> dict:
    """Four writes while paused; afterwards the follower shows what the leader shows."""
    began, s = time.time(), ReplicaSet(spark, 2)
    s.pause(1)
    for i in range(4):
        s.put(f"k{i}", str(i))
    s.pause(1, False)
    s.replicate_all()
    same = s.scan().collect() == s.scan(mode="follower", replica=1).collect()
    return _result("follower_catchup", {"same_rows": same}, began)
