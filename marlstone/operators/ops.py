"""What-ifs over routing: where keys live, what a failure makes unavailable, what a new node set would move."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.ring import Ring, route

#: What an operator has to do by hand for a plan (there is no automatic rebalancing).
STEPS = ("stop writes to the cluster", "copy the moved keys to their new nodes", "check the copies", "switch all clients to the new node set", "delete the moved keys from their old nodes")


def route_keys(keys: DataFrame, ring: Ring) -> DataFrame:
    """(key, node)"""
    return route(keys.select("key"), F.col("key"), ring, "node")


def simulate_failure(keys: DataFrame, ring: Ring, down: list[str]) -> DataFrame:
    """(key, origin, node, origin_down, moved, affected): where each key goes while the nodes ``down`` are missing.

    ``moved`` tells keys whose owner is up and yet changes - a consistent ring has none - and ``affected`` those and
    the keys of missing nodes. With every node down ``node`` is null.
    """
    both = route(keys.select("key"), F.col("key"), ring, "origin")
    rest = ring.without(*down)
    both = route(both, F.col("key"), rest, "node") if rest.points else both.withColumn("node", F.lit(None).cast("string"))
    gone = F.col("origin").isin(*down) if down else F.lit(False)
    changed = ~F.col("origin").eqNullSafe(F.col("node"))
    return both.withColumn("origin_down", gone).withColumn("moved", ~gone & changed).withColumn("affected", gone | changed)


def failure_summary(simulated: DataFrame) -> DataFrame:
    count = lambda c: F.sum(F.col(c).cast("long"))
    return simulated.agg(F.count(F.lit(1)).alias("keys"), count("affected").alias("affected_keys"), count("moved").alias("moved_keys"), F.sum(F.col("node").isNull().cast("long")).alias("unavailable_keys"))


def plan_rebalance(keys: DataFrame, before: Ring, after: Ring) -> DataFrame:
    """(key, from_node, to_node, moved); keys of nodes that leave count as moved."""
    both = route(route(keys.select("key"), F.col("key"), before, "from_node"), F.col("key"), after, "to_node")
    return both.withColumn("moved", ~F.col("from_node").eqNullSafe(F.col("to_node")))


def rebalance_summary(plan: DataFrame) -> DataFrame:
    return plan.groupBy("from_node", "to_node").agg(F.count(F.lit(1)).alias("keys"), F.sum(F.col("moved").cast("long")).alias("moved_keys"))


def check_health(spark: SparkSession, nodes: list[str], probe: Callable[[str], tuple[int, str]]) -> DataFrame:
    """(node, healthy, detail) by id. ``probe`` gives a status code and the reported state; errors are unhealthy."""

    def one(node: str) -> tuple[str, bool, str]:
        try:
            code, state = probe(node)
        except Exception as e:
            return node, False, str(e)
        return node, 200 <= code < 300 and state == "ok", f"{code} {state}"

    with ThreadPoolExecutor(8) as pool:
        return spark.createDataFrame(sorted(pool.map(one, nodes)), "node string, healthy boolean, detail string").orderBy("node")
