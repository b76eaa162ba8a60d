"""Routing as data: a tree of any size is two tables, and the plan does not grow with it.

Nodes are numbered in preorder, so a subtree is an interval. Matchers are an inverted list: an equality
is found by (label, value), and only the rest are tried as expressions, on distinct values of their
label. A node is a candidate of a label set if all its own matchers hold. The walk from the root, first
matching child on every level, is a fold over the candidates in preorder: a candidate is entered if it
is a child of the node reached so far, which its interval and depth tell; later siblings are then no
children of that node any more.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import label
from ..operators.selectors import anchored
from .routing import Route

_NODES = "node int, last int, depth int, receiver string, n_matchers int"
_MATCHERS = "node int, name string, op string, value string"


def route_tables(spark: SparkSession, tree: Route) -> tuple[DataFrame, DataFrame]:
    """(node, last, depth, receiver, n_matchers) and (node, name, op, value); ``last`` ends the subtree."""
    nodes, matchers = [], []

    def walk(route: Route, depth: int) -> int:
        at = len(nodes)
        nodes.append(None)
        own = [(k, "=", v) for k, v in route.match.items()] + [(k, "=~", anchored(v)) for k, v in route.match_re.items()]
        matchers.extend((at, *m) for m in own)
        last = at
        for child in route.routes:
            last = walk(child, depth + 1)
        nodes[at] = (at, last, depth, route.receiver, len(own))
        return last

    walk(tree, 0)
    return spark.createDataFrame(nodes, _NODES), spark.createDataFrame(matchers, _MATCHERS)


def route(alerts: DataFrame, nodes: DataFrame, matchers: DataFrame, labels: Sequence[str], name: str = "receiver") -> DataFrame:
    """Receiver of each alert; ``labels`` are those that the tree's matchers name, absent ones read as ''.

    Label sets are routed once each, however many alerts have them. A set's candidates are the nodes
    that match it, which follow the tree's depth and overlap, not the number of routes.
    """
    keyed = alerts.withColumn("_set", F.array(*[label(alerts, c) for c in labels]))
    sets = keyed.select("_set").distinct()
    pairs = sets.select("_set", F.posexplode("_set").alias("_i", "value")).select("_set", F.get(F.array(*[F.lit(c) for c in labels]), F.col("_i")).alias("name"), "value")
    exact = matchers.where("op = '='").select("node", "name", "value")
    rest = matchers.where("op <> '='").select("node", "name", F.col("value").alias("pattern"))
    values = pairs.select("name", "value").distinct().join(rest, "name").where(F.regexp_like("value", F.col("pattern"))).select("node", "name", "value")
    held = pairs.join(exact.unionByName(values), ["name", "value"]).groupBy("_set", "node").agg(F.count("*").alias("n"))
    free = nodes.where("n_matchers = 0")
    node = ["node", "last", "depth", "receiver"]
    hits = held.join(nodes, "node").where("n = n_matchers").select("_set", *node)
    always = F.array_sort(F.collect_list(F.struct(*node)))
    some = hits.groupBy("_set").agg(F.collect_list(F.struct(*node)).alias("hits"))
    # nodes without matchers, the root among them, are candidates of every set: one row, told to all
    every = sets.join(some, "_set", "left").withColumn("common", free.agg(always.alias("common")).scalar())
    every = every.withColumn("candidates", F.array_sort(F.concat("common", F.coalesce("hits", F.array().cast("array<struct<node:int,last:int,depth:int,receiver:string>>")))))
    start = F.struct(F.lit(-1).alias("node"), F.lit(2147483647).alias("last"), F.lit(-1).alias("depth"), F.lit(None).cast("string").alias("receiver"))
    inside = lambda x, y: (y["depth"] == x["depth"] + 1) & (y["node"] > x["node"]) & (y["node"] <= x["last"])
    reached = F.aggregate("candidates", start, lambda x, y: F.when(inside(x, y), y).otherwise(x))
    return keyed.join(every.select("_set", reached["receiver"].alias(name)), "_set").drop("_set")
