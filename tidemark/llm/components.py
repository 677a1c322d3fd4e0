"""Connected components by alternating large-star and small-star rounds.

Edges stay in Spark tables in the shared folder; each round is two grouped minima and
two joins, and only the number of changed edges reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import drop, forget, source_of, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = both.join(low, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b): the smallest node it reaches.

    Edges with a null end or equal ends are dropped; repeated edges count once; no edges
    give an empty table.
    """
    now = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    seen = None
    for _ in range(rounds):
        old = source_of(now)
        nxt = written(_star(_star(now, True), False), "edges")
        mark = nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if old:
            drop(now.sparkSession, old)
        now = nxt
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    heads = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(heads.withColumn("component", F.col("node")))


def merged(classes: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, component) of classes found before, null if none, joined by more links (a, b).

    Only classes that a link names are worked on, each as one node.
    """
    if classes is None:
        return components(links)
    head = lambda end: classes.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
    ends = links.join(head("a"), "a", "left").join(head("b"), "b", "left")
    between = ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    edges = components(between)
    heads = written(edges, "heads")
    found = heads.select(F.col("node").alias("component"), F.col("component").alias("head"))
    old = classes.join(found, "component", "left").select("node", F.coalesce("head", "component").alias("component"))
    new = heads.join(classes.select("node"), "node", "left_anti")
    out = written(old.unionByName(new), "classes")
    forget(edges, heads)
    return out
