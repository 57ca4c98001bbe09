"""Frontier loops over edges (src, dst): one join a level, visited rows taken out by an anti join, each level written down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symbolweave.runtime import cut, is_empty


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, parents: bool = False) -> DataFrame:
    """(root, id, depth[, parent]): the fewest steps from each root along src -> dst, seeds (root, id) at depth 0.

    parents: of the ids a step before, the smallest that leads to this one; null for seeds.
    """
    extra = [F.lit(None).cast("string").alias("parent")] if parents else []
    frontier = cut(seeds.distinct().select("root", "id", F.lit(0).alias("depth"), *extra), "reach")
    edges = cut(edges.select("src", "dst").distinct(), "reach-edges")
    visited, depth = frontier, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.select("root", F.col("id").alias("src")).join(edges, "src").withColumnRenamed("dst", "id")
        step = step.join(visited.select("root", "id"), ["root", "id"], "left_anti")
        if parents:
            step = step.groupBy("root", "id").agg(F.min("src").alias("parent")).select("root", "id", F.lit(depth).alias("depth"), "parent")
        else:
            step = step.select("root", "id").distinct().withColumn("depth", F.lit(depth))
        frontier = cut(step, "reach")
        if is_empty(frontier):
            break
        visited = visited.unionByName(frontier)
    return visited


def reach_in_order(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """(root, id, depth, way): reach() as a queue would meet the ids, edges (src, dst, key), seeds (root, id, way).

    way: the keys from the seed to the id by the parent met first; among ids of one depth its order is that of the queue.
    """
    frontier = cut(seeds.groupBy("root", "id").agg(F.min("way").alias("way")).select("root", "id", F.lit(0).alias("depth"), "way"), "queue")
    edges = cut(edges.select("src", "dst", "key").distinct(), "queue-edges")
    visited = frontier
    for depth in range(1, max_depth + 1):
        step = frontier.select("root", F.col("id").alias("src"), "way").join(edges, "src").select("root", F.col("dst").alias("id"), F.array_append("way", F.col("key")).alias("way"))
        step = step.join(visited.select("root", "id"), ["root", "id"], "left_anti")
        frontier = cut(step.groupBy("root", "id").agg(F.min("way").alias("way")).select("root", "id", F.lit(depth).alias("depth"), "way"), "queue")
        if is_empty(frontier):
            break
        visited = visited.unionByName(frontier)
    return visited


def ways(reached: DataFrame, ends: DataFrame) -> DataFrame:
    """(root, id, way): for ends (root, id) the ids from the seed to each, from the parents of reach()."""
    known = cut(reached.select("root", F.col("id").alias("at"), "depth", "parent"), "ways-known")
    open_ = cut(known.join(ends.select("root", F.col("id").alias("at")).distinct(), ["root", "at"], "left_semi").select("root", F.col("at").alias("id"), "depth", F.array("at").alias("way"), F.col("parent").alias("at")), "ways")
    done = None
    for depth in range(int(open_.agg(F.coalesce(F.max("depth"), F.lit(0)).alias("d")).first()["d"]), -1, -1):
        ended = open_.where("at IS NULL").select("root", "id", "way")
        done = ended if done is None else done.unionByName(ended)
        if depth:
            up = known.select("root", "at", F.col("parent").alias("next"))
            open_ = cut(open_.where("at IS NOT NULL").join(up, ["root", "at"]).select("root", "id", "depth", F.array_prepend("way", F.col("at")).alias("way"), F.col("next").alias("at")), "ways")
    return done


def connected(links: DataFrame) -> DataFrame:
    """(id, component) over undirected links (a, b): the smallest id reachable, for components of small diameter or large."""
    both = cut(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    label = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(label.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        up = label.select(F.col("id").alias("component"), F.col("component").alias("up"))
        step = label.withColumn("old", F.col("component")).join(near, "id").withColumn("component", F.least("component", "near")).join(up, "component", "left")
        step = cut(step.select("id", F.least("component", F.coalesce("up", "component")).alias("component"), "old"), "labels")
        if is_empty(step.where("component < old")):
            return step.select("id", "component")
        label = step.select("id", "component")

