"""Walks over trees and graphs given as edges, by levels. The driver holds no node; each level is one join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumlake.sources.scratch import cut


def inherited(nodes: DataFrame, value: str, most: int = 128, *, lenient: bool = False) -> DataFrame:
    """node -> the first defined value on the way to the root, with its depth (0: the node's own). nodes: node,
    parent, value. Raises on cycles and on nodes deeper than `most`; lenient: such nodes get null values and `complete`
    is false. Pointers double each turn, so the turns are the logarithm of the depth."""
    state = nodes.select("node", F.col("parent").alias("up"), F.col(value).alias("v"), F.when(F.col(value).isNotNull(), 0).alias("d"), F.lit(1).alias("step"))
    turns = most.bit_length()
    for _ in range(turns):
        top = state.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("v").alias("v2"), F.col("d").alias("d2"), F.col("step").alias("s2"))
        state = state.join(top, "up", "left").select(
            "node", F.col("up2").alias("up"), F.coalesce("v", "v2").alias("v"), F.coalesce("d", F.col("step") + F.col("d2")).alias("d"), (F.col("step") + F.coalesce("s2", F.lit(0))).alias("step")
        )
        # each turn reads the one before twice, so it is written once
        state = cut(state, "inherited")
        if state.where("up is not null").isEmpty():
            break
    deep = F.col("up").isNotNull() | (F.col("step") > most + 1)
    if lenient:
        return state.select("node", F.when(~deep, F.col("v")).alias(value), F.when(~deep, F.col("d")).alias("depth"), (~deep).alias("complete"))
    checked = F.when(deep, F.raise_error(F.lit("cycle or too deep a tree")).cast("int")).otherwise(F.col("d"))
    return state.select("node", F.col("v").alias(value), checked.alias("depth"))


def outline(nodes: DataFrame, most: int = 64) -> DataFrame:
    """node, depth and path (ordinals from the root) of a forest of (node, parent, ord), in reading order of path.
    Nodes below a parent that is none are in no path. Raises on cycles and on nodes deeper than `most`. Paths double
    each turn, so there is no limit of rows, and the turns are the logarithm of the depth."""
    state = nodes.select("node", F.col("parent").alias("up"), F.array(F.col("ord").cast("bigint")).alias("path"))
    for _ in range(most.bit_length()):
        top = state.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("path").alias("path2"))
        known = state.join(top, "up", "left").where("up is null or path2 is not null")
        state = cut(known.select("node", F.col("up2").alias("up"), F.when(F.col("path2").isNull(), F.col("path")).otherwise(F.concat("path2", "path")).alias("path")), "outline")
        if state.where("up is not null").isEmpty():
            break
    deep = F.col("up").isNotNull() | (F.size("path") > most + 1)
    depth = F.when(deep, F.raise_error(F.lit("cycle or too deep an outline")).cast("int")).otherwise(F.size("path") - 1)
    return state.select("node", depth.alias("depth"), "path")


def call_graph(edges: DataFrame, roots: DataFrame, most: int = 64) -> DataFrame:
    """Paths of a call graph from its roots (caller, callee), cut where a call closes a cycle: callee, depth, and
    self, mutual or null as the kind of cycle. One join a level, each written; raises beyond `most` levels."""
    e = edges.select(F.col("caller").alias("node"), "callee")
    level = cut(roots.select("node", F.lit(0).alias("depth"), F.array("node").alias("path"), F.lit(None).cast("string").alias("cycle")), "calls")
    found = [level]
    for depth in range(1, most + 2):
        closes = F.when(F.col("callee") == F.col("node"), "self").when(F.array_contains("path", F.col("callee")), "mutual")
        level = cut(level.where("cycle is null").join(e, "node").select(F.col("callee").alias("node"), F.lit(depth).alias("depth"), F.concat("path", F.array("callee")).alias("path"), closes.alias("cycle")), "calls")
        if level.isEmpty():
            break
        if depth > most:
            raise ValueError("calls deeper than the limit")
        found.append(level)
    out = found[0]
    for f in found[1:]:
        out = out.unionAll(f)
    return out.select("node", "depth", "cycle")


def leaves(edges: DataFrame, roots: DataFrame, most: int = 64) -> DataFrame:
    """node: the nodes without children that the roots (node) reach over edges (parent, child). Raises where a node is
    reached twice: a cycle or a shared node; or beyond `most` levels."""
    e = edges.select(F.col("parent").alias("node"), "child")
    level, seen = cut(roots.select("node"), "reached"), None
    for _ in range(most + 1):
        seen = level if seen is None else seen.unionAll(level)
        level = cut(level.join(e, "node").select(F.col("child").alias("node")), "reached")
        if level.isEmpty():
            break
        if not seen.unionAll(level).groupBy("node").count().where("count > 1").isEmpty():
            raise ValueError("a cycle or a node of two parents")
    else:
        raise ValueError("a tree deeper than the limit")
    return seen.join(e.select("node").distinct(), "node", "left_anti")


def remapped_names(names: DataFrame, reached: DataFrame, pages: DataFrame) -> DataFrame:
    """Names (node, name, page) of the reached leaves with their page replaced; the first name by node rules."""
    of = names.join(reached.select("node"), "node").groupBy("name").agg(F.min(F.struct("node", "page")).alias("_n")).select("name", F.col("_n.page").alias("page"))
    return remapped(of, pages)


def remapped(references: DataFrame, pages: DataFrame) -> DataFrame:
    """References with their page replaced by the new one; null where the page is gone."""
    return references.join(pages.select(F.col("old").alias("page"), "new"), "page", "left")
