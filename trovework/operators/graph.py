"""Closures over inheritance edges, by joins of a frontier up to a bounded depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovework.session import cut

MOST = 10


def edges_of_paths(results: DataFrame) -> DataFrame:
    """src, dst: the steps of the relationship paths, each once; dst derives from src."""
    p = results.select("relationship_path").where(F.size("relationship_path") > 1).distinct()
    steps = F.transform(F.sequence(F.lit(1), F.size("relationship_path") - 1), lambda i: F.struct(F.element_at("relationship_path", i).alias("src"), F.element_at("relationship_path", i + 1).alias("dst")))
    return p.select(F.explode(steps).alias("s")).select("s.src", "s.dst").where("src is not null and dst is not null and src != dst").distinct()


def closure(edges: DataFrame, starts: DataFrame, depth: int = 5, itself: bool = False) -> DataFrame:
    """start, name, depth and path of all that derives from each start within depth steps, each once, at its least depth.

    The path is the first of the shortest in order. depth is brought to 1..10. A name met before isn't followed again, so
    cycles end. With itself the start is in the result, at depth 0. The frontier is cut each step, so plans stay small.
    """
    depth = max(1, min(MOST, depth))
    first = starts.toDF("start").where("start is not null").distinct().select("start", F.col("start").alias("name"), F.lit(0).alias("depth"), F.col("start").alias("path"))
    seen, frontier = first, first
    for d in range(1, depth + 1):
        step = frontier.join(edges, frontier["name"] == edges["src"]).select("start", F.col("dst").alias("name"), F.lit(d).alias("depth"), F.concat_ws(">", "path", "dst").alias("path"))
        frontier = cut(step.groupBy("start", "name").agg(F.min("depth").alias("depth"), F.min("path").alias("path")).join(seen.select("start", "name"), ["start", "name"], "left_anti"))
        seen = seen.unionByName(frontier)
        if frontier.isEmpty():
            break
    return seen if itself else seen.where("depth > 0")


def _labelled(edges: DataFrame, starts: DataFrame, *labels: str) -> DataFrame:
    """Of starts (one column) those that a declaration labels so; a name without a declaration of its own has its parent's side only, and no label."""
    n = starts.toDF("name").distinct()
    return n.join(edges.where(F.lower("label").isin(*labels)).select(F.col("dst").alias("name")).distinct(), "name", "left_semi")


def implementations(edges: DataFrame, starts: DataFrame, depth: int = 5) -> DataFrame:
    """As closure(), from the interfaces among starts, along both relations; edges have src, dst, relation and label, as inheritance() gives them."""
    return closure(edges.where(F.col("relation").isin("IMPLEMENTS", "EXTENDS")).select("src", "dst").distinct(), _labelled(edges, starts, "interface", "trait", "protocol"), depth)


def subclasses(edges: DataFrame, starts: DataFrame, depth: int = 5) -> DataFrame:
    """As closure(), from the classes among starts, along EXTENDS."""
    return closure(edges.where("relation = 'EXTENDS'").select("src", "dst").distinct(), _labelled(edges, starts, "class", "struct"), depth)


def usages(edges: DataFrame, starts: DataFrame, depth: int = 5) -> DataFrame:
    """Each start itself, its implementations and its subclasses, each name once, at its least depth."""
    first = starts.toDF("start").where("start is not null").distinct().select("start", F.col("start").alias("name"), F.lit(0).alias("depth"), F.col("start").alias("path"))
    found = first.unionByName(implementations(edges, starts, depth)).unionByName(subclasses(edges, starts, depth))
    return found.groupBy("start", "name").agg(F.min(F.struct("depth", "path")).alias("r")).select("start", "name", "r.depth", "r.path")


def degrees(edges: DataFrame) -> DataFrame:
    """name, children and parents of each node."""
    n = edges.select(F.col("src").alias("name"), F.lit(1).alias("c"), F.lit(0).alias("p")).unionAll(edges.select(F.col("dst").alias("name"), F.lit(0).alias("c"), F.lit(1).alias("p")))
    return n.groupBy("name").agg(F.sum("c").alias("children"), F.sum("p").alias("parents"))
