"""The shared history layer: rename chains, latest changes, living files, mechanical commits."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import exclude_pattern, seconds
from ..session import cut


def excluded(changes: DataFrame, globs: list[str] | tuple[str, ...]) -> DataFrame:
    """Changes whose new path matches none of the globs; their commits stay."""
    return changes.where(~F.col("path").rlike(exclude_pattern(globs))) if globs else changes


def with_mechanical(commits: DataFrame, changes: DataFrame, most: int | None) -> DataFrame:
    """``commits`` with files_changed and is_mechanical (more than ``most`` files; none is without a limit)."""
    counts = changes.groupBy("sha").agg(F.count("*").alias("files_changed"))
    own = commits.drop("files_changed", "is_mechanical").join(counts, "sha", "left").withColumn("files_changed", F.coalesce("files_changed", F.lit(0)))
    return own.withColumn("is_mechanical", F.col("files_changed") > most if most is not None else F.lit(False))


def anchor(commits: DataFrame) -> DataFrame:
    """One row: anchor, the latest commit's seconds; null without commits."""
    return commits.agg(F.max(seconds("committed_at")).alias("anchor"))


def rename_edges(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """(old, new): the latest rename of each old path; equal times go by sha and new path, the largest first."""
    moved = changes.where("change_type = 'R' AND old_path IS NOT NULL").select("sha", F.col("old_path").alias("old"), F.col("path").alias("new"))
    timed = moved.join(commits.select("sha", seconds("committed_at").alias("ts")), "sha")
    return latest_edges(timed)


def latest_edges(timed: DataFrame) -> DataFrame:
    return timed.groupBy("old").agg(F.max_by("new", F.struct("ts", "sha", "new")).alias("new"))


def chain_ends(edges: DataFrame) -> DataFrame:
    """(path, canonical) for every path in ``edges`` (old, new; at most one edge from each old path).

    A path's end is where its chain stops: at a path without an edge, or before the first path seen already. Pointers
    are doubled, each round cut and checked, so that a chain of n edges takes about log2 n rounds; what is still on
    its way after as many rounds as edges could need leads to a cycle and ends before the cycle's entry.
    """
    edges = cut(edges.select("old", "new"))
    n = edges.count()
    nodes = edges.select(F.col("old").alias("path")).union(edges.select("new")).distinct()

    def doubled(step: DataFrame, rounds: int) -> DataFrame:
        """(path, end) after 2**rounds edges, sooner where nothing moves any more."""
        at = cut(nodes.join(step.select(F.col("old").alias("path"), "new"), "path", "left").select("path", F.coalesce("new", "path").alias("end")))
        for _ in range(rounds):
            on = at.select(F.col("path").alias("end"), F.col("end").alias("next"))
            moved = cut(at.join(on, "end").select("path", F.col("next").alias("end"), (F.col("next") != F.col("end")).alias("moved")))
            at = moved.select("path", "end")
            if moved.where("moved").isEmpty():
                break
        return at

    rounds = max(1, math.ceil(math.log2(max(n, 2)))) + 1
    ends = doubled(edges, rounds)
    cyclic = ends.join(edges.withColumnRenamed("old", "end"), "end", "left_semi")
    if cyclic.isEmpty():
        return ends.select("path", F.col("end").alias("canonical"))
    on_cycle = cut(cyclic.select(F.col("end").alias("old")).distinct())
    before = edges.join(on_cycle, "old", "left_semi").select(F.col("new").alias("entry"), F.col("old").alias("canonical"))
    entries = doubled(edges.join(on_cycle, "old", "left_anti"), rounds).withColumnRenamed("end", "entry")
    return entries.join(before, "entry", "left").select("path", F.coalesce("canonical", "entry").alias("canonical"))


def path_map(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """(path, canonical) of the paths in rename chains; any other path is its own."""
    return chain_ends(rename_edges(commits, changes))


def history(commits: DataFrame, changes: DataFrame, paths: DataFrame | None = None, exclude_mechanical: bool = False) -> DataFrame:
    """Changes with their commit's time (ts, seconds) under canonical paths; raw_path is the path as committed."""
    if exclude_mechanical:
        commits = commits.where("NOT is_mechanical")
    own = changes.join(commits.select("sha", seconds("committed_at").alias("ts")), "sha").withColumn("raw_path", F.col("path"))
    if paths is not None:
        own = own.join(paths, "path", "left").withColumn("path", F.coalesce("canonical", "path")).drop("canonical")
    return own


def latest(rows: DataFrame) -> DataFrame:
    """The latest change of each path: by time, sha, deletions last, type, path as committed, and ``tie`` where there is one."""
    order = [F.desc("ts"), F.desc("sha"), (F.col("change_type") == "D").cast("int"), "change_type", "raw_path", *(["tie"] if "tie" in rows.columns else [])]
    ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy("path").orderBy(*order)))
    return ranked.where("rn = 1").drop("rn")


def living_files(rows: DataFrame) -> DataFrame:
    """Files whose latest change isn't a deletion: path, last_sha, revisions (rows), total_added, blob_sha."""
    totals = rows.groupBy("path").agg(F.count("*").alias("revisions"), F.sum(F.col("added").cast("bigint")).alias("total_added"))
    last = latest(rows).where("change_type <> 'D'").select("path", F.col("sha").alias("last_sha"), "blob_sha")
    return last.join(totals, "path").select("path", "last_sha", "revisions", "total_added", "blob_sha")
