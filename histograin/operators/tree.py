"""Directory trees: rollups over path prefixes, and treemaps of small frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prefixes(df: DataFrame, path: str = "path") -> DataFrame:
    """A row for each folder above each path: dir (the root is the empty text) and depth."""
    parts = F.split(path, "/")
    dirs = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("dir"), n.alias("depth")))
    return df.withColumn("d", F.explode(dirs)).withColumns({"dir": F.col("d.dir"), "depth": F.col("d.depth")}).drop("d")


def rollup(files: DataFrame, value: str = "value", color: str | None = None) -> DataFrame:
    """Per folder: depth, files, raw (sum of values), area (sum of their roots), color (average weighted by value; 0 where all are 0)."""
    own = prefixes(files)
    sums = [F.count("*").alias("files"), F.sum(value).alias("raw"), F.sum(F.sqrt(value)).alias("area")]
    if not color:
        return own.groupBy("dir", "depth").agg(*sums)
    weighted = F.sum(F.col(color) * F.col(value))
    return own.groupBy("dir", "depth").agg(*sums, F.when(F.sum(value) > 0, weighted / F.nullif(F.sum(value), F.lit(0))).otherwise(F.lit(0.0)).alias("color"))


def born(files: DataFrame) -> DataFrame:
    """Per folder: the earliest born_ts of its files."""
    return prefixes(files).groupBy("dir", "depth").agg(F.min("born_ts").alias("born_ts"))


def nodes(files: DataFrame) -> DataFrame:
    """(path, parent, is_file, born_ts, leaf_count) of all files and folders of (path, born_ts)."""
    parent = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit(""))
    leaves = files.select("path", parent.alias("parent"), F.lit(True).alias("is_file"), "born_ts", F.lit(1).cast("bigint").alias("leaf_count"))
    folders = prefixes(files).groupBy(F.col("dir").alias("path")).agg(F.min("born_ts").alias("born_ts"), F.count("*").alias("leaf_count")).where("path <> ''")
    return leaves.unionByName(folders.select("path", parent.alias("parent"), F.lit(False).alias("is_file"), "born_ts", "leaf_count"))


#: Least share of a level's total that a tile takes.
TILE_SHARE = 0.004


def floored(df: DataFrame, area: str = "area", share: float = TILE_SHARE, level: str | None = None) -> DataFrame:
    """``tile``: the root of the area, at least a share of the sum of roots over all rows (of the same ``level``), so that none vanishes."""
    if level is None:
        total = df.agg(F.sum(F.sqrt(area)).alias("t__"))
        own = df.crossJoin(F.broadcast(total))
    else:
        own = df.join(df.groupBy(level).agg(F.sum(F.sqrt(area)).alias("t__")), level)
    return own.withColumn("tile", F.greatest(F.sqrt(area), F.col("t__") * share)).drop("t__")


def treemap(areas: Sequence[float], width: float, height: float) -> list[tuple[float, float, float, float]]:
    """(x, y, width, height) of each area, in proportion, as square as rows allow; areas come in the caller's order."""
    total = float(sum(areas))
    if not areas or total <= 0 or width <= 0 or height <= 0:
        return [(0.0, 0.0, 0.0, 0.0)] * len(areas)
    left = [a * width * height / total for a in areas]
    x, y, w, h, at, out = 0.0, 0.0, float(width), float(height), 0, []

    def worst(row: list[float], side: float) -> float:
        s = sum(row)
        return max(side * side * max(row) / (s * s), s * s / (side * side * min(row))) if s > 0 and min(row) > 0 else float("inf")

    while at < len(left):
        side = min(w, h)
        row = [left[at]]
        while at + len(row) < len(left) and worst([*row, left[at + len(row)]], side) <= worst(row, side):
            row.append(left[at + len(row)])
        thick, pos = (sum(row) / side if side > 0 else 0.0), 0.0
        for a in row:
            long = a / thick if thick > 0 else 0.0
            out.append((x, y + pos, thick, long) if w >= h else (x + pos, y, long, thick))
            pos += long
        if w >= h:
            x, w = x + thick, w - thick
        else:
            y, h = y + thick, h - thick
        at += len(row)
    return out
