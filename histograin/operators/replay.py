"""Events of a history and their replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import seconds
from ..session import cut
from .metrics import maxima
from .ranking import global_rank


def events(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """One row a change: ts, sha, author_id, mechanical, path, change_type, old_path, added, deleted. Commits without changes have none."""
    own = commits.select("sha", seconds("committed_at").alias("ts"), "author_id", F.col("is_mechanical").alias("mechanical"))
    return changes.join(own, "sha").select("ts", "sha", "author_id", "mechanical", "path", "change_type", "old_path", "added", "deleted")


def event_order() -> list[Column]:
    """The order of all change rows: time, sha, path, type, old path; rows without one last."""
    return [*map(F.col, ("ts", "sha", "path", "change_type")), F.col("old_path").isNull(), F.col("old_path")]


def nested(flat: DataFrame) -> DataFrame:
    """One row a commit, its changes in event order in ``changes``."""
    change = F.struct("path", "change_type", F.col("old_path").isNull().alias("last"), "old_path", "added", "deleted")
    own = flat.groupBy("sha", "ts", "author_id", "mechanical").agg(F.array_sort(F.collect_list(change)).alias("c"))
    plain = F.transform("c", lambda x: F.struct(x.path.alias("path"), x.change_type.alias("change_type"), x.old_path.alias("old_path"), x.added.alias("added"), x.deleted.alias("deleted")))
    return own.select("sha", "ts", "author_id", "mechanical", plain.alias("changes"))


def numbered(flat: DataFrame) -> DataFrame:
    """Events with index, the number of their commit from 0 in the order of time and sha."""
    commits = global_rank(flat.select("ts", "sha").distinct(), [F.col("ts"), F.col("sha")], "index").withColumn("index", F.col("index") - 1)
    return flat.join(commits.select("sha", "index"), "sha")


def operations(indexed: DataFrame) -> DataFrame:
    """What each change does to the tree: (index, op, path, present, moved), in a commit by path; a rename takes the old path first, and both its halves are ``moved``."""
    order = ["path", "change_type", F.asc_nulls_last("old_path")]
    own = indexed.withColumn("n", F.row_number().over(Window.partitionBy("index").orderBy(*order)))

    def step(k: int, path: str, present: int, moved: bool = False) -> Column:
        return F.struct(F.lit(k).alias("k"), F.col(path).alias("path"), F.lit(present).alias("present"), F.lit(moved).alias("moved"))

    rename = F.array(step(0, "old_path", 0, True), step(1, "path", 1, True))
    steps = F.when(F.col("change_type") == "D", F.array(step(0, "path", 0))).when((F.col("change_type") == "R") & F.col("old_path").isNotNull(), rename).otherwise(F.array(step(1, "path", 1)))
    return own.select("index", "n", F.explode(steps).alias("s")).select("index", (F.col("n") * 2 + F.col("s.k")).alias("op"), "s.path", "s.present", "s.moved")


def alive_series(indexed: DataFrame) -> DataFrame:
    """(index, touched, alive): change rows of each commit and files that live after it, from presence differences of paths."""
    ops = operations(indexed)
    order = Window.partitionBy("path").orderBy("index", "op")
    delta = ops.withColumn("d", F.col("present") - F.lag("present", 1, 0).over(order)).groupBy("index").agg(F.sum("d").alias("d"))
    touched = indexed.groupBy("index").agg(F.count("*").alias("touched"))
    return running_sum(touched.join(delta, "index"), "index", "d", "alive").select("index", "touched", "alive")


def running_sum(df: DataFrame, order: str, value: str, name: str, width: int = 4096) -> DataFrame:
    """Sum of ``value`` up to each row by a whole-number order: inside stretches of ``width`` after the sums of those before."""
    own = df.withColumn("stretch", F.floor(F.col(order) / width))
    before = own.groupBy("stretch").agg(F.sum(value).alias("s")).withColumn("before", F.sum("s").over(Window.partitionBy(F.lit(0)).orderBy("stretch")) - F.col("s")).drop("s")
    inner = F.sum(value).over(Window.partitionBy("stretch").orderBy(order))
    return own.join(before, "stretch").withColumn(name, (inner + F.col("before")).cast("bigint")).drop("stretch", "before")


def series_maxima(series: DataFrame) -> DataFrame:
    """One row: max_alive and max_touched, 1 at least."""
    return maxima(series, "alive", "touched")


def replay(indexed: DataFrame, index: int | None = None) -> DataFrame:
    """Files that live after commit ``index`` (the last by default): path, churn, last_touch; a rename hands the old path's churn on and adds one.

    A path's changes between two absences, or from a rename onto it, are a life; its churn is the number of its own
    changes and of those of the lives that renames lead it back to. These are added up by doubling pointers over the
    lives that renames connect alone, each round cut, in about log2 rounds of the longest chain of renames.
    """
    ops = operations(indexed if index is None else indexed.where(F.col("index") <= index))
    order = Window.partitionBy("path").orderBy("index", "op")
    before = F.lag("present", 1, 0).over(order)
    begins = (F.col("present") == 1) & ((F.col("before") == 0) | F.col("moved"))
    own = ops.withColumn("before", before).withColumn("life", F.sum(begins.cast("int")).over(order))
    lives = own.groupBy("path", "life").agg(F.sum("present").alias("churn"), F.max(F.when(F.col("present") == 1, F.col("index"))).alias("last_touch"), F.max_by("present", F.struct("index", "op")).alias("alive"))
    last = lives.withColumn("latest", F.max("life").over(Window.partitionBy("path"))).where("life = latest AND alive = 1").select("path", "life", "churn", "last_touch")
    here = own.where("moved AND present = 1").select("index", F.floor(F.col("op") / 2).alias("n"), "path", "life")
    gone = own.where("moved AND present = 0 AND before = 1").select("index", F.floor(F.col("op") / 2).alias("n"), F.col("path").alias("from_path"), F.col("life").alias("from_life"))
    links = cut(here.join(gone, ["index", "n"]).select("path", "life", "from_path", "from_life"))
    if links.isEmpty():
        return last.select("path", "churn", "last_touch")
    joined = links.select("path", "life").union(links.select("from_path", "from_life")).distinct()
    sums = lives.select("path", "life", "churn").join(joined, ["path", "life"]).join(links, ["path", "life"], "left")
    while True:
        sums = cut(sums)
        if sums.where("from_path IS NOT NULL").isEmpty():
            break
        back = sums.select(F.col("path").alias("from_path"), F.col("life").alias("from_life"), F.col("churn").alias("more"), F.col("from_path").alias("far_path"), F.col("from_life").alias("far_life"))
        sums = sums.join(back, ["from_path", "from_life"], "left").select("path", "life", (F.col("churn") + F.coalesce("more", F.lit(0))).alias("churn"), F.col("far_path").alias("from_path"), F.col("far_life").alias("from_life"))
    whole = sums.select("path", "life", F.col("churn").alias("whole"))
    return last.join(whole, ["path", "life"], "left").select("path", F.coalesce("whole", "churn").alias("churn"), "last_touch")


def frame_at(indexed: DataFrame, index: int) -> DataFrame:
    """The frame after commit ``index``, as ``replay`` gives it: a snapshot of the rows up to it, whatever was replayed before."""
    return replay(indexed, index)


def seek(commits_indexed: DataFrame, ts: int) -> DataFrame:
    """One row: index of the first commit at or after ``ts``, else of the last."""
    return commits_indexed.agg(F.coalesce(F.min(F.when(F.col("ts") >= ts, F.col("index"))), F.max("index")).alias("index"))


def until(flat: DataFrame, ts: int) -> DataFrame:
    return flat.where(F.col("ts") <= ts)


def first_appearance(flat: DataFrame) -> DataFrame:
    """path, born_ts: the first change that isn't a deletion."""
    return flat.where("change_type <> 'D'").groupBy("path").agg(F.min("ts").alias("born_ts"))
