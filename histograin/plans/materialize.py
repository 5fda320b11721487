"""All metrics of a store, computed once and published together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions.columns import seconds
from ..functions.complexity import complexities
from ..model import MetricConfig
from ..operators import history as H
from ..operators import metrics as M
from .store import Store

Reader = Callable[[DataFrame], DataFrame]


def complexity_of(store: Store, living: DataFrame, read_blobs: Reader) -> DataFrame:
    """Complexities of living files; only blobs that the cache hasn't got are read."""
    from ..functions.columns import language

    wanted = living.where("blob_sha IS NOT NULL").withColumn("lang", F.coalesce(language("path"), F.lit("none")))
    missing = wanted.join(store.read("complexity_cache").select("blob_sha", "lang"), ["blob_sha", "lang"], "left_anti").groupBy("blob_sha", "lang").agg(F.min("path").alias("path"))
    if not missing.isEmpty():
        store.put("complexity_cache", complexities(read_blobs(missing.select("blob_sha", "path"))), ["blob_sha", "lang"])
    return M.complexity(living, store.read("complexity_cache"))


def hunks_of(store: Store, living: DataFrame, budget: int, blame: Reader) -> tuple[DataFrame, DataFrame]:
    """Hunks of living files and (path, reason, cost, budget) of those left out; only states that the cache hasn't got are blamed."""
    plan = M.blame_plan(living, budget).persist()
    misses = M.blame_misses(plan, store.read("blame_cache").select("path", "last_sha", "revisions").distinct())
    if not misses.isEmpty():
        store.put_blame(blame(misses))
    within = plan.where("NOT over_budget").select("path", "last_sha", "revisions", "cost")
    cached = store.read("blame_cache").join(within, ["path", "last_sha", "revisions"])
    failed = cached.where("failed").select("path", F.lit("failed").alias("reason"), "cost", F.lit(budget).cast("bigint").alias("budget")).distinct()
    over = plan.where("over_budget").select("path", F.lit("over_budget").alias("reason"), "cost", F.lit(budget).cast("bigint").alias("budget"))
    return cached.select("path", "failed", "commit_sha", "lines"), over.unionByName(failed)


def materialize(store: Store, read_blobs: Reader, blame: Reader, config: MetricConfig | None = None) -> dict[str, int]:
    """Compute the metric tables and publish them together, with the settings' hash; rows of each. What caches gain is published before."""
    config = config or MetricConfig()
    commits, changes = store.read("commits"), store.read("file_changes")
    paths = H.path_map(commits, changes).persist()
    living = H.living_files(H.history(commits, changes, paths)).persist()
    churn = M.churn(commits, changes, paths, config.windows, config.exclude_mechanical).persist()
    cx = complexity_of(store, living, read_blobs).persist()
    ranked = M.hotspots(churn, cx, config.hotspot_window)
    hunks, skips = hunks_of(store, living, config.blame_budget, blame)
    hunks = hunks.persist()
    owned = M.ownership(hunks, commits).persist()
    recent, mid, long = config.windows
    files = M.file_metrics(churn, cx, ranked)
    tables = {
        "file_metrics": files.select("path", F.col("churn_total"), F.col(f"churn_{recent}d").alias("churn_30d"), F.col(f"churn_{mid}d").alias("churn_90d"), F.col(f"churn_{long}d").alias("churn_365d"), "complexity", "complexity_per_loc", "hotspot_rank", "is_alive"),
        "coupling": M.coupling(commits, changes, paths, config.min_support, config.exclude_mechanical).withColumn("explained_by_imports", F.lit(None).cast("boolean")),
        "knowledge": owned.select("path", "author_id", "ownership_ratio"),
        "module_bus_factor": M.bus_factor(owned, config.bus_threshold).select(F.col("path").alias("module"), "bus_factor", "top_owner_ratio"),
        "file_age": M.age(hunks, commits),
        "blame_skips": skips,
    }
    schemas = {"file_metrics": model.FILE_METRICS, "coupling": model.COUPLING, "knowledge": model.KNOWLEDGE, "module_bus_factor": model.MODULE_BUS_FACTOR, "file_age": model.FILE_AGE, "blame_skips": model.BLAME_SKIPS}
    with store.transaction():
        for name, df in tables.items():
            own = [field.rsplit(" ", 1) for field in schemas[name].split(", ")]
            store.replace(name, df.select(*(F.col(c).cast(t).alias(c) for c, t in own)))
        meta = store.meta() or {}
        store.set_meta(meta.get("config_hash"), meta.get("head_sha"), config.hash())
    counts = {name: store.read(name).count() for name in tables}
    for df in (paths, living, churn, cx, hunks, owned):
        df.unpersist()
    store.vacuum()
    return counts


def counts_of(commits: DataFrame, files: DataFrame, pairs: DataFrame, factors: DataFrame, knowledge: DataFrame) -> DataFrame:
    """One row: commits, anchor (seconds of the latest, 0 without any), files, ranked files, pairs, files with one owner, authors."""
    parts = [
        commits.agg(F.count("*").alias("commits"), F.coalesce(F.max(seconds("committed_at")), F.lit(0)).alias("anchor")),
        files.agg(F.count("*").alias("files"), F.count("hotspot_rank").alias("ranked_files")),
        pairs.agg(F.count("*").alias("pairs")),
        factors.where("bus_factor = 1").agg(F.count("*").alias("single_owner")),
        knowledge.agg(F.countDistinct("author_id").alias("authors")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # rows of one
    return out


def overview(store: Store) -> DataFrame:
    """The counts of a materialized store."""
    return counts_of(*(store.read(t) for t in ("commits", "file_metrics", "coupling", "module_bus_factor", "knowledge"))).drop("anchor")
