"""The five file-level metrics: churn, coupling, complexity and hotspots, knowledge, age."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import DAY, age_bucket, age_days, col, language, min_max, per_loc, seconds
from .history import anchor, history
from .ranking import global_rank

UNKNOWN = -1
#: Files of a commit that meet in one task to make pairs.
PAIR_BLOCK = 1000


def churn(commits: DataFrame, changes: DataFrame, paths: DataFrame | None = None, windows: tuple[int, ...] = (30, 90, 365), exclude_mechanical: bool = True) -> DataFrame:
    """path, churn_total, churn_<days>d for each window, lines_added, lines_deleted, is_alive.

    Commits are counted once a file; a window begins ``days`` before the latest commit of all, to the second and
    inclusive. A file is alive if its latest change, of those counted, isn't a deletion; a deletion and a new file of
    one commit leave it alive.
    """
    rows = history(commits, changes, paths, exclude_mechanical)
    end = commits.agg(F.max(seconds("committed_at"))).first()[0]
    alive = F.col("change_type") != "D"
    own = rows.groupBy("path", "sha").agg(F.first("ts").alias("ts"), F.sum(F.col("added").cast("bigint")).alias("added"), F.sum(F.col("deleted").cast("bigint")).alias("deleted"), F.max(alive).alias("alive"))
    cuts = [F.sum((F.col("ts") >= F.lit(end) - d * DAY).cast("bigint")).alias(f"churn_{d}d") for d in windows]
    out = own.groupBy("path").agg(F.count("*").alias("churn_total"), *cuts, F.sum("added").alias("lines_added"), F.sum("deleted").alias("lines_deleted"), F.max_by("alive", F.struct("ts", "sha")).alias("is_alive"))
    return out


def coupling(commits: DataFrame, changes: DataFrame, paths: DataFrame | None = None, min_support: int = 5, exclude_mechanical: bool = True, block: int = PAIR_BLOCK) -> DataFrame:
    """path_a < path_b, support (commits with both), coupling_ratio = support / commits of the rarer one.

    Files that have too few commits for ``min_support`` can be in no pair and go before the pairs are made. A commit
    that changed more than ``block`` files is dealt into blocks of them, of which every two meet by themselves.
    """
    own = history(commits.where("NOT is_mechanical") if exclude_mechanical else commits, changes, paths).select("path", "sha").distinct()
    counts = own.groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") >= min_support)
    sides = own.join(counts.select("path"), "path")
    large = commits.where(F.col("files_changed") > block).select("sha", F.ceil(F.col("files_changed") / block).cast("int").alias("blocks"))
    met = _meeting(sides) if large.isEmpty() else _meeting(sides.join(large.select("sha"), "sha", "left_anti")).unionByName(_meeting(sides.join(large, "sha"), "blocks"))
    pairs = met.groupBy("path_a", "path_b").agg(F.count("*").alias("support")).where(F.col("support") >= min_support)
    kept = pairs.join(counts.select(F.col("path").alias("path_a"), F.col("n").alias("n_a")), "path_a").join(counts.select(F.col("path").alias("path_b"), F.col("n").alias("n_b")), "path_b")
    return kept.select("path_a", "path_b", "support", (F.col("support") / F.least("n_a", "n_b")).alias("coupling_ratio"))


def _meeting(sides: DataFrame, blocks: str | None = None) -> DataFrame:
    """path_a < path_b of each commit; with ``blocks``, of every two of its blocks of files by themselves."""
    if blocks is None:
        a, b, keys = sides.select("sha", F.col("path").alias("path_a")), sides.select("sha", F.col("path").alias("path_b")), ["sha"]
    else:
        own, every = F.pmod(F.xxhash64("path"), F.col(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
        a = sides.select("sha", F.col("path").alias("path_a"), own.alias("i"), every.alias("j"))
        b, keys = sides.select("sha", F.col("path").alias("path_b"), own.alias("j"), every.alias("i")), ["sha", "i", "j"]
    return a.join(b, keys).where("path_a < path_b").select("path_a", "path_b")


def coupling_order() -> list:
    return [F.desc("coupling_ratio"), F.desc("support"), "path_a", "path_b"]


def coupling_view(pairs: DataFrame, min_ratio: float = 0.0, min_support: int = 0, top: int | None = None, depth: int | None = None) -> DataFrame:
    """Data of a coupling graph: pairs above the thresholds, the first ``top``, folded to the first ``depth`` folders."""
    own = pairs.where((F.col("coupling_ratio") >= min_ratio) & (F.col("support") >= min_support))
    if depth is not None:
        fold = lambda c: F.array_join(F.slice(F.split(c, "/"), 1, depth), "/")
        own = own.select(F.least(fold("path_a"), fold("path_b")).alias("path_a"), F.greatest(fold("path_a"), fold("path_b")).alias("path_b"), "support", "coupling_ratio")
        own = own.where("path_a <> path_b").groupBy("path_a", "path_b").agg(F.sum("support").alias("support"), F.max("coupling_ratio").alias("coupling_ratio"))
    own = own.orderBy(*coupling_order())
    return own.limit(top) if top else own


def complexity(living: DataFrame, values: DataFrame) -> DataFrame:
    """path, language, method, complexity, complexity_per_loc, loc of living files, from values by blob and language."""
    tagged = living.select("path", "blob_sha", F.coalesce(language("path"), F.lit("none")).alias("language"))
    own = tagged.join(values.withColumnRenamed("lang", "language"), ["blob_sha", "language"])
    return own.select("path", F.nullif("language", F.lit("none")).alias("language"), "method", F.col("value").alias("complexity"), per_loc("value", "loc").alias("complexity_per_loc"), "loc")


def rank_percentile(df: DataFrame, value: str, name: str, tie: str = "path") -> DataFrame:
    """0 for the smallest to 1 for the largest value; equal values follow in the order of ``tie``; 1 for a single row."""
    ranked = global_rank(df, [F.col(value), F.col(tie)], "rank__of")
    n = ranked.agg(F.count("*").alias("rank__all"))
    share = F.when(F.col("rank__all") > 1, (F.col("rank__of") - 1) / F.nullif(F.col("rank__all") - 1, F.lit(0)).cast("double")).otherwise(F.lit(1.0))
    return ranked.crossJoin(F.broadcast(n)).withColumn(name, share).drop("rank__of", "rank__all")


def hotspots(file_churn: DataFrame, file_complexity: DataFrame, window: str = "total") -> DataFrame:
    """Files with a syntax-based complexity, ranked by the product of their churn's and complexity's rank percentiles.

    ``window``: total, or days of a churn window. A file without a living churn row counts as never changed.
    """
    column = "churn_total" if window == "total" else f"churn_{window}d"
    alive = file_churn.where("is_alive").select("path", F.col(column).alias("churn"))
    own = file_complexity.where("method = 'cyclomatic'").select("path", "complexity").join(alive, "path", "left").withColumn("churn", F.coalesce("churn", F.lit(0)))
    own = rank_percentile(rank_percentile(own, "churn", "churn_pct"), "complexity", "complexity_pct")
    own = own.withColumn("score", F.col("churn_pct") * F.col("complexity_pct"))
    return global_rank(own, [-F.col("score"), F.col("path")], "rank")


def ownership(hunks: DataFrame, commits: DataFrame) -> DataFrame:
    """path, author_id, lines, total, ownership_ratio of blamed lines; a commit that isn't known belongs to author -1. Files without lines are left out."""
    known = hunks.where("NOT failed AND lines > 0").join(commits.select(F.col("sha").alias("commit_sha"), "author_id"), "commit_sha", "left")
    own = known.groupBy("path", F.coalesce("author_id", F.lit(UNKNOWN)).alias("author_id")).agg(F.sum(F.col("lines").cast("bigint")).alias("lines"))
    own = own.withColumn("total", F.sum("lines").over(Window.partitionBy("path")))
    return own.where("total > 0").withColumn("ownership_ratio", F.col("lines") / F.col("total"))


def _by_share() -> Window:
    return Window.partitionBy("path").orderBy(F.desc("lines"), "author_id")


def bus_factor(owned: DataFrame, threshold: float = 0.5) -> DataFrame:
    """path, bus_factor (fewest owners with strictly more than the threshold of the lines; all if none have), top_owner_ratio, owners, total."""
    order = _by_share()
    ranked = owned.withColumn("rn", F.row_number().over(order)).withColumn("cum", F.sum("lines").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    enough = F.min(F.when(F.col("cum") > F.lit(threshold) * F.col("total"), F.col("rn")))
    return ranked.groupBy("path").agg(F.coalesce(enough, F.max("rn")).cast("bigint").alias("bus_factor"), F.max("ownership_ratio").alias("top_owner_ratio"), F.count("*").alias("owners"), F.first("total").alias("total"))


def top_owner(owned: DataFrame) -> DataFrame:
    """path, author_id, ownership_ratio of the first owner."""
    order = Window.partitionBy("path").orderBy(F.desc("ownership_ratio"), "author_id")
    return owned.withColumn("rn", F.row_number().over(order)).where("rn = 1").select("path", "author_id", "ownership_ratio")


def knowledge_risk(factors: DataFrame, owners: DataFrame, only_single: bool = False, top: int | None = None) -> DataFrame:
    """Files by risk: smallest bus factor, largest share, path; with the first owner."""
    own = factors.join(owners.select("path", "author_id"), "path")
    own = (own.where("bus_factor = 1") if only_single else own).orderBy("bus_factor", F.desc("top_owner_ratio"), "path")
    return own.limit(top) if top else own


def failed_files(hunks: DataFrame) -> DataFrame:
    """One row: files whose lines couldn't be attributed."""
    return hunks.agg(F.countDistinct(F.when(F.col("failed"), F.col("path"))).alias("failed"))


def age(hunks: DataFrame, commits: DataFrame, percentiles: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """path, lines, newest, median, p90 and oldest age in days, weighted by lines; lines of unknown commits are left out.

    A percentile is the smallest age that, with all smaller ones, covers ceil(p * lines) lines, one at least.
    """
    timed = hunks.where("NOT failed AND lines > 0").join(commits.select(F.col("sha").alias("commit_sha"), seconds("committed_at").alias("ts")), "commit_sha")
    aged = timed.crossJoin(F.broadcast(anchor(commits))).groupBy("path", age_days("anchor", "ts").alias("age")).agg(F.sum(F.col("lines").cast("bigint")).alias("lines"))
    order = Window.partitionBy("path").orderBy("age")
    own = aged.withColumn("cum", F.sum("lines").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("lines").over(Window.partitionBy("path")))
    names = {0.5: "median_age_days", 0.9: "p90_age_days"}
    points = [F.min(F.when(F.col("cum") >= F.greatest(F.ceil(F.lit(p) * F.col("total")), F.lit(1)), F.col("age"))).alias(names.get(p, f"p{round(p * 100)}_age_days")) for p in percentiles]
    return own.groupBy("path").agg(F.first("total").alias("lines"), F.min("age").alias("newest_age_days"), *points, F.max("age").alias("oldest_age_days"))


def age_histogram(ages: DataFrame, inclusive: bool = False) -> DataFrame:
    """bucket (0 to 5), files: by median age, empty buckets too."""
    counts = ages.groupBy(age_bucket("median_age_days", inclusive).alias("bucket")).agg(F.count("*").alias("files"))
    return ages.sparkSession.range(6).withColumnRenamed("id", "bucket").join(counts, "bucket", "left").select("bucket", F.coalesce("files", F.lit(0)).alias("files"))


def median_of_medians(ages: DataFrame) -> DataFrame:
    """One row: the upper median of the files' median ages; no row without files."""
    ranked = global_rank(ages.select("median_age_days", "path"), [F.col("median_age_days"), F.col("path")], "rn")
    return ranked.crossJoin(F.broadcast(ranked.agg(F.count("*").alias("n")))).where("rn = n div 2 + 1").select(F.col("median_age_days").alias("median_of_medians"))


def age_members(ages: DataFrame, inclusive: bool = True) -> DataFrame:
    """bucket, path, median_age_days, n: the files of each age bucket, numbered from the youngest bucket on, in it by median age and path."""
    own = ages.select(age_bucket("median_age_days", inclusive).alias("bucket"), "path", "median_age_days")
    return global_rank(own, [F.col("bucket"), F.col("median_age_days"), F.col("path")], "n")


def search(files: DataFrame, text: str) -> DataFrame:
    """Files whose path has ``text`` in it, whatever the case; white space around it doesn't count, and an empty text finds all."""
    return files.where(F.contains(F.lower("path"), F.lit(text.strip().lower())))


def maxima(df: DataFrame, *columns: str) -> DataFrame:
    """One row: max_<column> of each, 1 at least, for scales that begin at 0."""
    return df.agg(*[F.greatest(F.lit(1), F.coalesce(F.max(c), F.lit(1))).alias(f"max_{c}") for c in columns])


def file_metrics(file_churn: DataFrame, file_complexity: DataFrame, ranked: DataFrame) -> DataFrame:
    """All files of either metric with both, and the hotspot rank."""
    windows = [c for c in file_churn.columns if c.startswith("churn_")]
    both = file_churn.select("path", *windows, "is_alive").join(file_complexity.select("path", "complexity", "complexity_per_loc"), "path", "full_outer")
    return both.join(ranked.select("path", F.col("rank").alias("hotspot_rank")), "path", "left")


def blame_plan(living: DataFrame, budget: int = 10_000_000) -> DataFrame:
    """Living files with cost (revisions * lines added, held at the largest bigint) and over_budget; a budget of 0 is none."""
    from ..functions.columns import saturating_product

    own = living.withColumn("cost", saturating_product("revisions", "total_added"))
    return own.withColumn("over_budget", (F.lit(budget) > 0) & (F.col("cost") > budget))


def blame_misses(plan: DataFrame, cache: DataFrame) -> DataFrame:
    """Files within the budget whose (path, last_sha, revisions) the cache hasn't got, the most costly first."""
    return plan.where("NOT over_budget").join(cache, ["path", "last_sha", "revisions"], "left_anti").orderBy(F.desc("cost"), "path")


def valid_cache(cache: DataFrame, living: DataFrame) -> DataFrame:
    """Cache rows that still stand for a living file's state."""
    return cache.join(living.select("path", "last_sha", "revisions"), ["path", "last_sha", "revisions"], "left_semi")


def normalized(df: DataFrame, value: str, name: str) -> DataFrame:
    bounds = df.agg(F.min(value).alias("low__"), F.max(value).alias("high__"))
    return df.crossJoin(F.broadcast(bounds)).withColumn(name, min_max(col(value), F.col("low__"), F.col("high__"))).drop("low__", "high__")


def anonymous_labels(authors: DataFrame, scope: str = "knowledge") -> DataFrame:
    """(author_id, label): ``Author #n`` over the distinct ids in their order; in the scope ``commits`` the unknown author is ``Author #?``."""
    ids = authors.select("author_id").distinct()
    known = ids.where(F.col("author_id") != UNKNOWN) if scope == "commits" else ids
    out = global_rank(known, [F.col("author_id")], "n").select("author_id", F.concat(F.lit("Author #"), F.col("n").cast("string")).alias("label"))
    return out.union(ids.where(F.col("author_id") == UNKNOWN).select("author_id", F.lit("Author #?"))) if scope == "commits" else out


def labelled(df: DataFrame, labels: DataFrame) -> DataFrame:
    return df.join(labels, "author_id", "left").withColumn("label", F.coalesce("label", F.lit("Author #?")))
