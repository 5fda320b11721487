"""A history in Parquet: transactions over all tables, idempotent appends, one-row meta, caches, materialized tables."""

from __future__ import annotations

import datetime as dt
import json
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..functions.columns import from_seconds, normalized_email
from ..model import Config, StoreError
from ..operators.history import excluded, with_mechanical
from ..operators.ranking import global_rank

ENGINE_VERSION = "0.1.0"
CACHES = {"complexity_cache": "blob_sha string, lang string, value double, per_loc double, loc int, method string, backend string", "blame_cache": "path string, last_sha string, revisions bigint, failed boolean, commit_sha string, lines int"}
TABLES = {"authors": model.AUTHORS, "commits": model.COMMITS, "file_changes": model.FILE_CHANGES}
#: Folders of a table from which an append writes it anew as one.
MOST_FOLDERS = 64
#: Manifests that stay, and seconds after which a folder that no manifest names counts as left behind.
KEPT, GRACE = 2, 86_400


class Store:
    """Tables below ``root``, on any file system that Spark writes to.

    A table is a list of Parquet folders that never change. A manifest names the folders of all tables; the one with
    the largest number holds. A transaction writes new folders and then its manifest, which a rename puts in place
    under a number that is still free: readers see all of it or nothing, and a writer that another one has overtaken
    fails.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._files = self._path(self.root).getFileSystem(self._conf)
        self._staged: dict[str, list[str]] | None = None

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.root}/{folder}")
        return sorted(f.getPath().getName() for f in self._files.listStatus(at)) if self._files.exists(at) else []

    def _numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("manifests") if n.removesuffix(".json").isdigit())

    def _manifest(self, number: int) -> dict[str, list[str]]:
        stream = self._files.open(self._path(f"{self.root}/manifests/{number:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _tables(self) -> dict[str, list[str]]:
        if self._staged is not None:
            return self._staged
        numbers = self._numbers()
        return self._manifest(numbers[-1]) if numbers else {}

    def _publish(self, number: int, tables: dict[str, list[str]]) -> None:
        new = self._path(f"{self.root}/manifests/.new-{uuid.uuid4().hex}")
        stream = self._files.create(new, False)
        stream.write(bytearray(json.dumps(tables, sort_keys=True).encode()))
        stream.close()
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri() if new.toUri().getScheme() else self._files.getUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(self._files.makeQualified(new), self._files.makeQualified(self._path(f"{self.root}/manifests/{number:012d}.json")), options)
        except Py4JJavaError as e:
            self._files.delete(new, False)
            raise StoreError("another writer has published first") from e

    @contextmanager
    def transaction(self) -> Iterator[None]:
        """What is appended and replaced inside is read inside; others see it when the block has ended, all at once. A block that fails changes nothing."""
        if self._staged is not None:  # part of the one around it
            yield
            return
        numbers = self._numbers()
        self._staged = {k: list(v) for k, v in (self._manifest(numbers[-1]) if numbers else {}).items()}
        try:
            yield
            self._publish(numbers[-1] + 1 if numbers else 1, self._staged)
        finally:
            self._staged = None

    def _written(self, name: str, df: DataFrame) -> str:
        folder = f"{name}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        return folder

    def _folders(self, folders: list[str], schema: str | None) -> DataFrame:
        paths = [f"{self.root}/{f}" for f in folders]
        return self.spark.read.schema(schema).parquet(*paths) if schema else self.spark.read.parquet(*paths)

    def read(self, name: str, schema: str | None = None) -> DataFrame:
        schema = schema or TABLES.get(name) or CACHES.get(name)
        folders = self._tables().get(name, [])
        if not folders and schema is None:
            raise StoreError(f"there is no table {name}")
        return self._folders(folders, schema) if folders else self.spark.createDataFrame([], schema)

    def replace(self, name: str, df: DataFrame) -> None:
        with self.transaction():
            self._staged[name] = [self._written(name, df)]

    def append(self, name: str, df: DataFrame) -> None:
        with self.transaction():
            if len(self._staged.get(name, [])) >= MOST_FOLDERS:
                old = self.read(name)
                self.replace(name, old.unionByName(df.select(*old.columns)))
            else:
                self._staged.setdefault(name, []).append(self._written(name, df))

    def clear(self) -> None:
        """Begin anew, inside a transaction: no table has rows."""
        with self.transaction():
            self._staged.clear()

    def vacuum(self, grace: float = GRACE) -> None:
        """Delete manifests but the last ``KEPT``, the folders that only they name, and folders left behind by writers that failed ``grace`` seconds ago."""
        numbers = self._numbers()
        kept = {f for n in numbers[-KEPT:] for folders in self._manifest(n).values() for f in folders}
        past = {f for n in numbers[:-KEPT] for folders in self._manifest(n).values() for f in folders}
        for name in self._names(""):
            for version in self._names(name) if name != "manifests" else []:
                at = self._path(f"{self.root}/{name}/{version}")
                if (own := f"{name}/{version}") not in kept and (own in past or self._files.getFileStatus(at).getModificationTime() / 1000 < time.time() - grace):
                    self._files.delete(at, True)
        for n in numbers[:-KEPT]:
            self._files.delete(self._path(f"{self.root}/manifests/{n:012d}.json"), False)

    def meta(self) -> dict | None:
        row = self.read("analysis_meta", model.META).first()
        return row.asDict() if row else None

    def set_meta(self, config_hash: str, head_sha: str | None, metrics_hash: str | None = None) -> None:
        row = (ENGINE_VERSION, config_hash, metrics_hash, dt.datetime.now(dt.UTC).replace(tzinfo=None), head_sha)
        self.replace("analysis_meta", self.spark.createDataFrame([row], model.META).coalesce(1))

    def put(self, cache: str, rows: DataFrame, keys: list[str]) -> None:
        """Add rows whose keys the cache hasn't got."""
        self.append(cache, rows.select(*self.read(cache).columns).join(self.read(cache).select(*keys).distinct(), keys, "left_anti"))

    def put_blame(self, rows: DataFrame) -> None:
        """Put rows in the place of all that the cache has of their paths. They are computed once."""
        with self.transaction():
            old = self.read("blame_cache")
            new = self._written("blame_cache", rows.select(*old.columns))
            paths = self._folders([new], CACHES["blame_cache"]).select("path").distinct()
            if not old.join(paths, "path", "left_semi").isEmpty():
                self.replace("blame_cache", old.join(paths, "path", "left_anti").select(*old.columns))
            self._staged.setdefault("blame_cache", []).append(new)


def flattened(history: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """Commits (with author and walk_index) and their changes, of rows as a history source gives them."""
    own = history if config.since is None else history.where(F.col("committed_at") >= config.since)
    changes = own.select("sha", F.explode("file_changes").alias("c")).select("sha", "c.path", "c.old_path", "c.added", "c.deleted", "c.change_type", "c.blob_sha")
    changes = excluded(changes, config.exclude)
    commits = with_mechanical(own.select("sha", "walk_index", "author", from_seconds("committed_at").alias("committed_at")), changes, config.mechanical_max_files)
    return commits, changes


def author_ids(commits: DataFrame, known: DataFrame) -> DataFrame:
    """New rows for ``authors``: ids go on from the largest known, in the order of first appearance in the walk; the first name stays."""
    own = commits.select("walk_index", F.col("author.name").alias("name"), normalized_email("author.email").alias("canonical_email"))
    firsts = own.groupBy("canonical_email").agg(F.min("walk_index").alias("first"), F.min_by("name", "walk_index").alias("canonical_name"))
    new = firsts.join(known.select("canonical_email"), "canonical_email", "left_anti")
    top = known.agg(F.coalesce(F.max("author_id"), F.lit(0))).first()[0]
    numbered = global_rank(new, [F.col("first"), F.col("canonical_email")], "n")
    return numbered.select((F.col("n") + top).cast("int").alias("author_id"), "canonical_name", "canonical_email")


def ingest(store: Store, history: DataFrame, config: Config, head_sha: str | None = None) -> int:
    """Add the commits of ``history`` that the store hasn't got, with their changes and authors, in one transaction; how many there were."""
    with store.transaction():
        history = history.dropDuplicates(["sha"]).join(store.read("commits").select("sha"), "sha", "left_anti").persist()
        try:
            commits, changes = flattened(history, config)
            store.append("authors", author_ids(commits, store.read("authors")).coalesce(1))
            people = store.read("authors").select("author_id", "canonical_email")
            rows = commits.join(people, normalized_email("author.email") == F.col("canonical_email")).select("sha", "author_id", "committed_at", F.col("files_changed").cast("int").alias("files_changed"), "is_mechanical").persist()
            n = rows.count()
            if n:
                store.append("file_changes", changes)
                store.append("commits", rows)
            rows.unpersist()
        finally:
            history.unpersist()
        store.set_meta(config.hash(), head_sha)
    return n


def analyze(store: Store, repo: str, config: Config) -> int:
    """Bring the store up to the repository's head; nothing is read where it is. New settings, or a run that isn't incremental, begin anew, and the old tables hold until the new ones are there."""
    from ..sources import git

    now, meta = git.head(repo), store.meta()
    anew = bool(meta) and (not config.incremental or meta["config_hash"] != config.hash())
    if now is None or meta and not anew and meta["head_sha"] == now:
        return 0
    with store.transaction():
        if anew:
            store.clear()
            meta = None
        known = {"hidden": meta["head_sha"]} if meta and meta["head_sha"] else {}
        n = ingest(store, git.read_history(store.spark, repo, tip=now, **known), config, now)
    store.vacuum()
    return n
