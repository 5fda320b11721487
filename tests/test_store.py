"""Transactions of the store: what a run that breaks off, another writer, or a stream that lags leaves behind."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from histograin import model
from histograin.model import Config, MetricConfig, StoreError
from histograin.plans import materialize as P
from histograin.plans.store import CACHES, Store, ingest
from histograin.streaming import ingest as S


def commits(n, first=0):
    return [(first + n - 1 - i, f"c{first + i}", [], (f"Name {i % 3}", f"n{i % 3}@x"), 1_600_000_000 + 86_400 * (first + i), [(f"f{i % 4}.md", None, 2, 0, "A" if i < 4 else "M", f"b{first + i}")]) for i in range(n)]


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/db")


def history(spark, rows):
    return spark.createDataFrame(rows, model.HISTORY)


def state(store):
    return {t: sorted(map(str, store.read(t).collect())) for t in ("authors", "commits", "file_changes")}


@pytest.mark.parametrize("step", ["authors", "file_changes", "commits", "analysis_meta"])
def test_a_run_that_breaks_off_changes_nothing(spark, store, monkeypatch, step):
    ingest(store, history(spark, commits(5)), Config(), "c4")
    before, meta = state(store), store.meta()
    write = Store._written

    def breaks(self, name, df):
        folder = write(self, name, df)
        if name == step:
            raise RuntimeError("killed")
        return folder

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(Store, "_written", breaks)
        ingest(store, history(spark, commits(9)), Config(), "c8")
    other = Store(spark, store.root)
    assert state(other) == before and other.meta() == meta
    assert ingest(other, history(spark, commits(9)), Config(), "c8") == 4
    assert other.read("commits").count() == 9 and other.read("authors").count() == 3 and other.meta()["head_sha"] == "c8"
    whole = Store(spark, f"{store.root}-whole")
    ingest(whole, history(spark, commits(9)), Config(), "c8")
    assert {t: len(v) for t, v in state(whole).items()} == {t: len(v) for t, v in state(other).items()}
    left = {f for t in ("commits", "file_changes", "authors", "analysis_meta") for f in os.listdir(f"{store.root.removeprefix('file://')}/{t}")}
    other.vacuum(grace=-60)  # what the broken run left behind goes, what the last manifests name stays
    kept = {f for t in ("commits", "file_changes", "authors", "analysis_meta") for f in os.listdir(f"{store.root.removeprefix('file://')}/{t}")}
    assert kept < left and len(state(other)["commits"]) == 9


def test_writers_at_once(spark, store):
    store.replace("commits", spark.createDataFrame([("a", 1, dt.datetime(2020, 1, 1), 1, False)], model.COMMITS))
    other = Store(spark, store.root)
    with pytest.raises(StoreError), store.transaction():
        store.append("commits", store.read("commits"))
        other.append("commits", spark.createDataFrame([("b", 1, dt.datetime(2020, 1, 1), 1, False)], model.COMMITS))
    assert sorted(r.sha for r in store.read("commits").collect()) == ["a", "b"]


def test_old_versions_go_and_appends_are_gathered(spark, store, monkeypatch):
    from histograin.plans import store as module

    monkeypatch.setattr(module, "MOST_FOLDERS", 3)
    row = lambda k: spark.createDataFrame([(k, 1, dt.datetime(2020, 1, 1), 1, False)], model.COMMITS)
    reader = None
    for k in "abcdefg":
        store.append("commits", row(k))
        reader = reader or store.read("commits")
    assert sorted(r.sha for r in store.read("commits").collect()) == list("abcdefg") and [r.sha for r in reader.collect()] == ["a"]
    store.vacuum()
    root = store.root.removeprefix("file://")
    assert len([f for f in os.listdir(f"{root}/manifests") if f.endswith(".json") and not f.startswith(".")]) == module.KEPT
    assert sorted(r.sha for r in store.read("commits").collect()) == list("abcdefg")


def hunks(spark, calls):
    def blame(files):
        def run(frames):
            for f in frames:
                calls.add(len(f))
                yield f.assign(failed=False, commit_sha="c0", lines=1)[["path", "last_sha", "revisions", "failed", "commit_sha", "lines"]]

        return files.mapInPandas(run, CACHES["blame_cache"])

    return blame


def test_metrics_are_published_together_and_blamed_once(spark, store, monkeypatch):
    ingest(store, history(spark, commits(9)), Config(), "c8")
    calls, blobs = spark.sparkContext.accumulator(0), lambda df: df.withColumn("content", F.lit(b"a"))
    config = MetricConfig(min_support=1)
    P.materialize(store, blobs, hunks(spark, calls), config)
    assert calls.value == 4 and store.read("blame_cache").count() == 4
    assert store.meta()["metrics_hash"] == config.hash() and store.meta()["head_sha"] == "c8"
    before = sorted(map(str, store.read("file_metrics").collect()))
    ingest(store, history(spark, commits(3, 9)), Config(), "c11")
    assert store.meta()["metrics_hash"] is None  # the metrics are those of an older state
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        write = Store._written
        m.setattr(Store, "_written", lambda self, name, df: (_ for _ in ()).throw(RuntimeError("killed")) if name == "knowledge" else write(self, name, df))
        P.materialize(store, blobs, hunks(spark, calls), config)
    assert sorted(map(str, store.read("file_metrics").collect())) == before  # none of the new tables
    assert calls.value == 7 and store.read("blame_cache").count() == 4  # three files changed; the cache has them already
    P.materialize(store, blobs, hunks(spark, calls), config)
    assert calls.value == 7 and sorted(map(str, store.read("file_metrics").collect())) != before


def test_stream_stores_the_head_of_its_batch(spark, store, monkeypatch):
    """The repository may be further than the batch: the next run must not take its head for the store's."""
    batch = history(spark, commits(3))
    taken = []

    class Writer:
        def foreachBatch(self, take):
            taken.append(take)
            return self

        option = trigger = lambda self, *a, **k: self

        def start(self):
            return self

    class Stream:
        writeStream = Writer()

    class Reader:
        format = option = lambda self, *a: self

        def load(self):
            return Stream()

    class Session:
        readStream = Reader()
        dataSource = type("D", (), {"register": lambda self, x: None})()

    monkeypatch.setattr("histograin.sources.git.head", lambda repo: "later")
    S.follow(Session(), store, "repo", Config(), "checkpoint")
    taken[0](batch, 0)
    assert store.meta()["head_sha"] == "c2"
    taken[0](batch.limit(0), 1)
    assert store.meta()["head_sha"] == "c2"
