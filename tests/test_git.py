"""A real repository, end to end."""

import json
import os
import shutil
import subprocess

import pytest
from pyspark.sql import functions as F

from histograin import cli
from histograin.model import Config, MetricConfig, SourceError
from histograin.operators import history as H
from histograin.plans import export as E
from histograin.plans.materialize import materialize, overview
from histograin.plans.store import Store, analyze
from histograin.session import prepare
from histograin.sources import document, git
from histograin.streaming.ingest import follow

pytestmark = pytest.mark.skipif(not shutil.which("git"), reason="git isn't installed")


class Repo:
    def __init__(self, path):
        self.path = str(path)
        os.makedirs(self.path, exist_ok=True)
        self.git("init", "-q", "-b", "main")

    def git(self, *args, when="2021-06-01T00:00:00 +0000", who="Alice"):
        own = {f"GIT_{r}_{k}": v for r in ("AUTHOR", "COMMITTER") for k, v in (("NAME", who), ("EMAIL", f"{who}@X.org"), ("DATE", when))}
        return subprocess.run(["git", "-C", self.path, *args], check=True, capture_output=True, env=os.environ | own).stdout.decode()

    def commit(self, files=None, remove=(), move=(), **k):
        for name, text in (files or {}).items():
            os.makedirs(os.path.dirname(f"{self.path}/{name}") or self.path, exist_ok=True)
            with open(f"{self.path}/{name}", "wb") as f:
                f.write(text if isinstance(text, bytes) else text.encode())
        for name in remove:
            self.git("rm", "-q", name)
        for a, b in move:
            self.git("mv", a, b)
        self.git("add", "-A")
        self.git("commit", "-q", "--allow-empty", "-m", "x", **k)
        return self.git("rev-parse", "HEAD").strip()


@pytest.fixture
def repo(tmp_path):
    return Repo(tmp_path / "repo")


def dump(store):
    return {t: sorted(map(str, store.read(t).collect())) for t in ("authors", "commits", "file_changes")}


def test_history(spark, repo):
    prepare(spark)
    one = repo.commit({"a.txt": "1\n2\n", "bin": b"\0\1", "d/x y.txt": "q\n"})
    two = repo.commit({"a.txt": "1\n2\n3\n", "b.txt": "line one\nline two\nline three\n"}, when="2021-06-02T00:00:00 +0000", who="Bob")
    three = repo.commit(remove=["bin"], move=[("b.txt", "c.txt")], when="2021-06-03T00:00:00 +0000")
    rows = git.read_history(spark, repo.path, partition_commits="1").orderBy("walk_index").collect()
    assert [r.sha for r in rows] == [three, two, one] and rows[1].author.email == "Bob@X.org" and rows[0].parent_shas == [two]
    flat = lambda r: sorted((c.path, c.old_path, c.added, c.deleted, c.change_type) for c in r.file_changes)
    assert flat(rows[2]) == [("a.txt", None, 2, 0, "A"), ("bin", None, 0, 0, "A"), ("d/x y.txt", None, 1, 0, "A")]
    assert flat(rows[1]) == [("a.txt", None, 1, 0, "M"), ("b.txt", None, 3, 0, "A")]
    assert flat(rows[0]) == [("bin", None, 0, 0, "D"), ("c.txt", "b.txt", 0, 0, "R")]
    assert [r.sha for r in git.read_history(spark, repo.path, hidden=two).collect()] == [three]
    assert git.discover(f"{repo.path}/d") == os.path.realpath(repo.path)
    files = spark.createDataFrame([("a.txt", "s", 1), ("c.txt", "s", 1), ("b.txt", "s", 1)], "path string, last_sha string, revisions bigint")
    hunks = {(r.path, r.commit_sha): (r.lines, r.failed) for r in git.blame(files, repo.path, three).collect()}
    assert hunks == {("a.txt", one): (2, False), ("a.txt", two): (1, False), ("c.txt", three): (3, False), ("b.txt", None): (None, False)}
    assert git.blame_file(repo.path, "a.txt", "0" * 40) is None
    with pytest.raises(SourceError):
        git.discover("/")


def test_unborn_head(spark, repo, tmp_path):
    assert git.head(repo.path) is None and git.read_history(spark, repo.path).count() == 0
    store = Store(spark, f"file://{tmp_path}/db")
    assert analyze(store, repo.path, Config()) == 0 and store.read("commits").count() == 0


def test_ingest_twice_and_more(spark, repo, tmp_path):
    prepare(spark)
    repo.commit({"a.txt": "1\n2\n"})
    repo.commit({"a.txt": "1\n2\n3\n", "b.txt": "1\n"}, when="2021-06-02T00:00:00 +0000")
    repo.commit(move=[("b.txt", "c.txt")], when="2021-06-03T00:00:00 +0000")
    store = Store(spark, f"file://{tmp_path}/db")
    assert analyze(store, repo.path, Config()) == 3
    first = dump(store)
    assert len(first["file_changes"]) == 4 and len(first["authors"]) == 1
    assert analyze(store, repo.path, Config()) == 0 and dump(store) == first
    other = Store(spark, f"file://{tmp_path}/other")
    analyze(other, repo.path, Config())
    assert dump(other) == first
    repo.commit({"d.txt": "x\n"}, when="2021-06-04T00:00:00 +0000", who="Bob")
    assert analyze(store, repo.path, Config()) == 1 and store.read("authors").count() == 2
    assert analyze(store, repo.path, Config(exclude=("*.txt",))) == 4 and store.read("file_changes").count() == 0
    assert analyze(store, repo.path, Config(exclude=("*.txt",), incremental=False)) == 4


def test_stream_follows_head(spark, repo, tmp_path):
    prepare(spark)
    repo.commit({"a.txt": "1\n"})
    store = Store(spark, f"file://{tmp_path}/db")
    for n, more in ((1, "2\n"), (2, "3\n")):
        follow(spark, store, repo.path, Config(), f"{tmp_path}/checkpoint").awaitTermination()
        assert store.read("commits").count() == n
        repo.commit({"a.txt": more}, when=f"2021-06-0{n + 1}T00:00:00 +0000")


@pytest.fixture
def exported(spark, repo, tmp_path):
    prepare(spark)
    for i in range(6):
        repo.commit({"a.rs": f"fn a() {{ if x{i} {{ if y {{}} }} }}\n", "b.rs": f"fn b() {{ if z{i} {{}} }}\n"})
    repo.commit(move=[("b.rs", "c.rs")])
    store = Store(spark, f"file://{tmp_path}/db")
    analyze(store, repo.path, Config())
    return store, repo, lambda: materialize(store, lambda df: git.blobs(df, repo.path), lambda df: git.blame(df, repo.path, git.head(repo.path)), MetricConfig())


def test_export(spark, exported, tmp_path):
    store, repo, run = exported
    counts = run()
    assert counts == {"file_metrics": 2, "coupling": 1, "knowledge": 2, "module_bus_factor": 2, "file_age": 2, "blame_skips": 0}
    cached = store.read("complexity_cache").count(), store.read("blame_cache").count()
    out = [f"{tmp_path}/{k}.json" for k in "ab"]
    E.export_json(store, out[0])
    assert run() == counts and (store.read("complexity_cache").count(), store.read("blame_cache").count()) == cached
    E.export_json(store, out[1])
    assert open(out[0], "rb").read() == open(out[1], "rb").read()
    doc = json.load(open(out[0]))
    files = {f["path"]: f for f in doc["files"]}
    assert [files["a.rs"][k] for k in ("churn_total", "churn_30d", "churn_90d", "churn_365d", "complexity", "complexity_per_loc", "hotspot_rank", "is_alive")] == [6, 6, 6, 6, 3.0, 3.0, 1, True]
    assert [files["c.rs"][k] for k in ("churn_total", "complexity", "hotspot_rank")] == [7, 2.0, 2]
    assert doc["coupling"] == [{"a": "a.rs", "b": "c.rs", "support": 6, "ratio": 1.0}]
    assert doc["knowledge"] == [{"path": p, "bus_factor": 1, "top_owner": "Author #1", "top_owner_ratio": 1.0} for p in ("a.rs", "c.rs")]
    assert doc["file_age"][0] == {"path": "a.rs", "lines": 1, "newest_age_days": 0, "median_age_days": 0, "p90_age_days": 0, "oldest_age_days": 0}
    events = doc["events"]
    assert len(events) == 7 and [e["sha"] for e in events] == sorted(e["sha"] for e in events)
    moved = [c for e in events for c in e["changes"] if c["type"] == "R"]
    assert moved == [{"path": "c.rs", "type": "R", "old_path": "b.rs", "added": 0, "deleted": 0}]
    meta = doc["meta"]
    assert (meta["schema_version"], meta["anonymized"], meta["config_hash"], meta["total_commits"], meta["total_authors"], meta["anchor_ts"]) == (1, True, "f283ba95ccc573f7", 7, 1, 1622505600)
    assert "Alice" not in open(out[0]).read()
    read = document.read_document(spark, out[0])
    assert document.part(read, "coupling").first().support == 6
    with open(f"{tmp_path}/bad.json", "w") as f:
        json.dump({"meta": {"schema_version": 2}}, f)
    with pytest.raises(SourceError):
        document.read_document(spark, f"{tmp_path}/bad.json")
    E.export_json(store, out[1], names=True)
    assert json.load(open(out[1]))["events"][0]["author"] == "Alice"
    E.export_parquet(store, f"file://{tmp_path}/parquet")
    assert spark.read.parquet(f"file://{tmp_path}/parquet/files").count() == 2
    assert overview(store).first().asDict() == {"commits": 7, "files": 2, "ranked_files": 2, "pairs": 1, "single_owner": 2, "authors": 1}
    page = E.render_html(store)
    assert "c.rs" in page and "Alice" not in page and "<script" not in page and "http" not in page
    assert E.text_table(store.read("coupling").select("path_a", "support")).splitlines() == ["path_a  support", "a.rs    6"]


def test_only_changed_files_are_blamed_again(spark, exported):
    store, repo, run = exported
    run()
    before = {(r.path, r.last_sha) for r in store.read("blame_cache").collect()}
    repo.commit({"a.rs": "fn a() {}\n"}, when="2021-07-01T00:00:00 +0000", who="Bob")
    analyze(store, repo.path, Config())
    run()
    after = {(r.path, r.last_sha) for r in store.read("blame_cache").collect()}
    assert {p for p, _ in after - before} == {"a.rs"} and {x for x in before if x[0] == "c.rs"} <= after


def test_over_budget_is_a_row(spark, exported):
    store, repo, _ = exported
    counts = materialize(store, lambda df: git.blobs(df, repo.path), lambda df: git.blame(df, repo.path, git.head(repo.path)), MetricConfig(blame_budget=1))
    assert counts["blame_skips"] == 2 and counts["file_age"] == 0
    assert {(r.reason, r.budget) for r in store.read("blame_skips").collect()} == {("over_budget", 1)}


def test_dead_files_have_no_complexity(spark, repo, tmp_path):
    prepare(spark)
    repo.commit({"shapes/area.go": "func area(k int) int { for i := 0; i < k; i++ { if odd(i) { k-- } }; return k }\n", "todo.md": "- one\n    - two\n"})
    repo.commit(move=[("shapes/area.go", "shapes/size.go")], remove=["todo.md"], when="2021-06-02T00:00:00 +0000")
    store = Store(spark, f"file://{tmp_path}/db")
    analyze(store, repo.path, Config())
    materialize(store, lambda df: git.blobs(df, repo.path), lambda df: git.blame(df, repo.path, git.head(repo.path)))
    got = {r.path: (r.complexity, r.is_alive) for r in store.read("file_metrics").collect()}
    assert got == {"shapes/size.go": (3.0, True), "todo.md": (None, False)}


def test_blobs_come_in_bounded_frames(spark, repo, monkeypatch):
    prepare(spark)
    monkeypatch.setattr(git, "BLOB_BYTES", 10)
    repo.commit({f"f{i}": bytes([i]) * i for i in range(12)})
    wanted = [(s, f"f{i}") for i, s in enumerate(repo.git("rev-parse", *[f"HEAD:f{i}" for i in range(12)]).split())] + [("0" * 40, "none")]
    got = {r.path: r.content for r in git.blobs(spark.createDataFrame(wanted, "blob_sha string, path string"), repo.path).collect()}
    assert got == {"none": None, **{f"f{i}": bytes([i]) * i for i in range(12)}}


def test_command_line(spark, exported, capsys, tmp_path, monkeypatch):
    _, repo, _ = exported
    for argv in (["analyze", repo.path], ["coupling", repo.path, "--min-support", "2"], ["hotspots", repo.path, "--top", "1"], ["knowledge", repo.path], ["age", repo.path], ["export", repo.path, "--out", f"{tmp_path}/e.json"], ["report", repo.path, "--out", f"{tmp_path}/r.html"]):
        assert cli.main([*argv, "--db", f"file://{tmp_path}/cli"]) == 0
        out = capsys.readouterr().out
        assert {"analyze": "7", "coupling": "a.rs", "hotspots": "a.rs", "knowledge": "Author #1", "age": "a.rs"}.get(argv[0], "written") in out
    assert cli.main(["age", str(tmp_path), "--db", f"file://{tmp_path}/none"]) == 1
    capsys.readouterr()
    db = ["--db", f"file://{tmp_path}/cli"]
    monkeypatch.chdir(repo.path)
    assert cli.main(["sql", "SELECT count(*) AS n, max(files_changed) AS most FROM commits", *db]) == 0
    assert capsys.readouterr().out.split() == ["n", "most", "7", "2"]
    assert cli.main(["knowledge", repo.path, "--show-names", *db]) == 0 and "Alice" in capsys.readouterr().out
    assert cli.main(["analyze", repo.path, "--no-incremental", *db]) == 0 and "7 new commits, 7 in all" in capsys.readouterr().out
    assert cli.main(["export", repo.path, "--show-names", "--out", f"{tmp_path}/named.json", *db]) == 0 and "Alice" in open(f"{tmp_path}/named.json").read()


def test_authors_merge_by_mailmap(spark, repo, tmp_path):
    prepare(spark)
    repo.commit({"a.txt": "1\n"}, who="Alice")
    repo.commit({"a.txt": "1\n2\n", ".mailmap": "Alice <Alice@X.org> <Alice2@X.org>\n"}, who="Alice2", when="2021-06-02T00:00:00 +0000")
    store = Store(spark, f"file://{tmp_path}/db")
    analyze(store, repo.path, Config())
    assert [(r.canonical_name, r.canonical_email) for r in store.read("authors").collect()] == [("Alice", "alice@x.org")]
    assert H.living_files(H.history(store.read("commits"), store.read("file_changes"))).where(F.col("path") == "a.txt").first().revisions == 2
