"""Metrics on small histories with known answers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from histograin import model
from histograin.functions import columns as C
from histograin.operators import history as H
from histograin.operators import metrics as M
from histograin.operators import ranking


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def make(spark, commits, mechanical=None):
    """commits: (sha, time, [(type, path[, old])])."""
    cs = [(s, 1, dt.datetime.fromisoformat(t)) for s, t, _ in commits]
    fs = [(s, c[1], c[2] if len(c) > 2 else None, 1, 0, c[0], f"{s}-{c[1]}") for s, _, own in commits for c in own]
    changes = frame(spark, fs, model.FILE_CHANGES)
    return H.with_mechanical(frame(spark, cs, "sha string, author_id int, committed_at timestamp"), changes, mechanical), changes


CHURN = [
    ("k1", "2018-03-05 10:00:00", [("A", "main.c"), ("A", "util.c"), ("A", "log.c")]),
    ("k2", "2020-01-10 00:00:00", [("M", "main.c")]),
    ("k3", "2020-11-01 00:00:00", [("R", "tools.c", "util.c")]),
    ("k4", "2020-12-08 23:59:59", [("M", "tools.c")]),
    ("k5", "2020-12-09 00:00:00", [("M", "tools.c")]),
    ("k6", "2020-12-20 00:00:00", [("M", "main.c"), ("M", "log.c")]),
    ("k7", "2021-01-05 00:00:00", [("M", "main.c"), *[("A", f"gen{i}.c") for i in range(6)]]),
    ("k8", "2021-01-08 00:00:00", [("D", "log.c")]),
]


def test_churn(spark):
    """Windows end at k8, to the second; k7 has too many files; tools.c was util.c."""
    commits, changes = make(spark, CHURN, 5)
    got = {r.path: (r.churn_total, r.churn_30d, r.churn_90d, r.churn_365d, r.is_alive) for r in M.churn(commits, changes, H.path_map(commits, changes)).collect()}
    assert got == {"main.c": (3, 1, 1, 2, True), "tools.c": (4, 1, 3, 3, True), "log.c": (3, 2, 2, 2, False)}
    commits, changes = make(spark, CHURN)
    assert "gen0.c" in {r.path for r in M.churn(commits, changes).collect()}


def test_churn_of_nothing(spark):
    commits, changes = make(spark, CHURN)
    assert M.churn(commits.limit(0), changes.limit(0)).count() == 0


def test_a_reused_name_lives(spark):
    commits, changes = make(spark, [("c1", "2020-01-01 00:00:00", [("A", "a.txt"), ("A", "c.txt")]), ("c2", "2020-01-01 00:00:00", [("D", "a.txt"), ("R", "a.txt", "c.txt")])])
    rows = H.history(commits, changes)
    for parts in (1, 2, 3, 7):
        assert {r.path for r in H.living_files(rows.repartition(parts)).collect()} >= {"a.txt"}
        alive = {r.path: r.is_alive for r in M.churn(commits, changes.repartition(parts)).collect()}
        assert alive["a.txt"]


@pytest.mark.parametrize(
    ("edges", "ends"),
    [
        ([("a", "b"), ("b", "c"), ("c", "d"), ("x", "d")], {"a": "d", "b": "d", "c": "d", "d": "d", "x": "d"}),
        ([("a", "b"), ("b", "a")], {"a": "b", "b": "a"}),
        ([("x", "a"), ("a", "b"), ("b", "a")], {"x": "b", "a": "b", "b": "a"}),
        ([("a", "a"), ("z", "a")], {"a": "a", "z": "a"}),
        ([(f"p{i:03}", f"p{i + 1:03}") for i in range(200)], {f"p{i:03}": "p200" for i in range(201)}),
    ],
)
def test_chain_ends(spark, edges, ends):
    assert {r.path: r.canonical for r in H.chain_ends(frame(spark, edges, "old string, new string")).collect()} == ends


def test_latest_rename_wins(spark):
    commits, changes = make(spark, [("c1", "2020-01-01 00:00:00", [("R", "b", "a")]), ("c2", "2020-01-02 00:00:00", [("R", "c", "a")]), ("c3", "2020-01-02 00:00:00", [("R", "d", "a")])])
    assert [(r.old, r.new) for r in H.rename_edges(commits, changes).collect()] == [("a", "d")]


def coupling_case(spark, mechanical=5):
    commits = [(f"m{i}", "2020-04-01 00:00:00", [("M", f"{x}.go") for x in own]) for i, own in enumerate(["pqr", "pq", "pq", "q", "qr", "p", "pq"])]
    commits.append(("wide", "2020-04-02 00:00:00", [("M", "p.go"), *[("M", f"w{i}.go") for i in range(6)]]))
    return make(spark, commits, mechanical)


@pytest.mark.parametrize("block", [1000, 2])
def test_coupling(spark, block):
    """p.go has 5 commits, q.go 6, r.go 2; with a block of two files, commits are dealt into row blocks."""
    commits, changes = coupling_case(spark)
    pairs = lambda **k: {(r.path_a, r.path_b): (r.support, r.coupling_ratio) for r in M.coupling(commits, changes, block=block, **k).collect()}
    assert pairs(min_support=1) == {("p.go", "q.go"): (4, 0.8), ("p.go", "r.go"): (1, 0.5), ("q.go", "r.go"): (2, 1.0)}
    assert set(pairs(min_support=2)) == {("p.go", "q.go"), ("q.go", "r.go")}
    every = pairs(min_support=1, exclude_mechanical=False)
    assert sum("w0.go" in k for k in every) == 6 and all(a < b and 0 < r <= 1 for (a, b), (_, r) in every.items())


def test_coupling_view_folds(spark):
    pairs = frame(spark, [("x/a/1", "y/b/2", 3, 0.5), ("x/a/3", "y/b/4", 2, 0.7), ("x/a/1", "x/a/3", 9, 1.0)], "path_a string, path_b string, support bigint, coupling_ratio double")
    assert [tuple(r) for r in M.coupling_view(pairs, depth=1).collect()] == [("x", "y", 5, 0.7)]


def test_knowledge(spark):
    hunks = frame(spark, [("p.go", False, "k1", 7), ("p.go", False, "k2", 3), ("q.go", False, "k1", 6), ("q.go", False, "k2", 6), ("bad.go", True, None, None), ("old.go", False, "gone", 9)], model.HUNKS)
    commits = frame(spark, [("k1", 1), ("k2", 2)], "sha string, author_id int")
    owned = M.ownership(hunks, commits)
    got = {r.path: (r.bus_factor, r.top_owner_ratio, r.total) for r in M.bus_factor(owned).collect()}
    assert got == {"p.go": (1, 0.7, 10), "q.go": (2, 0.5, 12), "old.go": (1, 1.0, 9)}
    assert {(r.path, r.author_id) for r in M.top_owner(owned).collect()} == {("p.go", 1), ("q.go", 1), ("old.go", -1)}
    assert M.failed_files(hunks).first().failed == 1
    sums = owned.groupBy("path").agg(F.sum("ownership_ratio").alias("s"), F.sum("lines").alias("n"), F.first("total").alias("t")).collect()
    assert all(abs(r.s - 1) < 1e-12 and r.n == r.t for r in sums)
    assert {r.author_id: r.label for r in M.anonymous_labels(owned).collect()} == {-1: "Author #1", 1: "Author #2", 2: "Author #3"}
    assert {r.author_id: r.label for r in M.anonymous_labels(owned, "commits").collect()} == {-1: "Author #?", 1: "Author #1", 2: "Author #2"}


@pytest.mark.parametrize(("shares", "factor"), [((40, 40, 20), 2), ((75, 25), 1), ((50, 50), 2), ((1,), 1)])
def test_bus_factor_is_strict(spark, shares, factor):
    owned = frame(spark, [("f", i, n, sum(shares), n / sum(shares)) for i, n in enumerate(shares)], "path string, author_id int, lines bigint, total bigint, ownership_ratio double")
    assert M.bus_factor(owned).first().bus_factor == factor


def test_age(spark):
    commits = frame(spark, [("k1", dt.datetime(2019, 5, 1)), ("k2", dt.datetime(2019, 5, 22))], "sha string, committed_at timestamp")
    hunks = frame(spark, [("p.go", False, "k1", 9), ("p.go", False, "k2", 2), ("q.go", False, "k2", 1), ("q.go", False, "gone", 5)], model.HUNKS)
    got = {r.path: (r.lines, r.newest_age_days, r.median_age_days, r.p90_age_days, r.oldest_age_days) for r in M.age(hunks, commits).collect()}
    assert got == {"p.go": (11, 0, 21, 21, 21), "q.go": (1, 0, 0, 0, 0)}
    ages = frame(spark, [("a", 29), ("b", 30), ("c", 2000)], "path string, median_age_days bigint")
    buckets = lambda inclusive: [r.files for r in M.age_histogram(ages, inclusive).orderBy("bucket").collect()]
    assert buckets(False) == [1, 1, 0, 0, 0, 1] and buckets(True) == [2, 0, 0, 0, 0, 1]
    assert M.median_of_medians(ages).first()[0] == 30 and M.median_of_medians(ages.limit(0)).count() == 0
    assert [(r.bucket, r.path) for r in M.age_members(ages.union(frame(spark, [("A", 30)], ages.schema))).orderBy("n").collect()] == [(0, "a"), (0, "A"), (0, "b"), (5, "c")]
    assert tuple(M.maxima(ages.where("path = 'a'"), "median_age_days").first()) == (29,) and tuple(M.maxima(ages.limit(0), "median_age_days").first()) == (1,)


def test_search_ignores_case_and_white_space(spark):
    files = frame(spark, [("src/Tree.rs",), ("src/leaf.rs",), ("docs/TREES.md",)], "path string")
    found = lambda text: sorted(r.path for r in M.search(files, text).collect())
    assert found("  tree ") == ["docs/TREES.md", "src/Tree.rs"] and len(found("  ")) == 3 and found("oak") == []


def test_files_of_either_metric(spark):
    churn = frame(spark, [("both.c", 3, True), ("only_churn.c", 1, False)], "path string, churn_total bigint, is_alive boolean")
    cx = frame(spark, [("both.c", 5.0, 0.5), ("only_cx.c", 2.0, 1.0)], "path string, complexity double, complexity_per_loc double")
    ranked = frame(spark, [("both.c", 1)], "path string, rank bigint")
    got = {r.path: tuple(r)[1:] for r in M.file_metrics(churn, cx, ranked).collect()}
    assert got == {"both.c": (3, True, 5.0, 0.5, 1), "only_churn.c": (1, False, None, None, None), "only_cx.c": (None, None, 2.0, 1.0, None)}


def test_hotspots(spark):
    cxs = "path string, complexity double, method string"
    churn = frame(spark, [("parse.go", 31, 2, True), ("emit.go", 4, 4, True), ("plan.go", 17, 9, True), ("util.go", 2, 1, True), ("gone.go", 64, 64, False)], "path string, churn_total bigint, churn_90d bigint, is_alive boolean")
    cx = frame(spark, [("parse.go", 6.0, "cyclomatic"), ("emit.go", 28.0, "cyclomatic"), ("plan.go", 17.0, "cyclomatic"), ("util.go", 1.0, "cyclomatic"), ("readme.md", 70.0, "indentation")], cxs)
    got = {r.path: (r["rank"], r.churn_pct, r.complexity_pct, r.score) for r in M.hotspots(churn, cx).collect()}
    third = pytest.approx(1 / 3)
    assert got["plan.go"] == (1, pytest.approx(2 / 3), pytest.approx(2 / 3), pytest.approx(4 / 9)) and got["util.go"] == (4, 0.0, 0.0, 0.0)
    assert got["emit.go"] == (2, third, 1.0, third) and got["parse.go"] == (3, 1.0, third, third) and len(got) == 4
    recent = [r.path for r in M.hotspots(churn, cx, "90").orderBy("rank").collect()]
    assert recent == ["emit.go", "plan.go", "parse.go", "util.go"]  # by the window's churn: 2/3, 2/3, 1/9, 0
    dead = M.hotspots(churn, frame(spark, [("gone.go", 5.0, "cyclomatic")], cxs)).first()
    assert (dead.churn, dead.churn_pct, dead["rank"]) == (0, 1.0, 1)
    ties = M.hotspots(churn.limit(0), frame(spark, [(p, 1.0, "cyclomatic") for p in "zxy"], cxs))
    assert [r.path for r in ties.orderBy("rank").collect()] == ["z", "y", "x"]
    assert M.hotspots(churn, cx.limit(0)).count() == 0


def test_global_rank_over_ranges(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 611).alias("v"), F.col("id").alias("k"))
    got = ranking.global_rank(df, [F.col("v"), F.col("k")]).orderBy("rank").collect()
    rows = sorted((i * 7919 % 611, i) for i in range(5000))
    assert [(r.v, r.k) for r in got] == rows and [r["rank"] for r in got] == list(range(1, 5001))


def test_blame_plan(spark):
    living = frame(spark, [("f.rs", "s2", 2, 3), ("g.rs", "s1", 1, 1), ("big", "s", 1 << 62, 1 << 62)], "path string, last_sha string, revisions bigint, total_added bigint")
    plan = {r.path: (r.cost, r.over_budget) for r in M.blame_plan(living, 1).collect()}
    assert plan == {"f.rs": (6, True), "g.rs": (1, False), "big": ((1 << 63) - 1, True)}
    assert not any(r.over_budget for r in M.blame_plan(living, 0).collect())
    order = M.blame_misses(M.blame_plan(living.limit(2), 100), living.limit(0).select("path", "last_sha", "revisions"))
    assert [r.path for r in order.collect()] == ["f.rs", "g.rs"]
    assert [r.path for r in M.valid_cache(living.withColumn("revisions", F.col("revisions") + (F.col("path") == "f.rs").cast("int")), living).orderBy("path").collect()] == ["big", "g.rs"]


def test_scalar_functions(spark):
    one = lambda *c: tuple(spark.range(1).select(*c).first())
    lit = F.lit
    assert one(C.percent_text(lit(0.125)), C.percent_text(lit(1.0)), C.two_decimals(lit(2.345))) == ("13%", "100%", "2.35")
    assert one(C.shorten(lit("abcdefgh"), 4), C.shorten(lit("abcdefgh"), 4, "tail"), C.shorten(lit("abc"), 4)) == ("abc…", "…fgh", "abc")
    assert one(C.escape_html(lit("<a href=\"x\">'&'</a>"))) == ("&lt;a href=&quot;x&quot;&gt;&#39;&amp;&#39;&lt;/a&gt;",)
    assert one(*[C.language(lit(p)) for p in ("src/lib.rs", "a/b.py", "main.go", "app.js", "app.ts", "ui.tsx", "data.json", "Makefile", "dir.rs/file", "X.RS")]) == ("rust", "python", "go", "js", "ts", "tsx", None, None, None, None)
    assert one(C.is_binary(lit(b"ab\0c")), C.is_binary(lit(b"abc")), C.is_binary(lit(b"a" * 8000 + b"\0"))) == (True, False, False)
    assert one(C.per_loc(lit(3), lit(0)), C.per_loc(lit(3), lit(2))) == (0.0, 1.5)
    assert one(C.recency(lit(0), lit(0)), C.recency(lit(9), lit(9)), C.recency(lit(9), lit(0)), C.recency(lit(9), lit(-5))) == (1.0, 1.0, pytest.approx(0.1), 0.0)
    assert one(C.risk_color(lit(1.0)), C.risk_color(lit(4.0)), C.risk_color(lit(9.0))) == (1.0, 0.0, 0.0)
    assert one(C.display_name(lit(""), lit("e@x")), C.display_name(lit("N"), lit("e@x")), C.top_directory(lit("a/b/c")), C.top_directory(lit("a"))) == ("e@x", "N", "a", "")
    assert one(C.lines_of_code(lit("a\n \t\n\u2003\n b\r\n"))) == (2,)


@pytest.mark.parametrize(("glob", "hits", "misses"), [("*.txt", ["a.txt", "d/a.txt"], ["a.txt.rs"]), ("docs/**", ["docs/a/b"], ["adocs/a"]), ("**/x.rs", ["x.rs", "a/b/x.rs"], ["xx.rs"]), ("a?.[ch]", ["ab.c", "ab.h"], ["ab.o"]), ("{a,b}*.md", ["a1.md", "b.md"], ["c.md"])])
def test_globs(spark, glob, hits, misses):
    changes = frame(spark, [(p,) for p in hits + misses], "path string")
    assert {r.path for r in H.excluded(changes, [glob]).collect()} == set(misses)


def test_config_hash():
    assert model.Config().hash() == "f283ba95ccc573f7"
    assert model.Config(exclude=("a", "b")).hash() == model.Config(exclude=("b", "a")).hash() != model.Config(exclude=("a",)).hash()
    assert model.Config(path="x", incremental=False).hash() == model.Config().hash() != model.Config(mechanical_max_files=5).hash()
    with pytest.raises(model.ConfigError):
        model.Config(mechanical_max_files=-1)
