import random

import pytest

from histograin.functions import complexity as X
from histograin.functions.hashing import color_index, fnv1a32, fnv1a64, jitter
from histograin.operators import replay as R
from histograin.operators import tree as T

EVENTS = "ts bigint, sha string, author_id int, mechanical boolean, path string, change_type string, old_path string, added bigint, deleted bigint"


def random_events(seed, n=60):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        for p in rng.sample("abcdefg", rng.randint(1, 3)):
            kind = rng.choice("AMMDR")
            out.append((i // 2, f"s{i:03}", 1, False, p, kind, rng.choice("abcdefg") if kind == "R" else None, 1, 0))
    return out


def fold(rows):
    """Frames after each commit, and the touched counts."""
    shas = sorted({(r[0], r[1]) for r in rows})
    live, frames = {}, []
    for i, key in enumerate(shas):
        own = sorted((r for r in rows if (r[0], r[1]) == key), key=lambda r: (r[4], r[5], r[6] is None, r[6] or ""))
        for r in own:
            if r[5] == "D":
                live.pop(r[4], None)
            elif r[5] == "R" and r[6] is not None:
                churn = live.pop(r[6], (0, 0))[0]
                live[r[4]] = (churn + 1, i)
            else:
                live[r[4]] = (live.get(r[4], (0, 0))[0] + 1, i)
        frames.append((len(own), dict(live)))
    return frames


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_replay_like_a_fold(spark, seed):
    rows = random_events(seed)
    frames = fold(rows)
    indexed = R.numbered(spark.createDataFrame(rows, EVENTS).repartition(4))
    series = {r["index"]: (r.touched, r.alive) for r in R.alive_series(indexed).collect()}
    assert series == {i: (n, len(live)) for i, (n, live) in enumerate(frames)}
    for index in (None, 17):
        got = {r.path: (r.churn, r.last_touch) for r in R.replay(indexed, index).collect()}
        assert got == frames[-1 if index is None else index][1]


def test_frames_without_renames(spark):
    rows = [r for r in random_events(5) if r[5] != "R"]
    frames = fold(rows)
    indexed = R.numbered(spark.createDataFrame(rows, EVENTS))
    for i in (0, 9, len(frames) - 1):
        assert {r.path: (r.churn, r.last_touch) for r in R.frame_at(indexed, i).collect()} == frames[i][1]


def test_events_in_order(spark):
    rows = [(1, "s", 1, False, "b", "M", None, 1, 0), (1, "s", 1, False, "a", "R", "z", 1, 0), (1, "s", 1, False, "a", "R", None, 1, 0), (0, "t", 1, False, "c", "A", None, 1, 0)]
    own = R.nested(spark.createDataFrame(rows, EVENTS)).orderBy("ts").collect()
    assert [[(c.path, c.old_path) for c in r.changes] for r in own] == [[("c", None)], [("a", "z"), ("a", None), ("b", None)]]
    flat = spark.createDataFrame(rows, EVENTS)
    assert {r.path: r.born_ts for r in R.first_appearance(flat).collect()} == {"a": 1, "b": 1, "c": 0}
    index = R.numbered(flat).select("ts", "index").distinct()
    assert R.seek(index, 1).first()[0] == 1 and R.seek(index, 99).first()[0] == 1 and R.seek(index, 0).first()[0] == 0


def test_running_sum_over_stretches(spark):
    df = spark.range(100).selectExpr("id", "id % 7 - 3 as v")
    got = [r.s for r in R.running_sum(df, "id", "v", "s", 8).orderBy("id").collect()]
    assert got == [sum(i % 7 - 3 for i in range(k + 1)) for k in range(100)]


def test_rollup(spark):
    files = spark.createDataFrame([("a/b/x", 4, 1.0), ("a/y", 9, 0.0), ("z", 0, 5.0)], "path string, value bigint, color double")
    got = {r.dir: (r.files, r.raw, r.area, r.color) for r in T.rollup(files, color="color").collect()}
    assert got == {"": (3, 13, 5.0, 4 / 13), "a": (2, 13, 5.0, 4 / 13), "a/b": (1, 4, 2.0, 1.0)}
    nodes = {r.path: (r.parent, r.is_file, r.leaf_count) for r in T.nodes(files.selectExpr("path", "1L as born_ts")).collect()}
    assert nodes == {"a/b/x": ("a/b", True, 1), "a/y": ("a", True, 1), "z": ("", True, 1), "a": ("", False, 2), "a/b": ("a", False, 1)}


def test_treemap():
    areas, boxes = [50, 30, 20, 5, 5], T.treemap([50, 30, 20, 5, 5], 400, 300)
    for a, (x, y, w, h) in zip(areas, boxes, strict=True):
        assert w * h == pytest.approx(a * 400 * 300 / 110, abs=1e-6)
        assert -1e-9 <= x and -1e-9 <= y and x + w <= 400 + 1e-9 and y + h <= 300 + 1e-9
    assert T.treemap([], 1, 1) == [] and T.treemap([2, 2, 2], 9, 9) == T.treemap([2, 2, 2], 9, 9)


@pytest.mark.parametrize(
    ("path", "text", "value"),
    [
        ("m.rs", "fn m(k: u8) -> u8 { for j in 0..k { if j > 3 { return j } } match k { 0 | 1 => 0, 2..=9 => 1, _ => 2 } }", 6),
        ("m.rs", "impl Show for Q { fn g(&self) { let t = \"loop if\"; let q = '}'; /* while */ // match\n } }", 1),
        ("m.py", "class K:\n    def g(self, v):\n        while v:\n            if v > 2:\n                v -= 1\n            elif v < 0:\n                return\n        for _ in ():\n            pass\n", 5),
        ("m.go", "func g(k int) int { switch k { case 0, 1: return 0; case 2: for k > 0 { k-- } default: if k > 9 { k = 9 } }; return k }", 5),
        ("m.js", "const g = k => { while (k) { k = k > 4 ? k - 2 : k - 1 } switch (k) { case 0: break; default: throw k } }", 4),
        ("m.js", "const t = 'while (k)'; const re = /for(k)?j/; const u = t?.k ?? t; // if\n", 1),
        ("m.js", "do { if (k) k-- } while (k > 0)", 3),
        ("m.tsx", "const V = (p: { k?: number }) => { for (const j of p.k ? [1] : []) if (j) return null; return <b/> }", 4),
        ("m.rs", "struct Empty;", 1),
        ("list.md", "x\n   y\n      z\n   y\nx\n   y\n", 5),
        ("list.md", "x\n\n   y\n     \n", 1),
    ],
)
def test_complexity(path, text, value):
    assert X.file_complexity(path, text.encode())["value"] == value


def test_indentation_like_its_set_form():
    rng = random.Random(1)
    for _ in range(200):
        d = [rng.randint(0, 6) for _ in range(rng.randint(0, 25))]
        plain = sum(sum(d[j] < min(d[j + 1 : i + 1]) for j in range(i)) for i in range(len(d)))
        assert X.indentation("\n".join(" " * k + "x" for k in d)) == plain


def test_broken_files_are_judged():
    out = X.file_complexity("a.py", b"def f(:\n  if x\xff")
    assert out["backend"] == "lexer" and out["value"] == 2 and out["loc"] == 2
    assert X.file_complexity("a.rs", b"")["per_loc"] == 0


def test_hashes():
    assert fnv1a64("") == "cbf29ce484222325" and fnv1a32("") == 0x811C9DC5 and fnv1a32("a") == 0xE40C292C
    assert -1 <= jitter("x") <= 1 and 0 <= color_index("x", 7) < 7
