"""One query for each operator family, over business tables read as a history, and the same in SQL.

Keys stay whole numbers where only identity and order matter; ratios are doubles made by one division on both sides.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as C
from .functions import complexity as X
from .operators import history as H
from .operators import metrics as M
from .operators import replay as R
from .operators import tree as T
from .operators.ranking import global_rank
from .plans import export as E
from .session import cut, shared_dir
from .sources import analog as A
from .sources.document import SCHEMA_VERSION
from .streaming import ingest as S

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Named parts that the SQL of several queries begins with.
_PARTS = {
    "cm": f"""cm AS (SELECT o_orderkey AS sha, o_custkey AS author_id, CAST(epoch(o_orderdate) AS BIGINT) AS ts, coalesce(n, 0) AS files_changed, coalesce(n, 0) > {A.MECHANICAL} AS is_mechanical
      FROM orders LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey)""",
    "ch": """ch AS (SELECT l_orderkey AS sha, l_partkey AS path, CAST(l_quantity AS BIGINT) AS added, CAST(round(l_discount * 100) AS BIGINT) AS deleted,
      CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'D' WHEN l_returnflag = 'A' THEN 'A' ELSE 'M' END AS change_type, l_suppkey AS supp,
      lpad(CAST(l_suppkey AS VARCHAR), 10, '0') || '/' || strftime(l_shipdate, '%Y-%m-%d') AS tie FROM lineitem)""",
    "kept": "kept AS (SELECT ch.*, cm.ts FROM ch JOIN cm USING (sha) WHERE NOT is_mechanical)",
    "al": "al AS (SELECT ch.*, cm.ts FROM ch JOIN cm USING (sha))",
    "last": """last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, sha DESC, CASE WHEN change_type = 'D' THEN 1 ELSE 0 END, change_type, tie) AS rn FROM al) WHERE rn = 1)""",
    "live": """live AS (SELECT path, last.sha AS last_sha, revisions, total_added FROM last JOIN (SELECT path, count(*) AS revisions, CAST(sum(added) AS BIGINT) AS total_added FROM al GROUP BY path) USING (path) WHERE change_type <> 'D')""",
    "own": """own AS (SELECT *, lines / CAST(total AS DOUBLE) AS ratio FROM (SELECT l_partkey AS path, CAST(c_nationkey AS BIGINT) AS author_id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS lines, CAST(sum(sum(CAST(l_quantity AS BIGINT))) OVER (PARTITION BY l_partkey) AS BIGINT) AS total
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY l_partkey, c_nationkey))""",
    "bf": """bf AS (SELECT path, coalesce(min(CASE WHEN cum > 0.5 * total THEN rn END), max(rn)) AS bus_factor, max(ratio) AS top_owner_ratio, count(*) AS owners, max(total) AS total
      FROM (SELECT *, row_number() OVER w AS rn, CAST(sum(lines) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum FROM own WINDOW w AS (PARTITION BY path ORDER BY lines DESC, author_id)) GROUP BY path)""",
    "age": """aged AS (SELECT l_partkey AS path, greatest((SELECT max(ts) FROM cm) - ts, 0) // 86400 AS age, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS lines FROM lineitem JOIN cm ON cm.sha = l_orderkey GROUP BY 1, 2),
      age AS (SELECT path, CAST(max(total) AS BIGINT) AS lines, min(age) AS newest_age_days, min(CASE WHEN cum >= greatest(ceil(0.5 * total), 1) THEN age END) AS median_age_days,
        min(CASE WHEN cum >= greatest(ceil(0.9 * total), 1) THEN age END) AS p90_age_days, max(age) AS oldest_age_days
        FROM (SELECT *, sum(lines) OVER (PARTITION BY path ORDER BY age ROWS UNBOUNDED PRECEDING) AS cum, sum(lines) OVER (PARTITION BY path) AS total FROM aged) GROUP BY path)""",
    "churn": """churn AS (SELECT path, count(*) AS churn_total, count(CASE WHEN ts >= (SELECT max(ts) FROM cm) - 30 * 86400 THEN 1 END) AS churn_30d, count(CASE WHEN ts >= (SELECT max(ts) FROM cm) - 90 * 86400 THEN 1 END) AS churn_90d,
        count(CASE WHEN ts >= (SELECT max(ts) FROM cm) - 365 * 86400 THEN 1 END) AS churn_365d, CAST(sum(a) AS BIGINT) AS lines_added, CAST(sum(d) AS BIGINT) AS lines_deleted, arg_max(live, ts * 100000000 + sha) AS is_alive
      FROM (SELECT path, sha, ts, sum(added) AS a, sum(deleted) AS d, bool_or(change_type <> 'D') AS live FROM kept GROUP BY path, sha, ts) GROUP BY path)""",
    "cx": """cx AS (SELECT p_partkey AS path, CAST(p_size AS DOUBLE) AS complexity, CASE WHEN p_size % 8 < 6 THEN 'cyclomatic' ELSE 'indentation' END AS method FROM part)""",
    "hot": """hot0 AS (SELECT cx.path, complexity, coalesce(churn_total, 0) AS churn FROM cx LEFT JOIN (SELECT path, churn_total FROM churn WHERE is_alive) USING (path) WHERE method = 'cyclomatic'),
      hot1 AS (SELECT *, (row_number() OVER (ORDER BY churn, path) - 1) / CAST((SELECT count(*) - 1 FROM hot0) AS DOUBLE) AS churn_pct, (row_number() OVER (ORDER BY complexity, path) - 1) / CAST((SELECT count(*) - 1 FROM hot0) AS DOUBLE) AS complexity_pct FROM hot0),
      hot AS (SELECT *, churn_pct * complexity_pct AS score, row_number() OVER (ORDER BY churn_pct * complexity_pct DESC, path) AS rank FROM hot1)""",
    "edges": """pl AS (SELECT p_partkey, p_size, lead(p_partkey, 1) OVER w AS one, lead(p_partkey, 2) OVER w AS two FROM part WINDOW w AS (PARTITION BY p_brand, p_type ORDER BY p_partkey)),
      timed AS (SELECT p_partkey AS old, one AS new, p_size AS ts FROM pl WHERE p_partkey % 3 = 0 AND one IS NOT NULL UNION ALL SELECT p_partkey, two, p_size * 7 % 50 FROM pl WHERE p_partkey % 6 = 0 AND two IS NOT NULL),
      edges AS (SELECT old, new FROM (SELECT *, row_number() OVER (PARTITION BY old ORDER BY ts DESC, new DESC) AS rn FROM timed) WHERE rn = 1)""",
    "canon": """nodes AS (SELECT old AS path FROM edges UNION SELECT new FROM edges), steps AS (SELECT path, path AS here, 0 AS n FROM nodes UNION ALL SELECT s.path, e.new, s.n + 1 FROM steps s JOIN edges e ON e.old = s.here),
      canon AS (SELECT path, arg_max(here, n) AS canonical FROM steps GROUP BY path)""",
    "tree": """ext AS (SELECT ['.rs', '.py', '.go', '.js', '.ts', '.tsx', '.md', ''] AS e),
      files AS (SELECT p_partkey AS part, 'src/' || p_brand || '/' || p_type || '/p' || p_partkey || e[p_size % 8 + 1] AS path, CAST(p_size AS BIGINT) AS value, CAST(floor(p_retailprice) AS BIGINT) AS color FROM part, ext),
      pre AS (SELECT files.*, depth, array_to_string(list_slice(string_split(path, '/'), 1, depth), '/') AS dir FROM (SELECT *, unnest(range(0, len(string_split(path, '/')))) AS depth FROM files) files)""",
    "ev": f"""ev AS (SELECT *, CASE WHEN change_type = 'R' THEN CAST((CAST(path AS INTEGER) + {A.RENAME_FROM}) % {A.PATHS} AS VARCHAR) END AS old_path FROM (
        SELECT epoch_us(ts) AS ts, event_id AS sha, user_id AS author_id, json_extract_string(props, '$.k') AS path,
          CASE WHEN event_type = 'signup' THEN 'A' WHEN event_type = 'error' THEN 'D' WHEN event_type = 'purchase' AND event_id % {A.RENAME_EVERY} = 0 THEN 'R' ELSE 'M' END AS change_type FROM events)),
      ix AS (SELECT *, row_number() OVER (ORDER BY ts, sha) - 1 AS index FROM ev)""",
    "ops": """ops AS (SELECT index, 0 AS k, old_path AS path, 0 AS present, true AS moved FROM ix WHERE change_type = 'R'
      UNION ALL SELECT index, 1, path, CASE WHEN change_type = 'D' THEN 0 ELSE 1 END, change_type = 'R' FROM ix)""",
}


def _sql(parts: str, body: str) -> str:
    own = parts.split()
    return f"WITH {'RECURSIVE ' if {'canon', 'back'} & {p.split('_')[0] for p in own} else ''}{', '.join(_PARTS[p] for p in own)}\n{body}" if own else body


def query(name: str, parts: str = "", sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = _sql(parts, sql)
        return f

    return add


def _kept(spark: SparkSession, d: str) -> DataFrame:
    return M.churn(A.commits(spark, d), A.changes(spark, d))


def _history(spark: SparkSession, d: str) -> DataFrame:
    return H.history(A.commits(spark, d), A.changes(spark, d))


@query("churn_total", "cm ch kept churn", "SELECT path, churn_total FROM churn")
def churn_total(spark, d):
    return _kept(spark, d).select("path", "churn_total")


@query("churn_windows", "cm ch kept churn", "SELECT path, churn_30d, churn_90d, churn_365d FROM churn")
def churn_windows(spark, d):
    return _kept(spark, d).select("path", "churn_30d", "churn_90d", "churn_365d")


@query("churn_lines", "cm ch kept churn", "SELECT path, lines_added, lines_deleted FROM churn")
def churn_lines(spark, d):
    return _kept(spark, d).select("path", "lines_added", "lines_deleted")


@query("churn_mechanical_excluded", "cm ch kept churn", "SELECT path, churn_total AS kept, n AS all_commits, is_alive FROM churn JOIN (SELECT path, count(DISTINCT sha) AS n FROM ch GROUP BY path) USING (path)")
def churn_mechanical_excluded(spark, d):
    every = M.churn(A.commits(spark, d), A.changes(spark, d), exclude_mechanical=False).select("path", F.col("churn_total").alias("all_commits"))
    return _kept(spark, d).join(every, "path").select("path", F.col("churn_total").alias("kept"), "all_commits", "is_alive")


@query("latest_change_alive", "cm ch al last", "SELECT path, sha, change_type, change_type <> 'D' AS is_alive FROM last")
def latest_change_alive(spark, d):
    return H.latest(_history(spark, d)).select("path", "sha", "change_type", (F.col("change_type") != "D").alias("is_alive"))


@query("living_files_meta", "cm ch al last live", "SELECT * FROM live")
def living_files_meta(spark, d):
    return H.living_files(_history(spark, d)).select("path", "last_sha", "revisions", "total_added")


@query("head_blobs", "cm ch al last", "SELECT path, 'b' || sha || '-' || path AS blob_sha FROM last WHERE change_type <> 'D'")
def head_blobs(spark, d):
    return H.living_files(_history(spark, d)).select("path", "blob_sha")


@query("rename_edges_latest", "edges", "SELECT old, new FROM edges")
def rename_edges_latest(spark, d):
    return H.latest_edges(A.renames(spark, d))


@query("canonical_paths", "edges canon", "SELECT path, canonical FROM canon")
def canonical_paths(spark, d):
    return H.chain_ends(H.latest_edges(A.renames(spark, d)))


@query("churn_canonical", "cm ch edges canon", "SELECT coalesce(canonical, ch.path) AS path, count(DISTINCT sha) AS churn_total FROM ch JOIN cm USING (sha) LEFT JOIN canon ON canon.path = ch.path WHERE NOT is_mechanical GROUP BY 1")
def churn_canonical(spark, d):
    paths = H.chain_ends(H.latest_edges(A.renames(spark, d)))
    return M.churn(A.commits(spark, d), A.changes(spark, d), paths).select("path", "churn_total")


@query("mechanical_flags", "cm", "SELECT sha, files_changed, is_mechanical FROM cm")
def mechanical_flags(spark, d):
    bare = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("sha"))
    return H.with_mechanical(bare, A.changes(spark, d).select("sha", "path").distinct(), A.MECHANICAL)


_PAIRS = """x AS (SELECT DISTINCT path, sha FROM kept), n AS (SELECT path, count(*) AS n FROM x GROUP BY path),
 s AS (SELECT a.path AS path_a, b.path AS path_b, count(*) AS support FROM x a JOIN x b ON a.sha = b.sha AND a.path < b.path GROUP BY ALL HAVING count(*) >= {0}),
 pairs AS (SELECT path_a, path_b, support, support / CAST(least(na.n, nb.n) AS DOUBLE) AS coupling_ratio FROM s JOIN n na ON na.path = path_a JOIN n nb ON nb.path = path_b)"""
_PARTS["pairs"] = _PAIRS.format(2)
_PARTS["kept_supp"] = "kept AS (SELECT ch.sha, supp AS path FROM ch JOIN cm USING (sha) WHERE NOT is_mechanical)"
_PARTS["pairs30"] = _PAIRS.format(30)


def _pairs(spark, d):
    return M.coupling(A.commits(spark, d), A.changes(spark, d), min_support=2)


@query("coupling_support", "cm ch kept pairs", "SELECT path_a, path_b, support FROM pairs")
def coupling_support(spark, d):
    return _pairs(spark, d).select("path_a", "path_b", "support")


@query("coupling_ratio", "cm ch kept pairs", "SELECT * FROM pairs")
def coupling_ratio(spark, d):
    return _pairs(spark, d)


@query("coupling_topk", "cm ch kept pairs", "SELECT * FROM pairs ORDER BY coupling_ratio DESC, support DESC, path_a, path_b LIMIT 20")
def coupling_topk(spark, d):
    return M.coupling_view(_pairs(spark, d), top=20)


@query("coupling_suppliers", "cm ch kept_supp pairs30", "SELECT * FROM pairs")
def coupling_suppliers(spark, d):
    return M.coupling(A.commits(spark, d), A.changes(spark, d, "l_suppkey"), min_support=30)


@query("coupling_view", "cm ch kept pairs", "SELECT * FROM pairs WHERE coupling_ratio >= 0.1 AND support >= 2")
def coupling_view(spark, d):
    return M.coupling_view(_pairs(spark, d), min_ratio=0.1, min_support=2)


def _owned(spark, d):
    return M.ownership(A.hunks(spark, d), A.commits(spark, d, coarse=True))


@query("ownership", "own", "SELECT path, author_id, lines, total, ratio AS ownership_ratio FROM own")
def ownership(spark, d):
    return _owned(spark, d)


@query("bus_factor", "own bf", "SELECT * FROM bf")
def bus_factor(spark, d):
    return M.bus_factor(_owned(spark, d))


@query("top_owner", "own", "SELECT path, author_id, ratio AS ownership_ratio FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ratio DESC, author_id) AS rn FROM own) WHERE rn = 1")
def top_owner(spark, d):
    return M.top_owner(_owned(spark, d))


@query("bus_factor_one", "own", "SELECT path, max(ratio) AS top_owner_ratio FROM own GROUP BY path HAVING max(lines) > 0.2 * max(total)")
def bus_factor_one(spark, d):
    return M.bus_factor(_owned(spark, d), 0.2).where("bus_factor = 1").select("path", "top_owner_ratio")


@query(
    "knowledge_risk_order", "own bf",
    "SELECT path, bus_factor, top_owner_ratio, author_id FROM bf JOIN (SELECT path, author_id FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ratio DESC, author_id) AS rn FROM own) WHERE rn = 1) USING (path) ORDER BY bus_factor, top_owner_ratio DESC, path LIMIT 25",
)
def knowledge_risk_order(spark, d):
    owned = _owned(spark, d)
    return M.knowledge_risk(M.bus_factor(owned), M.top_owner(owned), top=25).select("path", "bus_factor", "top_owner_ratio", "author_id")


@query("hunk_failures", "", "SELECT count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_partkey END) AS failed FROM lineitem")
def hunk_failures(spark, d):
    own = A.table(spark, d, "lineitem").select(F.col("l_partkey").alias("path"), (F.col("l_returnflag") == "R").alias("failed"))
    return M.failed_files(own)


@query("anon_labels_commits", "", "SELECT author_id, 'Author #' || row_number() OVER (ORDER BY author_id) AS label FROM (SELECT DISTINCT o_custkey AS author_id FROM orders) UNION ALL SELECT -1, 'Author #?'")
def anon_labels_commits(spark, d):
    ids = A.commits(spark, d).select("author_id").union(spark.range(1).select(F.lit(M.UNKNOWN).cast("bigint")))
    return M.anonymous_labels(ids, "commits")


@query("anon_labels_knowledge", "own", "SELECT author_id, 'Author #' || row_number() OVER (ORDER BY author_id) AS label FROM (SELECT DISTINCT author_id FROM own)")
def anon_labels_knowledge(spark, d):
    return M.anonymous_labels(_owned(spark, d))


@query("author_display", "", "SELECT c_custkey AS author_id, CASE WHEN c_custkey % 5 = 0 THEN 'c' || c_custkey || '@mail' ELSE c_name END AS label FROM customer")
def author_display(spark, d):
    name = F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.col("c_name"))
    return A.table(spark, d, "customer").select(F.col("c_custkey").alias("author_id"), C.display_name(name, F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@mail"))).alias("label"))


def _ages(spark, d):
    return M.age(A.hunks(spark, d), A.commits(spark, d))


@query("age_profile", "cm age", "SELECT * FROM age")
def age_profile(spark, d):
    return _ages(spark, d)


_HISTOGRAM = "SELECT b AS bucket, coalesce(n, 0) AS files FROM (SELECT unnest(range(0, 6)) AS b) LEFT JOIN (SELECT CASE {0} ELSE 5 END AS b, count(*) AS n FROM age GROUP BY 1) USING (b)"


@query("age_buckets_report", "cm age", _HISTOGRAM.format(" ".join(f"WHEN median_age_days < {x} THEN {k}" for k, x in enumerate(C.AGE_BOUNDS))))
def age_buckets_report(spark, d):
    return M.age_histogram(_ages(spark, d))


@query("age_buckets_ui", "cm age", _HISTOGRAM.format(" ".join(f"WHEN median_age_days <= {x} THEN {k}" for k, x in enumerate(C.AGE_BOUNDS))))
def age_buckets_ui(spark, d):
    return M.age_histogram(_ages(spark, d), inclusive=True)


@query("age_repo_median", "cm age", "SELECT median_age_days AS median_of_medians FROM (SELECT median_age_days, row_number() OVER (ORDER BY median_age_days, path) AS rn FROM age) WHERE rn = (SELECT count(*) // 2 + 1 FROM age)")
def age_repo_median(spark, d):
    return M.median_of_medians(_ages(spark, d))


@query("age_members", "cm age", f"SELECT *, row_number() OVER (ORDER BY bucket, median_age_days, path) AS n FROM (SELECT CASE {' '.join(f'WHEN median_age_days <= {x} THEN {k}' for k, x in enumerate(C.AGE_BOUNDS))} ELSE 5 END AS bucket, path, median_age_days FROM age)")
def age_members(spark, d):
    return M.age_members(_ages(spark, d))


_DOC_PATH = "source || '/' || doc_id || '.' || CASE lang WHEN 'en' THEN 'rs' WHEN 'de' THEN 'py' WHEN 'fr' THEN 'tsx' ELSE 'TXT' END"


def _documents(spark, d):
    extension = F.create_map(F.lit("en"), F.lit("rs"), F.lit("de"), F.lit("py"), F.lit("fr"), F.lit("tsx"))[F.col("lang")]
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), F.coalesce(extension, F.lit("TXT")))
    return A.table(spark, d, "documents").select("doc_id", path.alias("path"), "text")


_LOC = "CAST(len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160) || chr(5760) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288)) <> '')) AS BIGINT)"


@query("loc_per_document", "", f"SELECT doc_id, {_LOC} AS loc FROM documents")
def loc_per_document(spark, d):
    return _documents(spark, d).select("doc_id", C.lines_of_code("text").alias("loc"))


@query("language_detect", "", f"SELECT doc_id, path, CASE WHEN path LIKE '%.rs' THEN 'rust' WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.tsx' THEN 'tsx' END AS language FROM (SELECT doc_id, {_DOC_PATH} AS path FROM documents)")
def language_detect(spark, d):
    return _documents(spark, d).select("doc_id", "path", C.language("path").alias("language"))


def _indented(spark, d):
    """Documents whose lines are indented by their length modulo 7; none has an indent of its own."""
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.concat(F.repeat(F.lit(" "), F.length(x) % 7), x))
    return _documents(spark, d).select(F.col("doc_id").cast("string").alias("blob_sha"), F.lit("notes.txt").alias("path"), F.array_join(lines, "\n").cast("binary").alias("content"))


_BLANK = "trim({0}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160) || chr(5760) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288)) = ''"
#: A line stays open until the next one that isn't indented more; it is counted once for each line in between.
_INDENTED = f"""lines AS (SELECT doc_id, length(t) % 7 AS x, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i FROM (SELECT doc_id, unnest(l) AS t, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE NOT {_BLANK.format("t")}),
      ends AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, {", ".join(f"min(CASE WHEN x <= {v} THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS e{v}" for v in range(7))} FROM lines)"""
_PARTS["indented"] = _INDENTED


@query("indent_complexity", "indented", f"SELECT doc_id, CAST(coalesce(sum(coalesce(CASE x {' '.join(f'WHEN {v} THEN e{v}' for v in range(7))} END, n + 1) - i - 1), 0) AS BIGINT) AS indentation, count(i) AS loc FROM documents LEFT JOIN ends USING (doc_id) GROUP BY doc_id")
def indent_complexity(spark, d):
    return X.complexities(_indented(spark, d)).select(F.col("blob_sha").cast("bigint").alias("doc_id"), F.col("value").cast("bigint").alias("indentation"), F.col("loc").cast("bigint").alias("loc"))


@query("complexity_per_loc", "", f"SELECT doc_id, CASE WHEN loc > 0 THEN n_chars / CAST(loc AS DOUBLE) ELSE 0 END AS per_loc FROM (SELECT doc_id, n_chars, {_LOC} AS loc FROM documents)")
def complexity_per_loc(spark, d):
    own = A.table(spark, d, "documents").select("doc_id", "n_chars", C.lines_of_code("text").alias("loc"))
    return own.select("doc_id", C.per_loc("n_chars", "loc").alias("per_loc"))


#: Contents, and by hand: the language, the value, the lines of code and the method.
_SOURCES = {
    "pick.rs": ("fn pick(xs: &[u8]) -> u8 {\n    let mut n = 0;\n    while n < 9 {\n        n += 1;\n        if xs[n] == 0 { break }\n    }\n    loop { match n { 0 => return 1, 7 | 8 => return 2, _ => n -= 1 } }\n}\n", "rust", 7, 8, "cyclomatic"),
    "rows.py": ("for row in rows:\n    try:\n        use(row)\n    except KeyError:\n        skip()\n    while row and not done:\n        step()\n", "python", 4, 7, "cyclomatic"),
    "drain.go": ("func drain(c chan int) {\n\tfor v := range c {\n\t\tswitch {\n\t\tcase v > 9: stop()\n\t\tcase v < 0: if v == -1 { return }\n\t\t}\n\t}\n}\n", "go", 5, 8, "cyclomatic"),
    "run.js": ("const run = q => {\n  try { for (const j of q) { if (!j) continue; } }\n  catch (e) { do { wait() } while (busy()) }\n\n  return q.length ? 1 : 0 // if\n}\n", "js", 6, 5, "cyclomatic"),
    "box.ts": ("class Box<T> {\n  get(k?: number): T | undefined { while (this.open) { if (k) return this.at[k] } return undefined }\n}\n", "ts", 3, 3, "cyclomatic"),
    "todo.md": ("top\n    mid\n        deep\n    mid\n", "none", 4, 4, "indentation"),
}


@query("cyclomatic_fixture", "", f"SELECT * FROM (VALUES {', '.join(repr((p, lang, float(value), loc, method)) for p, (_, lang, value, loc, method) in _SOURCES.items())}) AS t(blob_sha, lang, value, loc, method)")
def cyclomatic_fixture(spark, d):
    """A few sources with values counted by hand: no table has any."""
    rows = spark.createDataFrame([(p, p, bytearray(t[0].encode())) for p, t in _SOURCES.items()], "blob_sha string, path string, content binary")
    return X.complexities(rows).select("blob_sha", "lang", "value", F.col("loc").cast("bigint").alias("loc"), "method")


def _complexity(spark, d):
    return A.table(spark, d, "part").select(F.col("p_partkey").alias("path"), F.col("p_size").cast("double").alias("complexity"), F.when(F.col("p_size") % 8 < 6, "cyclomatic").otherwise("indentation").alias("method"), (F.col("p_size") / 10).alias("complexity_per_loc"))


def _hot(spark, d):
    return M.hotspots(_kept(spark, d), _complexity(spark, d))


@query("hotspot_percentiles", "cm ch kept churn cx hot", "SELECT path, churn, complexity, churn_pct, complexity_pct FROM hot")
def hotspot_percentiles(spark, d):
    return _hot(spark, d).select("path", "churn", "complexity", "churn_pct", "complexity_pct")


@query("hotspot_rank", "cm ch kept churn cx hot", "SELECT path, score, rank FROM hot")
def hotspot_rank(spark, d):
    return _hot(spark, d).select("path", "score", "rank")


@query("hotspot_dead_zero", "cm ch kept churn cx", "SELECT cx.path, coalesce(churn_total, 0) AS churn_raw, CASE WHEN is_alive THEN churn_total ELSE 0 END AS churn FROM cx LEFT JOIN churn USING (path) WHERE method = 'cyclomatic'")
def hotspot_dead_zero(spark, d):
    raw = _kept(spark, d).select("path", F.col("churn_total").alias("raw"))
    return _hot(spark, d).select("path", "churn").join(raw, "path", "left").select("path", F.coalesce("raw", F.lit(0)).alias("churn_raw"), "churn")


@query(
    "file_metrics_full_outer", "cm ch kept churn cx hot",
    "SELECT path, churn_total, churn_30d, churn_90d, churn_365d, is_alive, complexity, rank AS hotspot_rank FROM churn FULL JOIN cx USING (path) LEFT JOIN (SELECT path, rank FROM hot) USING (path)",
)
def file_metrics_full_outer(spark, d):
    churn, values = cut(_kept(spark, d)), _complexity(spark, d)
    return M.file_metrics(churn, values, M.hotspots(churn, values)).drop("complexity_per_loc")


@query(
    "overview_counts", "cm ch kept churn cx hot pairs own bf",
    "SELECT (SELECT count(*) FROM cm) AS commits, (SELECT count(*) FROM (SELECT path FROM churn UNION SELECT path FROM cx)) AS files, (SELECT count(*) FROM hot) AS ranked_files, (SELECT count(*) FROM pairs) AS pairs, (SELECT count(*) FROM bf WHERE bus_factor = 1) AS single_owner, (SELECT count(DISTINCT author_id) FROM own) AS authors, (SELECT coalesce(max(ts), 0) FROM cm) AS anchor",
)
def overview_counts(spark, d):
    from .plans.materialize import counts_of

    owned = _owned(spark, d)
    return counts_of(A.commits(spark, d), file_metrics_full_outer(spark, d), _pairs(spark, d), M.bus_factor(owned), owned)


_PARTS["plan"] = "plan AS (SELECT path, last_sha, revisions, total_added, revisions * total_added AS cost FROM live)"


def _plan(spark, d):
    return M.blame_plan(H.living_files(_history(spark, d)), 30_000)


def _cache(living: DataFrame) -> DataFrame:
    """A cache that has every third file, every ninth in an older state."""
    return living.where("path % 3 = 0").select("path", "last_sha", (F.col("revisions") - (F.col("path") % 9 == 0).cast("int")).alias("revisions"))


@query("blame_budget_skips", "cm ch al last live plan", "SELECT path, 'over_budget' AS reason, cost, CAST(30000 AS BIGINT) AS budget FROM plan WHERE cost > 30000")
def blame_budget_skips(spark, d):
    return _plan(spark, d).where("over_budget").select("path", F.lit("over_budget").alias("reason"), "cost", F.lit(30_000).cast("bigint").alias("budget"))


@query("blame_cache_misses", "cm ch al last live plan", "SELECT path, last_sha, revisions, cost FROM plan WHERE cost <= 30000 AND (path % 3 <> 0 OR path % 9 = 0)")
def blame_cache_misses(spark, d):
    plan = _plan(spark, d)
    return M.blame_misses(plan, _cache(plan)).select("path", "last_sha", "revisions", "cost")


@query("blame_cache_valid", "cm ch al last live", "SELECT path, last_sha, revisions FROM live WHERE path % 3 = 0 AND path % 9 <> 0")
def blame_cache_valid(spark, d):
    living = H.living_files(_history(spark, d))
    return M.valid_cache(_cache(living), living)


@query("blame_skip_reason", "cm ch al last live plan", "SELECT path, 'over budget: about ' || cost || ' line-revisions, the budget is 30000' AS why FROM plan WHERE cost > 30000")
def blame_skip_reason(spark, d):
    own = blame_budget_skips(spark, d)
    return own.select("path", C.skip_reason("reason", "cost", "budget").alias("why"))


@query("events_flat_order", "cm ch", "SELECT ts, sha, path, change_type, CASE WHEN supp % 3 = 0 THEN supp END AS old_path, added, deleted, tie, row_number() OVER (ORDER BY ts, sha, path, change_type, CASE WHEN supp % 3 = 0 THEN supp END NULLS LAST, tie) AS n FROM ch JOIN cm USING (sha)")
def events_flat_order(spark, d):
    supplier = F.substring_index("tie", "/", 1).cast("bigint")
    own = A.changes(spark, d).withColumn("old_path", F.when(supplier % 3 == 0, supplier))
    own = own.join(A.commits(spark, d).select("sha", C.seconds("committed_at").alias("ts")), "sha").select("ts", "sha", "path", "change_type", "old_path", "added", "deleted", "tie")
    return global_rank(own, [*R.event_order(), F.col("tie")], "n")


@query(
    "events_nested", "cm ch",
    "SELECT sha, ts, author_id, is_mechanical AS mechanical, count(*) AS n, string_agg(path || change_type || '+' || added || '-' || deleted, ' ' ORDER BY path, change_type, added, deleted) AS changes FROM ch JOIN cm USING (sha) GROUP BY ALL",
)
def events_nested(spark, d):
    own = R.nested(R.events(A.commits(spark, d), A.changes(spark, d)))
    text = F.transform("changes", lambda c: F.concat(c.path.cast("string"), c.change_type, F.lit("+"), c.added.cast("string"), F.lit("-"), c.deleted.cast("string")))
    return own.select("sha", "ts", "author_id", "mechanical", F.size("changes").cast("bigint").alias("n"), F.array_join(text, " ").alias("changes"))


def _stream(spark, d):
    return R.numbered(A.event_stream(spark, d))


_ALIVE = "SELECT index, CAST(1 AS BIGINT) AS touched, CAST(sum(d) OVER (ORDER BY index) AS BIGINT) AS alive FROM (SELECT index, sum(d) AS d FROM (SELECT index, present - lag(present, 1, 0) OVER (PARTITION BY path ORDER BY index, k) AS d FROM ops) GROUP BY index)"


@query("timeline_alive_series", "ev ops", _ALIVE)
def timeline_alive_series(spark, d):
    return R.alive_series(_stream(spark, d))


#: Lives of paths up to a commit, the lives that renames come from, and all lives that each goes back to.
_LIVES = """seen AS (SELECT *, lag(present, 1, 0) OVER (PARTITION BY path ORDER BY index, k) AS before FROM ops WHERE index <= {0}),
      lived AS (SELECT *, sum(CASE WHEN present = 1 AND (before = 0 OR moved) THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY index, k ROWS UNBOUNDED PRECEDING) AS life FROM seen),
      lives AS (SELECT path, life, sum(present) AS churn, max(CASE WHEN present = 1 THEN index END) AS last_touch, arg_max(present, index * 2 + k) AS alive FROM lived GROUP BY path, life),
      links AS (SELECT h.path, h.life, g.path AS from_path, g.life AS from_life FROM lived h JOIN lived g ON g.index = h.index AND g.moved AND g.present = 0 AND g.before = 1 WHERE h.moved AND h.present = 1),
      back AS (SELECT path, life, path AS at_path, life AS at_life FROM lives WHERE alive = 1 AND life = (SELECT max(life) FROM lives l WHERE l.path = lives.path)
        UNION ALL SELECT back.path, back.life, from_path, from_life FROM back JOIN links ON links.path = at_path AND links.life = at_life),
      frame AS (SELECT back.path, CAST(sum(l.churn) AS BIGINT) AS churn, max(CASE WHEN at_path = back.path AND at_life = back.life THEN last_touch END) AS last_touch FROM back JOIN lives l ON l.path = at_path AND l.life = at_life GROUP BY back.path, back.life)"""
_PARTS["back_700"], _PARTS["back_last"] = _LIVES.format(700), _LIVES.format(1 << 40)


@query("frame_at", "ev ops back_700", "SELECT path, churn, last_touch FROM frame")
def frame_at(spark, d):
    return R.frame_at(_stream(spark, d), 700)


@query("replay_last", "ev ops back_last", "SELECT path, churn, last_touch FROM frame")
def replay_last(spark, d):
    return R.replay(_stream(spark, d))


@query("timeline_maxima", "ev ops", f"SELECT greatest(1, max(alive)) AS max_alive, max(touched) AS max_touched FROM ({_ALIVE})")
def timeline_maxima(spark, d):
    return R.series_maxima(R.alive_series(_stream(spark, d)))


@query("scale_maxima", "cm ch kept churn age", "SELECT (SELECT greatest(1, max(churn_total)) FROM churn) AS max_churn_total, (SELECT greatest(1, max(median_age_days)) FROM age) AS max_median_age_days")
def scale_maxima(spark, d):
    return M.maxima(_kept(spark, d), "churn_total").crossJoin(M.maxima(_ages(spark, d), "median_age_days"))  # rows of one


@query("seek_index", "ev", "SELECT coalesce(min(CASE WHEN ts >= 1705000000000000 THEN index END), max(index)) AS index FROM ix")
def seek_index(spark, d):
    return R.seek(_stream(spark, d), 1_705_000_000_000_000)


@query("time_cut", "ev", "SELECT path, count(*) AS n FROM ev WHERE ts <= 1705000000000000 GROUP BY path")
def time_cut(spark, d):
    return R.until(A.event_stream(spark, d), 1_705_000_000_000_000).groupBy("path").agg(F.count("*").alias("n"))


@query("first_appearance", "ev", "SELECT path, min(ts) AS born_ts FROM ev WHERE change_type <> 'D' GROUP BY path")
def first_appearance(spark, d):
    return R.first_appearance(A.event_stream(spark, d))


@query("recency", "ev ops back_700", "SELECT path, last_touch, least(greatest(1 - (700 - last_touch) / CAST(701 AS DOUBLE), 0), 1) AS recency FROM frame")
def recency(spark, d):
    return R.frame_at(_stream(spark, d), 700).select("path", "last_touch", C.recency(F.lit(700), "last_touch").alias("recency"))


def _rolled(spark, d):
    return T.rollup(A.paths(spark, d), "value", "color")


@query("dir_rollup", "tree", "SELECT dir, CAST(depth AS INTEGER) AS depth, CAST(sum(value) AS BIGINT) AS raw, round(sum(sqrt(value)), 6) AS area FROM pre GROUP BY dir, depth")
def dir_rollup(spark, d):
    return _rolled(spark, d).select("dir", "depth", "raw", F.round("area", 6).alias("area"))


@query("dir_leaf_counts", "tree", "SELECT dir, count(*) AS files FROM pre GROUP BY dir")
def dir_leaf_counts(spark, d):
    return _rolled(spark, d).select("dir", "files")


@query("dir_weighted_color", "tree", "SELECT dir, CASE WHEN sum(value) > 0 THEN CAST(sum(color * value) AS DOUBLE) / CAST(sum(value) AS DOUBLE) ELSE 0 END AS color FROM pre GROUP BY dir")
def dir_weighted_color(spark, d):
    return _rolled(spark, d).select("dir", "color")


@query("dir_born_ts", "cm tree", "SELECT dir, min(ts) AS born_ts FROM pre JOIN lineitem ON l_partkey = part JOIN cm ON cm.sha = l_orderkey WHERE NOT (l_returnflag = 'R' AND l_linestatus = 'F') GROUP BY dir")
def dir_born_ts(spark, d):
    births = R.first_appearance(_history(spark, d)).withColumnRenamed("path", "part")
    return T.born(A.paths(spark, d).join(births, "part")).select("dir", "born_ts")


@query(
    "growth_nodes", "tree",
    "SELECT path, regexp_replace(path, '/[^/]*$', '') AS parent, true AS is_file, part AS born_ts, CAST(1 AS BIGINT) AS leaf_count FROM files UNION ALL SELECT dir, CASE WHEN contains(dir, '/') THEN regexp_replace(dir, '/[^/]*$', '') ELSE '' END, false, min(part), count(*) FROM pre WHERE dir <> '' GROUP BY dir",
)
def growth_nodes(spark, d):
    return T.nodes(A.paths(spark, d).select("path", F.col("part").alias("born_ts")))


@query("tile_floor", "tree", f"SELECT path, round(greatest(sqrt(value), sum(sqrt(value)) OVER (PARTITION BY string_split(path, '/')[2]) * {T.TILE_SHARE}), 6) AS tile FROM files")
def tile_floor(spark, d):
    own = A.paths(spark, d).withColumn("brand", F.split("path", "/")[1])
    return T.floored(own, "value", level="brand").select("path", F.round("tile", 6).alias("tile"))


@query("minmax_norm", "", "SELECT p_partkey AS path, CASE WHEN hi > lo THEN (p_size - lo) / CAST(hi - lo AS DOUBLE) ELSE 0.5 END AS norm FROM part, (SELECT min(p_size) AS lo, max(p_size) AS hi FROM part)")
def minmax_norm(spark, d):
    return M.normalized(A.table(spark, d, "part").select(F.col("p_partkey").alias("path"), F.col("p_size").cast("double").alias("v")), "v", "norm").select("path", "norm")


@query("risk_color_value", "own bf", "SELECT path, bus_factor + (1 - top_owner_ratio) AS risk, 1 - least(greatest((bus_factor + (1 - top_owner_ratio) - 1) / 3, 0), 1) AS color FROM bf")
def risk_color_value(spark, d):
    own = M.bus_factor(_owned(spark, d)).withColumn("risk", C.risk_value("bus_factor", "top_owner_ratio"))
    return own.select("path", "risk", C.risk_color("risk").alias("color"))


@query("author_ids_first_seen", "", "SELECT email, 9 + row_number() OVER (ORDER BY first, email) AS author_id FROM (SELECT lower(trim(' ' || c_mktsegment || c_nationkey || ' ')) AS email, min(o_orderkey) AS first FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1) WHERE email NOT IN ('building3', 'machinery7')")
def author_ids_first_seen(spark, d):
    from .plans.store import author_ids

    email = F.concat(F.lit(" "), "c_mktsegment", F.col("c_nationkey").cast("string"), F.lit(" "))
    own = A.table(spark, d, "orders").join(A.table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_orderkey").alias("walk_index"), F.struct(F.col("c_name").alias("name"), email.alias("email")).alias("author"))
    known = spark.createDataFrame([(4, "a", "building3"), (9, "b", "machinery7")], "author_id int, canonical_name string, canonical_email string")
    return author_ids(own, known).select(F.col("canonical_email").alias("email"), F.col("author_id").cast("bigint").alias("author_id"))


@query("email_normalize", "", "SELECT c_custkey, lower(trim('  ' || c_name || '@Mail.Example ')) AS email FROM customer")
def email_normalize(spark, d):
    return A.table(spark, d, "customer").select("c_custkey", C.normalized_email(F.concat(F.lit("  "), "c_name", F.lit("@Mail.Example "))).alias("email"))


def _ingested(spark, d):
    """Commits of a store that took in the orders up to 1999 and then all orders: after the first time, and after the second."""
    from .model import Config
    from .plans.store import Store, ingest

    store, every = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"), A.history(spark, d)
    ingest(store, every.where("committed_at < 946684800"), Config())
    first = store.read("commits")
    ingest(store, every, Config())
    return first, store


@query("idempotent_append", "", "SELECT (SELECT count(*) FROM orders) AS n, (SELECT count(DISTINCT o_orderkey) FROM orders) AS distinct_n, (SELECT count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey) AS changes, (SELECT count(DISTINCT lower(trim(c_mktsegment || c_nationkey))) FROM orders JOIN customer ON c_custkey = o_custkey) AS authors")
def idempotent_append(spark, d):
    """Commits that are there already come once more: each is there once, with its changes, and authors keep one id."""
    _, store = _ingested(spark, d)
    out = store.read("commits").agg(F.count("*").alias("n"), F.countDistinct("sha").alias("distinct_n"))
    return out.crossJoin(store.read("file_changes").agg(F.count("*").alias("changes"))).crossJoin(store.read("authors").agg(F.countDistinct("author_id").alias("authors")))  # rows of one


@query("incremental_delta", "", "SELECT o_orderkey AS sha FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01'")
def incremental_delta(spark, d):
    first, store = _ingested(spark, d)
    return store.read("commits").join(first.select("sha"), "sha", "left_anti").select(F.col("sha").cast("bigint").alias("sha"))


@query("exclude_globs", "tree", "SELECT path FROM files WHERE NOT (path LIKE '%.md' OR path LIKE 'src/Brand#1%')")
def exclude_globs(spark, d):
    return H.excluded(A.paths(spark, d), ["*.md", "src/Brand#1*"]).select("path")


@query("path_search", "tree", "SELECT path FROM files WHERE contains(lower(path), 'brand#2')")
def path_search(spark, d):
    return M.search(A.paths(spark, d), " Brand#2 ").select("path")


@query(
    "text_functions", "tree",
    "SELECT path, string_split(path, '/')[-1] AS base, string_split(path, '/')[1] AS top, CASE WHEN length(path) > 20 THEN substr(path, 1, 19) || '…' ELSE path END AS head, CASE WHEN length(path) > 20 THEN '…' || right(path, 19) ELSE path END AS tail, replace(replace('<' || path || '&>', '&', '&amp;'), '<', '&lt;') AS escaped FROM files",
)
def text_functions(spark, d):
    raw = F.concat(F.lit("<"), "path", F.lit("&>"))
    own = A.paths(spark, d)
    return own.select("path", C.basename("path").alias("base"), C.top_directory("path").alias("top"), C.shorten("path", 20).alias("head"), C.shorten("path", 20, "tail").alias("tail"), F.replace(C.escape_html(raw), F.lit("&gt;"), F.lit(">")).alias("escaped"))


@query("date_functions", "", "SELECT o_orderkey AS sha, CAST(epoch(o_orderdate) AS BIGINT) AS ts, strftime(o_orderdate, '%b %-d, %Y') AS day, substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 12) AS short FROM orders")
def date_functions(spark, d):
    own = A.table(spark, d, "orders")
    return own.select(F.col("o_orderkey").alias("sha"), C.seconds("o_orderdate").alias("ts"), C.date_text("o_orderdate").alias("day"), C.short_sha(F.md5(F.col("o_orderkey").cast("string").cast("binary"))).alias("short"))


@query("user_sort", "own bf", "SELECT path, bus_factor, owners, row_number() OVER (ORDER BY owners DESC, path) AS n FROM bf")
def user_sort(spark, d):
    own = M.bus_factor(_owned(spark, d)).select("path", "bus_factor", "owners")
    return global_rank(own, [-F.col("owners"), F.col("path")], "n")


@query("knowledge_churn_lookup", "cm ch kept churn own bf", "SELECT path, bus_factor, coalesce(churn_total, 0) AS churn FROM bf LEFT JOIN churn USING (path)")
def knowledge_churn_lookup(spark, d):
    return M.bus_factor(_owned(spark, d)).join(_kept(spark, d).select("path", "churn_total"), "path", "left").select("path", "bus_factor", F.coalesce("churn_total", F.lit(0)).alias("churn"))


def _sections(spark, d) -> dict[str, DataFrame]:
    return {"coupling": E.coupling_section(_pairs(spark, d)), "file_age": E.age_section(_ages(spark, d))}


_JSON = """SELECT 'coupling' AS section, to_json({'a': path_a, 'b': path_b, 'support': support, 'ratio': coupling_ratio}) AS json FROM pairs
    UNION ALL SELECT 'file_age', to_json({'path': path, 'lines': lines, 'newest_age_days': newest_age_days, 'median_age_days': median_age_days, 'p90_age_days': p90_age_days, 'oldest_age_days': oldest_age_days}) FROM age"""


@query("export_document", "cm ch kept pairs age", f"SELECT section, CAST(json AS VARCHAR) AS json, CAST({SCHEMA_VERSION} AS BIGINT) AS schema_version FROM ({_JSON})")
def export_document(spark, d):
    return E.document_rows(_sections(spark, d)).withColumn("schema_version", F.lit(SCHEMA_VERSION).cast("bigint"))


@query("export_roundtrip", "cm age", "SELECT * FROM age")
def export_roundtrip(spark, d):
    """File ages written as the document's JSON and parsed again."""
    own = E.document_rows({"file_age": _sections(spark, d)["file_age"]})
    return own.select(F.from_json("json", "path bigint, lines bigint, newest_age_days bigint, median_age_days bigint, p90_age_days bigint, oldest_age_days bigint").alias("j")).select("j.*")


def _streamed(spark, name, df, mode="append") -> DataFrame:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    S.available_now(df, path, f"{path}-checkpoint", mode)
    return spark.read.schema(df.schema).parquet(path)


@query("stream_ingest_available_now", "", "SELECT event_id, user_id, event_type FROM events")
def stream_ingest_available_now(spark, d):
    return _streamed(spark, "ingest", S.deduplicated(S.event_stream(spark, d)).select("event_id", "user_id", "event_type"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
