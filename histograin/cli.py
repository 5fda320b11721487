"""Command line: analyze, hotspots, coupling, knowledge, age, report, export, sql."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import functions as F

from .model import Config, HistoryError, MetricConfig
from .operators import history as H
from .operators import metrics as M
from .plans import export as E
from .plans.materialize import complexity_of, hunks_of, materialize
from .plans.store import Store, analyze
from .session import build, prepare
from .sources import document, git


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="histograin", description="Signals from a repository's history.")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("analyze", "hotspots", "coupling", "knowledge", "age", "report", "export", "sql"):
        c = commands.add_parser(name)
        c.add_argument("path" if name != "sql" else "query", nargs="?" if name != "sql" else None, default=".")
        c.add_argument("--db", default=None, help="folder of the store (.histograin in the repository)")
        c.add_argument("--exclude", action="append", default=[])
        if name == "analyze":
            c.add_argument("--no-incremental", action="store_true")
            c.add_argument("--mechanical-max-files", type=int, default=None)
        if name in ("hotspots", "coupling", "knowledge", "age"):
            c.add_argument("--top", type=int, default=20)
        if name == "coupling":
            c.add_argument("--min-support", type=int, default=5)
        if name in ("knowledge", "age", "report", "export"):
            c.add_argument("--blame-budget", type=int, default=10_000_000)
        if name in ("knowledge", "export"):
            c.add_argument("--show-names", action="store_true")
        if name in ("report", "export"):
            c.add_argument("--out", default="report.html" if name == "report" else "export.json")
        if name == "export":
            c.add_argument("--format", choices=("json", "parquet"), default="json")
    return top


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        print(run(args))
    except HistoryError as e:
        print(f"error: {e}")
        return 1
    return 0


def run(args: argparse.Namespace) -> str:
    spark = prepare(build())
    repo = git.discover(getattr(args, "path", "."))
    store = Store(spark, args.db or f"file://{repo}/.histograin")
    if args.command == "sql":
        tables = {n: store.read(n) for n in ("authors", "commits", "file_changes")}
        return E.text_table(document.query(spark, tables, args.query), 1000)
    config = Config(repo, None, tuple(args.exclude), getattr(args, "mechanical_max_files", None), not getattr(args, "no_incremental", False))
    new = analyze(store, repo, config)
    if args.command == "analyze":
        return f"{new} new commits, {store.read('commits').count()} in all"
    commits, changes = store.read("commits"), store.read("file_changes")
    read_blobs, blame = (lambda df: git.blobs(df, repo)), (lambda df: git.blame(df, repo, git.head(repo)))
    if args.command in ("report", "export"):
        materialize(store, read_blobs, blame, MetricConfig(blame_budget=args.blame_budget))
        if args.command == "report":
            with open(args.out, "w", encoding="utf-8") as f:
                f.write(E.render_html(store))
        elif args.format == "json":
            E.export_json(store, args.out, args.show_names)
        else:
            E.export_parquet(store, args.out, args.show_names)
        return f"written to {args.out}"
    paths = H.path_map(commits, changes)
    if args.command == "coupling":
        return E.text_table(M.coupling(commits, changes, paths, args.min_support).orderBy(*M.coupling_order()), args.top)
    living = H.living_files(H.history(commits, changes, paths))
    if args.command == "hotspots":
        ranked = M.hotspots(M.churn(commits, changes, paths), complexity_of(store, living, read_blobs))
        return E.text_table(ranked.orderBy("rank").select("rank", "path", "churn", "complexity", "score"), args.top)
    hunks, skips = hunks_of(store, living, args.blame_budget, blame)
    left = skips.count()
    note = f"\n{left} files left out" if left else ""
    if args.command == "age":
        return E.text_table(M.age(hunks, commits).orderBy("median_age_days", "path"), args.top) + note
    owned = M.ownership(hunks, commits)
    names = store.read("authors").select("author_id", E.display_name("canonical_name", "canonical_email").alias("label")) if args.show_names else M.anonymous_labels(owned)
    top = M.labelled(M.top_owner(owned), names).select("path", F.col("label").alias("first_owner"))
    risk = M.bus_factor(owned).join(top, "path").orderBy("bus_factor", F.desc("top_owner_ratio"), "path")
    return E.text_table(risk.select("path", "bus_factor", "top_owner_ratio", "first_owner"), args.top) + note


if __name__ == "__main__":
    raise SystemExit(main())
