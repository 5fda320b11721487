"""The exported document, the page and the terminal tables of a store."""

from __future__ import annotations

import html
import json
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import AGE_BOUNDS, display_name, seconds, skip_reason
from ..operators import metrics as M
from ..operators import replay as R
from ..operators.tree import treemap
from ..sources.document import SCHEMA_VERSION
from .store import Store


def labels(store: Store, scope: str, names: bool = False) -> DataFrame:
    """(author_id, label) for authors of ``commits`` or ``knowledge``; names only if asked for."""
    ids = store.read("commits" if scope == "commits" else "knowledge").select("author_id").distinct()
    if names:
        return store.read("authors").join(ids, "author_id").select("author_id", display_name("canonical_name", "canonical_email").alias("label"))
    return M.anonymous_labels(ids, scope)


def coupling_section(pairs: DataFrame) -> DataFrame:
    return pairs.orderBy(*M.coupling_order()).select(F.col("path_a").alias("a"), F.col("path_b").alias("b"), "support", F.col("coupling_ratio").alias("ratio"))


def age_section(ages: DataFrame) -> DataFrame:
    return ages.orderBy("path").select("path", "lines", "newest_age_days", "median_age_days", "p90_age_days", "oldest_age_days")


def document_rows(own: dict[str, DataFrame]) -> DataFrame:
    """(section, json): the rows of the document's lists as they stand in it, distributed and in no order."""
    rows = [df.select(F.lit(name).alias("section"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json")) for name, df in own.items()]
    return reduce(DataFrame.unionByName, rows)


def sections(store: Store, names: bool = False) -> dict[str, DataFrame]:
    """The document's lists as frames, each in its order."""
    label = labels(store, "commits", names)
    knowledge = store.read("module_bus_factor").withColumnRenamed("module", "path")
    top = M.labelled(M.top_owner(store.read("knowledge")), label).select("path", F.col("label").alias("top_owner"))
    flat = R.events(store.read("commits"), store.read("file_changes"))
    events = M.labelled(R.nested(flat), label).orderBy("ts", "sha")
    change = lambda c: F.struct(c.path.alias("path"), c.change_type.alias("type"), c.old_path.alias("old_path"), c.added.alias("added"), c.deleted.alias("deleted"))
    return {
        "files": store.read("file_metrics").orderBy("path"),
        "coupling": coupling_section(store.read("coupling")),
        "knowledge": knowledge.join(top, "path").orderBy("bus_factor", F.desc("top_owner_ratio"), "path").select("path", "bus_factor", "top_owner", "top_owner_ratio"),
        "file_age": age_section(store.read("file_age")),
        "blame_skips": store.read("blame_skips").orderBy("path"),
        "events": events.select("sha", "ts", F.col("label").alias("author"), "mechanical", F.transform("changes", change).alias("changes")),
    }


def head_of(store: Store, names: bool = False) -> dict:
    meta = store.meta() or {}
    one = store.read("commits").agg(F.count("*").alias("n"), F.coalesce(F.max(seconds("committed_at")), F.lit(0)).alias("anchor"), F.countDistinct("author_id").alias("authors")).first()
    return {"schema_version": SCHEMA_VERSION, "engine_version": meta.get("engine_version"), "config_hash": meta.get("config_hash"), "head_sha": meta.get("head_sha"), "anchor_ts": one.anchor, "total_commits": one.n, "total_authors": one.authors, "anonymized": not names}


def export_json(store: Store, path: str, names: bool = False) -> None:
    """Write the document to a local file on the driver, row by row; equal stores give equal bytes."""
    with open(path, "w", encoding="utf-8") as f:
        write = lambda x: json.dump(x, f, ensure_ascii=False, separators=(",", ":"))
        f.write('{"meta":')
        write(head_of(store, names))
        for name, df in sections(store, names).items():
            f.write(f',"{name}":[')
            for i, row in enumerate(df.toLocalIterator()):
                f.write("," * bool(i))
                write(row.asDict(recursive=True))
            f.write("]")
        f.write("}")


def export_parquet(store: Store, path: str, names: bool = False) -> None:
    """The same lists as Parquet folders below ``path``."""
    for name, df in sections(store, names).items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


#: Rows that the page shows of each list.
PAGE_ROWS = {"hotspots": 15, "coupling": 25, "knowledge": 25, "skips": 50}

_STYLE = "body{font:14px/1.4 system-ui,sans-serif;margin:2rem auto;max-width:1000px;color:#222}table{border-collapse:collapse;width:100%}td,th{padding:.2rem .6rem;text-align:left;border-bottom:1px solid #ddd}.cards{display:flex;gap:1rem;flex-wrap:wrap}.card{border:1px solid #ddd;border-radius:6px;padding:.6rem 1rem}.bar{background:#4a7;height:.8rem}"


def _table(title: str, names: list[str], rows: Iterable[Iterable]) -> str:
    cell = lambda x: html.escape("–" if x is None else f"{x:.2f}" if isinstance(x, float) else str(x))
    body = "".join("<tr>" + "".join(f"<td>{cell(x)}</td>" for x in r) + "</tr>" for r in rows)
    return f"<h2>{html.escape(title)}</h2><table><tr>{''.join(f'<th>{html.escape(n)}</th>' for n in names)}</tr>{body}</table>" if body else f"<h2>{html.escape(title)}</h2><p>Nothing to show.</p>"


def render_html(store: Store) -> str:
    """A page of its own, without scripts or links: counts, a treemap, the first rows of each list, ages."""
    from .materialize import overview

    counts, head = overview(store).first().asDict(), head_of(store)
    files = store.read("file_metrics")
    ranked = files.where("hotspot_rank IS NOT NULL")
    hot = ranked.orderBy("hotspot_rank").limit(PAGE_ROWS["hotspots"]).collect()
    sized = ranked.orderBy(F.desc("complexity"), "path").limit(200).collect()
    most = max([r.churn_total or 0 for r in sized], default=0) or 1
    boxes = treemap([max(float(r.complexity), 0.01) for r in sized], 960, 480)
    tiles = "".join(
        f'<rect x="{x:.1f}" y="{y:.1f}" width="{w:.1f}" height="{h:.1f}" fill="hsl({120 - 120 * (r.churn_total or 0) / most:.0f} 60% 60%)" stroke="#fff"><title>{html.escape(r.path)}</title></rect>'
        for r, (x, y, w, h) in zip(sized, boxes, strict=True)
    )
    lists = sections(store)
    pairs = lists["coupling"].limit(PAGE_ROWS["coupling"]).collect()
    label = labels(store, "knowledge")
    top = M.labelled(M.top_owner(store.read("knowledge")), label).select("path", F.col("label").alias("owner"))
    risk = store.read("module_bus_factor").withColumnRenamed("module", "path").join(top, "path").orderBy("bus_factor", F.desc("top_owner_ratio"), "path").limit(PAGE_ROWS["knowledge"]).collect()
    skips = lists["blame_skips"].limit(PAGE_ROWS["skips"]).select("path", skip_reason("reason", "cost", "budget").alias("why")).collect()
    ages = {r.bucket: r.files for r in M.age_histogram(store.read("file_age")).collect()}
    bounds = ["< 30 days", *(f"< {b} days" for b in AGE_BOUNDS[1:]), "older"]
    tallest = max(ages.values(), default=0) or 1
    bars = "".join(f'<tr><td>{html.escape(bounds[k])}</td><td>{n}</td><td style="width:60%"><div class="bar" style="width:{100 * n / tallest:.0f}%"></div></td></tr>' for k, n in sorted(ages.items()))
    cards = "".join(f'<div class="card"><b>{v}</b><br>{html.escape(k.replace("_", " "))}</div>' for k, v in counts.items())
    return "".join(
        [
            f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>Repository report</title><style>{_STYLE}</style></head><body><h1>Repository report</h1>',
            f"<p>At {html.escape((head['head_sha'] or '')[:12])}</p>",
            f'<div class="cards">{cards}</div><h2>Map of hotspots</h2><svg viewBox="0 0 960 480" role="img">{tiles}</svg>',
            _table("Hotspots", ["rank", "path", "churn", "complexity"], [(r.hotspot_rank, r.path, r.churn_total, float(r.complexity)) for r in hot]),
            _table("Change coupling", ["file", "file", "support", "ratio"], [(r.a, r.b, r.support, float(r.ratio)) for r in pairs]),
            _table("Knowledge", ["path", "bus factor", "first owner", "share"], [(r.path, r.bus_factor, r.owner, float(r.top_owner_ratio)) for r in risk]),
            _table("Left out", ["path", "why"], [(r.path, r.why) for r in skips]) if skips else "",
            f"<h2>Age of code</h2><table>{bars}</table></body></html>",
        ]
    )


def text_table(df: DataFrame, top: int = 20, widths: dict[str, int] | None = None) -> str:
    """The first rows in columns of fixed width; long paths keep their end."""
    rows, names = df.limit(top).collect(), df.columns
    show = lambda x: "-" if x is None else f"{x:.2f}" if isinstance(x, float) else str(x)
    fit = lambda x, n: x if len(x) <= n else "…" + x[-(n - 1) :]
    size = {n: min((widths or {}).get(n, 60), max([len(n), *(len(show(r[n])) for r in rows)])) for n in names}
    lines = ["  ".join(n.ljust(size[n]) for n in names).rstrip()]
    lines += ["  ".join(fit(show(r[n]), size[n]).ljust(size[n]) for n in names).rstrip() for r in rows]
    return "\n".join(lines)
