"""Schemas of a history and of its materialized tables, settings and errors."""

from __future__ import annotations

from dataclasses import dataclass, field

from .functions.hashing import fnv1a64

AUTHORS = "author_id int, canonical_name string, canonical_email string"
COMMITS = "sha string, author_id int, committed_at timestamp, files_changed int, is_mechanical boolean"
FILE_CHANGES = "sha string, path string, old_path string, added int, deleted int, change_type string, blob_sha string"
HUNKS = "path string, failed boolean, commit_sha string, lines int"
META = "engine_version string, config_hash string, metrics_hash string, analyzed_at timestamp, head_sha string"
FILE_METRICS = "path string, churn_total int, churn_30d int, churn_90d int, churn_365d int, complexity float, complexity_per_loc float, hotspot_rank int, is_alive boolean"
COUPLING = "path_a string, path_b string, support int, coupling_ratio float, explained_by_imports boolean"
KNOWLEDGE = "path string, author_id int, ownership_ratio float"
MODULE_BUS_FACTOR = "module string, bus_factor int, top_owner_ratio float"
FILE_AGE = "path string, lines int, newest_age_days int, median_age_days int, p90_age_days int, oldest_age_days int"
BLAME_SKIPS = "path string, reason string, cost bigint, budget bigint"

#: A commit as the history source gives it.
HISTORY = (
    "walk_index bigint, sha string, parent_shas array<string>, author struct<name: string, email: string>, committed_at bigint, "
    "file_changes array<struct<path: string, old_path: string, added: int, deleted: int, change_type: string, blob_sha: string>>"
)


class HistoryError(Exception):
    """What went wrong with a history."""


class SourceError(HistoryError):
    """The source can't be read."""


class StoreError(HistoryError):
    """The store can't be read or written."""


class ConfigError(HistoryError):
    """The settings make no sense."""


@dataclass(frozen=True)
class Config:
    """Settings of ingestion. Where the repository lies and how it is updated isn't part of the hash."""

    path: str = "."
    since: int | None = None
    exclude: tuple[str, ...] = ()
    mechanical_max_files: int | None = None
    incremental: bool = True

    def __post_init__(self) -> None:
        if self.mechanical_max_files is not None and self.mechanical_max_files < 0:
            raise ConfigError("mechanical_max_files can't be negative")

    def hash(self) -> str:
        """FNV-1a over the settings; the order of the excludes doesn't matter. The text form is a fixed value: stores are compared by it."""
        since = "all" if self.since is None else self.since
        most = "off" if self.mechanical_max_files is None else self.mechanical_max_files
        return fnv1a64(f"since={since};exclude=[{''.join(f'{e},' for e in sorted(self.exclude))}];mech_max_files={most};")


@dataclass(frozen=True)
class MetricConfig:
    """Settings of the metrics."""

    windows: tuple[int, int, int] = (30, 90, 365)
    exclude_mechanical: bool = True
    min_support: int = 5
    bus_threshold: float = 0.5
    blame_budget: int = 10_000_000
    hotspot_window: str = field(default="total")

    def hash(self) -> str:
        return fnv1a64(f"windows={self.windows};mech={self.exclude_mechanical};support={self.min_support};bus={self.bus_threshold};budget={self.blame_budget};window={self.hotspot_window};")
