"""Git histories as Spark data sources: commits (batch and stream), blobs and line attributions.

``spark.read.format("git_history").option("path", repo)`` reads commits in partitions of contiguous stretches of the
walk; each task runs ``git log`` for its own. Options: tip (HEAD), hidden (a commit whose ancestors are left out),
partition_commits (512). The repository must be reachable under the same path from every executor.
"""

from __future__ import annotations

import shutil
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..model import HISTORY, SourceError

#: Commits of a partition, and bytes of blobs that a task holds.
STRETCH, BLOB_BYTES = 512, 8 << 20
_FORMAT = "%x1e%H%x1f%P%x1f%aN%x1f%aE%x1f%ct%x00"
_MODES = {"100644", "100755", "120000"}  # files and links; folders and submodules are no files


def git(repo: str, *args: str, data: bytes | None = None) -> bytes:
    if not shutil.which("git"):
        raise SourceError("git isn't installed")
    done = subprocess.run(["git", "-C", repo, "-c", "core.quotepath=off", *args], input=data, capture_output=True)
    if done.returncode:
        raise SourceError(f"git {args[0]} failed: {done.stderr.decode('utf-8', 'replace').strip()[:500]}")
    return done.stdout


def discover(path: str) -> str:
    """The repository's top folder, from any folder inside it."""
    return git(path, "rev-parse", "--show-toplevel").decode().strip()


def head(repo: str) -> str | None:
    """The commit at HEAD; None before the first one."""
    try:
        return git(repo, "rev-parse", "--verify", "--quiet", "HEAD").decode().strip() or None
    except SourceError:
        return None


def walk(repo: str, tip: str | None = None, hidden: str | None = None) -> list[str]:
    """Commits reachable from ``tip`` and not from ``hidden``, the newest first."""
    tip = tip or head(repo)
    if not tip or tip == hidden:
        return []
    return git(repo, "rev-list", tip, *([f"^{hidden}"] if hidden else [])).decode().split()


def _changes(fields: list[bytes]) -> list[tuple]:
    """File changes of one commit from the NUL-separated raw and numstat records of its first-parent diff."""
    raw, lines, i = [], {}, 0
    text = lambda b: b.decode("utf-8", "replace")
    while i < len(fields):
        f = fields[i].lstrip(b"\n")
        if f.startswith(b":"):
            old_mode, new_mode, old_blob, new_blob, status = f[1:].decode().split(" ")
            kind = {"T": "M"}.get(status[0], status[0])
            two = kind in "RC"
            old, new = (text(fields[i + 1]), text(fields[i + 2])) if two else (None, text(fields[i + 1]))
            i += 3 if two else 2
            if (old_mode if kind == "D" else new_mode) in _MODES and kind in "AMDRC":
                raw.append((new, old, kind, old_blob if kind == "D" else new_blob))
        elif f.count(b"\t") >= 2:
            added, deleted, path = f.split(b"\t", 2)
            if not path:
                path = fields[i + 2]
                i += 2
            lines[text(path)] = tuple(0 if n == b"-" else int(n) for n in (added, deleted))
            i += 1
        else:
            i += 1
    return [(p, old, *lines.get(p, (0, 0)), kind, blob) for p, old, kind, blob in raw]


def commits(repo: str, shas: list[str], first: int) -> Iterator[tuple]:
    """Rows of ``HISTORY`` for a stretch of the walk that begins at index ``first``."""
    if not shas:
        return
    out = git(
        repo, "log", "--stdin", "--no-walk=unsorted", f"--format={_FORMAT}", "--diff-merges=first-parent", "--root", "--raw", "--numstat", "-z",
        "-M50%", "-l1000", "--no-abbrev", "--diff-algorithm=histogram", "--no-color", data="\n".join(shas).encode() + b"\n",
    )
    for k, record in enumerate(out.split(b"\x1e")[1:]):
        header, _, rest = record.partition(b"\0")
        sha, parents, name, email, when = header.decode("utf-8", "replace").split("\x1f")
        yield first + k, sha, parents.split(), (name, email), int(when), _changes(rest.split(b"\0"))


class Stretch(InputPartition):
    def __init__(self, first: int, shas: list[str]) -> None:
        self.first, self.shas = first, shas


class GitReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.repo, self.tip, self.hidden = options.get("path", "."), options.get("tip"), options.get("hidden")
        self.stretch = int(options.get("partition_commits", STRETCH))

    def partitions(self) -> list[InputPartition]:
        shas = walk(self.repo, self.tip, self.hidden)
        return [Stretch(at, shas[at : at + self.stretch]) for at in range(0, len(shas), self.stretch)] or [Stretch(0, [])]

    def read(self, partition: Stretch) -> Iterator[tuple]:
        return commits(self.repo, partition.shas, partition.first)


class GitStream(DataSourceStreamReader):
    """Offsets are heads; a batch is what came since the last one, in stretches like a batch read's."""

    def __init__(self, options: dict[str, str]) -> None:
        self.repo, self.start = options.get("path", "."), options.get("hidden") or ""
        self.stretch = int(options.get("partition_commits", STRETCH))

    def initialOffset(self) -> dict:
        return {"head": self.start}

    def latestOffset(self) -> dict:
        return {"head": head(self.repo) or ""}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        shas = walk(self.repo, end["head"], start["head"] or None) if end["head"] else []
        return [Stretch(at, shas[at : at + self.stretch]) for at in range(0, len(shas), self.stretch)] or [Stretch(0, [])]

    def read(self, partition: Stretch) -> Iterator[tuple]:
        return commits(self.repo, partition.shas, partition.first)


class GitHistory(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_history"

    def schema(self) -> str:
        return HISTORY

    def reader(self, schema) -> DataSourceReader:
        return GitReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return GitStream(self.options)


def read_history(spark: SparkSession, repo: str, **options: str) -> DataFrame:
    spark.dataSource.register(GitHistory)
    return spark.read.format("git_history").options(path=repo, **options).load()


def blobs(wanted: DataFrame, repo: str) -> DataFrame:
    """(blob_sha, path, content) of the distinct (blob_sha, path), read one after the other from one ``git cat-file`` a task, and passed on every ``BLOB_BYTES``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with subprocess.Popen(["git", "-C", repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as reader:
            for f in frames:
                rows, held = [], 0
                for sha, path in zip(f["blob_sha"], f["path"], strict=True):
                    reader.stdin.write(f"{sha}\n".encode())
                    reader.stdin.flush()
                    header = reader.stdout.readline().decode().split()
                    if not header:
                        raise SourceError("git cat-file ended early")
                    content = None
                    if header[-1] != "missing":
                        content = reader.stdout.read(int(header[2]))
                        reader.stdout.read(1)
                    rows.append((sha, path, content))
                    held += len(content or b"")
                    if held >= BLOB_BYTES:
                        yield pd.DataFrame(rows, columns=["blob_sha", "path", "content"])
                        rows, held = [], 0
                yield pd.DataFrame(rows, columns=["blob_sha", "path", "content"])
            reader.stdin.close()

    own = wanted.select("blob_sha", "path").distinct()
    return own.mapInPandas(run, "blob_sha string, path string, content binary")


def blame_file(repo: str, path: str, at: str) -> dict[str, int] | None:
    """Lines by commit at ``at``, renames not followed; none for a file that isn't there, None if it fails."""
    try:
        if git(repo, "ls-tree", at, "--", path).split(b" ")[0].decode() not in _MODES:
            return {}
        out: dict[str, int] = {}
        for line in git(repo, "-c", "diff.algorithm=histogram", "blame", "--no-follow", "--incremental", at, "--", path).split(b"\n"):
            part = line.split(b" ")
            if len(part) == 4 and len(part[0]) in (40, 64) and part[1].isdigit():
                out[part[0].decode()] = out.get(part[0].decode(), 0) + int(part[3])
        return out
    except SourceError:
        return None


HUNK_ROWS = "path string, last_sha string, revisions bigint, failed boolean, commit_sha string, lines int"


def blame(files: DataFrame, repo: str, at: str, tasks: int | None = None) -> DataFrame:
    """Hunks of (path, last_sha, revisions[, cost]); an empty file has one row without a commit, a failed one one marked so.

    Costly files are spread over the tasks and begun first.
    """

    framed = lambda rows: pd.DataFrame(rows, columns=["path", "last_sha", "revisions", "failed", "commit_sha", "lines"]).astype({"lines": "Int32", "revisions": "int64"})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for p, s, r in zip(f["path"], f["last_sha"], f["revisions"], strict=True):
                lines = blame_file(repo, p, at)
                own = [(None, None)] if not lines else list(lines.items())
                rows += [(p, s, r, lines is None, c, n) for c, n in own]
                if len(rows) >= 50_000:
                    yield framed(rows)
                    rows = []
            yield framed(rows)

    own = files.repartition(tasks or files.sparkSession.sparkContext.defaultParallelism, "path")
    own = own.sortWithinPartitions(*([own["cost"].desc()] if "cost" in files.columns else []), "path")
    return own.select("path", "last_sha", "revisions").mapInPandas(run, HUNK_ROWS)
