"""Quality rules (op 6): an isolation forest on rule statistics.

Base rules come first; the rest is judged by the forest: trees of random splits, each of its own draw from the rule
statistics of all rows, give each document a path length, short paths mean anomalous documents, and the threshold is
calibrated from all labelled rows, so that at most a set share of the rows labelled good fall to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WordHashes, bytes_of, chunks, discard, mix, small_batches, starts_of, sums_by_row, table, written

WINDOW = 8
MIN_WORDS, REPEAT_PERCENT = 20, 30
TREES, TREE_ROWS = 200, 256
#: Share of rows labelled good that may fall to the threshold at most.
LOST_GOOD = 0.01
SEED = 7

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
#: Rule statistics that the forest sees; repeats are left to the base rules.
RATES = ("word_length", "symbol_rate", "upper_rate", "digit_rate", "punct_rate", "line_length", "distinct_rate")

_FIELDS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64())] + [(r, pa.float64()) for r in RATES]


def _member(values: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=np.int64)
    out[list(values)] = 1
    return out


_SYMBOL, _SPACE = _member(SYMBOLS), _member(SPACES)
_UPPER, _DIGIT = _member(bytes(range(65, 91))), _member(bytes(range(48, 58)))
_PUNCT = _member(bytes(b for b in range(33, 127) if not chr(b).isalnum()))
_CHAR = np.array([0 if 0x80 <= b < 0xC0 else 1 for b in range(256)], dtype=np.int64)
_STATS = [_SYMBOL, _CHAR * (1 - _SPACE), _UPPER, _DIGIT, _PUNCT]


def statistics(docs: DataFrame, columns: list[str], window: int = WINDOW) -> DataFrame:
    """``columns`` of ``docs`` with the rule statistics of every whole text; zeros for null and empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in chunks(batches):
            texts = [t or b"" for t in bytes_of(batch.column("text"))]
            by_byte = np.stack([np.bincount(np.frombuffer(t, dtype=np.uint8), minlength=256) for t in texts])
            symbols, chars, upper, digit, punct = (by_byte @ s for s in _STATS)
            flat: list[int] = []
            lengths, dup, lines = [], [], []
            for t in texts:
                words = t.split()
                lengths.append(len(words))
                flat += map(hashes.__getitem__, words)
                own = [x for x in t.split(b"\n") if x and not x.isspace()]
                lines.append(len(own))
                dup.append(len(own) - len(set(own)))
            bounds = starts_of(np.array(lengths, dtype=np.int64))
            n_words = np.diff(bounds)
            h = np.array(flat, dtype=np.uint64)
            doc = np.repeat(np.arange(len(texts), dtype=np.uint64), n_words)
            repeats = _repeated(h, doc, bounds, window)
            uniq = np.unique(mix(h) ^ mix(doc + np.uint64(1)), return_index=True)[1] if len(h) else np.zeros(0, dtype=np.int64)
            distinct = np.bincount(doc[uniq].astype(np.int64), minlength=len(texts))
            w, c = np.maximum(n_words, 1), np.maximum(chars, 1)
            rates = [chars / w, symbols / w, upper / c, digit / c, punct / c, np.minimum(n_words / np.maximum(lines, 1), 400), distinct / w / _expected_distinct(n_words)]
            values = [n_words, chars, symbols, np.array(dup), repeats, *rates]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *(pa.array(np.asarray(v), t) for v, (_, t) in zip(values, _FIELDS, strict=True))], names=[*columns, *(n for n, _ in _FIELDS)])

    small_batches(docs.sparkSession)
    out = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns), *(f"{n} {'bigint' if t == pa.int64() else 'double'}" for n, t in _FIELDS)])
    return docs.select(*columns, *(["text"] if "text" not in columns else [])).mapInArrow(run, out)


def _expected_distinct(n: np.ndarray) -> np.ndarray:
    """Texts repeat more words the longer they are: the share falls about as this power."""
    return np.maximum(n, 1.0) ** -0.12


def _repeated(h: np.ndarray, doc: np.ndarray, bounds: np.ndarray, window: int) -> np.ndarray:
    """Words of each text inside windows that the text has at least twice."""
    n = len(h) - window + 1
    if n <= 0:
        return np.zeros(len(bounds) - 1, dtype=np.int64)
    key = np.zeros(n, dtype=np.uint64)
    for i in range(window):
        key = key * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    key = mix(key) ^ mix(doc[:n] + np.uint64(1))
    at = np.flatnonzero(doc[:n] == doc[window - 1 :])
    own = key[at]
    order = np.argsort(own, kind="stable")
    sorted_key = own[order]
    same = sorted_key[1:] == sorted_key[:-1]
    twice = at[order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]] if len(at) else at
    marks = np.zeros(len(h) + 1, dtype=np.int64)
    np.add.at(marks, twice, 1)
    np.add.at(marks, twice + window, -1)
    return sums_by_row((np.cumsum(marks[:-1]) > 0).astype(np.int64), bounds)


def _harmonic(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def draws(n: int, trees: int = TREES, rows: int = TREE_ROWS, seed: int = SEED) -> np.ndarray:
    """For each tree the numbers of its rows among all ``n``, each row as likely as any other."""
    rng = np.random.Generator(np.random.PCG64(seed))
    return np.stack([rng.choice(n, min(rows, n), replace=False) for _ in range(trees)]) if n else np.zeros((trees, 0), dtype=np.int64)


class IsolationForest:
    """Trees as arrays: feature (-1 in leaves), split value, children, and the path length at leaves.

    ``x``: all rows, or by ``drawn`` the rows of each tree.
    """

    def __init__(self, x: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = SEED, drawn: np.ndarray | None = None) -> None:
        drawn = draws(len(x), trees, rows, seed) if drawn is None else drawn
        rng = np.random.Generator(np.random.PCG64([seed, 1]))
        self.rows = drawn.shape[1]
        self.trees = [self._grow(x[own], rng) for own in drawn] if self.rows else []

    def _grow(self, x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        limit = int(np.ceil(np.log2(max(len(x), 2))))
        feature, value, left, right, length = [-1], [0.0], [0], [0], [0.0]
        todo = [(0, np.arange(len(x)), 0)]
        while todo:
            node, own, depth = todo.pop()
            low, high = x[own].min(axis=0), x[own].max(axis=0)
            able = np.flatnonzero(high > low)
            if depth >= limit or len(own) <= 1 or not len(able):
                length[node] = depth + float(_harmonic(len(own)))
                continue
            f = int(rng.choice(able))
            v = float(rng.uniform(low[f], high[f]))
            below = x[own, f] < v
            feature[node], value[node], left[node], right[node] = f, v, len(feature), len(feature) + 1
            for part in (own[below], own[~below]):
                for a, e in ((feature, -1), (value, 0.0), (left, 0), (right, 0), (length, 0.0)):
                    a.append(e)
                todo.append((len(feature) - 1, part, depth + 1))
        return tuple(np.array(a) for a in (feature, value, left, right, length))

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** -(mean path length / its expectation): near 1 for anomalies, 0 for no trees."""
        if not self.trees:
            return np.zeros(len(x))
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, value, left, right, length in self.trees:
            node, live = np.zeros(len(x), dtype=np.int64), rows
            while len(live := live[feature[node[live]] >= 0]):
                at = node[live]
                node[live] = np.where(x[live, feature[at]] < value[at], left[at], right[at])
            total += length[node]
        return 2.0 ** (-(total / len(self.trees)) / max(float(_harmonic(self.rows)), 1e-9))


def calibrate(scores: np.ndarray, good: np.ndarray, lost_good: float = LOST_GOOD) -> float:
    """Highest score to keep: of the scores that lose at most ``lost_good`` of the good rows, the one that errs least on both kinds of rows.

    Without good rows nothing is rejected, without bad ones nothing that was labelled good.
    """
    own, bad = np.sort(scores[good]), np.sort(scores[~good])
    if not len(own):
        return np.inf
    at = np.unique(np.concatenate([own, bad]))
    lost = 1 - np.searchsorted(own, at, side="right") / len(own)
    kept_bad = np.searchsorted(bad, at, side="right") / max(1, len(bad))
    able = lost <= lost_good
    at, cost = at[able], (lost + kept_bad)[able]
    best = int(len(cost) - 1 - cost[::-1].argmin())
    return float((at[best] + at[best + 1]) / 2 if best + 1 < len(at) else at[best])


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def grown(stats: DataFrame) -> IsolationForest:
    """The forest of all rows of ``stats``: they are sorted and numbered by Spark, and the driver fetches those that a tree draws, at most ``TREES * TREE_ROWS``."""
    order = [F.col(r) for r in reversed(RATES)]
    rows = written(stats.select(*RATES).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "quality-order")
    parts = sorted((r.part, r.k) for r in rows.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("k")).collect())
    begins = starts_of(np.array([k for _, k in parts], dtype=np.int64))
    drawn = draws(int(begins[-1]))
    ranks, own = np.unique(drawn, return_inverse=True)
    part = np.searchsorted(begins, ranks, side="right") - 1
    at = (np.array([p for p, _ in parts], dtype=np.int64)[part] << 33) + ranks - begins[part] if len(ranks) else ranks
    wanted = stats.sparkSession.createDataFrame(pa.table({"at": pa.array(at, pa.int64())}))
    fetched = sorted(tuple(r) for r in rows.join(F.broadcast(wanted), "at").select("at", *RATES).toLocalIterator())
    x = np.array([r[1:] for r in fetched], dtype=float).reshape(-1, len(RATES))
    forest = IsolationForest(x, drawn=own.reshape(drawn.shape))
    discard(rows)
    return forest


def threshold_of(scores: DataFrame, lost_good: float = LOST_GOOD) -> float:
    """``calibrate`` of all rows of ``scores`` (quality, anomaly), with the running counts made in ranges of scores."""
    good, bad = F.count_if(F.col("quality") == 1), F.count_if(F.col("quality") != 1)
    counts = scores.groupBy("anomaly").agg(good.alias("good"), bad.alias("bad"))
    counts = written(counts.repartitionByRange("anomaly").withColumn("part", F.spark_partition_id()), "quality-labelled")
    parts = sorted(tuple(r) for r in counts.groupBy("part").agg(F.sum("good"), F.sum("bad")).collect())
    n_good, n_bad = sum(g for _, g, _ in parts), sum(b for _, _, b in parts)
    best = np.inf
    if n_good:
        ends = starts_of(np.array([g for _, g, _ in parts])), starts_of(np.array([b for _, _, b in parts]))
        before = scores.sparkSession.createDataFrame([(p, int(g), int(b)) for (p, _, _), g, b in zip(parts, *(e[:-1] for e in ends), strict=True)], "part int, good_before bigint, bad_before bigint")
        upto = Window.partitionBy("part").orderBy("anomaly")
        lost = F.lit(1.0) - (F.col("good_before") + F.sum("good").over(upto)) / F.lit(float(n_good))
        kept_bad = (F.col("bad_before") + F.sum("bad").over(upto)) / F.lit(float(max(1, n_bad)))
        able = counts.join(F.broadcast(before), "part").select("anomaly", lost.alias("lost"), (lost + kept_bad).alias("cost")).where(F.col("lost") <= lost_good)
        best = -able.agg(F.min(F.struct("cost", (-F.col("anomaly")).alias("at"))).alias("best")).first().best.at
        following = counts.where(F.col("anomaly") > best).agg(F.min("anomaly")).first()[0]
        best = best if following is None else (best + following) / 2
    discard(counts)
    return float(best)


def judge(docs: DataFrame, labels: DataFrame, lost_good: float = LOST_GOOD) -> DataFrame:
    """Per row of ``docs``: doc_id, the rule statistics, base_failed, anomaly, kept.

    Null and empty texts have no words and fail the base rules. Labels with null ids or qualities teach nothing, the
    worst of a document's labels counts; where no good row is labelled the forest rejects nothing. Texts are read whole,
    however long. Repeated rows are judged one by one, an empty table gives no row; other columns are ignored.
    """
    spark = docs.sparkSession
    stats = written(statistics(docs, ["doc_id"]), "quality-statistics")
    shared = spark.sparkContext.broadcast(grown(stats.where(~base_failed())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(r).to_numpy(zero_copy_only=False) for r in RATES], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.score(x), pa.float64())], names=[*batch.schema.names, "anomaly"])

    scored = stats.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stats.schema) + ", anomaly double")
    scored = written(scored.withColumn("base_failed", base_failed()), "quality-verdicts")
    discard(stats)
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    threshold = threshold_of(scored.where("not base_failed").join(known, "doc_id").select("quality", "anomaly"), lost_good)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= threshold))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return docs.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
