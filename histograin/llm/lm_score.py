"""LM scoring (op 2): stupid-backoff scores from n-gram count tables.

The count tables are partitioned by n-gram hash and joined to the documents' n-grams. A row of either side stands for
many n-grams, as one row for each would be ten times the text: hashes lie in it sorted, as packed differences.

1. a run of documents becomes a row: its vocabulary (sorted word hashes) and its words as numbers into it;
2. for one order after the other, a run's distinct n-grams, counted, go to the partitions of their hashes;
3. a partition adds the runs' counts to its part of the count table and joins the totals to what each run has sent
   (or joins the part of a table that was written before, to score documents by another corpus);
4. runs meet their totals, every word takes the longest n-gram that the table keeps, and documents are summed.

Corpora that need more than ``FAN`` partitions pass what they send through two exchanges each way, first to groups of
partitions and then to those, in which rows of many runs are bundled anew: a row is dealt to about the square root of
the partitions, and rows grow with the text, not with its square.

Counts are over all documents, the scored one included. ``min_count`` above 1 leaves rarer n-grams of two and more
words out of the table, so that they back off.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, chunks, discard, hashed_words, mix, release, small_batches, starts_of, table, written

ORDER, MIN_COUNT, BACKOFF = 3, 1, 0.4
#: Bytes of text in a run, and for each partition of the count tables.
RUN_BYTES, PARTITION_BYTES = 8 << 20, 16 << 20
#: Partitions up to which a run's rows go to them at once.
FAN = 1024
#: Bytes of packed rows that a bundle is made of.
BUNDLE_BYTES = 8 << 20

#: A run's rows are large: the writer shall look at its size after each.
_WRITER = {"compression": "zstd", "parquet.block.size": str(8 << 20), "parquet.block.row.count.limit": "2", "parquet.enable.dictionary": "false"}


def pack(x: np.ndarray) -> bytes:
    """64-bit integers byte by byte of all of them, without the upper bytes that none has; this compresses well."""
    x = np.ascontiguousarray(x).view(np.uint64)
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([width]) + np.ascontiguousarray(x.view(np.uint8).reshape(len(x), 8).T[:width]).tobytes()


def unpack(b: bytes) -> np.ndarray:
    planes = np.frombuffer(b, dtype=np.uint8, offset=1).reshape(b[0], -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, : b[0]] = planes.T
    return out.view(np.uint64).ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=np.zeros(1, dtype=np.uint64)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b), dtype=np.uint64)


def grams(vocabulary: np.ndarray, words: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a run's documents: the last word's place and the hash of every n-gram."""
    h, lengths = vocabulary[words], np.diff(bounds)
    if n == 1:
        return np.arange(len(h), dtype=np.int32), h
    key = h
    for k in range(2, n + 1):
        key = mix(np.roll(key, 1) + h * np.uint64(2 * k + 1))
    place = np.arange(len(h), dtype=np.int32) - np.repeat(bounds[:-1], lengths).astype(np.int32)
    ends = np.flatnonzero(place >= n - 1).astype(np.int32)
    return ends, key[ends]


def partition_of(hashes: np.ndarray, partitions: int) -> np.ndarray:
    """Partitions are ranges of hashes: those of sorted hashes follow one another."""
    return ((hashes >> np.uint64(32)).astype(np.int64) * partitions) >> 32


def bundles(to: np.ndarray, of: np.ndarray, lengths: np.ndarray, items: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Sections of ``items`` (their owners ``of``, their ``lengths``) dealt by ``to`` of each item: (place, owners, lengths, items) of each place."""
    if not len(to):
        return
    section = np.repeat(np.arange(len(of), dtype=np.int32), lengths)
    if (np.diff(to) < 0).any():
        order = np.argsort(to, kind="stable")
        to, section, items = to[order], section[order], [x[order] for x in items]
    turn = np.diff(to) != 0
    cuts = np.concatenate([[0], np.flatnonzero(turn | (np.diff(section) != 0)) + 1])
    sizes = np.diff(np.append(cuts, len(to)))
    rows = np.concatenate([[0], np.searchsorted(cuts, np.flatnonzero(turn) + 1), [len(cuts)]])
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        begin, end = cuts[a], cuts[b] if b < len(cuts) else len(to)
        yield int(to[begin]), of[section[cuts[a:b]]], sizes[a:b], [x[begin:end] for x in items]


def _rows(found: Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]], names: list[str], packers: list) -> Iterator[pa.RecordBatch]:
    """Arrow rows of ``bundles``: place, owners, lengths, then packed items."""
    held: list[list] = []
    for place, of, lengths, items in found:
        held.append([place, of.astype(np.int64).tobytes(), lengths.astype(np.int32).tobytes(), *(p(x) for p, x in zip(packers, items, strict=True))])
        if len(held) == 64:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*held, strict=True)], names=names)
            held.clear()
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*held, strict=True)], names=names)


def _sections(batch: pa.RecordBatch | pa.Table, names: list[str], unpackers: list) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """What ``_rows`` packed, of all rows: owners, lengths, items."""
    raw = lambda c, kind: np.concatenate([np.zeros(0, dtype=kind), *(np.frombuffer(b, dtype=kind) for b in batch.column(c).to_pylist())])
    items = [np.concatenate([np.zeros(0, dtype=np.uint64), *(u(b) for b in batch.column(c).to_pylist())]) for c, u in zip(names[2:], unpackers, strict=True)]
    return raw(names[0], np.int64), raw(names[1], np.int32), items


_SENT, _SENT_SCHEMA = ["part", "runs", "lengths", "hashes", "counts"], "part bigint, runs binary, lengths binary, hashes binary, counts binary"
_ANSWERED, _ANSWERED_SCHEMA = ["run", "parts", "lengths", "totals"], "run bigint, parts binary, lengths binary, totals binary"
_BUNDLED, _BUNDLED_SCHEMA = ["group", "runs", "lengths", "totals"], "group bigint, runs binary, lengths binary, totals binary"
_TABLE_SCHEMA = "part bigint, hashes binary, totals binary"


def _localized(docs: DataFrame, run_bytes: int) -> DataFrame:
    """Runs of documents, written: run, doc_ids, lengths, vocabulary, words, n."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def localize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, part, k = WordHashes(), TaskContext.get().partitionId(), 0
        for batch in chunks(batches, limit=run_bytes):
            h, lengths = hashed_words(batch.column("text"), hashes)
            vocabulary, words = np.unique(h, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part << 32 | k]),
                    pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("doc_id")),
                    pa.array([pack(lengths)], pa.binary()),
                    pa.array([pack_sorted(vocabulary)], pa.binary()),
                    pa.array([pack(words)], pa.binary()),
                    pa.array([len(words)]),
                ],
                names=["run", "doc_ids", "lengths", "vocabulary", "words", "n"],
            )
            k += 1

    schema = f"run bigint, doc_ids array<{key}>, lengths binary, vocabulary binary, words binary, n bigint"
    return written(docs.select("doc_id", "text").mapInArrow(localize, schema), "lm-runs", **_WRITER)


def _unfold(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return unpack_sorted(row["vocabulary"]), unpack(row["words"]).astype(np.int32), starts_of(unpack(row["lengths"]).astype(np.int64))


def places(partitions: int, fan: int) -> int:
    """Where rows go first: to the partitions themselves, or beyond ``fan`` of them to as many groups as each group then has partitions, ``fan`` at least."""
    return partitions if partitions <= fan else max(fan, math.isqrt(partitions - 1) + 1)


def _sent(runs: DataFrame, n: int, partitions: int, fan: int) -> DataFrame:
    """The runs' distinct n-grams, counted, in rows for the partitions of their hashes."""
    coarse = places(partitions, fan)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                hashes, counts = np.unique(grams(*_unfold(row), n)[1], return_counts=True)
                own = bundles(partition_of(hashes, partitions) * coarse // partitions, np.array([row["run"]]), np.array([len(hashes)]), [hashes, counts])
                yield from _rows(own, _SENT, [pack_sorted, pack])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "hashes", BUNDLE_BYTES):
            of, lengths, items = _sections(batch, _SENT[1:], [unpack_sorted, unpack])
            yield from _rows(bundles(partition_of(items[0], partitions), of, lengths, items), _SENT, [pack_sorted, pack])

    out = runs.select("run", "lengths", "vocabulary", "words").mapInArrow(explode, _SENT_SCHEMA)
    return out if partitions <= fan else out.repartition("part").mapInArrow(deal, _SENT_SCHEMA)


def _answers(part: int, of: np.ndarray, lengths: np.ndarray, totals: np.ndarray, partitions: int, fan: int) -> pa.Table:
    """Totals of what the runs ``of`` have sent to a partition, in rows for the runs (or, bundled, for groups of them)."""
    if partitions <= fan:
        return pa.Table.from_batches(list(_rows(bundles(np.repeat(of, lengths), np.full(len(of), part), lengths, [totals]), _ANSWERED, [pack])))
    rows = _rows(bundles(np.repeat(_hashed(of, places(partitions, fan)), lengths), of, lengths, [totals]), _BUNDLED, [pack])
    return pa.Table.from_batches([r.append_column("part", pa.array([part] * r.num_rows, pa.int64())) for r in rows])


def _returned(answers: DataFrame, partitions: int, fan: int) -> DataFrame:
    """Answers in rows for the runs."""

    def return_to(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "totals", BUNDLE_BYTES):
            of, lengths, (totals,) = _sections(batch, _BUNDLED[1:], [unpack])
            parts = np.repeat(batch.column("part").to_numpy(), [len(b) // 8 for b in batch.column("runs").to_pylist()])
            yield from _rows(bundles(np.repeat(of, lengths), parts, lengths, [totals]), _ANSWERED, [pack])

    return answers if partitions <= fan else answers.repartition("group").mapInArrow(return_to, _ANSWERED_SCHEMA)


def _counted(runs: DataFrame, n: int, partitions: int, fan: int, table: str | None, held: list[DataFrame]) -> DataFrame:
    """Counts and joins in one pass: a partition adds up its part of the table of order n and answers the runs from it. With ``table``, the part is written there too, by way of a frame that is added to ``held``."""
    schema = (_ANSWERED_SCHEMA if partitions <= fan else f"{_BUNDLED_SCHEMA}, part bigint") + ", hashes binary" * (table is not None)

    def add_up(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        of, lengths, (hashes, counts) = _sections(group, _SENT[1:], [unpack_sorted, unpack])
        distinct, number = np.unique(hashes, return_inverse=True)
        sums = np.zeros(len(distinct), dtype=np.int64)
        np.add.at(sums, number, counts.view(np.int64))
        out = _answers(part, of, lengths, sums[number], partitions, fan)
        if table is None:
            return out
        out = out.append_column("hashes", pa.nulls(out.num_rows, pa.binary()))
        own = {"run": None, "group": None, "runs": b"", "parts": np.array([part], dtype=np.int64).tobytes(), "part": part, "lengths": b"", "totals": pack(sums), "hashes": pack_sorted(distinct)}
        return pa.concat_tables([out, pa.Table.from_pylist([{f.name: own[f.name] for f in out.schema}], schema=out.schema)])

    answers = _sent(runs, n, partitions, fan).groupBy("part").applyInArrow(add_up, schema)
    if table is None:
        return _returned(answers, partitions, fan)
    both = written(answers, f"lm-counted-{n}", compression="zstd")
    held.append(both)
    part = F.col("part") if partitions > fan else F.conv(F.hex(F.reverse("parts")), 16, 10).cast("bigint")
    both.where("hashes IS NOT NULL").select(part.alias("part"), "hashes", "totals").write.parquet(f"{table}/order={n}")
    return _returned(both.where("hashes IS NULL").drop("hashes"), partitions, fan)


def _joined(runs: DataFrame, n: int, partitions: int, fan: int, table: DataFrame) -> DataFrame:
    """The runs' n-grams joined to a count table by the partitions of their hashes; those that it lacks have the total 0."""

    def look_up(sent: pa.Table, rows: pa.Table) -> pa.Table:
        if not sent.num_rows:
            return pa.schema([(f, pa.int64() if f in ("run", "group", "part") else pa.binary()) for f in (_ANSWERED if partitions <= fan else [*_BUNDLED, "part"])]).empty_table()
        of, lengths, (hashes, _) = _sections(sent, _SENT[1:], [unpack_sorted, unpack])
        totals = np.zeros(len(hashes), dtype=np.int64)
        for own in rows.to_pylist():
            known, sums = unpack_sorted(own["hashes"]), unpack(own["totals"]).view(np.int64)
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            totals += np.where(known[at] == hashes, sums[at], 0)
        return _answers(sent.column("part")[0].as_py(), of, lengths, totals, partitions, fan)

    schema = _ANSWERED_SCHEMA if partitions <= fan else f"{_BUNDLED_SCHEMA}, part bigint"
    return _returned(_sent(runs, n, partitions, fan).groupBy("part").cogroup(table.groupBy("part")).applyInArrow(look_up, schema), partitions, fan)


def score(docs: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT, backoff: float = BACKOFF, run_bytes: int = RUN_BYTES, partition_bytes: int = PARTITION_BYTES, fan: int = FAN, tables: str | None = None, by: str | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, log_score (natural logarithm, summed over the words), mean_log_score.

    Words: A-Z lower-cased, split at space and \\t-\\r. A word w after the words c has count(c w) / count(c) if the table
    has c w, else ``backoff`` times the value for the shorter context; without context count(w) / words of the corpus.
    Null, empty and blank texts have no words, 0 and a null mean; a text above ``run_bytes`` is a run of its own. An
    empty table gives no row. Repeated rows are counted and scored each, rows that share a doc_id too; a null doc_id
    stays null. Other columns are ignored.

    The corpus is ``docs`` itself. ``tables``: a folder to which its count tables are written, as Parquet partitioned by
    n-gram hash; ``by``: one from which another corpus's tables are read instead, of at least ``order`` orders. A word
    that this corpus lacks counts as if it had it once.
    """
    spark = docs.sparkSession
    small_batches(spark)
    key = docs.schema["doc_id"].dataType.simpleString()
    runs = _localized(docs, run_bytes)
    if by is None:
        total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        partitions, corpus = max(1, -(-total // partition_bytes)), runs.agg(F.sum("n")).first()[0] or 0
        if tables:
            spark.createDataFrame([(partitions, corpus)], "partitions bigint, words bigint").coalesce(1).write.parquet(f"{tables}/corpus")
    else:
        partitions, corpus = spark.read.parquet(f"{by}/corpus").first()
    totals, held = [], []
    for n in range(1, order + 1):
        if by is None:
            own = _counted(runs, n, partitions, fan, tables, held)
        else:
            own = _joined(runs, n, partitions, fan, spark.read.schema(_TABLE_SCHEMA).parquet(f"{by}/order={n}"))
        totals.append(written(own.withColumn("n", F.lit(n)), f"lm-totals-{n}", compression="zstd"))
        release(spark)

    def sum_up(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[pa.Table] = []
        for i in range(left.num_rows):
            row = left.slice(i, 1).to_pylist()[0]
            vocabulary, words, bounds = _unfold(row)
            n_words, value, shorter = np.diff(bounds), np.zeros(len(words)), np.zeros(0)
            for n in range(1, order + 1):
                mine = right.filter(pc.equal(right.column("n"), n))
                parts, lengths, (totals,) = _sections(mine, _ANSWERED[1:], [unpack])
                if (np.diff(parts) < 0).any():  # hashes ascend with the partitions
                    at = starts_of(lengths.astype(np.int64))
                    totals = np.concatenate([totals[at[k] : at[k + 1]] for k in np.argsort(parts, kind="stable")])
                ends, hashes = grams(vocabulary, words, bounds, n)
                count = totals.view(np.int64)[np.unique(hashes, return_inverse=True)[1]] if len(hashes) else np.zeros(0, dtype=np.int64)
                longer = np.zeros(len(words), dtype=np.int64)  # count of the n-gram that ends at each word
                longer[ends] = count
                if n == 1:
                    value = np.log(np.maximum(longer, 1) / max(1, corpus))
                else:
                    value[ends] += np.log(backoff)
                    kept = count >= max(1, min_count)
                    at = ends[kept]
                    value[at] = np.log(count[kept] / shorter[at - 1])
                shorter = longer
            sums = np.zeros(len(n_words))
            some = np.flatnonzero(n_words)
            if len(some):
                sums[some] = np.add.reduceat(value, bounds[some])
            ids = left.slice(i, 1).column("doc_ids").combine_chunks().flatten()
            out.append(pa.table({"doc_id": ids, "n_words": pa.array(n_words, pa.int64()), "log_score": pa.array(sums), "mean_log_score": pa.array(sums / np.maximum(n_words, 1), mask=n_words == 0)}))
        empty = pa.schema([("doc_id", left.schema.field("doc_ids").type.value_type), ("n_words", pa.int64()), ("log_score", pa.float64()), ("mean_log_score", pa.float64())]).empty_table()
        return pa.concat_tables(out) if out else empty

    own, answers = runs.select("run", "doc_ids", "lengths", "vocabulary", "words"), reduce(DataFrame.unionByName, totals)
    out = own.groupBy("run").cogroup(answers.groupBy("run")).applyInArrow(sum_up, f"doc_id {key}, n_words bigint, log_score double, mean_log_score double")
    scored = written(out, "lm-scores")
    for done in (runs, *totals, *held):
        discard(done)
    return scored


def _hashed(x: np.ndarray, n: int) -> np.ndarray:
    return (mix(x.astype(np.int64).view(np.uint64)) % np.uint64(n)).astype(np.int64)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", F.round("log_score", 6).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT r, i, w[i] AS c, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS a
      FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
c1 AS (SELECT c AS word, count(*) AS n FROM p GROUP BY c),
c2 AS (SELECT b, c, count(*) AS n FROM p WHERE b IS NOT NULL GROUP BY b, c),
c3 AS (SELECT a, b, c, count(*) AS n FROM p WHERE a IS NOT NULL GROUP BY a, b, c),
t AS (SELECT count(*) AS n FROM p),
v AS (SELECT p.r, CASE WHEN p.a IS NOT NULL THEN ln(c3.n / CAST(ab.n AS DOUBLE))
                       WHEN p.b IS NOT NULL THEN ln(bc.n / CAST(c1.n AS DOUBLE))
                       ELSE ln(cc.n / CAST(t.n AS DOUBLE)) END AS v
      FROM p CROSS JOIN t JOIN c1 cc ON cc.word = p.c LEFT JOIN c1 ON c1.word = p.b LEFT JOIN c2 bc ON bc.b = p.b AND bc.c = p.c
      LEFT JOIN c2 ab ON ab.b = p.a AND ab.c = p.b LEFT JOIN c3 ON c3.a = p.a AND c3.b = p.b AND c3.c = p.c),
s AS (SELECT r, sum(v) AS s FROM v GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, round(coalesce(s, 0.0), 6) AS log_score,
       CASE WHEN len(w) > 0 THEN round(s / len(w), 6) END AS mean_log_score
FROM d LEFT JOIN s USING (r)
"""
