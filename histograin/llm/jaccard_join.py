"""N-gram Jaccard join (op 7): blocked sparse product of the document by n-gram incidence matrix.

Rows are documents, columns their distinct 4-word shingles. Two rows of sizes a and b whose Jaccard is at least t
differ in at most (a + b)(1 - t)/(1 + t) columns and have sizes within a factor t. From this bound come

1. the column blocks: rows of a size band share one partition of the columns into more blocks than linked rows can
   differ in, so linked rows agree completely in some block (each row also joins the next band, so that a pair in
   neighbouring bands meets). Blocks in which a row has few columns are too weak to tell rows apart; a row leaves out
   all blocks of up to so many columns as it has blocks to spare for (by its own size). Of two linked rows the one that
   leaves out more agrees with the other in a block that both list, so no pair is lost. Empty blocks say nothing and are
   never listed: a row with more of them than it has to spare lists its blocks of another partition besides, so that
   two such rows meet there (after ``SALTS`` partitions, which no row gets to by chance, also the empty ones);
2. the row blocks: rows that agree in a column block are joined to the smallest of them, a star and never all pairs;
   the connected rows form a cluster. A cluster above ``ROWS`` rows is dealt into hashed row blocks. Each block is first
   held against ``STARS`` rows of the cluster: what hangs together with most of it needs no more links among
   itself. The columns of all its rows are then counted, and the cluster joined anew by the rarest columns of each row:
   linked rows share one of these, and unrelated rows that passages chain together part. In what still hangs together,
   the rows that are not linked yet meet every row block. No row is dropped, and a task never holds more than two;
3. inside the product, column postings accumulate the overlap counts of one row against all earlier rows, and pairs
   below the size-derived overlap are discarded. A task returns a spanning forest of its links, not the pairs.

Equal sets are one row of the matrix throughout. Components of the links give the classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WordHashes, chunks, components, discard, hashed_words, mix, release, small_batches, starts_of, table, written

SHINGLE, NUM, DEN = 4, 85, 100
#: Bytes of text that are cut into shingles at once.
CHUNK = 4 << 20
#: Rows in a row block, and shingles in all of them; a task multiplies two of them.
ROWS, COLUMNS = 1500, 1 << 20
#: Rows of a large cluster that all others are held against first.
STARS = 48
#: Partitions of the columns that a row with too many empty blocks tries; distinct rows whose keys a task has sent.
SALTS, SEEN = 12, 100_000
#: Bits of the fixed-size filter that spares unclustered texts the second pass; a full filter only spares fewer.
FILTER_BITS = 1 << 23

_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


class Bands:
    """Size bands and the number of column blocks of each, for the threshold num/den."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den, self.tops, self.blocks = num, den, [], []

    def of(self, n: int) -> int:
        while not self.tops or self.tops[-1] < n:
            low = self.tops[-1] + 1 if self.tops else 1
            top = max(low, low * self.den // self.num)
            differ = 2 * top * (self.den - self.num) // (self.den + self.num)
            self.tops.append(top)
            self.blocks.append(1 + differ + 1 + differ * 3 // 20)
        return int(np.searchsorted(self.tops, n))

    def spare(self, band: int, n: int) -> int:
        """Blocks of a row of n columns that it need not list: it agrees with any row linked with it in more blocks than these."""
        partner = min(self.tops[band], n * self.den // self.num)
        return self.blocks[band] - 1 - (n + partner) * (self.den - self.num) // (self.den + self.num)


class Shingles:
    """Sorted distinct shingle hashes of texts, the same in every process (64 bits of word and shingle hashes)."""

    def __init__(self, k: int) -> None:
        self.k, self.words = k, WordHashes()

    def sets(self, texts: pa.Array) -> list[np.ndarray]:
        out = []
        h, lengths = hashed_words(texts, self.words)
        bounds = starts_of(lengths)
        n = max(0, len(h) - self.k + 1)
        grams = np.zeros(n, dtype=np.uint64)
        for i in range(self.k):
            grams += h[i : i + n] * _K[i % len(_K)] ^ np.uint64(i)
        grams = mix(grams)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= self.k:
                out.append(np.unique(grams[a : b - self.k + 1]))
            elif b > a:
                out.append(np.array([xxhash.xxh3_64_intdigest(h[a:b].tobytes(), seed=b - a)], dtype=np.uint64))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
        return out


def digest(rows: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(rows.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def block_keys(rows: np.ndarray, bands: Bands) -> np.ndarray:
    """One 64-bit key for each column block that the row lists, in its own band and in the next."""
    n = len(rows)
    if n * bands.den < (n + 1) * bands.num:  # any other set falls below the threshold
        return np.zeros(0, dtype=np.uint64)
    own, keys = bands.of(n), []
    bands.of(bands.tops[own] + 1)
    for band in (own, own + 1):
        m, spare = bands.blocks[band], bands.spare(band, n)
        for salt in range(SALTS):
            spread = mix(rows ^ _K[3] ^ np.uint64(salt << 56))
            at = (spread >> np.uint64(32)).astype(np.int64) * m >> 32
            size = np.bincount(at, minlength=m)
            order = np.argsort(at, kind="stable")
            total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(spread[order], dtype=np.uint64)])
            ends = np.cumsum(size)
            block = mix((total[ends] - total[ends - size]) ^ mix(np.arange(m, dtype=np.uint64) + np.uint64((salt << 56) + (band << 32))))
            upto = np.cumsum(np.bincount(size))  # blocks of at most so many columns
            least = int(np.searchsorted(upto, spare, side="right"))
            if least:
                keys.append(block[size >= least])
                break
            keys.append(block if salt == SALTS - 1 else block[size > 0])
    return np.concatenate(keys)


def _product(frames: pd.DataFrame, num: int, den: int, left: np.ndarray | None = None, among: bool = True) -> list[tuple[int, int]]:
    """Spanning forest (as row numbers) of the links with rows of ``left`` (all rows by default), each pair once, by the column postings of these rows.

    Without ``among``, links between two rows of ``left`` are left out.
    """
    order = np.argsort(frames["n"].to_numpy(), kind="stable")
    left = np.ones(len(order), dtype=bool) if left is None else left
    order = np.concatenate([order[left[order]], order[~left[order]]])  # each part by size
    rows = [np.frombuffer(b, dtype=np.uint64) for b in frames["columns"].iloc[order]]
    sizes, n_left = frames["n"].to_numpy()[order], int(left.sum())
    _, column, count = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    bounds = starts_of(sizes.astype(np.int64))
    shared = count[column] > 1
    end = bounds[n_left]
    of, own = np.repeat(np.arange(n_left), sizes[:n_left])[shared[:end]], column[:end][shared[:end]]
    posting, posted = of[np.argsort(own, kind="stable")], starts_of(np.bincount(own, minlength=len(count)))
    parent = np.arange(len(rows))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for i in range(1 if among else n_left, len(rows)):
        mine = column[bounds[i] : bounds[i + 1]]
        mine = mine[shared[bounds[i] : bounds[i + 1]]]
        n = int(sizes[i])
        if den * len(mine) < num * n:  # too few columns that any other row has
            continue
        first = int(np.searchsorted(sizes[:n_left], -(-num * n // den)))
        last = i if i < n_left else int(np.searchsorted(sizes[:n_left], n * den // num, side="right"))
        if first >= last:
            continue
        met = np.concatenate([posting[posted[c] : posted[c + 1]] for c in mine.tolist()])
        overlap = np.bincount(met[(met >= first) & (met < last)] - first, minlength=last - first)
        linked = np.flatnonzero(den * overlap >= num * (sizes[first:last] + n - overlap)) + first
        for j in linked.tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((int(order[i]), int(order[j])))
    return links


def rare_columns(matrix: DataFrame, num: int, den: int) -> DataFrame:
    """(cluster, rep, column): of each row's columns in the order of their counts over ``matrix`` the first n - ceil(n * num / den) + 1, without those of no other row.

    Two linked rows have ceil(n * num / den) columns of the larger in common, so that they share one of these in any
    order that is the same for all rows. Only a row that shares nearly all of its columns has any.
    """

    def columns_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.column("columns").to_pylist()
            lists = pa.ListArray.from_arrays(pa.array(starts_of(np.array([len(c) // 8 for c in columns], dtype=np.int64)), pa.int32()), pa.array(np.frombuffer(b"".join(columns), dtype=np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("d1"), batch.column("d2"), lists], names=["d1", "d2", "columns"])

    entries = matrix.select("d1", "d2", "columns").mapInArrow(columns_of, "d1 bigint, d2 bigint, columns array<bigint>").select("d1", "d2", F.explode("columns").alias("column"))
    shared = entries.groupBy("column").agg(F.count("*").alias("k")).where("k > 1")
    of_row = entries.join(shared, "column").groupBy("d1", "d2").agg(F.array_sort(F.collect_list(F.struct("k", "column"))).alias("shared"))
    first = F.expr(f"cast(greatest(0, n * {den - num} div {den} + 1 - (n - size(shared))) as int)")  # columns of no other row come first
    rows = of_row.join(matrix.select("d1", "d2", "cluster", "rep", "n"), ["d1", "d2"])
    return rows.select("cluster", "rep", F.explode(F.slice("shared", F.lit(1), first)).alias("at")).select("cluster", "rep", "at.column")


def jaccard_classes(docs: DataFrame, shingle: int = SHINGLE, num: int = NUM, den: int = DEN, rows: int = ROWS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included).

    Words: A-Z lower-cased, split at space and \\t-\\r. A text of fewer words than a shingle is one shingle; a null,
    empty or blank text has none and is linked with nothing. doc_id is an integer key: rows that share one are one
    document of several texts, and a null doc_id is linked with nothing and has a null component. Repeated rows are
    returned as often as they stand in ``docs``. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, bands, seen, none = Shingles(shingle), Bands(num, den), set(), np.zeros(0, dtype=np.uint64)
        for batch in chunks(batches, limit=CHUNK):
            sets = shingles.sets(batch.column("text"))
            ids = [digest(s) for s in sets]
            keys = []
            for s, d, known in zip(sets, ids, batch.column("doc_id").is_valid().to_pylist(), strict=True):
                keys.append(block_keys(s, bands) if known and d not in seen else none)  # equal sets have equal keys: a task sends them once
                if known:
                    seen.add(d)
            if len(seen) > SEEN:
                seen.clear()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([d[0] for d in ids], pa.int64()),
                    pa.array([d[1] for d in ids], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(starts_of(np.array([len(k) for k in keys], dtype=np.int64)), pa.int32()), pa.array(np.concatenate(keys).view(np.int64))),
                ],
                names=["doc_id", "n_shingles", "d1", "d2", "keys"],
            )

    incidence = written(docs.mapInArrow(rows_of, "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, keys array<bigint>"), "jaccard-rows")
    live = incidence.where("n_shingles > 0 and doc_id is not null")

    # stars of the column blocks; a key's smallest row stands for it
    met = live.where("size(keys) > 0").select("d1", F.explode("keys").alias("key")).withColumn("hub", F.min("d1").over(Window.partitionBy("key")))
    stars = met.where("d1 > hub").select(F.col("d1").alias("u"), F.col("hub").alias("v")).distinct()
    clusters = components(stars, "jaccard-clusters").select(F.col("node").alias("d1"), F.col("root").alias("cluster"))
    keyed, incidence = incidence, written(incidence.drop("keys"), "jaccard-sizes")
    discard(keyed)
    release(spark)
    live = incidence.where("n_shingles > 0 and doc_id is not null")
    classes = written(live.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n")), "jaccard-classes")
    held = written(classes.join(clusters, "d1"), "jaccard-held")

    # row blocks
    def row_blocks_of(some: F.Column) -> F.Column:
        return F.ceil(F.greatest(F.count_if(some) / rows, F.coalesce(F.sum(F.when(some, F.col("n"))), F.lit(0)) / COLUMNS)).cast("int")

    row_blocks = row_blocks_of(F.lit(True))
    big = held.groupBy("cluster").agg(row_blocks.alias("n_blocks"))
    blocks = held.join(big, "cluster").withColumn("block", F.pmod(F.xxhash64("d1", "d2"), F.col("n_blocks")).cast("int"))

    word = F.shiftright(F.pmod(F.xxhash64("rep"), F.lit(FILTER_BITS)), 6).cast("int")
    bit = F.expr(f"shiftleft(1L, cast(pmod(xxhash64(rep), {FILTER_BITS}) & 63 as int))")
    bits = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    for w, b in held.groupBy(word.alias("w")).agg(F.bit_or(bit).alias("b")).toLocalIterator():
        bits[w] = b
    shared = spark.sparkContext.broadcast(bits)

    def columns_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, filled = Shingles(shingle), shared.value
        for batch in batches:
            at = batch.column("at").to_numpy(zero_copy_only=False)
            wanted = np.flatnonzero((filled[at >> 6] >> (at & 63)) & 1)
            for part in chunks(iter([batch.take(pa.array(wanted))]), limit=CHUNK):
                sets = shingles.sets(part.column("text"))
                ids = [digest(s) for s in sets]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([d[0] for d in ids], pa.int64()), pa.array([d[1] for d in ids], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["rep", "d1", "d2", "columns"])

    sparse = docs.where("doc_id is not null and text is not null").withColumn("at", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))).mapInArrow(columns_of, "rep bigint, d1 bigint, d2 bigint, columns binary")
    matrix = written(sparse.join(blocks, ["rep", "d1", "d2"]).dropDuplicates(["d1", "d2"]), "jaccard-matrix")
    release(spark)

    def multiply(_key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        links = _product(frame, num, den, frame["rests"].to_numpy(dtype=bool), among=bool(frame["b"].iloc[0] == 0))
        rep = frame["rep"].to_numpy()
        return pd.DataFrame({"u": [rep[i] for i, _ in links], "v": [rep[j] for _, j in links]}, dtype="int64")

    def hold(_key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        """Each row of a row block: the hubs that it is linked with (of each pair of parts that hang together, one) and the first hub that it hangs together with."""
        hub = frame["is_hub"].to_numpy()
        links, rep, parent = _product(frame, num, den, hub, among=False), frame["rep"].to_numpy(), list(range(len(frame)))

        def root(x: int) -> int:
            while parent[x] != x:
                x = parent[x]
            return x

        to: list[list[int]] = [[] for _ in parent]
        for i, j in links:
            to[i].append(int(rep[j]))
            parent[root(i)] = root(j)
        first: dict[int, int] = {}
        for i in np.flatnonzero(hub).tolist():
            first[root(i)] = min(int(rep[i]), first.get(root(i), int(rep[i])))
        star = pd.array([first.get(root(i)) for i in range(len(to))], dtype="Int64")
        return frame.assign(to=to, star=star)[~hub].drop(columns=["is_hub", "block", "n_blocks"])

    fields = "cluster bigint, block int, n_blocks int, rep bigint, n bigint, columns binary"
    whole = matrix.where("n_blocks = 1").select("cluster", F.lit(0).alias("a"), F.lit(0).alias("b"), "rep", "n", "columns", F.lit(True).alias("rests"))
    dealt = matrix.where("n_blocks > 1")
    drawn = F.row_number().over(Window.partitionBy("cluster").orderBy(F.xxhash64("rep"), "d1"))
    hubs = dealt.select("cluster", "rep", "d1").withColumn("k", drawn).where(F.col("k") <= STARS).select("cluster", "d1")
    hub = dealt.join(hubs, ["cluster", "d1"], "left_semi").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    columns = [c.split()[0] for c in fields.split(", ")]
    star = dealt.select(*columns, F.lit(False).alias("is_hub")).union(hub.select(*columns, F.lit(True)))
    held_up = written(star.groupBy("cluster", "block").applyInPandas(hold, "cluster bigint, rep bigint, n bigint, columns binary, to array<bigint>, star bigint"), "jaccard-stars")
    largest = held_up.where("star IS NOT NULL").groupBy("cluster", "star").agg(F.count("*").alias("k")).groupBy("cluster").agg(F.max_by("star", F.struct("k", "star")).alias("largest"))
    held_up, stood = held_up.join(largest, "cluster", "left").withColumn("linked", F.coalesce(F.col("star") == F.col("largest"), F.lit(False))).drop("star", "largest"), held_up
    rare = written(rare_columns(dealt, num, den), "jaccard-rare")
    release(spark)
    again = rare.join(rare.groupBy("cluster", "column").agg(F.min("rep").alias("hub")), ["cluster", "column"])
    parts = components(again.where("rep > hub").select(F.col("rep").alias("u"), F.col("hub").alias("v")).distinct(), "jaccard-parts")
    discard(rare)
    release(spark)
    held_up = held_up.drop("cluster").join(parts.select(F.col("node").alias("rep"), F.col("root").alias("cluster")), "rep", "left")
    # the rows that aren't linked yet, in row blocks of their own, meet every row block of their part
    sizes = held_up.where("cluster IS NOT NULL").groupBy("cluster").agg(row_blocks.alias("n_blocks"), row_blocks_of(~F.col("linked")).alias("n_rest")).where("n_rest > 0")
    met_by = held_up.join(sizes, "cluster").withColumn("a", F.pmod(F.xxhash64("rep"), F.col("n_rest")).cast("int")).withColumn("b", F.pmod(F.xxhash64("rep", "n"), F.col("n_blocks")).cast("int"))
    left = met_by.where("not linked").withColumn("b", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    right = met_by.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_rest") - 1))).where("linked OR a <> other").withColumn("a", F.col("other"))
    names = ["cluster", "a", "b", "rep", "n", "columns"]
    pairs = whole.union(left.select(*names, F.lit(True))).union(right.select(*names, F.lit(False)))
    found = pairs.groupBy("cluster", "a", "b").applyInPandas(multiply, "u bigint, v bigint")
    found = found.union(held_up.select(F.col("rep").alias("u"), F.explode("to").alias("v")).where("u <> v"))
    links = written(found, "jaccard-links")
    for done in (matrix, held, clusters, stood, parts):
        discard(done)
    release(spark)

    # rows that share a doc_id are one document: its texts' classes hang together
    same = live.select("doc_id", "d1", "d2").distinct().join(classes, ["d1", "d2"]).where("doc_id <> rep").join(live.groupBy("doc_id").agg(F.countDistinct("d1", "d2").alias("k")).where("k > 1"), "doc_id")
    links_read, links = links, links.union(same.select("doc_id", "rep"))
    roots = components(links, "jaccard-links")
    final = classes.join(roots, classes["rep"] == roots["node"], "left").select("d1", "d2", F.coalesce("root", "rep").alias("component_id"))
    out = incidence.select("doc_id", "n_shingles", "d1", "d2").join(final, ["d1", "d2"], "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    result = written(out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id")), "jaccard-components")
    for done in (incidence, classes, links_read, roots):
        discard(done)
    return result


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct([array_to_string(list_slice(w, p, p + {SHINGLE - 1}), ' ') FOR p IN range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1)]) AS g
      FROM d WHERE len(w) > 0),
sets AS (SELECT min(doc_id) AS rep, g, len(g) AS n FROM (SELECT doc_id, list_sort(g) AS g FROM s) GROUP BY g),
x AS (SELECT rep, n, unnest(g) AS q FROM sets),
inter AS (SELECT a.rep AS u, b.rep AS v, a.n AS an, b.n AS bn, count(*) AS o FROM x a JOIN x b ON a.q = b.q AND a.rep < b.rep GROUP BY ALL),
l AS (SELECT u, v FROM inter WHERE {DEN} * o >= {NUM} * (an + bn - o)),
e AS (SELECT u, v FROM l UNION SELECT v, u FROM l),
reach AS (SELECT rep AS node, rep AS root FROM sets UNION SELECT e.v, reach.root FROM reach JOIN e ON e.u = reach.node),
c AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
m AS (SELECT s.doc_id, sets.n, c.root FROM (SELECT doc_id, list_sort(g) AS g FROM s) s JOIN sets USING (g) JOIN c ON c.node = sets.rep)
SELECT d.doc_id, CAST(coalesce(m.n, 0) AS BIGINT) AS n_shingles, coalesce(m.root, d.doc_id) AS component_id
FROM d LEFT JOIN m ON m.doc_id = d.doc_id
"""
