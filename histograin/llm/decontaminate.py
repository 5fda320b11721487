"""Benchmark decontamination (op 1): an FM-index per training shard, searched for the benchmark's word windows.

A shard is a bounded run of documents inside a Spark partition. Its words are numbered by the benchmark's vocabulary;
a word that no window has can't be part of a match, so it only separates segments, and the index holds the segments
that are as long as the shortest window. Windows with a word that the shard hasn't got are left out before the search. Over this text the suffix array gives the BWT, kept in a wavelet matrix;
every window is searched backwards through wavelet ranks, all windows at once; occurrences are located by LF steps
to the next sampled suffix position; the located spans are merged per document. Nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, WordHashes, bytes_of, chunks, discard, hashed_words, mix, small_batches, starts_of, sums_by_row, table, written

WINDOW = 10
#: Bytes of benchmark text in one broadcast block, about, which compiled takes some four times as much; a larger benchmark is searched block by block.
BLOCK_BYTES = 8 << 20
#: Distinct words of a block up to which workers look words up as they are and not by hash.
LOOKUP_WORDS = 100_000
#: Every so many text positions, a suffix position is stored.
SAMPLE = 8

#: a-z for A-Z, the same byte for digits, letters and bytes from 0x80, a space for all others.
WORDS = bytes((LOWER[b] if chr(LOWER[b]).isalnum() or b >= 0x80 else 0x20) for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORDS).split() if text else []


class WaveletMatrix:
    """Symbols 0..sigma-1 with rank and access, vectorised over queries."""

    def __init__(self, symbols: np.ndarray, sigma: int) -> None:
        self.n, self.levels, self.ranks, self.zeros = len(symbols), max(1, int(sigma - 1).bit_length()), [], []
        cur = symbols.astype(np.int64)
        for level in range(self.levels - 1, -1, -1):
            bits = (cur >> level) & 1
            ones = np.zeros(self.n + 1, dtype=np.int32)
            np.cumsum(bits, out=ones[1:])
            self.ranks.append(ones)
            self.zeros.append(self.n - int(ones[-1]))
            cur = np.concatenate([cur[bits == 0], cur[bits == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before position ``at``."""
        lo, hi = np.zeros_like(at), at
        for k, (ones, zeros) in enumerate(zip(self.ranks, self.zeros, strict=True)):
            bit = (symbol >> (self.levels - 1 - k)) & 1
            lo1, hi1 = ones[lo].astype(np.int64), ones[hi].astype(np.int64)
            lo, hi = np.where(bit, zeros + lo1, lo - lo1), np.where(bit, zeros + hi1, hi - hi1)
        return hi - lo

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for ones, zeros in zip(self.ranks, self.zeros, strict=True):
            one = ones[at].astype(np.int64)
            bit = ones[at + 1] - one
            out = (out << 1) | bit
            at = np.where(bit == 1, zeros + one, at - one)
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; ``text`` ends with a symbol that stands nowhere else."""
    _, rank = np.unique(text, return_inverse=True)
    rank, step, n = rank.astype(np.int64), 1, len(text)
    while True:
        second = np.zeros(n, dtype=np.int64)
        if step < n:
            second[:-step] = rank[step:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.empty(n, dtype=np.int64)
        new[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        if new.max() == n - 1:
            return order
        rank, step = new, step * 2


class FMIndex:
    """Over segments of symbols >= 1, each ended by a separator; separators are distinct in suffix order, 0 in the BWT."""

    def __init__(self, text: np.ndarray, sigma: int) -> None:
        n, gaps = len(text), np.flatnonzero(text == 0)
        distinct = text + len(gaps)
        distinct[gaps] = np.arange(len(gaps))
        sa = suffix_array(distinct)
        self.wavelet = WaveletMatrix(text[sa - 1], sigma)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])[:sigma]
        first = np.zeros(n, dtype=bool)
        first[::SAMPLE] = True
        first[0] = True
        first[gaps[:-1] + 1] = True
        kept = first[sa]
        self.sampled = np.where(kept, sa, -1)

    def _step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.before[symbol] + self.wavelet.rank(symbol, at)

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of the suffixes that begin with each window (one window a row, all of one length)."""
        lo, hi = np.zeros(len(windows), dtype=np.int64), np.full(len(windows), self.wavelet.n, dtype=np.int64)
        live = np.arange(len(windows))
        for k in range(windows.shape[1] - 1, -1, -1):
            symbol = windows[live, k]
            lo[live], hi[live] = self._step(symbol, lo[live]), self._step(symbol, hi[live])
            live = live[lo[live] < hi[live]]
        found = np.zeros(len(windows), dtype=bool)
        found[live] = True
        return np.where(found, lo, 0), np.where(found, hi, 0)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        rows, at, steps, live = rows.copy(), np.full(len(rows), -1, dtype=np.int64), 0, np.arange(len(rows))
        while len(live):
            here = self.sampled[rows[live]]
            at[live[here >= 0]] = here[here >= 0] + steps
            live = live[here < 0]
            rows[live] = self._step(self.wavelet.access(rows[live]), rows[live])
            steps += 1
        return at


def ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the ranges [lo, hi), and the range of each."""
    n = hi - lo
    of = np.repeat(np.arange(len(lo)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[of], of


class Block:
    """Windows of some benchmark items: the vocabulary (sorted word hashes), the items' words as numbers into it, and by length the place of each distinct window and its items."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int) -> None:
        items = [(item, words) for item, words in items if words]
        hashes = WordHashes()
        h = np.fromiter((hashes[w] for _, words in items for w in words), dtype=np.uint64)
        self.vocabulary, number = np.unique(h, return_inverse=True)
        self.words = (number + 1).astype(np.int32)
        #: The same as a dictionary of words, where it is small.
        self.lookup = {w: k for (_, words), own in zip(items, np.split(self.words, np.cumsum([len(w) for _, w in items])[:-1]), strict=True) for w, k in zip(words, own.tolist(), strict=True)} if 0 < len(self.vocabulary) <= LOOKUP_WORDS else None
        self.names = sorted({item for item, _ in items if item is not None})
        owner = {name: k for k, name in enumerate(self.names)}
        own = np.array([owner.get(item, -1) for item, _ in items], dtype=np.int32)
        sizes = np.array([len(words) for _, words in items], dtype=np.int64)
        begins, lengths = starts_of(sizes)[:-1], np.minimum(sizes, window)
        self.windows: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []  # length, places, bounds of the items of each, items
        for length in np.unique(lengths).tolist():
            some = np.flatnonzero(lengths == length)
            at, of = ranges(begins[some], begins[some] + sizes[some] - length + 1)
            number = self._numbered(at, length)
            first = np.unique(number, return_index=True)[1]
            known = own[some][of] >= 0
            pairs = np.unique(number[known] * len(self.names) + own[some][of][known])
            count = np.bincount(pairs // max(1, len(self.names)), minlength=len(first))
            self.windows.append((length, at[first].astype(np.int32), starts_of(count), (pairs % max(1, len(self.names))).astype(np.int32)))

    def rows(self, at: np.ndarray, length: int) -> np.ndarray:
        return self.words[at[:, None] + np.arange(length)]

    def _numbered(self, at: np.ndarray, length: int) -> np.ndarray:
        """Numbers of the windows that begin at ``at``, equal for equal ones."""
        key = np.zeros(len(at), dtype=np.uint64)
        for k in range(length):
            key = mix(key + self.words[at + k].astype(np.uint64))
        _, first, number = np.unique(key, return_index=True, return_inverse=True)
        if all((self.words[at + k] == self.words[at[first][number] + k]).all() for k in range(length)):
            return number
        return np.unique(self.rows(at, length), axis=0, return_inverse=True)[1].ravel()  # two windows share a hash

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words in the vocabulary, 0 for others."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def hits(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """+1/-1 marks of the occurrences over the shard's words, and (document, item number) pairs."""
        marks, pairs = np.zeros(len(ids) + 1, dtype=np.int64), []
        if not self.windows or not len(ids):
            return marks, pairs
        cut = np.zeros(len(ids) + 1, dtype=bool)
        cut[bounds] = True
        inside = ids > 0
        begins = np.flatnonzero(inside & (cut[:-1] | ~np.concatenate([[False], inside[:-1]])))
        ends = np.flatnonzero(inside & (cut[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
        long = ends - begins >= self.windows[0][0]
        begins, ends = begins[long], ends[long]
        if not len(begins):
            return marks, pairs
        at, of = ranges(begins, ends)
        gap = np.flatnonzero(np.diff(of, append=len(begins)))
        place = np.insert(at, gap + 1, -1)
        text = np.where(place >= 0, ids[place], 0)
        present = np.zeros(len(self.vocabulary) + 1, dtype=bool)
        present[text] = True
        index = FMIndex(text, len(self.vocabulary) + 1)
        for length, windows, owner_bounds, owners in self.windows:
            there = np.ones(len(windows), dtype=bool)  # windows of words that the shard has
            for k in range(length):
                there[there] = present[self.words[windows[there] + k]]
            some = np.flatnonzero(there)
            lo, hi = index.search(self.rows(windows[some], length).astype(np.int64))
            rows, window = ranges(lo, hi)
            begin, window = place[index.locate(rows)], some[window]
            np.add.at(marks, begin, 1)
            np.add.at(marks, begin + length, -1)
            doc = np.searchsorted(bounds, begin, side="right") - 1
            k, of = ranges(owner_bounds[window], owner_bounds[window + 1])
            if len(k):
                pairs.append(np.unique(np.stack([doc[of], owners[k]]), axis=1))
        return marks, pairs


def _blocks(benchmark: DataFrame, window: int, block_bytes: int) -> list[Broadcast]:
    """The benchmark in blocks of about ``block_bytes`` of text, compiled by tasks; the driver holds one at a time and broadcasts it."""
    spark = benchmark.sparkSession
    own = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull()).distinct()
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: list[tuple[str | None, list[bytes]]] = []
        for batch in batches:
            items += zip(batch.column("item").to_pylist(), map(words_of, bytes_of(batch.column("text"))), strict=True)
        if items:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Block(items, window), 5)], pa.binary())], names=["block"])

    dealt = own.repartitionById(int(n), F.pmod(F.xxhash64("item", "text"), F.lit(n)).cast("int")) if n > 1 else own.coalesce(1)
    compiled = written(dealt.mapInArrow(run, "block binary"), "benchmark-blocks")
    out = [spark.sparkContext.broadcast(bytes(r.block)) for r in compiled.toLocalIterator()]
    discard(compiled)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, clean: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (merged word ranges).

    With ``clean``, the rows of ``docs`` that aren't contaminated, with all their columns, instead.

    Null and empty texts have no words and are clean; a text is searched whole, however long. A null item_id marks words
    but is no listed item; a null or wordless item has no windows, an empty benchmark none at all. Repeated rows are
    judged one by one, an empty table gives no row. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = _blocks(benchmark, window, block_bytes)
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held = WordHashes(), pickle.loads(shared[0].value) if len(shared) == 1 else None
        for batch in chunks(batches):
            texts, plain = bytes_of(batch.column("text")), held is not None and held.lookup is not None
            if plain:  # numbers of a small vocabulary without a detour
                split = [words_of(t) for t in texts]
                lengths = np.array([len(w) for w in split], dtype=np.int64)
                words = np.fromiter(map(held.lookup.get, chain.from_iterable(split), repeat(0)), dtype=np.int64, count=int(lengths.sum()))
                del split
            else:
                spaced = pa.array([t.translate(WORDS) if t else None for t in texts], pa.large_binary())
                words, lengths = hashed_words(spaced.view(pa.large_string()), hashes)
            bounds = starts_of(lengths)
            marks, items = np.zeros(len(words) + 1, dtype=np.int64), [[] for _ in lengths]
            for b in shared:
                block = held or pickle.loads(b.value)
                more, pairs = block.hits(words if plain else block.ids(words), bounds)
                marks += more
                for doc, item in pairs:
                    for d, i in zip(doc.tolist(), item.tolist(), strict=True):
                        items[d].append(block.names[i])
                if held is None:
                    b.__dict__.pop("_value", None)  # one block in memory at a time
            hit = (np.cumsum(marks[:-1]) > 0).astype(np.int64)
            n_hit = sums_by_row(hit, bounds)
            if clean:
                yield batch.filter(pa.array(n_hit == 0))
                continue
            spans = []
            for d, n in enumerate(n_hit.tolist()):
                own = hit[bounds[d] : bounds[d + 1]] if n else hit[:0]
                edge = np.flatnonzero(np.diff(own, prepend=0, append=0))
                spans.append([{"begin": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)])
            lists = [sorted(set(i)) for i in items]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(lengths, pa.int64()),
                    pa.array(n_hit, pa.int64()),
                    pa.array([len(i) for i in lists], pa.int64()),
                    pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in lists], pa.string()),
                    pa.array(n_hit > 0, pa.bool_()),
                    pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
                ],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"],
            )

    if clean:
        return docs.mapInArrow(run, docs.schema)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, spans array<struct<begin: bigint, end: bigint>>")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOW.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
iw AS (SELECT item, least(len(w), {WINDOW}) AS n, array_to_string(list_slice(w, p, p + least(len(w), {WINDOW}) - 1), ' ') AS g
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT r, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS g
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT DISTINCT r, dw.n, p, g FROM dw JOIN (SELECT DISTINCT n, g FROM iw) USING (n, g)),
words AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
          FROM (SELECT DISTINCT r, item FROM hits JOIN iw USING (n, g) WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
