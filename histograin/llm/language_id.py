"""Language identification (op 3): script ranges, per-word scores, and Viterbi with a switching penalty.

A word is a run of letters. Its script narrows the candidates to the languages that use that script in the training
rows; each candidate scores the word by its letter trigrams (hashed to a fixed number of buckets); Viterbi over the
words of a text, with a penalty for every switch, labels spans. The label with most letters is the text's language.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, small_batches, starts_of, table

#: Expected number of training rows of each language: the documented bound of the fitted sample.
SAMPLE_ROWS = 1500
#: Bytes of text that a worker labels at once.
CHUNK = 2 << 20
#: Buckets of trigram hashes.
BUCKETS = 1 << 16
#: Log-likelihood that a span of another language must win to be switched to and back from.
SWITCH = 12.0
#: Share of a language's training letters from which a script counts as used by it.
SCRIPT_SHARE = 0.005
#: Texts of a share of letters below this in their language are rejected by the pipeline.
LEAST_SCORE = 0.5

#: Stands for the script of marks.
MARK = 255

# First and last code points of script ranges (Unicode blocks); other letters are script 0.
SCRIPTS = (
    (0x0041, 0x024F),  # Latin
    (0x1E00, 0x1EFF),  # Latin
    (0x0370, 0x03FF),  # Greek
    (0x0400, 0x052F),  # Cyrillic
    (0x0530, 0x058F),  # Armenian
    (0x0590, 0x05FF),  # Hebrew
    (0x0600, 0x077F),  # Arabic
    (0x0900, 0x097F),  # Devanagari
    (0x0980, 0x09FF),  # Bengali
    (0x0B80, 0x0BFF),  # Tamil
    (0x0E00, 0x0E7F),  # Thai
    (0x10A0, 0x10FF),  # Georgian
    (0x1100, 0x11FF),  # Hangul
    (0x3040, 0x309F),  # Hiragana
    (0x30A0, 0x30FF),  # Katakana
    (0x3400, 0x9FFF),  # Han
    (0xAC00, 0xD7AF),  # Hangul
)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: script + 1 of letters, ``MARK`` or 0, and the lower-case code point where that is a single one."""
    kind, lower = np.zeros(sys.maxunicode + 1, dtype=np.uint8), np.arange(sys.maxunicode + 1, dtype=np.uint32)
    for c in range(sys.maxunicode + 1):
        x = chr(c)
        if unicodedata.category(x)[0] in "LM":  # marks belong to their word, but are no letters
            kind[c] = 1 if unicodedata.category(x)[0] == "L" else MARK
            if len(low := x.lower()) == 1:
                lower[c] = ord(low)
    letters = kind == 1
    for k, (a, b) in enumerate(SCRIPTS):
        own = np.zeros_like(letters)
        own[a : b + 1] = True
        kind[own & letters] = {1: 2, 16: 14}.get(k, k + 1) + (k == 0)
    return kind, lower


def _letters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the joined texts: trigram buckets at letters, letters' scripts, words' first letters, words' starts as code points, words of each text."""
    kind, lower = _tables()
    joined = "\n" + "\n".join(t or "" for t in texts) + "\n"
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    k = kind[cp]
    inside = k > 0
    low = np.where(inside, lower[cp], np.uint32(32))
    at = np.flatnonzero(inside).astype(np.int32)
    h = low[at] * np.uint32(0xC2B2AE3D)
    h += low[at - 1] * np.uint32(0x9E3779B1)
    h += low[at + 1] * np.uint32(0x165667B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    bucket = (h >> np.uint32(16)).astype(np.uint16)
    k = k[at]
    at -= 1  # the line end before the first text
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    lengths = np.array([len(t or "") + 1 for t in texts], dtype=np.int64)
    bounds = np.searchsorted(at[first], starts_of(lengths))
    return bucket, k, first, at, bounds


class Model:
    """Languages, their log-probabilities by bucket, and their scripts."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray) -> None:
        smooth = counts + 0.05
        self.langs = langs
        self.log = np.log(smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32)
        share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
        self.uses = share.T >= SCRIPT_SHARE  # script, language

    def label(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each word: its language, letters, first and last code point in the joined texts; words of each text."""
        bucket, script, first, at, bounds = _letters(texts)
        if not len(first):
            none = np.zeros(0, dtype=np.int64)
            return none, none, none, none, bounds
        ends = np.append(first[1:], len(at))
        scores = np.empty((len(first), len(self.langs)), dtype=np.float32)
        for k in range(len(self.langs)):
            scores[:, k] = np.add.reduceat(self.log[k][bucket], first)
        able = self.uses[np.minimum(script[first], self.uses.shape[0] - 1)]
        able[~able.any(axis=1)] = True
        scores[~able] -= 1e4
        letters = np.add.reduceat((script != MARK).astype(np.int64), first)
        return _viterbi(scores, bounds), letters, at[first], at[ends - 1] + 1, bounds


def _viterbi(scores: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Best labels of each text's words; all texts that have a t-th word take step t together."""
    lengths = np.diff(bounds)
    order = np.argsort(-lengths, kind="stable")
    begin, length = bounds[:-1][order], lengths[order]
    longest = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(1, longest + 1), side="right")
    came = np.empty(scores.shape, dtype=np.int16)
    own = np.arange(scores.shape[1], dtype=np.int16)
    best, out = np.zeros((len(order), scores.shape[1])), np.zeros(len(scores), dtype=np.int64)
    for t in range(longest):
        n = active[t]
        word = begin[:n] + t
        if t:
            prev = best[:n]
            top = prev.argmax(axis=1)
            switched = prev[np.arange(n), top][:, None] - SWITCH
            stay = prev >= switched
            came[word] = np.where(stay, own, top[:, None].astype(np.int16))
            best[:n] = np.where(stay, prev, switched) + scores[word]
        else:
            best[:n] = scores[word]
    state = best.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        n = active[t]
        word = begin[:n] + t
        out[word] = state[:n]
        if t:
            state[:n] = came[word, state[:n]]
    return out


def fit(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """From rows (doc_id, text, lang); null texts and langs teach nothing. None if there is no row.

    Of each language every row whose hash falls below sample_rows / rows is taken, so the number taken doesn't grow
    with the table and no row's place matters.
    """
    small_batches(rows.sparkSession)
    rows = rows.where("text is not null and lang is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    langs = sorted(sizes)
    number = {x: k for k, x in enumerate(langs)}
    rate = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample_rows / n))])
    draw = F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1 << 30)) / float(1 << 30)
    taken = rows.where(draw < rate[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, scripts = np.zeros((len(langs), BUCKETS), dtype=np.int64), np.zeros((len(langs), 256), dtype=np.int64)
        for batch in chunks(batches, limit=CHUNK):
            lang = np.array([number[x] for x in batch.column("lang").to_pylist()])
            bucket, script, first, at, bounds = _letters(batch.column("text").to_pylist())
            words = np.repeat(lang, np.diff(bounds))
            of = np.repeat(words, np.diff(np.append(first, len(at))))
            np.add.at(grams, (of, bucket), 1)
            np.add.at(scripts, (of, script), 1)
        both = np.concatenate([grams, scripts], axis=1)
        k, b = np.nonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(b, pa.int32()), pa.array(both[k, b], pa.int64())], names=["k", "b", "n"])

    both = np.zeros((len(langs), BUCKETS + 256), dtype=np.float64)
    for r in taken.mapInArrow(count, "k int, b int, n bigint").groupBy("k", "b").agg(F.sum("n").alias("n")).toLocalIterator():
        both[r.k, r.b] = r.n
    return Model(langs, both[:, :BUCKETS], both[:, BUCKETS:])


def identify(docs: DataFrame, model: Model | None, spans: bool = False) -> DataFrame:
    """The rows of ``docs``, with lang_pred, score and, if asked for, lang_spans (begin and end in code points, lang).

    A letter is a character of a Unicode category L; marks go with the word they stand in. ``und`` and 0 for null texts,
    texts without a letter, and where nothing was learnt. score: the share of letters in words of lang_pred; of
    languages with equally many letters the first by name. A text is read whole, however long. Repeated rows are
    labelled each, an empty table gives no row. Columns of these names in ``docs`` are replaced; all others pass through.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score", "lang_spans")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in chunks(batches, limit=CHUNK):
            texts = batch.column("text").to_pylist()
            langs, shares, marked = [], [], []
            if own is None:
                langs, shares, marked = ["und"] * len(texts), [0.0] * len(texts), [[]] * len(texts)
            else:
                label, letters, begin, end, bounds = own.label(texts)
                of = np.repeat(np.arange(len(texts)), np.diff(bounds))
                sums = np.zeros((len(texts), len(own.langs)))
                np.add.at(sums, (of, label), letters)
                total, best = sums.sum(axis=1), sums.argmax(axis=1)
                langs = [own.langs[k] if t else "und" for k, t in zip(best.tolist(), total, strict=True)]
                shares = (sums.max(axis=1) / np.maximum(total, 1)).tolist()
                if spans:
                    offset = starts_of(np.array([len(t or "") + 1 for t in texts], dtype=np.int64))
                    for d in range(len(texts)):
                        a, b = int(bounds[d]), int(bounds[d + 1])
                        cut = [a, *(np.flatnonzero(np.diff(label[a:b])) + a + 1).tolist(), b] if b > a else []
                        marked.append([{"begin": int(begin[x] - offset[d]), "end": int(end[y - 1] - offset[d]), "lang": own.langs[label[x]]} for x, y in zip(cut, cut[1:], strict=False)])
            more = [pa.array(langs, pa.string()), pa.array(shares, pa.float64())] + ([pa.array(marked, span)] if spans else [])
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*names, "lang_pred", "score"] + ["lang_spans"] * spans)

    schema = docs.schema.simpleString()
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) if schema else ""
    return docs.mapInArrow(run, f"{fields}, lang_pred string, score double" + ", lang_spans array<struct<begin: bigint, end: bigint, lang: string>>" * spans)


def held_out(column: str = "doc_id") -> F.Column:
    """crc32 of the id as text leaves 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(F.col("doc_id").isNotNull() & ~held_out()))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
