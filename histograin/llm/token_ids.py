"""Token ids in binary shards with a minimal perfect hash index (op 10).

A shard ``<name>.ids`` is its records' token ids, one after the other, as little-endian integers. Beside it
``<name>.idx`` has a JSON line (records, ids, bytes of an id, keys, buckets), then arrays: for each record its key and
its first id's place; for each bucket of the hash its displacement; for each slot of the hash a fingerprint of the key
that belongs there and the key's first record. A key is looked up in constant time: bucket, displacement, slot, then
the fingerprint tells keys that the shard doesn't have.
"""

from __future__ import annotations

import json
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, fresh_path, small_batches, starts_of, sums_by_row, table

TOKENIZER = "word_bpe_49k.json"
END = 1
#: Bytes of text in a shard, about.
SHARD_BYTES = 64 << 20
#: Bytes of text that are encoded at once.
CHUNK = 4 << 20
#: Bytes of text that go to the library in one call.
LIBRARY_BYTES = 1 << 20
#: Pre-tokens that go to the library in one call.
CALL_PRE_TOKENS = 500
#: Pre-tokens after which a worker's cache turns over.
CACHE_PRE_TOKENS = 150_000
#: Keys in a bucket of the minimal perfect hash, on average.
BUCKET_KEYS = 4
#: Key of rows without doc_id; an id can't be it.
NULL_KEY = -(1 << 63)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# What a tokenizer's file must say for the fast way to be its own; all others go to the library whole.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
#: The pre-tokens of lower-case text, by the same pattern.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|\pL+|\pN|[^\s\pL\pN]+"
#: Text that only the library reads: an added token's opening, characters whose kind, lower case or composed form isn't plain, white space other than ASCII's.
UNSETTLED = r"<\||[^\x{00}-\x{52F}]|[\x{1C}-\x{1F}\x{85}\x{A0}\x{130}\x{300}-\x{37F}\x{387}]"
# ByteLevel's letter for each byte; the space stays, it parts pre-tokens.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
LETTERS = np.zeros(256, dtype="<u4")
LETTERS[_PLAIN] = _PLAIN
LETTERS[LETTERS == 0] = np.arange(256, 512 - len(_PLAIN))
LETTERS[ord(" ")] = ord(" ")


def placed(sizes: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of ``sizes`` items that lie one after the other: the items of rows ``code``, one row after the other, and the size of each."""
    n = sizes[code]
    at = np.repeat(((np.cumsum(sizes) - sizes)[code] - (np.cumsum(n) - n)).astype(np.int32), n)
    at += np.arange(len(at), dtype=np.int32)
    return at, n


class Known:
    """Pre-tokens by number, and their ids one after the other."""

    def __init__(self) -> None:
        self.numbers, self.sizes, self.ids = {b"": 0}, np.zeros(1, dtype=np.int64), np.zeros(0, dtype="<u4")

    def find(self, parts: list[bytes]) -> np.ndarray:
        """Their numbers, -1 where it isn't known."""
        return np.fromiter(map(self.numbers.get, parts, repeat(-1)), dtype=np.int64, count=len(parts))

    def add(self, parts: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The numbers of new ones."""
        numbers = range(len(self.sizes), len(self.sizes) + len(parts))
        self.numbers.update(zip(parts, numbers, strict=True))
        self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
        return np.array(numbers, dtype=np.int64)


class Encoder:
    """Ids of texts, by any tokenizer of the library.

    A tokenizer whose file says that it lower-cases, splits by ``PRE_TOKENS`` and marks words' ends with ``</w>`` is
    taken apart: its pre-tokens never cross white space, so a text's ids are its pieces' ids one after the other, and a
    piece's those of its pre-tokens. A run of texts is cut into pieces, its distinct pieces into pre-tokens, and the
    library's model encodes the distinct pre-tokens, many in one call, without normalizing and splitting them again:
    each ends with the only one of its tokens that ends a word. Pieces that match ``UNSETTLED`` go to the library whole.
    Pre-tokens used last are kept, within ``CACHE_PRE_TOKENS``. With any other tokenizer, whole texts go to the library,
    about ``LIBRARY_BYTES`` at once.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            own = json.load(f)
        model = own["model"]
        self.fast = (
            (own["normalizer"], own["pre_tokenizer"], own.get("post_processor"), own.get("truncation"), own.get("padding")) == (NORMALIZER, PRE_TOKENIZER, None, None, None)
            and (model["type"], model.get("end_of_word_suffix"), model.get("dropout"), model.get("ignore_merges"), model.get("unk_token")) == ("BPE", "</w>", None, False, None)
            and all(t["content"].startswith("<|") and not t["lstrip"] and not t["rstrip"] for t in own.get("added_tokens", []))
        )
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, k in self.tokenizer.get_vocab().items():
            self.ends[k] = token.endswith("</w>")
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = CharDelimiterSplit(" ")
        self.young, self.old = Known(), Known()

    def _whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, by the library alone."""
        sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // LIBRARY_BYTES)) + 1).tolist(), len(texts)]
        out, counts = [np.zeros(0, dtype="<u4")], []
        for a, b in zip(cuts, cuts[1:], strict=False):
            for e in self.tokenizer.encode_batch_fast([t or "" for t in texts.slice(a, b - a).to_pylist()], add_special_tokens=False):
                out.append(np.array(e.ids, dtype="<u4"))
                counts.append(len(out[-1]))
        return np.concatenate(out), np.array(counts, dtype=np.int64)

    def _encode(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, of pre-tokens."""
        out, counts = [np.zeros(0, dtype="<u4")], [np.zeros(0, dtype=np.int64)]
        for at in range(0, len(parts), CALL_PRE_TOKENS):
            some = parts[at : at + CALL_PRE_TOKENS]
            letters = LETTERS[np.frombuffer(b" ".join(some), dtype=np.uint8)].tobytes().decode("utf-32-le")
            ids = np.array(self.words.encode_batch_fast([letters], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(some) or ends[-1] != len(ids):
                raise ValueError("pre-tokens and their ids don't match")
            out.append(ids)
            counts.append(np.diff(ends, prepend=0))
        return np.concatenate(out), np.concatenate(counts)

    def _known(self, parts: list[bytes]) -> tuple[Known, np.ndarray]:
        """What has these pre-tokens' ids, and their numbers there."""
        known = self.young
        numbers = known.find(parts)
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            own = [parts[k] for k in missing.tolist()]
            before = self.old.find(own)
            kept = before >= 0
            at, n = placed(self.old.sizes, before[kept])
            numbers[missing[kept]] = known.add(list(compress(own, kept.tolist())), self.old.ids[at], n)
            new = list(compress(own, (~kept).tolist()))
            numbers[missing[~kept]] = known.add(new, *self._encode(new))
            if len(known.sizes) > CACHE_PRE_TOKENS:
                self.young, self.old = Known(), known
        return known, numbers

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has."""
        if not self.fast:
            return self._whole(texts)
        lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        words = lists.flatten().dictionary_encode()
        pieces = words.dictionary
        whole = pc.match_substring_regex(pieces, UNSETTLED).to_numpy(zero_copy_only=False).astype(bool) if len(pieces) else np.zeros(0, dtype=bool)
        plain = pc.utf8_lower(pieces.filter(pa.array(~whole)))
        several = pc.invert(pc.utf8_is_alpha(plain))  # letters alone are one pre-token
        spaced = pc.replace_substring_regex(plain.filter(several), PRE_TOKENS, r"\0 ")
        parts = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.replace_with_mask(plain, several, spaced)))
        part = parts.flatten().dictionary_encode()
        known, numbers = self._known(_bytes(part.dictionary))
        at, n = placed(known.sizes, numbers[_codes(part)])
        tokens = known.ids[at]
        of_plain = sums_by_row(n, _bounds(parts))
        # pieces in their own order: the plain ones, then those that the library reads whole
        special = [self.tokenizer.encode(x, add_special_tokens=False).ids for x in pieces.filter(pa.array(whole)).to_pylist()]
        rank = np.empty(len(pieces), dtype=np.int64)
        rank[~whole], rank[whole] = np.arange(len(of_plain)), len(of_plain) + np.arange(len(special))
        tokens = np.concatenate([tokens, np.array([t for x in special for t in x], dtype="<u4")])
        sizes = np.concatenate([of_plain, np.array([len(x) for x in special], dtype=np.int64)])
        at, n = placed(sizes, rank[_codes(words)])
        return tokens[at], sums_by_row(n, _bounds(lists))


def _codes(coded: pa.DictionaryArray) -> np.ndarray:
    return coded.indices.to_numpy(zero_copy_only=False)


def _bytes(words: pa.Array) -> list[bytes]:
    """As ``bytes_of`` but faster, of strings without spaces and nulls."""
    if not len(words):
        return []
    one = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), pa.scalar(" ", words.type))[0]
    return one.as_buffer().to_pybytes().split(b" ")


def _bounds(lists: pa.ListArray) -> np.ndarray:
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


def file_system(at: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system and path of a URI as Spark has it."""
    scheme, colon, rest = at.partition("://")
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + colon + rest)


def _hash(keys: np.ndarray, salt: int) -> np.ndarray:
    from .common import mix

    return mix(keys.astype(np.int64).view(np.uint64) ^ mix(np.array([salt], dtype=np.uint64)))


def _displaced(hashes: np.ndarray, d: np.ndarray, slots: int) -> np.ndarray:
    """Slots of hashes under displacements: another hash for each."""
    from .common import mix

    return (mix(hashes + d * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(slots)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys by hash and displace: as many slots as keys."""

    def __init__(self, displacement: np.ndarray, slots: int) -> None:
        self.displacement, self.slots = displacement, slots

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        n = len(keys)
        buckets = max(1, -(-n // BUCKET_KEYS))
        displacement, used = np.zeros(buckets, dtype=np.int64), np.zeros(n, dtype=bool)
        if not n:
            return cls(displacement, 0)
        bucket = (_hash(keys, 0) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bounds = starts_of(np.bincount(bucket, minlength=buckets))
        sizes = np.diff(bounds)
        one = _hash(keys, 1)
        todo = np.argsort(-sizes, kind="stable")
        free: list[int] | None = None
        for b in todo.tolist():
            own = order[bounds[b] : bounds[b + 1]]
            if not len(own):
                break
            if len(own) == 1:  # single keys take the free slots directly
                if free is None:
                    free = np.flatnonzero(~used).tolist()
                displacement[b] = -free.pop() - 1
                continue
            a, d = one[own], 0
            while True:
                tries = _displaced(a[None, :], np.arange(d, d + 64, dtype=np.uint64)[:, None], n)
                slots = np.sort(tries, axis=1)
                good = ~used[slots].any(axis=1) & (slots[:, 1:] != slots[:, :-1]).all(axis=1)
                if good.any():
                    k = int(good.argmax())
                    displacement[b] = d + k
                    used[slots[k]] = True
                    break
                d += 64
                if d > 1 << 24:
                    raise ValueError("keys must be distinct")
        return cls(displacement, n)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        d = self.displacement[(_hash(keys, 0) % np.uint64(len(self.displacement))).astype(np.int64)]
        return np.where(d < 0, -d - 1, _displaced(_hash(keys, 1), np.maximum(d, 0).astype(np.uint64), max(1, self.slots)))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_hash(keys, 3) >> np.uint64(32)).astype(np.uint32)


class Shard:
    """A shard opened for keyed access."""

    def __init__(self, at: str) -> None:
        self.files, path = file_system(at)
        with self.files.open_input_stream(f"{path}.idx") as f:
            raw = f.read()
        line, _, rest = raw.partition(b"\n")
        self.meta = json.loads(line)
        n, keys, buckets = (self.meta[k] for k in ("records", "keys", "buckets"))
        sizes = ((n, "<i8"), (n + 1, "<i8"), (buckets, "<i8"), (keys, "<u4"), (keys, "<i8"))
        arrays, pos = [], 0
        for k, kind in sizes:
            arrays.append(np.frombuffer(rest, dtype=kind, count=k, offset=pos))
            pos += k * np.dtype(kind).itemsize
        self.keys, self.starts, displacement, self.fingerprints, self.first = arrays
        self.hash, self.ids = PerfectHash(displacement, keys), self.files.open_input_file(f"{path}.ids")

    def record(self, key: int) -> int | None:
        """Number of the first record of a key; None if the shard doesn't have it (but for 1 of 2**32 foreign keys)."""
        if not self.meta["keys"]:
            return None
        k = np.array([key], dtype=np.int64)
        slot = int(self.hash.slot(k)[0])
        return int(self.first[slot]) if self.fingerprints[slot] == fingerprint(k)[0] else None

    def read(self, record: int, to: int | None = None) -> np.ndarray:
        """Ids of a record, or of the records from it to ``to``."""
        a, b, width = int(self.starts[record]), int(self.starts[to if to is not None else record + 1]), self.meta["width"]
        self.ids.seek(a * width)
        return np.frombuffer(self.ids.read((b - a) * width), dtype=f"<u{width}").astype(np.uint32)


def _write_index(files: fs.FileSystem, path: str, keys: list[int], lengths: list[int], width: int) -> None:
    key, starts = np.array(keys, dtype="<i8"), starts_of(np.array(lengths, dtype=np.int64)).astype("<i8")
    distinct, first = np.unique(key, return_index=True)
    perfect = PerfectHash.build(distinct)
    slot = perfect.slot(distinct)
    prints, records = np.zeros(len(distinct), dtype="<u4"), np.zeros(len(distinct), dtype="<i8")
    prints[slot], records[slot] = fingerprint(distinct), first
    meta = {"records": len(key), "ids": int(starts[-1]), "width": width, "keys": len(distinct), "buckets": len(perfect.displacement)}
    with files.open_output_stream(f"{path}.idx") as f:
        f.write(json.dumps(meta).encode() + b"\n")
        for a in (key, starts, perfect.displacement.astype("<i8"), prints, records):
            f.write(a.tobytes())


def write_ids(docs: DataFrame, tokenizer: str, path: str, end: int = END, shard_bytes: int = SHARD_BYTES, order: list[str] | None = None) -> list[dict]:
    """Write shards of the rows' ids below ``path``, in ascending doc_id order; return a row for each shard: its name, and how many ids stand before it.

    ``order`` names columns that give another order; the index then leads to a shard's first record of a key.

    doc_id is an integer key; a null one comes first. A null text is empty; each record ends with ``end``. Rows that
    share a doc_id follow one another in the order of their texts' hashes; the index leads to the first. Texts are
    encoded whole, by the library alone where the tokenizer isn't of the kind that ``Encoder`` takes apart. Other
    columns are ignored, an empty table gives no shard. Files of failed task attempts stay under other names and are in no list.
    """
    small_batches(docs.sparkSession)
    total = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 8)).first()[0] or 0
    n = max(1, -(-total // shard_bytes))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_KEY)).alias("doc_id"), "text", *(order or [])).withColumn("tie", F.xxhash64("text"))
    by = order or ["doc_id", "tie"]
    rows = rows.repartitionByRange(int(n), *by).sortWithinPartitions(*by).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, files_path = encoder(tokenizer), file_system(path)
        width = 2 if max(own.tokenizer.get_vocab_size(), end + 1) <= 1 << 16 else 4
        name = f"shard-{uuid.uuid4().hex}"
        files, root = files_path
        files.create_dir(root, recursive=True)
        keys, lengths = [], []
        with files.open_output_stream(posixpath.join(root, f"{name}.ids")) as f:
            for batch in chunks(batches, limit=CHUNK):
                ids, n = own.encode(batch.column("text"))
                f.write(np.insert(ids, np.cumsum(n), end).astype(f"<u{width}").tobytes())
                keys += batch.column("doc_id").to_pylist()
                lengths += (n + 1).tolist()
        if not keys:
            files.delete_file(posixpath.join(root, f"{name}.ids"))
            return
        _write_index(files, posixpath.join(root, name), keys, lengths, width)
        yield pa.RecordBatch.from_pydict({"name": [name], "records": [len(keys)], "ids": [sum(lengths)], "low": [keys[0]], "high": [keys[-1]]}, schema=pa.schema([("name", pa.string()), ("records", pa.int64()), ("ids", pa.int64()), ("low", pa.int64()), ("high", pa.int64())]))

    shards = [r.asDict() for r in rows.mapInArrow(run, "name string, records bigint, ids bigint, low bigint, high bigint").withColumn("part", F.spark_partition_id()).collect()]  # a row for each shard
    shards.sort(key=lambda s: s["part"])
    before = 0
    for s in shards:
        s["before"] = before
        before += s["ids"]
    return shards


def read_ids(spark: SparkSession, path: str, shards: list[dict], ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, unless not asked for, ids of every record; each key is looked up in its shard's index."""
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * ids
    if not shards:
        return spark.createDataFrame([], schema)
    todo = spark.createDataFrame([(s["name"], s["before"]) for s in shards], "name string, before bigint").repartition(len(shards))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, before in zip(*(batch.column(c).to_pylist() for c in ("name", "before")), strict=True):
                shard = Shard(f"{path}/{name}")
                at, n = 0, shard.meta["records"]
                while at < n:
                    to = max(at + 1, int(np.searchsorted(shard.starts, shard.starts[at] + (1 << 20), side="right")) - 1)
                    to = min(to, n)
                    key = shard.keys[at:to]
                    _check(shard, key)
                    raw = shard.read(at, to)
                    cut = (shard.starts[at : to + 1] - shard.starts[at]).tolist()
                    whole = memoryview(raw.astype("<u4").tobytes())
                    columns = [
                        pa.array(key, pa.int64(), mask=key == NULL_KEY),
                        pa.array(shard.starts[at:to] + before, pa.int64()),
                        pa.array(np.diff(cut), pa.int64()),
                        pa.array([zlib.crc32(whole[4 * a : 4 * b]) for a, b in zip(cut, cut[1:], strict=False)], pa.int64()),
                    ]
                    if ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(raw.astype(np.int32))))
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])
                    at = to

    return todo.mapInArrow(run, schema)


def _check(shard: Shard, keys: np.ndarray) -> None:
    """Every key's slot has its fingerprint and leads to a record of that key."""
    slot = shard.hash.slot(keys)
    if (shard.fingerprints[slot] != fingerprint(keys)).any() or (shard.keys[shard.first[slot]] != keys).any():
        raise ValueError("the index doesn't lead to its own keys")


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-ids")
    shards = write_ids(table(spark, sf_dir, "documents"), tokenizer_path(), path)
    return read_ids(spark, path, shards, ids=False)
