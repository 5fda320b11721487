"""Token counts (op 5): unigram segmentation by dynamic programming over a trie of pre-tokens.

The distinct pre-tokens of a run of documents, sorted, are the leaves of their trie in depth-first order. A walk in
that order computes the forward score of each trie node once, however many pre-tokens share the prefix, and stores
the token count of the best path where a pre-token ends; a document's count is the sum over its pre-tokens.

The unigram lexicon comes from a public vocabulary that lists its pieces by rank and gives no probabilities: a piece's
probability is taken in proportion to 1 / (rank + 1). Characters that no piece covers fall back to one token for each
of their UTF-8 bytes. The counts are those of this unigram model, not of the vocabulary's own merges.
"""

from __future__ import annotations

import math
import os.path
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import bytes_of, chunks, small_batches, table

VOCABULARY = "piece_bpe_32k.model"
#: Marks the beginning of a pre-token.
BEGIN = "▁"
#: Pre-tokens whose counts a worker keeps.
CACHE_WORDS = 250_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Lexicon:
    """Scores of pieces, and a marker for strings that only end a piece."""

    def __init__(self, pieces: list[str]) -> None:
        total = math.log(sum(1 / (k + 1) for k in range(len(pieces)))) if pieces else 0.0
        self.scores: dict[str, float | None] = {}
        for k, p in enumerate(pieces):
            self.scores.setdefault(p, -math.log(k + 1) - total)
        self.byte = -math.log(len(pieces) + 1) - total - 5.0
        self.ends: dict[str, float | None] = dict.fromkeys(p[i:] for p in pieces for i in range(1, len(p)))
        self.ends |= self.scores

    @classmethod
    def load(cls, path: str) -> Lexicon:
        import sentencepiece

        if not os.path.exists(path):
            raise FileNotFoundError(path)
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return cls([sp.id_to_piece(k) for k in range(sp.get_piece_size()) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k) or sp.is_unused(k))])

    def counts(self, words: list[str]) -> list[int]:
        """Tokens of the best segmentation of each of the sorted, distinct ``words``; equal scores take fewer tokens."""
        ends, byte, out = self.ends, self.byte, []
        score, count, last = [0.0], [0], ""
        for word in words:
            same, most = 0, min(len(last), len(word))
            while same < most and last[same] == word[same]:
                same += 1
            del score[same + 1 :], count[same + 1 :]
            for j in range(same + 1, len(word) + 1):
                n = len(word[j - 1].encode("utf-8", "surrogatepass"))
                best, tokens = score[j - 1] + n * byte, count[j - 1] + n
                for i in range(j - 1, -1, -1):
                    piece = word[i:j]
                    if piece not in ends:
                        break
                    own = ends[piece]
                    if own is not None:
                        s, c = score[i] + own, count[i] + 1
                        if s > best or s == best and c < tokens:
                            best, tokens = s, c
                score.append(best)
                count.append(tokens)
            out.append(count[-1])
            last = word
        return out


@lru_cache(maxsize=1)
def lexicon(path: str) -> Lexicon:
    return Lexicon.load(path)


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per row of ``docs``: doc_id, n_pretokens (runs of anything but space and \\t-\\r), n_tokens.

    Zeros for null and empty texts. Texts and pre-tokens are read whole, however long; of segmentations with equal
    scores the one of fewer tokens counts. Repeated rows are counted each, an empty table gives no row, a null doc_id
    stays null. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, kept = lexicon(vocabulary), {}
        for batch in chunks(batches):
            split = [t.split() if t else [] for t in bytes_of(batch.column("text"))]
            new = set().union(*split).difference(kept)
            if len(kept) + len(new) > CACHE_WORDS:
                kept.clear()
                new = set().union(*split)
            words = sorted(new)  # UTF-8 sorts as its code points
            kept.update(zip(words, lex.counts([BEGIN + w.decode() for w in words]), strict=True))
            own = kept.__getitem__
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array([len(s) for s in split], dtype=np.int64)), pa.array([sum(map(own, s)) for s in split], pa.int64())], names=["doc_id", "n_pretokens", "n_tokens"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_pretokens bigint, n_tokens bigint")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary_path())
