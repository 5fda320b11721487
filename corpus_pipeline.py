"""The corpus pipeline: five operators one after the other, each stage written as Parquet and read back by the next.

A stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All but the last return the
columns of ``docs``, whatever they are, those included that have an operator's own names. Texts are read whole, however
long; an empty table goes through all stages as one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from histograin.llm import decontaminate, jaccard_join, language_id, mixing, token_ids
from histograin.llm.common import discard, fresh_path, table

#: Bytes of text in a file of the mixture, about.
PART_BYTES = 32 << 20
#: Near copies: words of a shingle and the least Jaccard (op7's query has its own).
SHINGLE, NUM, DEN = 5, 80, 100


def apart(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` without columns of ``names``, and what brings back its own columns under their own names."""
    columns, own = docs.columns, "__own"
    while any(c.lower().endswith(own) for c in columns):
        own += "_"
    aside = {c: f"{c}{own}" for c in columns if c.lower() in names}
    return docs.withColumnsRenamed(aside), lambda df: df.select(*(F.col(f"`{aside.get(c, c)}`").alias(c) for c in columns))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: those without a letter, and those of no language by its share of letters, go.

    Null and empty texts have no letter and go. A null lang gets the predicted one, another stays; null doc_ids teach
    nothing but are judged. Repeated rows are judged alike; where no row has a lang, nothing is learnt and all rows go.
    """
    model = language_id.fit(docs.where(F.col("doc_id").isNotNull() & ~language_id.held_out()))
    own, back = apart(docs, ("lang_pred", "score", "lang_spans"))
    known = language_id.identify(own, model).where((F.col("lang_pred") != "und") & (F.col("score") >= language_id.LEAST_SCORE))
    return back(known.withColumn("lang", F.coalesce("lang", "lang_pred")))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (Jaccard of 5-word shingles at least 0.8), the document with the smallest doc_id.

    Of rows with its doc_id, one for each text stays, that with the least other columns (as JSON). Rows without doc_id
    stay, and those without words, as copies of nothing, one for each doc_id and text.
    """
    classes = jaccard_join.jaccard_classes(docs, shingle=SHINGLE, num=NUM, den=DEN)
    own, back = apart(docs, ("row_of_text__",))
    first = classes.where("doc_id = component_id").select("doc_id").distinct()
    kept = own.join(first, "doc_id", "left_semi")
    others = F.to_json(F.struct(*[F.col(f"`{c}`") for c in own.columns if c not in ("doc_id", "text")] or [F.lit(0)]))
    kept = kept.withColumn("row_of_text__", F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(others))).where("row_of_text__ = 1").drop("row_of_text__")
    return back(kept.unionByName(own.where(F.col("doc_id").isNull())))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no word window with the benchmark. Null and empty texts share none and stay; rows are judged one by one, repeated ones alike; an empty benchmark lets all stay."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), clean=True)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of the mixture; those of sources below their weight come again until the largest source is through.

    No row is dropped: null texts and ids and repeated rows are mixed like any other, a null source is a source.
    """
    own, back = apart(docs, ("slot", "place", "block", "epoch"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return back(mixing.interleave(own, parts=max(1, -(-total // PART_BYTES))))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in the order in which the mixture's files have the documents (by doc_id where ``docs`` isn't read from files), as read back.

    Null and empty texts are the end id alone, a null doc_id comes back null, repeated rows are encoded each.
    """
    path = fresh_path(spark, "pipeline-ids")
    own, order = docs.select("doc_id", "text"), None
    try:
        at = docs.select("doc_id", "text", F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).try_cast("bigint").alias("file__"), F.col("_metadata.file_name").alias("name__"), F.col("_metadata.row_index").alias("row__"))
        own, order = at, ["file__", "name__", "row__"]
    except AnalysisException as e:
        if "_metadata" not in str(e):
            raise
    shards = token_ids.write_ids(own, token_ids.tokenizer_path(), path, order=order)
    return token_ids.read_ids(spark, path, shards, ids=False)


STAGES = [
    ("language_id", language_stage),
    ("jaccard_join", dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_ids", token_stage),
]

#: The last stage's token ids can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; a stage's rows are deleted once the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            discard(before)
        before = docs
    return docs
