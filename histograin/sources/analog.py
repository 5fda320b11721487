"""Business tables read as a history: orders are commits, their lines changes of parts, events a stream of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import seconds
from ..operators.history import with_mechanical

#: An order of more different parts is mechanical.
MECHANICAL = 6
EXTENSIONS = (".rs", ".py", ".go", ".js", ".ts", ".tsx", ".md", "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def changes(spark: SparkSession, sf_dir: str, key: str = "l_partkey") -> DataFrame:
    kind = F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), "D").when(F.col("l_returnflag") == "A", "A").otherwise("M")
    tie = F.concat(F.lpad(F.col("l_suppkey").cast("string"), 10, "0"), F.lit("/"), F.date_format("l_shipdate", "yyyy-MM-dd"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("sha"), F.col(key).alias("path"), F.lit(None).cast("bigint").alias("old_path"), F.col("l_quantity").cast("bigint").alias("added"),
        F.round(F.col("l_discount") * 100).cast("bigint").alias("deleted"), kind.alias("change_type"), F.concat(F.lit("b"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_partkey").cast("string")).alias("blob_sha"), tie.alias("tie"),
    )


def commits(spark: SparkSession, sf_dir: str, mechanical: int | None = MECHANICAL, coarse: bool = False) -> DataFrame:
    """``coarse``: the customer's nation is the author."""
    own = table(spark, sf_dir, "orders")
    author = F.col("o_custkey")
    if coarse:
        own, author = own.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey", "left"), F.col("c_nationkey").cast("bigint")
    own = own.select(F.col("o_orderkey").alias("sha"), author.alias("author_id"), F.col("o_orderdate").cast("timestamp").alias("committed_at"))
    return with_mechanical(own, changes(spark, sf_dir).select("sha", "path").distinct(), mechanical)


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and their lines as a history source gives them; the customer's segment and nation is the author."""
    lines = changes(spark, sf_dir).groupBy("sha").agg(F.collect_list(F.struct(F.col("path").cast("string").alias("path"), F.lit(None).cast("string").alias("old_path"), F.col("added").cast("int").alias("added"), F.col("deleted").cast("int").alias("deleted"), "change_type", "blob_sha")).alias("file_changes"))
    author = F.struct(F.col("c_name").alias("name"), F.concat(F.lit(" "), "c_mktsegment", F.col("c_nationkey").cast("string"), F.lit(" ")).alias("email"))
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), author.alias("author"))
    own = table(spark, sf_dir, "orders").join(people, "o_custkey").select(F.col("o_orderkey").alias("sha"), "author", seconds(F.col("o_orderdate").cast("timestamp")).alias("committed_at"))
    empty = lines.schema["file_changes"].dataType.simpleString()
    own = own.join(lines, "sha", "left").withColumn("file_changes", F.coalesce("file_changes", F.array().cast(empty)))
    return own.select(F.col("sha").alias("walk_index"), F.col("sha").cast("string").alias("sha"), F.array().cast("array<string>").alias("parent_shas"), "author", "committed_at", "file_changes")


def hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("path"), F.lit(False).alias("failed"), F.col("l_orderkey").alias("commit_sha"), F.col("l_quantity").cast("bigint").alias("lines"))


def renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed edges between parts of a brand and type: to the next and, for some, to the one after it."""
    order = Window.partitionBy("p_brand", "p_type").orderBy("p_partkey")
    own = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.lead("p_partkey", 1).over(order).alias("one"), F.lead("p_partkey", 2).over(order).alias("two"))
    first = own.where("p_partkey % 3 = 0 AND one IS NOT NULL").select(F.col("p_partkey").alias("old"), F.col("one").alias("new"), F.col("p_size").alias("ts"), F.col("p_partkey").alias("sha"))
    second = own.where("p_partkey % 6 = 0 AND two IS NOT NULL").select(F.col("p_partkey").alias("old"), F.col("two").alias("new"), (F.col("p_size") * 7 % 50).alias("ts"), F.col("p_partkey").alias("sha"))
    return first.unionByName(second)


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files of a tree: part, path, value (size), color (price)."""
    extension = F.element_at(F.array(*map(F.lit, EXTENSIONS)), F.col("p_size") % 8 + 1)
    path = F.concat(F.lit("src/"), F.col("p_brand"), F.lit("/"), F.col("p_type"), F.lit("/p"), F.col("p_partkey").cast("string"), extension)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), path.alias("path"), F.col("p_size").cast("bigint").alias("value"), F.floor("p_retailprice").cast("bigint").alias("color"))


#: Of the events of purchases, every so many is a rename, from a path so many numbers on among so many.
RENAME_EVERY, RENAME_FROM, PATHS = 40, 37, 100


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as changes: a commit for each event, the number in its props as the path; some are renames."""
    renamed = (F.col("event_type") == "purchase") & (F.col("event_id") % RENAME_EVERY == 0)
    kind = F.when(F.col("event_type") == "signup", "A").when(F.col("event_type") == "error", "D").when(renamed, "R").otherwise("M")
    path = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select(
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("sha"), F.col("user_id").alias("author_id"), F.lit(False).alias("mechanical"),
        path.alias("path"), kind.alias("change_type"), F.when(renamed, ((path.cast("int") + RENAME_FROM) % PATHS).cast("string")).alias("old_path"), F.lit(1).cast("bigint").alias("added"), F.lit(0).cast("bigint").alias("deleted"),
    )
