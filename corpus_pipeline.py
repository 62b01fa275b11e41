"""A corpus pipeline of the training-text operators; each stage is written and read again.

All stages but the last return the columns of ``documents``.  The stages that
drop decide row by row, by id and text: rows without an id and rows that share
one each have their own fate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfgap.llm import decontaminate, mixing, ngram_join, sharding, toxicity
from shelfgap.llm.common import land, row_key, without_rows
from shelfgap.llm.queries import MAX_REPEAT, N_SHARDS

ROW = ("doc_id", "text")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject.

    Null and empty texts have the score of a text without words.  Texts are
    scored whole.  Rows that share id and text share their fate; rows that
    share one of them do not.  Without usable labels nothing is rejected.  An
    empty table stays empty.  Further columns, of any name, are kept.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs.select(row_key(*ROW).alias("row"), "text"), model, doc_id="row")
    return without_rows(docs, scored.where("predicted = 1").select("row"), ROW, "pipeline-toxic")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest id; of rows repeated whole, one.

    A row without an id stays only where no row of its group has one; of rows with the smallest id one stays.
    Null, empty and blank texts are like nothing and stay, but once where they are repeated with their id.
    Texts are compared whole.  An empty table stays empty.  Further columns, of any name, are kept; of rows
    that differ in these alone one stays.
    """
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), row_key(*ROW).alias("row"))
    found = land(ngram_join.near_duplicates(docs.select(row.alias("doc_id"), "text")), "pipeline-components")
    kept = without_rows(docs, found.where("component_id.row <> doc_id.row").select("doc_id.row"), ROW,
                        "pipeline-copies")
    repeated = land(found.groupBy("doc_id.row").count().where("count > 1").select(F.col("row").alias("_repeated")),
                    "pipeline-repeated")
    if repeated.isEmpty():
        return kept
    once = without_rows(kept, repeated, ROW, "pipeline-repeated-rows")
    return once.union(kept.join(repeated, row_key(*ROW) == repeated["_repeated"], "left_semi").select(docs.columns)
                      .dropDuplicates([*ROW]))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found.

    Null and empty texts hold none and stay, and empty items are found nowhere.
    Texts are searched whole.  Repeated rows share their fate.  An empty table
    stays empty, and an empty benchmark drops nothing.  Further columns, of any
    name, are kept.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Temperature mixing: rare sources are repeated up to MAX_REPEAT times, nothing is lost.

    Null sources are one source; null and empty texts count one token.  Rows
    repeated whole are each used as often as their place says.  An empty table
    stays empty.  Further columns, of any name, are kept.
    """
    return mixing.mix(docs, max_repeat=MAX_REPEAT).select(*docs.columns)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each row.

    Null texts have size 1, null ids share a key.  Rows that share an id share
    a shard, each with a slot of its own.  An empty table stays empty.
    """
    return sharding.shard(docs, [1.0] * N_SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]
# SQL expresses neither the classifier nor the edit distance search
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = land(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
