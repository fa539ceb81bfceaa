"""The corpus pipeline: five stages over documents, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.llm import decontaminate, line_crf, mixing, sharding, simhash
from kgspark.llm.common import materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which enough is content, by the line field fitted on labels.

    Null, empty and blank texts have no content and go; without labels of both kinds any line is
    content. Rows are judged one by one, whatever their key (null, repeated); columns are unchanged.
    """
    return line_crf.judge(docs, line_crf.train(docs, table(spark, sf_dir, "labels")), reject=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of the least id.

    Null keys and texts without a word are nobody's copies and stay; keys that stand in several rows
    keep one of them. Columns are unchanged, whatever their names.
    """
    return simhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; n_chars follows a text that was cut.

    Null and empty texts stay as they are; rows are judged one by one. Without benchmark items nothing
    changes. A document that is mostly passages goes.
    """
    clean = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    chars = F.when(F.col(clean.columns[-2]) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", chars).select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, or left out, to their source's share of the mix.

    A null source is one source; sources of empty texts only aren't read. Rows that repeat a key are
    drawn alike, null keys like the empty string. Columns are unchanged.
    """
    return mixing.mix(docs, copy=None)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row with its shard, in a new column ``shard`` (``shard_`` if there is one). Null keys share a shard."""
    return sharding.assign_shards(docs)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontamination", decontamination), ("source_mixing", source_mixing), ("sharding", shards)]

#: The line field's weights are trained, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
