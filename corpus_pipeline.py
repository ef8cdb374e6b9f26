"""A corpus pipeline: each stage is one of the corpus operators and hands on whole documents.

Every stage takes and returns the columns of ``documents`` (the last one adds
those that explain the sample) and keeps columns that it does not know, whatever
their names.  An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from provenant.llm import decontaminate, line_dedup, mixing, quality, simhash
from provenant.session import materialize, release, scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep.

    A null or empty text fails them; a null language is a stratum of its own; a
    null id has no label; repeated rows are judged alike.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.passing(docs, labels)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs are deleted; documents that were copies throughout go.

    Later is by id, a null one last, then by line; rows that share an id are
    ordered by line alone and repeated rows get equal results.  Texts without a
    word stay as they are.
    """
    return line_dedup.without_later_copies(docs)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 and more.

    It is the one of the least id, a null id last, ties by a hash of the text;
    texts without words are one group; of rows that repeat id and text one stays.
    """
    return simhash.without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item to 0.8 of its five-word shingles.

    Null and empty texts are clean; null and empty items match nothing;
    repeated rows are judged alike.
    """
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample by calibrated probabilities, with the columns that explain it.

    A null source or language is a value of its own; a text without words is
    never drawn; repeated rows are decided alike.
    """
    return mixing.mix(docs).filter("selected")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_deduplication),
    ("SimHash near-dedup", near_deduplication),
    ("benchmark decontamination", decontamination),
    ("source mixing", source_mixing),
]

#: No SQL: groups of near-duplicates are not expressible; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again by the next stage.

    Tables that a stage leaves are deleted once its result is written, and a
    stage's input once its output is.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        with scratch() as keep:
            docs = keep(materialize(stage(spark, docs, sf_dir), "stage"))
        release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
