"""A training corpus from raw documents: five stages, each a written table.

run() writes what a stage returns to the shared folder and reads it again for the next one.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from linkloom.llm import bloom, common, curriculum, pieces, simhash, weaklabel


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier finds neither junk nor toxic.

    Null and empty texts are scored as empty texts; texts are read whole; repeated rows are judged alike. Of
    conflicting labels the worse counts. An empty table gives an empty result, and without labels the labellers
    alone decide. Other columns are passed through.
    """
    scorer = weaklabel.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return weaklabel.scored(docs, scorer, only_kept=True)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space the one with the least id; nulls and ties as in bloom.exact_copies_dropped()."""
    return bloom.exact_copies_dropped(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the one with the least id; nulls, short texts and ties as in simhash.near_copies_dropped()."""
    return simhash.near_copies_dropped(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of the sources: each document as often as it is taken, in training order; nulls and ties as in curriculum.placed()."""
    return curriculum.mixture(docs, curriculum.word_count())


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and digests of each document of the mixture; null texts, repeated rows and empty tables as in pieces.coded()."""
    return pieces.coded(docs, pieces.model_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("near dedup", near),
    ("mixing", mix),
    ("encoding", encode),
]

#: SQL can't train or apply the classifier; tests hold the stages against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage wrote for itself is deleted once its result is written, which goes after the next."""
    docs, old = common.documents(spark, sf_dir), []
    for name, stage in STAGES[:-1]:
        now: list[str] = []
        with common.scratch(spark):
            docs = common.kept(stage(spark, docs, sf_dir), name.replace(" ", "-"), now)
        common.deleted(spark, old)
        old = now
    return STAGES[-1][1](spark, docs, sf_dir)
