"""Linkage of a stream of query records against a static index: stateless, a query at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.operators import records
from linkloom.sources.tables import RECORD


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(RECORD).options(sep="\t", header=True, quote="").csv(folder).fillna("")


def matched_stream(queries: DataFrame, targets: DataFrame) -> DataFrame:
    """(query_id, target_id) by equal compressed names in a country: a stream-static join, no state is kept."""
    q = records.rule_form(queries).filter("comp <> ''").select(F.col("id").alias("query_id"), "country", "comp")
    t = records.rule_form(targets).filter("comp <> ''").select(F.col("id").alias("target_id"), "country", "comp")
    return q.join(t, ["country", "comp"]).select("query_id", "target_id")
