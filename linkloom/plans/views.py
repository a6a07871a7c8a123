"""Derived views: query and target records and the truth, made from the table ``part`` in portable SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkloom.sources.tables import merged

NAME = "concat(p_name, ' ', lower(replace(p_brand,'#',' ')), ' ', lower(p_type))"
NUM = "cast(p_partkey % 900 + 100 AS varchar(20))"
CTRY = "CASE p_partkey % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'India' ELSE 'France' END"
KEY = "cast(p_partkey AS varchar(20))"
SOURCE1 = f"SELECT concat('S1-', {KEY}) AS entity_id, {NAME} AS business_name, concat({NUM}, ' main street') AS business_address, {CTRY} AS country FROM part"
SOURCE2 = f"""SELECT concat('S2-', {KEY}) AS entity_id,
  CASE p_partkey % 6 WHEN 0 THEN upper({NAME}) WHEN 1 THEN concat({NAME}, ' pvt ltd')
    WHEN 2 THEN concat(lower(p_type), ' ', lower(replace(p_brand,'#',' ')), ' ', p_name)
    WHEN 3 THEN translate({NAME}, 'so', '50') WHEN 4 THEN concat({NAME}, ', inc')
    ELSE concat('the ', p_name, ' & ', lower(replace(p_brand,'#',' ')), ' ', lower(p_type)) END AS business_name,
  CASE WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 2 = 0 THEN concat('0', {NUM}, ' main st') ELSE concat({NUM}, ' main street') END AS business_address,
  {CTRY} AS country FROM part WHERE p_partkey % 5 <> 0"""
SOURCE3 = f"""SELECT concat('S3-', {KEY}) AS entity_id,
  concat(p_name, ' ', lower(replace(p_brand,'#',' ')), CASE WHEN p_partkey % 4 = 0 THEN ' llc' ELSE '' END) AS business_name,
  concat({NUM}, ' main street') AS business_address, {CTRY} AS country FROM part WHERE p_partkey % 7 IN (1, 2, 3)"""
TRUTH = f"""SELECT concat('S1-', {KEY}) AS query_id, concat('S2-', {KEY}) AS target_id FROM part WHERE p_partkey % 5 <> 0
  UNION ALL SELECT concat('S1-', {KEY}), concat('S3-', {KEY}) FROM part WHERE p_partkey % 7 IN (1, 2, 3)"""
SQL = {"s1": SOURCE1, "s2": SOURCE2, "s3": SOURCE3, "tgt": f"{SOURCE2} UNION ALL {SOURCE3}", "truth": TRUTH}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of s1, s2, s3, tgt (both target sources) and truth."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return merged(spark.sql(SQL[name].replace("FROM part", "FROM {part}"), part=part))
