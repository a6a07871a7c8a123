"""Tab-separated records, truth, candidates and scores: reading and writing."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

RECORD = T.StructType([T.StructField(n, T.StringType()) for n in ("entity_id", "business_name", "business_address", "country")])


def _read(spark: SparkSession, path: str, schema: T.StructType, header: bool = True, recursive: bool = False) -> DataFrame:
    options = {"sep": "\t", "header": header, "quote": "", "mode": "PERMISSIVE", "enforceSchema": True, "recursiveFileLookup": recursive}
    return spark.read.schema(schema).options(**options).csv(path).fillna("")


def records(spark: SparkSession, *paths: str, trim: bool = False, distinct: bool = False, unknown: str = "", recursive: bool = False) -> DataFrame:
    """All-text records of one or more files; missing fields are empty, a missing country is ``unknown``.

    With ``distinct`` one row of each id stays: the last by its other fields.
    """
    out = None
    for p in paths:
        part = _read(spark, p, RECORD, recursive=recursive)
        out = part if out is None else out.unionByName(part)
    if trim:
        out = out.select(*(F.trim(c).alias(c) for c in out.columns))
    if unknown:
        out = out.withColumn("country", F.when(F.col("country") == "", unknown).otherwise(F.col("country")))
    if distinct:
        rest = F.struct("business_name", "business_address", "country")
        out = out.groupBy("entity_id").agg(F.max(rest).alias("r")).select("entity_id", "r.*")
    return out


def names(spark: SparkSession, path: str) -> DataFrame:
    return records(spark, path).select("entity_id", "business_name")


def lists(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """(query_id, ids): a comma-separated list a query; an empty one is an empty array."""
    raw = _read(spark, path, T.StructType([T.StructField("query_id", T.StringType()), T.StructField("ids", T.StringType())]), header)
    return raw.select(F.trim("query_id").alias("query_id"), F.filter(F.transform(F.split("ids", ","), lambda x: F.trim(x)), lambda x: x != "").alias("ids"))


def pairs(listed: DataFrame) -> DataFrame:
    """(query_id, target_id, rank) of lists(); empty lists have no row."""
    return listed.select("query_id", F.posexplode("ids").alias("n", "target_id")).select("query_id", "target_id", (F.col("n") + 1).alias("rank"))


def scores(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, target_id, p) of lines ``id<tab>target:p;target:p``; an id may hold colons."""
    raw = _read(spark, path, T.StructType([T.StructField("query_id", T.StringType()), T.StructField("items", T.StringType())]))
    item = raw.select("query_id", F.explode(F.filter(F.split("items", ";"), lambda x: x != "")).alias("x"))
    return item.select("query_id", F.regexp_extract("x", "^(.*):([^:]*)$", 1).alias("target_id"), F.regexp_extract("x", "^(.*):([^:]*)$", 2).cast("double").alias("p"))


def wanted(targets: DataFrame, ids: DataFrame) -> DataFrame:
    """The records whose id is asked for."""
    return targets.join(ids.select(F.col("target_id").alias("entity_id")).distinct(), "entity_id", "left_semi")


def head(listed: DataFrame, n: int) -> DataFrame:
    """The first n by id: files have no stable order here."""
    return listed.orderBy("query_id").limit(n)


def joined(found: DataFrame, queries: DataFrame, by_id: bool = False, names: tuple[str, str] = ("source1_entity_id", "matched_entity_ids")) -> DataFrame:
    """Every query with its targets as one comma-separated text, by rank or, with ``by_id``, by id."""
    order = F.struct("target_id") if by_id else F.struct("rank", "target_id")
    ids = found.groupBy("query_id").agg(F.sort_array(F.collect_list(order))["target_id"].alias("ids"))
    own = queries.select("query_id").join(ids, "query_id", "left")
    return own.select(F.col("query_id").alias(names[0]), F.coalesce(F.array_join("ids", ","), F.lit("")).alias(names[1]))


def joined_scores(scored: DataFrame, queries: DataFrame, digits: int = 4, names: tuple[str, str] = ("source1_entity_id", "scored_candidates")) -> DataFrame:
    """Every query with its scored targets as ``target:p;...``, falling."""
    items = F.sort_array(F.collect_list(F.struct((-F.col("p")).alias("m"), "target_id")))
    own = queries.select("query_id").join(scored.groupBy("query_id").agg(items.alias("items")), "query_id", "left")
    text = F.array_join(F.transform("items", lambda x: F.format_string(f"%s:%.{digits}f", x["target_id"], -x["m"])), ";")
    return own.select(F.col("query_id").alias(names[0]), F.coalesce(text, F.lit("")).alias(names[1]))


def write_tsv(rows: DataFrame, path: str, mode: str = "overwrite", sep: str = "\t", header: bool = True) -> None:
    rows.write.mode(mode).options(sep=sep, header=header, quote="", escape="", emptyValue="").csv(path)


def write_presets(rows: DataFrame, path: str) -> None:
    """One folder a preset."""
    rows.write.mode("overwrite").partitionBy("preset").parquet(path)


def unfinished(queries: DataFrame, done: DataFrame) -> DataFrame:
    """What is left to do: a job that starts again appends these only."""
    return queries.join(done.select("query_id").distinct(), "query_id", "left_anti")


def resumed(queries: DataFrame, path: str, work: Callable[[DataFrame], DataFrame]) -> int:
    """Appends what ``work`` gives for the queries that the table at ``path`` lacks, and returns how many those were.

    ``work`` has to return one row for each query it is given, with query_id; what a broken run has
    committed stays, so a run that starts again does the rest only. Where nothing is left, nothing is written.
    """
    try:
        left = unfinished(queries, queries.sparkSession.read.parquet(path))
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        left = queries
    n = left.count()
    if n:
        work(left).write.mode("append").parquet(path)
    return n


def resynced(candidates: DataFrame, done: DataFrame) -> DataFrame:
    return candidates.join(done.select("query_id").distinct(), "query_id", "left_semi")


def extract(queries: DataFrame, per_country: int = 400) -> DataFrame:
    """The first records of each country, by id."""
    first = F.row_number().over(W.partitionBy("country").orderBy("entity_id"))
    return queries.withColumn("n", first).filter(F.col("n") <= per_country).drop("n")


def save_model(model: PipelineModel, path: str, about: dict) -> None:
    """The model, and beside it what it was made with (features, thresholds, version)."""
    model.write().overwrite().save(f"{path}/model")
    model_spark = SparkSession.getActiveSession()
    model_spark.createDataFrame([(json.dumps(about, sort_keys=True),)], "about string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    return PipelineModel.load(f"{path}/model"), json.loads(spark.read.text(f"{path}/about").first()[0])


def feature_set_of(about: dict, sets: dict[str, tuple[tuple[str, ...], str]]) -> str:
    """The set whose number of features a model has, where it doesn't name one."""
    return about.get("set") or next(k for k, (names, _) in sets.items() if len(names) == about["n_features"])


def report(statistics: DataFrame) -> str:
    """A table of 1,000 rows at most as Markdown; more are an error."""
    rows = statistics.limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("a report has 1,000 rows at most")
    line = lambda xs: "| " + " | ".join(map(str, xs)) + " |"
    return "\n".join([line(statistics.columns), line("-" * 3 for _ in statistics.columns), *(line(r) for r in rows)])


def merged(df: DataFrame) -> DataFrame:
    """``df``, and what is selected, exploded or summed up from it, is joined by sorting, never by broadcast.

    Spark takes the size of Parquet files, compressed, for that of their rows, and counts an exploded row once;
    so it would broadcast tables of millions of rows, which the driver can't hold.
    """
    return df.hint("merge")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet and read back: what several joins read is made once, and a lost executor costs one stage.

    It lies in the folder that driver and executors share, ``spark.checkpoint.dir``; where the session names none
    and runs on one machine, in a temporary one.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not at:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="linkloom-"))
        at = context.getCheckpointDir()
    path = f"{at.rstrip('/')}/linkloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return merged(spark.read.schema(df.schema).parquet(path))
