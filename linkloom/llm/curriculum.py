"""Mixing sources to target weights over training time. DataFrame functions only.

Each source has a weight schedule w(t) over training time t from 0 to 1, linear from a to b. Its integral
W(t) is the part of the source's tokens that are due by t. A document that lies at part u of its source's
token demand is trained at the t with W(t) = u W(1), that is t = (a + b) u / (a + sqrt(a^2 + (b^2 - a^2) u)).
The mixture is range-sorted by t.

Running sums need no large window: documents go to bins of their source by the MD5 of their id, as many as
keep a bin at some 65,536 rows (4,096 at least); the bins' sums are added up, and a window adds up within a bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from linkloom.llm.common import documents, small, written

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Weight schedules (at the start, at the end) of the sources, repeating: early, even, late.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
#: No document is taken more often.
MOST_REPEATS = 3
#: Least number of hexadecimal digits of the hash that name a bin, and rows a bin that ask for one more.
BIN_DIGITS, BIN_ROWS = 3, 65_536


def word_count(text_col: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _of(values: tuple[float, ...], rank: Column) -> Column:
    return F.element_at(F.array(*(F.lit(float(v)) for v in values)), F.pmod(rank, F.lit(len(values))).cast("int") + 1)


def source_targets(sizes: DataFrame) -> DataFrame:
    """(key, source_size, target, a, b) for each source of ``sizes`` (key, source_size).

    The weights share the sum of all sizes; what is above MOST_REPEATS times a source's size goes to the
    others by weight, until none is above: target = min(level * weight, limit), with one level for all.
    Ordered by limit / weight, the level is that of the first source that stays below its limit.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy("key")) - 1)
    ranked = ranked.select("*", _of(WEIGHTS, F.col("rank")).alias("w"), _of([s[0] for s in SCHEDULES], F.col("rank")).alias("a"), _of([s[1] for s in SCHEDULES], F.col("rank")).alias("b"))
    ranked = ranked.withColumn("limit", F.col("source_size") * float(MOST_REPEATS)).withColumn("ratio", F.col("limit") / F.col("w"))
    order = W.orderBy("ratio", "key")
    whole = W.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing))
    ranked = ranked.withColumn("level", level)
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "key", "level"))).over(whole)["level"]
    return ranked.withColumn("target", F.least(first * F.col("w"), F.col("limit"))).select("key", "source_size", "target", "a", "b")


def placed(sizes: DataFrame) -> DataFrame:
    """``sizes`` (id, source, size[, row]) with source_size, target, copies, position (of the first copy; null if none).

    A source is gone through in hash order as often as its target holds it whole, then up to the document
    whose middle passes the target. Rows with equal ids lie side by side. Null sources are one source, the
    last; a null id sorts first in its bin; empty tables give empty results. before, a and b go along.
    """
    digits = BIN_DIGITS
    n = sizes.count()
    while n > BIN_ROWS << (4 * digits):
        digits += 1
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("d"), F.col("source")))
    hashed = F.coalesce(F.md5(F.col("id").cast("string").cast("binary")), F.lit(""))
    keyed = sizes.select("*", key.alias("key"), hashed.alias("h"), F.substring(hashed, 1, digits).alias("bin"))
    bins = written(keyed.groupBy("key", "bin").agg(F.sum("size").alias("bin_size")), "bins")
    sources = source_targets(bins.groupBy("key").agg(F.sum("bin_size").alias("source_size")))
    upto = W.partitionBy("key").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    bins = bins.withColumn("offset", F.coalesce(F.sum("bin_size").over(upto), F.lit(0))).drop("bin_size").join(sources, "key")
    within = W.partitionBy("key", "bin").orderBy("h", "id", "size").rowsBetween(W.unboundedPreceding, -1)
    before = F.col("offset") + F.coalesce(F.sum("size").over(within), F.lit(0))
    own = keyed.join(bins, ["key", "bin"]).withColumn("before", before)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MOST_REPEATS))).otherwise(F.lit(1))
    own = own.withColumn("whole", whole)
    more = (F.col("before") + F.col("size") / 2.0) < F.col("target") - F.col("whole") * F.col("source_size")
    own = own.withColumn("copies", (F.col("whole") + F.when(more & (F.col("whole") < MOST_REPEATS), 1).otherwise(0)).cast("int"))
    own = own.withColumn("position", F.when(F.col("copies") > 0, _position(F.lit(0))))
    return own.select(*sizes.columns, "source_size", "target", "copies", "position", "before", "a", "b")


def _position(copy: Column) -> Column:
    """Training time of a copy: the inverse of its source's cumulative demand."""
    u = F.when(F.col("target") > 0, F.least((copy * F.col("source_size") + F.col("before") + F.col("size") / 2.0) / F.col("target"), F.lit(1.0))).otherwise(F.lit(0.0))
    a, b = F.col("a"), F.col("b")
    return (a + b) * u / (a + F.sqrt(a * a + (b * b - a * a) * u))


def mixture(docs: DataFrame, size: Column, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The mixture itself: each document as often as it is taken, in training order, with docs' columns.

    Ids, sources and sizes are placed first, and the rows looked up; where ids repeat or are null, whole rows are placed.
    Both give the same. Nulls as in placed(); columns may have any names; an empty table gives an empty result.
    """
    own = [F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size")]
    row = F.struct(*(F.col(c) for c in docs.columns)).alias("row")
    sizes = written(docs.select(*own), "sizes")
    if sizes.groupBy("id").count().filter("count > 1 OR id IS NULL").isEmpty():
        taken = written(placed(sizes).filter("copies > 0"), "taken")
        found = docs.select(F.col(id_col).alias("row_id"), row).join(small(taken), F.col("row_id") == F.col("id"))
    else:
        found = placed(docs.select(*own, row)).filter("copies > 0")
    copies = found.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    return copies.select("row", "id", "copy", _position(F.col("copy")).alias("at")).orderBy("at", "id", "copy").select(*(F.col("row")[c].alias(c) for c in docs.columns))


def op9_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = placed(written(documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "source", word_count().alias("size")), "sizes"))
    return own.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("bigint").alias("taken"), "copies", "position").orderBy("position", "doc_id")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS k FROM d GROUP BY source
), w AS (
  SELECT *, [5.0, 2.0, 1.0][(k % 3 + 1)::INT]::DOUBLE AS w, [1.5, 1.0, 0.5][(k % 3 + 1)::INT]::DOUBLE AS a,
    [0.5, 1.0, 1.5][(k % 3 + 1)::INT]::DOUBLE AS b, source_size * 3.0::DOUBLE AS lim FROM s
), l AS (
  SELECT *, lim / w AS ratio, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(lim) OVER (ORDER BY lim / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(w) OVER (ORDER BY lim / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), t AS (
  SELECT source, source_size, a, b, least((SELECT level FROM l WHERE level <= ratio ORDER BY ratio, k LIMIT 1) * w, lim) AS target FROM l
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.a, t.b,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(d.doc_id::VARCHAR), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before,
    CASE WHEN t.source_size > 0 THEN least(floor(t.target / t.source_size), 3) ELSE 1 END AS whole
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, (whole + CASE WHEN before + size / 2.0::DOUBLE < target - whole * source_size AND whole < 3 THEN 1 ELSE 0 END)::INT AS copies,
    CASE WHEN target > 0 THEN least((before + size / 2.0::DOUBLE) / target, 1.0) ELSE 0.0 END AS u FROM p
)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies,
  CASE WHEN copies > 0 THEN (a + b) * u / (a + sqrt(a * a + (b * b - a * a) * u)) END AS position FROM c
"""
