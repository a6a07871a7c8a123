"""Exact deduplication with a two-pass Bloom filter.

Pass one hashes every text and finds the filter's bits that were set twice or more; pass two asks that
filter about every hash. A text that was seen once has, but for false positives, a bit that was set once,
and passes straight through: only possibly repeated rows shuffle. False positives cost a shuffled row,
never a wrong result, since those rows are grouped by their full digest.

The filter has BITS_PER_ROW bits a row. It is cut into slices by hash, of at most SLICE_BITS each, made,
asked and dropped one after the other, so that what the driver gathers and broadcasts at a time stays within
32 MiB however many rows there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from linkloom.llm.common import SPACE, documents, fresh, small, written

BITS_PER_ROW = 16
PROBES = 3
#: Bits of a slice's filter: 32 MiB at most.
SLICE_BITS = 28
#: Bits of a segment, the unit in which tasks' filters are merged.
SEGMENT_BITS = 20
#: Odd 64-bit multipliers, one a probe.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def probes(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """The filter's positions of each hash."""
    x = np.ascontiguousarray(h).view(np.uint64)
    return [(x * np.uint64(m)) >> np.uint64(64 - bits) for m in MULTIPLIERS[:PROBES]]


def _once_and_twice(positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, count = np.unique(positions, return_counts=True)
    return found, found[count > 1]


def _segments(once: np.ndarray, twice: np.ndarray) -> list[tuple[int, bytes, bytes]]:
    """The sorted positions by segment, as offsets in it."""
    at = np.unique(once >> np.uint64(SEGMENT_BITS))
    low = np.uint64((1 << SEGMENT_BITS) - 1)

    def part(x: np.ndarray, s: np.uint64) -> bytes:
        i, j = np.searchsorted(x, [s << np.uint64(SEGMENT_BITS), (s + np.uint64(1)) << np.uint64(SEGMENT_BITS)])
        return (x[i:j] & low).astype("<u4").tobytes()

    return [(int(s), part(once, s), part(twice, s)) for s in at]


def twice_filter(hashes: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of the positions that two or more rows of ``hashes`` (h) set."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column(0).to_numpy()
            # A row sets a position once, even if two of its probes meet there.
            p = np.sort(np.stack(probes(h, bits), axis=1), axis=1)
            new = np.ones(p.shape, bool)
            new[:, 1:] = p[:, 1:] != p[:, :-1]
            rows = _segments(*_once_and_twice(p[new]))
            s, once, twice = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], names=["segment", "once", "twice"])

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        every = np.concatenate([np.frombuffer(x, "<u4") for x in rows.once])
        seen = np.concatenate([_once_and_twice(every)[1], *(np.frombuffer(x, "<u4") for x in rows.twice)])
        bitmap = np.zeros(1 << SEGMENT_BITS, bool)
        bitmap[seen] = True
        return pd.DataFrame({"segment": rows.segment[:1], "bitmap": [np.packbits(bitmap, bitorder="little").tobytes()]})

    parts = hashes.select("h").mapInArrow(gather, "segment bigint, once binary, twice binary").groupBy("segment").applyInPandas(merge, "segment bigint, bitmap binary")
    out = np.zeros(max(1 << bits, 1 << SEGMENT_BITS) // 8, np.uint8)
    for row in parts.toLocalIterator():
        at = row.segment << (SEGMENT_BITS - 3)
        out[at : at + (1 << (SEGMENT_BITS - 3))] = np.frombuffer(row.bitmap, np.uint8)
    return out[: max(1, (1 << bits) // 8)]


def possibly_repeated(rows: DataFrame) -> DataFrame:
    """``rows`` (with a long column h) and a boolean column maybe: true wherever h occurs twice or more.

    Of several slices each is a folder of a written table; its filter is made, asked and dropped before the
    next one's, so one filter is alive at a time and each row is read twice, however many slices there are.
    """
    spark = rows.sparkSession
    bits = max(SEGMENT_BITS, (max(1, rows.count()) * BITS_PER_ROW - 1).bit_length())
    slices = 1 << max(0, bits - SLICE_BITS)
    bits = min(bits, SLICE_BITS)
    names, schema = rows.columns, T.StructType([*rows.schema.fields, T.StructField("maybe", T.BooleanType(), False)])
    if slices == 1:
        return _asked(rows, names, schema, spark.sparkContext.broadcast(twice_filter(rows, bits)), bits)
    cut = written(rows.withColumn("slice", F.pmod(F.col("h"), F.lit(slices)).cast("int")), "slices", by=("slice",))
    out = None
    for k in range(slices):
        part = cut.filter(F.col("slice") == k).select(*names)
        twice = spark.sparkContext.broadcast(twice_filter(part, bits))
        asked = written(_asked(part, names, schema, twice, bits), "asked")
        twice.destroy()
        out = asked if out is None else out.unionByName(asked)
    return out


def _asked(rows: DataFrame, names: list[str], schema: T.StructType, twice: Broadcast, bits: int) -> DataFrame:
    """``rows`` with the filter's answer for each."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = twice.value
        for b in batches:
            maybe = np.ones(b.num_rows, bool)
            for p in probes(b.column(names.index("h")).to_numpy(), bits):
                maybe &= (bitmap[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(maybe)], names=[*names, "maybe"])

    return rows.mapInArrow(ask, schema)


def normalised(text_col: str = "text") -> Column:
    """The text with each run of white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), f"{SPACE}+", " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for every row of ``docs``.

    Of rows with equal normalised texts the one with the smallest id stays (nulls last); of several with
    that same id, one. Null and empty texts are equal. An empty table gives an empty result; other
    columns are not read.
    """
    digests = written(docs.select(F.col(id_col).alias("id"), F.sha2(normalised(text_col).cast("binary"), 256).alias("text_sha256")), "digests")
    marked = possibly_repeated(digests.withColumn("h", F.xxhash64("text_sha256"))).drop("h")
    alone = marked.filter(~F.col("maybe")).select("id", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    some = marked.filter("maybe").drop("maybe")
    groups = small(written(some.groupBy("text_sha256").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups"))
    # Rows that share digest and id are numbered; a group of copies has an id a row, so no window is large.
    numbered = some.withColumn("n", F.row_number().over(W.partitionBy("text_sha256", "id").orderBy(F.lit(0))))
    repeated = numbered.join(groups, "text_sha256").select("id", "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("n") == 1)).alias("kept"), "text_sha256")
    return alone.unionByName(repeated).withColumnRenamed("id", id_col)


def exact_copies_dropped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that exact_groups() doesn't keep; all columns stay as they are, whatever their names.

    Null and empty texts are equal, null ids come last, of the same row twice one stays; an empty table gives
    an empty result. The few rows that go are looked up; texts move only where those are too many to broadcast.
    """
    found = written(exact_groups(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.col("text_sha256").alias("sha"), "kept"), "kept")
    key, own = fresh(docs, "id_that_goes"), fresh(docs, "own_sha")
    sha = fresh(docs, "sha_that_goes")
    goes = found.filter(~F.col("kept")).select(F.col("id").alias(key), F.col("sha").alias(sha)).distinct()
    stays = found.filter("kept").select(F.col("id").alias(key), F.col("sha").alias(sha))
    # An id that stays with another text or with a second row of the same can't be dropped by itself.
    mixed_ids = goes.join(stays, goes[key].eqNullSafe(stays[key]), "left_semi")
    if mixed_ids.isEmpty():
        gone = small(written(goes.select(key).distinct(), "gone"))
        return docs.join(gone, F.col(id_col).eqNullSafe(F.col(key)), "left_anti")
    keyed = docs.withColumn(own, F.sha2(normalised(text_col).cast("binary"), 256))
    match = F.col(id_col).eqNullSafe(F.col(key)) & (F.col(own) == F.col(sha))
    partly = goes.join(stays, goes[key].eqNullSafe(stays[key]) & (goes[sha] == stays[sha]), "left_semi")
    stay = keyed.join(goes, match, "left_anti").select(*docs.columns)
    one = keyed.join(partly, match, "left_semi").dropDuplicates([id_col, own]).select(*docs.columns)
    return stay.unionByName(one)


def op3_bloom_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""
