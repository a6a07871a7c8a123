"""What the operators of this folder share: the shared folder, written tables, row access."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One character of white space, as the contracts of the operators define it.
SPACE = r"[\x20\x09-\x0D]"
#: Rows of numbers that may be broadcast, once counted: some 64 MB.
BROADCAST_ROWS = 2_000_000

#: Paths written inside each open scratch(), the innermost last.
_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests), a temporary folder is made and set;
    a cluster without a shared folder is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="linkloom-"))
    return context.getCheckpointDir().rstrip("/")


def written(df: DataFrame, name: str, paths: list[str] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder, in folders ``by`` columns, and read it back.

    ``paths`` takes down where it is.

    This cuts the lineage: a lost executor costs the running stage only, never the stages before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/linkloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=list(by) or None)
    for own in (*_open[-1:], *([paths] if paths is not None else ())):
        own.append(path)
    return spark.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside are deleted at the end.

    What the block makes for later has to be written after it, or by kept() inside it.
    """
    _open.append([])
    try:
        yield
    finally:
        deleted(spark, _open.pop())


def kept(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """written(), for a table that outlives the innermost scratch()."""
    own = _open.pop() if _open else None
    try:
        return written(df, name, paths)
    finally:
        if own is not None:
            _open.append(own)


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a written table, marked for broadcast if it is counted to have ``most`` rows or fewer.

    Beyond that a join shuffles both sides.
    """
    return F.broadcast(df) if df.count() <= most else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` hasn't, beginning with ``name``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_bytes(column: str = "text") -> Column:
    """The text as UTF-8 bytes; a null text counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")
