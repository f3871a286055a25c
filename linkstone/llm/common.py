"""Helpers shared by the operators: table access, stage tables in shared storage, Arrow slicing."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark only (the path may be of any store Spark knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, in one machine's local mode, a temporary one where that is unset."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="linkstone-"))
    return _OWN_DIR[0]


def stash(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again: the lineage ends there,
    so a lost executor costs a reread and not a recomputation, and the columns are compressed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def empty(df: DataFrame) -> bool:
    return not df.take(1)


def slices(batches: Iterable[pa.RecordBatch], column: str | None, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds about ``limit`` bytes in each piece (one row at least)."""
    for batch in batches:
        if column is None or batch.num_rows == 0:
            if batch.num_rows:
                yield batch
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).cumsum()
        start = 0
        while start < batch.num_rows:
            base = sizes[start - 1] if start else 0
            stop = max(start + 1, int(sizes.searchsorted(base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_of(df: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The id columns and the text, with null texts as empty ones."""
    return df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("text"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores more as it takes to be none of the frame's columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
