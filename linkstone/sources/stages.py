"""Stage tables of a query: written once, read by all that follows."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame

#: Whether a query's shuffle files go at its end; a garbage collection alone leaves those of the last stage table until the next is made.
_REMOVED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a Parquet table in spark.checkpoint.dir, which all executors share; without that folder it is kept in memory and on disk.

    The lineage ends at the table, so nothing before it is computed twice, and Spark removes the shuffle
    files that made it as soon as it is written; what else is no longer referred to goes as the driver
    collects its garbage.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df.persist()
    path = f"{folder.rstrip('/')}/stage-{what}-{uuid.uuid4().hex}"
    before = spark.conf.get(_REMOVED, None)
    spark.conf.set(_REMOVED, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_REMOVED) if before is None else spark.conf.set(_REMOVED, before)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)
