"""Streaming ingestion (an extension): arriving S2/S3 records are linked against the S1 keys as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkstone.functions.text import normalise
from linkstone.operators.blocking import key_rows, ranks


def link_arrivals(arrivals: DataFrame, query_keys: DataFrame, weights: DataFrame, max_df: int = 300, top: int = 3) -> DataFrame:
    """Best queries of the arriving records: a stream-static join on the blocking keys and a sum by pair.

    ``query_keys`` (country, id, src, key) and ``weights`` (country, key, df, idf) are of the batch side.
    """
    keys = key_rows(normalise(arrivals)).where("src > 1")
    usable = query_keys.where("src = 1").select("country", "key", F.col("id").alias("s1")).join(weights.where(F.col("df") <= max_df), ["country", "key"])
    pairs = keys.select("country", "key", F.col("id").alias("cand")).join(usable, ["country", "key"])
    return pairs.groupBy("country", "s1", "cand").agg(F.round(F.sum("idf"), 6).alias("sc"))


def run(arrivals: DataFrame, query_keys: DataFrame, weights: DataFrame, path: str, checkpoint: str, max_df: int = 300, top: int = 3):
    """Starts a query that appends each micro-batch's links to ``path``; a batch that is run again writes the same folder again."""

    def batch(rows: DataFrame, number: int) -> None:
        links = link_arrivals(rows, query_keys, weights, max_df)
        best = ranks(links.withColumn("sn", F.col("sc")).withColumn("sa", F.col("sc")), "cand").where(F.col("brank") < top).select("country", "s1", "cand", "sc")
        best.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return arrivals.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
