"""Files of the linkage: tab-separated records, gold and id lists, score tables, stage outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

RECORD = StructType([StructField(n, StringType()) for n in ("entity_id", "business_name", "business_address", "country")])
GOLD = StructType([StructField(n, StringType()) for n in ("source1_entity_id", "matched_entity_ids")])


def read_tsv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All columns strings; quotes, backslashes and the text NA are what they are; empty fields are empty strings."""
    return spark.read.csv(path, sep="\t", quote="", escape="", header=True, schema=schema, encoding="UTF-8").fillna("")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, RECORD).withColumn("src", F.substring("entity_id", 2, 1).cast("int"))


def read_gold(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(s1, cand) pairs, and all queries (s1) with or without a match."""
    rows = read_tsv(spark, path, GOLD).withColumnRenamed("source1_entity_id", "s1")
    pairs = rows.select("s1", F.explode(F.filter(F.split("matched_entity_ids", ","), lambda x: x != "")).alias("cand"))
    return pairs, rows.select("s1").distinct()


def read_fields(spark: SparkSession, path: str, columns: list[str], country: str | None = None, sources: list[int] | None = None, ids: DataFrame | None = None) -> DataFrame:
    """Pruned and filtered scan of normalised records; the filters reach the files."""
    rows = spark.read.parquet(path)
    if country is not None:
        rows = rows.where(F.col("country") == country)
    if sources is not None:
        rows = rows.where(F.col("src").isin(sources))
    if ids is not None:
        rows = rows.join(ids.select("entity_id"), "entity_id", "left_semi")
    return rows.select(*columns)


def read_pool(spark: SparkSession, path: str, columns: list[str], queries: DataFrame | None = None, low: str | None = None, high: str | None = None) -> DataFrame:
    """Pool pairs of a range of queries, and of those in ``queries`` (s1) if given; the range is pushed to the files."""
    rows = spark.read.parquet(path)
    if low is not None:
        rows = rows.where(F.col("s1") >= low)
    if high is not None:
        rows = rows.where(F.col("s1") < high)
    if queries is not None:
        rows = rows.join(queries.select("s1"), "s1", "left_semi")
    return rows.select(*columns)


def corpus_sample(rec: DataFrame, fraction: float = 0.1, seed: int = 0) -> DataFrame:
    """The same rows on every run: those whose id's hash falls in the fraction."""
    return rec.where(F.pmod(F.xxhash64("entity_id", F.lit(seed)), F.lit(10_000)) < int(10_000 * fraction))


def read_scores(spark: SparkSession, folder: str, prefix: str) -> DataFrame:
    """Score tables ``<prefix>_<number>.parquet`` only; other names with the prefix are left out."""
    return spark.read.option("pathGlobFilter", f"{prefix}_[0-9]*.parquet").option("recursiveFileLookup", "true").parquet(folder)


def id_lists(pairs: DataFrame, queries: DataFrame) -> DataFrame:
    """(s1, ids): a row for each query, its ids in order, joined by commas, empty if none."""
    lists = pairs.groupBy("s1").agg(F.array_join(F.array_sort(F.collect_set("cand")), ",").alias("ids"))
    return queries.select("s1").join(lists, "s1", "left").fillna({"ids": ""})


def write_id_lists(lists: DataFrame, path: str, header: tuple[str, str]) -> None:
    """Id lists as text parts in order of s1, each with the header."""
    ordered = lists.repartitionByRange("s1").sortWithinPartitions("s1")
    ordered.select(F.concat_ws("\t", "s1", "ids").alias("\t".join(header))).write.mode("overwrite").option("quote", "").option("emptyValue", "").option("ignoreTrailingWhiteSpace", False).option("header", True).option("sep", "\x01").csv(path)


def once(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A stage's table: read if a whole one is there, made and written if not."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def model_once(spark: SparkSession, path: str, make: Callable[[], PipelineModel]) -> PipelineModel:
    """A fitted model: loaded if a whole one is there, fitted and saved if not."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/metadata/_SUCCESS")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        make().write().overwrite().save(path)
    return PipelineModel.load(path)


def write_table(rows: DataFrame, path: str) -> None:
    """Any table as tab-separated text with a header, for reading by people."""
    rows.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(path)


def read_first_column(spark: SparkSession, path: str) -> DataFrame:
    """(entity_id): the first field of each line after the header."""
    lines = spark.read.option("header", True).option("sep", "\t").option("quote", "").csv(path)
    return lines.select(F.col(lines.columns[0]).alias("entity_id")).where("entity_id IS NOT NULL AND entity_id <> ''")


def write_token_map(mapping: DataFrame, path: str) -> None:
    mapping.select("native", "latin").write.mode("overwrite").json(path)


def read_token_map(spark: SparkSession, path: str, limit: int = 200_000) -> dict[str, str]:
    """The learned map as a dictionary; refuses one larger than ``limit`` words."""
    rows = spark.read.schema("native string, latin string").json(path).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"the token map has more than {limit} words")
    return {r["native"]: r["latin"] for r in rows}


def id_number(entity_id):
    """Column: source times 10^10 plus the number of an id; the string id stays the join key."""
    return F.substring(entity_id, 2, 1).cast("long") * F.lit(10**10) + F.substring(entity_id, 4, 20).cast("long")


def id_text(number):
    """Column: the id of such a number."""
    number = F.col(number) if isinstance(number, str) else number
    return F.concat(F.lit("S"), F.floor(number / F.lit(10**10)).cast("string"), F.lit("-"), F.pmod(number, F.lit(10**10)).cast("string"))
