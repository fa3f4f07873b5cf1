"""Market tables on disk: partitioned scans with optional tables, sinks, report writers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The tables of a saved market. The first three are required.
MARKET_TABLES = ("securities", "prices", "fundamentals", "estimates", "shares", "membership", "index_prices")
REQUIRED = ("securities", "prices", "fundamentals")


def save_market(tables: Mapping[str, DataFrame], metadata: DataFrame, path: str, mode: str = "errorifexists"):
    """One parquet table each; prices by year so that a date condition prunes files."""
    for name, df in tables.items():
        if name not in MARKET_TABLES:
            raise KeyError(f"unknown market table: {name}")
        if name == "prices":
            dated = df.withColumn("year", F.year("date"))
            dated.repartition("year", F.pmod(F.xxhash64("security_id"), F.lit(64))).write.mode(mode).partitionBy("year").parquet(f"{path}/{name}")
        else:
            df.write.mode(mode).parquet(f"{path}/{name}")
    metadata.write.mode(mode).json(f"{path}/metadata")


def exists(spark: SparkSession, path: str) -> bool:
    """Through the file system of the path, so that object stores and HDFS work alike."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    location = jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(conf).exists(location)


def load_market(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Lazy scans of the tables that exist, and metadata with data-quality warnings added."""
    found = {n: spark.read.parquet(f"{path}/{n}") for n in MARKET_TABLES if exists(spark, f"{path}/{n}")}
    missing = [n for n in REQUIRED if n not in found]
    if missing:
        raise FileNotFoundError(f"no {missing} under {path}")
    metadata = spark.read.json(f"{path}/metadata")
    universe = F.col("universe") if "universe" in metadata.columns else F.lit(None).cast("string")
    adjusted_only = F.lit("price_close" not in found["prices"].columns)
    warnings = F.array_compact(
        F.array(
            F.when(adjusted_only, F.lit("levels use dividend-adjusted prices (look-ahead bias)")),
            F.when(
                universe.isNull() | universe.startswith("current members only"),
                F.lit("current members only: strong survivorship bias"),
            ),
        )
    )
    return found, metadata.withColumn("warnings", warnings)


def wide_to_long(wide: DataFrame, value: str, date: str = "date", key: str = "security_id") -> DataFrame:
    """A date x security matrix as rows; cells without a value are dropped."""
    names = [c for c in wide.columns if c != date]
    return wide.unpivot([date], names, key, value).where(F.col(value).isNotNull())


def write_report(tables: Mapping[str, DataFrame], path: str, mode: str = "errorifexists") -> None:
    """Report tables as CSV with a header, a directory each."""
    for name, df in tables.items():
        flat = [
            F.to_json(c).alias(c) if kind.startswith(("array", "struct", "map")) else F.col(c)
            for c, kind in df.dtypes
        ]
        df.select(*flat).write.mode(mode).option("header", True).csv(f"{path}/{name}")


def write_keyed_json(df: DataFrame, key: str, path: str, file_rows: int = 100_000, mode: str = "errorifexists") -> None:
    """One JSON document per row in files of at most ``file_rows``, in order of the key, and an index
    with each file's smallest and largest key and its rows. Files follow the data's size, not the
    number of keys. Rows without a key come first and are found by reading the whole."""
    spark, docs = df.sparkSession, f"{path}/documents"
    ordered = df.repartitionByRange(F.col(key).asc_nulls_first()).sortWithinPartitions(F.col(key).asc_nulls_first())
    ordered.write.mode(mode).option("maxRecordsPerFile", file_rows).json(docs)
    written = spark.read.schema(df.schema).json(docs).select(key, F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"))
    index = written.groupBy("file").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count(F.lit(1)).alias("rows"))
    index.write.mode(mode).parquet(f"{path}/index")


def read_keyed_json(spark: SparkSession, path: str, key: str, schema, keys: Sequence | None = None) -> DataFrame:
    """The documents, or those of ``keys``: then only files whose range holds one of them are opened."""
    docs = f"{path}/documents"
    if keys is None:
        return spark.read.schema(schema).json(docs)
    wanted = F.array(*map(F.lit, keys))
    near = spark.read.parquet(f"{path}/index").where(F.exists(wanted, lambda k: (k >= F.col("first")) & (k <= F.col("last"))))
    files = [f"{docs}/{r.file}" for r in near.select("file").collect()]  # at most a file a key asked
    found = spark.read.schema(schema).json(files) if files else spark.createDataFrame([], schema)
    return found.where(F.col(key).isin(list(keys)))
