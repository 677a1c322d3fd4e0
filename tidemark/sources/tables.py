"""Readers of the driver's tables and of landed files, with the derived views that the operators run on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PRICE_CSV = "Date string, Open string, High string, Low string, Close string, Volume string"
UNIVERSE_CSV = "cik string, ticker string, name string, source string, asof_date string"
SUBMISSIONS = "cik string, filings struct<recent: struct<form: array<string>, accessionNumber: array<string>, acceptanceDateTime: array<string>>>"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def price_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw daily price files, one for each ticker, the ticker being the file's name up to its first dot."""
    name = F.regexp_extract(F.input_file_name(), r"([^/.]+)[^/]*$", 1)
    return spark.read.schema(PRICE_CSV).option("header", True).csv(path).withColumn("ticker", F.upper(name))


def universe_csv(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The last universe file: index lists win over filing lists, later names over earlier ones."""
    rank = lambda p: (p.rsplit("/", 1)[-1].startswith("sp500_"), p.rsplit("/", 1)[-1])
    return spark.read.schema(UNIVERSE_CSV).option("header", True).csv(max(paths, key=rank))


def company_json(spark: SparkSession, path: str) -> DataFrame:
    """Companies landed as one JSON object of numbered records."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, struct<cik_str: bigint, ticker: string, title: string>>").alias("m"))
    return raw.select(F.explode(F.map_values("m")).alias("r")).select("r.*")


def submissions_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SUBMISSIONS).option("multiLine", True).json(path)


def _file() -> Column:
    """The file that a row comes from, in one spelling of local paths."""
    return F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:///").alias("file")


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(file, length) of all files, empty ones too, which scans leave out; the driver holds their names, as it does to scan them."""
    found = spark.read.format("binaryFile").load(path)
    listed = spark.createDataFrame([(name,) for name in found.inputFiles()], "file string").withColumn("file", F.regexp_replace("file", "^file:/+", "file:///"))
    return listed.join(found.select(_file(), "length"), "file", "left").select("file", F.coalesce("length", F.lit(0)).cast("long").alias("length"))  # contents aren't read


def landed_prices(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """price_csv() of the files that hold a usable row, with their file, and (file, length, reason) of those that don't: empty, "No data" or broken ones.

    A row is usable if its date and close can be read. Single bad rows of a good file are left to cleaning.
    """
    files, rows = _files(spark, path), price_csv(spark, path).select("*", _file())
    usable = F.expr("try_cast(Date AS DATE)").isNotNull() & F.expr("try_cast(Close AS DOUBLE)").isNotNull()
    good = rows.where(usable).groupBy("file").agg(F.count(F.lit(1)).alias("usable"))
    reason = F.when(F.col("length") == 0, "empty").otherwise("no usable row")
    return rows.join(good.select("file"), "file", "left_semi"), files.join(good, "file", "left_anti").select("file", "length", reason.alias("reason"))


def landed_submissions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cik, filings, file) of the files that are JSON objects, and (file, length, reason) of the others.

    Files are read as variants: a list that is missing, or of another type, is null and gives no filings, whatever other files have there.
    """
    text = spark.read.text(path, wholetext=True).select("value", _file())
    files = _files(spark, path)
    parsed = text.select("file", F.try_parse_json("value").alias("v"))
    parsed = parsed.where(F.schema_of_variant("v").startswith("OBJECT"))
    of = lambda name: F.try_variant_get("v", f"$.filings.recent.{name}", "array<string>").alias(name)
    recent = F.struct(*[of(name) for name in ("form", "accessionNumber", "acceptanceDateTime")]).alias("recent")
    docs = parsed.select(F.try_variant_get("v", "$.cik", "string").alias("cik"), F.struct(recent).alias("filings"), "file")
    reason = F.when(F.col("length") == 0, "empty").otherwise("no JSON object")
    return docs, files.join(parsed.select("file"), "file", "left_anti").select("file", "length", reason.alias("reason"))


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees; a temporary one where none is named and all tasks run in this process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back, for what several jobs read."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def there(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def deleted(context: SparkContext, path: str | None) -> None:
    """Delete a folder that nothing reads any more, if one is named."""
    if path:
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def first_table(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """The first of the Parquet tables that is there: boosted predictions before ridge ones, or an optional report; None without any."""
    return next((spark.read.parquet(p) for p in paths if there(spark, p)), None)


def settings(spark: SparkSession, path: str) -> dict:
    """A small YAML file of settings, read once by the driver."""
    import yaml

    return yaml.safe_load(spark.read.text(path, wholetext=True).first().value) or {}


def write_report_csv(df: DataFrame, path: str) -> None:
    """Small result tables as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def prices(spark: SparkSession, folder: str) -> DataFrame:
    """(ticker, date, close, volume) by supplier and day, and the market MKT; exact integer sums before one division."""
    li = table(spark, folder, "lineitem").select(
        F.col("l_suppkey"), F.to_date("l_shipdate").alias("date"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("c"), F.col("l_quantity").cast("bigint").alias("v")
    )
    # suppliers' days and the market's in one pass over the table
    by = li.groupingSets([["l_suppkey", "date"], ["date"]], "l_suppkey", "date").agg(F.grouping("l_suppkey").alias("all"), F.sum("c").alias("c"), F.sum("v").alias("v"))
    ticker = F.when(F.col("all") == 1, F.lit("MKT")).otherwise(F.concat(F.lit("S"), "l_suppkey"))
    return by.select(ticker.alias("ticker"), "date", (F.lit(1000.0) + F.sqrt(F.col("c").cast("double") / (F.lit(100.0) * F.col("v").cast("double")))).alias("close"), F.col("v").alias("volume"))


def filings(spark: SparkSession, folder: str) -> DataFrame:
    """(event_id, ticker, form, accepted_utc, trade_date, pred) of orders."""
    seller = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("sk"))
    key = F.col("o_orderkey")
    return table(spark, folder, "orders").join(seller, key == F.col("l_orderkey")).select(
        key.alias("event_id"), F.concat(F.lit("S"), "sk").alias("ticker"), F.col("o_orderstatus").alias("form"),
        F.timestamp_add("SECOND", ((key * 7919) % 86400).cast("int"), F.col("o_orderdate").cast("timestamp")).alias("accepted_utc"),
        F.to_date("o_orderdate").alias("trade_date"), (((key * 2654435761) % 1000003).cast("double") / 1000003.0).alias("pred"),
    )


def signals(spark: SparkSession, folder: str) -> DataFrame:
    """(event_id, ticker, date, pred, y_true) of events."""
    key = F.col("event_id")
    return table(spark, folder, "events").select(key, F.concat(F.lit("U"), "user_id").alias("ticker"), F.to_date("ts").alias("date"), (((key * 2654435761) % 1000003).cast("double") / 1000003.0).alias("pred"), F.col("value").alias("y_true"))
