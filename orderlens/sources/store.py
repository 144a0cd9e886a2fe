"""The star schema and report tables as files."""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from orderlens.plans.star import Star, iso_text

STAR_TABLES = ("fact_orders", "dim_customers", "dim_products", "dim_sellers", "dim_date")
EXTRACTS = ("monthly_kpis", "category_breakdown", "regional_delivery", "seller_leaderboard")


class CountMismatch(Exception):
    """Raised when a written table does not hold the rows that were sent to it."""


def write_table(df: DataFrame, path: str, partition_by: str | None = None) -> int:
    """Replace the Parquet table at `path`; verify its row count and return it.

    Rows are counted while they are written, so nothing is computed twice; reading the count
    back touches file footers only.
    """
    sent = Observation()
    observed = df.observe(sent, F.count(F.lit(1)).alias("n"))
    writer = observed.write.mode("overwrite")
    if partition_by:
        # Rebalancing gives each month few files and splits a month that is too large for one.
        writer = observed.hint("rebalance", partition_by).write.mode("overwrite")
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    stored = df.sparkSession.read.parquet(path).count()
    if stored != sent.get["n"]:
        raise CountMismatch(f"{path}: sent {sent.get['n']} rows, found {stored}")
    return stored


def with_year_month(fact: DataFrame) -> DataFrame:
    return fact.withColumn("year_month", F.date_format("order_purchase_timestamp", "yyyy-MM"))


# Names the folder of the version that readers see; the only file of a store that is ever replaced.
POINTER = "CURRENT"
KEPT_VERSIONS = 2


def _files(spark: SparkSession, path: str):
    """The file system of a path, and Hadoop's path class."""
    jvm = spark._jvm
    return jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def current_version(spark: SparkSession, directory: str) -> str | None:
    """The version of the store that readers see, or nothing before the first one is complete."""
    try:
        return spark.read.text(f"{directory}/{POINTER}").first()["value"]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _publish(spark: SparkSession, directory: str, version: str) -> None:
    """Let the pointer name `version`: a new file takes its place in one rename."""
    jvm = spark._jvm
    files, path = _files(spark, directory)
    draft = path(f"{directory}/.{POINTER}-{version}")
    out = files.create(draft, True)
    out.write(bytearray(version.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(files.makeQualified(draft), files.makeQualified(path(f"{directory}/{POINTER}")), how)


def _drop_old(spark: SparkSession, directory: str, kept: int) -> None:
    """Remove all but the latest complete and incomplete versions; readers may still be in the one before."""
    files, path = _files(spark, directory)
    found = sorted(f.getPath().getName() for f in files.listStatus(path(directory)) if f.getPath().getName().startswith("version-"))
    for name in found[:-kept]:
        files.delete(path(f"{directory}/{name}"), True)


def write_star(star: Star, directory: str, by_month: bool = True, kept: int = KEPT_VERSIONS) -> dict[str, int]:
    """Full refresh of the five tables; the fact is laid out by purchase month.

    All tables are written to a folder of their own and their counts verified before the pointer
    names it: a refresh that fails anywhere leaves the former star as it is, and readers see the
    tables of one refresh only.  The `kept` latest versions stay on disk.
    """
    spark = star.fact.sparkSession
    version = f"version-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    counts = {}
    for name, df in star.tables().items():
        path = f"{directory}/{version}/{name}"
        if name == "fact_orders" and by_month:
            counts[name] = write_table(with_year_month(df), path, "year_month")
        else:
            counts[name] = write_table(df, path)
    _publish(spark, directory, version)
    _drop_old(spark, directory, kept)
    return counts


def read_star(spark: SparkSession, directory: str) -> Star:
    """The tables of the current version; without versions, those that lie in the folder itself."""
    version = current_version(spark, directory)
    root = f"{directory}/{version}" if version else directory
    fact, customers, products, sellers, dates = (
        spark.read.parquet(f"{root}/{name}") for name in STAR_TABLES
    )
    # The month that lays out the stored fact is no column of the star.
    return Star(fact.drop("year_month"), customers, products, sellers, dates)


def write_csv(df: DataFrame, path: str, single: bool = False, compression: str | None = None) -> None:
    """CSV with a header; `single` merges the parts and is meant for report-sized tables."""
    writer = (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True)
    writer.csv(path, compression=compression)


def export_star(star: Star, directory: str, compression: str | None = None) -> None:
    """The five tables as CSV; plain text takes about six times the disk of the stored tables."""
    for name, df in star.tables().items():
        write_csv(iso_text(df), f"{directory}/{name}", compression=compression)


def export_extracts(extracts: Mapping[str, DataFrame], directory: str) -> None:
    for name in EXTRACTS:
        write_csv(extracts[name], f"{directory}/{name}", single=True)


def read_extracts(spark: SparkSession, directory: str) -> dict[str, DataFrame] | None:
    """The four dashboard extracts, or nothing when any of them has not been exported."""
    schemas = {
        "monthly_kpis": "year_month string, total_gmv double, total_orders long, "
        "avg_order_value double, on_time_rate double, avg_delivery_days double, "
        "avg_review_score double",
        "category_breakdown": "product_category string, revenue double, order_count long, "
        "avg_review double, late_rate double",
        "regional_delivery": "customer_state string, total_orders long, "
        "avg_delivery_days double, late_rate double, avg_review double, total_revenue double",
        "seller_leaderboard": "seller_id string, seller_city string, seller_state string, "
        "total_items_sold long, total_revenue double, avg_review_score double",
    }
    frames = {}
    for name in EXTRACTS:
        try:
            frames[name] = spark.read.csv(
                f"{directory}/{name}", header=True, schema=schemas[name]
            )
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
    return frames


def write_results(df: DataFrame, path: str) -> None:
    """Result rows of tests and model evaluations (name/value tables)."""
    df.write.mode("overwrite").parquet(path)
