"""Scans of vendor files and sinks of results: whatever can't be read as its type is missing, not an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import core as O

#: Columns of a consensus file by type; a file may lack any of them.
CONSENSUS = {
    "string": ("ticker", "cusip", "oftic", "cname", "measure", "fiscalp", "fpi", "anntims_act"),
    "date": ("statpers", "fpedats", "anndats_act"),
    "double": ("actual", "meanest", "medest", "stdev", "numest", "numup", "numdown"),
}
#: Names under which a constituent list may have its ticker.
TICKER_NAMES = ("tic", "ticker", "symbol")


def text_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, every column as text under its name in lower case."""
    rows = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    return rows.toDF(*(c.lstrip("﻿").strip().lower() for c in rows.columns))


def consensus_scan(spark: SparkSession, path: str) -> DataFrame:
    """The columns of CONSENSUS; bad dates and numbers are missing, and so are columns that the file lacks."""
    rows = text_csv(spark, path)
    value = lambda c, kind: (F.col(c).try_cast(kind) if c in rows.columns else F.lit(None).cast(kind)).alias(c)
    return rows.select(*(value(c, kind) for kind, columns in CONSENSUS.items() for c in columns))


def announcements(consensus: DataFrame, *, years: tuple[int, int] | None = None, tickers: DataFrame | None = None, measure: str = "EPS", period: str = "QTR") -> DataFrame:
    """The snapshots of one measure and period with all that an announcement needs, in the years (inclusive) and, where
    `tickers` (column ticker) has any, of those."""
    rows = consensus.where((F.col("measure") == measure) & (F.col("fiscalp") == period)).na.drop(subset=["oftic", "anndats_act", "fpedats", "actual"])
    if years:
        rows = rows.where(F.year("anndats_act").between(*years))
    if tickers is not None and not tickers.isEmpty():
        rows = rows.withColumn("wanted", F.upper("oftic")).join(tickers.select(F.upper("ticker").alias("wanted")).distinct(), "wanted", "left_semi").drop("wanted")
    return rows


def price_scan(spark: SparkSession, path: str, needed: DataFrame, benchmark: str) -> DataFrame:
    """tic, date, price of the needed tickers (column tic) and the benchmark: positive prices, the first of a ticker's day."""
    rows = text_csv(spark, path).select(F.upper(F.trim("tic")).alias("tic"), F.col("date").try_cast("date").alias("date"), F.col("price").try_cast("double").alias("price"), F.monotonically_increasing_id().alias("sequence"))
    wanted = needed.select(F.upper("tic").alias("tic")).union(spark.range(1).select(F.lit(benchmark))).distinct()
    rows = rows.na.drop(subset=["tic", "date", "price"]).where((F.col("price") > 0) & (F.col("price") < float("inf"))).join(wanted, "tic", "left_semi")
    return O.keep_first(rows, ["tic", "date"], "sequence").drop("sequence")


def constituents(spark: SparkSession, path: str) -> DataFrame:
    """ticker: of a list's ticker column, or else its first, trimmed and in upper case, without blanks."""
    rows = text_csv(spark, path)
    column = next((c for c in TICKER_NAMES if c in rows.columns), rows.columns[0])
    return rows.select(F.upper(F.trim(f"`{column}`")).alias("ticker")).where(F.length("ticker") > 0)


def write_by_year(df: DataFrame, path: str, year: Column) -> None:
    """A Parquet folder partitioned by year, compressed with ZSTD. Spark cuts a large year into several tasks, and files."""
    df.withColumn("year", year).hint("rebalance", "year").write.option("compression", "zstd").partitionBy("year").parquet(path)


def read_years(spark: SparkSession, path: str, windows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of the years that the windows (low, high) touch; other partitions aren't read, absent ones are skipped."""
    touched = windows.select(F.explode(F.sequence(F.year("low"), F.year("high"))).alias("year")).distinct()
    years = [r.year for r in touched.collect()]  # as many as there are years
    return spark.read.parquet(path).where(F.col("year").isin(years)).select(*columns)


def missing_years(spark: SparkSession, path: str, years: range) -> DataFrame:
    """The expected years that a partitioned folder lacks."""
    return spark.range(years.start, years.stop).select(F.col("id").cast("int").alias("year")).join(spark.read.parquet(path).select("year").distinct(), "year", "left_anti")


def assert_complete(spark: SparkSession, path: str, years: range, tables: dict[str, DataFrame]) -> None:
    """Raises, naming all that is missing: years of the folder, and required tables without a row."""
    lacking = [str(r.year) for r in missing_years(spark, path, years).orderBy("year").collect()] + [name for name, df in tables.items() if df.isEmpty()]
    if lacking:
        raise ValueError("missing: " + ", ".join(lacking))


def unioned(parts: list[DataFrame]) -> DataFrame:
    """All rows under one schema: columns that a part lacks are missing there."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def fundamentals(rows: DataFrame, companies: DataFrame, years: tuple[int, int]) -> DataFrame:
    """Consolidated industrial reports in standard format of the wanted companies (gvkey), two years before the first on."""
    kept = rows.where("consol = 'C' and indfmt = 'INDL' and datafmt = 'STD' and popsrc = 'D'").where(F.year("datadate").between(years[0] - 2, years[1]))
    return kept.join(companies.select("gvkey").distinct(), "gvkey", "left_semi").drop("consol", "indfmt", "datafmt", "popsrc")


def daily_window(rows: DataFrame, securities: DataFrame, years: tuple[int, int]) -> DataFrame:
    """Daily rows of the wanted securities (permno), two years before the first on; the price without its sign."""
    return rows.where(F.year("date").between(years[0] - 2, years[1])).join(securities.select("permno").distinct(), "permno", "left_semi").withColumn("prc", F.abs("prc"))


def write_csv(df: DataFrame, path: str) -> None:
    """A result as CSV files with a header."""
    df.write.option("header", True).csv(path)
