"""Identifier links: ticker to security to company, each with a validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import adapters as A

FAR = "2099-12-31"


def valid_until(ends: Column) -> Column:
    """A link without an end holds until the far future; text that is no date is missing."""
    return F.when(ends.isNull(), F.lit(FAR).cast("date")).otherwise(ends.try_cast("date"))


def security_links(links: DataFrame, tickers: DataFrame) -> DataFrame:
    """Ticker links of the wanted tickers (column ticker), as dates."""
    return links.withColumn("ticker", F.upper("ticker")).join(tickers.select("ticker").distinct(), "ticker", "left_semi").withColumn("sdate", F.col("sdate").try_cast("date")).withColumn("edate", valid_until(F.col("edate")))


def primary_companies(links: DataFrame) -> DataFrame:
    """Researched and unresearched primary links only, with the company key in one form."""
    return links.where(F.col("linktype").isin("LU", "LC") & F.col("linkprim").isin("P", "C")).withColumn("gvkey", S.company_key(F.col("gvkey"))).withColumn("linkenddt", valid_until(F.col("linkenddt")))


def joined(securities: DataFrame, companies: DataFrame) -> DataFrame:
    """ticker, permno, gvkey with both ends of validity; a security without a company keeps a null key."""
    return securities.join(companies.select("permno", "gvkey", "linkenddt"), "permno", "left")


def last_link(links: DataFrame, value: str) -> DataFrame:
    """One value a ticker: that of the link that ends last."""
    order = F.struct(*(c for c in ("edate", "linkenddt", value) if c in links.columns))
    return links.where(F.col(value).isNotNull()).groupBy("ticker").agg(F.max_by(value, order).alias(value))


def link_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = A.table(spark, sf_dir, "nation").select(F.upper("n_name").alias("ticker"))
    return joined(security_links(A.links(spark, sf_dir), wanted), primary_companies(A.company_links(spark, sf_dir)))


def ticker_to_permno(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_link(link_table(spark, sf_dir), "permno")


def ticker_to_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_link(link_table(spark, sf_dir), "gvkey")
