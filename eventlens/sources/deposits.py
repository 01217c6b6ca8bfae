"""The flat payments table, as delivered or partitioned by day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from eventlens.functions.timeutil import utc_date
from eventlens.schema import DEPOSITS

DAY = "deposit_day"
ZONED = r"\d{1,2}:\d{2}.*(Z|UTC|GMT|[+-]\d{1,2}(:?\d{2})?)$"


def read_deposits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DEPOSITS).parquet(path)


def payment_day(created: str | Column, skip_bad_dates: bool = False) -> Column:
    """``DATE(CAST(created AS TIMESTAMP))``: the UTC day of a text, whatever the
    session's time zone; an offset in the text is applied, a text without one
    is UTC.  A text that is no time fails the job, as in the source, or with
    ``skip_bad_dates`` gives NULL, so its payment is left out."""
    c = F.trim(F.col(created) if isinstance(created, str) else created)
    zoned = utc_date(F.unix_micros(c.try_cast("timestamp")))
    # yyyy-MM-dd HH:mm:ss, the usual form, has no room for a zone
    plain = ((F.length(c) == 19) & (F.substring(c, 14, 1) == ":") & (F.substring(c, 17, 1) == ":")
             & F.substring(c, 19, 1).between("0", "9"))
    day = F.when(~plain & c.rlike(ZONED), zoned).otherwise(c.try_cast("timestamp_ntz").cast("date"))
    if skip_bad_dates:
        return day
    bad = F.raise_error(F.concat(F.lit("payment with an unparsable date: "), c)).cast("date")
    return F.coalesce(day, F.when(c.isNotNull(), bad))


def with_payment_day(deposits: DataFrame, name: str, skip_bad_dates: bool = False) -> DataFrame:
    """``deposits`` with the day of each payment as column ``name``: that of the
    partition when the table is kept by day, else parsed, once per row (a plain
    projection would be repeated in every filter and key that uses it)."""
    if DAY in deposits.columns:
        return deposits.withColumn(name, F.col(DAY))
    return deposits.select("*", F.explode(F.array(payment_day("date_created", skip_bad_dates))).alias(name))


def write_deposits_by_day(deposits: DataFrame, path: str, skip_bad_dates: bool = False) -> None:
    """Payments partitioned by ``deposit_day``; replaces the days written and
    leaves others alone.  Payments without a date, and with ``skip_bad_dates``
    those with a bad one, go to the null day."""
    (by_day(deposits, skip_bad_dates).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path))


def by_day(deposits: DataFrame, skip_bad_dates: bool = False) -> DataFrame:
    """``deposits`` with ``deposit_day``, dealt out by day; AQE cuts a large day
    into several files and packs small ones."""
    return with_payment_day(deposits, DAY, skip_bad_dates).hint("rebalance", DAY)


def read_deposits_by_day(spark: SparkSession, path: str) -> DataFrame:
    """The payments analyses prune such a table to the days they need."""
    from pyspark.sql.types import DateType, StructType
    return spark.read.schema(StructType([*DEPOSITS.fields]).add(DAY, DateType())).option("basePath", path).parquet(path)
