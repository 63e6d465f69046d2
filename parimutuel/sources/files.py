"""Landed files: matches and news as JSON or Parquet, always with a given schema."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DateType, StringType, StructField, StructType, TimestampType

from ..functions.dates import instant, within_horizon
from ..schemas import BOOKMAKERS, HORIZON_MS, MATCH, MATCHES, NEWS


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Matches of feed answers, each file one JSON array as the feed sends it.

    ``src_ord`` is a match's place in its file. A price that is not a JSON number is null.
    """
    files = spark.read.text(path, wholetext=True)
    every = F.from_json("value", ArrayType(MATCH))
    return files.select(F.posexplode(every).alias("src_ord", "m")).select("m.*", "src_ord")


def read_matches(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Landed matches; ``partitionBy("sport")`` on writing makes a league's scan read its files alone."""
    return spark.read.schema(MATCHES).format(format).load(path)


def read_news(spark: SparkSession, path: str, format: str = "json") -> DataFrame:
    return spark.read.schema(NEWS).format(format).load(path)


def typed_odds(analyses: DataFrame) -> DataFrame:
    """Stored analyses with their odds read back; null stays null and an empty list empty."""
    return analyses.withColumn("bookmakers", F.from_json("odds", BOOKMAKERS))


def land(matches: DataFrame, path: str, days: int = 1) -> None:
    """Write matches of a feed (with ``sport``) with their start typed once, laid out for scans by league and time.

    ``path/matches`` has a folder a league and stretch of ``days`` days (``from_day``);
    matches that cannot be listed, without id or readable date, go to ``path/rejects``
    with a reason. Rows are dealt by folder, so each has one file, or several where a
    league's stretch has very many.
    """
    day = F.to_date("starts_at")
    start = F.date_sub(day, F.pmod(F.datediff(day, F.lit("1970-01-01")), F.lit(days)))
    timed = matches.withColumn("starts_at", instant(F.col("commence_time"))).withColumn("from_day", start)
    reason = F.when(F.col("id").isNull(), "no id").when(F.col("starts_at").isNull(), "no date")
    # Kept on disk for both writes, so that matches nested or fetched on the way are so once.
    rated = timed.withColumn("reason", reason).persist(StorageLevel.DISK_ONLY)
    try:
        salt = F.pmod(F.xxhash64("id"), F.lit(4))
        good = rated.where("reason IS NULL").drop("reason").repartition("sport", "from_day", salt)
        good.sortWithinPartitions("sport", "from_day", "starts_at").write.mode("append").partitionBy("sport", "from_day").parquet(f"{path}/matches")
        rated.where("reason IS NOT NULL").drop("starts_at", "from_day").write.mode("append").parquet(f"{path}/rejects")
    finally:
        rated.unpersist()


def landed_upcoming(spark: SparkSession, path: str, now: Column, days: int = 1, sports: list[str] | None = None) -> DataFrame:
    """Landed matches of the next seven days; only folders that can hold one are read.

    ``days`` is what they were landed with.
    """
    columns = StructType([*MATCHES, StructField("starts_at", TimestampType()), StructField("sport", StringType()), StructField("from_day", DateType())])
    rows = spark.read.schema(columns).parquet(f"{path}/matches")
    if sports:
        rows = rows.where(F.col("sport").isin(sports))
    today = F.to_date(now)
    near = F.col("from_day").between(F.date_sub(today, days), F.date_add(today, HORIZON_MS // 86_400_000 + 1))
    return rows.where(near & within_horizon(F.col("starts_at"), now))
