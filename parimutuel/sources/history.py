"""The history of analyses: a Parquet table laid out for lookups by id.

An insert adds a part, a folder with a folder for each bucket of ids in it; it counts
once it is complete, so readers never see half of it. A part's name comes from the
insert's key, and an insert that is run again changes nothing. A lookup reads the files
of one bucket, and of these only what their Bloom filters on ``id`` let through. A
delete writes the id's bucket anew, in the parts that hold the id, and nothing else;
while it puts the bucket in place, readers may miss it. One writer at a time.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators.core import lookup, top, without
from ..plans.checkpoint import cut
from ..schemas import ANALYSIS, HISTORY_ROWS

#: Buckets that ids are dealt to by their hash.
BUCKETS = 16
LISTED = ["id", "league", "matchDate", "homeTeam", "awayTeam", "createdAt"]


class History:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._dir = self._path(self.path)
        self._fs = self._dir.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _complete(self, path: str) -> list[str]:
        """Names of the folders under ``path`` whose write has ended."""
        at = self._path(path)
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(n for n in names if self._fs.exists(self._path(f"{path}/{n}/_SUCCESS")))

    def parts(self) -> list[str]:
        """Paths of the inserts that are complete."""
        return [f"{self.path}/{name}" for name in self._complete(self.path)]

    def _read(self, parts: list[str]) -> DataFrame:
        """Rows of parts with their bucket."""
        schema = StructType([*ANALYSIS, StructField("insert", StringType()), StructField("bucket", LongType())])
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(*parts) if parts else self.spark.createDataFrame([], schema)

    def table(self) -> DataFrame:
        return self._read(self.parts()).drop("insert", "bucket")

    def _bucket(self, id: Column) -> Column:
        return F.pmod(F.xxhash64(id), F.lit(self.buckets)).cast("long")

    def _write(self, rows: DataFrame, part: str) -> None:
        """Write rows with their bucket; of a part that is there, only their buckets are replaced."""
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket")
        writer.option("parquet.bloom.filter.enabled#id", "true").option("parquet.bloom.filter.expected.ndv#id", "100000").parquet(part)

    def append(self, analyses: DataFrame, key: str | None = None) -> None:
        """Add rows, once a ``key``; ``id`` and ``createdAt`` are made where the input lacks them."""
        name = f"insert={key or uuid4().hex}"
        if name in self._complete(self.path):
            return
        if "id" not in analyses.columns:
            analyses = analyses.withColumn("id", F.uuid())
        if "createdAt" not in analyses.columns:
            analyses = analyses.withColumn("createdAt", F.current_timestamp())
        rows = analyses.select(*(F.col(f.name).cast(f.dataType) for f in ANALYSIS)).withColumn("bucket", self._bucket(F.col("id")))
        at = self._path(f"{self.path}/{name}")
        if self._fs.exists(at):  # what a failed run has left
            self._fs.delete(at, True)
        self._write(rows.repartition("bucket"), f"{self.path}/{name}")
        if not self._fs.exists(self._path(f"{self.path}/{name}/_SUCCESS")):
            self._fs.create(self._path(f"{self.path}/{name}/_SUCCESS")).close()

    def latest(self) -> DataFrame:
        """The newest hundred without their texts; ties by id."""
        return top(self.table().select(LISTED), "createdAt", "id", HISTORY_ROWS)

    def _held(self, id: str) -> DataFrame:
        """The rows with this id, from the files of its bucket."""
        return lookup(self._read(self.parts()).where(F.col("bucket") == self._bucket(F.lit(id))), "id", id)

    def get(self, id: str) -> DataFrame:
        """The analysis with this id, or no row."""
        return self._held(id).drop("insert", "bucket")

    def delete(self, id: str) -> int:
        """Remove an analysis; returns how many rows went, 0 for an unknown id."""
        found = self._held(id).groupBy("insert", "bucket").agg(F.count("*").alias("n")).collect()
        for insert, bucket, _ in found:
            at = f"{self.path}/insert={insert}"
            rows = self._read([at]).where(F.col("bucket") == bucket).drop("insert")
            kept = cut(without(rows, "id", id))  # the files that it was read from go
            if kept.isEmpty():
                self._fs.delete(self._path(f"{at}/bucket={bucket}"), True)
            else:
                self._write(kept, at)
        return sum(row.n for row in found)
