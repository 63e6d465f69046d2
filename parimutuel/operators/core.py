"""Operators over any table, from which the domain's are made."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.checkpoint import cut


def between(df: DataFrame, column: str, low: Column, high: Column) -> DataFrame:
    """Rows from ``low`` to ``high``, both included; nulls are dropped."""
    return df.where(F.col(column).between(low, high))


def numbered(df: DataFrame, order: Sequence[str], name: str = "ord") -> DataFrame:
    """Rows with their place in a global order, without one task that holds them all.

    Rows are sorted over the cluster; a task counts its own and starts where the
    tasks before it end. Where the sort cuts differs from run to run, so it is kept.
    """
    spark = df.sparkSession
    ordered = cut(df.sort(*order).withColumn("part of rows", F.spark_partition_id()).withColumn("id of row", F.monotonically_increasing_id()))
    sizes = ordered.groupBy("part of rows").agg(F.count("*").alias("n"), F.min("id of row").alias("first")).collect()
    starts, total = [], 0
    for part, n, first in sorted(sizes):
        starts.append((part, first - total))
        total += n
    base = spark.createDataFrame(starts, "`part of rows` int, `start of part` long")
    joined = ordered.join(F.broadcast(base), "part of rows")
    return joined.select(*df.columns, (F.col("id of row") - F.col("start of part")).alias(name))


def first_best(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """Per key the row with the largest value; of equal ones the first by ``order``.

    Null and NaN values never win, and a key that has nothing else has no row. One
    hash aggregate with partial results, so hot keys are reduced before the shuffle.
    """
    rated = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    best = F.min_by(F.struct(value, *payload), F.struct(-F.col(value), *order))
    return rated.groupBy(*keys).agg(best.alias("best row")).select(*keys, "best row.*")


def top(df: DataFrame, newest: str, tie: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(newest), tie).limit(n)


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == F.lit(value))


def without(df: DataFrame, key: str, value) -> DataFrame:
    """All rows but those with the key; rows whose key is null stay."""
    return df.where(~F.col(key).eqNullSafe(F.lit(value)))


def with_dimension(df: DataFrame, dimension: DataFrame, on: str, label: str, default: Column) -> DataFrame:
    """Left join of a label, with a default where there is none.

    The dimension has one row a key. Spark broadcasts it where its measured size allows.
    """
    return df.join(dimension, on, "left").withColumn(label, F.coalesce(label, default))


def in_order_of(df: DataFrame, order: DataFrame, key: str) -> DataFrame:
    """Rows whose key is listed, with its place in the list (ord, key); whoever shows them sorts by ``ord``."""
    return df.join(order, key)


def positions(df: DataFrame, array: str, position: str, element: str) -> DataFrame:
    """A row per element and its place; rows without elements are dropped."""
    rest = [c for c in df.columns if c != array]
    return df.select(*rest, F.posexplode(array).alias(position, element))


def difference(array: Column, removed: Column) -> Column:
    """The array without the removed elements; repeated elements stay."""
    return F.filter(array, lambda x: ~F.array_contains(removed, x))


def first_where(array: Column, predicate) -> Column:
    """The first element that fits, null if none does."""
    return F.get(F.filter(array, predicate), F.lit(0))


def joined_in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, separator: str, name: str) -> DataFrame:
    """Per key the texts in order, joined; null texts are left out."""
    collected = F.sort_array(F.collect_list(F.struct(*order, text)))
    return df.where(F.col(text).isNotNull()).groupBy(*keys).agg(F.array_join(F.transform(collected, lambda s: s[text]), separator).alias(name))
