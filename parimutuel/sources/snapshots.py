"""Answers of a remote source kept for a while, as Parquet snapshots named by their time."""

from __future__ import annotations

import re
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

# Seconds that the match list and a single league's scan are kept.
LIST_TTL, LEAGUE_TTL = 300, 0


def cached(spark: SparkSession, path: str, load: Callable[[], DataFrame], ttl: float = LIST_TTL, clock: Callable[[], float] = time.time) -> DataFrame:
    """The newest snapshot under ``path`` if it is younger than ``ttl`` seconds, else a new one of ``load()``.

    Snapshots are whole or not there: only those whose write has ended count.
    """
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = jvm.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    times = sorted(int(m[1]) for n in names if (m := re.fullmatch(r"t(\d+)", n)) and fs.exists(jvm.Path(f"{path}/{n}/_SUCCESS")))
    now = int(clock() * 1000)
    if not times or now - times[-1] >= ttl * 1000:
        load().write.mode("overwrite").parquet(f"{path}/t{now}")
        times.append(now)
    return spark.read.parquet(f"{path}/t{times[-1]}")
