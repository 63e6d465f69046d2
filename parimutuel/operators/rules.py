"""Extensions: betting rules that can be computed; the estimates they need are an input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import implied_probability
from ..schemas import BOTH_SCORE

# Fixed values.
EDGE = 5.0
SCORE_RULES = [
    ("П1", 1.5, 1.9, ["1:0", "2:0", "2:1"]),
    ("Ничья", 3.0, 3.5, ["1:1", "0:0"]),
]
BOTH_SCORE_BELOW = 1.8
HALF_TIME_RULES = {
    "1:0": ["П1/П1"],
    "2:0": ["П1/П1"],
    "2:1": ["П1/П1", "X/П1"],
    "3:1": ["П1/П1", "X/П1"],
    "1:1": ["X/X", "П1/X"],
    "2:2": ["X/X", "П1/X"],
    "0:0": ["X/X"],
}
BANK = [60, 25, 15]
TWO_BETS, THREE_BETS = [70, 30], [50, 30, 20]


def value_bets(best: DataFrame, estimates: DataFrame) -> DataFrame:
    """Prices whose implied probability an estimate (event_id, market, p in percent) exceeds by the edge."""
    rated = best.join(estimates, ["event_id", "market"]).withColumn("edge", F.col("p") - implied_probability(F.col("price")))
    return rated.where(F.col("edge") >= EDGE)


def likely_scores(best: DataFrame) -> DataFrame:
    """(event_id, market, score, half_time): scores that a price suggests, and the half-time results that fit."""
    spark = best.sparkSession
    # Where both teams are expected to score, the scores of the table in which both do.
    both = (BOTH_SCORE, 0.0, BOTH_SCORE_BELOW, [s for s in HALF_TIME_RULES if "0" not in s])
    scores = spark.createDataFrame([*SCORE_RULES, both], "market string, low double, high double, scores array<string>")
    halves = spark.createDataFrame([*HALF_TIME_RULES.items()], "score string, half_time array<string>")
    below = (F.col("market") != BOTH_SCORE) | (F.col("price") < F.col("high"))
    fit = best.join(scores, "market").where(F.col("price").between(F.col("low"), F.col("high")) & below)
    return fit.select("event_id", "market", F.explode("scores").alias("score")).join(halves, "score", "left").select("event_id", "market", "score", "half_time")


def bank_split(bets: DataFrame, bank: float = 100.0, shares: list[int] = BANK) -> DataFrame:
    """Adds ``stake`` to bets by their place in ``rank``, from 1; those beyond the shares get nothing."""
    of = F.array(*map(F.lit, shares))
    return bets.withColumn("stake", F.coalesce(F.get(of, F.col("rank") - 1), F.lit(0)) * bank / 100)


def focused(quotes: DataFrame) -> DataFrame:
    """Quotes of the markets that an analysis looks at: all but totals."""
    return quotes.where(~F.col("market").eqNullSafe("totals"))
