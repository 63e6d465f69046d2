"""Matches and quotes: what is coming up, flat quotes, best prices, first bookmaker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import instant, within_horizon
from ..functions.labels import best_key
from ..functions.numbers import clean, fixed
from ..schemas import BOTH_SCORE, DISPLAY_ORDER, HIGHLIGHT_FROM, TILES, display_order
from .core import first_best, first_where, in_order_of


def upcoming(matches: DataFrame, now: Column) -> DataFrame:
    """Matches of the next seven days in order of time, then of the feed; unreadable dates are dropped."""
    timed = matches.withColumn("starts_at", instant(F.col("commence_time")))
    return timed.where(within_horizon(F.col("starts_at"), now)).orderBy("starts_at", "src_ord")


def quotes(matches: DataFrame) -> DataFrame:
    """A row per outcome, with the places of bookmaker, market and outcome in their arrays."""
    bookmakers = matches.select(F.col("id").alias("event_id"), "home_team", "away_team", F.posexplode("bookmakers").alias("bm_ord", "b"))
    markets = bookmakers.select("event_id", "home_team", "away_team", "bm_ord", F.col("b.title").alias("bookmaker"), F.posexplode("b.markets").alias("mk_ord", "m"))
    outcomes = markets.select("event_id", "home_team", "away_team", "bm_ord", "bookmaker", "mk_ord", F.col("m.key").alias("market"), F.posexplode("m.outcomes").alias("oc_ord", "o"))
    return outcomes.select("event_id", "home_team", "away_team", "bm_ord", "bookmaker", "mk_ord", "market", "oc_ord", F.col("o.name").alias("outcome"), F.col("o.price").alias("price"), F.col("o.point").alias("point"))


def both_score_prices(matches: DataFrame) -> DataFrame:
    """(event_id, market, price, bookmaker): the highest price for both teams to score, under its label."""
    yes = quotes(matches).where("market = 'btts' AND outcome = 'Yes'")
    rated = yes.withColumn("price", F.when(F.col("price") > 0, clean(F.col("price"))))
    best = first_best(rated, ["event_id"], "price", ["bm_ord", "mk_ord", "oc_ord"], ["bookmaker"])
    return best.select("event_id", F.lit(BOTH_SCORE).alias("market"), "price", "bookmaker")


def keyed_prices(matches: DataFrame, both_score: bool = False) -> DataFrame:
    """(event_id, key, price, bookmaker): the highest price of each outcome on display, the first of equals.

    With ``both_score`` also that of both teams to score. Quotes without a usable price
    take no part.
    """
    key = best_key(F.col("market"), F.col("outcome"), F.col("point"), F.col("home_team"), F.col("away_team"))
    keys = DISPLAY_ORDER
    if both_score:
        key, keys = F.when((F.col("market") == "btts") & (F.col("outcome") == "Yes"), BOTH_SCORE).otherwise(key), [*DISPLAY_ORDER, BOTH_SCORE]
    keyed = quotes(matches).withColumn("key", key).where(F.col("key").isin(keys))
    rated = keyed.withColumn("price", F.when(F.col("price") > 0, clean(F.col("price"))))
    return first_best(rated, ["event_id", "key"], "price", ["bm_ord", "mk_ord", "oc_ord"], ["bookmaker"])


def best_prices(matches: DataFrame) -> DataFrame:
    """(event_id, market, price, bookmaker, highlight, ord): each outcome's best price and its place on display."""
    shown = in_order_of(keyed_prices(matches), display_order(matches.sparkSession), "key")
    return shown.select("event_id", F.col("key").alias("market"), "price", "bookmaker", (F.col("price") >= HIGHLIGHT_FROM).alias("highlight"), "ord")


def outcome_count(bookmakers: Column) -> Column:
    """How many outcomes all markets of all bookmakers have."""
    return F.size(F.flatten(F.flatten(F.transform(bookmakers, lambda b: F.transform(b["markets"], lambda m: m["outcomes"])))))


def winner_prices() -> list[Column]:
    """home_odds, draw_odds and away_odds of the first bookmaker's first winner market; null where missing."""
    market = first_where(F.get("bookmakers", F.lit(0))["markets"], lambda m: m["key"] == "h2h")
    price = lambda name: first_where(market["outcomes"], lambda o: o["name"] == name)["price"]
    return [price(F.col("home_team")).alias("home_odds"), price(F.lit("Draw")).alias("draw_odds"), price(F.col("away_team")).alias("away_odds")]


def first_bookmaker(matches: DataFrame) -> DataFrame:
    """(id, home_odds, draw_odds, away_odds) of each match."""
    return matches.select("id", *winner_prices())


def tiles(matches: DataFrame) -> DataFrame:
    """(id, ord, label, text): the prices a match is shown with; missing and zero ones are hidden."""
    pivot = first_bookmaker(matches)
    rows = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(label).alias("label"), F.col(c).alias("price")) for i, (label, c) in enumerate(zip(TILES, ("home_odds", "draw_odds", "away_odds")))))
    flat = pivot.select("id", F.inline(rows)).where("price IS NOT NULL AND price <> 0")
    return flat.select("id", "ord", "label", fixed(F.col("price"), 2).alias("text"))
