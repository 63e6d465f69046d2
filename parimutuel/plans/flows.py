"""The engine's three entry points as plans: what is coming up, one analysis, the history."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import day_and_time, instant
from ..operators.matches import upcoming, winner_prices
from ..operators.matching import named_matches, sport_key
from ..operators.text import odds_text, prompt, with_news
from ..schemas import LEAGUE_SCAN_MARKETS
from .checkpoint import cut
from ..sources.odds_api import fetched, typed


def upcoming_list(matches: DataFrame, now: Column) -> DataFrame:
    """Upcoming matches with the first bookmaker's prices and the date as shown, in order."""
    date = day_and_time(F.col("starts_at"), year=False).alias("date")
    return upcoming(matches, now).select("id", "src_ord", "starts_at", "home_team", "away_team", date, *winner_prices())


def analysis_input(matches: DataFrame, news: DataFrame, league: Column) -> DataFrame:
    """(id, league, matchDate, homeTeam, awayTeam, prompt, odds): what the model is asked, and the odds as stored.

    Missing bookmakers are stored as an empty list.
    """
    home, away = F.col("home_team"), F.col("away_team")
    listed = matches.withColumn("bookmakers", F.coalesce("bookmakers", F.array()))
    # Written below the joins: the prompt names the text three times, and above them each would be written anew.
    known = with_news(listed.withColumn("odds text", odds_text(F.col("bookmakers"), home, away)), news)
    date = day_and_time(instant(F.col("commence_time")))
    asked = prompt(league, date, home, away, F.col("odds text"), F.col("home_news"), F.col("away_news"))
    return known.select("id", league.alias("league"), date.alias("matchDate"), home.alias("homeTeam"), away.alias("awayTeam"), asked.alias("prompt"), F.to_json("bookmakers").alias("odds"))


def finished(asked: DataFrame, folded: DataFrame) -> DataFrame:
    """Rows for the history: analyses whose stream is done; failed and unfinished ones are not stored."""
    done = folded.where("status = 'done'").select(F.col("stream_id").alias("id"), F.col("content").alias("result"))
    return asked.join(done, "id").select("league", "matchDate", "homeTeam", "awayTeam", "result", "odds")


def listing_status(listed: DataFrame) -> str:
    """What a list says where it has no rows."""
    return "empty" if listed.isEmpty() else "ok"


def listing(load: Callable[[], DataFrame]) -> tuple[str, DataFrame | None, str | None]:
    """Status, rows and message of a list: ``ok``, ``empty``, or ``error`` where the feed fails."""
    try:
        listed = load()
        return listing_status(listed), listed, None
    except Exception as e:  # noqa: BLE001  whatever fails, the list says so
        return "error", None, str(e)


def league_game(spark, fetch, key: str | None, league: str, home: str, away: str) -> DataFrame | None:
    """The first match of a league with both names alike; nothing without a key, a match or a working feed."""
    if not key:
        return None
    sports = spark.range(1).select(sport_key(F.lit(league)).alias("sport"))
    rows = cut(fetched(sports, fetch, key, LEAGUE_SCAN_MARKETS))  # asked once, whatever is done with the game
    wanted = spark.createDataFrame([(0, home, away)], "want_id int, want_home string, want_away string")
    game = named_matches(typed(rows), wanted)
    return None if game.isEmpty() else game
