"""Texts made of odds and news."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import market_label, outcome_label
from ..functions.numbers import fixed, implied_probability, plain
from ..schemas import DATE_HEADING, IMPLIED_CLOSE, IMPLIED_OPEN, LEAGUE_HEADING, MATCH_HEADING, NEWS_HEADING, NO_NEWS, NO_NEWS_HEADING, NO_ODDS, NO_ODDS_HEADING, ODDS_COUNT, ODDS_HEADING, SHORT_BOOKMAKERS


def odds_line(label: Column, price: Column) -> Column:
    """One outcome; a price without an implied probability stands alone."""
    percent = fixed(implied_probability(price), 1)
    return F.concat(F.lit("  "), label, F.lit(": **"), F.coalesce(plain(price), F.lit("")), F.lit("**"), F.coalesce(F.concat(F.lit(IMPLIED_OPEN), percent, F.lit(IMPLIED_CLOSE)), F.lit("")))


def flat_lines(bookmakers: Column, per_market) -> Column:
    """Per bookmaker its heading and the lines of its markets, all in array order."""
    one = lambda b: F.concat(F.array(F.concat(F.lit("\n### "), b["title"])), F.flatten(F.transform(b["markets"], per_market)))
    return F.flatten(F.transform(bookmakers, one))


def odds_text(bookmakers: Column, home: Column, away: Column) -> Column:
    """All quotes as text; null without bookmakers."""

    def lines(m: Column) -> Column:
        line = lambda o: odds_line(outcome_label(m["key"], o["name"], o["point"], home, away), o["price"])
        return F.concat(F.array(F.concat(F.lit("**"), market_label(m["key"]), F.lit(":**"))), F.transform(m["outcomes"], line))

    count = F.concat(F.lit(ODDS_COUNT), F.size(bookmakers).cast("string"), F.lit("\n"))
    return F.when(F.size(bookmakers) > 0, F.array_join(F.concat(F.array(count), flat_lines(bookmakers, lines)), "\n"))


def short_odds_text(bookmakers: Column, home: Column, away: Column) -> Column:
    """The first bookmakers' quotes under their markets' raw keys."""

    def lines(m: Column) -> Column:
        line = lambda o: F.concat(F.lit("  "), o["name"], F.lit(": "), F.coalesce(plain(o["price"]), F.lit("")))
        return F.concat(F.array(F.concat(F.upper(m["key"]), F.lit(":"))), F.transform(m["outcomes"], line))

    first = F.slice(F.coalesce(bookmakers, F.array()), 1, SHORT_BOOKMAKERS)
    return F.array_join(F.concat(F.array(F.concat(F.lit("Match: "), home, F.lit(" vs "), away)), flat_lines(first, lines)), "\n")


def search_text(answer: Column, results: Column) -> Column:
    """An answer and the results under it, null where there is neither."""
    summary = F.when(answer != "", F.concat(F.lit("Summary: "), answer))
    each = F.transform(F.coalesce(results, F.array()), lambda r: F.concat(F.lit("\n["), F.coalesce(r["title"], F.lit("")), F.lit("]\n"), F.coalesce(r["content"], F.lit(""))))
    return F.nullif(F.concat_ws("\n\n", summary, each), F.lit(""))


def prompt(league: Column, date: Column, home: Column, away: Column, odds: Column, home_news: Column, away_news: Column) -> Column:
    """The whole question about a match; what is missing is said or left out."""
    filled = lambda c: c.isNotNull() & (c != "")
    block = lambda *parts: F.concat(F.lit("\n"), *parts)
    text = lambda c: F.coalesce(c, F.lit(""))
    news = lambda team, c: F.when(filled(c), block(F.lit(NEWS_HEADING), text(team), F.lit("\n"), c))
    with_odds = F.when(filled(odds), block(F.lit(ODDS_HEADING + "\n"), odds)).otherwise(block(F.lit(f"{NO_ODDS_HEADING}\n{NO_ODDS}")))
    none = F.when(~F.coalesce(filled(home_news), F.lit(False)) & ~F.coalesce(filled(away_news), F.lit(False)), block(F.lit(f"{NO_NEWS_HEADING}\n{NO_NEWS}")))
    return F.concat_ws("\n", F.concat(F.lit(MATCH_HEADING), text(home), F.lit(" — "), text(away)), F.concat(F.lit(LEAGUE_HEADING), text(league)), F.concat(F.lit(DATE_HEADING), text(date)), with_odds, news(home, home_news), news(away, away_news), none)


def with_news(matches: DataFrame, news: DataFrame) -> DataFrame:
    """Adds ``home_news`` and ``away_news``; teams without news keep null. ``news`` has a row a team.

    Texts are brought to pairs of teams, and each match then finds its pair, so no text
    is sorted or shuffled once for every match of a team. ``matches`` is read twice, the
    first time for its teams alone.
    """
    texts = news.select("team", search_text(F.col("answer"), F.col("results")).alias("text"))
    pairs = matches.select("home_team", "away_team").distinct()
    for side in ("home", "away"):
        of = texts.select(F.col("team").alias(f"{side}_team"), F.col("text").alias(f"{side}_news"))
        pairs = pairs.join(of, f"{side}_team", "left")
    told = pairs.select(F.col("home_team").alias("home of pair"), F.col("away_team").alias("away of pair"), "home_news", "away_news")
    same = F.col("home_team").eqNullSafe(F.col("home of pair")) & F.col("away_team").eqNullSafe(F.col("away of pair"))
    return matches.join(told, same, "left").drop("home of pair", "away of pair")
