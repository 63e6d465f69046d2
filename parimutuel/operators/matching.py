"""Finding a match by league and team names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import mapped
from ..functions.names import alike_normal, normalized
from ..schemas import DEFAULT_SPORT, SPORT_KEYS, leagues


#: Length of the pieces of names that are looked up.
GRAM = 3


def sport_key(league):
    """The feed's key of a league's name; the default for names it does not know."""
    return mapped(league, SPORT_KEYS, F.lit(DEFAULT_SPORT))


def with_league_label(df: DataFrame, sport: str = "sport") -> DataFrame:
    """Adds ``label``: the league's, or its key where it has none."""
    names = leagues(df.sparkSession).withColumnRenamed("sport", "sport of label")
    return df.join(names, F.col(sport) == F.col("sport of label"), "left").drop("sport of label").withColumn("label", F.coalesce("label", sport))


def grams(name: Column, least: int, most: int) -> Column:
    """The distinct pieces of a name from ``least`` to ``most`` characters."""
    of = lambda n: F.transform(F.sequence(F.lit(1), F.length(name) - (n - 1)), lambda i: F.substr(name, i, F.lit(n)))
    every = [F.when(F.length(name) >= n, of(n)).otherwise(F.array().cast("array<string>")) if n else F.array(F.lit("")) for n in range(least, most + 1)]
    return F.array_distinct(F.flatten(F.array(*every)))


def held_names(long: DataFrame, short: DataFrame, require_nonempty: bool = True) -> DataFrame:
    """(long, short): each of the distinct names ``long`` that holds one of ``short``.

    A name within another has all its pieces there. Each short name is looked up by its
    piece that fewest long names have; one shorter than a piece is looked up itself.
    Only names that share that piece are compared, so nothing is compared with all.
    """
    pieces = long.select("long", F.explode(grams(F.col("long"), 1 if require_nonempty else 0, GRAM)).alias("piece"))
    spread = pieces.groupBy("piece").agg(F.count("*").alias("n"))
    own = F.when(F.length("short") < GRAM, F.array("short")).otherwise(grams(F.col("short"), GRAM, GRAM))
    asked = short.where("short <> ''") if require_nonempty else short
    rated = asked.select("short", F.explode(own).alias("piece")).join(spread, "piece", "left")
    rarest = rated.groupBy("short").agg(F.min_by("piece", F.struct(F.coalesce("n", F.lit(0)), "piece")).alias("piece"))
    return pieces.join(rarest, "piece").where(F.contains("long", "short")).select("long", "short")


def alike_names(a: DataFrame, b: DataFrame, require_nonempty: bool = True) -> DataFrame:
    """(a, b): the normalized names of one column each, of which one holds the other."""
    left, right = (df.toDF("name").where("name IS NOT NULL").distinct() for df in (a, b))
    names = lambda df, name: df.select(F.col("name").alias(name))
    holding = held_names(names(left, "long"), names(right, "short"), require_nonempty).select(F.col("long").alias("a"), F.col("short").alias("b"))
    held = held_names(names(right, "long"), names(left, "short"), require_nonempty).select(F.col("short").alias("a"), F.col("long").alias("b"))
    return holding.union(held).distinct()


def named_matches(matches: DataFrame, wanted: DataFrame, block: str | None = None, require_nonempty: bool = True) -> DataFrame:
    """Per wanted (want_id, want_home, want_away) the first match of the feed with both names alike.

    Names are compared once each, by rare pieces; of matches with the same names, in
    letters and digits, only the first counts, so a team with very many is no burden.
    With ``block`` both tables have that column (a day, a league) and only its equals fit.
    """
    on = [block] if block else []
    keyed = matches.withColumns({"home name": normalized(F.col("home_team")), "away name": normalized(F.col("away_team"))})
    first = keyed.groupBy(*on, "home name", "away name").agg(F.min_by(F.struct(*matches.columns), "src_ord").alias("found"))
    asked = wanted.select("want_id", *on, normalized(F.col("want_home")).alias("a"), normalized(F.col("want_away")).alias("wanted away"))
    pairs = alike_names(asked.select("a"), keyed.select("home name"), require_nonempty).withColumnRenamed("b", "home name")
    both = asked.join(pairs, "a").join(first, [*on, "home name"])
    fit = both.where(alike_normal(F.col("away name"), F.col("wanted away"), require_nonempty))
    return fit.groupBy("want_id").agg(F.min_by("found", "found.src_ord").alias("found")).select("want_id", "found.*")
