"""The odds feed over HTTP, as a Spark data source, and how it gives up markets.

The fetcher is a parameter, ``module:function``, called with a URL and returning
(status, body); the default uses the standard library.
"""

from __future__ import annotations

import importlib
import json
import re
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from ..schemas import DEFAULT_SPORT, MATCH, SCAN_MARKETS

Fetch = Callable[[str], tuple[int, str]]
# Fixed value.
URL = "https://api.the-odds-api.com/v4/sports/{sport}/odds?apiKey={key}&regions=eu,uk&markets={markets}&oddsFormat=decimal"


class FeedError(Exception):
    """The feed refused; ``status`` is what a caller over HTTP is told."""

    def __init__(self, message: str, status: int = 502):
        super().__init__(message)
        self.status = status


def over_http(url: str) -> tuple[int, str]:
    try:
        with urllib.request.urlopen(url, timeout=30) as r:
            return r.status, r.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode(errors="replace")


def refused(body: str, markets: list[str]) -> list[str]:
    """Markets that an error names, as whole words."""
    try:
        error = json.loads(body)
    except ValueError:
        return []
    if not isinstance(error, dict) or error.get("error_code") != "INVALID_MARKET":
        return []
    named = set(re.findall(r"\w+", str(error.get("message", ""))))
    return [m for m in markets if m in named]


def negotiated(fetch: Fetch, key: str, sport: str = DEFAULT_SPORT, markets: list[str] | None = None) -> list[dict]:
    """The feed's matches, asked again without the markets that it does not have.

    Ends with an error where the feed names no market that was asked for, or would
    leave none.
    """
    left = list(markets or SCAN_MARKETS)
    while True:
        status, body = fetch(URL.format(sport=sport, key=key, markets=",".join(left)))
        if status == 200:
            return json.loads(body)
        gone = refused(body, left) if len(left) > 1 else []
        left = [m for m in left if m not in gone]
        if not gone or not left:
            raise FeedError(f"odds feed: {body}")


class Sport(InputPartition):
    def __init__(self, sport: str):
        super().__init__(sport)
        self.sport = sport


def asked(filters: list[Filter], column: str) -> tuple[set | None, list[Filter]]:
    """The values that filters leave of a column, all if none does, and the filters that say so."""
    left, used = None, []
    for f in filters:
        values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
        if values is not None and f.attribute == (column,):
            left = values if left is None else left & values
            used.append(f)
    return left, used


class OddsReader(DataSourceReader):
    """One partition a league."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.options = schema, options
        self.sports = [s.strip() for s in options["sport"].split(",")] if options.get("sport") else None
        self.teams: dict[str, set] = {}

    def partitions(self) -> list[InputPartition]:
        return [Sport(s) for s in ([DEFAULT_SPORT] if self.sports is None else self.sports)]

    def read(self, partition: Sport | None) -> Iterator[tuple]:
        if partition is None:  # Spark asks for one partition where there are none
            return
        module, _, name = self.options.get("fetcher", f"{__name__}:over_http").partition(":")
        markets = [m for m in self.options.get("markets", "").split(",") if m]
        fetch = getattr(importlib.import_module(module), name)
        for place, match in enumerate(negotiated(fetch, self.options["apikey"], partition.sport, markets)):
            if all(match.get(side) in names for side, names in self.teams.items()):
                yield partition.sport, place, match.get("home_team"), match.get("away_team"), json.dumps(match, ensure_ascii=False)


class PushedReader(OddsReader):
    """Takes filters: those on leagues spare requests, those on teams spare rows."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        sports, used = asked(filters, "sport")
        if sports is not None:
            self.sports = sorted(sports) if self.sports is None else [s for s in self.sports if s in sports]
        for side in ("home_team", "away_team"):
            names, own = asked(filters, side)
            if names is not None:
                self.teams[side] = names
                used += own
        return [f for f in filters if f not in used]


class OddsSource(DataSource):
    """``spark.read.format("odds").option("apiKey", …).option("sport", "a,b").load()``: a partition per league.

    Rows are (sport, src_ord, home_team, away_team, match) with the match as JSON for
    ``typed``. With the option ``pushDown`` and the setting
    ``spark.sql.python.filterPushdown.enabled``, which Spark demands for it, only leagues
    that a filter on ``sport`` leaves are asked for, also without the option ``sport``.
    """

    @classmethod
    def name(cls) -> str:
        return "odds"

    def schema(self) -> str:
        return "sport string, src_ord int, home_team string, away_team string, match string"

    def reader(self, schema: StructType) -> DataSourceReader:
        options = {k.lower(): v for k, v in self.options.items()}
        if not options.get("apikey"):
            raise FeedError("the odds feed needs the option apiKey", 400)
        return (PushedReader if options.get("pushdown") == "true" else OddsReader)(schema, options)


def typed(rows: DataFrame) -> DataFrame:
    """The source's rows as matches."""
    return rows.select("sport", "src_ord", F.from_json("match", MATCH).alias("m")).select("m.*", "src_ord", "sport")


def fetched(sports: DataFrame, fetch: Fetch, key: str, markets: list[str] | None = None) -> DataFrame:
    """(sport, src_ord, match) of each league of ``sports`` (sport), asked for in tasks; a league whose feed fails has no rows."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for sport in batch["sport"]:
                try:
                    found = negotiated(fetch, key, sport, markets)
                except Exception:  # noqa: BLE001  any failure of the feed leaves the league without odds
                    continue
                yield pd.DataFrame([(sport, i, json.dumps(m, ensure_ascii=False)) for i, m in enumerate(found)], columns=["sport", "src_ord", "match"])

    return sports.select("sport").mapInPandas(ask, "sport string, src_ord int, match string")
