"""Schemas of the domain's tables, and its small fixed dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType



def table(**columns) -> StructType:
    """A schema; types are Spark's type objects."""
    return StructType([StructField(name, type) for name, type in columns.items()])


TEXT, NUMBER, WHOLE = StringType(), DoubleType(), IntegerType()
OUTCOME = table(name=TEXT, price=NUMBER, point=NUMBER)
MARKET = table(key=TEXT, outcomes=ArrayType(OUTCOME))
BOOKMAKERS = ArrayType(table(title=TEXT, markets=ArrayType(MARKET)))
#: A match as the feed sends it.
MATCH = table(id=TEXT, commence_time=TEXT, home_team=TEXT, away_team=TEXT, bookmakers=BOOKMAKERS)
#: A feed's matches; ``src_ord`` is a match's place in the feed.
MATCHES = StructType([*MATCH, StructField("src_ord", WHOLE)])
ANALYSIS = table(id=TEXT, league=TEXT, matchDate=TEXT, homeTeam=TEXT, awayTeam=TEXT, result=TEXT, odds=TEXT, createdAt=TimestampType())
NEWS = table(team=TEXT, answer=TEXT, results=ArrayType(table(title=TEXT, content=TEXT)))
CHUNKS = table(stream_id=TEXT, seq=LongType(), chunk=TEXT)
EVENT = table(type=TEXT, content=TEXT, id=TEXT, message=TEXT)

# Fixed values.
LEAGUES = [
    ("soccer_epl", "Английская Премьер-лига"),
    ("soccer_spain_la_liga", "Ла Лига (Испания)"),
    ("soccer_germany_bundesliga", "Бундеслига (Германия)"),
    ("soccer_italy_serie_a", "Серия А (Италия)"),
    ("soccer_france_ligue_one", "Лига 1 (Франция)"),
    ("soccer_uefa_champs_league", "Лига чемпионов УЕФА"),
    ("soccer_uefa_europa_league", "Лига Европы УЕФА"),
    ("soccer_fifa_world_cup", "Чемпионат мира 2026"),
    ("basketball_nba", "НБА"),
    ("icehockey_nhl", "НХЛ"),
]
SPORT_KEYS = {
    "Premier League": "soccer_epl",
    "UEFA Champions League": "soccer_uefa_champs_league",
    "UEFA Europa League": "soccer_uefa_europa_league",
    "La Liga": "soccer_spain_la_liga",
    "Bundesliga": "soccer_germany_bundesliga",
    "Serie A": "soccer_italy_serie_a",
    "Ligue 1": "soccer_france_ligue_one",
    "NBA": "basketball_nba",
    "NHL": "icehockey_nhl",
}
DEFAULT_SPORT = "soccer_epl"
MARKET_LABELS = {
    "h2h": "Исход матча (1X2)",
    "totals": "Тотал голов",
    "btts": "Обе команды забьют",
    "spreads": "Азиатский гандикап",
}
BOTH_SCORE, NEITHER = "Да (обе забьют)", "Нет"
DISPLAY_ORDER = ["П1", "Ничья", "П2", "ТБ 2.5", "ТМ 2.5"]
TILES = ["П1", "X", "П2"]
MONTHS = ["января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря"]
SCAN_MARKETS = ["h2h", "spreads", "btts"]
LEAGUE_SCAN_MARKETS = ["h2h", "totals", "btts"]
HIGHLIGHT_FROM = 2.0
HORIZON_MS = 7 * 24 * 60 * 60 * 1000
HISTORY_ROWS, SHORT_BOOKMAKERS, SEARCH_RESULTS = 100, 4, 5
ODDS_COUNT, IMPLIED_OPEN, IMPLIED_CLOSE = "Всего букмекеров: ", " (вероятность по рынку: ", "%)"
MATCH_HEADING, LEAGUE_HEADING, DATE_HEADING = "## Матч: ", "**Лига:** ", "**Дата:** "
NO_ODDS = "Данные букмекеров недоступны — используй исторические средние."
NO_NEWS = "Tavily API не настроен — анализируй на основе коэффициентов и своих знаний."
ODDS_HEADING = "## 📊 ВСЕ КОЭФФИЦИЕНТЫ БУКМЕКЕРОВ"
NO_ODDS_HEADING = "## 📊 Коэффициенты"
NEWS_HEADING = "## 🔍 Форма и новости: "
NO_NEWS_HEADING = "## 🔍 Веб-поиск"


def leagues(spark: SparkSession) -> DataFrame:
    """(sport, label) of the leagues on offer."""
    return spark.createDataFrame(LEAGUES, "sport string, label string")


def display_order(spark: SparkSession, keys: list[str] = DISPLAY_ORDER) -> DataFrame:
    """(ord, key) in the order of display."""
    return spark.createDataFrame([*enumerate(keys)], "ord int, key string")
