"""Golden cases of the domain: the fixtures F1 to F8."""

import json
import random

import pytest
from pyspark.sql import functions as F

from parimutuel.functions.dates import day_and_time, instant, within_horizon
from parimutuel.functions.names import alike, alike_normal, normalized
from parimutuel.operators import matches as M
from parimutuel.operators import rules
from parimutuel import schemas
from parimutuel.operators import matching
from parimutuel.operators.matching import named_matches, sport_key, with_league_label
from parimutuel.operators.text import odds_text, prompt, search_text, short_odds_text, with_news
from parimutuel.plans.flows import analysis_input, finished, upcoming_list
from parimutuel.schemas import MATCHES, NEWS

HOME, AWAY = "Alpha FC", "Beta United"
H2H = lambda *p: ("h2h", [(HOME, p[0], None), (AWAY, p[1], None), ("Draw", p[2], None)])
BOOKS = [
    ("BookA", [H2H(1.75, 4.5, 3.6), ("spreads", [(HOME, 1.9, -0.5), (AWAY, 1.95, 0.5)]), ("btts", [("Yes", 1.8, None), ("No", 2.0, None)])]),
    ("BookB", [H2H(1.8, 4.5, 3.4), ("totals", [("Over", 1.9, 2.5), ("Under", 2.0, 2.5)])]),
]
NOW = "2026-01-01T00:00:00Z"


def match(id, time, books, ord, home=HOME, away=AWAY):
    return (id, time, home, away, books, ord)


@pytest.fixture(scope="module")
def f1(spark):
    rows = [match("G1", "2026-01-03T15:00:00Z", BOOKS, 0), match("G2", "2026-01-08T00:00:00Z", [], 1), match("G3", "2026-01-08T00:00:00.001Z", [], 2), match("G4", "2025-12-31T23:59:59Z", [], 3), match("G5", "soon", [], 4), match("G6", "2026-01-03T15:00:00Z", [], 5)]
    return spark.createDataFrame(rows, MATCHES)


def test_upcoming_order_and_bounds(f1):
    got = M.upcoming(f1, F.lit(NOW).cast("timestamp")).collect()
    assert [r.id for r in got] == ["G1", "G6", "G2"]


def test_upcoming_list_keeps_the_order_and_shows_prices(f1):
    got = upcoming_list(f1, F.lit(NOW).cast("timestamp")).collect()
    assert [(r.id, r.home_odds, r.date) for r in got] == [("G1", 1.75, "03 января 15:00"), ("G6", None, "03 января 15:00"), ("G2", None, "08 января 00:00")]


def test_best_prices(f1):
    got = [(r.market, r.price, r.bookmaker, r.highlight) for r in M.best_prices(f1).orderBy("event_id", "ord").collect()]
    assert got == [("П1", 1.8, "BookB", False), ("Ничья", 3.6, "BookA", True), ("П2", 4.5, "BookA", True), ("ТБ 2.5", 1.9, "BookB", False), ("ТМ 2.5", 2.0, "BookB", True)]


def test_best_prices_do_not_depend_on_row_order(spark, f1):
    shuffled = M.quotes(f1).orderBy(F.rand(3))
    assert shuffled.count() == 12
    again = M.best_prices(f1.repartition(3).orderBy(F.rand(1)))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, M.best_prices(f1).collect()))


def test_unusable_prices_never_win(spark):
    bad = [("h2h", [(HOME, 0.0, None), (AWAY, None, None), ("Draw", float("nan"), None)]), ("h2h", [(HOME, 1.1, None)])]
    df = spark.createDataFrame([match("B", NOW, [("X", bad)], 0)], MATCHES)
    assert [(r.market, r.price) for r in M.best_prices(df).collect()] == [("П1", 1.1)]
    text = df.select(odds_text("bookmakers", F.col("home_team"), F.col("away_team"))).first()[0]
    assert "**0**\n" in text and "NaN%" not in text


def test_third_outcome_is_a_draw_only_for_best_prices(spark):
    df = spark.createDataFrame([match("O", NOW, [("X", [("h2h", [("Other", 9.0, None)])])], 0)], MATCHES)
    assert M.best_prices(df).first().market == "Ничья"
    assert "  Other: **9**" in df.select(odds_text("bookmakers", F.col("home_team"), F.col("away_team"))).first()[0]


def test_first_bookmaker_and_tiles(f1):
    got = {r.id: tuple(r)[1:] for r in M.first_bookmaker(f1).collect()}
    assert got["G1"] == (1.75, 3.6, 4.5) and got["G2"] == (None, None, None)
    assert [(r.label, r.text) for r in M.tiles(f1).orderBy("ord").collect()] == [("П1", "1.75"), ("X", "3.60"), ("П2", "4.50")]


def test_odds_text(f1):
    text = f1.where("id = 'G1'").select(odds_text("bookmakers", F.col("home_team"), F.col("away_team"))).first()[0]
    lines = text.split("\n")
    assert lines[:5] == ["Всего букмекеров: 2", "", "", "### BookA", "**Исход матча (1X2):**"]
    assert "  П1 — Alpha FC: **1.75** (вероятность по рынку: 57.1%)" in lines
    for part in ("Alpha FC (-0.5): **1.9**", "Beta United (+0.5): **1.95**", "Да (обе забьют): **1.8**", "Нет: **2** (вероятность по рынку: 50.0%)", "ТБ 2.5: **1.9**", "ТМ 2.5: **2**", "Ничья: **3.6**"):
        assert f"  {part}" in text
    assert f1.where("id = 'G2'").select(odds_text("bookmakers", F.col("home_team"), F.col("away_team"))).first()[0] is None


def test_unknown_market_and_spread_without_point(spark):
    books = [("X", [("corners", [("X", 2.0, None)]), ("spreads", [(HOME, 2.0, None)])])]
    df = spark.createDataFrame([match("U", NOW, books, 0)], MATCHES)
    text = df.select(odds_text("bookmakers", F.col("home_team"), F.col("away_team"))).first()[0]
    assert "**corners:**\n  X: **2**" in text and "  Alpha FC: **2**" in text


def test_short_text_takes_four_bookmakers(spark):
    df = spark.createDataFrame([match("S", NOW, [(f"B{i}", [H2H(2.0, 3.0, 4.0)]) for i in range(6)], 0)], MATCHES)
    text = df.select(short_odds_text("bookmakers", F.col("home_team"), F.col("away_team"))).first()[0]
    assert text.startswith("Match: Alpha FC vs Beta United\n\n### B0\nH2H:\n  Alpha FC: 2") and "B3" in text and "B4" not in text


@pytest.mark.parametrize("a,b,expected", [("Man. City", "man city", True), ("Manchester City FC", "Manchester City", True), ("Manchester City", "Manchester United", False), ("Динамо", "x", False)])
def test_names(spark, a, b, expected):
    assert spark.range(1).select(alike(F.lit(a), F.lit(b))).first()[0] is expected


def test_names_without_letters_match_all_when_asked(spark):
    assert spark.range(1).select(alike(F.lit("Динамо"), F.lit("x"), require_nonempty=False)).first()[0] is True


@pytest.mark.parametrize("block", [None, "day"])
def test_named_match_is_the_first_of_the_feed(spark, block):
    rows = [match("A", NOW, [], 0, "Man. City FC", "Arsenal"), match("B", NOW, [], 1, "Manchester City", "Arsenal FC"), match("C", NOW, [], 2, "Manchester City", "Arsenal")]
    df = spark.createDataFrame(rows, MATCHES).withColumn("day", F.lit(1))
    wanted = spark.createDataFrame([(1, "manchester city", "arsenal", 1), (2, "Leeds", "Arsenal", 1)], "want_id int, want_home string, want_away string, day int")
    got = named_matches(df, wanted if block else wanted.drop("day"), block).collect()
    assert [(r.want_id, r.id) for r in got] == [(1, "B")]


def test_leagues(spark):
    df = spark.createDataFrame([("basketball_nba",), ("chess",)], "sport string")
    assert {r.sport: r.label for r in with_league_label(df).collect()} == {"basketball_nba": "НБА", "chess": "chess"}
    got = spark.createDataFrame([("NBA",), ("?",), (None,)], "l string").select(sport_key(F.col("l"))).collect()
    assert [r[0] for r in got] == ["basketball_nba", "soccer_epl", "soccer_epl"]


@pytest.mark.parametrize("odds", [None, "O"])
@pytest.mark.parametrize("home", [None, "H"])
@pytest.mark.parametrize("away", [None, "A"])
def test_prompt(spark, odds, home, away):
    c = lambda v: F.lit(v).cast("string")
    text = spark.range(1).select(prompt(F.lit("L"), F.lit("D"), F.lit("X"), F.lit("Y"), c(odds), c(home), c(away))).first()[0]
    assert text.startswith("## Матч: X — Y\n**Лига:** L\n**Дата:** D\n\n## 📊 ")
    assert ("недоступны" in text) == (odds is None)
    assert ("новости: X\nH" in text) == bool(home) and ("новости: Y\nA" in text) == bool(away)
    assert ("Веб-поиск" in text) == (not home and not away)


def test_search_text(spark):
    df = spark.createDataFrame([("t", "yes", [("a", "b"), ("c", "d")]), ("u", None, None), ("v", "", []), ("w", None, [("a", None)])], NEWS)
    got = {r.team: r.x for r in df.select("team", search_text(F.col("answer"), F.col("results")).alias("x")).collect()}
    assert got == {"t": "Summary: yes\n\n\n[a]\nb\n\n\n[c]\nd", "u": None, "v": None, "w": "\n[a]\n"}


def test_horizon_is_real_time_in_any_zone(spark):
    times = [("2026-03-26T12:00:00Z", True), ("2026-04-02T12:00:00Z", True), ("2026-04-02T12:00:00.001Z", False), ("2026-03-26T11:59:59.999Z", False)]
    df = spark.createDataFrame(times, "t string, e boolean")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "Europe/Berlin"):
            spark.conf.set("spark.sql.session.timeZone", z)
            got = df.select("e", within_horizon(instant(F.col("t")), instant(F.lit("2026-03-26T12:00:00Z"))).alias("g")).collect()
            assert all(r.e == r.g for r in got)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_dates(spark):
    got = spark.range(1).select(day_and_time(instant(F.lit("2026-11-26T22:20:00Z"))), day_and_time(instant(F.lit("soon")))).first()
    assert tuple(got) == ("26 ноября 2026 22:20", None)


def test_analysis_flow(spark, f1):
    news = spark.createDataFrame([(HOME, "form", [])], NEWS)
    asked = analysis_input(f1.where("id IN ('G1', 'G2')"), news, F.lit("НБА"))
    rows = {r.id: r for r in asked.collect()}
    assert "Summary: form" in rows["G1"].prompt and rows["G2"].odds == "[]"
    assert json.loads(rows["G1"].odds)[0]["title"] == "BookA"
    said = spark.createDataFrame([("G1", "text", "done"), ("G2", "half", "open")], "stream_id string, content string, status string")
    assert [(r.homeTeam, r.result) for r in finished(asked, said).collect()] == [(HOME, "text")]


def test_rules(spark, f1):
    best = M.best_prices(f1)
    scores = {(r.market, r.score): r.half_time for r in rules.likely_scores(best).collect()}
    assert scores == {("П1", "1:0"): ["П1/П1"], ("П1", "2:0"): ["П1/П1"], ("П1", "2:1"): ["П1/П1", "X/П1"]}
    estimates = spark.createDataFrame([("G1", "П1", 60.6), ("G1", "П2", 27.0)], "event_id string, market string, p double")
    assert [r.market for r in rules.value_bets(best, estimates).collect()] == ["П1"]


def test_repeated_ids_are_listed_once_each(f1):
    twice = f1.where("id = 'G1'").union(f1.where("id = 'G1'"))
    assert upcoming_list(twice, F.lit(NOW).cast("timestamp")).count() == 2


def test_both_score_rule(spark):
    best = spark.createDataFrame([("e", schemas.BOTH_SCORE, 1.79), ("f", schemas.BOTH_SCORE, 1.8)], "event_id string, market string, price double")
    assert {(r.event_id, r.score) for r in rules.likely_scores(best).collect()} == {("e", s) for s in ("2:1", "3:1", "1:1", "2:2")}


def test_many_names_are_matched_without_comparing_all(spark):
    """10,000 by 10,000 names, short, odd and equal ones among them, as a nested loop matches them."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.choice([1, 2, 3, 6, 9, 12])))
    left = [*{word() for _ in range(14_000)}][:10_000] + ["Динамо", "", None, "a b-c"]
    right = [*{word() + r.choice(["", "fc"]) for _ in range(14_000)}][:10_000] + ["Зенит", "ab", None]
    a, b = (spark.createDataFrame([(x,) for x in side], "n string").select(normalized(F.col("n")).alias("n")) for side in (left, right))
    got = matching.alike_names(a, b)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    want = a.distinct().alias("a").join(b.distinct().alias("b"), alike_normal(F.col("a.n"), F.col("b.n")))
    hashes = lambda df: df.select(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
    assert hashes(got) == hashes(want.select(F.col("a.n").alias("a"), F.col("b.n").alias("b"))) and got.count() > 10_000


def test_names_without_letters_match_all_by_pieces_too(spark):
    a, b = (spark.createDataFrame([(x,) for x in side], "n string") for side in (["", "xy", "abc"], ["", "x", "zabc"]))
    got = {tuple(r) for r in matching.alike_names(a, b, require_nonempty=False).collect()}
    assert got == {("", ""), ("", "x"), ("", "zabc"), ("xy", ""), ("abc", ""), ("xy", "x"), ("abc", "zabc")}


@pytest.mark.parametrize("text,kept", [("2026-01-03T15:00:00Z", True), ("2026-01-03", True), ("15:00", False), ("T15:00:00", False), ("2026-01", False), ("soon", False), ("", False), (None, False)])
def test_only_whole_dates_are_instants(spark, text, kept):
    assert (spark.createDataFrame([(text,)], "t string").select(instant(F.col("t"))).first()[0] is not None) is kept


def test_the_odds_of_a_prompt_are_written_once(spark, f1):
    news = spark.createDataFrame([], NEWS)
    plan = analysis_input(f1, news, F.lit("L")).select("id", "prompt")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(schemas.ODDS_COUNT) == 1


def test_news_are_brought_to_pairs_of_teams(spark):
    """No join takes in rows that hold both a match and a text; nulls and missing teams keep their match."""
    listed = spark.createDataFrame([("1", "A", "B"), ("2", "A", "B"), ("3", None, "B"), ("4", "A", None), ("5", None, None), ("6", "X", "Y"), ("7", "B", "A")], "id string, home_team string, away_team string")
    news = spark.createDataFrame([("A", "a", []), ("B", "b", [])], "team string, answer string, results array<struct<title string, content string>>")
    told = with_news(listed, news)
    a, b = "Summary: a", "Summary: b"
    assert sorted(tuple(r) for r in told.select("id", "home_news", "away_news").collect()) == [("1", a, b), ("2", a, b), ("3", None, b), ("4", a, None), ("5", None, None), ("6", None, None), ("7", b, a)]
    nodes = [told._jdf.queryExecution().optimizedPlan()]
    while nodes:
        node = nodes.pop()
        below = node.children().iterator()
        while below.hasNext():
            child = below.next()
            nodes.append(child)
            names = {c.strip().split("#")[0] for c in child.output().mkString(",").split(",")}
            assert node.nodeName() != "Join" or not {"id", "home_news"} <= names
