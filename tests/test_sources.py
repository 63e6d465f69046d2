"""Feed, search, history and stream frames."""

import json
from threading import Barrier

import pytest
from pyspark.sql import functions as F

from parimutuel.plans import session
from parimutuel.plans.flows import league_game, listing, listing_status, upcoming_list
from parimutuel.schemas import ANALYSIS
from parimutuel.schemas import BOOKMAKERS
from parimutuel.sources import files, odds_api, requests, search, snapshots
from parimutuel.sources.history import LISTED, History
from parimutuel.streaming import frames

FEED = [{"id": "a", "commence_time": "2026-01-02T00:00:00Z", "home_team": "H", "away_team": "W", "bookmakers": [{"title": "B", "markets": [{"key": "h2h", "outcomes": [{"name": "H", "price": 2}, {"name": "W", "price": "1.5"}]}]}]}, {"id": "b", "commence_time": "2026-01-01T12:00:00Z", "home_team": "H", "away_team": "W"}]


def refusing(*answers):
    """A fetcher that gives these answers in turn and keeps the markets it was asked for."""
    asked, left = [], list(answers)

    def fetch(url):
        asked.append(url.split("markets=")[1].split("&")[0])
        return left.pop(0)

    return fetch, asked


def invalid(message):
    return 422, json.dumps({"error_code": "INVALID_MARKET", "message": message})


def test_markets_are_given_up():
    fetch, asked = refusing(invalid("not supported: btts"), (200, "[]"))
    assert odds_api.negotiated(fetch, "k") == [] and asked == ["h2h,spreads,btts", "h2h,spreads"]


@pytest.mark.parametrize("answer", [(500, "down"), (422, json.dumps({"error_code": "OTHER", "message": "btts"})), invalid("no such market"), invalid("h2h_lay"), invalid("h2h spreads btts"), (422, "[1]")])
def test_other_errors_end(answer):
    fetch, asked = refusing(answer)
    with pytest.raises(odds_api.FeedError) as e:
        odds_api.negotiated(fetch, "k")
    assert e.value.status == 502 and len(asked) == 1


def test_last_market_is_not_given_up():
    fetch, _ = refusing(invalid("h2h"))
    with pytest.raises(odds_api.FeedError):
        odds_api.negotiated(fetch, "k", markets=["h2h"])


def fake(url):
    return (200, json.dumps(FEED)) if "soccer_epl" in url else (200, "[]")


def test_feed_source(spark):
    spark.dataSource.register(odds_api.OddsSource)
    rows = spark.read.format("odds").option("apiKey", "k").option("sport", "soccer_epl,basketball_nba").option("fetcher", "tests.test_sources:fake").load()
    got = odds_api.typed(rows).orderBy("src_ord").collect()
    assert [r.id for r in got] == ["a", "b"] and got[0].bookmakers[0].markets[0].outcomes[1].price is None
    shown = upcoming_list(odds_api.typed(rows), F.lit("2026-01-01T00:00:00Z").cast("timestamp")).collect()
    assert [(r.id, r.home_odds) for r in shown] == [("b", None), ("a", 2.0)]


def test_feed_needs_a_key(spark):
    with pytest.raises(Exception, match="apiKey"):
        spark.dataSource.register(odds_api.OddsSource)
        spark.read.format("odds").load().collect()


def test_landed_feed(spark, tmp_path):
    (tmp_path / "feed.json").write_text(json.dumps(FEED))
    got = files.read_feed(spark, str(tmp_path)).orderBy("src_ord").collect()
    assert [(r.id, r.src_ord, r.bookmakers is None) for r in got] == [("a", 0, False), ("b", 1, True)]


def test_search_failures_are_no_news(spark):
    def broken(_):
        raise OSError

    answers = {"ok": (200, json.dumps({"answer": "yes", "results": [{"title": "t", "content": "c"}]})), "bad": (500, ""), "junk": (200, "{")}
    ask = lambda body: broken(body) if body["query"] == "gone" else answers[body["query"]]
    got = {r.team: (r.answer, r.results and len(r.results)) for r in search.news(queries(spark, *("ok", "bad", "junk", "gone")), ask, "k").collect()}
    assert got == {"ok": ("yes", 1), "bad": (None, None), "junk": (None, None), "gone": (None, None)}
    assert search.searched(ask, None, "ok") == (None, None)


def test_history(spark, tmp_path):
    h = History(spark, str(tmp_path / "h"))
    assert h.latest().columns == LISTED and h.latest().count() == 0 and h.delete("x") == 0
    rows = spark.range(101).select(F.col("id").cast("string"), *(F.lit("x").alias(c) for c in ("league", "matchDate", "homeTeam", "awayTeam", "result")), F.when(F.col("id") % 2 == 0, "[]").alias("odds"), F.timestamp_seconds(F.col("id")).alias("createdAt"))
    h.append(rows)
    got = h.latest().collect()
    assert len(got) == 100 and got[0].id == "100" and got[-1].id == "1"
    assert h.get("7").first().odds is None and files.typed_odds(h.get("8")).first().bookmakers == []
    assert h.get("nope").isEmpty()
    assert h.delete("7") == 1 and h.delete("7") == 0 and h.table().count() == 100
    h.append(rows.drop("id", "createdAt").limit(1))
    assert h.table().count() == 101 and h.table().schema.names == ANALYSIS.names


TEXT = "".join(f"data: {json.dumps(e)}\n\n" for e in ({"type": "text", "content": "ab"}, {"type": "text", "content": "c"}, {"type": "text", "content": "d"}, {"type": "done", "id": "7"}))


def test_frames_survive_every_cut(spark):
    rows = [(str(k), i, part) for k in range(len(TEXT) + 1) for i, part in enumerate((TEXT[:k], TEXT[k:]))]
    got = frames.folded(frames.reassembled(spark.createDataFrame(rows, "stream_id string, seq long, chunk string"))).collect()
    assert len(got) == len(TEXT) + 1 and {(r.content, r.status, r.id) for r in got} == {("abcd", "done", "7")}


def test_bad_frames_are_skipped_and_the_tail_is_dropped(spark):
    text = "data: {oops\n\nevent: x\n\ndata: {\"type\":\"text\",\"content\":\"a\"}\n\ndata: {\"type\":\"error\",\"message\":\"m\"}\n\ndata: {\"type\":\"text\",\"content\":\"b\"}\n\ndata: {\"type\":\"text\",\"content\":\"c\"}"
    events = frames.reassembled(spark.createDataFrame([("s", 0, text)], "stream_id string, seq long, chunk string"))
    assert events.count() == 3
    got = frames.folded(events).first()
    assert (got.content, got.status, got.message) == ("a", "error", "m")


def test_streamed_frames(spark, tmp_path):
    provider = spark.conf.get(frames.ROCKSDB[0], None)
    spark.conf.set(*frames.ROCKSDB)
    try:
        cut = TEXT.index("\n\n") + 1
        source = tmp_path / "in"
        source.mkdir()
        schema = "stream_id string, seq long, chunk string"
        chunks = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(str(source))
        (source / "0.json").write_text(json.dumps({"stream_id": "s", "seq": 0, "chunk": TEXT[:cut]}))
        query = frames.reassembled_stream(chunks).writeStream.format("memory").queryName("framed").option("checkpointLocation", str(tmp_path / "c")).start()
        try:
            query.processAllAvailable()
            assert spark.table("framed").count() == 0
            (source / "1.json").write_text(json.dumps({"stream_id": "s", "seq": 1, "chunk": TEXT[cut:]}))
            query.processAllAvailable()
        finally:
            query.stop()
        assert [(r.type, r.content) for r in spark.table("framed").collect()] == [("text", "ab"), ("text", "c"), ("text", "d"), ("done", None)]
    finally:
        spark.conf.set(frames.ROCKSDB[0], provider) if provider else spark.conf.unset(frames.ROCKSDB[0])


def test_snapshots_are_kept_for_a_while(spark, tmp_path):
    loads, now = [], [1000.0]

    def load():
        loads.append(1)
        return spark.createDataFrame([(len(loads),)], "n int")

    ask = lambda ttl=snapshots.LIST_TTL: snapshots.cached(spark, str(tmp_path / "s"), load, ttl, lambda: now[0]).first().n
    assert ask() == 1
    now[0] += 299
    assert ask() == 1
    now[0] += 1
    assert ask() == 2 and ask(snapshots.LEAGUE_TTL) == 3


def test_session_values(spark):
    assert session.recall(spark, "last_matches") is None
    session.remember(spark.range(3), "last_matches")
    assert session.recall(spark, "last_matches").count() == 3
    assert session.forget(spark, "last_matches") and session.recall(spark, "last_matches") is None


def fails(url):
    return 500, ""


def league_feed(url):
    """Answers with what was asked, as the match's id."""
    sport, markets = url.split("sports/")[1].split("/")[0], url.split("markets=")[1].split("&")[0]
    return 200, json.dumps([{**m, "id": f"{m['id']} {sport} {markets}"} for m in FEED])


def test_league_game(spark):
    assert league_game(spark, league_feed, "k", "NBA", "h", "W!").collect()[0].id == "a basketball_nba h2h,totals,btts"
    assert league_game(spark, league_feed, "k", "?", "h", "w").collect()[0].id.split()[1] == "soccer_epl"
    assert league_game(spark, league_feed, "k", "?", "zzz", "w") is None
    assert league_game(spark, league_feed, None, "NBA", "h", "w") is None
    assert league_game(spark, fails, "k", "NBA", "h", "w") is None


def test_listing_status(spark):
    assert (listing_status(spark.range(0)), listing_status(spark.range(1))) == ("empty", "ok")


def test_events_are_framed_and_stored(spark, tmp_path):
    rows = [("s", "text", "ab", None, None), ("s", "done", None, "7", None)]
    events = spark.createDataFrame(rows, "stream_id string, type string, content string, id string, message string")
    assert [r.value for r in frames.framed(events).collect()] == ['data: {"type":"text","content":"ab"}\n\n', 'data: {"type":"done","id":"7"}\n\n']
    source = str(tmp_path / "events")
    events.write.parquet(source)
    history = History(spark, str(tmp_path / "kept"))
    fill = [F.lit("x").alias(c) for c in ("league", "matchDate", "homeTeam", "awayTeam", "result", "odds")]
    query = frames.stored(spark.readStream.schema(events.schema).parquet(source), history, str(tmp_path / "c"), lambda done: done.select("id", *fill)).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert [r.id for r in history.table().collect()] == ["7"]


def analysis(spark, id):
    return spark.createDataFrame([(id, "l", "d", "h", "a", "r", None)], "id string, league string, matchDate string, homeTeam string, awayTeam string, result string, odds string")


def test_inserts_are_whole_and_count_once(spark, tmp_path):
    path = tmp_path / "h"
    h = History(spark, str(path))
    for _ in range(2):
        h.append(analysis(spark, "1"), key="k")
    h.append(analysis(spark, "2"))
    assert sorted(r.id for r in h.table().collect()) == ["1", "2"]
    # A write that has not ended is not read.
    broken = path / "insert=half"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"no parquet")
    assert h.table().count() == 2
    assert h.delete("2") == 1
    h.append(analysis(spark, "1"), key="k")  # still known after the delete
    assert [r.id for r in h.table().collect()] == ["1"]


def test_lookups_and_deletes_touch_one_bucket(spark, tmp_path):
    h = History(spark, str(tmp_path / "h"), buckets=8)
    rows = spark.range(400).select(F.col("id").cast("string"), *(F.lit("x").alias(c) for c in ("league", "matchDate", "homeTeam", "awayTeam", "result", "odds")))
    h.append(rows.where("id < 200"), key="a")
    h.append(rows.where("id >= 200"), key="b")
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "h").rglob("*.parquet")}
    before = files()
    assert len(before) == 16
    found = h.get("42")
    assert [r.id for r in found.collect()] == ["42"] and "PartitionFilters: [isnotnull(bucket" in found._jdf.queryExecution().executedPlan().toString()
    assert h._held("42").select(F.input_file_name()).distinct().count() == 1
    assert h.delete("42") == 1 and h.delete("42") == 0
    after = files()
    gone, new = before.keys() - after.keys(), after.keys() - before.keys()
    assert len(gone) == 1 and {p.parent for p in new} == {p.parent for p in gone} and all(before[p] == after[p] for p in before.keys() & after.keys())
    assert sorted(int(r.id) for r in h.table().collect()) == [i for i in range(400) if i != 42]


def test_a_stored_batch_is_told_once_it_is_kept(spark, tmp_path):
    events = spark.createDataFrame([("s", "text", "ab", None, None), ("s", "done", None, "7", None)], "stream_id string, type string, content string, id string, message string")
    source, told = str(tmp_path / "events"), []
    events.write.parquet(source)
    history = History(spark, str(tmp_path / "kept"))
    fill = [F.lit("x").alias(c) for c in ("league", "matchDate", "homeTeam", "awayTeam", "result", "odds")]

    def tell(done):
        told.extend((r.value, history.table().count()) for r in done.collect())

    start = lambda: frames.stored(spark.readStream.schema(events.schema).parquet(source), history, str(tmp_path / "c"), lambda done: done.select("id", *fill), tell).start()
    for commit in (tmp_path / "c" / "commits" / "0", None):
        query = start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        if commit:  # as if it had failed before the end: the batch runs again
            for f in (commit, commit.with_name(".0.crc")):
                f.unlink(missing_ok=True)
    assert [r.id for r in history.table().collect()] == ["7"]
    assert told[0] == ('data: {"type":"done","id":"7"}\n\n', 1)


def test_a_model_is_a_source_of_chunks(spark, tmp_path):
    def model(prompt):
        yield "message_start", None, None
        for word in prompt.split():
            yield "content_block_delta", "text_delta", word

    prompts = spark.createDataFrame([("a", "one two"), ("b", "three")], "stream_id string, prompt string")
    want = {("a", 1, "one"), ("a", 2, "two"), ("b", 1, "three")}
    assert {(r.stream_id, r.seq, r.event.content) for r in frames.text_events(frames.said(prompts, model)).collect()} == want
    source = str(tmp_path / "prompts")
    prompts.write.parquet(source)
    chunks = frames.said(spark.readStream.schema(prompts.schema).parquet(source), model)
    query = frames.text_events(chunks).writeStream.format("memory").queryName("said").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
        assert {(r.stream_id, r.seq, r.event.content) for r in spark.table("said").collect()} == want
    finally:
        query.stop()


def queries(spark, *texts):
    return spark.createDataFrame([(q, q) for q in texts], "team string, query string").coalesce(1)


BOTH = Barrier(2, timeout=20)


def meets(_):
    BOTH.wait()
    return 200, json.dumps({"answer": "x", "results": []})


def test_searches_run_at_the_same_time(spark):
    assert {r.team: r.answer for r in search.news(queries(spark, "a", "b"), meets, "k").collect()} == {"a": "x", "b": "x"}


CALLS = []


def moody(body):
    """Fails the first time that a worker asks something."""
    CALLS.append(body["query"])
    return (500, "") if CALLS.count(body["query"]) < 2 else (200, json.dumps({"answer": body["query"], "results": [{"title": "t", "content": None}]}))


def test_searches_are_tried_again(spark):
    rows = search.news(queries(spark, "a1", "a2", "a3"), moody, "k", tries=2, wait=0.01, block=2).collect()
    assert {r.team: (r.answer, [tuple(x) for x in r.results]) for r in rows} == {q: (q, [("t", None)]) for q in ("a1", "a2", "a3")}
    assert {r.answer for r in search.news(queries(spark, "b1"), moody, "k").collect()} == {None}
    assert {r.answer for r in search.news(queries(spark, "b2"), moody, None, tries=3).collect()} == {None}


def counting(url):
    """Leaves a mark for each league that is asked for."""
    from pathlib import Path

    sport = url.split("sports/")[1].split("/")[0]
    folder = Path(url.split("apiKey=")[1].split("&")[0])
    (folder / sport).touch()
    return 200, json.dumps([{"id": sport, "home_team": t, "away_team": "w"} for t in ("h", "other")])


def test_only_the_leagues_and_teams_asked_for_are_fetched(spark, tmp_path):
    spark.dataSource.register(odds_api.OddsSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = spark.read.format("odds").option("apiKey", str(tmp_path)).option("fetcher", "tests.test_sources:counting").option("sport", "a,b,c,d").option("pushDown", "true").load()
        got = rows.where(F.col("sport").isin("b", "d", "e")).where("home_team = 'h'").collect()
        assert sorted((r.sport, r.home_team, json.loads(r.match)["id"]) for r in got) == [("b", "h", "b"), ("d", "h", "d")]
        assert sorted(p.name for p in tmp_path.iterdir()) == ["b", "d"]
        assert rows.where("sport = 'z'").collect() == [] and rows.where("sport = 'a' AND src_ord > 0").count() == 1
        assert rows.where("sport = 'c'").count() == 2
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_a_scan_of_a_week_reads_a_week(spark, tmp_path):
    feed = spark.range(400).select(F.when(F.col("id") == 9, None).otherwise(F.col("id").cast("string")).alias("id"), F.when(F.col("id") == 8, "15:00").otherwise(F.date_format(F.timestamp_seconds(F.lit(1767225600) + F.col("id") * 21600), "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("commence_time"), F.lit("h").alias("home_team"), F.lit("w").alias("away_team"), F.from_json(F.lit("[]"), BOOKMAKERS).alias("bookmakers"), F.col("id").cast("int").alias("src_ord"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("sport"))
    files.land(feed, str(tmp_path))
    now = F.lit("2026-01-20T07:00:00Z").cast("timestamp")
    got = files.landed_upcoming(spark, str(tmp_path), now, sports=["even"])
    want = {r.id for r in upcoming_list(feed.where("id % 2 = 0"), now).collect()}
    assert {r.id for r in got.collect()} == want and len(want) == 14
    assert "PartitionFilters: [" in got._jdf.queryExecution().executedPlan().toString()
    days = {p.name for p in (tmp_path / "matches" / "sport=even").iterdir() if "=" in p.name}
    assert len(days) == 100 and len({r.d for r in got.select(F.to_date("starts_at").alias("d")).collect()}) == 8
    scanned = got.select(F.input_file_name().alias("f")).distinct().count()
    assert scanned <= 10 * 4
    reasons = {r.reason: r.id for r in spark.read.parquet(f"{tmp_path}/rejects").collect()}
    assert reasons == {"no date": "8", "no id": None}


def test_landing_reads_a_feed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    feed = spark.range(20).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") < 5, "soon").otherwise("2026-01-03T15:00:00Z").alias("commence_time"), F.lit("h").alias("home_team"), F.lit("w").alias("away_team"), F.from_json(F.lit("[]"), BOOKMAKERS).alias("bookmakers"), F.col("id").cast("int").alias("src_ord"), F.lit("s").alias("sport"))
    files.land(feed.mapInArrow(counted, feed.schema), str(tmp_path))
    assert seen.value == 20
    assert spark.read.parquet(f"{tmp_path}/matches").count() == 15 and spark.read.parquet(f"{tmp_path}/rejects").count() == 5


@pytest.mark.parametrize("body,reason", [
    ('{"homeTeam":"h","awayTeam":"w","league":"l","matchDate":"d","bookmakers":[{"title":"t","markets":[]}],"more":1}', None),
    ('{"homeTeam":"h","awayTeam":"w"}', None), ('{"homeTeam":"h","awayTeam":"w","league":null}', None),
    ('{"homeTeam":"h"', "malformed"), ("", "malformed"), (None, "malformed"), ("[]", "malformed"), ('"x"', "malformed"), ("null", "malformed"),
    ("{}", "missing homeTeam"), ('{"homeTeam":"h"}', "missing awayTeam"), ('{"homeTeam":null,"awayTeam":"w"}', "missing homeTeam"),
    ('{"homeTeam":1,"awayTeam":"w"}', "wrong type homeTeam"), ('{"homeTeam":"h","awayTeam":"w","bookmakers":{}}', "wrong type bookmakers"), ('{"homeTeam":"h","awayTeam":"w","league":[1]}', "wrong type league"),
])
def test_request_bodies(spark, body, reason):
    bodies = spark.createDataFrame([("r", body)], "request_id string, body string")
    (r,) = requests.parsed(bodies).collect()
    assert r.reason == reason and r.homeTeam == (None if reason else "h")
    good, bad = requests.split(bodies)
    assert (good.count(), bad.count()) == ((0, 1) if reason else (1, 0))
    if body and "title" in body:
        assert r.bookmakers[0].title == "t" and (r.league, r.matchDate) == ("l", "d")


def test_listing(spark):
    def fail():
        raise odds_api.FeedError("refused")

    assert listing(fail) == ("error", None, "refused")
    assert listing(lambda: spark.range(0))[0] == "empty" and listing(lambda: spark.range(2))[1].count() == 2
