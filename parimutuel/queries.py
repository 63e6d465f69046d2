"""Queries that run each operator over the driver's tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.dates import day, day_and_time, short
from .functions.labels import mapped
from .functions.names import normalized
from .functions.numbers import fixed, implied_probability, plain, signed
from .operators import core, rules
from .operators.matching import alike_names
from .operators.text import odds_line, prompt, search_text
from .schemas import MONTHS, NO_NEWS, NO_NEWS_HEADING, NO_ODDS, NO_ODDS_HEADING, display_order
from .streaming.frames import folded, frame, parsed, reassembled, text_events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    """Register a query under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


WINDOW = ("2024-01-05 00:00:00", "2024-01-12 00:00:00")
LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
LINE_ORDER_SQL = ", ".join(LINE_ORDER)
TYPE_LABELS = {"STANDARD": "Стандарт", "PROMO": "Промо", "ECONOMY": "Эконом"}
FLAGS = ["A", "N", "R"]
IMPLIED_SQL = "CAST(CAST((1.0::DOUBLE / {}) * 100 AS DECIMAL(10, 1)) AS VARCHAR)"
PLAIN_SQL = "regexp_replace(CAST({} AS VARCHAR), '\\.0$', '')"
UPCOMING_SQL = f"SELECT event_id, ts, user_id, event_type FROM events WHERE ts BETWEEN TIMESTAMP '{WINDOW[0]}' AND TIMESTAMP '{WINDOW[1]}'"


def in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = (F.lit(t).cast("timestamp_ntz") for t in WINDOW)
    return core.between(read(spark, sf_dir, "events"), "ts", low, high).select("event_id", "ts", "user_id", "event_type")


@query(UPCOMING_SQL)
def upcoming_window(spark, sf_dir):
    return in_window(spark, sf_dir)


@query(f"SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS ord FROM ({UPCOMING_SQL})")
def upcoming_sorted(spark, sf_dir):
    return core.numbered(in_window(spark, sf_dir), ["ts", "event_id"])


BEST_SQL = f"""
SELECT l_partkey, l_quantity AS price, l_orderkey, l_linenumber FROM (
  SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, {LINE_ORDER_SQL}) AS rn FROM lineitem
) WHERE rn = 1
"""


@query(BEST_SQL)
def best_price(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    best = core.first_best(lines, ["l_partkey"], "l_quantity", LINE_ORDER, ["l_orderkey", "l_linenumber"])
    return best.withColumnRenamed("l_quantity", "price")


@query(f"SELECT *, price >= 50.0 AS highlight FROM ({BEST_SQL})")
def highlight_flag(spark, sf_dir):
    return best_price(spark, sf_dir).withColumn("highlight", F.col("price") >= 50.0)


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, {IMPLIED_SQL.format('l_quantity')} AS implied, {PLAIN_SQL.format('l_quantity')} AS price FROM lineitem")
def implied_text(spark, sf_dir):
    price = F.col("l_quantity")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", fixed(implied_probability(price), 1).alias("implied"), plain(price).alias("price"))


@query("SELECT c_custkey, concat(CASE WHEN n > 0 THEN '+' ELSE '' END, n) AS signed FROM (SELECT c_custkey, CAST(round(c_acctbal) AS INT) AS n FROM customer)")
def signed_number(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", signed(F.round("c_acctbal") + 0.0).alias("signed"))


@query("SELECT n_nationkey, regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') AS name FROM nation")
def normalize_name(spark, sf_dir):
    return read(spark, sf_dir, "nation").select("n_nationkey", normalized(F.col("n_name")).alias("name"))


@query("""
WITH n AS (SELECT n_nationkey AS k, regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') AS name FROM nation)
SELECT a.k AS a_key, b.k AS b_key FROM n a JOIN n b ON (contains(a.name, b.name) OR contains(b.name, a.name)) AND a.name <> '' AND b.name <> ''
""")
def fuzzy_name_join(spark, sf_dir):
    nation = read(spark, sf_dir, "nation")
    a, b = (nation.select(F.col("n_nationkey").alias(f"{x}_key"), normalized(F.col("n_name")).alias(x)) for x in "ab")
    return a.join(alike_names(a.select("a"), b.select("b")), "a").join(b, "b").select("a_key", "b_key")


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS content FROM conversations GROUP BY conv_id")
def fold_stream(spark, sf_dir):
    return core.joined_in_order(read(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "text", "\n", "content")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def history_top100(spark, sf_dir):
    return core.top(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"), "o_orderdate", "o_orderkey", 100)


@query("SELECT * FROM orders WHERE o_orderkey = 42")
def point_lookup(spark, sf_dir):
    return core.lookup(read(spark, sf_dir, "orders"), "o_orderkey", 42)


@query("SELECT * FROM orders WHERE o_orderkey IS DISTINCT FROM 42")
def delete_by_id(spark, sf_dir):
    return core.without(read(spark, sf_dir, "orders"), "o_orderkey", 42)


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders UNION ALL SELECT -1, 0, 'N'")
def insert_append(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return orders.union(spark.createDataFrame([(-1, 0, "N")], orders.schema))


@query("SELECT p_partkey, CASE p_type WHEN 'STANDARD' THEN 'Стандарт' WHEN 'PROMO' THEN 'Промо' WHEN 'ECONOMY' THEN 'Эконом' ELSE 'soccer_epl' END AS label FROM part")
def lookup_default(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", mapped(F.col("p_type"), TYPE_LABELS, F.lit("soccer_epl")).alias("label"))


@query("SELECT p_partkey, p_type, CASE p_type WHEN 'STANDARD' THEN 'Стандарт' WHEN 'PROMO' THEN 'Промо' WHEN 'ECONOMY' THEN 'Эконом' ELSE p_type END AS label FROM part")
def lookup_passthrough(spark, sf_dir):
    labels = spark.createDataFrame([*TYPE_LABELS.items()], "p_type string, label string")
    return core.with_dimension(read(spark, sf_dir, "part").select("p_partkey", "p_type"), labels, "p_type", "label", F.col("p_type"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("""
SELECT ord, o.key AS p_type, count(*) AS n FROM part JOIN (VALUES (0, 'PROMO'), (1, 'SMALL'), (2, 'ECONOMY')) AS o(ord, key) ON p_type = o.key GROUP BY ord, o.key
""")
def ordered_dimension(spark, sf_dir):
    counts = read(spark, sf_dir, "part").groupBy(F.col("p_type").alias("key")).agg(F.count("*").alias("n"))
    return core.in_order_of(counts, display_order(spark, ["PROMO", "SMALL", "ECONOMY"]), "key").withColumnRenamed("key", "p_type")


@query(f"SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE_ORDER[1:])}, l_quantity, l_discount, l_tax) - 1 AS oc_ord, l_linenumber, l_partkey, l_quantity AS price FROM lineitem")
def unnest_quotes(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    nested = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(*LINE_ORDER[1:], "l_quantity", "l_discount", "l_tax"))).alias("outcomes"))
    flat = core.positions(nested, "outcomes", "oc_ord", "o")
    return flat.select("l_orderkey", F.col("oc_ord").cast("long"), "o.l_linenumber", "o.l_partkey", F.col("o.l_quantity").alias("price"))


@query(f"""
WITH f AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY {LINE_ORDER_SQL}, l_quantity) AS rn FROM lineitem
)
SELECT l_orderkey, max(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS home_odds, max(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS draw_odds, max(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS away_odds
FROM f WHERE rn = 1 GROUP BY l_orderkey
""")
def first_bookmaker_pivot(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    nested = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(*LINE_ORDER, "l_quantity", "l_returnflag"))).alias("outcomes"))
    price = lambda flag: core.first_where(F.col("outcomes"), lambda o: o["l_returnflag"] == flag)["l_quantity"]
    return nested.select("l_orderkey", price("A").alias("home_odds"), price("N").alias("draw_odds"), price("R").alias("away_odds"))


@query("SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), 'none') AS news, l.doc_id IS NOT NULL AS found FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id")
def news_enrichment(spark, sf_dir):
    labels = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").cast("string").alias("news"))
    joined = core.with_dimension(read(spark, sf_dir, "documents").select("doc_id"), labels.withColumn("found", F.lit(True)), "doc_id", "news", F.lit("none"))
    return joined.select("doc_id", "news", F.coalesce("found", F.lit(False)).alias("found"))


@query("SELECT l_orderkey, array_to_string(list_filter(['A', 'N', 'R'], lambda x: NOT list_contains(flags, x)), ',') AS missing FROM (SELECT l_orderkey, list(DISTINCT l_returnflag) AS flags FROM lineitem GROUP BY l_orderkey)")
def market_difference(spark, sf_dir):
    flags = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("flags"))
    return flags.select("l_orderkey", F.array_join(core.difference(F.array(*map(F.lit, FLAGS)), F.col("flags")), ",").alias("missing"))


LABEL_SQL = "CASE WHEN l_returnflag = 'A' THEN concat('П1 — ', l_linestatus) WHEN l_returnflag = 'R' THEN concat('П2 — ', l_linestatus) ELSE 'Ничья' END"


def flag_label():
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    return F.when(flag == "A", F.concat(F.lit("П1 — "), status)).when(flag == "R", F.concat(F.lit("П2 — "), status)).otherwise("Ничья")


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, {LABEL_SQL} AS label FROM lineitem")
def outcome_label(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", flag_label().alias("label"))


@query(f"""
SELECT l_orderkey, string_agg(concat('  ', {LABEL_SQL}, ': **', {PLAIN_SQL.format('l_quantity')}, '** (вероятность по рынку: ', {IMPLIED_SQL.format('l_quantity')}, '%)'), chr(10) ORDER BY {LINE_ORDER_SQL}, l_quantity, l_returnflag, l_linestatus) AS odds
FROM lineitem GROUP BY l_orderkey
""")
def odds_text(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").withColumn("line", odds_line(flag_label(), F.col("l_quantity")))
    return core.joined_in_order(lines, ["l_orderkey"], [*LINE_ORDER, "l_quantity", "l_returnflag", "l_linestatus"], "line", "\n", "odds")


@query(f"""
SELECT l_orderkey, array_to_string(list_slice(list(l_linenumber ORDER BY {LINE_ORDER_SQL}, l_quantity), 1, 4), ',') AS first_four FROM lineitem GROUP BY l_orderkey
""")
def first_four(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    nested = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(*LINE_ORDER, "l_quantity"))).alias("o"))
    return nested.select("l_orderkey", F.array_join(F.transform(F.slice("o", 1, 4), lambda s: s["l_linenumber"].cast("string")), ",").alias("first_four"))


def events_of(turns: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return turns.select(F.col("conv_id").cast("string").alias("stream_id"), F.col("turn").alias("seq"), F.struct(F.lit("text").alias("type"), F.col("text").alias("content"), none.alias("id"), none.alias("message")).alias("event"))


@query("SELECT CAST(conv_id AS VARCHAR) AS stream_id, text AS content FROM conversations")
def sse_frames(spark, sf_dir):
    """Frames joined per stream, cut into chunks of 37 characters, and put together again."""
    framed = events_of(read(spark, sf_dir, "conversations")).select("stream_id", "seq", frame(F.col("event")).alias("text"))
    whole = core.joined_in_order(framed, ["stream_id"], ["seq"], "text", "", "text")
    cuts = F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 37).cast("int")), lambda i: F.substr("text", i * 37 + 1, F.lit(37)))
    chunks = whole.select("stream_id", F.posexplode(cuts).alias("seq", "chunk"))
    return reassembled(chunks).select("stream_id", "content")


@query("""
WITH t AS (SELECT conv_id, turn, text, min(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS stop FROM conversations)
SELECT CAST(conv_id AS VARCHAR) AS stream_id, coalesce(string_agg(text, '' ORDER BY turn) FILTER (stop IS NULL OR turn < stop), '') AS content, CASE WHEN max(stop) IS NULL THEN 'open' ELSE 'done' END AS status FROM t GROUP BY conv_id
""")
def fold_until_done(spark, sf_dir):
    """Turns of a conversation as events, of which the first answer ends the stream."""
    turns = read(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "assistant", "done").otherwise("text")
    none = F.lit(None).cast("string")
    events = turns.select(F.col("conv_id").cast("string").alias("stream_id"), F.col("turn").alias("ord"), kind.alias("type"), F.col("text").alias("content"), none.alias("id"), none.alias("message"))
    return folded(events).select("stream_id", "content", "status")


@query("SELECT CAST(conv_id AS VARCHAR) AS stream_id, turn AS seq, text AS content FROM conversations WHERE role = 'assistant'")
def type_tag_filter(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "assistant", "content_block_delta").otherwise(F.col("role"))
    chunks = turns.select(F.col("conv_id").cast("string").alias("stream_id"), F.col("turn").alias("seq"), kind.alias("type"), F.lit("text_delta").alias("delta_type"), "text")
    return text_events(chunks).select("stream_id", "seq", "event.content")


@query("SELECT conv_id, turn, CASE WHEN role = 'user' THEN text END AS content FROM conversations")
def prefix_filter(spark, sf_dir):
    """Users' turns as frames, answers as frames without the prefix or with broken JSON: only the first are parsed."""
    turns = read(spark, sf_dir, "conversations")
    whole = F.split(frame(F.struct(F.lit("text").alias("type"), F.col("text").alias("content"))), "\n\n")[0]
    text = F.when(F.col("role") == "user", whole).when(F.col("turn") % 2 == 0, F.concat(F.lit("event: "), whole)).otherwise(F.substring(whole, 1, 12))
    return turns.select("conv_id", "turn", parsed(text)["content"].alias("content"))


@query("""
WITH t AS (SELECT conv_id, turn, text, min(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS stop FROM conversations)
SELECT CAST(conv_id AS VARCHAR) AS stream_id, coalesce(string_agg(text, '' ORDER BY turn) FILTER (stop IS NULL OR turn < stop), '') AS content, CASE WHEN max(stop) IS NULL THEN 'open' WHEN conv_id % 3 = 0 THEN 'error' ELSE 'done' END AS status,
  max(CASE WHEN turn = stop AND conv_id % 3 = 0 THEN text END) AS message, max(CASE WHEN turn = stop AND conv_id % 3 <> 0 THEN CAST(turn AS VARCHAR) END) AS id FROM t GROUP BY conv_id
""")
def fold_with_errors(spark, sf_dir):
    """The first answer ends a stream: as an error in every third one, with its text as message."""
    turns = read(spark, sf_dir, "conversations")
    answer, bad = F.col("role") == "assistant", F.col("conv_id") % 3 == 0
    kind = F.when(answer & bad, "error").when(answer, "done").otherwise("text")
    events = turns.select(F.col("conv_id").cast("string").alias("stream_id"), F.col("turn").alias("ord"), kind.alias("type"), F.col("text").alias("content"), F.when(answer & ~bad, F.col("turn").cast("string")).alias("id"), F.when(answer & bad, F.col("text")).alias("message"))
    return folded(events).select("stream_id", "content", "status", "message", "id")


@query("SELECT o_orderkey, concat(strftime(o_orderdate, '%d'), ' ', ([" + ", ".join(f"'{m}'" for m in MONTHS) + "])[month(o_orderdate)], ' ', year(o_orderdate)) AS date, strftime(o_orderdate, '%d.%m.%Y, %H:%M:%S') AS stamp FROM orders")
def russian_date(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", day(F.col("o_orderdate")).alias("date"), short(F.col("o_orderdate")).alias("stamp"))


@query("""
SELECT conv_id, nullif(concat_ws(chr(10) || chr(10), CASE WHEN answer <> '' THEN concat('Summary: ', answer) END, results), '') AS news FROM (
  SELECT conv_id, max(CASE WHEN turn = 0 THEN text END) AS answer, string_agg(concat(chr(10), '[', role, ']', chr(10), text), chr(10) || chr(10) ORDER BY turn) FILTER (turn > 0) AS results FROM conversations GROUP BY conv_id)
""")
def news_text(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations")
    later = F.when(F.col("turn") > 0, F.struct("turn", F.col("role").alias("title"), F.col("text").alias("content")))
    grouped = turns.groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("answer"), F.sort_array(F.collect_list(later)).alias("results"))
    return grouped.select("conv_id", search_text(F.col("answer"), F.col("results")).alias("news"))


@query(f"""
SELECT c_custkey, concat_ws(chr(10), concat('## Матч: ', c_name, ' — ', n_name), concat('**Лига:** ', c_mktsegment), '**Дата:** сегодня', concat(chr(10), '{NO_ODDS_HEADING}', chr(10), '{NO_ODDS}'),
  CASE WHEN c_acctbal > 0 THEN concat(chr(10), '## 🔍 Форма и новости: ', c_name, chr(10), 'плюс') ELSE concat(chr(10), '{NO_NEWS_HEADING}', chr(10), '{NO_NEWS}') END) AS prompt
FROM customer JOIN nation ON c_nationkey = n_nationkey
""")
def prompt_text(spark, sf_dir):
    both = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    none = F.lit(None).cast("string")
    text = prompt(F.col("c_mktsegment"), F.lit("сегодня"), F.col("c_name"), F.col("n_name"), none, F.when(F.col("c_acctbal") > 0, "плюс"), none)
    return both.select("c_custkey", text.alias("prompt"))


@query("SELECT o_orderkey, concat(strftime(o_orderdate, '%d'), ' ', m, ' ', year(o_orderdate), ' ', strftime(o_orderdate, '%H:%M')) AS long_date, concat(strftime(o_orderdate, '%d'), ' ', m, ' ', strftime(o_orderdate, '%H:%M')) AS short_date FROM (SELECT *, ([" + ", ".join(f"'{m}'" for m in MONTHS) + "])[month(o_orderdate)] AS m FROM orders)")
def date_texts(spark, sf_dir):
    at = F.col("o_orderdate")
    return read(spark, sf_dir, "orders").select("o_orderkey", day_and_time(at).alias("long_date"), day_and_time(at, year=False).alias("short_date"))


@query("SELECT o_orderkey, rank, CASE rank WHEN 1 THEN 70.0 WHEN 2 THEN 30.0 ELSE 0.0 END::DOUBLE AS two, CASE rank WHEN 1 THEN 50.0 WHEN 2 THEN 30.0 WHEN 3 THEN 20.0 ELSE 0.0 END::DOUBLE AS three FROM (SELECT o_orderkey, CAST(o_orderkey % 5 AS INT) AS rank FROM orders)")
def bank_splits(spark, sf_dir):
    bets = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 5).cast("int").alias("rank"))
    two = rules.bank_split(bets, shares=rules.TWO_BETS).withColumnRenamed("stake", "two")
    return rules.bank_split(two, shares=rules.THREE_BETS).withColumnRenamed("stake", "three")


@query(f"SELECT l_partkey AS event_id, 'П1' AS market, price, CAST(CAST(p - (1.0::DOUBLE / price) * 100 AS DECIMAL(10, 2)) AS VARCHAR) AS edge FROM ({BEST_SQL}) JOIN (SELECT p_partkey, CAST(p_size AS DOUBLE) AS p FROM part) ON l_partkey = p_partkey WHERE p - (1.0::DOUBLE / price) * 100 >= 5")
def value_bets(spark, sf_dir):
    best = best_price(spark, sf_dir).select(F.col("l_partkey").alias("event_id"), F.lit("П1").alias("market"), "price")
    estimates = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("event_id"), F.lit("П1").alias("market"), F.col("p_size").cast("double").alias("p"))
    return rules.value_bets(best, estimates).select("event_id", "market", "price", F.col("edge").cast("decimal(10,2)").cast("string").alias("edge"))


@query("SELECT o_orderkey, rank, CASE rank WHEN 1 THEN 60.0 WHEN 2 THEN 25.0 WHEN 3 THEN 15.0 ELSE 0.0 END::DOUBLE AS stake FROM (SELECT o_orderkey, CAST(o_orderkey % 5 AS INT) AS rank FROM orders)")
def bank_split(spark, sf_dir):
    return rules.bank_split(read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 5).cast("int").alias("rank")))


@query("""
WITH s AS (SELECT s_suppkey AS k, regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g') AS name FROM supplier), c AS (SELECT c_custkey AS k, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS name FROM customer),
n AS (SELECT s.k AS s_key, replace(name, 'supplier', 'customer') AS name FROM s)
SELECT s_key, c.k AS c_key FROM n JOIN c ON contains(c.name, n.name) OR contains(n.name, c.name)
""")
def supplier_customers(spark, sf_dir):
    """Names of two tables of which one holds the other, found by rare pieces."""
    name = normalized(F.col("s_name"))
    asked = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("s_key"), F.replace(name, F.lit("supplier"), F.lit("customer")).alias("a"))
    listed = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c_key"), normalized(F.col("c_name")).alias("b"))
    return asked.join(alike_names(asked.select("a"), listed.select("b")), "a").join(listed, "b").select("s_key", "c_key")


#: A price and its size from tiny to huge; ties of two digits are rounded away from zero.
SCALED_SQL = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE l_linenumber % 4 WHEN 0 THEN l_extendedprice / 1024 WHEN 1 THEN l_extendedprice / 3 WHEN 2 THEN -l_quantity / 8 ELSE l_extendedprice * 1000003 END AS x FROM lineitem"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, printf('%.2f', CASE WHEN x * 8 = floor(x * 8) AND abs(x * 8) % 2 = 1 THEN x + sign(x) * 0.001 ELSE x END) AS two FROM ({SCALED_SQL})")
def fixed_digits(spark, sf_dir):
    line = F.col("l_linenumber") % 4
    price = F.col("l_extendedprice")
    x = F.when(line == 0, price / 1024).when(line == 1, price / 3).when(line == 2, -F.col("l_quantity") / 8).otherwise(price * 1000003)
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", fixed(x, 2).alias("two"))
