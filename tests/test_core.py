"""Operators over any table, at their edges."""

import math
import random
import struct
from decimal import ROUND_HALF_UP, Decimal, localcontext

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parimutuel.functions.numbers import clean, fixed, implied_probability, plain, signed
from parimutuel.operators import core
from parimutuel.operators.matching import named_matches
from parimutuel.schemas import MATCHES

ROWS = "k string, v double, o int, p string"


def test_first_best_of_ties_nulls_and_nan(spark):
    df = spark.createDataFrame([("a", 1.0, 2, "x"), ("a", 1.0, 1, "y"), ("a", None, 0, "z"), ("a", float("nan"), 0, "w"), ("b", None, 0, "q"), (None, 2.0, 0, "n"), ("a", 1.0, 1, "y")], ROWS)
    got = core.first_best(df, ["k"], "v", ["o"], ["p"]).collect()
    assert {(r.k, r.v, r.p) for r in got} == {("a", 1.0, "y"), (None, 2.0, "n")}
    assert core.first_best(df.limit(0), ["k"], "v", ["o"], ["p"]).count() == 0


def test_texts_join_in_order(spark):
    df = spark.createDataFrame([("a", 0.0, 2, "x"), ("a", 0.0, 1, "y"), ("a", 0.0, 3, None), ("b", 0.0, 1, None)], ROWS)
    assert {r.k: r.t for r in core.joined_in_order(df, ["k"], ["o"], "p", "\n", "t").collect()} == {"a": "y\nx"}


def test_without_keeps_nulls(spark):
    df = spark.createDataFrame([("a",), (None,)], "k string")
    assert [r.k for r in core.without(df, "k", "a").collect()] == [None]
    assert core.lookup(df, "k", "a").count() == 1


def test_array_operators(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a", "c"], ["c"]), (2, [], ["c"]), (3, None, ["c"])], "i int, a array<string>, r array<string>")
    got = df.select(core.difference(F.col("a"), F.col("r")).alias("d"), core.first_where(F.col("a"), lambda x: x == "b").alias("f")).collect()
    assert [(r.d, r.f) for r in got] == [(["a", "b", "a"], "b"), ([], None), (None, None)]
    assert [(r.i, r.n, r.x) for r in core.positions(df.drop("r"), "a", "n", "x").collect()] == [(1, 0, "a"), (1, 1, "b"), (1, 2, "a"), (1, 3, "c")]


def test_numbering_of_many_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), "id").repartition(7)
    got = core.numbered(df, ["x"]).orderBy("x").collect()
    assert [r.ord for r in got] == list(range(1000)) == [r.x for r in got]
    assert core.numbered(df.limit(0), ["x"]).count() == 0


def test_default_of_a_dimension(spark):
    labels = spark.createDataFrame([("a", "A")], "k string, label string")
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    assert {(r.k, r.label) for r in core.with_dimension(df, labels, "k", "label", F.col("k")).collect()} == {("a", "A"), ("b", "b"), (None, None)}


@given(st.lists(st.floats(1.01, 1000).map(lambda x: round(x, 2)), min_size=1, max_size=40))
@settings(max_examples=8, deadline=None)
def test_numbers(spark, prices):
    df = spark.createDataFrame([(p,) for p in prices], "p double")
    for r in df.select("p", plain(F.col("p")).alias("t"), fixed(implied_probability(F.col("p")), 1).alias("i"), signed(F.col("p")).alias("s")).collect():
        assert r.t == f"{r.p:g}" or float(r.t) == r.p and not r.t.endswith(".0")
        assert abs(float(r.i) - 100 / r.p) <= 0.0500001 and r.s == "+" + r.t


def test_odd_numbers(spark):
    df = spark.createDataFrame([(0.0,), (None,), (float("nan"),), (float("inf"),), (-0.5,), (2.0,)], "p double")
    got = df.select(fixed(implied_probability(F.col("p")), 1).alias("i"), clean(F.col("p")).alias("c"), signed(F.col("p")).alias("s")).collect()
    assert [r.i for r in got] == [None, None, None, None, "-200.0", "50.0"]
    assert [r.c for r in got] == [0.0, None, None, None, -0.5, 2.0] and got[4].s == "-0.5" and got[5].s == "+2"


def test_named_matches_of_nothing(spark):
    empty = spark.createDataFrame([], MATCHES)
    wanted = spark.createDataFrame([(1, None, "x")], "want_id int, want_home string, want_away string")
    assert named_matches(empty, wanted).count() == 0


def written(x: float) -> str:
    """A double's text by arbitrary precision: the shortest that reads back, plain from 1e-6 to under 1e21."""
    if math.isnan(x) or math.isinf(x):
        return {"nan": "NaN", "inf": "Infinity", "-inf": "-Infinity"}[str(x)]
    sign, digits, e = Decimal(repr(abs(x))).normalize().as_tuple()
    d, point = "".join(map(str, digits)), len(digits) + e
    if x == 0:
        return "0"
    if len(d) <= point <= 21:
        body = d + "0" * (point - len(d))
    elif 0 < point <= 21:
        body = d[:point] + "." + d[point:]
    elif -6 < point <= 0:
        body = "0." + "0" * -point + d
    else:
        body = d[0] + ("." + d[1:] if len(d) > 1 else "") + f"e{'+' if point > 0 else '-'}{abs(point - 1)}"
    return "-" * (x < 0) + body


def rounded(x: float, digits: int) -> str:
    if not abs(x) < 1e21:
        return written(x)
    with localcontext() as c:
        c.prec = 1200
        return "-" * (x < 0) + format(Decimal(abs(x)).quantize(Decimal(1).scaleb(-digits), rounding=ROUND_HALF_UP), "f")


def test_numbers_are_written_exactly(spark):
    """200,000 doubles: random bits, magnitudes, decimals and eighths, against arbitrary precision."""
    r = random.Random(9)
    xs = [struct.unpack("d", struct.pack("Q", r.getrandbits(64)))[0] for _ in range(50_000)]
    xs += [r.choice([-1, 1]) * 10 ** r.uniform(-10, 27) for _ in range(50_000)] + [round(r.uniform(0, 1000), r.randrange(6)) for _ in range(50_000)] + [r.randrange(-(10**6), 10**6) / 8 for _ in range(50_000)]
    xs += [0.0, -0.0, 1e7, 0.0005, 1.005, 2.675, 0.35, 0.995, 99.995, 1e21, 1e-6, 1e-7, 5e-324, 1.7976931348623157e308, math.inf, -math.inf, 2.0**62, 2.0**63, 2.0**69 + 2**20, 123456789012345680000.0, -0.001]
    df = spark.createDataFrame([(x,) for x in xs], "x double").repartition(8)
    out = df.select("x", plain(F.col("x")).alias("p"), fixed(F.col("x"), 1).alias("one"), fixed(F.col("x"), 2).alias("two"))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString().replace("Scan ExistingRDD", "")
    wrong = [(q.x, q.p, q.one, q.two) for q in out.collect() if q.x is not None and (q.p, q.one, q.two) != (written(q.x), rounded(q.x, 1), rounded(q.x, 2))]
    assert not wrong, wrong[:5]
    none = spark.createDataFrame([(None,)], "x double").select(plain(F.col("x")), fixed(F.col("x"), 2)).first()
    assert tuple(none) == (None, None)
