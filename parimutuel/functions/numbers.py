"""Numbers as the domain writes them: shortest texts and fixed digits of the exact binary value.

A double's text is the shortest that reads back as the same double, plain from 1e-6
on to under 1e21 and with an exponent beyond. Fixed digits round the exact value, ties
away from zero, whatever the shortest text looks like: 1.005 has two digits 1.00.
All are column expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(x: Column) -> Column:
    """The number, null where it is not finite: a NaN would otherwise win every comparison."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def whole_digits(x: Column) -> Column:
    """All digits of a whole number from 0 to under 1e27."""
    half = float(1 << 45)
    high = F.floor(x / half)
    low = F.floor(x - high.cast("double") * half)
    return (high.cast("decimal(20,0)") * F.lit(1 << 45).cast("decimal(17,0)") + low.cast("decimal(20,0)")).cast("string")


def shortest(x: Column) -> Column:
    """A text of a positive double with as few digits as read back the same, with or without exponent.

    Spark's own text may have digits too many, and of large whole numbers not the
    nearest: those are rounded from all their digits.
    """
    large = (x >= float(1 << 53)) & (x < 1e27)

    def rounded(digits: int) -> Callable[[Column], Column]:
        up = lambda t: F.when(F.substr(t, F.lit(digits + 1), F.lit(1)) >= "5", 1).otherwise(0)
        cut = lambda t: F.concat((F.substr(t, F.lit(1), F.lit(digits)).cast("long") + up(t)).cast("string"), F.repeat(F.lit("0"), F.length(t) - digits))
        return lambda t: F.when(F.length(t) > digits, cut(t)).otherwise(t)

    text = x.cast("string")
    for digits in (17, 16, 15, 1):  # one: the smallest of all, whose own text has two
        exact = let(whole_digits(F.when(large, x)), rounded(digits))
        tried = F.coalesce(exact, F.format_string(f"%.{digits - 1}e", x))
        text = F.when(tried.cast("double") == x, tried).otherwise(text)
    return text


def parts(text: Column, use: Callable[[Column, Column], Column]) -> Column:
    """``use(digits, point)`` of a positive number's text: digits without zeros around them, and where the point stands."""

    def split(t: Column) -> Column:
        e = F.instr(t, "e")
        mantissa = F.when(e > 0, F.substr(t, F.lit(1), e - 1)).otherwise(t)
        exponent = F.when(e > 0, F.substr(t, e + 1).cast("int")).otherwise(0)
        whole = F.substring_index(mantissa, ".", 1)
        raw = F.replace(mantissa, F.lit("."), F.lit(""))
        return F.struct(F.rtrim(F.ltrim(raw, F.lit("0")), F.lit("0")).alias("digits"), (F.length(whole) + exponent - F.length(raw) + F.length(F.ltrim(raw, F.lit("0")))).alias("point"))

    return let(let(F.lower(text), split), lambda s: use(s["digits"], s["point"]))


def written(digits: Column, point: Column) -> Column:
    n = F.length(digits)
    zeros = lambda k: F.repeat(F.lit("0"), k)
    more = F.when(n > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise("")
    power = F.concat(F.lit("e"), F.when(point > 0, "+").otherwise("-"), F.abs(point - 1).cast("string"))
    return (
        F.when((n <= point) & (point <= 21), F.concat(digits, zeros(point - n)))
        .when((point > 0) & (point <= 21), F.concat(F.substr(digits, F.lit(1), point), F.lit("."), F.substr(digits, point + 1)))
        .when((point > -6) & (point <= 0), F.concat(F.lit("0."), zeros(-point), digits))
        .otherwise(F.concat(F.substr(digits, F.lit(1), F.lit(1)), more, power))
    )


def plain(x: Column) -> Column:
    """A number as text: 2 rather than 2.0, 10000000 rather than 1.0E7."""
    size = F.abs(x)
    # Few decimals in an ordinary range need no care: a quotient of whole numbers is the nearest double.
    easy = (size >= 0.001) & (size < 1e7) & (F.floor(x * 1000 + 0.5) / 1000 == x)
    short = F.when(F.floor(x) == x, F.floor(x).cast("string")).otherwise(x.cast("string"))
    sign = F.when(x < 0, "-").otherwise("")
    rare = F.when(F.isnan(x), "NaN").when(size == float("inf"), F.concat(sign, F.lit("Infinity"))).when(x == 0, "0")
    return F.when(x.isNull(), None).when(easy, short).otherwise(F.coalesce(rare, F.concat(sign, parts(shortest(size), written))))


def signed(x: Column) -> Column:
    """Plain text with a plus sign before positive numbers."""
    return F.concat(F.when(x > 0, "+").otherwise(""), plain(x))


def fixed(x: Column, digits: int) -> Column:
    """The number with one or two digits after the point.

    The part after the point, times 2^60, is a whole number wherever it can reach half
    a last digit, so integers decide.
    """
    if digits not in (1, 2):
        raise ValueError("one or two digits")
    return let(x, lambda known: fixed_text(known, digits))


def fixed_text(x: Column, digits: int) -> Column:
    """``fixed`` of a number that is read many times, so it should not be computed anew each time."""
    ten = 10**digits
    size = F.abs(x)

    def text(s: Column) -> Column:
        whole = F.floor(s)
        rest = F.floor((s - whole.cast("double")) * float(1 << 60))
        last = lambda r: F.shiftright(F.shiftright(r, 30) * ten + F.shiftright(r.bitwiseAND((1 << 30) - 1) * ten, 30) + (1 << 29), 30)
        point = lambda n: F.concat((whole + F.floor(n / ten)).cast("string"), F.lit("."), F.lpad((n % ten).cast("string"), digits, "0"))
        return let(let(rest, last), point)

    sign = F.when(x < 0, "-").otherwise("")
    usual = F.when(size < float(1 << 62), F.concat(sign, text(F.when(size < float(1 << 62), size))))
    return F.when(x.isNull(), None).when((size < 1e21) & ~F.isnan(x), F.coalesce(usual, F.concat(sign, whole_digits(F.when(size < 1e21, size)), F.lit("." + "0" * digits)))).otherwise(plain(x))


def implied_probability(price: Column) -> Column:
    """Percent that a decimal price implies; null where it is missing, zero or not a number."""
    return F.try_divide(F.lit(1.0), clean(price)) * 100
