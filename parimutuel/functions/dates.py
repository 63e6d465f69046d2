"""Instants and the Russian texts they are shown as. The session's zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import HORIZON_MS, MONTHS


def instant(text: Column) -> Column:
    """The instant of an ISO-8601 text, null where it is none or names no whole date, as a time of day does."""
    return F.when(text.rlike(r"^\s*[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.try_to_timestamp(text))


def within_horizon(t: Column, now: Column, horizon_ms: int = HORIZON_MS) -> Column:
    """Whether ``t`` lies from ``now`` to the horizon, both included; counted in milliseconds of real time."""
    until = F.timestamp_millis(F.unix_millis(now) + horizon_ms)
    return t.between(now, until)


def month(t: Column) -> Column:
    return F.get(F.array(*map(F.lit, MONTHS)), F.month(t) - 1)


def day(t: Column, year: bool = True) -> Column:
    """03 января 2026 г. without the last two letters; or without the year."""
    parts = [F.date_format(t, "dd"), month(t)] + [F.date_format(t, "yyyy")] * year
    return F.when(t.isNotNull(), F.concat_ws(" ", *parts))


def day_and_time(t: Column, year: bool = True) -> Column:
    return F.when(t.isNotNull(), F.concat_ws(" ", day(t, year), F.date_format(t, "HH:mm")))


def short(t: Column) -> Column:
    """03.01.2026, 15:00:00"""
    return F.date_format(t, "dd.MM.yyyy, HH:mm:ss")
