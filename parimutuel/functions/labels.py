"""Labels of markets and outcomes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import BOTH_SCORE, MARKET_LABELS, NEITHER
from .numbers import plain, signed


def mapped(value: Column, labels: dict[str, str], default: Column | None = None) -> Column:
    """The value's label, else the default, else the value itself."""
    table = F.create_map(*(F.lit(x) for item in labels.items() for x in item))
    return F.coalesce(F.try_element_at(table, value), value if default is None else default)


def market_label(key: Column) -> Column:
    return mapped(key, MARKET_LABELS)


def outcome_label(market: Column, name: Column, point: Column, home: Column, away: Column) -> Column:
    """An outcome's label in the odds text; what a market does not name keeps its own name."""
    winner = F.when(name == home, F.concat(F.lit("П1 — "), home)).when(name == away, F.concat(F.lit("П2 — "), away)).when(name == "Draw", "Ничья")
    total = F.when(name == "Over", F.concat(F.lit("ТБ "), plain(point))).when(name == "Under", F.concat(F.lit("ТМ "), plain(point)))
    both = F.when(name == "Yes", BOTH_SCORE).when(name == "No", NEITHER)
    spread = F.concat(name, F.lit(" ("), signed(point), F.lit(")"))
    return F.coalesce(F.when(market == "h2h", winner).when(market == "totals", total).when(market == "btts", both).when(market == "spreads", spread), name)


def best_key(market: Column, name: Column, point: Column, home: Column, away: Column) -> Column:
    """The key under which prices compete; null for markets that do not take part.

    Unlike the label, any third outcome is a draw, and whatever is not over is under.
    """
    winner = F.when(name == home, "П1").when(name == away, "П2").otherwise("Ничья")
    total = F.concat(F.when(name == "Over", "ТБ ").otherwise("ТМ "), plain(point))
    return F.when(market == "h2h", winner).when(market == "totals", total)
