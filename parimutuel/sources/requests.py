"""Request bodies: typed where they fit, rejected with a reason where they don't."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import BOOKMAKERS

#: Fields of a request and the kinds of JSON value that they take; those first named are needed.
NEEDED = {"homeTeam": "STRING", "awayTeam": "STRING"}
OPTIONAL = {"league": "STRING", "matchDate": "STRING", "bookmakers": "ARRAY"}


def parsed(bodies: DataFrame) -> DataFrame:
    """(request_id, homeTeam, awayTeam, league, matchDate, bookmakers, reason) of (request_id, body).

    ``reason`` is null where a body is good, else what is wrong with it first: ``malformed``
    where it is no JSON object, then ``missing`` or ``wrong type`` and the field. A null
    value counts as missing; further fields are ignored; a bookmaker's price that is
    no JSON number is null.
    """
    value = F.try_parse_json(F.col("body"))
    kind = lambda name: F.schema_of_variant(F.try_variant_get("v", f"$.{name}", "variant"))
    there = lambda name: F.col(f"kind of {name}").isNotNull() & (F.col(f"kind of {name}") != "VOID")
    wrong = lambda name, want: there(name) & ~F.startswith(F.col(f"kind of {name}"), F.lit(want))
    every = {**NEEDED, **OPTIONAL}
    read = bodies.select("request_id", "body", value.alias("v"))
    kinds = read.withColumns({"kind of body": F.schema_of_variant("v"), **{f"kind of {n}": kind(n) for n in every}})
    reason = F.when(F.col("v").isNull() | ~F.startswith(F.col("kind of body"), F.lit("OBJECT")), "malformed")
    for name in NEEDED:
        reason = reason.when(~there(name), f"missing {name}")
    for name, want in every.items():
        reason = reason.when(wrong(name, want), f"wrong type {name}")
    text = lambda name: F.when(F.col("reason").isNull(), F.try_variant_get("v", f"$.{name}", "string")).alias(name)
    books = F.when(F.col("reason").isNull(), F.from_json(F.get_json_object("body", "$.bookmakers"), BOOKMAKERS)).alias("bookmakers")
    return kinds.withColumn("reason", reason).select("request_id", *(text(n) for n in [*NEEDED, "league", "matchDate"]), books, "reason")


def split(bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good requests, and (request_id, reason) of the others."""
    every = parsed(bodies)
    return every.where("reason IS NULL").drop("reason"), every.where("reason IS NOT NULL").select("request_id", "reason")

