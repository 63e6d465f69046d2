"""Web search as a table. Failures of any kind leave a team without news."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame

from ..schemas import NEWS, SEARCH_RESULTS

#: Calls of a task under way at the same time, and those whose answers are handed on together.
AT_ONCE, BLOCK = 8, 64
Search = Callable[[dict], tuple[int, str]]


def searched(search: Search, key: str | None, query: str) -> tuple[str | None, list | None]:
    """Answer and results, both null where the search is not set up or fails."""
    if not key:
        return None, None
    try:
        status, body = search({"api_key": key, "query": query, "search_depth": "basic", "max_results": SEARCH_RESULTS, "include_answer": True})
        found = json.loads(body) if status == 200 else {}
        results = found.get("results")
        return found.get("answer") or None, None if results is None else [(r.get("title"), r.get("content")) for r in results]
    except Exception:  # noqa: BLE001  a failed search is no news
        return None, None


def tried(search: Search, key: str | None, query: str, tries: int, wait: float) -> tuple[str | None, list | None]:
    """``searched``, again after a while where it found nothing at all."""
    found = None, None
    for n in range(tries if key else 1):
        found = searched(search, key, query)
        if found != (None, None):
            break
        if n + 1 < tries:
            time.sleep(wait * 2**n)
    return found


def news(queries: DataFrame, search: Search, key: str | None, tries: int = 1, wait: float = 1.0, block: int = BLOCK) -> DataFrame:
    """(team, answer, results) of each row of ``queries`` (team, query).

    Tasks search, each a share of the queries and some of them at the same time; what
    fails ``tries`` times, each after twice the wait, is no news.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(AT_ONCE) as pool:
            for batch in batches:
                for a in range(0, len(batch), block):
                    teams, asked = batch["team"][a : a + block], batch["query"][a : a + block]
                    found = [*pool.map(lambda query: tried(search, key, query, tries, wait), asked)]
                    rows = [(answer, None if results is None else [{"title": t, "content": c} for t, c in results]) for answer, results in found]
                    yield pd.DataFrame({"team": [*teams], "answer": [r[0] for r in rows], "results": [r[1] for r in rows]})

    return queries.select("team", "query").mapInPandas(ask, NEWS)
