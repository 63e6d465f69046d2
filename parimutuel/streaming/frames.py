"""Event frames: text streams cut anywhere, put together again.

A frame is ``data: `` with a JSON object and an empty line after it. Chunks of a
stream arrive cut at any place; what follows the last empty line waits for more.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType

from ..schemas import EVENT, TEXT, table

# Fixed values.
PREFIX, END = "data: ", "\n\n"
CHUNK_TYPE, DELTA_TYPE = "content_block_delta", "text_delta"


def frame(event: Column) -> Column:
    """An event struct as a frame; null fields are left out."""
    return F.concat(F.lit(PREFIX), F.to_json(event), F.lit(END))


def text_events(chunks: DataFrame) -> DataFrame:
    """Text deltas of a model's stream (stream_id, seq, type, delta_type, text) as events."""
    rows = chunks.where((F.col("type") == CHUNK_TYPE) & (F.col("delta_type") == DELTA_TYPE))
    return rows.select("stream_id", "seq", F.struct(F.lit("text").alias("type"), F.col("text").alias("content"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("message")).alias("event"))


Model = Callable[[str], Iterable[tuple[str, str | None, str | None]]]
#: Chunks handed on together.
AT_ONCE = 10_000
SAID = "stream_id string, seq long, type string, delta_type string, text string"


def said(prompts: DataFrame, model: Model) -> DataFrame:
    """What a model streams for each prompt (stream_id, prompt), as chunks for ``text_events``.

    ``model`` gives (type, delta_type, text) for a prompt. A batch table or a stream:
    ``said(spark.readStream…, model)`` is a source of chunks.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.partition(" ")[0] for f in SAID.split(", ")]
        for batch in batches:
            rows: list[tuple] = []
            for stream_id, prompt in zip(batch["stream_id"], batch["prompt"]):
                for k, chunk in enumerate(model(prompt)):
                    rows.append((stream_id, k, *chunk))
                    if len(rows) == AT_ONCE:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return prompts.select("stream_id", "prompt").mapInPandas(ask, SAID)


def parsed(text: Column) -> Column:
    """The event of a frame; null without the prefix or with bad JSON."""
    event = F.from_json(F.substring(text, len(PREFIX) + 1, 1 << 30), EVENT)
    return F.when(F.startswith(text, F.lit(PREFIX)) & event["type"].isNotNull(), event)


def reassembled(chunks: DataFrame) -> DataFrame:
    """(stream_id, ord, type, content, id, message) of whole chunk tables (stream_id, seq, chunk).

    The tail after the last empty line is dropped.
    """
    whole = chunks.groupBy("stream_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "chunk"))), lambda s: s["chunk"]), "").alias("text"))
    parts = F.split("text", END)
    frames = whole.select("stream_id", F.posexplode(F.slice(parts, F.lit(1), F.size(parts) - 1)).alias("ord", "frame"))
    return frames.select("stream_id", "ord", parsed(F.col("frame")).alias("e")).where("e IS NOT NULL").select("stream_id", "ord", "e.*")


def folded(events: DataFrame) -> DataFrame:
    """(stream_id, content, status, id, message): each stream's text up to its end or error.

    Status is ``done``, ``error`` or ``open``; only finished streams are stored.
    """
    last = events.where(F.col("type").isin("done", "error")).groupBy("stream_id").agg(F.min_by(F.struct("ord", "type", "id", "message"), "ord").alias("end"))
    joined = events.select("stream_id", "ord", "type", "content").join(last, "stream_id", "left")
    said = F.when((F.col("type") == "text") & (F.col("end").isNull() | (F.col("ord") < F.col("end.ord"))), F.struct("ord", "content"))
    grouped = joined.groupBy("stream_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(said)), lambda s: s["content"]), "").alias("content"), F.first("end").alias("end"))
    return grouped.select("stream_id", "content", F.coalesce("end.type", F.lit("open")).alias("status"), "end.id", "end.message")


OUT = table(stream_id=TEXT, ord=LongType(), frame=TEXT)


class Framer(StatefulProcessor):
    """Puts chunks in order over micro-batches and emits whole frames with their place in the stream.

    A chunk that comes before its turn waits in the state; one that comes again is
    dropped. A stream's state goes when its last frame is out, ``done`` or ``error``, or
    when it was silent for too long: then what waits is emitted without what is missing.
    """

    def __init__(self, first: int, silent_ms: int | None, remember_ms: int | None):
        self.first, self.silent_ms, self.remember_ms = first, silent_ms, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.closed = closed(handle, self.remember_ms)
        self.at = handle.getValueState("at", "next long, place long, tail string")
        self.early = handle.getMapState("early", "seq long", "chunk string")

    def framed(self, key: tuple, place: int, text: str) -> Iterator[Row]:
        """The whole frames of a text; the state is put down after the last."""
        *found, self.tail = text.split(END)
        self.place, self.ended = place + len(found), False
        for n, one in enumerate(found):
            yield Row(stream_id=key[0], ord=place + n, frame=one)
            if closes(one):
                self.ended = True
                return

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if self.closed and self.closed.exists():
            return
        after, place, tail = self.at.get() if self.at.exists() else (self.first, 0, "")
        fresh: dict[int, str] = {}
        for row in rows:
            if row.seq is not None and row.seq >= after:
                fresh.setdefault(row.seq, row.chunk or "")
        ready = [tail]
        while True:
            if after in fresh:
                ready.append(fresh.pop(after))
            elif not self.early.containsKey((after,)):
                break
            else:
                ready.append(self.early.getValue((after,))[0])
                self.early.removeKey((after,))
            after += 1
        yield from self.framed(key, place, "".join(ready))
        if self.ended:
            self.forget()
            if self.closed:
                self.closed.update((True,))
            return
        for seq, chunk in fresh.items():
            if not self.early.containsKey((seq,)):
                self.early.updateValue((seq,), (chunk,))
        self.at.update((after, self.place, self.tail))
        remind(self.handle, self.silent_ms, timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        _, place, tail = self.at.get() if self.at.exists() else (0, 0, "")
        waiting = sorted((k[0], v[0]) for k, v in self.early.iterator())
        yield from self.framed(key, place, tail + "".join(chunk for _, chunk in waiting))
        self.forget()

    def forget(self) -> None:
        self.at.clear()
        self.early.clear()
        remind(self.handle, self.silent_ms)

    def close(self) -> None:
        pass


def closes(text: str) -> bool:
    """Whether a frame ends its stream."""
    try:
        event = json.loads(text.removeprefix(PREFIX)) if text.startswith(PREFIX) else None
    except ValueError:
        return False
    return isinstance(event, dict) and event.get("type") in ("done", "error")


def remind(handle: StatefulProcessorHandle, silent_ms: int | None, timerValues=None) -> None:
    """The stream's only timer: gone, and set anew where the time is given; nothing without ``silent_ms``."""
    if silent_ms is None:
        return
    for at in [*handle.listTimers()]:
        handle.deleteTimer(at)
    if timerValues is not None:
        handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + silent_ms)


def closed(handle: StatefulProcessorHandle, remember_ms: int | None):
    """The mark of a stream that has ended, kept for a time; none where nothing is to be remembered."""
    return None if remember_ms is None else handle.getValueState("closed", "closed boolean", ttlDurationMs=remember_ms)


def time_mode(*durations: int | None) -> str:
    return "None" if all(d is None for d in durations) else "ProcessingTime"


def reassembled_stream(chunks: DataFrame, first: int = 0, silent_ms: int | None = None, remember_ms: int | None = None) -> DataFrame:
    """The streaming twin of ``reassembled``: (stream_id, ord, type, content, id, message) as frames become whole.

    A stream's chunks may come in any order and more than once; ``seq`` counts them from
    ``first``. With ``silent_ms`` a stream that brings nothing for so long is closed.
    Chunks that come after the end of their stream are dropped for ``remember_ms``;
    without it they open it anew, and nothing is kept of streams that have ended.
    Needs the RocksDB state store.
    """
    processor = Framer(first, silent_ms, remember_ms)
    frames = chunks.groupBy("stream_id").transformWithState(statefulProcessor=processor, outputStructType=OUT, outputMode="Append", timeMode=time_mode(silent_ms, remember_ms))
    return frames.select("stream_id", "ord", parsed(F.col("frame")).alias("e")).where("e IS NOT NULL").select("stream_id", "ord", "e.*")


FOLDED = table(stream_id=TEXT, content=TEXT, status=TEXT, id=TEXT, message=TEXT)


class Folder(StatefulProcessor):
    """Keeps each stream's text until it ends, then emits it whole; a silent stream is emitted as open."""

    def __init__(self, silent_ms: int | None, remember_ms: int | None):
        self.silent_ms, self.remember_ms = silent_ms, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.closed = closed(handle, self.remember_ms)
        self.said = handle.getListState("said", "ord long, content string")

    def whole(self, key: tuple, status: str, more: list, id: str | None = None, message: str | None = None) -> Row:
        held = [tuple(s) for s in self.said.get()] if self.said.exists() else []
        self.said.clear()
        remind(self.handle, self.silent_ms)
        return Row(stream_id=key[0], content="".join(text for _, text in sorted(held + more)), status=status, id=id, message=message)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if self.closed and self.closed.exists():
            return
        more: list[tuple[int, str]] = []
        for row in sorted(rows, key=lambda r: r.ord):
            if row.type == "text":
                more.append((row.ord, row.content or ""))
            elif row.type in ("done", "error"):
                yield self.whole(key, row.type, more, row.id, row.message)
                if self.closed:
                    self.closed.update((True,))
                return
        if more:
            self.said.appendList(more)
        remind(self.handle, self.silent_ms, timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield self.whole(key, "open", [])

    def close(self) -> None:
        pass


def folded_stream(events: DataFrame, silent_ms: int | None = None, remember_ms: int | None = None) -> DataFrame:
    """The streaming twin of ``folded``: a row a stream once it is done or has failed.

    Events must come in order over micro-batches, as ``reassembled_stream`` gives them;
    within one, ``ord`` orders them. With ``silent_ms`` a stream that brings nothing for
    so long is given up, as ``open``. What comes after the end of a stream is dropped for
    ``remember_ms``; without it nothing is kept of a stream that has ended.
    """
    processor = Folder(silent_ms, remember_ms)
    return events.groupBy("stream_id").transformWithState(statefulProcessor=processor, outputStructType=FOLDED, outputMode="Append", timeMode=time_mode(silent_ms, remember_ms))


ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def framed(events: DataFrame) -> DataFrame:
    """(stream_id, value): each event as the frame that a client reads; works on streams too."""
    return events.select("stream_id", frame(F.struct("type", "content", "id", "message")).alias("value"))


def stored(events: DataFrame, history, checkpoint: str, analyses, told: Callable[[DataFrame], None] | None = None):
    """Start a query that appends the analysis of each stream that is done, then is ready for more.

    ``analyses`` turns done events (stream_id, id) into rows of the history. A batch
    that is run again is not appended again. Once its rows are stored, ``told`` gets
    the batch's ``done`` frames (stream_id, value) to send.
    """
    name = sha256(checkpoint.encode()).hexdigest()[:16]

    def keep(batch: DataFrame, number: int) -> None:
        done = batch.where("type = 'done'")
        if not done.isEmpty():
            history.append(analyses(done.select("stream_id", "id")), key=f"{name}-{number}")
            if told:
                told(framed(done))

    return events.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)


def stored_streams(events: DataFrame, asked: DataFrame, history, checkpoint: str, told: Callable[[DataFrame], None] | None = None, silent_ms: int | None = None, remember_ms: int | None = None):
    """Start a query that keeps each stream's text in its state and stores the analysis once the stream is done.

    ``asked`` has what the history stores besides the text: (id, league, matchDate,
    homeTeam, awayTeam, odds) with a stream's id. A stream that fails, or is silent for
    too long, stores nothing. An analysis' id follows from its stream's, so a batch that
    runs again stores and tells the same. Once a batch's rows are stored, ``told`` gets
    its last frames (stream_id, value): ``done`` with the stored id, or ``error``.
    """
    name = sha256(checkpoint.encode()).hexdigest()[:16]

    def keep(batch: DataFrame, number: int) -> None:
        batch.persist()
        stored_id = F.substring(F.sha2(F.concat(F.lit(name), F.col("stream_id")), 256), 1, 25)
        ended = batch.select("stream_id", "content", "status", "message", stored_id.alias("stored id"))
        done = ended.where("status = 'done'")
        if not done.isEmpty():
            rows = asked.join(done, F.col("id") == F.col("stream_id"))
            history.append(rows.select(F.col("stored id").alias("id"), "league", "matchDate", "homeTeam", "awayTeam", F.col("content").alias("result"), "odds"), key=f"{name}-{number}")
        if told:
            last = ended.where("status <> 'open'")
            id = F.when(F.col("status") == "done", F.col("stored id"))
            told(framed(last.select("stream_id", F.col("status").alias("type"), F.lit(None).cast("string").alias("content"), id.alias("id"), "message")))
        batch.unpersist()

    return folded_stream(events, silent_ms, remember_ms).writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
