"""Queries that run the streaming operators over the driver's tables, batch after batch, and their SQL.

A conversation is a stream: its turns are events until the first answer, which ends it,
in every third conversation as an error. Tables are landed as files that are taken
one a micro-batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .plans.checkpoint import cut, scratch
from .queries import query, read
from .schemas import CHUNKS
from .sources.history import History
from .streaming.frame_sink import FrameSink
from .streaming.frames import ROCKSDB, frame, parsed, reassembled_stream, stored_streams

#: Characters of a chunk, and micro-batches that a table is dealt to.
CUT, BATCHES = 211, 3


@contextmanager
def stateful(spark: SparkSession) -> Iterator[None]:
    """Settings of stateful streams: their state store, and a partition a core."""
    wanted = dict([ROCKSDB, ("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))])
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def ended(writer) -> None:
    """Start a stream and wait until it has taken all that is landed."""
    writer.trigger(availableNow=True).start().awaitTermination()


def events(turns: DataFrame) -> DataFrame:
    """Turns as events: text, and the first answer as done or, in every third conversation, as error."""
    answer, bad = F.col("role") == "assistant", F.col("conv_id") % 3 == 0
    event = F.struct(F.when(answer & bad, "error").when(answer, "done").otherwise("text").alias("type"), F.when(~answer, F.col("text")).alias("content"), F.when(answer & ~bad, F.col("turn").cast("string")).alias("id"), F.when(answer & bad, F.col("text")).alias("message"))
    return turns.select(F.col("conv_id").cast("string").alias("stream_id"), F.col("turn").alias("ord"), event.alias("event"))


def chunks(spark, sf_dir, path: str) -> DataFrame:
    """Frames of all conversations, cut into chunks, as a stream that takes them out of order, some twice."""
    framed = events(read(spark, sf_dir, "conversations")).select("stream_id", "ord", frame(F.col("event")).alias("text"))
    texts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda s: s["text"]), "")
    cuts = lambda t: F.transform(F.sequence(F.lit(0), F.floor((F.length(t) - 1) / CUT).cast("int")), lambda i: F.substr(t, i * CUT + 1, F.lit(CUT)))
    cut_up = framed.groupBy("stream_id").agg(texts.alias("text")).select("stream_id", F.posexplode(cuts(F.col("text"))).alias("seq", "chunk"))
    rows = cut_up.select("stream_id", F.col("seq").cast("long").alias("seq"), "chunk")
    for n in range(BATCHES):  # the last chunks of each stream come first
        late = F.col("seq") % BATCHES == BATCHES - 1 - n
        again = (F.col("seq") % 5 == 0) & (F.col("seq") % BATCHES == BATCHES - n)
        rows.where(late | again).coalesce(1).write.mode("append").parquet(f"{path}/chunks/batch={n}")
    return spark.readStream.schema(CHUNKS).option("maxFilesPerTrigger", 1).parquet(f"{path}/chunks/batch=*")


UNTIL = "t AS (SELECT *, min(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS stop FROM conversations)"


@query(f"WITH {UNTIL} SELECT CAST(conv_id AS VARCHAR) AS stream_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ord, CASE WHEN role = 'user' OR role = 'system' THEN text END AS content FROM t WHERE stop IS NULL OR turn <= stop")
def streamed_frames(spark, sf_dir):
    """Frames put together from chunks that come out of order over micro-batches, up to the end of each stream."""
    with scratch(spark) as path, stateful(spark):
        found = reassembled_stream(chunks(spark, sf_dir, path)).select("stream_id", "ord", "content")
        ended(found.writeStream.format("parquet").option("path", f"{path}/found").option("checkpointLocation", f"{path}/c"))
        return cut(spark.read.schema(found.schema).parquet(f"{path}/found"))


@query(f"""
WITH {UNTIL}, said AS (SELECT conv_id, stop, coalesce(string_agg(text, '' ORDER BY turn) FILTER (turn < stop), '') AS result FROM t WHERE stop IS NOT NULL GROUP BY conv_id, stop)
SELECT concat('L', conv_id) AS league, concat('H', conv_id) AS "homeTeam", result FROM said WHERE conv_id % 3 <> 0
""")
def streamed_analyses(spark, sf_dir):
    """Texts kept in a stream's state until it is done, then stored with what was asked; failed ones are not."""
    turns = read(spark, sf_dir, "conversations")
    some = lambda x: F.concat(F.lit(x), F.col("conv_id").cast("string"))
    asked = turns.select("conv_id").distinct().select(F.col("conv_id").cast("string").alias("id"), some("L").alias("league"), F.lit("D").alias("matchDate"), some("H").alias("homeTeam"), F.lit("A").alias("awayTeam"), F.lit("[]").alias("odds"))
    with scratch(spark) as path, stateful(spark):
        end = F.min(F.when(F.col("role") == "assistant", F.col("turn"))).over(Window.partitionBy("conv_id"))
        said = turns.withColumn("end", end).where("end IS NULL OR turn <= end")  # a stream brings nothing after its end
        rows = events(said).select("stream_id", "ord", "event.*")
        for n, some_turns in enumerate((F.col("ord") < 1, F.col("ord").between(1, 2), F.col("ord") > 2)):
            rows.where(some_turns).coalesce(1).write.mode("append").parquet(f"{path}/events/batch={n}")
        landed = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/events/batch=*")
        kept = History(spark, f"{path}/kept")
        ended(stored_streams(landed, asked, kept, f"{path}/c"))
        return cut(kept.table().select("league", "homeTeam", "result"))


def whole(text: Column) -> Column:
    return F.split(text, "\n\n")[0]


@query("SELECT CAST(conv_id AS VARCHAR) AS stream_id, turn AS ord, CASE WHEN role <> 'assistant' THEN text END AS content FROM conversations")
def sent_frames(spark, sf_dir):
    """Frames written by a stream's tasks and read back as clients see them."""
    spark.dataSource.register(FrameSink)
    rows = events(read(spark, sf_dir, "conversations")).select("stream_id", "ord", frame(F.col("event")).alias("value"))
    with scratch(spark) as path:
        rows.write.parquet(f"{path}/frames")
        landed = spark.readStream.schema(rows.schema).parquet(f"{path}/frames")
        to = path if "://" in path or path.startswith("/") else path.replace("file:", "file://")
        ended(landed.writeStream.format("frames").option("path", f"{to}/sent").option("checkpointLocation", f"{path}/c"))
        sent = spark.read.format("frames").load(f"{to}/sent")
        return cut(sent.select("stream_id", "ord", parsed(whole(F.col("value")))["content"].alias("content")))
