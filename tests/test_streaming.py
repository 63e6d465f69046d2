"""Streams over micro-batches: order, state, restarts, and what readers can see."""

import itertools
import json
import os
from pathlib import Path
from uuid import uuid4

import pytest
from pyspark.sql import functions as F

from parimutuel.sources.history import History
from parimutuel.streaming import frame_sink, frames, model_source

TEXT = 'data: {"type":"text","content":"ab"}\n\ndata: {"type":"text","content":"cd"}\n\ndata: bad\n\ndata: {"type":"done","id":"1"}\n\n'
CHUNK = "stream_id string, seq long, chunk string"
EVENT = "stream_id string, ord long, type string, content string, id string, message string"


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get(frames.ROCKSDB[0], None)
    spark.conf.set(*frames.ROCKSDB)
    yield
    spark.conf.set(frames.ROCKSDB[0], before) if before else spark.conf.unset(frames.ROCKSDB[0])


def land(spark, folder, rows, schema, n):
    """One file, taken as one micro-batch."""
    at = folder / f"{n:03d}.json"
    at.write_text("".join(json.dumps(dict(zip([c.split()[0] for c in schema.split(", ")], r))) + "\n" for r in rows))
    os.utime(at, (1_000_000_000 + n, 1_000_000_000 + n))  # files are taken by their age


def source(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def state_rows(query):
    return sum(o["numRowsTotal"] for o in query.lastProgress["stateOperators"])


def run(spark, df, name, checkpoint):
    query = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(checkpoint)).start()
    query.processAllAvailable()
    return query


def test_chunks_in_any_order_over_batches(spark, rocksdb, tmp_path):
    """Every order of four chunks, a file a chunk, each chunk twice in some: as the batch result, and no state is left."""
    cuts = [0, 30, 37, 38, len(TEXT)]
    chunks = [(i, TEXT[a:b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    orders = list(itertools.permutations(chunks))
    folder = tmp_path / "in"
    folder.mkdir()
    for step in range(4):
        rows = [(f"s{k}", *order[step]) for k, order in enumerate(orders)]
        rows += [(f"s{k}", *order[max(0, step - 1)]) for k, order in enumerate(orders) if k % 2 and step < 3]  # again
        land(spark, folder, rows, CHUNK, step)
    query = run(spark, frames.reassembled_stream(source(spark, folder, CHUNK)), "any_order", tmp_path / "c")
    try:
        assert state_rows(query) == 0
    finally:
        query.stop()
    want = sorted(map(tuple, frames.reassembled(spark.createDataFrame([("s", *c) for c in chunks], CHUNK)).drop("stream_id").collect()))
    got = {}
    for r in spark.table("any_order").collect():
        got.setdefault(r.stream_id, []).append(tuple(r)[1:])
    assert len(got) == len(orders) and all(sorted(v) == want for v in got.values())


def test_a_silent_stream_is_closed(spark, rocksdb, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    land(spark, folder, [("s", 0, TEXT[:40]), ("s", 2, TEXT[42:80])], CHUNK, 0)
    query = frames.reassembled_stream(source(spark, folder, CHUNK), silent_ms=1).writeStream.format("memory").queryName("silent").trigger(processingTime="200 milliseconds").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for _ in range(60):
            query.awaitTermination(0.5)
            if query.lastProgress and query.lastProgress["batchId"] > 1 and state_rows(query) == 0:
                break
        assert state_rows(query) == 0
    finally:
        query.stop()
    assert [r.content for r in spark.table("silent").orderBy("ord").collect()][0] == "ab"


ASKED = "id string, league string, matchDate string, homeTeam string, awayTeam string, odds string"


def test_text_is_folded_in_state_and_stored_once_done(spark, rocksdb, tmp_path):
    """Three streams over five batches with a restart between: done, failed and silent ones; the same rows as the batch fold."""
    events = [
        ("a", 0, "text", "x", None, None), ("b", 0, "text", "p", None, None), ("c", 0, "text", "never", None, None),
        ("a", 1, "text", "y", None, None), ("b", 1, "error", None, None, "broke"),
        ("a", 2, "text", None, None, None), ("a", 3, "text", "z", None, None),
        ("a", 4, "done", None, "m", None),
    ]
    folder = tmp_path / "in"
    folder.mkdir()
    asked = spark.createDataFrame([(s, "L", "D", "H", "A", "[]") for s in "abc"], ASKED)
    history, told, seen = History(spark, str(tmp_path / "kept")), [], []
    tell = lambda last: told.extend((r.stream_id, json.loads(r.value[6:]), history.table().count()) for r in last.collect())

    def go(n):
        query = frames.stored_streams(source(spark, folder, EVENT), asked, history, str(tmp_path / "c"), tell).start()
        try:
            query.processAllAvailable()
            seen.append(state_rows(query))
        finally:
            query.stop()

    for n, rows in enumerate((events[:3], events[3:5], events[5:7])):
        land(spark, folder, rows, EVENT, n)
    go(1)
    assert history.table().count() == 0 and seen[0] == 2
    land(spark, folder, events[7:], EVENT, 3)
    go(2)
    stored = history.table().collect()
    batch = {r.stream_id: r for r in frames.folded(spark.createDataFrame(events, EVENT)).collect()}
    assert [(r.result, r.league) for r in stored] == [(batch["a"].content, "L")] == [("xyz", "L")]
    assert told == [("b", {"type": "error", "message": "broke"}, 0), ("a", {"type": "done", "id": stored[0].id}, 1)]
    assert seen[1] == 1  # of the stream that never ended


def test_a_stream_that_never_ends_is_given_up(spark, rocksdb, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    land(spark, folder, [("c", 0, "text", "never", None, None)], EVENT, 0)
    asked = spark.createDataFrame([("c", "L", "D", "H", "A", "[]")], ASKED)
    history = History(spark, str(tmp_path / "kept"))
    query = frames.stored_streams(source(spark, folder, EVENT), asked, history, str(tmp_path / "c"), silent_ms=1).trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(60):
            query.awaitTermination(0.5)
            if query.lastProgress and query.lastProgress["batchId"] > 1 and state_rows(query) == 0:
                break
        assert state_rows(query) == 0 and history.table().count() == 0
    finally:
        query.stop()


def test_what_comes_after_the_end_is_dropped(spark, rocksdb, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    query = frames.folded_stream(source(spark, folder, EVENT), remember_ms=600_000).writeStream.format("memory").queryName("after_end").trigger(processingTime="200 milliseconds").option("checkpointLocation", str(tmp_path / "c")).start()

    def taken(n):
        for _ in range(60):
            query.awaitTermination(0.5)
            if sum(p["numInputRows"] for p in query.recentProgress) >= n:
                return

    try:
        land(spark, folder, [("a", 0, "text", "x", None, None), ("a", 1, "done", None, "1", None)], EVENT, 0)
        taken(2)
        land(spark, folder, [("a", 2, "text", "late", None, None), ("a", 3, "done", None, "2", None)], EVENT, 1)
        taken(4)
    finally:
        query.stop()
    assert [(r.content, r.id) for r in spark.table("after_end").collect()] == [("x", "1")]


# --- the model as a source


def prompts(options):
    return [tuple(p) for p in json.loads(Path(options["desk"], "prompts.json").read_text())]


def moody(prompt, options):
    """Never says the same twice; leaves a mark for each call."""
    Path(options["desk"], "calls", uuid4().hex).touch()
    yield "message_start", None, None
    for word in prompt.split():
        yield "content_block_delta", "text_delta", f"{word}-{uuid4().hex[:6]}"


@pytest.fixture
def desk(spark, tmp_path):
    """Where prompts are landed and calls are counted, and the options that name it."""
    (tmp_path / "calls").mkdir()
    spark.dataSource.register(model_source.ModelSource)
    spark.dataSource.register(frame_sink.FrameSink)
    return tmp_path, {"prompts": f"{__name__}:prompts", "model": f"{__name__}:moody", "answers": f"file://{tmp_path}/answers", "desk": str(tmp_path)}


def test_a_model_stream_is_stopped_and_started_again(spark, desk):
    folder, options = desk
    read = lambda: spark.readStream.format("model").options(**options, block=2).load()

    def go():
        query = read().writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "c")).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return sorted(map(tuple, spark.read.parquet(str(folder / "out")).collect()), key=str)

    (folder / "prompts.json").write_text(json.dumps([["a", "one two"], ["b", "three"], ["c", ""]]))
    first = go()
    assert [(r[0], r[1]) for r in first] == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1), ("c", 0)]
    (folder / "prompts.json").write_text(json.dumps([["a", "one two"], ["b", "three"], ["c", ""], ["d", "four"]]))
    second = go()
    assert [r for r in second if r[0] != "d"] == first and [r[1] for r in second if r[0] == "d"] == [0, 1]
    assert len(list((folder / "calls").iterdir())) == 4


def test_an_answer_is_the_same_when_a_task_runs_again(spark, desk):
    folder, options = desk
    (folder / "prompts.json").write_text(json.dumps([["a", "one two"]]))
    reader = model_source.ModelReader(options)
    (part,) = reader.partitions(reader.initialOffset(), reader.latestOffset())
    once, again = list(reader.read(part)), list(reader.read(part))
    assert once == again and len(list((folder / "calls").iterdir())) == 1
    reader.commit({"prompt": 1})
    assert not list((folder / "answers").iterdir())
    with pytest.raises(ValueError, match="answers"):
        model_source.ModelSource({"prompts": "p", "model": "m"}).streamReader(None)


# --- frames that clients read


def test_frames_are_seen_batch_by_batch(spark, desk):
    folder, _ = desk
    landed = folder / "in"
    landed.mkdir()
    rows = lambda n: [(s, 2 * n + i, f"{s}{n}{i}\n\n") for s in "ab" for i in range(2)]
    sent = "stream_id string, ord long, value string"

    def go():
        query = source(spark, landed, sent).writeStream.format("frames").option("path", f"file://{folder}/sent").option("checkpointLocation", str(folder / "c")).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    read = lambda: sorted(map(tuple, spark.read.format("frames").load(f"file://{folder}/sent").collect()))
    assert read() == []
    land(spark, landed, rows(0), sent, 0)
    go()
    land(spark, landed, rows(1), sent, 1)
    go()
    want = sorted((s, n, o, v) for n in range(2) for s, o, v in rows(n))
    assert read() == want and not list((folder / "sent" / "staged").iterdir())
    # The last batch runs again, as after a failure between its commit and Spark's.
    for f in ((folder / "c" / "commits" / "1"), (folder / "c" / "commits" / ".1.crc")):
        f.unlink(missing_ok=True)
    go()
    assert read() == want and not list((folder / "sent" / "staged").iterdir())


def test_a_task_that_dies_leaves_no_frame(tmp_path):
    from pyspark.sql import Row

    writer = frame_sink.FrameWriter(f"file://{tmp_path}/sent")

    def dies():
        yield Row(stream_id="a", ord=0, value="half")
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        writer.write(dies())
    done = writer.write(iter([Row(stream_id="a", ord=0, value="data: é\n\n")]))
    given_up = writer.write(iter([Row(stream_id="a", ord=0, value="again")]))
    reader = frame_sink.FrameReader(f"file://{tmp_path}/sent")
    assert reader.partitions() == []
    writer.abort([given_up, None], 0)
    writer.commit([done, None, writer.write(iter([]))], 0)
    (part,) = reader.partitions()
    assert list(reader.read(part)) == [("a", 0, 0, "data: é\n\n")]
    assert not list((tmp_path / "sent" / "staged").iterdir())
