"""Frames written by tasks, visible batch by batch: the sink that clients read from.

``writeStream.format("frames").option("path", …)`` takes (stream_id, ord, value). A task
writes its rows to a file of its own under ``staged``; when all have ended, the files
move to ``parts`` and a list of them, put in place at once, makes the batch visible. A
task that dies leaves nothing that anybody reads; a batch that is written again, having
been listed before, changes nothing. One query writes to a path.

``read.format("frames")`` gives (stream_id, batch, ord, value) of the listed files.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from uuid import uuid4

from pyarrow import fs
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SENT = "stream_id string, batch long, ord long, value string"


class Written(WriterCommitMessage):
    """A task's file, none where it had no rows."""

    def __init__(self, file: str | None):
        self.file = file


class Folder:
    def __init__(self, uri: str):
        self.store, self.path = fs.FileSystem.from_uri(uri)

    def made(self) -> Folder:
        for name in ("staged", "parts", "batches"):
            self.store.create_dir(f"{self.path}/{name}", recursive=True)
        return self

    def there(self, path: str) -> bool:
        return self.store.get_file_info(f"{self.path}/{path}").type != fs.FileType.NotFound

    def names(self, folder: str) -> list[str]:
        found = self.store.get_file_info(fs.FileSelector(f"{self.path}/{folder}", allow_not_found=True))
        return sorted(f.base_name for f in found)

    def delete(self, path: str) -> None:
        if self.there(path):
            self.store.delete_file(f"{self.path}/{path}")

    def put(self, path: str, text: str) -> None:
        """Write a small file that is there as a whole or not at all."""
        half = f"{self.path}/staged/half-{uuid4().hex}"
        with self.store.open_output_stream(half) as out:
            out.write(text.encode())
        self.store.move(half, f"{self.path}/{path}")

    def listed(self, name: str) -> list[str]:
        """Files of a batch."""
        with self.store.open_input_stream(f"{self.path}/batches/{name}") as given:
            return json.loads(given.read())

    def lines(self, path: str) -> Iterator[list]:
        with self.store.open_input_stream(f"{self.path}/{path}") as given:
            rest = b""
            while block := given.read(1 << 20):
                *whole, rest = (rest + block).split(b"\n")
                yield from map(json.loads, whole)


class FrameWriter(DataSourceStreamWriter):
    def __init__(self, uri: str):
        self.uri = uri

    def write(self, iterator: Iterator[Row]) -> Written:
        folder, name, out = Folder(self.uri).made(), f"{uuid4().hex}.jsonl", None
        try:
            for row in iterator:
                if out is None:
                    out = folder.store.open_output_stream(f"{folder.path}/staged/{name}")
                out.write(json.dumps([row["stream_id"], row["ord"], row["value"]], ensure_ascii=False).encode() + b"\n")
        except BaseException:
            if out is not None:
                out.close()
                folder.delete(f"staged/{name}")
            raise
        if out is None:
            return Written(None)
        out.close()
        return Written(name)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        folder = Folder(self.uri).made()
        files = [m.file for m in messages if m and m.file]
        listed = f"batches/{batchId:020d}.json"
        if not folder.there(listed):
            for file in files:
                folder.store.move(f"{folder.path}/staged/{file}", f"{folder.path}/parts/{file}")
            folder.put(listed, json.dumps(files))
        # What is left was written by tasks that failed, or for a batch that is listed already.
        for name in folder.names("staged"):
            folder.delete(f"staged/{name}")

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        folder = Folder(self.uri)
        for m in messages:
            if m and m.file:
                folder.delete(f"staged/{m.file}")


class Part(InputPartition):
    def __init__(self, batch: int, file: str):
        super().__init__((batch, file))
        self.batch, self.file = batch, file


class FrameReader(DataSourceReader):
    def __init__(self, uri: str):
        self.uri = uri

    def partitions(self) -> Sequence[InputPartition]:
        folder = Folder(self.uri)
        return [Part(int(name.partition(".")[0]), file) for name in folder.names("batches") for file in folder.listed(name)]

    def read(self, partition: Part | None) -> Iterator[tuple]:
        if partition is not None:  # Spark asks for one partition where there are none
            for stream_id, place, value in Folder(self.uri).lines(f"parts/{partition.file}"):
                yield stream_id, partition.batch, place, value


class FrameSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return SENT

    def uri(self) -> str:
        options = {k.lower(): v for k, v in self.options.items()}
        if not options.get("path"):
            raise ValueError("frames need the option path")
        return options["path"]

    def reader(self, schema: StructType) -> DataSourceReader:
        return FrameReader(self.uri())

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        return FrameWriter(self.uri())
