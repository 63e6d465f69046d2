"""A model's answers as a stream that can be stopped and started again.

``spark.readStream.format("model")`` with the options ``prompts`` and ``model``, both
``module:function``: ``prompts(options)`` gives a sequence of (stream_id, prompt) to which
more are only added at the end, ``model(prompt, options)`` yields (type, delta_type,
text). Offsets count prompts; each task asks for a block of them.

A model seldom says the same twice. An answer is therefore written whole to the shared
folder ``answers`` before it is handed on, and a task that runs again, or a query
that is started again, reads it there; what a batch has committed is deleted.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator, Sequence
from uuid import uuid4

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from .frames import SAID

#: Prompts that a task asks for.
BLOCK = 16


def named(path: str) -> Callable:
    """The function that ``module:function`` names."""
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


class Prompts(InputPartition):
    def __init__(self, start: int, end: int):
        super().__init__((start, end))
        self.start, self.end = start, end


class ModelReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.block = int(options.get("block", BLOCK))

    def prompts(self) -> Sequence[tuple[str, str]]:
        return named(self.options["prompts"])(self.options)

    def initialOffset(self) -> dict:
        return {"prompt": 0}

    def latestOffset(self) -> dict:
        return {"prompt": len(self.prompts())}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        a, b = start["prompt"], end["prompt"]
        return [Prompts(i, min(b, i + self.block)) for i in range(a, b, self.block)]

    def folder(self) -> tuple[fs.FileSystem, str]:
        store, path = fs.FileSystem.from_uri(self.options["answers"])
        store.create_dir(path, recursive=True)
        return store, path

    def answer(self, store: fs.FileSystem, path: str, n: int, prompt: str) -> list:
        """The answer written down for prompt ``n``; asked for where there is none."""
        at = f"{path}/{n:012d}.json"
        if store.get_file_info(at).type == fs.FileType.NotFound:
            said = [*named(self.options["model"])(prompt, self.options)]
            half = f"{path}/half-{uuid4().hex}"
            with store.open_output_stream(half) as out:
                out.write(json.dumps(said, ensure_ascii=False).encode())
            store.move(half, at)
        with store.open_input_stream(at) as given:
            return json.loads(given.read())

    def read(self, partition: Prompts) -> Iterator[tuple]:
        store, path = self.folder()
        asked = self.prompts()
        for n in range(partition.start, partition.end):
            stream_id, prompt = asked[n]
            for seq, chunk in enumerate(self.answer(store, path, n, prompt)):
                yield stream_id, seq, *chunk

    def commit(self, end: dict) -> None:
        store, path = self.folder()
        for file in store.get_file_info(fs.FileSelector(path)):
            if file.base_name.removesuffix(".json").isdigit() and int(file.base_name.removesuffix(".json")) < end["prompt"]:
                store.delete_file(file.path)


class ModelSource(DataSource):
    """Rows are chunks as ``text_events`` takes them: (stream_id, seq, type, delta_type, text)."""

    @classmethod
    def name(cls) -> str:
        return "model"

    def schema(self) -> str:
        return SAID

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        options = {k.lower(): v for k, v in self.options.items()}
        for needed in ("prompts", "model", "answers"):
            if not options.get(needed):
                raise ValueError(f"a model stream needs the option {needed}")
        return ModelReader(options)
