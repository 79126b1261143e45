"""A queue of messages in a shared folder, as a streaming source and sink.

A batch of a producer becomes visible whole, by one manifest that names its files; a batch that is committed again is the same
manifest and is passed over, and one that is aborted leaves nothing. A consumer's offset is the last manifest it
was given, so each message is delivered until the consumer's batch is done, and no later. Manifests are ordered by the producer's
generation (when it first started, see ``streaming.stages``) and its batch numbers; one producer writes a queue at a time.

    spark.dataSource.register(MessageQueue)
    jobs.writeStream.format("message_queue").option("path", folder).option("generation", "1") ...
    spark.readStream.format("message_queue").option("path", folder).load()

Messages are strings (``body``). Defined cases: a null message is an empty one; a queue that is not there yet is empty.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row


def _place(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _write(path: str, name: str, data: bytes) -> None:
    """Under a name of its own first, so that nobody reads half of it."""
    system, folder = _place(path)
    system.create_dir(folder, recursive=True)
    waiting = f"{folder}/_{uuid.uuid4().hex}"
    with system.open_output_stream(waiting) as out:
        out.write(data)
    system.move(waiting, f"{folder}/{name}")


def _manifests(path: str) -> list[str]:
    system, folder = _place(f"{path}/manifests")
    found = system.get_file_info(pyarrow.fs.FileSelector(folder, allow_not_found=True))
    return sorted(f.base_name for f in found if f.is_file and not f.base_name.startswith("_"))


def _files(path: str, manifest: str) -> list[str]:
    system, folder = _place(f"{path}/manifests")
    with system.open_input_stream(f"{folder}/{manifest}") as given:
        return json.loads(given.read())


@dataclass
class Written(WriterCommitMessage):
    name: str
    messages: int


class QueueFile(InputPartition):
    def __init__(self, name: str):
        super().__init__(name)


class QueueWriter(DataSourceStreamWriter):
    def __init__(self, path: str, generation: int):
        self.path, self.generation = path, generation

    def write(self, iterator: Iterator[Row]) -> Written:
        bodies = [r["body"] or "" for r in iterator]
        name = f"{uuid.uuid4().hex}.jsonl"
        if bodies:
            _write(f"{self.path}/messages", name, "".join(json.dumps(b) + "\n" for b in bodies).encode())
        return Written(name, len(bodies))

    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        written = [m.name for m in messages if m is not None and m.messages]
        if self._name(batchId) in _manifests(self.path):
            self._drop(set(written) - set(self._listed(batchId)))
        else:
            _write(f"{self.path}/manifests", self._name(batchId), json.dumps(written).encode())

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        """Also called where a commit went through but was not heard of: what its manifest names stays."""
        self._drop({m.name for m in messages if m is not None and m.messages} - set(self._listed(batchId)))

    def _name(self, batch: int) -> str:
        return f"{self.generation:015d}-{batch:012d}.json"

    def _listed(self, batch: int) -> list[str]:
        return _files(self.path, self._name(batch)) if self._name(batch) in _manifests(self.path) else []

    def _drop(self, names: set[str]) -> None:
        system, folder = _place(f"{self.path}/messages")
        for name in names:
            if system.get_file_info(f"{folder}/{name}").is_file:
                system.delete_file(f"{folder}/{name}")


class QueueReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:  # noqa: N802
        return {"after": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"after": max(_manifests(self.path), default="")}

    def partitions(self, start: dict, end: dict) -> list[QueueFile]:
        return [QueueFile(x) for name in _manifests(self.path) if start["after"] < name <= end["after"] for x in _files(self.path, name)]

    def read(self, partition: QueueFile) -> Iterator[tuple[str]]:
        system, folder = _place(f"{self.path}/messages")
        with system.open_input_stream(f"{folder}/{partition.value}") as given:
            rest = b""
            while block := given.read(1 << 20):
                *lines, rest = (rest + block).split(b"\n")
                for line in lines:
                    yield (json.loads(line),)


class MessageQueue(DataSource):
    @classmethod
    def name(cls) -> str:
        return "message_queue"

    def schema(self) -> str:
        return "body string"

    def streamReader(self, schema) -> QueueReader:  # noqa: N802
        return QueueReader(self.options["path"])

    def streamWriter(self, schema, overwrite: bool) -> QueueWriter:  # noqa: N802
        return QueueWriter(self.options["path"], int(self.options.get("generation", "0")))
