"""Detection requests as a stream: a spool of JSON lines that producers append to, and a store of answers.

    register(spark)
    spark.readStream.format("call_requests").load("spool/")  # option ending: other files than .jsonl
    answers.write.format("call_answers").option("batch", 7).mode("append").save("answers/")
    answers.writeStream.format("call_answers").option("checkpointLocation", ...).start("answers/")

An offset is how many bytes of each spool file are taken, up to the end of a line, so a batch that is run again reads the same
requests. A line that is no JSON is a request without sound. Answers are written beside the store and moved in
under their batch's number; a batch that is written again takes the place of what it wrote before, so each request is answered once,
whenever a run is stopped. A batch of an earlier attempt that was never committed is no part of the store.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from colloquy.schemas import REQUESTS
from colloquy.sources import places

ENDING = ".jsonl"
#: What a batch's committed answers are called; and how much of a file's end is looked at for the end of a line at a time.
DONE, TAIL = "batch-{:010d}.done", 1 << 16


def whole_lines(uri: str, path: str, size: int, least: int) -> int:
    """Bytes of a file, of size now, up to the end of its last whole line; least if there is no later one."""
    end = size
    while end > least:
        start = max(least, end - TAIL)
        if (at := places.read(uri, path, start, end).rfind(b"\n")) >= 0:
            return start + at + 1
        end = start
    return least


@dataclass
class Part(InputPartition):
    """A run of whole lines of one file."""

    path: str
    start: int
    end: int


def fields(line: bytes, names: list[tuple[str, str]]) -> tuple:
    """A line's values for the columns; what is missing or of another kind is null."""
    try:
        found = json.loads(line)
    except ValueError:
        found = None
    found = found if isinstance(found, dict) else {}
    kinds = {"string": str, "integer": int, "long": int, "double": (int, float), "boolean": bool}
    out = []
    for name, kind in names:
        value = found.get(name)
        fine = isinstance(value, kinds.get(kind, object)) and (kind == "boolean" or not isinstance(value, bool))
        out.append(float(value) if fine and kind == "double" else value if fine else None)
    return tuple(out)


def lines_of(uri: str, part: Part, names: list[tuple[str, str]]) -> Iterator[tuple]:
    for line in places.read(uri, part.path, part.start, part.end).splitlines():
        if line.strip():
            yield fields(line, names)


def parts_of(uri: str, start: dict, end: dict, most: int) -> list[Part]:
    """What lies between two offsets, in runs of whole lines of about most bytes."""
    out = []
    for path in sorted(end):
        at = start.get(path, 0)
        while at < end[path]:
            # a run ends with a line, whatever its length
            to, step = end[path], most
            while at + step < end[path] and (to := whole_lines(uri, path, at + step, at)) == at:
                step *= 2
            to = to if at + step < end[path] and to > at else end[path]
            out.append(Part(path, at, to))
            at = to
    return out


class Requests:
    """What the reader of a table and that of a stream share."""

    def __init__(self, schema: StructType, options: dict):
        self.uri, self.most, self.ending = options["path"], int(options.get("partitionBytes", 16 << 20)), options.get("ending", ENDING)
        self.names = [(f.name, f.dataType.typeName()) for f in schema]

    def now(self, before: dict) -> dict:
        return before | {path: whole_lines(self.uri, path, size, before.get(path, 0)) for path, size in places.listed(self.uri, self.ending) if size > before.get(path, 0)}

    def lines(self, partition: Part) -> Iterator[tuple]:
        return lines_of(self.uri, partition, self.names) if partition.path else iter(())


class RequestReader(Requests, DataSourceReader):
    def partitions(self) -> list[Part]:
        return parts_of(self.uri, {}, self.now({}), self.most) or [Part("", 0, 0)]

    def read(self, partition: Part) -> Iterator[tuple]:
        return self.lines(partition)


class RequestStream(Requests, DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict):
        super().__init__(schema, options)
        self.seen: dict = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        self.seen = self.now(self.seen)
        return self.seen

    def partitions(self, start: dict, end: dict) -> list[Part]:
        self.seen = self.seen | {p: max(n, self.seen.get(p, 0)) for p, n in end.items()}
        return parts_of(self.uri, start, end, self.most)

    def read(self, partition: Part) -> Iterator[tuple]:
        return self.lines(partition)

    def commit(self, end: dict) -> None:
        """Spool files stay; who owns them clears what the checkpoint has passed."""


class CallRequests(DataSource):
    """Requests of a spool folder, as a table or as a stream."""

    @classmethod
    def name(cls) -> str:
        return "call_requests"

    def schema(self) -> str:
        return REQUESTS

    def reader(self, schema: StructType) -> RequestReader:
        return RequestReader(schema, self.options)

    def streamReader(self, schema: StructType) -> RequestStream:
        return RequestStream(schema, self.options)


@dataclass
class Answered(WriterCommitMessage):
    path: str


def plain(value):
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    return float(value) if isinstance(value, Decimal) else value.hex() if isinstance(value, (bytes, bytearray)) else str(value)


class Answers:
    """One file a task, moved in under the number of its batch."""

    def __init__(self, schema: StructType, options: dict):
        self.uri, self.names = options["path"], schema.fieldNames()
        self.folder = places.place(self.uri)[1]
        self.staged = f"{self.folder}/_staged-{uuid.uuid4().hex}"

    def written(self, rows: Iterator) -> Answered:
        found = [json.dumps({n: row[n] for n in self.names}, default=plain).encode() for row in rows]
        path = f"{self.staged}/{uuid.uuid4().hex}"
        if found:
            places.write(self.uri, path, b"\n".join(found) + b"\n")
        return Answered(path if found else "")

    def settle(self, messages: list, batch: int) -> None:
        """All of a batch's answers, instead of what an earlier attempt left."""
        done = f"{self.folder}/{DONE.format(batch)}"
        places.drop(self.uri, done)
        places.drop(self.uri, f"{self.folder}/batch={batch}")
        store = places.place(self.uri)[0]
        store.create_dir(f"{self.folder}/batch={batch}", recursive=True)
        for n, message in enumerate(m for m in messages if m and m.path):
            store.move(message.path, f"{self.folder}/batch={batch}/part-{n:05d}{ENDING}")
        places.write(self.uri, done, b"")
        self.clear()

    def clear(self) -> None:
        places.drop(self.uri, self.staged)


class AnswerWriter(Answers, DataSourceWriter):
    """option batch: the number of the micro-batch that these are all the answers of."""

    def __init__(self, schema: StructType, options: dict):
        super().__init__(schema, options)
        self.batch = int(options["batch"])

    def write(self, iterator: Iterator) -> Answered:
        return self.written(iterator)

    def commit(self, messages: list) -> None:
        self.settle(messages, self.batch)

    def abort(self, messages: list) -> None:
        self.clear()


class AnswerStream(Answers, DataSourceStreamWriter):
    def write(self, iterator: Iterator) -> Answered:
        return self.written(iterator)

    def commit(self, messages: list, batchId: int) -> None:
        self.settle(messages, batchId)

    def abort(self, messages: list, batchId: int) -> None:
        self.clear()


class AnswerReader(DataSourceReader):
    """Answers of committed batches."""

    def __init__(self, schema: StructType, options: dict):
        self.uri, self.names = options["path"], [(f.name, f.dataType.typeName()) for f in schema]

    def partitions(self) -> list[Part]:
        done = {path.rsplit("-", 1)[-1].removesuffix(".done") for path, _ in places.listed(self.uri, ".done")}
        found = [(p, n) for p, n in places.listed(self.uri, ENDING, deep=True) if p.rsplit("/", 2)[-2].removeprefix("batch=").zfill(10) in done and "/_staged-" not in p]
        return [Part(path, 0, size) for path, size in found] or [Part("", 0, 0)]

    def read(self, partition: Part) -> Iterator[tuple]:
        return lines_of(self.uri, partition, self.names) if partition.path else iter(())


class CallAnswers(DataSource):
    """A store of answers: written batch by batch or as a stream's sink, read as a table."""

    @classmethod
    def name(cls) -> str:
        return "call_answers"

    def schema(self) -> str:
        return "call_id string, is_synthetic boolean, confidence double, error string"

    def reader(self, schema: StructType) -> AnswerReader:
        return AnswerReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> AnswerWriter:
        return AnswerWriter(schema, self.options)

    def streamWriter(self, schema: StructType, overwrite: bool) -> AnswerStream:
        return AnswerStream(schema, self.options)


def register(spark: SparkSession) -> None:
    for source in (CallRequests, CallAnswers):
        spark.dataSource.register(source)
