"""WAV files: a chunk parser, and a Spark data source over folders of ``<call_id>.wav``.

    register(spark)
    spark.read.format("wav_calls").load("calls/").where("call_id = 'c1'")
    audio.write.format("wav_calls").mode("append").save("copies/")

A filter on call_id reaches the source: files that it leaves out are not opened. Files are dealt to partitions by their bytes.
The source reads stores that Arrow knows; for a path that only Spark can open there is sources.audio.wav_files.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from colloquy.schemas import AUDIO
from colloquy.sources import places

RATES = (8000, 16000)
#: Format tags: whole numbers, floats, and those that name one of these in their extension.
WHOLE, FLOAT, EXTENDED = 1, 3, 0xFFFE
NOTHING = (None, None, 0, 0, None)


def chunks(data: bytes) -> Iterator[tuple[bytes, memoryview]]:
    """(name, body) of a RIFF file's chunks; a body that the file cuts short is as long as it is there."""
    at, view = 12, memoryview(data)
    while at + 8 <= len(data):
        size = struct.unpack_from("<I", data, at + 4)[0]
        yield data[at : at + 4], view[at + 8 : at + 8 + size]
        at += 8 + size + size % 2


def parse(data: bytes) -> tuple[int, int, int, int, memoryview] | None:
    """(format tag, channels, rate, bytes a sample, samples) of a WAV file; None if it is none."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    form = None
    for name, body in chunks(data):
        if name == b"fmt " and len(body) >= 16:
            tag, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", body)
            if tag == EXTENDED and len(body) >= 26:
                tag = struct.unpack_from("<H", body, 24)[0]
            form = (tag, channels, rate, -(-bits // 8))
        elif name == b"data" and form:
            return (*form, body)
    return None


def samples16(tag: int, channels: int, width: int, raw: memoryview) -> np.ndarray | None:
    """Samples as 16-bit rows, a column for each channel; None for a format that is not read. More bits are cut off, floats are -1 to 1."""
    size = width * channels
    raw = raw[: len(raw) // size * size] if size else raw[:0]
    if tag == FLOAT and width in (4, 8):
        values = np.nan_to_num(np.frombuffer(raw, f"<f{width}").astype(np.float64), nan=0.0)
        values = np.clip(np.rint(np.clip(values, -1.0, 1.0) * 32768.0), -32768, 32767).astype("<i2")
    elif tag == WHOLE and width == 1:
        values = (np.frombuffer(raw, np.uint8).astype(np.int16) - 128) << 8
    elif tag == WHOLE and width in (2, 3, 4):
        # the upper two bytes of each sample
        values = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(-1, width)[:, width - 2 :]).view("<i2")[:, 0]
    else:
        return None
    return values.reshape(-1, channels)


def decode(data: bytes | None) -> tuple:
    """(caller PCM, agent PCM, samples, samples, rate, error): 16-bit little-endian, channels over two ignored.

    Errors, in the order in which they are looked for: base64, wav, stereo, rate.
    """
    if data is None:
        return *NOTHING, "base64"
    found = parse(bytes(data))
    if found is None or not found[1] or found[3] not in (1, 2, 3, 4, 8) or found[0] not in (WHOLE, FLOAT):
        return *NOTHING, "wav"
    tag, channels, rate, width, raw = found
    if channels < 2:
        return *NOTHING, "stereo"
    if rate not in RATES:
        return *NOTHING, "rate"
    rows = samples16(tag, channels, width, raw)
    if rows is None:
        return *NOTHING, "wav"
    sides = [np.ascontiguousarray(rows[:, c]).astype("<i2").tobytes() for c in (0, 1)]
    return *sides, len(rows), len(rows), rate, None


def encode(pcm0: bytes, pcm1: bytes, rate: int) -> bytes:
    """A WAV file of two 16-bit channels; the shorter one is filled up with silence."""
    sides = [np.frombuffer(p, "<i2") for p in (pcm0, pcm1)]
    rows = np.zeros((max(map(len, sides)), 2), "<i2")
    for c, side in enumerate(sides):
        rows[: len(side), c] = side
    body = rows.tobytes()
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, WHOLE, 2, rate, rate * 4, 4, 16, b"data", len(body))
    return head + body


def call_of(path: str) -> str:
    return path.rsplit("/", 1)[-1].removesuffix(".wav")


@dataclass
class Files(InputPartition):
    paths: list[str]


class WavReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri, self.most = options["path"], int(options.get("partitionBytes", 64 << 20))
        self.tests: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes what says which call_ids are wanted; hands back the rest."""
        for f in filters:
            if getattr(f, "attribute", None) != ("call_id",):
                yield f
            elif isinstance(f, EqualTo):
                self.tests.append(("is", (f.value,)))
            elif isinstance(f, In):
                self.tests.append(("is", tuple(f.value)))
            elif isinstance(f, StringStartsWith):
                self.tests.append(("starts", f.value))
            else:
                yield f

    def wanted(self, call_id: str) -> bool:
        return all(call_id in value if kind == "is" else call_id.startswith(value) for kind, value in self.tests)

    def partitions(self) -> list[Files]:
        found = [(path, size) for path, size in places.listed(self.uri, ".wav") if self.wanted(call_of(path))]
        return [Files([p for p, _ in found[a:b]]) for a, b in places.deal([s for _, s in found], self.most)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.string())
        for path in partition.paths:
            row = (call_of(path), *decode(places.read(self.uri, path)))
            yield pa.record_batch([pa.array([v], type=k) for v, k in zip(row, kinds)], names=["call_id", "pcm0", "pcm1", "n0", "n1", "sample_rate", "error"])


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WavWriter(DataSourceWriter):
    """Files are written beside the folder's own and moved in when all tasks are done."""

    def __init__(self, options: dict, overwrite: bool):
        self.uri, self.overwrite = options["path"], overwrite
        self.staged = f"{places.place(self.uri)[1]}/_staged-{uuid.uuid4().hex}"

    def write(self, iterator) -> Written:
        files = []
        for row in iterator:
            if row["pcm0"] is not None and row["pcm1"] is not None:
                path = f"{self.staged}/{uuid.uuid4().hex}/{row['call_id']}.wav"  # a retried task writes elsewhere
                places.write(self.uri, path, encode(bytes(row["pcm0"]), bytes(row["pcm1"]), row["sample_rate"]))
                files.append(path)
        return Written(files)

    def commit(self, messages: list) -> None:
        store, folder = places.place(self.uri)
        if self.overwrite:
            for path, _ in places.listed(self.uri, ".wav"):
                store.delete_file(path)
        for message in messages:
            for path in message.files if message else ():
                store.move(path, f"{folder}/{path.rsplit('/', 1)[-1]}")
        places.drop(self.uri, self.staged)

    def abort(self, messages: list) -> None:
        places.drop(self.uri, self.staged)


class WavCalls(DataSource):
    """AUDIO rows of a folder of WAV files; files that can't be read are rows with an error."""

    @classmethod
    def name(cls) -> str:
        return "wav_calls"

    def schema(self) -> str:
        return AUDIO

    def reader(self, schema: StructType) -> WavReader:
        return WavReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WavWriter:
        return WavWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WavCalls)
