"""Voice-activity detectors by name, in plans and as table functions of SQL.

    register("loud", lambda sound, rate, least: [(0, 0.0, len(sound) / rate)])
    voice_activity(audio, "loud")
    as_function(spark, "loud")
    spark.sql("SELECT * FROM detect_loud(TABLE(audio), 0.2)")

A detector takes one channel's samples (floats in -1 to 1), the rate and the least length in seconds, and gives (seq, start, end).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from colloquy.schemas import SEGMENTS
from colloquy.sources.audio import signal
from colloquy.sources.wav import decode

Detector = Callable[[np.ndarray, int, float], list[tuple[int, float, float]]]
DETECTORS: dict[str, Detector] = {}
LEAST_S = 0.12


def register(name: str, detector: Detector) -> None:
    DETECTORS[name] = detector


def detector(name: str) -> Detector:
    if name not in DETECTORS:
        raise ValueError(f"unknown backend: {name}; there are {', '.join(sorted(DETECTORS))}")
    return DETECTORS[name]


def as_function(spark: SparkSession, name: str) -> str:
    """Registers detect_<name>(TABLE(rows), least), and says that name.

    rows are decoded audio (call_id, pcm0, pcm1, sample_rate), or WAV files (call_id, content); which of the two is seen from its columns. Rows
    are taken one by one where they are; those that can't be read have no segments.
    """
    find, segments = detector(name), StructType.fromDDL(SEGMENTS)

    class Detect:
        @staticmethod
        def analyze(rows: AnalyzeArgument, least: AnalyzeArgument | None = None) -> AnalyzeResult:
            if not rows.isTable:
                raise ValueError("the first argument is a table")
            columns = set(rows.dataType.fieldNames())
            if "call_id" not in columns or not (columns >= {"pcm0", "pcm1", "sample_rate"} or "content" in columns):
                raise ValueError("the table needs call_id and either pcm0, pcm1 and sample_rate, or content")
            return AnalyzeResult(schema=segments)

        def eval(self, row, least: float = LEAST_S) -> Iterator[tuple]:
            found = row.asDict()
            if "pcm0" in found:
                sides, rate = (found["pcm0"], found["pcm1"]), found["sample_rate"]
            else:
                *sides, _, _, rate, _ = decode(found["content"])
            for channel, pcm in enumerate(sides):
                if pcm is not None:
                    for seq, start, end in find(signal(pcm), rate, float(least)):
                        yield found["call_id"], int(seq), channel, float(start), float(end)

    spark.udtf.register(f"detect_{name}", udtf(Detect))
    return f"detect_{name}"
