"""Stereo call audio: WAV files and base64 requests to PCM columns, with errors as data."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.schemas import AUDIO
from colloquy.session import small_batches
from colloquy.sources.wav import RATES, decode  # noqa: F401  what may be asked here too


def signal(pcm: bytes) -> np.ndarray:
    """PCM as 32-bit floats in -1 to 1."""
    return np.frombuffer(pcm, "<i2").astype(np.float32) / np.float32(32768.0)


def decoded(files: DataFrame) -> DataFrame:
    """AUDIO rows of files (call_id, content). Bad files become rows with an error, never a failed task."""

    def run(batches):
        for batch in batches:
            rows = [(call, *decode(content)) for call, content in zip(batch["call_id"], batch["content"])]
            yield pd.DataFrame(rows, columns=["call_id", "pcm0", "pcm1", "n0", "n1", "sample_rate", "error"]).astype({"sample_rate": "Int32"})

    return small_batches(files.select("call_id", "content")).mapInPandas(run, AUDIO)


def wav_files(spark: SparkSession, folder: str, wanted: DataFrame | None = None) -> DataFrame:
    """AUDIO rows of a folder of ``<call_id>.wav``; wanted (call_id) leaves out files before they are decoded."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(folder)
    files = files.select(F.regexp_extract("path", r"([^/]+)\.wav$", 1).alias("call_id"), "content")
    return decoded(files if wanted is None else files.join(wanted, "call_id", "left_semi"))


def requests(batch: DataFrame) -> DataFrame:
    """AUDIO rows of detection requests; audio_b64 is another name of audio_base64. Base64 is read strictly."""
    named = batch.withColumn("text", F.coalesce("audio_base64", "audio_b64"))
    return decoded(named.select("call_id", F.try_to_binary("text", F.lit("base64")).alias("content")))
