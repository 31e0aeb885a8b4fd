"""A folder of labelled calls: manifest.csv, turns/<call_id>.json and audio/<call_id>.wav, wherever Spark can read it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.sources.audio import wav_files
from colloquy.sources.tables import manifest, turns

#: Where a data set lies if no folder is named, in the order in which they are looked at.
PLACES = ("dataset", "resources/challenge-dataset")
#: Where its sound may lie besides its own folder.
SOUND = ("audio", "resources/audio", "dataset/audio")


class DatasetError(ValueError):
    """There is no such data set or call."""


def readable(spark: SparkSession, path: str) -> bool:
    """If Spark finds the path, on whatever file system."""
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException:
        return False
    return True


@dataclass(frozen=True)
class Dataset:
    spark: SparkSession
    root: str
    sound: str

    def calls(self, split: str | None = None) -> DataFrame:
        return manifest(self.spark, f"{self.root}/manifest.csv", split)

    def turns(self) -> DataFrame:
        return turns(self.spark, f"{self.root}/turns")

    def audio(self, split: str | None = None) -> DataFrame:
        """AUDIO rows; a split is joined before any file is decoded."""
        wanted = None if split is None else self.calls(split).select(F.col("anon_id").alias("call_id"))
        return wav_files(self.spark, self.sound, wanted)

    def call(self, call_id: str) -> DataFrame:
        """One row: the manifest's columns, the call's turns as an array, and its audio columns."""
        row = self.calls().where(F.col("anon_id") == call_id)
        if row.isEmpty():
            raise DatasetError(f"not in the manifest: {call_id}")
        own = wav_files(self.spark, self.sound, self.spark.createDataFrame([(call_id,)], "call_id string"))
        spoken = self.turns().where(F.col("call_id") == call_id).groupBy("call_id").agg(F.sort_array(F.collect_list(F.struct("seq", "channel", "start", "end"))).alias("turns"))
        found = row.join(own, F.col("anon_id") == own["call_id"]).join(spoken, "call_id", "left")
        if found.isEmpty():
            raise DatasetError(f"no audio file: {call_id}")
        return found


def resolve(spark: SparkSession, root: str | None = None, base: str = ".", places: Sequence[str] = PLACES) -> Dataset:
    """The first place with a manifest, turns and sound; a named root is the only place looked at."""
    tried = [root] if root is not None else [f"{base}/{p}" for p in places]
    for place in tried:
        if readable(spark, f"{place}/manifest.csv") and readable(spark, f"{place}/turns"):
            for sound in (f"{place}/audio", *[f"{base}/{s}" for s in SOUND]):
                if readable(spark, sound):
                    return Dataset(spark, place, sound)
            raise DatasetError(f"manifest and turns, but no sound: {place}")
    raise DatasetError(f"no data set in: {', '.join(tried)}")
