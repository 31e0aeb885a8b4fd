"""From raw documents to packed training sequences, one stage after another.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from colloquy.llm.common import read_table
from colloquy.llm.importance import keep_drawn
from colloquy.llm.mixing import mix
from colloquy.llm.packing import best_fit_pack
from colloquy.llm.secrets import redact
from colloquy.llm.weighted import keep_one


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling rejects go."""
    return keep_drawn(docs, read_table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay; each secret in them gives way to the name of its kind."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are dropped or repeated until sources meet their target weights."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' pieces in training sequences."""
    return best_fit_pack(docs)


STAGES = [("quality classifier", quality), ("minhash near-dedup", near_dedup), ("secret scans", secrets), ("mixing sources", mixing), ("best-fit packing", packing)]

#: The stages draw, hash and tokenise, which SQL cannot express; tests hold near-dedup against brute force over its
#: predecessor's rows, the quality stage's weights against their definition, the other stages against their operators or
#: properties, and the rows of run() against those of the stages one by one.
ORACLE_SQL = None


def shared_folder(spark: SparkSession) -> str:
    """Where stages are written: in the cluster's shared checkpoint folder; only a session of this machine alone may name none."""
    folder, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if folder is None:
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir")
    return f"{folder.rstrip('/')}/corpus-pipeline-{uuid.uuid4().hex}"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. The intermediate tables stay in the shared folder for its own clean-up."""
    docs, folder = read_table(spark, sf_dir, "documents"), shared_folder(spark)
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs.write.parquet(path := f"{folder}/{number}")
            docs = spark.read.parquet(path)
    return docs
