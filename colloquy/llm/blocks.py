"""A bounded part of a stated query set against all rows: rows stay where they are, and answers are a few a query and task.

Queries are a fixed share of the rows, so they are dealt to parts of about CHUNK rows each, and one part after the other is
broadcast. No pair of a query and a row ever is a row of Spark: a task keeps the best of each query over all
the blocks of rows that it reads, and only those go through a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import arrow_schema, forget, settle, sliced

#: Queries that are broadcast at a time, and rows that a task compares with them at a time.
CHUNK, BLOCK = 16384, 8192


def finite(vector: Column) -> Column:
    """A vector without null, infinite or undefined components; false for a null vector."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(good, F.lit(False))


def numbered(rows: DataFrame) -> DataFrame:
    """rows, settled, with a number rid for each, by which equal rows stay apart."""
    return settle(rows.withColumn("rid", F.monotonically_increasing_id()))


def matrix(column: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    """A column of lists as a matrix; shorter lists are filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    width = int(sizes.max()) if len(sizes) else 0
    values = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), kind)
    out[np.arange(width)[None, :] < sizes[:, None]] = values
    return out


def widened(rows: np.ndarray, width: int) -> np.ndarray:
    return rows if rows.shape[1] >= width else np.pad(rows, ((0, 0), (0, width - rows.shape[1])))


def against(rows: DataFrame, queries: DataFrame, searcher: Callable[[pa.Table], object], schema: str, chunk: int = CHUNK) -> DataFrame:
    """What searchers find: searcher(queries of a part) is made in each task, add(batch) shows it rows, results() gives columns of schema.

    queries: a settled table with a column rid. Parts are dealt by hash, so each has about chunk queries.
    """
    context, kinds = rows.sparkSession.sparkContext, arrow_schema(rows.sparkSession, schema)
    parts, out = max(1, -(-queries.count() // chunk)), None

    def search(sent) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forget()
            own = searcher(sent.value)
            for batch in sliced(batches, BLOCK):
                own.add(batch)
            found = own.results()
            size = len(found[kinds.names[0]])
            for at in range(0, size, 1 << 16):
                yield pa.record_batch([pa.array(found[f.name][at : at + (1 << 16)], type=f.type) for f in kinds], schema=kinds)

        return rows.mapInArrow(run, schema)

    for part in range(parts):
        own = queries.where(F.pmod(F.xxhash64("rid"), F.lit(parts)) == part).toArrow()  # of bounded size
        sent = context.broadcast(own)
        found = search(sent)
        if parts > 1:
            found = settle(found)
            sent.unpersist()
        out = found if out is None else out.unionByName(found)
    return out


def best(found: DataFrame, by: Sequence[str], first: int) -> DataFrame:
    """The first rows of each group by score, then vec_id (null ones last), then row, with their rank from 1."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
