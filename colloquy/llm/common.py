"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that parts words: space, tab, line feed, vertical tab, form feed, carriage return.
#: ``bytes.split()`` without arguments splits on exactly these six.
WORD_GAPS = "\x20\x09-\x0d"
#: Rows that a worker handles at a time.
ROWS = 1000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data, a file or a folder of part files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder, so that lost executors cost no recomputation.

    The folder is the session's ``spark.checkpoint.dir``; only a session of this machine alone (tests, a laptop)
    may leave that unset and gets a folder here.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def tidy(spark: SparkSession) -> None:
    """Let the driver drop what nothing refers to: shuffles and checkpoints of steps that are over, and its own garbage.

    For operators of many steps; by itself Spark only does so when the driver's memory is full.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def typed(docs: DataFrame, **kinds: str) -> DataFrame:
    """Only the named columns, cast; whatever else the table carries is left out and cannot clash.

    A column that is of its kind stays as it is: an alias more would keep equal exchanges apart.
    """
    same_kind = {"long": "bigint"}
    own = dict(docs.dtypes)
    return docs.select(*[F.col(f"`{name}`") if own[name] == same_kind.get(kind, kind) else F.col(f"`{name}`").cast(kind).alias(name) for name, kind in kinds.items()])


def sliced(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most so many rows: a worker then makes Python objects of few texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


KEPT: dict[tuple, object] = {}


def kept(make: Callable, *args) -> object:
    """make(*args), once for each worker, which keeps the last such thing only: what another operator needed goes."""
    if (make, *args) not in KEPT:
        forget()
        KEPT[(make, *args)] = make(*args)
    return KEPT[(make, *args)]


def forget() -> None:
    """Workers outlive tasks and go from operator to operator; what the last one kept would stay in their memory."""
    if KEPT:
        KEPT.clear()
        gc.collect()
        trim()


def trim() -> None:
    """Give back to the system what the C library holds free, the tokenizer's for one; only some C libraries can."""
    if give_back := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give_back(0)


def map_rows(df: DataFrame, schema: str, work: Callable[[dict[str, list]], dict[str, list] | None], setup: Callable | None = None) -> DataFrame:
    """mapInArrow over column dictionaries; setup() runs once a task and is handed to work as its second argument; what is dear to set up it takes from kept() for its worker."""
    kinds = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else forget()
        for batch in sliced(batches):
            columns = {n: c for n, c in zip(batch.schema.names, batch.columns)}
            out = work(columns, state) if setup else work(columns)
            if out is not None and len(next(iter(out.values()))):
                yield pa.record_batch([pa.array(out[f.name], type=f.type) if not isinstance(out[f.name], (pa.Array, pa.ChunkedArray)) else out[f.name] for f in kinds], schema=kinds)

    return df.mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema), prefers_large_types=False)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)
