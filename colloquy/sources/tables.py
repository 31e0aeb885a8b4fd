"""Manifests, turn and transcript files, models and reports."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.schemas import MANIFEST, TRANSCRIPT_FILE, TURN_FILE
from colloquy.sources import places


def manifest(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Manifest rows; a split is a filter on the scan."""
    rows = spark.read.csv(path, header=True, schema=MANIFEST)
    return rows if split is None else rows.where(F.col("split") == split)


def turns(spark: SparkSession, folder: str, texts: bool = False) -> DataFrame:
    """Segments of a folder of ``<call_id>.json``, seq keeping the order of the file; texts: transcripts."""
    files = spark.read.schema(TRANSCRIPT_FILE if texts else TURN_FILE).option("multiLine", True).json(folder).select(F.regexp_extract("_metadata.file_name", r"(.*)\.json$", 1).alias("call_id"), F.posexplode("turns").alias("seq", "turn"))
    kinds = {"channel": "int", "start": "double", "end": "double"} | ({"text": "string"} if texts else {})
    missing = {"start": F.lit(0.0), "end": F.lit(0.0), "text": F.lit("")} if texts else {}
    return files.select("call_id", "seq", *[F.coalesce(F.col(f"turn.{n}").cast(k), *([missing[n]] if n in missing else [])).alias(n) for n, k in kinds.items()])


def first_rows(rows: DataFrame, order: str, limit: int) -> DataFrame:
    """The first rows in a given order: a top-k, not a sort."""
    return rows.orderBy(order).limit(limit)


def save_model(model: dict, path: str, spark: SparkSession) -> None:
    """A model document as one JSON row, wherever the path leads."""
    spark.createDataFrame([(json.dumps(model, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_model(path: str, spark: SparkSession) -> dict:
    """A model document from save_model() or a JSON file; keys that are missing take their defaults."""
    text = "\n".join(r["value"] for r in spark.read.text(path).collect())  # one document
    return {"fusion_type": "stacked", "vad_backend": "hybrid", "disagree_unsure": 0.10, "metrics": {}} | json.loads(text)


def report(rows: DataFrame, path: str, kind: str = "json") -> None:
    rows.write.mode("overwrite").format(kind).save(path)


def shown(rows: DataFrame, limit: int) -> tuple[list, int]:
    """(the first rows, how many there are beyond them): what a report shows, and what it must say that it does not."""
    taken = rows.limit(limit + 1).collect()
    return (taken, 0) if len(taken) <= limit else (taken[:limit], rows.count() - limit)


def markdown(rows: DataFrame, limit: int = 200) -> str:
    """A small result as a table; rows beyond limit are counted in its last line."""
    taken, more = shown(rows, limit)
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    lines += ["| " + " | ".join("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in taken]
    return "\n".join(lines + [f"({more} more rows are not shown)"] * bool(more))


def embedded_json(value: object) -> str:
    """JSON that can stand inside an HTML script element."""
    return json.dumps(value, default=str).replace("<", "\\u003c")


def html_page(title: str, tables: dict[str, DataFrame], limit: int = 200) -> str:
    """Small results as one page: a heading and a table for each, the numbers also as JSON for scripts. Rows beyond limit are counted under their table."""
    taken = {name: (rows.columns, *shown(rows, limit)) for name, rows in tables.items()}
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else html.escape(str(v))
    body = "".join(
        f"<h2>{html.escape(name)}</h2><table><tr>{''.join(f'<th>{html.escape(c)}</th>' for c in columns)}</tr>"
        + "".join(f"<tr>{''.join(f'<td>{cell(v)}</td>' for v in row)}</tr>" for row in rows) + "</table>" + f"<p>{more} more rows are not shown</p>" * bool(more)
        for name, (columns, rows, more) in taken.items()
    )
    data = embedded_json({name: {"columns": c, "rows": [list(r) for r in rows], "more": more} for name, (c, rows, more) in taken.items()})
    return f'<!doctype html><meta charset="utf-8"><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>{body}<script type="application/json" id="data">{data}</script>'


def save_page(page: str, path: str) -> None:
    """A page as one file, in any store that Arrow knows."""
    places.write(path, places.place(path)[1], page.encode())
