"""The entry module, with and without the training-data subpackage."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from colloquy.plans import catalogue
from tests.conftest import SF

ROOT = Path(__file__).resolve().parent.parent


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and rows[0].__fields__ == ["call_id", "wait", "talk", "p", "is_synthetic"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalogue.QUERIES) <= set(entry.queries())


def test_import_without_the_subpackage(tmp_path):
    (tmp_path / "colloquy").mkdir()
    for part in (ROOT / "colloquy").iterdir():
        if part.name not in ("llm", "__pycache__"):
            (tmp_path / "colloquy" / part.name).symlink_to(part)
    (tmp_path / "entry_copy.py").write_text((ROOT / "__spark_entry__.py").read_text())
    code = "import entry_copy as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; e.oracle_sql()"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


@pytest.mark.parametrize("name", ["scan_split_counts", "overlap_by_call", "timing_features", "fused_verdict"])
def test_queries_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("events", "labels", "documents"):
        con.execute(f"create view {table} as select * from read_parquet('{SF}/{table}.parquet')")
    found = con.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in found.description]
    want = sorted((tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in found.fetchall()), key=repr)
    got = catalogue.QUERIES[name](spark, SF).select(*columns).collect()
    assert sorted((tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in got), key=repr) == want
