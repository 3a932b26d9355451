"""One local session for all tests, and the comparison with DuckDB."""

from __future__ import annotations

import math
import os
import shutil
import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    home = tempfile.mkdtemp(prefix="session-")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", f"{home}/warehouse")
        .config("spark.checkpoint.dir", f"file://{home}/checkpoints")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
    shutil.rmtree(home, ignore_errors=True)


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    """A value that compares and sorts alike from either engine."""
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in v.items())
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return tuple(plain(x) for x in v)
    return v


def kind(t) -> str:
    import pyarrow as pa

    if pa.types.is_list(t) or pa.types.is_large_list(t):
        return f"list<{kind(t.value_type)}>"
    return {"large_string": "string", "float": "float", "double": "double"}.get(str(t), str(t))


def rows_of(table) -> list[tuple]:
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    return sorted((tuple(plain(v) for v in row) for row in zip(*columns, strict=True)), key=repr)


@pytest.fixture(scope="session")
def same(spark, duck, sf):
    """Holds a query against its SQL: columns, types and all rows."""

    def check(query, sql):
        got, want = query(spark, sf).toArrow(), duck.execute(sql).to_arrow_table()
        assert sorted(got.column_names) == sorted(want.column_names)
        types = {n: (kind(got.schema.field(n).type), kind(want.schema.field(n).type)) for n in got.column_names}
        assert {n: t for n, t in types.items() if t[0] != t[1]} == {}
        a, b = rows_of(got), rows_of(want)
        assert len(a) == len(b)
        assert [(x, y) for x, y in zip(a, b, strict=True) if x != y][:3] == []
        return len(a)

    return check
