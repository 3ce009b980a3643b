"""Each query of the stages against its DuckDB SQL, on the smallest tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from samplemill.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = Counter(tuple(plain(r[c]) for c in columns) for r in df.select([c for c, t in df.dtypes if c in columns]).collect()) if name in ORACLES else None
    if rows is None:
        assert df.count() > 0
        return
    found = tables.sql(ORACLES[name])
    assert sorted(found.columns) == columns
    at = [list(found.columns).index(c) for c in columns]
    assert rows == Counter(tuple(plain(r[k]) for k in at) for r in found.fetchall())


def test_jpegs_of_vectors_of_any_kind(spark, tmp_path):
    """Missing, empty, short and long vectors, values of all kinds, and rows that share their number."""
    nan, inf = float("nan"), float("inf")
    vectors = [(1, None), (2, []), (3, [0.5]), (4, [k / 7 - 5 for k in range(64)]), (5, [k / 9 for k in range(-50, 51)]), (6, [nan, None, inf, -inf, -0.0, 1e30]), (7, [1.0] * 9), (7, [2.0] * 9), (7, [2.0] * 9)]
    rows = spark.createDataFrame([(k, v, 0) for k, v in vectors], "vec_id long, embedding array<float>, label int")
    rows.coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = Counter((r["vec_id"], r["pos"], r["low"], r["high"]) for r in QUERIES["save_load_jpeg"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(f"select vec_id, pos, low, high from ({ORACLES['save_load_jpeg']})").fetchall()
    assert got == Counter(want) and len(want) == 1 + 64 + 101 + 6 + 27
