"""Every query of the catalog against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from chunkloom import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def spelled(v):
    if v is None or isinstance(v, str):
        return str(v)
    return "nan" if isinstance(v, float) and math.isnan(v) else f"{float(v):.6g}"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(spelled(r[c]) for c in cols) for r in df.collect())
    out = duck.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in out.description]
    want = sorted(tuple(spelled(dict(zip(names, row))[c]) for c in cols) for row in out.fetchall())
    assert sorted(names) == cols and got == want


def test_predictor_rounds_as_its_sql_where_float_products_are_halves(spark, duck, tmp_path):
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    v = (np.arange(-64, 64, dtype="<f8") + 0.5).astype("<f4") / np.float32(100)
    halves = [x for x in np.concatenate([v, np.nextafter(v, np.float32(0)), np.nextafter(v, np.float32(9))]) if abs(x * np.float32(100)) % 1 == 0.5]
    assert any(abs(float(x) * 100) % 1 != 0.5 for x in halves)
    kind = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32()))])
    pq.write_table(pa.table({"vec_id": [0, 1], "embedding": [halves, halves[::-1]]}, schema=kind), str(tmp_path / "embeddings.parquet"))
    got = sorted(map(tuple, catalog.queries()["predictor2_decode"](spark, str(tmp_path)).select("i0", "i1", "decoded").collect()))
    sql = catalog.oracle_sql()["predictor2_decode"].replace("from embeddings", f"from '{tmp_path}/embeddings.parquet'")
    assert got == sorted(duck.execute(f"select i0, i1, decoded from ({sql})").fetchall())


def test_entry(spark):
    assert catalog.entry(spark, SF).count() == 80
