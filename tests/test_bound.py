"""Every bound query against DuckDB on the small tables."""

import os

import duckdb
import pytest

from ferrule.plans import bound, bound_code, bound_resolve  # noqa: F401

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(bound.SQL))
def test_same_rows(spark, con, name):
    a, b = bound.QUERIES[name](spark, DIR).toArrow(), con.execute(bound.SQL[name]).to_arrow_table()
    cols = sorted(a.column_names)
    assert cols == sorted(b.column_names)
    assert sorted(map(repr, zip(*[a[c].to_pylist() for c in cols]))) == sorted(map(repr, zip(*[b[c].to_pylist() for c in cols])))


def test_contamination_by_short_items(spark, tmp_path):
    items = [(i, " ".join(f"x{j}" for j in range(n))) for i, n in enumerate(range(1, 10))] + [(20, "cat"), (21, "two  words"), (22, None), (23, "a b c")]
    docs = [(0, "y" + " ".join(f"x{j}" for j in range(9)) + "z end"), (1, "concatenate two  words"), (2, "two words a b"), (3, None), (4, "a b c"), (5, "za b cz"), (6, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, bound.q_contamination(spark, str(tmp_path)).collect()))
    assert got == sorted((d, i) for d, t in docs for i, m in items if t is not None and m is not None and m in t)
