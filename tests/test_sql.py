"""Every query that has SQL gives the rows that DuckDB gives, and some rows at all but where a small table has no case."""

from pathlib import Path

import duckdb
import pytest

import verify
from quire.plans import all_queries, all_sql

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no tables here")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in Path(FOLDER).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_same_rows(spark, db, name):
    df = all_queries()[name](spark, FOLDER)
    cur = db.execute(all_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(df.columns) == sorted(names)
    want = verify.rows(names, cur.fetchall())
    assert verify.rows(df.columns, df.collect()) == want
    assert want or name in {"verse_runs", "version_diff", "split_sections", "protected_blocks", "header_footer_texts", "events_since", "stale_keys", "cast_runs", "front_back_matter", "flatten_outline", "store_get", "preflight", "column_split", "pinning_diff", "sections_by_status", "in_flight_sections"}


@pytest.mark.parametrize("name", sorted(set(all_queries()) - set(all_sql())))
def test_runs(spark, name):
    assert all_queries()[name](spark, FOLDER).collect()
