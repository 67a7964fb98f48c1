"""Every query of the event operators against its SQL on the smallest tables."""

import duckdb
import pytest

from rillstone import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rounded(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, sql, name):
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = sorted((tuple(rounded(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = sql.execute(queries.SQL[name])
    names = [d[0] for d in cursor.description]
    want = sorted((tuple(rounded(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert sorted(names) == columns and found and found == want


@pytest.mark.parametrize("name", ["network_comparison_large", "geoip_enricher_six"])
def test_users_of_any_number_have_addresses(spark, tmp_path, name):
    """Numbers of more than four hexadecimal digits, up to the largest."""
    users = [0, 1, 63, 64, 65535, 65536, 89999, 2**32, 2**48 + 3, 2**63 - 1]
    spark.createDataFrame([(4 * i + k, u) for i, u in enumerate(users) for k in (0, 1)], "event_id long, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    found = sorted(tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).collect())
    assert found == sorted(duckdb.connect().execute(f"WITH events AS (FROM '{tmp_path}/events.parquet/*.parquet') {queries.SQL[name]}").fetchall())
