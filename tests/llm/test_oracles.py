import os

import duckdb
import pytest

from quernlight.llm.queries import ORACLE_SQL, QUERIES


def plain(x):
    return round(x, 6) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    want = c.execute(ORACLE_SQL[name])
    names = [x[0] for x in want.description]
    got = QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(names)
    assert sorted(repr([plain(r[n]) for n in names]) for r in got.collect()) == sorted(repr([plain(x) for x in r]) for r in want.fetchall())
