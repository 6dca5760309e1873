"""Every registered query against its plain-SQL counterpart on the smallest data set."""

import datetime
import math
import os
from collections import Counter

import duckdb
import pytest

from quotelake.plans.registry import all_oracles, all_queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def norm(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return repr(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_matches_sql(spark, duck, name):
    df = all_queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = Counter(tuple(norm(r[c]) for c in cols) for r in df.collect())
    sql = all_oracles().get(name)
    assert sql is not None, "every entry needs its SQL"
    res = duck.execute(sql)
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = Counter(tuple(norm(row[names.index(c)]) for c in cols) for row in res.fetchall())
    assert got == want
