"""Every query on the driver's tables against its SQL."""

import duckdb
import pytest

import __spark_entry__
from codeloom.plans import answers, commerce, generated, polyglot

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


MODULES = (commerce, generated, polyglot, answers)
QUERIES, ORACLES = ({k: v for m in MODULES for k, v in getattr(m, kind).items()} for kind in ("QUERIES", "ORACLES"))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, db, name):
    got, want = QUERIES[name](spark, SF).toPandas(), db.execute(ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda d: sorted(tuple(str(v) for v in r) for r in d[cols].astype(object).where(d[cols].notna(), None).values.tolist())
    assert rows(got) == rows(want)


def test_queries_without_sql(spark):
    got = commerce.rename_candidates(spark, SF).collect()
    assert len(got) == 200 and all(0 <= r.score <= 1 for r in got)
    assert all("+" in r.diff and r.diff.startswith("--- a/") for r in commerce.unified_diff_pages(spark, SF).collect() if r.diff)
    facts = commerce.extract_python_facts(spark, SF)
    assert facts.filter("kind = 'symbol' and c = 'function'").count() == 150


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
