import duckdb
import pytest

import __spark_entry__ as entry
from tallyforge.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, oracle, name):
    got = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    want = oracle.sql(registry.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    shown = lambda v: repr(v) if isinstance(v, float) else str(v)
    rows = sorted(tuple(shown(v) for v in r) for r in got.select(*columns).collect())
    assert rows == sorted(tuple(shown(r[i]) for i in at) for r in want.fetchall())


def test_every_query_has_sql_or_is_known_to_have_none():
    assert set(registry.QUERIES) - set(registry.ORACLE_SQL) == {"mutants"}
    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    row = entry.entry(spark).first()
    assert row.total_seeds == 370 and row.seeds_with_full_k == 113 and row.seeds_degraded == 200


def test_realtime_equals_batch(spark, sf_dir):
    assert registry.QUERIES["realtime_summary"](spark, sf_dir).first() == registry.QUERIES["passk_summary"](spark, sf_dir).first()


def test_plans_prune_columns_and_stay_native(spark, sf_dir):
    for name in set(registry.ORACLE_SQL):
        plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan, name
    plan = registry.QUERIES["pass1_per_seed"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "l_tax" not in plan


def test_mutants_are_of_whole_documents(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = registry.QUERIES["mutants"](spark, sf_dir).collect()
    assert {r.key % 3 for r in rows} >= {0, 1}
    for r in rows:
        # One line differs, and the snippet follows.
        old, new = [] if texts[r.key] is None else texts[r.key].split("\n"), r.mutant.split("\n")
        assert len(new) == len(old) + (5, 6, 0)[r.key % 3] and sum(a != b for a, b in zip(old, new, strict=False)) <= 1
