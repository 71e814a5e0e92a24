"""Every query with SQL gives the SQL's rows on the small tables."""

import math

import duckdb
import pytest

from leafmill.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    if hasattr(x, "item"):
        x = x.item()
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "~"
    return repr(round(x, 9)) if isinstance(x, float) else repr(x)


@pytest.fixture(scope="module")
def larger():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF.replace('0.001', '0.01')}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ["validate_report", "validate_entry", "build_notes", "source_info", "review_apply"])
def test_same_rows_of_the_larger_table(name, spark, larger):
    compare(registry.QUERIES[name](spark, SF.replace("0.001", "0.01")).toPandas(), larger.execute(registry.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(name, spark, con):
    a = registry.QUERIES[name](spark, SF).toPandas()
    compare(a, con.execute(registry.ORACLES[name]).df())
    assert len(a) > 0 or name in ("dedup_embedding_pairs",)


@pytest.mark.parametrize("rows", [
    [],
    [(1, 0, "user", None), (1, 1, "assistant", "no question"), (1, 2, "user", "unanswered"), (1, 3, "user", ""), (1, 4, None, "x"), (2, 0, "system", "s"), (2, 1, "user", "unanswered"), (3, 0, "user", "enta enta enta"), (3, 1, "assistant", None)],
])
def test_prompts_of_odd_conversations(rows, spark, tmp_path):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    for name in ("turn_cards", "near_prompts", "dedup_fuzzy_prompts"):
        compare(registry.QUERIES[name](spark, str(tmp_path)).toPandas(), c.execute(registry.ORACLES[name]).df())


def compare(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)
    rows = lambda d: sorted(tuple(map(plain, r)) for r in d[cols].itertuples(index=False))
    assert rows(a) == rows(b)


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
