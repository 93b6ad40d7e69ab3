"""Every registered query against its SQL twin on the smallest driver tables."""

from pathlib import Path

import pytest
from oracle import compare

from lodestar.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    df = registry.QUERIES[name](spark, SF)
    assert compare(df, SF, registry.ORACLE_SQL[name]) is None


def test_entry_points():
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not Path(SF).exists(), reason="no driver tables")
def test_query_without_sql(spark):
    """The one query that SQL can't express, against the same rule written in Python."""
    from difflib import SequenceMatcher

    assert set(registry.QUERIES) - set(registry.ORACLE_SQL) == {"exact_ratios"}
    parts = spark.read.parquet(f"{SF}/part.parquet").select("p_partkey", "p_brand", "p_name").collect()
    first = {}
    for r in sorted(parts):
        first.setdefault(r.p_brand, r.p_name)
    want = {r.p_partkey: (r.p_name.lower(), round(SequenceMatcher(None, r.p_name, first[r.p_brand]).ratio(), 6)) for r in parts}
    got = registry.QUERIES["exact_ratios"](spark, SF).collect()
    assert {r.p_partkey: (r.folded, r.score) for r in got} == want
    assert all(abs(r.title - (0.72 * r.score + 0.28)) < 2e-6 for r in got)


def test_import_tags_at_a_half(spark, tmp_path):
    """A confidence that is a hair below half of the last digit, compared with SQL to that digit."""
    import duckdb

    values = [16.52, 9.42, 11.0, 2.49, 116.81, 46.17, 23.21, 45.22]
    rows = [(i, 7, "click", v) for i, v in enumerate(values)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = db.execute(registry.ORACLE_SQL["import_tags"]).fetchall()
    assert [tuple(r) for r in registry.QUERIES["import_tags"](spark, str(tmp_path)).collect()] == want == [(7, "click", "mood", 0.829913)]
