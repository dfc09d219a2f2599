import os

import pytest

import __spark_entry__
import discoforge.plans.queries  # noqa: F401  registers all
from discoforge.plans.registry import ORACLE_SQL, QUERIES
from tests.comparing import SF, duck, rows

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no supplied tables")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = duck(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no supplied tables")
@pytest.mark.parametrize("name", ["null_seq_sort", "systematic_sample", "federated_search", "presence_exact", "pushed_tracks", "matched_files", "workbook_rows", "archive_members", "message_files", "indexed_searches", "persisted_lookups"])
def test_larger_tables_too(spark, name):
    """Queries that shuffle by ranges, pass rows in order or ask an index, on tables that a sampler doesn't read whole."""
    assert rows(QUERIES[name](spark, "/root/testdata/sf0.01").toPandas()) == rows(duck(ORACLE_SQL[name], "/root/testdata/sf0.01"))


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
