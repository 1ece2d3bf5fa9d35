"""The driver's contract: every key runs, and the SQL side agrees on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__ as entry
from tidemark import queries as series

SF = os.environ.get("CONTRACT_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
#: A key of each kind; CONTRACT_ALL=1 takes all of them.
SOME = ["sel_offset", "sel_nre", "rate_reset", "irate", "changes", "stddev_over_time", "fn_round_to", "agg_topk", "agg_quantile", "bin_vector_filter", "set_or", "sel_range_long", "ingest_reject_out_of_order", "retention", "meta_label_values", "flushed_blocks", "flushed_samples", "compaction_plan", "compacted", "write_request", "match_errors"]


@pytest.fixture(scope="module")
def con():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def shown(pdf):
    columns = sorted(pdf.columns)
    return columns, sorted((tuple(round(float(x), 4) if isinstance(x, float) else x for x in r) for r in pdf[columns].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("key", sorted(series.oracles()) if os.environ.get("CONTRACT_ALL") else SOME)
def test_oracle(spark, con, key):
    assert shown(series.queries()[key](spark, SF).toPandas()) == shown(con.sql(series.oracles()[key]).df())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["event_type", "ts", "v"] and df.count() > 0


def test_keys():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(series.queries()) == set(series.oracles()) and len(series.queries()) > 100
