"""Checks and streams that must not gather a table in one task or on the driver."""

from pyspark.sql import functions as F

from keyloom.operators import validation
from keyloom.plans import catalog

SF = "/root/testdata/sf0.001"


def _ids(spark, *values):
    return spark.createDataFrame([(x,) for x in values], "id long")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_window_over_whole_tables(spark):
    for name in ("id_gap_check", "adjacent_duplicates"):
        assert "Window" not in _plan(catalog.QUERIES[name](spark, SF)), name


def test_id_gaps(spark):
    said = lambda *v: sorted(map(tuple, validation.id_gaps(_ids(spark, *v)).collect()))
    assert said(0, 1, 1, 1, 2, 4, 5, 9, None) == [(1, "dup"), (1, "dup"), (4, "gap"), (9, "gap")]
    assert said(-2, -1, 0) == [(-2, "dup")] and said(3, 4) == [(3, "gap")] and said() == said(0, 1) == []
    assert [r.id for r in validation.adjacent_duplicates(_ids(spark, 1, 2, 1, None, None), "id").collect()] == [1]


def test_the_stream_leaves_its_result_in_files(spark):
    got = catalog.QUERIES["stream_latest"](spark, SF)
    assert got.select(F.input_file_name().alias("f")).where("f = ''").count() == 0 and len(got.inputFiles()) > 0
