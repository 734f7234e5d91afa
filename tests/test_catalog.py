"""Registered queries beside their SQL in DuckDB."""

import glob
import os

import pytest

SF = "/root/testdata/sf0.001"
NAMES = ["pdb_models", "pdb_no_model", "contacts_schema", "output_paths", "cluster_split", "components_maps", "smooth_values", "summarize_values", "raw_overlay", "known_clusters", "plot_points", "drawn_squares", "clustered_text",
         "filling_joins", "stream_windows", "summary_counts", "parsed_head", "animation_mp4"]


@pytest.fixture(scope="module")
def sql():
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def rows(frame):
    own = sorted(frame.columns)
    return own, sorted(map(str, frame[own].astype(object).where(frame[own].notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", NAMES)
def test_like_sql(spark, sql, name):
    import __spark_entry__ as entry

    assert rows(entry.queries()[name](spark, SF).toPandas()) == rows(sql.execute(entry.oracle_sql()[name]).df())
