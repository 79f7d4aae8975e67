"""Registered queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tracewright import registry

SF = "/root/testdata/sf0.001"
SOME = ["line_fields", "count_windows_10_4", "masked_lines_hdfs", "stratified_split", "oversampled_train", "token_ids", "score_columns", "bm25_terms", "parsed_answers", "classification_report", "run_metrics"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", SOME)
def test_query(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(map(str, r)) for r in df.select(*cols).collect())
    names = ", ".join(f'"{c}"' for c in cols)
    want = sorted(tuple(map(str, r)) for r in con.execute(f"SELECT {names} FROM ({registry.ORACLES[name]})").fetchall())
    assert got == want
