"""Counts of the fixture: whole, and with items shuffled without a copy for each distinct count."""

from __future__ import annotations

from gridscribe.sources.trials import counts


def test_counts_of_odd_items_without_expanded_rows(spark, tmp_path):
    rows = [(1, 1, "F", 10), (1, 1, "F", 10), (1, 2, "O", 10), (1, 3, "X", 11), (1, 9, "F", 12), (1, 4, "F", None), (None, 1, "F", 1), (2, 7, None, 5)]
    spark.createDataFrame(rows, "l_suppkey bigint, l_linenumber bigint, l_linestatus string, l_orderkey bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    df = counts(spark, str(tmp_path))
    got = sorted((r["table_id"], r["row_index"], r["n_a"], r["n_b"], r["big_a"], r["big_b"]) for r in df.collect())
    assert got == [(1, 1, 1, 0, 2, 1), (1, 2, 0, 1, 2, 1), (1, 3, 0, 0, 2, 1), (1, 4, 0, 0, 2, 1), (2, 7, 0, 0, 0, 0)]
    assert "Expand" not in df._jdf.queryExecution().toString()
