"""Adaptive time partitions against a plain simulation of the layout, files read back."""

from __future__ import annotations

import calendar
import glob
import hashlib
import zlib
from datetime import datetime, timedelta

import duckdb
import pyarrow.parquet as pq
import pytest
from conftest import SF
from pyspark.sql import functions as F

from gridscribe.llm import timeparts


def moment(click_id, ts):
    k = zlib.crc32(str(click_id).encode()) % 128 if click_id is not None else 64
    if ts is None:
        return None
    if k < 16:
        return ts - timedelta(days=(k + 6) ** 3)
    if k > 111:
        return datetime(ts.year, ts.month, ts.day) - timedelta(days=ts.weekday())
    return ts


def brute_leaves(moments, limit):
    """(leaf, from, to) by the rule, one sibling after another."""
    some = [m for m in moments if m is not None]
    out = []

    def walk(prefix, members, deeper):
        """members: (label, from, to)"""
        run, size = [], 0

        def close():
            if run and size:
                out.append((prefix + run[0][0] + "-" + run[-1][0], run[0][1], run[-1][2]))

        for m in members:
            n = sum(m[1] <= x < m[2] for x in some)
            if n > limit:
                close()
                run, size = [], 0
                if deeper is None:
                    out.append((f"{prefix}{m[0]}-{m[0]}", m[1], m[2]))
                else:
                    deeper(f"{prefix}{m[0]}/", m[1])
            elif run and size + n <= limit:
                run, size = [*run, m], size + n
            else:
                close()
                run, size = [m], n
        close()

    def hours(prefix, d):
        walk(prefix, [(f"{h:02d}", d + timedelta(hours=h), d + timedelta(hours=h + 1)) for h in range(24)], None)

    def days(prefix, m):
        n = calendar.monthrange(m.year, m.month)[1]
        walk(prefix, [(f"{i + 1:02d}", m + timedelta(days=i), m + timedelta(days=i + 1)) for i in range(n)], hours)

    def months(prefix, y):
        walk(prefix, [(f"{i:02d}", datetime(y.year, i, 1), datetime(y.year + i // 12, i % 12 + 1, 1)) for i in range(1, 13)], days)

    if some:
        walk("", [(f"{y:04d}", datetime(y, 1, 1), datetime(y + 1, 1, 1)) for y in range(min(some).year, max(some).year + 1)], months)
    return out


def brute_files(rows, limit):
    """{(leaf, part): rows in order}; rows are (moment, arrived_at, click_id, others)."""
    files = {}
    groups = [(leaf, [r for r in rows if r[0] is not None and a <= r[0] < b]) for leaf, a, b in brute_leaves([r[0] for r in rows], limit)]
    groups.append(("null", [r for r in rows if r[0] is None]))
    none_first = lambda v: (v is not None, v if v is not None else 0)
    for leaf, mine in groups:
        mine = sorted(mine, key=lambda r: (none_first(r[0]) if r[0] else (False, 0), r[1] is not None, r[1] or datetime.min, none_first(r[2]), str(r[3:])))
        for p in range(0, len(mine), limit):
            files[leaf, p // limit + 1] = mine[p : p + limit]
    return files


def brute_report(rows, limit, cut_at):
    early = lambda r: r[1] is not None and r[1] < cut_at
    start, final = brute_files([r for r in rows if early(r)], limit), brute_files(rows, limit)
    digest = lambda x: hashlib.sha256(",".join(str(r[2]) for r in x).encode()).hexdigest()
    return {k: (len(v), sum(not early(r) for r in v), digest(v), start.get(k) != v) for k, v in final.items()}


@pytest.fixture(scope="module")
def clicks():
    return duckdb.sql(f"SELECT click_id, ts, arrived_at, client_id, kind, value, props FROM '{SF}/clicks.parquet'").fetchall()


def test_query_equals_brute_force(spark, clicks):
    got = timeparts.op12_time_partitions(spark, SF).collect()
    rows = [(moment(r[0], r[1]), r[2], r[0], *r[3:]) for r in clicks]
    want = brute_report(rows, 1 + len(rows) // 650, datetime(2024, 3, 1))
    assert {(r["leaf"], r["part"]): (r["n_rows"], r["n_new"], r["ids_sha256"], r["rewritten"]) for r in got} == want
    assert any(not r["rewritten"] for r in got) and any(r["rewritten"] and not r["n_new"] for r in got) and sum(r["n_rows"] for r in got) == len(clicks)
    folder = got[0]["path"].split("/leaf=")[0].removeprefix("file://").removeprefix("file:")
    there = glob.glob(f"{folder}/**/*.parquet", recursive=True)
    assert sorted(there) == sorted(r["path"].removeprefix("file://").removeprefix("file:") for r in got)
    by = {r["path"].removeprefix("file://").removeprefix("file:"): r for r in got}
    for path in there[::25]:
        one = pq.ParquetFile(path).read()
        assert ",".join(one.column_names) == by[path]["columns"] == "click_id,ts,arrived_at,client_id,kind,value,props"
        assert hashlib.sha256(",".join(map(str, one["click_id"].to_pylist())).encode()).hexdigest() == by[path]["ids_sha256"]
    assert not glob.glob(f"{folder}-sorted*")


SCHEMA = "click_id bigint, ts timestamp_ntz, arrived_at timestamp_ntz, leaf string, `a.b` int, _row string"


def written(spark, tmp_path, rows, limit, folder=None, has_files=False):
    folder = folder or f"{tmp_path}/out"
    df = spark.createDataFrame(rows, SCHEMA)
    timeparts.write_partitions(df, F.col("ts"), ["arrived_at", "click_id"], limit, folder, has_files)
    found = {}
    for path in glob.glob(f"{folder}/**/*.parquet", recursive=True):
        leaf, part = (x.split("=", 1)[1] for x in path.split("/")[-3:-1])
        assert (leaf.replace(".", "/"), int(part)) not in found
        found[leaf.replace(".", "/"), int(part)] = (path, pq.ParquetFile(path).read())
    return folder, found


def test_any_rows(spark, tmp_path):
    import random

    rnd = random.Random(4)
    some = [datetime(2021, 2, 28, 23, 59, 59, 999999), datetime(2024, 2, 29), datetime(1969, 12, 31, 23), datetime(1600, 1, 1), datetime(2024, 12, 31, 23, 30), None]
    rows = []
    for i in range(400):
        ts = rnd.choice(some) if rnd.random() < 0.5 else datetime(2020, 1, 1) + timedelta(minutes=rnd.randrange(3_000_000))
        rows.append((rnd.choice([i, 7, None]), ts, rnd.choice([None, datetime(2024, 1, 1), datetime(2024, 5, 1)]), rnd.choice(["x", None]), rnd.choice([1, None]), "r"))
    for limit in (1, 3, 20, 1000):
        want = brute_files([(r[1], r[2], r[0], *r[3:]) for r in rows], limit)
        _, got = written(spark, tmp_path / str(limit), rows, limit)
        assert {k: (len(v), [r[2] for r in v]) for k, v in want.items()} == {k: (t.num_rows, t["click_id"].to_pylist()) for k, (_, t) in got.items()}
        assert all(t.column_names == ["click_id", "ts", "arrived_at", "leaf", "a.b", "_row"] for _, t in got.values()) if limit > 1 else True


def test_one_moment_and_one_row_many_times(spark, tmp_path):
    at = datetime(2024, 5, 6, 7, 8)
    rows = [(1, at, at, "x", 1, "r")] * 25 + [(2, None, None, None, None, None)] * 25
    _, got = written(spark, tmp_path, rows, 10)
    assert {k: t.num_rows for k, (_, t) in got.items()} == {("2024/05/06/07-07", 1): 10, ("2024/05/06/07-07", 2): 10, ("2024/05/06/07-07", 3): 5, ("null", 1): 10, ("null", 2): 10, ("null", 3): 5}


def test_empty_siblings_join_runs(spark, tmp_path):
    """Ten rows in 2005 and 2007, with a limit of ten: 2005 and empty 2006 are one run; 2007 begins the next, which the empty 2008 joins."""
    rows = [(i, datetime(y, 3, 1 + i), None, None, None, None) for y in (2005, 2007) for i in range(10)] + [(99, datetime(2009, 1, 1), None, None, None, None)]
    _, got = written(spark, tmp_path, rows, 10)
    assert set(got) == {("2005-2006", 1), ("2007-2008", 1), ("2009-2009", 1)}


def test_rewrite_keeps_equal_files_only(spark, tmp_path):
    row = lambda i, y, v="x": (i, datetime(y, 1, 1, i), None, v, None, None)
    first = [row(i, y) for y in (2001, 2002, 2003) for i in range(5)]
    folder, before = written(spark, tmp_path, first, 5)
    assert set(before) == {("2001-2001", 1), ("2002-2002", 1), ("2003-2003", 1)}
    later = [r if r[:2] != (2, datetime(2002, 1, 1, 2)) else (*r[:3], "changed", *r[4:]) for r in first] + [row(7, 2003)]
    _, after = written(spark, tmp_path, later, 5, folder, True)
    assert after["2001-2001", 1][0] == before["2001-2001", 1][0]
    assert after["2002-2002", 1][0] != before["2002-2002", 1][0] and ("2003-2003", 1) not in after


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "click_id bigint, ts timestamp_ntz, arrived_at timestamp_ntz, client_id bigint").write.parquet(f"{tmp_path}/clicks.parquet")
    assert timeparts.op12_time_partitions(spark, str(tmp_path)).count() == 0
    assert written(spark, tmp_path, [], 5)[1] == {}
