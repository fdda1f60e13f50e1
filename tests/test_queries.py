"""Every registered query against its SQL oracle in DuckDB."""

import glob
import math
import os

import duckdb
import pytest

from deltaloom.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v if isinstance(v, (int, str, bool, type(None))) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(name, spark, duck):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in catalogue.ORACLE_SQL:
        assert got
        return
    out = duck.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in out.fetchall()), key=repr)


@pytest.mark.parametrize("rows", [
    # over a thousand documents; averages that end in 5 after four digits (114/16, 138/16, 186/16); nulls and a tie; none
    "SELECT 'src' || (i % 3) AS source, i * 37 % 1000 AS n_chars FROM range(4500) t(i)",
    "SELECT 'src' || (i // 16) AS source, CASE i % 16 WHEN 0 THEN [24, 48, 36, 10][1 + i // 16] ELSE [6, 6, 10, 10][1 + i // 16] END AS n_chars FROM range(64) t(i)",
    "SELECT * FROM (VALUES ('b', 170), ('a', 270), (NULL, 30), ('c', NULL), ('d', 99), (NULL, 30)) t(source, n_chars)",
    "SELECT '' AS source, 1 AS n_chars WHERE FALSE",
])
def test_score_report(spark, rows, tmp_path):
    con = duckdb.connect()
    con.execute(f"create table documents as select source::VARCHAR as source, n_chars::BIGINT as n_chars from ({rows})")
    con.execute(f"copy documents to '{tmp_path}/documents.parquet' (format parquet)")
    got = {tuple(r) for r in catalogue.QUERIES["score_report"](spark, str(tmp_path)).collect()}
    assert got == set(con.execute(catalogue.ORACLE_SQL["score_report"]).fetchall())


def test_score_report_mean(spark):
    from deltaloom.operators import report

    units = [5373, 5364, 5347, 5336, 5324, 5313, 5297, 5296, 5293, 5276, 5275, 5270, 5266, 5264, 5250, 5249, 5238, 5211, 5170, 5118]  # check_h's; their mean ends in 5
    for order in (units, units[::-1], units[::2] + units[1::2]):
        df = spark.createDataFrame([(f"src{k}", u / 10_000) for k, u in enumerate(order)], "target string, overall double")
        assert report.text_report(df).collect()[-1].line == f"mean {math.fsum(u / 10_000 for u in units) / 20:.4f} of 20"
