"""A few registered plans beside their SQL twins on the smallest tables; check.py runs them all."""

import os

import duckdb
import pytest

from check import TABLES, plain
from threadgauge.plans.registry import load, queries

FOLDER = "/root/testdata/sf0.001"
NAMES = ["snp_06_roots", "smp_08_stratified_sample", "ans_13_two_level_assignment", "crd_02_card_metrics", "est_04_interval", "men_01_collect", "led_05_run_rows", "gate_04_pattern_findings"]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_plan_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(v) for v in r) for r in df.select(*cols).collect())
    res = con.execute(load()[name].sql)
    names = [d[0] for d in res.description]
    order = [names.index(c) for c in cols]
    assert got == sorted(tuple(plain(r[i]) for i in order) for r in res.fetchall())


def test_every_section_is_registered():
    prefixes = {n.split("_")[0] for n in load()}
    assert prefixes >= {"src", "snk", "snp", "txt", "jsn", "smp", "ans", "crd", "est", "tst", "agr", "met", "rep", "men", "trm", "bun", "led", "str", "gate", "pub"}
