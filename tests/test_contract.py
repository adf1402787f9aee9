"""Driver contract: entry runs, every oracle key has a query, a sample of
oracles agree with Spark on sf0.001."""

import os

import duckdb

from __spark_entry__ import entry, oracle_sql, queries
from tools.compare import TABLES, digest
from tests.conftest import SF_SMALL

SURVEY_IDS = ["S1", "S2", "S3", "S4", "S5", "S6", "S7", "S8", "S9", "S10", "S12", "S13", "S14", "S15",
              "P1", "P2", "P3", "P4", "P5", "P6", "P7", "P8", "P9", "P10", "P11", "P12", "P13", "P14", "P15", "P16", "P17",
              "P18", "P19", "J1", "J2", "J3", "A1", "A2", "A3", "A4", "A5", "A6", "A7", "A8", "A9", "A10", "A11",
              "A12", "A13", "A14", "A15", "W1", "W2", "T1", "U1", "F1", "F2", "F3", "F4", "F5", "F6", "F7", "F8", "F9", "F10", "F11", "F12", "F13",
              "F14", "M1", "M2", "M3", "M4", "M5", "M6", "M7", "M8", "M9", "M10", "M11", "M12", "M13", "M14",
              "M15", "M16", "M17", "M18", "M19", "M20", "M21", "G1", "G2", "I1", "I2", "I3", "I4", "I5",
              "O1", "O2", "O3", "X1", "X2"]


def test_entry_runs(spark):
    df = entry(spark)
    assert df.count() > 0 and "window_start" in df.columns


def test_every_survey_id_registered():
    qs = queries()
    missing = [i for i in SURVEY_IDS if i not in qs]
    assert not missing, missing
    assert set(oracle_sql()) <= set(qs)


def test_sample_oracles_agree(spark):
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF_SMALL, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    qs, sqls = queries(), oracle_sql()
    for k in ["A2", "A3", "J1", "T1", "A10", "G1", "P15", "P16", "F7_F11", "M2"]:
        df = qs[k](spark, SF_SMALL)
        res = con.execute(sqls[k])
        a = digest(df.columns, [tuple(r) for r in df.collect()])[0]
        b = digest([d[0] for d in res.description], res.fetchall())[0]
        assert a == b, k
