"""Registered queries at the smallest scale: every oracle key has a query, and a sample is compared."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SAMPLE = ["c05_shape_iou", "n02_final_dedupe", "n06_id_switches", "j01_merge_pose", "j04_redetect", "t03_assign_totals",
          "a01_mot_metrics", "g01_body_gestures", "g02_hand_gestures", "l05_typed_events", "l02_no_commands", "a03_health",
          "a05_throttle", "s05_decode_detect", "s08_rejected_snapshots"]


def clean(v):
    return f"{v + 0.0:.6g}" if isinstance(v, float) else str(v)


def test_oracle_keys_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 4 and all(r.total_tracks > 0 for r in rows)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    want = sorted([clean(v) for v in r] for r in cur.fetchall())
    got = sorted([clean(v) for v in r] for r in entry.queries()[name](spark, SF).select(*cols).collect())
    assert want and got == want
