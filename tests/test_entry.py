"""The registry: every query runs on the smallest tables; names and SQL fit."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF
from threatloom.plans import all_queries

FAST = ["u1_url_parts", "u13_open_redirect", "j1_blocklist_match", "e2_merge_feeds", "e7_adblock_rules", "d4_card_check", "p2_page_forms", "w4_auth_flow_anomalies", "t2_stream_auth_flow", "t8_stream_feed_refresh", "g9_latency_profile", "w6_rate_budget", "d7_mnemonic_check", "d16_redact_log_payload", "p3_visible_text", "s2_read_upload_files", "j10_third_party_assets"]


def test_sql_only_for_known_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_names_are_unique_and_lower():
    assert all(n == n.lower() for n in all_queries())


@pytest.mark.parametrize("name", FAST)
def test_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("pages", "documents", "events", "labels", "conversations", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    place = [want.columns.index(c) for c in columns]
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(str, (tuple(r[i] for i in place) for r in want.fetchall())))


def test_registry_needs_no_session():
    """Names and SQL can be read before there is a Spark session."""
    import subprocess
    import sys

    from tests.conftest import ROOT

    code = "import __spark_entry__ as e; print(len(e.queries()) >= len(e.oracle_sql()) > 50)"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert done.stdout.split()[-1:] == ["True"], done.stderr
