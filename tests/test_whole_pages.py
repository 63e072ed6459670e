"""Queries over whole pages: what stands behind 4000 characters of text, ten forms, 60 scripts, 50 images or 400 000 characters of
HTML counts, in the SQL too."""

import os

import pytest

from tests.conftest import SF

FILL = "".join(f"<p>plain words number {i} of a long page</p>" for i in range(150))
LOGIN = '<form action="{}" method="post"><input type="email" name="email"><input type="password" name="p"></form>'
SEARCH = '<form action="/find" method="get"><input name="q"></form>'
#: Bodies by what they show. Ids are multiples of 24, so neither their URLs nor their forms are dressed up.
BODIES = {
    "brand": FILL + "<h1>Sign in to Netflix</h1>" + LOGIN.format("/session"),
    "form": "<p>short</p>" + SEARCH * 12 + LOGIN.format("https://gather.far-away.example/p"),
    "terms": FILL + "<p>phishing analysis of a phishing kit: tutorial, documentation, oauth2, pkce, threat intelligence</p>" + LOGIN.format("/session"),
    "layout": '<h1>Hello</h1><img src="/a.png">' + FILL + '<p>sign in, use your google account, forgot email</p><form action="/n"><input type="email" name="email"></form>',
    "assets": "".join(f'<script src="https://s{i}.far-away.example/x.js"></script><img src="/i{i}.png">' for i in range(70)) + '<img src="https://www.paypal.com/logo.png"><p>sign in to paypal</p>' + LOGIN.format("/session"),
    "blob": FILL + "<p>" + "QUJDREVGR0hJSktMTU5P" * 8 + "</p>" + LOGIN.format("/session"),
    "html": "<p>" + "plain words " * 35_000 + "</p><h2>Netflix</h2>" + LOGIN.format("https://gather.far-away.example/p"),
    "plain": "<p>short</p>" + LOGIN.format("/session"),
}
IDS = {name: 24 * (i + 1) for i, name in enumerate(BODIES)}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    import duckdb

    home = tmp_path_factory.mktemp("whole-pages")
    columns = duckdb.sql(f"DESCRIBE SELECT * FROM '{SF}/pages.parquet'").fetchall()
    con = duckdb.connect()
    con.sql("CREATE TABLE made (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO made VALUES (?, ?, ?)", [(IDS[k], f"https://desk{IDS[k]}.far-off.example/", f"<html><head><title>Page</title></head><body>{body}</body></html>") for k, body in BODIES.items()])
    con.sql(f"COPY (SELECT {', '.join(c if c in ('page_id', 'url', 'html') else f'NULL::{t} AS {c}' for c, t, *_ in columns)} FROM made) TO '{home}/pages.parquet'")
    for table in os.listdir(SF):
        if table != "pages.parquet":
            os.symlink(f"{SF}/{table}", home / table)
    return home


def both(spark, home, name):
    """Rows of a query by page, which equal those of its SQL."""
    import duckdb

    import __spark_entry__ as entry

    got = entry.queries()[name](spark, str(home))
    rows = sorted(map(tuple, got.collect()))
    con = duckdb.connect()
    for table in ("pages", "documents", "events", "labels", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{home}/{table}.parquet'")
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert rows == sorted(want)
    by = {r[0]: dict(zip(got.columns, r)) for r in rows}
    return {k: by[i] for k, i in IDS.items()}


def test_page_verdicts(spark, tables):
    rows = both(spark, tables, "a11_page_verdict")
    assert "brand-creds" in rows["brand"]["rules"] and rows["brand"]["status"] == "dangerous"
    assert "external-post" in rows["form"]["rules"] and "external-post" in rows["html"]["rules"] and rows["html"]["status"] == "dangerous"
    assert rows["plain"]["status"] != "dangerous" and rows["assets"]["status"] == "dangerous"


def test_context_damping(spark, tables):
    rows = both(spark, tables, "a4_context_damping")
    assert rows["terms"]["context_score"] == 0.85 and rows["plain"]["context_score"] == 0


def test_layout_match(spark, tables):
    """Keywords of a template count wherever they stand, and so does a form behind ten others."""
    rows = both(spark, tables, "p10_auth_layout_match")
    assert rows["layout"]["layout_template"] == "google" and rows["layout"]["layout_match"] == 0.9
    assert rows["form"]["layout_match"] > 0


def test_phishing_signals(spark, tables):
    rows = both(spark, tables, "p5_phishing_signals")
    assert "brand-impersonation" in rows["brand"]["signals"] and "external-form-post" in rows["form"]["signals"] and rows["form"]["page_external_post"]
    assert rows["html"]["page_external_post"] and rows["html"]["auth_risk"] == "critical"
    # the mark of a brand is the 71st image
    assert "clone" in rows["assets"]["signals"].split(",") and "brand-impersonation" not in rows["plain"]["signals"]
