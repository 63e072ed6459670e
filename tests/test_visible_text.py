"""The scan of visible text against a whole HTML parser: all given pages, and markup of every odd kind."""

import random

from tests.conftest import SF
from threatloom.operators import pages

PARTS = ["<p>", "</p>", "<div>", "</div>", "<div hidden>", '<div style="display:none">', "<span aria-hidden='true'>", "</span>", "<a href='x>y'>", "</a>", "<br>", "<br/>", "<img src=a>", "text ", "a &amp; b", "&lt;tag&gt;", "<script>", "</script>", "var x = '<p>';", "<style>", "</style>", "<title>", "</title>", "<!-- c <p> -->", "<!---->", "<!doctype html>", '<h1 class=big id="q">', "</h1>", "< notatag", "<p", "<button STYLE='opacity: 0'>", "</button>", "<noscript>", "</noscript>", "<textarea>", "</textarea>", "<template>", "</template>", "<label/>", "<SPAN>", '<p a="1"b>', "<iframe src=x></iframe>", "& co", "&#60;p&#62;", "<x-y>", "\n", "<a b=c/>", "</ p>", "<?php ?>", "<![CDATA[x]]>", '<p style="display&#58;none">']


def parsed(html):
    title, parts = pages._parsed(html or "")
    return " ".join([title.strip(), *parts])[:4000]


def test_all_pages(spark):
    rows = [r["html"] for r in spark.read.parquet(f"{SF.replace('sf0.001', 'sf0.01')}/pages.parquet").select("html").collect()]
    assert [pages.visible(h) for h in rows] == [parsed(h) for h in rows]
    assert sum(pages._scanned(h or "") is None for h in rows) < len(rows) / 50


def test_odd_markup():
    rng, scanned = random.Random(1), 0
    for _ in range(20_000):
        html = "".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 14)))
        scanned += pages._scanned(html) is not None
        assert pages.visible(html) == parsed(html), html
    assert scanned > 2000
