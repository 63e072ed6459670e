"""Golden cases of URL operators and scores."""

import pytest
from pyspark.sql import functions as F

from threatloom.functions import hosts as H
from threatloom.operators import scoring, urls

SHOP, CAFE = "https://shop.example.org/", "https://harbour-cafe.net"
PUNY, SCRIPT = "https://xn--ntflix-3of.com/in", "https://gооgle.com/"


@pytest.fixture(scope="module")
def verdicts(spark):
    cases = [
        SHOP, "http://shop.example.org/", "https://netf1ix.com/watch", "http://10.20.30.40/panel", "https://guest:room@shop.example.org/", "no address at all",
        "https://netflix.com.billing-desk.xyz/pay", "https://accounts.google.com.portal-eu.top/", SHOP + "notes-on-netflix", "https://www.netflix.com/account", "https://tinyurl.com/q7",
        CAFE + "/update-billing/step", CAFE + "/leave?url=https://far-away.example/start", CAFE + "/go?redirect=https%3A%2F%2Ffar-away.example%2Fx", CAFE + "/go?goto=http://198.51.100.7/x",
        CAFE + "/in?next=/tables", CAFE + "/in?next=" + CAFE + "/tables", CAFE + "/go?u=//far-away.example/x", PUNY, "https://netflix.members-desk.net/x", SCRIPT,
    ]
    rows = scoring.url_verdicts(spark.createDataFrame(list(enumerate(cases)), "url_id long, url string"))
    out = rows.select("url", "score", "status", F.transform("signals", lambda s: s["id"]).alias("ids"), "lookalike_kind", "lookalike_brand", "brand_subdomain", "redirect_host", "redirect_risky", "phishy_token", "shortener")
    return {r["url"]: r for r in out.collect()}


def test_clean_and_reputable_urls_are_safe(verdicts):
    assert verdicts[SHOP]["status"] == "safe"
    assert verdicts["https://www.netflix.com/account"]["status"] == "safe"


def test_plain_http_costs_points(verdicts):
    row = verdicts["http://shop.example.org/"]
    assert "no-https" in row["ids"] and row["score"] < 80


def test_invalid_url_is_suspicious_at_fifty(verdicts):
    row = verdicts["no address at all"]
    assert (row["score"], row["status"], row["ids"]) == (50, "suspicious", [])


@pytest.mark.parametrize(
    "url,signal",
    [
        ("http://10.20.30.40/panel", "ip-host"), ("https://guest:room@shop.example.org/", "userinfo"), ("https://netf1ix.com/watch", "lookalike"), ("https://tinyurl.com/q7", "url-shortener"),
        (CAFE + "/update-billing/step", "phishy-token"), ("https://netflix.com.billing-desk.xyz/pay", "brand-subdomain-spoof"), (PUNY, "mixed-script-host"), (SCRIPT, "lookalike"),
    ],
)
def test_signal_fires(verdicts, url, signal):
    assert signal in verdicts[url]["ids"]


def test_brand_in_subdomain(verdicts):
    assert verdicts["https://netflix.com.billing-desk.xyz/pay"]["brand_subdomain"] == "netflix.com"
    assert verdicts["https://accounts.google.com.portal-eu.top/"]["brand_subdomain"] == "google.com"
    assert verdicts[SHOP + "notes-on-netflix"]["brand_subdomain"] is None


@pytest.mark.parametrize(
    "url,host,risky",
    [
        (CAFE + "/leave?url=https://far-away.example/start", "far-away.example", False), (CAFE + "/go?redirect=https%3A%2F%2Ffar-away.example%2Fx", "far-away.example", True),
        (CAFE + "/go?goto=http://198.51.100.7/x", "198.51.100.7", True), (CAFE + "/in?next=/tables", None, False), (CAFE + "/in?next=" + CAFE + "/tables", None, False), (CAFE + "/go?u=//far-away.example/x", "far-away.example", False),
    ],
)
def test_open_redirects(verdicts, url, host, risky):
    assert (verdicts[url]["redirect_host"], verdicts[url]["redirect_risky"]) == (host, risky)


def test_lookalikes(verdicts):
    assert (verdicts["https://netf1ix.com/watch"]["lookalike_kind"], verdicts["https://netf1ix.com/watch"]["lookalike_brand"]) == ("typo", "netflix.com")
    assert verdicts[PUNY]["lookalike_kind"] == "homoglyph"
    assert verdicts["https://netflix.members-desk.net/x"]["lookalike_kind"] == "brand-in-host"
    assert verdicts["https://www.netflix.com/account"]["lookalike_kind"] is None


def test_root_domains(spark):
    cases = {"one.two.example.org": "example.org", "shop.harbour.org.uk": "harbour.org.uk", "desk.kiwi.net.nz": "kiwi.net.nz", "a.reef.net.au": "reef.net.au", "x.cape.web.za": "cape.web.za", "in.port.ne.jp": "port.ne.jp", "10.20.30.40": "30.40", "intranet": "intranet"}
    rows = spark.createDataFrame(list(cases.items()), "host string, want string").select("host", "want", H.root_domain(F.col("host")).alias("got"), H.root_domain("host").alias("named")).collect()
    assert all(r["got"] == r["named"] == r["want"] for r in rows), rows


def test_sensitivity_orders_scores(spark):
    df = spark.createDataFrame([(1, "http://harbour-cafe.net/")], "url_id long, url string")
    strict, lenient = (scoring.url_verdicts(df, sensitivity=s).first()["score"] for s in (1.25, 0.75))
    assert strict < lenient


def test_undecodable_hosts_stay(spark):
    assert H.decode_host("xn--é.org") is not None
    assert H.decode_host("www.xn--ggle-55da.com") == "gооgle.com"
    assert H.encode_host("gооgle.com") == "xn--ggle-55da.com"


def test_empty_and_extra_columns(spark):
    empty = spark.createDataFrame([], "url_id long, url string, score int, extra string")
    assert urls.url_facts(empty.drop("score")).count() == 0


EVIDENCE = {"ext_malicious": "gsb", "ext_engines": "vt", "flow_relay": "authflow:credential-relay", "flow_token_drift": "authflow:oauth-token-drift", "flow_iframe_swap": "authflow:iframe-origin-swap", "flow_mfa_split": "authflow:mfa-origin-split", "flow_redirect_storm": "authflow:redirect-storm", "hops": "long-redirects", "chain_roots": "cross-domain-redirects"}


def test_evidence_of_other_tables_counts(spark):
    columns = list(EVIDENCE)
    plain = spark.createDataFrame([(i, f"{CAFE}/tables/{i}", i) for i in range(len(columns) + 1)], "url_id long, url string, tab_id long")
    of = lambda names, key: spark.createDataFrame([(key(i), *[(c == columns[i] if kind == "boolean" else 6 * (c == columns[i])) for c, kind in names]) for i in range(len(columns))], [k for k, _ in [("url" if key(0) != 0 else "tab_id", ""), *names]])
    by_tab = of([(c, "boolean" if c.startswith("flow") else "int") for c in columns if not c.startswith("ext")], lambda i: i)
    by_url = of([("ext_malicious", "boolean"), ("ext_engines", "int")], lambda i: f"{CAFE}/tables/{i}")
    rows = {r["url_id"]: r for r in scoring.url_verdicts(plain, evidence=[(by_tab, "tab_id"), (by_url, "url")]).collect()}
    before = rows[len(columns)]  # of which nothing is known
    assert before["status"] == "safe"
    for i, column in enumerate(columns):
        assert EVIDENCE[column] in [s["id"] for s in rows[i]["signals"]] and rows[i]["score"] < before["score"], column
    roots = spark.createDataFrame([("harbour-cafe.net", True, 5)], "root string, allowlisted boolean, trust_count int")
    http = spark.createDataFrame([(1, "http://harbour-cafe.net/", 7)], "url_id long, url string, tab_id long")
    assert scoring.url_verdicts(http, evidence=[(roots.drop("trust_count"), "root")]).first()["score"] >= 85
    assert scoring.url_verdicts(http, evidence=[(roots.drop("allowlisted"), "root")]).first()["score"] >= 70
    relay = spark.createDataFrame([(7, True)], "tab_id long, flow_relay boolean")
    row = scoring.url_verdicts(http, evidence=[(roots, "root"), (relay, "tab_id")]).first()
    assert "external-post" in [r["id"] for r in row["rules"]] and row["status"] == "dangerous"  # allowed roots are no shield
