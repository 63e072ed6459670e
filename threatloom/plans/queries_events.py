"""Queries over events, activity, reports, sources, sinks and streams, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import events, feeds, scoring
from ..sources import readers, sinks
from ..sources.shared import shared_path
from ..streaming import streams
from . import inputs as I
from . import oracle_parts as O
from .queries import blocklist, evidence, feed_table, query, url_table, verdicts


def navigation(spark, sf) -> DataFrame:
    return I.derived(spark, sf, I.NAVIGATION)


def steps(spark, sf) -> DataFrame:
    return I.derived(spark, sf, I.STEPS)


_NAV = f"WITH nav AS ({I.NAVIGATION})"
_CHAINS = _NAV + ", c AS (SELECT *, sum(CASE WHEN kind = 'navigate' THEN 1 ELSE 0 END) OVER (PARTITION BY tab_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS chain_no FROM nav), chains AS (SELECT tab_id, CAST(chain_no AS BIGINT) AS chain_no, list(url ORDER BY ts, seq) AS urls FROM c GROUP BY tab_id, chain_no)"


@query("w1_redirect_chains", _CHAINS + "SELECT tab_id, chain_no, least(25, len(urls)) AS n_hops, urls[-1] AS last_url FROM chains")
def w1(spark, sf):
    return events.redirect_chains(navigation(spark, sf)).select("tab_id", "chain_no", "n_hops", F.element_at("urls", -1).alias("last_url"))


@query("w2_redirect_signals", _CHAINS + ", r AS (SELECT tab_id, chain_no, len(urls[-25:]) AS n_hops, len(list_distinct(list_transform(urls[-25:], lambda u: array_to_string(string_split(regexp_extract(u, '://([^/]*)', 1), '.')[-2:], '.')))) AS chain_roots FROM chains) SELECT tab_id, chain_no, n_hops, chain_roots, CASE WHEN n_hops > 3 THEN least(1e0, (n_hops - 3) / 5) END AS long_conf, CASE WHEN chain_roots >= 3 THEN 0.8e0 END AS cross_conf FROM r")
def w2(spark, sf):
    return events.redirect_facts(events.redirect_chains(navigation(spark, sf))).drop("urls")


@query("w3_scan_dedupe", _NAV + ", l AS (SELECT *, lag(url) OVER (PARTITION BY tab_id ORDER BY ts, seq) AS b FROM nav) SELECT tab_id, seq, url FROM l WHERE url IS DISTINCT FROM b")
def w3(spark, sf):
    return events.scan_dedupe(navigation(spark, sf)).select("tab_id", "seq", "url")


_FLOWS = f"WITH {O.FLOWS} SELECT flow_id, seq, n_steps, flow_relay, flow_token_drift, flow_iframe_swap, flow_redirect_storm, flow_mfa_split FROM flow_rows"


@query("w4_auth_flow_anomalies", _FLOWS)
def w4(spark, sf):
    return events.auth_flows(steps(spark, sf)).select("flow_id", "seq", "n_steps", *streams._FLAGS)


_WARN = "SELECT 'h' || (event_id % 20) || '.example' AS host, event_type AS kind, ts, event_id AS seq FROM events"


@query("w5_warning_cooldown", f"WITH RECURSIVE w AS ({_WARN}), shown AS (SELECT host, kind, min(ts) AS ts FROM w GROUP BY host, kind UNION ALL SELECT s.host, s.kind, (SELECT min(w.ts) FROM w WHERE w.host = s.host AND w.kind = s.kind AND w.ts >= s.ts + INTERVAL 30 MINUTES) AS ts FROM shown s WHERE s.ts IS NOT NULL) SELECT host, kind, count(ts) AS n_shown, min(ts) AS first_shown, max(ts) AS last_shown FROM shown GROUP BY host, kind")
def w5(spark, sf):
    shown = events.cooldown(I.derived(spark, sf, _WARN))
    return shown.groupBy("host", "kind").agg(F.count(F.lit(1)).alias("n_shown"), F.min("ts").alias("first_shown"), F.max("ts").alias("last_shown"))


_CALLS = "SELECT event_id % 50 AS key, ts FROM events"


# a call by the last three allowed ones before it, from the first call of each key on
@query("w6_rate_budget", f"""WITH RECURSIVE calls AS ({_CALLS}), c AS (SELECT key, ts, row_number() OVER (PARTITION BY key ORDER BY ts) AS i, count(*) OVER (PARTITION BY key) AS n FROM calls),
r AS (SELECT key, 0::BIGINT AS i, NULL::TIMESTAMP AS a, NULL::TIMESTAMP AS b, NULL::TIMESTAMP AS c, 0::BIGINT AS allowed FROM c WHERE i = 1 UNION ALL SELECT r.key, c.i, CASE WHEN ok THEN r.b ELSE r.a END, CASE WHEN ok THEN r.c ELSE r.b END, CASE WHEN ok THEN c.ts ELSE r.c END, r.allowed + ok::INT FROM r JOIN c ON c.key = r.key AND c.i = r.i + 1, LATERAL (SELECT r.a IS NULL OR r.a < c.ts - INTERVAL 3600 SECONDS AS ok))
SELECT key, max(i) AS n_calls, max(allowed) AS n_allowed FROM r GROUP BY key""")
def w6(spark, sf):
    return events.rate_budget(I.derived(spark, sf, _CALLS), 3, 3600.0)


# joins as of a time ---------------------------------------------------------------------------------

_ASOF = "WITH req AS (SELECT event_id AS request_id, 'u' || (event_id % 40) AS url, ts FROM events WHERE event_id % 2 = 0), cache AS (SELECT 'u' || (event_id % 40) AS url, ts AS cached_at, ts + INTERVAL 15 MINUTES AS expires_at, CASE WHEN event_id % 3 = 0 THEN 'safe' ELSE 'suspicious' END AS status FROM events WHERE event_id % 2 = 1 AND event_id % 4 = 1)"


@query("j9_verdict_cache_asof", _ASOF + "SELECT r.request_id, r.url, CASE WHEN c.expires_at > r.ts THEN c.status END AS cached_status FROM req r ASOF LEFT JOIN cache c ON r.url = c.url AND r.ts >= c.cached_at")
def j9(spark, sf):
    table = spark.read.parquet(f"{sf}/events.parquet")
    requests = table.where("event_id % 2 = 0").selectExpr("event_id AS request_id", "'u' || (event_id % 40) AS url", "ts")
    cache = table.where("event_id % 4 = 1").selectExpr("'u' || (event_id % 40) AS url", "ts AS cached_at", "ts + INTERVAL 15 MINUTES AS expires_at", "CASE WHEN event_id % 3 = 0 THEN 'safe' ELSE 'suspicious' END AS status")
    return events.verdict_asof(requests, cache)


# reports --------------------------------------------------------------------------------------------


_BUMPS = "SELECT 'r' || (event_id % 30) AS root, ts, event_id AS seq, CASE WHEN event_type = 'error' THEN -1 ELSE 1 END AS step FROM events"


@query("g2_learned_safe_counts", f"WITH b AS ({_BUMPS}) SELECT root, least(50, count(*)) AS trust_count, max(ts) AS last_ts FROM b WHERE step = 1 GROUP BY root")
def g2(spark, sf):
    return events.learned_safe(I.derived(spark, sf, _BUMPS).where("step = 1"))


@query("g2_trust_decay", f"""WITH RECURSIVE b AS (SELECT root, step, row_number() OVER (PARTITION BY root ORDER BY ts, seq) AS i FROM ({_BUMPS}) x),
r AS (SELECT DISTINCT root, 0::BIGINT AS i, 0 AS trust FROM b UNION ALL SELECT r.root, b.i, greatest(0, least(50, r.trust + b.step)) FROM r JOIN b ON b.root = r.root AND b.i = r.i + 1)
SELECT root, CAST(max_by(trust, i) AS BIGINT) AS trust_count FROM r GROUP BY root""")
def g2_decay(spark, sf):
    return events.learned_safe_decay(I.derived(spark, sf, _BUMPS))


@query("g3_activity_from_verdicts", O.TO_VERDICTS + "SELECT status, count(*) AS n, min(score)::INT AS least, max(score)::INT AS most FROM verdicts WHERE status <> 'safe' GROUP BY status")
def g3(spark, sf):
    return verdicts(spark, sf).where("status <> 'safe'").groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"), F.max("score").alias("most"))


@query("g4_top_signals", O.TO_VERDICTS + "SELECT url_id, array_to_string(list_transform(list_sort(list_transform(signals, lambda s: struct_pack(c := s.contribution, p := s.place, id := s.id)))[1:2], lambda s: s.id), ',') AS top FROM verdicts")
def g4(spark, sf):
    return scoring.top_signals(verdicts(spark, sf)).select("url_id", F.array_join("top", ",").alias("top"))


_RISKS = "list_transform(list_sort(list_transform(list_filter(signals, lambda s: s.contribution < 0), lambda s: struct_pack(r := CASE s.severity WHEN 'critical' THEN -4 WHEN 'high' THEN -3 WHEN 'medium' THEN -2 WHEN 'low' THEN -1 ELSE 0 END, c := s.contribution, p := s.place, id := s.id)))[1:5], lambda s: s.id)"
_TRUSTED = "CASE WHEN valid THEN list_filter([" + ", ".join(f"CASE WHEN {cond} THEN '{i}' END" for i, _, cond in scoring.R.TRUST) + "], lambda x: x IS NOT NULL)[1:5] ELSE [] END"
_BY_CAP = "list_transform(list_sort(list_transform(rules, lambda r, i: struct_pack(cap := r.cap, i := i, id := r.id))), lambda r: r.id)"


@query("g5_explain_risks", O.TO_VERDICTS + f"SELECT url_id, array_to_string({_RISKS}, ',') AS risks, array_to_string({_TRUSTED}, ',') AS trust, array_to_string({_BY_CAP}, ',') AS rules FROM verdicts")
def g5(spark, sf):
    rows = scoring.explained(verdicts(spark, sf))
    return rows.select("url_id", *[F.array_join(c, ",").alias(a) for c, a in (("risks", "risks"), ("trust", "trust"), ("rules_by_cap", "rules"))])


#: Plain phrases of signals and of what earns trust, for readers of a report.
PHRASES = {
    "no-https": "Anything typed here could be read on the way.", "userinfo": "The address begins with a user name, which hides the real site.", "ip-host": "The site has a bare number for a name.",
    "lookalike": "The address looks like that of a well-known site.", "threat-blocklist": "The site is on a list of known threats.", "brand-subdomain-spoof": "A well-known name stands in front of another site's address.",
    "open-redirect": "The link leads on to another site.", "new-domain": "The site is very new.", "auth-keyword": "The address itself contains sign-in words.", "mixed-script-host": "The address mixes alphabets.",
    "many-dashes": "The address has an odd number of dashes.", "deep-subdomain": "The address has more parts than most.", "long-host": "The address is very long.", "long-redirects": "Many detours led to this page.",
    "cross-domain-redirects": "Several other sites were passed on the way here.", "gsb": "A safe-browsing service warns of this address.", "vt": "Security vendors warn of this address.", "tld-swap": "A known name stands here with another ending.",
    "abused-tld": "Addresses with this ending are often abused.", "url-shortener": "A short link hides where it leads.", "phishy-token": "The address has wording that lures use.", "ml-phishing-structure": "The address is built like those of fake pages.",
    "brand-impersonation": "The page bears a well-known name that isn't its own.", "domain-spoofing": "The address passes itself off as another site's.", "form-javascript": "A script decides where the sign-in goes.", "external-form-post": "What is typed here goes to another site.",
    "form-get": "The sign-in would put secrets into the address.", "hidden-login-fields": "The sign-in has fields that nobody sees.", "iframe-credential-form": "The sign-in box comes from elsewhere.", "oauth-impersonation": "A sign-in button isn't the provider's own.",
    "auth-phrasing": "The page presses for a sign-in.", "iframe-login": "The sign-in happens inside a frame.", "generic-enterprise-auth": "The page poses as a company sign-in.", "clone": "The page looks like a copy.",
    "authflow:credential-relay": "A sign-in was passed on to another site.", "authflow:oauth-token-drift": "The sign-in came back from another place than it began.", "authflow:iframe-origin-swap": "A frame of the sign-in changed its origin.",
    "authflow:mfa-origin-split": "Password and code were asked for by different sites.", "authflow:redirect-storm": "The sign-in jumped between many sites.",
    "https-trust": "The connection is private.", "known-reputable": "The site is well known.", "trusted-provider": "The site is a known sign-in provider.", "allowlist-trust": "The site is on the list of allowed ones.",
    "learned-safe-trust": "The site was fine before.", "no-auth-risk": "The page asks for no sign-in.", "established-domain": "The site has been there for long.",
}
#: Plain phrases of arbitration rules.
RULE_PHRASES = {
    "threat-blocklist": "The site is on a list of known threats.", "brand-subdomain-creds": "A sign-in borrows a well-known name in its address.", "tld-swap-creds": "A sign-in uses a known name with another ending.", "tld-swap": "A known name stands here with another ending.",
    "brand-subdomain": "A well-known name stands in front of another site's address.", "external-post-clone": "A copied page sends what is typed to another site.", "external-post": "What is typed here goes to another site.", "lookalike-creds": "A sign-in stands on an address that looks like a well-known one.",
    "brand-creds": "A sign-in bears a name that isn't the site's own.", "clone-auth": "A copied page asks for a sign-in.", "idn-creds": "A sign-in stands on an address in mixed alphabets.", "cross-origin-credentials": "The sign-in box belongs to another site.", "oauth-spoof": "The sign-in passes through a wrong place.",
    "mfa-harvest": "An unknown page asks for a code alone.", "auth-layout-clone": "The sign-in is laid out like a known provider's.", "lookalike-strong": "The address is nearly that of a well-known site.", "idn-auth": "The address uses look-alike letters before a sign-in.", "idn": "The address uses look-alike letters.",
    "auth-layout-soft-unknown": "The layout is that of a known sign-in.", "clone-medium": "Much of the page looks copied.", "clone-soft": "Some of the page looks copied.", "brand-text": "The page speaks in the name of another site.", "unknown-login": "Nobody knows who runs this sign-in.", "unknown-auth": "Nobody knows who asks for a sign-in here.",
    "abused-tld-auth": "A sign-in stands on an ending that is often abused.", "hidden-overlay": "Something unseen lies over the page.", "email-first": "An unknown page asks for an e-mail address first.", "auth-layout-soft": "The layout resembles a known sign-in.", "trusted-but-suspicious": "Something is amiss on a site of good name.",
}
CALM = "Nothing speaks against this page."


def _told(ids: str, phrases: dict[str, str]) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in phrases.items())
    return f"list_filter(list_transform({ids}, lambda x: CASE x {cases} END), lambda x: x IS NOT NULL)"


_FIRST_OF_EACH = lambda c: f"list_filter({c}, lambda x, i: list_position({c}, x) = i)[1:4]"


@query("g6_explain_bullets", O.TO_VERDICTS + f""", b0 AS (SELECT url_id, status, list_concat({_told(f"({_RISKS})[1:3]", PHRASES)}, {_told("list_transform(rules, lambda r: r.id)", RULE_PHRASES)}) AS told, {_told(_TRUSTED, PHRASES)} AS trust FROM verdicts), b1 AS (SELECT url_id, status, {_FIRST_OF_EACH("told")} AS told, trust FROM b0),
b2 AS (SELECT url_id, status, CASE WHEN len(told) < 2 THEN list_concat(told, trust) ELSE told END AS told FROM b1), b3 AS (SELECT url_id, status, {_FIRST_OF_EACH("told")} AS told FROM b2) SELECT url_id, CASE WHEN len(told) = 0 AND status = 'safe' THEN '{CALM}' ELSE array_to_string(told, ' | ') END AS bullets FROM b3""")
def g6(spark, sf):
    rows = scoring.bullets(verdicts(spark, sf), PHRASES, RULE_PHRASES, CALM)
    return rows.select("url_id", F.array_join("bullets", " | ").alias("bullets"))


_RECENT = "WITH a AS (SELECT user_id AS profile_id, ts AS seen, event_id AS seq, event_type AS kind, 'h' || (event_id % 20) || '.example' AS host, repeat('because ' || event_id || ' ', event_id % 40) AS reason FROM events), m AS (SELECT max(seen) AS now FROM a), r AS (SELECT a.*, row_number() OVER (PARTITION BY profile_id ORDER BY seen DESC, seq DESC) AS rank FROM a, m WHERE seen >= now - INTERVAL 7 DAYS)"


@query("g7_recent_activity", _RECENT + "SELECT profile_id, seq, kind, host, left(reason, 256) AS reason, CAST(rank AS INT) AS rank, rank <= 20 AS shown FROM r WHERE rank <= 200")
def g7(spark, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet").selectExpr("user_id AS profile_id", "ts AS at", "event_id AS seq", "event_type AS kind", "concat('h', event_id % 20, '.example') AS host", "repeat(concat('because ', event_id, ' '), CAST(event_id % 40 AS INT)) AS reason", "concat('https://h.example/', event_id) AS url")
    return events.recent_activity(rows, rows.agg(F.max("at")).scalar()).select("profile_id", "seq", "kind", "host", "reason", "rank", "shown")


@query("g8_activity_sweep", "WITH m AS (SELECT max(ts) AS now FROM events) SELECT count(*) FILTER (WHERE ts >= now - INTERVAL 7 DAYS) AS kept, count(*) FILTER (WHERE ts < now - INTERVAL 7 DAYS) AS removed FROM events, m")
def g8(spark, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet")
    old = F.col("ts") < rows.agg(F.max("ts")).scalar() - F.expr("INTERVAL 7 DAYS")
    return rows.select(old.alias("old")).agg(F.count_if(~F.col("old")).alias("kept"), F.count_if(F.col("old")).alias("removed"))


@query("g9_latency_profile", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, count(*) AS n, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, max(CASE WHEN r = least(n - 1, floor(n * 0.95)) THEN value END) AS p95 FROM r GROUP BY event_type")
def g9(spark, sf):
    rows = events.latency_profile(spark.read.parquet(f"{sf}/events.parquet"), "value", "event_type")
    return rows.withColumn("mean", F.round("mean", 6))


#: URLs of the inputs that are hostile by how they are made, and those that aren't.
_BAD, _GOOD = "url_id % 24 IN (8, 9, 10, 17, 18, 21, 22, 23)", "url_id % 24 < 8"


@query("g10_replay_metrics", O.TO_VERDICTS + f"SELECT count(*) FILTER (WHERE {_BAD}) AS n_bad, round(avg(CASE WHEN status <> 'safe' THEN 1.0 ELSE 0.0 END) FILTER (WHERE {_BAD}), 6) AS recall, round(avg(CASE WHEN status = 'dangerous' THEN 1.0 ELSE 0.0 END) FILTER (WHERE {_GOOD}), 6) AS false_positive_rate FROM verdicts")
def g10(spark, sf):
    """Live verdicts against what is known of the URLs: recall of hostile ones, and how many others are called dangerous."""
    rate = lambda hit, of: F.round(F.avg(F.when(F.expr(of), F.when(hit, 1.0).otherwise(0.0))), 6)
    status = F.col("status")
    return verdicts(spark, sf).agg(F.count_if(F.expr(_BAD)).alias("n_bad"), rate(status != "safe", _BAD).alias("recall"), rate(status == "dangerous", _GOOD).alias("false_positive_rate"))


# sources and sinks ----------------------------------------------------------------------------------


@query("s1_read_feed_lines", O.TO_FEED + "SELECT feed_id, count(*) AS n_lines, count(DISTINCT line) AS n_distinct FROM feed GROUP BY feed_id")
def s1(spark, sf):
    path = shared_path(spark, "feeds")
    for feed in ("urlhaus", "phishing-army", "openphish"):
        feed_table(spark, sf).where(F.col("feed_id") == feed).select("line").write.text(f"{path}/{feed}")
    lines = readers.read_feed_lines(spark, [f"{path}/{f}" for f in ("urlhaus", "phishing-army", "openphish")])
    return lines.groupBy("feed_id").agg(F.count(F.lit(1)).alias("n_lines"), F.countDistinct("line").alias("n_distinct"))


_PACKED = f"list_reduce(list_transform(docs, lambda d: [d]), lambda a, d: CASE WHEN length(a[-1]) + length(d[1]) + 2 <= {readers.MAX_TEXT} THEN a[1:-2] || [a[-1] || chr(10) || d[1]] ELSE a || d END)"


@query("s2_read_upload_files", f"WITH g AS (SELECT doc_id // 64 AS g, list(text ORDER BY doc_id, text) AS docs FROM documents WHERE text IS NOT NULL GROUP BY 1), f AS (SELECT unnest({_PACKED}) AS value FROM g) SELECT least(length(value) + 1, {readers.MAX_TEXT}) AS n_chars, strlen(value) + 1 AS size FROM f WHERE strlen(value) + 1 <= {readers.MAX_FILE}")
def s2(spark, sf):
    path = shared_path(spark, "uploads")
    rows = spark.read.parquet(f"{sf}/documents.parquet").where("text IS NOT NULL")
    groups = rows.groupBy(F.expr("coalesce(doc_id DIV 64, xxhash64(text))").alias("g")).agg(F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("docs"))

    # neighbours share a file up to the reader's limit, so that it bites only on documents that are oversize themselves
    def pack(files, doc):
        last = F.try_element_at(files, F.lit(-1))
        fits = F.length(last) + F.length(doc["text"]) + 2 <= readers.MAX_TEXT
        return F.when(fits, F.concat(F.slice(files, 1, F.size(files) - 1), F.array(F.concat(last, F.lit("\n"), doc["text"])))).otherwise(F.concat(files, F.array(doc["text"])))

    packed = groups.select(F.explode(F.aggregate("docs", F.array().cast("array<string>"), pack)).alias("value"))
    packed.write.option("maxRecordsPerFile", 1).text(path)
    files = readers.read_upload_files(spark, path)
    return files.select(F.length("text").cast("long").alias("n_chars"), "size")


@query("s3_read_pages", "SELECT page_id, url, length(left(html, 400000)) AS n_chars FROM pages WHERE length(html) >= 200")
def s3(spark, sf):
    return readers.read_pages(spark, f"{sf}/pages.parquet").select("page_id", "url", F.length("html").cast("long").alias("n_chars"))


@query("s4_write_block_snapshot", O.TO_FEED + ", m AS (SELECT DISTINCT host FROM feed_hosts WHERE host IS NOT NULL) SELECT host FROM m WHERE host NOT IN " + O.KEPT + " AND " + O.root_of("host") + " NOT IN " + O.KEPT)
def s4(spark, sf):
    path = shared_path(spark, "snapshot")
    sinks.write_block_snapshot(feeds.snapshot(feed_table(spark, sf)), path)
    return spark.read.text(path).withColumnRenamed("value", "host")


_ADS = O.TO_FEED + r""", a0 AS (SELECT lower(trim(line)) AS t FROM feed), a1 AS (SELECT t, regexp_extract(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '^\|\|', ''), '[\^/].*$', ''), '^(0\.0\.0\.0|127\.0\.0\.1)\s+', ''), '^www\.', ''), '^(\S*)', 1) AS d FROM a0),
ads AS (SELECT DISTINCT d FROM a1 WHERE NOT regexp_matches(t, '^[#!]') AND contains(d, '.') AND NOT regexp_matches(d, '[^a-z0-9.-]') AND length(d) <= 253)"""


@query("s5_write_dnr_rules", _ADS + f", kept AS (SELECT row_number() OVER (ORDER BY d) - 1 AS i FROM ads WHERE d NOT IN {O.KEPT} AND {O.root_of('d')} NOT IN {O.KEPT}) SELECT i // 50 + 1 AS id, 'block' AS type, count(*) AS n_domains FROM kept WHERE i < 6000 GROUP BY 1")
def s5(spark, sf):
    path = shared_path(spark, "rules")
    sinks.write_dnr_rules(feeds.ad_rules(feed_table(spark, sf), chunk=50), path, least=20)  # made-up feeds are short
    return spark.read.json(path).select("id", "action.type", F.size("condition.requestDomains").cast("long").alias("n_domains"))


@query("s6_write_verdicts", O.TO_VERDICTS + "SELECT 'eval:' || url || ':url' AS key, CAST(score AS INT) AS score, status FROM verdicts")
def s6(spark, sf):
    path = shared_path(spark, "verdicts")
    rows = verdicts(spark, sf).withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("url_id")))
    sinks.write_verdicts(rows, path, "at", dom=False)
    return spark.read.parquet(path).where("expires_at > cached_at").select("key", "score", "status")


@query("s7_write_model")
def s7(spark, sf):
    from ..operators import classifier
    from .queries_text import corpus

    path = shared_path(spark, "model")
    sinks.write_model(spark, classifier.train(corpus(spark, sf)), path)
    return spark.read.json(path).select("bias", F.to_json("weights").alias("weights"))


# streams --------------------------------------------------------------------------------------------


def event_stream(spark, sf, text: str) -> DataFrame:
    """The events table as a stream, dressed up like the batch input ``text``."""
    table = spark.read.parquet(f"{sf}/events.parquet")
    path = shared_path(spark, "events")
    table.write.parquet(path)
    body, _, _ = text.partition(" FROM events")
    return spark.readStream.schema(table.schema).parquet(path).selectExpr(*_columns(body.removeprefix("SELECT ")))


def _columns(body: str) -> list[str]:
    """The select list of a query as single expressions."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(body):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(body[start:i])
            start = i + 1
    return [x.strip() for x in [*out, body[start:]]]


def _streamed(spark, sf, text, operator, name: str, mode: str = "append") -> DataFrame:
    path = shared_path(spark, name)
    streams.run_to(operator(event_stream(spark, sf, text)), path, mode)
    return spark.read.parquet(path)


@query("t1_stream_redirect_chains", _NAV + ", c AS (SELECT *, sum(CASE WHEN kind = 'navigate' THEN 1 ELSE 0 END) OVER (PARTITION BY tab_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS chain_no FROM nav) SELECT tab_id, seq, CAST(chain_no AS BIGINT) AS chain_no, least(25, row_number() OVER (PARTITION BY tab_id, chain_no ORDER BY ts, seq)) AS n_hops FROM c")
def t1(spark, sf):
    return _streamed(spark, sf, I.NAVIGATION, streams.redirect_chains, "chains")


@query("t2_stream_auth_flow", _FLOWS)
def t2(spark, sf):
    return _streamed(spark, sf, I.STEPS, streams.auth_flows, "flows")


@query("t3_stream_cooldown", "WITH RECURSIVE" + f" w AS ({_WARN}), shown AS (SELECT host, kind, min(ts) AS ts FROM w GROUP BY host, kind UNION ALL SELECT s.host, s.kind, (SELECT min(w.ts) FROM w WHERE w.host = s.host AND w.kind = s.kind AND w.ts >= s.ts + INTERVAL 30 MINUTES) AS ts FROM shown s WHERE s.ts IS NOT NULL) SELECT host, kind, count(ts) AS n_shown, max(ts) AS last_shown FROM shown GROUP BY host, kind")
def t3(spark, sf):
    return _streamed(spark, sf, _WARN, streams.cooldown, "cooldown").groupBy("host", "kind").agg(F.count(F.lit(1)).alias("n_shown"), F.max("ts").alias("last_shown"))


@query("t4_stream_dedupe", "SELECT count(DISTINCT event_id // 2) AS n FROM events")
def t4(spark, sf):
    rows = _streamed(spark, sf, "SELECT event_id DIV 2 AS nonce, ts FROM events", lambda s: streams.dedupe(s, "nonce", "365 days"), "dedupe")
    return rows.agg(F.count(F.lit(1)).alias("n"))


# only intervals that the watermark (an hour behind the latest event) has passed are out
@query("t5_stream_metrics", "SELECT date_trunc('hour', ts) AS start, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def t5(spark, sf):
    rows = _streamed(spark, sf, "SELECT ts, event_type AS kind FROM events", streams.metrics, "metrics")
    return rows.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("t6_stream_verdicts", O.TO_VERDICTS + "SELECT url_id, host, CAST(score AS INT) AS score, status FROM verdicts WHERE status <> 'safe'")
def t6(spark, sf):
    source, path = shared_path(spark, "urls"), shared_path(spark, "activity")
    table = url_table(spark, sf)
    table.write.parquet(source)
    streams.verdicts_to(spark.readStream.schema(table.schema).parquet(source), blocklist(spark, sf), path, evidence(spark, sf))
    return spark.read.parquet(path).select("url_id", "host", "score", "status")


@query("t7_stream_activity_retention", "SELECT count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 7 DAYS")
def t7(spark, sf):
    rows = _streamed(spark, sf, "SELECT ts, event_id FROM events", lambda s: streams.retained(s, "2024-01-20 00:00:00"), "retained")
    return rows.agg(F.count(F.lit(1)).alias("n"))


@query("t8_stream_feed_refresh", O.TO_FEED + "SELECT DISTINCT host FROM feed_hosts WHERE host IS NOT NULL")
def t8(spark, sf):
    source, path = shared_path(spark, "feedlines"), shared_path(spark, "sets")
    table = feed_table(spark, sf)
    table.write.parquet(source)
    streams.feeds_to(spark, spark.readStream.schema(table.schema).parquet(source), path)
    return streams.feed_set(spark, path).select("host")
