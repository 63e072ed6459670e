"""Queries of the web-threat and data-leak operators over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import events, feeds, scoring, urls
from ..sources.shared import kept
from . import inputs as I
from . import oracle_parts as O

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def url_table(spark: SparkSession, sf: str) -> DataFrame:
    return I.derived(spark, sf, I.URLS)


def feed_table(spark: SparkSession, sf: str) -> DataFrame:
    return I.derived(spark, sf, I.FEED)


def blocklist(spark: SparkSession, sf: str) -> DataFrame:
    """Hosts of all feeds."""
    lines = feed_table(spark, sf)
    return lines.select(feeds.feed_host(F.col("line")).alias("host"), F.lit("feed").alias("source")).where("host IS NOT NULL").distinct()


def evidence(spark: SparkSession, sf: str) -> list[tuple[DataFrame, str]]:
    """What the tables tell of URLs beside themselves: the last redirect chain and the sign-in flow of their tab, an
    outside service's findings, roots that were trusted before and roots that are allowed."""
    chains = events.redirect_facts(events.redirect_chains(I.derived(spark, sf, I.NAVIGATION)))
    chains = chains.groupBy("tab_id").agg(F.max_by(F.struct(F.col("n_hops").alias("hops"), "chain_roots"), "chain_no").alias("c")).select("tab_id", "c.*")
    flags = [f"flow_{k}" for k in ("relay", "token_drift", "iframe_swap", "mfa_split", "redirect_storm")]
    flows = events.auth_flows(I.derived(spark, sf, I.STEPS))
    flows = flows.groupBy(F.col("flow_id").alias("tab_id")).agg(F.max_by(F.struct(*flags), F.struct("ts", "seq")).alias("f")).select("tab_id", "f.*")
    roots = lambda text: urls.url_parts(I.derived(spark, sf, text)).where("valid").select("root")
    learned = events.learned_safe(roots(I.TRUSTED_HOSTS).withColumn("ts", F.lit(0))).drop("last_ts")
    allowed = roots(I.ALLOWED_HOSTS).distinct().withColumn("allowlisted", F.lit(True))
    tables = ((chains, "tab_id"), (flows, "tab_id"), (I.derived(spark, sf, I.EXTERNAL), "url"), (learned, "root"), (allowed, "root"))
    return [(table, key, True) for table, key in tables]  # each is grouped by its key


def facts(spark: SparkSession, sf: str) -> DataFrame:
    return urls.url_facts(url_table(spark, sf), blocklist(spark, sf), evidence(spark, sf))


def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts of all URLs. The facts, with their dozen joins, are a table first: each stage of an adaptive plan would plan the
    many steps of the score anew."""
    return scoring.score(kept(facts(spark, sf), "url-facts"))


def ids(column):
    return F.array_join(F.transform(column, lambda x: x["id"]), ",")


# hosts and URLs -------------------------------------------------------------------------------------


@query("u1_url_parts", O.TO_PARTS + "SELECT url_id, scheme, userinfo, hostname, host, path, query, valid FROM parts")
def u1(spark, sf):
    return urls.url_parts(url_table(spark, sf)).select("url_id", "scheme", "userinfo", "hostname", "host", "path", "query", "valid")


@query("u2_root_domain", O.TO_PARTS + "SELECT url_id, host, root, tld FROM parts")
def u2(spark, sf):
    return urls.url_parts(url_table(spark, sf)).select("url_id", "host", "root", "tld")


@query("u3_unicode_host", "WITH " + ",\n".join((O.URLS, O.PARTS, O.LOOK)) + "SELECT hostname, host_unicode FROM look")
def u3(spark, sf):
    return urls.unicode_hosts(urls.url_parts(url_table(spark, sf))).select("hostname", "host_unicode")


@query("u4_homoglyph_normalize", "WITH " + ",\n".join((O.URLS, O.PARTS, O.LOOK)) + "SELECT hostname, root_unicode, root_normal FROM look")
def u4(spark, sf):
    return urls.lookalikes(urls.unicode_hosts(urls.url_parts(url_table(spark, sf)))).select("hostname", "root_unicode", "root_normal")


def _one_signal(*wanted: str) -> str:
    return O.TO_FACTS + ",\n" + O.SIGNALS + "SELECT url_id, s.id AS signal_id, s.weight AS weight, round(s.confidence, 6) AS confidence, s.contribution AS contribution FROM (SELECT url_id, unnest(url_signals) AS s FROM sig WHERE valid) WHERE s.id IN " + O.members(wanted)


def _signal_query(name: str, *wanted: str):
    def run(spark, sf):
        rows = facts(spark, sf).where("valid").select("url_id", F.explode(urls.signals()).alias("s")).where(F.col("s.id").isin(*wanted))
        return rows.select("url_id", F.col("s.id").alias("signal_id"), "s.weight", F.round("s.confidence", 6).alias("confidence"), "s.contribution")

    query(name, _one_signal(*wanted))(run)


_signal_query("u5_url_structure_signals", "no-https", "userinfo", "ip-host", "many-dashes", "deep-subdomain", "long-host", "auth-keyword")
_signal_query("u6_new_domain_signal", "new-domain")
_signal_query("u7_abused_tld", "abused-tld")
_signal_query("u8_url_shortener", "url-shortener")
_signal_query("u9_brand_subdomain_spoof", "brand-subdomain-spoof")
_signal_query("u10_tld_swap", "tld-swap")
_signal_query("u11_phishy_token", "phishy-token")
_signal_query("u12_mixed_script_host", "mixed-script-host")


@query("u13_open_redirect", "WITH " + ",\n".join((O.URLS, O.PARTS, O.REDIR)) + "SELECT url_id, redirect_param, redirect_host, redirect_risky FROM redir")
def u13(spark, sf):
    return urls.open_redirects(urls.url_parts(url_table(spark, sf))).where("redirect_host IS NOT NULL").select("url_id", "redirect_param", "redirect_host", "redirect_risky")


@query("u14_reputation_class", "WITH " + ",\n".join((O.URLS, O.PARTS, O.REP)) + "SELECT url_id, root, reputable, provider, safelist_kind FROM rep")
def u14(spark, sf):
    return urls.reputation(urls.url_parts(url_table(spark, sf))).select("url_id", "root", "reputable", "provider", "safelist_kind")


# joins ----------------------------------------------------------------------------------------------


@query("j1_blocklist_match", O.TO_FACTS + "SELECT url_id, host, matched_host FROM facts WHERE blocklisted")
def j1(spark, sf):
    return feeds.blocklist_match(urls.url_parts(url_table(spark, sf)), blocklist(spark, sf)).where("blocklisted").select("url_id", "host", "matched_host")


_LOOK = "WITH " + ",\n".join((O.URLS, O.PARTS, O.LOOK))


@query("j2_lookalike_typo", _LOOK + "SELECT hostname, lookalike_brand, lookalike_distance::INT AS lookalike_distance FROM look WHERE lookalike_kind = 'typo'")
def j2(spark, sf):
    return urls.lookalikes(urls.unicode_hosts(urls.url_parts(url_table(spark, sf)))).where("lookalike_kind = 'typo'").select("hostname", "lookalike_brand", "lookalike_distance")


def brand_table(spark) -> DataFrame:
    return spark.createDataFrame(list(enumerate(urls.C.LOOKALIKE_BRANDS)), "place int, brand string")


@query("j2_lookalike_index", _LOOK + "SELECT hostname, lookalike_kind, lookalike_brand, round(lookalike_conf, 6) AS lookalike_conf FROM look")
def j2_index(spark, sf):
    """All look-alikes by the index for brand lists of any size, here that of the fixed list."""
    rows = urls.lookalikes_of(urls.unicode_hosts(urls.url_parts(url_table(spark, sf))), brand_table(spark))
    return rows.select("hostname", "lookalike_kind", "lookalike_brand", F.round("lookalike_conf", 6).alias("lookalike_conf"))


@query("j3_lookalike_brand_in_host", _LOOK + "SELECT hostname, lookalike_brand, lookalike_conf FROM look WHERE lookalike_kind = 'brand-in-host'")
def j3(spark, sf):
    return urls.lookalikes(urls.unicode_hosts(urls.url_parts(url_table(spark, sf)))).where("lookalike_kind = 'brand-in-host'").select("hostname", "lookalike_brand", "lookalike_conf")


@query("j4_lookalike_verdict", _LOOK + "SELECT hostname, lookalike_kind, lookalike_brand, round(lookalike_conf, 6) AS lookalike_conf FROM look")
def j4(spark, sf):
    return urls.lookalikes(urls.unicode_hosts(urls.url_parts(url_table(spark, sf)))).select("hostname", "lookalike_kind", "lookalike_brand", F.round("lookalike_conf", 6).alias("lookalike_conf"))


@query("j5_never_block_filter", O.TO_FEED + f"SELECT DISTINCT host FROM feed_hosts WHERE host IS NOT NULL AND host NOT IN {O.KEPT} AND {O.root_of('host')} NOT IN {O.KEPT}")
def j5(spark, sf):
    return feed_table(spark, sf).select(feeds.feed_host(F.col("line")).alias("host")).where("host IS NOT NULL").where(~feeds.never_listed(F.col("host"))).distinct()


# (url, malicious flag, engines) that an outside service reported, derived from the URLs
_EXTERNAL = "SELECT DISTINCT url, url_id % 9 = 0 AS malicious, CASE WHEN url_id % 5 = 0 THEN url_id % 7 ELSE 0 END AS engines FROM urls WHERE url_id % 3 = 0"
_J6 = """SELECT url_id, CASE WHEN malicious THEN 90 ELSE 0 END AS gsb_weight, CASE WHEN engines > 0 THEN round(least(1e0, 0.4 + engines * 0.15), 6) ELSE 0e0 END AS vt_conf FROM urls JOIN external USING (url) WHERE malicious OR engines > 0"""


@query("j6_external_reputation_join", f"WITH {O.URLS}, external AS ({_EXTERNAL}) {_J6}")
def j6(spark, sf):
    table = url_table(spark, sf)
    external = table.where("url_id % 3 = 0").selectExpr("url", "url_id % 9 = 0 AS malicious", "CASE WHEN url_id % 5 = 0 THEN url_id % 7 ELSE 0 END AS engines").distinct()
    hit = table.join(external, "url").where("malicious OR engines > 0")
    return hit.select("url_id", F.when(F.col("malicious"), 90).otherwise(0).alias("gsb_weight"), F.when(F.col("engines") > 0, F.round(F.least(F.lit(1.0), 0.4 + F.col("engines") * 0.15), 6)).otherwise(0.0).alias("vt_conf"))


@query("j7_learned_safe_join", O.TO_PARTS + ", stats AS (SELECT root, least(50, count(*)) AS n FROM parts WHERE valid GROUP BY root) SELECT url_id, root, n AS trust_count, CASE WHEN n >= 3 THEN 70 ELSE 0 END AS floor_score, CASE WHEN n >= 3 THEN least(20, 8 + 2 * n) ELSE 0 END AS points FROM parts LEFT JOIN stats USING (root) WHERE valid")
def j7(spark, sf):
    parts = urls.url_parts(url_table(spark, sf)).where("valid")
    stats = parts.groupBy("root").agg(F.least(F.lit(50), F.count(F.lit(1))).alias("trust_count"))
    return parts.join(stats, "root", "left").selectExpr("url_id", "root", "trust_count", "CASE WHEN trust_count >= 3 THEN 70 ELSE 0 END AS floor_score", "CASE WHEN trust_count >= 3 THEN least(20, 8 + 2 * trust_count) ELSE 0 END AS points")


@query("j8_allowlist_join", O.TO_PARTS + ", allowed AS (SELECT DISTINCT root FROM parts WHERE valid AND url_id % 10 = 0) SELECT url_id, root, a.root IS NOT NULL AS allowlisted, CASE WHEN a.root IS NOT NULL THEN 85 ELSE 0 END AS floor_score FROM parts p LEFT JOIN allowed a USING (root) WHERE valid")
def j8(spark, sf):
    parts = urls.url_parts(url_table(spark, sf)).where("valid")
    allowed = parts.where("url_id % 10 = 0").select("root", F.lit(True).alias("_a")).distinct()
    out = parts.join(allowed, "root", "left").withColumn("allowlisted", F.coalesce("_a", F.lit(False)))
    return out.selectExpr("url_id", "root", "allowlisted", "CASE WHEN allowlisted THEN 85 ELSE 0 END AS floor_score")


# scoring --------------------------------------------------------------------------------------------


@query("a1_signal_contributions", O.TO_FACTS + ",\n" + O.SIGNALS + "SELECT url_id, s.place AS place, s.id AS signal_id, s.category AS category, s.severity AS severity, s.contribution AS contribution FROM (SELECT url_id, unnest(list_transform(signals, lambda s, i: struct_pack(place := i - 1, id := s.id, category := s.category, severity := s.severity, contribution := s.contribution))) AS s FROM (SELECT url_id, url_signals AS signals FROM sig WHERE valid))")
def a1(spark, sf):
    rows = facts(spark, sf).where("valid").select("url_id", F.posexplode(urls.signals()).alias("place", "s"))
    return rows.select("url_id", F.col("place").cast("long").alias("place"), F.col("s.id").alias("signal_id"), "s.category", "s.severity", "s.contribution")


@query("a2_trust_score", O.TO_VERDICTS + "SELECT url_id, CAST(trust_gain AS INT) AS trust_gain, CAST(penalty AS BIGINT) AS penalty, CAST(base_score AS INT) AS base_score, CAST(score AS INT) AS score, status FROM verdicts WHERE valid")
def a2(spark, sf):
    return verdicts(spark, sf).where("valid").select("url_id", F.col("trust_gain").cast("int").alias("trust_gain"), "penalty", "base_score", "score", "status")


@query("a3_arbitrate", O.TO_VERDICTS + "SELECT url_id, array_to_string(list_transform(rules, lambda r: r.id), ',') AS rules, arb_cap, arb_force, trust_floor FROM verdicts WHERE valid")
def a3(spark, sf):
    return verdicts(spark, sf).where("valid").select("url_id", ids("rules").alias("rules"), "arb_cap", "arb_force", "trust_floor")


@query("a6_suspicion_band", O.TO_VERDICTS + "SELECT url_id, level, CASE WHEN level = 'dangerous' THEN 'hard' WHEN level = 'highRisk' THEN 'soft' ELSE 'none' END AS modal, CASE WHEN level IN ('dangerous', 'highRisk') THEN 'red' WHEN level = 'informational' THEN 'green' ELSE 'amber' END AS badge FROM verdicts WHERE valid")
def a6(spark, sf):
    return verdicts(spark, sf).where("valid").select("url_id", "level", "modal", "badge")


@query("a7_verdict_confidence", O.TO_VERDICTS + "SELECT url_id, confidence, phishing_confidence FROM verdicts WHERE valid")
def a7(spark, sf):
    return verdicts(spark, sf).where("valid").select("url_id", "confidence", "phishing_confidence")


@query("a8_presentation", O.TO_VERDICTS + "SELECT url_id, CASE WHEN status = 'dangerous' AND greatest(confidence, phishing_confidence) >= 0.8 THEN 'modal' WHEN status IN ('dangerous', 'suspicious') THEN 'toast' ELSE 'silent' END AS presentation FROM verdicts WHERE valid")
def a8(spark, sf):
    return verdicts(spark, sf).where("valid").select("url_id", "presentation")


@query("a9_arbitration_trace", O.TO_VERDICTS + "SELECT url_id, r.id AS rule_id, r.cap AS cap, r.force AS force, CASE WHEN r.force IS NOT NULL THEN 'escalation' WHEN r.cap < 100 THEN 'cap' ELSE 'informational' END AS role, trust_floor IS NOT NULL AND r.force IS NOT NULL AS suppressed FROM (SELECT url_id, trust_floor, unnest(rules) AS r FROM verdicts WHERE valid)")
def a9(spark, sf):
    return scoring.rule_trace(verdicts(spark, sf).where("valid"), "url_id")


@query("a10_url_verdict", O.TO_VERDICTS + "SELECT url_id, url, host, root, CAST(score AS INT) AS score, status, level, len(signals) AS n_signals FROM verdicts")
def a10(spark, sf):
    return verdicts(spark, sf).select("url_id", "url", "host", "root", "score", "status", "level", F.size("signals").cast("long").alias("n_signals"))


# feeds ----------------------------------------------------------------------------------------------


@query("e1_normalize_feed_hosts", O.TO_FEED + "SELECT line_no, host FROM feed_hosts")
def e1(spark, sf):
    return feed_table(spark, sf).select("line_no", feeds.feed_host(F.col("line")).alias("host"))


_MERGED = O.TO_FEED + ", merged AS (SELECT host, min(feed_ord * 1000000000 + line_no) AS seen FROM feed_hosts WHERE host IS NOT NULL GROUP BY host ORDER BY seen, host LIMIT 200000)"
_SNAP = f"SELECT host FROM merged WHERE host NOT IN {O.KEPT} AND {O.root_of('host')} NOT IN {O.KEPT} AND host <> 'evil-kit.tk' ORDER BY seen LIMIT 20000"


@query("e2_merge_feeds", _MERGED + "SELECT host, seen // 1000000000 AS feed_ord, seen % 1000000000 AS line_no FROM merged")
def e2(spark, sf):
    return feeds.merge_feeds(feed_table(spark, sf)).select("host", "feed_ord", "line_no")


@query("e3_feed_snapshot", _MERGED + _SNAP)
def e3(spark, sf):
    seed = feed_table(spark, sf).where("line = 'evil-kit.tk'").select(F.col("line").alias("host"))
    return feeds.snapshot(feed_table(spark, sf), seed)


@query("e4_feed_delta", O.TO_FEED + ", o AS (SELECT DISTINCT host FROM feed_hosts WHERE host IS NOT NULL AND line_no % 10 <> 0), n AS (SELECT DISTINCT host FROM feed_hosts WHERE host IS NOT NULL AND line_no % 10 <> 1) SELECT host, 'added' AS change FROM n WHERE host NOT IN (SELECT host FROM o) UNION ALL SELECT host, 'removed' FROM o WHERE host NOT IN (SELECT host FROM n)")
def e4(spark, sf):
    lines = feed_table(spark, sf)
    return feeds.delta(feeds.merge_feeds(lines.where("line_no % 10 <> 0")), feeds.merge_feeds(lines.where("line_no % 10 <> 1")))


@query("e5_feed_source_counts", O.TO_FEED + "SELECT feed_id, count(DISTINCT host) AS n_hosts FROM feed_hosts GROUP BY feed_id")
def e5(spark, sf):
    return feeds.feed_counts(feed_table(spark, sf))


_AD = r""", ad0 AS (SELECT line_no, lower(trim(line)) AS t FROM feed), ad1 AS (SELECT line_no, t, regexp_extract(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '^\|\|', ''), '[\^/].*$', ''), '^(0\.0\.0\.0|127\.0\.0\.1)\s+', ''), '^www\.', ''), '^(\S*)', 1) AS h FROM ad0),
ads AS (SELECT line_no, CASE WHEN NOT regexp_matches(t, '^[#!]') AND contains(h, '.') AND NOT regexp_matches(h, '[^a-z0-9.-]') AND length(h) <= 253 THEN h END AS domain FROM ad1)"""


@query("e6_normalize_ad_domains", O.TO_FEED + _AD + "SELECT line_no, domain FROM ads")
def e6(spark, sf):
    return feed_table(spark, sf).select("line_no", feeds.ad_domain(F.col("line")).alias("domain"))


@query("e7_adblock_rules", O.TO_FEED + _AD + f", d AS (SELECT DISTINCT domain FROM ads WHERE domain IS NOT NULL AND domain NOT IN {O.KEPT} AND {O.root_of('domain')} NOT IN {O.KEPT} ORDER BY domain LIMIT 6000), r AS (SELECT domain, CAST(floor((row_number() OVER (ORDER BY domain) - 1) / 50) AS INT) + 1 AS id FROM d) SELECT id, count(*) AS n_domains, array_to_string(list(domain ORDER BY domain), ',') AS domains FROM r GROUP BY id")
def e7(spark, sf):
    return feeds.ad_rules(feed_table(spark, sf), chunk=50).select("id", F.size("domains").cast("long").alias("n_domains"), F.array_join("domains", ",").alias("domains"))




@query("e8_training_corpus", "WITH " + ",\n".join((O.FEED, O.FEED_HOSTS, O.URLS, O.PARTS)) + f", merged AS (SELECT host, min(feed_ord * 1000000000 + line_no) AS seen FROM feed_hosts WHERE host IS NOT NULL GROUP BY host), top AS (SELECT host, min(url_id) AS rank FROM parts WHERE valid GROUP BY host), bad AS (SELECT * FROM merged WHERE host NOT IN {O.KEPT} AND {O.root_of('host')} NOT IN {O.KEPT} AND host NOT IN (SELECT host FROM top)), good AS (SELECT * FROM top WHERE host NOT IN (SELECT host FROM bad)) SELECT * FROM (SELECT host, 1 AS label FROM bad ORDER BY seen LIMIT 500) UNION ALL SELECT * FROM (SELECT host, 0 AS label FROM good ORDER BY rank, host LIMIT 500)")
def e8(spark, sf):
    top = urls.url_parts(url_table(spark, sf)).where("valid").select("host", F.col("url_id").alias("rank"))
    return feeds.training_corpus(feed_table(spark, sf), top, 500)


@query("e9_allowlist_build", O.TO_PARTS + "SELECT root, min(url_id) AS first_ts FROM parts WHERE valid GROUP BY root ORDER BY first_ts, root LIMIT 500")
def e9(spark, sf):
    return feeds.allowlist(urls.url_parts(url_table(spark, sf)).where("valid").select("host", F.col("url_id").alias("ts")))
