"""Common table expressions of the oracle SQL (DuckDB): the same facts, written a second time."""

from __future__ import annotations

from ..functions import constants as C
from ..functions import hosts as H
from ..functions import rules as R
from . import inputs as I


def strings(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def members(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def root_of(host: str) -> str:
    two, parts = f"array_to_string(string_split({host}, '.')[-2:], '.')", f"string_split({host}, '.')"
    return f"CASE WHEN len({parts}) <= 2 THEN {host} WHEN {two} IN {members(C.TWO_LEVEL_SUFFIXES)} THEN array_to_string({parts}[-3:], '.') ELSE {two} END"


_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*)://(?:([^/?#@]*)@)?([^/?#:]*)(?::\d+)?([^?#]*)(\?[^#]*)?"
#: The only internationalised hosts of the inputs, in both forms.
_IDN = {"xn--ntflix-3of.com": "nеtflix.com", "xn--ggle-55da.com": "gооgle.com"}
_TO_ASCII = "CASE lower(regexp_extract(url, '{re}', 3)) " + " ".join(f"WHEN '{u}' THEN '{a}'" for a, u in _IDN.items()) + " ELSE lower(regexp_extract(url, '{re}', 3)) END"
URLS = f"urls AS ({I.URLS})"
PARTS = f"""parts0 AS (SELECT *, lower(regexp_extract(url, '{_RE}', 1)) AS scheme, regexp_extract(url, '{_RE}', 2) AS userinfo, {_TO_ASCII.format(re=_RE)} AS hostname,
  regexp_extract(url, '{_RE}', 4) AS path, regexp_extract(url, '{_RE}', 5) AS query FROM urls),
parts1 AS (SELECT *, regexp_replace(hostname, '^www\\.', '') AS host, hostname <> '' AS valid FROM parts0),
parts AS (SELECT *, {root_of('host')} AS root, CASE WHEN contains(host, '.') THEN string_split(host, '.')[-1] ELSE '' END AS tld FROM parts1)"""

_GLYPHS, _LATIN = H.glyph_tables()
LOOK = f"""brands AS (SELECT unnest({strings(C.LOOKALIKE_BRANDS)}) AS brand, unnest(range({len(C.LOOKALIKE_BRANDS)})) AS place),
look0 AS (SELECT DISTINCT hostname, host, CASE host {" ".join(f"WHEN '{a}' THEN '{u}'" for a, u in _IDN.items())} ELSE host END AS host_unicode FROM parts WHERE valid),
look1 AS (SELECT *, {root_of('host_unicode')} AS root_unicode, {root_of('host')} AS root_ascii, regexp_matches(host, '(^|\\.)xn--') AS puny FROM look0),
look2 AS (SELECT *, translate(root_unicode, '{_GLYPHS}', '{_LATIN}') AS root_normal FROM look1),
dist AS (SELECT hostname, brand, place, least(levenshtein(root_unicode, brand), levenshtein(root_normal, brand), levenshtein(root_ascii, brand)) AS d, length(root_normal) AS n FROM look2, brands),
typo AS (SELECT hostname, arg_min(brand, d * 1000 + place) AS typo_brand, min(d) AS typo_d FROM dist WHERE d BETWEEN 1 AND 2 AND abs(n - length(brand)) <= 3 GROUP BY hostname),
inside AS (SELECT hostname, arg_min(brand, place) AS inside_brand FROM look2, brands WHERE length(string_split(brand, '.')[1]) >= 4 AND root_normal <> brand
  AND list_contains(list_concat(list_concat(regexp_split_to_array(host_unicode, '[.-]'), regexp_split_to_array(host, '[.-]')), regexp_split_to_array(root_normal, '[.-]')), string_split(brand, '.')[1]) GROUP BY hostname),
look3 AS (SELECT l.*, typo_brand, typo_d, inside_brand, CASE WHEN NOT puny AND root_unicode IN {members(C.LOOKALIKE_BRANDS)} THEN NULL WHEN root_normal <> root_unicode AND root_normal IN {members(C.LOOKALIKE_BRANDS)} THEN 'homoglyph'
  WHEN typo_brand IS NOT NULL THEN 'typo' WHEN puny THEN 'punycode' WHEN inside_brand IS NOT NULL THEN 'brand-in-host' END AS lookalike_kind FROM look2 l LEFT JOIN typo USING (hostname) LEFT JOIN inside USING (hostname)),
look AS (SELECT *, CASE lookalike_kind WHEN 'homoglyph' THEN root_normal WHEN 'typo' THEN typo_brand WHEN 'brand-in-host' THEN inside_brand END AS lookalike_brand,
  CASE lookalike_kind WHEN 'homoglyph' THEN 0.95e0 WHEN 'typo' THEN greatest(0.6e0, 1 - typo_d * 0.2e0) WHEN 'punycode' THEN 0.75e0 WHEN 'brand-in-host' THEN 0.55e0 ELSE 0e0 END AS lookalike_conf, CASE WHEN lookalike_kind = 'typo' THEN typo_d END AS lookalike_distance,
  CASE WHEN host_unicode IN {members(_IDN.values())} THEN true ELSE false END AS mixed_script FROM look3)"""

_B = strings(C.BRAND_DOMAINS)
REP = f"""rep0 AS (SELECT *, scheme IN ('http', 'https') AND valid AS web, root IN {members(C.REPUTABLE_ROOTS)} AS reputable, root IN {members(C.LOGIN_ROOTS)} AS provider,
  CASE WHEN list_contains({_B}, root) THEN {_B}[1:list_position({_B}, root) - 1] ELSE {_B} END AS upto FROM parts),
rep1 AS (SELECT *, reputable OR provider AS trusted, CASE WHEN web THEN list_filter(upto, lambda b: contains(host, b || '.'))[1] END AS brand_subdomain FROM rep0),
rep AS (SELECT *, CASE WHEN web AND brand_subdomain IS NULL AND NOT trusted THEN list_filter(upto, lambda b: length(string_split(b, '.')[1]) >= 4 AND string_split(b, '.')[1] = string_split(root, '.')[1])[1] END AS tld_swap,
  CASE WHEN web AND NOT trusted AND tld IN {members(C.ABUSED_TLDS)} THEN tld END AS abused_tld, web AND root IN {members(C.URL_SHORTENERS)} AS shortener,
  CASE WHEN web AND NOT trusted THEN list_filter({strings(C.PHISHY_TOKENS)}, lambda t: contains(host || ' ' || lower(path), t))[1] END AS phishy_token,
  CASE {" ".join(f"WHEN root IN {members(v)} THEN '{k}'" for k, v in C.SAFELIST.items())} END AS safelist_kind FROM rep1)"""

SHAPE = r"""shape AS (SELECT *, regexp_matches(hostname, '^\d{1,3}(\.\d{1,3}){3}$') AS is_ip, length(hostname) - length(replace(hostname, '-', '')) AS dashes, len(string_split(hostname, '.')) AS depth,
  length(hostname) AS host_length, regexp_matches(string_split(root, '.')[1], '(?i)login|verify|secure|account|update|wallet|signin') AS auth_label FROM rep)"""

_V = "url_decode(regexp_replace(p, '^[^=]*=?', ''))"
REDIR = f"""pairs AS (SELECT url_id, root AS page_root, unnest(string_split(regexp_replace(query, '^\\?', ''), '&')) AS p, generate_subscripts(string_split(regexp_replace(query, '^\\?', ''), '&'), 1) AS i FROM parts WHERE scheme IN ('http', 'https')),
targets0 AS (SELECT *, string_split(p, '=')[1] AS param, regexp_matches(regexp_replace(p, '^[^=]*=?', ''), '%[0-9a-fA-F]{{2}}') AS coded, trim({_V}) AS v FROM pairs),
targets1 AS (SELECT *, CASE WHEN starts_with(v, '//') THEN 'https:' || v ELSE v END AS u FROM targets0),
targets2 AS (SELECT *, regexp_replace(lower(regexp_extract(u, '{_RE}', 3)), '^www\\.', '') AS target_host, regexp_extract(u, '{_RE}', 2) AS ui FROM targets1 WHERE lower(param) IN {members(C.REDIRECT_PARAMS)} AND regexp_matches(u, '(?i)^https?://')),
redir AS (SELECT url_id, arg_min(param, i) AS redirect_param, arg_min(target_host, i) AS redirect_host, arg_min(regexp_matches(target_host, '^\\d{{1,3}}(\\.\\d{{1,3}}){{3}}$') OR ui <> '' OR coded, i) AS redirect_risky
  FROM targets2 WHERE target_host <> '' AND {root_of('target_host')} <> page_root GROUP BY url_id)"""

FEED = f"feed AS ({I.FEED})"
FEED_HOSTS = r"""fh0 AS (SELECT *, regexp_replace(trim(line), '^(0\.0\.0\.0|127\.0\.0\.1)\s+', '') AS t FROM feed),
fh1 AS (SELECT *, regexp_replace(regexp_replace(lower(CASE WHEN regexp_matches(t, '(?i)^https?://') THEN regexp_extract(t, '^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]*)', 1) ELSE string_split(t, '/')[1] END), '^www\.', ''), '\.$', '') AS h FROM fh0),
feed_hosts AS (SELECT feed_id, feed_ord, line_no, CASE WHEN NOT regexp_matches(trim(line), '^[#!]') AND contains(h, '.') AND NOT regexp_matches(h, '\s') AND length(h) <= 253 THEN h END AS host FROM fh1)"""
KEPT = members(sorted({*C.REPUTABLE_ROOTS, *C.LOGIN_ROOTS, *(r for v in C.SAFELIST.values() for r in v)}))
BLOCK = "blocklist AS (SELECT DISTINCT host FROM feed_hosts WHERE host IS NOT NULL)"

_LURE, _CT = strings(C.LURE_TOKENS), members(C.CLASSIFIER_TLDS)
FEATURES = f"""features AS (SELECT s.*, look.* EXCLUDE (hostname, host), redirect_param, redirect_host, coalesce(redirect_risky, false) AS redirect_risky,
  (b1.host IS NOT NULL OR b2.host IS NOT NULL) AS blocklisted, CASE WHEN b1.host IS NOT NULL THEN s.host WHEN b2.host IS NOT NULL THEN s.root END AS matched_host,
  CAST(valid AND scheme <> 'https' AS INT)::DOUBLE AS not_https, CAST(valid AND regexp_matches(s.host, '(^|\\.)xn--') AS INT)::DOUBLE AS punycode, CAST(valid AND string_split(s.host, '.')[-1] IN {_CT} AS INT)::DOUBLE AS abused_tld_f,
  CASE WHEN NOT valid THEN 0.0 WHEN len(string_split(s.host, '.')) - len(string_split(s.root, '.')) >= 3 THEN 1.0 WHEN len(string_split(s.host, '.')) - len(string_split(s.root, '.')) = 2 THEN 0.5 ELSE 0.0 END::DOUBLE AS many_subdomains,
  CASE WHEN valid THEN len(regexp_extract_all(s.host, '[0-9]'))::DOUBLE / length(s.host) ELSE 0.0 END::DOUBLE AS host_digits_ratio, CASE WHEN valid THEN least(3, len(regexp_extract_all(s.host, '-'))) ELSE 0 END::DOUBLE AS host_hyphens,
  CASE WHEN valid THEN least(3, len(list_filter({_LURE}, lambda t: contains(lower(look.host_unicode || path), t)))) ELSE 0 END::DOUBLE AS lure_tokens,
  CAST(valid AND regexp_matches(array_to_string(string_split(s.host, '.')[1:greatest(0, len(string_split(s.host, '.')) - len(string_split(s.root, '.')))], '.'), '\\b(paypal|apple|microsoft|google|amazon|netflix|coinbase|metamask|bank|hdfc|icici|sbi|instagram|facebook|whatsapp)\\b') AS INT)::DOUBLE AS brand_in_subdomain
  FROM shape s LEFT JOIN look ON look.hostname = s.hostname LEFT JOIN redir USING (url_id) LEFT JOIN blocklist b1 ON b1.host = s.host LEFT JOIN blocklist b2 ON b2.host = s.root)"""
_Z = str(R.CLASSIFIER_BIAS) + "e0 + " + " + ".join(f"{k} * {w}e0" for k, w in R.CLASSIFIER)
#: What a URL has where its page isn't known.
NO_PAGE = """paged AS (SELECT *, 0e0 AS has_password_field, 0e0 AS cross_origin_form, 0e0 AS many_external_scripts, 0e0 AS obfuscation, false AS has_auth, false AS creds, false AS page_external_post, false AS page_cross_origin,
  false AS oauth_impersonation, false AS mfa_only, false AS email_first, false AS brand_text, false AS brand_image, false AS hidden_overlay, false AS csp_weakened, 0e0 AS clone_conf, 0e0 AS phish_conf, 0e0 AS context_score,
  NULL::INT AS page_cap, NULL::VARCHAR AS page_force, []::STRUCT(place INTEGER, id VARCHAR, category VARCHAR, severity VARCHAR, weight DOUBLE, confidence DOUBLE, contribution BIGINT)[] AS page_signals FROM features)"""
#: Redirects and sign-in flow of a tab as of its last event, outside findings, earlier trust.
EVIDENCE = f"""nav AS ({I.NAVIGATION}), nav1 AS (SELECT *, sum(CASE WHEN kind = 'navigate' THEN 1 ELSE 0 END) OVER (PARTITION BY tab_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS chain_no FROM nav),
nav2 AS (SELECT tab_id, chain_no, list(url ORDER BY ts, seq)[-25:] AS urls FROM nav1 GROUP BY tab_id, chain_no),
ev_chain AS (SELECT tab_id, arg_max(len(urls), chain_no) AS hops, arg_max(len(list_distinct(list_transform(urls, lambda u: array_to_string(string_split(regexp_extract(u, '://([^/]*)', 1), '.')[-2:], '.')))), chain_no) AS chain_roots FROM nav2 GROUP BY tab_id),
{{flows}}, ev_flow AS (SELECT flow_id AS tab_id, arg_max(struct_pack(flow_relay := flow_relay, flow_token_drift := flow_token_drift, flow_iframe_swap := flow_iframe_swap, flow_mfa_split := flow_mfa_split, flow_redirect_storm := flow_redirect_storm), struct_pack(ts := ts, seq := seq)) AS f FROM flow_rows GROUP BY flow_id),
ev_external AS ({I.EXTERNAL}), ev_learned AS (SELECT root, least(50, count(*)) AS trust_count FROM parts WHERE valid AND url_id % 24 IN (1, 18, 19, 22) GROUP BY root), ev_allowed AS (SELECT DISTINCT root, true AS allowlisted FROM parts WHERE valid AND url_id % 24 IN (10, 17, 20))"""
#: Rows of sign-in flows with their anomalies as of each step.
FLOWS = f"""steps AS ({I.STEPS}), flow0 AS (SELECT *, list(struct_pack(ts := ts, seq := seq, kind := kind, origin := origin, post_origin := post_origin, in_iframe := in_iframe)) OVER (PARTITION BY flow_id ORDER BY ts, seq ROWS BETWEEN 63 PRECEDING AND CURRENT ROW) AS s0 FROM steps),
flow1 AS (SELECT flow_id, seq, ts, list_filter(s0, lambda x: x.ts >= ts - INTERVAL 300 SECONDS) AS s FROM flow0), flow2 AS (SELECT *, list_filter(s, lambda x: x.kind IN ('credential', 'mfa')) AS creds, list_filter(s, lambda x: x.kind = 'entry')[1] AS entry, list_filter(s, lambda x: x.kind = 'credential')[1] AS pw, list_filter(s, lambda x: x.kind = 'mfa')[1] AS mfa,
  list_transform(list_filter(s, lambda x: x.kind = 'oauth'), lambda x: x.origin) AS issuers, list_transform(list_filter(s, lambda x: x.kind = 'token'), lambda x: x.origin) AS tokens FROM flow1),
flow_rows AS (SELECT flow_id, seq, ts, len(s) AS n_steps, len(s) >= 2 AND len(list_filter(creds, lambda x: x.post_origin IS NOT NULL AND NOT list_contains(list_transform(s, lambda y: y.origin), x.post_origin))) > 0 AS flow_relay, len(s) >= 2 AND len(issuers) > 0 AND len(list_filter(tokens, lambda t: NOT list_contains(issuers, t))) > 0 AS flow_token_drift,
  coalesce(len(s) >= 2 AND len(list_filter(creds, lambda x: x.in_iframe AND x.origin <> entry.origin)) > 0, false) AS flow_iframe_swap, len(s) >= 2 AND len(list_distinct(list_transform(list_filter(s, lambda x: x.kind = 'redirect'), lambda x: x.origin))) >= 4 AS flow_redirect_storm, coalesce(len(s) >= 2 AND pw.origin <> mfa.origin, false) AS flow_mfa_split FROM flow2)"""
EVIDENCE = EVIDENCE.replace("{flows}", FLOWS)
_FLAGS = ("flow_relay", "flow_token_drift", "flow_iframe_swap", "flow_mfa_split", "flow_redirect_storm")
FACTS = f"""facts0 AS (SELECT p.*, coalesce(c.hops, 0) AS hops, coalesce(c.chain_roots, 0) AS chain_roots, {", ".join(f"coalesce(w.f.{k}, false) AS {k}" for k in _FLAGS)}, coalesce(x.ext_malicious, false) AS ext_malicious, coalesce(x.ext_engines, 0) AS ext_engines,
  coalesce(l.trust_count, 0) AS trust_count, coalesce(a.allowlisted, false) AS allowlisted FROM paged p LEFT JOIN ev_chain c USING (tab_id) LEFT JOIN ev_flow w USING (tab_id) LEFT JOIN ev_external x USING (url) LEFT JOIN ev_learned l USING (root) LEFT JOIN ev_allowed a USING (root)),
facts AS (SELECT *, CASE WHEN trusted THEN 0e0 ELSE floor(1 / (1 + exp(-({_Z}))) * 100 + 0.5) / 100 END AS probability, coalesce(mixed_script, false) AS mixed_spoof, page_external_post OR flow_relay AS external_post, page_cross_origin OR flow_iframe_swap AS cross_origin_creds,
  flow_token_drift OR (oauth_impersonation AND (page_external_post OR flow_relay)) AS oauth_spoof FROM facts0)"""


def signal(place, sid, category, severity, weight, conf, cond) -> str:
    w, c = f"CAST({weight} AS DOUBLE)", f"least(1e0, greatest(0e0, CAST({conf} AS DOUBLE)))"
    return f"CASE WHEN {cond} THEN struct_pack(place := {place}, id := '{sid}', category := '{category}', severity := {severity}, weight := {w}, confidence := {c}, contribution := CAST(-floor({w} * {c} + 0.5) AS BIGINT)) END"


_SIG = ", ".join(signal(i, *row) for i, row in enumerate(R.URL_SIGNALS))
_FLOW = ", ".join(signal(200 + i, f"authflow:{sid}", "behavior", f"'{sev}'", w, "0.9", cond) for i, (sid, sev, w, cond) in enumerate(R.FLOW_SIGNALS))
SIGNALS = f"sig AS (SELECT *, CASE WHEN valid THEN list_filter(list_concat(list_concat([{_SIG}], page_signals), [{_FLOW}]), lambda s: s IS NOT NULL) ELSE [] END AS signals, list_filter([{_SIG}], lambda s: s IS NOT NULL) AS url_signals FROM facts)"
_TRUST = " + ".join(f"CASE WHEN {cond} THEN {p} ELSE 0 END" for _, p, cond in R.TRUST)
_ARB = ", ".join(f"CASE WHEN {cond} THEN struct_pack(id := '{i}', cap := {cap}, force := {repr(f) if f else 'NULL::VARCHAR'}) END" for i, cap, f, cond in R.ARBITRATION)
_DECAY = " + ".join(f"CASE WHEN {cond} THEN {p} ELSE 0 END" for _, p, cond in R.DECAY)
_EXT = "ext_malicious OR ext_engines > 0"
SCORE = f"""raw AS (SELECT *, {_TRUST} AS trust_gain, coalesce(list_sum(list_transform(signals, lambda s: s.contribution)), 0) AS penalty, greatest(CASE WHEN allowlisted THEN 85 ELSE 0 END, CASE WHEN trust_count >= 3 THEN 70 ELSE 0 END) AS floor_,
  coalesce(list_sum(list_transform(list_filter(signals, lambda s: s.id IN ('lookalike', 'clone', 'brand-impersonation')), lambda s: -s.contribution)), 0) AS visual,
  CASE WHEN context_score >= 0.6 AND NOT allowlisted AND NOT (external_post OR oauth_spoof OR creds OR cross_origin_creds OR {_EXT} OR blocklisted OR brand_subdomain IS NOT NULL OR flow_relay OR flow_token_drift OR flow_iframe_swap) THEN context_score ELSE 0e0 END AS damping FROM sig),
damped AS (SELECT * REPLACE (clone_conf * (1 - damping * 0.8e0) AS clone_conf, phish_conf * (1 - damping * 0.8e0) AS phish_conf, brand_text AND damping = 0 AS brand_text), CAST(floor(least(visual, 30) * damping * 0.8e0 + 0.5) AS INT) AS damping_points, coalesce(lookalike_conf, 0e0) * (1 - damping * 0.8e0) AS lookalike_arb,
  NOT reputable AND NOT provider AS unknown, brand_subdomain IS NOT NULL AS url_spoof, tld_swap IS NOT NULL AS swapped, has_auth OR creds AS auth_or_creds, coalesce(lookalike_kind, '') = 'punycode' OR regexp_matches(hostname, '(^|\\.)xn--') OR coalesce(mixed_script, false) AS idn_spoof, false AS layout_clone, 0e0 AS layout_conf FROM raw),
arb0 AS (SELECT *, least(100, greatest(floor_, greatest(0, least(100, {R.BASELINE} + trust_gain + penalty))) + damping_points) AS base_score, external_post OR cross_origin_creds OR oauth_spoof OR idn_spoof OR mfa_only OR brand_text OR {_EXT} OR blocklisted OR url_spoof OR swapped AS evidence FROM damped),
arb1 AS (SELECT *, evidence OR lookalike_arb > 0.5 OR clone_conf >= 0.4 OR phish_conf >= 0.4 OR abused_tld IS NOT NULL OR coalesce(age_days >= 0 AND age_days < 60, false) OR scheme <> 'https' OR hidden_overlay OR email_first AS corroborated,
  allowlisted AND NOT (external_post OR cross_origin_creds OR oauth_spoof OR {_EXT}) AS silent FROM arb0),
arb2 AS (SELECT *, CASE WHEN silent THEN [] ELSE list_filter([{_ARB}], lambda r: r IS NOT NULL) END AS rules, (reputable OR provider) AND NOT evidence AND NOT silent AS floored,
  {_EXT} OR page_external_post OR page_cross_origin OR blocklisted OR brand_subdomain IS NOT NULL OR tld_swap IS NOT NULL OR coalesce(mixed_script, false) AS malicious FROM arb1),
arb AS (SELECT *, CASE WHEN NOT floored THEN list_min(list_transform(rules, lambda r: r.cap)) END AS arb_cap, CASE WHEN NOT floored THEN CASE WHEN list_contains(list_transform(rules, lambda r: r.force), 'dangerous') THEN 'dangerous' WHEN list_contains(list_transform(rules, lambda r: r.force), 'suspicious')
  OR (list_contains(list_transform(rules, lambda r: r.id), 'unknown-login') AND phish_conf >= 0.5) THEN 'suspicious' END END AS arb_force, CASE WHEN floored THEN CASE WHEN reputable THEN 85 ELSE 80 END END AS trust_floor, NOT allowlisted OR malicious AS spoken FROM arb2),
capped AS (SELECT *, least(base_score, coalesce(arb_cap, 100), CASE WHEN lookalike_kind IS NOT NULL AND (lookalike_kind = 'punycode' OR regexp_matches(hostname, '(^|\\.)xn--')) THEN 45 ELSE 100 END, CASE WHEN brand_subdomain IS NOT NULL THEN 25 ELSE 100 END,
  CASE WHEN mixed_script THEN 35 ELSE 100 END, CASE WHEN spoken THEN coalesce(page_cap, 100) ELSE 100 END) AS capped, CASE WHEN reputable OR provider OR allowlisted THEN {_DECAY} ELSE 0 END AS decay, coalesce(arb_force, CASE WHEN spoken THEN page_force END) AS force_ FROM arb),
scored AS (SELECT *, CASE WHEN valid THEN greatest(0, CASE WHEN trust_floor IS NOT NULL AND scheme = 'https' THEN greatest(capped, trust_floor) ELSE capped END - decay) ELSE 50 END AS score, malicious OR flow_relay OR flow_token_drift OR flow_iframe_swap AS behavioural FROM capped),
verdict0 AS (SELECT *, CASE WHEN score >= 71 THEN 'safe' WHEN score >= 41 THEN 'suspicious' ELSE 'dangerous' END AS by_score FROM scored),
verdict1 AS (SELECT *, CASE WHEN NOT valid THEN 'suspicious' WHEN force_ = 'dangerous' THEN 'dangerous' WHEN force_ = 'suspicious' AND by_score = 'safe' THEN 'suspicious' ELSE by_score END AS status,
  CASE WHEN NOT valid THEN 0e0 WHEN len(signals) = 0 THEN 0.6e0 ELSE floor(least(1e0, list_sum(list_transform(signals, lambda s: s.confidence * least(1e0, s.weight / 30))) / 1.5) * 100 + 0.5) / 100 END AS confidence,
  floor(least(1e0, coalesce(list_sum(list_transform(list_filter(signals, lambda s: s.category IN ('identity', 'structure', 'behavior', 'reputation', 'clone')), lambda s: s.confidence * least(1e0, s.weight / 25))), 0) / 2) * 100 + 0.5) / 100 AS phishing_confidence FROM verdict0),
verdict2 AS (SELECT *, CASE WHEN status = 'dangerous' AND behavioural THEN 'dangerous' WHEN status = 'dangerous' THEN 'highRisk' WHEN status = 'suspicious' AND behavioural THEN 'suspicious' WHEN status = 'suspicious' THEN 'contextual' WHEN score < 71 THEN 'contextual' ELSE 'informational' END AS level0 FROM verdict1),
verdicts AS (SELECT *, CASE WHEN (trusted OR allowlisted) AND decay >= 5 AND level0 = 'informational' THEN 'contextual' WHEN (trusted OR allowlisted) AND level0 = 'highRisk' AND NOT behavioural THEN 'suspicious' ELSE level0 END AS level FROM verdict2)"""

TO_PARTS = "WITH " + ",\n".join((URLS, PARTS))
_URL_FEATURES = (URLS, PARTS, LOOK, REP, SHAPE, REDIR, FEED, FEED_HOSTS, BLOCK, FEATURES)
TO_FEATURES = "WITH " + ",\n".join(_URL_FEATURES)
TO_FACTS = "WITH " + ",\n".join((*_URL_FEATURES, NO_PAGE, EVIDENCE, FACTS))
TO_VERDICTS = ",\n".join((TO_FACTS, SIGNALS, SCORE))
TO_FEED = "WITH " + ",\n".join((FEED, FEED_HOSTS))
