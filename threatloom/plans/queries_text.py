"""Queries over texts, pages and the classifier, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..operators import classifier, dlp, feeds, pages, scoring, urls
from ..session import spread
from ..sources.shared import kept
from . import inputs as I
from . import oracle_pages as OP
from . import oracle_parts as O
from .queries import SQL, blocklist, evidence, feed_table, query, url_table, verdicts

_TEXTS = f"WITH texts AS ({I.TEXTS})"


def texts(spark, sf) -> DataFrame:
    return spread(I.derived(spark, sf, I.TEXTS), f"{sf}/documents.parquet")


def hundredths(x: str) -> str:
    return f"floor({x} * 100 + 0.5) / 100"


# texts ----------------------------------------------------------------------------------------------


@query("d1_sensitive_findings")
def d1(spark, sf):
    rows = texts(spark, sf).select("doc_id", F.explode(dlp.sensitive_findings("text", whole=True)).alias("f"))
    return rows.select("doc_id", F.col("f.id").alias("finding_id"), "f.severity", "f.confidence", "f.redacted", F.col("f.offset").cast("long").alias("at"), "f.suppressed", "f.reason")


_HIDE = "CASE WHEN length({v}) <= 6 THEN repeat('•', length({v})) ELSE left({v}, 2) || repeat('•', least(length({v}) - 4, 10)) || right({v}, 2) END"
_PLACE = f"len(list_filter({O.strings(C.PLACEHOLDER_TOKENS)}, lambda p: contains(lower(t), p))) = 0"


@query("d2_entropy_blobs", _TEXTS + f""", tok AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z0-9+/_=-]{{32,}}')[1:40])) AS t FROM texts), h AS (SELECT doc_id, t, list_aggregate(string_split(t, ''), 'entropy') AS h FROM tok)
SELECT doc_id, {_HIDE.format(v='t')} AS redacted, floor(least(0.85, (h - 4.5) * 0.5 + 0.55) * 100 + 0.5) / 100 AS confidence FROM h WHERE h >= 4.5 AND {_PLACE}""")
def d2(spark, sf):
    return dlp.entropy_blobs(texts(spark, sf))


@query("d3_shannon_entropy", _TEXTS + "SELECT doc_id, round(list_aggregate(string_split(text, ''), 'entropy'), 6) AS entropy FROM texts WHERE length(text) > 0")
def d3(spark, sf):
    return texts(spark, sf).where(F.length("text") > 0).select("doc_id", F.round(dlp.text_entropy("text"), 6).alias("entropy"))


_CARDS = _TEXTS + ", c AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\b(?:\\d[ -]*?){13,19}\\b')) AS card FROM texts), d AS (SELECT doc_id, regexp_replace(card, '[^0-9]', '', 'g') AS digits FROM c)"


@query("d4_card_check", _CARDS + ", s AS (SELECT doc_id, digits, list_sum(list_transform(string_split(reverse(digits), ''), lambda x, i: CASE WHEN i % 2 = 1 THEN x::INT WHEN x::INT * 2 > 9 THEN x::INT * 2 - 9 ELSE x::INT * 2 END)) AS total FROM d WHERE length(digits) BETWEEN 13 AND 19) SELECT doc_id, count(*) AS n_cards, count(*) FILTER (WHERE total % 10 = 0) AS n_valid FROM s GROUP BY doc_id")
def d4(spark, sf):
    cards = F.regexp_extract_all("text", F.lit(dlp.bounded(r"\b(?:[0-9][ -]*?){13,19}\b")), F.lit(0))
    rows = texts(spark, sf).select("doc_id", F.explode(cards).alias("card")).where(F.length(F.regexp_replace("card", "[^0-9]", "")).between(13, 19))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_cards"), F.count_if(dlp.luhn(F.col("card"))).alias("n_valid"))


_BIG = "list_reduce(list_prepend(0, list_transform(string_split(substr(v, 5) || left(v, 4), ''), lambda c: CASE WHEN c BETWEEN 'A' AND 'Z' THEN ord(c) - 55 + 100 ELSE c::INT END)), lambda a, c: CASE WHEN c >= 100 THEN (a * 100 + c - 100) % 97 ELSE (a * 10 + c) % 97 END)"


@query("d5_iban_check", _TEXTS + f", c AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\b[A-Z]{{2}}\\d{{2}}[A-Z0-9]{{10,30}}\\b')) AS v FROM texts) SELECT doc_id, v AS iban, length(v) BETWEEN 15 AND 34 AND {_BIG} = 1 AS valid FROM c")
def d5(spark, sf):
    rows = texts(spark, sf).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(dlp.bounded(r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}\b")), F.lit(0))).alias("iban"))
    return rows.select("doc_id", "iban", dlp.iban(F.col("iban")).alias("valid"))


_D, _P = "".join(dlp.VERHOEFF_D), "".join(dlp.VERHOEFF_P)
_VER = f"list_reduce(list_prepend(0, list_transform(string_split(reverse(v), ''), lambda c, i: substr('{_P}', ((i - 1) % 8 * 10 + c::INT + 1)::INT, 1)::INT)), lambda a, c: substr('{_D}', a * 10 + c + 1, 1)::INT)"


@query("d6_aadhaar_check", _TEXTS + f", c AS (SELECT doc_id, regexp_replace(unnest(regexp_extract_all(text, '\\b\\d{{4}}[\\s-]?\\d{{4}}[\\s-]?\\d{{4}}\\b')), '[^0-9]', '', 'g') AS v FROM texts) SELECT doc_id, v AS digits, {_VER} = 0 AS valid FROM c")
def d6(spark, sf):
    rows = texts(spark, sf).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(dlp.bounded(r"\b[0-9]{4}[\s-]?[0-9]{4}[\s-]?[0-9]{4}\b")), F.lit(0))).alias("raw"))
    rows = rows.withColumn("digits", F.regexp_replace("raw", "[^0-9]", ""))
    return rows.select("doc_id", "digits", dlp.aadhaar(F.col("digits")).alias("valid"))


_RUNS = "list_filter(list_transform(string_split(array_to_string(list_transform(regexp_split_to_array(text, '[ \\t\\n\\f\\r]+'), lambda t: CASE WHEN regexp_full_match(t, '[a-z]{3,8}') THEN t ELSE '|' END), ' '), '|'), lambda r: string_split(trim(r), ' ')), lambda w: len(w) >= 12)"


@query("d7_mnemonic_check", _TEXTS + f""", r AS (SELECT doc_id, unnest({_RUNS}) AS w FROM texts), n AS (SELECT doc_id, w, unnest([12, 15, 18, 21, 24]) AS n FROM r), p AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - n + 2), lambda i: w[i:i + n - 1])) AS p FROM n WHERE len(w) >= n)
SELECT doc_id, len(p) AS n_words, count(*) AS n_phrases FROM p WHERE len(list_distinct(p)) >= len(p) * 0.7e0 AND list_aggregate(string_split(array_to_string(p, ''), ''), 'entropy') > 3.4 GROUP BY ALL""")
def d7(spark, sf):
    rows = texts(spark, sf).select("doc_id", F.explode(dlp.mnemonic_phrases(F.col("text"))).alias("p"))
    rows = rows.where(dlp.mnemonic(F.col("p"))).select("doc_id", (F.regexp_count("p", F.lit(" ")) + 1).cast("long").alias("n_words"))
    return rows.groupBy("doc_id", "n_words").agg(F.count(F.lit(1)).alias("n_phrases"))


@query("d8_redact", _TEXTS + f"SELECT doc_id, {_HIDE.format(v='source')} AS source_hidden, {_HIDE.format(v='text')} AS text_hidden FROM texts")
def d8(spark, sf):
    return texts(spark, sf).select("doc_id", dlp.redact(F.col("source")).alias("source_hidden"), dlp.redact(F.col("text")).alias("text_hidden"))


@query("d9_suppress_findings")
def d9(spark, sf):
    rows = texts(spark, sf).select("doc_id", F.explode(dlp.sensitive_findings("text", whole=True)).alias("f")).where("f.suppressed")
    return rows.groupBy(F.col("f.id").alias("finding_id"), F.col("f.reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs"))


@query("d10_doc_risk")
def d10(spark, sf):
    rows = texts(spark, sf).withColumn("f", dlp.sensitive_findings("text", whole=True))
    return rows.select("doc_id", *[v.alias(k) for k, v in dlp.risk(F.col("f"), F.col("doc_id") % 2 == 0).items()])


def _letters(word: str) -> str:
    """A word in letters of any case, ASCII alone: with (?i), RE2 also takes the long s and the Kelvin sign."""
    return "".join(f"[{c}{c.upper()}]" for c in word)


_RE2 = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "awsSecret": r"[A-Za-z0-9/+=]{40,}",
    "genericApiKey": rf"\b(?:{_letters('api')}[_-]?{_letters('key')}|{_letters('secret')}|{_letters('token')})[\"':=\s]+[\"']?[A-Za-z0-9_\-]{{24,}}",
}
_LUHN = "list_sum(list_transform(string_split(reverse(regexp_replace(h, '[^0-9]', '', 'g')), ''), lambda x, i: CASE WHEN i % 2 = 1 THEN x::INT WHEN x::INT * 2 > 9 THEN x::INT * 2 - 9 ELSE x::INT * 2 END)) % 10 = 0 AND length(regexp_replace(h, '[^0-9]', '', 'g')) BETWEEN 13 AND 19"
_KEEP = {"creditCard": _LUHN, "ssn": "left(h, 3) NOT IN ('000', '666') AND left(h, 1) <> '9' AND h[5:6] <> '00' AND h[8:11] <> '0000'", "awsSecret": "length(h) = 40 AND regexp_matches(text, '" + "|".join(map(_letters, ("aws", "secret", "amazon"))) + "')"}


def _pii_sql() -> str:
    parts = []
    for n, (kind, severity, _, pattern) in enumerate(dlp.PII):
        # white space has the vertical tab in it, which RE2 leaves out
        pattern = _RE2.get(kind, pattern).replace(r"\s", r"\s\x0B").replace("'", "''")
        parts.append(f"SELECT doc_id, {n} AS p, i, '{kind}' AS kind, '{severity}' AS severity, h FROM (SELECT doc_id, text, unnest(regexp_extract_all(text, '{pattern}')) AS h, generate_subscripts(regexp_extract_all(text, '{pattern}'), 1) AS i FROM texts) WHERE {_KEEP.get(kind, 'true')}")
    parts.append("SELECT doc_id, 99 AS p, i, 'highEntropy' AS kind, 'medium' AS severity, h FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9+/_=-]{20,}')) AS h, generate_subscripts(regexp_extract_all(text, '[A-Za-z0-9+/_=-]{20,}'), 1) AS i FROM texts) WHERE length(h) >= 24 AND list_aggregate(string_split(h, ''), 'entropy') >= 4.2")
    # the stop rule: a pattern gives what brings a text to 51 matches, and one at least; tokens of high entropy all count
    stop = "kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS own, row_number() OVER (PARTITION BY doc_id ORDER BY p, i) AS seen FROM hits) WHERE p = 99 OR own <= greatest(1, 51 - (seen - own)))"
    return _TEXTS + ", hits AS (" + " UNION ALL ".join(parts) + f"), {stop}, found AS (SELECT DISTINCT ON (doc_id, kind, value) doc_id, p, i, kind, severity, value FROM (SELECT *, {_HIDE.format(v='h')} AS value FROM kept) ORDER BY doc_id, kind, value, p, i)"


_FOUND = _pii_sql()


def found(spark, sf) -> DataFrame:
    return dlp.scan_text(texts(spark, sf))


@query("d11_pii_region_scan", _FOUND + "SELECT doc_id, kind, severity, value FROM found")
def d11(spark, sf):
    return dlp.finding_rows(found(spark, sf)).select("doc_id", "kind", "severity", "value")


@query("d12_high_entropy_tokens", _FOUND + "SELECT doc_id, value FROM found WHERE kind = 'highEntropy'")
def d12(spark, sf):
    rows = texts(spark, sf).select("doc_id", F.explode(F.array_distinct(dlp.high_entropy(F.col("text")))).alias("f"))
    return rows.select("doc_id", "f.value")


@query("d13_dedupe_findings", _FOUND + "SELECT kind, value, count(*) AS n_docs, min(doc_id) AS first_doc FROM found GROUP BY kind, value")
def d13(spark, sf):
    rows = dlp.finding_rows(found(spark, sf)).dropDuplicates(["doc_id", "kind", "value"])
    return rows.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"))


_TOP = "CASE max(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END"


@query("d14_top_severity", _FOUND + f"SELECT doc_id, {_TOP} AS top_severity FROM found GROUP BY doc_id")
def d14(spark, sf):
    return found(spark, sf).where(F.size("found") > 0).select("doc_id", dlp.top_severity(F.col("found")).alias("top_severity"))


@query("d15_paste_decision", _FOUND + """, a AS (SELECT doc_id, bool_or(kind IN ('awsKey', 'ghToken', 'jwt')) AS strong, bool_or(kind NOT IN ('highEntropy', 'email')) AS validated, max(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS top, count(*) AS n, count(DISTINCT kind) AS kinds FROM found GROUP BY doc_id)
SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'ignore' WHEN strong THEN CASE WHEN top >= 3 THEN 'warn' ELSE 'toast' END WHEN validated AND top > 1 THEN 'toast' WHEN n >= 3 AND kinds >= 2 THEN 'toast' ELSE 'ignore' END AS action FROM a""")
def d15(spark, sf):
    strong = F.transform("found", lambda f: F.struct(F.when(f["kind"] == "highEntropy", "entropy").otherwise(f["kind"]).alias("kind"), f["severity"].alias("severity"), F.when(f["kind"].isin("awsKey", "ghToken", "jwt"), 0.9).otherwise(0.6).alias("confidence")))
    rows = found(spark, sf).where(F.size("found") > 0)
    return rows.select("doc_id", dlp.paste_decision(strong, F.col("doc_id") % 10 == 0).alias("action"))


_LOGGED = "CASE WHEN length(v) > 64 THEN left(v, 32) || '…[trunc]' WHEN regexp_matches(v, '(?i)^https?://') THEN CASE WHEN regexp_extract(v, '(?i)^https?://(?:[^/?#@]*@)?([^/?#]*)', 1) = '' THEN '[url]' ELSE lower(regexp_extract(v, '(?i)^https?://(?:[^/?#@]*@)?([^/?#]*)', 1)) END WHEN contains(v, '@') AND regexp_matches(v, '(?i)\\.[a-z]{2,}') THEN '[email]' WHEN regexp_matches(v, '[A-Za-z0-9_\\-]{20,}') THEN '[token]' ELSE v END"


#: A log entry of each kind of value: strings, numbers, secret-named keys, nested entries, arrays.
_ENTRY = """SELECT url_id, map('url', url, 'who', concat('user', url_id, '@mail.example'), 'code', concat('k', url_id), 'auth_header', concat('x', url_id)) AS plain, array(url, concat('n', url_id), 'a', 'b', 'c', 'd', 'e', 'f', 'g', 'h', 'i', 'j') AS items FROM urls"""
_KEYED = "SELECT url_id, unnest(['url', 'who', 'code', 'auth_header']) AS k, unnest([url, 'user' || url_id || '@mail.example', 'k' || url_id, 'x' || url_id]) AS v FROM urls"
_ITEMS = "SELECT url_id, 'items' AS k, unnest([url, 'n' || url_id, 'a', 'b', 'c', 'd', 'e', 'f', 'g', 'h']) AS v FROM urls"


@query("d16_redact_log_payload", f"WITH {O.URLS}, v AS ({_KEYED} UNION ALL {_ITEMS}) SELECT url_id, k AS key, CASE WHEN regexp_matches(k, '(?i)value|token|password|secret|cookie|auth|email') THEN '[redacted]' ELSE {_LOGGED} END AS logged FROM v")
def d16(spark, sf):
    rows = spark.sql(_ENTRY.replace("FROM urls", "FROM {urls}"), urls=url_table(spark, sf))
    rows = rows.select("url_id", dlp.log_map(F.col("plain")).alias("plain"), dlp.log_array(F.col("items")).alias("items"))
    keyed = rows.select("url_id", F.explode("plain").alias("key", "logged"))
    return keyed.unionByName(rows.select("url_id", F.lit("items").alias("key"), F.explode("items").alias("logged")))


@query("d17_dlp_file_report", _FOUND + f"SELECT doc_id, count(*) AS n_findings, {_TOP} AS top_severity, array_to_string(list(kind ORDER BY p, i)[1:6], ',') AS items, CASE WHEN {_TOP} = 'low' THEN 'log' ELSE 'warn' END AS action FROM found GROUP BY doc_id")
def d17(spark, sf):
    return dlp.file_report(found(spark, sf))


# pages ----------------------------------------------------------------------------------------------


def page_table(spark, sf) -> DataFrame:
    return spread(I.derived(spark, sf, I.PAGES), f"{sf}/pages.parquet")


def page_facts(spark, sf, beginning: bool = True) -> DataFrame:
    """Facts of pages: of their beginning where a query's SQL has limits of texts and lists, else of whole pages."""
    return pages.page_facts(page_table(spark, sf), blocklist(spark, sf), evidence(spark, sf), beginning)


def page_verdicts(spark, sf, beginning: bool = True) -> DataFrame:
    """Scores need no texts: these aren't written with the facts."""
    return scoring.score(kept(page_facts(spark, sf, beginning).drop("text_sample", "visible_text"), "page-facts"))


_PAGES = f"WITH pg AS ({I.PAGES})"
_FORMS = _PAGES + r""", f AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<form\b[^>]*>.*?</form>')[1:10]) AS f, generate_subscripts(regexp_extract_all(html, '(?is)<form\b[^>]*>.*?</form>')[1:10], 1) - 1 AS form_no FROM pg),
i AS (SELECT page_id, form_no, f, regexp_extract_all(f, '(?is)<input\b[^>]*>') AS inputs, regexp_extract(f, '(?is)^(<form\b[^>]*>)', 1) AS head FROM f)"""


@query("p1_page_context", _PAGES + r"""SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>([^<]*)', 1)) AS title, regexp_matches(html, '(?is)<input[^>]+type\s*=\s*["'']?password') AS has_password, least(10, len(regexp_extract_all(html, '(?is)<form\b[^>]*>.*?</form>'))) AS n_forms,
len(list_filter(regexp_extract_all(html, '(?is)<script\b[^>]*>'), lambda t: regexp_extract(t, '(?is)\bsrc\s*=\s*["'']([^"'']*)["'']', 1) <> '')) AS n_scripts, len(list_filter(regexp_extract_all(html, '(?is)<a\b[^>]*>'), lambda t: regexp_extract(t, '(?is)\bhref\s*=\s*["'']([^"'']*)["'']', 1) <> '')) AS n_links,
left(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'), 4000) AS text_sample FROM pg""")
def p1(spark, sf):
    c = pages.page_context(page_table(spark, sf), beginning=True)
    return c.select("page_id", "title", "has_password", F.size("forms").cast("long").alias("n_forms"), F.size("scripts").cast("long").alias("n_scripts"), F.size("links").cast("long").alias("n_links"), "text_sample")


@query("p2_page_forms", _FORMS + r"""SELECT page_id, form_no, regexp_extract(head, '(?is)\baction\s*=\s*["'']([^"'']*)["'']', 1) AS action, lower(CASE WHEN regexp_extract(head, '(?is)\bmethod\s*=\s*["'']([^"'']*)["'']', 1) = '' THEN 'post' ELSE regexp_extract(head, '(?is)\bmethod\s*=\s*["'']([^"'']*)["'']', 1) END) AS method,
len(list_filter(inputs, lambda t: regexp_matches(t, '(?is)\btype\s*=\s*["'']?password'))) > 0 AS has_password, len(list_filter(inputs, lambda t: regexp_matches(t, '(?is)\btype\s*=\s*["'']?email') OR regexp_matches(lower(regexp_extract(t, '(?is)\bname\s*=\s*["'']([^"'']*)["'']', 1)), 'email|user(name)?|login|account'))) > 0 AS has_email_like,
len(list_filter(inputs, lambda t: regexp_matches(lower(regexp_extract(t, '(?is)\bname\s*=\s*["'']([^"'']*)["'']', 1)), 'otp|one[-_ ]?time|2fa|mfa|verification[-_ ]?code'))) > 0 AS has_otp, len(list_filter(inputs, lambda t: regexp_matches(t, '(?is)\btype\s*=\s*["'']?hidden')))::INT AS hidden_count, len(inputs)::INT AS fields_count, page_id % 13 = 0 AS inside_iframe FROM i""")
def p2(spark, sf):
    rows = pages.page_forms(pages.page_context(page_table(spark, sf), beginning=True))
    return rows.withColumn("form_no", F.col("form_no").cast("long"))


@query("p3_visible_text", "WITH " + OP.PAGES + ", " + OP.VISIBLE + "SELECT page_id, visible_text FROM seen")
def p3(spark, sf):
    return page_table(spark, sf).select("page_id", pages.visible_text("html").alias("visible_text"))


@query("p4_oauth_buttons", _PAGES + r"SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(html), '(?s)<(?:button|a)\b[^>]*>\s*sign in with (google|microsoft|apple|facebook|github|twitter|x|linkedin)', 1))), ',') AS providers FROM pg WHERE regexp_matches(lower(html), '(?s)<(?:button|a)\b[^>]*>\s*sign in with (google|microsoft|apple|facebook|github|twitter|x|linkedin)')")
def p4(spark, sf):
    return pages.page_context(page_table(spark, sf)).where(F.size("oauth_buttons") > 0).select("page_id", F.array_join(F.array_sort("oauth_buttons"), ",").alias("providers"))


def _page_query(name: str, columns, sql: str, beginning: bool = True):
    """Registers a query over page facts; ``columns`` is called when it runs, as columns need a session."""

    @query(name, (OP.TO_PAGE_FACTS if beginning else OP.WHOLE_PAGE_FACTS) + f"SELECT url_id AS page_id, {sql} FROM facts")
    def run(spark, sf):
        return page_facts(spark, sf, beginning).select("page_id", *columns())


def _ids(c: str):
    return F.array_join(F.transform(c, lambda s: s["id"]), ",")


_IDS = lambda c: f"array_to_string(list_transform({c}, lambda s: s.id), ',')"
_page_query("p5_phishing_signals", lambda: (_ids("page_signals").alias("signals"), "creds", "auth_risk", "page_external_post", "page_cap", "page_force", F.round("phish_conf", 6).alias("phish_conf"),), f"{_IDS('page_signals')} AS signals, creds, auth_risk, page_external_post, page_cap, page_force, round(phish_conf, 6) AS phish_conf", beginning=False)
_page_query("p6_brand_impersonation", lambda: (F.col("brand_hit.brand").alias("brand"), F.col("brand_hit.evidence").alias("evidence"), "brand_text",), "brand_hit.brand AS brand, brand_hit.evidence AS evidence, brand_text")
_page_query("p7_external_form_post", lambda: ("page_external_post", F.array_join(F.transform("targets", lambda t: t["target_root"]), ",").alias("target_roots"),), "page_external_post, array_to_string(list_transform(targets, lambda t: t.target_root), ',') AS target_roots")
_page_query("p8_clone_signals", lambda: ("favicon_mismatch", "brand_image", "layout_signal", F.col("clone_signals").cast("long").alias("clone_signals"), F.round("clone_conf", 6).alias("clone_conf"),), "favicon_mismatch, brand_image, layout_signal, clone_signals::BIGINT AS clone_signals, round(clone_conf, 6) AS clone_conf")
_page_query("p9_auth_layout_fingerprint", lambda: ("zones", F.round("hidden_ratio", 6).alias("hidden_ratio"),), "zones, round(hidden_ratio, 6) AS hidden_ratio")
_page_query("p10_auth_layout_match", lambda: ("layout_template", "layout_match",), "layout_template, layout_match", beginning=False)
_page_query("p11_security_context", lambda: (F.col("research_terms").cast("long").alias("research_terms"), F.col("education_terms").cast("long").alias("education_terms"), F.col("auth_doc_terms").cast("long").alias("auth_doc_terms"), "context_score",), "research_terms, education_terms, auth_doc_terms, context_score")


def _re2(p: str) -> str:
    return p.replace("'", "''")


_CODES = r"regexp_extract_all(html, '(?is)<code>(.*?)</code>', 1)"
_CMDS = "[" + ", ".join(f"CASE WHEN regexp_matches(c, '(?i){_re2(p)}') THEN '{i}' END" for i, p, _ in pages.COMMANDS) + "]"
_STRONG = O.members([i for i, _, s in pages.COMMANDS if s])


def codes():
    return F.regexp_extract_all("html", F.lit(r"(?is)<code>(.*?)</code>"), F.lit(1))


@query("p12_clickfix_commands", _PAGES + f", b AS (SELECT page_id, unnest({_CODES}) AS c, generate_subscripts({_CODES}, 1) AS block FROM pg), h AS (SELECT page_id, block, list_filter({_CMDS}, lambda x: x IS NOT NULL) AS hits FROM (SELECT page_id, block, left(c, 8000) AS c FROM b) WHERE length(c) >= 6) SELECT page_id, block::BIGINT AS block, array_to_string(hits, ',') AS techniques, round(CASE WHEN len(list_filter(hits, lambda x: x IN {_STRONG})) > 0 THEN least(0.98, 0.85 + (len(hits) - 1) * 0.05) ELSE least(0.8, 0.5 + (len(hits) - 1) * 0.1) END, 6)::DOUBLE AS command_conf FROM h WHERE len(hits) > 0")
def p12(spark, sf):
    blocks = page_table(spark, sf).select("page_id", F.posexplode(codes()).alias("block", "code"))
    rows = blocks.withColumns(pages.clickfix_commands(F.col("code"))).where("techniques <> ''")
    return rows.select("page_id", (F.col("block") + 1).cast("long").alias("block"), "techniques", F.round("command_conf", 6).alias("command_conf"))


_PLAIN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')"
_ANY = lambda ps: "(" + " OR ".join(f"regexp_matches(t, '(?i){_re2(p)}')" for p in ps) + ")"
_N = lambda ps: "(" + " + ".join(f"regexp_matches(t, '(?i){_re2(p)}')::INT" for p in ps) + ")"


@query("p13_clickfix_page_verdict", _PAGES + f", c AS (SELECT page_id, list_filter(list_transform({_CODES}, lambda c: left(c, 8000)), lambda c: length(c) >= 6) AS cs, left({_PLAIN}, 20000) AS t FROM pg), h AS (SELECT page_id, flatten(list_transform(cs, lambda c: list_filter({_CMDS}, lambda x: x IS NOT NULL))) AS hits, {_ANY(pages.RUN_PHRASES)} AS run_phrase, {_ANY(pages.VERIFY_PHRASES)} AS fake_verify FROM c) SELECT page_id, run_phrase, fake_verify, CASE WHEN len(hits) > 0 THEN 'critical' WHEN run_phrase AND fake_verify THEN 'high' ELSE 'none' END AS clickfix_severity FROM h")
def p13(spark, sf):
    rows = page_table(spark, sf).withColumns({"code": codes(), "plain": pages.html_text(F.col("html"))})
    return pages.clickfix(rows, "code", "plain").select("page_id", "run_phrase", "fake_verify", "clickfix_severity")


_TEL = r"regexp_matches(html, '(?is)href\s*=\s*[\"'']tel:')"
_POINTS = "least(alarm_hits, 2) * 0.28e0 + least(call_hits, 2) * 0.3e0 + CASE WHEN vendor_hit THEN 0.18e0 ELSE 0e0 END + least(cues, 2) * 0.2e0"


@query("p14_scareware_verdict", _PAGES + f", c AS (SELECT page_id, left({_PLAIN}, 20000) AS t, {_TEL}::INT AS cues FROM pg), h AS (SELECT page_id, cues, {_N(pages.ALARMS)} AS alarm_hits, {_N(pages.CALLS)} AS call_hits, regexp_matches(t, '(?i){pages.VENDORS}') AS vendor_hit FROM c) SELECT page_id, alarm_hits::INT AS alarm_hits, call_hits::INT AS call_hits, vendor_hit, cues >= 1 AND (alarm_hits >= 1 OR call_hits >= 1) AND {_POINTS} >= 0.6 AS scam FROM h")
def p14(spark, sf):
    rows = page_table(spark, sf).withColumns({"plain": pages.html_text(F.col("html")), "tel": F.col("html").rlike(r"(?is)href\s*=\s*[\"']tel:").cast("int")})
    return pages.scareware(rows, "plain", F.col("tel")).select("page_id", "alarm_hits", "call_hits", "vendor_hit", "scam")


_RULE_ROWS = "[" + ", ".join(f"struct_pack(rule_id := '{i}', severity := '{v}', category := '{c}', matched := coalesce({cond}, false), contribution := CASE WHEN {cond} THEN {p} ELSE 0 END)" for i, v, c, p, cond in pages.PAGE_RULES) + "]"


@query("p15_page_rule_registry", OP.TO_PAGE_FACTS + f", r AS (SELECT url_id AS page_id, unnest({_RULE_ROWS}) AS r FROM facts) SELECT page_id, r.rule_id AS rule_id, r.severity AS severity, r.category AS category, r.matched AS matched, r.contribution AS contribution FROM r")
def p15(spark, sf):
    return pages.page_rules(page_facts(spark, sf))


@query("a4_context_damping", OP.WHOLE_PAGE_VERDICTS + "SELECT url_id AS page_id, context_score, damping, damping_points FROM verdicts")
def a4(spark, sf):
    return page_verdicts(spark, sf, beginning=False).select("page_id", "context_score", "damping", "damping_points")


@query("a5_trust_decay", OP.TO_PAGE_VERDICTS + "SELECT url_id AS page_id, reputable, provider, decay::BIGINT AS decay FROM verdicts")
def a5(spark, sf):
    return page_verdicts(spark, sf).select("page_id", "reputable", "provider", F.col("decay").cast("long").alias("decay"))


@query("a11_page_verdict", OP.WHOLE_PAGE_VERDICTS + f"SELECT url_id AS page_id, score::INT AS score, status, level, {_IDS('rules')} AS rules, confidence, phishing_confidence FROM verdicts")
def a11(spark, sf):
    return page_verdicts(spark, sf, beginning=False).select("page_id", "score", "status", "level", _ids("rules").alias("rules"), "confidence", "phishing_confidence")


@query("j10_third_party_assets", OP.TO_PAGED + f", a AS (SELECT url_id AS page_id, root, unnest(assets) AS asset FROM page0), h AS (SELECT *, {OP._HOST_OF('asset')} AS asset_host FROM a) SELECT page_id, asset, asset_host FROM h WHERE {OP._FOREIGN('asset_host')}")
def j10(spark, sf):
    return pages.third_party_assets(pages.page_context(page_table(spark, sf), beginning=True)).select("page_id", "asset", "asset_host")


@query("j11_adblock_match", O.TO_FEED + r""", ads AS (SELECT DISTINCT regexp_extract(line, '^\|\|([a-z0-9.-]+)', 1) AS domain FROM feed WHERE starts_with(line, '||')), req AS (SELECT page_id AS request_id, 'cdn' || (page_id % 5) || '.track' || (page_id % 60) || '.example.com' AS resource_host, CASE WHEN page_id % 4 = 0 THEN 'main_frame' ELSE 'script' END AS resource_type FROM pages)
SELECT request_id, domain FROM req JOIN ads ON resource_host = domain OR ends_with(resource_host, '.' || domain) WHERE resource_type <> 'main_frame'""")
def j11(spark, sf):
    domains = feed_table(spark, sf).where(F.startswith("line", F.lit("||"))).select(feeds.ad_domain(F.col("line")).alias("domain"))
    requests = spark.read.parquet(f"{sf}/pages.parquet").selectExpr("page_id AS request_id", "'cdn' || (page_id % 5) || '.track' || (page_id % 60) || '.example.com' AS resource_host", "CASE WHEN page_id % 4 = 0 THEN 'main_frame' ELSE 'script' END AS resource_type")
    return feeds.ad_match(requests, domains)


_RUNS_FILE = pages.DANGEROUS.replace("'", "''")


@query("j12_dangerous_downloads", OP.TO_PAGE_VERDICTS + f", l AS (SELECT url_id AS page_id, page_origin, status, unnest(links) AS href FROM verdicts), d AS (SELECT page_id, href, status IN ('suspicious', 'dangerous') AS low_trust, regexp_matches(href, '(?i)^https?://') AND lower(regexp_extract(href, '{O._RE}', 1)) || '://' || lower(regexp_extract(href, '{O._RE}', 3)) <> page_origin AS cross_origin FROM l WHERE regexp_matches(href, '{_RUNS_FILE}')) SELECT page_id, href, CASE WHEN low_trust THEN 'high' ELSE 'medium' END AS severity, cross_origin FROM d WHERE low_trust OR cross_origin")
def j12(spark, sf):
    verdicts = page_verdicts(spark, sf).select("page_id", "status")
    return pages.dangerous_downloads(pages.page_context(page_table(spark, sf)), verdicts).select("page_id", "href", "severity", "cross_origin")


#: Forms of up to eight fields each, so their number grows with the table and not their text; some go to another host.
_SUBMITS = """SELECT submit_id, concat('https://shop', submit_id % 5, '.example/form') AS page_url,
  CASE submit_id % 6 WHEN 0 THEN '' WHEN 1 THEN '/save' WHEN 2 THEN concat('https://shop', submit_id % 5, '.example/save') WHEN 3 THEN concat('//collect', submit_id % 3, '.example/in') ELSE concat('https://collect', submit_id % 7, '.example/in') END AS action
  FROM (SELECT DISTINCT doc_id DIV 8 AS submit_id FROM documents) d"""


@query("j13_cross_domain_submissions")
def j13(spark, sf):
    kind = F.when(F.col("doc_id") % 11 == 0, "password").when(F.col("doc_id") % 13 == 0, "hidden").otherwise("text")
    fields = texts(spark, sf).select(F.expr("doc_id DIV 8").alias("submit_id"), F.col("doc_id").alias("place"), kind.alias("field_type"), F.col("text").alias("value"))
    return dlp.submissions(fields, I.derived(spark, sf, _SUBMITS))


@query("d16_redact_nested_log", f"""WITH {O.URLS}, e AS (SELECT url_id, url, 'k' || url_id AS k FROM urls), l AS (SELECT url_id, k, {_LOGGED.replace("v,", "url,").replace("(v)", "(url)").replace("ELSE v END", "ELSE url END")} AS u FROM e)
SELECT url_id, '{{"page": {{"url": "' || u || '", "tag": "' || k || '", "deep": {{"x": "[depth]", "n": "[depth]"}}, "session_token": "[redacted]"}}, "items": ["' || u || '", 1, true, null' || repeat(', "y"', 6) || '], "password": "[redacted]", "n": ' || url_id || '}}' AS logged FROM l""")
def d16_nested(spark, sf):
    """Entries with entries in them, two levels deep, and lists that are cut."""
    entry = F.to_json(F.struct(F.struct(F.col("url").alias("url"), F.concat(F.lit("k"), "url_id").alias("tag"), F.struct(F.struct(F.lit(1).alias("y")).alias("x"), F.lit(7).alias("n")).alias("deep"), F.lit("abc").alias("session_token")).alias("page"), F.lit("ITEMS").alias("items"), F.lit("hidden").alias("password"), F.col("url_id").alias("n")))
    items = F.concat(F.lit("["), F.to_json(F.struct("url")).substr(F.lit(8), F.length(F.to_json(F.struct("url"))) - 8), F.lit(', 1, true, null' + ', "y"' * 9 + "]"))
    return url_table(spark, sf).select("url_id", dlp.safe_log(F.replace(entry, F.lit('"ITEMS"'), items)).alias("logged"))


@query("g1_threat_metrics", f"SELECT (SELECT count(*) FROM ({SQL['a10_url_verdict']}) v WHERE status = 'dangerous') AS threats_prevented, (SELECT count(*) FROM ({SQL['a10_url_verdict']}) v WHERE status = 'suspicious') AS suspicious, (SELECT count(*) FROM ({SQL['a10_url_verdict']}) v) AS n, (SELECT count(*) FROM ({SQL['d15_paste_decision']}) p WHERE action = 'warn') AS pastes_blocked, (SELECT count(*) FROM ({SQL['p13_clickfix_page_verdict']}) c WHERE clickfix_severity = 'critical') AS clickfix_blocked")
def g1(spark, sf):
    """Counters of what was prevented: addresses, pastes that were held back, copied commands that were defused."""
    kinds = verdicts(spark, sf).select(F.lit("url").alias("of"), F.col("status").alias("what"))
    kinds = kinds.unionByName(d15(spark, sf).select(F.lit("paste").alias("of"), F.col("action").alias("what"))).unionByName(p13(spark, sf).select(F.lit("command").alias("of"), F.col("clickfix_severity").alias("what")))
    count = lambda of, what=None: F.count_if((F.col("of") == of) & (F.col("what") == what if what else F.lit(True)))
    return kinds.agg(count("url", "dangerous").alias("threats_prevented"), count("url", "suspicious").alias("suspicious"), count("url").alias("n"), count("paste", "warn").alias("pastes_blocked"), count("command", "critical").alias("clickfix_blocked"))


@query("g11_asset_origin_ratio", OP.TO_PAGED + "SELECT url_id AS page_id, n_assets, n_foreign, n_foreign / n_assets >= 0.5 AND n_foreign >= 3 AS informational FROM paged WHERE n_assets > 0")
def g11(spark, sf):
    rows = page_facts(spark, sf).where("n_assets > 0")
    return rows.select("page_id", F.col("n_assets").cast("long").alias("n_assets"), F.col("n_foreign").cast("long").alias("n_foreign"), F.expr("n_foreign / n_assets >= 0.5 AND n_foreign >= 3").alias("informational"))


# classifier -----------------------------------------------------------------------------------------

_FEATURES = [k for k in ("not_https", "punycode", "abused_tld_f", "many_subdomains", "host_digits_ratio", "host_hyphens", "lure_tokens", "brand_in_subdomain")]


def features(spark, sf) -> DataFrame:
    parts = urls.reputation(urls.host_facts(urls.url_parts(url_table(spark, sf))))
    return urls.url_features(parts)


@query("c1_host_features", O.TO_FACTS + "SELECT url_id, " + ", ".join(k if k != "host_digits_ratio" else "round(host_digits_ratio, 9) AS host_digits_ratio" for k in _FEATURES) + " FROM facts")
def c1(spark, sf):
    return features(spark, sf).select("url_id", *[F.round(k, 9).alias(k) for k in _FEATURES])


@query("c2_dom_features", OP.TO_PAGED + "SELECT url_id AS page_id, has_password_field, cross_origin_form, many_external_scripts, obfuscation FROM paged")
def c2(spark, sf):
    return page_facts(spark, sf).select("page_id", "has_password_field", "cross_origin_form", "many_external_scripts", "obfuscation")


@query("c3_classify_pages", O.TO_FACTS + "SELECT url_id, probability, CASE WHEN probability >= 0.92 THEN 'phishing' WHEN probability >= 0.8 THEN 'suspicious' ELSE 'benign' END AS label FROM facts")
def c3(spark, sf):
    rows = urls.classify(urls.no_page(urls.with_evidence(features(spark, sf))))
    return rows.select("url_id", "probability", F.when(F.col("probability") >= 0.92, "phishing").when(F.col("probability") >= 0.8, "suspicious").otherwise("benign").alias("label"))


_TERMS = "[" + ", ".join(f"struct_pack(k := -floor({k} * {w}e0 * 100 + 0.5) / 100, place := {i}, feature := '{k}')" for i, (k, w) in enumerate(urls.R.CLASSIFIER)) + "]"


@query("c4_top_contributors", O.TO_FACTS + f"SELECT url_id, array_to_string(list_transform(list_sort(list_filter({_TERMS}, lambda t: t.k < 0))[1:4], lambda t: t.feature), ',') AS top FROM facts")
def c4(spark, sf):
    rows = urls.no_page(urls.with_evidence(features(spark, sf)))
    return rows.select("url_id", F.array_join(F.transform(urls.top_contributors(), lambda t: t["feature"]), ",").alias("top"))


def corpus(spark, sf) -> DataFrame:
    top = urls.url_parts(url_table(spark, sf)).where("valid").select("host", F.col("url_id").alias("rank"))
    rows = feeds.training_corpus(feed_table(spark, sf), top, 6000)
    parts = urls.url_parts(rows.select("label", F.concat(F.lit("https://"), "host", F.lit("/")).alias("url")))
    return urls.url_features(urls.reputation(urls.host_facts(parts)))


@query("c5_train_classifier")
def c5(spark, sf):
    model = classifier.train(corpus(spark, sf))
    rows = [("bias", model["bias"], model["n_rows"]), *((k, w, model["n_rows"]) for k, w in model["weights"].items())]
    return spark.createDataFrame(rows, "feature string, weight double, n_rows long")


@query("c6_eval_thresholds")
def c6(spark, sf):
    """The fitted model on the hosts that it was not fitted on."""
    table = corpus(spark, sf)
    return classifier.thresholds(classifier.apply(table.where(classifier.held_out()), classifier.train(table), "probability"))


#: A model of top-level domains and wording alone, for the bundled one to be held against.
_PLAIN_MODEL = {"bias": -1.519, "weights": {"abused_tld_f": 2.0011, "lure_tokens": 0.2319}}
_PLAIN_Z = f"{_PLAIN_MODEL['bias']}e0 + " + " + ".join(f"{k} * {w}e0" for k, w in _PLAIN_MODEL["weights"].items())
_CORPUS_URLS = f"urls AS (SELECT row_number() OVER (ORDER BY host) AS url_id, 'https://' || host || '/' AS url, label, NULL::BIGINT AS tab_id, NULL::DOUBLE AS age_days FROM ({SQL['e8_training_corpus'].replace('LIMIT 500', 'LIMIT 6000')}) e8)"
_GATE = "WITH " + ", ".join((_CORPUS_URLS, *O._URL_FEATURES[1:])) + f""", s AS (SELECT label, contains(host, 'login') AS is_login, CASE WHEN trusted THEN 0e0 ELSE floor(1 / (1 + exp(-({O._Z.replace("has_password_field", "0e0").replace("cross_origin_form", "0e0").replace("many_external_scripts", "0e0").replace("obfuscation", "0e0")}))) * 100 + 0.5) / 100 END AS p_new,
  CASE WHEN trusted THEN 0e0 ELSE floor(1 / (1 + exp(-({_PLAIN_Z}))) * 100 + 0.5) / 100 END AS p_old FROM features WHERE ('0x' || substr(md5(host), 1, 8))::BIGINT % 5 = 0)"""


@query("c7_adopt_gate", _GATE + ", a AS (SELECT  count(*) FILTER (WHERE label = 1) AS n_bad, count(*) FILTER (WHERE label <> 1) AS n_good, " + ", ".join(f"count(*) FILTER (WHERE p_{k} >= 0.8 AND label = 1) AS tp_{k}, count(*) FILTER (WHERE p_{k} >= 0.8 AND label <> 1) AS fp_{k}, count(*) FILTER (WHERE p_{k} >= 0.8 AND label <> 1 AND is_login) AS login_fp_{k}" for k in ("new", "old")) + " FROM s) SELECT n_bad, n_good, tp_new, fp_new, tp_old, fp_old, n_bad >= 10 AND n_good >= 10 AND tp_new / n_bad > tp_old / n_bad + 0.02 AND CASE WHEN tp_new + fp_new > 0 THEN tp_new / (tp_new + fp_new) ELSE 0 END >= CASE WHEN tp_old + fp_old > 0 THEN tp_old / (tp_old + fp_old) ELSE 0 END - 0.02 AND login_fp_new <= login_fp_old AS adopt FROM a")
def c7(spark, sf):
    """Whether the bundled model replaces a simpler one, by the hosts of the corpus that are held out."""
    rows = urls.classify(urls.no_page(urls.with_evidence(corpus(spark, sf)))).where(classifier.held_out()).withColumnRenamed("probability", "p_new")
    rows = classifier.apply(rows, _PLAIN_MODEL, "p_old").withColumn("is_login", F.col("host").contains("login"))
    return classifier.adopt_gate(rows, least=10).select("n_bad", "n_good", "tp_new", "fp_new", "tp_old", "fp_old", "adopt")
