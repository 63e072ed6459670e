"""Common table expressions of the oracle SQL (DuckDB) for pages: the same facts from the same HTML, written a
second time. The visible text is written for the markup of the given pages: in their bodies all text but that of ads,
code and footers stands in elements whose text counts, and nothing is hidden. Expressions named ``WHOLE`` are the same over
whole pages; the others count the beginning of texts and the first forms, scripts, styles and images."""

from __future__ import annotations

from ..functions import constants as C
from ..operators import pages as P
from . import inputs as I
from . import oracle_parts as O


def _q(text: str) -> str:
    return text.replace("'", "''")


def attribute(tag: str, name: str) -> str:
    return rf"""regexp_extract({tag}, '(?is)\b{name}\s*=\s*["'']([^"'']*)["'']', 1)"""


def tags(html: str, name: str) -> str:
    return rf"regexp_extract_all({html}, '(?is)<{name}\b[^>]*>')"


def filled(tag: str, name: str, most: str = "") -> str:
    return f"list_filter(list_transform({tags('html', tag)}, lambda t: {attribute('t', name)}), lambda x: x <> ''){most}"


PAGES = f"pg AS ({I.PAGES})"
_NO = "CASE WHEN trim(regexp_replace(plain0, '\\s+', ' ', 'g')) <> '' THEN ' ' || trim(regexp_replace(plain0, '\\s+', ' ', 'g')) ELSE '' END"
_ENTITIES = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '\"', 'g'), '&amp;?', '&', 'g')"
_VISIBLE = rf"""seen0 AS (SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>([^<]*)', 1) AS head, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->|<title.*?</title>|<code>.*?</code>|<div class="ad">.*?</div>|<footer>.*?(?:</footer>|$)', '', 'g'), '(?s)<div class="ad">.*$', ''), '<[^>]*$', '') AS body FROM pg),
seen1 AS (SELECT page_id, head, regexp_replace(body, '<[^>]*>', ' ', 'g') AS plain0 FROM seen0), seen AS (SELECT page_id, {{}} AS visible_text FROM seen1)"""
_SEEN = _ENTITIES.format("trim(head) || " + _NO)
VISIBLE, WHOLE_VISIBLE = (_VISIBLE.replace("{}", text) for text in (f"left({_SEEN}, 4000)", _SEEN))

_NAMING = "lower(" + " || ' ' || ".join(attribute("t", n) for n in ("name", "id", "autocomplete")) + ")"
_KIND = r"""lower(regexp_extract(t, '(?is)\btype\s*=\s*["'']?([A-Za-z-]+)', 1))"""
_ANY_INPUT = lambda cond: f"len(list_filter(inputs, lambda t: {cond})) > 0"
_PLAIN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')"
#: Facts of the HTML alone.
CONTEXT = rf"""form0 AS (SELECT page_id, in_frame, unnest(regexp_extract_all(html, '(?is)<form\b[^>]*>.*?</form>')[1:10]) AS f, generate_subscripts(regexp_extract_all(html, '(?is)<form\b[^>]*>.*?</form>')[1:10], 1) AS form_no FROM pg),
form1 AS (SELECT *, {tags('f', 'input')} AS inputs, regexp_extract(f, '(?is)^(<form\b[^>]*>)', 1) AS head FROM form0),
form2 AS (SELECT page_id, form_no, struct_pack(action := {attribute('head', 'action')}, method := lower(CASE WHEN {attribute('head', 'method')} = '' THEN 'post' ELSE {attribute('head', 'method')} END), has_password := {_ANY_INPUT(_KIND + " = 'password'")}, has_email_like := {_ANY_INPUT(f"{_KIND} = 'email' OR regexp_matches({_NAMING}, 'email|user(name)?|login|account')")},
  has_otp := {_ANY_INPUT(f"regexp_matches({_NAMING}, 'otp|one[-_ ]?time|2fa|mfa|verification[-_ ]?code')")}, hidden_count := len(list_filter(inputs, lambda t: {_KIND} = 'hidden')), fields_count := len(inputs), inside_iframe := in_frame) AS form FROM form1),
form3 AS (SELECT page_id, list(form ORDER BY form_no) AS forms FROM form2 GROUP BY page_id),
context AS (SELECT pg.page_id, pg.in_frame, pg.hidden_overlay, pg.csp_weakened, trim(regexp_extract(html, '(?is)<title[^>]*>([^<]*)', 1)) AS title, visible_text, regexp_matches(html, '(?is)<input[^>]+type\s*=\s*["'']?password') AS has_password, coalesce(forms, []) AS forms,
  {filled('script', 'src', '[1:60]')} AS scripts, list_filter(list_transform(list_filter({tags('html', 'link')}, lambda t: lower({attribute('t', 'rel')}) = 'stylesheet'), lambda t: {attribute('t', 'href')}), lambda x: x <> '')[1:60] AS styles, {filled('img', 'src', '[1:60]')} AS images, {filled('a', 'href')} AS links,
  coalesce({attribute(f"list_filter({tags('html', 'link')}, lambda t: contains(lower({attribute('t', 'rel')}), 'icon'))[1]", 'href')}, '') AS favicon, list_distinct(regexp_extract_all(lower(html), '(?s)<(?:button|a)\b[^>]*>\s*sign in with (google|microsoft|apple|facebook|github|twitter|x|linkedin)', 1)) AS oauth_buttons,
  regexp_matches(html, '(?is)<img\b') AS has_logo_image, regexp_matches(html, '(?is)<h[12]\b') AS has_heading, left({_PLAIN}, 4000) AS text_sample FROM pg JOIN seen USING (page_id) LEFT JOIN form3 ON form3.page_id = pg.page_id)"""

_HOST = lambda u: f"regexp_replace(lower(regexp_extract({u}, '{O._RE}', 3)), '^www\\.', '')"
_ABSOLUTE = lambda u: f"CASE WHEN starts_with({u}, '//') THEN 'https:' || {u} ELSE {u} END"
_HOST_OF = lambda u: _HOST(f"({_ABSOLUTE(u)})")
_BELOW = lambda h, names: f"len(list_filter({O.strings(names)}, lambda c: {h} = c OR ends_with({h}, '.' || c))) > 0"
_FOREIGN = lambda h: f"({h} <> '' AND {O.root_of(h)} <> root AND NOT ({_BELOW(h, C.CDN_HOSTS)}) AND NOT ({_BELOW(h, C.INFRA_HOSTS)}))"
_BRAND = lambda h: f"list_contains({O.strings(C.CLONE_BRANDS)}, {O.root_of(h)})"
_ANY = lambda cond: f"len(list_filter(forms, lambda f: {cond})) > 0"
_BRANDS = "[" + ", ".join(f"struct_pack(brand := '{r}', kw := {O.strings(kw)}, at := {O.strings(at)})" for kw, r, at in P.BRANDS) + "]"
_HIT = f"list_filter({_BRANDS}, lambda b: len(list_filter(b.kw, lambda k: contains(txt, k))) > 0 AND len(list_filter(b.at, lambda a: root = a OR ends_with(hostname, '.' || a))) = 0)[1]"
_FORM_CONDITIONS = {
    "form-javascript": "t.script", "external-form-post": "NOT t.script AND t.external", "form-get": "NOT t.script AND t.resolved AND t.form.method = 'get' AND (t.form.has_password OR t.form.has_otp)",
    "hidden-login-fields": "NOT t.script AND t.resolved AND t.form.hidden_count >= 4 AND (t.form.fields_count <= 8 OR t.form.hidden_count * 2 >= t.form.fields_count) AND NOT t.trusted",
    "iframe-credential-form": "NOT t.script AND t.resolved AND t.form.inside_iframe AND NOT t.trusted AND (t.form.has_password OR t.form.has_otp)",
}
_BY_FORM = ", ".join(O.signal(120, sid, "behavior", f"'{sev}'", w, c, _FORM_CONDITIONS[sid]) for sid, sev, w, c, _ in P.FORM_SIGNALS)
_BEFORE = ", ".join(O.signal(100 + i, *row) for i, row in enumerate(P.PAGE_BEFORE))
_AFTER = ", ".join(O.signal(150 + i, *row) for i, row in enumerate(P.PAGE_AFTER)).replace("size(oauth_buttons)", "len(oauth_buttons)")
_CLONE = O.signal(190, "clone", "clone", "CASE WHEN clone_conf >= 0.8 THEN 'critical' ELSE 'high' END", "35", "clone_conf", "clone_conf >= 0.4 AND clone_corroborated AND NOT ((reputable OR provider) AND NOT brand_image)")


def _fit(i: int, t) -> str:
    name, root, zones, oauth, low, high, words = t
    hits = " + ".join(f"CASE WHEN contains(look_text, '{_q(w)}') THEN 1 ELSE 0 END" for w in words)
    score = f"(1 - levenshtein(zones, '{zones}')::DOUBLE / greatest(length(zones), {len(zones)})) * 0.55e0 + CASE WHEN (len(oauth_buttons) > 0) = {str(oauth).lower()} THEN 0.1e0 ELSE 0e0 END + CASE WHEN hidden_ratio BETWEEN {low}e0 AND {high}e0 THEN 0.1e0 ELSE 0e0 END + least(0.25e0, ({hits}) * 0.12e0)"
    return f"struct_pack(key := -least(1e0, {score}), place := {i}, template := '{name}', root := '{root}')"


_FITS = "[" + ", ".join(_fit(i, t) for i, t in enumerate(P.TEMPLATES)) + "]"
_COUNT = lambda terms: f"len(list_filter({O.strings([_q(t) for t in terms])}, lambda t: contains(txt_plain, t)))"
_ORIGIN_OF = lambda u: f"CASE WHEN regexp_matches({u}, '(?i)^https?://') THEN lower(regexp_extract({u}, '{O._RE}', 1)) || '://' || lower(regexp_extract({u}, '{O._RE}', 3)) WHEN starts_with({u}, '//') THEN scheme || '://' || {_HOST_OF(u)} ELSE page_origin END"
_EXTERNAL = f"len(list_filter(scripts, lambda s: ({_ORIGIN_OF('s')}) <> page_origin))"
_BLOB = r"(?i)[A-Za-z0-9+/]{120,}={0,2}|(?:%[0-9a-f]{2}){40,}|\\x[0-9a-f]{2}(?:\\x[0-9a-f]{2}){30,}"
_LAYOUT_ROOT = O.root_of("regexp_replace(best.root, '^www\\.', '')")
#: Facts of pages beside those of their URLs; ``paged`` has both, as scoring needs them.
PAGED = rf"""page0 AS (SELECT f.*, c.* EXCLUDE (page_id), f.scheme || '://' || f.hostname AS page_origin, lower(title || ' ' || chr(10) || ' ' || visible_text) AS txt, lower(title || chr(10) || visible_text) AS txt_plain, lower(visible_text || ' ' || title) AS look_text, root IN {O.members(C.PAGE_LOGIN_ROOTS)} AS page_trusted,
  coalesce(lookalike_kind, '') = 'punycode' OR regexp_matches(hostname, '(^|\.)xn--') AS page_idn, list_concat(scripts, styles) AS assets FROM features f JOIN context c ON c.page_id = f.url_id),
page1 AS (SELECT *, {_HIT} AS brand_row, has_password OR {_ANY('f.has_password OR f.has_otp')} OR len(oauth_buttons) > 0 AS brand_intent, has_password OR {_ANY('f.has_password OR (f.has_email_like AND f.has_otp)')} AS has_pwd, regexp_matches(txt, '(?i){_q(P.URGENT)}') AS urgent,
  {_ANY('f.has_email_like AND NOT f.has_password AND f.fields_count <= 4')} AS email_first, {_ANY('f.has_otp AND NOT f.has_password')} AS mfa_only, in_frame AS top_level_iframe,
  list_transform(list_filter(forms, lambda f: f.has_password OR f.has_email_like OR f.has_otp), lambda f: struct_pack(form := f, script := regexp_matches(f.action, '(?i)^javascript:'), resolved := f.action <> '', trusted := page_trusted, target_host := {_HOST("(CASE WHEN starts_with(f.action, '//') THEN 'https:' || f.action WHEN starts_with(f.action, '/') THEN page_origin || f.action ELSE f.action END)")})) AS targets0 FROM page0),
page2 AS (SELECT *, CASE WHEN brand_row IS NOT NULL THEN struct_pack(brand := brand_row.brand, evidence := list_filter(brand_row.kw, lambda k: contains(txt, k))[1]) END AS brand_hit, regexp_matches(txt, '(?i){_q(P.ENTERPRISE)}') AND NOT page_trusted AND (has_pwd OR regexp_matches(txt, '(?i){_q(P.AUTH)}') OR len(oauth_buttons) > 0 OR email_first OR mfa_only) AS enterprise_auth,
  list_transform(targets0, lambda t: struct_pack(form := t.form, script := t.script, resolved := t.resolved, trusted := t.trusted, target_root := {O.root_of('t.target_host')}, external := t.target_host <> '' AND ({O.root_of('t.target_host')}) <> root)) AS targets FROM page1),
page3 AS (SELECT *, list_filter(list_concat(list_concat([{_BEFORE}], flatten(list_transform(targets, lambda t: [{_BY_FORM}]))), [{_AFTER}]), lambda s: s IS NOT NULL) AS page_signals0, has_pwd AND NOT page_trusted AS creds, len(list_filter(targets, lambda t: NOT t.script AND t.external)) > 0 AS page_external_post, brand_hit IS NOT NULL AND brand_intent AS brand_text FROM page2),
page4 AS (SELECT *, least(1e0, coalesce(list_sum(list_transform(page_signals0, lambda s: s.confidence * least(1e0, s.weight / 30))), 0e0) / 2) AS phish_conf, len(list_filter(page_signals0, lambda s: s.id IN ('iframe-credential-form', 'iframe-login'))) > 0 AS page_cross_origin, len(list_filter(page_signals0, lambda s: s.id = 'oauth-impersonation')) > 0 AS oauth_impersonation, list_filter(forms, lambda f: f.has_password OR f.has_email_like)[1] AS form FROM page3),
page5 AS (SELECT *, CASE WHEN creds AND (brand_text OR page_external_post OR page_idn) THEN 20 WHEN creds AND phish_conf >= 0.6 THEN 60 WHEN NOT creds AND brand_text THEN 50 WHEN NOT creds AND page_idn THEN 45 WHEN enterprise_auth THEN 55 END AS page_cap,
  CASE WHEN creds AND (brand_text OR page_external_post OR page_idn) THEN 'dangerous' WHEN (creds AND phish_conf >= 0.6) OR (NOT creds AND (brand_text OR page_idn)) OR enterprise_auth THEN 'suspicious' END AS page_force,
  CASE WHEN creds AND (brand_text OR page_external_post OR page_idn) THEN 'critical' WHEN creds OR enterprise_auth THEN 'medium' WHEN has_pwd THEN 'low' ELSE 'none' END AS auth_risk,
  CASE WHEN has_logo_image THEN 'l' ELSE '' END || CASE WHEN has_heading THEN 'h' ELSE '' END || CASE WHEN form.has_email_like THEN 'e' ELSE '' END || CASE WHEN form.has_email_like AND NOT form.has_password THEN 'n' ELSE '' END || CASE WHEN form.has_password THEN 'p' ELSE '' END || CASE WHEN form.has_otp THEN 'o' ELSE '' END || CASE WHEN form.has_password OR form.has_otp THEN 's' ELSE '' END AS zones,
  coalesce(CASE WHEN form.fields_count > 0 THEN form.hidden_count::DOUBLE / form.fields_count END, 0e0) AS hidden_ratio FROM page4),
page6 AS (SELECT *, CASE WHEN length(zones) > 0 THEN list_sort({_FITS})[1] END AS best FROM page5),
page7 AS (SELECT *, best.template AS layout_template, floor(coalesce(-best.key, 0e0) * 100 + 0.5) / 100 AS layout_match, len(assets) AS n_assets, len(list_filter(list_transform(assets, lambda a: {_HOST_OF('a')}), lambda h: {_FOREIGN('h')})) AS n_foreign, {_HOST_OF('favicon')} AS icon_host,
  len(list_filter(list_transform(images[1:50], lambda i: {_HOST_OF('i')}), lambda h: h <> '' AND NOT ({_BELOW('h', C.INFRA_HOSTS)}) AND {O.root_of('h')} <> root AND {_BRAND('h')})) > 0 AS brand_image, creds OR page_external_post OR brand_text AS clone_corroborated FROM page6),
page8 AS (SELECT *, {_FOREIGN('icon_host')} AND {_BRAND('icon_host')} AS favicon_mismatch, coalesce(CASE WHEN contains(best.root, '*') THEN NOT contains(root, 'bank') ELSE {_LAYOUT_ROOT} <> root END AND layout_match >= 0.7, false) AS layout_signal,
  {_COUNT(C.RESEARCH_TERMS)} AS research_terms, {_COUNT(C.EDUCATION_TERMS)} AS education_terms, {_COUNT(C.AUTH_DOC_TERMS)} AS auth_doc_terms FROM page7),
page9 AS (SELECT *, favicon_mismatch::INT + brand_image::INT + layout_signal::INT + clone_corroborated::INT AS clone_signals,
  floor(least(1e0, CASE WHEN research_terms >= 2 THEN 0.45e0 WHEN research_terms = 1 THEN 0.15e0 ELSE 0e0 END + CASE WHEN education_terms >= 3 THEN 0.3e0 WHEN education_terms >= 1 THEN 0.1e0 ELSE 0e0 END + CASE WHEN auth_doc_terms >= 2 THEN 0.3e0 WHEN auth_doc_terms = 1 THEN 0.1e0 ELSE 0e0 END
  + CASE WHEN len(list_filter({O.strings(C.RESEARCH_HOSTS)}, lambda x: contains(hostname, x))) > 0 THEN 0.45e0 WHEN len(list_filter({O.strings(C.DOC_HOST_PREFIXES)}, lambda x: starts_with(hostname, x))) > 0 THEN 0.2e0 ELSE 0e0 END + CASE WHEN len(list_filter({O.strings(C.DOC_PATHS)}, lambda x: contains(lower(path), x))) > 0 THEN 0.15e0 ELSE 0e0 END
  + CASE WHEN regexp_matches(hostname, 'github\.(com|io)$') AND regexp_matches(lower(path), 'demo|example|sample|tutorial|awareness|training|playground') THEN 0.2e0 ELSE 0e0 END) * 100 + 0.5) / 100 AS context_score,
  has_password::INT::DOUBLE AS has_password_field, ({_ANY(f"f.action <> '' AND ({_ORIGIN_OF('f.action')}) <> page_origin AND (f.has_password OR f.has_email_like)")})::INT::DOUBLE AS cross_origin_form, CASE WHEN {_EXTERNAL} >= 8 THEN 1e0 WHEN {_EXTERNAL} >= 4 THEN 0.5e0 ELSE 0e0 END AS many_external_scripts, regexp_matches(text_sample, '{_BLOB}')::INT::DOUBLE AS obfuscation,
  creds OR auth_risk IN ('medium', 'critical') OR has_password OR {_ANY('f.has_password OR (f.has_email_like AND f.has_otp)')} AS has_auth FROM page8),
page10 AS (SELECT *, CASE WHEN clone_signals >= 2 THEN least(1e0, clone_signals * 0.25e0 + CASE WHEN layout_signal THEN least(0.15e0, layout_match * 0.2e0) ELSE 0e0 END) ELSE 0e0 END AS clone_conf FROM page9),
paged AS (SELECT *, list_filter(list_concat(page_signals0, [{_CLONE}]), lambda s: s IS NOT NULL) AS page_signals FROM page10)"""

#: Limits of pages of which only the beginning counts, and what stands there for whole pages.
_LIMITS = {"[1:10]": "", "[1:60]": "", "images[1:50]": "images", f"left({_PLAIN}, 4000)": _PLAIN}


def _whole(sql: str) -> str:
    for limit, all_ in _LIMITS.items():
        sql = sql.replace(limit, all_)
    return sql


TO_PAGED = O.TO_FEATURES + ",\n" + ",\n".join((PAGES, VISIBLE, CONTEXT, PAGED))
TO_PAGE_FACTS = TO_PAGED + ",\n" + ",\n".join((O.EVIDENCE, O.FACTS))
TO_PAGE_VERDICTS = TO_PAGE_FACTS + ",\n" + ",\n".join((O.SIGNALS, O.SCORE))
WHOLE_PAGED = O.TO_FEATURES + ",\n" + ",\n".join((PAGES, WHOLE_VISIBLE, _whole(CONTEXT), _whole(PAGED)))
WHOLE_PAGE_FACTS = WHOLE_PAGED + ",\n" + ",\n".join((O.EVIDENCE, O.FACTS))
WHOLE_PAGE_VERDICTS = WHOLE_PAGE_FACTS + ",\n" + ",\n".join((O.SIGNALS, O.SCORE))
