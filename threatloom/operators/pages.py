"""Page operators: facts from raw HTML, and analyzers over them.

Whole HTML is read, by patterns; facts leave the page as arrays in its row, so the html column can be dropped right
after ``page_context``. With ``beginning`` only the first 4000 characters of plain and visible text count, 10 forms, 60 scripts, 60
styles and 60 images (50 of them for clones): the rule of the queries whose SQL has these limits.
"""

from __future__ import annotations

import re
from functools import reduce
from html import unescape
from html.parser import HTMLParser
from operator import or_

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as C
from ..functions import hosts as H
from ..session import small_batches
from .dlp import loose, matched
from .urls import SIGNALS, derive, signals, url_parts

#: Characters of text, forms, and scripts, styles or images each that count where only the beginning of a page does.
FIRST_TEXT, FIRST_FORMS, FIRST_ASSETS = 4000, 10, 60

# visible text ---------------------------------------------------------------------------------------

_KEEP = {"h1", "h2", "h3", "button", "a", "label", "p", "span"}
_SKIP = {"script", "style", "template", "noscript"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(hidden|collapse)|opacity\s*:\s*0(\.0+)?\s*(;|$)|(left|top)\s*:\s*-[3-9]\d{3,}px|translate[xy]?\([^)]*-[3-9]\d{3,}px|inset\(\s*100%|rect\(\s*0(px)?[, ]+0(px)?[, ]+0(px)?[, ]+0(px)?\s*\)", re.I)


class _Visible(HTMLParser):
    """Text of headings, buttons, links, labels, paragraphs and spans that isn't hidden in its own markup."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool]] = []
        self.hidden = self.kept = 0
        self.title, self.parts, self.in_title = "", [], False

    def handle_starttag(self, tag, attrs):
        if tag == "title":
            self.in_title = True
        if tag in _VOID:
            return
        a = dict(attrs)
        hides = tag in _SKIP or a.get("aria-hidden") == "true" or "hidden" in a or bool(_HIDDEN.search(a.get("style") or ""))
        self.open.append((tag, hides))
        self.hidden += hides
        self.kept += tag in _KEEP

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                for t, hides in self.open[i:]:
                    self.hidden -= hides
                    self.kept -= t in _KEEP
                del self.open[i:]
                break

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif self.kept and not self.hidden and data.strip():
            self.parts.append(" ".join(data.split()))


def _parsed(html: str) -> tuple[str, list[str]]:
    parser = _Visible()
    try:
        parser.feed(html)
        parser.close()
    except (AssertionError, ValueError):
        pass
    return parser.title, parser.parts


#: A tag or comment that parsers agree on: a plain name, attributes that are quoted or plain, and nothing left open.
_TAG = re.compile(r"""<(?:(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n\r\f]+[a-zA-Z_:@][a-zA-Z0-9_:.@-]*(?:=(?:"[^"]*"|'[^']*'|[a-zA-Z0-9_.:#%-]+(?!/)))?)*)[ \t\n\r\f]*(/?)>|!--(?!-?>)(?:(?!--|<!).)*-->|!(?i:doctype)[^<>]*>)""", re.S)
_ATTRIBUTE = re.compile(r"""[ \t\n\r\f]([a-zA-Z_:@][a-zA-Z0-9_:.@-]*)(?:=(?:"([^"]*)"|'([^']*)'|([a-zA-Z0-9_.:#%-]+)))?""")
_TELLING = re.compile("hidden|style", re.I)
#: Elements whose content isn't markup in some parsers.
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext"}


_END = {t: re.compile(rf"</{t}(?=[ >])", re.I) for t in ("script", "style")}
_MARKUP = re.compile("<")


def _hides(tag: str, attributes: str) -> bool:
    if tag in _SKIP or not _TELLING.search(attributes):
        return tag in _SKIP
    a = {m[1].lower(): next((x for x in m.groups()[1:] if x is not None), None) for m in _ATTRIBUTE.finditer(attributes)}
    return a.get("aria-hidden") == "true" or "hidden" in a or bool(_HIDDEN.search(unescape(a.get("style") or "")))


def _scanned(html: str) -> tuple[str, list[str]] | None:
    """Title and visible parts from one pass over the tags, with the depth of hidden and of kept elements running along;
    None for markup that parsers read differently."""
    title, parts, opened = [], [], []
    hidden = kept = at = 0
    in_title = False
    while True:
        m = _TAG.search(html, at)
        data = html[at : m.start()] if m else html[at:]
        if "<" in data:
            return None
        if data and (in_title or kept and not hidden):
            text = unescape(data) if "&" in data else data
            if in_title:
                title.append(text)
            elif words := text.split():
                parts.append(" ".join(words))
        if not m:
            return "".join(title), parts
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if not m[1]:
            if tag in _RAW and not m[4]:
                # of scripts all but the end tag is content; in other such elements nothing but text may stand before it
                end = _END.get(tag, _MARKUP).search(html, at)
                if tag == "plaintext" or not end or tag in _END and "<!--" in html[at : end.start()]:
                    return None
                if tag not in _END and not re.match(rf"</{tag}[ >]", html[end.start() : end.start() + 14], re.I):
                    return None
                at = end.start() if tag in _END else at
            in_title |= tag == "title"
            if tag not in _VOID:
                hides = _hides(tag, m[3])
                opened.append((tag, hides))
                hidden += hides
                kept += tag in _KEEP
        if m[1] or m[4]:
            in_title &= tag != "title"
            for i in range(len(opened) - 1, -1, -1):
                if opened[i][0] == tag:
                    for t, hides in opened[i:]:
                        hidden -= hides
                        kept -= t in _KEEP
                    del opened[i:]
                    break


def visible(html: str | None, limit: int | None = FIRST_TEXT) -> str:
    """Title and visible text, by a scan of the tags; markup that isn't plain goes through a whole parser. Without ``limit`` all
    of it."""
    title, parts = _scanned(html or "") or _parsed(html or "")
    return " ".join([title.strip(), *parts])[:limit]


@F.pandas_udf(T.StringType())
def visible_text(html: pd.Series) -> pd.Series:
    """Title and visible text of pages, at most 4000 characters."""
    return html.map(visible)


@F.pandas_udf(T.StringType())
def whole_visible_text(html: pd.Series) -> pd.Series:
    """Title and all visible text of pages."""
    return html.map(lambda h: visible(h, None))


# facts ----------------------------------------------------------------------------------------------


def _attribute(tag: Column, name: str) -> Column:
    return F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*[\"']([^\"']*)[\"']", 1)


def _tags(html: Column, name: str) -> Column:
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{name}\b[^>]*>"), F.lit(0))


def forms(html: Column, in_frame: Column, limit: int | None = None) -> Column:
    """Forms of a page: action, method, kinds of fields, counts, whether the page is inside a frame."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<form\b[^>]*>.*?</form>"), F.lit(0))

    def facts(form: Column) -> Column:
        inputs = _tags(form, "input")
        kind = lambda t: F.lower(F.coalesce(F.regexp_extract(t, r"(?is)\btype\s*=\s*[\"']?([A-Za-z-]+)", 1), F.lit("")))
        naming = lambda t: F.lower(F.concat_ws(" ", _attribute(t, "name"), _attribute(t, "id"), _attribute(t, "autocomplete")))
        head = F.regexp_extract(form, r"(?is)^(<form\b[^>]*>)", 1)
        method = _attribute(head, "method")
        return F.struct(
            _attribute(head, "action").alias("action"),
            F.lower(F.when(method == "", "post").otherwise(method)).alias("method"),
            F.exists(inputs, lambda t: kind(t) == "password").alias("has_password"),
            F.exists(inputs, lambda t: (kind(t) == "email") | naming(t).rlike("email|user(name)?|login|account")).alias("has_email_like"),
            F.exists(inputs, lambda t: naming(t).rlike("otp|one[-_ ]?time|2fa|mfa|verification[-_ ]?code")).alias("has_otp"),
            F.size(F.filter(inputs, lambda t: kind(t) == "hidden")).alias("hidden_count"),
            F.size(inputs).alias("fields_count"),
            in_frame.alias("inside_iframe"),
        )

    return F.transform(F.slice(found, 1, limit) if limit else found, facts)


def page_context(pages: DataFrame, beginning: bool = False) -> DataFrame:
    """Pages (page_id, url, html, and in_frame where it is known) with their facts; html is dropped."""
    small_batches(pages.sparkSession)
    html = F.coalesce("html", F.lit(""))
    first = lambda a: F.slice(a, 1, FIRST_ASSETS) if beginning else a
    in_frame = F.coalesce("in_frame", F.lit(False)) if "in_frame" in pages.columns else F.lit(False)
    out = url_parts(pages.withColumns({"html": html, "in_frame": in_frame}))
    plain = html_text(F.col("html"))
    drop_empty = lambda a: F.filter(a, lambda x: x != "")
    links = F.filter(_tags(F.col("html"), "link"), lambda t: F.lower(_attribute(t, "rel")).contains("icon"))
    oauth = F.transform(F.regexp_extract_all(F.lower("html"), F.lit(r"(?s)<(?:button|a)\b[^>]*>\s*sign in with (google|microsoft|apple|facebook|github|twitter|x|linkedin)"), F.lit(1)), lambda x: x)
    out = out.withColumns(
        {
            "page_origin": F.concat("scheme", F.lit("://"), "hostname"),
            "title": F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>([^<]*)", 1)),
            "has_password": F.col("html").rlike(r"(?is)<input[^>]+type\s*=\s*[\"']?password"),
            "forms": forms(F.col("html"), F.col("in_frame"), FIRST_FORMS if beginning else None),
            "scripts": first(drop_empty(F.transform(_tags(F.col("html"), "script"), lambda t: _attribute(t, "src")))),
            "styles": first(drop_empty(F.transform(F.filter(_tags(F.col("html"), "link"), lambda t: F.lower(_attribute(t, "rel")) == "stylesheet"), lambda t: _attribute(t, "href")))),
            "images": first(drop_empty(F.transform(_tags(F.col("html"), "img"), lambda t: _attribute(t, "src")))),
            "links": drop_empty(F.transform(_tags(F.col("html"), "a"), lambda t: _attribute(t, "href"))),
            "favicon": F.coalesce(_attribute(H.first_of(links), "href"), F.lit("")),
            "oauth_buttons": F.array_distinct(oauth),
            "has_logo_image": F.col("html").rlike(r"(?is)<img\b"),
            "has_heading": F.col("html").rlike(r"(?is)<h[12]\b"),
            "has_tel_link": F.col("html").rlike(r"(?is)href\s*=\s*[\"']tel:"),
            "text_sample": F.substring(plain, 1, FIRST_TEXT) if beginning else plain,
            "visible_text": (visible_text if beginning else whole_visible_text)(F.col("html")),
        }
    )
    return out.drop("html")


def html_text(html: Column) -> Column:
    """Text without scripts, styles and tags, white space run together."""
    text = F.regexp_replace(html, r"(?is)<script.*?</script>", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"(?is)<style.*?</style>", " "), r"(?s)<[^>]+>", " ")
    return F.regexp_replace(text, r"\s+", " ")


def page_forms(context: DataFrame) -> DataFrame:
    """One row a form."""
    return context.select("page_id", F.posexplode("forms").alias("form_no", "f")).select("page_id", "form_no", "f.*")


# phishing -------------------------------------------------------------------------------------------

# Fixed values. (keywords, root, roots and parents that may use them), in order of precedence.
BRANDS = (
    (("microsoft", "office 365", "office365", "outlook", "onedrive", "sharepoint"), "microsoft.com", ("microsoft.com", "microsoftonline.com", "live.com", "office.com", "office365.com", "outlook.com", "sharepoint.com")),
    (("google account", "gmail", "google workspace", "google sign"), "google.com", ("google.com", "gmail.com", "googlemail.com", "googleusercontent.com", "googleapis.com")),
    (("apple id", "icloud", "appleid"), "apple.com", ("apple.com", "icloud.com")),
    (("paypal",), "paypal.com", ("paypal.com",)),
    (("ionos", "1&1", "webmail ionos", "ionos login"), "ionos.com", ("ionos.com", "1and1.com")),
    (("facebook", "meta business"), "facebook.com", ("facebook.com", "fb.com", "meta.com")),
    (("instagram",), "instagram.com", ("instagram.com",)),
    (("netflix",), "netflix.com", ("netflix.com",)),
    (("amazon",), "amazon.com", ("amazon.com", "amazon.in", "amazon.co.uk", "amazon.de")),
    (("coinbase",), "coinbase.com", ("coinbase.com",)),
    (("binance",), "binance.com", ("binance.com", "binance.us")),
    (("metamask",), "metamask.io", ("metamask.io",)),
    (("chase bank", "jpmorgan"), "chase.com", ("chase.com", "jpmorgan.com")),
    (("wells fargo",), "wellsfargo.com", ("wellsfargo.com",)),
    (("bank of america",), "bankofamerica.com", ("bankofamerica.com", "bofa.com")),
    (("hdfc bank",), "hdfcbank.com", ("hdfcbank.com", "hdfc.bank.in")),
    (("icici bank",), "icicibank.com", ("icicibank.com", "icici.bank.in")),
    (("state bank of india", "sbi online"), "sbi.co.in", ("sbi.co.in", "onlinesbi.com", "sbi.bank.in")),
)
# Fixed values. Wordings of sign-in, of company sign-in, and of pressure.
AUTH = r"\b(sign in|log in|login|signin|verify your (account|identity)|confirm your (account|identity)|account suspended|unusual activity|two[- ]factor|2fa|mfa|one[- ]time (code|password)|otp|authenticator)\b"
ENTERPRISE = r"\b(continue to (your )?(organization|organisation|company|tenant|workspace)|device (verification|registration|trust)|approve (this )?sign[- ]?in request|sso (sign|log) ?in|enterprise (sign|log) ?in|use your (work|corporate|organization|company) account|verify it'?s you|complete sign[- ]?in on (another|your) device|your organization requires)\b"
URGENT = r"\b(verify your (account|identity)|confirm your (account|identity)|account (has been |is |was )?(suspended|locked|disabled|limited|restricted|on hold)|unusual (activity|sign[- ]?in|login)|suspicious (activity|sign[- ]?in|login)|(re[- ]?)?verify (your|the) (account|identity|information) (to|before)|to (avoid|prevent) (suspension|closure|termination)|within [0-9]+ ?(hours|hrs|minutes|days) or|failure to (verify|confirm|respond)|action required)\b"

# Fixed values. Rules of single forms: (id, severity, weight, confidence, condition over the form's facts).
FORM_SIGNALS = (
    ("form-javascript", "high", 30, 0.9, lambda f: f["script"]),
    ("external-form-post", "critical", 60, 0.95, lambda f: ~f["script"] & f["external"]),
    ("form-get", "medium", 20, 0.9, lambda f: ~f["script"] & f["resolved"] & (f["form"]["method"] == "get") & (f["form"]["has_password"] | f["form"]["has_otp"])),
    ("hidden-login-fields", "medium", 16, 0.7, lambda f: ~f["script"] & f["resolved"] & (f["form"]["hidden_count"] >= 4) & ((f["form"]["fields_count"] <= 8) | (f["form"]["hidden_count"] * 2 >= f["form"]["fields_count"])) & ~f["trusted"]),
    ("iframe-credential-form", "high", 28, 0.85, lambda f: ~f["script"] & f["resolved"] & f["form"]["inside_iframe"] & ~f["trusted"] & (f["form"]["has_password"] | f["form"]["has_otp"])),
)
# Fixed values. (id, category, severity, weight, confidence, condition) of whole pages, before and after those of forms.
PAGE_BEFORE = (
    ("brand-impersonation", "identity", "'high'", "50", "0.85", "brand_hit IS NOT NULL AND brand_intent"),
    ("domain-spoofing", "identity", "CASE WHEN page_idn THEN 'critical' ELSE 'high' END", "CASE WHEN page_idn THEN 55 ELSE 38 END", "greatest(0.75, lookalike_conf)", "lookalike_kind IS NOT NULL"),
)
PAGE_AFTER = (
    ("oauth-impersonation", "identity", "'high'", "18", "0.7", "size(oauth_buttons) > 0 AND NOT page_trusted AND has_pwd"),
    ("auth-phrasing", "behavior", "'medium'", "12", "0.6", "urgent AND NOT page_trusted AND has_pwd"),
    ("iframe-login", "behavior", "'high'", "25", "0.8", "top_level_iframe AND has_pwd"),
    ("generic-enterprise-auth", "behavior", "'high'", "24", "0.72", "enterprise_auth"),
)


def brand_hit(text: Column, root: Column, host: Column) -> Column:
    """struct(brand, evidence): the first brand whose keywords stand in the text of a page off its roots."""
    rows = F.expr("array(" + ", ".join(f"named_struct('brand', '{r}', 'kw', array({H.sql_list(kw)}), 'at', array({H.sql_list(at)}))" for kw, r, at in BRANDS) + ")")
    hit = H.first_of(F.filter(rows, lambda b: F.exists(b["kw"], lambda k: F.contains(text, k)) & ~F.exists(b["at"], lambda a: (root == a) | F.endswith(host, F.concat(F.lit("."), a)))))
    return F.when(hit.isNotNull(), F.struct(hit["brand"].alias("brand"), H.first_of(F.filter(hit["kw"], lambda k: F.contains(text, k))).alias("evidence")))


def form_targets(forms_: Column, origin: Column, root: Column, trusted: Column) -> Column:
    """Sign-in forms with where they post to."""
    def one(f: Column) -> Column:
        action = f["action"]
        host = F.lower(H.url_part(F.when(action.startswith("//"), F.concat(F.lit("https:"), action)).when(action.startswith("/"), F.concat(origin, action)).otherwise(action), 3))
        target = H.root_domain(H.no_www(host))
        return F.struct(f.alias("form"), action.rlike("(?i)^javascript:").alias("script"), ((target != "") & (target != root)).alias("external"), (action != "").alias("resolved"), trusted.alias("trusted"), target.alias("target_root"))

    login = F.filter(forms_, lambda f: f["has_password"] | f["has_email_like"] | f["has_otp"])
    return F.transform(login, one)


def phishing(facts: DataFrame) -> DataFrame:
    """Page facts (context with host facts) with phishing signals, flags, cap and forced status."""
    root = F.col("root")
    text = F.lower(F.concat("title", F.lit(" \n "), "visible_text"))
    out = facts.withColumns({"page_trusted": H.one_of("root", C.PAGE_LOGIN_ROOTS), "_text": text, "top_level_iframe": F.col("in_frame"), "page_idn": (F.coalesce("lookalike_kind", F.lit("")) == "punycode") | F.col("hostname").rlike(r"(^|\.)xn--")})
    any_form = lambda test: F.exists("forms", test)
    login = any_form(lambda f: f["has_password"] | (f["has_email_like"] & f["has_otp"]))
    out = out.withColumns({"brand_hit": brand_hit(F.col("_text"), root, F.col("hostname")), "brand_intent": F.col("has_password") | any_form(lambda f: f["has_password"] | f["has_otp"]) | (F.size("oauth_buttons") > 0), "has_pwd": F.col("has_password") | login, "urgent": F.col("_text").rlike("(?i)" + URGENT), "targets": form_targets(F.col("forms"), F.col("page_origin"), root, F.col("page_trusted"))})
    first = any_form(lambda f: f["has_email_like"] & ~f["has_password"] & (f["fields_count"] <= 4))
    only = any_form(lambda f: f["has_otp"] & ~f["has_password"])
    workflow = F.col("has_pwd") | F.col("_text").rlike("(?i)" + AUTH) | (F.size("oauth_buttons") > 0)
    out = out.withColumns({"email_first": first, "mfa_only": only, "enterprise_auth": F.col("_text").rlike("(?i)" + ENTERPRISE) & ~F.col("page_trusted") & (workflow | first | only)})
    one = lambda t, r: F.when(r[4](t), F.struct(F.lit(r[0]).alias("id"), F.lit("behavior").alias("category"), F.lit(r[1]).alias("severity"), F.lit(float(r[2])).alias("weight"), F.lit(r[3]).alias("confidence"), F.lit(-int(r[2] * r[3] + 0.5)).cast("long").alias("contribution")))
    by_form = F.flatten(F.transform("targets", lambda t: F.array_compact(F.array(*[one(t, r) for r in FORM_SIGNALS])))).cast(SIGNALS)
    out = out.withColumns({"page_signals": F.concat(signals(PAGE_BEFORE), by_form, signals(PAGE_AFTER)), "creds": F.col("has_pwd") & ~F.col("page_trusted"), "page_external_post": F.exists("targets", lambda t: ~t["script"] & t["external"])})
    conf = F.least(F.lit(1.0), F.aggregate("page_signals", F.lit(0.0), lambda a, s: a + s["confidence"] * F.least(F.lit(1.0), s["weight"] / 30.0)) / 2)
    out = out.withColumns({"phish_conf": conf, "brand_text": F.col("brand_hit").isNotNull() & F.col("brand_intent"), "page_cross_origin": F.exists("page_signals", lambda s: s["id"].isin("iframe-credential-form", "iframe-login"))})
    grave = F.expr("creds AND (brand_text OR page_external_post OR page_idn)")
    return out.withColumns(
        {
            "page_cap": F.expr("CASE WHEN creds AND (brand_text OR page_external_post OR page_idn) THEN 20 WHEN creds AND phish_conf >= 0.6 THEN 60 WHEN NOT creds AND brand_text THEN 50 WHEN NOT creds AND page_idn THEN 45 WHEN enterprise_auth THEN 55 END"),
            "page_force": F.expr("CASE WHEN creds AND (brand_text OR page_external_post OR page_idn) THEN 'dangerous' WHEN (creds AND phish_conf >= 0.6) OR (NOT creds AND (brand_text OR page_idn)) OR enterprise_auth THEN 'suspicious' END"),
            "auth_risk": F.when(grave, "critical").when(F.col("creds") | F.col("enterprise_auth"), "medium").when(F.col("has_pwd"), "low").otherwise("none"),
        }
    ).drop("_text")


# layout and clones ----------------------------------------------------------------------------------

# Fixed values. (template, root, zones, buttons of other providers, band of hidden fields, keywords).
TEMPLATES = (
    ("microsoft", "login.microsoftonline.com", "lhen", False, 0.3, 0.6, ("sign in", "use your microsoft account", "no account")),
    ("google", "accounts.google.com", "lhen", False, 0.2, 0.55, ("sign in", "use your google account", "forgot email")),
    ("apple", "appleid.apple.com", "lhan", False, 0.1, 0.4, ("apple id", "sign in")),
    ("okta", "okta.com", "lheps", True, 0.2, 0.5, ("sign in", "okta")),
    ("coinbase", "coinbase.com", "lheps", False, 0.1, 0.4, ("sign in", "coinbase")),
    ("generic-bank", "*bank*", "lhups", False, 0.0, 0.5, ("online banking", "secure sign on", "account number")),
)


def auth_layout(facts: DataFrame) -> DataFrame:
    """Zones of the sign-in area as letters (logo, heading, email, next, password, otp, submit), and the
    provider template that fits best: ordered similarity, buttons, hidden fields, keywords."""
    flag = lambda c, letter: f"CASE WHEN coalesce({c}, false) THEN '{letter}' ELSE '' END"
    pwd, mail, otp = (f"_form.{k}" for k in ("has_password", "has_email_like", "has_otp"))
    zones = ((c, x) for c, x in (("has_logo_image", "l"), ("has_heading", "h"), (mail, "e"), (f"{mail} AND NOT {pwd}", "n"), (pwd, "p"), (otp, "o"), (f"{pwd} OR {otp}", "s")))
    out = derive(facts, _form="try_element_at(filter(forms, f -> f.has_password OR f.has_email_like), 1)", _text="lower(concat(visible_text, ' ', title))")
    out = derive(out, zones="concat(" + ", ".join(flag(*z) for z in zones) + ")", hidden_ratio="coalesce(CASE WHEN _form.fields_count > 0 THEN _form.hidden_count / _form.fields_count END, 0D)")

    def fit(place: int, t) -> str:
        name, root, letters, oauth, low, high, words = t
        hits = " + ".join(f"CAST(contains(_text, '{w}') AS INT)" for w in words)
        alike = f"(1 - levenshtein(zones, '{letters}') / greatest(length(zones), {len(letters)})) * 0.55D"
        score = f"{alike} + CASE WHEN (size(oauth_buttons) > 0) = {str(oauth).lower()} THEN 0.1D ELSE 0D END + CASE WHEN hidden_ratio BETWEEN {low}D AND {high}D THEN 0.1D ELSE 0D END + least(0.25D, ({hits}) * 0.12D)"
        return f"named_struct('key', -least(1D, {score}), 'place', {place}, 'template', '{name}', 'root', '{root}')"

    out = derive(out, _best="CASE WHEN length(zones) > 0 THEN array_min(array(" + ", ".join(fit(i, t) for i, t in enumerate(TEMPLATES)) + ")) END")
    return derive(out, layout_template="_best.template", layout_root="_best.root", layout_match="floor(coalesce(-_best.key, 0D) * 100 + 0.5D) / 100").drop("_form", "_best", "_text")


def _host_of(url: Column) -> Column:
    return H.no_www(F.lower(H.url_part(F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).otherwise(url), 3)))


def _foreign(host: str) -> str:
    """Whether a host has another root than the page and isn't shared infrastructure."""
    return f"({host} <> '' AND {H.root_sql(host)} <> root AND NOT {H.below_sql(host, C.CDN_HOSTS)} AND NOT {H.below_sql(host, C.INFRA_HOSTS)})"


def clone_facts(facts: DataFrame, beginning: bool = False) -> DataFrame:
    """Clone indicators (brand favicon, brand image, provider layout elsewhere, phishing evidence); two of
    four make a confidence. The share of foreign assets is reported and never counts."""
    brand = lambda h: f"{H.root_sql(h)} IN ({H.sql_list(C.CLONE_BRANDS)})"
    out = derive(
        facts,
        _hosts=f"transform(concat(scripts, styles), a -> {H.host_sql('a')})",
        _images=f"transform({'slice(images, 1, 50)' if beginning else 'images'}, i -> {H.host_sql('i')})",
        _icon=H.host_sql("favicon"),
        _layout=H.root_sql("regexp_replace(layout_root, r'^www\\.', '')"),
        clone_corroborated="creds OR page_external_post OR brand_text",
    )
    out = derive(
        out,
        n_assets="size(_hosts)",
        n_foreign=f"size(filter(_hosts, h -> {_foreign('h')}))",
        favicon_mismatch=f"{_foreign('_icon')} AND {brand('_icon')}",
        brand_image=f"exists(_images, h -> h <> '' AND NOT {H.below_sql('h', C.INFRA_HOSTS)} AND {H.root_sql('h')} <> root AND {brand('h')})",
        layout_signal="coalesce(CASE WHEN contains(layout_root, '*') THEN NOT contains(root, 'bank') ELSE _layout <> root END AND layout_match >= 0.7, false)",
    )
    out = derive(out, clone_signals="CAST(favicon_mismatch AS INT) + CAST(brand_image AS INT) + CAST(layout_signal AS INT) + CAST(clone_corroborated AS INT)")
    out = derive(out, clone_conf="CASE WHEN clone_signals >= 2 THEN least(1D, clone_signals * 0.25D + CASE WHEN layout_signal THEN least(0.15D, layout_match * 0.2D) ELSE 0D END) ELSE 0D END")
    return out.drop("_hosts", "_images", "_icon", "_layout")


def security_context(facts: DataFrame) -> DataFrame:
    """Score that a page discusses security or teaches, from its words, host and path."""
    any_of = lambda names, test: f"exists(array({H.sql_list(names)}), x -> {test})"
    count = lambda terms: f"size(filter(array({H.sql_list(terms)}), x -> contains(_text, x)))"
    out = derive(facts, _text=r"lower(concat(title, '\n', visible_text))")
    out = derive(out, research_terms=count(C.RESEARCH_TERMS), education_terms=count(C.EDUCATION_TERMS), auth_doc_terms=count(C.AUTH_DOC_TERMS)).drop("_text")
    points = (
        "CASE WHEN research_terms >= 2 THEN 0.45D WHEN research_terms = 1 THEN 0.15D ELSE 0D END",
        "CASE WHEN education_terms >= 3 THEN 0.3D WHEN education_terms >= 1 THEN 0.1D ELSE 0D END",
        "CASE WHEN auth_doc_terms >= 2 THEN 0.3D WHEN auth_doc_terms = 1 THEN 0.1D ELSE 0D END",
        f"CASE WHEN {any_of(C.RESEARCH_HOSTS, 'contains(hostname, x)')} THEN 0.45D WHEN {any_of(C.DOC_HOST_PREFIXES, 'startswith(hostname, x)')} THEN 0.2D ELSE 0D END",
        f"CASE WHEN {any_of(C.DOC_PATHS, 'contains(lower(path), x)')} THEN 0.15D ELSE 0D END",
        "CASE WHEN hostname RLIKE 'github[.](com|io)$' AND lower(path) RLIKE 'demo|example|sample|tutorial|awareness|training|playground' THEN 0.2D ELSE 0D END",
    )
    return derive(out, context_score="floor(least(1D, " + " + ".join(points) + ") * 100 + 0.5D) / 100")


# lures ----------------------------------------------------------------------------------------------

# Fixed values. (id, pattern, strong): command lines that no page has business copying.
COMMANDS = (
    ("powershell", r"\b(powershell|pwsh)\b", False),
    ("ps-encoded", r"-e(nc|ncodedcommand)?\b\s+[A-Za-z0-9+/=]{12,}", True),
    ("ps-iex", r"\b(iex|invoke-expression|invoke-webrequest|invoke-restmethod|iwr|irm|downloadstring|downloadfile|frombase64string|start-bitstransfer|net\.webclient)\b", True),
    ("ps-hidden", r"-(w(indowstyle)?\s+hidden|nop|noprofile|noni|ep\s+bypass|executionpolicy\s+bypass)\b", True),
    ("defender-evade", r"\b(add-mppreference|set-mppreference|-exclusionpath|amsiutils|amsiinitfailed)\b", True),
    ("cmd", r"\bcmd(\.exe)?\s*/(c|k)\b", False),
    ("mshta", r"\bmshta(\.exe)?\b|hta:application|\.hta\b", True),
    ("lolbin", r"\b(certutil|bitsadmin|regsvr32|rundll32|wscript|cscript|msiexec|forfiles|installutil|schtasks|conhost|wmic|hh\.exe)\b", True),
    ("nix-oneliner", r"\b(python3?|node|perl|ruby)\s+-(c|e)\b[^\n]{0,200}(http|socket|urllib|requests|child_process|exec)", True),
    ("curl-pipe", r"\b(curl|wget)\b[^\n|]{0,200}\|\s*(ba)?sh\b", True),
    ("curl-iex", r"\b(curl|wget|iwr)\b[^\n|]{0,200}\|\s*iex\b", True),
    ("base64-sh", r"base64\s+(-d|--decode)\b[^\n|]{0,120}\|\s*(ba)?sh\b", True),
    ("osascript", r"\bosascript\b|\bdo shell script\b", False),
)
# Fixed values. Wordings that make a visitor run something, and of sham verification.
RUN_PHRASES = (
    r"\bwin(dows)?\s*\+\s*r\b", r"\bpress\s+(the\s+)?(windows|win)\b.*\br\b", r"\b(hold|press)\b.*\bwindows\s*key\b.*\br\b", "⊞",
    r"\b(open|launch)\s+(the\s+)?(run\s+dialog|run\s+(box|window)|powershell|terminal|command\s+prompt|cmd)\b", r"\bctrl\s*\+\s*v\b.*\b(enter|run)\b",
    r"\bpaste\b.*\b(and\s+)?(press|hit)\s+(enter|return)\b", r"\bpaste\s+(this|the\s+(code|command|script)|it)\b", r"\b(open|launch|press)\s+(spotlight|terminal|finder)\b",
    r"\b(command|⌘)\s*(\+|key\s+and)\s*(space|spacebar)\b", r"\btype\s+(in\s+)?terminal\b",
)
VERIFY_PHRASES = (
    r"\bverify\s+(you('| a)?re|that you are)\s+(a\s+)?human\b", r"\bi('| a)?m not a robot\b", r"\b(human|robot)\s+verification\b", r"\bverification\s+(steps|failed|required|id)\b",
    r"\bto (continue|proceed),?\s+(please\s+)?(complete|perform|follow)\b", r"\bchecking\s+(if\s+)?your\s+browser\b", r"\bray\s*id\b", r"\bcaptcha\b",
)
# Fixed values. Wordings of scareware: alarm, call to action, vendors.
ALARMS = (
    r"\byour\s+(computer|pc|system|device|windows)\s+(is|has been|may be)\s+(infected|locked|blocked|compromised|at risk)\b", r"\b(virus(es)?|trojan|spyware|malware)\s+(detected|found|alert)\b",
    r"\b(security|system)\s+(alert|warning|breach)\b", r"\byour\s+(data|files|identity|information)\s+(is|are|may be)\s+(at risk|stolen|compromised|encrypted)\b", r"\berror\s*(code)?\s*[:#]?\s*[a-z0-9-]{3,}\b",
)
CALLS = (
    r"\bcall\s+(us|now|immediately|microsoft|apple|windows|support|toll[- ]?free)\b", r"\b(toll[- ]?free|helpline|support\s+(line|number|team))\b", r"\bcontact\s+(microsoft|apple|windows)\s+(support|technician)\b",
    r"\bdo\s+not\s+(close|restart|shut\s*down|turn\s*off|ignore)\b", r"\bcall\s*[:.]?\s*(\+?\d[\d\s().-]{7,}\d)\b",
)
VENDORS = r"\b(windows\s+defender|microsoft\s+(security|support)|apple\s+support|norton|mcafee)\b"


def _count(text: Column, patterns) -> Column:
    return sum((text.rlike("(?i)" + p).cast("int") for p in patterns), F.lit(0))


def clickfix_commands(text: Column) -> dict[str, Column]:
    """Techniques of command lines in a text, and the confidence that it is one."""
    s = F.substring(text, 1, 8000)
    hits = F.array_compact(F.array(*[F.when(s.rlike("(?i)" + p), F.lit(i)) for i, p, _ in COMMANDS]))
    strong = F.arrays_overlap(hits, F.array(*[F.lit(i) for i, _, x in COMMANDS if x]))
    conf = F.when(strong, F.least(F.lit(0.98), 0.85 + (F.size(hits) - 1) * 0.05)).otherwise(F.least(F.lit(0.8), 0.5 + (F.size(hits) - 1) * 0.1))
    ok = (F.length(s) >= 6) & (F.size(hits) > 0)
    return {"techniques": F.when(ok, F.array_join(hits, ",")).otherwise(""), "command_conf": F.when(ok, conf).otherwise(0.0)}


_PHRASES = RUN_PHRASES + VERIFY_PHRASES
_LOOSE_PHRASES = ["(?i)" + loose(p) for p in _PHRASES]


@F.arrow_udf(T.IntegerType())
def phrase_hints(text: pa.Array) -> pa.Array:
    """Phrases of the two lists that a text may hold, as bits."""
    return pa.array(matched(text, _LOOSE_PHRASES), mask=text.is_null().to_numpy(zero_copy_only=False))


def _said(text: Column, phrases: tuple[str, ...]) -> Column:
    """Whether a text holds one of some phrases; only those of ``_hints`` are looked for."""
    return reduce(or_, [(F.col("_hints").bitwiseAND(1 << _PHRASES.index(p)) != 0) & text.rlike("(?i)" + p) for p in phrases])


def clickfix(df: DataFrame, copied: str, shown: str) -> DataFrame:
    """Severity and confidence that a page makes its visitor run a command (array of copied texts, shown text)."""
    each = F.transform(copied, lambda c: F.struct(*[v.alias(k) for k, v in clickfix_commands(c).items()]))
    out = df.withColumn("_each", F.filter(each, lambda x: x["techniques"] != ""))
    out = out.withColumns({"techniques": F.array_join(F.array_distinct(F.flatten(F.transform("_each", lambda x: F.split(x["techniques"], ",")))), ","), "command_conf": F.coalesce(F.array_max(F.transform("_each", lambda x: x["command_conf"])), F.lit(0.0))}).drop("_each")
    s = F.substring(F.col(shown), 1, 20000)
    small_batches(df.sparkSession)
    out = out.withColumn("_hints", phrase_hints(s)).withColumns({"run_phrase": _said(s, RUN_PHRASES), "fake_verify": _said(s, VERIFY_PHRASES)}).drop("_hints")
    bad = F.col("techniques") != ""
    lure = F.col("run_phrase") & F.col("fake_verify")
    return out.withColumns({"clickfix_severity": F.when(bad, "critical").when(lure, "high").otherwise("none"), "clickfix_conf": F.when(bad, F.least(F.lit(0.99), F.col("command_conf") + F.when(F.col("run_phrase") | F.col("fake_verify"), 0.05).otherwise(0.0))).when(lure, 0.95).otherwise(0.0)})


def scareware(df: DataFrame, text: str, structural: Column) -> DataFrame:
    """Whether a page is a tech-support scam: alarm and call words, vendor names and ``structural`` cues."""
    s = F.substring(F.col(text), 1, 20000)
    out = df.withColumns({"alarm_hits": _count(s, ALARMS), "call_hits": _count(s, CALLS), "vendor_hit": s.rlike("(?i)" + VENDORS), "_cues": structural})
    points = F.least("alarm_hits", F.lit(2)) * 0.28 + F.least("call_hits", F.lit(2)) * 0.3 + F.when(F.col("vendor_hit"), 0.18).otherwise(0.0) + F.least("_cues", F.lit(2)) * 0.2
    scam = (F.col("_cues") >= 1) & ((F.col("alarm_hits") >= 1) | (F.col("call_hits") >= 1)) & (points >= 0.6)
    return out.withColumns({"scam": scam, "scam_conf": F.when(scam, F.floor(F.least(F.lit(0.97), points) * 100 + 0.5) / 100).otherwise(0.0)}).drop("_cues")


# joins over page assets -----------------------------------------------------------------------------


def third_party_assets(context: DataFrame) -> DataFrame:
    """One row a script or style from another root that isn't shared infrastructure."""
    rows = context.select("page_id", "root", F.explode(F.concat("scripts", "styles")).alias("asset"))
    return derive(rows, asset_host=H.host_sql("asset")).where(_foreign("asset_host"))


# Fixed values. File extensions that run.
DANGEROUS = r"(?i)\.(exe|scr|msi|bat|cmd|com|hta|vbs|vbe|js|jse|wsf|ps1|jar|apk|dmg|pkg|iso|img|lnk|reg|gadget|cpl)(\?|#|$)"


def dangerous_downloads(context: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Links to files that run, on pages of low trust or leading elsewhere (verdicts: page_id, status)."""
    rows = context.select("page_id", "page_origin", F.explode("links").alias("href")).where(F.col("href").rlike(DANGEROUS))
    rows = rows.join(verdicts.select("page_id", "status"), "page_id", "left")
    origin = F.concat(F.lower(H.url_part(F.col("href"), 1)), F.lit("://"), F.lower(H.url_part(F.col("href"), 3)))
    rows = rows.withColumns({"cross_origin": F.col("href").rlike("(?i)^https?://") & (origin != F.col("page_origin")), "low_trust": F.coalesce(F.col("status").isin("suspicious", "dangerous"), F.lit(False))})
    return rows.where("low_trust OR cross_origin").withColumn("severity", F.when(F.col("low_trust"), "high").otherwise("medium"))


# whole pages ----------------------------------------------------------------------------------------


def dom_features(facts: DataFrame) -> DataFrame:
    """The classifier's features of a page."""
    origin = F.col("page_origin")
    of = lambda u: F.when(u.rlike("(?i)^https?://"), F.concat(F.lower(H.url_part(u, 1)), F.lit("://"), F.lower(H.url_part(u, 3)))).when(u.startswith("//"), F.concat("scheme", F.lit("://"), _host_of(u))).otherwise(origin)
    external = F.size(F.filter("scripts", lambda s: of(s) != origin))
    cross = F.exists("forms", lambda f: (f["action"] != "") & (of(f["action"]) != origin) & (f["has_password"] | f["has_email_like"]))
    blob = r"(?i)[A-Za-z0-9+/]{120,}={0,2}|(?:%[0-9a-f]{2}){40,}|\\x[0-9a-f]{2}(?:\\x[0-9a-f]{2}){30,}"
    return facts.withColumns({"has_password_field": F.col("has_password").cast("double"), "cross_origin_form": cross.cast("double"), "many_external_scripts": F.when(external >= 8, 1.0).when(external >= 4, 0.5).otherwise(0.0), "obfuscation": F.col("text_sample").rlike(blob).cast("double")})


# Fixed values. (id, severity, category, points, condition) of the page rule registry. Callers may add their own.
PAGE_RULES = (
    ("external-form-post", "critical", "phishing", -60, "page_external_post"),
    ("brand-keyword-mismatch", "high", "phishing", -35, "brand_text"),
    ("mfa-only-unknown-domain", "high", "auth", -30, "mfa_only AND NOT page_trusted"),
    ("safelisted-root", "info", "trust", 10, "safelist_kind IS NOT NULL"),
    ("credential-relay", "critical", "behavioral", -50, "flow_relay"),
    ("oauth-token-drift", "high", "behavioral", -35, "flow_token_drift"),
    ("iframe-origin-swap", "high", "behavioral", -25, "flow_iframe_swap"),
    ("csp-downgrade", "low", "antiEvasion", -8, "csp_weakened"),
)


def page_rules(facts: DataFrame, rules=PAGE_RULES) -> DataFrame:
    """One row a page and rule: whether it matched and what it contributes."""
    rows = F.array(*[F.struct(F.lit(i).alias("rule_id"), F.lit(s).alias("severity"), F.lit(c).alias("category"), F.coalesce(F.expr(cond), F.lit(False)).alias("matched"), F.when(F.expr(cond), p).otherwise(0).alias("contribution")) for i, s, c, p, cond in rules])
    return facts.select("page_id", F.explode(rows).alias("r")).select("page_id", "r.*")


def page_facts(pages: DataFrame, blocklist: DataFrame | None = None, evidence=(), beginning: bool = False) -> DataFrame:
    """All facts of pages, ready for scoring. Pages may carry what only a browser sees (in_frame, hidden_overlay,
    csp_weakened, layout_clone, layout_conf) and the columns of ``urls.EVIDENCE``, or other tables have those."""
    from .feeds import blocklist_match
    from .urls import classify, host_facts, open_redirects, reputation, structure, url_features, with_evidence

    out = open_redirects(structure(reputation(host_facts(with_evidence(page_context(pages, beginning), evidence)))))
    seen = {"hidden_overlay": "false", "csp_weakened": "false", "layout_clone": "false", "layout_conf": "0D"}
    known = set(out.columns)
    out = derive(out, **{k: f"coalesce({k}, {v})" if k in known else v for k, v in seen.items()})
    out = blocklist_match(out, blocklist) if blocklist is not None else out.withColumn("blocklisted", F.lit(False))
    out = clone_facts(auth_layout(phishing(out)), beginning)
    out = security_context(out)
    out = derive(
        out,
        has_auth="creds OR auth_risk IN ('medium', 'critical') OR has_password OR exists(forms, f -> f.has_password OR (f.has_email_like AND f.has_otp))",
        external_post="page_external_post OR flow_relay",
        cross_origin_creds="page_cross_origin OR flow_iframe_swap",
        oauth_spoof="flow_token_drift OR (exists(page_signals, s -> s.id = 'oauth-impersonation') AND (page_external_post OR flow_relay))",
    )
    clone = (("clone", "clone", "CASE WHEN clone_conf >= 0.8 THEN 'critical' ELSE 'high' END", "35", "clone_conf", "clone_conf >= 0.4 AND clone_corroborated AND NOT ((reputable OR provider) AND NOT brand_image)"),)
    out = out.withColumn("page_signals", F.concat("page_signals", signals(clone)))
    return classify(dom_features(url_features(out)))
