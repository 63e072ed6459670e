"""URL operators: parts, reputation, look-alikes, redirects, and the facts that scoring needs.

Everything is columns over one row a URL. Facts that depend on the host alone (look-alikes, alphabets,
Unicode forms) are worked out once a distinct host and joined back, because few hosts carry most URLs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import hosts as H
from ..functions import rules as R


def derive(df: DataFrame, **columns: str) -> DataFrame:
    """``df`` with columns from SQL expressions over those it has: one step of the plan, parsed at once."""
    return df.withColumns({name: F.expr(text) for name, text in columns.items()})


def url_parts(urls: DataFrame) -> DataFrame:
    """Scheme, user info, hostname (ASCII, lower case), host without ``www.``, path, query, root, tld.
    ``valid`` is false for what isn't an absolute URL."""
    url = F.col("url")
    out = urls.withColumns({"scheme": F.lower(H.url_part(url, 1)), "userinfo": H.url_part(url, 2), "hostname": F.lower(H.url_part(url, 3)), "path": H.url_part(url, 4), "query": H.url_part(url, 5)})
    out = out.withColumn("is_idn", F.col("hostname").rlike(H.IDN)).withColumn("hostname", H.rare(H._ascii_udf, F.col("hostname")))
    out = out.withColumn("host", H.no_www(F.col("hostname"))).withColumn("root", H.root_domain("host"))
    return out.withColumns({"tld": F.when(F.col("host").contains("."), F.substring_index("host", ".", -1)).otherwise(""), "valid": F.col("hostname") != ""})


def unicode_hosts(parts: DataFrame) -> DataFrame:
    """Distinct hosts with their Unicode form."""
    hosts = parts.where("valid").select("hostname", "host").distinct()
    return hosts.withColumn("host_unicode", H.rare(H._unicode_udf, F.col("host")))


def lookalikes(hosts: DataFrame) -> DataFrame:
    """Look-alike kind, brand and confidence of distinct hosts (hostname, host, host_unicode): homoglyphs
    before typos before punycode before a brand's name inside the host."""
    brands = F.expr("array(" + ", ".join(f"named_struct('brand', '{b}', 'name', '{b.split('.')[0]}', 'place', {i})" for i, b in enumerate(C.LOOKALIKE_BRANDS)) + ")")
    out = hosts.withColumns({"root_unicode": H.root_domain("host_unicode"), "root_ascii": H.root_domain("host"), "punycode": F.col("host").rlike(r"(^|\.)xn--")})
    out = out.withColumn("root_normal", H.normal_form(F.col("root_unicode")))

    def distance(b: Column) -> Column:
        each = [F.levenshtein(F.col(c), b["brand"], 2) for c in ("root_unicode", "root_normal", "root_ascii")]
        return F.least(*[F.when(d < 0, 99).otherwise(d) for d in each])

    near = F.filter(F.transform(brands, lambda b: F.struct(distance(b).alias("distance"), b["place"].alias("place"), b["brand"].alias("brand"))), lambda x: (x["distance"] > 0) & (x["distance"] <= 2) & (F.abs(F.length("root_normal") - F.length(x["brand"])) <= 3))
    words = F.flatten(F.array(*[F.split(F.col(c), "[.-]") for c in ("host_unicode", "host", "root_normal")]))
    inside = F.filter(brands, lambda b: (F.length(b["name"]) >= 4) & (F.col("root_normal") != b["brand"]) & F.array_contains(words, b["name"]))
    out = out.withColumns({"_typo": F.array_min(near), "_inside": H.first_of(inside)["brand"]})
    return _kinds(out, H.one_of("root_normal", C.LOOKALIKE_BRANDS), H.one_of("root_unicode", C.LOOKALIKE_BRANDS))


def _kinds(out: DataFrame, known: Column, same: Column) -> DataFrame:
    """Kind, brand and confidence from _typo, _inside and whether the root's normal and own forms are brands."""
    exact = ~F.col("punycode") & same
    kind = (
        F.when(exact, None)
        .when((F.col("root_normal") != F.col("root_unicode")) & known, "homoglyph")
        .when(F.col("_typo").isNotNull(), "typo")
        .when(F.col("punycode"), "punycode")
        .when(F.col("_inside").isNotNull(), "brand-in-host")
    )
    out = out.withColumn("lookalike_kind", kind)
    brand = F.when(F.col("lookalike_kind") == "homoglyph", F.col("root_normal")).when(F.col("lookalike_kind") == "typo", F.col("_typo.brand")).when(F.col("lookalike_kind") == "brand-in-host", F.col("_inside"))
    conf = F.when(F.col("lookalike_kind") == "homoglyph", 0.95).when(F.col("lookalike_kind") == "typo", F.greatest(F.lit(0.6), 1 - F.col("_typo.distance") * 0.2)).when(F.col("lookalike_kind") == "punycode", 0.75).when(F.col("lookalike_kind") == "brand-in-host", 0.55)
    return out.withColumns({"lookalike_brand": brand, "lookalike_conf": F.coalesce(conf, F.lit(0.0)), "lookalike_distance": F.when(F.col("lookalike_kind") == "typo", F.col("_typo.distance"))}).drop("_typo", "_inside")


def deletions(text: Column, most: int = 2) -> Column:
    """A string and all that is left of it without up to ``most`` of its characters."""
    def shorter(s: Column) -> Column:
        places = F.when(F.length(s) > 0, F.sequence(F.lit(1), F.length(s))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))

    last, all_ = F.array(text), F.array(text)
    for _ in range(most):
        last = F.array_distinct(F.flatten(F.transform(last, shorter)))
        all_ = F.concat(all_, last)
    return F.array_distinct(all_)


def near_brands(hosts: DataFrame, brands: DataFrame) -> DataFrame:
    """(hostname, _typo): the nearest brand within two edits of a form of the root, for a list (place, brand) of any size.

    Two strings within two edits of each other have a string in common that each becomes by leaving out up to two
    characters; those are the join keys, so a host meets few brands. Forms too long for any brand have no keys."""
    longest = brands.agg(F.max(F.length("brand"))).scalar() + 2
    index = brands.select("place", "brand", F.explode(deletions(F.col("brand"))).alias("key"))
    forms = hosts.select("hostname", F.length("root_normal").alias("size"), F.explode(F.array_distinct(F.array("root_unicode", "root_normal", "root_ascii"))).alias("form"))
    keys = forms.where(F.length("form") <= longest).withColumn("key", F.explode(deletions(F.col("form"))))
    met = keys.join(index, "key").select("hostname", "size", "form", "place", "brand").distinct()
    edits = met.withColumn("edits", F.levenshtein("form", "brand", 2)).where("edits >= 0 AND abs(size - length(brand)) <= 3")
    best = edits.groupBy("hostname", "place", "brand").agg(F.min("edits").alias("distance")).where("distance > 0")
    return best.groupBy("hostname").agg(F.min(F.struct("distance", "place", "brand")).alias("_typo"))


def lookalikes_of(hosts: DataFrame, brands: DataFrame) -> DataFrame:
    """``lookalikes`` for a table of brands (place, brand) of any size: joins by equality instead of a pass over the list."""
    out = hosts.withColumns({"root_unicode": H.root_domain("host_unicode"), "root_ascii": H.root_domain("host"), "punycode": F.col("host").rlike(r"(^|\.)xn--")})
    out = out.withColumn("root_normal", H.normal_form(F.col("root_unicode")))
    words = out.select("hostname", "root_normal", F.explode(F.array_distinct(F.flatten(F.array(*[F.split(F.col(c), "[.-]") for c in ("host_unicode", "host", "root_normal")])))).alias("name"))
    named = brands.select("place", "brand", F.substring_index("brand", ".", 1).alias("name")).where("length(name) >= 4")
    inside = words.join(named, "name").where("root_normal <> brand").groupBy("hostname").agg(F.min(F.struct("place", "brand"))["brand"].alias("_inside"))
    out = out.join(near_brands(out, brands), "hostname", "left").join(inside, "hostname", "left")
    for form in ("root_normal", "root_unicode"):
        out = out.join(brands.select(F.col("brand").alias(form), F.lit(True).alias(f"_{form}_known")).distinct(), form, "left")
    is_known = lambda form: F.coalesce(f"_{form}_known", F.lit(False))
    return _kinds(out, is_known("root_normal"), is_known("root_unicode")).drop("_root_normal_known", "_root_unicode_known")


def mixed_scripts(hosts: DataFrame) -> DataFrame:
    """The first label that mixes alphabets, and whether Latin meets one that can pass for it."""
    labels = F.transform(F.split("host_unicode", r"\."), lambda x: F.struct(x.alias("label"), H.scripts_of(x).alias("scripts")))
    found = H.first_of(F.filter(labels, lambda x: F.size(x["scripts"]) >= 2))
    spoof = F.array_contains(found["scripts"], "latin") & F.arrays_overlap(found["scripts"], H.letters(("cyrillic", "greek", "armenian")))
    return hosts.withColumns({"mixed_script": found.isNotNull(), "mixed_label": found["label"], "mixed_spoof": F.coalesce(spoof, F.lit(False))})


def host_facts(parts: DataFrame) -> DataFrame:
    """``parts`` with look-alike and alphabet facts, by way of the distinct hosts."""
    hosts = mixed_scripts(lookalikes(unicode_hosts(parts))).select("hostname", "host_unicode", "lookalike_kind", "lookalike_brand", "lookalike_conf", "lookalike_distance", "mixed_script", "mixed_spoof", "mixed_label")
    return parts.join(hosts, "hostname", "left")


def reputation(parts: DataFrame) -> DataFrame:
    """Repute of the root, brands in subdomains or on other TLDs, abused TLDs, shorteners, lure wording."""
    brands, swapped = f"array({H.sql_list(C.BRAND_DOMAINS)})", "length(substring_index(b, '.', 1)) >= 4 AND substring_index(b, '.', 1) = substring_index(root, '.', 1)"
    out = derive(
        parts,
        reputable=f"root IN ({H.sql_list(C.REPUTABLE_ROOTS)})",
        provider=f"root IN ({H.sql_list(C.LOGIN_ROOTS)})",
        _web="scheme IN ('http', 'https') AND valid",
        # in order, up to the brand that the root itself is
        _upto=f"CASE WHEN array_position({brands}, root) > 0 THEN slice({brands}, 1, CAST(array_position({brands}, root) AS INT) - 1) ELSE {brands} END",
        safelist_kind="CASE " + " ".join(f"WHEN root IN ({H.sql_list(roots)}) THEN '{kind}'" for kind, roots in C.SAFELIST.items()) + " END",
        shortener=f"scheme IN ('http', 'https') AND valid AND root IN ({H.sql_list(C.URL_SHORTENERS)})",
    )
    out = derive(out, trusted="reputable OR provider", brand_subdomain="CASE WHEN _web THEN try_element_at(filter(_upto, b -> contains(host, concat(b, '.'))), 1) END")
    return derive(
        out,
        tld_swap=f"CASE WHEN _web AND brand_subdomain IS NULL AND NOT trusted THEN try_element_at(filter(_upto, b -> {swapped}), 1) END",
        abused_tld=f"CASE WHEN _web AND NOT trusted AND tld IN ({H.sql_list(C.ABUSED_TLDS)}) THEN tld END",
        phishy_token=f"CASE WHEN _web AND NOT trusted THEN try_element_at(filter(array({H.sql_list(C.PHISHY_TOKENS)}), t -> contains(concat(host, ' ', lower(path)), t)), 1) END",
    ).drop("_web", "_upto")


def structure(parts: DataFrame) -> DataFrame:
    """Counts and flags of the URL's shape."""
    name = F.col("hostname")
    return parts.withColumns(
        {
            "is_ip": name.rlike(H.IP),
            "dashes": F.length(name) - F.length(F.replace(name, F.lit("-"))),
            "depth": F.size(F.split(name, r"\.")),
            "host_length": F.length(name),
            "auth_label": F.substring_index("root", ".", 1).rlike("(?i)login|verify|secure|account|update|wallet|signin"),
        }
    )


def open_redirects(parts: DataFrame) -> DataFrame:
    found = H.redirect_target(F.col("query"), F.col("root"))
    out = parts.withColumn("_r", F.when(F.col("scheme").isin("http", "https"), found))
    return out.withColumns({"redirect_param": F.col("_r.param"), "redirect_host": F.col("_r.target_host"), "redirect_risky": F.coalesce(F.col("_r.risky"), F.lit(False))}).drop("_r")


def url_features(parts: DataFrame) -> DataFrame:
    """The classifier's features that a URL alone has (host, host_unicode, root, path, scheme)."""
    host = F.col("host")
    sub = F.size(F.split("host", r"\.")) - F.size(F.split("root", r"\."))
    hay = F.lower(F.concat(F.coalesce("host_unicode", "host"), "path"))
    below = F.array_join(F.slice(F.split("host", r"\."), F.lit(1), F.greatest(F.lit(0), sub)), ".")
    brandy = r"(?<![A-Za-z0-9_])(paypal|apple|microsoft|google|amazon|netflix|coinbase|metamask|bank|hdfc|icici|sbi|instagram|facebook|whatsapp)(?![A-Za-z0-9_])"
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    features = {
        "not_https": flag(F.col("scheme") != "https"),
        "punycode": flag(host.rlike(r"(^|\.)xn--")),
        "abused_tld_f": flag(H.one_of("substring_index(host, '.', -1)", C.CLASSIFIER_TLDS)),
        "many_subdomains": F.when(sub >= 3, 1.0).when(sub == 2, 0.5).otherwise(0.0),
        "host_digits_ratio": F.when(F.length(host) > 0, F.regexp_count(host, F.lit("[0-9]")) / F.length(host)).otherwise(0.0),
        "host_hyphens": F.least(F.lit(3), F.regexp_count(host, F.lit("-"))).cast("double"),
        "lure_tokens": F.least(F.lit(3), F.size(F.filter(H.letters(C.LURE_TOKENS), lambda t: F.contains(hay, t)))).cast("double"),
        "brand_in_subdomain": flag(below.rlike(brandy)),
    }
    return parts.withColumns({k: F.when(F.col("valid"), v).otherwise(0.0) for k, v in features.items()})


def no_page(df: DataFrame) -> DataFrame:
    """Page features and facts of a URL whose page isn't known. What its sign-in flow shows counts all the same."""
    zero = ("has_password_field", "cross_origin_form", "many_external_scripts", "obfuscation", "clone_conf", "layout_conf", "phish_conf", "context_score")
    flags = ("has_auth", "creds", "page_external_post", "brand_text", "brand_image", "page_cross_origin", "mfa_only", "email_first", "layout_clone", "hidden_overlay", "csp_weakened")
    flows = {"external_post": "flow_relay", "cross_origin_creds": "flow_iframe_swap", "oauth_spoof": "flow_token_drift"}
    return df.withColumns({k: F.lit(0.0) for k in zero} | {k: F.lit(False) for k in flags} | {k: F.col(v) for k, v in flows.items()} | {"page_cap": F.lit(None).cast("int"), "page_force": F.lit(None).cast("string"), "page_signals": F.array().cast(SIGNALS)})


#: What other tables may know of a URL, and what counts where they don't.
EVIDENCE = {"age_days": "CAST(NULL AS DOUBLE)", "hops": "0", "chain_roots": "0", "allowlisted": "false", "trust_count": "0", "ext_malicious": "false", "ext_engines": "0"} | {f"flow_{k}": "false" for k in ("relay", "token_drift", "iframe_swap", "mfa_split", "redirect_storm")}


def with_evidence(parts: DataFrame, evidence=()) -> DataFrame:
    """``parts`` with the columns of EVIDENCE: own ones, or those of other tables. ``evidence`` has pairs of a table and
    the column that it is joined by (url, root, tab_id). Of several rows of a key the greatest counts, so none multiplies
    verdicts; a third element that is true says that keys are unique by how the table is made."""
    for table, key, *unique in evidence:
        if not any(unique):
            facts = [c for c in table.columns if c != key]
            table = table.groupBy(key).agg(F.max(F.struct(*facts)).alias("_e")).select(key, "_e.*")
        parts = parts.join(table, key, "left")
    return parts.withColumns({k: F.expr(f"coalesce({k}, {v})" if k in parts.columns else v) for k, v in EVIDENCE.items()})


SIGNALS = "array<struct<id: string, category: string, severity: string, weight: double, confidence: double, contribution: bigint>>"


def signals(table=R.URL_SIGNALS, sensitivity: float = 1.0) -> Column:
    """The signals of a row by a rule table, in its order. A signal takes -floor(weight * confidence *
    sensitivity + 0.5) points."""

    def one(sid, category, severity, weight, conf, condition):
        w, c = f"CAST({weight} AS DOUBLE)", f"least(1D, greatest(0D, CAST({conf} AS DOUBLE)))"
        points = f"-CAST(floor({w} * {c} * {float(sensitivity)}D + 0.5D) AS BIGINT)"
        return f"CASE WHEN {condition} THEN named_struct('id', '{sid}', 'category', '{category}', 'severity', {severity}, 'weight', {w}, 'confidence', {c}, 'contribution', {points}) END"

    return F.array_compact(F.expr("array(" + ", ".join(one(*r) for r in table) + ")")).cast(SIGNALS)


def classify(df: DataFrame) -> DataFrame:
    """Probability of the bundled linear classifier, rounded to hundredths; 0 on trusted roots."""
    from .classifier import apply

    return apply(df, {"bias": R.CLASSIFIER_BIAS, "weights": dict(R.CLASSIFIER)}, "probability")


def top_contributors(n: int = 4) -> Column:
    """The largest positive terms of the classifier, ties in order of features."""
    terms = F.array(*[F.struct((-F.floor(F.col(k) * w * 100 + 0.5) / 100).alias("key"), F.lit(i).alias("place"), F.lit(k).alias("feature")) for i, (k, w) in enumerate(R.CLASSIFIER)])
    return F.slice(F.transform(F.array_sort(F.filter(terms, lambda t: t["key"] < 0)), lambda t: F.struct(t["feature"].alias("feature"), (-t["key"]).alias("contribution"))), 1, n)


def url_facts(urls: DataFrame, blocklist: DataFrame | None = None, evidence=()) -> DataFrame:
    """All facts of URLs without their pages. ``urls`` may carry columns of EVIDENCE, or other tables have them."""
    out = open_redirects(structure(reputation(host_facts(with_evidence(url_parts(urls), evidence)))))
    if blocklist is not None:
        from .feeds import blocklist_match

        out = blocklist_match(out, blocklist)
    elif "blocklisted" not in out.columns:
        out = out.withColumn("blocklisted", F.lit(False))
    return classify(no_page(url_features(out)))
