"""Scores, arbitration, decay, bands and explanations: columns over facts, no shuffle.

Rules are kept as arrays inside the row, so a verdict is one row; reports explode what they need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from .urls import SIGNALS, derive, signals

_RULES = "array<struct<id: string, cap: int, force: string>>"
_EXTERNAL = "ext_malicious OR ext_engines > 0"


def rule_hits(table) -> str:
    """SQL of the rules of a table (id, cap, force, condition) that hold, in order."""
    force = lambda f: f"'{f}'" if f else "CAST(NULL AS STRING)"
    return "CAST(array_compact(array(" + ", ".join(f"CASE WHEN {cond} THEN named_struct('id', '{rid}', 'cap', {cap}, 'force', {force(f)}) END" for rid, cap, f, cond in table) + f")) AS {_RULES})"


def points(table) -> str:
    """SQL of the sum of a table's points (id, points, condition)."""
    return "(" + " + ".join(f"CASE WHEN {cond} THEN {points} ELSE 0 END" for _, points, cond in table) + ")"


def arbitrate(facts: DataFrame) -> DataFrame:
    """Ordered hard rules: rules, cap, force and trust floor. An allowlisted root without malicious
    behaviour hits no rule; a trusted root without behavioural evidence keeps a floor instead of caps."""
    out = derive(
        facts,
        unknown="NOT reputable AND NOT provider",
        url_spoof="brand_subdomain IS NOT NULL",
        swapped="tld_swap IS NOT NULL",
        auth_or_creds="has_auth OR creds",
        idn_spoof=r"coalesce(lookalike_kind, '') = 'punycode' OR hostname RLIKE '(^|[.])xn--' OR coalesce(mixed_script, false)",
    )
    out = derive(out, evidence=f"external_post OR cross_origin_creds OR oauth_spoof OR idn_spoof OR mfa_only OR brand_text OR {_EXTERNAL} OR blocklisted OR url_spoof OR swapped")
    out = derive(
        out,
        corroborated="evidence OR lookalike_arb > 0.5 OR clone_conf >= 0.4 OR phish_conf >= 0.4 OR abused_tld IS NOT NULL OR coalesce(age_days >= 0 AND age_days < 60, false) OR scheme <> 'https' OR hidden_overlay OR email_first",
        _silent=f"allowlisted AND NOT (external_post OR cross_origin_creds OR oauth_spoof OR {_EXTERNAL})",
    )
    out = derive(out, rules=f"CASE WHEN _silent THEN CAST(array() AS {_RULES}) ELSE {rule_hits(R.ARBITRATION)} END", _floored="(reputable OR provider) AND NOT evidence AND NOT _silent")
    return derive(
        out,
        arb_cap="CASE WHEN NOT _floored THEN array_min(transform(rules, r -> r.cap)) END",
        arb_force="CASE WHEN NOT _floored THEN CASE WHEN exists(rules, r -> r.force <=> 'dangerous') THEN 'dangerous' WHEN exists(rules, r -> r.force <=> 'suspicious') OR (phish_conf >= 0.5 AND exists(rules, r -> r.id = 'unknown-login')) THEN 'suspicious' END END",
        trust_floor="CASE WHEN _floored THEN CASE WHEN reputable THEN 85 ELSE 80 END END",
    ).drop("_floored", "_silent")


def flow_signals() -> tuple:
    return tuple((f"authflow:{i}", "behavior", f"'{s}'", str(w), "0.9", cond) for i, s, w, cond in R.FLOW_SIGNALS)


def score(facts: DataFrame, sensitivity: float = 1.0) -> DataFrame:
    """Signals, score, status, confidence and band of every row of facts, in the order of the pipeline."""
    out = facts.withColumn("signals", F.concat(signals(R.URL_SIGNALS, sensitivity), F.col("page_signals"), signals(flow_signals(), sensitivity)))
    # security-research pages: visual evidence counts less unless behaviour speaks against it
    out = derive(
        out,
        trust_gain=points(R.TRUST),
        penalty="aggregate(signals, 0L, (a, s) -> a + s.contribution)",
        _floor="greatest(CASE WHEN allowlisted THEN 85 ELSE 0 END, CASE WHEN trust_count >= 3 THEN 70 ELSE 0 END)",
        _visual="aggregate(filter(signals, s -> s.id IN ('lookalike', 'clone', 'brand-impersonation')), 0L, (a, s) -> a - s.contribution)",
        damping=f"CASE WHEN context_score >= 0.6 AND NOT allowlisted AND NOT (external_post OR oauth_spoof OR creds OR cross_origin_creds OR {_EXTERNAL} OR blocklisted OR brand_subdomain IS NOT NULL OR flow_relay OR flow_token_drift OR flow_iframe_swap) THEN context_score ELSE 0D END",
        _decay=points(R.DECAY),
    )
    out = derive(out, damping_points="CAST(floor(least(_visual, 30) * damping * 0.8D + 0.5D) AS INT)", _raw=f"greatest(0, least(100, {R.BASELINE} + trust_gain + penalty))")
    out = derive(
        out,
        base_score="CAST(least(100, greatest(_raw, _floor) + damping_points) AS INT)",
        lookalike_arb="coalesce(lookalike_conf, 0D) * (1 - damping * 0.8D)",
        clone_conf="clone_conf * (1 - damping * 0.8D)",
        phish_conf="phish_conf * (1 - damping * 0.8D)",
        brand_text="brand_text AND damping = 0",
        _malicious=f"page_external_post OR page_cross_origin OR {_EXTERNAL} OR blocklisted OR brand_subdomain IS NOT NULL OR tld_swap IS NOT NULL OR coalesce(mixed_script, false)",
    )
    out = arbitrate(out)
    puny = r"lookalike_kind IS NOT NULL AND (lookalike_kind = 'punycode' OR hostname RLIKE '(^|[.])xn--')"
    out = derive(
        out,
        _spoken="NOT allowlisted OR _malicious",
        decay="CASE WHEN reputable OR provider OR allowlisted THEN _decay ELSE 0 END",
        behavioural="_malicious OR flow_relay OR flow_token_drift OR flow_iframe_swap",
    )
    out = derive(
        out,
        _capped=f"least(base_score, coalesce(arb_cap, 100), CASE WHEN {puny} THEN 45 ELSE 100 END, CASE WHEN brand_subdomain IS NOT NULL THEN 25 ELSE 100 END, CASE WHEN mixed_script THEN CASE WHEN mixed_spoof THEN 35 ELSE 50 END ELSE 100 END, CASE WHEN _spoken THEN coalesce(page_cap, 100) ELSE 100 END)",
        _force="coalesce(arb_force, CASE WHEN _spoken THEN page_force END)",
    )
    out = derive(out, score="CAST(CASE WHEN valid THEN greatest(0, CASE WHEN trust_floor IS NOT NULL AND scheme = 'https' THEN greatest(_capped, trust_floor) ELSE _capped END - decay) ELSE 50 END AS INT)", signals=f"CASE WHEN valid THEN signals ELSE CAST(array() AS {SIGNALS}) END")
    by_score = "CASE WHEN score >= 71 THEN 'safe' WHEN score >= 41 THEN 'suspicious' ELSE 'dangerous' END"
    out = derive(out, status=f"CASE WHEN NOT valid THEN 'suspicious' WHEN _force = 'dangerous' THEN 'dangerous' WHEN _force = 'suspicious' AND {by_score} = 'safe' THEN 'suspicious' ELSE {by_score} END", **_CONFIDENCES)
    return suspicion(out).drop("_floor", "_visual", "_decay", "_raw", "_malicious", "_spoken", "_capped", "_force")


def _total(kept: str, scale: float) -> str:
    return f"aggregate({kept}, 0D, (a, s) -> a + s.confidence * least(1D, s.weight / {scale}D))"


#: Confidence in the verdict and in phishing, rounded to hundredths.
_CONFIDENCES = {
    "confidence": f"CASE WHEN NOT valid THEN 0D WHEN size(signals) = 0 THEN 0.6D ELSE floor(least(1D, {_total('signals', 30)} / 1.5D) * 100 + 0.5D) / 100 END",
    "phishing_confidence": "floor(least(1D, " + _total("filter(signals, s -> s.category IN ('identity', 'structure', 'behavior', 'reputation', 'clone'))", 25) + " / 2) * 100 + 0.5D) / 100",
}


def suspicion(df: DataFrame) -> DataFrame:
    """Progressive band, and how to present it."""
    level = "CASE WHEN status = 'dangerous' AND behavioural THEN 'dangerous' WHEN status = 'dangerous' THEN 'highRisk' WHEN status = 'suspicious' AND behavioural THEN 'suspicious' WHEN status = 'suspicious' THEN 'contextual' WHEN score < 71 THEN 'contextual' ELSE 'informational' END"
    out = derive(df, _level=level, _trusted="reputable OR provider OR allowlisted")
    out = derive(out, level="CASE WHEN _trusted AND decay >= 5 AND _level = 'informational' THEN 'contextual' WHEN _trusted AND _level = 'highRisk' AND NOT behavioural THEN 'suspicious' ELSE _level END").drop("_level", "_trusted")
    return derive(
        out,
        modal="CASE level WHEN 'dangerous' THEN 'hard' WHEN 'highRisk' THEN 'soft' ELSE 'none' END",
        badge="CASE WHEN level IN ('dangerous', 'highRisk') THEN 'red' WHEN level = 'informational' THEN 'green' ELSE 'amber' END",
        presentation="CASE WHEN status = 'dangerous' AND greatest(confidence, phishing_confidence) >= 0.8 THEN 'modal' WHEN status IN ('dangerous', 'suspicious') THEN 'toast' ELSE 'silent' END",
    )


def rule_trace(verdicts: DataFrame, key: str) -> DataFrame:
    """One row a rule: its role (escalation, cap, informational) and whether a trust floor suppressed it."""
    rows = verdicts.select(key, "trust_floor", F.explode("rules").alias("r"))
    return rows.select(key, F.col("r.id").alias("rule_id"), F.col("r.cap").alias("cap"), F.col("r.force").alias("force"), F.when(F.col("r.force").isNotNull(), "escalation").when(F.col("r.cap") < 100, "cap").otherwise("informational").alias("role"), (F.col("trust_floor").isNotNull() & F.col("r.force").isNotNull()).alias("suppressed"))


def signal_rows(verdicts: DataFrame, key: str) -> DataFrame:
    """One row a signal, with its place in the row."""
    return verdicts.select(key, F.posexplode("signals").alias("place", "s")).select(key, "place", F.col("s.id").alias("signal_id"), "s.category", "s.severity", "s.weight", "s.confidence", "s.contribution")


def top_signals(verdicts: DataFrame, n: int = 2) -> DataFrame:
    """verdicts with ``top``: ids of the n most negative signals, ties in order."""
    order = F.transform("signals", lambda s, i: F.struct(s["contribution"].alias("points"), i.alias("place"), s["id"].alias("id")))
    return verdicts.withColumn("top", F.transform(F.slice(F.array_sort(order), 1, n), lambda x: x["id"]))


def top_risks(verdicts: DataFrame, n: int = 5) -> DataFrame:
    """verdicts with ``risks``: ids of the n gravest signals, by severity, then points, then order."""
    rank = lambda s: F.when(s["severity"] == "critical", -4).when(s["severity"] == "high", -3).when(s["severity"] == "medium", -2).when(s["severity"] == "low", -1).otherwise(0)
    fired = F.filter("signals", lambda s: s["contribution"] < 0)
    order = F.transform(fired, lambda s, i: F.struct(rank(s).alias("rank"), s["contribution"].alias("points"), i.alias("place"), s["id"].alias("id")))
    return verdicts.withColumn("risks", F.transform(F.slice(F.array_sort(order), 1, n), lambda x: x["id"]))


def trust_adds(n: int = 5) -> Column:
    """Ids of what earned trust, the first n in the order of the pipeline."""
    return F.expr("slice(array_compact(array(" + ", ".join(f"CASE WHEN {cond} THEN '{i}' END" for i, _, cond in R.TRUST) + f")), 1, {n})")


def explained(verdicts: DataFrame) -> DataFrame:
    """verdicts with ``risks``, ``trust`` and ``rules_by_cap``: what a report names, gravest first."""
    rules = F.transform("rules", lambda r, i: F.struct(r["cap"].alias("cap"), i.alias("place"), r["id"].alias("id")))
    return top_risks(verdicts).withColumns({"trust": F.when(F.col("valid"), trust_adds()).otherwise(F.array().cast("array<string>")), "rules_by_cap": F.transform(F.array_sort(rules), lambda r: r["id"])})


def bullets(verdicts: DataFrame, signal_phrases: dict[str, str], rule_phrases: dict[str, str], calm: str) -> DataFrame:
    """verdicts with ``bullets``: at most four distinct phrases, of the three gravest risks, then of the rules in
    their order, then, if there are fewer than two, of what earned trust; ``calm`` for a safe page without any."""
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    told = lambda ids, d: F.array_compact(F.transform(ids, lambda i: F.try_element_at(table(d), i)))
    out = explained(verdicts)
    grave = F.slice(F.array_distinct(F.concat(told(F.slice("risks", 1, 3), signal_phrases), told(F.transform("rules", lambda r: r["id"]), rule_phrases))), 1, 4)
    out = out.withColumn("_told", grave)
    out = out.withColumn("_told", F.when(F.size("_told") < 2, F.slice(F.array_distinct(F.concat("_told", told(F.col("trust"), signal_phrases))), 1, 4)).otherwise(F.col("_told")))
    return out.withColumn("bullets", F.when((F.size("_told") == 0) & (F.col("status") == "safe"), F.array(F.lit(calm))).otherwise(F.col("_told"))).drop("_told")


def url_verdicts(urls: DataFrame, blocklist: DataFrame | None = None, sensitivity: float = 1.0, evidence=()) -> DataFrame:
    """URL-only verdicts from end to end."""
    from .urls import url_facts

    return score(url_facts(urls, blocklist, evidence), sensitivity)
