"""Rule tables as SQL expressions over fact columns. Weights, confidences, caps and order are fixed values.

A rule is data: the same tables give the signals of a row, the long table of signals and the reports.
"""

from __future__ import annotations

# (id, category, severity, weight, confidence, condition) in order of evaluation.
URL_SIGNALS = (
    ("no-https", "transport", "'high'", "25", "1.0", "scheme <> 'https'"),
    ("new-domain", "identity", "'medium'", "22", "1e0 - age_days / 60e0", "age_days >= 0 AND age_days < 60"),
    ("lookalike", "identity", "CASE WHEN lookalike_conf > 0.8 THEN 'critical' ELSE 'high' END", "45", "lookalike_conf", "lookalike_kind IS NOT NULL"),
    ("userinfo", "structure", "'high'", "20", "1.0", "userinfo <> ''"),
    ("ip-host", "structure", "'medium'", "15", "1.0", "is_ip"),
    ("many-dashes", "structure", "'low'", "6", "least(1e0, (dashes - 3) / 4e0)", "dashes >= 4"),
    ("deep-subdomain", "structure", "'low'", "6", "least(1e0, (depth - 4) / 3e0)", "depth > 4"),
    ("long-host", "structure", "'low'", "4", "least(1e0, (host_length - 40) / 30e0)", "host_length > 40"),
    ("auth-keyword", "structure", "'medium'", "10", "0.7", "auth_label AND lookalike_kind IS NULL AND NOT reputable AND NOT provider"),
    ("long-redirects", "behavior", "'medium'", "12", "least(1e0, (hops - 3) / 5e0)", "hops > 3"),
    ("cross-domain-redirects", "behavior", "'medium'", "10", "0.8", "chain_roots >= 3"),
    ("threat-blocklist", "reputation", "'critical'", "85", "0.97", "blocklisted"),
    ("gsb", "reputation", "'critical'", "90", "1.0", "ext_malicious"),
    ("vt", "reputation", "'critical'", "80", "least(1.0, 0.4 + ext_engines * 0.15)", "ext_engines > 0"),
    ("brand-subdomain-spoof", "identity", "'critical'", "48", "0.9", "brand_subdomain IS NOT NULL"),
    ("tld-swap", "identity", "'high'", "30", "0.8", "tld_swap IS NOT NULL"),
    ("abused-tld", "identity", "CASE WHEN has_auth THEN 'medium' ELSE 'low' END", "CASE WHEN has_auth THEN 14 ELSE 7 END", "CASE WHEN has_auth THEN 0.7 ELSE 0.35 END", "abused_tld IS NOT NULL"),
    ("url-shortener", "behavior", "'low'", "4", "0.5", "shortener"),
    ("phishy-token", "structure", "CASE WHEN has_auth THEN 'medium' ELSE 'low' END", "CASE WHEN has_auth THEN 8 ELSE 4 END", "CASE WHEN has_auth THEN 0.6 ELSE 0.4 END", "phishy_token IS NOT NULL"),
    ("mixed-script-host", "identity", "CASE WHEN mixed_spoof THEN 'critical' ELSE 'high' END", "CASE WHEN mixed_spoof THEN 45 ELSE 28 END", "CASE WHEN mixed_spoof THEN 0.95 ELSE 0.75 END", "mixed_script"),
    ("open-redirect", "behavior", "CASE WHEN redirect_risky THEN 'high' ELSE 'medium' END", "CASE WHEN redirect_risky THEN 22 ELSE 12 END", "CASE WHEN redirect_risky THEN 0.8 ELSE 0.55 END", "redirect_host IS NOT NULL"),
    ("ml-phishing-structure", "behavioral", "CASE WHEN probability >= 0.92 THEN 'critical' ELSE 'high' END", "CASE WHEN probability >= 0.92 THEN 30 ELSE 18 END", "probability", "probability >= 0.8"),
)

# (id, points, condition): what earns trust.
TRUST = (
    ("https-trust", "10", "scheme = 'https'"),
    ("known-reputable", "28", "reputable"),
    ("trusted-provider", "14", "provider AND NOT reputable"),
    ("allowlist-trust", "40", "allowlisted"),
    ("learned-safe-trust", "least(20, 8 + 2 * trust_count)", "trust_count >= 3"),
    ("no-auth-risk", "5", "scheme = 'https' AND NOT has_auth"),
    ("established-domain", "6", "age_days > 365"),
)

# (id, cap, force or null, condition) in order of evaluation.
ARBITRATION = (
    ("threat-blocklist", 12, "dangerous", "blocklisted"),
    ("brand-subdomain-creds", 18, "dangerous", "url_spoof AND auth_or_creds"),
    ("tld-swap-creds", 22, "dangerous", "NOT (url_spoof AND auth_or_creds) AND swapped AND auth_or_creds AND unknown"),
    ("tld-swap", 45, "suspicious", "NOT (url_spoof AND auth_or_creds) AND NOT (swapped AND auth_or_creds AND unknown) AND swapped"),
    ("brand-subdomain", 40, "suspicious", "url_spoof AND NOT blocklisted"),
    ("external-post-clone", 15, "dangerous", "external_post AND (brand_text OR brand_image OR clone_conf >= 0.6)"),
    ("external-post", 20, "dangerous", "external_post"),
    ("lookalike-creds", 25, "dangerous", "lookalike_arb > 0.9 AND creds AND unknown"),
    ("brand-creds", 25, "dangerous", "brand_text AND creds AND unknown"),
    ("clone-auth", 25, "dangerous", "clone_conf >= 0.8 AND auth_or_creds AND unknown AND evidence"),
    ("idn-creds", 25, "dangerous", "idn_spoof AND creds"),
    ("cross-origin-credentials", 20, "dangerous", "cross_origin_creds AND unknown"),
    ("oauth-spoof", 22, "dangerous", "oauth_spoof AND unknown"),
    ("mfa-harvest", 25, "dangerous", "mfa_only AND unknown"),
    ("auth-layout-clone", 25, "dangerous", "layout_clone AND unknown AND evidence"),
    ("lookalike-strong", 35, "suspicious", "lookalike_arb > 0.85 AND unknown"),
    ("idn-auth", 30, "suspicious", "idn_spoof AND has_auth"),
    ("idn", 45, "suspicious", "idn_spoof"),
    ("auth-layout-soft-unknown", 35, "suspicious", "layout_clone AND unknown AND NOT evidence"),
    ("clone-medium", 35, "suspicious", "clone_conf >= 0.6 AND unknown"),
    ("clone-soft", 55, None, "clone_conf >= 0.4 AND clone_conf < 0.6 AND unknown"),
    ("brand-text", 45, "suspicious", "brand_text AND NOT reputable"),
    ("unknown-login", 60, None, "creds AND unknown AND corroborated"),
    ("unknown-auth", 70, None, "has_auth AND NOT creds AND unknown AND corroborated"),
    ("abused-tld-auth", 55, "suspicious", "abused_tld IS NOT NULL AND has_auth AND unknown"),
    ("hidden-overlay", 35, "suspicious", "hidden_overlay AND unknown"),
    ("email-first", 55, "suspicious", "email_first AND unknown AND NOT creds"),
    ("auth-layout-soft", 55, None, "NOT layout_clone AND layout_conf >= 0.5 AND unknown"),
    ("trusted-but-suspicious", 55, "suspicious", "provider AND evidence AND (lookalike_arb > 0.85 OR clone_conf >= 0.6)"),
)

# (id, points, condition) on trusted roots.
DECAY = (
    ("external-credential-post", 60, "page_external_post"),
    ("cross-origin-cred-iframe", 35, "page_cross_origin OR flow_iframe_swap"),
    ("oauth-relay-mismatch", 30, "flow_token_drift"),
    ("hidden-login-overlay", 15, "hidden_overlay"),
    ("csp-weakening", 10, "csp_weakened"),
    ("abnormal-redirect-chain", 12, "flow_redirect_storm"),
    ("auth-flow-mutation", 18, "flow_mfa_split"),
)

# (id, severity, weight) of sign-in flow anomalies, all of confidence 0.9.
FLOW_SIGNALS = (
    ("credential-relay", "high", 50, "flow_relay"),
    ("oauth-token-drift", "high", 35, "flow_token_drift"),
    ("iframe-origin-swap", "medium", 28, "flow_iframe_swap"),
    ("mfa-origin-split", "medium", 20, "flow_mfa_split"),
    ("redirect-storm", "medium", 14, "flow_redirect_storm"),
)

# (feature, weight) of the bundled classifier, and its bias.
CLASSIFIER_BIAS = -1.519
CLASSIFIER = (
    ("not_https", 1.1), ("has_password_field", 1.0), ("cross_origin_form", 1.7), ("many_external_scripts", 0.7), ("obfuscation", 1.2), ("punycode", 0.0),
    ("abused_tld_f", 2.0011), ("many_subdomains", 1.4262), ("host_digits_ratio", 9.0909), ("host_hyphens", 0.8407), ("lure_tokens", 0.2319), ("brand_in_subdomain", 0.0),
)
SENSITIVITY = {"strict": 1.25, "balanced": 1.0, "lenient": 0.75}
BASELINE = 62
