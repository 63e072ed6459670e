"""Lists, weights and limits that results depend on. Order is part of the value where a
first match counts."""

from __future__ import annotations

# Fixed values. High-abuse top-level domains.
ABUSED_TLDS = (
    "tk", "ml", "ga", "cf", "gq", "zip", "mov", "top", "xyz", "gdn", "kim", "country", "science", "work", "party", "click",
    "link", "review", "stream", "download", "loan", "racing", "win", "bid", "cricket", "men", "date", "faith", "accountant",
    "trade", "webcam", "rest", "fit", "cam", "sbs", "lol", "makeup", "mom", "quest", "cyou", "icu", "monster", "beauty", "hair",
    "autos", "boats", "christmas", "wang", "buzz", "rodeo", "vip", "shop",
)

# Fixed values. Link shorteners.
URL_SHORTENERS = (
    "bit.ly", "tinyurl.com", "t.co", "goo.gl", "ow.ly", "is.gd", "buff.ly", "rebrand.ly", "cutt.ly", "shorturl.at", "t.ly",
    "rb.gy", "tiny.cc", "bl.ink", "lnkd.in", "db.tt", "qr.ae", "adf.ly", "bit.do", "mcaf.ee", "su.pr", "x.co", "v.gd",
    "trib.al", "shor.by", "soo.gd", "clck.ru", "tr.im", "cli.gs", "shrtco.de", "1url.com", "snip.ly",
)

# Fixed values. Domains sought inside subdomains, in order of precedence.
BRAND_DOMAINS = (
    "paypal.com", "apple.com", "icloud.com", "microsoft.com", "microsoftonline.com", "office365.com", "outlook.com", "live.com",
    "google.com", "gmail.com", "amazon.com", "netflix.com", "facebook.com", "instagram.com", "whatsapp.com", "linkedin.com",
    "github.com", "dropbox.com", "adobe.com", "coinbase.com", "binance.com", "metamask.io", "chase.com", "wellsfargo.com",
    "bankofamerica.com", "citi.com", "americanexpress.com", "hdfcbank.com", "icicibank.com", "sbi.co.in", "axisbank.com",
    "kotak.com", "dhl.com", "fedex.com", "ups.com", "usps.com", "irs.gov", "gov.uk",
)

# Fixed values. Lure wording in host or path, in order of precedence.
PHISHY_TOKENS = (
    "secure-", "-secure", "account-update", "verify-account", "account-verify", "confirm-account", "signin-", "-signin",
    "login-verify", "webscr", "update-billing", "unlock-account", "suspended-account", "security-alert", "wallet-connect",
    "validate-", "recover-account", "appeal-",
)

# Fixed values. Domains that look-alikes are held against, in order of precedence.
LOOKALIKE_BRANDS = (
    "google.com", "gmail.com", "youtube.com", "facebook.com", "instagram.com", "whatsapp.com", "apple.com", "icloud.com",
    "microsoft.com", "outlook.com", "live.com", "office.com", "amazon.com", "paypal.com", "netflix.com", "github.com",
    "linkedin.com", "twitter.com", "x.com", "dropbox.com", "adobe.com", "ionos.com", "1and1.com", "binance.com", "coinbase.com",
    "metamask.io", "chase.com", "wellsfargo.com", "bankofamerica.com", "hdfcbank.com", "icicibank.com", "sbi.co.in",
    "axisbank.com", "kotak.com", "rbi.org.in",
)

# Fixed values. Public suffixes of two labels.
TWO_LEVEL_SUFFIXES = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "net.uk", "ltd.uk", "plc.uk", "me.uk", "co.in", "net.in", "org.in", "gen.in",
    "firm.in", "ind.in", "ac.in", "gov.in", "bank.in", "com.au", "net.au", "org.au", "edu.au", "gov.au", "asn.au", "id.au",
    "co.nz", "net.nz", "org.nz", "ac.nz", "govt.nz", "school.nz", "geek.nz", "co.za", "net.za", "org.za", "web.za", "gov.za",
    "ac.za", "co.jp", "ne.jp", "or.jp", "ac.jp", "go.jp", "ad.jp", "ed.jp", "gr.jp", "com.br", "net.br", "org.br", "gov.br",
    "edu.br", "ind.br", "com.sg", "edu.sg", "com.hk", "org.hk", "com.mx", "com.ar", "com.tr", "com.pk", "net.pk", "org.pk",
    "edu.pk", "gov.pk", "gob.pk", "co.ke", "ne.ke", "or.ke", "ac.ke", "go.ke", "sc.ke", "me.ke", "com.ng", "net.ng", "org.ng",
    "edu.ng", "gov.ng", "sch.ng", "co.id", "net.id", "or.id", "ac.id", "go.id", "sch.id", "web.id", "my.id",
)

# Fixed values. Query parameters that carry a redirect target.
REDIRECT_PARAMS = (
    "url", "redirect", "redirecturl", "redirect_url", "next", "return", "returnurl", "return_url", "returnto", "dest",
    "destination", "continue", "goto", "target", "u", "r", "link", "out", "redir", "forward", "to", "rurl", "checkout_url",
)

# Fixed values. Roots of good repute.
REPUTABLE_ROOTS = (
    "example.com", "wikipedia.org", "github.com", "google.com", "microsoft.com", "apple.com", "paypal.com", "amazon.com",
    "linkedin.com", "youtube.com", "stripe.com", "cloudflare.com", "okta.com", "notion.so", "slack.com", "figma.com",
    "atlassian.com", "dropbox.com", "gitlab.com", "ionos.com", "1and1.com",
)

# Fixed values. Roots of sign-in providers, for scoring.
LOGIN_ROOTS = (
    "google.com", "microsoft.com", "microsoftonline.com", "live.com", "office.com", "office365.com", "outlook.com",
    "sharepoint.com", "apple.com", "icloud.com", "github.com", "gitlab.com", "atlassian.com", "slack.com", "dropbox.com",
    "notion.so", "figma.com", "okta.com", "auth0.com", "linkedin.com", "facebook.com", "x.com", "twitter.com", "amazon.com",
    "paypal.com", "stripe.com", "shopify.com", "netflix.com", "spotify.com", "adobe.com", "ionos.com", "1and1.com",
)

# Fixed values. Roots of sign-in providers, for page analysis (a wider list).
PAGE_LOGIN_ROOTS = (
    "google.com", "accounts.google.com", "youtube.com", "gmail.com", "microsoft.com", "microsoftonline.com", "live.com",
    "office.com", "outlook.com", "office365.com", "sharepoint.com", "apple.com", "icloud.com", "appleid.apple.com",
    "github.com", "gitlab.com", "bitbucket.org", "atlassian.com", "slack.com", "dropbox.com", "notion.so", "figma.com",
    "zoom.us", "okta.com", "auth0.com", "onelogin.com", "duosecurity.com", "linkedin.com", "twitter.com", "x.com",
    "facebook.com", "instagram.com", "amazon.com", "paypal.com", "stripe.com", "shopify.com", "ebay.com", "netflix.com",
    "spotify.com", "adobe.com", "chase.com", "wellsfargo.com", "bankofamerica.com", "citi.com", "capitalone.com",
    "americanexpress.com", "hdfcbank.com", "hdfc.bank.in", "icicibank.com", "icici.bank.in", "axisbank.com", "axis.bank.in",
    "kotak.com", "kotak.bank.in", "sbi.co.in", "sbi.bank.in", "rbi.org.in", "ionos.com", "1and1.com",
)

# Fixed values. Top-level domains of the classifier's feature.
CLASSIFIER_TLDS = (
    "tk", "ml", "ga", "cf", "gq", "work", "click", "link", "xyz", "top", "online", "support", "rest", "country", "kim",
    "science", "party", "gdn", "zip", "mov",
)

# Fixed values. Words of the classifier's lure feature.
LURE_TOKENS = (
    "secure", "verify", "account", "login", "signin", "update", "confirm", "unlock", "billing", "recover", "wallet",
    "authenticate", "validation",
)

# Fixed values. Words of security research.
RESEARCH_TERMS = (
    "phishing analysis", "phishing kit", "phishing campaign", "phishing sample", "phishing url", "threat intelligence", "ioc",
    "indicator of compromise", "indicators of compromise", "malware sample", "malware analysis", "sandbox analysis",
    "detonation", "url scan", "url analysis", "scan report", "submission report", "submitted url", "analysis report",
    "virustotal", "urlscan", "phishtank", "any.run", "anyrun", "hybrid-analysis", "hybrid analysis", "joe sandbox",
    "joesandbox", "tria.ge", "triage report", "abuse.ch", "openphish", "alienvault", "otx pulse", "misp", "yara rule",
    "sigma rule",
)

# Fixed values. Words of teaching material.
EDUCATION_TERMS = (
    "tutorial", "documentation", "docs", "example", "code example", "demo", "demonstration", "sample app", "getting started",
    "guide", "walkthrough", "reference", "developer guide", "api reference", "training", "course", "lesson", "workshop",
    "lab exercise", "awareness", "simulation exercise", "phishing awareness", "security training", "security awareness",
    "educational",
)

# Fixed values. Words of sign-in documentation.
AUTH_DOC_TERMS = (
    "oauth 2.0", "oauth2", "openid connect", "oidc", "authorization code flow", "authorization code grant", "implicit flow",
    "client credentials", "device code flow", "pkce", "redirect_uri", "client_id", "client_secret", "access token",
    "refresh token", "id_token", "scopes", "saml assertion", "saml response", "jwks", "well-known/openid-configuration",
)

# Fixed values. Parts of hosts of analysis platforms.
RESEARCH_HOSTS = (
    "virustotal.com", "urlscan.io", "phishtank.", "phishtank.org", "any.run", "app.any.run", "hybrid-analysis.com", "tria.ge",
    "joesandbox.com", "abuse.ch", "openphish.com", "alienvault.com", "otx.alienvault.com", "misp-project.org",
    "threatcrowd.org", "shodan.io", "censys.io", "greynoise.io", "abuseipdb.com",
)

# Fixed values. Beginnings of documentation hosts.
DOC_HOST_PREFIXES = (
    "docs.", "developer.", "developers.", "learn.", "help.", "support.", "guide.", "guides.", "tutorial.", "tutorials.",
)

# Fixed values. Parts of documentation paths.
DOC_PATHS = (
    "/docs/", "/doc/", "/documentation/", "/developer/", "/developers/", "/learn/", "/tutorial", "/tutorials/", "/guide/",
    "/guides/", "/reference/", "/examples/", "/cookbook/", "/howto/",
)

# Fixed values. Roots whose pictures and icons betray a clone.
CLONE_BRANDS = (
    "paypal.com", "apple.com", "microsoft.com", "amazon.com", "facebook.com", "instagram.com", "github.com", "ionos.com",
    "1and1.com", "binance.com", "coinbase.com", "metamask.io", "chase.com", "wellsfargo.com", "bankofamerica.com",
    "hdfcbank.com", "icicibank.com",
)

# Fixed values. Shared infrastructure.
INFRA_HOSTS = (
    "googleapis.com", "gstatic.com", "googleusercontent.com", "fonts.googleapis.com", "fonts.gstatic.com", "cloudflare.com",
    "cloudflareinsights.com", "cdnjs.cloudflare.com", "jsdelivr.net", "unpkg.com", "bootstrapcdn.com", "jquery.com",
    "fontawesome.com", "amazonaws.com", "cloudfront.net", "akamaihd.net", "github.io", "githubusercontent.com", "vercel.app",
    "netlify.app", "google-analytics.com", "googletagmanager.com",
)

# Fixed values. Trusted content networks.
CDN_HOSTS = (
    "googleapis.com", "gstatic.com", "googleusercontent.com", "google.com", "cloudflare.com", "cloudflareinsights.com",
    "jsdelivr.net", "unpkg.com", "bootstrapcdn.com", "jquery.com", "fontawesome.com", "fonts.googleapis.com",
    "fonts.gstatic.com", "github.io", "githubusercontent.com", "vercel.app", "netlify.app", "amazonaws.com", "cloudfront.net",
    "akamaihd.net", "stripe.com", "stripe.network", "youtube.com", "ytimg.com",
)

# Fixed values. Tokens of placeholders.
PLACEHOLDER_TOKENS = (
    "your_", "<your", "example", "placeholder", "xxxxxxxx", "lorem", "ipsum", "abc123", "password123", "changeme", "demo_",
    "sample_", "fake_", "test_only", "dotenv", "process.env.",
)

# Fixed values. Roots by kind of provider.
SAFELIST = {
    "identity-provider": (
        "google.com", "accounts.google.com", "microsoft.com", "microsoftonline.com", "live.com", "office.com", "apple.com",
        "icloud.com", "okta.com", "auth0.com", "onelogin.com", "duosecurity.com", "pingidentity.com", "github.com", "gitlab.com",
        "bitbucket.org", "facebook.com", "linkedin.com",
    ),
    "banking": (
        "chase.com", "bankofamerica.com", "wellsfargo.com", "citi.com", "capitalone.com", "usbank.com", "americanexpress.com",
        "hsbc.com", "barclays.co.uk", "lloydsbank.com", "natwest.com", "santander.com", "bnpparibas.com", "deutschebank.com",
        "scotiabank.com", "td.com", "rbc.com", "sbi.co.in", "hdfcbank.com", "icicibank.com", "axisbank.com",
    ),
    "payments": (
        "paypal.com", "stripe.com", "wise.com", "revolut.com", "venmo.com", "cashapp.com", "squareup.com",
    ),
    "password-manager": (
        "1password.com", "bitwarden.com", "lastpass.com", "dashlane.com", "keepersecurity.com", "nordpass.com",
    ),
    "saas": (
        "salesforce.com", "workday.com", "atlassian.com", "slack.com", "zoom.us", "dropbox.com", "box.com",
    ),
}
