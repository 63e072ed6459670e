"""Findings by windows against a plain scan of whole texts: every pattern, every separator, and what surrounds a match."""

import random
import string
import unicodedata

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from threatloom.operators import dlp
from threatloom.plans import inputs as I
from threatloom.plans import queries_text

GAPS = ["", " ", "-", "  ", " - ", "--", "\t", "\n", "   "]
AROUND = ["", " ", ".", ",", ";", "(", ")", '"', "'", "_", "-", "=", "/", "x", "7", "é", "\n", ". ", ", ", ": ", "“", "|", "…", "=\""]
WORDS = "the card bank swift backup code storage azure aws secret wire sample test example curl docs import export reference of a in to letter number please send again today".split()


def sample(rng):
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    gap, digits, upper, token = rng.choice(GAPS), string.digits, string.ascii_uppercase, string.ascii_letters + string.digits
    card = rng.choice(["5500000000000004", "4012888888881881", "378282246310005", "4242424242424242", pick(digits, rng.randrange(9, 21))])
    spread = lambda s, every: gap.join(s[i : i + every] for i in range(0, len(s), every))
    return rng.choice([
        lambda: spread(card, rng.choice([1, 4])), lambda: "".join(d + rng.choice(["", " ", "  ", "-"]) for d in card), lambda: spread(pick("23456789", 1) + pick(digits, 11), 4),
        lambda: f"{pick(digits, 3)}-{pick(digits, 2)}-{pick(digits, 4)}", lambda: "219-09-9999", lambda: "DE89370400440532013000", lambda: pick(upper, 2) + pick(digits, 2) + pick(upper + digits, rng.randrange(8, 32)),
        lambda: pick(upper, 5) + pick(digits, 4) + pick(upper, 1), lambda: pick(upper, 6) + pick(upper + digits, rng.choice([2, 5])), lambda: "-".join(pick(upper + digits, 4) for _ in range(rng.choice([3, 4]))),
        lambda: rng.choice(["AKIA", "ASIA"]) + pick(upper + digits, rng.choice([15, 16, 17])), lambda: "AIza" + pick(token + "-_", 35), lambda: pick(token + "/+=", rng.choice([32, 39, 40, 41, 60])),
        lambda: f'"type"{rng.choice(["", " ", chr(10)])}:{gap if not gap.strip("- ") else ""}"service_account"', lambda: rng.choice(["sv", "sig"]) + "=" + pick(token + "%", 24), lambda: "ghp_" + pick(token, 36), lambda: "github_pat_" + pick(token + "_", 61),
        lambda: "glpat-" + pick(token, 22), lambda: f"xox{pick('abprsz', 1)}-" + pick(token + "-", 12), lambda: f"{rng.choice(['sk', 'rk'])}_{rng.choice(['live', 'test'])}_" + pick(token, 24), lambda: "sk-" + rng.choice(["", "proj-", "ant-"]) + pick(token + "_-", 33),
        lambda: f"-----BEGIN {rng.choice(['', 'RSA ', 'EC ', 'OPENSSH '])}PRIVATE KEY-----", lambda: "ssh-rsa " + pick(token + "+/", 44), lambda: ".".join(("eyJ" + pick(token + "-_", 9), pick(token, 9), pick(token, 12))),
        lambda: rng.choice([" ", "  ", "\n"]).join(pick(string.ascii_lowercase, rng.randrange(3, 9)) for _ in range(rng.choice([11, 12, 13, 24, 30]))),
    ])()


def text(rng):
    parts = []
    for _ in range(rng.randrange(1, 8)):
        parts += rng.choices(WORDS, k=rng.randrange(0, 30))
        parts[-1:] = ["".join([*parts[-1:], rng.choice(AROUND), sample(rng), rng.choice(AROUND)])]
    out = "".join(p + rng.choice([" ", " ", " ", ", ", ". ", "\n"]) for p in parts)
    form = rng.random()
    if form < 0.08:
        out = out.translate({ord("0") + i: 0xFF10 + i for i in range(10)})  # wide digits
    elif form < 0.16:
        out = unicodedata.normalize("NFD", out + " é ü") + rng.choice(["ﬁ", "①", " ", "x²", "日本"])
    return out


def plain(found):
    return [{**f, "confidence": round(f["confidence"], 6)} for f in found]


def test_windows_equal_the_plain_scan(spark):
    rng = random.Random(11)
    texts = [text(rng) for _ in range(1000)]
    texts += ["4  0  1  2  8 8 8 8  8 8 8 8  1 8 8 1", "", None, " ", "card " + " ".join(["4012888888881881"] * 40), ", ".join(["ghp_" + "aB3" * 12] * 60), "x" * 200_001, "a" * 199_990 + " 4012888888881881", "token " * 3 + "Zq9" * 14 + " and again " + "Zq9" * 14, "été 4012888888881881 naïve"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string").repartition(4)
    got = {r["i"]: plain(f.asDict() for f in r["f"]) for r in rows.withColumn("f", dlp.sensitive_findings("text")).collect()}
    kinds = set()
    for i, t in enumerate(texts):
        want = plain(dlp.sensitive(t))
        assert got[i] == want, (t[:300], [f for f in want if f not in got[i]], [f for f in got[i] if f not in want])
        kinds |= {f["id"] for f in want}
    assert kinds == {s[0] for s in dlp.SENSITIVE} | {"entropy_blob"}


def test_few_characters_leave_the_jvm(spark):
    rows = I.derived(spark, SF.replace("sf0.001", "sf0.01"), I.TEXTS)
    sent = F.when(dlp.may_change(F.col("text")), F.length("text")).otherwise(F.aggregate(dlp.candidate_windows(F.col("text")), F.lit(0), lambda a, w: a + F.length(w)))
    whole, part = rows.agg(F.sum(F.length("text")), F.sum(sent)).first()
    assert part < 0.2 * whole


def test_every_pattern_may_stay_in_a_phrase(spark):
    """The shortest match of each kind isn't cut and is worth a look, whatever is around it."""
    rng = random.Random(12)
    import re

    worth, cut = re.compile(dlp._WORTH), re.compile(dlp._CUT)
    for _ in range(20_000):
        for _, _, _, pattern, _ in dlp._COMPILED:
            if m := pattern.search(s := sample(rng)):
                assert worth.search(m[0]) and not cut.search(m[0]), (pattern.pattern, s)


def test_queries_of_findings(spark):
    found = {r["doc_id"]: dlp.sensitive(r["text"]) for r in queries_text.texts(spark, SF).collect()}
    got = sorted((r["doc_id"], r["at"], r["finding_id"]) for r in queries_text.d1(spark, SF).collect())
    assert got == sorted((k, f["offset"], f["id"]) for k, own in found.items() for f in own) and got


#: Texts around the stop rule, with white space and letters on which engines differ.
ODD = (
    " ".join(f"user{i}@example.org" for i in range(60)) + " ssn 219-09-9999 and 219-09-9998 " + I.SAMPLE_KEY,
    " ".join(f"user{i}@example.org" for i in range(49)) + " 219-09-9999 219-09-9998 219-09-9997 ABCDE1234F ABCDE1235F",
    " ".join(f"212-555-{i:04d}" for i in range(70)),
    "a\x0b212\x0b555\x0b0147 x 1234\x0b5678\x0b9012 token\x0bABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "to\u212aen: ABCDEFGHIJKLMNOPQRSTUVWXYZ \u017fecret=ABCDEFGHIJKLMNOPQRSTUVWXYZ u\u017f@ex.com u@e\u017f.org",
)


@pytest.mark.parametrize("name", ["d11_pii_region_scan", "d13_dedupe_findings", "d17_dlp_file_report"])
def test_scan_equals_its_sql_beyond_50_matches(spark, tmp_path, name):
    import duckdb

    import __spark_entry__ as entry

    rows = [(16 * i + 15, t, "en", "s", len(t)) for i, t in enumerate(ODD)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = entry.queries()[name](spark, str(tmp_path))
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


#: Addresses that begin with a point or sign right after the match before.
JOINED = (
    "a1@ex.com+bc2@ex.org.de3@ex.net-fg4@ex.com%hi5@ex.org end",
    "bc@ex.com bcd@ex.com+bcd@ex.com",
    "one@ex.com.two@ex.com, .three@ex.com, x.four@ex.com and five@ex.com..six@ex.com",
)


def _joined(spark, tmp_path, name):
    import duckdb

    import __spark_entry__ as entry

    rows = [(16 * i + 15, t, "en", "s", len(t)) for i, t in enumerate(JOINED)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = entry.queries()[name](spark, str(tmp_path))
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_joined_addresses_are_counted_as_in_the_sql(spark, tmp_path):
    _joined(spark, tmp_path, "d13_dedupe_findings")


def test_joined_addresses_make_the_same_report_as_the_sql(spark, tmp_path):
    _joined(spark, tmp_path, "d17_dlp_file_report")


def test_repeated_lines_make_the_same_report_as_the_sql(spark, tmp_path):
    """Lines that stand in a text more than 50 times stop the scan: what later patterns and the end of the text add is cut to
    one a pattern, in the SQL too. Keys of every ending."""
    import duckdb

    import __spark_entry__ as entry

    lines = ["write to ana.31@mail6.example.com today", "call +1 (202) 555-2281 or +1 (203) 555-0762", "pay by 4012888888881881!!", "token = \"" + "9dd3c800" * 5 + "\""]
    texts = ["\n".join((lines[k:] + lines[:k])[:width] * times) for k in range(4) for width in (1, 2, 4) for times in (1, 49, 50, 51, 60)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(t for t in texts for _ in range(16))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    report = entry.queries()["d17_dlp_file_report"](spark, str(tmp_path))
    want = con.sql(f"SELECT {', '.join(report.columns)} FROM ({entry.oracle_sql()['d17_dlp_file_report']})").fetchall()
    got = report.collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    # the ending of key 9 has an address and a number: the address is the 51st match, or the 52nd and cut
    of = {r["doc_id"]: r["n_findings"] for r in got}
    assert [of[16 * texts.index("\n".join(lines[:1] * times)) + 9] for times in (50, 51)] == [3, 2]


def test_boundaries_before_a_class_with_signs_stay_whole():
    import re

    text = "+".join(f"a{i}@ex.com" for i in range(3))
    assert re.findall(dlp.bounded(dlp.PII[0][3]), text, re.A) == ["a0@ex.com", "+a1@ex.com", "+a2@ex.com"]


def test_texts_are_cut_where_they_were(spark):
    """The class of cuts takes all characters but those that a match may hold."""
    import re

    kept, cut = re.compile(r"[A-Za-z0-9_/+=%:.\"\s-]", re.A), re.compile(dlp._CUT)
    odd = [chr(i) for i in [*range(0x3000), 0xFFFD, 0x1F600, 0x10FFFF]]
    assert all(bool(cut.fullmatch(c)) == (not kept.fullmatch(c)) for c in odd if c != ".")
    rows = spark.createDataFrame([(f"ab{c}cd",) for c in odd if c not in "\0."], "text string")
    assert rows.where(F.size(F.split("text", f"(?:{dlp._CUT})++", -1)) == 1).count() == sum(bool(kept.fullmatch(c)) for c in odd if c not in "\0.")


def test_entropy_of_whole_texts(spark):
    import math
    from collections import Counter

    texts = ["", "a", "aaaa", "ab" * 500, "Grüße 日本 😀 \u0085" * 40, "".join(map(chr, range(0x20, 0x2000)))]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, text string")
    got = dict(rows.select("i", dlp.text_entropy("text")).collect())
    for i, t in enumerate(texts):
        want = -sum(n / len(t) * math.log2(n / len(t)) for n in Counter(t).values())
        assert abs(got[i] - want) < 1e-9
    assert got[len(texts)] == 0
    assert "replace(" not in queries_text.d3(spark, SF)._jdf.queryExecution().optimizedPlan().toString()  # no pass a character


def test_batches_are_tried_by_patterns_that_miss_nothing(spark):
    """A text goes to a pattern if that may match, by Arrow's matcher; the scan by windows finds the same."""
    import pyarrow as pa

    rng = random.Random(13)
    texts = [unicodedata.normalize("NFKC", text(rng)) for _ in range(2000)] + ['"type"\x0b: "service_account"', "1234\x0b5678\x0b9012", " ".join(["abcde\x0bfgh"] * 8), "a", ""]
    may = dlp.matched(pa.array([*texts, None]), dlp._LOOSE)
    assert may[-1] == 0
    for t, bits in zip(texts, may.tolist()):
        want = {i for i, (_, _, _, pattern, _) in enumerate(dlp._COMPILED) if pattern.search(t)} | ({len(dlp._COMPILED)} if dlp._TOKEN.search(t) else set())
        assert want <= {i for i in range(len(dlp._LOOSE)) if bits >> i & 1}, t
    rows = spark.createDataFrame(list(enumerate(texts[:300])), "i long, text string").repartition(4)
    for r in rows.select("text", dlp.sensitive_findings("text").alias("a"), dlp.window_findings("text").alias("b")).collect():
        assert r["a"] == r["b"], r["text"]


def test_texts_without_findings_cost_no_pass_a_pattern(spark):
    plan = queries_text.d9(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "rlike" not in plan.lower() and "split(" not in plan


def test_patterns_of_the_simple_scan_are_tried_where_they_may_match(spark):
    import re

    import pyarrow as pa

    rng = random.Random(14)
    texts = [text(rng) + rng.choice(["", " u@ex.com", " +1 212-555-0147", " 9876543210", " api_key='" + "aB3_" * 7, " token\x0b=\x0b" + "Zq9" * 9]) for _ in range(2000)] + list(ODD)
    may = dlp.matched(pa.array(texts), dlp._PII_LOOSE)
    patterns = [re.compile(dlp.bounded(p), re.A) for *_, p in dlp.PII] + [re.compile("[A-Za-z0-9+/_=-]{24}")]
    seen = set()
    for t, bits in zip(texts, may.tolist()):
        want = {i for i, p in enumerate(patterns) if p.search(t)}
        assert want <= {i for i in range(len(patterns)) if bits >> i & 1}, t
        seen |= want
    assert len(seen) == len(patterns)
    # no pass a pattern over texts: patterns stand behind what was found in the batch
    assert "rlike" not in dlp.scan_text(rows := queries_text.texts(spark, SF))._jdf.queryExecution().optimizedPlan().toString().lower() and rows.count()


def test_phrases_of_pages_are_tried_where_they_may_stand(spark):
    from threatloom.operators import pages

    texts = ["Press the Windows key and\x0br", "hold windows key then r", "ctrl + v and then enter", "verify you are\x0bhuman", "I'm not a robot", "a CAPTCHA", "open the\trun dialog", "⌘ + space", "⊞", "plain words", "", None]
    rows = spark.createDataFrame([([], t) for t in texts], "code array<string>, plain string")
    got = [(r["run_phrase"], r["fake_verify"]) for r in pages.clickfix(rows, "code", "plain").select("run_phrase", "fake_verify").collect()]
    want = [tuple(r) for r in rows.select(pages._count(F.col("plain"), pages.RUN_PHRASES) > 0, pages._count(F.col("plain"), pages.VERIFY_PHRASES) > 0).collect()]
    assert got == want and (True, False) in got and (False, True) in got and got[-1] == (None, None)
    plan = queries_text.p13(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "phrase_hints" in plan


def test_whole_texts_have_no_limits(spark, tmp_path):
    """A secret behind 200 000 characters, each of many matches of a pattern and each of many long tokens count: in d1, in d9 and
    d10 and submissions, which share the scan, and in the scan by windows."""
    import re

    rng = random.Random(15)
    pick = lambda n: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n))
    keys = ["ghp_" + pick(36) for _ in range(60)]
    tokens = [pick(50) for _ in range(90)]
    nested = [tokens[0] + tokens[1], tokens[1], tokens[2][:40] + "=", tokens[2], tokens[2][:40] + "="]
    texts = ["plain words " * 20_000 + keys[0], " , ".join(keys), " ; ".join(tokens), "été " + " ; ".join([*nested, *tokens]), "", ", ".join(["test card 4012888888881881"] * 70)]
    spark.createDataFrame([(16 * i + 15, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {i: [] for i in range(len(texts))}
    for r in queries_text.d1(spark, str(tmp_path)).collect():
        got[r["doc_id"] // 16].append((r["finding_id"], r["at"]))
    at = lambda i, own: {texts[i].index(x) for x in own}
    assert ("github_classic", texts[0].index(keys[0])) in got[0]
    assert {a for k, a in got[1] if k == "github_classic"} == at(1, keys) and len(at(1, keys)) == 60
    assert {a for k, a in got[2] if k == "entropy_blob"} == at(2, tokens) and len(got[2]) >= 90
    # a token that stands inside a longer one before it is where that is
    long = dict.fromkeys(re.findall("[A-Za-z0-9+/_=-]{32,}", texts[3]))
    assert {a for k, a in got[3] if k == "entropy_blob"} == at(3, [t for t in long if dlp.bits(t) >= 4.5])
    assert got[4] == [] and sum(k == "credit_card" for k, _ in got[5]) == 70
    want = [dlp.sensitive(t, whole=True) for t in texts]
    assert all(sorted((f["id"], f["offset"]) for f in own) == sorted(got[i]) for i, own in enumerate(want))
    assert sum(r["n"] for r in queries_text.d9(spark, str(tmp_path)).collect()) == sum(f["suppressed"] for own in want for f in own) >= 70
    assert [r["risk_level"] for r in queries_text.d10(spark, str(tmp_path)).orderBy("doc_id").collect()][:2] == ["critical", "critical"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string").select("i", dlp.window_findings("text", whole=True).alias("f"))
    assert {r["i"]: plain(f.asDict() for f in r["f"]) for r in rows.collect()} == dict(enumerate(map(plain, want)))
    fields = spark.createDataFrame([(1, i, "text", " , ".join(keys[i : i + 10])) for i in range(0, 60, 10)], "submit_id long, place long, field_type string, value string")
    submits = spark.createDataFrame([(1, "https://a.example/", "https://b.example/in")], "submit_id long, page_url string, action string")
    assert dlp.submissions(fields, submits).first()["n_findings"] == 60
    # within the limits nothing differs
    assert all(dlp.sensitive(t) == dlp.sensitive(t, whole=True) for t in (text(rng) for _ in range(500)))
