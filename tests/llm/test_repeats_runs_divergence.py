"""Suffix-array dedup, periodic runs and the divergence audit against brute force, with hard cases in every table."""

import hashlib
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from threatloom.llm import divergence, queries, run_detection, suffix_dedup
from threatloom.llm.shared import documents

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def sha(data):
    return hashlib.sha256(data).hexdigest()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)] + ["é", "日本語", "a", "aa"]
    base = [" ".join(rng.choice(words) for _ in range(150)) for _ in range(6)]
    texts = []
    for _ in range(100):
        changed = rng.choice(base).split()
        for _ in range(rng.randrange(4)):
            changed[rng.randrange(len(changed))] = f"x{rng.randrange(1000)}"
        texts.append(" ".join(changed))
    texts += ["a" * 1000, "ab" * 300, "a" * 199, "b" * 200, None, "", " \t\n", "z" * 200, "abc" * 70 + "q" + "abc" * 80, "hello world " * 17]
    texts += rng.sample(texts, 10)
    texts.append(" ".join(rng.choice(words) for _ in range(3000)) + base[0] + " " + " ".join(rng.choice(words) for _ in range(3000)) + base[0])
    made = list(enumerate(texts))
    return [*made, (5, texts[5]), (6, "same id, other text"), (None, texts[3]), (None, "null " + base[1])]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return df.withColumns({"unit": F.lit("x"), "_group": F.lit(1), "h": F.lit(2), "n": F.lit(3), "runs": F.lit(None).cast("string")})


def without_repeats(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        yield len(t), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]][: len(gone)]).sum()), sha(kept)


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_suffix_dedup(docs, rows, monkeypatch, block):
    """Also with many blocks and buckets, where every verdict needs other tasks."""
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    monkeypatch.setattr(suffix_dedup, "ROW", 1)
    got = suffix_dedup.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256))
    want = without_repeats([(t or "").encode() for _, t in rows], 200)
    assert Counter(map(tuple, got.collect())) == Counter((i, *w) for (i, _), w in zip(rows, want))


def test_suffix_dedup_of_other_lengths_and_empty_tables(docs, rows):
    got = suffix_dedup.remove_repeats(docs.where("doc_id < 40"), 33)
    want = without_repeats([t.encode() for i, t in rows if i is not None and i < 40], 33)
    assert Counter((r["n_bytes"], r["n_removed"], len(r["spans"]), sha(bytes(r["kept"]))) for r in got.collect()) == Counter(want)
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_suffix_dedup_in_pieces(monkeypatch):
    """Pieces of a long text hold each of its windows once, and name them alike."""
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    rng = np.random.default_rng(1)
    text = bytes(rng.integers(97, 123, 5403, dtype=np.uint8)).decode()
    found = {}
    for _, at, data, offsets in suffix_dedup.pieces(pa.array([text]), 200):
        for start, number, name in zip(*suffix_dedup.stretches(data, offsets, 200)):
            for i in range(at + start, at + start + number):
                assert found.setdefault(i, name) is name
    whole = np.frombuffer(text.encode(), np.uint8)
    want = {i: name for start, number, name in zip(*suffix_dedup.stretches(whole, np.array([0, len(whole)]), 200)) for i in range(start, start + number)}
    assert found == want and sorted(found) == list(range(5403 - 199))


def test_a_passage_in_all_texts_goes(spark, monkeypatch):
    """Whatever surrounds it, and with blocks of which each knows a few of its surroundings."""
    monkeypatch.setattr(suffix_dedup, "BLOCK", 60)
    passage = " ".join(f"p{i}" for i in range(100))
    texts = [hashlib.sha512(str(i).encode()).hexdigest() * 2 + passage + hashlib.md5(str(i).encode()).hexdigest() for i in range(150)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5))
    want = without_repeats([t.encode() for t in texts], 200)
    assert Counter((r["n_bytes"], r["n_removed"], len(r["spans"]), sha(bytes(r["kept"]))) for r in got.collect()) == Counter(want)


def plain_runs(words):
    out = []
    for p in range(1, len(words) // 4 + 1):
        i = 0
        while i + p < len(words):
            e = i
            while e + p < len(words) and words[e] == words[e + p]:
                e += 1
            size = e - i + p
            if size >= max(6, 4 * p) and not any(words[i + q : i + size] == words[i : i + size - q] for q in range(1, p)):
                out.append((i, size, p))
            i = max(e, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_lyndon_prefixes_and_runs():
    rng = random.Random(1)
    for _ in range(1500):
        k, n = rng.choice([1, 2, 3, 10]), rng.randrange(1, 60)
        words = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(n)
            words[at:at] = [rng.randrange(k) for _ in range(rng.randrange(1, 6))] * rng.randrange(3, 8)
        prefixes = []
        for i in range(len(words)):
            j, m = i + 1, i
            while j < len(words) and words[m] <= words[j]:
                m = m + 1 if words[m] == words[j] else i
                j += 1
            prefixes.append(j - m)
        assert run_detection.lyndon_lengths(np.array(words)).tolist() == prefixes
        assert run_detection.runs(np.array(words)) == plain_runs(words)
    assert run_detection.runs(np.array([], np.int64)) == []


def test_runs_of_a_long_text():
    words = np.tile(np.random.default_rng(2).integers(0, 900, 5000), 9)
    assert run_detection.runs(words) == [(0, 45000, 5000)]


def report_of(doc_id, words):
    found = plain_runs(words)
    gone = {i for a, size, p in found for i in range(a + p, a + size)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    lines = "".join(f"{a},{size},{p}\n" for a, size, p in found)
    own = (best[0], best[1], best[2], best[1] * 1000 // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *own, sha(lines.encode()), sha(" ".join(w for i, w in enumerate(words) if i not in gone).encode()), len(words))


def test_run_report(spark, docs, rows):
    more = [(900, "x y z " * 30 + "q " + "a a a a a a a b"), (901, "na " * 5), (902, "na " * 6), (902, "na " * 6)]
    df = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    want = Counter(report_of(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in [*rows, *more])
    assert Counter(map(tuple, run_detection.run_report(df).collect())) == want
    assert run_detection.run_report(docs.limit(0)).count() == 0


def test_run_query(spark):
    want = []
    for r in documents(spark, SF).select("doc_id", "text").collect():
        words, h = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""), zlib.crc32(str(r["doc_id"]).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        numbers = {}
        own = [numbers.setdefault(w, len(numbers)) for w in words]
        found = plain_runs(own) if len(words) < 400 else run_detection.runs(np.array(own))
        want.append((r["doc_id"], len(found), sha("".join(f"{a},{size},{p}\n" for a, size, p in found).encode()), len(words)))
    got = queries.op12_run_detection(spark, SF).select("doc_id", "n_runs", "runs_sha256", "n_words")
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_multikey_sort(monkeypatch):
    monkeypatch.setattr(divergence, "SMALL", 100)
    rng = random.Random(3)
    words = [b"".join(rng.choice([b"a", b"b", b"prefix", b"\xc3\xa9"]) for _ in range(rng.randrange(1, 7))) for _ in range(3000)]
    data = np.frombuffer(b"".join(words), np.uint8)
    sizes = np.array([len(w) for w in words])
    order, fresh = divergence.multikey_sort(data, np.cumsum(sizes) - sizes, sizes)
    assert order.tolist() == sorted(range(len(words)), key=lambda i: (words[i], i))
    assert fresh.tolist() == [k == 0 or words[order[k]] != words[order[k - 1]] for k in range(len(words))]


def plain_audit(rows):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))) for lang, source, text in rows]
    seen, counts = Counter(), defaultdict(Counter)
    for lang, source, words in docs:
        seen.update({(lang, w) for w in words})
        counts[lang, source].update(words)
    out = []
    for lang in {d[0] for d in docs}:
        kept = [w for (of, w), n in seen.items() if of == lang and n >= 3]
        own = {s: c for (of, s), c in counts.items() if of == lang}

        def shares(count):
            of = sum(count[w] for w in kept) + len(kept)
            return {w: 1 + 10**9 * (count[w] + 1) // of for w in kept}

        q = shares(sum(own.values(), Counter()))
        p = {s: shares(c) for s, c in own.items()}
        for s in own:
            pairs = [(o, sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept)) for o in own if o != s]
            terms = [(w, (p[s][w] - q[w]) ** 2 // q[w]) for w in kept if own[s][w] and p[s][w] > q[w]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda r: (-r[1], r[0].encode()))
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(found[: 200 if part == "term" else None], 1)]
    return Counter(out)


def test_audit(spark, monkeypatch):
    rng = random.Random(8)
    words = ["Alpha", "alpha", "beta", "été", "ÉTÉ", "日本", "x1y", "o'clock", "longer-than-eight", "longerthaneight", "longerthaneights", *(f"{a}{b}" for a in "qrstuv" for b in "abcdefgh")]
    rows = []
    for k in range(200):
        text = " ".join(rng.choice(words[: 10 + 9 * (k % 5)]) for _ in range(rng.randrange(40)))
        rows.append((rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "s10", "é", None]), text))
    rows += [("fr", "s1", "only two documents"), ("fr", "s2", "only two documents"), ("it", "s1", None), ("en", "empty", ""), ("en", "empty", None), ("es", "s1", "uno uno uno"), ("es", "s1", "uno dos"), ("es", "s2", "uno"), rows[0], rows[0], ("en", "s1", "word " * 5000)]
    df = spark.createDataFrame([(i % 50, *r) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string").repartition(3)
    df = df.withColumns({"term": F.lit("x"), "n": F.lit(0), "p": F.lit(1), "words": F.lit("y"), "item": F.lit(None).cast("string")})
    assert Counter(map(tuple, divergence.audit(df).collect())) == plain_audit(rows)
    assert divergence.audit(df.limit(0)).count() == 0


def test_audit_with_one_source_in_large_parts(spark):
    rows = [("en", "hot" if i % 3 else f"s{i % 7}", f"common words {i % 11} and w{'abcdefghij'[i % 10]} more common") for i in range(300)]
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(8)
    assert Counter(map(tuple, divergence.audit(df).collect())) == plain_audit(rows)
