"""Operators against brute force, round trips and held-out labels, with hard cases in every table: nulls,
empty and long texts, repeated rows and ids, extra columns, empty tables."""

import base64
import hashlib
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.conftest import SF
from threatloom.llm import decontaminate, katz, license_scan, mixing, mpeg_audio, quality_mil, simhash, substring_dedup, textops, token_files, warc_index

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SHARED = " ".join(f"w{i}" for i in range(60))
LONG = " ".join(f"t{i % 997} v{i}" for i in range(6000))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "A first text, about nothing much at all."), (2, None), (3, ""), (4, "  \t\n "), (5, SHARED + " end of five"), (6, "start of six " + SHARED), (7, "A first text, about nothing much at all."), (8, LONG), (9, "été naïve “quotes” 日本語 x"), (9, "same id, other text"), (10, SHARED), (10, SHARED), (None, SHARED + " null id"), (11, "one"), (12, "two words")]
    real = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60").select((F.col("doc_id") + 100).alias("doc_id"), "text")
    made = spark.createDataFrame(rows, "doc_id long, text string").unionByName(real)
    return made.withColumns({"source": F.when(F.col("doc_id") % 3 == 0, None).otherwise(F.concat(F.lit("s"), F.col("doc_id") % 4)), "_size": F.lit(1), "fp": F.lit("x"), "_doc": F.lit(0), "n": F.lit(2), "lang": F.lit(None).cast("string")})


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"] or "", r["source"]) for r in docs.select("doc_id", "text", "source").collect()]


def empty(docs):
    return docs.limit(0)


def test_word_hashes_agree_with_words():
    import pyarrow as pa

    texts = ["a b  a\tc", None, "", "ÄB é", "x" * 5000 + " a"]
    seen = {}
    for _, data, offsets in textops.slices(pa.array(texts), limit=8):
        words = textops.Words(data, offsets)
        for text, a, b in zip([bytes(data[i:j]) for i, j in zip(offsets, offsets[1:])], words.first, words.first[1:]):
            assert int(b - a) == len(text.split())
            for w, h in zip(text.split(), words.hashes()[a:b]):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_token_files(spark, docs, rows):
    got = token_files.token_table(docs).collect()
    enc = token_files.Encoder(token_files.default_tokenizer())
    want, start = [], 0
    for doc_id, text in sorted(((d, t) for d, t, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = [*enc.tokenizer.encode(text, add_special_tokens=False).ids, 0]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_files.token_table(empty(docs)).count() == 0


@pytest.mark.parametrize("text", ["", " ", "a  b", "don't we'll", "1 2 33a", "a\nb \nc", "a　b", "<|endoftext|> hi", "x 's y", "a b", "日本 語"])
def test_pieces_equal_whole_texts(text):
    enc = token_files.encoder(token_files.default_tokenizer())
    assert enc.encode(text) == enc._pack(enc.tokenizer.encode(text, add_special_tokens=False).ids)


def test_warc(spark):
    pages = [(1, "http://b.example.com/x", "same"), (2, "https://a.example.com/", "same"), (3, None, None), (4, "not a url", ""), (5, "http://b.example.com/x", "ünï" * 5000), (None, "http://c.example.com", "same"), (6, "http://b.example.com/x", "same")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"_sha": F.lit("x"), "archive": F.lit(1)})
    stamp = F.concat(F.lit("2024010100000"), F.coalesce(F.col("page_id"), F.lit(0)))
    got = {r["page_id"]: r for r in warc_index.archive_table(df, stamp).collect()}
    assert len(got) == 7
    assert [(got[i]["record_type"], got[i]["refers_to"]) for i in (1, 2, 6, None, 3, 4, 5)] == [("response", None), ("revisit", 1), ("revisit", 1), ("revisit", 1), ("response", None), ("revisit", 3), ("response", None)]
    for i, _, html in pages:
        data = (html or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(data), warc_index.base32_sha1(data))
    order = sorted(got.values(), key=lambda r: r["history_rank"])
    assert [r["url_key"] for r in order] == sorted(r["url_key"] for r in order)
    assert warc_index.archive_table(df.limit(0), stamp).count() == 0


def test_loser_tree():
    rng = np.random.default_rng(1)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(((str(x).encode(), b"0", int(x)), b"") for x in rng.integers(0, 50, rng.integers(0, 9))) for _ in range(k)]
        assert [h for h, _ in warc_index.LoserTree(iter(r) for r in runs)] == sorted(h for r in runs for h, _ in r)


def test_groups_of_runs_and_cuts_inside_a_hot_url(spark, monkeypatch):
    monkeypatch.setattr(warc_index, "FAN_IN", 3)
    monkeypatch.setattr(warc_index, "RANGE", 50)
    monkeypatch.setattr(warc_index, "STRIDE", 4)
    pages = [(i, "http://hot.example.com/" if i % 3 else f"http://h{i % 7}.example.com/{i % 5}", f"page {i % 40}") for i in range(400)]
    df = spark.createDataFrame([*pages, (5, "http://hot.example.com/", "page 5")], "page_id long, url string, html string").repartition(10)
    stamp = F.concat(F.lit("2024010100000"), F.col("page_id") % 10)
    got = warc_index.archive_table(df, stamp).collect()
    assert sorted(r["history_rank"] for r in got) == list(range(401))
    keys = [(r["url_key"], r["page_id"] % 10, r["page_id"]) for r in sorted(got, key=lambda r: r["history_rank"])]
    assert keys == sorted(keys)
    first = {f"page {k}": k for k in range(40)}
    want = Counter((i, hashlib.sha1(h.encode()).digest(), None if i == first[h] else first[h]) for i, _, h in [*pages, (5, "", "page 5")])
    assert Counter((r["page_id"], base64.b32decode(r["payload_digest"]), r["refers_to"]) for r in got) == want


def shingles(text, width=5):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def test_decontaminate(spark, docs, rows):
    items = spark.createDataFrame([(1, SHARED), (2, "too short"), (3, None), (4, "v10 t11 v11 t12 v12 t13 v13 t14 v14 t15"), (5, SHARED.upper().replace(" ", ", "))], "item_id long, text string")
    got = Counter((r["doc_id"], r["item_id"], r["shared"]) for r in decontaminate.leaks(docs, items).collect())
    want = Counter()
    for doc_id, text, _ in rows:
        for item in items.collect():
            q = shingles(item["text"] or "")
            n = len(q & shingles(text))
            if q and n >= 0.8 * len(q):
                want[doc_id, item["item_id"], n] += 1
    assert got == want and want
    kept = decontaminate.decontaminate(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(rows) - len({(d, t) for d, t, _ in rows if any(shingles(i["text"] or "") and len(shingles(i["text"] or "") & shingles(t)) >= 0.8 * len(shingles(i["text"] or "")) for i in items.collect())}) - 1  # document 10 stands twice
    assert decontaminate.leaks(docs, items.limit(0)).count() == 0 and decontaminate.leaks(empty(docs), items).count() == 0


@pytest.mark.parametrize("block", [2_000_000, 20])
def test_short_items_in_long_texts_and_blocks_of_items(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    rng = np.random.default_rng(2)
    items, texts = {}, {}
    for i in range(60):
        items[i] = [f"q{x}" for x in rng.integers(0, 300, int(rng.integers(3, 40)))]
        filler = [f"f{x}" for x in rng.integers(0, 900, 1500)]
        at, own = int(rng.integers(0, 1500)), list(items[i])
        if i % 3 == 0 and len(own) > 5:
            own[int(rng.integers(0, len(own)))] = "changed"
        texts[i] = " ".join(filler[:at] + own + filler[at:])
    df = lambda rows, name: spark.createDataFrame([(k, " ".join(v) if isinstance(v, list) else v) for k, v in rows.items()], f"{name} long, text string")
    want = set()
    texts[60] = "so " + " ".join(next(v for v in items.values() if len(v) < 5)) + " it is"
    for i, item in items.items():
        width = min(5, len(item))  # an item of fewer words is one shingle
        q = shingles(" ".join(item), width)
        for d, text in texts.items():
            n = len(q & shingles(text, width))
            if n >= 0.8 * len(q):
                want.add((d, i, n))
    got = {(r["doc_id"], r["item_id"], r["shared"]) for r in decontaminate.leaks(df(texts, "doc_id"), df(items, "item_id")).collect()}
    assert {d for d, i, _ in got if len(items[i]) < 5} >= {60}
    clean = {r["doc_id"] for r in decontaminate.decontaminate(df(texts, "doc_id"), df(items, "item_id")).collect()}
    assert clean == set(texts) - {d for d, i, _ in got if len(items[i]) >= 5}
    assert len({i for _, i, _ in want}) > 40 and len(want - got) <= len(want) // 50 and not got - want
    assert {w for w in want if len(shingles(" ".join(items[w[1]]))) < 8} <= got


def fingerprint(text):
    words = WORD.findall(text.translate(LOWER))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_fingerprints(docs, rows):
    got = Counter((r["doc_id"], r["fp"] & (1 << 64) - 1) for r in simhash.fingerprints(docs).collect())
    assert got == Counter((d, fingerprint(t)) for d, t, _ in rows)


@pytest.mark.parametrize("bucket", [1, 64])
@pytest.mark.parametrize("bits", [1, 2])
def test_links_reach_what_pairs_reach(spark, monkeypatch, bucket, bits):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = np.random.default_rng(bits)
    values = {0}
    for _ in range(12):
        x = int(rng.integers(0, 1 << 63))
        for _ in range(6):
            values.add(x)
            for b in rng.integers(0, 64, int(rng.integers(1, 4))):
                x ^= 1 << int(b)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    nodes = spark.createDataFrame([(v, i) for i, v in enumerate(signed)], "fp long, node long")
    got = {r["node"]: r["component"] for r in simhash.components(simhash.links(nodes, bits)).collect()}
    root = list(range(len(values)))
    for _ in values:
        for i, a in enumerate(values):
            for j, b in enumerate(values):
                if (a ^ b).bit_count() <= bits:
                    root[i] = min(root[i], root[j])
    assert [got.get(i, i) for i in range(len(values))] == root


def test_report_equals_brute_force(docs, rows):
    prints = [(d, fingerprint(t)) for d, t, _ in rows]
    known = sorted({f for d, f in prints if d is not None})
    group = {f: min(d for d, g in prints if g == f and d is not None) for f in known}
    for _ in known:
        for a in known:
            for b in known:
                if (a ^ b).bit_count() <= 2:
                    group[a] = min(group[a], group[b])
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicate_report(docs).collect())
    assert got == Counter((d, f"{f:016x}", group.get(f)) for d, f in prints)


def test_keep_one(docs, rows):
    kept = simhash.keep_one(docs)
    ids = sorted(r["doc_id"] or -1 for r in kept.collect())
    assert kept.columns == docs.columns and 1 in ids and 7 not in ids and 3 not in ids and 4 not in ids and ids.count(10) <= 1
    assert simhash.keep_one(empty(docs)).count() == 0


def test_keep_one_decides_for_rows(spark):
    texts = [" ".join(f"{k}{i}" for i in range(40)) for k in "abcde"]
    given = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (1, texts[2]), (None, texts[2]), (2, texts[3]), (2, texts[4]), (2, texts[4]), (3, texts[4])]
    kept = simhash.keep_one(spark.createDataFrame(given, "doc_id long, text string"))
    assert Counter(tuple(r) for r in kept.collect()) == Counter([(None, texts[0]), (None, texts[1]), (1, texts[2]), (2, texts[3]), (2, texts[4])])


def plain_good_turing(counter):
    """Discounts by count, from the definition."""
    n = Counter(counter.values())
    for k in range(5, 0, -1):
        if all(n[r] for r in range(1, k + 2)):
            common = (k + 1) * n[k + 1] / n[1]
            d = {r: ((r + 1) * n[r + 1] / n[r] / r - common) / (1 - common) for r in range(1, k + 1)} if common < 1 else {}
            if d and all(0 < x < 1 for x in d.values()):
                return lambda c: d.get(c, 1.0) * c
    return lambda c: c - 0.5 if c <= 5 else c


class PlainKatz:
    def __init__(self, train):
        self.grams = [Counter(), Counter(), Counter()]
        for s in train:
            padded = [0, 1, *s]
            for i in range(2, len(padded)):
                for k in range(3):
                    self.grams[k][tuple(padded[i - k : i + 1])] += 1
        self.cut = [plain_good_turing(g) for g in self.grams]
        self.after = defaultdict(list)
        for g in self.grams[1:]:
            for gram in g:
                self.after[gram[:-1]].append(gram[-1])
        self.total = sum(self.grams[0].values())
        self.history = Counter()
        for g in self.grams[1:]:
            for gram, c in g.items():
                self.history[gram[:-1]] += c
        self.weights = {}

    def backoff(self, h):
        if h not in self.weights:
            if not self.history[h]:
                self.weights[h] = (1, 1.0)
            else:
                kept = sum(self.cut[len(h)](self.grams[len(h)][(*h, w)]) for w in self.after[h])
                n = self.history[h] + (self.history[h] - kept < 1e-9)
                self.weights[h] = n, (1 - kept / n) / (1 - sum(self.p(w, h[1:]) for w in self.after[h]))
        return self.weights[h]

    def p(self, w, h):
        c = self.grams[len(h)][(*h, w)]
        if not h:
            return self.cut[0](c) / self.total if c else 1 - sum(map(self.cut[0], self.grams[0].values())) / self.total
        n, alpha = self.backoff(h)
        return self.cut[len(h)](c) / n if c else alpha * self.p(w, h[1:])


def katz_rows(rows):
    got = defaultdict(list)
    for r in rows.collect():
        got[r["doc_id"]].append(r)
    return got


def test_katz(docs, rows, monkeypatch):
    monkeypatch.setattr(katz, "BLOCK", 500)
    monkeypatch.setattr(katz, "ROW", 1)
    got = katz_rows(katz.katz_scores(docs))
    seqs = [(d, WORD.findall(t.translate(LOWER)) + [None]) for d, t, _ in rows]
    learned = lambda d: zlib.crc32(("null" if d is None else str(d)).encode()) % 5 != 1
    plain = PlainKatz([s for d, s in seqs if learned(d)])
    words = [w for (w,) in plain.grams[0]]
    for length in (1, 2):
        for h in [h for h in plain.after if len(h) == length][:50]:
            assert sum(plain.p(w, h) for w in words) + plain.p("never seen", h) == pytest.approx(1)
    want = defaultdict(list)
    for d, s in seqs:
        padded = [0, 1, *s]
        score = sum(np.log10(plain.p(padded[i], tuple(padded[i - 2 : i]))) for i in range(2, len(padded)))
        base = sum(np.log10((plain.grams[0][(w,)] + 0.5) / (plain.total + 0.5 * (len(words) + 1))) for w in s)
        want[d].append((len(s), sum(plain.grams[0][(w,)] > 0 for w in s), base, score))
    for d in want:
        assert sorted((r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in got[d]) == [pytest.approx(x) for x in sorted(want[d])]
        assert {r["train_tokens"] for r in got[d]} == {plain.total}
    assert katz.katz_scores(empty(docs)).count() == 0
    # a kept model scores texts that it never saw as the joint run does
    train = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), F.lit(5)) != 1
    later = katz_rows(katz.score(docs.where(~train), katz.fit(docs.where(train))))
    assert later and all(sorted((x["n_known"], x["base_score"], x["score"]) for x in v) == [pytest.approx(x) for x in sorted((x["n_known"], x["base_score"], x["score"]) for x in got[d])] for d, v in later.items())
    assert katz.fit(empty(docs)) is None


@pytest.mark.parametrize("module", [katz, substring_dedup])
def test_exchanged_rows_grow_as_the_input(spark, monkeypatch, module):
    """Rows that blocks deal out, at two sizes of the input, the second eight times the first."""
    monkeypatch.setattr(module, "BLOCK", 100)
    monkeypatch.setattr(module, "ROW", 8)
    made = []
    for n in (40, 320):
        words = F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.concat(F.lit("word"), (F.col("id") * 131 + i * i) % 5003))
        docs = spark.range(n).select(F.col("id").alias("doc_id"), F.array_join(words, " ").alias("text")).repartition(4)
        if module is katz:
            found = katz._run(docs.withColumn("train", F.lit(True)).select("doc_id", "train", "text"))
            made.append(found[1][3].where("block IS NOT NULL").count())
        else:
            windows = docs.agg(F.sum(F.octet_length("text"))).first()[0] // 6
            block = substring_dedup.block_size(windows, module.BLOCK, module.ROW)
            rows = docs.select(F.xxhash64("doc_id", "text").alias("unit"), "doc_id", "text")
            made.append(substring_dedup.repeated_windows(rows, block, max(4, -(-windows // block))).count())
    assert made[1] < 16 * max(made[0], 10)


def test_mixing(docs, rows):
    got = mixing.mixing_report(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixing_report(docs).collect()))
    assert all(r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0) for r in got)
    by = defaultdict(lambda: [0, 0.0, 0, 0])
    source = {(d, len(WORD.findall(t))): s for d, t, s in rows}
    for r in got:
        one = by[source[r["doc_id"], r["size"]]]
        one[0] += r["taken"]
        one[1] = r["target"]
        one[2] = max(one[2], r["size"])
        one[3] += r["size"]
    for taken, target, largest, size in by.values():
        assert target <= 2 * size + 1e-9 and abs(taken - target) <= 2 * largest
    assert sum(x[1] for x in by.values()) == pytest.approx(1.5 * sum(x[3] for x in by.values()))
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    assert mixing.mixing_report(empty(docs)).count() == 0


def test_license_scan(spark):
    long = "x " * 20000 + "Released under the MIT License. and again under the mit LICENSE"
    texts = [(1, "Licensed under CC BY-NC 4.0."), (2, None), (3, ""), (4, long), (5, "Licensed under the Apache License, Version 2.0."), (6, "under the mit license under the mit license"), (7, "This work is licensed under the GNU General Public License, version 3."), (8, "mit license under the apache")]
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(texts, "doc_id long, text string").withColumn("labels", F.lit("x"))).collect()}
    assert [(got[i]["n_base"], got[i]["first_word"], got[i]["base_labels"]) for i in (1, 2, 4, 5, 6, 8)] == [(1, 2, "cc-by-nc"), (0, None, ""), (2, 20001, "mit"), (1, 3, "apache-2"), (2, 0, "mit"), (0, None, "")]
    assert got[7]["labels"] == "gpl-3" and got[4]["last_word"] == 20007 and got[3]["score"] == 0 and all(0 <= r["score"] <= 1 for r in got.values())


LICENCE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_license_scan_equals_brute_force(spark):
    """Every start of every template, in texts with passages that were changed in some words."""
    rng = np.random.default_rng(4)
    vocabulary = sorted({w for _, t, _ in license_scan.TEMPLATES for w in t.split()})
    texts = {0: None, 1: "", 2: "mit " * 30}
    for i in range(3, 120):
        words = [vocabulary[k] for k in rng.integers(0, len(vocabulary), int(rng.integers(0, 60)))]
        for _ in range(int(rng.integers(0, 3))):
            passages = [t for _, t, _ in license_scan.TEMPLATES] + [t for t, _ in license_scan.BASE]
            own = passages[int(rng.integers(0, len(passages)))].split()
            for _ in range(int(rng.integers(0, 1 + len(own) // 3))):
                own[int(rng.integers(0, len(own)))] = vocabulary[int(rng.integers(0, len(vocabulary)))]
            at = int(rng.integers(0, len(words) + 1))
            words[at:at] = own
        texts[i] = "".join(w.upper() + ", " if rng.random() < 0.2 else w + " " for w in words)
    texts[None] = texts[5]
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    hits = 0
    for i, text in texts.items():
        words = LICENCE_WORD.findall((text or "").translate(LOWER))
        found, based = [], []
        for label, passage, keys in license_scan.TEMPLATES:
            t = passage.split()
            must = set()
            for key in keys:
                k = key.split()
                place = next(p for p in range(len(t)) if t[p : p + len(k)] == k)
                must |= set(range(place, place + len(k)))
            for start in range(-len(t), len(words)):
                same = [0 <= start + p < len(words) and words[start + p] == t[p] for p in range(len(t))]
                if sum(same) >= 0.8 * len(t) - 1e-9 and all(same[p] for p in must):
                    found.append((label, start, len(t)))
        for phrase, label in license_scan.BASE:
            t = phrase.split()
            based += [(label, start) for start in range(len(words)) if words[start : start + len(t)] == t]
        r = got[i]
        assert sorted((p["label"], p["first_word"], p["n_words"]) for p in r["passages"]) == sorted(found)
        assert (r["n_words"], r["n_base"]) == (len(words), len(based))
        assert (r["first_word"], r["last_word"]) == ((min(s for _, s in based), max(s for _, s in based)) if based else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for x, _ in based})) and r["labels"] == ",".join(sorted({x for x, _ in based} | {x for x, _, _ in found}))
        hits += len(found)
    assert hits > 40 and len({x for x, _, _ in license_scan.TEMPLATES}) >= 40
    assert license_scan.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_attention_and_gradient_equal_plain_ones():
    rng = np.random.default_rng(6)
    bags = [rng.standard_normal((n, 7)) for n in (1, 4, 2)]
    labels, x, first = np.array([1.0, 0.0, 1.0]), np.concatenate(bags), np.array([0, 1, 5, 7])
    model = quality_mil.begin(x, 0.6, 3)
    p = model.weights
    sigmoid = lambda v: 1 / (1 + np.exp(-v))

    def loss():
        total = 0.0
        for bag, y in zip(bags, labels):
            h = [np.tanh((row - model.mean) / model.scale @ p["E"] + p["e"]) for row in bag]
            raw = np.array([np.dot(p["w"], np.tanh(v @ p["V"]) * sigmoid(v @ p["U"])) for v in h])
            a = np.exp(raw) / np.exp(raw).sum()
            score = sigmoid(sum(w * v for w, v in zip(a, h)) @ p["b"] + p["c"])
            total -= y * np.log(score) + (1 - y) * np.log(1 - score)
        return total / len(bags)

    scores = model.score(x, first)
    assert loss() == pytest.approx(-np.mean(labels * np.log(scores) + (1 - labels) * np.log(1 - scores)))
    for name, g in quality_mil.gradient(model, x, first, labels).items():
        for at in [tuple(rng.integers(0, n) for n in np.shape(p[name])) for _ in range(6)]:
            kept, both = p[name][at], []
            for step in (1e-5, -1e-5):
                p[name] = np.array(p[name])
                p[name][at] = kept + step
                both.append(loss())
            p[name][at] = kept
            assert (both[0] - both[1]) / 2e-5 == pytest.approx(np.asarray(g)[at], abs=1e-7)


def test_quality_sample_holds_one_row_of_an_id(spark):
    rows = [(1, "good words here")] * 50 + [(1, "other text of one")] * 50 + [(2, "BUY! BUY! " * 40), (3, "good words there"), (4, None), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (3, 0), (4, 0)], "doc_id long, quality int")
    got = quality_mil.quality_scores(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert quality_mil.quality_scores(empty(docs), labels).count() == 0


def test_quality(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = quality_mil.quality_scores(table, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50 and np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.93
    odd = quality_mil.quality_scores(docs, spark.createDataFrame([(1, 1), (5, None), (None, 0)], "doc_id long, quality int")).collect()
    assert len(odd) == docs.count() and len({r["score"] for r in odd}) == 1
    assert quality_mil.keep_good(empty(docs), labels).columns == docs.columns


def test_substring_dedup(docs, rows):
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.remove_repeats(docs).collect())
    key = lambda d: d if d is not None else 1 << 62
    first = {}
    cut = [(d, t.encode().split()) for d, t, _ in rows]
    for d, w in cut:
        for i in range(len(w) - 12):
            s = tuple(w[i : i + 13])
            first[s] = min(first.get(s, key(d)), key(d))
    want = Counter()
    for d, w in cut:
        gone = {k for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < key(d) for k in range(i, i + 13)}
        want[d, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()] += 1
    assert got == want and any(n for _, _, n, _ in want)
    assert substring_dedup.remove_repeats(empty(docs)).count() == 0


def test_mpeg_round_trip_and_damage():
    for text in (b"", b"x" * 1417, bytes(range(200)) * 40):
        data = mpeg_audio.encode(mpeg_audio.payload_of(text))
        back = mpeg_audio.decode(data)
        assert back.payload == mpeg_audio.payload_of(text) and back.whole and not back.damaged and not back.skipped
        assert back.seconds == back.frames * 1152 / 32000
    at = back.offsets[1]
    head = mpeg_audio.decode(data[: at + 8] + b"\x55" + data[at + 9 :])
    assert head.damaged == 1 and not head.whole
    flipped = mpeg_audio.decode(data[: at + 100] + bytes([data[at + 100] ^ 1]) + data[at + 101 :])
    assert len(flipped.payload) == len(back.payload) and not flipped.damaged and not flipped.whole
    lost = mpeg_audio.decode(data[:at] + data[back.offsets[2] :])
    assert lost.frames == back.frames - 1 and not lost.whole
    cut = mpeg_audio.decode(data[:-5])
    assert not cut.whole and not mpeg_audio.decode(b"").whole
    junk = mpeg_audio.decode(data[:at] + b"junk!" + data[at:])
    assert junk.skipped == 5 and junk.payload == back.payload and not junk.whole


def test_media_features(docs, rows):
    got = Counter(tuple(r[c] for c in ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")) for r in mpeg_audio.media_features(docs).collect())
    want = Counter()
    for d, t, _ in rows:
        text = t.encode()
        payload = text + b"\0" * (64 if not text else -len(text) % 64)
        media = mpeg_audio.encode(payload)
        want[d, len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest()] += 1
    assert got == want
    features = {r["feature"] for r in mpeg_audio.media_features(docs.where("doc_id IN (1, 7)")).collect()}
    assert len(features) == 1 and "stream=whole" in features.pop()
    assert mpeg_audio.media_features(empty(docs)).count() == 0


def test_long_words_that_differ_have_other_hashes(spark):
    """Words whose polynomial hashes modulo 2**64 are equal whatever the base is, in the operators that hash words."""
    pattern = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = pattern.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"r{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"{pattern} {rest}"), (2, f"{other} {rest}")], "doc_id long, text string")
    assert [r["n_removed"] for r in substring_dedup.remove_repeats(docs).collect()] == [0, 0]
    leaks = decontaminate.leaks(docs, spark.createDataFrame([(1, f"{pattern} r0 r1 r2 r3")], "item_id long, text string"))
    assert [r["doc_id"] for r in leaks.collect()] == [1]
    first = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 != 1)
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    pair = spark.createDataFrame([(first, f"{pattern} x"), (held, f"{other} x")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_known"] for r in katz.katz_scores(pair).collect()} == {first: 3, held: 2}


def test_blocks_of_items_are_searched_in_one_pass(spark, monkeypatch):
    """However many blocks, documents are read once and nothing is written again."""
    monkeypatch.setattr(decontaminate, "BLOCK", 20)
    items = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(12))) for i in range(30)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"before w{i}x0 " + " ".join(f"w{i}x{k}" for k in range(12)) + " after") for i in range(40)], "doc_id long, text string")
    found = decontaminate.with_leaks(docs, items)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, items).collect()} == {(i, i) for i in range(30)}


def test_shards_follow_the_bytes(spark, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_BYTES", 2000)
    rows = [(i, f"text number {i} " * 10) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    few = token_files.write(docs.where("doc_id < 50"), token_files.shared_dir(spark, "few"))
    many = token_files.write(docs, token_files.shared_dir(spark, "many"))
    assert 2 * len(few) < len(many) and sum(r["docs"] for r in many) == 200
    assert [r["doc_id"] for r in token_files.token_table(docs).orderBy("start").collect()] == list(range(200))


def test_merge_jobs_stay_linear(spark, monkeypatch):
    """With four times the runs there are some four times the jobs and opened files, not sixteen."""
    monkeypatch.setattr(warc_index, "FAN_IN", 4)
    monkeypatch.setattr(warc_index, "RANGE", 60)
    monkeypatch.setattr(warc_index, "STRIDE", 4)
    seen, real = [], warc_index.json.dumps
    monkeypatch.setattr(warc_index.json, "dumps", lambda x, **k: (seen.append(len(x[1])) if isinstance(x, list) and len(x) == 4 else None, real(x, **k))[1])
    opened = []
    for n in (16, 64):
        pages = [(i, f"http://h{i % 37}.example.com/{i % 11}", f"page {i}") for i in range(25 * n)]
        df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(n)
        before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        seen.clear()
        got = warc_index.archive_table(df, F.concat(F.lit("2024010100000"), F.col("page_id") % 10)).collect()
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[0])
        spark.conf.set("spark.sql.shuffle.partitions", before[1])
        assert sorted(r["history_rank"] for r in got) == list(range(25 * n)) and max(seen) <= 4 * 2
        opened.append(sum(seen))
    assert opened[1] < 8 * opened[0]


def test_licence_postings_of_whole_texts(spark):
    """Ten templates of some 1500 words each, as whole licences are: passages are those of brute force."""
    rng = np.random.default_rng(9)
    common = [f"c{i}" for i in range(400)]
    templates = []
    for k in range(10):
        words = [common[i] for i in rng.integers(0, 400, 1500)]
        words[700:703] = [f"key{k}a", f"key{k}b", f"key{k}c"]
        templates.append((f"t{k}", " ".join(words), (f"key{k}a key{k}b key{k}c",)))
    texts = {}
    for d in range(30):
        words = templates[d % 10][1].split()
        for i in rng.integers(0, 1500, int(rng.integers(0, 420))):
            words[int(i)] = "other"
        if d % 7 == 3:
            words[701] = "other"
        texts[d] = " ".join([common[i] for i in rng.integers(0, 400, 300)] + words)
    got = {r["doc_id"]: {(p["label"], p["first_word"]) for p in r["passages"]} for r in license_scan.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), templates).collect()}
    found = 0
    for d, text in texts.items():
        own, want = np.array(text.split()), set()
        for label, passage, _ in templates:
            p = np.array(passage.split())
            for s in range(-300, len(own)):
                a, b = max(0, s), min(len(own), s + len(p))
                same = own[a:b] == p[a - s : b - s]
                if same.sum() >= 1200 and same[700 - (a - s) : 703 - (a - s)].all() and s <= 700:
                    want.add((label, s))
        assert got[d] == want
        found += len(want)
    assert 10 < found < 30
