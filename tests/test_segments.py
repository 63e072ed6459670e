"""Ordered work on busy keys: each operator cut into many buckets against a plain pass over the sorted rows."""

import math
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from threatloom.operators import events
from threatloom.operators import segments as S

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(seconds):
    return START + timedelta(seconds=seconds)


@pytest.fixture
def uneven(spark):
    """No merging of small partitions, so that the spread of a key shows."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def navigation(rng, n):
    rows = []
    for i in range(n):
        tab = 1 if i % 2 else rng.choice([2, 3, 4, None])
        rows.append((tab, at(rng.randrange(4000)), i, rng.choice(["navigate", "redirect", "redirect", "redirect", "close"]), f"https://h{rng.randrange(9)}.example/" if rng.random() < 0.9 else None))
    return rows


NAV = "tab_id long, ts timestamp, seq long, kind string, url string"


def by_tab(rows):
    tabs = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        tabs[r[0]].append(r)
    return tabs


@pytest.mark.parametrize("bucket", [7, 600, 86_400])
def test_redirect_chains(spark, bucket):
    rows = navigation(random.Random(bucket), 1500)
    chains = defaultdict(list)
    for tab, own in by_tab(rows).items():
        number = 0
        for _, _, _, kind, url in own:
            if kind in ("navigate", "redirect"):
                number += kind == "navigate"
                chains[tab, number].append(url)
    want = Counter((tab, no, min(5, len(c)), tuple(c[-5:])) for (tab, no), c in chains.items())
    got = events.redirect_chains(spark.createDataFrame(rows, NAV), keep=5, bucket=bucket)
    assert Counter((r["tab_id"], r["chain_no"], r["n_hops"], tuple(r["urls"])) for r in got.collect()) == want


@pytest.mark.parametrize("bucket", [7, 86_400])
def test_scan_dedupe(spark, bucket):
    rows = navigation(random.Random(5), 900)
    want = {r[2] for own in by_tab(rows).values() for before, r in zip([None, *own], own) if r[4] != (before and before[4])}
    assert {r["seq"] for r in events.scan_dedupe(spark.createDataFrame(rows, NAV), bucket).collect()} == want


def test_half_of_all_events_in_one_tab_are_many_tasks(uneven):
    rows = uneven.range(200_000).selectExpr("CASE WHEN id % 2 = 0 THEN 7 ELSE -id END AS tab_id", "timestamp_seconds(1700000000 + id) AS ts", "id AS seq", "id % 10 = 0 AS begins")
    rows = S.running_count(rows.withColumn("_bucket", S.bucket_of(S.micros("ts"))), "tab_id", F.col("begins"), ["ts", "seq"], "no").where("tab_id = 7")
    spread = {r["p"]: r["n"] for r in rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.max("no").alias("m")).collect()}
    assert sum(spread.values()) == 100_000 and len(spread) >= 8 and max(spread.values()) < 40_000
    assert rows.agg(F.max("no")).first()[0] == 20_000


def taken(times, wait):
    out = []
    for t in sorted(times):
        if not out or t - out[-1] >= wait:
            out.append(t)
    return out


@pytest.mark.parametrize("span", [1, 2, 5, 64])
def test_spaced(spark, span):
    """Dense and sparse keys, ties, waits that stretches begin in the middle of."""
    rng = random.Random(span)
    times = {"dense": [rng.randrange(3000) for _ in range(2000)], "sparse": [rng.randrange(10**6) for _ in range(80)], "ties": [5] * 9 + [105] * 9 + [104], None: [0, 99, 100, 199, 200], "one": [77], "steps": list(range(0, 5000, 33)), "bursts": [1000 * k + rng.randrange(120) for k in range(40) for _ in range(5)]}
    rows = [(k, t * 1_000_000) for k, own in times.items() for t in own]
    got = S.spaced(spark.createDataFrame(rows, "key string, _us long").repartition(3), ["key"], 100, span)
    assert Counter(map(tuple, got.collect())) == Counter((k, t * 1_000_000) for k, own in times.items() for t in taken(own, 100))


def test_one_key_of_a_million_times(uneven):
    rows = uneven.range(1_000_000).selectExpr("'h' AS host", "'k' AS kind", "timestamp_micros(1700000000000000 + id * 7000000 + (id * 7919) % 5000000) AS ts")
    shown = events.cooldown(rows)
    counts = [r["n"] for r in shown.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    want = len(taken([1700000000000000 + i * 7000000 + (i * 7919) % 5000000 for i in range(1_000_000)], 1800 * 10**6))
    assert sum(counts) == want and len(counts) >= 8
    calls = uneven.range(1_000_000).selectExpr("'k' AS key", "1700000000000000 + id * 1000000 + (id DIV 1000) * 400000000 AS _us")
    parts = S.independent_parts(calls, "key", 300.0)
    assert parts.groupBy("_part").count().count() == 1000
    assert parts.repartition("key", "_part").select(F.spark_partition_id()).distinct().count() >= 8


def test_rate_budget(spark):
    rng = random.Random(2)
    times = {"a": sorted(rng.randrange(20_000) for _ in range(400)), "b": sorted(rng.randrange(300) for _ in range(400)), "c": [0, 100, 200, 301, 402, 402, 402], None: [1, 1, 1, 1, 1]}
    want = {}
    for k, own in times.items():
        hits = []
        for t in own:
            if len(hits) < 3 or hits[-3] < t - 100:
                hits.append(t)
        want[k] = (len(own), len(hits))
    rows = [(k, at(t)) for k, own in times.items() for t in own]
    got = events.rate_budget(spark.createDataFrame(rows, "key string, ts timestamp"), 3, 100.0)
    assert {r["key"]: (r["n_calls"], r["n_allowed"]) for r in got.collect()} == want


@pytest.mark.parametrize("bucket", [5, 3600])
def test_verdict_asof(spark, bucket):
    rng = random.Random(3)
    requests = [(i, "hot" if i % 2 else rng.choice(["u1", "u2", None]), at(rng.randrange(600))) for i in range(300)]
    cache = [(rng.choice(["hot", "u1", None]), at(t := rng.randrange(600)), at(t + rng.randrange(1, 90)) if rng.random() < 0.9 else None, f"s{i}") for i in range(120)]
    cache = list({(u, c): (u, c, e, s) for u, c, e, s in cache}.values())  # one verdict a time
    want = {}
    for i, url, t in requests:
        seen = max((c for c in cache if c[0] == url and c[1] <= t), key=lambda c: c[1], default=None)
        want[i] = seen[3] if seen and seen[2] and seen[2] > t else None
    got = events.verdict_asof(spark.createDataFrame(requests, "request_id long, url string, ts timestamp"), spark.createDataFrame(cache, "url string, cached_at timestamp, expires_at timestamp, status string"), bucket)
    assert {r["request_id"]: r["cached_status"] for r in got.collect()} == want


@pytest.mark.parametrize("bucket", [3, 100_000])
def test_trust_decay(spark, bucket):
    rng = random.Random(6)
    rows = [(rng.choice(["hot", "hot", "r1", None]), at(rng.randrange(500)), i, rng.choice([1, 1, -1])) for i in range(1200)]
    want = defaultdict(int)
    for root, _, _, step in sorted(rows, key=lambda r: (r[1], r[2])):
        want[root] = max(0, min(20, want[root] + step))
    got = events.learned_safe_decay(spark.createDataFrame(rows, "root string, ts timestamp, seq long, step int"), 20, bucket)
    assert {r["root"]: r["trust_count"] for r in got.collect()} == want


def test_latency_profile(spark):
    rng = random.Random(7)
    values = {"even": [rng.random() for _ in range(3000)], "far": [rng.expovariate(1) ** 9 for _ in range(500)], "one": [4.25], "same": [1.5] * 99, "few": [rng.choice([0.1, 0.2, 0.3]) for _ in range(1000)], "ends": [float("inf")] * 30 + [1.0, 2.0, float("-inf")], "nan": [float("nan")] * 40 + [3.0], None: [1.0, 2.0, 3.0], "low": [float("-inf")] * 300 + [5.0]}
    rows = [(k, v) for k, own in values.items() for v in [*own, None]]
    got = {r["kind"]: r for r in events.latency_profile(spark.createDataFrame(rows, "kind string, v double"), "v", "kind").collect()}
    assert set(got) == set(values)
    for k, own in values.items():
        ordered = sorted(own, key=lambda v: (math.isnan(v), v))
        p95 = ordered[min(len(own) - 1, math.floor(len(own) * 0.95))]
        assert got[k]["n"] == len(own) and (got[k]["p95"] == p95 or math.isnan(p95) and math.isnan(got[k]["p95"])), k
