"""Ordered events: redirect chains, scans, sign-in flows, cool-downs, budgets, activity.

A key's rows are cut at times (``segments``), so a busy tab, host or URL is many tasks; what is collected is cut before
it is collected (the last 25 of a chain, 64 steps of 5 minutes). Flows look back 64 rows. A budget's key is cut at its
pauses alone: one that never pauses for its time is one sorted stream, in little memory.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import hosts as H
from . import segments as S
from .segments import micros

CHAIN, STEPS, TTL = 25, 64, 300


def redirect_chains(nav: DataFrame, keep: int = CHAIN, bucket: float = S.BUCKET) -> DataFrame:
    """(tab_id, chain_no, n_hops, urls): a navigation begins a chain, redirects extend it, the last
    ``keep`` URLs stay. Chain numbers add up over buckets of ``bucket`` seconds, and each bucket gives its chains' last
    URLs."""
    rows = nav.where("kind IN ('navigate', 'redirect')").select("tab_id", "ts", "seq", "kind", "url", S.bucket_of(micros("ts"), bucket).alias("_bucket"))
    rows = S.running_count(rows, "tab_id", F.col("kind") == "navigate", ["ts", "seq"], "chain_no")
    for part in (["tab_id", "_bucket", "chain_no"], ["tab_id", "chain_no"]):
        last = Window.partitionBy(*part).orderBy(F.col("ts").desc(), F.col("seq").desc())
        rows = rows.withColumn("_back", F.row_number().over(last)).where(F.col("_back") <= keep)
    grouped = rows.groupBy("tab_id", "chain_no").agg(F.array_sort(F.collect_list(F.struct("ts", "seq", "url"))).alias("_c"))
    return grouped.select("tab_id", "chain_no", F.size("_c").cast("long").alias("n_hops"), F.transform("_c", lambda x: x["url"]).alias("urls"))


def redirect_facts(chains: DataFrame) -> DataFrame:
    """chains with hops, distinct roots, and the two redirect signals' confidences (null: not fired)."""
    roots = F.array_distinct(F.transform("urls", lambda u: H.root_domain(H.no_www(F.lower(H.url_part(u, 3))))))
    out = chains.withColumn("chain_roots", F.size(roots).cast("long"))
    return out.withColumns({"long_conf": F.when(F.col("n_hops") > 3, F.least(F.lit(1.0), (F.col("n_hops") - 3) / 5)), "cross_conf": F.when(F.col("chain_roots") >= 3, 0.8)})


def scan_dedupe(nav: DataFrame, bucket: float = S.BUCKET) -> DataFrame:
    """Events whose URL differs from the one before in the same tab."""
    rows = nav.withColumns({"_bucket": S.bucket_of(micros("ts"), bucket), "_url": F.struct("url")})
    rows = S.last_before(rows, "tab_id", "_url", ["ts", "seq"], "_before", including=False)
    return rows.where(~F.col("url").eqNullSafe(F.col("_before.url"))).select(*nav.columns)


def flow_anomalies(steps: Column) -> dict[str, Column]:
    """Flags of a sign-in flow from its ordered steps (kind, origin, post_origin, in_iframe)."""
    of = lambda *kinds: F.filter(steps, lambda s: s["kind"].isin(*kinds))
    origins = lambda a: F.transform(a, lambda s: s["origin"])
    creds = of("credential", "mfa")
    posts = F.array_compact(F.transform(creds, lambda s: s["post_origin"]))
    entry = H.first_of(of("entry"))
    password, mfa = H.first_of(of("credential")), H.first_of(of("mfa"))
    enough = F.size(steps) >= 2
    no = lambda c: F.coalesce(enough & c, F.lit(False))
    return {
        "flow_relay": no(F.size(F.array_except(posts, origins(steps))) > 0),
        "flow_token_drift": no((F.size(of("oauth")) > 0) & (F.size(F.array_except(origins(of("token")), origins(of("oauth")))) > 0)),
        "flow_iframe_swap": no(F.exists(creds, lambda s: s["in_iframe"] & (s["origin"] != entry["origin"]))),
        "flow_redirect_storm": no(F.size(F.array_distinct(origins(of("redirect")))) >= 4),
        "flow_mfa_split": no(password["origin"] != mfa["origin"]),
    }


def auth_flows(steps: DataFrame, ttl: int = TTL, keep: int = STEPS) -> DataFrame:
    """Each step with the anomalies of its flow as of then: of the last ``keep`` steps those within ``ttl`` seconds. A
    row holds ``keep`` steps at most, however busy its flow is."""
    last = Window.partitionBy("flow_id").orderBy("_us", "seq").rowsBetween(1 - keep, 0)
    rows = steps.withColumn("_us", micros("ts"))
    rows = rows.withColumn("_seen", F.collect_list(F.struct("_us", "seq", "kind", "origin", "post_origin", "in_iframe")).over(last))
    rows = rows.withColumn("_seen", F.filter("_seen", lambda s: s["_us"] >= F.col("_us") - ttl * 1_000_000))
    return rows.withColumns(flow_anomalies(F.col("_seen"))).withColumn("n_steps", F.size("_seen").cast("long")).drop("_seen", "_us")


def cooldown(warnings: DataFrame, seconds: int = 1800) -> DataFrame:
    """Warnings (host, kind, ts) that are shown: at most one a host and kind in ``seconds`` from the last
    one shown."""
    shown = S.spaced(warnings.select("host", "kind", micros("ts").alias("_us")), ["host", "kind"], seconds)
    return shown.select("host", "kind", F.timestamp_micros("_us").cast(warnings.schema["ts"].dataType).alias("ts"))


def rate_budget(calls: DataFrame, most: int, seconds: float) -> DataFrame:
    """(key, n_calls, n_allowed): a call is allowed if fewer than ``most`` allowed ones lie within the last
    ``seconds``; rejected calls don't count. After a pause of more than ``seconds`` nothing before matters, so a key is
    cut there; each part's times are read in order, with the last ``most`` allowed ones as the state."""
    us, kind = int(seconds * 1_000_000), to_arrow_type(calls.schema["key"].dataType)
    rows = S.independent_parts(calls.select("key", micros("ts").alias("_us")).where("_us IS NOT NULL"), "key", seconds)

    def fold(batches):
        now, n, allowed, hits, out = None, 0, 0, deque(maxlen=most), []
        for key, part in S.parts_in_order(batches, 2):
            if key != now:
                if now is not None:
                    out.append((now[0], n, allowed))
                now, n, allowed, hits = key, 0, 0, deque(maxlen=most)
            times = part.column(2).to_pylist()
            n += len(times)
            for t in times:
                if len(hits) < most or hits[0] < t - us:
                    hits.append(t)
                    allowed += 1
            if len(out) >= 10_000:
                yield of(out)
                out = []
        if now is not None:
            yield of([*out, (now[0], n, allowed)])

    def of(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (kind, pa.int64(), pa.int64()))], names=["key", "n_calls", "n_allowed"])

    ordered = rows.select("key", "_part", "_us").repartition("key", "_part").sortWithinPartitions("key", "_part", "_us")
    parts = ordered.mapInArrow(fold, f"key {calls.schema['key'].dataType.simpleString()}, n_calls long, n_allowed long")
    return parts.groupBy("key").agg(F.sum("n_calls").alias("n_calls"), F.sum("n_allowed").alias("n_allowed"))


# Fixed values. Fields of an activity entry that are ever stored.
ACTIVITY_FIELDS = ("kind", "host", "score", "status", "ruleId", "reason", "severity")
VIEW = 20


def safe_activity(activity: DataFrame, most: int = 256) -> DataFrame:
    """Activity with nothing but its profile, time, number and the fields that may be stored, strings cut to ``most``."""
    kept = [c for c in activity.columns if c in ACTIVITY_FIELDS]
    cut = [F.substring(c, 1, most).alias(c) if activity.schema[c].dataType.simpleString() == "string" else F.col(c) for c in kept]
    return activity.select("profile_id", "at", "seq", *cut)


def recent_activity(activity: DataFrame, now: Column, days: int = 7, keep: int = 200) -> DataFrame:
    """The newest ``keep`` entries of each profile within ``days``, safe to store, with their rank; the first VIEW of them
    are shown."""
    rows = safe_activity(activity).where(F.col("at") >= now - F.expr(f"INTERVAL {days} DAYS"))
    newest = Window.partitionBy("profile_id").orderBy(F.col("at").desc(), F.col("seq").desc())
    return rows.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= keep).withColumn("shown", F.col("rank") <= VIEW)


def verdict_asof(requests: DataFrame, cache: DataFrame, bucket: float = S.BUCKET) -> DataFrame:
    """Requests (request_id, url, ts) with the newest cached verdict (url, cached_at, expires_at, status) that
    had not expired: both in one order, no range join. A bucket's requests see its own verdicts, else the newest one
    that the buckets before hand on."""
    left = requests.select("url", F.col("ts").alias("_t"), F.lit(1).alias("_side"), "request_id", F.lit(None).cast("struct<expires_at: timestamp, status: string>").alias("_v"))
    right = cache.select("url", F.col("cached_at").alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast("bigint").alias("request_id"), F.struct("expires_at", "status").cast("struct<expires_at: timestamp, status: string>").alias("_v"))
    both = left.unionByName(right).withColumn("_bucket", S.bucket_of(micros("_t"), bucket))
    rows = S.last_before(both, "url", "_v", ["_t", "_side"], "_seen", including=True).where("_side = 1")
    good = F.col("_seen.expires_at") > F.col("_t")
    return rows.select("request_id", "url", F.when(good, F.col("_seen.status")).alias("cached_status"))


def learned_safe(bumps: DataFrame, most: int = 50) -> DataFrame:
    """(root, trust_count, last_ts): trusts a root, at most ``most``."""
    return bumps.groupBy("root").agg(F.least(F.lit(most), F.count(F.lit(1))).cast("long").alias("trust_count"), F.max("ts").alias("last_ts"))


def learned_safe_decay(changes: DataFrame, most: int = 50, bucket: float = S.BUCKET) -> DataFrame:
    """(root, trust_count) of +1 and -1 changes (root, ts, seq, step) in order of time, kept between 0 and ``most``."""
    time = micros("ts") if "timestamp" in changes.schema["ts"].dataType.simpleString() else F.col("ts") * 1_000_000
    rows = changes.withColumn("_bucket", S.bucket_of(time, bucket))
    return S.clamped_sums(rows, "root", "step", ["ts", "seq"], most).withColumnRenamed("total", "trust_count")


def latency_profile(rows: DataFrame, value: str, by: str) -> DataFrame:
    """n, min, max, mean and exact p95 (sorted value number min(n - 1, floor(0.95 n)))."""
    rows = rows.where(F.col(value).isNotNull())
    facts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"))
    ranked = S.exact_rank(rows, by, value, F.least(F.col("n") - 1, F.floor(F.col("n") * 0.95)))
    return facts.join(ranked.select(F.col(by).alias("_by"), F.col(value).alias("p95")), F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")
