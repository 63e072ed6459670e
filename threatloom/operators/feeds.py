"""Threat and ad lists: normal forms, merging, snapshots, deltas, matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import hosts as H

FEED_CAP = 200_000
SNAPSHOT_CAP = 20_000


def feed_host(line: Column) -> Column:
    """The bare host of a feed line (hosts file, URL or host), null for comments and non-hosts."""
    text = F.regexp_replace(F.trim(line), r"^(0\.0\.0\.0|127\.0\.0\.1)\s+", "")
    host = F.when(text.rlike("(?i)^https?://"), H.url_part(text, 3)).otherwise(F.substring_index(text, "/", 1))
    host = F.regexp_replace(H.no_www(F.lower(host)), r"\.$", "")
    good = ~F.trim(line).rlike("^[#!]") & host.contains(".") & ~host.rlike(r"\s") & (F.length(host) <= 253)
    return F.when(good, host)


def ad_domain(line: Column) -> Column:
    """The domain of an ad-list line, block-list syntax included."""
    text = F.lower(F.trim(line))
    host = F.regexp_replace(F.regexp_replace(text, r"^\|\|", ""), r"[\^/].*$", "")
    host = H.no_www(F.regexp_replace(host, r"^(0\.0\.0\.0|127\.0\.0\.1)\s+", ""))
    host = F.regexp_extract(host, r"^(\S*)", 1)
    good = ~text.rlike("^[#!]") & host.contains(".") & ~host.rlike("[^a-z0-9.-]") & (F.length(host) <= 253)
    return F.when(good, host)


def never_listed(host: Column) -> Column:
    """Whether a host or its root is of good repute and must not be listed."""
    kept = sorted({*C.REPUTABLE_ROOTS, *C.LOGIN_ROOTS, *(r for roots in C.SAFELIST.values() for r in roots)})
    return host.isin(*kept) | H.root_domain(host).isin(*kept)


def merge_feeds(lines: DataFrame, cap: int = FEED_CAP) -> DataFrame:
    """Distinct hosts of feed lines (feed_ord, line_no, line) in order of first sight, at most ``cap``."""
    first = lines.select(feed_host(F.col("line")).alias("host"), F.struct("feed_ord", "line_no").alias("seen")).where("host IS NOT NULL").groupBy("host").agg(F.min("seen").alias("seen"))
    return first.orderBy("seen", "host").limit(cap).select("host", "seen.feed_ord", "seen.line_no")


def feed_counts(lines: DataFrame) -> DataFrame:
    return lines.select("feed_id", feed_host(F.col("line")).alias("host")).groupBy("feed_id").agg(F.countDistinct("host").alias("n_hosts"))


def snapshot(lines: DataFrame, seed: DataFrame | None = None, cap: int = SNAPSHOT_CAP) -> DataFrame:
    """Merged hosts without the seed and those of good repute, capped in feed order, then sorted."""
    merged = merge_feeds(lines).where(~never_listed(F.col("host")))
    if seed is not None:
        merged = merged.join(seed.select("host").distinct(), "host", "left_anti")
    return merged.orderBy("feed_ord", "line_no", "host").limit(cap).select("host").orderBy("host")


def delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """Hosts that came or went between two snapshots."""
    added = new.select("host").subtract(old.select("host")).withColumn("change", F.lit("added"))
    return added.unionByName(old.select("host").subtract(new.select("host")).withColumn("change", F.lit("removed")))


def ad_rules(lines: DataFrame, chunk: int = 1000, cap: int = 6000) -> DataFrame:
    """(id, domains): distinct ad domains, sorted, in rules of at most ``chunk``. The list is capped, so
    its ranks come from one small window."""
    names = lines.select(ad_domain(F.col("line")).alias("domain")).where("domain IS NOT NULL").where(~never_listed(F.col("domain"))).distinct().orderBy("domain").limit(cap)
    ranked = names.withColumn("id", F.floor((F.row_number().over(Window.orderBy("domain")) - 1) / chunk).cast("int") + 1)
    return ranked.groupBy("id").agg(F.array_sort(F.collect_list("domain")).alias("domains"))


def blocklist_match(parts: DataFrame, blocklist: DataFrame) -> DataFrame:
    """``parts`` with blocklisted and matched_host: the host first, then its root; ``blocklist`` has host
    and source, of which ``bundled`` counts before ``feed``. Two equi-joins on distinct hosts; Spark
    broadcasts the list while it is small enough."""
    best = blocklist.groupBy("host").agg(F.min("source").alias("source"))  # bundled before feed
    by = lambda key: best.select(F.col("host").alias(key), F.col("source").alias(f"_{key}_source"))
    out = parts.join(by("host"), "host", "left").join(by("root"), "root", "left")
    out = out.withColumns({"blocklisted": F.col("_host_source").isNotNull() | F.col("_root_source").isNotNull(), "matched_host": F.when(F.col("_host_source").isNotNull(), F.col("host")).when(F.col("_root_source").isNotNull(), F.col("root")), "block_source": F.coalesce("_host_source", "_root_source")})
    return out.drop("_host_source", "_root_source")


def suffixes(host: Column) -> Column:
    """The host and all its parent domains."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def ad_match(requests: DataFrame, domains: DataFrame) -> DataFrame:
    """Sub-resource requests (request_id, resource_host, resource_type) to a listed domain or below one."""
    rows = requests.where("resource_type <> 'main_frame'").withColumn("domain", F.explode(suffixes(F.col("resource_host"))))
    hit = rows.join(domains.select("domain").distinct(), "domain", "left_semi")
    return hit.groupBy("request_id").agg(F.max_by("domain", F.length("domain")).alias("domain"))


def allowlist(trusts: DataFrame, cap: int = 500) -> DataFrame:
    """Roots of trusted hosts (host, ts), in order of first trust."""
    roots = trusts.groupBy(H.root_domain(F.col("host")).alias("root")).agg(F.min("ts").alias("first_ts"))
    return roots.orderBy("first_ts", "root").limit(cap)


def training_corpus(lines: DataFrame, top: DataFrame, per_class: int) -> DataFrame:
    """(host, label): as many listed hosts as benign ones (host, rank), neither on the other list."""
    bad = merge_feeds(lines).where(~never_listed(F.col("host"))).join(top.select("host").distinct(), "host", "left_anti")
    good = top.groupBy("host").agg(F.min("rank").alias("rank")).join(bad.select("host"), "host", "left_anti")
    bad = bad.orderBy("feed_ord", "line_no").limit(per_class).select("host", F.lit(1).alias("label"))
    return bad.unionByName(good.orderBy("rank", "host").limit(per_class).select("host", F.lit(0).alias("label")))
