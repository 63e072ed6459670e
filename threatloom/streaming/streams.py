"""The same state as streams: chains, flows, cool-downs, dedupe, counters, verdicts, retention, feeds.

State is kept a key and bounded (two counts, 64 steps, one time), in typed state variables. A timer removes it when the
watermark has passed the last event of its key by the key's time to live, and a closed tab's goes at once. Sign-in flows
share the state of a group of flows, so that calls don't grow with the flows. A key's (or group's) events of one
micro-batch are sorted together and worked on as arrays, so micro-batches should be bounded at the source
(``maxFilesPerTrigger``); events behind the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import feeds, scoring
from ..operators.events import CHAIN, STEPS, TTL

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ordered(frames: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(by, kind="stable", ignore_index=True)


def _micros(times: pd.Series) -> np.ndarray:
    return times.to_numpy("datetime64[us]").astype(np.int64)


class _Expiring(StatefulProcessor):
    """State of a key that goes ``ttl`` seconds of event time after its last event."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.expiry = handle.getValueState("expiry", "at long")
        self.open(handle)

    def keep(self, last_us: int, timers) -> None:
        """The timer moves on with the newest event; it stays where it is if that is no later."""
        at = max(last_us // 1000, timers.getCurrentWatermarkInMs()) + self.ttl * 1000
        before = self.expiry.get()[0] if self.expiry.exists() else None
        if before is None or at > before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(at)
            self.expiry.update((at,))

    def forget(self) -> None:
        if self.expiry.exists():
            self.handle.deleteTimer(self.expiry.get()[0])
        self.clear()

    def clear(self) -> None:
        self.expiry.clear()
        self.state.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def chain_steps(kind: np.ndarray, chain_no: int, hops: int, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Chain number and hops after each event in order, from those before: a navigation begins a chain, a close ends all."""
    place, begins, closes = np.arange(len(kind)), kind == "navigate", kind == "close"
    reset = np.maximum.accumulate(np.where(begins | closes, place, -1))
    closed = np.maximum.accumulate(np.where(closes, place, -1))
    count = np.cumsum(begins)
    number = np.where(closed >= 0, count - count[closed], chain_no + count)
    since = np.where(reset < 0, hops + place + 1, place - reset + begins[reset])
    return number, np.minimum(keep, since)


class _Chains(_Expiring):
    def __init__(self, keep: int, ttl: int):
        super().__init__(ttl)
        self.most = keep

    def open(self, handle):
        self.state = handle.getValueState("chain", "chain_no long, n_hops long")

    def handleInputRows(self, key, rows, timerValues):
        frame = _ordered(rows, ["ts", "seq"])
        before = self.state.get() if self.state.exists() else (0, 0)
        kind = frame["kind"].to_numpy()
        number, hops = chain_steps(kind, *before, self.most)
        if kind[-1] == "close":
            number[-1] = hops[-1] = 0
        if number[-1]:
            self.state.update((int(number[-1]), int(hops[-1])))
            self.keep(int(_micros(frame["ts"])[-1]), timerValues)
        elif self.state.exists():
            self.forget()
        out = kind != "close"
        yield pd.DataFrame({"tab_id": key[0], "seq": frame["seq"][out], "chain_no": number[out], "n_hops": hops[out]})


def _stateful(rows: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str) -> DataFrame:
    return rows.groupBy(*keys).transformWithStateInPandas(processor, schema, "append", "eventtime")


def redirect_chains(nav: DataFrame, keep: int = CHAIN, ttl: int = 86_400, delay: str = "1 hour") -> DataFrame:
    """Per event: the tab's chain so far (tab_id, seq, chain_no, n_hops); a close, or a day without events, drops the
    tab's state."""
    return _stateful(timed(nav, delay), ["tab_id"], _Chains(keep, ttl), "tab_id long, seq long, chain_no long, n_hops long")


_FLAGS = ("flow_relay", "flow_token_drift", "flow_iframe_swap", "flow_redirect_storm", "flow_mfa_split")


#: Groups of flows, whose state is kept together. A checkpoint is bound to its number.
FLOW_GROUPS = 4096


def _runs(n: int, firsts: np.ndarray, lasts: np.ndarray) -> np.ndarray:
    """How many of the ranges ``firsts`` to ``lasts`` (both included, none if the last is before the first) hold each place."""
    good = firsts <= lasts
    return np.cumsum(np.bincount(firsts[good], minlength=n + 1) - np.bincount(lasts[good] + 1, minlength=n + 1))[:n]


def flow_flags(us: np.ndarray, kind: np.ndarray, origin: np.ndarray, post: np.ndarray, in_iframe: np.ndarray, ttl_us: int, keep: int, starts: tuple | np.ndarray = (0,)) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """For each step in order of time the first step that counts with it (of the last ``keep`` those within ``ttl_us``), and
    the flags of these steps. Several flows stand one after the other, the first steps of each at ``starts``.

    A step counts with those after it up to the last that looks back so far, so what it tells holds for a range of steps,
    and the ranges that hold a step are added up, however many origins there are."""
    n = len(us)
    place, begin = np.arange(n), np.empty(n, np.int64)
    for a, b in zip(starts, [*starts[1:], n]):
        begin[a:b] = np.maximum(a, np.maximum(place[a:b] + 1 - keep, a + np.searchsorted(us[a:b], us[a:b] - ttl_us)))
    codes = pd.factorize(np.concatenate([origin, post]))[0].astype(np.int64) + 1
    origin_code, post_code = codes[:n], codes[n:]
    oauth, token, jump = kind == "oauth", kind == "token", kind == "redirect"
    creds = (kind == "credential") | (kind == "mfa")
    framed = creds & in_iframe

    def first(mask: np.ndarray) -> np.ndarray:
        """The first such step among those that count, or -1."""
        at = np.append(np.flatnonzero(mask), n)
        found = at[np.searchsorted(at, begin)]
        return np.where(found <= place, found, -1)

    def after(at: np.ndarray) -> np.ndarray:
        """The first step with which a place doesn't count any more."""
        return np.searchsorted(begin, at, "right")

    def keys(mask: np.ndarray) -> np.ndarray:
        """Places of ``mask`` by origin, as one sorted number each."""
        return np.sort(origin_code[mask] * n + place[mask])

    def unmatched(mask: np.ndarray, by: np.ndarray, among: np.ndarray) -> np.ndarray:
        """Whether a step of ``mask`` counts, and none of ``among`` that counts has its value as the origin."""
        j, known = np.flatnonzero(mask), np.concatenate([[-1], keys(among), [np.iinfo(np.int64).max]])
        i = np.searchsorted(known, by[j] * n + j, "right")
        before, next_ = known[i - 1] - by[j] * n, known[i] - by[j] * n  # of another origin: below 0, or n and more
        return _runs(n, np.maximum(j, np.where(before >= 0, after(before), 0)), np.minimum(after(j), np.minimum(next_, n)) - 1) > 0

    def counted(by: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """How many steps of ``mask`` count that have the origin ``by``."""
        known = keys(mask)
        return np.searchsorted(known, by * n + place, "right") - np.searchsorted(known, by * n + begin)

    entry, password, code = first(kind == "entry"), first(kind == "credential"), first(kind == "mfa")
    j = keys(jump)
    again = np.append(False, j[1:] // max(n, 1) == j[:-1] // max(n, 1))[: len(j)]
    j %= max(n, 1)
    storm = _runs(n, np.maximum(j, np.where(again, after(np.roll(j, 1)), 0)), after(j) - 1)
    all_framed = np.append(0, np.cumsum(framed))
    flags = {
        "flow_relay": unmatched(creds & (post != ""), post_code, np.ones(n, bool)),
        "flow_token_drift": unmatched(token, origin_code, oauth) & (first(oauth) >= 0),
        "flow_iframe_swap": (entry >= 0) & (all_framed[1:] - all_framed[begin] > counted(origin_code[entry], framed)),
        "flow_redirect_storm": storm >= 4,
        "flow_mfa_split": (password >= 0) & (code >= 0) & (origin_code[password] != origin_code[code]),
    }
    return begin, {k: v & (place > begin) for k, v in flags.items()}


class _Flows(_Expiring):
    """A group of flows: one call works on all steps that came, and the state is the steps that still count of all its flows."""

    def __init__(self, keep: int, ttl: int):
        super().__init__(ttl)
        self.most = keep

    def open(self, handle):
        self.state = handle.getListState("steps", "flow string, us long, kind string, origin string, post_origin string, in_iframe boolean")

    def handleInputRows(self, key, rows, timerValues):
        frame = _ordered(rows, ["ts", "seq"])
        held = list(zip(*self.state.get())) if self.state.exists() else [()] * 6
        new = (frame["flow"], _micros(frame["ts"]), frame["kind"], frame["origin"], frame["post_origin"].fillna(""), frame["in_iframe"].eq(True))
        columns = [np.concatenate([np.array(h, t), np.asarray(c, t)]) for h, c, t in zip(held, new, (object, np.int64, object, object, object, bool))]
        number = pd.factorize(columns[0])[0]
        order = np.argsort(number, kind="stable")  # of a flow the held steps, then the new ones in order of time
        flow, us, kind, origin, post, in_iframe = (c[order] for c in columns)
        starts = np.flatnonzero(np.diff(number[order], prepend=-2))
        sizes = np.diff(starts, append=len(us))
        for a, b in zip(starts, starts + sizes):
            us[a:b] = np.maximum.accumulate(us[a:b])
        begin, flags = flow_flags(us, kind, origin, post, in_iframe, self.ttl * 1_000_000, self.most, starts)
        past = timerValues.getCurrentWatermarkInMs() * 1000 - self.ttl * 1_000_000
        count = (np.arange(len(us)) >= np.repeat(begin[starts + sizes - 1], sizes)) & (us >= past)
        if count.any():
            self.state.put(list(zip(*(c[count].tolist() for c in (flow, us, kind, origin, post, in_iframe)))))
            self.keep(int(us[count].max()), timerValues)
        else:
            self.forget()
        came = order >= len(held[0])
        yield pd.DataFrame({"flow": flow[came], "seq": frame["seq"].to_numpy()[order[came] - len(held[0])], "n_steps": (np.arange(len(us)) - begin + 1)[came], **{k: flags[k][came] for k in _FLAGS}})


def auth_flows(steps: DataFrame, ttl: int = TTL, keep: int = STEPS, delay: str = "1 hour", groups: int = FLOW_GROUPS) -> DataFrame:
    """Per step: the anomalies of its flow's last ``ttl`` seconds and ``keep`` steps, which are the state. Flows are dealt to
    ``groups`` by hash; a task holds the new steps of a group at once."""
    kind = steps.schema["flow_id"].dataType
    rows = timed(steps, delay).select(F.pmod(F.xxhash64("flow_id"), F.lit(groups)).alias("_group"), F.col("flow_id").cast("string").alias("flow"), "seq", "ts", "kind", "origin", "post_origin", "in_iframe")
    out = _stateful(rows, ["_group"], _Flows(keep, ttl), "flow string, seq long, n_steps long, " + ", ".join(f"{f} boolean" for f in _FLAGS))
    return out.select(F.col("flow").cast(kind).alias("flow_id"), "seq", "n_steps", *_FLAGS)


class _Cooldown(_Expiring):
    def open(self, handle):
        self.state = handle.getValueState("last", "us long")

    def handleInputRows(self, key, rows, timerValues):
        frame = _ordered(rows, ["ts"])
        us, wait, shown = _micros(frame["ts"]), self.ttl * 1_000_000, []
        at = int(np.searchsorted(us, self.state.get()[0] + wait)) if self.state.exists() else 0
        while at < len(us):
            shown.append(at)
            at = max(at + 1, int(np.searchsorted(us, us[at] + wait)))
        if shown:
            self.state.update((int(us[shown[-1]]),))
            self.keep(int(us[shown[-1]]), timerValues)
        yield pd.DataFrame({"host": [key[0]] * len(shown), "kind": [key[1]] * len(shown), "ts": frame["ts"].iloc[shown]})


def cooldown(warnings: DataFrame, seconds: int = 1800, delay: str = "1 hour") -> DataFrame:
    """Warnings that are shown; the state of a key is the time of its last one, for as long as it matters."""
    return _stateful(timed(warnings, delay), ["host", "kind"], _Cooldown(seconds), "host string, kind string, ts timestamp")


def timed(events: DataFrame, delay: str) -> DataFrame:
    """Events with a watermark on ``ts``, which may be a time without zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def dedupe(events: DataFrame, key: str, delay: str = "1 hour") -> DataFrame:
    """Events without those whose key came within the watermark."""
    return timed(events, delay).dropDuplicatesWithinWatermark([key])


def metrics(activity: DataFrame, every: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Counters of kinds by interval."""
    return timed(activity, delay).groupBy(F.window("ts", every), "kind").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "kind", "n")


def retained(activity: DataFrame, cutoff: str, days: int = 7) -> DataFrame:
    """Entries within ``days`` of ``cutoff``; older ones that come late are dropped."""
    return timed(activity, f"{days} days").where(F.col("ts") >= F.expr(f"TIMESTAMP '{cutoff}' - INTERVAL {days} DAYS"))


def run_to(stream: DataFrame, path: str, mode: str = "append") -> None:
    """Runs a stream over what is there now, into Parquet. State variables and timers need the RocksDB state store."""
    spark = stream.sparkSession
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", path + "-state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before)


def verdicts_to(urls: DataFrame, blocklist: DataFrame, path: str, evidence=()) -> None:
    """Scores a stream of URLs batch by batch against static lists; what isn't safe becomes activity.
    A batch overwrites its own folder, so a repeated batch adds nothing."""

    def batch(rows: DataFrame, number: int) -> None:
        found = scoring.url_verdicts(rows, blocklist, evidence=evidence).where("status <> 'safe'").select("url_id", "host", "score", "status")
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")

    urls.writeStream.foreachBatch(batch).option("checkpointLocation", path + "-state").trigger(availableNow=True).start().awaitTermination()


#: Changes that are read over a full list, at most; then the next batch writes a full list.
COMPACT_AFTER = 8


def feed_set(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """The matching set (host, seen) of ``feeds_to`` as of its newest batch, or of batch ``upto``: the newest full list with
    the additions and removals after it."""
    versions = spark.read.schema("host string, seen struct<batch: int, feed_ord: bigint, line_no: bigint>, change string, batch int").parquet(path)
    if upto is not None:
        versions = versions.where(F.col("batch") <= upto)
    base = versions.where("change = 'full'").agg(F.max("batch")).scalar()
    after = versions.where(F.col("batch") >= F.coalesce(base, F.lit(-1)))
    newest = after.groupBy("host").agg(F.max_by(F.struct("seen", "change"), "batch").alias("n"))
    return newest.where("host IS NOT NULL AND n.change <> 'removed'").select("host", "n.seen")


def feeds_to(spark: SparkSession, lines: DataFrame, path: str, cap: int = feeds.FEED_CAP, compact_after: int = COMPACT_AFTER) -> None:
    """Refreshes the matching set from new feed files: each batch merges with the set so far, whose hosts keep their
    places; at most ``cap`` hosts in order of first sight.

    A batch writes only the hosts that come, and those that the cap puts out, as ``change=added|removed``; after
    ``compact_after`` such batches the whole set is written (``change=full``) and the versions that nothing reads any
    more, those before the full list before, are removed. A repeated batch overwrites its own folder."""

    def batch(rows: DataFrame, number: int) -> None:
        own = f"{path}/batch={number}"
        hosts = feeds.merge_feeds(rows, cap).select("host", F.struct(F.lit(number).alias("batch"), F.col("feed_ord").cast("long").alias("feed_ord"), F.col("line_no").cast("long").alias("line_no")).alias("seen"))
        if not number:
            hosts.withColumn("change", F.lit("full")).write.mode("overwrite").partitionBy("change").parquet(own)
            return
        known = feed_set(spark, path, number - 1)
        new = hosts.join(known, "host", "left_anti")
        union = known.select("host", "seen", F.lit(True).alias("old")).unionByName(new.select("host", "seen", F.lit(False).alias("old")))
        kept = union.orderBy("seen", "host").limit(cap)
        if number % (compact_after + 1) == 0:
            kept.select("host", "seen", F.lit("full").alias("change")).write.mode("overwrite").partitionBy("change").parquet(own)
            vacuum(spark, path, number - compact_after - 1)
            return
        added = kept.where("NOT old").select("host", "seen", F.lit("added").alias("change"))
        # hosts keep their places, so a full list has no room for new ones and puts out none
        removed = known.join(kept.select("host"), "host", "left_anti").select("host", "seen", F.lit("removed").alias("change"))
        added.unionByName(removed).write.mode("overwrite").partitionBy("change").parquet(own)

    lines.writeStream.foreachBatch(batch).option("checkpointLocation", path + "-state").trigger(availableNow=True).start().awaitTermination()


def vacuum(spark: SparkSession, path: str, before: int) -> None:
    """Removes the versions of batches before ``before``."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(hadoop):
        name = status.getPath().getName()
        if name.startswith("batch=") and int(name[6:]) < before:
            fs.delete(status.getPath(), True)
