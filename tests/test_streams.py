"""State of streams against plain passes: array work of one batch, restarts between batches, expiry; versions of the feed set."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta, timezone
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from threatloom.operators import events
from threatloom.streaming import streams

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
KINDS = ["entry", "redirect", "credential", "mfa", "oauth", "token"]


def at(seconds):
    return START + timedelta(seconds=seconds)


def plain_flags(steps):
    """Flags of ordered steps (us, seq, kind, origin, post_origin, in_iframe)."""
    origins = {s[3] for s in steps}
    creds = [s for s in steps if s[2] in ("credential", "mfa")]
    issuers, tokens = ({s[3] for s in steps if s[2] == k} for k in ("oauth", "token"))
    entry = next((s for s in steps if s[2] == "entry"), None)
    first = {k: next((s for s in creds if s[2] == k), None) for k in ("credential", "mfa")}
    enough = len(steps) >= 2
    return (
        enough and any(s[4] and s[4] not in origins for s in creds),
        enough and bool(issuers) and bool(tokens - issuers),
        enough and entry is not None and any(s[5] and s[3] != entry[3] for s in creds),
        enough and len({s[3] for s in steps if s[2] == "redirect"}) >= 4,
        enough and all(first.values()) and first["credential"][3] != first["mfa"][3],
    )


@pytest.mark.parametrize("seed", range(12))
def test_flow_flags(seed):
    rng = random.Random(seed)
    keep, ttl = rng.choice([3, 10, 64]), rng.choice([5, 60, 10_000])
    us = sorted(rng.randrange(2000) for _ in range(150))
    steps = [(t, i, rng.choice(KINDS), f"o{rng.randrange(6)}", rng.choice(["", "o1", "p1", "p2"]), rng.random() < 0.3) for i, t in enumerate(us)]
    columns = [np.array(c, d) for c, d in zip(zip(*steps), (np.int64, np.int64, object, object, object, bool))]
    begin, flags = streams.flow_flags(columns[0], *columns[2:], ttl, keep)
    for i in range(len(steps)):
        own = [s for s in steps[: i + 1] if s[0] >= us[i] - ttl][-keep:]
        assert i - begin[i] + 1 == len(own)
        assert tuple(bool(flags[k][i]) for k in streams._FLAGS) == plain_flags(own), i


def test_chain_steps():
    rng = random.Random(1)
    for _ in range(200):
        kinds = [rng.choice(["navigate", "redirect", "redirect", "close"]) for _ in range(rng.randrange(1, 30))]
        number, hops = rng.choice([(0, 0), (3, 2)])
        got = streams.chain_steps(np.array(kinds, object), number, hops, 4)
        for i, kind in enumerate(kinds):
            if kind == "close":
                number, hops = 0, 0
                continue
            number, hops = (number + 1, 1) if kind == "navigate" else (number, min(4, hops + 1))
            assert (int(got[0][i]), int(got[1][i])) == (number, hops)


def run_in_parts(spark, tmp_path, rows, schema, operator, parts):
    """The stream run once for each part of the rows, from the checkpoint that the run before left."""
    for k in range(parts):
        spark.createDataFrame(rows[len(rows) * k // parts : len(rows) * (k + 1) // parts], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        streams.run_to(operator(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")), f"{tmp_path}/out")
    return spark.read.parquet(f"{tmp_path}/out").collect()


NAV = "tab_id long, ts timestamp, seq long, kind string"


def test_chains_after_restarts(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.randrange(4), at(10 * i), i, rng.choice(["navigate", "redirect", "redirect", "close"])) for i in range(240)]
    want, state = Counter(), defaultdict(lambda: (0, 0))
    for tab, _, seq, kind in rows:
        number, hops = state[tab]
        state[tab] = (0, 0) if kind == "close" else (number + 1, 1) if kind == "navigate" else (number, min(25, hops + 1))
        if kind != "close":
            want[tab, seq, *state[tab]] += 1
    assert Counter(map(tuple, run_in_parts(spark, tmp_path, rows, NAV, streams.redirect_chains, 3))) == want


def test_flows_after_restarts(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.randrange(3), i, at(20 * i), rng.choice(KINDS), f"o{rng.randrange(5)}", rng.choice([None, "o1", "p1"]), rng.random() < 0.3) for i in range(200)]
    held, want = defaultdict(list), {}
    for flow, seq, ts, kind, origin, post, frame in rows:
        held[flow] = [s for s in held[flow] if s[0] >= ts - timedelta(seconds=300)]
        held[flow] = [*held[flow], (ts, seq, kind, origin, post, frame)][-64:]
        want[seq] = (len(held[flow]), *plain_flags(held[flow]))
    schema = "flow_id long, seq long, ts timestamp, kind string, origin string, post_origin string, in_iframe boolean"
    got = run_in_parts(spark, tmp_path, rows, schema, streams.auth_flows, 2)
    assert {r["seq"]: (r["n_steps"], *(r[k] for k in streams._FLAGS)) for r in got} == want


def test_flags_of_flows_one_after_the_other():
    """Flows in one pass have the flags that each has alone, also with as many origins as steps."""
    rng = random.Random(21)
    for origins in (2, 6, 400):
        flows = []
        for _ in range(30):
            us = sorted(rng.randrange(1500) for _ in range(rng.randrange(1, 90)))
            flows.append([(t, i, rng.choice(KINDS), rng.choice([None, *(f"o{k}" for k in range(origins))]), rng.choice(["", "o1", "p1", f"o{rng.randrange(origins)}"]), rng.random() < 0.3) for i, t in enumerate(us)])
        columns = [np.array(c, d) for c, d in zip(zip(*(s for f in flows for s in f)), (np.int64, np.int64, object, object, object, bool))]
        starts = np.cumsum([0, *map(len, flows[:-1])])
        begin, flags = streams.flow_flags(columns[0], *columns[2:], 200, 12, starts)
        for start, steps in zip(starts, flows):
            for i in range(len(steps)):
                own = [s for s in steps[: i + 1] if s[0] >= steps[i][0] - 200][-12:]
                assert start + i - begin[start + i] + 1 == len(own)
                assert tuple(bool(flags[k][start + i]) for k in streams._FLAGS) == plain_flags(own)


def test_groups_of_flows_after_restarts(spark, tmp_path):
    """Many flows in three groups, some without an id, some with ids that no double holds."""
    rng = random.Random(22)
    ids = [None, *range(40), 2**60 + 1, 2**60 + 2, -5]
    rows = [(rng.choice(ids), i, at(2 * i + rng.randrange(2)), rng.choice(KINDS), f"o{rng.randrange(5)}", rng.choice([None, "o1", "p1"]), rng.random() < 0.3) for i in range(1500)]
    held, want = defaultdict(list), {}
    for flow, seq, ts, kind, origin, post, frame in rows:
        held[flow] = [*(s for s in held[flow] if s[0] >= ts - timedelta(seconds=300)), (ts, seq, kind, origin, post, frame)][-64:]
        want[seq] = (flow, len(held[flow]), *plain_flags(held[flow]))
    schema = "flow_id long, seq long, ts timestamp, kind string, origin string, post_origin string, in_iframe boolean"
    got = run_in_parts(spark, tmp_path, rows, schema, lambda s: streams.auth_flows(s, groups=3), 3)
    assert len(got) == len(want) and {r["seq"]: (r["flow_id"], r["n_steps"], *(r[k] for k in streams._FLAGS)) for r in got} == want


def test_one_call_takes_all_flows_of_a_group():
    """Its state holds the steps that still count, of flows without new steps too, until the watermark passes them."""
    import pandas as pd

    class Kept:
        rows, timers, watermark = None, set(), 0

        def exists(self):
            return self.rows is not None

        def get(self):
            return self.rows

        def put(self, rows):
            self.rows = list(rows)

        update = put

        def clear(self):
            self.rows = None

        def getListState(self, *_):
            return self

        def getValueState(self, *_):
            return Kept()

        def registerTimer(self, ms):
            self.timers.add(ms)

        def deleteTimer(self, ms):
            self.timers.discard(ms)

        def getCurrentWatermarkInMs(self):
            return self.watermark

    kept, flows = Kept(), streams._Flows(4, 300)
    flows.init(kept)

    def call(rows):
        frame = pd.DataFrame([(f, i, START.replace(tzinfo=None) + timedelta(seconds=s), "entry", "o", None, False) for i, (f, s) in enumerate(rows)], columns=["flow", "seq", "ts", "kind", "origin", "post_origin", "in_iframe"])
        return sorted(tuple(r) for r in pd.concat(list(flows.handleInputRows((0,), iter([frame[:3], frame[3:]]), kept)))[["flow", "seq", "n_steps"]].itertuples(index=False))

    assert call([("a", 10), ("b", 0), ("a", 0), ("b", 20), ("a", 900), *(("c", 880 + i) for i in range(6))]) == [("a", 0, 2), ("a", 2, 1), ("a", 4, 1), ("b", 1, 1), ("b", 3, 2), *(("c", 5 + i, min(4, i + 1)) for i in range(6))]
    assert Counter(r[0] for r in kept.rows) == {"a": 1, "b": 2, "c": 4} and len(kept.timers) == 1
    kept.watermark = int(at(800).timestamp() * 1000)
    assert call([("a", 1000)]) == [("a", 0, 2)]
    assert Counter(r[0] for r in kept.rows) == {"a": 2, "c": 4} and kept.timers == {int(at(1300).timestamp() * 1000)}


def test_state_expires(spark, tmp_path):
    """A tab's numbers start anew once the watermark has passed its last event by the time to live; others go on."""
    rows = [(1, at(0), 0, "navigate"), (1, at(5), 1, "navigate"), (2, at(10), 2, "navigate"), (2, at(9000), 3, "redirect"), (2, at(9100), 4, "redirect"), (1, at(9200), 5, "redirect")]
    got = run_in_parts(spark, tmp_path, rows, NAV, lambda s: streams.redirect_chains(s, ttl=600, delay="1 second"), 6)
    assert sorted((r["seq"], r["chain_no"], r["n_hops"]) for r in got) == [(0, 1, 1), (1, 2, 1), (2, 1, 1), (3, 1, 2), (4, 1, 3), (5, 0, 1)]


def test_cooldown_after_restarts(spark, tmp_path):
    rng = random.Random(5)
    rows = sorted(((rng.choice("ab"), "k", at(rng.randrange(20_000))) for _ in range(150)), key=lambda r: r[2])
    schema = "host string, kind string, ts timestamp"
    got = run_in_parts(spark, tmp_path, rows, schema, lambda s: streams.cooldown(s, 900, "6 hours"), 3)
    want = events.cooldown(spark.createDataFrame(rows, schema), 900).collect()
    assert sorted((r["host"], r["ts"]) for r in got) == sorted((r["host"], r["ts"]) for r in want)


FEED = "feed_ord long, line_no long, line string"


def test_feed_versions(spark, tmp_path):
    """The set after each batch is that of all lines so far; a batch writes what changes; old versions go."""
    path, source, lines = f"{tmp_path}/sets", f"{tmp_path}/lines", []
    for number in range(8):
        new = [(number % 3, 100 * number + i, f"h{number}x{i}.example") for i in range(400 if number == 0 else 5)] + [(0, 100 * number + 50, "h0x1.example")]
        lines += [(number, *r) for r in new]
        spark.createDataFrame(new, FEED).coalesce(1).write.mode("append").parquet(source)
        streams.feeds_to(spark, spark.readStream.schema(FEED).parquet(source), path, cap=425, compact_after=3)
        first = {}
        for b, ordinal, line, host in lines:
            first[host] = min(first.get(host, (9, 9, 9)), (b, ordinal, line))
        want = set(sorted(first, key=lambda h: (first[h], h))[:425])
        assert {r["host"] for r in streams.feed_set(spark, path).collect()} == want
        written = spark.read.schema("host string").parquet(f"{path}/batch={number}").count()
        assert written == (400 if number == 0 else len(want) if number % 4 == 0 else 5 if number < 6 else 0)
    assert streams.feed_set(spark, path, 5).count() == 425
    streams.vacuum(spark, path, 4)
    assert sorted(p.name for p in Path(path).glob("batch=*")) == [f"batch={i}" for i in range(4, 8)]
    assert {r["host"] for r in streams.feed_set(spark, path).collect()} == want
    assert spark.read.parquet(f"{path}/batch=4").where(F.col("change") == "full").count() == 420
