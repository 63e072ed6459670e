"""Ordered work on keys of any share: each key's rows are cut at times, and what crosses a cut is a small table.

A key's rows are dealt by key and bucket of time, so a busy key is many tasks. What a bucket hands on (a total, a
last value, a summary of what it does to any state it may begin with) is one row a bucket; only these rows come
together by key.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a bucket, where the work itself sets none.
BUCKET = 3600
_LEAST = -(1 << 62)


def micros(name: str) -> Column:
    """Microseconds of a time, with or without zone (one without is read in the session's zone)."""
    return F.unix_micros(F.col(name).cast("timestamp"))


def bucket_of(us: Column, seconds: float = BUCKET) -> Column:
    """The bucket of a time; times that are null come first."""
    return F.coalesce(F.floor(us / F.lit(seconds * 1_000_000)).cast("long"), F.lit(_LEAST))


def _with(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of ``table``, one row a key at most; null keys are keys."""
    table = table.select(*[F.col(k).alias(f"_of_{k}") for k in keys], *[c for c in table.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    out = rows.join(table, same, "left")
    return out.drop(*[f"_of_{k}" for k in keys])


def running_count(rows: DataFrame, key: str, counted: Column, order: list[str], out: str, bucket: str = "_bucket") -> DataFrame:
    """``rows`` with how many of its key's rows up to itself are ``counted``: by bucket, plus the buckets before."""
    rows = rows.withColumn("_one", counted.cast("long"))
    totals = rows.groupBy(key, bucket).agg(F.sum("_one").alias("_total"))
    before = F.sum("_total").over(Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select(key, bucket, F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.sum("_one").over(Window.partitionBy(key, bucket).orderBy(*order))
    return _with(rows.withColumn("_own", own), totals, [key, bucket]).withColumn(out, F.col("_before") + F.col("_own")).drop("_one", "_own", "_before")


def last_before(rows: DataFrame, key: str, value: str, order: list[str], out: str, including: bool, bucket: str = "_bucket") -> DataFrame:
    """``rows`` with the newest value that isn't null among its key's rows before it, or up to itself: from its bucket, else
    from the newest bucket before that has one. ``value`` is a struct, so that a null in it is a value."""
    newest = F.max(F.when(F.col(value).isNotNull(), F.struct(*order, F.col(value).alias("_v"))))["_v"]
    totals = rows.groupBy(key, bucket).agg(newest.alias("_newest"))
    carried = F.last("_newest", ignorenulls=True).over(Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select(key, bucket, carried.alias("_carried"))
    own = F.last(value, ignorenulls=True).over(Window.partitionBy(key, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if including else -1))
    return _with(rows.withColumn("_own", own), totals, [key, bucket]).withColumn(out, F.coalesce("_own", "_carried")).drop("_own", "_carried")


def parts_in_order(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """(key, rows) of runs of equal keys, the first columns, in batches that are sorted by them; a key may come in several runs."""
    for batch in batches:
        names = list(zip(*(batch.column(k).to_pylist() for k in range(keys))))
        at = 0
        while at < len(names):
            end = at + 1
            while end < len(names) and names[end] == names[at]:
                end += 1
            yield names[at], batch.slice(at, end - at)
            at = end


class Orbits:
    """What a stretch of sorted times makes of any "not before x" it may begin with: the first time from x on is taken, and
    the next may come ``wait`` later. Starting values that have come to the same are one piece: (intervals of x, value)."""

    def __init__(self, begin: int, wait: int):
        self.wait, self.reach, self.most = wait, _LEAST, begin + wait  # x beyond ``most`` can't begin here; beyond ``reach`` x is still itself
        self.pieces: deque[tuple[list[tuple[int, int]], int]] = deque()

    def add(self, times: list[int]) -> None:
        at = 0
        while at < len(times):
            t = times[at]
            merged: list[tuple[int, int]] = []
            while self.pieces and self.pieces[0][1] <= t:
                merged += self.pieces.popleft()[0]
            if self.reach < self.most:
                upto = min(t, self.most)
                if upto > self.reach:
                    merged.append((self.reach, upto))
                    self.reach = upto
            if merged:
                joined: list[tuple[int, int]] = []
                for low, high in sorted(merged):
                    if joined and joined[-1][1] == low:
                        joined[-1] = (joined[-1][0], high)
                    else:
                        joined.append((low, high))
                self.pieces.append((joined, t + self.wait))
            # nothing changes before the first piece's value, once all starting values are in pieces
            at = bisect_left(times, self.pieces[0][1], at + 1) if self.reach >= self.most else at + 1

    def table(self) -> list[tuple[int, int, int]]:
        """(low, high, value): x in (low, high] becomes value; any other x stays."""
        return sorted((low, high, value) for intervals, value in self.pieces for low, high in intervals)


def spaced(rows: DataFrame, keys: list[str], seconds: int, span: int = 64) -> DataFrame:
    """Of the times (keys, _us) those that are taken: a key's first, and from then on the first that is at least
    ``seconds`` after the last one taken. A key's times are cut every ``span`` * ``seconds``: each stretch is summed up for
    whatever it may begin with, the summaries are followed in order, and then each stretch takes its times."""
    wait = seconds * 1_000_000
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    n = len(keys)
    rows = rows.where("_us IS NOT NULL").select(*keys, bucket_of(F.col("_us"), seconds * span).alias("_part"), "_us")

    def sum_up(batches):
        def row(key, orbits):
            low, high, value = ([list(c)] for c in zip(*orbits.table())) if orbits.pieces else ([[]],) * 3
            return key, low[0], high[0], value[0]

        now, orbits, out = None, None, []
        for key, part in parts_in_order(batches, n + 1):
            if key != now:
                if now is not None:
                    out.append(row(now, orbits))
                now, orbits = key, Orbits(key[-1] * wait * span, wait)
            orbits.add(part.column(n + 1).to_pylist())
            if len(out) >= 1000:
                yield from batch_of(out)
                out = []
        if now is not None:
            yield from batch_of([*out, row(now, orbits)])

    def batch_of(out):
        key, low, high, value = zip(*out)
        columns = [pa.array(c, t) for c, t in zip(zip(*key), types)] + [pa.array(c, pa.list_(pa.int64())) for c in (low, high, value)]
        yield pa.RecordBatch.from_arrays(columns, names=[*keys, "_part", "low", "high", "value"])

    from pyspark.sql.pandas.types import to_arrow_type

    types = [*(to_arrow_type(f.dataType) for f in rows.select(*keys).schema), pa.int64()]

    def follow(batches):
        now, x = None, _LEAST + 1
        for key, part in parts_in_order(batches, n):
            if key != now:
                now, x = key, _LEAST + 1
            begins = []
            for low, high, value in zip(*(part.column(k).to_pylist() for k in (n + 1, n + 2, n + 3))):
                begins.append(x)
                k = bisect_left(high, x)
                if k < len(high) and low[k] < x:
                    x = value[k]
            yield pa.RecordBatch.from_arrays([*part.columns[: n + 1], pa.array(begins, pa.int64())], names=[*keys, "_part", "_from"])

    def take(batches):
        now, x = None, 0
        for key, part in parts_in_order(batches, n + 1):
            begin, times = part.column(n + 1)[0].as_py(), part.column(n + 2).to_pylist()
            if key != now:
                now, x, times = key, begin, times[1:]  # the row with the beginning comes first
            taken, at = [], bisect_left(times, x)
            while at < len(times):
                x = times[at] + wait
                taken.append(times[at])
                at = bisect_left(times, x, at + 1)
            if taken:
                yield pa.RecordBatch.from_arrays([*(pa.array([k] * len(taken), t) for k, t in zip(key[:n], types)), pa.array(taken, pa.int64())], names=[*keys, "_us"])

    by = [*keys, "_part"]
    summaries = rows.repartition(*by).sortWithinPartitions(*by, "_us").mapInArrow(sum_up, f"{names}, _part long, low array<bigint>, high array<bigint>, value array<bigint>")
    begins = summaries.repartition(*keys).sortWithinPartitions(*by).mapInArrow(follow, f"{names}, _part long, _from long")
    both = rows.select(*by, F.lit(None).cast("long").alias("_from"), "_us").unionByName(begins.select(*by, "_from", F.lit(_LEAST).alias("_us")))
    return both.repartition(*by).sortWithinPartitions(*by, "_us").mapInArrow(take, f"{names}, _us long")


def independent_parts(rows: DataFrame, key: str, seconds: float) -> DataFrame:
    """``rows`` (key, _us) with _part: the number of pauses of more than ``seconds`` in the key before the row. Pauses are
    looked for between buckets of that length, so none is missed that has an end in another bucket."""
    rows = rows.withColumn("_bucket", bucket_of(F.col("_us"), seconds))
    ends = rows.groupBy(key, "_bucket").agg(F.min("_us").alias("_first"), F.max("_us").alias("_last"))
    order = Window.partitionBy(key).orderBy("_bucket")
    pause = (F.col("_first") - F.lag("_last").over(order) > int(seconds * 1_000_000)).cast("long")
    ends = ends.withColumn("_pause", F.coalesce(pause, F.lit(0))).withColumn("_part", F.sum("_pause").over(order)).select(key, "_bucket", "_part")
    return _with(rows, ends, [key, "_bucket"]).drop("_bucket")


def clamped_sums(changes: DataFrame, key: str, step: str, order: list[str], most: int, bucket: str = "_bucket") -> DataFrame:
    """(key, total) of steps in order, the sum being kept between 0 and ``most`` after each. What a bucket does to any sum
    x is max(low, x + shift) cut at high; such summaries follow each other to one of the same kind."""
    whole = F.struct(F.lit(_LEAST).alias("low"), F.lit(-_LEAST).alias("high"), F.lit(0).cast("long").alias("shift"))
    within = lambda c: F.greatest(F.lit(0).cast("long"), F.least(F.lit(most).cast("long"), c))

    def and_then(a, s):
        return F.struct(within(a["low"] + s).alias("low"), within(a["high"] + s).alias("high"), (a["shift"] + s).alias("shift"))

    ordered = F.array_sort(F.collect_list(F.struct(*order, F.col(step).cast("long").alias("_step"))))
    summaries = changes.groupBy(key, bucket).agg(ordered.alias("_s")).select(key, bucket, F.aggregate("_s", whole, lambda a, s: and_then(a, s["_step"])).alias("f"))
    total = F.aggregate("_f", F.lit(0).cast("long"), lambda x, f: F.least(f["f"]["high"], F.greatest(f["f"]["low"], x + f["f"]["shift"])))
    return summaries.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(bucket, "f"))).alias("_f")).select(key, total.alias("total"))


def exact_rank(rows: DataFrame, by: str, value: str, rank: Column, bins: int = 1024) -> DataFrame:
    """(by, value) of each group's row at ``rank``, from 0, a column of the group's size n. Two histograms find the bin that holds it;
    only that bin's distinct values are put in order. Values that aren't finite are at the ends, NaN last."""
    finite = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), F.col(value))
    ends = rows.groupBy(by).agg(F.count(value).alias("n"), F.min(finite).alias("_low"), F.max(finite).alias("_high")).withColumn("_rank", rank)

    def narrowed(rows: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows of the bin that holds the rank, and its ends with the rank in it."""
        scale = F.when(F.col("_high") > F.col("_low"), (F.col(value) - F.col("_low")) / (F.col("_high") - F.col("_low")) * bins)
        bin_ = F.when(F.isnan(value) | (F.col(value) > F.col("_high")), bins + 1).when(F.col(value) < F.col("_low"), -1).otherwise(F.coalesce(F.least(F.floor(scale), F.lit(bins)), F.lit(0)))
        rows = _with(rows, found, [by]).withColumn("_bin", bin_.cast("int"))
        counts = rows.groupBy(by, "_bin").agg(F.count(F.lit(1)).alias("_k"), F.min(finite).alias("_low"), F.max(finite).alias("_high"), F.first("_rank").alias("_rank"))
        upto = F.sum("_k").over(Window.partitionBy(by).orderBy("_bin"))  # over bins
        at = counts.withColumn("_upto", upto).where((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_k")))
        at = at.select(by, F.col("_bin").alias("_hit"), "_low", "_high", (F.col("_rank") - F.col("_upto") + F.col("_k")).alias("_rank"))
        rows = _with(rows.drop("_low", "_high", "_rank", "n"), at, [by]).where("_bin = _hit")
        return rows.select(by, value), at.drop("_hit")

    rows = rows.where(F.col(value).isNotNull()).select(by, value)
    rows, found = narrowed(rows, ends)
    rows, found = narrowed(rows, found)
    last = rows.groupBy(by, value).agg(F.count(F.lit(1)).alias("_k")).withColumn("_upto", F.sum("_k").over(Window.partitionBy(by).orderBy(value)))
    return _with(last, found.select(by, "_rank"), [by]).where((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_k"))).select(by, value)
