"""The fixed-window limiter in batch form, exact, without a task that holds a source.

A source's window begins with the first request after the previous window's
end, so every window depends on the one before it. The chain is solved by
pointer doubling: each request time points to the first one that lies behind
a window begun there (its successor); the successor of the successor is found
by a join, and so on with doubled steps; marks then run from each source's
first request down the levels. After ``log2`` of the longest chain's length
rounds of joins every window is known, and each request finds its own.

Nothing is gathered by source: successors are found inside (source, time
slot) with slots of one window's length, at most one window begins in a slot,
and ranks inside a window are taken in salted parts first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanforge.session import checkpoint_dir

_SALTS = 64


def _kept(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _nearest_above(points: DataFrame, asked: DataFrame, keys: list[str], x: str, value: str) -> DataFrame:
    """For each row of ``asked`` the ``value`` of the point with the least ``x`` above its own, among equal ``keys`` (else NULL).
    ``asked`` rows come back with ``_found``. One running window from the highest ``x`` down."""
    rest = [c for c in asked.columns if c not in (*keys, x)]
    rows = points.select(*keys, x, F.col(value).alias("_v"), *(F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in rest), F.lit(False).alias("_ask"))
    rows = rows.unionByName(asked.select(*keys, x, F.lit(None).cast(points.schema[value].dataType).alias("_v"), *rest, F.lit(True).alias("_ask")))
    down = Window.partitionBy(*keys).orderBy(F.desc(x), F.desc("_ask")).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_found", F.last("_v", ignorenulls=True).over(down)).where("_ask").select(*keys, x, *rest, "_found")


def successors(times: DataFrame, width: int) -> DataFrame:
    """times (_s, _t) -> links (_s, _t, _next): the first time above ``_t + width`` of the same source, where there is one."""
    slotted = times.withColumn("_slot", F.floor(F.col("_t") / width))
    ends = slotted.select("_s", (F.col("_slot") + 1).alias("_slot"), (F.col("_t") + width).alias("_x"), F.col("_t").alias("_from"))
    same = _nearest_above(slotted.select("_s", "_slot", F.col("_t").alias("_x")), ends, ["_s", "_slot"], "_x", "_x")
    # behind the end's own slot: the first time of the source's next slot that has any; one row a slot
    firsts = slotted.groupBy("_s", "_slot").agg(F.min("_t").alias("_first"))
    later = _nearest_above(firsts, firsts.select("_s", (F.col("_slot") + 1).alias("_slot")).distinct(), ["_s"], "_slot", "_first")
    later = later.select("_s", "_slot", F.col("_found").alias("_later"))
    linked = same.join(later, ["_s", "_slot"], "left")
    return linked.select("_s", F.col("_from").alias("_t"), F.coalesce("_found", "_later").alias("_next")).where("_next IS NOT NULL")


def window_starts(times: DataFrame, width: int) -> DataFrame:
    """times (_s, _t), distinct -> (_s, _t) of those that begin a window."""
    levels = [_kept(successors(times, width))]
    while True:
        a, b = levels[-1], levels[-1]
        far = b.select("_s", F.col("_t").alias("_next"), F.col("_next").alias("_far"))
        twice = _kept(a.join(far, ["_s", "_next"]).select("_s", "_t", F.col("_far").alias("_next")))
        if twice.isEmpty():
            break
        levels.append(twice)
    marked = times.groupBy("_s").agg(F.min("_t").alias("_t"))
    for level in reversed(levels):
        marked = _kept(marked.unionByName(marked.join(level, ["_s", "_t"]).select("_s", F.col("_next").alias("_t"))))
    return marked


def _micros(c) -> F.Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def request_windows(events: DataFrame, window_seconds: float = 60, key: str = "source", ts_col: str = "ts") -> DataFrame:
    """Adds ``window_start`` (microseconds) to every request; a null source is a source, a request without a time has no window."""
    width = round(window_seconds * 1_000_000)
    rows = events.withColumn("_s", F.struct(F.col(key))).withColumn("_t", _micros(ts_col))
    starts = window_starts(rows.select("_s", "_t").where("_t IS NOT NULL").distinct(), width)
    slot = F.floor(F.col("_t") / width)
    # a request's window began in its own slot or in the one before; no slot has two
    near = starts.select("_s", slot.alias("_slot"), F.col("_t").alias("_own"), F.lit(None).cast("bigint").alias("_before"))
    near = near.unionByName(starts.select("_s", (slot + 1).alias("_slot"), F.lit(None).cast("bigint").alias("_own"), F.col("_t").alias("_before")))
    near = near.groupBy("_s", "_slot").agg(F.max("_own").alias("_own"), F.max("_before").alias("_before"))
    found = rows.withColumn("_slot", slot).join(near, ["_s", "_slot"], "left")
    start = F.when(F.col("_own") <= F.col("_t"), F.col("_own")).otherwise(F.col("_before"))
    return found.withColumn("window_start", start).drop("_own", "_before", "_slot", "_t")


def rate_limit(events: DataFrame, n: int = 60, window_seconds: float = 60, key: str = "source", ts_col: str = "ts", order=()) -> DataFrame:
    """Requests that the limiter lets through: the first ``n`` of every window by time, then by ``order`` (default: the first other column).

    A window begins with a source's first request, or the first after the
    previous window's end (start + ``window_seconds``; a request at that very
    moment is still inside). Requests without a time are not let through.
    """
    tie = list(order) or [c for c in events.columns if c not in (key, ts_col)][:1]
    rows = request_windows(events, window_seconds, key, ts_col).where("window_start IS NOT NULL")
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(ts_col, *tie), F.lit(_SALTS)))
    for part in (["_s", "window_start", "_salt"], ["_s", "window_start"]):
        rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*part).orderBy(ts_col, *tie))).where(F.col("_r") <= n)
    return rows.drop("_r", "_salt", "_s")
