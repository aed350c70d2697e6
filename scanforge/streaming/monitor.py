"""Monitoring as stateless filters + keyed state.

Stateless checks (signature, ref parsing, validation, watched branch) are
plain column expressions and run unchanged on batch or streaming frames.
Stateful parts: the limiter (per-source token window; in batch ``limiter.py``) and ``head_changes``
(last successfully scanned SHA per repo/branch). ``incremental_scan`` runs a
scan per micro-batch in ``foreachBatch`` with a checkpoint, so a failed scan
is retried and a replayed batch is written idempotently.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanforge.constants import PRIVATE_CIDRS
from scanforge.functions.text import hmac_sha256_hex

BRANCH_RX = r"\A[a-zA-Z0-9._/\-]+\z"
REPO_RX = r"\A[a-zA-Z0-9._\-]+/[a-zA-Z0-9._\-]+\z"


def valid_branch(c) -> Column:
    b = F.col(c) if isinstance(c, str) else c
    return (F.coalesce(b, F.lit("")) != "") & (F.octet_length(b) <= 255) & b.rlike(BRANCH_RX) \
        & ~b.contains("..") & ~b.startswith("/") & ~b.endswith("/")


def valid_repo(c) -> Column:
    r = F.col(c) if isinstance(c, str) else c
    return F.coalesce(r.rlike(REPO_RX), F.lit(False))


def verify_push(pushes: DataFrame, secret: str, platform_col: str = "platform",
                payload_col: str = "payload", signature_col: str = "signature") -> DataFrame:
    """Accept a push when its signature verifies: ``sha256=<hex>`` equal to
    the HMAC-SHA-256 of the body (HMAC platforms) or a token equal to the
    secret (token platforms). An empty secret rejects everything."""
    if not secret:
        return pushes.where(F.lit(False))
    sig = F.coalesce(F.col(signature_col), F.lit(""))
    hmac_ok = sig.startswith("sha256=") & (F.lower(F.substring(sig, 8, 1 << 30)) == hmac_sha256_hex(secret, F.col(payload_col)))
    token_ok = sig == F.lit(secret)
    plat = F.col(platform_col) if platform_col in pushes.columns else F.lit("github")
    return pushes.where(F.when(plat == "gitlab", token_ok).otherwise(hmac_ok))


def push_branch(pushes: DataFrame, payload_col: str = "payload") -> DataFrame:
    """Branch from the JSON ``ref`` (must start refs/heads/ and be a valid
    branch name); other pushes are dropped, and payloads that are not one
    whole JSON document."""
    body = F.col(payload_col)
    # the parsers stop behind the first value; inside a list and inside an object, other text is an error
    whole = (F.json_array_length(F.concat(F.lit("["), body, F.lit("]"))) == 1) & F.try_parse_json(F.concat(F.lit('{"p":'), body, F.lit("}"))).isNotNull()
    doc = F.when(whole, F.try_parse_json(body))
    ref = F.when(F.call_function("schema_of_variant", F.try_variant_get(doc, "$.ref", "variant")) == "STRING", F.try_variant_get(doc, "$.ref", "string"))
    branch = F.when(ref.startswith("refs/heads/"), F.substring(ref, 12, 1 << 30))
    return pushes.withColumn("branch", branch).where(valid_branch(F.col("branch")))


def target_branch(pushes: DataFrame, watch) -> DataFrame:
    """Keep pushes to the watched branch: a name, or a (repo, branch) table
    (semi-join)."""
    if isinstance(watch, str):
        return pushes.where(F.col("branch") == watch)
    return pushes.join(watch.select("repo", "branch").distinct(), ["repo", "branch"], "left_semi")


def rate_limit_tumbling(events: DataFrame, n: int = 60, window: str = "1 minute", key_cols=("source",),
                        ts_col: str = "ts", salts: int = 64) -> DataFrame:
    """Batch approximation with clock-aligned windows: the first ``n`` by time
    per key and window. The limiter proper, whose window starts at the first
    request after expiry, is ``limiter.rate_limit``. Ranked inside (key, window,
    salt) first, so one busy source is ranked by many tasks."""
    rest = [c for c in events.columns if c != ts_col][:1]
    out = events.withColumn("_w", F.window(F.col(ts_col), window).start).withColumn("_salt", F.pmod(F.xxhash64(ts_col, *rest), F.lit(salts)))
    for keys in ([*key_cols, "_w", "_salt"], [*key_cols, "_w"]):
        win = Window.partitionBy(*keys).orderBy(ts_col, *rest)
        out = out.withColumn("_r", F.row_number().over(win)).where(F.col("_r") <= n)
    return out.drop("_r", "_w", "_salt")


def _let_through(times, used: int, end: int, n: int, width: int):
    """Which of the sorted ``times`` pass, and (used, end) after them: one step a window, not one a request."""
    import numpy as np

    keep, at = np.zeros(len(times), bool), 0
    while at < len(times):
        if times[at] > end:
            used, end = 0, int(times[at]) + width
        upto = int(np.searchsorted(times, end, "right"))
        free = min(max(n - used, 0), upto - at)
        keep[at:at + free] = True
        used += free
        at = upto
    return keep, used, end


_NEVER = -(1 << 62)


def _limiter(n: int, width: int, fields: list[str]):
    from pyspark.sql.streaming import StatefulProcessor

    class Limiter(StatefulProcessor):
        """State of a source: (used, end of its window); a timer at the window's end clears it."""

        def init(self, handle):
            self.handle = handle
            self.window = handle.getValueState("window", "used long, end long")

        def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
            import pandas as pd

            chunks = [p for p in rows if len(p)]
            if not chunks:
                return
            held = self.window.get() if self.window.exists() else (0, _NEVER)
            batch = pd.concat(chunks, ignore_index=True).set_axis([*fields, "_t"], axis=1).sort_values(["_t", fields[2]], kind="stable")
            keep, used, end = _let_through(batch["_t"].to_numpy(), int(held[0]), int(held[1]), n, width)
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.window.update((used, end))
            self.handle.registerTimer(-(-end // 1000))
            if keep.any():
                yield batch.loc[keep, fields]

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
            # the watermark passed the window's end: a later request begins a new one anyway
            self.window.clear()
            return iter(())

        def close(self):
            pass

    return Limiter()


def rate_limit_stream(events: DataFrame, n: int = 60, window_seconds: float = 60, key: str = "source",
                      ts_col: str = "ts", id_col: str | None = None, watermark: str = "10 minutes") -> DataFrame:
    """Streaming form of the exact limiter: (key, ts, id) of the requests let
    through; join them with the rows where more is needed.

    Only source, time and id pass the state operator (``transformWithState``
    on the RocksDB store, which this sets). The state of a source is
    (used, window end), cleared by a timer when the watermark passes the end.
    A micro-batch's requests of one source are sorted in one task, 24 bytes
    each: bound the batch at the source (``maxFilesPerTrigger``,
    ``maxBytesPerTrigger``). The batch form (``limiter.rate_limit``) has no
    such task. Requests without a time are not let through, those behind the
    watermark are late and dropped by Spark.
    """
    id_col = id_col or [c for c in events.columns if c not in (key, ts_col)][0]
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    fields = [key, ts_col, id_col]
    rows = events.where(F.col(ts_col).isNotNull()).withWatermark(ts_col, watermark).select(*fields)
    timed = rows.withColumn("_t", F.unix_micros(F.col(ts_col).cast("timestamp")))
    return timed.groupBy(key).transformWithStateInPandas(_limiter(n, round(window_seconds * 1_000_000), fields), outputStructType=rows.schema,
                                                         outputMode="Append", timeMode="EventTime")


def head_changes(observations: DataFrame, key_cols=("repo", "branch"), ts_col: str = "ts",
                 sha_col: str = "sha", bucket: str = "1 day") -> DataFrame:
    """Batch form: observations whose SHA differs from the previous
    observation of the same repo/branch (the first observation counts).

    Exact global ``lag`` computed in two levels so that one very active
    branch is not a single task: the lag inside (key, time bucket) windows,
    and for each bucket's first row the last SHA of the key's previous
    non-empty bucket (a one-row-per-bucket table)."""
    keys = list(key_cols)
    b = F.window(F.col(ts_col), bucket).start
    obs = observations.withColumn("_bucket", b)
    order = [F.col(ts_col)] + [F.col(c) for c in observations.columns if c not in keys + [ts_col]][:1]
    w_in = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    obs = obs.withColumn("_prev_in", F.lag(sha_col).over(w_in)).withColumn("_rn", F.row_number().over(w_in))
    last = obs.groupBy(*keys, "_bucket").agg(F.max_by(F.col(sha_col), F.struct(*order)).alias("_last"))
    w_b = Window.partitionBy(*keys).orderBy("_bucket")
    carry = last.withColumn("_prev_bucket", F.lag("_last").over(w_b)).select(*keys, "_bucket", "_prev_bucket")
    j = obs.join(carry, keys + ["_bucket"], "left")
    prev = F.when(F.col("_rn") == 1, F.col("_prev_bucket")).otherwise(F.col("_prev_in"))
    return (j.withColumn("prev_sha", prev).where(~F.col(sha_col).eqNullSafe(F.col("prev_sha")))
            .drop("_bucket", "_prev_in", "_rn", "_prev_bucket"))


_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_IPV4 = rf"\A{_OCTET}(?:\.{_OCTET}){{3}}\z"


def _ipv4_number(c: Column) -> Column:
    """Number of a dotted address (no leading zeros, each part at most 255), NULL for other text."""
    parts = F.split(c, r"\.")
    value = parts[0].try_cast("long")
    for k in (1, 2, 3):
        value = value * 256 + F.get(parts, F.lit(k)).try_cast("long")
    return F.when(c.rlike(_IPV4), value)


def _ipv6_groups(ip: Column) -> Column:
    """The eight 16-bit groups of an IPv6 address (``::`` expanded, an IPv4 tail read as two groups), NULL for other text."""
    s = F.lower(ip)
    tail = F.regexp_extract(s, r"(?::)([0-9]+\.[0-9.]+)\z", 1)
    number = _ipv4_number(tail)
    hexed = F.lower(F.concat(F.conv(F.floor(number / 65536).cast("string"), 10, 16), F.lit(":"), F.conv((number % 65536).cast("string"), 10, 16)))
    s = F.when(tail == "", s).otherwise(F.concat(F.substr(s, F.lit(1), F.length(s) - F.length(tail)), hexed))
    gap = s.contains("::")
    shape = s.rlike(r"\A(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?(?:::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?)?\z")
    halves = F.split(s, "::", 2)
    left = F.filter(F.split(halves[0], ":"), lambda x: x != "")
    right = F.filter(F.split(F.coalesce(F.get(halves, F.lit(1)), F.lit("")), ":"), lambda x: x != "")
    n = F.size(left) + F.size(right)
    whole = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - n, F.lit(0))), right)
    ok = shape & s.contains(":") & F.when(gap, n <= 7).otherwise(n == 8)
    return F.when(ok, F.transform(whole, lambda g: F.conv(g, 16, 10).cast("long")))


def _in_private_blocks(v4: Column, groups: Column) -> Column:
    inside = F.lit(False)
    for cidr in PRIVATE_CIDRS:
        net = ipaddress.ip_network(cidr)
        if net.version == 4:
            inside = inside | v4.between(int(net.network_address), int(net.broadcast_address))
        else:
            low, high = int(net.network_address), int(net.broadcast_address)
            fit = v4.isNull()
            for k in range(8):  # both ends agree up to the prefix, so the groups are tested one by one
                a, b = low >> (112 - 16 * k) & 0xFFFF, high >> (112 - 16 * k) & 0xFFFF
                if (a, b) != (0, 0xFFFF):
                    fit = fit & F.get(groups, F.lit(k)).between(a, b)
            inside = inside | F.coalesce(fit, F.lit(False))
    return F.coalesce(inside, F.lit(False))


def private_address(ips: DataFrame, ip_col: str = "ip") -> DataFrame:
    """Add ``private``: membership in the private, loopback and link-local
    blocks; False for text that is no address. The blocks are literal ranges:
    no join. A mapped IPv4 address (::ffff:a.b.c.d) counts as that address."""
    ip = F.col(ip_col)
    mapped = F.forall(F.slice("_g", 1, 5), lambda g: g == 0) & (F.get("_g", F.lit(5)) == 65535)
    v4 = F.coalesce(_ipv4_number(ip), F.when(mapped, F.get("_g", F.lit(6)) * 65536 + F.get("_g", F.lit(7))))
    # each step is used many times in the next one: kept as columns
    read = ips.withColumn("_g", F.when(ip.contains(":"), _ipv6_groups(ip))).withColumn("_v4", v4)
    return read.withColumn("private", _in_private_blocks(F.col("_v4"), F.col("_g"))).drop("_g", "_v4")


def _address_bits(df: DataFrame, blocks: bool) -> DataFrame:
    """(text) -> text, _family (4, 6), _hi, _lo (the address as two longs; IPv4: the top 32 bits of _hi) and, of blocks, _len.
    Text that is none is left out; a mapped IPv4 address (::ffff:a.b.c.d) is that address, and a block of such is one of IPv4."""
    import pyarrow as pa

    def read(text: str) -> tuple | None:
        head, slash, size = text.partition("/")
        if "%" in head or slash and not (blocks and size.isascii() and size.isdigit() and len(size) <= 3):
            return None
        try:
            a = ipaddress.ip_address(head)
        except ValueError:
            return None
        n = int(size) if slash else a.max_prefixlen
        if n > a.max_prefixlen:
            return None
        if a.version == 6 and a.ipv4_mapped is not None and n >= 96:
            a, n = a.ipv4_mapped, n - 96
        bits = int(a) << (96 if a.version == 4 else 0)
        signed = [x - (1 << 64) if x >> 63 else x for x in (bits >> 64, bits & (1 << 64) - 1)]
        return (text, a.version, *signed, n)

    def run(batches):
        types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
        for batch in batches:
            rows = [r for r in map(read, batch.column(0).to_pylist()) if r]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["text", "_family", "_hi", "_lo", "_len"])

    return df.mapInArrow(run, "text string, _family int, _hi bigint, _lo bigint, _len int")


def _masked(hi: str, lo: str, length: str) -> tuple[Column, Column]:
    """The first ``length`` bits of two longs."""
    keep = lambda n: f"CASE WHEN {n} <= 0 THEN 0L WHEN {n} >= 64 THEN -1L ELSE shiftleft(-1L, 64 - {n}) END"
    return F.expr(f"{hi} & ({keep(length)})"), F.expr(f"{lo} & ({keep(f'({length} - 64)')})")


def block_keys(cidrs: DataFrame, cidr_col: str = "cidr") -> DataFrame:
    """Blocks as (_family, _len, _hi, _lo, block): the prefix cut to its length, one row a prefix (of equal ones the least text).
    A bare address is a block of its own; text that is no block is dropped."""
    df = _address_bits(cidrs.select(F.col(cidr_col).alias("text")).where("text IS NOT NULL").distinct(), blocks=True)
    hi, lo = _masked("_hi", "_lo", "_len")
    return df.select("_family", "_len", hi.alias("_hi"), lo.alias("_lo"), F.col("text").alias("block")).groupBy("_family", "_len", "_hi", "_lo").agg(F.min("block").alias("block"))


def address_block(ips: DataFrame, cidrs: DataFrame, ip_col: str = "ip", cidr_col: str = "cidr") -> DataFrame:
    """Add ``block``: the longest of the blocks of a table that holds the address (NULL: none, or no address).

    A range join without comparing ranges: every distinct address is cut to
    each prefix length that occurs among the blocks of its family (at most 33
    and 129, collected) and joins the blocks on the cut prefix, an equi-join
    for tables of any size; the longest match goes back to the rows by their
    text. Blocks may nest and overlap."""
    keys = block_keys(cidrs, cidr_col)
    lengths = [tuple(r) for r in keys.select("_family", "_len").distinct().collect()]
    spark = ips.sparkSession
    sizes = F.broadcast(spark.createDataFrame(lengths or [(4, 32)], "_family int, _len int"))
    asked = ips.select(F.col(ip_col).alias("text")).where("text IS NOT NULL").distinct()
    asked = _address_bits(asked, blocks=False).drop("_len").join(sizes, "_family")
    hi, lo = _masked("_hi", "_lo", "_len")
    cut = asked.select(F.col("text").alias("_ip"), "_family", "_len", hi.alias("_hi"), lo.alias("_lo"))
    best = cut.join(keys, ["_family", "_len", "_hi", "_lo"]).groupBy("_ip").agg(F.max_by("block", "_len").alias("block"))
    return ips.join(best.withColumnRenamed("_ip", ip_col), ip_col, "left")


_KEY = "\u001f"


def _scan_branches(files: DataFrame, heads: DataFrame, fn) -> DataFrame:
    """Scan branch-wise files (repo, branch, path, content): repository and
    branch travel as one key through the scan, then ``heads`` (one row per repo
    and branch) joins on both."""
    if "branch" not in files.columns:
        raise ValueError("files_for must return the branch of every file")
    keyed = files.withColumn("repo", F.concat_ws(_KEY, "repo", "branch")).drop("branch")
    found = fn(keyed)
    parts = F.split("repo", _KEY)
    return found.withColumn("branch", parts[1]).withColumn("repo", parts[0]).join(heads, ["repo", "branch"])


def incremental_scan(changes: DataFrame, files_for, sink_dir: str, checkpoint: str,
                     trigger_seconds: int = 30, scan_fn=None, available_now: bool = False):
    """Stream of accepted pushes / HEAD changes -> per micro-batch scan of the
    changed branches -> stamped findings written under ``sink_dir``.

    ``files_for(batch_df)`` returns the files (repo, branch, path, content) of
    the batch's (repo, branch) rows; ``scan_fn(files)`` (default: the flagship scan)
    returns findings. The write is keyed by batch id (idempotent on replay);
    the checkpoint advances only after the batch succeeded, so a failed scan
    is retried at the next trigger.
    """
    from scanforge.plans.scan import scan as default_scan
    fn = scan_fn or default_scan

    def run(batch: DataFrame, batch_id: int):
        if batch.isEmpty():
            return
        heads = batch.groupBy("repo", "branch").agg(F.max("ts").alias("scan_ts"))
        findings = _scan_branches(files_for(batch), heads, fn)
        (findings.withColumn("batch_id", F.lit(batch_id))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id", "repo", "branch").parquet(sink_dir))

    w = changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    if available_now:
        return w.trigger(availableNow=True)
    return w.trigger(processingTime=f"{max(trigger_seconds, 30)} seconds")


def _drop_versions(spark, state_dir: str, before: int) -> None:
    """Remove state versions older than the last one below ``before`` + 1."""
    path = spark._jvm.org.apache.hadoop.fs.Path(state_dir)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath() for x in fs.listStatus(path) if x.getPath().getName().startswith("batch_id=")]
    old = sorted((int(p.getName().split("=")[1]), p) for p in names if int(p.getName().split("=")[1]) <= before)
    for _, p in old[:-1]:
        fs.delete(p, True)


def monitor_heads(observations: DataFrame, files_for, sink_dir: str, state_dir: str, checkpoint: str,
                  trigger_seconds: int = 30, scan_fn=None, available_now: bool = False):
    """Polling monitor as a stream: observations (repo, branch, ts, sha) ->
    scan of every branch whose HEAD differs from the last *successfully
    scanned* SHA.

    The branch state is a small table (one row per repo/branch) versioned by
    batch id under ``state_dir``; versions no retry can need are removed. Inside one ``foreachBatch`` call the batch's
    changes are found against the previous state version, the changed
    branches are scanned and written, and only then the next state version is
    written; a failed batch leaves the state untouched, so the change is
    found again when the batch is retried (the checkpoint has not advanced).
    """
    from pyspark.sql.utils import AnalysisException

    from scanforge.plans.scan import scan as default_scan
    fn = scan_fn or default_scan
    keys = ["repo", "branch"]

    def previous_state(spark, batch_id):
        try:
            st = spark.read.parquet(state_dir)
        except AnalysisException:
            return None
        st = st.where(F.col("batch_id") < batch_id)
        last = st.groupBy().agg(F.max("batch_id").alias("b")).collect()[0]["b"]   # one scalar
        return None if last is None else st.where(F.col("batch_id") == last).select(*keys, "sha")

    def run(batch: DataFrame, batch_id: int):
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        # last observation per branch in this batch
        latest = batch.groupBy(*keys).agg(F.max("ts").alias("ts"), F.max_by("sha", F.struct("ts", "sha")).alias("sha"))
        prev = previous_state(spark, batch_id)
        if prev is None:
            changed = latest
            new_state = latest.select(*keys, "sha")
        else:
            p = prev.withColumnRenamed("sha", "_prev")
            changed = latest.join(p, keys, "left").where(~F.col("sha").eqNullSafe(F.col("_prev"))).drop("_prev")
            new_state = (p.join(latest.select(*keys, "sha"), keys, "full")
                         .select(*keys, F.coalesce(F.col("sha"), F.col("_prev")).alias("sha")))
        if not changed.isEmpty():
            heads = changed.select("repo", "branch", F.col("ts").alias("scan_ts"), F.col("sha").alias("head_sha"))
            findings = _scan_branches(files_for(changed), heads, fn)
            (findings.withColumn("batch_id", F.lit(batch_id))
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("batch_id", "repo", "branch").parquet(sink_dir))
        (new_state.withColumn("batch_id", F.lit(batch_id))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(state_dir))
        # a retry of this batch needs the version before it; older ones go
        _drop_versions(spark, state_dir, batch_id - 1)

    w = observations.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    if available_now:
        return w.trigger(availableNow=True)
    return w.trigger(processingTime=f"{max(trigger_seconds, 30)} seconds")
