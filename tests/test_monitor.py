import datetime as dt
import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from scanforge.streaming.monitor import (head_changes, private_address, push_branch, rate_limit_tumbling, valid_branch,
                                         verify_push)


@pytest.mark.parametrize("branch,ok", [("main", True), ("feature/a", True), ("", False), ("b" * 256, False),
                                       ("a b", False), ("a..b", False), ("/a", False), ("a/", False)])
def test_valid_branch(spark, branch, ok):
    assert spark.createDataFrame([(branch,)], "b string").select(valid_branch("b")).collect()[0][0] is ok


def test_verify_and_branch(spark):
    secret = "s3cret"
    body = '{"ref": "refs/heads/main"}'
    good = "sha256=" + hmac.new(secret.encode(), body.encode(), hashlib.sha256).hexdigest()
    rows = [(1, "github", body, good), (2, "github", body, "sha256=00"), (3, "gitlab", body, secret),
            (4, "gitlab", body, "x"), (5, "github", '{"ref": "refs/tags/v1"}', good)]
    p = spark.createDataFrame(rows, "id int, platform string, payload string, signature string")
    ok = sorted(r.id for r in verify_push(p, secret).collect())
    assert ok == [1, 3]
    assert verify_push(p, "").count() == 0
    assert sorted(r.id for r in push_branch(p).collect()) == [1, 2, 3, 4]


@pytest.mark.parametrize("ip,private", [
    ("10.1.2.3", True), ("11.0.0.1", False), ("172.16.0.1", True), ("172.32.0.1", False),
    ("192.168.1.1", True), ("192.169.1.1", False), ("127.0.0.1", True), ("128.0.0.1", False),
    ("169.254.1.1", True), ("169.255.1.1", False), ("::1", True), ("::2", False),
    ("fd00::1", True), ("fe00::1", False), ("fe80::1", True), ("fec0::1", False)])
def test_private_address(spark, ip, private):
    df = spark.createDataFrame([(ip,)], "ip string")
    assert private_address(df).collect()[0].private is private


def test_head_changes(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("r", "main", t0 + dt.timedelta(minutes=i), s) for i, s in enumerate(["a", "a", "b", "b", "a"])]
    df = spark.createDataFrame(rows, "repo string, branch string, ts timestamp, sha string")
    assert [r.sha for r in head_changes(df).orderBy("ts").collect()] == ["a", "b", "a"]


def test_rate_limit_batch(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("s", t0 + dt.timedelta(seconds=i)) for i in range(5)] + [("s", t0 + dt.timedelta(minutes=2))]
    df = spark.createDataFrame(rows, "source string, ts timestamp")
    assert rate_limit_tumbling(df, n=2).count() == 3


def test_rate_limit_stream_exact_anchor(spark, tmp_path):
    from scanforge.streaming.monitor import rate_limit_stream
    t0 = dt.datetime(2024, 1, 1)
    # window of 60 s starting at the first request: 0,10,20 | 70 (new window), 75, 80 -> n=2 keeps 0,10,70,75
    secs = [0, 10, 20, 70, 75, 80]
    src = tmp_path / "src"
    src.mkdir()
    spark.createDataFrame([(i, t0 + dt.timedelta(seconds=s), "s") for i, s in enumerate(secs)],
                          "event_id int, ts timestamp, source string").write.parquet(str(src / "p"))
    stream = spark.readStream.schema("event_id int, ts timestamp, source string").parquet(str(src / "p"))
    out = rate_limit_stream(stream, n=2, window_seconds=60, key="source")
    q = (out.writeStream.format("parquet").option("path", str(tmp_path / "out"))
         .option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    kept = sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert kept == [0, 1, 3, 4]


def test_rate_limit_stream_over_batches_equals_the_batch_form(spark, tmp_path):
    """Several micro-batches in time order, one source with a third of all rows; state goes on over restarts."""
    import random

    from scanforge.streaming.limiter import rate_limit
    from scanforge.streaming.monitor import rate_limit_stream
    rng, t0 = random.Random(4), dt.datetime(2024, 1, 1)
    rows = sorted((t0 + dt.timedelta(seconds=rng.randrange(3000) / 2), i) for i in range(600))
    rows = [(i, t, "busy" if i % 3 == 0 else f"s{i % 7}") for t, i in rows]
    schema, out = "event_id int, ts timestamp, source string", str(tmp_path / "out")
    for k in range(3):
        spark.createDataFrame(rows[k * 200:k * 200 + 200], schema).write.mode("append").parquet(str(tmp_path / "src"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "src"))
        limited = rate_limit_stream(stream, n=3, window_seconds=60, watermark="1 hour")
        assert limited.columns == ["source", "ts", "event_id"]
        limited.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    want = rate_limit(spark.createDataFrame(rows, schema), n=3, window_seconds=60, order=["event_id"])
    assert sorted(r.event_id for r in spark.read.parquet(out).collect()) == sorted(r.event_id for r in want.collect())


def test_limiter_steps_by_window():
    import numpy as np

    from scanforge.streaming.monitor import _NEVER, _let_through
    keep, used, end = _let_through(np.array([0, 1, 2, 10, 11, 12, 30]), 0, _NEVER, 2, 10)
    assert keep.tolist() == [True, True, False, False, True, True, True] and (used, end) == (1, 40)
    assert _let_through(np.array([35, 41]), used, end, 1, 10)[0].tolist() == [False, True]


def test_monitor_heads_advances_after_scan(spark, tmp_path):
    from scanforge.streaming.monitor import monitor_heads
    t0 = dt.datetime(2024, 1, 1)
    obs_dir = tmp_path / "obs"
    schema = "repo string, branch string, ts timestamp, sha string"

    def add(rows, name):
        spark.createDataFrame(rows, schema).write.parquet(str(obs_dir / name))

    files = spark.createDataFrame([("r1", "a.py", "pickle.loads(x)"), ("r2", "b.py", "ok")],
                                  "repo string, path string, content string")

    def files_for(changed):
        return files.join(changed.select("repo", "branch").distinct(), "repo")

    def run_once():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(obs_dir))
        q = monitor_heads(stream, files_for, str(tmp_path / "sink"), str(tmp_path / "state"),
                          str(tmp_path / "ck"), available_now=True, scan_fn=lambda f: f.select("repo", "path")).start()
        q.awaitTermination()

    add([("r1", "main", t0, "a"), ("r2", "main", t0, "x")], "b0")
    run_once()
    add([("r1", "main", t0 + dt.timedelta(minutes=5), "a"), ("r2", "main", t0 + dt.timedelta(minutes=5), "y")], "b1")
    run_once()
    out = spark.read.parquet(str(tmp_path / "sink"))
    got = sorted((r.batch_id, r.repo, r.head_sha) for r in out.collect())
    assert got == [(0, "r1", "a"), (0, "r2", "x"), (1, "r2", "y")]


def test_head_changes_across_buckets(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("r", "main", t0 + dt.timedelta(minutes=i, seconds=5 * (i % 2)), s)
            for i, s in enumerate(["a", "a", "b", "b", "a", "a"])]
    df = spark.createDataFrame(rows, "repo string, branch string, ts timestamp, sha string")
    for bucket in ("1 minute", "2 minutes", "1 day"):
        assert [r.sha for r in head_changes(df, bucket=bucket).orderBy("ts").collect()] == ["a", "b", "a"]


def test_incremental_scan_replay_is_idempotent(spark, tmp_path):
    from scanforge.streaming.monitor import incremental_scan
    t0 = dt.datetime(2024, 1, 1)
    src = tmp_path / "pushes"
    schema = "repo string, ts timestamp, payload string"
    files = spark.createDataFrame([("r1", "a.py", "pickle.loads(x)"), ("r2", "b.py", "eval(x)")],
                                  "repo string, path string, content string")

    def files_for(batch):
        return files.join(batch.select("repo", "branch").distinct(), "repo")

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(src))
        changes = push_branch(stream)
        incremental_scan(changes, files_for, str(tmp_path / "sink"), str(tmp_path / "ck"),
                         available_now=True).start().awaitTermination()
        return sorted((r.batch_id, r.repo, r.rule_id) for r in spark.read.parquet(str(tmp_path / "sink")).collect())

    spark.createDataFrame([("r1", t0, '{"ref": "refs/heads/main"}')], schema).write.parquet(str(src / "p0"))
    first = run()
    assert first == [(0, "r1", "PY-007")]
    assert run() == first                                  # replay: nothing new, nothing duplicated
    spark.createDataFrame([("r2", t0, '{"ref": "refs/heads/main"}')], schema).write.parquet(str(src / "p1"))
    assert run() == [(0, "r1", "PY-007"), (1, "r2", "PY-009")]


def test_newline_and_trailing_text_are_rejected(spark):
    from scanforge.streaming.monitor import valid_branch, valid_repo
    df = spark.createDataFrame([("main",), ("main\n",), ("a/b",), ("a/b\n",)], "s string")
    rows = df.select("s", valid_branch("s").alias("b"), valid_repo("s").alias("r")).collect()
    assert {r.s for r in rows if r.b} == {"main", "a/b"} and {r.s for r in rows if r.r} == {"a/b"}
    bodies = ['{"ref":"refs/heads/main"}', '{"ref":"refs/heads/main"} xx', '{"ref":"refs/heads/main\\n"}', '{"ref":["refs/heads/main"]}', "1],[2",
              '1},{"p":2', "", '{"ref":"refs/heads/' + "a" * 255 + '"}', '{"ref":"refs/heads/' + "a" * 256 + '"}']
    p = spark.createDataFrame(list(enumerate(bodies)), "i int, payload string")
    assert sorted(r.i for r in push_branch(p).collect()) == [0, 7]


def test_private_address_by_hand(spark):
    from scanforge.streaming.monitor import private_address
    cases = {"10.0.0.1": True, "10.0.0.256": False, "010.0.0.1": False, "10.0.0.1\n": False, "172.15.0.1": False, "172.31.255.255": True,
             "::ffff:10.0.0.1": True, "::ffff:127.0.0.1": True, "::ffff:8.8.8.8": False, "::FFFF:A00:1": True, "fd00": False, "fd00::": True, "::1": True,
             "::2": False, "::": False, "fe80::1:2:3:4": True, "febf::1": True, "fec0::1": False, "1:2:3:4:5:6:7:8:9": False, "fc00:::1": False,
             "fc00::1::2": False, "": False, "2001:db8::1": False, "64:ff9b::10.0.0.1": False, "1:2:3:4:5:6:7": False, "fc00:1:2:3:4:5:6:7": True}
    df = spark.createDataFrame([(k,) for k in cases], "ip string")
    assert {r.ip: r.private for r in private_address(df).collect()} == cases


def test_branches_of_one_batch_keep_their_own_files(spark, tmp_path):
    import datetime as dt

    from scanforge.streaming.monitor import _scan_branches
    files = spark.createDataFrame([("r", "main", "a.py", "pickle.loads(x)"), ("r", "dev", "b.js", "eval(x)")],
                                  "repo string, branch string, path string, content string")
    heads = spark.createDataFrame([("r", "main", dt.datetime(2026, 1, 1)), ("r", "dev", dt.datetime(2026, 1, 1))], "repo string, branch string, scan_ts timestamp")
    from scanforge.plans.scan import scan
    got = sorted({(r.repo, r.branch, r.file) for r in _scan_branches(files, heads, scan).collect()})
    assert got == [("r", "dev", "b.js"), ("r", "main", "a.py")]
