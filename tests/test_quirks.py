"""Quirks of the original tool kept on purpose."""

from scanforge.operators.sast import iac_scan, sast_scan
from scanforge.operators.secrets import history_scan
from tests.conftest import files_df

LOW = "api_" + 'key = "' + "a" * 20 + '"'
HIGH_SAME_PREFIX = "api_" + 'key = "' + "a" * 9 + "B2c3D4e5F6g" + '"'


def test_q2_kubernetes_rules_need_iac_map(spark):
    f = files_df(spark, [("deploy/pod.yaml", "  securityContext:\n    privileged: true\n    runAsUser: 0")])
    assert sast_scan(f).count() == 0                                   # .yaml has no language by default
    assert sorted(r.rule_id for r in iac_scan(f).collect()) == ["K8S-001", "K8S-002"]


def test_q3_multiline_pattern_never_fires(spark):
    f = files_df(spark, [("a.py", "try:\n    x()\nexcept ValueError:\n    pass\n")])
    assert "PY-024" not in {r.rule_id for r in sast_scan(f).collect()}


def test_q14_history_dedup_before_entropy_gate(spark):
    rows = [("r", "c%012d" % 0, 0, "cfg.py", LOW), ("r", "c%012d" % 1, 1, "cfg.py", HIGH_SAME_PREFIX)]
    b = spark.createDataFrame(rows, "repo string, commit_hash string, commit_seq long, path string, content string")
    # two secrets that share 20 bytes are two findings; the gate drops the low-entropy one
    assert [r.commit_hash for r in history_scan(b).collect() if r.rule_id == "LEAK-121"] == ["c%012d" % 1]
    b2 = b.where("commit_seq = 1")
    assert [r.rule_id for r in history_scan(b2).collect()] == ["LEAK-121"]
