"""Rule catalog: the rule tables of one scan with a global position ``k``.

Matching produces ``k``; findings get their rule columns from a join with the
catalog, broadcast when its exact size (computed on the driver, where the
rule rows are) is below ``BROADCAST_CATALOG_BYTES``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanforge.operators.matching import Rule

# The catalog is broadcast when its exact size (known on the driver) is below
# this bound; otherwise the (small) hit table joins it with a regular join.
BROADCAST_CATALOG_BYTES = 64 * 1024 * 1024
from scanforge.operators.rules import builtin_rule_rows, leak_rule_rows

CATALOG_SCHEMA = T.StructType([
    T.StructField("k", T.IntegerType(), False),
    T.StructField("engine", T.StringType(), False),
    T.StructField("rule_id", T.StringType(), False),
    T.StructField("rule_language", T.StringType(), True),
    T.StructField("title", T.StringType(), True),
    T.StructField("description", T.StringType(), True),
    T.StructField("severity", T.StringType(), True),
    T.StructField("owasp", T.StringType(), True),
    T.StructField("cwe", T.StringType(), True),
    T.StructField("cvss", T.DoubleType(), True),
    T.StructField("references", T.ArrayType(T.StringType()), True),
    T.StructField("remediation", T.StringType(), True),
    T.StructField("leak_type", T.StringType(), True),
    T.StructField("entropy_gated", T.BooleanType(), True),
])


def _rows(rules: DataFrame | None, kind: str) -> list[dict]:
    if rules is None:
        if kind == "sast":
            names = ["rule_id", "language", "title", "description", "pattern", "anti_pattern", "severity",
                     "owasp", "cwe", "cvss", "references", "remediation", "hints", "rule_source", "rule_ord"]
            return [dict(zip(names, r)) for r in builtin_rule_rows()]
        names = ["rule_id", "name", "pattern", "severity", "description", "confidence", "hints", "rule_ord"]
        return [dict(zip(names, r)) for r in leak_rule_rows()]
    ordered = rules.orderBy("rule_ord") if "rule_ord" in rules.columns else rules
    return [r.asDict() for r in ordered.collect()]


class Catalog:
    """SAST rules first (k = 0..), then secret rules."""

    def __init__(self, spark: SparkSession, sast_rules: DataFrame | None = None,
                 leak_rules: DataFrame | None = None, sast: bool = True, leaks: bool = True):
        self.spark = spark
        self.sast_specs: list[Rule] = []
        self.leak_specs: list[Rule] = []
        rows = []
        k = 0
        if sast:
            for d in _rows(sast_rules, "sast"):
                self.sast_specs.append(Rule(k, d["rule_id"], d["language"], d["pattern"], d.get("anti_pattern"),
                                            tuple(d["hints"]) if d.get("hints") else None))
                rows.append((k, "sast", d["rule_id"], d["language"], d.get("title"), d.get("description"),
                             d["severity"], d.get("owasp"), d.get("cwe"),
                             float(d["cvss"]) if d.get("cvss") is not None else None,
                             list(d["references"]) if d.get("references") else None, d.get("remediation"),
                             None, None))
                k += 1
        if leaks:
            for d in _rows(leak_rules, "leak"):
                self.leak_specs.append(Rule(k, d["rule_id"], None, d["pattern"], None,
                                            tuple(d["hints"]) if d.get("hints") else None))
                name = d["name"]
                rows.append((k, "leak", d["rule_id"], None, name, d.get("description"), d["severity"],
                             None, None, None, None, None, name,
                             ("Generic" in name) or ("High Entropy" in name)))
                k += 1
        self.rows = rows

    def approx_bytes(self) -> int:
        return sum(len(str(v).encode()) for row in self.rows for v in row if v is not None)

    def df(self) -> DataFrame:
        d = self.spark.createDataFrame(self.rows, CATALOG_SCHEMA)
        return F.broadcast(d) if self.approx_bytes() <= BROADCAST_CATALOG_BYTES else d
