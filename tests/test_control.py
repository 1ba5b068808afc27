import json

import pytest
from pyspark.sql import functions as F

from fiberloom.operators import control
from fiberloom.sources import imports


def test_fixpoint_and_its_limit(spark):
    rows = spark.createDataFrame([(i, i) for i in range(1, 20)], "k long, v long")
    halve = lambda now: now.select("k", F.when(F.col("v") % 2 == 0, (F.col("v") / 2).cast("long")).otherwise(F.col("v")).alias("v"))
    got = {r.k: r.v for r in control.fixpoint(rows, halve, "k").collect()}
    assert got == {k: k // (k & -k) for k in range(1, 20)}
    with pytest.raises(RuntimeError, match="no fixed point"):
        control.fixpoint(rows, lambda now: now.select("k", (F.col("v") + 1).alias("v")), "k", most_rounds=3)


def test_deadline(spark):
    assert control.within(spark, 60, lambda: spark.range(10).count()) == 10
    slow = spark.range(4).repartition(4).mapInPandas(lambda it: (__import__("time").sleep(30) or b for b in it), "id long")
    with pytest.raises(control.DeadlineExceeded):
        control.within(spark, 2, slow.count)


def test_what_is_made_again(spark):
    modules = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "module string, context string")
    queries = spark.createDataFrame([("q1", "module"), ("q2", "context"), ("q3", "global")], "query string, granularity string")
    made = lambda changed: sorted(map(tuple, control.to_recompute(modules, spark.createDataFrame(changed, "module string"), queries).collect()))
    assert made([("a",)]) == [("q1", "a"), ("q2", "a"), ("q2", "b"), ("q3", "a"), ("q3", "b"), ("q3", "c")]
    assert made([]) == []


def test_documents_from_elsewhere(spark, tmp_path):
    (tmp_path / "f.json").write_text("\n".join(json.dumps({"detector": d, "subject": "s", "n": 1, "evidence": [{"path": "p", "line": 1, "symbol": "x"}]}) for d in ("a", "a", "b")))
    findings = imports.read_findings(spark, str(tmp_path / "f.json"))
    assert findings.count() == 3
    (tmp_path / "bad.json").write_text('{"detector": "a", "n": "many"}')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        imports.read_findings(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "t.json").write_text(json.dumps({"targets": [{"name": "t", "path": "p", "expected_detectors": [{"detector_id": "a", "min_count": 3}, {"detector_id": "c"}], "forbidden_detectors": ["b"]}]}))
    got = sorted(map(tuple, imports.gate(imports.read_targets(spark, str(tmp_path / "t.json")), findings).collect()))
    assert got == [("t", "a", 2, "too few"), ("t", "b", 1, "forbidden"), ("t", "c", 0, "too few")]
    (tmp_path / "n.tsv").write_text("3\t1\ta.py\n-\t-\tb.png\n0\t7\tc d.py\n")
    assert sorted(map(tuple, imports.read_changes(spark, str(tmp_path / "n.tsv")).collect())) == [("a.py", 3, 1), ("c d.py", 0, 7)]
