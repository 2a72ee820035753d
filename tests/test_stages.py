"""All stages of a repository in one scan."""

import re

from pyspark.sql import functions as F

from strataloom.operators import stages as S
from strataloom.operators.risks import component_risks, components, weighted
from strataloom.plans import overview


def test_one_scan_and_no_join(spark):
    plan = overview.repository_report(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("FileScan|Scan parquet", plan)) == 1 and "Join" not in plan
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 2


def test_counts_of_small_texts(spark):
    block = "\n".join(f"line {i}" for i in range(6))
    rows = [("a", block + "\n\n" + block), ("a", None), ("a", "os.system('rm ' + x)\nif a and b or c"), ("b", ""), (None, block)]
    got = {r.repo: r for r in S.repository_counts(spark.createDataFrame(rows, "source string, text string").selectExpr("*", "1 as repo", "2 as stage", "3 as lines")).collect()}
    a, b = got["a"], got["b"]
    assert (a.files, a.lines, a.findings, a.critical, a.assessed) == (3, 13 + 1 + 2, 1, 1, "minimal")
    assert (a.blocks, a.duplicates, a.largest, a.ratio) == (7, 2, 2, 12 / 7)
    assert (b.files, b.blocks, b.duplicates, b.largest, b.duplication) == (1, 0, 0, 0, 100.0)
    assert got[None].blocks == 1
    assert S.repository_counts(spark.createDataFrame([], "source string, text string")).collect() == []


def test_components_need_only_the_columns_there(spark):
    counts = spark.createDataFrame([("r", 2, 90.0)], "repo string, critical int, compliance double")
    got = {r.component: (r.level, r.score) for r in component_risks(counts).collect()}
    assert len(got) == 14 and got["security"] == ("critical", 10) and got["compliance"] == ("low", 0) and got["api"] == ("low", 0)
    assert counts.select(weighted(F.array(*components(counts))).alias("m")).first().m == 1.0
