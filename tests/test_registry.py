"""Rules that users add, and the model of words."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strataloom.operators.models import chances, surprise
from strataloom.operators.registry import Rules, catalogue


def test_own_rules_in_one_scan(spark, tmp_path):
    rows = [(1, "a", "de", "x (y"), (2, "a", "en", "todo"), (3, "b", None, None), (4, "b", "de", "")]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    rules = Rules().column("C", "OWN", "low", lambda text, low: low.contains("todo")).batch("B", "OWN", "high", lambda t: t.str.count(r"\(") != t.str.count(r"\)")).batch("N", "OWN", "low", lambda t: t.map(lambda x: None))
    rules.column("D", "OWN", "low", lambda text, low: F.length(text) > 0, "de")
    found = rules.apply(docs)
    got = {(r.doc_id, r.rule): r.broken for r in found.collect()}
    assert got == {(i, n): False for i in (1, 2, 3, 4) for n in "CBN"} | {(2, "C"): True, (1, "B"): True, (1, "D"): True, (4, "D"): False}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("FileScan", plan)) == 1 and plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan
    assert rules.apply(docs.filter("false")).collect() == []


def test_catalogue_has_the_compliance_rules():
    rules = catalogue()
    assert len(rules.rules) == 16
    with pytest.raises(ValueError, match="SEC-001"):
        rules.column("SEC-001", "x", "low", lambda text, low: low.isNull())


def test_surprise_against_counts(spark):
    learned = ["the cat sat on the mat", "the cat ran", "a cat sat on a hat, the cat sat"]
    asked = ["the cat sat on the hat", "zzz cat sat", "two words", None, "", "the cat sat"]
    split = lambda t: re.sub("[^a-z0-9]+", " ", (t or "").lower()).split()
    seen = [tuple(w[i : i + 3]) for w in map(split, learned) for i in range(len(w) - 2)]
    tri, bi, uni = Counter(seen), Counter(t[1:] for t in seen), Counter(t[2] for t in seen)
    after2, after1 = Counter(t[:2] for t in seen), Counter(t[1] for t in seen)

    def chance(t):
        if t in tri:
            return tri[t] / after2[t[:2]]
        if t[1:] in bi:
            return 0.4 * bi[t[1:]] / after1[t[1]]
        return 0.16 * uni[t[2]] / len(seen) if t[2] in uni else 0.064 / len(seen)

    model = chances(spark.createDataFrame([(t,) for t in learned], "text string"))
    got = {r.doc_id: (r.windows, r.known, r.bits) for r in surprise(spark.createDataFrame(list(enumerate(asked)), "doc_id int, text string"), model).collect()}
    for i, text in enumerate(asked):
        own = [tuple(w[k : k + 3]) for w in [split(text)] for k in range(len(w) - 2)]
        bits = -sum(math.log2(chance(t)) for t in own) / len(own) if own else 0.0
        assert got[i][:2] == (len(own), sum(t in tri for t in own)) and math.isclose(got[i][2], bits, abs_tol=1e-9)
