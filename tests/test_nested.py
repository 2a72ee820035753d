"""Nested JSON: leaves, changes, canonical form, digests."""

from pyspark.sql import functions as F

from strataloom.operators import nested as N

TEXTS = [
    (1, '{"a": {"b": [1, {"c": null}, [true, "x{[\\"]"]]}, "e": [], "o": {}}'), (2, '{"a": 1, "a": 2}'), (3, "7"), (4, None), (5, "{broken"), (6, "[]"), (7, '{"k/l": "\\u00e9", "n": 1.50}'),
    (8, "[" * 30 + "1" + "]" * 30), (9, '""'),
]


def test_leaves(spark):
    rows = spark.createDataFrame(TEXTS, "id int, text string").selectExpr("*", "1 as key", "2 as value", "3 as pos", "4 as path")
    got = {(r.id, r.path): r.value for r in N.leaves(rows, "text", "id").collect()}
    assert got == {
        (1, "a/b[0]"): "1", (1, "a/b[1]/c"): "null", (1, "a/b[2][0]"): "true", (1, "a/b[2][1]"): '"x{[\\"]"', (2, "a"): "2", (3, ""): "7", (7, "k/l"): '"é"', (7, "n"): "1.5",
        (8, "[0]" * 30): "1", (9, ""): '""',
    }
    assert N.leaves(rows.filter("id = 0"), "text", "id").collect() == []


def test_leaves_move_no_row(spark):
    plan = N.leaves(spark.createDataFrame(TEXTS[:1], "id int, text string"), "text", "id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_changes(spark):
    of = lambda *texts: N.leaves(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "text", "id")
    a, b = of('{"x": 1, "y": [1, 2], "z": null}', "{}"), of('{"x": 1, "y": [1, 3, 4], "z": null}', '{"q": null}')
    got = {(r.id, r.path, r.left_value, r.right_value) for r in N.leaf_changes(a, b, "id").collect()}
    assert got == {(0, "y[1]", "2", "3"), (0, "y[2]", None, "4"), (1, "q", None, "null")}


def test_canonical_form(spark):
    pairs = [('{"b": [3, 1, {"z": 1, "y": [2, 1]}], "a": "é"}', '{"a":"é","b":[1,3,{"y":[1,2],"z":1}]}'), (None, None), ("{broken", None), ("[]", "[]"), ('{"a": 1, "a": 2}', '{"a":2}'), ("[" * 5000 + "]" * 5000, None)]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(pairs)], "id int, text string")
    got = {r.id: r.c for r in rows.select("id", N.canonical("text").alias("c")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(pairs)}


def test_digest_knows_no_order(spark):
    def of(texts, parts=3):
        rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(parts)
        return rows.select(N.canonical("text").alias("text")).agg(*N.digest(F.col("text"))).select(N.digest_text()).first()[0]

    texts = ['{"a": 1, "b": [1, 2]}', '{"a": 2}', '{"a": 2}', None]
    same = of(['{"a": 2}', None, '{"b": [2, 1], "a": 1}', '{"a": 2}'], 1)
    assert of(texts) == same
    assert len({same, of(texts[:3]), of(texts[:2] + texts[3:]), of(['{"a": 1, "b": [1, 3]}', *texts[1:]]), of([])}) == 5


def test_digest_collects_nothing(spark):
    plan = spark.createDataFrame([("x",)], "text string").agg(*N.digest(F.col("text")))._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "collect" not in plan
