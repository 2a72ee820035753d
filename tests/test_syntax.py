"""Facts of syntax trees, clone blocks of other shapes, and Jaccard similarity."""

from pyspark.sql import functions as F

from strataloom.functions.scalars import jaccard
from strataloom.operators import blocks as B
from strataloom.operators import syntax as X

TEXT = "import os\nx = 1\nclass K:\n    def m(self):\n        return os.path.join(x, f()(x))\nasync def g():\n    x = K().m()\n    del x\n"


def files(spark, *rows):
    return spark.createDataFrame([("r", *row) for row in rows], "repo string, path string, content string")


def test_calls_and_variables(spark):
    df = files(spark, ("a.py", TEXT), ("bad.py", "def ("), ("null.py", None), ("a.js", TEXT))
    calls = {(r.caller, r.callee.split("(")[0], r.line) for r in X.calls(df).collect()}
    assert calls == {("K+m", "os.path.join", 5), ("K+m", "Call", 5), ("K+m", "f", 5), ("g", "m", 7), ("g", "K", 7)}
    flow = {r.name: (r.defined, r.used) for r in X.variables(df).collect()}
    assert flow == {"x": ([2, 7], [5, 5]), "os": ([], [5]), "f": ([], [5]), "K": ([], [7])}


def test_style_of_nothing(spark):
    assert X.style(files(spark, ("bad.py", "def ("))).count() == 0
    row = X.style(files(spark, ("null.py", None))).first()
    assert (row.functions, row.function_naming, row.class_naming, row.import_grouping) == (0, None, None, None)
    assert X.style(files(spark, ("a.py", TEXT))).first().import_grouping == "mixed"


def test_blocks_of_few_or_no_lines(spark):
    df = files(spark, ("a.py", "a1\n" * 5), ("null.py", None), ("b.py", "ab = 1\n\n# c\n" * 7), ("c.py", "}\n" * 9), ("d.js", "# x\n" * 6))
    got = sorted((r.path, r.place, r.has_token) for r in B.code_blocks(df).collect())
    assert got == [("b.py", 0, True), ("b.py", 1, True), *(("c.py", n, False) for n in range(4)), ("d.js", 0, False)]
    found = B.clones(B.code_blocks(df)).first()
    assert (found.path, found.places, found.occurrences, found.files) == ("b.py", [0, 1], 2, 1)


def test_jaccard(spark):
    rows = spark.createDataFrame([(["a", "b", "b"], ["b", "c"]), ([], ["a"]), ([], [])], "a array<string>, b array<string>")
    assert [r.j for r in rows.select(jaccard(F.col("a"), F.col("b")).alias("j")).collect()] == [1 / 3, 0.0, 0.0]
