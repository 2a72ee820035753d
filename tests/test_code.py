"""Symbols, endpoints and history of small source trees."""

import subprocess

from strataloom.operators import ranks
from strataloom.operators import symbols as Y
from strataloom.sources import apis as A
from strataloom.sources import trees
from pyspark.sql import functions as F

PY = "import os\nfrom a.b import c\nclass K:\n    def m(self): pass\ndef f(x):\n    if x and 1:\n        return 1\nif 1:\n    def g(): pass\n"
JS = "import x from 'lib'\nconst f = x => {\n}\nfunction go(a) { if (a) { return (1) } }\nexport const f2 = (a) => (a)\nclass V {}\n"
JAVA = "package p.q;\nimport java.util.List;\n@Entity\npublic class Big {\n  public void  run(int x) {}\n}\nenum E {}\n"


def files(spark, *rows):
    return spark.createDataFrame(list(rows), "rel_path string, content string")


def test_symbols(spark):
    found = Y.symbols(files(spark, ("a.py", PY), ("bad.py", "def ("), ("b.js", JS), ("c.ts", "interface I {}\ntype T = 1"), ("D.java", JAVA), ("e.md", "class No"), ("n.py", None)))
    got = {(r.lang, r.kind, r.name, r.line) for r in found.collect()}
    assert {x for x in got if x[0] == "python"} == {("python", "import", "os", 1), ("python", "import", "a.b.c", 2), ("python", "class", "K", 3), ("python", "function", "f", 5), ("python", "function", "g", 9)}
    assert {("javascript", "function", "f", 0), ("javascript", "function", "go", 0), ("javascript", "import", "lib", 0), ("javascript", "class", "V", 0), ("javascript", "component", "f2", 0)} <= got
    assert not any(x[2].startswith("if") for x in got)
    assert {("typescript", "interface", "I", 0), ("typescript", "type", "T", 0)} <= got
    assert {("java", "package", "p.q", 0), ("java", "method", "run", 0), ("java", "annotation", "@Entity", 0), ("java", "enum", "E", 0)} <= got
    assert found.filter("name = 'f' and lang = 'python'").first().complexity == 3
    assert {r.module for r in Y.imports(found).filter("lang = 'python'").collect()} == {"os", "a.b.c"}
    tree = files(spark, ("a.py", ""), ("src/b.py", ""), ("tests/test_a.py", ""))
    assert [r.rel_path for r in Y.untested(found, tree).collect()] == ["src/b.py"]


def test_endpoints(spark):
    spec = '{"paths": {"/a": {"get": {"description": "d", "responses": {"200": {}}, "security": [{"k": []}]}, "parameters": [1]}}}'
    nested = '{"item": [{"item": [{"name": "n", "request": {"method": "POST", "url": {"raw": "/p"}}}]}, {"request": {"url": "/q"}}]}'
    schema = "type Query {\n  one(id: ID): User\n  two: Int\n}\ntype Other {\n x(a: B): C\n}"
    got = {(r.path, r.method, r.description, tuple(r.responses), r.source) for r in A.endpoints(files(spark, ("x/openapi.yaml", spec), ("b.postman_collection.json", nested), ("s.graphql", schema), ("a.py", "@app.route('/z')"))).collect()}
    assert got == {("/a", "GET", "d", ("200",), "openapi"), ("/p", "POST", "n", (), "postman"), ("/q", "GET", "", (), "postman"), ("/query/one", "GRAPHQL", "Query one", ("User",), "graphql")}
    code = A.endpoints(files(spark, ("a.py", "@app.route('/z')"), ("b.js", "app.post('/y', f)"), ("c.txt", "app.get('/no')")))
    assert {(r.path, r.method, r.source) for r in code.collect()} == {("/z", "GET", "code_flask"), ("/y", "POST", "code_express")}
    assert A.postman_requests("[1]") == A.postman_requests("{") == []


def test_history(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=N", "-c", "user.email=n@x.org", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "__init__.py").write_text("1\n2\n")
    git("add", ".")
    git("commit", "-qm", "feat: one\n\nbody #12")
    (tmp_path / "__init__.py").write_text("1\n")
    git("commit", "-qam", "fix: two")
    rows = trees.git_log(spark, [str(tmp_path)]).orderBy("insertions").collect()
    assert [(r.insertions, r.deletions, len(r.parents), r.author) for r in rows] == [(0, 1, 1, "N"), (2, 0, 0, "N")]
    assert rows[1].message.strip() == "feat: one\n\nbody #12"


def test_values_at_ranks(spark):
    values = [-5.0, -1.0, 0.0, 0.0, 0.25, 1.0, 1.0, 7.5, 1e9, 1e9 + 1]
    rows = spark.createDataFrame([("k", v) for v in values] + [("one", 3.0), ("none", None)], "k string, v double")
    places = {f"p{i}": (lambda n, i=i: F.lit(i)) for i in range(len(values))}
    got = {r.k: r for r in ranks.values_at(rows, "k", "v", places).collect()}
    assert [got["k"][f"p{i}"] for i in range(len(values))] == values and got["k"].n == 10
    assert got["one"].p0 == 3.0 and got["one"].p1 is None and "none" not in got
