import json

import pytest

from strataloom.sources import apis, cache, reports


def test_sorted_fields_and_nulls(spark, tmp_path):
    df = spark.createDataFrame([(2, None, "x"), (1, 0.5, "y")], "b int, a double, c string")
    reports.write_json(df, f"{tmp_path}/j")
    lines = sorted(r.value for r in spark.read.text(f"{tmp_path}/j").collect())
    assert [list(json.loads(x)) for x in lines] == [["a", "b", "c"]] * 2 and json.loads(lines[1])["a"] is None
    reports.write_csv(df, f"{tmp_path}/c")
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").columns == ["b", "a", "c"]


def test_required_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x")], "id int, name string")
    assert reports.write_validated(df, f"{tmp_path}/ok", ["id"]).count() == 2
    with pytest.raises(ValueError, match="nulls: {'name': 1}"):
        reports.write_validated(df, f"{tmp_path}/bad", ["id", "name"])
    with pytest.raises(ValueError, match="required"):
        reports.write_validated(df, f"{tmp_path}/none", ["other"])


def test_long_verdicts_are_cut(spark):
    df = spark.createDataFrame([("a b",), ("w " * 301,), (None,)], "text string")
    short, long, none = (r.text for r in reports.verdict_text(df).collect())
    assert short == "a b" and len(long.split()) == 281 and none is None


def test_markdown_holds_every_section(spark, tmp_path):
    rows = [("r", "Critical Issues", n, f"i{n}", "high") for n in range(7)] + [("r", "Evidence Highlights", 1, None, None), ("r", "Other", 1, "gone", "x")]
    reports.write_markdown(spark.createDataFrame(rows, "repo string, section string, seq int, name string, detail string"), f"{tmp_path}/m")
    lines = [r.value for r in spark.read.text(f"{tmp_path}/m").collect()]
    assert [x[3:] for x in lines if x.startswith("## ")] == [name for name, _, _ in reports.SECTIONS]
    assert lines[0] == "# Repository Analysis Report" and "- **Unknown:** " in lines and not any("gone" in x for x in lines)
    assert [x for x in lines if x.startswith("- **i")] == [f"- **i{n}:** high" for n in range(5)]


def test_cache_keeps_results_for_a_day(spark, tmp_path):
    key, built = cache.cache_key(b=1, a="x"), []
    assert key == cache.cache_key(a="x", b=1) != cache.cache_key(a="y", b=1) and len(key) == 16

    def build():
        built.append(1)
        return spark.range(len(built))

    at = lambda now: cache.cached(spark, str(tmp_path), key, build, now=now).count()
    assert [at(0.0), at(cache.DAY), at(cache.DAY + 1.0), at(cache.DAY + 2.0)] == [1, 1, 2, 2] and len(built) == 2


def test_yaml_descriptions(spark):
    text = "openapi: 3.0.0\npaths:\n  /a:\n    get:\n      description: d\n      responses:\n        200:\n          description: ok\n    parameters: [1]\n"
    df = spark.createDataFrame([("x/openapi.yaml", text), ("y/openapi.yaml", "a: &b 1\nc: *b"), ("z/openapi.yaml", "a: [")], "rel_path string, content string")
    pytest.importorskip("yaml")
    assert [(r.path, r.method, r.description, r.responses, r.file) for r in apis.endpoints(df).collect()] == [("/a", "GET", "d", ["200"], "x/openapi.yaml")]
    assert apis.as_json("") is apis.as_json(None) is None and apis.as_json('{"a": 1}') == '{"a": 1}'


def test_aliases_of_yaml_are_resolved_under_a_bound():
    pytest.importorskip("yaml")
    assert apis.as_json("a: &b {x: 1}\nc: *b") == '{"a": {"x": 1}, "c": {"x": 1}}'
    laughs = "a0: &a0 [x, x, x, x, x, x, x, x, x]\n" + "".join(f"a{i}: &a{i} [{', '.join(['*a' + str(i - 1)] * 9)}]\n" for i in range(1, 9))
    with pytest.raises(ValueError, match="nodes"):
        apis.as_json(laughs)
