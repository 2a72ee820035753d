"""Findings and score of a few endpoints."""

from collections import Counter

from strataloom.operators import api_checks as C
from strataloom.sources import apis as A

DDL = "path string, method string, description string, parameters array<string>, responses array<string>, security array<string>, source string, file string"
ROWS = [
    ("/items", "GET", "all", [], ["200"], ['{"Bearer": []}'], "openapi", "a"),
    ("/Admin/config", "DELETE", " ", ["{}"], ["302", "default"], [], "openapi", "a"),
    ("/users/1", "TRACE", None, [], [], ['{"Basic": [], "API-Key": []}', "no"], "openapi", "a"),
]


def test_issues(spark):
    got = Counter((r.endpoint, r.type) for r in C.issues(spark.createDataFrame(ROWS, DDL)).collect())
    deleted, traced = "DELETE /Admin/config", "TRACE /users/1"
    assert got == Counter({
        (deleted, "insecure_method"): 2, (deleted, "missing_auth"): 1, (deleted, "naming_convention"): 1, (deleted, "status_codes"): 1,
        (deleted, "missing_description"): 1, (deleted, "undocumented_parameters"): 1, (traced, "weak_auth"): 2,
        (traced, "naming_convention"): 1, (traced, "http_method"): 1, (traced, "missing_description"): 1,
    })


def test_health(spark):
    rows = spark.createDataFrame(ROWS, DDL)
    r = C.health(rows, True).first()
    assert (r.total_endpoints, r.secure_endpoints, r.documented_endpoints) == (3, 2, 1)
    assert (r.security_issues, r.design_issues, r.documentation_issues) == (5, 4, 3)
    assert abs(r.score - (110 + 20 / 3 - 25 - 8 - 3)) < 1e-9
    assert C.health(rows.filter("false"), False).first().score == 100
    code = A.routes(spark.createDataFrame([("a.py", "@app.route('/user')")], "rel_path string, content string"))
    assert {r.type for r in C.issues(code).collect()} == {"missing_auth"}
