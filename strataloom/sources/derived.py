"""Relations of repositories, bounties and runs, derived from the given tables.

The tables hold no source trees, so their rows are told as files, commits and
checks: one row a document, page, message or event, with its whole text. Each
relation is one SELECT that Spark and DuckDB read alike; ``~`` stands for a line
feed and ``#`` for the row's number in the texts of ``_FILES``, and ``@array`` for
the array function of either engine.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from strataloom.sources.examples import ROWS
from strataloom.sources.tables import table


def _cases(value: str, *labels: str | None) -> str:
    """One of the labels, in turn by a number."""
    told = " ".join(f"WHEN {i} THEN {'NULL' if x is None else _quoted(x)}" for i, x in enumerate(labels))
    return f"CASE {value} % {len(labels)} {told} END"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values(rows: list[tuple], names: str) -> str:
    one = lambda r: "(" + ", ".join(str(x) if isinstance(x, int) else _quoted(x) for x in r) + ")"
    return f"(VALUES {', '.join(map(one, rows))}) AS t({names})"


def _share(value: str, of: int = 101) -> str:
    return f"cast(({value}) % {of} AS DOUBLE) / {of - 1}"


#: Paths of a repository's files in turn, and what precedes a document in them; manifests in JSON and XML hold none, and in Python files and lists of requirements it is a comment.
_FILES = [
    ("README#.md", "# Readme #~"), ("src/core/m#.py", "import os~import json.decoder~~~class Part#:~    pass~~~def run_#(x):~    if x and x > 1:~        return x~    return None~"), ("tests/test_m#.py", "def test_m#():~    assert True~"),
    ("src/app#.js", "// app~const a = 1;~"), ("docs/guide#.md", ""), ("pkg#/requirements.txt", "requests==2.#~numpy~"), ("src/main#.py", "from . import sibling~~def main():~    return run()~"), ("config/app#.yml", ""),
    (".github/workflows/ci#.yml", ""), ("tests/unit/test_u#.py", "def helper():~    return 1~"), ("src/web#.ts", ""), ("pkg#/LICENSE", ""), ("pkg#/src/test_plan#.py", "def test_a():~    pass~"), ("svc#/Dockerfile", ""),
    ("src/lib#.go", "/* go */~"), ("CONTRIBUTING#.md", ""), ("e2e/flow#.spec.ts", ""), ("./src/m#.py", "def again():~    pass~"), ("node_modules/x#/test.js", ""), ("docs#/SECURITY#.md", ""),
    ("web#/package.json", '{"dependencies":{"lodash":"^4.17.#","left-pad":"1.3.0","axios":"^1.2.0"},"devDependencies":{"jest":"^29.0.0","gplkit":"1.0.0"}}'),
    ("app#/pom.xml", "<dependency><groupId>org.a</groupId><artifactId>b</artifactId><version>1.2</version></dependency>"),
]
_FILE_ROWS = _values([(i, *f) for i, f in enumerate(_FILES)], "k, p, head")
_TEXT = "replace(coalesce(text, ''), chr(13), ' ')"
_COMMENT = f"'# ' || replace({_TEXT}, chr(10), chr(10) || '# ')"
_FILL = lambda c: f"replace(replace({c}, '~', chr(10)), '#', cast(doc_id AS STRING))"
_REPO_FILES = f"""SELECT source AS repo, replace(p, '#', cast(doc_id AS STRING)) AS path, doc_id, p,
 CASE WHEN p LIKE '%.py' OR p LIKE '%.txt' THEN {_FILL('head')} || {_COMMENT} WHEN p LIKE '%.json' OR p LIKE '%.xml' THEN {_FILL('head')} ELSE {_FILL('head')} || {_TEXT} END AS content FROM {{documents}} JOIN {_FILE_ROWS} ON doc_id % {len(_FILES)} = k"""
_COMPONENTS = ("structural", "semantic", "security", "comprehension", "compliance", "dependency", "duplication", "api", "advanced_code", "testing", "governance", "intent", "misleading", "change")
_BY_SOURCE = "(SELECT source AS repo, sum(n_chars) AS s, count(*) AS n FROM {documents} GROUP BY source)"
_LINES = (
    "q = 'SELECT * FROM t WHERE id = ' + name; cursor.execute('select ' + x)", "el.innerHTML = name + x; document.write(a + b)", "hashlib.md5(x); random.random()", "password = 'hunter2' # api_key = 'k'", "open('../' + name); f = open(path + '/x')",
    "os.system('rm ' + name)", "pickle.loads(data)", "x = 1",
)
_PREFIXES = (
    "import xml~parser = sax~admin = user~secret token ssn credit card~TODO: random.random() open(\"../x\")~", "cursor.execute(\"select %s\" % name) # SELECT~auth = True~email name age birth~", "def f(x):~    y = 1~", "# consent, privacy: delete and expire, role, secure, safe~",
    "", "execute(\"a\" + \"b\")~subprocess.call(\"ls\" + x)~session = r.get(\"session\")~",
)
_MODULES = (
    "import os~import json~~import requests~from . import sibling~~~class Keeper#:~    def _hidden(self):~        return json.dumps(os.name)~~    def shown(self):~        return self._hidden()~~~def main():~    return Keeper#().shown()~",
    "import os~import sys~~class lower:~    pass~", "def (~", "def f(x):~    y = x~    return g(y)~",
)


def _pick(value: str, texts: tuple) -> str:
    return "CASE " + value + f" % {len(texts)} " + " ".join(f"WHEN {i} THEN {_quoted(t)}" for i, t in enumerate(texts)) + " END"


def _counts() -> str:
    schema, _ = ROWS["counts"]
    told = {"boolean": lambda i: f"(s * {i}) % 3 <> 0", "int": lambda i: f"cast((s * {i}) % {(3, 12, 150)[i % 3]} AS INT)", "double": lambda i: _share(f"s * {i}") + (" * 100" if i % 2 else "")}
    words = {"assessed": (None, "low", "high", "medium"), "misled": ("low", "medium", "high"), "safety": ("high", "low", "very_low")}
    out = []
    for i, f in enumerate(schema.split(", ")[1:], 1):
        name, kind = f.split()
        out.append((_cases(f"(s + {i})", *words[name]) if name in words else told[kind](i)) + f" AS {name}")
    return f"SELECT repo, {', '.join(out)} FROM {_BY_SOURCE}"


#: Paths at a repository's root, in turn.
_ROOT = (
    "SECURITY.md", "LICENSE", "LICENSE.md", "privacy_policy.md", "PRIVACY.md", "Dockerfile", ".github/workflows/security.yml", ".github/dependabot.yml", ".github/workflows/codeql.yml", "requirements.txt", "package.json",
    "hipaa_compliance.md", "gdpr.md", "app.py", "web.ts", "notes.txt", "COPYING",
)
_ID = "cast(doc_id AS STRING)"
SQL: dict[str, str] = {
    "repo_files": f"SELECT repo, path, content FROM ({_REPO_FILES})",
    "root_files": f"SELECT source AS repo, {_cases('(doc_id + n_chars)', *_ROOT)} AS path, {_cases('n_chars', '', 'key = ', 'personal_data phi ', 'MIT ', 'encryption test ', 'requests>=2.0 http://x ', 'https://y encrypt ')} || coalesce(text, '') AS content FROM {{documents}}",
    "risk_levels": f"SELECT repo, component, {_cases('(s + i * n)', 'low', 'medium', 'high', 'critical', None)} AS level FROM {_BY_SOURCE} CROSS JOIN {_values([(c, i) for i, c in enumerate(_COMPONENTS)], 'component, i')}",
    "bounties": "SELECT " + ", ".join([f"{_ID} AS id", *(f"{_share(f'n_chars * {i} + doc_id')} AS {c}" for i, c in enumerate(("complexity", "scope", "quality", "risk", "maturity", "maintainer", "competition", "forensics", "risk_confidence"), 3)), "doc_id % 2 = 0 AS has_tests", "doc_id % 3 = 0 AS has_profile"]) + " FROM {documents}",
    "artifacts": f"SELECT repo, 'a' || {_ID} AS id, {_cases('doc_id', 'HIGH', 'CRITICAL', 'low', 'high', 'MEDIUM', 'critical')} AS severity, CASE WHEN doc_id % 7 = 0 OR p NOT LIKE '%#.%' THEN NULL WHEN doc_id % 11 = 0 THEN 'nowhere.py' ELSE path END AS source_path, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE substr(content, 3, 9) END AS snippet FROM ({_REPO_FILES})",
    "verdicts": f"SELECT {_ID} AS repo, {_cases('doc_id', 'low', 'critical', 'unknown', 'medium', 'minimal', 'high', 'odd', None)} AS level, {_share('n_chars')} AS confidence FROM {{documents}}",
    "expected": f"SELECT source AS repo, {_ID} AS id FROM {{documents}} JOIN (SELECT doc_id AS labelled, quality FROM {{labels}}) ON doc_id = labelled WHERE quality = 0",
    "predicted": f"SELECT source AS repo, {_ID} AS id FROM {{documents}} JOIN (SELECT doc_id AS labelled FROM {{labels}}) ON doc_id = labelled WHERE n_chars < 300",
    "recommendations": f"SELECT source AS repo, cast(doc_id AS INT) AS seq, {_cases('n_chars', 'low', 'critical', 'high', 'medium', 'someday')} AS priority, 'act on ' || {_ID} AS action FROM {{documents}}",
    "commits": """SELECT cast(conv_id AS STRING) || '.' || cast(turn AS STRING) AS sha, CASE WHEN turn = 0 THEN @array() WHEN turn % 3 = 2 THEN @array(cast(conv_id AS STRING) || '.' || cast(turn - 1 AS STRING), cast(conv_id AS STRING) || '.' || cast(turn - 2 AS STRING)) ELSE @array(cast(conv_id AS STRING) || '.' || cast(turn - 1 AS STRING)) END AS parents,
 CASE conv_id % 4 WHEN 0 THEN 'Ann' WHEN 1 THEN 'Bob' WHEN 2 THEN 'ann' ELSE 'Cy' END AS author, CASE conv_id % 4 WHEN 0 THEN 'Ann@x.org' WHEN 1 THEN 'bob@y.org' WHEN 2 THEN 'ann@x.org' ELSE 'cy@z.org' END AS email, cast(conv_id * 10 + turn * (conv_id % 7) AS INT) AS hours,
 CASE WHEN turn % 3 = 2 THEN 'Merge pull request #' || cast(conv_id AS STRING) ELSE text END AS message, cast(length(text) AS INT) AS added, cast(turn AS INT) AS deleted FROM {conversations}""",
    "reputation": """SELECT cast(user_id AS STRING) AS bounty, CASE user_id % 3 WHEN 0 THEN 'hub' ELSE 'lab' END AS platform, 'submitted' AS event, cast(min(event_id) AS DOUBLE) AS hours, cast(NULL AS INT) AS comments FROM {events} GROUP BY user_id
 UNION ALL SELECT cast(user_id AS STRING), CASE user_id % 3 WHEN 0 THEN 'hub' ELSE 'lab' END, 'response', cast(min(event_id) AS DOUBLE), cast(NULL AS INT) FROM {events} WHERE event_type = 'purchase' AND user_id % 5 <> 0 GROUP BY user_id
 UNION ALL SELECT cast(user_id AS STRING), CASE user_id % 3 WHEN 0 THEN 'hub' ELSE 'lab' END, 'merged', cast(max(event_id) AS DOUBLE), cast(count(*) AS INT) FROM {events} WHERE event_type = 'error' AND user_id % 4 <> 1 GROUP BY user_id""",
    "leaves": "SELECT 'a' AS run, source || '/' || coalesce(lang, 'none') AS path, cast(count(*) AS STRING) AS value FROM {documents} GROUP BY source, lang UNION ALL SELECT 'b', source || '/' || coalesce(lang, 'none'), cast(count(*) AS STRING) FROM {documents} WHERE n_chars > 300 GROUP BY source, lang",
    "code_lines": f"SELECT doc_id, source, lang, cast(1 AS INT) AS line_no, {_pick('doc_id', _LINES)} || ' ' || replace({_TEXT}, chr(10), ' ') AS line FROM {{documents}}",
    "code_texts": f"SELECT doc_id, source, replace({_pick('doc_id', _PREFIXES)}, '~', chr(10)) || coalesce(text, '') AS text FROM {{documents}}",
    "api_files": """SELECT CASE page_id % 3 WHEN 0 THEN 'p' || cast(page_id AS STRING) || '/openapi.yaml' WHEN 1 THEN 'p' || cast(page_id AS STRING) || '.postman_collection.json' ELSE 'p' || cast(page_id AS STRING) || '.graphql' END AS rel_path,
 CASE page_id % 3 WHEN 0 THEN '{"paths": {"/p' || cast(page_id AS STRING) || regexp_extract(url, '^[a-z]+://[^/?#]*([^?#" ]*)', 1) || '": {"get": {"description": "d", "responses": {"200": {}}, "security": [{"k": []}]}, "delete": {"responses": {}}, "parameters": [1]}}}'
  WHEN 1 THEN '{"item": [{"item": [{"name": "n", "request": {"method": "POST", "url": {"raw": "/a' || cast(page_id AS STRING) || '"}}}]}, {"request": {"url": "/b' || cast(page_id AS STRING) || '"}}]}'
  ELSE 'type Query {' || chr(10) || '  one' || cast(page_id AS STRING) || '(id: ID): User' || chr(10) || '  two: Int' || chr(10) || '}' || chr(10) END AS content FROM {pages}""",
    "records": f"SELECT CASE doc_id % 4 WHEN 0 THEN 'docs/adr/' WHEN 1 THEN 'docs/decisions/' WHEN 2 THEN 'docs/' ELSE 'x/adr/' END || {_ID} || '.md' AS path, replace('# Title~## Context~We have load.~## Decision~For performance and security.~Alternatives:~- polling~- cron~~Constraints: none~## Status~', '~', chr(10)) || replace({_TEXT}, '#', '') AS content FROM {{documents}}",
    "factors": f"SELECT repo, factor, {_cases('(s + i * n)', 'high', 'medium', 'low', 'very_low', 'odd')} AS level FROM {_BY_SOURCE} CROSS JOIN {_values([(f, i) for i, f in enumerate(('test', 'complexity', 'dependency', 'critical', 'documentation'))], 'factor, i')}",
    "cases": f"SELECT {_ID} AS id, {_share('n_chars')} AS profitability, {_share('n_chars * 7 + doc_id')} AS merge, {_share('doc_id * 13')} AS confidence, (n_chars + doc_id) % 3 = 0 AS outcome FROM {{documents}}",
    "violations": f"SELECT {_cases('doc_id', 'style', 'open')} AS audit, {_cases('n_chars', 'critical', 'high', 'medium', 'major', 'minor', 'low')} AS severity, cast(doc_id % 5 + 1 AS INT) AS files FROM {{documents}}",
    "topics": "SELECT cast(item_id AS STRING) AS topic, replace(replace(replace(text, '.', ''), ',', ''), chr(10), ' ') AS words FROM {benchmark}",
    "clone_files": f"SELECT source AS repo, {_cases('doc_id', 'a', 'b', 'test/c')} || {_ID} || {_cases('n_chars', '.py', '.java', '.js')} AS path, coalesce(text, '') AS content FROM {{documents}}",
    "api_calls": "SELECT regexp_extract(url, '^[a-z]+://([^/?]*)', 1) AS repo, regexp_extract(url, '^[a-z]+://[^/?]*([^ ]*)', 1) AS url, " + _cases("page_id", "GET", "POST", "PUT", "DELETE", "PATCH") + " AS method, cast(page_id % 6 AS INT) AS security FROM {pages}",
    "requests": f"SELECT cast(conv_id AS STRING) AS id, substr(replace(text, chr(10), ' '), 1, 90) AS title, CASE conv_id % 4 WHEN 0 THEN @array('bug', 'p1') WHEN 1 THEN @array('docs') WHEN 2 THEN @array('enhancement') ELSE @array() END AS labels, {_cases('conv_id', 'formal', 'collaborative', 'professional', None)} AS tone, {_share('length(text)')} AS profile, {_share('conv_id * 7')} AS maturity, CASE conv_id % 3 WHEN 0 THEN @array('stability', 'testing') WHEN 1 THEN @array('testing') ELSE @array() END AS focus FROM {{conversations}} WHERE turn = 0",
    "maturities": f"SELECT {_ID} AS repo, {_cases('doc_id', 'stable', 'experimental', 'unknown', 'mature', None)} AS level, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE n_chars % 2 = 0 END AS ci, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE n_chars % 3 = 0 END AS documented, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE {_share('n_chars')} END AS proven FROM {{documents}}",
    "checks": f"SELECT source AS repo, 'check ' || {_ID} AS name, cast(n_chars % 9 AS INT) AS weight, doc_id % 10 = 0 AS critical, {_cases('n_chars', 'PASS', 'PASS', 'PASS', 'FAIL', 'PENDING', 'PASS', 'PASS')} AS status FROM {{documents}}",
    "backtests": f"SELECT {_ID} AS id, doc_id % 2 = 0 AS pursue, n_chars % 3 <> 0 AS merged, {_cases('doc_id', 'high', 'low', 'medium', None)} AS complexity, cast(n_chars % 400 AS INT) AS added, {_cases('n_chars', 'Python', 'Rust', 'python 3', '', None)} AS technology, {_share('n_chars')} * 10 AS seconds FROM {{documents}}",
    "trials": f"SELECT {_cases('doc_id', 'web', 'legacy', 'library', 'other')} AS kind, n_chars % 4 <> 0 AS success, {_cases('n_chars', 'medium', 'high', 'low')} AS risk, cast(n_chars % 6 AS INT) AS issues, {_share('n_chars')} * 20 AS seconds, {_share('doc_id * 31')} * 400 AS memory FROM {{documents}}",
    "runs": "SELECT cast(conv_id AS STRING) AS input, cast(turn AS INT) AS seq, CASE WHEN conv_id % 3 = 0 THEN role ELSE 'same' END AS output, CASE WHEN turn % 5 = 4 THEN NULL ELSE conv_id % 97 <> 3 END AS agreed FROM {conversations}",
    "summaries": f"SELECT repo, cast(n AS BIGINT) AS files, cast(n - s % 2 AS BIGINT) AS kinds, CASE WHEN s % 7 = 0 THEN NULL ELSE cast(n + s % 3 - 1 AS BIGINT) END AS semantic, cast(CASE s % 3 WHEN 0 THEN 8 ELSE 14 END AS BIGINT) AS components, cast(s % 4 AS BIGINT) AS actions, cast(s % 5 AS BIGINT) AS reported FROM {_BY_SOURCE}",
    "findings": f"SELECT repo, section, cast(k AS INT) AS seq, 'n' || cast(k AS STRING) AS name, 'of ' || cast(count(*) AS STRING) || ' files' AS detail FROM (SELECT source AS repo, {_cases('(doc_id + n_chars)', 'Misleading Signals', 'Safe to Change Surface', 'Critical Issues', 'What Not to Fix', 'Executive Verdict')} AS section, n_chars % 4 AS k FROM {{documents}}) GROUP BY repo, section, k",
    "modules": f"SELECT source AS repo, CASE n_chars % 4 WHEN 2 THEN 'bad' ELSE 'm' END || {_ID} || '.py' AS path, replace(replace({_pick('n_chars', _MODULES)}, '~', chr(10)), '#', {_ID}) || {_COMMENT} AS content FROM {{documents}}",
    "counts": _counts(),
    "confidences": "SELECT source AS grp, cast(n_chars % 11 AS DOUBLE) / 10 AS c FROM {documents}",
    "names": f"SELECT {_cases('doc_id', 'part', 'Part', 'PART')} || CASE doc_id % 5 WHEN 0 THEN '_of_' WHEN 1 THEN '-of-' WHEN 2 THEN 'Of' WHEN 3 THEN '_OF_' ELSE ' ' END || substr(coalesce(text, ''), 1, 6) AS name FROM {{documents}}",
    "constraints": f"SELECT source AS repo, cast(doc_id AS INT) AS seq, {_cases('doc_id', 'ceiling', 'constraint', 'factor')} AS kind, {_cases('n_chars', 'chief_architect', 'developer', 'senior_technical_lead', 'technical_lead', 'senior_architect', 'stranger')} AS authority FROM {{documents}}",
}

_TABLE = re.compile(r"\{(\w+)\}")


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = SQL[name].replace("@array()", "cast(array() AS array<string>)").replace("@array(", "array(")
    # Other braces than those around tables stand for themselves.
    told = _TABLE.sub(r"<<\1>>", text).replace("{", "{{").replace("}", "}}").replace("<<", "{").replace(">>", "}")
    return spark.sql(told, **{t: table(spark, sf_dir, t) for t in set(_TABLE.findall(text))})


def derived_sql(name: str) -> str:
    """The same rows as a subquery of DuckDB."""
    return "(" + _TABLE.sub(r"\1", SQL[name].replace("@array()", "[]::VARCHAR[]").replace("@array(", "list_value(")) + ")"
