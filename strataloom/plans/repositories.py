"""Queries about repositories, bounties and runs, on relations derived from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions.scalars import level
from strataloom.operators import signals as S
from strataloom.operators.api_checks import health
from strataloom.operators.dependencies import VULNERABLE, dependencies, dependency_health
from strataloom.operators.risks import WEIGHTS as COMPONENTS
from strataloom.operators.rules import COMPLIANCE, MORE_COMPLIANCE, SECURITY, alternation, compliance, security_findings
from strataloom.operators.symbols import symbols
from strataloom.plans.texts import quoted, ruled
from strataloom.sources.apis import endpoints
from strataloom.sources.derived import derived, derived_sql
from strataloom.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _files(spark, sf_dir) -> DataFrame:
    return derived(spark, sf_dir, "repo_files")


FILES = derived_sql("repo_files")
_EXT = r"lower(regexp_extract(path, '(^|/)[.]*[^./][^/]*([.][^./]*)$', 2))"
_LANG = f"CASE {_EXT} " + " ".join(f"WHEN '{e}' THEN '{n}'" for e, n in S.LANGUAGES.items()) + " ELSE 'Unknown' END"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _any(column: str, needles) -> str:
    return "(" + " OR ".join(f"contains({column}, '{n}')" for n in needles) + ")"


def _ends(column: str, suffixes) -> str:
    return "(" + " OR ".join(f"ends_with({column}, '{s}')" for s in suffixes) + ")"


_TEST = f"({_any('lower(path)', ('test', 'spec'))} AND NOT {_any('lower(path)', ('node_modules', '.git', '__pycache__'))})"
_KIND = f"CASE WHEN {_any('lower(path)', ('unit', 'test_'))} THEN 'unit' WHEN contains(lower(path), 'int') THEN 'integration' WHEN {_any('lower(path)', ('e2e', 'end_to_end'))} THEN 'e2e' ELSE 'other' END"


@query(f"""SELECT repo, path, {_LANG} AS language, {_EXT} IN {_in(S.CODE)} AS is_code, {_EXT} IN {_in(S.CONFIG)} AS is_config, {_TEST} AS is_test,
 CASE WHEN {_TEST} THEN {_KIND} END AS test_kind, {_ends('path', S.CLONED)} AND NOT {_any('lower(path)', S.NOT_CLONED)} AS cloned, {_ends('path', S.SCANNED)} AS scanned,
 CASE WHEN {_ends('path', ('.py', '.rb'))} THEN len(list_filter(string_split(content, chr(10)), lambda x: starts_with(trim(x), '#')))
  WHEN {_ends('path', ('.js', '.ts', '.java', '.c', '.cpp', '.go', '.rs', '.php'))} THEN len(list_filter(string_split(content, chr(10)), lambda x: starts_with(trim(x), '//') OR starts_with(trim(x), '/*') OR contains(x, '*/'))) ELSE 0 END::INT AS comments,
 content[1:20] AS excerpt FROM {FILES}""")
def file_classes(spark, sf_dir):
    """Language, category, kind of test, filters, comment lines and an excerpt of each file."""
    path = F.col("path")
    return _files(spark, sf_dir).select(
        "repo", "path", S.language(path).alias("language"), S.extension(path).isin(*S.CODE).alias("is_code"), S.extension(path).isin(*S.CONFIG).alias("is_config"),
        S.is_test(path).alias("is_test"), F.when(S.is_test(path), S.test_kind(path)).alias("test_kind"),
        (S.ends(path, S.CLONED) & ~S.has(F.lower(path), *S.NOT_CLONED)).alias("cloned"), S.ends(path, S.SCANNED).alias("scanned"),
        S.comment_lines(path, F.col("content")).alias("comments"), F.substring("content", 1, 20).alias("excerpt"),
    )


_SIGNAL_ROWS = ", ".join(f"('{g}', '{label}', '{n}', '{m}')" for g, label, n, m in S.SIGNALS)
_SIGNALS = f"""(SELECT DISTINCT repo, grp, label FROM {FILES} JOIN (VALUES {_SIGNAL_ROWS}) AS s(grp, label, needle, mode)
 ON contains(CASE mode WHEN 'exact' THEN path WHEN 'lower' THEN lower(path) ELSE upper(path) END, needle))"""


@query(f"SELECT * FROM {_SIGNALS}")
def repo_signals(spark, sf_dir):
    """Frameworks, build systems, tools, policies, platforms and documents that a repository shows."""
    return S.signals(_files(spark, sf_dir))


_NORMAL = "(SELECT DISTINCT repo, regexp_replace(regexp_replace(path, '/([.]?/)+', '/', 'g'), '^([.]/)+', '') AS path FROM " + FILES + ")"
_LOWEXT = _EXT.replace("path", "lower(path)")
_COUNTS = f"""(SELECT repo, count(*)::BIGINT AS total, count(*) FILTER ({_LOWEXT} IN {_in(S.CODE)})::BIGINT AS code, count(*) FILTER (contains(lower(path), 'test'))::BIGINT AS test,
 count(*) FILTER ({_LOWEXT} IN {_in(S.CONFIG)})::BIGINT AS config, count(*) FILTER ({_any('lower(path)', ('readme', 'docs'))} OR {_LOWEXT} = '.md')::BIGINT AS docs FROM {_NORMAL} GROUP BY 1)"""


@query(f"SELECT * FROM {_COUNTS}")
def repo_file_counts(spark, sf_dir):
    return S.file_counts(_files(spark, sf_dir))


_UNTESTED = f"""(SELECT repo, path FROM {FILES} m WHERE ends_with(path, '.py') AND NOT EXISTS (
 SELECT 1 FROM (SELECT repo AS r, path AS t FROM {FILES} WHERE {_TEST}) WHERE r = m.repo AND contains(t, 'test_' || regexp_extract(m.path, '([^/]+)[.]py$', 1) || '.py')))"""


@query(f"SELECT * FROM {_UNTESTED}")
def untested_modules(spark, sf_dir):
    return S.untested_modules(_files(spark, sf_dir))


_DEFS = f"(SELECT repo, count(*) FILTER (contains(lower(name), 'test')) AS tests FROM (SELECT repo, unnest(regexp_extract_all(content, 'def\\s+(\\w+)', 1)) AS name FROM {FILES} WHERE ends_with(path, '.py')) GROUP BY 1)"


@query(f"""SELECT repo, n_unit::BIGINT AS unit, n_integration::BIGINT AS integration, n_e2e::BIGINT AS e2e, n_other::BIGINT AS other, round(CASE WHEN code > 0 THEN test / code::DOUBLE ELSE 0 END, 6) AS test_to_code,
 round(CASE WHEN code > 0 THEN test / (code + test)::DOUBLE * 100 ELSE 0 END, 4) AS test_percent, untested::BIGINT AS untested,
 round(((CASE WHEN test / greatest(code, 1)::DOUBLE > 0.5 THEN 1 WHEN test / greatest(code, 1)::DOUBLE > 0.2 THEN 0.5 ELSE 0 END) + (CASE WHEN frameworks > 0 THEN 1 ELSE 0 END) + (CASE WHEN tests > 10 THEN 1 WHEN tests > 0 THEN 0.5 ELSE 0 END)) / 5, 6)::DOUBLE AS maturity,
 concat_ws(',', 'missing_test_directory', CASE WHEN (CASE WHEN code > 0 THEN test / code::DOUBLE ELSE 0 END) < 0.1 THEN 'low_test_coverage' END, CASE WHEN untested > 5 THEN 'untested_modules' END) AS gaps
FROM {_COUNTS} JOIN (SELECT repo, count(*) FILTER ({_TEST} AND {_KIND} = 'unit') AS n_unit, count(*) FILTER ({_TEST} AND {_KIND} = 'integration') AS n_integration, count(*) FILTER ({_TEST} AND {_KIND} = 'e2e') AS n_e2e, count(*) FILTER ({_TEST} AND {_KIND} = 'other') AS n_other FROM {FILES} GROUP BY 1) USING (repo)
LEFT JOIN (SELECT repo, count(*) AS frameworks FROM {_SIGNALS} WHERE grp = 'test_framework' GROUP BY 1) USING (repo)
LEFT JOIN (SELECT repo, coalesce(u, 0) AS untested FROM (SELECT DISTINCT repo FROM {FILES}) LEFT JOIN (SELECT repo, count(*) AS u FROM {_UNTESTED} GROUP BY 1) USING (repo)) USING (repo) LEFT JOIN {_DEFS} USING (repo)""")
def test_signals(spark, sf_dir):
    """Kinds of tests, ratios, untested modules, maturity of five points and gaps.

    A list of files holds no directories, so a missing test directory is always
    told and the point for one is never given."""
    return _test_signals(_files(spark, sf_dir))


def _test_signals(files: DataFrame) -> DataFrame:
    path = F.col("path")
    kinds = files.filter(S.is_test(path)).groupBy("repo").agg(*(F.count_if(S.test_kind(path) == k).alias(k) for k in ("unit", "integration", "e2e", "other")))
    frameworks = S.signals(files).filter("grp = 'test_framework'").groupBy("repo").agg(F.count(F.lit(1)).alias("frameworks"))
    untested = S.untested_modules(files).groupBy("repo").agg(F.count(F.lit(1)).alias("untested"))
    names = F.regexp_extract_all("content", F.lit(r"def\s+(\w+)"), 1)
    defined = files.filter(path.endswith(".py")).groupBy("repo").agg(F.sum(F.size(F.filter(names, lambda x: F.lower(x).contains("test")))).alias("tests"))
    out = S.file_counts(files)
    for more in (kinds, frameworks, untested, defined):
        out = out.join(more, "repo", "left")
    ratio = F.col("test") / F.greatest("code", F.lit(1))
    told = F.when(F.col("code") > 0, ratio).otherwise(0.0)
    points = (
        level(ratio, [(0.5000001, 1.0), (0.2000001, 0.5)], 0.0) + F.when(F.col("frameworks") > 0, 1.0).otherwise(0.0)
        + F.when(F.col("tests") > 10, 1.0).when(F.col("tests") > 0, 0.5).otherwise(0.0)
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(
        "repo", zero("unit"), zero("integration"), zero("e2e"), zero("other"), F.round(told, 6).alias("test_to_code"),
        F.round(F.when(F.col("code") > 0, F.col("test") / (F.col("code") + F.col("test")) * 100).otherwise(0.0), 4).alias("test_percent"), zero("untested"), F.round(points / 5, 6).alias("maturity"),
        F.concat_ws(",", F.lit("missing_test_directory"), F.when(told < 0.1, "low_test_coverage"), F.when(F.col("untested") > 5, "untested_modules")).alias("gaps"),
    )


# Needles of the governance score, in lower or upper case where compared so.
_CI = (".github/workflows", ".gitlab-ci", "Jenkinsfile")
_QUALITY = ("pylint", "flake8", "black", "pre-commit")
_SECURITY = ("security.md", "dependabot", "bandit")
_DOCUMENTS = ("README", "CONTRIBUTING", "LICENSE", "CHANGELOG")
_MANIFESTS = ("requirements.txt", "pyproject.toml", "package.json", "Cargo.toml")


def _or(column: str, needles) -> str:
    return f"coalesce(bool_or({_any(column, needles)}), false)"


@query(f"""SELECT repo, round((ci::INT + quality::INT + security::INT + (d0::INT + d1::INT + d2::INT + d3::INT) / 4.0 + manifests::INT + 0.5 * framework::INT + 0.5 * ignored::INT + 0.5 * legal::INT) / 8, 6)::DOUBLE AS maturity,
 concat_ws(',', CASE WHEN NOT ci THEN 'missing_ci_cd' END, CASE WHEN NOT quality_gap THEN 'missing_code_quality' END, CASE WHEN NOT security_gap THEN 'missing_security_practices' END, CASE WHEN NOT (d0 AND d2) THEN 'incomplete_documentation' END) AS gaps
FROM (SELECT repo, {_or('path', _CI)} AS ci, {_or('lower(path)', (*_QUALITY, 'mypy'))} AS quality, {_or('lower(path)', _QUALITY)} AS quality_gap, {_or('lower(path)', (*_SECURITY, 'safety'))} AS security, {_or('lower(path)', _SECURITY)} AS security_gap,
 {', '.join(f"{_or('upper(path)', (d,))} AS d{i}" for i, d in enumerate(_DOCUMENTS))}, {_or('path', _MANIFESTS)} AS manifests, {_or('lower(path)', ('pytest', 'unittest', 'jest', 'mocha'))} AS framework, {_or('path', ('.gitignore',))} AS ignored, {_or('upper(path)', ('LICENSE', 'CODE_OF_CONDUCT'))} AS legal FROM {FILES} GROUP BY 1)""")
def governance_maturity(spark, sf_dir):
    """Governance score of eight points (6.5 can be reached) and gaps, in one pass."""
    path, low, up = F.col("path"), F.lower("path"), F.upper("path")
    flags = {
        "ci": S.has(path, *_CI), "quality": S.has(low, *_QUALITY, "mypy"), "quality_gap": S.has(low, *_QUALITY), "security": S.has(low, *_SECURITY, "safety"), "security_gap": S.has(low, *_SECURITY),
        "manifests": S.has(path, *_MANIFESTS), "framework": S.has(low, "pytest", "unittest", "jest", "mocha"), "ignored": path.contains(".gitignore"), "legal": S.has(up, "LICENSE", "CODE_OF_CONDUCT"),
        **{d: up.contains(d) for d in _DOCUMENTS},
    }
    rows = _files(spark, sf_dir).groupBy("repo").agg(*(F.bool_or(c).alias(n) for n, c in flags.items()))
    weights = {"ci": 1.0, "quality": 1.0, "security": 1.0, "manifests": 1.0, "framework": 0.5, "ignored": 0.5, "legal": 0.5} | dict.fromkeys(_DOCUMENTS, 0.25)
    score = sum((F.when(F.col(n), w).otherwise(0.0) for n, w in weights.items()), F.lit(0.0))
    gaps = F.concat_ws(
        ",", F.when(~F.col("ci"), "missing_ci_cd"), F.when(~F.col("quality_gap"), "missing_code_quality"),
        F.when(~F.col("security_gap"), "missing_security_practices"), F.when(~(F.col("README") & F.col("LICENSE")), "incomplete_documentation"),
    )
    return rows.select("repo", F.round(score / 8, 6).alias("maturity"), gaps.alias("gaps"))


#: Intent, points, needles and how the path is compared; ties go to the first.
INTENTS = ("library", "application", "tool", "framework", "research", "educational", "infrastructure")
POINTS = (
    ("library", 2, ("__init__.py",), "path"), ("library", 1, ("setup.py", "pyproject.toml"), "path"), ("application", 2, ("main.py",), "path"), ("application", 1, ("app.py", "application.py"), "path"),
    ("tool", 2, ("cli", "command"), "lower(path)"), ("tool", 1, ("argparse", "click"), "content"), ("research", 2, ("research", "experiment"), "lower(path)"), ("research", 1, ("notebook", ".ipynb"), "lower(path)"),
    ("educational", 1, ("tutorial", "example", "lesson"), "lower(path)"), ("infrastructure", 2, ("docker", "kubernetes", "terraform"), "lower(path)"), ("infrastructure", 1, ("ci", "cd", "pipeline"), "lower(path)"),
)
_INTENT_SQL = " UNION ALL ".join(
    f"SELECT repo, '{i}' AS intent, {INTENTS.index(i)} AS seq, max(CASE WHEN {_any(c, n)} THEN {p} ELSE 0 END) AS points FROM {FILES} GROUP BY 1" for i, p, n, c in POINTS
) + f" UNION ALL SELECT repo, 'framework', 3, CASE WHEN count(DISTINCT CASE WHEN {_EXT} IN {_in(S.CODE)} THEN path END) > 50 AND bool_or(contains(lower(path), 'template')) THEN 1 ELSE 0 END FROM {FILES} GROUP BY 1"


@query(f"""WITH s AS (SELECT repo, intent, min(seq) AS seq, sum(points)::BIGINT AS score FROM ({_INTENT_SQL}) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY score DESC, seq) AS first, row_number() OVER (PARTITION BY repo ORDER BY score DESC, intent) AS place FROM s)
SELECT repo, max(CASE WHEN first = 1 THEN intent END) AS primary_intent, max(score) AS score, (CASE WHEN max(score) > 0 THEN 1 ELSE 0 END)::DOUBLE AS confidence, max(CASE WHEN place = 2 THEN intent END) AS second, max(CASE WHEN place = 3 THEN intent END) AS third FROM r GROUP BY 1""")
def intent_posture(spark, sf_dir):
    """Primary and secondary intents by seven scores, ties by their order or name."""
    columns = {"path": F.col("path"), "lower(path)": F.lower("path"), "content": F.col("content")}
    big = F.countDistinct(F.when(S.extension(F.col("path")).isin(*S.CODE), F.col("path"))) > 50
    rows = _files(spark, sf_dir).groupBy("repo").agg(
        *(F.when(F.bool_or(S.has(columns[c], *n)), p).otherwise(0).alias(f"p{k}") for k, (_, p, n, c) in enumerate(POINTS)),
        F.when(big & F.bool_or(F.lower("path").contains("template")), 1).otherwise(0).alias("framework"),
    )
    total = lambda i: sum((F.col(f"p{k}") for k, x in enumerate(POINTS) if x[0] == i), F.col("framework") if i == "framework" else F.lit(0))
    scores = F.array(*(F.struct(total(i).cast("long").alias("score"), F.lit(-n).alias("order"), F.lit(i).alias("intent")) for n, i in enumerate(INTENTS)))
    best = F.array_max(scores)
    by_name = F.array_sort(scores, lambda a, b: F.when(a["score"] != b["score"], (b["score"] - a["score"]).cast("int")).when(a["intent"] < b["intent"], -1).otherwise(1))
    return rows.select("repo", best["intent"].alias("primary_intent"), best["score"].alias("score"), F.when(best["score"] > 0, 1.0).otherwise(0.0).alias("confidence"), by_name[1]["intent"].alias("second"), by_name[2]["intent"].alias("third"))


def _flag(name: str, condition: str) -> str:
    return f"CASE WHEN {condition} THEN '{name}' END"


@query(f"""SELECT repo, concat_ws(',', {_flag('missing_documentation', 'code > 50 AND docs = 0')}, {_flag('multiple_readmes', 'readmes > 1')}, {_flag('ci_without_security', 'ci')}, {_flag('todo_without_tests', 'todo AND maturity < 0.3')}, {_flag('missing_ci_cd', 'NOT ci')}) AS signals,
 (code > 50 AND docs = 0)::INT + (readmes > 1)::INT + ci::INT + (todo AND maturity < 0.3)::INT + (NOT ci)::INT AS n, CASE WHEN (code > 50 AND docs = 0)::INT + (readmes > 1)::INT + ci::INT + (todo AND maturity < 0.3)::INT + (NOT ci)::INT >= 5 THEN 'high' WHEN (code > 50 AND docs = 0)::INT + (readmes > 1)::INT + ci::INT + (todo AND maturity < 0.3)::INT + (NOT ci)::INT >= 3 THEN 'medium' ELSE 'low' END AS risk
FROM {_COUNTS} JOIN (SELECT repo, count(*) FILTER (contains(lower(path), 'readme')) AS readmes, bool_or({_any('path', ('.github/workflows', '.gitlab-ci.yml', 'Jenkinsfile', 'azure-pipelines.yml', 'bitbucket-pipelines.yml', '.travis.yml', 'circle.yml'))}) AS ci, bool_or({_any('lower(path)', ('todo', 'fixme'))}) AS todo FROM {FILES} GROUP BY 1) USING (repo)
JOIN (SELECT repo, maturity FROM (@test_signals@)) USING (repo)""")
def misleading_signals(spark, sf_dir):
    """Five detectors that files alone can answer, and their risk ladder."""
    files = _files(spark, sf_dir)
    ci = S.signals(files).filter("grp = 'ci_platform'").select("repo").distinct().withColumn("ci", F.lit(True))
    low = F.lower("path")
    told = files.groupBy("repo").agg(F.count_if(low.contains("readme")).alias("readmes"), F.bool_or(S.has(low, "todo", "fixme")).alias("todo"))
    rows = S.file_counts(files).join(told, "repo").join(_test_signals(files).select("repo", "maturity"), "repo").join(ci, "repo", "left").withColumn("ci", F.coalesce("ci", F.lit(False)))
    found = {
        "missing_documentation": (F.col("code") > 50) & (F.col("docs") == 0), "multiple_readmes": F.col("readmes") > 1, "ci_without_security": F.col("ci"),
        "todo_without_tests": F.col("todo") & (F.col("maturity") < 0.3), "missing_ci_cd": ~F.col("ci"),
    }
    rows = rows.select("repo", F.array_compact(F.array(*(F.when(c, n) for n, c in found.items()))).alias("s")).withColumn("n", F.size("s"))
    return rows.select("repo", F.array_join("s", ",").alias("signals"), "n", level(F.col("n"), [(5, "high"), (3, "medium")], "low").alias("risk"))


SQL["misleading_signals"] = SQL["misleading_signals"].replace("@test_signals@", SQL["test_signals"])


_DEPS = f"""(SELECT repo, 'python' AS ecosystem, regexp_extract(line, '^([a-zA-Z0-9_-]+)', 1) AS name, line AS spec FROM (SELECT repo, trim(unnest(string_split(content, chr(10)))) AS line FROM {FILES} WHERE ends_with(path, '/requirements.txt')) WHERE line <> '' AND NOT starts_with(line, '#')
 UNION ALL SELECT repo, 'javascript', k, json_extract_string(content, '$.' || s || '."' || k || '"') FROM (SELECT repo, content, s, unnest(json_keys(content, '$.' || s)) AS k FROM {FILES}, (VALUES ('dependencies'), ('devDependencies')) AS x(s) WHERE ends_with(path, '/package.json'))
 UNION ALL SELECT repo, 'java', 'org.a:b', '1.2' FROM {FILES} WHERE ends_with(path, '/pom.xml'))"""
_VULN = ", ".join(f"('{e}', '{n}')" for e, n, _ in VULNERABLE)


@query(f"SELECT * FROM {_DEPS}")
def dependency_list(spark, sf_dir):
    return dependencies(_files(spark, sf_dir)).select("repo", "ecosystem", "name", "spec")


@query(f"""SELECT repo, count(name)::BIGINT AS packages, count(v)::BIGINT AS vulnerable, count(*) FILTER (contains(lower(name), 'gpl'))::BIGINT AS licence_issues, count(*) FILTER (starts_with(spec, '1.') OR starts_with(spec, '^1.'))::BIGINT AS outdated,
 greatest(0, 100 - least(10 * count(v), 40) - least(5 * count(*) FILTER (contains(lower(name), 'gpl')), 20) - least(2 * count(*) FILTER (starts_with(spec, '1.') OR starts_with(spec, '^1.')), 20) - CASE WHEN count(name) = 0 THEN 30 ELSE 0 END)::BIGINT AS health
FROM (SELECT DISTINCT repo FROM {FILES}) LEFT JOIN {_DEPS} USING (repo) LEFT JOIN (VALUES {_VULN}) AS x(e, v) ON e = ecosystem AND v = lower(name) GROUP BY 1""")
def dependency_summary(spark, sf_dir):
    """Vulnerable, licensed and outdated packages, and the health score."""
    return dependency_health(_files(spark, sf_dir))


# Weights of the risk components (23 in all), and of the triage score.
TRIAGE = {"complexity": 0.13, "scope": 0.10, "quality": 0.10, "risk": 0.13, "maturity": 0.10, "maintainer": 0.10, "competition": 0.20, "forensics": 0.14}
_WEIGHTS = ", ".join(f"('{c}', {w})" for c, w in COMPONENTS.items())


@query(f"""SELECT repo, round(m, 6)::DOUBLE AS risk, CASE WHEN m >= 2.5 THEN 'high' WHEN m >= 1.8 THEN 'medium' ELSE 'low' END AS level, n AS components FROM (
SELECT repo, sum(weight * CASE level WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) / sum(weight)::DOUBLE AS m, count(*)::BIGINT AS n FROM {derived_sql('risk_levels')} JOIN (VALUES {_WEIGHTS}) AS w(component, weight) USING (component) GROUP BY 1)""")
def risk_synthesis(spark, sf_dir):
    """Weighted mean of 14 component levels; any level but medium and high counts as low."""
    return weighted_risk(derived(spark, sf_dir, "risk_levels"))


def weighted_risk(levels: DataFrame) -> DataFrame:
    weights = F.create_map(*(F.lit(x) for pair in COMPONENTS.items() for x in pair))
    rows = levels.withColumn("w", F.try_element_at(weights, F.col("component"))).filter("w is not null")
    points = F.when(F.col("level") == "high", 3).when(F.col("level") == "medium", 2).otherwise(1)
    out = rows.groupBy("repo").agg((F.sum(points * F.col("w")) / F.sum("w")).alias("m"), F.count(F.lit(1)).alias("components"))
    return out.select("repo", F.round("m", 6).alias("risk"), level(F.col("m"), [(2.5, "high"), (1.8, "medium")], "low").alias("level"), "components")


_SCORE = " + ".join(f"{w} * {'(1 - ' + c + ')' if c in ('complexity', 'scope') else c}" for c, w in TRIAGE.items())


@query(f"""SELECT id, round(s, 6)::DOUBLE AS score, CASE WHEN s >= 0.8 THEN 'HIGH_PRIORITY' WHEN s >= 0.6 THEN 'MEDIUM_PRIORITY' WHEN s >= 0.4 THEN 'LOW_PRIORITY' ELSE 'REJECT' END AS decision,
 round(least((risk_confidence + CASE WHEN has_tests THEN 1 ELSE 0.5 END + CASE WHEN has_profile THEN 1 ELSE 0.3 END) / 3, 0.99999), 6)::DOUBLE AS confidence, row_number() OVER (ORDER BY s DESC, id)::INT AS place FROM (SELECT *, greatest(0, least(1, ({_SCORE})::DOUBLE)) AS s FROM {derived_sql('bounties')})""")
def bounty_triage(spark, sf_dir):
    """Profitability of eight weighted scores, decision, confidence and place."""
    parts = [(1 - F.col(c) if c in ("complexity", "scope") else F.col(c)) * w for c, w in TRIAGE.items()]
    rows = derived(spark, sf_dir, "bounties").withColumn("s", F.greatest(F.lit(0.0), F.least(F.lit(1.0), sum(parts[1:], parts[0]))))
    confidence = (F.col("risk_confidence") + F.when(F.col("has_tests"), 1.0).otherwise(0.5) + F.when(F.col("has_profile"), 1.0).otherwise(0.3)) / 3
    ladder = level(F.col("s"), [(0.8, "HIGH_PRIORITY"), (0.6, "MEDIUM_PRIORITY"), (0.4, "LOW_PRIORITY")], "REJECT")
    place = F.row_number().over(Window.orderBy(F.desc("s"), "id"))  # a report of one list
    return rows.select("id", F.round("s", 6).alias("score"), ladder.alias("decision"), F.round(F.least(confidence, F.lit(0.99999)), 6).alias("confidence"), place.alias("place"))


@query(f"""WITH kept AS (SELECT * FROM {derived_sql('artifacts')} WHERE NOT (coalesce(upper(severity), '') IN ('HIGH', 'CRITICAL') AND source_path IS NULL)),
m AS (SELECT k.*, f.path, f.content, row_number() OVER (PARTITION BY k.id ORDER BY f.path) AS n FROM kept k LEFT JOIN {FILES} f ON f.repo = k.repo AND ends_with(f.path, k.source_path)),
o AS (SELECT *, CASE WHEN snippet IS NOT NULL AND trim(snippet) <> '' THEN instr(content, snippet) ELSE 0 END AS spot FROM m WHERE n = 1)
SELECT id, severity, path, CASE WHEN spot > 0 THEN len(string_split(content[1:spot - 1], chr(10))) WHEN path IS NOT NULL THEN 1 END::INT AS first_line,
 CASE WHEN spot > 0 THEN len(string_split(content[1:spot - 1], chr(10))) + len(string_split(snippet, chr(10))) - 1 WHEN path IS NOT NULL THEN greatest(1, len(string_split(content, chr(10))) - CASE WHEN ends_with(content, chr(10)) THEN 1 ELSE 0 END) END::INT AS last_line,
 CASE WHEN spot > 0 THEN strlen(content[1:spot - 1]) WHEN path IS NOT NULL THEN 0 END::INT AS first_byte, CASE WHEN spot > 0 THEN strlen(content[1:spot - 1]) + strlen(snippet) WHEN path IS NOT NULL THEN strlen(content) END::INT AS last_byte FROM o""")
def evidence_filter(spark, sf_dir):
    """Artefacts without the severe ones that lack evidence, each with the lines and bytes of its evidence."""
    severe = F.coalesce(F.upper("severity"), F.lit("")).isin("HIGH", "CRITICAL")
    kept = derived(spark, sf_dir, "artifacts").filter(~(severe & F.col("source_path").isNull()))
    # The last name of both paths is equal where one path ends the other, which makes an equal join.
    name = lambda c: F.regexp_extract(c, "[^/]*$", 0)
    files = _files(spark, sf_dir).select("repo", "path", "content", name("path").alias("name"))
    found = kept.withColumn("name", name("source_path")).join(files.drop("content"), ["repo", "name"]).filter(F.endswith("path", "source_path"))
    # Paths are chosen first, so that one content an artefact is moved.
    first = found.groupBy("id").agg(F.min(F.struct("path", "repo")).alias("f")).select("id", "f.*").join(files.drop("name"), ["repo", "path"]).select("id", "path", "content")
    at = F.when(F.trim(F.coalesce("snippet", F.lit(""))) != "", F.instr("content", F.col("snippet"))).otherwise(0)
    rows = kept.join(first, "id", "left").select("id", "severity", "snippet", "path", "content").withColumn("at", at)
    lines = lambda c: F.size(F.split(c, "\n"))
    before, hit, known = F.expr("substring(content, 1, at - 1)"), F.col("at") > 0, F.col("path").isNotNull()
    whole = F.greatest(F.lit(1), lines("content") - F.col("content").endswith("\n").cast("int"))
    return rows.select(
        "id", "severity", "path", F.when(hit, lines(before)).when(known, 1).alias("first_line"), F.when(hit, lines(before) + lines("snippet") - 1).when(known, whole).alias("last_line"),
        F.when(hit, F.octet_length(before)).when(known, 0).alias("first_byte"), F.when(hit, F.octet_length(before) + F.octet_length("snippet")).when(known, F.octet_length("content")).alias("last_byte"),
    )


@query(f"SELECT repo, CASE WHEN confidence < 0.5 THEN 'INSUFFICIENT_EVIDENCE' WHEN level IN ('low', 'minimal') THEN 'PASS' WHEN level IN ('high', 'critical') THEN 'FAIL' WHEN level = 'medium' THEN 'CAUTION' ELSE 'INSUFFICIENT_EVIDENCE' END AS verdict FROM {derived_sql('verdicts')}")
def verdict_ladder(spark, sf_dir):
    risk = F.col("level")
    verdict = F.when(F.col("confidence") < 0.5, "INSUFFICIENT_EVIDENCE").when(risk.isin("low", "minimal"), "PASS").when(risk.isin("high", "critical"), "FAIL").when(risk == "medium", "CAUTION").otherwise("INSUFFICIENT_EVIDENCE")
    return derived(spark, sf_dir, "verdicts").select("repo", verdict.alias("verdict"))


_GOLDEN = f"(SELECT coalesce(e.repo, p.repo) AS repo, e.id IS NOT NULL AS wanted, p.id IS NOT NULL AS said FROM {derived_sql('expected')} e FULL JOIN {derived_sql('predicted')} p ON e.repo = p.repo AND e.id = p.id)"


@query(f"""SELECT coalesce(repo, 'all') AS repo, count(*) FILTER (wanted AND said)::BIGINT AS tp, count(*) FILTER (said AND NOT wanted)::BIGINT AS fp, count(*) FILTER (wanted AND NOT said)::BIGINT AS fn,
 round(count(*) FILTER (wanted AND said) / nullif(count(*) FILTER (said), 0)::DOUBLE, 6) AS precision_, round(count(*) FILTER (wanted AND said) / nullif(count(*) FILTER (wanted), 0)::DOUBLE, 6) AS recall FROM {_GOLDEN} GROUP BY GROUPING SETS ((repo), ())""")
def golden_calibration(spark, sf_dir):
    """Predicted against expected findings by a full outer join, by repository and in all."""
    wanted, said = derived(spark, sf_dir, "expected").withColumn("wanted", F.lit(True)), derived(spark, sf_dir, "predicted").withColumn("said", F.lit(True))
    both = wanted.join(said, ["repo", "id"], "full").na.fill(False)
    tp = F.count_if(F.col("wanted") & F.col("said"))
    out = both.rollup("repo").agg(
        tp.alias("tp"), F.count_if(F.col("said") & ~F.col("wanted")).alias("fp"), F.count_if(F.col("wanted") & ~F.col("said")).alias("fn"),
        F.round(F.try_divide(tp, F.count_if("said")), 6).alias("precision_"), F.round(F.try_divide(tp, F.count_if("wanted")), 6).alias("recall"),
    )
    return out.withColumn("repo", F.coalesce("repo", F.lit("all")))


@query(f"SELECT repo, action, priority, row_number() OVER (PARTITION BY repo ORDER BY CASE priority WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, seq)::INT AS place FROM {derived_sql('recommendations')}")
def priority_sort(spark, sf_dir):
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, ("critical", "high", "medium", "low"))), F.col("priority")), F.lit(0))
    order = Window.partitionBy("repo").orderBy(F.when(rank == 0, 5).otherwise(rank), "seq")
    return derived(spark, sf_dir, "recommendations").select("repo", "action", "priority", F.row_number().over(order).alias("place"))


@query(f"""WITH c AS {derived_sql('commits')} SELECT m.sha, lower(m.author) AS author, (m.hours - p.hours)::INT AS latency, CASE WHEN contains(lower(m.message), 'performance') THEN 'performance' WHEN contains(lower(m.message), 'security') THEN 'security' WHEN contains(lower(m.message), 'api') THEN 'api_design' WHEN contains(lower(m.message), 'data') THEN 'data_structure' ELSE 'implementation' END AS decision,
 len(m.parents) > 1 AS is_merge, coalesce(nullif(regexp_extract(m.message, '#(\\d+)', 1), ''), 'none') AS request, (m.added + m.deleted)::INT AS churn FROM c m LEFT JOIN c p ON p.sha = m.parents[2]""")
def commit_history(spark, sf_dir):
    """Merge latency from the second parent, kind of decision, request number and churn of each commit."""
    commits = derived(spark, sf_dir, "commits")
    parent = commits.select(F.col("sha").alias("second"), F.col("hours").alias("since"))
    low = F.lower("message")
    kind = F.when(low.contains("performance"), "performance").when(low.contains("security"), "security").when(low.contains("api"), "api_design").when(low.contains("data"), "data_structure").otherwise("implementation")
    request = F.coalesce(F.nullif(F.regexp_extract("message", r"#(\d+)", 1), F.lit("")), F.lit("none"))
    rows = commits.withColumn("second", F.get("parents", F.lit(1))).join(parent, "second", "left")
    return rows.select("sha", F.lower("author").alias("author"), (F.col("hours") - F.col("since")).alias("latency"), kind.alias("decision"), (F.size("parents") > 1).alias("is_merge"), request.alias("request"), (F.col("added") + F.col("deleted")).alias("churn"))


@query(f"SELECT lower(email) AS email, count(*)::BIGINT AS commits, sum(added + deleted)::BIGINT AS churn, count(*) FILTER (len(parents) > 1)::BIGINT AS merges FROM {derived_sql('commits')} WHERE contains(lower(author), 'an') OR contains(lower(email), 'bob') GROUP BY 1")
def author_churn(spark, sf_dir):
    """Commits, churn and merges of the authors whose name or address holds a text."""
    rows = derived(spark, sf_dir, "commits").filter(F.lower("author").contains("an") | F.lower("email").contains("bob"))
    return rows.groupBy(F.lower("email").alias("email")).agg(F.count(F.lit(1)).alias("commits"), F.sum(F.col("added") + F.col("deleted")).alias("churn"), F.count_if(F.size("parents") > 1).alias("merges"))


_EVENTS = f"""(SELECT s.bounty, s.platform, r.hours - s.hours AS latency, m.hours - s.hours AS merge, m.comments FROM (SELECT * FROM {derived_sql('reputation')} WHERE event = 'submitted') s
 LEFT JOIN (SELECT * FROM {derived_sql('reputation')} WHERE event = 'response') r USING (bounty) LEFT JOIN (SELECT * FROM {derived_sql('reputation')} WHERE event = 'merged') m USING (bounty))"""


@query(f"""SELECT coalesce(platform, 'all') AS platform, count(*)::BIGINT AS submitted, count(merge)::BIGINT AS merged, round(avg(latency), 6) AS mean_latency, median(latency)::DOUBLE AS median_latency, round(avg(merge), 6) AS mean_merge,
 round(greatest(0, 1 - coalesce(avg(merge), 0) / 168), 6)::DOUBLE AS merge_roi, round(greatest(0, 1 - coalesce(avg(comments), 0) / 10), 6)::DOUBLE AS review_roi FROM {_EVENTS} GROUP BY GROUPING SETS ((platform), ())""")
def reputation_roi(spark, sf_dir):
    """Latencies from submission to response and merge, and the returns they mean."""
    rows = derived(spark, sf_dir, "reputation")
    of = lambda event, *columns: rows.filter(F.col("event") == event).select("bounty", *columns)
    out = of("submitted", "platform", F.col("hours").alias("since")).join(of("response", F.col("hours").alias("responded")), "bounty", "left")
    out = out.join(of("merged", F.col("hours").alias("done"), "comments"), "bounty", "left").withColumn("latency", F.col("responded") - F.col("since")).withColumn("merge", F.col("done") - F.col("since"))
    roi = lambda c, most: F.round(F.greatest(F.lit(0.0), 1 - F.coalesce(F.avg(c), F.lit(0)) / most), 6)
    out = out.rollup("platform").agg(
        F.count(F.lit(1)).alias("submitted"), F.count("merge").alias("merged"), F.round(F.avg("latency"), 6).alias("mean_latency"), F.median("latency").alias("median_latency"),
        F.round(F.avg("merge"), 6).alias("mean_merge"), roi("merge", 168).alias("merge_roi"), roi("comments", 10).alias("review_roi"),
    )
    return out.withColumn("platform", F.coalesce("platform", F.lit("all")))


@query(f"SELECT coalesce(a.path, b.path) AS path, a.value AS left_value, b.value AS right_value FROM (SELECT * FROM {derived_sql('leaves')} WHERE run = 'a') a FULL JOIN (SELECT * FROM {derived_sql('leaves')} WHERE run = 'b') b ON a.path = b.path WHERE a.value IS DISTINCT FROM b.value")
def leaf_differences(spark, sf_dir):
    """Leaves of two runs' results that differ; a null leaf equals a null or missing one."""
    rows = derived(spark, sf_dir, "leaves")
    run = lambda r, name: rows.filter(F.col("run") == r).select("path", F.col("value").alias(name))
    return run("a", "left_value").join(run("b", "right_value"), "path", "full").filter(~F.col("left_value").eqNullSafe(F.col("right_value")))


_SLUG = "trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-')"


@query(f"""SELECT name, CASE WHEN regexp_full_match(name, '[A-Z][A-Z0-9]*(_[A-Z0-9]+)+') THEN 'screaming' WHEN regexp_full_match(name, '[a-z0-9]+(_[a-z0-9]+)+') THEN 'snake' WHEN regexp_full_match(name, '[a-z0-9]+(-[a-z0-9]+)+') THEN 'kebab'
 WHEN regexp_full_match(name, '[a-z]+([A-Z][a-z0-9]*)+') THEN 'camel' WHEN regexp_full_match(name, '([A-Z][a-z0-9]+)+') THEN 'pascal' WHEN regexp_full_match(name, '[a-z0-9]+') THEN 'plain' ELSE 'other' END AS style, {_SLUG} AS slug FROM {derived_sql('names')}""")
def naming_styles(spark, sf_dir):
    """Naming case and slug of identifiers."""
    name, style = F.col("name"), None
    for label, pattern in (("screaming", "[A-Z][A-Z0-9]*(_[A-Z0-9]+)+"), ("snake", "[a-z0-9]+(_[a-z0-9]+)+"), ("kebab", "[a-z0-9]+(-[a-z0-9]+)+"), ("camel", "[a-z]+([A-Z][a-z0-9]*)+"), ("pascal", "([A-Z][a-z0-9]+)+"), ("plain", "[a-z0-9]+")):
        style = (F if style is None else style).when(name.rlike(f"^(?:{pattern})$"), label)
    slug = F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-"))
    return derived(spark, sf_dir, "names").select("name", style.otherwise("other").alias("style"), slug.alias("slug"))


#: Levels of authority, the least level is the highest.
AUTHORITY = {"chief_architect": 1, "senior_architect": 2, "senior_technical_lead": 3, "technical_lead": 4, "developer": 5}
_AUTH = "CASE authority " + " ".join(f"WHEN '{a}' THEN {n}" for a, n in AUTHORITY.items()) + " ELSE 5 END"


@query(f"""WITH c AS (SELECT *, {_AUTH} AS l FROM {derived_sql('constraints')}), f AS (SELECT *, min(l) OVER (PARTITION BY repo ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c)
SELECT repo, min(l)::INT AS level, coalesce(string_agg(kind || seq, ',' ORDER BY seq) FILTER (l < before), '') AS applied FROM f GROUP BY 1""")
def authority_ceiling(spark, sf_dir):
    """Constraints that lower the level reached so far, in order, and the last level."""
    levels = F.create_map(*(F.lit(x) for pair in AUTHORITY.items() for x in pair))
    rows = derived(spark, sf_dir, "constraints").withColumn("l", F.coalesce(F.try_element_at(levels, F.col("authority")), F.lit(5)))
    before = F.min("l").over(Window.partitionBy("repo").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("hit", F.when(F.col("l") < before, F.struct("seq", F.concat("kind", "seq").alias("name"))))
    return rows.groupBy("repo").agg(F.min("l").alias("level"), F.array_join(F.array_sort(F.collect_list("hit"))["name"], ",").alias("applied"))


@query(f"SELECT repo, sha256(string_agg(grp || ':' || label, chr(10) ORDER BY grp, label)) AS digest FROM {_SIGNALS} GROUP BY 1")
def canonical_hash(spark, sf_dir):
    """SHA-256 of a repository's sorted signals, alike for any order of its files."""
    # At most one entry per signal, so a group is bounded by the table of signals.
    entries = F.array_sort(F.collect_list(F.struct("grp", "label")))
    text = F.array_join(F.transform(entries, lambda x: F.concat_ws(":", x["grp"], x["label"])), "\n")
    return S.signals(_files(spark, sf_dir)).groupBy("repo").agg(F.sha2(text, 256).alias("digest"))


@query(f"""SELECT repo, label, min(path) AS path FROM {FILES} JOIN (SELECT * FROM (VALUES {_SIGNAL_ROWS}) AS s(grp, label, needle, mode) WHERE grp = 'ci_platform') ON contains(path, needle) GROUP BY 1, 2""")
def first_ci_file(spark, sf_dir):
    """The first file by path of each CI platform."""
    path = F.col("path")
    hits = [F.when(path.contains(n), F.lit(label)) for g, label, n, _ in S.SIGNALS if g == "ci_platform"]
    return _files(spark, sf_dir).select("repo", "path", F.explode(F.array_compact(F.array(*hits))).alias("label")).groupBy("repo", "label").agg(F.min("path").alias("path"))


_WORDS = "string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ')"


@query(f"""WITH t AS (SELECT w[i] || ' ' || w[i + 1] AS pair, w[i + 2] AS following FROM (SELECT {_WORDS} AS w FROM conversations), unnest(range(1, len(w) - 1)) AS r(i)),
n AS (SELECT pair, following, count(*) AS n FROM t GROUP BY 1, 2)
SELECT pair, following, n::BIGINT AS n FROM n QUALIFY row_number() OVER (PARTITION BY pair ORDER BY n DESC, following) = 1 AND n > 2""")
def next_word(spark, sf_dir):
    """The word that most often follows each pair of words, of those seen over twice."""
    words = F.split(F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")), " ")
    rows = table(spark, sf_dir, "conversations").select(words.alias("w")).filter(F.size("w") > 2)
    at = lambda i, k: F.element_at("w", i + k)
    triples = F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.struct(F.concat_ws(" ", at(i, 0), at(i, 1)).alias("pair"), at(i, 2).alias("following")))
    counts = rows.select(F.explode(triples).alias("t")).groupBy("t.pair", "t.following").agg(F.count(F.lit(1)).alias("n"))
    # The least of (-n, word) is the commonest word, by name where tied: a partial minimum, no sort of a group.
    best = counts.groupBy("pair").agg(F.min(F.struct((-F.col("n")).alias("m"), "following")).alias("b"))
    return best.select("pair", "b.following", (-F.col("b.m")).alias("n")).filter("n > 2")


_RULE_LINES = " UNION ALL ".join(
    f"SELECT doc_id, line_no, {quoted(r)} AS rule, {quoted(s)} AS severity, {quoted(c)} AS cwe FROM {derived_sql('code_lines')} WHERE regexp_matches(line, {quoted(alternation(p))})" for r, s, c, _, p in SECURITY
)


@query(_RULE_LINES)
def security_rule_lines(spark, sf_dir):
    """Lines of code that break each of the seven security rules."""
    return security_findings(derived(spark, sf_dir, "code_lines")).select("doc_id", "line_no", "rule", "severity", "cwe")


@query(f"SELECT doc_id, rule, framework, severity, broken FROM ({ruled(COMPLIANCE + MORE_COMPLIANCE, derived_sql('code_texts'))})")
def compliance_rule_files(spark, sf_dir):
    """Each of the 16 compliance rules on files, of which one at least breaks it."""
    return compliance(derived(spark, sf_dir, "code_texts"), COMPLIANCE + MORE_COMPLIANCE).select("doc_id", "rule", "framework", "severity", "broken")


_PY_LINES = f"(SELECT repo || '/' || path AS rel_path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM {FILES} WHERE ends_with(path, '.py'))"


@query(f"SELECT rel_path, kind, name, n::INT AS line, complexity FROM (SELECT rel_path, 'function' AS kind, regexp_extract(line, '^def (\\w+)', 1) AS name, n, CASE WHEN starts_with(line, 'def run_') THEN 3 ELSE 1 END::INT AS complexity FROM {_PY_LINES} UNION ALL SELECT rel_path, 'import', coalesce(nullif(regexp_extract(line, '^import ([\\w.]+)', 1), ''), regexp_extract(line, '^from [.] import (\\w+)', 1)), n, NULL FROM {_PY_LINES} UNION ALL SELECT rel_path, 'class', regexp_extract(line, '^class (\\w+)', 1), n, NULL FROM {_PY_LINES}) WHERE name <> ''")
def ast_symbols(spark, sf_dir):
    """Functions and imports of Python files, by their syntax trees."""
    found = symbols(_files(spark, sf_dir).select(F.concat_ws("/", "repo", "path").alias("rel_path"), "content"))
    return found.filter("lang = 'python'").select("rel_path", "kind", "name", "line", "complexity")


@query("""SELECT '/p' || page_id || regexp_extract(url, '^[a-z]+://[^/?#]*([^?#" ]*)', 1) AS path, unnest(['GET', 'DELETE']) AS method, 'openapi' AS source FROM pages WHERE page_id % 3 = 0
UNION ALL SELECT unnest(['/a', '/b']) || page_id, unnest(['POST', 'GET']), 'postman' FROM pages WHERE page_id % 3 = 1 UNION ALL SELECT '/query/one' || page_id, 'GRAPHQL', 'graphql' FROM pages WHERE page_id % 3 = 2""")
def api_endpoints(spark, sf_dir):
    """Endpoints that API descriptions name; routes in code count only without any."""
    return endpoints(derived(spark, sf_dir, "api_files")).select("path", "method", "source")


@query()
def api_health(spark, sf_dir):
    return health(endpoints(derived(spark, sf_dir, "api_files")), True)


@query(f"""SELECT repo, path, line_no::INT AS line_no, (following - line_no)::INT AS gap FROM (SELECT repo, path, line_no, lead(line_no) OVER (PARTITION BY repo, path ORDER BY line_no) AS following FROM (
SELECT repo, path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM {FILES}) WHERE trim(line) <> '') WHERE following - line_no > 1""")
def line_gaps(spark, sf_dir):
    """Lines that blank lines follow, inside the row of their file."""
    numbers = F.array_compact(F.transform(F.split("content", "\n"), lambda line, i: F.when(F.trim(line) != "", i + 1)))
    rows = _files(spark, sf_dir).select("repo", "path", numbers.alias("n")).filter(F.size("n") > 1)
    pairs = F.transform(F.sequence(F.lit(1), F.size("n") - 1), lambda i: F.struct(F.element_at("n", i).alias("line_no"), (F.element_at("n", i + 1) - F.element_at("n", i)).alias("gap")))
    return rows.select("repo", "path", F.explode(pairs).alias("p")).select("repo", "path", "p.*").filter("gap > 1")
