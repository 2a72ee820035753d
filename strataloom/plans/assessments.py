"""Assessments of files, records, predictions and audits, on relations derived from the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataloom.functions.scalars import level
from strataloom.operators.contains import held
from strataloom.operators.standards import standards
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


#: Label, and texts that a file must hold (all of them) or must not hold.
PATTERNS = (
    ("object_oriented", ("class",), ()), ("decorators", ("def", "@"), ()), ("asynchronous", ("async def",), ()), ("modular_imports", ("import", "from"), ()),
    ("error_handling", ("try:", "except"), ()), ("context_management", ("with",), ()),
)
ISSUES = (("todo", ("TODO",), ()), ("print", ("print(",), ("logging",)), ("broad_except", ("except:",), ("Exception",)))
_TEXTS = derived_sql("code_texts")


def _sql_flags(flags) -> str:
    test = lambda holds, lacks: " AND ".join([f"contains(text, '{t}')" for t in holds] + [f"NOT contains(text, '{t}')" for t in lacks])
    return ", ".join(f"CASE WHEN {test(h, n)} THEN '{label}' END" for label, h, n in flags)


_PARTS = "(len(text) - len(replace(text, 'def ', ''))) // 4 + (len(text) - len(replace(text, 'class ', ''))) // 6"


@query(f"""SELECT doc_id, concat_ws(',', {_sql_flags(PATTERNS)}) AS patterns, concat_ws(',', CASE WHEN len(text) > 10000 THEN 'large' END, {_sql_flags(ISSUES)}, CASE WHEN contains(text, 'eval(') OR contains(text, 'exec(') THEN 'eval' END) AS issues,
 CASE WHEN len(string_split(text, chr(10))) > 500 OR {_PARTS} > 20 THEN 'high' WHEN len(string_split(text, chr(10))) > 200 OR {_PARTS} > 10 THEN 'medium' ELSE 'low' END AS complexity FROM {_TEXTS}""")
def comprehension_flags(spark, sf_dir):
    """Patterns, issues and the size ladder of each file."""
    text = F.col("text")

    def flags(table):
        tests = [(reduce(lambda a, b: a & b, [text.contains(t) for t in holds] + [~text.contains(t) for t in lacks]), label) for label, holds, lacks in table]
        return [F.when(test, label) for test, label in tests]

    lines = F.size(F.split(text, "\n"))
    parts = F.regexp_count(text, F.lit("def ")) + F.regexp_count(text, F.lit("class "))
    size = F.when((lines > 500) | (parts > 20), "high").when((lines > 200) | (parts > 10), "medium").otherwise("low")
    unsafe = F.when(text.contains("eval(") | text.contains("exec("), "eval")
    return derived(spark, sf_dir, "code_texts").select(
        "doc_id", F.concat_ws(",", *flags(PATTERNS)).alias("patterns"), F.concat_ws(",", F.when(F.length(text) > 10000, "large"), *flags(ISSUES), unsafe).alias("issues"), size.alias("complexity"),
    )


@query(f"""SELECT repo, round(m, 6)::DOUBLE AS score, CASE WHEN m >= 3.5 THEN 'high' WHEN m >= 2.5 THEN 'medium' WHEN m >= 1.5 THEN 'low' ELSE 'very_low' END AS safety FROM (
SELECT repo, avg(CASE level WHEN 'very_low' THEN 1 WHEN 'medium' THEN 3 WHEN 'high' THEN 4 ELSE 2 END) AS m FROM {derived_sql('factors')} GROUP BY 1)""")
def change_safety(spark, sf_dir):
    """Mean of five factor levels; an unknown level counts as low."""
    points = F.when(F.col("level") == "very_low", 1).when(F.col("level") == "medium", 3).when(F.col("level") == "high", 4).otherwise(2)
    rows = derived(spark, sf_dir, "factors").groupBy("repo").agg(F.avg(points).alias("m"))
    return rows.select("repo", F.round("m", 6).alias("score"), level(F.col("m"), [(3.5, "high"), (2.5, "medium"), (1.5, "low")], "very_low").alias("safety"))


@query(f"""SELECT repo, round(s, 6)::DOUBLE AS confidence, CASE WHEN s >= 0.8 THEN 'high' WHEN s >= 0.6 THEN 'medium' ELSE 'low' END AS level FROM (
SELECT repo, (0.85 + least(count(level) / 8.0, 1) + greatest(0, 1 - var_pop(CASE level WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) / 2))::DOUBLE / 3 AS s FROM {derived_sql('risk_levels')} GROUP BY 1)""")
def confidence_assessment(spark, sf_dir):
    """Mean of the constant risk confidence, completeness of eight components, and consistency of levels."""
    points = F.when(F.col("level") == "high", 3).when(F.col("level") == "medium", 2).otherwise(1)
    score = (F.lit(0.85) + F.least(F.count("level") / 8, F.lit(1.0)) + F.greatest(F.lit(0.0), 1 - F.var_pop(points) / 2)) / 3
    rows = derived(spark, sf_dir, "risk_levels").groupBy("repo").agg(score.alias("s"))
    return rows.select("repo", F.round("s", 6).alias("confidence"), level(F.col("s"), [(0.8, "high"), (0.6, "medium")], "low").alias("level"))


_DECISION = " OR ".join(f"contains(lower(title), '{w}')" for w in ("decision", "choice", "approach", "architecture", "design"))


@query(f"""SELECT path, title, CASE WHEN contains(lower(body), 'performance') THEN 'performance' WHEN contains(lower(body), 'security') THEN 'security' WHEN contains(lower(body), 'scalability') THEN 'scalability' WHEN contains(lower(body), 'maintainability') THEN 'maintainability' ELSE 'architectural' END AS kind, contains(lower(body), 'alternative') AS weighed
FROM (SELECT path, trim(string_split(section, chr(10))[1]) AS title, array_to_string(string_split(section, chr(10))[2:], chr(10)) AS body FROM (
 SELECT path, unnest(regexp_split_to_array(content, '(?m)^##\\s+')) AS section FROM {derived_sql('records')} WHERE contains(path, '/adr/') OR contains(path, '/decisions/'))) WHERE {_DECISION}""")
def decision_records(spark, sf_dir):
    """Sections of decision records whose title tells a decision, and their kind."""
    rows = derived(spark, sf_dir, "records").filter(F.col("path").contains("/adr/") | F.col("path").contains("/decisions/"))
    parts = F.split("section", "\n")
    rows = rows.select("path", F.explode(F.split("content", r"(?m)^##\s+")).alias("section"))
    rows = rows.select("path", F.trim(parts[0]).alias("title"), F.lower(F.array_join(F.slice(parts, 2, 2147483647), "\n")).alias("body"))
    told = F.lower("title").rlike("decision|choice|approach|architecture|design")
    kinds = ("performance", "security", "scalability", "maintainability")
    kind = reduce(lambda out, k: out.when(F.col("body").contains(k), k), kinds[1:], F.when(F.col("body").contains(kinds[0]), kinds[0])).otherwise("architectural")
    return rows.filter(told).select("path", "title", kind.alias("kind"), F.col("body").contains("alternative").alias("weighed"))


#: Thresholds of the grid in the order in which ties are settled.
GRID = [(p, c) for p in (0.5, 0.6, 0.7, 0.8) for c in (0.7, 0.8, 0.9)]


@query(f"""WITH g AS (SELECT * FROM (VALUES {', '.join(f'({i}, {p}::DOUBLE, {c}::DOUBLE)' for i, (p, c) in enumerate(GRID))}) AS t(i, p, c)),
a AS (SELECT i, p, c, avg(((profitability > p AND merge > c) = outcome)::INT) AS accuracy FROM g, {derived_sql('cases')} WHERE confidence >= 0.8 GROUP BY 1, 2, 3)
SELECT p AS profitability, c AS merge, round(accuracy, 6) AS accuracy FROM a ORDER BY a.accuracy DESC, i LIMIT 1""")
def threshold_search(spark, sf_dir):
    """The pair of thresholds of best accuracy over cases of enough confidence; the first of equals."""
    grid = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(p).alias("p"), F.lit(c).alias("c")) for i, (p, c) in enumerate(GRID)))
    rows = derived(spark, sf_dir, "cases").filter("confidence >= 0.8").select("*", F.explode(grid).alias("g"))
    said = (F.col("profitability") > F.col("g.p")) & (F.col("merge") > F.col("g.c"))
    tried = rows.groupBy("g").agg(F.avg((said == F.col("outcome")).cast("int")).alias("accuracy"))
    best = tried.agg(F.max_by(F.struct("g", "accuracy"), F.struct("accuracy", -F.col("g.i"))).alias("b"))
    return best.select(F.col("b.g.p").alias("profitability"), F.col("b.g.c").alias("merge"), F.round("b.accuracy", 6).alias("accuracy"))


@query(f"""WITH k AS (SELECT topic, len(ws) AS n, unnest(ws) AS w FROM (SELECT topic, list_distinct(list_filter(string_split(lower(words), ' '), lambda x: len(x) > 3)) AS ws FROM {derived_sql('topics')})),
h AS (SELECT topic, sha, max(hours) AS hours, count(DISTINCT w) / max(n)::DOUBLE AS relevance FROM k JOIN {derived_sql('commits')} ON contains(lower(message), w) GROUP BY 1, 2)
SELECT topic, sha, round(relevance, 6) AS relevance, row_number() OVER (PARTITION BY topic ORDER BY relevance DESC, hours DESC, sha)::INT AS place FROM h QUALIFY place <= 5""")
def topic_anchors(spark, sf_dir):
    """The five commits that hold most of a topic's words of over three letters; newer first where equal."""
    words = F.array_distinct(F.filter(F.split(F.lower("words"), " "), lambda w: F.length(w) > 3))
    topics = derived(spark, sf_dir, "topics").select("topic", F.size(words).alias("n"), F.explode(words).alias("phrase"))
    commits = derived(spark, sf_dir, "commits").select("sha", "hours", F.lower("message").alias("text"))
    rows = held(commits, topics, "topic", "sha", "n", "hours").withColumn("relevance", F.col("held") / F.col("n"))
    place = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("relevance"), F.desc("hours"), "sha"))
    return rows.withColumn("place", place).filter("place <= 5").select("topic", "sha", F.round("relevance", 6).alias("relevance"), "place")


@query(f"""SELECT audit, count(*)::BIGINT AS violations, round(greatest(0, 1 - CASE audit WHEN 'style' THEN sum(CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 1 ELSE 0.5 END) / (5.0 * max(files))
 ELSE sum(CASE severity WHEN 'critical' THEN 1 WHEN 'major' THEN 0.5 ELSE 0.1 END) / 5.0 END), 6)::DOUBLE AS score FROM {derived_sql('violations')} GROUP BY 1""")
def audit_scores(spark, sf_dir):
    """Scores of a style audit (five expected violations a file) and a transparency audit (five in all)."""
    s = F.col("severity")
    style = F.sum(F.when(s == "high", 3.0).when(s == "medium", 1.0).otherwise(0.5)) / (5 * F.max("files"))
    opened = F.sum(F.when(s == "critical", 1.0).when(s == "major", 0.5).otherwise(0.1)) / 5
    rows = derived(spark, sf_dir, "violations").groupBy("audit").agg(F.count(F.lit(1)).alias("violations"), style.alias("a"), opened.alias("b"))
    return rows.select("audit", "violations", F.round(F.greatest(F.lit(0.0), 1 - F.when(F.col("audit") == "style", F.col("a")).otherwise(F.col("b"))), 6).alias("score"))


@query(f"SELECT grp, round(CASE WHEN bool_or(c <= 0) THEN avg(c) ELSE count(*) / sum(1 / nullif(c, 0)) END, 6)::DOUBLE AS confidence FROM {derived_sql('confidences')} GROUP BY 1")
def conservative_confidence(spark, sf_dir):
    """Harmonic mean, or the arithmetic one where a value is not positive."""
    c = F.col("c")
    harmonic = F.count(F.lit(1)) / F.sum(F.try_divide(F.lit(1.0), c))
    return derived(spark, sf_dir, "confidences").groupBy("grp").agg(F.round(F.when(F.bool_or(c <= 0), F.avg(c)).otherwise(harmonic), 6).alias("confidence"))


@query("SELECT event_type, threshold, stars, floor(stars * threshold)::INT AS lost, (stars - floor(stars * threshold))::BIGINT AS rest, lost >= 10 AS triggered FROM (SELECT event_type, count(*)::BIGINT AS stars FROM events GROUP BY 1), (VALUES (0.02::DOUBLE), (0.1::DOUBLE)) AS t(threshold)")
def star_loss(spark, sf_dir):
    """Losses of each event type's count at two thresholds; ten or more trigger the breaker."""
    stars = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("stars"))
    rows = stars.select("event_type", "stars", F.explode(F.array(F.lit(0.02), F.lit(0.1))).alias("threshold"))
    rows = rows.withColumn("lost", F.floor(F.col("stars") * F.col("threshold")).cast("int"))
    return rows.withColumn("rest", F.col("stars") - F.col("lost")).withColumn("triggered", F.col("lost") >= 10)


_CONTENT = "lower(coalesce(content, ''))"
_IS = lambda *paths: "path IN (" + ", ".join(f"'{p}'" for p in paths) + ")"
_HOLDS = lambda *words: "(" + " OR ".join(f"contains({_CONTENT}, '{w}')" for w in words) + ")"
_ANY = lambda c: f"bool_or({c})"


@query(rf"""WITH f AS (SELECT * FROM {derived_sql('root_files')}), l AS (SELECT repo, {_HOLDS('mit', 'apache', 'gpl', 'gnu', 'bsd')} AS known, CASE path WHEN 'LICENSE' THEN 0 WHEN 'LICENSE.md' THEN 1 ELSE 2 END AS place FROM f WHERE {_IS('LICENSE', 'LICENSE.md', 'COPYING')}),
k AS (SELECT repo, bool_or(known) AS known FROM l WHERE place = (SELECT min(place) FROM l m WHERE m.repo = l.repo) GROUP BY 1),
c AS (SELECT repo, {_ANY(_IS('privacy_policy.md', 'gdpr.md', 'data_processing.md'))} AND {_ANY("(ends_with(path, '.py') OR ends_with(path, '.js') OR ends_with(path, '.ts')) AND " + _HOLDS('personal_data', 'user_data', 'gdpr', 'data_processing', 'consent', 'privacy_policy', 'data_retention'))} AS gdpr,
 {_ANY(_IS('hipaa_compliance.md', 'phi_protection.md', 'health_data.md'))} AND (NOT {_ANY("ends_with(path, '.py') AND " + _HOLDS('protected_health_information', 'phi', 'medical_data', 'patient_data', 'health_records', 'hipaa'))} OR {_ANY(_HOLDS('encryption', 'access_control', 'audit_logging'))}) AS hipaa,
 {_ANY(_IS('.github/workflows/security.yml'))} AND {_ANY(_IS('docker-compose.yml', 'Dockerfile'))} AND {_ANY(_HOLDS('test'))} AND {_ANY(_HOLDS('encrypt'))} AND {_ANY(_IS('PRIVACY.md', 'privacy_policy.md'))} AS soc2,
 {_ANY(_IS('SECURITY.md'))}::INT + {_ANY(_IS('.github/dependabot.yml'))}::INT + {_ANY(_IS('.github/workflows/codeql.yml'))}::INT + (NOT bool_or(regexp_matches(content, '(?i)(password|secret|key)\s*=\s*[''"][^''"]+[''"]')))::INT + (NOT {_ANY(_HOLDS('http://'))})::INT >= 3 AS security,
 {_ANY(_IS('requirements.txt', 'pyproject.toml', 'package.json', 'Cargo.toml'))} AND NOT {_ANY("regexp_matches(content, '(?i)(requests|django)[^\n]*[<>=][^\n]*2[.]0')")} AS dependencies FROM f GROUP BY 1)
SELECT repo, gdpr, hipaa, soc2, security, coalesce(known, false) AS license, dependencies, (gdpr::INT + hipaa::INT + soc2::INT + security::INT + coalesce(known, false)::INT + dependencies::INT)::INT AS compliant,
 round((gdpr::INT + hipaa::INT + soc2::INT + security::INT + coalesce(known, false)::INT + dependencies::INT) / 6.0::DOUBLE, 6) AS score FROM c LEFT JOIN k USING (repo)""")
def standards_report(spark, sf_dir):
    """Six standards of each source, by documents at its root and words in its files."""
    return standards(derived(spark, sf_dir, "root_files"))
