"""One result per repository, from all stages in one scan of ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.functions.scalars import level
from strataloom.operators.risks import components, weighted
from strataloom.operators.stages import repository_counts
from strataloom.plans.texts import _ALL_RULED, _BLOCKS, _ONE, SQL as TEXTS
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


# The twin joins the stages, and spells out the rules of the four components that they feed.
_FAMILY = "count(*) FILTER (framework = '{0}' AND broken) * 100.0::DOUBLE / count(*) FILTER (framework = '{0}')"
_COUNTS = f"""
f AS (SELECT source AS repo, count(*)::BIGINT AS files, sum(len(string_split(text, chr(10))))::BIGINT AS lines FROM documents GROUP BY 1),
s AS (SELECT source AS repo, count(*)::BIGINT AS findings, count(*) FILTER (severity = 'critical')::BIGINT AS critical, count(*) FILTER (severity = 'high')::BIGINT AS high, count(*) FILTER (severity = 'medium')::BIGINT AS medium FROM ({_ONE}) GROUP BY 1),
c AS (SELECT source AS repo, count(*) FILTER (broken AND severity = 'critical')::BIGINT AS broken_critical, count(*) FILTER (broken AND severity = 'high')::BIGINT AS broken_high,
 100 - count(*) FILTER (broken) * 100.0::DOUBLE / count(*) AS compliance, 100 - {_FAMILY.format('OWASP')} AS owasp, 100 - {_FAMILY.format('SECURITY')} AS practices FROM ({_ALL_RULED}) GROUP BY 1),
m AS (SELECT source AS repo, count(*) FILTER (cyclomatic > 15)::BIGINT AS cyclomatic_high, count(*) FILTER (cyclomatic BETWEEN 11 AND 15)::BIGINT AS cyclomatic_mid,
 count(*) FILTER (cognitive > 20)::BIGINT AS cognitive_high, count(*) FILTER (cognitive BETWEEN 16 AND 20)::BIGINT AS cognitive_mid FROM ({TEXTS['file_metrics']}) JOIN documents USING (doc_id) GROUP BY 1),
d AS (SELECT repo, sum(n)::BIGINT AS blocks, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS duplicates, max(n)::BIGINT AS largest FROM (SELECT source AS repo, digest, count(*) AS n FROM {_BLOCKS} GROUP BY 1, 2) GROUP BY 1),
j AS (SELECT * REPLACE (coalesce(largest, 0)::BIGINT AS largest), coalesce(duplicates * 6 / blocks::DOUBLE, 0) AS ratio, CASE WHEN findings IS NULL THEN NULL ELSE round((critical + 0.7 * high + 0.4 * medium)::DOUBLE / findings * least(lines / 10000.0::DOUBLE, 1), 6) END AS score
 FROM f LEFT JOIN s USING (repo) LEFT JOIN c USING (repo) LEFT JOIN m USING (repo) LEFT JOIN d USING (repo)),
t AS (SELECT *, CASE WHEN findings IS NULL THEN 'low' WHEN score >= 0.8 THEN 'critical' WHEN score >= 0.6 THEN 'high' WHEN score >= 0.4 THEN 'medium' WHEN score >= 0.2 THEN 'low' ELSE 'minimal' END AS assessed,
 greatest(0, 100 - least(ratio * 100, 50) - least(2 * largest, 20)) AS duplication FROM j),
p AS (SELECT *, (CASE WHEN compliance < 70 THEN 4 WHEN compliance < 85 THEN 2 ELSE 0 END) + 3 * broken_critical + 2 * broken_high + (CASE WHEN owasp < 80 THEN 2 ELSE 0 END) + (CASE WHEN practices < 80 THEN 2 ELSE 0 END) AS p_compliance,
 coalesce((CASE WHEN duplication < 50 THEN 8 WHEN duplication < 70 THEN 5 WHEN duplication < 85 THEN 2 ELSE 0 END) + (CASE WHEN ratio > 0.3 THEN 3 WHEN ratio > 0.15 THEN 1 ELSE 0 END) + (CASE WHEN largest > 10 THEN 2 ELSE 0 END), 0) AS p_duplication,
 2 * cyclomatic_high + cyclomatic_mid + 2 * cognitive_high + cognitive_mid AS p_code FROM t),
l AS (SELECT *, CASE WHEN p_compliance >= 8 THEN 3 WHEN p_compliance >= 4 THEN 2 ELSE 1 END AS l_compliance, CASE WHEN p_duplication >= 12 THEN 1 WHEN p_duplication >= 6 THEN 3 WHEN p_duplication >= 3 THEN 2 ELSE 1 END AS l_duplication,
 CASE WHEN p_code >= 8 THEN 3 WHEN p_code >= 4 THEN 2 ELSE 1 END AS l_code, CASE assessed WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS l_security FROM p)"""
_POINTS = ("3 * l_security + 2 * l_compliance + l_duplication + 2 * l_code + 15",)


@query(f"""WITH {_COUNTS}
SELECT repo, files, lines, coalesce(findings, 0)::BIGINT AS findings, coalesce(critical, 0)::BIGINT AS critical, coalesce(high, 0)::BIGINT AS high, coalesce(medium, 0)::BIGINT AS medium, assessed,
 round(compliance, 4)::DOUBLE AS compliance, broken_critical, broken_high, round(owasp, 4)::DOUBLE AS owasp, round(practices, 4)::DOUBLE AS practices, coalesce(blocks, 0)::BIGINT AS blocks, coalesce(duplicates, 0)::BIGINT AS duplicates, largest,
 round(ratio, 4)::DOUBLE AS ratio, round(duplication, 4)::DOUBLE AS duplication, cyclomatic_high, cyclomatic_mid, cognitive_high, cognitive_mid, round(({_POINTS[0]}) / 23.0::DOUBLE, 6) AS risk,
 CASE WHEN ({_POINTS[0]}) / 23.0 >= 2.5 THEN 'high' WHEN ({_POINTS[0]}) / 23.0 >= 1.8 THEN 'medium' ELSE 'low' END AS level,
 concat_ws(',', CASE WHEN critical > 0 THEN 'critical_security_vulnerabilities' END, CASE WHEN high > 0 THEN 'high_security_vulnerabilities' END, CASE WHEN findings * 1000.0 / lines > 5 THEN 'high_vulnerability_density' END,
  CASE WHEN compliance < 70 THEN 'low_overall_compliance' WHEN compliance < 85 THEN 'moderate_compliance_issues' END, CASE WHEN broken_critical > 0 THEN 'critical_compliance_violations' END, CASE WHEN broken_high > 0 THEN 'high_severity_compliance_violations' END,
  CASE WHEN owasp < 80 THEN 'owasp_compliance_issues' END, CASE WHEN practices < 80 THEN 'security_best_practice_violations' END,
  CASE WHEN duplication < 50 THEN 'severe_duplication' WHEN duplication < 70 THEN 'high_duplication' WHEN duplication < 85 THEN 'moderate_duplication' END, CASE WHEN ratio > 0.3 THEN 'high_duplicate_ratio' WHEN ratio > 0.15 THEN 'moderate_duplicate_ratio' END,
  CASE WHEN largest > 10 THEN 'large_clone_groups' END, CASE WHEN cyclomatic_high > 0 THEN 'high_cyclomatic_complexity' END, CASE WHEN cyclomatic_mid > 0 THEN 'moderate_cyclomatic_complexity' END,
  CASE WHEN cognitive_high > 0 THEN 'high_cognitive_complexity' END, CASE WHEN cognitive_mid > 0 THEN 'moderate_cognitive_complexity' END) AS factors FROM l""")
def repository_report(spark, sf_dir):
    """Security, compliance, duplication, metrics and the risk they make, one row per source.

    Components that no stage feeds count as low, as one without findings does."""
    counts = repository_counts(table(spark, sf_dir, "documents"))
    rows = counts.withColumn("parts", F.array(*components(counts)))
    mean = weighted(F.col("parts"))
    four = lambda *names: [F.round(n, 4).alias(n) for n in names]
    return rows.select(
        "repo", "files", "lines", "findings", "critical", "high", "medium", "assessed", *four("compliance"), "broken_critical", "broken_high", *four("owasp", "practices"), "blocks", "duplicates", "largest", *four("ratio", "duplication"),
        "cyclomatic_high", "cyclomatic_mid", "cognitive_high", "cognitive_mid", F.round(mean, 6).alias("risk"), level(mean, [(2.5, "high"), (1.8, "medium")], "low").alias("level"),
        F.array_join(F.flatten(F.transform("parts", lambda x: x["factors"])), ",").alias("factors"),
    )
