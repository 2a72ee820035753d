"""Compliance rules on planted files, and literals of the security rules."""

import re

from strataloom.operators import rules
from strataloom.plans import texts as plans

#: Texts, and the one of four rules that each breaks.
PLANTED = [
    ("Execute('SELECT a' + b)", "OWASP-A01"), ("cursor.execute('x %s' )", "OWASP-A01"), ("q = \"select 1\" + x", "OWASP-A01"), ("execute('a'\n+ b)", None),
    ("PassWord = ''", "OWASP-A02"), ("auth_ok = true", "OWASP-A02"), ("session = r.get('session')", "OWASP-A02"),
    ("os.system('ls ' + d)", "SEC-003"), ("OS.SYSTEM('ls ' + d)", None), ("exec(a + b)", "SEC-003"), ("subprocess.call(\na + b)", "SEC-003"), ("os.system(a\n\r b + c)", None),
    ("def f(a):\n" + "x\n" * 60, "QUAL-004"), ("def f(a):\n" * 2 + "x\n" * 60, None), ("x\n" * 60, None), ("plain", None), ("", None),
]


def test_four_rules_as_planted(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, "s") for i, (t, _) in enumerate(PLANTED)], "doc_id long, text string, source string")
    found = {(r.doc_id, r.rule) for r in rules.compliance(docs, rules.MORE_COMPLIANCE).collect() if r.broken}
    assert found == {(i, rule) for i, (_, rule) in enumerate(PLANTED) if rule}
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.rule: r for r in plans.compliance_violations(spark, str(tmp_path)).collect()}
    assert len(got) == 16 and [got[r].violations for r in ("OWASP-A01", "OWASP-A02", "SEC-003", "QUAL-004")] == [3, 3, 3, 1]
    assert {r.framework: r.passed for r in plans.compliance_framework_rollup(spark, str(tmp_path)).collect()}["all"] == sum(r.checked - r.violations for r in got.values())


def test_literals_hold_for_every_pattern(spark):
    # A shortest line of each pattern: optional parts left out, classes and gaps filled, once in capitals.
    made = []
    for rule, *_, patterns in rules.SECURITY:
        for pattern in patterns:
            line = pattern.replace("""["']?""", "")
            line = line.replace("""["'][^"']+["']""", "'x'").replace(r"\s+", " ").replace(r"\s*", "").replace(".*", "x").replace("loads?", "load")
            made.append((rule, re.sub(r"\\(.)", r"\1", line)))
    rows = spark.createDataFrame([(r, x) for r, x in made] + [(r, x.upper()) for r, x in made], "want string, line string")
    found = {(r.want, r.line) for r in rules.security_findings(rows).filter("want = rule").collect()}
    assert found == {(r.want, r.line) for r in rows.collect()} and len(made) == 35
