"""Queries over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions.scalars import BRANCHES, WORD, count_of, cyclomatic, entropy, level, nesting, share
from strataloom.operators.blocks import BLOCK, blocks
from strataloom.operators.rules import COMMANDS, COMPLIANCE, MORE_COMPLIANCE, PERSONAL, PRIVACY, SECRETS, SECURITY, SENSITIVE, SQL_INJECTION, WEAK_LOGIN, WEIGHTS, advice, alternation, compliance, security_findings, severities, suspects, weight
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


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


LINES = "(SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line FROM documents)"
_ONE = " UNION ALL ".join(
    f"SELECT doc_id, source, {quoted(r)} AS rule, {quoted(s)} AS severity, {quoted(o)} AS owasp FROM {LINES} WHERE regexp_matches(line, {quoted(alternation(p))})"
    for r, s, _, o, p in SECURITY
)
_WEIGHT = "CASE severity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.items()) + " END"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(f"SELECT rule, severity, count(*)::BIGINT AS findings, count(DISTINCT doc_id)::BIGINT AS files FROM ({_ONE}) GROUP BY ALL")
def security_findings_by_type(spark, sf_dir):
    found = security_findings(suspects(_documents(spark, sf_dir)), searched=True)
    return found.groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("doc_id").alias("files"))


@query(f"""
WITH f AS (SELECT source, count(*) AS findings, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high,
             count(*) FILTER (severity = 'medium') AS medium, avg({_WEIGHT})::DOUBLE AS mean_weight FROM ({_ONE}) GROUP BY 1),
l AS (SELECT source, count(*) AS lines FROM {LINES} GROUP BY 1)
SELECT source, lines::BIGINT AS lines, coalesce(findings, 0)::BIGINT AS findings, coalesce(critical, 0)::BIGINT AS critical, coalesce(high, 0)::BIGINT AS high,
  coalesce(medium, 0)::BIGINT AS medium, round(coalesce(findings, 0)::DOUBLE / greatest(lines, 1) * 1000, 2) AS per_1000_lines, risk_score,
  CASE WHEN findings IS NULL THEN 'low' WHEN risk_score >= .8 THEN 'critical' WHEN risk_score >= .6 THEN 'high' WHEN risk_score >= .4 THEN 'medium' WHEN risk_score >= .2 THEN 'low' ELSE 'minimal' END AS risk_level
FROM (SELECT *, CASE WHEN findings IS NULL THEN 0.1::DOUBLE ELSE round(mean_weight * least(lines / 10000.0::DOUBLE, 1), 6) END AS risk_score FROM l LEFT JOIN f USING (source))""")
def security_summary(spark, sf_dir):
    # One scan: lines and findings are counted inside the row of their text.
    rows = _documents(spark, sf_dir).select("source", F.size(F.split("text", "\n")).alias("n"), severities(F.col("text")).alias("hits"))
    levels = ("critical", "high", "medium")
    out = rows.groupBy("source").agg(
        F.sum("n").alias("lines"), F.sum(F.size("hits")).alias("findings"),
        *(F.sum(F.size("hits") - F.size(F.array_remove("hits", s))).alias(s) for s in levels),
        (F.sum(F.aggregate("hits", F.lit(0.0), lambda a, x: a + weight(x))) / F.nullif(F.sum(F.size("hits")), F.lit(0))).alias("mean_weight"),
    )
    none = F.col("findings") == 0
    score = F.when(none, F.lit(0.1)).otherwise(F.round(F.col("mean_weight") * F.least(F.col("lines") / 10000, F.lit(1.0)), 6))
    out = out.withColumn("risk_score", score)
    ladder = level(F.col("risk_score"), [(0.8, "critical"), (0.6, "high"), (0.4, "medium"), (0.2, "low")], "minimal")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(
        "source", "lines", zero("findings"), zero("critical"), zero("high"), zero("medium"),
        F.round(F.coalesce("findings", F.lit(0)) / F.greatest("lines", F.lit(1)) * 1000, 2).alias("per_1000_lines"),
        "risk_score", F.when(none, "low").otherwise(ladder).alias("risk_level"),
    )


# The twin spells the advice out by rule and asks each rule of each line.
_SAID = ["'Implement parameterized queries or prepared statements for all database operations'", "'Implement proper output encoding and input validation for all user inputs'", "'Avoid shell command execution with user inputs; use safe APIs instead'", "'Move all secrets to environment variables or secure credential stores'", "'Upgrade to modern cryptographic algorithms (AES-256, SHA-256+)'"]
_ASKED = ["sql_injection", "xss_vulnerability", "command_injection", "hardcoded_secrets", "weak_crypto"]


@query(f"""WITH f AS (SELECT source, count(*) AS findings, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, list(DISTINCT rule) AS rules FROM ({_ONE}) GROUP BY 1)
SELECT source, coalesce(findings, 0)::BIGINT AS findings, coalesce(critical, 0)::BIGINT AS critical, coalesce(high, 0)::BIGINT AS high, coalesce(medium, 0)::BIGINT AS medium, CASE WHEN findings IS NULL THEN 'No critical security issues detected. Continue regular security reviews.'
 ELSE concat_ws(chr(10), {', '.join(f"CASE WHEN list_contains(rules, '{r}') THEN {t} END" for r, t in zip(_ASKED, _SAID, strict=True))}, CASE WHEN critical > 0 THEN 'Address ' || critical || ' critical security findings immediately' END,
  'Implement automated security testing in CI/CD pipeline', 'Conduct regular security code reviews and penetration testing') END AS advice FROM (SELECT DISTINCT source FROM documents) LEFT JOIN f USING (source)""")
def security_advice(spark, sf_dir):
    """Findings by severity and what each source should do about them."""
    return advice(_documents(spark, sf_dir)).withColumn("advice", F.array_join("advice", "\n"))


@query(f"SELECT source, count(DISTINCT owasp)::BIGINT AS categories, round(count(DISTINCT owasp) / 10.0::DOUBLE * 100, 1) AS coverage FROM ({_ONE}) GROUP BY 1")
def owasp_coverage(spark, sf_dir):
    found = security_findings(suspects(_documents(spark, sf_dir)), searched=True)
    return found.groupBy("source").agg(F.countDistinct("owasp").alias("categories")).withColumn("coverage", F.round(F.col("categories") / 10 * 100, 1))


def _families(patterns) -> str:
    return " + ".join(f"regexp_matches(text, {quoted('(?i)' + p)})::INT" for p in patterns)


def _has(*words) -> str:
    return "(" + " OR ".join(f"contains(lower(text), {quoted(w)})" for w in words) + ")"


_DEFINED = r"def\s+\w+\s*\([^)]*\):"
_CHECKS = {
    "OWASP-A03": f"({_families(SENSITIVE)}) > 2",
    "OWASP-A04": f"{_has('xml')} AND {_has('parser', 'sax')} AND NOT {_has('secure')} AND NOT {_has('safe')}",
    "OWASP-A05": f"{_has('admin', 'user')} AND NOT {_has('role')}",
    "SEC-001": f"regexp_matches(text, {quoted(alternation(SECRETS))})",
    "SEC-002": f"{_has('random')} AND NOT {_has('secure')}",
    "SEC-004": r"(contains(text, '../') OR contains(text, '..\')) AND (contains(text, 'open') OR contains(text, 'file'))",
    "QUAL-001": "len(string_split(text, chr(10))) > 100",
    "QUAL-002": "(contains(text, 'TODO') OR contains(text, 'FIXME'))",
    "QUAL-003": r"len(regexp_extract_all(text, '\b\d{2,}\b')) > 10",
    "GDPR-001": f"({_families(PERSONAL)}) > 1",
    "GDPR-002": f"NOT {_has('delete', 'expire')}",
    "CCPA-001": f"NOT {_has(*PRIVACY)}",
}
_MORE_CHECKS = {
    "OWASP-A01": f"regexp_matches(text, {quoted(alternation(SQL_INJECTION))})", "OWASP-A02": f"regexp_matches(text, {quoted(alternation(WEAK_LOGIN))})",
    "SEC-003": f"regexp_matches(text, {quoted('|'.join(COMMANDS))})",
    "QUAL-004": f"(len(regexp_extract_all(text, {quoted(_DEFINED)})) > 0 AND len(string_split(text, chr(10))) > 50 * len(regexp_extract_all(text, {quoted(_DEFINED)})))",
}


def ruled(rules: tuple, docs: str = "documents") -> str:
    checks = _CHECKS | _MORE_CHECKS
    return " UNION ALL ".join(f"SELECT doc_id, source, '{r}' AS rule, '{f}' AS framework, '{s}' AS severity, ({checks[r]}) AS broken FROM {docs}" for r, f, s in rules)


_ALL_RULED = ruled(COMPLIANCE + MORE_COMPLIANCE)


@query(f"SELECT rule, framework, severity, count(*) FILTER (broken)::BIGINT AS violations, count(*)::BIGINT AS checked FROM ({_ALL_RULED}) GROUP BY ALL")
def compliance_violations(spark, sf_dir):
    """All 16 rules of the catalogue."""
    return _violations(compliance(_documents(spark, sf_dir), COMPLIANCE + MORE_COMPLIANCE))


def _violations(rows: DataFrame) -> DataFrame:
    return rows.groupBy("rule", "framework", "severity").agg(F.count_if("broken").alias("violations"), F.count(F.lit(1)).alias("checked"))


@query(f"SELECT coalesce(framework, 'all') AS framework, count(*) FILTER (NOT broken)::BIGINT AS passed, round(count(*) FILTER (NOT broken)::DOUBLE / count(*) * 100, 4) AS score FROM ({_ALL_RULED}) GROUP BY ROLLUP (framework)")
def compliance_framework_rollup(spark, sf_dir):
    """Scores of frameworks over all 16 rules of the catalogue."""
    return _rollup(compliance(_documents(spark, sf_dir), COMPLIANCE + MORE_COMPLIANCE))


def _rollup(rows: DataFrame) -> DataFrame:
    rows = rows.rollup("framework").agg(F.count_if(~F.col("broken")).alias("passed"), F.count(F.lit(1)).alias("n"))
    return rows.select(F.coalesce("framework", F.lit("all")).alias("framework"), "passed", F.round(F.col("passed") / F.col("n") * 100, 4).alias("score"))


_BLOCKS = f"""(SELECT doc_id, source, md5(array_to_string(own, chr(10))) AS digest FROM (
  SELECT doc_id, source, list(line) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN CURRENT ROW AND {BLOCK - 1} FOLLOWING) AS own FROM (
    SELECT doc_id, source, line_no, trim(line) AS line FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
    WHERE trim(line) <> '')) WHERE len(own) = {BLOCK} AND length(array_to_string(own, chr(10))) >= 10)"""


@query(f"SELECT digest, count(*)::BIGINT AS copies, count(DISTINCT doc_id)::BIGINT AS files, min(doc_id) AS first_file FROM {_BLOCKS} GROUP BY 1 HAVING count(*) > 1 ORDER BY copies DESC, digest LIMIT 20")
def dup_blocks_topk(spark, sf_dir):
    found = blocks(_documents(spark, sf_dir)).groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.countDistinct("doc_id").alias("files"), F.min("doc_id").alias("first_file"))
    return found.filter("copies > 1").orderBy(F.desc("copies"), "digest").limit(20)


@query(f"""WITH b AS {_BLOCKS}, d AS (SELECT digest, count(*) AS copies FROM b GROUP BY 1)
SELECT source, count(*)::BIGINT AS blocks, count(*) FILTER (copies > 1)::BIGINT AS duplicates, round(count(*) FILTER (copies > 1) * {BLOCK} / count(*)::DOUBLE, 3) AS ratio, max(copies)::BIGINT AS largest,
 round(greatest(0, 100 - least(count(*) FILTER (copies > 1) * {BLOCK} / count(*)::DOUBLE * 100, 50) - least(2 * max(copies), 20)), 3)::DOUBLE AS score FROM b JOIN d USING (digest) GROUP BY 1""")
def dup_metrics(spark, sf_dir):
    # Blocks are counted by source before they meet, so a common block is one row a source.
    own = blocks(_documents(spark, sf_dir)).groupBy("source", "digest").agg(F.count(F.lit(1)).alias("n"))
    rows = own.join(own.groupBy("digest").agg(F.sum("n").alias("copies")), "digest")
    out = rows.groupBy("source").agg(F.sum("n").alias("blocks"), F.sum(F.when(F.col("copies") > 1, F.col("n")).otherwise(0)).alias("duplicates"), F.max("copies").alias("largest"))
    ratio = F.col("duplicates") * BLOCK / F.col("blocks")
    score = F.greatest(F.lit(0.0), 100 - F.least(ratio * 100, F.lit(50.0)) - F.least(2 * F.col("largest"), F.lit(20)))
    return out.select("source", "blocks", "duplicates", F.round(ratio, 3).alias("ratio"), "largest", F.round(score, 3).alias("score"))


@query("SELECT md5(text) AS digest, count(*)::BIGINT AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dup_docs(spark, sf_dir):
    return _documents(spark, sf_dir).groupBy(F.md5("text").alias("digest")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc")).filter("copies > 1")


@query("""WITH new AS (SELECT conv_id, turn, sha256(text) AS h FROM conversations), old AS (SELECT conv_id, turn + 1 AS turn, sha256(text) AS h FROM conversations)
SELECT CASE WHEN old.conv_id IS NULL THEN 'added' WHEN old.h IS DISTINCT FROM new.h THEN 'changed' ELSE 'same' END AS state, count(*)::BIGINT AS messages FROM new LEFT JOIN old USING (conv_id, turn) GROUP BY 1""")
def content_cdc(spark, sf_dir):
    """Changes by content hash of each turn against the state one turn before."""
    new = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2("text", 256).alias("h"))
    old = new.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("h").alias("before"), F.lit(True).alias("known"))
    state = F.when(F.col("known").isNull(), "added").when(F.col("before").eqNullSafe(F.col("h")), "same").otherwise("changed")
    return new.join(old, ["conv_id", "turn"], "left").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("messages"))


OPERATOR = r"[+\-*/%=<>!&|^~]+"
OPERAND = "[A-Za-z_][A-Za-z0-9_]*|[0-9]+"


@query(rf"""SELECT doc_id, loc, cyclomatic, cyclomatic + nesting AS cognitive, operators, operands, (operators + operands) * length(bin(operators + operands)) AS volume FROM (
SELECT doc_id, len(string_split(text, chr(10)))::BIGINT AS loc, 1 + len(list_filter(regexp_extract_all(text, '{WORD}'), lambda x: x IN {BRANCHES}))::BIGINT AS cyclomatic, len(regexp_extract_all(text, '{OPERATOR}'))::BIGINT AS operators,
 len(regexp_extract_all(text, '{OPERAND}'))::BIGINT AS operands, list_max(list_transform(string_split(text, chr(10)), lambda x: (length(x) - length(ltrim(x, ' '))) // 4))::BIGINT AS nesting FROM documents)""")
def file_metrics(spark, sf_dir):
    text = F.col("text")
    split = F.split("text", "\n")
    out = _documents(spark, sf_dir).select(
        "doc_id", F.size(split).cast("long").alias("loc"), cyclomatic(text).alias("cyclomatic"), nesting(split).alias("nesting"),
        count_of(text, OPERATOR).alias("operators"), count_of(text, OPERAND).alias("operands"),
    )
    n = F.col("operators") + F.col("operands")
    return out.select("doc_id", "loc", "cyclomatic", (F.col("cyclomatic") + F.col("nesting")).alias("cognitive"), "operators", "operands", (n * F.length(F.bin(n))).alias("volume"))


@query("SELECT coalesce(lang, 'Unknown') AS lang, count(*)::BIGINT AS files, sum(n_chars)::BIGINT AS chars, round(avg(n_chars), 4) AS mean_chars FROM documents GROUP BY 1")
def lang_histogram(spark, sf_dir):
    return _documents(spark, sf_dir).groupBy(F.coalesce("lang", F.lit("Unknown")).alias("lang")).agg(F.count(F.lit(1)).alias("files"), F.sum("n_chars").alias("chars"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))


@query("SELECT source, count(*)::BIGINT AS files, sum(CASE WHEN n_chars > 100000 THEN 2 ELSE 0 END)::BIGINT AS large, (count(*) + sum(CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 0.5 ELSE 0.25 END))::DOUBLE AS complexity, count(*) > 200 OR count(*) + sum(CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 0.5 ELSE 0.25 END) > 50 AS optimised FROM documents GROUP BY 1")
def complexity_estimate(spark, sf_dir):
    w = F.when(F.col("lang") == "en", 1.0).when(F.col("lang") == "de", 0.5).otherwise(0.25)
    out = _documents(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.sum(F.when(F.col("n_chars") > 100000, 2).otherwise(0)).alias("large"), (F.count(F.lit(1)) + F.sum(w)).alias("complexity"))
    return out.withColumn("optimised", (F.col("files") > 200) | (F.col("complexity") > 50))


@query(r"""SELECT scheme, count(*)::BIGINT AS pages, count(*) FILTER (regexp_matches(path, '^/[a-z][a-z0-9_-]*/?$'))::BIGINT AS well_named, count(*) FILTER (regexp_matches(path, '(?i)admin|user|private'))::BIGINT AS sensitive
FROM (SELECT regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages) GROUP BY 1""")
def url_endpoint_design(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"), F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1).alias("path"))
    return rows.groupBy("scheme").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("path").rlike("^/[a-z][a-z0-9_-]*/?$")).alias("well_named"), F.count_if(F.col("path").rlike("(?i)admin|user|private")).alias("sensitive"))


@query("SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, count(*)::BIGINT AS pages, count(*) FILTER (contains(html, '<script'))::BIGINT AS scripted, count(*) FILTER (regexp_matches(html, '(?i)innerHTML\\s*=|document\\.write'))::BIGINT AS unsafe FROM pages GROUP BY 1".replace("\\\\", "\\"))
def markup_findings(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").withColumn("host", F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1))
    return rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("html").contains("<script")).alias("scripted"), F.count_if(F.col("html").rlike(r"(?i)innerHTML\s*=|document\.write")).alias("unsafe"))


#: Needles of the presence matrix.
SIGNALS = {"licence": "licen", "secret": "token", "mail": "@", "table": "|", "heading": "#"}


@query("SELECT source, " + ", ".join(f"bool_or(contains(lower(text), {quoted(n)})) AS has_{k}" for k, n in SIGNALS.items()) + " FROM documents GROUP BY 1")
def needle_presence(spark, sf_dir):
    low = F.lower("text")
    return _documents(spark, sf_dir).groupBy("source").agg(*(F.bool_or(low.contains(n)).alias(f"has_{k}") for k, n in SIGNALS.items()))


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unlabelled_files(spark, sf_dir):
    """Anti join: files that no label covers."""
    return _documents(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "source")


@query("""SELECT 'union' AS op, count(*)::BIGINT AS n FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels) UNION ALL SELECT 'intersect', count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)
UNION ALL SELECT 'except', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'except_back', count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)
UNION ALL SELECT 'union_all', count(*) FROM (SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM labels)""")
def set_operations(spark, sf_dir):
    a, b = _documents(spark, sf_dir).select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    rows = [("union", a.union(b).distinct()), ("intersect", a.intersect(b)), ("except", a.subtract(b)), ("except_back", b.subtract(a)), ("union_all", a.unionAll(b))]
    out = None
    for name, df in rows:
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("op"), "n")
        out = one if out is None else out.unionByName(one)
    return out


#: Words that speak for an intent, in the order that breaks ties.
INTENTS = {"listing": "|", "shouting": "!", "prose": ".", "markup": "#"}


@query("""WITH s AS (SELECT doc_id, unnest([""" + ", ".join(f"{{'k': '{k}', 'o': {i}, 'n': length(text) - length(replace(text, {quoted(n)}, ''))}}" for i, (k, n) in enumerate(INTENTS.items())) + """]) AS x FROM documents),
r AS (SELECT doc_id, x.k AS k, x.n AS n, row_number() OVER (PARTITION BY doc_id ORDER BY x.n DESC, x.o) AS rank FROM s)
SELECT doc_id, max(k) FILTER (rank = 1) AS first_intent, max(n) FILTER (rank = 1)::BIGINT AS score, max(k) FILTER (rank = 2) AS second_intent FROM r GROUP BY 1""")
def mark_argmax(spark, sf_dir):
    one = [F.struct((-(F.length("text") - F.length(F.replace("text", F.lit(n))))).cast("long").alias("n"), F.lit(i).alias("o"), F.lit(k).alias("k")) for i, (k, n) in enumerate(INTENTS.items())]
    rows = _documents(spark, sf_dir).select("doc_id", F.array_sort(F.array(*one)).alias("x"))
    return rows.select("doc_id", F.col("x")[0]["k"].alias("first_intent"), (-F.col("x")[0]["n"]).alias("score"), F.col("x")[1]["k"].alias("second_intent"))


@query(r"""SELECT doc_id, len(s)::BIGINT AS sentences, round(-list_sum(list_transform(c, lambda x: x / n * log2(x / n))), 6)::DOUBLE + 0 AS entropy FROM (SELECT doc_id, s, n::DOUBLE AS n, list(k::DOUBLE ORDER BY k) AS c FROM (
SELECT doc_id, s, len(s) AS n, l, count(*) AS k FROM (SELECT doc_id, s, unnest(list_transform(s, lambda x: len(regexp_extract_all(x, '[A-Za-z]+')))) AS l FROM (SELECT doc_id, list_filter(string_split_regex(text, '[.!?]+'), lambda x: trim(x) <> '') AS s FROM documents)) GROUP BY ALL) GROUP BY ALL)""")
def sentence_entropy(spark, sf_dir):
    sentences = F.filter(F.split("text", "[.!?]+"), lambda x: F.trim(x) != "")
    rows = _documents(spark, sf_dir).select("doc_id", sentences.alias("s")).filter(F.size("s") > 0)
    sizes = F.transform("s", lambda x: F.regexp_count(x, F.lit("[A-Za-z]+")))
    # The arrays of one bind what is made once: sentences, their sizes in order, where a size begins, and how many are of each.
    bound = lambda made, f: F.transform(F.array(made), f)[0]
    begins = lambda x: F.filter(F.sequence(F.lit(0), F.size(x)), lambda i: (i == 0) | (i == F.size(x)) | ~F.get(x, i).eqNullSafe(F.get(x, i - 1)))
    lengths = lambda at: F.array_sort(F.zip_with(F.slice(at, 2, F.size(at)), F.slice(at, 1, F.size(at) - 1), lambda j, i: (j - i).cast("double")))
    told = bound(F.array_sort(sizes), lambda x: bound(begins(x), lambda at: bound(lengths(at), entropy)))
    return rows.select("doc_id", F.size("s").cast("long").alias("sentences"), (F.round(told, 6) + 0).alias("entropy"))


@query("SELECT role, count(*)::BIGINT AS messages, round(avg(length(text)), 4) AS mean_length, count(*) FILTER (regexp_matches(text, '^(feat|fix|docs|style|refactor|test|chore)(\\([^)]*\\))?:'))::BIGINT AS conventional, count(*) FILTER (regexp_matches(text, '#\\d+'))::BIGINT AS references_ FROM conversations GROUP BY 1".replace("\\\\", "\\"))
def message_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.groupBy("role").agg(
        F.count(F.lit(1)).alias("messages"), F.round(F.avg(F.length("text")), 4).alias("mean_length"),
        F.count_if(F.col("text").rlike(r"^(feat|fix|docs|style|refactor|test|chore)(\([^)]*\))?:")).alias("conventional"), F.count_if(F.col("text").rlike(r"#\d+")).alias("references_"),
    )


@query("SELECT lower(regexp_extract(text, '^[^ ]+')) AS word, count(*)::BIGINT AS n FROM conversations GROUP BY 1 ORDER BY n DESC, word LIMIT 10")
def first_word_topk(spark, sf_dir):
    word = F.lower(F.regexp_extract("text", "^[^ ]+", 0))
    return table(spark, sf_dir, "conversations").groupBy(word.alias("word")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(10)


@query("SELECT conv_id, count(*)::BIGINT AS turns, max(turn) AS last_turn, sum(length(text))::BIGINT AS chars, count(*) FILTER (role = 'user')::BIGINT AS asked, round(count(*) FILTER (role = 'user')::DOUBLE / count(*), 6) AS user_share FROM conversations GROUP BY 1")
def collaboration(spark, sf_dir):
    out = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.max("turn").alias("last_turn"), F.sum(F.length("text")).alias("chars"), F.count_if(F.col("role") == "user").alias("asked"))
    return out.withColumn("user_share", F.round(share(F.col("asked"), F.col("turns")), 6))
