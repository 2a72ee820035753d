"""Clones, integration points, request texts, profiles and checks, on relations derived from the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions.scalars import jaccard, level
from strataloom.operators import signals as S
from strataloom.operators.blocks import COMMENTS, clones, code_blocks
from strataloom.operators.dependencies import dependency_health
from strataloom.operators.risks import CUT, RISKS, component_risks
from strataloom.operators.symbols import symbols
from strataloom.operators.syntax import STANDARD, calls, style, variables
from strataloom.plans import repositories as R
from strataloom.sources.derived import derived, derived_sql
from strataloom.sources.reports import SECTIONS, markdown
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


def _or(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _sql_or(tests) -> str:
    return "(" + " OR ".join(tests) + ")"


def _sql_has(column: str, needles) -> str:
    return _sql_or(f"contains({column}, '{n}')" for n in needles)


# Clones

_STRIP = r"regexp_replace(x, '^[ \t\r\f]+|[ \t\r\f]+$', '', 'g')"
_COMMENT = _sql_or(
    f"({_sql_or(f'''ends_with(path, '{e}')''' for e in ends)} AND {_sql_or([f'''starts_with({_STRIP}, '{b}')''' for b in begins] + [f'''contains({_STRIP}, '{h}')''' for h in holds])})"
    for ends, begins, holds in COMMENTS
)
_CODE = f"{_sql_or(f'''ends_with(path, '{e}')''' for e in S.CLONED)} AND NOT {_sql_has('lower(path)', S.NOT_CLONED)}"
_BLOCKS = rf"""code AS (SELECT repo, path, list_filter(string_split(content, chr(10)), lambda x: {_STRIP} <> '' AND NOT {_COMMENT}) AS ls FROM {derived_sql('clone_files')} WHERE {_CODE}),
runs AS (SELECT repo, path, i - 1 AS place, ls[i:i + 5] AS b FROM code, unnest(range(1, len(ls) - 4)) AS r(i)),
blocks AS (SELECT repo, path, place, array_to_string(list_transform(b, lambda x: repeat(' ', (len(regexp_extract(x, '^[ \t\r\f]*', 0)) // 4 * 4)::INT) || {_STRIP}), chr(10)) AS text FROM runs WHERE len(array_to_string(b, chr(10))) >= 10),
dups AS (SELECT *, md5(text) AS digest, count(*) OVER (PARTITION BY repo, text) AS n FROM blocks WHERE regexp_matches(text, '\w\w'))"""


def _cloned(spark, sf_dir: str) -> DataFrame:
    files, path = derived(spark, sf_dir, "clone_files"), F.col("path")
    return code_blocks(files.filter(S.ends(path, S.CLONED) & ~S.has(F.lower(path), *S.NOT_CLONED)))


@query(f"""WITH {_BLOCKS}, f AS (SELECT repo, digest, path, max(n) AS n, string_agg(place, ',' ORDER BY place) AS places FROM dups WHERE n > 1 GROUP BY 1, 2, 3)
SELECT repo, digest, path, places, n::BIGINT AS occurrences, count(*) OVER (PARTITION BY repo, digest)::BIGINT AS files FROM f""")
def clone_groups(spark, sf_dir):
    """Groups of equal blocks of code: one row a file with the places in it."""
    return clones(_cloned(spark, sf_dir)).select("repo", "digest", "path", F.array_join("places", ",").alias("places"), "occurrences", "files")


@query(f"""WITH {_BLOCKS}, p AS (SELECT repo, path, count(*) AS k FROM dups WHERE n > 1 GROUP BY 1, 2), t AS (SELECT repo, count(*) AS all_blocks FROM blocks GROUP BY 1),
d AS (SELECT repo, sum(k) AS dup, arg_min(path, (-k, path)) AS worst FROM p GROUP BY 1), g AS (SELECT repo, max(n) AS largest FROM dups WHERE n > 1 GROUP BY 1),
m AS (SELECT repo, round(coalesce(dup, 0) * 6 / all_blocks::DOUBLE, 3) AS ratio, coalesce(dup, 0)::BIGINT AS blocks, coalesce(largest, 0)::BIGINT AS largest, coalesce(worst, '') AS worst FROM t LEFT JOIN d USING (repo) LEFT JOIN g USING (repo))
SELECT *, round(greatest(0, 100 - least(ratio * 100, 50) - least(largest * 2, 20)), 3)::DOUBLE AS score FROM m""")
def clone_metrics(spark, sf_dir):
    """Share of duplicated lines, largest group, most duplicated file (the first by path of equals) and score of each repository."""
    blocks = _cloned(spark, sf_dir)
    files = clones(blocks).groupBy("repo", "path").agg(F.sum("own").alias("k"), F.max("occurrences").alias("largest"))
    dup = files.groupBy("repo").agg(F.sum("k").alias("dup"), F.max("largest").alias("largest"), F.min(F.struct((-F.col("k")).alias("k"), "path")).alias("worst"))
    rows = blocks.groupBy("repo").agg(F.count(F.lit(1)).alias("n")).join(dup, "repo", "left")
    none = lambda c: F.coalesce(c, F.lit(0))
    rows = rows.select("repo", F.round(none("dup") * 6 / F.col("n"), 3).alias("ratio"), none("dup").alias("blocks"), none("largest").alias("largest"), F.coalesce("worst.path", F.lit("")).alias("worst"))
    score = 100 - F.least(F.col("ratio") * 100, F.lit(50.0)) - F.least(F.col("largest") * 2, F.lit(20))
    return rows.withColumn("score", F.round(F.greatest(F.lit(0.0), score), 3))


@query(f"""WITH {_BLOCKS}, p AS (SELECT repo, path, count(*) AS k FROM dups WHERE n > 1 GROUP BY 1, 2), t AS (SELECT repo, path, count(*) AS n FROM blocks GROUP BY 1, 2)
SELECT repo, path, CASE WHEN coalesce(k, 0) / n::DOUBLE > 0.5 THEN 'critical' WHEN coalesce(k, 0) / n::DOUBLE > 0.3 THEN 'high' WHEN coalesce(k, 0) / n::DOUBLE > 0.15 THEN 'medium' ELSE 'low' END AS severity FROM t LEFT JOIN p USING (repo, path)""")
def clone_severity(spark, sf_dir):
    """Severity of each file's share of duplicated blocks."""
    blocks = _cloned(spark, sf_dir)
    own = clones(blocks).groupBy("repo", "path").agg(F.sum("own").alias("k"))
    rows = blocks.groupBy("repo", "path").agg(F.count(F.lit(1)).alias("n")).join(own, ["repo", "path"], "left")
    ratio = F.coalesce("k", F.lit(0)) / F.col("n")
    return rows.select("repo", "path", F.when(ratio > 0.5, "critical").when(ratio > 0.3, "high").when(ratio > 0.15, "medium").otherwise("low").alias("severity"))


_WORDSET = "list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: len(x) > 1))"


@query(f"""WITH w AS (SELECT conv_id, turn, {_WORDSET} AS ws FROM conversations), p AS (SELECT *, lag(ws) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM w)
SELECT conv_id, turn, round(CASE WHEN len(ws) > 0 AND len(before) > 0 THEN len(list_intersect(ws, before)) / len(list_distinct(list_concat(ws, before)))::DOUBLE ELSE 0 END, 6)::DOUBLE AS similarity FROM p WHERE before IS NOT NULL""")
def turn_similarity(spark, sf_dir):
    """Jaccard similarity of the words of each message and the one before it."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda x: F.length(x) > 1))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", words.alias("ws"))
    rows = rows.withColumn("before", F.lag("ws").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("before is not null")
    return rows.select("conv_id", "turn", F.round(jaccard(F.col("ws"), F.col("before")), 6).alias("similarity"))


# Integration points

#: Parts of an endpoint's address and what each adds to its score.
VALUABLE = ((("/admin", "/config", "/settings", "/system"), 0.3), (("/api/v", "/webhook", "/integration"), 0.2), (("/auth", "/login", "/token", "/oauth"), 0.25), (("/upload", "/import", "/export", "/data"), 0.15))
GUARDED = ("auth", "security", "admin", "config")
SUITABLE = ("/pulls", "/issues", "/releases", "/webhooks", "/api/v", "/integrations", "/automations")
PURPOSES = (("pull", "pr_management"), ("issue", "issue_tracking"), ("release", "release_management"), ("webhook", "event_handling"), ("integration", "third_party_integration"))
HOOKS = (
    "webhook", "payload", "signature.*verify", "x-hub-signature", "github-event", "ci\\.cd", "pipeline.*trigger", "build.*hook", "deploy.*hook", "automation.*trigger",
    "/api/", "/webhook/", "/integration/", "pulls", "issues", "releases",
)
CI = ((".github/workflows/", "action.yml", "action.yaml"), ("Jenkinsfile", "jenkins", ".jenkins"), (".circleci/", "circle.yml"), (".travis.yml", "travis"))
AUTOMATION = ((("webhook", "hook"), 0.2), (("client", "integration"), 0.2), (("automate", "script"), 0.1))
READINESS = ((0.8, "fully_automated"), (0.6, "highly_automated"), (0.4, "moderately_automated"), (0.2, "partially_automated"))
_FILES, _CALLS = derived_sql("repo_files"), derived_sql("api_calls")
_SUITS = f"({_sql_has('lower(url)', SUITABLE)} AND method IN ('POST', 'PUT', 'PATCH'))"
_PARTS = " + ".join(f"CASE WHEN {_sql_has('lower(url)', parts)} THEN {n} ELSE 0 END" for parts, n in VALUABLE)


def _suits(url: Column) -> Column:
    return S.has(F.lower(url), *SUITABLE) & F.col("method").isin("POST", "PUT", "PATCH")


@query(f"""WITH a AS (SELECT *, string_split(url, '/')[-1] AS seg FROM {_CALLS}),
h AS (SELECT a.repo, url, method, security, count(f.path) FILTER ({_sql_has('lower(f.path)', GUARDED)} OR contains(lower(f.path), seg)) AS related FROM a LEFT JOIN {_FILES} f ON f.repo = a.repo GROUP BY 1, 2, 3, 4),
s AS (SELECT *, least(0.5 + {_PARTS} + CASE WHEN method IN ('POST', 'PUT', 'PATCH') THEN 0.1 WHEN method = 'DELETE' THEN 0.2 ELSE 0 END + least(security * 0.1, 0.2) + least(related * 0.05, 0.15), 1) AS alpha FROM h)
SELECT repo, url, method, round(alpha, 6)::DOUBLE AS alpha, CASE WHEN security >= 3 THEN 'high' WHEN security >= 2 THEN 'medium' WHEN security >= 1 THEN 'low' ELSE 'none' END AS guard, {_SUITS} AS suitable,
 CASE {' '.join(f"WHEN contains(lower(url), '{w}') THEN '{p}'" for w, p in PURPOSES)} ELSE 'general_api' END AS purpose, row_number() OVER (PARTITION BY repo ORDER BY round(alpha, 6) DESC, url)::INT AS place FROM s WHERE round(alpha, 6) >= 0.7""")
def endpoint_alpha(spark, sf_dir):
    """Endpoints of high value, best first in each repository.

    Related files are counted in two partial aggregates, files of a guarded
    name and others that hold the endpoint's last part; an endpoint's parts
    travel to the files of its repository as one list, which its API bounds.
    Equal calls are one endpoint, whose related files count once for each.
    """
    url = F.col("url")
    calls = derived(spark, sf_dir, "api_calls").groupBy("repo", "url", "method", "security").agg(F.count(F.lit(1)).alias("calls"))
    made = calls.withColumn("seg", F.element_at(F.split(url, "/"), -1))
    files = derived(spark, sf_dir, "repo_files").select("repo", F.lower("path").alias("p")).withColumn("guarded", S.has(F.col("p"), *GUARDED))
    always = files.groupBy("repo").agg(F.count_if("guarded").alias("always"))
    segments = made.groupBy("repo").agg(F.collect_set("seg").alias("segs"))
    others = files.filter("not guarded").join(segments, "repo").select("repo", F.explode(F.filter("segs", lambda s: F.col("p").contains(s))).alias("seg"))
    rows = made.join(always, "repo", "left").join(others.groupBy("repo", "seg").agg(F.count(F.lit(1)).alias("more")), ["repo", "seg"], "left")
    related = (F.coalesce("always", F.lit(0)) + F.coalesce("more", F.lit(0))) * F.col("calls")
    parts = sum((F.when(S.has(F.lower(url), *needles), n).otherwise(0.0) for needles, n in VALUABLE), F.lit(0.5))
    way = F.when(F.col("method").isin("POST", "PUT", "PATCH"), 0.1).when(F.col("method") == "DELETE", 0.2).otherwise(0.0)
    alpha = F.least(parts + way + F.least(F.col("security") * 0.1, F.lit(0.2)) + F.least(related * 0.05, F.lit(0.15)), F.lit(1.0))
    purpose = reduce(lambda out, wp: out.when(F.lower(url).contains(wp[0]), wp[1]), PURPOSES[1:], F.when(F.lower(url).contains(PURPOSES[0][0]), PURPOSES[0][1])).otherwise("general_api")
    rows = rows.select(
        "repo", "url", "method", "security", F.round(alpha, 6).alias("alpha"), level(F.col("security"), [(3, "high"), (2, "medium"), (1, "low")], "none").alias("guard"), _suits(url).alias("suitable"), purpose.alias("purpose"),
    ).filter("alpha >= 0.7")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("alpha"), "url", "method", "security"))).drop("security")


_HOOK_URL = _sql_has("lower(url)", ("webhook", "hook", "payload"))
_PLATFORMS = [n for g, _, n, _ in S.SIGNALS if g == "ci_platform"]


@query(f"""WITH f AS (SELECT repo, count(*) FILTER ({_sql_has('lower(path)', HOOKS)}) AS hooks, {' + '.join(f"bool_or({_sql_has('path', c)})::INT" for c in CI)} AS ci,
 bool_or({_sql_has('path', _PLATFORMS)})::INT * 0.3 + {' + '.join(f"bool_or({_sql_has('lower(path)', words)})::INT * {n}" for words, n in AUTOMATION)} AS automation FROM {_FILES} GROUP BY 1),
a AS (SELECT repo, count(*) FILTER ({_HOOK_URL}) AS hooks, count(*) FILTER ({_SUITS}) AS points FROM {_CALLS} GROUP BY 1),
j AS (SELECT repo, coalesce(f.hooks, 0) + coalesce(a.hooks, 0) AS hooks, coalesce(ci, 0) AS ci, coalesce(points, 0) AS points, coalesce(automation, 0) AS automation FROM f FULL JOIN a USING (repo))
SELECT repo, hooks::BIGINT AS hooks, ci::INT AS ci, points::BIGINT AS points, round(automation, 6)::DOUBLE AS automation, CASE {' '.join(f"WHEN round(automation, 6) >= {b} THEN '{r}'" for b, r in READINESS)} ELSE 'manual_only' END AS readiness,
 round(least(least(hooks * 0.1, 0.3) + least(ci * 0.25, 0.25) + least(points * 0.083, 0.25) + automation * 0.2, 1), 6)::DOUBLE AS score,
 round((1 + (hooks > 0)::INT + (ci > 0)::INT + (points > 0)::INT) / (1 / 0.7 + (hooks > 0)::INT / 0.9 + (ci > 0)::INT / 0.8 + (points > 0)::INT / 0.8), 6)::DOUBLE AS confidence FROM j""")
def integration_summary(spark, sf_dir):
    """Webhooks, CI, endpoints and automation of each repository, with score and harmonic confidence."""
    path, low, url = F.col("path"), F.lower("path"), F.col("url")
    flag = lambda test: F.bool_or(test).cast("int")
    automation = flag(S.has(path, *_PLATFORMS)) * 0.3 + sum((flag(S.has(low, *words)) * n for words, n in AUTOMATION), F.lit(0.0))
    files = derived(spark, sf_dir, "repo_files").groupBy("repo").agg(F.count_if(S.has(low, *HOOKS)).alias("fh"), sum((flag(S.has(path, *c)) for c in CI), F.lit(0)).alias("ci"), F.round(automation, 6).alias("automation"))
    api = derived(spark, sf_dir, "api_calls").groupBy("repo").agg(F.count_if(S.has(F.lower(url), "webhook", "hook", "payload")).alias("ah"), F.count_if(_suits(url)).alias("points"))
    rows = files.join(api, "repo", "full").na.fill(0).withColumn("hooks", F.col("fh") + F.col("ah"))
    score = F.least(F.col("hooks") * 0.1, F.lit(0.3)) + F.least(F.col("ci") * 0.25, F.lit(0.25)) + F.least(F.col("points") * 0.083, F.lit(0.25)) + F.col("automation") * 0.2
    there = {c: (F.col(c) > 0).cast("int") for c in ("hooks", "ci", "points")}
    harmonic = sum(there.values(), F.lit(1)) / (there["hooks"] / 0.9 + there["ci"] / 0.8 + there["points"] / 0.8 + 1 / 0.7)
    return rows.select(
        "repo", "hooks", "ci", "points", "automation", level(F.col("automation"), READINESS, "manual_only").alias("readiness"),
        F.round(F.least(score, F.lit(1.0)), 6).alias("score"), F.round(harmonic, 6).alias("confidence"),
    )


# Requests and profiles

#: Kinds by words of the title, prefixes, branches and labels of each kind.
KINDS = (("security", ("security", "vulnerability", "exploit", "cve")), ("bug_fix", ("bug", "fix", "issue", "error")), ("feature", ("feature", "enhancement", "add")), ("documentation", ("doc", "documentation", "readme")))
PREFIXES = {"security": ("🔒 Security: ", "Security Fix: "), "bug_fix": ("🐛 Fix: ", "Fix: "), "feature": ("✨ Add: ", "Add: "), "documentation": ("📝 Update: ", "Update: ")}
BRANCHES = {"security": "security", "bug_fix": "fix", "feature": "feature", "documentation": "docs"}
LABELS = {"security": ("security", "bug"), "bug_fix": ("bug", "fix"), "feature": ("enhancement", "feature"), "documentation": ("documentation",)}


def _by_kind(values: dict) -> Column:
    (first, v), *rest = values.items()
    return reduce(lambda out, kv: out.when(F.col("kind") == kv[0], kv[1]), rest, F.when(F.col("kind") == first, v))


def _sql_by_kind(values: dict) -> str:
    return "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"


_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query(f"""WITH k AS (SELECT *, CASE {' '.join(f"WHEN {_sql_has('lower(title)', words)} THEN '{kind}'" for kind, words in KINDS)} WHEN list_contains(labels, 'bug') THEN 'bug_fix'
 WHEN list_contains(labels, 'enhancement') OR list_contains(labels, 'feature') THEN 'feature' ELSE 'bug_fix' END AS kind FROM {derived_sql('requests')})
SELECT id, kind, (CASE WHEN tone = 'collaborative' THEN {_sql_by_kind({k: f"'{v[0]}'" for k, v in PREFIXES.items()})} ELSE {_sql_by_kind({k: f"'{v[1]}'" for k, v in PREFIXES.items()})} END
 || trim(regexp_replace(regexp_replace(title, '[^\\p{{L}}\\p{{N}}_\\s-]', '', 'g'), '\\s+', ' ', 'g')) || CASE WHEN id <> '' THEN ' (#' || id || ')' ELSE '' END)[1:100] AS title,
 ({_sql_by_kind({k: f"'{v}'" for k, v in BRANCHES.items()})} || '/' || trim(regexp_replace(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}_-]', '-', 'g'), '-+', '-', 'g'), '-') || '-' || id)[1:50] AS branch,
 array_to_string(list_sort(list_distinct(list_concat({_sql_by_kind({k: _LIST(v) for k, v in LABELS.items()})}, labels, list_filter(focus, lambda x: x IN ('stability', 'testing'))))), ',') AS labels,
 round(least(0.5 + CASE WHEN profile > 0 THEN 0.2 ELSE 0 END + maturity * 0.3, 0.99), 6)::DOUBLE AS confidence FROM k""")
def request_texts(spark, sf_dir):
    """Kind, title, branch, labels and confidence of requests."""
    rows, title = derived(spark, sf_dir, "requests"), F.col("title")
    named = [(kind, S.has(F.lower(title), *words)) for kind, words in KINDS]
    kind = reduce(lambda out, kt: out.when(kt[1], kt[0]), named[1:], F.when(named[0][1], named[0][0])).when(F.array_contains("labels", "bug"), "bug_fix")
    kind = kind.when(F.array_contains("labels", "enhancement") | F.array_contains("labels", "feature"), "feature").otherwise("bug_fix")
    clean = F.trim(F.regexp_replace(F.regexp_replace(title, r"[^\p{L}\p{N}_\s-]", ""), r"\s+", " "))
    slug = F.btrim(F.regexp_replace(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}_-]", "-"), "-+", "-"), F.lit("-"))
    prefix = F.when(F.col("tone") == "collaborative", _by_kind({k: F.lit(v[0]) for k, v in PREFIXES.items()})).otherwise(_by_kind({k: F.lit(v[1]) for k, v in PREFIXES.items()}))
    own = _by_kind({k: F.array(*map(F.lit, v)) for k, v in LABELS.items()})
    labels = F.array_sort(F.array_distinct(F.concat(own, "labels", F.filter("focus", lambda x: x.isin("stability", "testing")))))
    return rows.withColumn("kind", kind).select(
        "id", "kind", F.substring(F.concat(prefix, clean, F.when(F.col("id") != "", F.concat(F.lit(" (#"), "id", F.lit(")"))).otherwise("")), 1, 100).alias("title"),
        F.substring(F.concat(_by_kind({k: F.lit(v) for k, v in BRANCHES.items()}), F.lit("/"), slug, F.lit("-"), "id"), 1, 50).alias("branch"), F.array_join(labels, ",").alias("labels"),
        F.round(F.least(0.5 + F.when(F.col("profile") > 0, 0.2).otherwise(0.0) + F.col("maturity") * 0.3, F.lit(0.99)), 6).alias("confidence"),
    )


_PROFILE = "CASE WHEN level IN ('stable', 'mature') THEN {} WHEN level IN ('experimental', 'alpha') THEN {} ELSE {} END"


@query(f"""WITH p AS (SELECT *, {_PROFILE.format(0.8, 0.6, 0.5)} AS style, CASE WHEN ci THEN 0.8 ELSE 0.5 END AS testing, CASE WHEN documented THEN 0.7 ELSE 0.5 END AS docs, {_PROFILE.format(0.7, 0.6, 0.5)} AS tone FROM {derived_sql('maturities')})
SELECT repo, {_PROFILE.format("'thorough'", "'flexible'", "'standard'")} AS review, {_PROFILE.format("'multiple_approvers'", "'single_approver'", "'single_approver'")} AS approvals,
 {_PROFILE.format("'stability,backward_compatibility,testing'", "'innovation,functionality'", "''")} AS focus, {_PROFILE.format("'formal'", "'collaborative'", "'professional'")} AS voice, {_PROFILE.format("'comprehensive'", "'concise'", "'standard'")} AS detail,
 round(CASE WHEN proven IS NULL THEN style ELSE (style + proven) / 2 END, 6)::DOUBLE AS style_confidence, round(5 / (1 / style + 1 / testing + 1 / docs + 1 / style + 1 / tone), 6)::DOUBLE AS confidence FROM p""")
def maintainer_profile(spark, sf_dir):
    """How a repository's maintainers review and write, from its maturity; proven accuracy is averaged in."""

    def of(settled, young, other):
        at = F.col("level")
        return F.when(at.isin("stable", "mature"), settled).when(at.isin("experimental", "alpha"), young).otherwise(other)

    own = of(0.8, 0.6, 0.5)
    parts = (own, F.when(F.col("ci"), 0.8).otherwise(0.5), F.when(F.col("documented"), 0.7).otherwise(0.5), own, of(0.7, 0.6, 0.5))
    return derived(spark, sf_dir, "maturities").select(
        "repo", of("thorough", "flexible", "standard").alias("review"), of("multiple_approvers", "single_approver", "single_approver").alias("approvals"),
        of("stability,backward_compatibility,testing", "innovation,functionality", "").alias("focus"), of("formal", "collaborative", "professional").alias("voice"), of("comprehensive", "concise", "standard").alias("detail"),
        F.round(F.coalesce((own + F.col("proven")) / 2, own), 6).alias("style_confidence"), F.round(len(parts) / sum((1 / c for c in parts), F.lit(0.0)), 6).alias("confidence"),
    )


# Checks

READY = ((95, "production_ready"), (85, "minor_issues"), (70, "requires_attention"), (50, "significant_issues"))


@query(f"""WITH s AS (SELECT repo, coalesce(100 * sum(CASE WHEN status = 'PASS' THEN weight WHEN status = 'FAIL' AND critical THEN -2 * weight ELSE 0 END) / nullif(sum(weight), 0)::DOUBLE, 0) AS score FROM {derived_sql('checks')} GROUP BY 1)
SELECT repo, round(score, 6) AS score, CASE {' '.join(f"WHEN score >= {b} THEN '{n}'" for b, n in READY)} ELSE 'not_ready' END AS readiness FROM s""")
def readiness_score(spark, sf_dir):
    """Weighted share of passed checks; a failed critical one counts twice against it."""
    gain = F.when(F.col("status") == "PASS", F.col("weight")).when((F.col("status") == "FAIL") & F.col("critical"), -2 * F.col("weight")).otherwise(0)
    score = F.coalesce(F.try_divide(100 * F.sum(gain), F.sum("weight")), F.lit(0.0))
    rows = derived(spark, sf_dir, "checks").groupBy("repo").agg(score.alias("s"))
    return rows.select("repo", F.round("s", 6).alias("score"), level(F.col("s"), READY, "not_ready").alias("readiness"))


_PARITY = "((pursue = merged)::INT + CASE WHEN coalesce(complexity, 'medium') = CASE WHEN added > 200 THEN 'high' WHEN added > 50 THEN 'medium' ELSE 'low' END THEN 0.5 ELSE 0 END + CASE WHEN contains(lower(technology), 'python') THEN 0.5 ELSE 0 END) / 3.0"


@query(f"""WITH p AS (SELECT {_PARITY} AS parity FROM {derived_sql('backtests')})
SELECT count(*)::BIGINT AS n, count(*) FILTER (parity >= 0.8)::BIGINT AS right_ones, round(avg(parity), 6)::DOUBLE AS mean_parity, round(avg((parity < 0.5)::INT), 6)::DOUBLE AS false_negative_rate,
 round(CASE WHEN count(*) < 2 THEN 0 ELSE greatest(0, least(1, avg(parity) - 2.576 * 0.1 / sqrt(count(*)))) END, 6)::DOUBLE AS confidence FROM p""")
def backtest_parity(spark, sf_dir):
    """How predictions of merged requests agree with what happened."""
    size = F.when(F.col("added") > 200, "high").when(F.col("added") > 50, "medium").otherwise("low")
    told = F.when(F.coalesce("complexity", F.lit("medium")) == size, 0.5).otherwise(0.0) + F.when(F.lower("technology").contains("python"), 0.5).otherwise(0.0)
    p = ((F.col("pursue") == F.col("merged")).cast("int") + told) / 3
    bound = F.avg("p") - 2.576 * 0.1 / F.sqrt(F.count(F.lit(1)))
    return derived(spark, sf_dir, "backtests").select(p.alias("p")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("p") >= 0.8).alias("right_ones"), F.round(F.avg("p"), 6).alias("mean_parity"), F.round(F.avg((F.col("p") < 0.5).cast("int")), 6).alias("false_negative_rate"),
        F.round(F.when(F.count(F.lit(1)) < 2, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), bound))), 6).alias("confidence"),
    )


#: Expected risk and least issues of each kind of trial; others get the last.
EXPECTED = (("web", "medium", 3), ("legacy", "high", 6), ("library", "low", 0))
_EXPECTED = ", ".join(f"('{k}', '{r}', {n})" for k, r, n in EXPECTED)


@query(f"""WITH e AS (SELECT t.*, coalesce(x.r, 'medium') AS want, greatest(1, coalesce(x.n, 2)) AS least_issues FROM {derived_sql('trials')} t LEFT JOIN (VALUES {_EXPECTED}) AS x(k, r, n) ON t.kind = x.k),
m AS (SELECT avg(success::INT) AS accuracy, avg((CASE WHEN risk = want THEN 1 ELSE 0.5 END + least(1, issues / least_issues::DOUBLE)) / 2) AS risk_accuracy, avg(least(1, issues / least_issues::DOUBLE)) AS coverage,
 greatest(0, 1 - avg(seconds) / 5) AS speed, greatest(0, 1 - avg(memory) / 100) AS memory FROM e)
SELECT round(accuracy, 6)::DOUBLE AS accuracy, round(risk_accuracy, 6)::DOUBLE AS risk_accuracy, round(coverage, 6)::DOUBLE AS coverage, round(speed, 6)::DOUBLE AS speed, round(memory, 6)::DOUBLE AS memory,
 round(100 * (accuracy * 0.25 + speed * 0.2 + accuracy * 0.2 + coverage * 0.2 + 0.95 * 0.15), 4)::DOUBLE AS score FROM m""")
def effectiveness_score(spark, sf_dir):
    """Trials against what is expected of their kind: accuracy, coverage, speed, memory and the weighted score."""
    known = F.broadcast(spark.createDataFrame(EXPECTED, "kind string, want string, n int"))  # a table of fixed values
    rows = derived(spark, sf_dir, "trials").join(known, "kind", "left").withColumn("found", F.least(F.lit(1.0), F.col("issues") / F.greatest(F.lit(1), F.coalesce("n", F.lit(2)))))
    right = F.when(F.col("risk") == F.coalesce("want", F.lit("medium")), 1.0).otherwise(0.5)
    m = rows.agg(
        F.avg(F.col("success").cast("int")).alias("accuracy"), F.avg((right + F.col("found")) / 2).alias("risk_accuracy"), F.avg("found").alias("coverage"),
        F.greatest(F.lit(0.0), 1 - F.avg("seconds") / 5).alias("speed"), F.greatest(F.lit(0.0), 1 - F.avg("memory") / 100).alias("memory"),
    )
    score = 100 * (F.col("accuracy") * 0.45 + F.col("speed") * 0.2 + F.col("coverage") * 0.2 + 0.95 * 0.15)
    return m.select(*(F.round(c, 6).alias(c) for c in m.columns), F.round(score, 4).alias("score"))


@query(f"""SELECT 'determinism: ' || input AS claim, count(DISTINCT output) = 1 AS valid, CASE WHEN count(*) > 3 THEN 1.0 ELSE 0.5 END::DOUBLE AS confidence FROM {derived_sql('runs')} GROUP BY input
UNION ALL SELECT 'accuracy', coalesce(avg(agreed::INT) >= 0.99999, false), least(1, count(agreed) / 1000.0)::DOUBLE FROM {derived_sql('runs')}""")
def claim_checks(spark, sf_dir):
    """Whether runs of one input agree, surer after three earlier ones, and whether reviewers agree."""
    runs = derived(spark, sf_dir, "runs")
    # The least and the largest output are equal where all are: a partial aggregate without a distinct.
    same = runs.groupBy("input").agg((F.min("output") == F.max("output")).alias("valid"), F.when(F.count(F.lit(1)) > 3, 1.0).otherwise(0.5).alias("confidence"))
    agreed = runs.agg(F.coalesce(F.avg(F.col("agreed").cast("int")) >= 0.99999, F.lit(False)).alias("valid"), F.least(F.lit(1.0), F.count("agreed") / 1000).alias("confidence"))
    return same.select(F.concat(F.lit("determinism: "), "input").alias("claim"), "valid", "confidence").unionByName(agreed.select(F.lit("accuracy").alias("claim"), "valid", "confidence"))


@query(f"""WITH s AS (SELECT repo, 1 - CASE WHEN kinds <> files THEN 0.2 ELSE 0 END - CASE WHEN semantic > files THEN 0.1 ELSE 0 END - CASE WHEN components <> 8 THEN 0.05 ELSE 0 END - CASE WHEN actions <> reported THEN 0.05 ELSE 0 END AS s FROM {derived_sql('summaries')})
SELECT repo, round(s, 6)::DOUBLE AS score, CASE WHEN round(s, 6) >= 0.9 THEN 'high' WHEN round(s, 6) >= 0.7 THEN 'medium' ELSE 'low' END AS consistency FROM s""")
def result_consistency(spark, sf_dir):
    """What a result's counts take from its consistency."""
    off = lambda test, n: F.when(test, n).otherwise(0.0)
    c = F.col
    score = 1 - off(c("kinds") != c("files"), 0.2) - off(c("semantic") > c("files"), 0.1) - off(c("components") != 8, 0.05) - off(c("actions") != c("reported"), 0.05)
    rows = derived(spark, sf_dir, "summaries").select("repo", F.round(score, 6).alias("score"))
    return rows.withColumn("consistency", level(c("score"), [(0.9, "high"), (0.7, "medium")], "low"))


# Reports and syntax

_LISTED = "(" + ", ".join(f"'{name}'" for name, _, _ in SECTIONS) + ", 'Critical Issues')"

@query(f"""WITH l AS (SELECT repo, section, string_agg('- **' || name || ':** ' || detail, chr(10) ORDER BY seq) AS lines FROM {derived_sql('findings')} WHERE section IN {_LISTED} GROUP BY 1, 2)
SELECT repo, count(*)::BIGINT AS filled, max(lines) FILTER (section = 'Misleading Signals') AS misleading, max(lines) FILTER (section = 'Critical Issues') AS issues FROM l GROUP BY 1""")
def report_sections(spark, sf_dir):
    """Lines of a report's sections as they stand in the Markdown report; other sections are left out."""
    body = F.col("report")
    part = lambda title: F.regexp_extract(body, rf"##+ {title}\n\n(?:### [^\n]*\n\n)?((?:- [^\n]*\n?)+)", 1)
    filled = F.size(F.filter(F.split(body, r"\n##+ "), lambda x: x.contains("\n- **"))).cast("long")
    none = lambda c: F.when(c != "", F.rtrim(F.regexp_replace(c, r"\n+$", "")))
    return markdown(derived(spark, sf_dir, "findings")).select("repo", filled.alias("filled"), none(part("Misleading Signals")).alias("misleading"), none(part("Critical Issues")).alias("issues"))


_MODULES = derived_sql("modules")
_MOD_LINES = f"(SELECT repo, path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM {_MODULES} WHERE ends_with(path, '.py') AND NOT starts_with(path, 'bad'))"
_STD = "(" + ", ".join(f"'{m}'" for m in STANDARD) + ")"


@query(rf"""WITH l AS (SELECT *, lead(line) OVER (PARTITION BY repo, path ORDER BY n) AS following FROM {_MOD_LINES}),
i AS (SELECT repo, path, n, regexp_extract(line, '^(?:import|from) (\.?\w*)', 1) AS m, n - lag(n) OVER (PARTITION BY repo, path ORDER BY n) AS gap FROM l WHERE regexp_matches(line, '^(import|from) ')),
g AS (SELECT repo, path, bool_or(gap > 1) AS parted FROM i GROUP BY 1, 2),
f AS (SELECT repo, count(*) FILTER (regexp_matches(line, '^\s*def ')) AS functions, count(*) FILTER (regexp_matches(line, '^\s*def _')) AS private, count(*) FILTER (regexp_matches(line, '^\s*def ') AND regexp_matches(following, '^\s*"{{3}}')) AS told,
 count(*) FILTER (regexp_matches(line, '^class ')) AS classes, count(*) FILTER (regexp_matches(line, '^class [A-Z]')) AS pascal FROM l GROUP BY 1),
t AS (SELECT repo, count(*) FILTER (m IN {_STD}) AS standard, count(*) FILTER (m = '.') AS own, count(*) FILTER (m <> '.' AND m NOT IN {_STD}) AS others FROM i GROUP BY 1),
p AS (SELECT repo, avg(coalesce(parted, false)::INT) AS parted FROM g GROUP BY 1)
SELECT repo, functions::BIGINT AS functions, CASE WHEN private / nullif(functions, 0)::DOUBLE > 0.3 THEN 'prefers_private' WHEN functions > 0 THEN 'balanced' END AS function_naming, CASE WHEN told / nullif(functions, 0)::DOUBLE > 0.7 THEN 'well_documented' WHEN functions > 0 THEN 'minimal' END AS documentation,
 CASE WHEN pascal / nullif(classes, 0)::DOUBLE > 0.8 THEN 'pascal_case' WHEN classes > 0 THEN 'mixed' END AS class_naming, CASE WHEN parted > 0.5 THEN 'separated' WHEN parted IS NOT NULL THEN 'mixed' END AS import_grouping,
 coalesce(standard, 0)::BIGINT AS standard, coalesce(others, 0)::BIGINT AS others, coalesce(own, 0)::BIGINT AS own FROM f LEFT JOIN t USING (repo) LEFT JOIN p USING (repo)""")
def style_profile(spark, sf_dir):
    """Naming, docstrings and imports of each repository's Python files, from their syntax trees."""
    return style(derived(spark, sf_dir, "modules"))


@query()
def variable_flow(spark, sf_dir):
    """Definitions and uses of each variable of Python files."""
    return variables(derived(spark, sf_dir, "modules"))


@query()
def call_graph(spark, sf_dir):
    """Calls in Python files: caller, callee and line."""
    return calls(derived(spark, sf_dir, "modules"))


# Change safety

#: What critical files of a repository of each intent hold in their path, as it is or in lower case.
CRITICAL = {"application": ("path", ("main.py", "__main__.py")), "library": ("path", ("__init__.py", "setup.py")), "tool": ("low", ("cli", "command"))}
_CRITICAL = " OR ".join(f"(primary_intent = '{i}' AND {_sql_has('path' if c == 'path' else 'lower(path)', words)})" for i, (c, words) in CRITICAL.items())
_PY = f"(SELECT repo, unnest(string_split(content, chr(10))) AS line FROM {_FILES} WHERE ends_with(path, '.py'))"


@query(rf"""WITH c AS (SELECT repo, path FROM {_FILES} JOIN (SELECT repo, primary_intent FROM ({R.SQL['intent_posture']})) USING (repo) WHERE {_CRITICAL} OR contains(lower(path), 'ci') OR contains(path, '.github/workflows') UNION SELECT repo, label FROM {R._SIGNALS} WHERE grp = 'configuration'),
k AS (SELECT repo, count(*) AS critical, list_sort(list(path))[1:10] AS firsts FROM c GROUP BY 1), n AS (SELECT repo, count(*) AS files, bool_or(contains(lower(path), 'readme')) AS readme FROM {_FILES} GROUP BY 1),
i AS (SELECT repo, count(*) AS imports, count(*) FILTER (contains(m, '.') AND NOT starts_with(m, 'src.')) AS outer_imports FROM (SELECT repo, regexp_extract(line, '^import ([\w.]+)', 1) AS m FROM {_PY}) WHERE m <> '' GROUP BY 1),
s AS (SELECT repo, bool_or(grp = 'lock_file') AS locked, bool_or(grp = 'api_docs') AS api_docs FROM {R._SIGNALS} GROUP BY 1),
l AS (SELECT repo, CASE WHEN maturity >= 0.8 THEN 'high' WHEN maturity >= 0.6 THEN 'medium' WHEN maturity >= 0.3 THEN 'low' ELSE 'very_low' END AS test, 'high' AS complexity,
 CASE WHEN NOT coalesce(locked, false) OR vulnerable > 0 THEN 'low' WHEN coalesce(outer_imports, 0) / greatest(coalesce(imports, 0), 1)::DOUBLE < 0.3 THEN 'high' ELSE 'medium' END AS dependency,
 CASE WHEN coalesce(critical, 0) / files::DOUBLE < 0.1 THEN 'high' WHEN coalesce(critical, 0) / files::DOUBLE < 0.3 THEN 'medium' ELSE 'low' END AS critical,
 CASE WHEN docs / greatest(code, 1)::DOUBLE > 0.5 AND readme AND coalesce(api_docs, false) THEN 'high' WHEN docs / greatest(code, 1)::DOUBLE > 0.2 AND readme THEN 'medium' WHEN readme THEN 'low' ELSE 'very_low' END AS documentation,
 coalesce(array_to_string(firsts, ','), '') AS critical_files
 FROM n JOIN {R._COUNTS} USING (repo) JOIN (SELECT repo, maturity FROM ({R.SQL['test_signals']})) USING (repo) JOIN (SELECT repo, vulnerable FROM ({R.SQL['dependency_summary']})) USING (repo) LEFT JOIN k USING (repo) LEFT JOIN i USING (repo) LEFT JOIN s USING (repo)),
m AS (SELECT *, ({' + '.join(f"CASE {c} WHEN 'very_low' THEN 1 WHEN 'low' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END" for c in ('test', 'complexity', 'dependency', 'critical', 'documentation'))}) / 5.0 AS score FROM l)
SELECT *, CASE WHEN score >= 3.5 THEN 'high' WHEN score >= 2.5 THEN 'medium' WHEN score >= 1.5 THEN 'low' ELSE 'very_low' END AS safety FROM (SELECT * REPLACE (score::DOUBLE AS score) FROM m)""")
def change_factors(spark, sf_dir):
    """Five factors of how safe a repository is to change, their mean, and its first ten critical files.

    Lock files, vulnerable packages, readmes and API documents are told by the
    signals of its files."""
    files = R._files(spark, sf_dir)
    path, low = F.col("path"), F.lower("path")
    intents = R.intent_posture(spark, sf_dir).select("repo", "primary_intent")
    signals = S.signals(files)
    fits = _or([(F.col("primary_intent") == i) & S.has(path if c == "path" else low, *words) for i, (c, words) in CRITICAL.items()])
    held = files.join(intents, "repo").filter(fits | low.contains("ci") | path.contains(".github/workflows")).select("repo", "path")
    critical = held.unionByName(signals.filter("grp = 'configuration'").select("repo", F.col("label").alias("path"))).distinct()
    # The first ten by a rank, so that no list holds all of them.
    ranked = critical.withColumn("n", F.row_number().over(Window.partitionBy("repo").orderBy("path")))
    critical = ranked.groupBy("repo").agg(F.count(F.lit(1)).alias("n_critical"), F.array_sort(F.collect_list(F.when(F.col("n") <= 10, F.col("path")))).alias("firsts"))
    found = symbols(files.select(F.concat_ws("\n", "repo", "path").alias("rel_path"), "content")).withColumn("repo", F.split("rel_path", "\n")[0])
    is_import, is_function = F.col("kind") == "import", F.col("kind") == "function"
    code = found.groupBy("repo").agg(
        F.count_if(is_import).alias("imports"), F.count_if(is_import & F.col("name").contains(".") & ~F.col("name").startswith("src.")).alias("outer_imports"),
        F.count_if(is_function).alias("functions"), F.count_if(is_function & (F.col("complexity") > 15)).alias("branched"),
    )
    told = signals.groupBy("repo").agg(F.bool_or(F.col("grp") == "lock_file").alias("locked"), F.bool_or(F.col("grp") == "api_docs").alias("api_docs"))
    rows = files.groupBy("repo").agg(F.count(F.lit(1)).alias("files"), F.bool_or(low.contains("readme")).alias("readme"))
    for other in (S.file_counts(files).select("repo", "code", "docs"), R._test_signals(files).select("repo", "maturity"), dependency_health(files).select("repo", "vulnerable"), critical, code, told):
        rows = rows.join(other, "repo", "left")
    rows = rows.na.fill(0).na.fill(False)
    ratio = lambda part, whole: F.col(part) / F.greatest(F.col(whole), F.lit(1))
    few = lambda part, whole: F.when(ratio(part, whole) < 0.1, "high").when(ratio(part, whole) < 0.3, "medium").otherwise("low")
    covered = ratio("docs", "code")
    factors = {
        "test": level(F.col("maturity"), [(0.8, "high"), (0.6, "medium"), (0.3, "low")], "very_low"), "complexity": few("branched", "functions"),
        "dependency": F.when(~F.col("locked") | (F.col("vulnerable") > 0), "low").when(ratio("outer_imports", "imports") < 0.3, "high").otherwise("medium"), "critical": few("n_critical", "files"),
        "documentation": F.when((covered > 0.5) & F.col("readme") & F.col("api_docs"), "high").when((covered > 0.2) & F.col("readme"), "medium").when(F.col("readme"), "low").otherwise("very_low"),
    }
    rows = rows.select("repo", *(c.alias(n) for n, c in factors.items()), F.coalesce(F.array_join("firsts", ","), F.lit("")).alias("critical_files"))
    points = {n: F.when(F.col(n) == "very_low", 1).when(F.col(n) == "low", 2).when(F.col(n) == "medium", 3).otherwise(4) for n in factors}
    rows = rows.withColumn("score", sum(points.values(), F.lit(0)) / 5)
    return rows.withColumn("safety", level(F.col("score"), [(3.5, "high"), (2.5, "medium"), (1.5, "low")], "very_low"))


def _sql_risk(component: str, steps, rules) -> str:
    score = " + ".join(f"CASE WHEN {test} THEN {n} ELSE 0 END" for test, n, _ in rules)
    factors = ", ".join(f"CASE WHEN {test} THEN {name} END" for test, _, name in rules)
    told = "CASE " + " ".join(f"WHEN s >= {b} THEN '{n}'" for b, n in steps) + " ELSE 'low' END"
    told = f"coalesce(assessed, {told})" if component == "security" else told
    return f"SELECT repo, '{component}' AS component, {told} AS level, {f'least(s, {CUT[component]})' if component in CUT else 's'}::BIGINT AS score, factors FROM (SELECT repo, assessed, {score} AS s, concat_ws(',', {factors}) AS factors FROM {derived_sql('counts')})"


_RISKS = " UNION ALL ".join(_sql_risk(*r) for r in RISKS)


@query(_RISKS)
def component_scores(spark, sf_dir):
    """Score, level and factors of the 14 components of each repository's risk."""
    return component_risks(derived(spark, sf_dir, "counts")).withColumn("factors", F.array_join("factors", ","))


@query(f"""SELECT repo, round(m, 6)::DOUBLE AS risk, CASE WHEN m >= 2.5 THEN 'high' WHEN m >= 1.8 THEN 'medium' ELSE 'low' END AS level FROM (
SELECT repo, sum(weight * CASE level WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) / sum(weight)::DOUBLE AS m FROM ({_RISKS}) JOIN (VALUES {R._WEIGHTS}) AS w(component, weight) USING (component) GROUP BY 1)""")
def overall_risk(spark, sf_dir):
    """Weighted risk of repositories from their counts; ``critical`` counts as low, as any level but medium and high does."""
    return R.weighted_risk(component_risks(derived(spark, sf_dir, "counts"))).select("repo", "risk", "level")
