"""All stages of an analysis over texts in one scan, as one row a repository.

Each text gives one row a stage, ``(repo, stage, key, a … f)`` with up to six
counts, and one a block of lines. All go to one partial aggregate, by the block's
digest where there is one, so what is shuffled is a row a task, repository and
stage, and a row a block that differs; a second, tiny aggregate has a row a task
and repository. No stage is joined to another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions.scalars import cyclomatic, level, nesting, share
from strataloom.operators.blocks import BLOCK, digests
from strataloom.operators.rules import COMPLIANCE, MORE_COMPLIANCE, compliance_checks, severities

COUNTS = ("a", "b", "c", "d", "e", "f")


def stage_rows(docs: DataFrame) -> DataFrame:
    """Rows ``(repo, stage, key, a … f)`` of texts ``(source, text)``; a null text is empty."""
    text, low, lines = F.col("text"), F.col("low"), F.col("lines")
    rules, checks = COMPLIANCE + MORE_COMPLIANCE, compliance_checks(text, low)
    some = lambda tests: sum((F.col("broken")[i].cast("long") for i, (_, f, s) in enumerate(rules) if tests(f, s)), F.lit(0).cast("long"))
    own = lambda s: F.size("hits") - F.size(F.array_remove("hits", s))
    above = lambda c, bound, most=1 << 40: ((F.col(c) > bound) & (F.col(c) <= most))

    def row(stage: str, *counts: Column, key: Column | None = None) -> Column:
        padded = [*counts, *[F.lit(0)] * (len(COUNTS) - len(counts))]
        return F.struct(F.lit(stage).alias("stage"), (F.lit(None) if key is None else key).cast("string").alias("key"), *(c.cast("long").alias(n) for c, n in zip(padded, COUNTS, strict=True)))

    base = docs.select("source", F.coalesce("text", F.lit("")).alias("text")).select("*", F.lower("text").alias("low"), F.split("text", "\n").alias("lines"))
    told = base.select(
        "source", "lines", F.array(*(checks[r] for r, _, _ in rules)).alias("broken"), severities(text).alias("hits"), cyclomatic(text).alias("cyclomatic"), digests(lines).alias("digests"),
    ).withColumn("cognitive", F.col("cyclomatic") + nesting(lines))
    stages = F.array(
        row("structure", F.lit(1), F.size("lines")),
        row("security", F.size("hits"), own("critical"), own("high"), own("medium")),
        row("compliance", some(lambda f, s: True), some(lambda f, s: s == "critical"), some(lambda f, s: s == "high"), some(lambda f, s: f == "OWASP"), some(lambda f, s: f == "SECURITY")),
        row("metrics", above("cyclomatic", 15), above("cyclomatic", 10, 15), above("cognitive", 20), above("cognitive", 15, 20)),
    )
    # Outer, as the planner would make all rows twice, first for their number.
    rows = told.select(F.col("source").alias("repo"), F.explode_outer(F.concat(stages, F.transform("digests", lambda d: row("duplication", F.lit(1), key=d)))).alias("x"))
    return rows.select("repo", "x.*")


def repository_counts(docs: DataFrame) -> DataFrame:
    """One row per repository: what all stages counted, under the names that the rules of risk read."""
    met = stage_rows(docs).groupBy("repo", "stage", "key").agg(*(F.sum(c).alias(c) for c in COUNTS))
    of = lambda stage, c: F.coalesce(F.sum(F.when(F.col("stage") == stage, F.col(c))), F.lit(0).cast("long"))
    repeated = F.when((F.col("stage") == "duplication") & (F.col("a") > 1), F.col("a"))
    named = {
        "files": ("structure", "a"), "lines": ("structure", "b"), "findings": ("security", "a"), "critical": ("security", "b"), "high": ("security", "c"), "medium": ("security", "d"),
        "broken": ("compliance", "a"), "broken_critical": ("compliance", "b"), "broken_high": ("compliance", "c"), "broken_owasp": ("compliance", "d"), "broken_practices": ("compliance", "e"),
        "cyclomatic_high": ("metrics", "a"), "cyclomatic_mid": ("metrics", "b"), "cognitive_high": ("metrics", "c"), "cognitive_mid": ("metrics", "d"), "blocks": ("duplication", "a"),
    }
    out = met.groupBy("repo").agg(*(of(*x).alias(n) for n, x in named.items()), F.coalesce(F.sum(repeated), F.lit(0)).cast("long").alias("duplicates"), F.coalesce(F.max(F.when(F.col("stage") == "duplication", F.col("a"))), F.lit(0).cast("long")).alias("largest"))
    rules = COMPLIANCE + MORE_COMPLIANCE
    kept = lambda broken, n: 100 - F.col(broken) * 100 / (F.col("files") * n)
    ratio = share(F.col("duplicates") * BLOCK, F.col("blocks"))
    mean = (F.col("critical") * 10 + F.col("high") * 7 + F.col("medium") * 4) / 10 / F.col("findings")
    score = F.round(mean * F.least(F.col("lines") / 10000, F.lit(1.0)), 6)
    told = F.when(F.col("findings") == 0, "low").otherwise(level(score, [(0.8, "critical"), (0.6, "high"), (0.4, "medium"), (0.2, "low")], "minimal"))
    return out.select(
        "*", (F.col("findings") * 1000 / F.col("lines")).alias("density"), told.alias("assessed"), kept("broken", len(rules)).alias("compliance"),
        *(kept(f"broken_{c}", sum(r[1] == f for r in rules)).alias(c) for c, f in (("owasp", "OWASP"), ("practices", "SECURITY"))), ratio.alias("ratio"),
        F.greatest(F.lit(0.0), 100 - F.least(ratio * 100, F.lit(50.0)) - F.least(2 * F.col("largest"), F.lit(20))).alias("duplication"),
    )
