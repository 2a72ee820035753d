"""Sinks of reports: JSON with sorted fields, CSV, and writes that are read back and checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sorted_json(df: DataFrame) -> DataFrame:
    """One JSON text a row, its fields in order of their names, nulls included."""
    fields = F.struct(*(F.col(f"`{c}`").alias(c) for c in sorted(df.columns)))
    return df.select(F.to_json(fields, {"ignoreNullFields": "false"}).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    sorted_json(df).write.text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def write_validated(df: DataFrame, path: str, required: list[str]) -> DataFrame:
    """Write Parquet, read it back by the same schema, and raise a ValueError
    where a required column is missing or holds a null; returns what was read."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are required")
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    nulls = back.agg(*(F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in required)).first() if required else None
    bad = {c: nulls[c] for c in required if nulls[c]}
    if bad:
        raise ValueError(f"required columns hold nulls: {bad}")
    return back


def verdict_text(verdicts: DataFrame, most: int = 300, cut: int = 280) -> DataFrame:
    """``text`` of at most ``most`` words; longer ones keep their first ``cut`` words."""
    words = F.split(F.trim("text"), r"\s+")
    short = F.concat(F.array_join(F.slice(words, 1, cut), " "), F.lit(" ..."))
    return verdicts.withColumn("text", F.when(F.size(words) > most, short).otherwise(F.col("text")))


#: Sections of the Markdown report in order, their subtitle, and the text of empty or constant ones.
SECTIONS = (
    ("Executive Summary", None, None), ("System Characterization", None, None), ("Evidence Highlights", None, None), ("Misleading Signals", "Potential False Positives", None),
    ("Safe to Change Surface", "Recommended Modification Areas", None), ("Risk Synthesis", None, None), ("Decision Artifacts", None, None), ("Authority Ceiling Evaluation", None, None),
    ("What Not to Fix", "Low Priority Recommendations", None),
    ("Refusal or First Action", None, "**Recommendation:** Do not proceed with changes until critical issues are addressed."), ("Confidence and Limits", None, None),
    ("Validity and Expiry", None, "**Valid for:** 30 days from generation\n**Conditions:** Repository state unchanged\n**Re-validation:** Required after any critical changes"),
)


def markdown(findings: DataFrame, title: str = "Repository Analysis Report", most: int = 5) -> DataFrame:
    """One Markdown ``report`` a repository from ``findings(repo, section, seq,
    name, detail)``. All sections stand in it, also empty ones. ``Critical
    Issues`` are part of the risks and list the first ``most``; findings of any
    other section are left out. A report is meant to be read, so its lines fit
    one row.
    """
    line = F.concat(F.lit("- **"), F.coalesce("name", F.lit("Unknown")), F.lit(":** "), F.coalesce("detail", F.lit("")))
    entry = F.struct("section", "seq", line.alias("line"))
    rows = findings.groupBy("repo").agg(F.array_sort(F.collect_list(entry)).alias("found"))

    def lines(name: str, first: int | None = None):
        own = F.transform(F.filter("found", lambda x: x["section"] == name), lambda x: x["line"])
        return F.array_join(own if first is None else F.slice(own, 1, first), "\n")

    def block(name, subtitle, constant):
        head = f"## {name}\n" + (f"\n### {subtitle}\n" if subtitle else "")
        body = F.lit(constant) if constant else lines(name)
        if name == "Risk Synthesis":
            issues = lines("Critical Issues", most)
            body = F.concat(body, F.when(issues != "", F.concat(F.lit("\n### Critical Issues\n\n"), issues)).otherwise(""))
        return F.concat(F.lit(head + "\n"), body, F.lit("\n"))

    return rows.select("repo", F.concat_ws("\n", F.lit(f"# {title}\n"), *(block(*s) for s in SECTIONS)).alias("report"))


def write_markdown(findings: DataFrame, path: str) -> None:
    markdown(findings).select(F.col("report").alias("value")).write.text(path)
