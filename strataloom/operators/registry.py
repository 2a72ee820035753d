"""A catalogue of rules over whole files to which users add their own.

A rule is a function from the text and its lower-case form to a Column, or one
of whole batches of texts where Columns can't say it. All rules of a catalogue
are answered in one projection over one scan; those on batches share one Arrow
exchange, whatever their number.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType

from strataloom.operators.rules import COMPLIANCE, MORE_COMPLIANCE, compliance_checks


@dataclass
class Rule:
    name: str
    framework: str
    severity: str
    check: Callable
    language: str = "any"
    by_batch: bool = False


@dataclass
class Rules:
    """Rules by name, in the order in which they were added."""

    rules: dict[str, Rule] = field(default_factory=dict)

    def add(self, rule: Rule) -> Rules:
        if rule.name in self.rules:
            raise ValueError(f"there is a rule {rule.name} already")
        self.rules[rule.name] = rule
        return self

    def column(self, name: str, framework: str, severity: str, check: Callable[[Column, Column], Column], language: str = "any") -> Rules:
        """A rule that tells from the text and its lower-case form, as Columns, whether it is broken."""
        return self.add(Rule(name, framework, severity, check, language))

    def batch(self, name: str, framework: str, severity: str, check: Callable[[pd.Series], pd.Series], language: str = "any") -> Rules:
        """A rule that tells for a batch of texts which break it."""
        return self.add(Rule(name, framework, severity, check, language, True))

    def apply(self, docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
        """Rows ``(doc_id, source, rule, framework, severity, broken)`` for each
        file and each rule of its language; a null text is empty, a null answer
        says that a rule is kept."""
        batches = [r for r in self.rules.values() if r.by_batch]
        checks = [r.check for r in batches]

        @F.pandas_udf(ArrayType(BooleanType()))
        def answers(texts: pd.Series) -> pd.Series:
            told = [list(check(texts)) for check in checks]
            return pd.Series([[None if pd.isna(x) else bool(x) for x in row] for row in zip(*told, strict=True)] if len(texts) else [], dtype=object)

        rows = docs.select("doc_id", "source", F.col(lang).alias("__lang"), F.coalesce(F.col(text), F.lit("")).alias("__text")).withColumn("__low", F.lower("__text"))
        if batches:
            rows = rows.withColumn("__told", answers("__text"))
        place = {r.name: i for i, r in enumerate(batches)}
        one = []
        for r in self.rules.values():
            broken = F.col("__told")[place[r.name]] if r.by_batch else r.check(F.col("__text"), F.col("__low"))
            row = F.struct(F.lit(r.name).alias("rule"), F.lit(r.framework).alias("framework"), F.lit(r.severity).alias("severity"), F.coalesce(broken, F.lit(False)).alias("broken"))
            one.append(row if r.language == "any" else F.when(F.col("__lang") == r.language, row))
        # Outer, as the planner would answer all rules twice, first for their number.
        told = rows.select("doc_id", "source", F.explode_outer(F.array_compact(F.array(*one))).alias("x"))
        return told.select("doc_id", "source", "x.*").filter("rule is not null")


def catalogue() -> Rules:
    """The 16 compliance rules, to add to."""
    out = Rules()
    for name, framework, severity in COMPLIANCE + MORE_COMPLIANCE:
        out.column(name, framework, severity, lambda text, low, name=name: compliance_checks(text, low)[name])
    return out
