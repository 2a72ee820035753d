"""Calibration, risk and confidence scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.functions.scalars import level, share, wilson
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


_JUDGED = "(SELECT d.source, d.n_chars, d.lang, l.quality FROM documents d JOIN labels l USING (doc_id))"


def _judged(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", "lang")
    return docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


@query(f"""SELECT source, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision_, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1
FROM (SELECT source, count(*) FILTER (n_chars > 400 AND quality = 1) AS tp, count(*) FILTER (n_chars > 400 AND quality = 0) AS fp, count(*) FILTER (n_chars <= 400 AND quality = 1) AS fn FROM {_JUDGED} GROUP BY 1)""")
def calibration_prf(spark, sf_dir):
    said, good = F.col("n_chars") > 400, F.col("quality") == 1
    out = _judged(spark, sf_dir).groupBy("source").agg(F.count_if(said & good).alias("tp"), F.count_if(said & ~good).alias("fp"), F.count_if(~said & good).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.select("source", "tp", "fp", "fn", F.round(share(tp, tp + fp), 6).alias("precision_"), F.round(share(tp, tp + fn), 6).alias("recall"), F.round(share(2 * tp, 2 * tp + fp + fn), 6).alias("f1"))


@query(f"""SELECT lang, n, good, round(greatest(0, (p + z2 / (2 * n) - 3.291 * sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)), 6)::DOUBLE AS low, round(least(1, (p + z2 / (2 * n) + 3.291 * sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)), 6)::DOUBLE AS high
FROM (SELECT *, good / n::DOUBLE AS p, (3.291 * 3.291)::DOUBLE AS z2 FROM (SELECT lang, count(*)::BIGINT AS n, count(*) FILTER (quality = 1)::BIGINT AS good FROM {_JUDGED} GROUP BY 1))""")
def wilson_interval(spark, sf_dir):
    out = _judged(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 1).alias("good"))
    low, high = wilson(F.col("good"), F.col("n"))
    return out.select("lang", "n", "good", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


#: Grid of thresholds.
GRID = (100, 200, 400, 800, 1600)


@query("SELECT threshold, round(avg(((n_chars > threshold) = (quality = 1))::INT), 6) AS accuracy FROM " + _JUDGED + " CROSS JOIN (SELECT unnest([" + ", ".join(map(str, GRID)) + "]) AS threshold) GROUP BY 1")
def threshold_grid(spark, sf_dir):
    """Accuracy at each threshold; the grid is fixed, so rows are exploded, not joined."""
    rows = _judged(spark, sf_dir).select("n_chars", "quality", F.explode(F.array(*map(F.lit, GRID))).alias("threshold"))
    right = ((F.col("n_chars") > F.col("threshold")) == (F.col("quality") == 1)).cast("int")
    return rows.groupBy("threshold").agg(F.round(F.avg(right), 6).alias("accuracy"))


@query("SELECT o_custkey AS id, count(*)::BIGINT AS n, round(count(*) / sum(1 / o_totalprice), 4) AS harmonic, round(greatest(0, 1 - var_pop(o_totalprice / 100000) / 2), 6)::DOUBLE AS consistency FROM orders GROUP BY 1")
def harmonic_confidence(spark, sf_dir):
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.round(F.count(F.lit(1)) / F.sum(1 / price), 4).alias("harmonic"), F.round(F.greatest(F.lit(0.0), 1 - F.var_pop(price / 100000) / 2), 6).alias("consistency"))


@query("SELECT l_suppkey AS supplier, round(sum(l_quantity * l_discount) / sum(l_quantity), 6) AS weighted, CASE WHEN sum(l_quantity * l_discount) / sum(l_quantity) >= 0.055 THEN 'high' WHEN sum(l_quantity * l_discount) / sum(l_quantity) >= 0.045 THEN 'medium' ELSE 'low' END AS level, round(100 - least(10 * count(*) FILTER (l_returnflag = 'R'), 40) - least(5 * count(*) FILTER (l_tax > 0.07), 20), 6)::DOUBLE AS health FROM lineitem GROUP BY 1")
def weighted_ladder(spark, sf_dir):
    """Weighted mean, ladder and penalty score by key."""
    mean = F.sum(F.col("l_quantity") * F.col("l_discount")) / F.sum("l_quantity")
    health = 100 - F.least(10 * F.count_if(F.col("l_returnflag") == "R"), F.lit(40)) - F.least(5 * F.count_if(F.col("l_tax") > 0.07), F.lit(20))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("supplier")).agg(F.round(mean, 6).alias("weighted"), level(mean, [(0.055, "high"), (0.045, "medium")], "low").alias("level"), health.cast("double").alias("health"))


@query("""SELECT conv_id, round(score, 6) AS score, CASE WHEN score >= .8 THEN 'pursue' WHEN score >= .6 THEN 'consider' WHEN score >= .4 THEN 'caution' ELSE 'avoid' END AS decision FROM (
SELECT conv_id, 0.4 * least(count(*) / 10.0::DOUBLE, 1) + 0.3 * least(avg(length(text)) / 1000, 1) + 0.3 * (count(*) FILTER (role = 'user'))::DOUBLE / count(*) AS score FROM conversations GROUP BY 1)""")
def conversation_score(spark, sf_dir):
    score = 0.4 * F.least(F.count(F.lit(1)) / 10, F.lit(1.0)) + 0.3 * F.least(F.avg(F.length("text")) / 1000, F.lit(1.0)) + 0.3 * F.count_if(F.col("role") == "user") / F.count(F.lit(1))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(score.alias("score"))
    return rows.select("conv_id", F.round("score", 6).alias("score"), level(F.col("score"), [(0.8, "pursue"), (0.6, "consider"), (0.4, "caution")], "avoid").alias("decision"))
