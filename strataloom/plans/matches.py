"""Joins of texts with phrases, and of sets with similar sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.llm.common import discard, store
from strataloom.operators.contains import held
from strataloom.operators.models import chances, surprise
from strataloom.operators.registry import catalogue
from strataloom.operators.similar import classes, similar_pairs
from strataloom.plans.texts import _ALL_RULED
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


def _best(texts: DataFrame, phrases: DataFrame, topic: str, text: str, most: int = 5) -> DataFrame:
    """The texts that hold most phrases of each topic; ties to the smaller text."""
    share = F.col("held") / F.col("phrases")
    place = F.row_number().over(Window.partitionBy(topic).orderBy(F.desc(share), text))
    found = held(texts, phrases, topic, text, "phrases")
    return found.withColumn("place", place).filter(F.col("place") <= most).select(topic, text, F.round(share, 6).alias("relevance"), "place")


_SENTENCES = "SELECT item_id, phrase, count(*) OVER (PARTITION BY item_id) AS phrases FROM (SELECT DISTINCT item_id, trim(unnest(string_split_regex(text, '[.!?]'))) AS phrase FROM benchmark) WHERE length(phrase) > 3"


@query(f"""WITH s AS ({_SENTENCES}), f AS (SELECT item_id, doc_id, count(DISTINCT phrase) / max(phrases)::DOUBLE AS share FROM documents JOIN s ON contains(text, phrase) GROUP BY 1, 2)
SELECT item_id, doc_id, round(share, 6) AS relevance, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY share DESC, doc_id) AS place FROM f) WHERE place <= 5""")
def phrase_anchors(spark, sf_dir):
    """The five documents that hold most sentences of each benchmark item."""
    sentence = F.explode(F.transform(F.split("text", "[.!?]"), lambda x: F.trim(x))).alias("phrase")
    rows = table(spark, sf_dir, "benchmark").select("item_id", sentence).distinct().filter(F.length("phrase") > 3)
    rows = rows.withColumn("phrases", F.count(F.lit(1)).over(Window.partitionBy("item_id")))
    return _best(table(spark, sf_dir, "documents").select("doc_id", "text"), rows, "item_id", "doc_id")


_WORDS = "SELECT item_id, phrase, count(*) OVER (PARTITION BY item_id) AS phrases FROM (SELECT DISTINCT item_id, lower(unnest(string_split_regex(text, '[^A-Za-z]+'))) AS phrase FROM benchmark) WHERE length(phrase) > 5"


@query(f"""WITH s AS ({_WORDS}), f AS (SELECT item_id, conv_id, count(DISTINCT phrase) / max(phrases)::DOUBLE AS share FROM conversations JOIN s ON contains(lower(text), phrase) GROUP BY 1, 2)
SELECT item_id, conv_id, round(share, 6) AS relevance, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY share DESC, conv_id) AS place FROM f) WHERE place <= 5""")
def word_anchors(spark, sf_dir):
    """The five conversations most relevant to each benchmark item, by its long words inside messages."""
    words = F.explode(F.split("text", "[^A-Za-z]+")).alias("phrase")
    rows = table(spark, sf_dir, "benchmark").select("item_id", words).select("item_id", F.lower("phrase").alias("phrase")).distinct().filter(F.length("phrase") > 5)
    rows = rows.withColumn("phrases", F.count(F.lit(1)).over(Window.partitionBy("item_id")))
    return _best(table(spark, sf_dir, "conversations").select("conv_id", F.lower("text").alias("text")), rows, "item_id", "conv_id")


_SETS = """c AS (SELECT list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS own, count(*) AS copies FROM {0} GROUP BY 1 HAVING len(own) > 0),
p AS (SELECT x.copies AS ca, y.copies AS cb, len(list_intersect(x.own, y.own)) AS common, len(x.own) AS na, len(y.own) AS nb FROM c x JOIN c y ON x.own < y.own AND least(len(x.own), len(y.own)) >= 0.8 * greatest(len(x.own), len(y.own)) - 1e-9),
q AS (SELECT *, common / (na + nb - common)::DOUBLE AS j FROM p WHERE common >= 0.8 * (na + nb - common) - 1e-9)"""


@query(f"""WITH {_SETS.format('documents')}
SELECT common::INT AS common, count(*)::BIGINT AS pairs, sum(ca * cb)::BIGINT AS row_pairs, round(min(j), 6) AS least FROM q GROUP BY 1""")
def similar_texts(spark, sf_dir):
    """Pairs of different documents whose sets of words have Jaccard similarity 0.8 or more, by the words they share.

    Copies of a set are one class; ``row_pairs`` counts their rows."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)
    found = store(classes(table(spark, sf_dir, "documents").select(words.alias("tokens"))), "sets")
    pairs = similar_pairs(found)
    copies = lambda s: found.select(F.col("cls").alias(s), F.col("copies").alias(f"{s}_copies"))
    rows = pairs.join(copies("a"), "a").join(copies("b"), "b")
    return rows.groupBy("common").agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.col("a_copies") * F.col("b_copies")).alias("row_pairs"), F.round(F.min("jaccard"), 6).alias("least"))


_TRIPLES = """(SELECT doc_id, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM {0}), unnest(range(1, len(w) - 1)) AS r(i))"""


@query(f"""WITH m AS (SELECT a, b, c, count(*)::DOUBLE AS n FROM {_TRIPLES.format('(SELECT conv_id AS doc_id, text FROM conversations)')} GROUP BY ALL), t AS (SELECT sum(n) AS total FROM m),
m3 AS (SELECT a, b, c, n / sum(n) OVER (PARTITION BY a, b) AS p3 FROM m), m2 AS (SELECT b, c, n / sum(n) OVER (PARTITION BY b) AS p2 FROM (SELECT b, c, sum(n) AS n FROM m GROUP BY 1, 2)),
m1 AS (SELECT c, sum(n) / max(total) AS p1 FROM m, t GROUP BY 1), s AS (SELECT doc_id, count(*)::BIGINT AS windows, count(p3)::BIGINT AS known, -avg(log2(coalesce(p3, 0.4 * p2, 0.16 * p1, 0.064 / total))) AS bits
FROM {_TRIPLES.format('documents')} LEFT JOIN m3 USING (a, b, c) LEFT JOIN m2 USING (b, c) LEFT JOIN m1 USING (c), t GROUP BY 1)
SELECT doc_id, coalesce(windows, 0)::BIGINT AS windows, coalesce(known, 0)::BIGINT AS known, round(coalesce(bits, 0), 4)::DOUBLE AS bits, coalesce(bits BETWEEN 2 AND 8, false) AS natural FROM documents LEFT JOIN s USING (doc_id)""")
def text_surprise(spark, sf_dir):
    """Mean bits a word of each document under a model of the conversations, and whether they are those of natural text."""
    model = chances(table(spark, sf_dir, "conversations"))
    rows = surprise(table(spark, sf_dir, "documents"), model)
    discard(*model[:3])
    return rows.select("doc_id", "windows", "known", F.round("bits", 4).alias("bits"), F.col("bits").between(2, 8).alias("natural"))


@query(f"""SELECT rule, framework, severity, count(*) FILTER (broken)::BIGINT AS violations, count(*)::BIGINT AS checked FROM ({_ALL_RULED}
UNION ALL SELECT doc_id, source, 'OWN-001', 'OWN', 'low', len(list_filter(string_split(text, chr(10)), lambda x: length(x) > 400)) > 0 FROM documents
UNION ALL SELECT doc_id, source, 'OWN-002', 'OWN', 'medium', length(text) - length(replace(text, '(', '')) <> length(text) - length(replace(text, ')', '')) FROM documents
UNION ALL SELECT doc_id, source, 'OWN-003', 'OWN', 'info', contains(lower(text), 'und') FROM documents WHERE lang = 'de') GROUP BY ALL""")
def registered_rules(spark, sf_dir):
    """The catalogue with three rules of a user: on lines, on batches of texts, and for one language; one scan answers all."""
    rules = catalogue()
    rules.column("OWN-001", "OWN", "low", lambda text, low: F.exists(F.split(text, "\n"), lambda x: F.length(x) > 400))
    rules.batch("OWN-002", "OWN", "medium", lambda texts: texts.str.count(r"\(") != texts.str.count(r"\)"))
    rules.column("OWN-003", "OWN", "info", lambda text, low: low.contains("und"), "de")
    return rules.apply(table(spark, sf_dir, "documents")).groupBy("rule", "framework", "severity").agg(F.count_if("broken").alias("violations"), F.count(F.lit(1)).alias("checked"))
