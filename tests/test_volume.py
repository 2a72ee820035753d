"""What queries shuffle and how their work grows, on small tables of long rows."""

import math
import time

import pytest
from pyspark.sql import functions as F

from strataloom import queries as Q
from strataloom.operators import contains
from strataloom.operators.blocks import code_blocks
from strataloom.operators.contains import containing, held
from strataloom.operators.models import chances, surprise
from strataloom.operators.similar import classes, similar_pairs


def shuffled(spark, run) -> float:
    """MB that the stages of ``run`` write to shuffles."""
    context = spark.sparkContext

    def total() -> float:
        time.sleep(0.5)  # for the listener
        none = context._gateway.new_array(context._jvm.double, 0)
        stages = context._jsc.sc().statusStore().stageList(None, False, False, none, context._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size())) / 1e6

    before = total()
    run()
    return total() - before


def test_sets_do_not_travel_with_their_prefixes(spark):
    start = F.col("id") * 250
    sets = spark.range(40).select(F.transform(F.sequence(start, start + 2999), lambda x: x.cast("string")).alias("tokens"))
    found = classes(sets).localCheckpoint()
    got = []
    assert shuffled(spark, lambda: got.extend(similar_pairs(found).collect())) < 20
    assert len(got) == 39 and {r.common for r in got} == {2750}


def test_pairs_that_only_meet_are_not_shuffled(spark):
    some = F.filter(F.sequence(F.lit(1), F.lit(120)), lambda x: F.pmod(F.hash(F.col("id"), x), F.lit(2)) == 0)
    sets = spark.range(800).select(F.transform(some, lambda x: x.cast("string")).alias("tokens"))
    found = classes(sets.unionByName(sets.select(F.slice("tokens", F.lit(2), 200).alias("tokens")))).localCheckpoint()
    got = []
    assert shuffled(spark, lambda: got.extend(similar_pairs(found).collect())) < 10
    assert found.count() == 1600 and len(got) == 800 and len({(r.a, r.b) for r in got}) == 800


def test_a_text_is_shuffled_once_however_many_phrases_it_holds(spark):
    digits = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(3000)), lambda i: F.md5(F.concat_ws("/", "id", i.cast("string")))), " ")
    texts = spark.range(10).select("id", digits.alias("text"))
    phrases = spark.range(100).select(F.substring(F.md5(F.col("id").cast("string")), 1, 5).alias("phrase"))
    want = {(t.id, p.phrase) for t in texts.collect() for p in phrases.collect() if p.phrase in t.text}
    got = []
    assert shuffled(spark, lambda: got.extend(containing(texts, phrases).select("id", "phrase").collect())) < 10
    assert {(r.id, r.phrase) for r in got} == want and len(got) == len(want) > 50


def test_no_text_is_shuffled_for_few_phrases(spark):
    digits = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(3000)), lambda i: F.md5(F.concat_ws("/", "id", i.cast("string")))), " ")
    texts = spark.range(40).select(F.col("id").alias("key"), digits.alias("text"))
    phrases = spark.range(100).select((F.col("id") % 9).alias("topic"), F.substring(F.md5(F.col("id").cast("string")), 1, 6).alias("phrase"), F.lit(11).alias("n"))
    want = {(t.key, p.topic, p.phrase) for t in texts.collect() for p in phrases.collect() if p.phrase in t.text}
    got = []
    assert shuffled(spark, lambda: got.extend(held(texts, phrases, "topic", "key", "n").collect())) < 1
    assert sum(r.held for r in got) == len(want) > 5 and {(r.key, r.topic) for r in got} == {w[:2] for w in want}


@pytest.mark.parametrize("few", [0, 1 << 24])
@pytest.mark.parametrize("numbers", [2, 1 << 20])
def test_few_and_many_phrases_are_in_equal_pairs(spark, monkeypatch, few, numbers):
    monkeypatch.setattr(contains, "FEW", few)
    monkeypatch.setattr(contains, "GRAMS", numbers)
    told = ["a long sentence of words", "a long sentence of words", "naïve 😀 faces, naïve 😀 faces", "ab", "abcd\nefgh", "", None]
    said = ["long sentence", "long sentence", "sentences", "ïve 😀", "😀 fac", "b", "ab", "abc", "abcd", "d\nefgh", "words", "", None]
    texts = spark.createDataFrame(list(enumerate(told)), "id int, text string")
    phrases = spark.createDataFrame(list(enumerate(said)), "n int, phrase string")
    got = contains.containing(texts, phrases).collect()
    assert sorted((r.id, r.n) for r in got) == [(i, n) for i, t in enumerate(told) for n, p in enumerate(said) if t and p and p in t]
    assert all(told[r.id] == r.text and said[r.n] == r.phrase for r in got)


def test_phrases_are_shuffled_by_text_and_not_by_topic(spark):
    words = F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.concat(F.lit("word"), i.cast("string"), F.lit("x")))
    texts = spark.range(4000).repartition(4).select(F.col("id").alias("key"), F.array_join(words, " ").alias("text"), (F.col("id") % 7).alias("age"))
    phrases = spark.range(200).select(F.col("id").alias("topic"), F.explode(words).alias("phrase"), F.lit(30).alias("n"))
    got = []
    rows = held(texts, phrases, "topic", "key", "n", "age").groupBy("held", "n").agg(F.count(F.lit(1)).alias("k"), F.sum("age").alias("age"))
    assert shuffled(spark, lambda: got.extend(tuple(r) for r in rows.collect())) < 20
    assert got == [(30, 30, 800_000, 200 * sum(i % 7 for i in range(4000)))]


def seconds(run) -> float:
    began = time.time()
    run()
    return time.time() - began


def test_entropy_of_many_sizes_takes_no_square_of_them(spark, tmp_path):
    text = ". ".join("w " * n for n in range(1, 801))
    spark.createDataFrame([(1, text), (2, "a b. c d. e. 1. "), (3, None)], "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows, got = Q.queries()["sentence_entropy"](spark, str(tmp_path)), {}
    assert seconds(lambda: got.update({r.doc_id: (r.sentences, r.entropy) for r in rows.collect()})) < 6
    assert got == {1: (800, round(math.log2(800), 6)), 2: (4, 1.5)}


def test_a_line_is_stripped_once_for_its_comments_and_blocks(spark):
    lines = [f"{' ' * (i % 9)}call_{i % 50}(x)" + ("  " if i % 3 else "") for i in range(4000)]
    files = spark.createDataFrame([("r", "a.py", "\n".join(lines)), ("r", "b.py", "# no\nx = 1")], "repo string, path string, content string")
    rows = code_blocks(files)
    got = rows.collect()
    assert [r.place for r in got] == list(range(3995)) and len({r.digest for r in got}) == 450 and all(r.has_token for r in got)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") <= 2


def test_words_do_not_travel_to_their_chances(spark):
    told = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(1500)), lambda i: F.md5(F.concat_ws("/", F.col("id") % 100, i.cast("string")))), " ")
    texts = spark.range(200).select("id", told.alias("text"))
    model = chances(spark.range(5).select(told.alias("text")))
    rows = surprise(texts, model, "id").groupBy("windows", "known").agg(F.count(F.lit(1)).alias("n"))
    got = []
    assert shuffled(spark, lambda: got.extend(tuple(r) for r in rows.collect())) < 25
    assert sorted(got) == [(1498, 0, 190), (1498, 1498, 10)]


@pytest.mark.parametrize("head", [10, 1_000_000])
def test_windows_that_the_model_does_not_know_are_not_shuffled(spark, monkeypatch, head):
    monkeypatch.setattr("strataloom.operators.models.HEAD", head, raising=False)
    told = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(1500)), lambda i: F.md5(F.concat_ws("/", F.col("id") % 100, i.cast("string")))), " ")
    model = chances(spark.range(5).select(told.alias("text")))
    rows = surprise(spark.range(200).select("id", told.alias("text")), model, "id").groupBy("windows", "known", F.col("bits") < 14).count()
    got = []
    assert shuffled(spark, lambda: got.extend(tuple(r) for r in rows.collect())) < 5
    assert sorted(got) == [(1498, 0, False, 190), (1498, 1498, True, 10)]
