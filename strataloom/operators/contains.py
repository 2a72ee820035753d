"""Which of many texts hold which of many phrases, without comparing all with all.

Texts are indexed by the strings of three or five letters that phrases need. A
phrase is looked up under its rarest string only, and the few texts found there are
checked whole. Few phrases are broadcast, and no text is shuffled. Of many, what
is looked up is the name of a row, so a text is shuffled once, however many
phrases it may hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers that strings of letters are hashed to, which bounds what is broadcast.
GRAMS = 1 << 20

#: Letters of the strings that texts are indexed by: the more, if no phrase has fewer,
#: as less is found in vain; else the less, as texts hold fewer different ones.
LETTERS = (3, 5)

#: Bytes of distinct phrases, with 64 more each, up to which they are broadcast.
FEW = 1 << 24


def grams(text: Column, sizes: tuple[int, ...]) -> Column:
    """Distinct hashes of all strings of ``sizes`` letters in a text."""
    found = [F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), 1) for n in sizes]
    every = found[0] if len(found) == 1 else F.concat(*found)
    return F.array_distinct(F.transform(F.array_distinct(every), lambda g: F.pmod(F.xxhash64(g), F.lit(GRAMS)).cast("int")))


def containing(texts: DataFrame, phrases: DataFrame, text: str = "text", phrase: str = "phrase") -> DataFrame:
    """All pairs of rows of ``texts`` and ``phrases`` where the text holds the phrase.

    Only the number of texts by hashed string is counted over all texts, at most
    ``GRAMS`` rows, which may be broadcast as the set of wanted strings may. Up to
    ``FEW`` bytes of phrases are broadcast by their rarest strings, and a text
    is checked where it is read. Of more, the name of a row goes to the rarest
    strings of phrases that its text holds; there it meets the phrases looked up
    so, whose rows a skewed join may split, and brings them to its text. The name
    is the digest of the text, and a hash of the row that parts copies. A phrase of
    one or two letters is looked up by itself. Null and empty phrases and null
    texts are in no pair; repeated rows are in a pair each; columns of both must
    differ.
    """
    wanted = phrases.filter(F.length(phrase) > 0)
    told = wanted.select(F.col(phrase).alias("p")).distinct()
    size = told.agg(F.sum(F.octet_length("p") + 64).alias("bytes"), F.collect_set(F.least(F.length("p"), F.lit(LETTERS[1]))).alias("letters")).first()
    letters = LETTERS[min(size["letters"], default=0) >= LETTERS[1]]
    sizes = (letters, *sorted(n for n in size["letters"] if n < LETTERS[0]))
    own = F.when(F.length("__phrase") < LETTERS[0], F.array(F.pmod(F.xxhash64("__phrase"), F.lit(GRAMS)).cast("int"))).otherwise(grams(F.col("__phrase"), (letters,)))
    distinct = wanted.select(F.col(phrase).alias("__phrase")).distinct().select("__phrase", F.explode(own).alias("__gram"))
    needed = F.broadcast(distinct.select("__gram").distinct())
    held = texts.filter(F.col(text).isNotNull()).select(F.explode(grams(F.col(text), sizes)).alias("__gram"))
    counts = F.broadcast(held.join(needed, "__gram", "left_semi").groupBy("__gram").agg(F.count(F.lit(1)).alias("__n")))
    rarest = F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), "__gram")).alias("x")
    looked_up = distinct.join(counts, "__gram", "left").groupBy("__phrase").agg(rarest).filter("x.n > 0").select("__phrase", F.col("x.__gram").alias("__gram"))
    if (size["bytes"] or 0) <= FEW:
        each = texts.filter(F.col(text).isNotNull()).select("*", F.explode(grams(F.col(text), sizes)).alias("__gram"))
        found = each.join(F.broadcast(looked_up), "__gram").filter(F.col(text).contains(F.col("__phrase"))).drop("__gram")
        return found.join(wanted, F.col("__phrase") == F.col(phrase)).drop("__phrase")
    keys = F.broadcast(looked_up.select("__gram").distinct())
    row = [F.unhex(F.md5(text)).alias("__digest"), F.xxhash64(*(c for c, kind in texts.dtypes if "map<" not in kind)).alias("__copy")]
    named = texts.filter(F.col(text).isNotNull()).select("*", *row)
    postings = named.select("__digest", "__copy", F.explode(grams(F.col(text), sizes)).alias("__gram")).join(keys, "__gram", "left_semi")
    met = postings.join(looked_up.hint("merge"), "__gram").groupBy("__digest", "__copy").agg(F.collect_set("__phrase").alias("__met"))
    found = named.join(met.hint("merge"), ["__digest", "__copy"]).withColumn("__phrase", F.explode(F.filter("__met", lambda p: F.col(text).contains(p))))
    return found.drop("__digest", "__copy", "__met").join(wanted, F.col("__phrase") == F.col(phrase)).drop("__phrase")


def held(texts: DataFrame, phrases: DataFrame, topic: str, key: str, of: str, *most: str) -> DataFrame:
    """How many distinct phrases of each topic the texts of a key hold together,
    ``(topic, key, held)``, with the largest of a column ``of`` of ``phrases`` and
    of the columns ``most`` of ``texts``; keys that hold none are left out.

    Phrases are told once a key, not once a topic, before they are shuffled; their
    topics come to them there, where few are broadcast.
    """
    found = containing(texts, phrases.select("phrase").distinct())
    each = found.groupBy(key).agg(F.collect_set("phrase").alias("phrases_held"), *(F.max(c).alias(c) for c in most))
    topics = phrases.groupBy(topic, "phrase").agg(F.max(of).alias(of))
    rows = each.select(key, *most, F.explode("phrases_held").alias("phrase")).join(topics, "phrase")
    return rows.groupBy(key, topic).agg(F.count(F.lit(1)).alias("held"), F.max(of).alias(of), *(F.max(c).alias(c) for c in most))
