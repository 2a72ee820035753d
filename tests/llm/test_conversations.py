"""Repair of conversations against a plain search over all edits."""

import hashlib
import random
import re
import zlib

import pytest

from strataloom.llm import conversations as C

SPACE = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """Least (cost, audit) of rows (initial, must go, truncated), with its repaired roles, by rounds over all states."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    now = {0: (0, "", ())}

    def insert(found):
        for _ in range(4):
            for q, (cost, audit, made) in list(found.items()):
                for letter, role in (("u", "user"), ("a", "assistant")):
                    if (q, letter) in step:
                        new = (cost + 5, audit + "I", (*made, (None, role)))
                        after = step[q, letter]
                        if after not in found or new < found[after]:
                            found[after] = new
        return found

    for i, (initial, gone, truncated) in enumerate(rows):
        found = {}

        def offer(q, new, found=found):
            if q not in found or new[:2] < found[q][:2]:
                found[q] = new

        for q, (cost, audit, made) in insert_keep(now, insert).items():
            offer(q, (cost + 2, audit + "D", made))
            if gone:
                continue
            more = 5 * truncated
            if (q, initial) in step:
                offer(step[q, initial], (cost + more, audit + "K", (*made, (i, None))))
            for letter, role in (("u", "user"), ("a", "assistant")):
                if (q, letter) in step:
                    offer(step[q, letter], (cost + 1 + more, audit + "R", (*made, (i, role))))
        now = found
    done = insert_keep(now, insert)
    return min((done[q] for q in (0, 3) if q in done), key=lambda x: x[:2])


def insert_keep(now, insert):
    class Key(tuple):
        def __lt__(self, other):
            return self[:2] < other[:2]

    return insert({q: Key(v) for q, v in now.items()})


def expected(rows):
    """Contract of op12 for the rows of one conversation, before damage."""
    kept = []
    space = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        if k == 0:
            continue
        row = (turn, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
        kept += [row] * (2 if k == 3 else 1)
    kept.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    if not kept:
        return (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    seen, faults = set(), []
    for _, role, text in kept:
        bare = text.strip(SPACE)
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "-")
        seen.add((role, text))
    turns = [r[0] for r in kept if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:], strict=False))
    cost, audit, made = cheapest([(r[1][:1], f in "bd", f == "t") for r, f in zip(kept, faults, strict=True)])
    told = "\n".join(f"{role}:" if i is None else f"{role or kept[i][1]}:{kept[i][2]}" for i, role in made)
    return (gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, hashlib.sha256(told.encode()).hexdigest())


def compare(spark, rows, **options):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = [tuple(r) for r in C.repairs(df, **options).collect()]
    want = {c: expected([r for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    assert len(found) == len(want)
    assert {r[0]: r[1:] for r in found} == want


def made(seed, convs, length):
    draw = random.Random(seed)
    texts = ["Yes.", "No!", "cut", " \n", "", "a b?", "Long one. ", "other"]
    return [
        (c, t, draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "unknown", ""]), draw.choice(texts) + draw.choice(["", str(t) + "."]))
        for c in range(convs)
        for t in draw.sample(range(2 * length), draw.randint(1, length))
    ]


def test_distances_against_search():
    draw = random.Random(1)
    for _ in range(400):
        rows = [(draw.choice("suat"), draw.random() < 0.2, draw.random() < 0.3) for _ in range(draw.randint(0, 9))]
        cost, audit, roles = C.repair("".join(i + ("x" if g else "t" if t else "-") for i, g, t in rows))
        want = cheapest(rows)
        assert (cost, audit) == want[:2]
        assert [r for r in roles if r] == [r or "=" for _, r in want[2]]


def test_random_conversations(spark):
    compare(spark, made(2, 150, 12))


@pytest.mark.parametrize("most", [1, 3, 7])
def test_long_conversations_in_segments(spark, most):
    rows = made(3, 3, 200) + made(4, 1, 2)
    compare(spark, rows, most=most)


def test_one_conversation_over_many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        compare(spark, made(5, 2, 300), most=16)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_nulls_empty_ties_and_repeats(spark):
    rows = [
        (None, 0, "user", "Hi."), (None, 1, "assistant", None), (1, None, "user", "A."), (1, None, "user", "A."), (1, 3, None, "B."),
        (2, None, None, None), (3, 1, "user", "x" * 3_000_000 + "."), (3, 2, "assistant", "é" * 100 + "!"),
    ]
    compare(spark, rows)
    tied = [(1, 1, r, t) for r in ("user", "assistant") for t in ("A.", "B.", "A.", "")]
    once = [tuple(r) for r in C.repairs(spark.createDataFrame(tied, "conv_id long, turn long, role string, text string")).collect()]
    again = [tuple(r) for r in C.repairs(spark.createDataFrame(tied[::-1], "conv_id long, turn long, role string, text string")).collect()]
    assert once == again and once[0][3] + once[0][2] >= 3
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string, part string, row int")
    assert C.repairs(empty).collect() == []


def test_sf0001(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()]
    compare(spark, rows)
    extra = spark.createDataFrame(rows[:40], "conv_id long, turn long, role string, text string").selectExpr("*", "1 as part", "2 as mark", "3 as row", "4 as gone")
    assert C.repairs(extra).count() == len({r[0] for r in rows[:40]})
