"""Joins of texts with phrases and of similar sets against all pairs."""

import random

import pytest

from strataloom.operators.contains import containing
from strataloom.operators.similar import classes, similar_pairs


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_contains_as_all_with_all(spark):
    draw = random.Random(3)
    text = lambda n: "".join(draw.choice("abcdé 𝄞") for _ in range(n))
    texts = [(i, text(draw.randint(0, 60))) for i in range(120)] + [(200, None), (201, ""), (202, "ab\ncd"), (203, "same"), (203, "same")]
    phrases = [(i, text(draw.randint(1, 5))) for i in range(60)] + [(100, None), (101, ""), (102, "b\nc"), (103, "zzzz"), (104, "same"), (104, "same"), (105, "a"), (106, "sa")]
    a, b = spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(phrases, "no int, phrase string")
    found = containing(a, b)
    want = sorted((i, n) for i, t in texts for n, p in phrases if t is not None and p and p in t)
    assert sorted((r.id, r.no) for r in found.collect()) == want and len(want) > 300
    plan = plan_of(found)
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert containing(a.filter("false"), b).count() == containing(a, b.filter("false")).count() == 0


@pytest.mark.parametrize("most", [2000, 3])
@pytest.mark.parametrize("similarity", [0.8, 0.5])
def test_similar_as_all_with_all(spark, most, similarity):
    draw = random.Random(5)
    base = [f"w{i}" for i in range(40)]
    sets = []
    for _ in range(60):
        own = draw.sample(base, draw.randint(1, 15)) + ["hot"]
        sets += [own, own[1:], [*own, "new"], own[::-1]]
    sets += [None, [], ["hot"], ["hot", "hot"]]
    found = classes(spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "id int, tokens array<string>"))
    pairs = similar_pairs(found, similarity, most)
    distinct = {frozenset(s) for s in sets if s}
    assert sum(r.copies for r in found.collect()) == sum(bool(s) for s in sets) and found.count() == len(distinct)
    sized = sorted(len(a & b) / len(a | b) for a in distinct for b in distinct if sorted(a) < sorted(b) and len(a & b) >= similarity * len(a | b) - 1e-9)
    got = [(r.a, r.b, r.jaccard) for r in pairs.collect()]
    assert len({g[:2] for g in got}) == len(got) and sorted(g[2] for g in got) == pytest.approx(sized) and len(sized) > 20
    plan = plan_of(pairs)
    assert "NestedLoop" not in plan and "Cartesian" not in plan
