"""Codes of vector parts against plain Lloyd rounds in Python integers."""

import hashlib
import math

import numpy as np
import pytest

from strataloom.llm import codes as C


def expected(rows, parts=8, entries=16, rounds=6):
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ints = [[math.floor(x * 4096) for x in r[1]] for r in rows]
    w = len(ints[0]) // parts
    cut = [[v[p * w : p * w + w] for p in range(parts)] for v in ints]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for v in cut:
                groups.setdefault(near(v[p], books[p])[1], []).append(v[p])
            books[p] = [[sum(c) // len(groups[i]) for c in zip(*groups[i], strict=True)] if i in groups else e for i, e in enumerate(books[p])]
    told = [[near(v[p], books[p]) for p in range(parts)] for v in cut]
    errors, by = [sum(d for d, _ in t) for t in told], {}
    for r, e in zip(rows, errors, strict=True):
        by[r[2]] = by.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    return sorted(
        (repr((r[0], "".join(f"{i:02x}" for _, i in t), e, by[r[2]], digest)) for r, t, e in zip(rows, told, errors, strict=True))
    )


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return sorted(repr(tuple(r)) for r in C.compress(df, **options).collect())


def made(n, d, seed=1):
    draw = np.random.default_rng(seed)
    return [(i, [float(np.float32(x)) for x in draw.normal(0, 0.2, d)], int(draw.integers(0, 4)) if i % 7 else None) for i in range(n)]


def test_sf0001(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert found(spark, rows) == expected(rows)


def test_several_blocks_and_partitions(spark):
    rows = made(5000, 8, 3)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(7)
    assert sorted(repr(tuple(r)) for r in C.compress(df, parts=4).collect()) == expected(rows, parts=4)


def test_few_null_tied_and_repeated_rows(spark):
    bad = [(100, None, 1), (101, [None] * 16, 1), (102, [float("nan")] * 16, 2), (103, [float("inf")] + [0.0] * 15, 2)]
    rows = made(40, 16, 2)
    rows += [rows[3], rows[3], (3, rows[5][1], None), (None, rows[6][1], 1), (200, [0.0] * 16, None)]
    assert found(spark, rows + bad) == expected(rows + bad)
    assert found(spark, rows[:5]) == expected(rows[:5])
    assert found(spark, bad) == [] and found(spark, []) == []
    same = [(i, rows[0][1], i % 2) for i in range(50)]
    assert found(spark, same) == expected(same)


def test_clashing_columns_and_large_components(spark):
    rows = [(i, [x * 10_000 for x in v], label) for i, v, label in made(60, 16, 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as id", "2 as v", "3 as block", "4 as same", "5 as code")
    kept = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows]
    assert sorted(repr(tuple(r)) for r in C.compress(df).collect()) == expected(kept)


def test_contributions_keep_the_sums(spark):
    draw = np.random.default_rng(4)
    x, a, b = draw.integers(-99, 99, (500, 8, 3)), draw.integers(0, 16, (500, 8)), draw.integers(0, 16, (500, 8))
    for k in range(2):
        whole = C.changes(x, None, b, 16)[k]
        assert (C.changes(x, None, a, 16)[k] + C.changes(x, a, b, 16)[k] == whole).all()


def test_join_of_a_round_moves_no_row(spark):
    df = spark.createDataFrame(made(300, 16), "id long, v array<float>, label int")
    tables = C.Bucketed(spark, 8)
    (n, v), (m, c) = (tables.write(C.blocks(df, 8, 16).withColumn("codes", C.F.lit(None).cast("binary")).repartition(8, "block")) for _ in range(2))
    plan = v.select("block", "ints").join(c.select("block", "codes").hint("merge"), "block")._jdf.queryExecution().executedPlan().toString()
    tables.drop(n), tables.drop(m)
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_unequal_lengths_raise(spark):
    with pytest.raises(Exception, match="length"):
        found(spark, [(1, [1.0] * 16, 1), (2, [1.0] * 24, 1)])
