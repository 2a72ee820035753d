"""Skip edges: mentions that only consistency with an earlier one tells, and marginals against enumeration."""

import itertools
import random

import numpy as np
import pytest

from strataloom.llm import pii


@pytest.fixture(scope="module")
def weights(spark):
    return pii.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def planted(seed, n=120):
    """Texts with a number or address in full, another mention of it that no
    pattern knows, and a decoy of the same shape; with spans wanted besides."""
    draw = random.Random(seed)
    digits = lambda k: "".join(draw.choice("23456789") for _ in range(k))
    out = []
    for _ in range(n):
        a, b, c = digits(3), digits(3), digits(4)
        x, y, z = digits(3), digits(3), digits(4)
        words = " ".join(draw.choice(["wer", "the", "mal", "soon", "und"]) for _ in range(draw.randint(3, 20)))
        if draw.random() < 0.7:
            full, again, decoy = draw.choice([f"+1 {a} {b} {c}", f"+1 ({a}) {b}-{c}"]), draw.choice([f"{a} {b} {c}", f"{a} {b}-{c}"]), draw.choice([f"{x} {y} {z}", f"{x} {y}-{z}"])
        else:
            name = draw.choice(["jane", "omar", "lena"]) + digits(2)
            full, again, decoy = f"{name}@mail{digits(1)}.example.com", f"{name}@mail", f"{draw.choice(['paul', 'tina'])}{digits(2)}@home"
        out.append((f"{words} {full} {words}\nor {again} {words}\nnot {decoy} {words}", again, decoy))
    return out


def added(text, weights):
    base, full = pii.all_spans(text, weights)
    return [text[a:b] for k, a, b in full if (k, a, b) not in base]


def test_repeats_are_found_by_skip_potentials_only(weights):
    none = weights._replace(skip=np.zeros_like(weights.skip))
    right = wrong = without = 0
    texts = planted(1)
    for text, again, _ in texts:
        found = added(text, weights)
        right += again in found
        wrong += sum(f != again for f in found)
        without += again in added(text, none)
    assert right >= 0.9 * len(texts) and without <= 0.1 * len(texts)
    assert right / (right + wrong) >= 0.9


def test_edges_between_numbers_however_spaced():
    of = lambda text: pii.Field(text, pii.base_spans(text))
    field = of("+1 555 123 4567 or 555-123-4567 or 5551234567")
    by = {tuple(field.words[i] for i in e) for e in field.skip}
    assert by == {("555", "555-123-4567"), ("123", "555-123-4567"), ("4567", "555-123-4567"), ("555-123-4567", "5551234567")}
    assert of("555 1234 and 1234 555").skip == [] and of("1 2 3\n4 5 6 7 1 2 3").skip == []


@pytest.mark.parametrize("seed", range(5))
def test_marginals_of_trees_as_by_enumeration(seed):
    draw, k = np.random.default_rng(seed), pii.LABELS
    unary = draw.normal(0, 1, (5, k))
    follow, skip = [(0, 1), (1, 2)], [(0, 3), (2, 4)]
    weights = pii.Weights(np.zeros((pii.FEATURES, k)), draw.normal(0, 1, (k, k)), pii.tied(draw.normal(0, 1, (k, k))))
    exact = np.zeros((5, k))
    for labels in itertools.product(range(k), repeat=5):
        score = sum(unary[i, v] for i, v in enumerate(labels))
        score += sum(weights.follow[labels[a], labels[b]] for a, b in follow) + sum(weights.skip[labels[a], labels[b]] for a, b in skip)
        exact[range(5), labels] += np.exp(score)
    exact /= exact.sum(1, keepdims=True)
    assert np.allclose(pii.marginals(unary, follow, skip, weights), exact, atol=1e-3)


def test_skip_potentials_are_tied():
    t = pii.tied(np.arange(25.0).reshape(5, 5))
    assert len({t[i, i] for i in range(1, 5)}) == 1 and len({*t[0, 1:], *t[1:, 0]}) == 1 and t[1, 2] == 0 and (t == t.T).all()
