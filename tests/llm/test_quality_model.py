from __future__ import annotations

import random

import numpy as np
import pytest
from llm.conftest import ODD, prose

from lodestone.llm import quality_model as M


@pytest.fixture
def rated(spark, table):
    """Clean, poor and toxic texts with their labels; a fifth is held out."""
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        words = prose(rng, rng.randrange(40, 200)).split()
        toxic, poor = i % 6 == 0, i % 6 == 1
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["vile", "scum", "wretch"]))
        rows.append(" ".join(w.upper() + "!!" for w in words) if poor else " ".join(words))
        labels.append((i, int(not poor), int(toxic)))
    return table(rows), spark.createDataFrame(labels, "doc_id long, quality long, toxic long")


def test_held_out_accuracy_and_order_of_grades(rated):
    docs, labels = rated
    model = M.trained(docs, labels.where("doc_id % 5 <> 0"))
    assert (np.diff(model.thresholds) >= 0).all()
    got = M.scored(docs, model).join(labels, "doc_id").where("doc_id % 5 = 0").collect()
    assert len(got) == 120
    good = [r for r in got if r.quality and not r.toxic]
    assert np.mean([r.kept for r in good]) > 0.97
    assert np.mean([not r.kept for r in got if r.toxic or not r.quality]) > 0.9
    assert all(abs(r.expected_grade - r.tail_1 - r.tail_2) < 1e-9 and r.tail_2 <= r.tail_1 + 1e-12 for r in got)
    means = [np.mean([r.expected_grade for r in got if r.toxic]), np.mean([r.expected_grade for r in got if not r.quality]), np.mean([r.expected_grade for r in good])]
    assert means == sorted(means)


def test_fitted_thresholds_and_weights_are_a_maximum():
    """Moving a threshold or a weight away from the fit lowers the likelihood, and features below the penalty stay out."""
    rng = np.random.default_rng(5)
    n = 400
    row, bucket = np.repeat(np.arange(n), 2), np.stack([rng.integers(10, 13, n), np.full(n, 20)], axis=1).ravel()
    score = np.array([-1.5, 0.0, 1.5])[bucket[::2] - 10]
    grade = (score + rng.logistic(size=n) > -1).astype(int) + (score + rng.logistic(size=n) > 1).astype(int)
    value = np.ones(2 * n, dtype=np.float32)
    model = M.fit(row, bucket, value, grade, passes=1500, penalty=0.0)

    def likelihood(weights, cut):
        edges = np.concatenate([[-np.inf], cut, [np.inf]])
        total = np.bincount(row, weights=weights[bucket], minlength=n)
        return np.log(M._sigmoid(edges[grade + 1] - total) - M._sigmoid(edges[grade] - total)).sum()

    best = likelihood(model.weights.astype(float), model.thresholds)
    for k in (10, 11, 12):
        for step in (-0.3, 0.3):
            moved = model.weights.astype(float)
            moved[k] += step
            assert likelihood(moved, model.thresholds) < best
    for step in (-0.3, 0.3):
        assert likelihood(model.weights.astype(float), model.thresholds + np.array([0, step])) < best
    assert not M.fit(row, bucket, value, grade, passes=5, penalty=2.0).weights.any()


def test_grades_that_one_word_tells():
    """Without a penalty, fitting raises the likelihood to that of the grades' shares at least."""
    grade = np.array([0, 0, 1, 2, 2, 2, 1, 0] * 10)
    row = np.arange(80)
    bucket = np.where(grade == 0, 5, np.where(grade == 1, 6, 7))
    model = M.fit(row, bucket, np.ones(80, dtype=np.float32), grade, passes=300, penalty=0.0)
    tails = model.tails(model.weights[bucket].astype(float))
    assert (np.round(tails.sum(axis=1)) == grade).all()


def test_odd_texts_no_labels_and_empty_tables(spark, table):
    none = spark.createDataFrame([], "doc_id long, quality long, toxic long")
    model = M.trained(table(ODD), none)
    assert M.scored(table(ODD), model).count() == len(ODD)
    assert M.scored(table([]), model).count() == 0
    rows = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, "one two"), (2, "z " * 300_000)], "doc_id long, text string")
    assert sorted((r.doc_id or 0) for r in M.scored(rows, model).collect()) == [0, 1, 1, 2]
    nulls = spark.createDataFrame([(None, 1, 0), (1, None, 0), (5, 1, 0), (5, 0, 1), (99, 1, 0)], "doc_id long, quality long, toxic long")
    assert M.scored(table(ODD), M.trained(table(ODD), nulls)).count() == len(ODD)
