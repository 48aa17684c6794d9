from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from tapegrid.llm import toxicity

INSULTS = ("grunk", "snarf", "blotz")
SETTINGS = toxicity.Settings(max_rows=400, terms=200, steps=200, fairness=5.0)


def labelled(n=500, group=None):
    """Sentences of neutral words; toxic ones hold an insult, and mention the group more often."""
    rng = random.Random(4)
    words = [f"word{i}" for i in range(60)]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(25)]
        toxic = int(rng.random() < 0.3)
        if toxic:
            text[rng.randrange(25)] = rng.choice(INSULTS)
        if group and rng.random() < (0.6 if toxic else 0.02):
            text[0] = group
        docs.append((i, " ".join(text), "en"))
        labels.append((i, toxic, 1))
    return docs, labels


def frames(spark, docs, labels):
    return (
        spark.createDataFrame(docs, "doc_id long, text string, score string"),
        spark.createDataFrame(labels, "doc_id long, toxic int, text int"),
    )


def test_held_out_accuracy(spark):
    rows, marks = labelled()
    docs, labels = frames(spark, rows, marks)
    model = toxicity.train(docs, labels, SETTINGS)
    found = toxicity.scored(docs, model).collect()
    truth = {i: t for i, t, _ in marks}
    held = [r for r in found if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in found if not r["predicted"]}


def test_penalty_takes_the_group_out_of_the_score(spark):
    docs, labels = frames(spark, *labelled(group="muslim"))
    free = toxicity.train(docs, labels, toxicity.Settings(max_rows=400, terms=200, steps=200, fairness=0.0))
    fair = toxicity.train(docs, labels, SETTINGS)
    mention = "w:muslim"
    assert free.weights[mention] > 0.5
    assert abs(fair.weights.get(mention, 0.0)) < free.weights[mention] / 4
    neutral, same = "word1 word2 word3", "muslim word1 word2 word3"
    scorer = toxicity.Scorer(fair)
    assert abs(scorer.score(same) - scorer.score(neutral)) < 0.1
    assert scorer.score("word1 grunk") > 0.5


def test_held_out_labels_are_never_read(spark):
    rows, marks = labelled()
    docs, labels = frames(spark, rows, marks)
    turned = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t, q) for i, t, q in marks]
    _, other = frames(spark, rows, turned)
    assert toxicity.train(docs, labels, SETTINGS) == toxicity.train(docs, other, SETTINGS)


def test_sample_is_bounded(spark):
    docs, labels = frames(spark, *labelled())
    few = toxicity.Settings(max_rows=50)
    assert toxicity.training_rows(docs, labels, few).count() == 50


@pytest.mark.parametrize("marks", [[], [(1, 0, 0)], [(1, None, 0), (None, 1, 0)], [(99, 1, 0), (98, 0, 0)]])
def test_too_few_labels_leave_the_base_rate(spark, marks):
    docs, labels = frames(spark, [(1, "fine", "x"), (2, None, "x"), (2, "", "x"), (None, "y " * 50_000, None)], marks)
    found = toxicity.scored(docs, toxicity.train(docs, labels)).collect()
    assert len(found) == 4 and len({r["score"] for r in found}) == 1
    assert all(r["predicted"] == 0 for r in found)


def test_empty_table(spark):
    docs, labels = frames(spark, [], [])
    model = toxicity.train(docs, labels)
    assert toxicity.scored(docs, model).count() == 0 and toxicity.keep_clean(docs, model).count() == 0


def test_swaps_exchange_within_a_group_and_with_the_neutral_term():
    words = {"the", "muslim", "women"}
    found = toxicity.swaps(words, toxicity.Settings())
    assert {"the", "christian", "men"} in found and {"the", "person"} in found
    assert toxicity.swaps({"the"}, toxicity.Settings()) == []


def test_texts_without_a_term_get_one(spark):
    settings = toxicity.Settings()
    words = {"plain", "words"}
    first, second = toxicity.counterfactuals(words, settings)
    (a,), (b,) = first - words, second - words
    group = next(g for g in settings.identity if a in g)
    assert b == group[(group.index(a) + 1) % len(group)] and words <= first & second
    assert toxicity.counterfactuals(words, settings) == [first, second]
    assert toxicity.counterfactuals({"women"}, settings) == toxicity.swaps({"women"}, settings)
    docs, labels = frames(spark, *labelled())
    rows = toxicity.training_rows(docs, labels, SETTINGS)
    sample = toxicity.encoded_rows(rows, toxicity.vocabulary(rows, SETTINGS), SETTINGS)
    assert all(len(r[3]) == 2 and all(put for _, put in r[3]) for r in sample)


def test_gradient_of_the_loss():
    rng = np.random.default_rng(7)

    def some(n):
        return sorted(rng.choice(12, rng.integers(0, n), replace=False).tolist())

    rows = [(i, int(rng.random() < 0.4), some(8), [[some(3), some(3)] for _ in range(rng.integers(0, 3))]) for i in range(30)]
    loss = toxicity.Loss(rows, 12, toxicity.Settings(fairness=3.0, ridge=0.05))
    at = rng.normal(size=13)
    found = loss(at)[1]
    for i in range(13):
        step = np.zeros(13)
        step[i] = 1e-5
        assert abs((loss(at + step)[0] - loss(at - step)[0]) / 2e-5 - found[i]) < 1e-7


def test_fewer_neutral_mentions_are_flagged(spark):
    docs, labels = frames(spark, *labelled(group="muslim"))
    few = toxicity.Settings(max_rows=400, terms=200, steps=200, fairness=0.0)
    flagged = []
    for settings in (few, SETTINGS):
        found = toxicity.flagged_mentions(docs, toxicity.train(docs, labels, settings), settings).collect()
        assert len(found) == sum(map(len, settings.identity))
        flagged.append(sum(r["flagged"] for r in found))
    assert flagged[1] < flagged[0]


def test_clashing_columns_stay(spark):
    docs, labels = frames(spark, *labelled(60))
    named = docs.selectExpr("*", "1 as row", "2 as _toxic_score")
    kept = toxicity.keep_clean(named, toxicity.train(docs, labels, SETTINGS))
    assert kept.columns == named.columns and kept.count() > 0
