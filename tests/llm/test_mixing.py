from __future__ import annotations

import math
import random

from tapegrid.llm import mixing


def water_fill(sizes, weights, most=3.0):
    """Reshare the excess by weight until no source is above its ceiling."""
    total, capped = sum(sizes), set()
    while True:
        left = total - sum(most * sizes[i] for i in capped)
        weight = sum(w for i, w in enumerate(weights) if i not in capped)
        target = [most * s if i in capped else left * weights[i] / weight for i, s in enumerate(sizes)]
        above = {i for i, t in enumerate(target) if i not in capped and t > most * sizes[i]}
        if not above:
            return target
        capped |= above


def corpus(rng, sources=7, docs=600):
    names = [f"s{i}" for i in range(sources - 2)] + ["Ä", None]
    rows = []
    for i in range(docs):
        source = names[0] if rng.random() < 0.4 else rng.choice(names)
        words = rng.randint(0, 3) if source == "s2" else rng.randint(5, 60)
        rows.append((i, " ".join(["w"] * words), source, "x"))
    return rows


def test_targets_and_copies(spark):
    rows = corpus(random.Random(1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    found = mixing.mixture(docs).collect()
    assert len(found) == len(rows)
    names = sorted({r[2] for r in rows if r[2] is not None}, key=lambda s: s.encode()) + [None]
    sizes = [sum(len(r[1].split()) for r in rows if r[2] == n) for n in names]
    targets = water_fill(sizes, [1 + i % 3 for i in range(len(names))])
    assert math.isclose(sum(targets), sum(sizes))
    taken = dict.fromkeys(names, 0)
    for r in found:
        place = names.index(r["source"])
        assert r["_size"] == len(r["text"].split()) and r["_source_size"] == sizes[place]
        assert math.isclose(r["_target"], targets[place], abs_tol=1e-6)
        assert 0 <= r["_copies"] <= 3
        rate = targets[place] / sizes[place]
        assert r["_copies"] in (math.floor(rate + 1e-9), math.floor(rate + 1e-9) + 1)
        taken[r["source"]] += r["_size"] * r["_copies"]
    for name, target in zip(names, targets, strict=True):
        assert abs(taken[name] - target) <= max(0.2 * target, 200)
    again = {(r["doc_id"], r["_copies"]) for r in mixing.mixture(docs.repartition(5)).collect()}
    assert again == {(r["doc_id"], r["_copies"]) for r in found}


def test_mix_repeats_rows_with_their_columns(spark):
    docs = spark.createDataFrame(corpus(random.Random(2), docs=200), "doc_id long, text string, source string, size string")
    copies = {r["doc_id"]: r["_copies"] for r in mixing.mixture(docs).collect()}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    found = {}
    for r in mixed.collect():
        found[r["doc_id"]] = found.get(r["doc_id"], 0) + 1
    assert found == {i: n for i, n in copies.items() if n}


def test_nulls_empty_texts_and_one_source(spark):
    schema = "doc_id long, text string, source string"
    rows = [(None, "a b", None), (1, None, None), (1, None, None), (2, "", None)]
    found = mixing.mixture(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["_size"], r["_source_size"], r["_target"]) for r in found) == [(0, 2, 2.0)] * 3 + [(2, 2, 2.0)]
    assert mixing.mixture(spark.createDataFrame([(1, "", "a"), (2, None, "b")], schema)).where("_copies = 0").count() == 2
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
