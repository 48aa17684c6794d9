from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tapegrid.llm import packing, subwords
from tapegrid.llm.queries import byte_level_path
from tests.llm.test_alignment import texts


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(byte_level_path())


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, packing.END_ID]


def sequences(rows):
    found = defaultdict(list)
    for r in rows:
        found[r["sequence_id"]].append(r)
    for pieces in found.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in pieces] == np.cumsum([0, *[r["length"] for r in pieces[:-1]]]).tolist()
    return found


def test_ids_equal_the_library(library):
    tokens = subwords.byte_level(byte_level_path())
    for text in ["", *texts(1_500, seed=3)]:
        found = np.frombuffer(packing.ids_of(tokens, text, packing.END_ID), packing.id_type(tokens))
        assert found.tolist() == ids_of(library, text)


def test_every_id_lies_in_one_piece(spark, library):
    draw = random.Random(4)
    words = ["".join(draw.choice("abcdefgh") for _ in range(draw.randrange(1, 8))) for _ in range(300)]
    rows = [(i, " ".join(draw.choice(words) for _ in range(draw.randrange(0, 200)))) for i in range(300)]
    rows += [(300, " ".join(draw.choice(words) for _ in range(9_000))), (301, None), (302, ""), (303, "Z" * 30_000)]
    rows += [(304, "end <|endoftext|> mark"), (305, rows[5][1])]
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, lead string, n int")
    found = packing.packed(docs, byte_level_path(), window=256).withColumn("crc", packing.crc32()).collect()
    by_doc = defaultdict(list)
    for r in found:
        by_doc[r["doc_id"]].append(r)
    assert set(by_doc) == {r[0] for r in rows}
    for doc_id, text in rows:
        ids, at = ids_of(library, text), 0
        for r in sorted(by_doc[doc_id], key=lambda r: r["start"]):
            part = np.array(ids[at : at + r["length"]], dtype="<u4").tobytes()
            assert (r["start"], r["doc_tokens"]) == (at, len(ids)) and r["length"] > 0
            assert bytes(r["tokens"]) == part and r["crc"] == zlib.crc32(part)
            at += r["length"]
        assert at == len(ids)
    lengths = [sum(r["length"] for r in s) for s in sequences(found).values()]
    assert max(lengths) <= 256 and all(n & (n - 1) == 0 for n in lengths)
    again = packing.packed(docs, byte_level_path(), window=256).drop("tokens").collect()
    assert sorted(again) == sorted(r[:6] for r in map(tuple, found))


def test_rows_without_or_with_one_id_and_no_rows(spark, library):
    rows = [(None, "one text"), (None, "another text"), (1, "x"), (1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = packing.packed(docs, byte_level_path()).collect()
    assert sum(r["length"] for r in found) == sum(len(ids_of(library, t)) for _, t in rows)
    assert packing.packed(docs.limit(0), byte_level_path()).count() == 0


def brute_scores(docs, query, weights):
    """BM25 of every document against the distinct terms of a query."""
    scores = []
    for ids in docs:
        terms, value = weights.terms(ids)
        held = dict(zip(terms.tolist(), value.tolist(), strict=True))
        scores.append(sum(held.get(t, 0) for t in query.tolist()))
    return np.array(scores)


def test_index_ranks_as_brute_force():
    draw = np.random.default_rng(6)
    docs = [draw.zipf(1.5, draw.integers(5, 80)) % 200 for _ in range(60)]
    held = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=300)
    weights = packing.Weights(np.log1p((60 - held + 0.5) / (held + 0.5)), float(np.mean(list(map(len, docs)))))
    index = packing.Index([weights.terms(d) for d in docs])
    unused = draw.random(60) < 0.7
    for seed in range(0, 60, 7):
        query = np.append(np.unique(docs[seed]), 299)
        ranked = index.ranked(query, unused)
        scores = brute_scores(docs, query, weights)
        assert sorted(ranked.tolist()) == np.flatnonzero(unused).tolist()
        assert np.all(np.diff(scores[ranked]) <= 1e-9)


def test_windows_hold_neighbours(spark):
    """Documents on ten subjects: most of a window's documents share the subject of its seed."""
    draw = random.Random(8)
    subjects = [[f"{'abcdefghij'[s]}{w}x" for w in range(40)] for s in range(10)]
    rows = [(i, " ".join(draw.choice(subjects[i % 10]) for _ in range(30))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = packing.packed(docs, byte_level_path(), window=1_024).collect()
    same = total = 0
    for pieces in sequences(found).values():
        kinds = [r["doc_id"] % 10 for r in pieces]
        same += sum(k == kinds[0] for k in kinds)
        total += len(kinds)
    assert same > 0.8 * total
