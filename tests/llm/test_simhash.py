from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from tapegrid.llm import simhash
from tapegrid.llm.components import components


def brute_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    counts = [0] * 64
    for shingle in shingles:
        value = xxhash.xxh64_intdigest(shingle.encode(), 42)
        for b in range(64):
            counts[b] += value >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def brute_components(marks, distance=3):
    """Smallest id of each component, by comparing everything with everything."""
    parent = {i: i for i in marks}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(marks)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (marks[a] ^ marks[b]).bit_count() <= distance:
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("text", ["", None, "  \t\n", "One", "One TWO", "a b c", "É é É", "x " * 5_000, "a b c"])
def test_fingerprint(text):
    assert simhash.fingerprint((text or "").encode()) == brute_fingerprint(text)


def marks_of(rng, n):
    """Clusters of near fingerprints, chains that drift, equal ones, and noise."""
    out = []
    for _ in range(n // 10):
        value = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            out.append(value)
            for _ in range(rng.randint(0, 4)):
                value ^= 1 << rng.randrange(64)
    return out


@pytest.mark.parametrize("parts,limit", [(4, 50_000), (3, 50_000), (2, 50_000), (4, 3), (None, 8)])
def test_links_connect_what_brute_force_connects(spark, parts, limit):
    rng = random.Random(7)
    values = marks_of(rng, 250)
    signed = {i: v - (1 << 64) if v >> 63 else v for i, v in enumerate(values)}
    classes = spark.createDataFrame([(v,) for v in set(signed.values())], "bits long")
    links = simhash.near_links(classes, parts=parts, bucket_limit=limit)
    roots = {r["node"]: r["root"] for r in components(links).collect()}
    expected = brute_components(dict(enumerate(values)))
    found = {i: roots.get(v, v) for i, v in signed.items()}
    groups = {}
    for i, root in found.items():
        groups.setdefault(root, set()).add(i)
    wanted = {}
    for i, root in expected.items():
        wanted.setdefault(root, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_dense_group_yields_a_forest_not_all_pairs(spark):
    centre = 0x0123456789ABCDEF
    values = {centre} | {centre ^ 1 << a ^ 1 << b for a in range(64) for b in range(a)}
    own = np.array(sorted(values), dtype=np.uint64)
    parents, _ = simhash.within(own, 3)
    assert len(parents) == len(own) - 1


def test_correlated_bits_share_a_part():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2, (4_000, 4))
    noise = rng.random((4_000, 64)) < 0.05
    places = rng.permutation(64)
    rows = np.zeros((4_000, 64))
    for group in range(4):
        rows[:, places[group * 16 : group * 16 + 16]] = base[:, group : group + 1]
    rows = np.abs(rows - noise)
    groups = simhash.group_bits(len(rows), rows.T @ rows, 4)
    assert {frozenset(g) for g in groups} == {frozenset(places[i * 16 : i * 16 + 16].tolist()) for i in range(4)}


def test_thresholds_spend_the_budget_where_candidates_are_few():
    groups = [list(range(i * 16, i * 16 + 16)) for i in range(4)]
    crowded = np.full((4, 1 << 16), 10_000.0)
    plan = simhash.Parts(groups, groups, [crowded, crowded * 0, crowded, crowded * 0.5], 3)
    thresholds = simhash.allocate(np.array([1, 2**63], dtype=np.uint64), plan)
    assert (thresholds.sum(axis=1) == 3 - 4 + 1).all()
    assert (thresholds[:, 0] == -1).all() and (thresholds[:, 1] >= 1).all()


def test_documents(spark):
    text = " ".join(f"w{i}" for i in range(400))
    rows = [
        (5, text), (2, text), (9, text + " tail"), (3, "something else entirely here now"),
        (7, ""), (6, None), (8, "\n \t"), (1, "one"), (4, "One"), (4, "One"), (None, text),
    ]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, bits string, root int")
    found = [(r["doc_id"], r["bits"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(docs).collect()]
    assert len(found) == len(rows)
    marks = {i: brute_fingerprint(t) for i, t in rows if i is not None}
    components_of = brute_components(marks)
    for doc, bits, component in found:
        if doc is None:
            assert (bits, component) == (brute_fingerprint(text), components_of[2])
        else:
            assert (bits, component) == (marks[doc], components_of[doc])
    kept = sorted(r["doc_id"] or -1 for r in simhash.keep_first(docs.where("doc_id IS NOT NULL")).collect())
    assert kept == sorted(i for i, _ in rows if i is not None and components_of[i] == i)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.keep_first(docs).columns == ["doc_id", "text"]


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    pairs = [(i, i + 1) for i in range(100, 180)] + [(0, i) for i in range(1, 60)] + [(500, 500), (501, 502), (502, 501)]
    pairs += [(rng.randrange(600, 700), rng.randrange(600, 700)) for _ in range(60)]
    links = spark.createDataFrame(pairs, "u long, v long")
    found = {r["node"]: r["root"] for r in components(links).collect()}
    parent = {n: n for pair in pairs for n in pair}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    ends = {n for a, b in pairs if a != b for n in (a, b)}
    assert set(found) == ends
    for a in ends:
        for b in ends:
            if b % 7 == 0:
                assert (found[a] == found[b]) == (find(a) == find(b))
