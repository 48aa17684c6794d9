from __future__ import annotations

import random

import corpus_pipeline
from tapegrid.llm import shingles
from tests.llm.test_simhash import brute_fingerprint


def corpus():
    docs, labels = [], []
    for i in range(120):
        words = [f"w{(i * 31 + j * j) % 997}" for j in range(120 + i)]
        if i % 10 == 3:
            words[5] = words[50] = "grunk"
        docs.append((i, " ".join(words), "en", None if i % 17 == 0 else f"s{i % 4}", 0))
        labels.append((i, 1, int(i % 10 == 3)))
    docs += [(200 + i, docs[i][1].replace(" ", "  "), "en", "s1", 0) for i in range(6)]
    docs += [(300 + i, docs[i][1] + " tail", "en", "s2", 0) for i in range(20, 26)]
    docs += [(400, None, None, None, None), (401, "", "en", "s0", 0), (5, docs[5][1], "en", "s1", 0)]
    return docs, labels


def shingle_texts(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def similarity(a, b):
    a, b = shingle_texts(a), shingle_texts(b)
    return len(a & b) / len(a | b)


def kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return sorted((r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()), key=str)


def row(number, text):
    return (number, text, "en", "s", 0)


def test_near_copies_beyond_three_bits_go(spark):
    draw = random.Random(1)
    rows, far = [], 0
    for i in range(40):
        words = [f"w{draw.randrange(5_000)}" for _ in range(200)]
        copy = list(words)
        for place in (20, 80, 140):
            copy[place] = f"x{i}"
        rows += [row(i, " ".join(words)), row(100 + i, " ".join(copy))]
        assert similarity(rows[-2][1], rows[-1][1]) >= 0.8
        far += (brute_fingerprint(rows[-2][1]) ^ brute_fingerprint(rows[-1][1])).bit_count() > 3
    assert far > 10
    assert kept(spark, rows) == sorted(range(40), key=str)


def test_a_shared_passage_is_no_copy_and_copies_within_its_buckets_go(spark):
    draw = random.Random(2)
    passage = [f"p{i}" for i in range(120)]
    rows = []
    for i in range(30):
        own = [f"w{draw.randrange(5_000)}" for _ in range(60)]
        rows += [row(i, " ".join(passage + own)), row(100 + i, " ".join(passage + own[:-3] + ["a", "b", "c"]))]
    rows += [row(500, None), row(501, ""), row(None, "a b c d e f g h")]
    alike = [(a[0], b[0]) for a in rows[:60] for b in rows[:60] if a[0] < b[0] and similarity(a[1], b[1]) >= 0.8]
    assert alike == [(i, 100 + i) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = [r["doc_id"] for r in shingles.keep_first(docs).collect()]
    assert set(found) == {*range(30), 500, 501, None} and len(found) == 33


def test_a_copy_at_four_bits_goes(spark):
    """The pair 20 and 320 of the pipeline's corpus: one word appended, similarity 0.99, four bits."""
    rows = [r for r in corpus()[0] if r[0] in (20, 21, 320, 321)]
    bits = {r[0]: brute_fingerprint(r[1]) for r in rows}
    assert (bits[20] ^ bits[320]).bit_count() == 4
    assert kept(spark, rows) == [20, 21]


def links(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    return {(r["u"], r["v"]) for r in shingles.near_links(docs).collect()}


def brute_first(texts):
    """Smallest id of the component of each text under similarity of five-word sets."""
    held = {i: shingle_texts((t or "").lower()) or {tuple((t or "").lower().split())} for i, t in texts}
    first = {i: i for i, _ in texts}
    ids = sorted(i for i, t in texts if (t or "").split())
    changed = True
    while changed:
        changed = False
        for x in ids:
            for y in ids:
                if x < y and first[x] != first[y]:
                    a, b = held[x], held[y]
                    if len(a & b) * 5 >= len(a | b) * 4:
                        first[x] = first[y] = min(first[x], first[y])
                        changed = True
    return first


def test_a_text_alike_to_an_absorbed_one_only_is_linked(spark):
    """0 and 1 are alike, 1 and 2 are, 0 and 2 are not; all share bands."""
    words = [f"w{i}" for i in range(200)]
    texts = [(0, " ".join(words)), (1, " ".join(words[18:] + [f"x{i}" for i in range(18)]))]
    texts.append((2, " ".join(words[36:] + [f"x{i}" for i in range(36)])))
    held = [shingles.band_keys(shingles.shingle_set(t.encode())) for _, t in texts]
    assert set(held[0]) & set(held[1]) & set(held[2])
    assert similarity(texts[0][1], texts[1][1]) >= 0.8 > similarity(texts[0][1], texts[2][1])
    assert similarity(texts[1][1], texts[2][1]) >= 0.8
    assert links(spark, texts) == {(0, 1), (1, 2)}


def test_prefix_pairs_miss_no_alike_pair(spark):
    draw = random.Random(9)
    base = [[f"w{draw.randrange(400)}" for _ in range(draw.randrange(1, 60))] for _ in range(25)]
    texts = []
    for number, words in enumerate(base):
        for copy in range(4):
            changed = [w if draw.random() > 0.02 * copy else "new" for w in words]
            texts.append((number * 4 + copy, " ".join(changed)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    sets = shingles._per_text(docs, "shingles").selectExpr("doc_id", "doc_id as group", "shingles")
    found = {(r["u"], r["v"]) for r in shingles.prefix_pairs(sets).collect()}
    values = {i: set(shingles.shingle_set(t.encode()).tolist()) for i, t in texts}
    alike = {
        (a, b) for a in values for b in values
        if a < b and len(values[a] & values[b]) * 5 >= len(values[a] | values[b]) * 4
    }
    assert alike and alike <= found
    # With groups as they come out, only pairs across groups are asked for.
    groups = {i: i // 4 for i in values}
    grouped = sets.selectExpr("doc_id", "cast(doc_id div 4 as long) as group", "shingles")
    across = {(r["u"], r["v"]) for r in shingles.prefix_pairs(grouped).collect()}
    assert {p for p in alike if groups[p[0]] != groups[p[1]]} <= across
    assert all(groups[a] != groups[b] for a, b in across)


def test_unlike_texts_with_a_passage_do_not_meet(spark):
    """A thousand texts share half their words: no alike pair, and hardly a candidate."""
    draw = random.Random(10)
    passage = [f"p{i}" for i in range(60)]
    texts = [(i, " ".join(passage + [f"w{draw.randrange(100_000)}" for _ in range(60)])) for i in range(1_000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    sets = shingles._per_text(docs, "shingles").selectExpr("doc_id", "doc_id as group", "shingles")
    assert shingles.prefix_pairs(sets).count() < 1_000
    assert links(spark, texts[:200]) == set()


def test_edge_rows(spark):
    long = " ".join(f"w{i % 9000}" for i in range(60_000))
    rows = [row(1, "a b"), row(2, "A  b"), row(3, ""), row(None, None), row(4, long), row(5, long + " end"), row(4, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "1 as key", "2 as shingles", "3 as group")
    found = sorted((r["doc_id"] for r in shingles.keep_first(docs).collect()), key=str)
    assert found == [1, 3, 4, 4, None]
    assert shingles.keep_first(docs).columns == docs.columns
    assert shingles.keep_first(docs.limit(0)).count() == 0


def test_texts_of_a_hot_group_below_the_threshold_do_not_meet(spark):
    """Three hundred variants of a text, most at a similarity of one half: only the alike pairs are candidates."""
    draw = random.Random(11)
    base = [f"w{i}" for i in range(150)]
    texts = [(i, " ".join(w if draw.random() > 0.035 else f"x{draw.randrange(40)}" for w in base)) for i in range(300)]
    sets = shingles._per_text(spark.createDataFrame(texts, "doc_id long, text string"), "shingles")
    found = {(r["u"], r["v"]) for r in shingles.prefix_pairs(sets.withColumn("group", sets["doc_id"])).collect()}
    values = [set(shingles.shingle_set(t.encode()).tolist()) for _, t in texts]
    alike = {
        (a, b) for a in range(300) for b in range(a + 1, 300)
        if len(values[a] & values[b]) * 5 >= len(values[a] | values[b]) * 4
    }
    assert 0 < len(alike) < 3_000 and alike <= found
    assert len(found) < 2 * len(alike) + 300
