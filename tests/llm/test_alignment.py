from __future__ import annotations

import collections
import hashlib
import random
import re
import tracemalloc

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tapegrid.llm import alignment, subwords
from tapegrid.llm.queries import byte_level_path, model_path
from tapegrid.session import settle

LETTERS = ["a", "b", " ", "  ", "\n", "\t", " ", "　", "\x1c", "\x85", "é", "日本", "<|endoftext|>", "<s>", "'s",
           "'ll", "🙂", ".", "1", "\r", "\x0b", "\0", "tion", "the", " ", " "]


def texts(n, seed=1):
    draw = random.Random(seed)
    return ["".join(draw.choice(LETTERS) for _ in range(draw.randrange(1, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    byte_tokens = Tokenizer.from_file(byte_level_path())
    byte_tokens.encode_special_tokens = True
    return byte_tokens, sentencepiece.SentencePieceProcessor(model_file=model_path())


def groups_of(text, library):
    byte_tokens, pieces = library
    letters = subwords.byte_of_letter()
    a, b = byte_tokens.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
    spelled = [
        [bytes(letters[c] for c in byte_tokens.id_to_token(i)) for i in a],
        [
            bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i)
            else pieces.id_to_piece(i).replace("▁", " ").encode()
            for i in b
        ],
    ]
    if any(b"".join(s) != (" " + text).encode() for s in spelled):
        return []
    ends = [np.cumsum(list(map(len, s))) for s in spelled]
    found, low = [], 0
    for cut in sorted({*ends[0].tolist()} & {*ends[1].tolist()}):
        found.append(
            tuple([i for i, e in zip(ids, stop.tolist(), strict=True) if low < e <= cut] for ids, stop in ((a, ends[0]), (b, ends[1])))
        )
        low = cut
    return found


def brute(rows, library):
    held, documents = collections.Counter(), []
    for doc_id, text in rows:
        groups = groups_of(text, library) if text else []
        links = [(x, y) for a, b in groups for x in a for y in b]
        held.update(set(links))
        documents.append((doc_id, groups, links))
    top = collections.defaultdict(int)
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    for doc_id, groups, links in documents:
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        yield (
            doc_id, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links),
            sum(held[link] == top[link[0]] for link in links), sum(held[link] for link in links),
            hashlib.sha256(text.encode()).hexdigest() if groups else "",
        )


@pytest.mark.parametrize("range_bytes", [1 << 15, 40])
def test_alignment_against_the_libraries(spark, library, range_bytes):
    rows = [(i, t) for i, t in enumerate(texts(250))]
    rows += [(None, "no id"), (7, "a repeated id"), (900, None), (901, ""), (902, "▁ mark"), (903, " "), (904, "x" * 300)]
    rows += [(905, "the same text"), (906, "the same text"), (907, "a b▁c " * 20)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, row string, groups int")
    found = alignment.aligned(docs, byte_level_path(), model_path(), range_bytes=range_bytes)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(brute(rows, library), key=str)


def test_long_texts_and_no_rows(spark, library):
    draw = random.Random(5)
    words = ["".join(draw.choice("abcdeéß日") for _ in range(draw.randrange(1, 9))) for _ in range(400)]
    rows = [
        (1, " ".join(draw.choice(words) for _ in range(4_000))),
        (2, "".join(draw.choice("abcXYZ019+/") for _ in range(20_000))),
        (3, "\n".join(draw.choice(words) for _ in range(3_000)) + "q" * 5_000 + " end"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = alignment.aligned(docs, byte_level_path(), model_path(), range_bytes=1 << 30, keep_groups=True).collect()
    many = alignment.aligned(docs, byte_level_path(), model_path(), range_bytes=300, keep_groups=True).collect()
    assert sorted(one) == sorted(many)
    assert min(r["n_groups"] for r in one) > 1_000
    assert alignment.aligned(docs.limit(0), byte_level_path(), model_path()).count() == 0


ENDS = st.sets(st.integers(1, 60), min_size=1, max_size=25)


@settings(max_examples=200, deadline=None)
@given(ENDS, ENDS, st.sets(st.integers(1, 59), max_size=6), st.integers(0, 100))
def test_fragments_are_a_monoid(a_ends, b_ends, borders, shape):
    """Any cutting into ranges and any tree of joins gives the fragment of the whole."""
    a_ends, b_ends = np.array(sorted(a_ends | {60})), np.array(sorted(b_ends | {60}))
    a, b = np.arange(len(a_ends)) + 100, np.arange(len(b_ends)) + 500
    edges = [0, *sorted(borders), 60]
    parts = []
    for low, high in zip(edges, edges[1:]):
        in_a, in_b = (a_ends > low) & (a_ends <= high), (b_ends > low) & (b_ends <= high)
        parts.append(alignment.fragment_of(a[in_a], a_ends[in_a], b[in_b], b_ends[in_b]))
    whole = alignment.closed(alignment.fragment_of(a, a_ends, b, b_ends))
    draw = random.Random(shape)
    while len(parts) > 1:
        at = draw.randrange(len(parts) - 1)
        parts[at : at + 2] = [parts[at] + alignment.Fragment() + parts[at + 1]]
    got = alignment.closed(parts[0])
    assert (got.text, got.groups, got.links, got.counts) == (whole.text, whole.groups, whole.links, whole.counts)
    assert sorted(got.pairs.tolist()) == sorted(whole.pairs.tolist())
    assert not len(got.tail[0]) and not len(got.tail[1])


def test_units_do_not_cut_tokens(library):
    a, b = subwords.byte_level(byte_level_path()), subwords.word_pieces(model_path())
    for text in texts(1_500, seed=2):
        units = subwords.quick_units(" " + text)
        if not all(map(subwords.plain, units)):
            units = subwords.safe_units(" " + text)
        assert [i for u in units for i in a.encode(u)] == library[0].encode(" " + text, add_special_tokens=False).ids
        assert [i for ids in b.encode_all(units) for i in ids] == library[1].encode(text)


def test_a_task_holds_one_python_worker(spark, monkeypatch):
    """No stage chains two Python functions: a worker each would stay with the tables it has loaded. Tables
    of large rows are read a few rows at once, and fragments are written in small row groups."""
    plans, large = [], []

    def noted(df, options=None):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        if df.columns[-1] in ("text", "docs"):
            large.append(int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")))
        if df.columns[-1] == "text":
            assert options["parquet.block.size"] <= 1 << 24
        return settle(df, options=options)

    monkeypatch.setattr(alignment, "settle", noted)
    rows = [(1, "a long text " * 900), (2, "short"), (2, "b c " * 30), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    noted(alignment.aligned(docs, byte_level_path(), model_path(), range_bytes=30))
    assert any("FlatMapGroupsInArrow" in plan for plan in plans)
    assert len(large) == 3 and max(large) <= 64 < int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize"))
    for plan in plans:
        functions = 0
        for line in plan.splitlines():
            functions = 0 if "Exchange" in line else functions + bool(re.search(r"(Map|Groups)InArrow", line))
            assert functions <= 1, plan


def test_remembered_units_are_small_and_bounded(monkeypatch):
    draw = random.Random(8)
    words = ["".join(draw.choice("abcdefgh") for _ in range(9)) for _ in range(12_000)]
    aligner = alignment.Aligner(byte_level_path(), model_path())
    aligner.units_of(["warm up"])
    tracemalloc.start()
    aligner.units_of([" ".join(words)])
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(aligner.known) > 11_000 and held < 330 * len(aligner.known)
    monkeypatch.setattr(alignment, "CACHED_BYTES", 1_000)
    aligner.units_of(["few words"])
    assert set(aligner.known) == {" few", " words"}
