from __future__ import annotations

import random

import numpy as np
import pytest
import sentencepiece

from tapegrid.llm import pieces
from tapegrid.llm.queries import model_path


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=model_path())


@pytest.fixture(scope="module")
def encoder():
    return pieces.Encoder(model_path())


def random_texts():
    rng = random.Random(5)
    letters = "abcdeéñ 人𐍈\n.,-0129THE ▁"
    yield from ("".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(2_000))
    yield from ("".join(rng.choice("aeinorst h") for _ in range(rng.randint(0, 200))) for _ in range(500))
    spans = ((0, 127), (128, 0xD7FF), (0xE000, 0x10FFFF))
    yield from ("".join(chr(rng.randint(*rng.choice(spans))) for _ in range(30)) for _ in range(500))


EDGES = [
    "", " ", "  a  b ", "\n", "a\tb", "▁x", "▁▁ x▁", "<s>", "</s> hi", "<0x41>", "a\x00b", "日本𐍈", "　x",
    "a" * 3_000, "ab" * 300, "aba" * 100, " " * 50 + "x" + " " * 33, "!!!!????", "=====---===", "the the  the   the",
]


def test_same_ids_and_text_as_the_library(library, encoder):
    texts = [*EDGES, *random_texts()]
    wanted = library.encode(texts, add_eos=True)
    found = encoder.encode(texts)
    assert [f.tolist() for f in found] == wanted
    assert [encoder.pieces.decode(f) for f in found] == library.decode(wanted)


def test_decode_of_any_ids(library, encoder):
    rng = random.Random(6)
    for _ in range(2_000):
        ids = [rng.randint(0, 31_999) if rng.random() < 0.5 else rng.randint(0, 300) for _ in range(rng.randint(0, 12))]
        assert encoder.pieces.decode(ids) == library.decode(ids)


def test_many_stray_bytes(library, encoder):
    ids = [3 + 0x80 + i % 64 for i in range(5_000)] + [3 + ord("a"), 3 + 0xC3, 3 + 0xA9]
    assert encoder.pieces.decode(ids) == library.decode(ids)


def test_long_words(library, encoder):
    rng = random.Random(8)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    texts = ["".join(rng.choice(letters) for _ in range(100_000)), "".join(rng.choice("ACGT") for _ in range(100_000))]
    texts += [c * 20_000 for c in "a=人𐍈"] + [unit * 3_000 for unit in ("th", "the", "and", "aab", "=-", "é人")]
    texts += ["".join(rng.choice("then ad▁"[: rng.randint(2, 8)]) for _ in range(3_000)) for _ in range(40)]
    texts += ["".join(rng.choice("then ad-=") for _ in range(3_000)).replace(" ", "") for _ in range(20)]
    wanted = library.encode(texts, add_eos=True)
    assert [f.tolist() for f in encoder.encode(texts)] == wanted


@pytest.mark.parametrize("blanks", [15, 31, 47, 100, 399, 400, 511, 1_200, 4_000])
def test_runs_of_blanks(library, encoder, blanks):
    texts = [" " * blanks, " " * blanks + "x", "y" + " " * blanks + "x " + " " * blanks]
    assert [f.tolist() for f in encoder.encode(texts)] == library.encode(texts, add_eos=True)


def test_long_and_short_words_by_the_same_merges(library, encoder, monkeypatch):
    texts = [*EDGES, *random_texts()][:800]
    monkeypatch.setattr(pieces, "LONG_WORD", 0)
    monkeypatch.setattr(pieces, "FEW", 1)
    wanted = library.encode(texts, add_eos=True)
    assert [f.tolist() for f in pieces.Encoder(model_path()).encode(texts)] == wanted
    monkeypatch.setattr(pieces, "FEW", 1_000)
    assert [f.tolist() for f in pieces.Encoder(model_path()).encode(texts)] == wanted


def test_forgetting_words_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(pieces, "CACHED_UNITS", 10)
    monkeypatch.setattr(pieces, "WORDS_PER_ROUND", 7)
    encoder = pieces.Encoder(model_path())
    texts = [t for t in random_texts()][:300]
    for start in range(0, 300, 20):
        part = texts[start : start + 20]
        assert [f.tolist() for f in encoder.encode(part)] == library.encode(part, add_eos=True)


def test_frames(spark, library):
    rows = [(1, "hello world", "x"), (1, "hello world", "x"), (2, None, "y"), (3, "", None), (None, "long " * 30_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    wanted = sorted(((i, t or "", library.encode(t or "", add_eos=True)) for i, t, _ in rows), key=str)
    both = pieces.encoded(docs, model_path(), back=True)
    assert sorted(((r["doc_id"], r["decoded"], list(r["ids"])) for r in both.collect()), key=str) == wanted
    ids = pieces.encoded(docs, model_path())
    assert ids.columns == ["doc_id", "ids"]
    back = pieces.decoded(ids, model_path()).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in back), key=str) == sorted((w[:2] for w in wanted), key=str)
    none = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [r["text"] for r in pieces.decoded(none, model_path()).collect()] == ["", ""]
    assert pieces.encoded(docs.where("false"), model_path()).count() == 0


def test_rounds_merge_from_the_left(encoder):
    ids = encoder.pieces.encode_words([pieces.SPACE + "aaaa"])[0]
    assert np.frombuffer(ids, dtype=np.int32).tolist() == encoder.encode(["aaaa"])[0].tolist()[:-1]
