"""Two public subword vocabularies over whole texts, word by word with a bounded table of words.

A text with a blank before it is cut where a blank or line feed stands between two characters that
are no white space. No token of either vocabulary goes across such a place, so the tokens of a text
are the tokens of its units in a row; both constructors check what this rests on.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import sentencepiece
import tiktoken

SPACE = "▁"
CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
MARK = "\0"
# Fixed value: how byte-level vocabularies divide a text before they merge.
BYTE_LEVEL_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def safe_units(text: str) -> list[str]:
    """The units of a text, joined they are the text."""
    return CUT.split(text)


def quick_units(text: str) -> list[str]:
    """Cut before every blank and line feed; equal to ``safe_units`` where all units are ``plain``."""
    if MARK in text:
        return safe_units(text)
    found = text.replace(" ", MARK + " ").replace("\n", MARK + "\n").split(MARK)
    return found if found[0] else found[1:]


def plain(unit: str) -> bool:
    """Whether the unit neither ends in white space nor goes on with it after its first character."""
    return len(unit) > 1 and not unit[1].isspace() and not unit[-1].isspace()


def byte_of_letter() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary file, by its rule:
    printable Latin-1 stands for itself, the others follow from U+0100 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = sorted(set(range(256)) - set(shown))
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteLevel:
    """A byte-level BPE vocabulary from its JSON file, merged by rank."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        before = model["pre_tokenizer"]
        if model["normalizer"] is not None or before["type"] != "ByteLevel" or before["add_prefix_space"]:
            raise ValueError("a byte-level vocabulary without normaliser and added blank is needed")
        letters = byte_of_letter()
        ranks = {bytes(map(letters.__getitem__, word)): i for word, i in model["model"]["vocab"].items()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"])
        order = [ranks[bytes(map(letters.__getitem__, "".join(pair)))] for pair in pairs]
        if order != sorted(order):
            raise ValueError("ids do not follow the order of merges")
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        ranks = {word: i for word, i in ranks.items() if i not in self.special.values()}
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a byte is no entry, so a text may not be spelled by its tokens")
        self.size = 1 + max(*ranks.values(), *self.special.values())
        self.spelled = [b""] * self.size
        for word, i in ranks.items():
            self.spelled[i] = word
        self.sizes = np.array(list(map(len, self.spelled)), dtype=np.int64)
        self.coder = tiktoken.Encoding(
            "byte-level", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens=self.special
        )

    def encode(self, unit: str) -> list[int]:
        """Ids of a unit; strings of special tokens are plain text."""
        return self.coder.encode_ordinary(unit)

    def encode_plain(self, units: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain units that start with a blank or line feed, in a row, and where each unit ends."""
        ids = np.array(self.coder.encode_ordinary("".join(units)), dtype=np.int64)
        ends = np.cumsum([len(u.encode()) for u in units])
        return ids, np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1

    def encode_marked(self, unit: str) -> list[int]:
        """Ids of a unit; strings of special tokens become their ids."""
        return self.coder.encode(unit, allowed_special="all")


class WordPieces:
    """A SentencePiece BPE vocabulary with byte fallback whose normaliser only adds a blank."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.vocab_size()
        names = [model.id_to_piece(i) for i in range(self.size)]
        if model.decode(model.encode("a  Ａ ")) != "a  Ａ ":
            raise ValueError("the normaliser changes text")
        if any("\n" in n or SPACE in n[1:] and n.strip(SPACE) for n in names):
            raise ValueError("a piece goes across the start of a word or line")
        self.spelled = [n.replace(SPACE, " ").encode() for n in names]
        for i in range(self.size):
            if model.is_byte(i):
                self.spelled[i] = bytes([int(names[i][3:-1], 16)])
            elif model.is_control(i):
                self.spelled[i] = b""
        self.blank = model.piece_to_id(SPACE)
        self.model = model

    def encode_all(self, units: Sequence[str]) -> list[list[int]]:
        """Ids of units that start with a blank or, after the start of a text, with a line feed."""
        found = self.model.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        return [ids if u[0] == " " else ids[1:] for u, ids in zip(units, found, strict=True)]


@lru_cache(maxsize=2)
def byte_level(path: str) -> ByteLevel:
    """Tables of one file, once per Python worker."""
    return ByteLevel(path)


@lru_cache(maxsize=2)
def word_pieces(path: str) -> WordPieces:
    return WordPieces(path)
