"""Byte-pair encoding and decoding with a given SentencePiece model, many words at a time."""

from __future__ import annotations

import codecs
import heapq
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "▁"
UNITS = re.compile(r" +[^ ]*")
# Fixed value: what an unknown piece decodes to.
UNKNOWN_TEXT = " \u2047 "
NO_PAIR = np.iinfo(np.int32).max
CACHED_UNITS = 150_000
WORDS_PER_ROUND = 1 << 15
# Words of more letters are encoded one by one, their occurrences held by rank.
LONG_WORD = 1 << 9
# So few occurrences are merged one after the other instead of as arrays.
FEW = 8
ROWS_AT_ONCE = 128


class Pieces:
    """Tables of a BPE model with byte fallback, and the vectorised encoder on them.

    The model's normaliser must leave text as it is but for the leading blank and the visible space
    mark, and no piece may go across the start of a word; both are checked.
    """

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        self.end = model.eos_id()
        names = [model.id_to_piece(i) for i in range(size)]
        self.control = [model.is_control(i) for i in range(size)]
        self.is_byte = [model.is_byte(i) for i in range(size)]
        self.byte_ids = np.array([i for i in range(size) if self.is_byte[i]])
        if len(self.byte_ids) != 256:
            raise ValueError("a model with byte fallback is needed")
        self.names = names
        special = [self.control[i] or self.is_byte[i] or model.is_unknown(i) for i in range(size)]
        plain = [i for i in range(size) if not special[i]]
        self.spelled = [b"" if special[i] else names[i].replace(SPACE, " ").encode() for i in range(size)]
        self.spelled[model.unk_id()] = UNKNOWN_TEXT.encode()
        for value, i in enumerate(self.byte_ids):
            self.spelled[i] = bytes([value])
        for i in plain:
            if SPACE in names[i][1:] and names[i].strip(SPACE):
                raise ValueError(f"piece {names[i]!r} goes across the start of a word")
        if model.encode("a  Ａ ") and model.decode(model.encode("a  Ａ ")) != "a  Ａ ":
            raise ValueError("the normaliser changes text")
        ids = {names[i]: i for i in plain}
        score = np.array([model.get_score(i) for i in range(size)])
        # Dense ranks: the best score is 0, equal scores share a rank.
        ranks = np.unique(-score[plain], return_inverse=True)[1]
        self.rank = np.full(size, NO_PAIR, dtype=np.int32)
        self.rank[plain] = ranks
        self.char = np.full(0x110000, -1, dtype=np.int32)
        for i in plain:
            if len(names[i]) == 1:
                self.char[ord(names[i])] = i
        self._pair_tables(plain, ids)

    def _pair_tables(self, plain: Sequence[int], ids: dict[str, int]) -> None:
        """Merged piece of every pair of pieces, as an open-addressed table of arrays.

        A merge is ``careful`` if its piece, or one of the same rank, can meet a neighbour in a pair of
        the same or a better rank; then another merge may come between two of its occurrences.
        """
        keys, merged = [], []
        careful = np.zeros(len(self.names), dtype=bool)
        for i in plain:
            name = self.names[i]
            for cut in range(1, len(name)):
                left, right = ids.get(name[:cut]), ids.get(name[cut:])
                if left is None or right is None:
                    if cut == 1 and left is None or cut == len(name) - 1 and right is None:
                        raise ValueError(f"a letter of piece {name!r} is no piece")
                    continue
                keys.append(left << 32 | right)
                merged.append(i)
                for part in (left, right):
                    if len(self.names[part]) > 1 and self.rank[i] <= self.rank[part]:
                        careful[part] = True
        self.careful_ranks = set(self.rank[careful].tolist())
        self.careful = np.isin(self.rank, self.rank[careful])
        self.pair_of = dict(zip(keys, merged, strict=True))
        bits = max(int(len(keys) * 4).bit_length(), 4)
        self.shift = np.uint64(64 - bits)
        table = np.full(1 << bits, -1, dtype=np.int64)
        value = np.full(1 << bits, -1, dtype=np.int32)
        todo_key, todo_value = np.array(keys, dtype=np.int64), np.array(merged, dtype=np.int32)
        slot = self._slot(todo_key)
        self.steps = 0
        while len(todo_key):
            self.steps += 1
            free = table[slot] < 0
            _, first = np.unique(slot, return_index=True)
            chosen = np.zeros(len(slot), dtype=bool)
            chosen[first] = True
            chosen &= free
            table[slot[chosen]] = todo_key[chosen]
            value[slot[chosen]] = todo_value[chosen]
            todo_key, todo_value = todo_key[~chosen], todo_value[~chosen]
            slot = (slot[~chosen] + 1) & (len(table) - 1)
        self.table, self.value = table, value

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Piece that each pair merges to, -1 if none."""
        out = np.full(len(left), -1, dtype=np.int32)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        key = left[at].astype(np.int64) << 32 | right[at]
        slot = self._slot(key)
        for _ in range(self.steps):
            held = self.table[slot]
            hit = held == key
            out[at[hit]] = self.value[slot[hit]]
            more = ~hit & (held >= 0)
            if not more.any():
                break
            at, key, slot = at[more], key[more], (slot[more] + 1) & (len(self.table) - 1)
        return out

    def encode_words(self, words: Sequence[str]) -> list[bytes]:
        """Ids of each word as 32-bit integers in memory order; a word is blanks (as ``SPACE``) and what
        follows them.

        All symbols of all words stand in one flat array. A round finds the best pair rank of each
        word, merges its occurrences from the left without overlap (only the leftmost one if the
        merge is careful), and closes the gaps; finished words leave the array.
        """
        flat = "".join(words)
        points = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbol = self.char[points]
        symbol = np.where(symbol < 0, -1 - points.astype(np.int64), symbol).astype(np.int64)
        word = np.repeat(np.arange(len(words)), lengths)
        done_symbol, done_word = [], []
        pair = self._pairs(symbol, word)
        while len(symbol):
            rank = np.where(pair >= 0, self.rank[pair], NO_PAIR)
            fresh = np.ones(len(word), dtype=bool)
            fresh[1:] = word[1:] != word[:-1]
            starts = np.flatnonzero(fresh)
            best = np.minimum.reduceat(rank, starts)
            place = np.cumsum(fresh) - 1
            over = (best == NO_PAIR)[place]
            if over.any():
                done_symbol.append(symbol[over])
                done_word.append(word[over])
                going = ~over
                symbol, word, pair, rank = symbol[going], word[going], pair[going], rank[going]
                best, place = best[best != NO_PAIR], None
                if not len(symbol):
                    break
                fresh = fresh[going]
                place = np.cumsum(fresh) - 1
            at = np.flatnonzero(rank == best[place])
            one = word[at]
            # Where occurrences touch (a a a), every second one of a run merges.
            joined = np.zeros(len(at), dtype=bool)
            joined[1:] = at[1:] == at[:-1] + 1
            run = np.maximum.accumulate(np.where(joined, 0, np.arange(len(at))))
            take = (np.arange(len(at)) - run) % 2 == 0
            first = np.ones(len(at), dtype=bool)
            first[1:] = one[1:] != one[:-1]
            take &= first | ~self.careful[pair[at]][np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
            at = at[take]
            symbol[at] = pair[at]
            stays = np.ones(len(symbol), dtype=bool)
            stays[at + 1] = False
            moved = np.cumsum(stays) - 1
            symbol, word, pair = symbol[stays], word[stays], pair[stays]
            at = moved[at]
            # Only pairs with a merged symbol are looked up again.
            near = np.zeros(len(symbol), dtype=bool)
            near[at] = True
            near[at[at > 0] - 1] = True
            touched = np.flatnonzero(near)
            ends = touched + 1 < len(symbol)
            pair[touched[~ends]] = -1
            inner = touched[ends]
            same = word[inner] == word[inner + 1]
            pair[inner[~same]] = -1
            inner = inner[same]
            pair[inner] = self.merged(symbol[inner], symbol[inner + 1])
        return self._gathered(done_symbol, done_word, len(words))

    def encode_long(self, word: str) -> bytes:
        """Ids of one long word, by the same rounds, each of which touches only its own merges.

        Symbols are linked to their neighbours instead of moved together, and the places of pairs wait
        in a list per rank. A round takes the best list and merges its occurrences from the left
        without overlap, up to the first that makes a pair of the same or a better rank; the others
        wait again. So a word of n letters costs n log n, however many ranks it goes through.
        """
        points = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        symbol = self.char[points].astype(np.int64)
        symbol = np.where(symbol < 0, -1 - points.astype(np.int64), symbol)
        n = len(symbol)
        # One more place than symbols: the neighbour of both ends, in no pair.
        symbol = np.append(symbol, -1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[n], before[0] = n, n
        alive = np.ones(n + 1, dtype=bool)
        pair = self.merged(symbol, symbol[after])
        waiting: dict[int, list[int]] = {}
        best: list[int] = []

        def wait_one(rank: int, place: int) -> None:
            held = waiting.get(rank)
            if held is None:
                waiting[rank] = [place]
                heapq.heappush(best, rank)
            elif rank in self.careful_ranks:
                heapq.heappush(held, place)
            else:
                held.append(place)

        def wait(places: np.ndarray) -> None:
            for rank, place in zip(self.rank[pair[places]].tolist(), places.tolist(), strict=True):
                wait_one(rank, place)

        def merge_few(rank: int, places: list[int]) -> list[int]:
            """Merges from the left; the places left over when a pair as good comes up."""
            for i, place in enumerate(places):
                made = int(pair[place])
                if not alive[place] or made < 0 or self.rank[made] != rank:
                    continue
                gone = int(after[place])
                symbol[place], alive[gone], after[place] = made, False, after[gone]
                before[after[gone]] = place
                least = NO_PAIR
                for left in (int(before[place]), place):
                    if left == n:
                        continue
                    new = self.pair_of.get(int(symbol[left]) << 32 | int(symbol[after[left]]), -1)
                    pair[left] = new
                    if new >= 0:
                        least = min(least, int(self.rank[new]))
                        wait_one(int(self.rank[new]), left)
                if least <= rank:
                    return places[i + 1 :]
            return []

        wait(np.flatnonzero(pair >= 0))
        portion: dict[int, int] = {}
        while best:
            rank = best[0]
            held, most = waiting[rank], portion.get(rank, FEW)
            if rank in self.careful_ranks and len(held) > most:
                # The leftmost ones; more of them the longer none has come between.
                found = [heapq.heappop(held) for _ in range(most)]
                portion[rank] = 2 * most
            else:
                found = waiting.pop(rank)
                heapq.heappop(best)
            if len(found) <= FEW:
                left_over = merge_few(rank, sorted(set(found)))
                for place in left_over:
                    wait_one(rank, place)
                if left_over:
                    portion[rank] = 2 * (len(found) - len(left_over))
                continue
            at = np.unique(np.array(found))
            at = at[alive[at] & (pair[at] >= 0)]
            at = at[self.rank[pair[at]] == rank]
            if not len(at):
                continue
            joined = np.zeros(len(at), dtype=bool)
            joined[1:] = at[1:] == after[at[:-1]]
            run = np.maximum.accumulate(np.where(joined, 0, np.arange(len(at))))
            take = at[(np.arange(len(at)) - run) % 2 == 0]
            made = pair[take].astype(np.int64)
            if self.careful[made].any():
                # What stands left of an occurrence when its turn comes: the one before it is merged.
                left = symbol[before[take]]
                touch = np.flatnonzero(after[after[take[:-1]]] == take[1:])
                left[touch + 1] = made[touch]
                right = symbol[after[after[take]]]
                new = np.stack([self.merged(left, made), self.merged(made, right)])
                bad = np.flatnonzero(((new >= 0) & (self.rank[new] <= rank)).any(axis=0))
                if len(bad):
                    take, made = take[: bad[0] + 1], made[: bad[0] + 1]
                    portion[rank] = 2 * len(take)
                    wait(at[at > take[-1]])
            gone = after[take]
            symbol[take] = made
            alive[gone] = False
            after[take] = after[gone]
            before[after[take]] = take
            before[0], after[n] = n, n
            touched = np.unique(np.concatenate([before[take], take]))
            touched = touched[touched < n]
            pair[touched] = self.merged(symbol[touched], symbol[after[touched]])
            wait(touched[pair[touched] >= 0])
        left = symbol[:n][alive[:n]]
        return self._gathered([left], [np.zeros(len(left), dtype=np.int64)], 1)[0]

    def _pairs(self, symbol: np.ndarray, word: np.ndarray) -> np.ndarray:
        pair = np.full(len(symbol), -1, dtype=np.int32)
        if len(symbol) > 1:
            inner = np.flatnonzero(word[1:] == word[:-1])
            pair[inner] = self.merged(symbol[inner], symbol[inner + 1])
        return pair

    def _gathered(
        self, symbols: list[np.ndarray], words: list[np.ndarray], n: int
    ) -> list[bytes]:
        """Ids per word in order, unknown characters as the ids of their UTF-8 bytes."""
        if not symbols:
            return [b""] * n
        symbol, word = np.concatenate(symbols), np.concatenate(words)
        order = np.argsort(word, kind="stable")
        symbol, word = symbol[order], word[order]
        unknown = np.flatnonzero(symbol < 0)
        if len(unknown):
            spelled = [
                self.byte_ids[list(chr(-1 - int(symbol[i])).encode("utf-8", "replace"))] for i in unknown
            ]
            repeats = np.ones(len(symbol), dtype=np.int64)
            repeats[unknown] = [len(s) for s in spelled]
            places = np.cumsum(repeats) - repeats
            symbol, word = np.repeat(symbol, repeats), np.repeat(word, repeats)
            for i, ids in zip(unknown, spelled, strict=True):
                symbol[places[i] : places[i] + len(ids)] = ids
        bounds = (4 * np.searchsorted(word, np.arange(n + 1))).tolist()
        data = symbol.astype(np.int32).tobytes()
        return [data[a:b] for a, b in zip(bounds, bounds[1:])]

    def decode(self, ids: Sequence[int] | np.ndarray) -> str:
        """Text of any ids: control pieces go, bytes are read as UTF-8, one by one where they are bad."""
        ids = list(map(int, ids)) if not isinstance(ids, np.ndarray) else ids.tolist()
        data = b"".join(map(self.spelled.__getitem__, ids))
        try:
            text = data.decode()
        except UnicodeDecodeError:
            text = "".join(
                _bytes_text(b"".join(map(self.spelled.__getitem__, run)))
                for _, run in groupby(ids, key=self.is_byte.__getitem__)
            )
        first = next((i for i in ids if not self.control[i]), None)
        return text[1:] if first is not None and self.names[first].startswith(SPACE) else text


# One replacement per byte that is part of no character, and on with the next byte.
codecs.register_error("each-byte", lambda error: ("\ufffd", error.start + 1))


def _bytes_text(data: bytes) -> str:
    """UTF-8 text of the bytes; every byte that is part of no character becomes U+FFFD."""
    return data.decode(errors="each-byte")


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    """Tables of one model file, once per Python worker."""
    return Pieces(path)


def units_of(text: str) -> list[str]:
    """Words with the blanks before them; joined they are the text with its leading blank."""
    text = " " + text.replace(SPACE, " ")
    if "  " in text or text.endswith(" "):
        return UNITS.findall(text)
    return [" " + w for w in text[1:].split(" ")]


class Encoder:
    """Encodes texts, remembering the ids of the words met (a bounded number of them)."""

    def __init__(self, path: str):
        self.pieces = pieces_of(path)
        self.known: dict[str, bytes] = {}

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        """Ids of each text with the end id; the empty text is the end id alone."""
        units = [units_of(t) if t else [] for t in texts]
        if len(self.known) > CACHED_UNITS:
            self.known.clear()
        known = self.known
        fresh = list({u for text in units for u in text if u not in known})
        long = [u for u in fresh if len(u) > LONG_WORD]
        fresh = [u for u in fresh if len(u) <= LONG_WORD]
        start = 0
        while start < len(fresh):
            # So many words at once, fewer if they are long.
            stop, letters = start, 0
            while stop < len(fresh) and stop - start < WORDS_PER_ROUND and letters < 1 << 20:
                letters += len(fresh[stop])
                stop += 1
            part = fresh[start:stop]
            marked = [u.replace(" ", SPACE) for u in part]
            known.update(zip(part, self.pieces.encode_words(marked), strict=True))
            start = stop
        for unit in long:
            known[unit] = self.pieces.encode_long(unit.replace(" ", SPACE))
        end = np.int32(self.pieces.end).tobytes()
        joined = (b"".join([*map(known.__getitem__, text), end]) for text in units)
        return [np.frombuffer(ids, dtype=np.int32) for ids in joined]


def encoded(
    docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", back: bool = False
) -> DataFrame:
    """``doc_id, ids``: every text's ids, the end id last. Null is the empty text.

    ``back`` adds ``decoded``, the text of those ids, from the same worker. ``model`` is the path of
    a SentencePiece file that every executor can open. Other columns are ignored. No shuffle; a task
    holds one batch of rows and a bounded table of words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        for batch in batches:
            for start in range(0, len(batch), ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                found = encoder.encode([t or "" for t in part.column(1).to_pylist()])
                offsets = np.cumsum([0, *map(len, found)])
                values = pa.array(np.concatenate(found))
                columns = [
                    part.column(0),
                    pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values),
                ]
                if back:
                    columns.append(pa.array(map(encoder.pieces.decode, found), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    fields = [source.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType()))]
    if back:
        fields.append(T.StructField("decoded", T.StringType()))
    names = [f.name for f in fields]
    return source.mapInArrow(run, T.StructType(fields))


def decoded(
    docs: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids"
) -> DataFrame:
    """``doc_id, text``: the text of each row's ids. Null is no id, the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model)
        for batch in batches:
            lists = (row.values for row in batch.column(1))
            texts = ["" if i is None else pieces.decode(i.to_numpy(zero_copy_only=False)) for i in lists]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"]
            )

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    fields = [source.schema["doc_id"], T.StructField("text", T.StringType())]
    return source.mapInArrow(run, T.StructType(fields))


def id_text(ids: str = "ids"):
    """Decimal ids joined by one space."""
    return F.array_join(F.transform(ids, lambda i: i.cast("string")), " ")
