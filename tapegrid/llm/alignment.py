"""Alignment of two tokenizers over the same bytes by an associative monoid of fragments.

A fragment stands for the tokens of both vocabularies that end in one range of bytes: an open prefix
(up to the first offset where both end), closed groups, and an open suffix. Joining two neighbours
closes the group between them, and joining is associative, so a long document is cut into ranges that
are tokenised in separate tasks and reduced as a tree. How often two ids are linked is counted in
blocks of documents, each with one list of its distinct pairs, instead of row by row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tapegrid.llm.subwords import byte_level, plain, quick_units, safe_units, word_pieces
from tapegrid.llm.text import arrow_rows, read_rows
from tapegrid.session import settle

# Bytes of a range of a long document, fragments joined at once, pairs of a block.
RANGE_BYTES = 1 << 15
FAN_IN = 16
BLOCK_PAIRS = 1 << 19
# Units remembered, bytes of their groups and links, and characters aligned at once.
CACHED_UNITS = 30_000
CACHED_BYTES = 1 << 24
LETTERS_AT_ONCE = 1 << 16
# Rows of a batch of texts, of long texts or their fragments, and rows of both read from a file at once.
SHORT_ROWS, LONG_ROWS, READ_ROWS = 64, 4, 64
# A fragment has several times the size of its range, so a writer looks often how much it holds.
LARGE_ROWS = {
    "parquet.block.size": 1 << 24,
    "parquet.block.size.row.check.min": 8,
    "parquet.page.size.row.check.min": 8,
}
NO_IDS = np.array([], dtype=np.int64)


def spelled_group(a: Sequence[int], b: Sequence[int]) -> str:
    return ",".join(map(str, a)) + "|" + ",".join(map(str, b))


@dataclass(frozen=True)
class Fragment:
    """Tokens of both sides that end in one range; the empty fragment is the neutral element.

    Without a common end (``cut`` false) all tokens stand in the prefix. An empty prefix before a cut
    means that both sides end where the range starts. ``pairs`` holds one code ``a << 32 | b`` per
    link of the closed groups, repeats included.
    """

    head: tuple[np.ndarray, np.ndarray] = (NO_IDS, NO_IDS)
    cut: bool = False
    groups: int = 0
    links: int = 0
    text: str = ""
    pairs: np.ndarray = field(default_factory=lambda: NO_IDS)
    tail: tuple[np.ndarray, np.ndarray] = (NO_IDS, NO_IDS)
    counts: tuple[int, int] = (0, 0)
    broken: bool = False

    def __add__(self, other: Fragment) -> Fragment:
        return join([self, other])


def codes_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, None] << 32 | b[None, :]).ravel()


def join(parts: Sequence[Fragment]) -> Fragment:
    """The fragment of the joined ranges, in order."""
    head: tuple[list, list] = ([], [])
    tail: tuple[list, list] = ([], [])
    cut, groups, links, texts, pairs = False, 0, 0, [], []
    for part in parts:
        open_end = tail if cut else head
        for side in (0, 1):
            open_end[side].append(part.head[side])
        if not part.cut:
            continue
        if cut:
            a, b = (np.concatenate(t) for t in tail)
            if len(a) or len(b):
                groups, links = groups + 1, links + len(a) * len(b)
                texts.append(spelled_group(a.tolist(), b.tolist()))
                pairs.append(codes_of(a, b))
        groups, links = groups + part.groups, links + part.links
        if part.groups:
            texts.append(part.text)
            pairs.append(part.pairs)
        tail, cut = ([part.tail[0]], [part.tail[1]]), True

    def whole(arrays: list) -> np.ndarray:
        return np.concatenate(arrays) if arrays else NO_IDS

    return Fragment(
        (whole(head[0]), whole(head[1])),
        cut,
        groups,
        links,
        ";".join(texts),
        whole(pairs),
        (whole(tail[0]), whole(tail[1])),
        (sum(p.counts[0] for p in parts), sum(p.counts[1] for p in parts)),
        any(p.broken for p in parts),
    )


EDGE = Fragment(cut=True)


def closed(part: Fragment) -> Fragment:
    """The fragment of a whole text with its first group closed: what precedes a text ends both sides."""
    return join([EDGE, part])


def fragment_of(
    a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray, broken: bool = False
) -> Fragment:
    """The fragment of the given tokens, from the offsets where they end."""
    cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
    counts = (len(a), len(b))
    if not len(cuts):
        return Fragment((a, b), counts=counts, broken=broken)
    a_cuts, b_cuts = np.searchsorted(a_ends, cuts) + 1, np.searchsorted(b_ends, cuts) + 1
    sizes_a, sizes_b = np.diff(a_cuts), np.diff(b_cuts)
    inner = [(a[i:j], b[k:m]) for i, j, k, m in zip(a_cuts, a_cuts[1:], b_cuts, b_cuts[1:])]
    return Fragment(
        (a[: a_cuts[0]], b[: b_cuts[0]]),
        True,
        len(inner),
        int((sizes_a * sizes_b).sum()),
        ";".join(spelled_group(x.tolist(), y.tolist()) for x, y in inner),
        np.concatenate([codes_of(x, y) for x, y in inner]) if inner else NO_IDS,
        (a[a_cuts[-1] :], b[b_cuts[-1] :]),
        counts,
        broken,
    )


def flat(lists: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists in a row, and the length of each list."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum())), sizes


def stretches(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``values`` with the given starts and sizes, one after the other."""
    ends = np.cumsum(sizes)
    return values[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Spelling:
    """Decimal numbers, each with the sign that follows it, as stretches of one array of bytes."""

    SIGNS = (b",", b"|", b";")

    def __init__(self, size: int):
        words = [b"%d" % i + sign for i in range(size) for sign in self.SIGNS]
        self.letters = np.frombuffer(b"".join(words), dtype=np.uint8)
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def of(self, ids: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The letters of all numbers in a row and where each number ends."""
        words = ids * len(self.SIGNS) + signs
        return stretches(self.letters, self.starts[words], self.sizes[words]), np.cumsum(self.sizes[words])


class Aligner:
    """Aligns units of two vocabularies and remembers a bounded number of them.

    What is known of all units stands in a few flat arrays, so that a worker holds no object per unit
    but its key and its number.
    """

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = byte_level(a_path), word_pieces(b_path)
        self.a_bytes = np.array([len(s) for s in self.a.spelled], dtype=np.int64)
        self.b_bytes = np.array([len(s) for s in self.b.spelled], dtype=np.int64)
        self.spelling = Spelling(max(self.a.size, self.b.size))
        # Unit -> its number; units with more white space than one leading character stand apart.
        self.known: dict[str, int] = {}
        self.odd: dict[str, int] = {}
        self.forget()

    def forget(self) -> None:
        self.known.clear()
        self.odd.clear()
        # Per unit: counts (a, b, groups, links, trouble), where its groups and its links end.
        self.facts = np.empty((0, 5), dtype=np.uint32)
        self.shown, self.shown_ends = np.empty(0, dtype=np.uint8), NO_IDS
        self.codes, self.code_ends = NO_IDS, NO_IDS

    def _tokens(
        self, units: Sequence[str], joined: bool
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of both sides in a row and how many are of each unit, none where the pieces fail to spell
        the unit (the last array); byte-level tokens never do.

        ``joined``: all units are plain, so the byte-level side reads them in a row.
        """
        if joined:
            a, stops = self.a.encode_plain(units)
            n_a = np.diff(stops, prepend=0)
        else:
            a, n_a = flat([self.a.encode(u) for u in units])
        b, n_b = flat(self.b.encode_all(units))
        broken = self._broken(units, b, n_b)
        if broken.any():
            a, b = a[np.repeat(~broken, n_a)], b[np.repeat(~broken, n_b)]
            n_a, n_b = np.where(broken, 0, n_a), np.where(broken, 0, n_b)
        return a, n_a, b, n_b, broken

    def _broken(self, units: Sequence[str], b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
        """Whether the pieces fail to spell a unit: first for all in a row, then one by one."""
        read = [u.encode() for u in units]
        pieces = list(map(self.b.spelled.__getitem__, b.tolist()))
        ends = np.cumsum(n_b)
        found = np.concatenate([[0], np.cumsum(self.b_bytes[b])])[ends]
        if b"".join(pieces) == b"".join(read) and (found == np.cumsum([*map(len, read)])).all():
            return np.zeros(len(units), dtype=bool)
        return np.array([r != b"".join(pieces[i:j]) for r, i, j in zip(read, ends - n_b, ends, strict=True)])

    def learn(self, units: Sequence[str], table: dict, joined: bool) -> None:
        """Align many units at once: a unit's end is a common end, so all stand in one line of bytes."""
        a, n_a, b, n_b, broken = self._tokens(units, joined)
        a_ends, b_ends = np.cumsum(self.a_bytes[a]), np.cumsum(self.b_bytes[b])
        a_at = np.searchsorted(a_ends, b_ends)
        b_at = np.flatnonzero(a_ends[a_at] == b_ends)
        a_at = a_at[b_at]
        # Tokens of each group, and where those of both sides end.
        group_a, group_b = np.diff(a_at + 1, prepend=0), np.diff(b_at + 1, prepend=0)
        links = group_a * group_b
        # Links of all groups: every a token repeats over the b tokens of its group.
        times = np.repeat(group_b, group_a)
        codes = np.repeat(a, times) << 32 | stretches(b, np.repeat(b_at + 1 - group_b, group_a), times)
        # Spelled, the a tokens of a group stand before its b tokens, and after the tokens of all groups before.
        order = np.concatenate(
            [np.arange(len(a)) + np.repeat(b_at + 1 - group_b, group_a), np.arange(len(b)) + np.repeat(a_at + 1, group_b)]
        )
        signs = np.zeros(len(a) + len(b), dtype=np.int64)
        signs[a_at], signs[len(a) + b_at] = 1, 2
        ids, signs_in_order = np.empty_like(signs), np.empty_like(signs)
        ids[order], signs_in_order[order] = np.concatenate([a, b]), signs
        shown, word_ends = self.spelling.of(ids, signs_in_order)
        # The unit of a group is told by the place of its last a token.
        borders = np.searchsorted(a_at, np.cumsum(n_a) - 1, side="right")
        link_ends = np.concatenate([[0], np.cumsum(links)])[borders]
        shown_ends = np.concatenate([[0], word_ends])[np.cumsum(n_a + n_b)]
        facts = np.stack([n_a, n_b, np.diff(borders, prepend=0), np.diff(link_ends, prepend=0), broken], axis=1)
        table.update(zip(units, range(len(self.facts), len(self.facts) + len(units)), strict=True))
        self.facts = np.concatenate([self.facts, facts.astype(np.uint32)])
        self.shown_ends = np.concatenate([self.shown_ends, len(self.shown) + shown_ends])
        self.code_ends = np.concatenate([self.code_ends, len(self.codes) + link_ends])
        self.shown, self.codes = np.concatenate([self.shown, shown]), np.concatenate([self.codes, codes])

    def units_of(self, texts: Sequence[str]) -> list[list[str]]:
        """The units of each text with its leading blank, all of them known afterwards."""
        self.make_room()
        quick = [quick_units(" " + t) for t in texts]
        met = set().union(*quick)
        new = [u for u in met if u not in self.known]
        odd = {u for u in new if not plain(u)}
        self.learn_all([u for u in new if u not in odd], self.known, True)
        if not odd:
            return quick
        found = [
            units if odd.isdisjoint(units) else safe_units(" " + text)
            for text, units in zip(texts, quick, strict=True)
        ]
        self.learn_new({u for units in found for u in units})
        return found

    def make_room(self) -> None:
        if len(self.facts) > CACHED_UNITS or self.shown.nbytes + self.codes.nbytes > CACHED_BYTES:
            self.forget()

    def learn_new(self, units: set[str]) -> None:
        new = [u for u in units if u not in self.known and u not in self.odd]
        joined = set(filter(plain, new))
        self.learn_all(list(joined), self.known, True)
        self.learn_all([u for u in new if u not in joined], self.odd, False)

    def learn_all(self, units: list[str], table: dict, joined: bool) -> None:
        shares = np.cumsum([*map(len, units)]) // LETTERS_AT_ONCE
        borders = [0, *(np.flatnonzero(np.diff(shares)) + 1).tolist(), len(units)]
        for start, stop in zip(borders, borders[1:]):
            if stop > start:
                self.learn(units[start:stop], table, joined)

    def of_units(self, units: Sequence[str]) -> Fragment:
        """The closed fragment of known whole units."""
        try:
            at = np.array(list(map(self.known.__getitem__, units)))
        except KeyError:
            at = np.array([self.known[u] if u in self.known else self.odd[u] for u in units])
        facts = self.facts[at].astype(np.int64)
        n_a, n_b, groups, links, broken = facts.sum(axis=0).tolist()
        shown_ends, code_ends = self.shown_ends[at], self.code_ends[at]
        shown_starts = np.where(at > 0, self.shown_ends[at - 1], 0)
        text = stretches(self.shown, shown_starts, shown_ends - shown_starts)
        return Fragment(
            cut=True,
            groups=groups,
            links=links,
            text=text[:-1].tobytes().decode(),
            pairs=stretches(self.codes, code_ends - facts[:, 3], facts[:, 3]),
            counts=(n_a, n_b),
            broken=broken > 0,
        )

    def ranged(self, unit: str, start: int, low: int, high: int) -> Fragment:
        """The tokens of the unit at offset ``start`` that end above ``low`` and not above ``high``."""
        a, _, b, _, broken = self._tokens([unit], False)
        if broken[0]:
            return Fragment(broken=True)
        ids = []
        for side, size in ((a, self.a_bytes), (b, self.b_bytes)):
            ends = start + np.cumsum(size[side])
            inside = (ends > low) & (ends <= high)
            ids += [side[inside], ends[inside]]
        return fragment_of(*ids)

    def of_range(self, window: str, start: int, low: int, high: int) -> Fragment:
        """The fragment of the bytes ``(low, high]`` from a window of whole units at ``start``."""
        units = safe_units(window)
        starts = start + np.cumsum([0, *(len(u.encode()) for u in units)])
        first = int(starts[0] < low)
        last = len(units) - int(starts[-1] > high)
        inner = units[first:last]
        self.make_room()
        self.learn_new(set(inner))
        parts = [self.ranged(units[0], int(starts[0]), low, high)] if first else []
        if inner:
            parts.append(self.of_units(inner))
        if last < max(len(units), first) and last >= first:
            parts.append(self.ranged(units[last], int(starts[last]), low, high))
        return join(parts)


@lru_cache(maxsize=1)
def aligner_of(a_path: str, b_path: str) -> Aligner:
    """One aligner per Python worker."""
    return Aligner(a_path, b_path)


def ranges_of(text: str, size: int) -> Iterator[tuple[int, str, int, int]]:
    """``start, window, low, high`` of every range of a text with its leading blank.

    Borders stand at multiples of ``size``; one is left out if no unit has started since the border
    before it, so that a unit is read by at most two ranges and a stretch without a cut by one task.
    The window holds the whole units that reach into the range.
    """
    units = safe_units(" " + text)
    starts = np.cumsum([0, *(len(u.encode()) for u in units)])
    end = int(starts[-1])
    borders = [0]
    for border in range(size, end, size):
        held = int(np.searchsorted(starts, border, side="right")) - 1
        if starts[held] > borders[-1] or starts[held] == border:
            borders.append(border)
    for low, high in zip(borders, [*borders[1:], end], strict=True):
        first = int(np.searchsorted(starts, low, side="right")) - 1
        last = int(np.searchsorted(starts, high, side="left"))
        yield int(starts[first]), "".join(units[first:last]), low, high


def fragment_type(id_field: T.StructField) -> T.StructType:
    """Columns of a fragment of document ``row``, the ``place``-th of its level."""
    return T.StructType(
        [
            T.StructField("row", T.LongType()),
            id_field,
            T.StructField("place", T.LongType()),
            *[T.StructField(n, T.BinaryType()) for n in ("head_a", "head_b", "tail_a", "tail_b", "pairs")],
            T.StructField("cut", T.BooleanType()),
            T.StructField("broken", T.BooleanType()),
            *[T.StructField(n, T.LongType()) for n in ("groups", "links", "n_a", "n_b")],
            T.StructField("text", T.StringType()),
        ]
    )


def packed(part: Fragment, row: int, doc_id, place: int) -> dict:
    return {
        "row": row,
        "doc_id": doc_id,
        "place": place,
        "head_a": part.head[0].tobytes(),
        "head_b": part.head[1].tobytes(),
        "tail_a": part.tail[0].tobytes(),
        "tail_b": part.tail[1].tobytes(),
        "pairs": part.pairs.tobytes(),
        "cut": part.cut,
        "broken": part.broken,
        "groups": part.groups,
        "links": part.links,
        "n_a": part.counts[0],
        "n_b": part.counts[1],
        "text": part.text,
    }


def unpacked(row: dict) -> Fragment:
    head_a, head_b, tail_a, tail_b, pairs = (
        np.frombuffer(row[n], dtype=np.int64) for n in ("head_a", "head_b", "tail_a", "tail_b", "pairs")
    )
    return Fragment(
        (head_a, head_b), row["cut"], row["groups"], row["links"], row["text"], pairs,
        (tail_a, tail_b), (row["n_a"], row["n_b"]), row["broken"],
    )


def _schema(kind: T.StructType) -> pa.Schema:
    return to_arrow_schema(kind)


def long_fragments(docs: DataFrame, a_path: str, b_path: str, range_bytes: int) -> DataFrame:
    """At most ``FAN_IN`` fragments per long document from ``doc_id, text``, in order and next to each other:
    cut, tokenise the ranges, reduce as a tree.

    The last join is left to the caller's task, so no stage runs two Python functions one after the
    other: each would hold a worker of its own per task, and workers keep the tables they have loaded.
    """
    kind = fragment_type(docs.schema["doc_id"])
    range_type = T.StructType(
        [
            T.StructField("row", T.LongType()),
            kind["doc_id"],
            *[T.StructField(n, T.LongType()) for n in ("place", "start", "low", "high")],
            T.StructField("window", T.StringType()),
        ]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _schema(range_type)
        for batch in batches:
            for r in batch.to_pylist():
                for place, (start, window, low, high) in enumerate(ranges_of(r["text"], range_bytes)):
                    one = {"row": r["row"], "doc_id": r["doc_id"], "place": place, "start": start,
                           "low": low, "high": high, "window": window}
                    yield pa.RecordBatch.from_pylist([one], schema=schema)

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, schema = aligner_of(a_path, b_path), _schema(kind)
        for batch in batches:
            for r in batch.to_pylist():
                part = aligner.of_range(r["window"], r["start"], r["low"], r["high"])
                yield pa.RecordBatch.from_pylist([packed(part, r["row"], r["doc_id"], r["place"])], schema=schema)
        aligner.forget()

    def reduce(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["place"])
        one = packed(join(list(map(unpacked, rows))), rows[0]["row"], rows[0]["doc_id"], rows[0]["place"] // FAN_IN)
        return pa.Table.from_pylist([one], schema=_schema(kind))

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    ranges = numbered.mapInArrow(cut, range_type).repartition("row", "place")
    with arrow_rows(docs.sparkSession, LONG_ROWS):
        parts = settle(ranges.mapInArrow(tokenise, kind), options=LARGE_ROWS)
    last = parts.agg(F.max("place")).first()[0] or 0
    while last >= FAN_IN:
        parts = parts.groupBy("row", F.floor(F.col("place") / FAN_IN)).applyInArrow(reduce, kind)
        last //= FAN_IN
    return parts.repartition("row").sortWithinPartitions("row", "place")


DOC_FIELDS = ("n_a", "n_b", "n_groups", "n_links")


def _block_type(id_field: T.StructField) -> T.StructType:
    """A block's rows: one per document (places of its pairs in the block's list, as steps, and how
    often), and one without document that holds the list and in how many documents each pair is."""
    return T.StructType(
        [
            T.StructField("block", T.StringType()),
            id_field,
            *[T.StructField(n, T.LongType()) for n in DOC_FIELDS],
            T.StructField("groups", T.StringType()),
            T.StructField("pairs", T.LongType()),
            T.StructField("steps", T.BinaryType()),
            T.StructField("times", T.BinaryType()),
            T.StructField("codes", T.ArrayType(T.LongType())),
            T.StructField("docs", T.ArrayType(T.IntegerType())),
        ]
    )


def narrow(values: np.ndarray) -> bytes:
    """Small whole numbers as 16 bits each if all fit, else 32; the number of values tells which."""
    fits = not len(values) or values.max() < 1 << 16
    return values.astype(np.uint16 if fits else np.uint32).tobytes()


def widened(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint16 if len(data) == 2 * n else np.uint32).astype(np.int64)


class Blocks:
    """Gathers aligned documents and gives them out as blocks of bounded size."""

    def __init__(self, kind: T.StructType, tag: str, keep_groups: bool):
        self.schema, self.tag, self.keep_groups = _schema(kind), tag, keep_groups
        self.number, self.held, self.rows = 0, 0, []

    def add(self, doc_id, part: Fragment | None) -> Iterator[pa.RecordBatch]:
        if part is None or part.broken:
            self.rows.append((doc_id, (0, 0, 0, 0), "", NO_IDS, NO_IDS))
        else:
            codes, times = np.unique(part.pairs, return_counts=True)
            groups = part.text if self.keep_groups else hashlib.sha256(part.text.encode()).hexdigest()
            self.rows.append((doc_id, (*part.counts, part.groups, part.links), groups, codes, times))
            self.held += len(codes)
        if self.held >= BLOCK_PAIRS or len(self.rows) >= 1 << 16:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            return
        ids, facts, groups, codes, times = zip(*self.rows, strict=True)
        pairs, place, docs = np.unique(np.concatenate(codes), return_inverse=True, return_counts=True)
        borders = np.cumsum([0, *map(len, codes)])
        n = len(ids)
        steps = [narrow(np.diff(place[i:j], prepend=0)) for i, j in zip(borders, borders[1:])]
        block = f"{self.tag}-{self.number}"
        columns = [
            pa.array([block] * (n + 1)),
            pa.array([*ids, None], self.schema.field(1).type),
            *[pa.array([*column, None], pa.int64()) for column in zip(*facts, strict=True)],
            pa.array([*groups, None], pa.string()),
            pa.array([*map(len, codes), None], pa.int64()),
            pa.array([*steps, None], pa.binary()),
            pa.array([*map(narrow, times), None], pa.binary()),
            _one_list(pairs, n, pa.int64()),
            _one_list(docs.astype(np.int32), n, pa.int32()),
        ]
        self.number, self.held, self.rows = self.number + 1, 0, []
        yield pa.RecordBatch.from_arrays(columns, schema=self.schema)


def _one_list(values: np.ndarray, nulls: int, kind: pa.DataType) -> pa.Array:
    """``nulls`` nulls and then one list."""
    offsets = pa.array([None] * nulls + [0, len(values)], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(values, kind))


def aligned(
    docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text",
    range_bytes: int = RANGE_BYTES, keep_groups: bool = False,
) -> DataFrame:
    """One row per document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups``.

    ``a_path`` is a byte-level JSON vocabulary, ``b_path`` a SentencePiece model that adds a blank;
    both read the text with one blank before it, and special tokens in a text are plain text. Offsets
    where tokens of both end cut the tokens into groups; every a token of a group links to every b
    token of it. The count of a pair of ids is the number of documents that hold it linked;
    ``n_best`` counts a document's links whose count is the highest of their a id (ties included),
    ``count_sum`` adds the counts over its links. ``groups`` is the hex SHA-256 of the groups spelled
    ``a1,a2|b1;a3|b2,b3``, or that text itself with ``keep_groups``.

    A null or empty text, or one whose tokens do not spell it (a visible space mark in it), has no
    tokens: zeros and the empty ``groups``. Rows that repeat an id, or have none, are documents of
    their own; other columns are ignored; an empty table gives no rows. Texts over ``range_bytes``
    bytes go through fragments in several tasks, with the same result at every size.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = _block_type(source.schema["doc_id"])
    over = F.coalesce(F.octet_length("text") > range_bytes, F.lit(False))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(a_path, b_path)
        blocks = Blocks(kind, f"s{TaskContext.get().partitionId()}", keep_groups)
        for batch in batches:
            ids, texts = batch.to_pydict().values()
            for doc_id, text, units in zip(ids, texts, aligner.units_of([t or "" for t in texts]), strict=True):
                yield from blocks.add(doc_id, aligner.of_units(units) if text else None)
        yield from blocks.flush()
        aligner.forget()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(kind, f"l{TaskContext.get().partitionId()}", keep_groups)
        rows = (row for batch in batches for row in batch.to_pylist())
        for _, parts in groupby(rows, key=itemgetter("row")):
            ids, fragments = zip(*((row["doc_id"], unpacked(row)) for row in parts), strict=True)
            yield from blocks.add(ids[0], closed(join(fragments)))
        yield from blocks.flush()

    with read_rows(docs.sparkSession, READ_ROWS):
        parts = long_fragments(source.where(over), a_path, b_path, range_bytes)
        with arrow_rows(docs.sparkSession, LONG_ROWS):
            finished = settle(parts.mapInArrow(whole, kind))
        with arrow_rows(docs.sparkSession, SHORT_ROWS):
            table = settle(source.where(~over).mapInArrow(short, kind)).unionByName(finished)
        return _counted(table, kind)


def _counted(table: DataFrame, kind: T.StructType) -> DataFrame:
    """The documents of the blocks with ``n_best`` and ``count_sum``."""
    # A null count marks the row of a block's list, so that its documents are told without reading the lists.
    lists, rows = table.where("n_a is null"), table.where("n_a is not null").drop("codes", "docs")
    entries = lists.select(F.col("block").alias("of"), F.posexplode("codes").alias("place", "code"))
    held = lists.select(F.explode(F.arrays_zip("codes", "docs")).alias("p"))
    counts = held.groupBy(F.col("p.codes").alias("code")).agg(F.sum("p.docs").alias("count"))
    counts = settle(counts.withColumn("a", F.shiftright("code", 32)))
    # One row per id of the first vocabulary: its size bounds what is broadcast.
    top = counts.groupBy("a").agg(F.max("count").alias("top"))
    judged = counts.join(F.broadcast(top), "a").select(
        "code", F.when(F.col("count") == F.col("top"), -F.col("count")).otherwise(F.col("count")).alias("count")
    )
    looked = entries.join(judged, "code").select("of", "place", "count")
    out = T.StructType(
        [kind["doc_id"], *[T.StructField(n, T.LongType()) for n in (*DOC_FIELDS, "n_best", "count_sum")],
         T.StructField("groups", T.StringType())]
    )

    def measured(docs: pa.Table, found: pa.Table) -> pa.Table:
        count = np.zeros(len(found), dtype=np.int64)
        count[found["place"].to_numpy()] = found["count"].to_numpy()
        size, best = np.abs(count), count < 0
        n_best, count_sum = [], []
        columns = (docs[n].to_pylist() for n in ("pairs", "steps", "times"))
        for n, steps, times in zip(*columns, strict=True):
            place, often = np.cumsum(widened(steps, n)), widened(times, n)
            n_best.append(int(often[best[place]].sum()))
            count_sum.append(int((often * size[place]).sum()))
        columns = [docs["doc_id"], *[docs[n] for n in DOC_FIELDS], pa.array(n_best, pa.int64()),
                   pa.array(count_sum, pa.int64()), docs["groups"]]
        return pa.Table.from_arrays(columns, names=[f.name for f in out])

    return rows.groupBy("block").cogroup(looked.groupBy("of")).applyInArrow(measured, out)

