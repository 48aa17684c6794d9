"""Packing of documents into windows of tokens next to their lexical neighbours.

Documents are ordered by their two heaviest terms, so that documents on one subject meet in one shard
of the range partitioning; a shard is packed block by block. In a block an inverted index with BM25
weights ranks the unused documents for each seed, and they fill its window in that order. Collection
statistics behind the weights cover all documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tapegrid.llm.subwords import ByteLevel, byte_level
from tapegrid.session import settle

WINDOW = 2_048
END_ID = 1
# Usual constants of BM25.
K1, B = 1.2, 0.75
# Tokens of a shard at most, and at least where the session asks for more partitions.
SHARD_TOKENS = 1 << 25
LEAST_TOKENS = 1 << 20
# A block is full at either of its two bounds.
BLOCK_DOCS = 512
BLOCK_TOKENS = 1 << 21
ROWS_AT_ONCE = 128


def id_type(tokens: ByteLevel) -> type:
    """The narrowest integers that hold every id."""
    return np.uint16 if tokens.size <= 1 << 16 else np.uint32


def ids_of(tokens: ByteLevel, text: str, end: int) -> bytes:
    """Ids of a text and the end id; strings of special tokens in it become their ids."""
    marked = any(special in text for special in tokens.special)
    found = tokens.encode_marked(text) if marked else tokens.encode(text)
    found.append(end)
    return np.array(found, dtype=id_type(tokens)).tobytes()


def tokenised(docs: DataFrame, path: str, end: int) -> DataFrame:
    """``doc_id, ids, n``: ids of every text as little-endian integers of the vocabulary's width."""
    kind = T.StructType(
        [docs.schema["doc_id"], T.StructField("ids", T.BinaryType()), T.StructField("n", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = byte_level(path)
        width = np.dtype(id_type(tokens)).itemsize
        for batch in batches:
            for start in range(0, len(batch), ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                found = [ids_of(tokens, t or "", end) for t in part.column(1).to_pylist()]
                sizes = pa.array([len(ids) // width for ids in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(found, pa.binary()), sizes], names=["doc_id", "ids", "n"]
                )

    return docs.mapInArrow(run, kind)


def distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids in order and how often each occurs; the stable sort of 16-bit ids is a radix sort."""
    line = np.sort(ids, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    return line[starts], np.diff(np.append(starts, len(line)))


def inverse_frequency(tokens: DataFrame, width: type, size: int) -> tuple[np.ndarray, float, int]:
    """Inverse document frequency of every id, mean length and number of tokens of the collection.

    Each task adds its documents into one vector over the vocabulary, and vectors are summed by id:
    what reaches the driver is bounded by the vocabulary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for ids in batch.column(0):
                held[distinct(np.frombuffer(ids.as_buffer(), dtype=width))[0]] += 1
        met = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(held[met])], names=["id", "docs"])

    held = np.zeros(size)
    for r in tokens.select("ids").mapInArrow(run, "id long, docs long").groupBy("id").agg(F.sum("docs")).collect():
        held[r[0]] = r[1]
    n, total = tokens.agg(F.count(F.lit(1)), F.sum("n")).first()
    return np.log1p((n - held + 0.5) / (held + 0.5)), (total or 0) / max(n, 1), total or 0


class Weights:
    """BM25 weight of the terms of a document."""

    def __init__(self, idf: np.ndarray, mean: float):
        self.idf, self.mean = idf, mean

    def terms(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct ids of a document and their weights."""
        terms, often = distinct(ids)
        length = 1 - B + B * len(ids) / self.mean
        return terms, self.idf[terms] * often * (K1 + 1) / (often + K1 * length)

    def key(self, ids: np.ndarray) -> int:
        """Place of a document among all: its two heaviest terms (ties: the smaller id), then a digest."""
        terms, weight = self.terms(ids)
        first = int(np.argmax(weight))
        weight[first] = -1
        second = int(np.argmax(weight))
        digest = zlib.crc32(ids.tobytes()) & ((1 << 23) - 1)
        return int(terms[first]) << 43 | int(terms[second]) << 23 | digest


class Index:
    """Inverted index of a block: per term the documents that hold it, with their weights."""

    def __init__(self, docs: list[tuple[np.ndarray, np.ndarray]]):
        terms = np.concatenate([terms for terms, _ in docs])
        order = np.argsort(terms, kind="stable")
        self.doc = np.repeat(np.arange(len(docs)), [len(terms) for terms, _ in docs])[order]
        self.weight = np.concatenate([w for _, w in docs])[order]
        self.terms, starts = np.unique(terms[order], return_index=True)
        self.borders = np.append(starts, len(order))
        self.size = self.left = len(docs)

    def _drop(self, unused: np.ndarray) -> None:
        """Take used documents out of the postings."""
        stays = unused[self.doc]
        self.borders = np.concatenate([[0], np.cumsum(stays)])[self.borders]
        self.doc, self.weight, self.left = self.doc[stays], self.weight[stays], int(unused.sum())

    def ranked(self, query: np.ndarray, unused: np.ndarray) -> np.ndarray:
        """Unused documents by falling score against the terms of a query; ties by place.

        Postings are cleared of used documents whenever half of them are used.
        """
        if 2 * int(unused.sum()) < self.left:
            self._drop(unused)
        at = np.searchsorted(self.terms, query)
        at = at[self.terms[np.minimum(at, len(self.terms) - 1)] == query]
        spans = list(zip(self.borders[at].tolist(), self.borders[at + 1].tolist(), strict=True))
        docs = np.concatenate([self.doc[i:j] for i, j in spans] or [self.doc[:0]])
        weights = np.concatenate([self.weight[i:j] for i, j in spans] or [self.weight[:0]])
        score = np.bincount(docs, weights, self.size)
        here = np.flatnonzero(unused)
        return here[np.argsort(-score[here], kind="stable")]


class Packer:
    """Fills windows with a seed document and its nearest unused neighbours, block after block.

    A window takes the neighbours that fit whole, nearest first, and then the beginning of the nearest
    one that does not; the rest of that one is the next seed. So every window but the last of a shard
    is full, and that one is divided into sequences whose lengths are powers of two.
    """

    def __init__(self, weights: Weights, window: int, first: int):
        self.weights, self.window, self.sequence = weights, window, first
        self.open: list[tuple[object, np.ndarray, int, int]] = []
        self.filled, self.query = 0, None

    def _emit(self, pieces: list, out: list) -> None:
        offset = 0
        for doc_id, ids, start, length in pieces:
            out.append((doc_id, start, length, len(ids), self.sequence, offset, ids[start : start + length]))
            offset += length
        self.sequence += 1

    def _place(self, doc_id, ids: np.ndarray, query: np.ndarray, out: list) -> None:
        """Put a document into the open window and the windows after it."""
        start = 0
        while start < len(ids):
            length = min(self.window - self.filled, len(ids) - start)
            if not self.open:
                self.query = query
            self.open.append((doc_id, ids, start, length))
            self.filled, start = self.filled + length, start + length
            if self.filled == self.window:
                self._emit(self.open, out)
                self.open, self.filled = [], 0

    def block(self, docs: list[tuple[object, np.ndarray]]) -> list[tuple]:
        """Pieces of the windows that this block closes."""
        out: list[tuple] = []
        terms = [self.weights.terms(ids) for _, ids in docs]
        index = Index(terms)
        lengths = np.array([len(ids) for _, ids in docs])
        unused = np.ones(len(docs), dtype=bool)
        seed = 0
        while True:
            while seed < len(docs) and not unused[seed]:
                seed += 1
            if seed == len(docs):
                return out
            if not self.open:
                unused[seed] = False
                self._place(*docs[seed], terms[seed][0], out)
                continue
            order = index.ranked(self.query, unused)
            sizes, waits = lengths[order], np.ones(len(order), dtype=bool)
            while self.open and waits.any():
                fits = waits & (sizes <= self.window - self.filled)
                pick = int(np.argmax(fits if fits.any() else waits))
                waits[pick] = unused[order[pick]] = False
                self._place(*docs[order[pick]], terms[order[pick]][0], out)
                if not fits.any():
                    break

    def tail(self) -> list[tuple]:
        """Pieces of the last window, cut into powers of two."""
        out: list[tuple] = []
        pieces, part, room = self.open, [], 0
        left = self.filled
        for doc_id, ids, start, length in pieces:
            while length:
                room = room or 1 << (left.bit_length() - 1)
                taken = min(room, length)
                part.append((doc_id, ids, start, taken))
                start, length, left, room = start + taken, length - taken, left - taken, room - taken
                if not room:
                    self._emit(part, out)
                    part = []
        self.open, self.filled = [], 0
        return out


def packed(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
    end: int = END_ID,
) -> DataFrame:
    """Pieces of the sequences: ``doc_id, start, length, doc_tokens, sequence_id, offset, tokens``.

    A document is the ids of its text by the byte-level vocabulary at ``path``, without added special
    tokens, then ``end``. Each id lies in exactly one piece; ``start`` is the number of its document's
    ids before it, ``offset`` its place in the sequence, which has no gap. ``tokens`` are the piece's
    ids, 32-bit little-endian. Sequences hold ``window`` ids, but the last window of a shard is
    divided into powers of two, so nothing is padded.

    A null text is empty: its document is ``end`` alone. Rows that repeat an id, or have none, are
    documents of their own; other columns are ignored; an empty table gives no rows. A task holds one
    block of at most 512 documents and, beyond its last document, two million ids.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    width, size = id_type(byte_level(path)), byte_level(path).size
    tokens = settle(tokenised(source, path, end))
    idf, mean, total = inverse_frequency(tokens, width, size)
    weights = Weights(idf, max(mean, 1.0))
    keyed_type = T.StructType(
        [T.StructField("shard", T.IntegerType()), T.StructField("key", T.LongType()), *tokens.schema.fields[:2]]
    )

    def keyed(rows: DataFrame, borders: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = [weights.key(np.frombuffer(ids.as_buffer(), dtype=width)) for ids in batch.column(1)]
                keys = np.array(keys, dtype=np.int64)
                shard = np.searchsorted(borders, keys).astype(np.int32)
                columns = [pa.array(shard), pa.array(keys), batch.column(0), batch.column(1)]
                yield pa.RecordBatch.from_arrays(columns, names=keyed_type.names)

        return rows.select("doc_id", "ids").mapInArrow(run, keyed_type)

    asked = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, -(-total // SHARD_TOKENS), min(asked, -(-total // LEAST_TOKENS)))
    # Borders of the shards from every sixteenth document by digest; they steer the plan only.
    borders = np.array([], dtype=np.int64)
    if shards > 1:
        some = keyed(tokens.where(F.pmod(F.xxhash64("ids"), F.lit(16)) == 0), borders)
        cuts = [i / shards for i in range(1, shards)]
        found = some.agg(F.percentile_approx("key", cuts, 100 * shards)).first()[0]
        borders = np.array(found or [], dtype=np.int64)

    piece_type = T.StructType(
        [
            tokens.schema["doc_id"],
            *[T.StructField(n, T.LongType()) for n in ("start", "length", "doc_tokens", "sequence_id", "offset")],
            T.StructField("tokens", T.BinaryType()),
        ]
    )
    id_arrow = to_arrow_type(tokens.schema["doc_id"].dataType)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(weights, window, TaskContext.get().partitionId() << 32)
        held, room = [], BLOCK_TOKENS
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append((doc_id, np.frombuffer(ids, dtype=width)))
                room -= len(held[-1][1])
                if len(held) == BLOCK_DOCS or room <= 0:
                    yield from given_out(packer.block(held))
                    held, room = [], BLOCK_TOKENS
        if held:
            yield from given_out(packer.block(held))
        yield from given_out(packer.tail())

    def given_out(pieces: list[tuple]) -> Iterator[pa.RecordBatch]:
        if pieces:
            ids, *numbers, data = zip(*pieces, strict=True)
            columns = [pa.array(ids, id_arrow), *[pa.array(c, pa.int64()) for c in numbers],
                       pa.array([d.astype("<u4").tobytes() for d in data], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=piece_type.names)

    ordered = keyed(tokens, borders).repartitionById(shards, "shard").sortWithinPartitions("key", "doc_id")
    return ordered.select("doc_id", "ids").mapInArrow(pack, piece_type)


def crc32(tokens: Column | str = "tokens") -> Column:
    """Unsigned CRC-32 of the ids of a piece."""
    return F.crc32(tokens)
