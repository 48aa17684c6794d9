"""Near copies by shared word shingles: MinHash candidates, each verified by its exact similarity."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapegrid.llm.components import components
from tapegrid.llm.text import utf8
from tapegrid.session import settle

WIDTH = 5
# Similarity from which on two texts are near copies, as a fraction.
ALIKE = (4, 5)
# A pair at similarity 0.8 shares one band of eight of 32 with probability 0.997.
BANDS, ROWS = 32, 8
SEED = 42
SLICE = 1 << 12
# Words of 64 bits in the parity sketch of a set.
SKETCH = 8
_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS), dtype=np.uint64)
MASKS, FACTORS = _DRAWN[0], _DRAWN[1] | np.uint64(1)


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text; a shorter text is one shingle."""
    words = text.lower().split()
    if not words:
        return np.array([], dtype=np.uint64)
    width = min(WIDTH, len(words))
    n = len(words) - width + 1
    joined = map(b" ".join, zip(*[words[i : i + n] for i in range(width)], strict=True))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(SEED)), np.uint64, n))


def band_keys(shingles: np.ndarray) -> list[int]:
    """One signed key per band; none for an empty set."""
    if not len(shingles):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(shingles), SLICE):
        part = (shingles[start : start + SLICE, None] ^ MASKS) * FACTORS
        least = np.minimum(least, part.min(axis=0))
    return [
        xxhash.xxh64_intdigest(row.tobytes(), band) - (1 << 63)
        for band, row in enumerate(least.reshape(BANDS, ROWS))
    ]


def _per_text(docs: DataFrame, name: str) -> DataFrame:
    """``doc_id`` and an array of longs: the band keys or the shingles of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = map(shingle_set, utf8(batch.column(1)))
            found = [band_keys(s) if name == "keys" else s.view(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", name]
            )

    schema = T.StructType([docs.schema["doc_id"], T.StructField(name, T.ArrayType(T.LongType()))])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _verified() -> Column:
    """Whether the sets ``a`` and ``b`` of a pair are alike."""
    shared = F.size(F.array_intersect("a", "b"))
    return shared * ALIKE[1] >= (F.size("a") + F.size("b") - shared) * ALIKE[0]


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``u, v`` whose sets are alike."""
    return settle(
        pairs.join(sets.select(F.col("doc_id").alias("v"), F.col("shingles").alias("b")), "v")
        .join(sets.select(F.col("doc_id").alias("u"), F.col("shingles").alias("a")), "u")
        .where(_verified())
        .select("u", "v")
    )


def with_groups(ids: DataFrame, links: DataFrame) -> DataFrame:
    """``ids`` with the component of each ``doc_id`` as ``group``."""
    roots = components(links).withColumnRenamed("node", "doc_id")
    return ids.join(roots, "doc_id", "left").withColumn("group", F.coalesce("root", "doc_id")).drop("root")


def prefix_pairs(sets: DataFrame) -> DataFrame:
    """Pairs ``u, v`` of different groups that may be alike, from ``doc_id, group, shingles``; no alike
    pair is missing.

    Shingles are ordered by the number of sets that hold them, rare ones first. Two sets of sizes up
    to n with a similarity of 0.8 share one of their first n - ceil(0.8 n) + 1 shingles. So texts that
    have but a common passage in common hardly meet. Where many texts of one group hold a shingle,
    only the texts of other groups look up its holders: of two texts of different groups, one is
    outside the largest group.

    A meeting counts only if the pair can still be alike, so that many texts with half their shingles
    in common do not make all their pairs. At the first shared shingle all that is shared lies from
    its places on. And the sketch of a set has a bit per hash value, set where an odd number of its
    shingles have it: sketches of two sets differ in no more bits than the sets do in shingles.
    """
    rows = sets.select("doc_id", "group", F.size("shingles").alias("size"), F.explode("shingles").alias("shingle"))
    held = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    bit = F.expr("shiftleft(1L, cast(shingle & 63 as int))")
    word = F.shiftright("shingle", 6).bitwiseAND(F.lit(SKETCH - 1))
    ordered = (
        rows.join(held, "shingle")
        .groupBy("doc_id", "group", "size")
        .agg(
            F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("line"),
            *[F.coalesce(F.bit_xor(F.when(word == i, bit)), F.lit(0)).alias(f"s{i}") for i in range(SKETCH)],
        )
    )
    first = F.col("size") - F.ceil(F.col("size") * ALIKE[0] / ALIKE[1]).cast("int") + 1
    sketch = [f"s{i}" for i in range(SKETCH)]
    postings = settle(
        ordered.select("doc_id", "group", "size", *sketch, F.posexplode(F.slice("line", F.lit(1), first)))
        .where("col.n > 1")
        .select("doc_id", "group", "size", "pos", *sketch, F.col("col.shingle").alias("shingle"))
    )
    per_group = postings.groupBy("shingle", "group").agg(F.count(F.lit(1)).alias("n"))
    largest = per_group.groupBy("shingle").agg(
        F.max(F.struct("n", "group"))["group"].alias("largest"), F.count(F.lit(1)).alias("groups")
    )
    asking = postings.join(largest.where("groups > 1"), "shingle").where("group <> largest")
    asking = asking.select(
        "shingle", F.col("doc_id").alias("a"), F.col("group").alias("g"), F.col("size").alias("m"),
        F.col("pos").alias("at"), *[F.col(n).alias(f"a{n}") for n in sketch],
    )
    near = F.least("size", "m") * ALIKE[1] >= F.greatest("size", "m") * ALIKE[0]
    both = F.col("size") + F.col("m")
    # Of sets alike, what is shared is this part of both sizes at least.
    needed = F.ceil(both * ALIKE[0] / sum(ALIKE))
    ahead = F.least(F.col("size") - F.col("pos"), F.col("m") - F.col("at")) >= needed
    unlike = sum((F.bit_count(F.col(n).bitwiseXOR(F.col(f"a{n}"))) for n in sketch), F.lit(0))
    alike = near & ahead & (unlike <= both - 2 * needed)
    met = asking.join(postings, "shingle").where((F.col("group") != F.col("g")) & alike)
    return settle(met.select(F.least("a", "doc_id").alias("u"), F.greatest("a", "doc_id").alias("v")).distinct())


def near_links(docs: DataFrame) -> DataFrame:
    """Links ``u, v`` that connect the texts of ``doc_id, text`` that are alike and share a band.

    Every text is first held against the smallest id of its bucket; a dense group is settled by
    that alone. The texts of buckets that then still hold several groups are joined with each other
    by their rare shingles, so that a text which is alike to an absorbed one only is linked as well.
    Everything is a join or an aggregation; no bucket is one task's work.
    """
    keys = settle(_per_text(docs, "keys")).select("doc_id", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("u"))
    shared = shared.where(F.col("n") > 1).select("key", "u")
    met = settle(keys.join(shared, "key").where(F.col("doc_id") != F.col("u")).withColumnRenamed("doc_id", "v"))
    pairs = settle(met.select("u", "v").distinct())
    ends = settle(pairs.select(F.col("u").alias("doc_id")).union(pairs.select("v")).distinct())
    sets = settle(_per_text(docs.join(ends, "doc_id", "left_semi"), "shingles").dropDuplicates(["doc_id"]))
    links = _linked(pairs, sets)
    groups = settle(with_groups(ends, links))
    named = met.select("key", "u", F.col("v").alias("doc_id")).join(groups, "doc_id")
    heads = groups.select(F.col("doc_id").alias("u"), F.col("group").alias("head"))
    open_keys = named.join(heads, "u").where("group <> head").select("key").distinct()
    members = met.join(open_keys, "key", "left_semi")
    open_ids = members.select(F.col("u").alias("doc_id")).union(members.select("v")).distinct()
    open_sets = settle(open_ids.join(groups, "doc_id").join(sets, "doc_id"))
    return links.unionByName(_linked(prefix_pairs(open_sets), sets))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its linked texts, all columns kept.

    Texts link when the Jaccard similarity of their sets of five-word shingles is 0.8 or more.
    Wordless texts and null ids stay. Rows that repeat an id are one document.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    roots = settle(components(near_links(texts.where(F.col("doc_id").isNotNull()))))
    first = roots.groupBy("root").agg(F.least(F.min("node"), F.min("root")).alias("first"))
    dropped = (
        roots.join(first, "root")
        .where(F.col("node") != F.col("first"))
        .select(F.col("node").alias(id_col))
    )
    return docs.join(settle(dropped.distinct()), id_col, "left_anti")
