"""SimHash near-duplicates: fingerprints, and links by the generalised pigeonhole principle."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapegrid.llm.components import components
from tapegrid.llm.text import utf8
from tapegrid.session import settle

BITS = 64
SEED = 42
# A probe row costs about as much as so many verified candidates.
PROBE_COST = 4.0
SLICE = 1 << 16


def fingerprint(text: bytes, width: int = 3) -> int:
    """Unsigned 64-bit SimHash of one text; 0 where it has no word."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = iter([b" ".join(words)])
        n = 1
    else:
        n = len(words) - width + 1
        shingles = map(b" ".join, zip(*[words[i : i + n] for i in range(width)], strict=True))
    ones = np.zeros(BITS, dtype=np.int64)
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(SEED))
    for start in range(0, n, SLICE):
        part = np.fromiter(hashes, dtype=np.uint64, count=min(SLICE, n - start))
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, bits``: one row per row of ``docs``, the fingerprint as a signed long.

    Null and wordless texts get 0. Only id and text reach Python.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter(map(fingerprint, utf8(batch.column(1))), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "bits"]
            )

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([source.schema["doc_id"], T.StructField("bits", T.LongType())])
    return source.mapInArrow(run, schema)


def hex_digits(bits: str = "bits"):
    return F.lower(F.lpad(F.hex(F.col(bits)), 16, "0"))


# --- parts of correlated bits ---------------------------------------------------------------------


def _spread(values: np.ndarray) -> np.ndarray:
    """Rows of 64 zeros and ones, most significant bit first."""
    return np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def bit_moments(classes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the 64 x 64 sums of bit products, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for start in range(0, len(values), SLICE):
                rows = _spread(values[start : start + SLICE]).astype(np.float32)
                total += rows.T @ rows
            n += len(values)
        if n:
            cells = pa.array(np.arange(BITS * BITS + 1))
            sums = pa.array(np.append(total.ravel(), float(n)))
            yield pa.RecordBatch.from_arrays([cells, sums], names=["cell", "part"])

    sums = (
        classes.select("bits")
        .mapInArrow(run, "cell long, part double")
        .groupBy("cell")
        .agg(F.sum("part").alias("total"))
        .collect()
    )
    cells = np.zeros(BITS * BITS + 1)
    for row in sums:
        cells[row["cell"]] = row["total"]
    return int(cells[-1]), cells[:-1].reshape(BITS, BITS)


def group_bits(n: int, products: np.ndarray, parts: int) -> list[list[int]]:
    """Cut the 64 bit numbers into ``parts`` groups, each of the bits that vary together.

    A group starts from the free bit with the largest summed correlation and takes the bit closest
    to its members until it is full.
    """
    mean = np.diag(products) / max(n, 1)
    deviation = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    near = np.abs(products / max(n, 1) - np.outer(mean, mean)) / np.outer(deviation, deviation)
    np.fill_diagonal(near, 0)
    free, groups = list(range(BITS)), []
    for width in [len(x) for x in np.array_split(np.arange(BITS), parts)]:
        seed = max(free, key=lambda b: (near[b, free].sum(), -b))
        members = [seed]
        free.remove(seed)
        while len(members) < width:
            closest = max(free, key=lambda b: (near[b, members].sum(), -b))
            members.append(closest)
            free.remove(closest)
        groups.append(sorted(members))
    return groups


def mask_of(bits: Sequence[int]) -> int:
    """Mask of bit numbers counted from the most significant one."""
    return sum(1 << (BITS - 1 - b) for b in bits)


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >= 1 << (BITS - 1) else value


# --- thresholds -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Parts:
    """Groups of bits, and what a probe of each part is expected to find.

    ``expected[i][r]`` is an array over the values of the first ``keyed[i]`` bits of part ``i``: the
    estimated number of fingerprints within ``r`` bits of that value in the part.
    """

    groups: list[list[int]]
    keyed: list[list[int]]
    expected: list[np.ndarray]
    distance: int

    @property
    def masks(self) -> list[int]:
        return [mask_of(g) for g in self.groups]


HISTOGRAM_BITS = 16


def _compact(values: np.ndarray, bits: Sequence[int]) -> np.ndarray:
    out = np.zeros(len(values), dtype=np.int64)
    for b in bits:
        out = (out << 1) | ((values >> np.uint64(BITS - 1 - b)) & np.uint64(1)).astype(np.int64)
    return out


def _ball(histogram: np.ndarray, bits: int, distance: int) -> np.ndarray:
    """Sums of the histogram over Hamming balls of radius 0..distance around every value."""
    values = np.arange(len(histogram))
    out, total = [], np.zeros(len(histogram))
    for radius in range(distance + 1):
        for flipped in combinations(range(bits), min(radius, bits + 1)):
            total = total + histogram[values ^ sum(1 << b for b in flipped)]
        out.append(total)
    return np.stack(out)


def plan_parts(classes: DataFrame, distance: int, parts: int) -> Parts:
    """Group the bits by correlation and estimate candidate counts from value histograms.

    A histogram has at most 2^16 cells per part, however many fingerprints there are; for wider
    parts it covers the first 16 bits and the counts are scaled down.
    """
    n, products = bit_moments(classes)
    groups = group_bits(n, products, parts)
    keyed = [g[:HISTOGRAM_BITS] for g in groups]
    sides = [
        F.struct(
            F.lit(i).alias("part"),
            F.col("bits").bitwiseAND(F.lit(_signed(mask_of(k)))).alias("value"),
        )
        for i, k in enumerate(keyed)
    ]
    cells = (
        classes.select(F.explode(F.array(*sides)).alias("c"))
        .groupBy("c.part", "c.value")
        .agg(F.count(F.lit(1)).alias("n"))
        .toPandas()
    )
    expected = []
    for i, bits in enumerate(keyed):
        own = cells[cells["part"] == i]
        histogram = np.zeros(1 << len(bits))
        places = _compact(own["value"].to_numpy(np.int64).view(np.uint64), bits)
        histogram[places] = own["n"].to_numpy()
        scale = 0.5 ** (len(groups[i]) - len(bits))
        expected.append((_ball(histogram, len(bits), distance) * scale).astype(np.float32))
    return Parts(groups, keyed, expected, distance)


def allocate(values: np.ndarray, plan: Parts) -> np.ndarray:
    """Thresholds per fingerprint and part, -1 where a part is not probed.

    Two fingerprints within ``distance`` bits are within ``t[i]`` bits in some part ``i`` whenever
    the thresholds add up to ``distance - parts + 1``. With ``u = t + 1`` that is a budget of
    ``distance + 1`` units; dynamic programming over the parts spends it where the estimated
    candidates and the probes are fewest.
    """
    units, n = plan.distance + 1, len(values)
    best = np.full((n, units + 1), np.inf)
    best[:, 0] = 0
    choices = []
    for i, group in enumerate(plan.groups):
        places = _compact(values, plan.keyed[i])
        probes = np.cumsum([_choose(len(group), r) for r in range(units)])
        cost = np.concatenate(
            [np.zeros((1, n)), plan.expected[i][:, places] + PROBE_COST * probes[:, None]]
        )
        new = np.full((n, units + 1), np.inf)
        choice = np.zeros((n, units + 1), dtype=np.int64)
        for total in range(units + 1):
            for u in range(total + 1):
                with_u = best[:, total - u] + cost[u]
                better = with_u < new[:, total]
                new[better, total] = with_u[better]
                choice[better, total] = u
        best = new
        choices.append(choice)
    thresholds = np.zeros((n, len(plan.groups)), dtype=np.int64)
    left = np.full(n, units)
    for i in reversed(range(len(plan.groups))):
        spent = choices[i][np.arange(n), left]
        thresholds[:, i] = spent - 1
        left = left - spent
    return thresholds


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


def bucket_rows(classes: DataFrame, plan: Parts) -> DataFrame:
    """``mask, value, bits``: every fingerprint under its own part values, and under its probes."""
    masks = np.array(plan.masks, dtype=np.uint64)
    flips = [
        [
            np.array([mask_of(c) for c in combinations(group, r)], dtype=np.uint64)
            for r in range(plan.distance + 1)
        ]
        for group in plan.groups
    ]
    shared = classes.sparkSession.sparkContext.broadcast((plan, masks, flips))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, masks, flips = shared.value

        def rows(part: int, value: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
            mask = np.full(len(bits), masks[part])
            arrays = [pa.array(x.view(np.int64)) for x in (mask, value, bits)]
            return pa.RecordBatch.from_arrays(arrays, names=["mask", "value", "bits"])

        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for start in range(0, len(every), 1 << 13):
                values = every[start : start + (1 << 13)]
                thresholds = allocate(values, plan)
                for part in range(len(masks)):
                    yield rows(part, values & masks[part], values)
                    for radius in range(1, plan.distance + 1):
                        probing = values[thresholds[:, part] >= radius]
                        if len(probing):
                            places = (probing & masks[part])[:, None] ^ flips[part][radius]
                            spread = np.repeat(probing, places.shape[1])
                            yield rows(part, places.ravel(), spread)

    return classes.select("bits").mapInArrow(run, "mask long, value long, bits long")


# --- buckets --------------------------------------------------------------------------------------


def refined(rows: DataFrame) -> DataFrame:
    """Rows of overfull buckets under longer keys.

    The bits outside a bucket's mask fall into four groups; a pair of the bucket that differs in at
    most three bits agrees in one of them, so each row goes to four narrower buckets and no pair is
    lost.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask, value, bits = (
                c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns
            )
            for one in np.unique(mask):
                free = [b for b in range(BITS) if not int(one) >> (BITS - 1 - b) & 1]
                own = mask == one
                for part in np.array_split(np.array(free), 4):
                    more = np.uint64(mask_of([int(b) for b in part]))
                    arrays = (np.full(own.sum(), one | more), value[own] | bits[own] & more, bits[own])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x.view(np.int64)) for x in arrays],
                        names=["mask", "value", "bits"],
                    )

    return rows.select("mask", "value", "bits").mapInArrow(run, "mask long, value long, bits long")


def within(bits: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside one bucket, as positions of parent and child.

    Breadth first over what is not reached yet: a dense group is absorbed by its first members, so
    neither the work nor the output is the square of its size.
    """
    left = np.arange(len(bits))
    parents, children = [], []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            one = front.pop()
            near = np.bitwise_count(bits[left] ^ bits[one]) <= distance
            if near.any():
                reached = left[near]
                parents.append(np.full(len(reached), one))
                children.append(reached)
                front.extend(reached)
                left = left[~near]
    if not parents:
        return np.array([], dtype=np.int64), np.array([], dtype=np.int64)
    return np.concatenate(parents), np.concatenate(children)


def bucket_links(rows: DataFrame, distance: int) -> DataFrame:
    """Verified links ``u, v`` of all buckets: at most one per member of a bucket."""

    def links_of(
        mask: np.ndarray, value: np.ndarray, bits: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Links of a run of whole buckets, sorted by key and then by fingerprint."""
        fresh = np.ones(len(bits), dtype=bool)
        fresh[1:] = (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])
        starts = np.flatnonzero(fresh)
        sizes = np.diff(np.append(starts, len(bits)))
        us, vs = [], []
        # Small buckets together: compare each row with the next ones of its bucket.
        small = np.repeat(sizes <= 32, sizes)
        place = np.repeat(np.arange(len(starts)), sizes)
        for step in range(1, int(sizes[sizes <= 32].max(initial=1))):
            same = (place[step:] == place[:-step]) & small[step:]
            at = np.flatnonzero(same)
            near = np.bitwise_count(bits[at] ^ bits[at + step]) <= distance
            us.append(bits[at[near]])
            vs.append(bits[at[near] + step])
        for start, size in zip(starts[sizes > 32], sizes[sizes > 32], strict=True):
            own = np.unique(bits[start : start + size])
            a, b = within(own, distance)
            us.append(own[a])
            vs.append(own[b])
        u = np.concatenate(us) if us else np.array([], dtype=np.uint64)
        v = np.concatenate(vs) if vs else np.array([], dtype=np.uint64)
        other = u != v
        return u[other], v[other]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.array([], dtype=np.uint64)] * 3

        def out(columns: list[np.ndarray]) -> pa.RecordBatch:
            u, v = links_of(*columns)
            return pa.RecordBatch.from_arrays(
                [pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"]
            )

        for batch in batches:
            fresh = [c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns]
            held = [np.concatenate([a, b]) for a, b in zip(held, fresh, strict=True)]
            mask, value, _ = held
            if len(mask) < SLICE:
                continue
            open_key = (mask == mask[-1]) & (value == value[-1])  # may go on in the next batch
            done = int(np.argmax(open_key))
            if done:
                yield out([c[:done] for c in held])
                held = [c[done:] for c in held]
        if len(held[0]):
            yield out(held)

    placed = rows.repartition("mask", "value").sortWithinPartitions("mask", "value", "bits")
    return placed.select("mask", "value", "bits").mapInArrow(run, "u long, v long")


def near_links(
    classes: DataFrame, distance: int = 3, parts: int | None = None, bucket_limit: int = 50_000
) -> DataFrame:
    """Links that connect every two fingerprints within ``distance`` (at most 3) bits.

    ``parts`` (default by the number of fingerprints: four, three or two) sets the key width, not
    the answer. Buckets of more than ``bucket_limit`` rows are cut by longer keys until they fit or
    hold no more than 12 free bits.
    """
    if distance > 3:
        raise ValueError("longer keys for overfull buckets need a distance of 3 or less")
    if parts is None:
        n = classes.count()
        parts = 4 if n <= 1 << 22 else 3 if n <= 1 << 27 else 2
    plan = plan_parts(classes, distance, parts)
    rows, links = settle(bucket_rows(classes, plan)), None
    while True:
        full = (
            rows.groupBy("mask", "value")
            .agg(F.count(F.lit(1)).alias("n"))
            .where((F.col("n") > bucket_limit) & (F.bit_count("mask") < BITS - 12))
            .select("mask", "value")
        )
        full = settle(full)
        key = ["mask", "value"]
        done = full.isEmpty()
        fitting = rows if done else rows.join(full, key, "left_anti")
        found = bucket_links(fitting, distance)
        links = found if links is None else links.unionByName(found)
        if done:
            return links
        rows = settle(refined(rows.join(full, key, "left_semi")))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    distance: int = 3,
    parts: int | None = None,
    bucket_limit: int = 50_000,
) -> DataFrame:
    """``doc_id, bits, component_id``, one row per row of ``docs``.

    Fingerprints that differ in at most ``distance`` bits link; ``component_id`` is the smallest id
    that can be reached. Equal fingerprints are one class, so copies never meet in pairs. Null and
    wordless texts share fingerprint 0 and link like any other. A null id is kept and never chosen
    as ``component_id`` unless the component has no other. Columns besides id and text are ignored.
    """
    marks = settle(fingerprints(docs, id_col, text_col))
    classes = settle(marks.groupBy("bits").agg(F.min("doc_id").alias("first")))
    roots = components(near_links(classes, distance, parts, bucket_limit))
    roots = settle(roots.withColumnRenamed("node", "bits"))
    placed = classes.join(roots, "bits", "left").withColumn("root", F.coalesce("root", "bits"))
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    answer = placed.join(smallest, "root").select("bits", "component_id")
    return marks.join(answer, "bits").select("doc_id", "bits", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, all columns kept.

    Rows that repeat an id are one document: they stay or go together.
    """
    dropped = (
        near_duplicates(docs, id_col, text_col)
        .where(F.col("doc_id") != F.col("component_id"))
        .select(F.col("doc_id").alias(id_col))
        .distinct()
    )
    return docs.join(settle(dropped), id_col, "left_anti")
