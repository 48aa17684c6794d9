"""Boosted trees of all coins, horizons and windows at once, from binned histograms summed in Spark.

Rows are binned once and dealt by blocks of the time line; a block carries the bit set of the windows
that use a row, and the scores of every model so far, so no row is copied per window. A job adds the
residuals of every open node of every model per input and bin, and finds the best split of a node where
its sums meet. A node of few rows (``rows_in_task``) is not summed: its rows meet in one task, which grows
all of the tree below it, so the small nodes of a round are one job. Trees grow best leaf first up to a
number of leaves. The driver holds trees only, whose number is that of the models times rounds.

Residuals are added as whole numbers (``UNIT`` per unit of the label's scale), so the sums, and with them
the trees, do not depend on the order in which Spark adds them.

Every window has two models, trained side by side: ``inner`` on the training rows, whose error in the
validation month says how many rounds are best, and ``refit`` on both. Training of a window stops when
``patience`` rounds in a row brought no better error, or no leaf can be split.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import astuple, dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapegrid.config import ROWS_PER_LEAF_PER_HORIZON_BAR, Study
from tapegrid.functions.columns import all_known, moment
from tapegrid.operators.blocks import order_counts
from tapegrid.operators.fitting import MODEL_KEYS
from tapegrid.operators.folds import (
    Fold,
    horizon_rows,
    monthly_folds,
    role_mask,
    test_rows,
    window_groups,
    window_rows,
)
from tapegrid.operators.walkforward import OUTPUT, prediction_scale
from tapegrid.session import Scratch, settle

UNIT = float(1 << 24)
HELD_SUMS = 512  # node histograms a task holds before it hands them on
INNER, REFIT = 0, 1


@dataclass(frozen=True)
class TreeSettings:
    rounds: int = 2_000
    patience: int = 100
    leaves: int = 15
    step: float = 0.03
    penalty: float = 10.0
    row_share: float = 0.7
    column_share: float = 0.7
    bins: int = 63  # at most 255: a code is one byte
    rows_per_leaf_per_bar: int = ROWS_PER_LEAF_PER_HORIZON_BAR
    rows_per_block: int = 16_384
    rows_in_task: int = 8_192  # nodes up to this size are grown by one task
    state_rounds: int = 10  # rounds between two written states of the scores


def best_round(errors: Sequence[float], patience: int) -> int:
    """Number of rounds with the least error, up to where ``patience`` rounds in a row bring no better."""
    best = 0
    for place, error in enumerate(errors):
        if error < errors[best]:
            best = place
        elif place - best >= patience:
            break
    return best + 1


# ---------------------------------------------------------------- one tree


@dataclass(frozen=True)
class Split:
    gain: float
    column: int
    cut: int
    left_rows: int
    left_sum: float


@dataclass
class Node:
    rows: int
    total: float
    split: Split | None = None
    children: tuple[int, int] | None = None


@dataclass
class Growth:
    """A tree while it grows. Nodes in ``waiting`` have no histogram yet."""

    leaves: int
    least: int
    rows: int = 0  # of the root, or more
    nodes: list[Node] = field(default_factory=list)
    waiting: list[int] = field(default_factory=lambda: [0])

    def __post_init__(self) -> None:
        self.nodes.append(Node(self.rows, 0.0))

    def learn(self, place: int, rows: int, total: float, split: Split | None) -> None:
        self.nodes[place] = Node(rows, total, split)

    def graft(self, place: int, below: Sequence[tuple[int, int, float, Split | None, int | None]]) -> None:
        """A tree that a task grew at ``place``: per node its number, rows, sum, split and first child,
        parents first."""
        at = {0: place}
        for number, rows, total, split, child in below:
            self.learn(at[number], rows, total, split)
            if child is not None:
                first = len(self.nodes)
                self.nodes[at[number]].children = (first, first + 1)
                self.nodes += [Node(0, 0.0), Node(0, 0.0)]
                at |= {child: first, child + 1: first + 1}

    def chosen(self) -> list[int]:
        """Nodes to split, best gain first among the leaves at hand.

        Nodes whose gain is not known yet can only push known ones out, so a node left out here is
        never split, and asking for the children of these alone finds the tree.
        """
        heap = [(-self.nodes[0].split.gain, 0)] if self.nodes[0].split else []
        found = []
        while heap and len(found) < self.leaves - 1:
            _, place = heapq.heappop(heap)
            found.append(place)
            for child in self.nodes[place].children or ():
                if self.nodes[child].split:
                    heapq.heappush(heap, (-self.nodes[child].split.gain, child))
        return found

    def advance(self) -> None:
        """Make the children of chosen nodes, and wait for those large enough to be split."""
        self.waiting = []
        for place in self.chosen():
            node = self.nodes[place]
            if node.children:
                continue
            s = node.split
            first = len(self.nodes)
            node.children = (first, first + 1)
            self.nodes.append(Node(s.left_rows, s.left_sum))
            self.nodes.append(Node(node.rows - s.left_rows, node.total - s.left_sum))
            self.waiting += [c for c in node.children if self.nodes[c].rows >= 2 * self.least]

    def table(self, value: Callable[[Node], float]) -> tuple[np.ndarray, list[int]]:
        """Rows ``column, cut, left, right, value`` over the nodes that are left, and their places."""
        splits = set(self.chosen())
        order = [0]
        for place in order:
            if place in splits and self.nodes[place].children:
                order.extend(self.nodes[place].children)
        at = {place: i for i, place in enumerate(order)}
        table = np.full((5, len(order)), -1.0)
        for i, place in enumerate(order):
            node = self.nodes[place]
            table[4, i] = value(node)
            if place in splits and node.children:
                left, right = node.children
                table[:4, i] = node.split.column, node.split.cut, at[left], at[right]
        return table, order


def leaf_of(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Node every row ends in; ``codes`` has one line per input."""
    column, cut, left, right = table[:4].astype(np.int64)
    row = np.arange(codes.shape[1])
    node = np.zeros(codes.shape[1], dtype=np.int64)
    while True:
        asked = column[node]
        inside = asked >= 0
        if not inside.any():
            return node
        below = codes[np.maximum(asked, 0), row] <= cut[node]
        node = np.where(inside, np.where(below, left[node], right[node]), node)


def added(tables: Iterable[np.ndarray], codes: np.ndarray) -> np.ndarray:
    """Sum of the trees' values per row, in the order of the trees."""
    total = np.zeros(codes.shape[1])
    for table in tables:
        total += table[4][leaf_of(table, codes)]
    return total


def best_split(sums: np.ndarray, counts: np.ndarray, least: int, penalty: float) -> Split | None:
    """Split with the largest gain; ``sums`` and ``counts`` have one line per input and a bin a column.
    Among equal gains the first input and the lowest cut win."""
    left_sum, left_rows = np.cumsum(sums, axis=1) / UNIT, np.cumsum(counts, axis=1)
    total, rows = left_sum[:, -1:], left_rows[:, -1:]
    right_sum, right_rows = total - left_sum, rows - left_rows
    gain = left_sum**2 / (left_rows + penalty) + right_sum**2 / (right_rows + penalty)
    gain -= total**2 / (rows + penalty)
    gain[(left_rows < least) | (right_rows < least)] = -np.inf
    column, cut = np.unravel_index(np.argmax(gain), gain.shape)
    if not gain[column, cut] > 1e-9:
        return None
    place = column, cut
    return Split(float(gain[place]), int(column), int(cut), int(left_rows[place]), float(left_sum[place]))


def grown_below(codes: np.ndarray, change: np.ndarray, columns: Sequence[int], growth: Growth, penalty: float, bins: int) -> Growth:
    """The whole tree below one node, from its rows."""
    width, chosen = bins + 1, list(columns)
    shifted = codes[chosen] + np.arange(len(chosen))[:, None] * width
    inside = {0: np.arange(len(change))}
    while growth.waiting:
        for place in growth.waiting:
            rows = inside[place]
            at, weights = shifted[:, rows].ravel(), np.tile(change[rows], len(chosen))
            sums = np.bincount(at, weights, len(chosen) * width).reshape(-1, width)
            counts = np.bincount(at, minlength=len(chosen) * width).reshape(-1, width)
            split = best_split(sums, counts, growth.least, penalty)
            if split:
                split = replace(split, column=chosen[split.column])
            growth.learn(place, len(rows), float(change[rows].sum() / UNIT), split)
        growth.advance()
        for place in list(inside):
            node = growth.nodes[place]
            if node.children and node.children[0] not in inside:
                below = codes[node.split.column, inside[place]] <= node.split.cut
                inside[node.children[0]], inside[node.children[1]] = inside[place][below], inside[place][~below]
    return growth


# ---------------------------------------------------------------- rows


@dataclass(frozen=True)
class Layout:
    """Places of the models: coin, then horizon, then window, then role."""

    coins: tuple[str, ...]
    horizons: tuple[int, ...]
    windows: tuple[str, ...]
    inputs: tuple[str, ...]

    @property
    def per_horizon(self) -> int:
        return 2 * len(self.windows)

    @property
    def per_coin(self) -> int:
        return len(self.horizons) * self.per_horizon

    def inner_cells(self) -> range:
        return range(INNER, len(self.coins) * self.per_coin, 2)

    def horizon(self, cell: int) -> int:
        return self.horizons[cell % self.per_coin // self.per_horizon]

    def key(self, cell: int) -> tuple[str, int, str]:
        coin, place = divmod(cell, self.per_coin)
        return self.coins[coin], self.horizon(cell), self.windows[place % self.per_horizon // 2]


def early_rows(frame: DataFrame, windows: Sequence[Fold], inputs: Sequence[str]) -> DataFrame:
    """Rows before the validation month of the earliest window, known to every model."""
    first = min(windows, key=lambda f: f.cut)
    time = F.col("open_time")
    known = (time >= moment(first.train_start)) & (time < moment(first.valid_start))
    return frame.where(known & all_known(inputs))


def bin_borders(early: DataFrame, inputs: Sequence[str], bins: int) -> dict[str, list[np.ndarray]]:
    """Per coin and input the exact quantiles that end the bins: at most ``bins`` values each."""
    sides = F.array(
        *[F.struct(F.lit(i).alias("side"), F.col(c).cast("double").alias("value")) for i, c in enumerate(inputs)]
    )
    stacked = early.select("coin", F.explode(sides).alias("_s")).select(
        "coin", F.col("_s.side").alias("side"), F.col("_s.value").alias("value")
    )
    ordered = order_counts(stacked, ["coin", "side"], "value")
    reached = F.floor((F.col("below") + F.col("ties")) * bins / F.col("n"))
    ends = ordered.where(F.floor(F.col("below") * bins / F.col("n")) < reached)
    lists = ends.groupBy("coin", "side").agg(F.sort_array(F.collect_list("value")).alias("borders"))
    found: dict[str, list[np.ndarray]] = {}
    for row in lists.collect():
        found.setdefault(row["coin"], [np.empty(0)] * len(inputs))[row["side"]] = np.array(row["borders"])
    return found


def label_scales(early: DataFrame, horizons: Sequence[int]) -> dict[tuple[str, int], float]:
    """Power of two next to each label's spread; it sets the unit of the whole-number sums only."""
    spreads = early.groupBy("coin").agg(*[F.stddev_pop(f"y_{h}").alias(f"{h}") for h in horizons])
    return {
        (row["coin"], h): 2.0 ** np.ceil(np.log2(row[f"{h}"])) if row[f"{h}"] else 1.0
        for row in spreads.collect()
        for h in horizons
    }


def codes_of(table: pd.DataFrame, inputs: Sequence[str], borders: Sequence[np.ndarray]) -> np.ndarray:
    """Number of borders below each value, one line per input."""
    lines = [np.searchsorted(b, table[c].to_numpy(dtype=float)) for c, b in zip(inputs, borders, strict=True)]
    return np.array(lines, dtype=np.uint8).reshape(len(inputs), len(table))


BLOCK = "coin int, block long, rows int, codes binary, y binary, mask binary, score binary"
BLOCK_NAMES = [c.split()[0] for c in BLOCK.split(",")]


def binned_blocks(
    frame: DataFrame,
    windows: Sequence[Fold],
    layout: Layout,
    study: Study,
    borders: dict[str, list[np.ndarray]],
    scales: dict[tuple[str, int], float],
    rows_per_block: int,
) -> DataFrame:
    """One row per coin and block of the time line: codes, scaled labels, window bits and scores of 0."""
    inputs, horizons, coins = layout.inputs, layout.horizons, layout.coins

    def mask(h: int) -> Column:
        return F.col(f"_mask_{h}")

    for h in horizons:
        dated = frame.withColumn("horizon", F.lit(h)).withColumn("y", F.col(f"y_{h}"))
        frame = dated.withColumn(f"_mask_{h}", role_mask(windows, inputs, study)).drop("horizon", "y")
    used = F.greatest(*[mask(h) for h in horizons], F.lit(0)) != 0
    rows = frame.where(used).select(
        "coin",
        F.floor(F.col("pos") / rows_per_block).alias("_block"),
        "pos",
        *inputs,
        *[F.coalesce(F.col(f"y_{h}"), F.lit(0.0)).alias(f"y_{h}") for h in horizons],
        *[mask(h) for h in horizons],
    )

    def pack(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        coin, block = key
        table = table.sort_values("pos", kind="stable")
        y = np.array([table[f"y_{h}"].to_numpy(dtype=float) / scales[coin, h] for h in horizons])
        masks = np.array([table[f"_mask_{h}"].to_numpy(dtype=np.int64) for h in horizons])
        codes = codes_of(table, inputs, borders[coin])
        score = np.zeros((layout.per_coin, len(table)))
        packed = [part.tobytes() for part in (codes, y, masks, score)]
        return pd.DataFrame([(coins.index(coin), block, len(table), *packed)], columns=BLOCK_NAMES)

    tasks = frame.sparkSession.sparkContext.defaultParallelism
    known = rows.where(F.col("coin").isin(list(borders)))
    return known.groupBy("coin", "_block").applyInPandas(pack, BLOCK).repartition(tasks, "coin", "block")


# ---------------------------------------------------------------- jobs


@dataclass(frozen=True)
class Task:
    """What a job does for one model: trees to add to the stored scores, the tree that grows, the place
    of every node that waits, those whose rows meet in one task, and the inputs to look at."""

    trees: list[np.ndarray]
    growing: np.ndarray | None = None
    slots: np.ndarray | None = None
    names: tuple[int, ...] = ()
    small: frozenset[int] = frozenset()
    columns: tuple[int, ...] = ()
    measured: bool = False


def unpacked(block: dict, horizons: int) -> tuple[np.ndarray, ...]:
    n = block["rows"]
    shapes = (("codes", np.uint8, -1), ("y", float, horizons), ("mask", np.int64, horizons), ("score", float, -1))
    return tuple(np.frombuffer(block[c], dtype=t).reshape(lines, n) for c, t, lines in shapes)


def block_sums(
    block: dict, tasks: dict[int, Task], layout: Layout, bins: int, drawn: np.ndarray | None
) -> Iterator[tuple[int, int, np.ndarray | bytes]]:
    """Model, node and its sums and counts per input and bin, or for a small node the bytes of its rows;
    node -1 has the validation error."""
    codes, y, mask, score = unpacked(block, len(layout.horizons))
    for place in range(layout.per_coin):
        cell = block["coin"] * layout.per_coin + place
        task = tasks.get(cell)
        if task is None:
            continue
        h, bit = divmod(place, layout.per_horizon)
        rows = np.flatnonzero(mask[h] >> (bit | 1) & 1)
        if not len(rows):
            continue
        own = codes[:, rows]
        pred = score[place, rows] + added(task.trees, own)
        residual = y[h, rows] - pred
        fitted = (mask[h, rows] >> bit & 1).astype(bool)
        if task.measured and not fitted.all():
            checked = ~fitted
            squares, fixed = np.rint(residual[checked] ** 2 * UNIT), np.rint(pred[checked] * UNIT)
            yield cell, -1, np.array([squares.sum(), checked.sum(), fixed.min(), fixed.max()], dtype=np.int64)
        if task.growing is None:
            continue
        if drawn is not None:
            fitted &= drawn[rows]
        slot = task.slots[leaf_of(task.growing, own)]
        kept = np.flatnonzero(fitted & (slot >= 0))
        slot, change, width = slot[kept], np.rint(residual[kept] * UNIT), bins + 1
        for i, name in enumerate(task.names):
            if name in task.small:
                mine = slot == i
                if mine.any():
                    yield cell, name, own[:, kept[mine]].tobytes() + change[mine].tobytes()
        if len(task.small) == len(task.names):
            continue
        size = len(task.names) * width
        found = np.zeros((len(task.names), 2, len(layout.inputs), width), dtype=np.int64)
        for column in task.columns:
            at = slot * width + own[column, kept]
            found[:, 0, column] = np.bincount(at, change, size).reshape(-1, width)
            found[:, 1, column] = np.bincount(at, minlength=size).reshape(-1, width)
        for name, vector in zip(task.names, found, strict=True):
            if name not in task.small:
                yield cell, name, vector.ravel()


def rows_of(body: bytes, inputs: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and residuals of the rows a block sent for a small node."""
    n = len(body) // (inputs + 8)
    codes = np.frombuffer(body, dtype=np.uint8, count=inputs * n).reshape(inputs, n)
    return codes, np.frombuffer(body, dtype=float, offset=inputs * n)


def combine(held: dict, key: tuple[int, int], vector: np.ndarray) -> None:
    known = held.get(key)
    if known is None:
        held[key] = vector.copy()
    elif key[1] < 0:
        held[key] = np.array(
            [known[0] + vector[0], known[1] + vector[1], min(known[2], vector[2]), max(known[3], vector[3])]
        )
    else:
        known += vector


SUMS = "cell int, node int, body binary"
SUMS_ARROW = pa.schema([("cell", pa.int32()), ("node", pa.int32()), ("body", pa.binary())])
FOUND = (
    "cell int, node int, rows long, total double, gain double, column int, cut int, left_rows long,"
    " left_sum double, low long, high long, number int, child int"
)
FOUND_NAMES = [c.split()[0] for c in FOUND.split(",")]
SPLIT_NAMES = ("gain", "column", "cut", "left_rows", "left_sum")


class Booster:
    """Trees of all models of one group of windows."""

    def __init__(
        self, scratch: Scratch, blocks: DataFrame, layout: Layout, settings: TreeSettings, seed: int
    ):
        self.scratch, self.layout, self.settings, self.seed = scratch, layout, settings, seed
        self.state, self.path = scratch.replace(blocks, None)
        self.models: dict[int, list[np.ndarray]] = {}
        self.stored = 0  # trees that the stored scores hold
        self.errors: dict[int, list[float]] = {}
        self.spread: dict[int, list[int]] = {}
        self.sizes: dict[int, int] = {}

    def least(self, cell: int) -> int:
        return self.settings.rows_per_leaf_per_bar * self.layout.horizon(cell)

    def run(self, tasks: dict[int, Task], drawn_in: int | None) -> list:
        """Sums of one job, and the best split of every node where they meet."""
        layout, settings, seed = self.layout, self.settings, self.seed
        work = self.scratch.spark.sparkContext.broadcast(tasks)
        least = {cell: self.least(cell) for cell in tasks}

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple[int, int], np.ndarray] = {}
            pieces: list[tuple[int, int, bytes]] = []

            def handed_on() -> pa.RecordBatch:
                rows = [*pieces, *((*key, vector.tobytes()) for key, vector in held.items())]
                held.clear()
                pieces.clear()
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SUMS_ARROW, strict=True)]
                return pa.RecordBatch.from_arrays(columns, schema=SUMS_ARROW)

            for batch in batches:
                for block in batch.to_pylist():
                    drawn = None
                    if drawn_in is not None:
                        keys = (seed, drawn_in, block["coin"], block["block"])
                        drawn = np.random.default_rng(keys).random(block["rows"]) < settings.row_share
                    for cell, node, vector in block_sums(block, work.value, layout, settings.bins, drawn):
                        if isinstance(vector, bytes):
                            pieces.append((cell, node, vector))
                        else:
                            combine(held, (cell, node), vector)
                        if len(held) + len(pieces) >= HELD_SUMS:
                            yield handed_on()
            if held or pieces:
                yield handed_on()

        def splits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[tuple[int, int], np.ndarray] = {}
            pieces: dict[tuple[int, int], list[bytes]] = {}
            for batch in batches:
                for cell, node, body in zip(batch["cell"], batch["node"], batch["body"], strict=True):
                    if node in work.value[cell].small:
                        pieces.setdefault((cell, node), []).append(body)
                    else:
                        combine(held, (cell, node), np.frombuffer(body, dtype=np.int64))
            rows = []
            for (cell, node), bodies in pieces.items():
                parts = [rows_of(body, len(layout.inputs)) for body in bodies]
                codes, change = (np.concatenate(p, axis=-1) for p in zip(*parts, strict=True))
                growth = Growth(settings.leaves, least[cell])
                grown_below(codes, change, work.value[cell].columns, growth, settings.penalty, settings.bins)
                for number, known in enumerate(growth.nodes):
                    parts = astuple(known.split) if known.split else (None,) * 5
                    child = known.children[0] if known.children else None
                    rows.append((cell, node, known.rows, known.total, *parts, None, None, number, child))
            for (cell, node), vector in held.items():
                if node < 0:
                    rows.append((cell, node, vector[1], vector[0] / UNIT, *(None,) * 5, *vector[2:], None, None))
                    continue
                columns = list(work.value[cell].columns)
                totals, counts = vector.reshape(2, len(layout.inputs), -1)[:, columns]
                split = best_split(totals, counts, least[cell], settings.penalty)
                found = (None,) * 5
                if split:
                    found = (split.gain, columns[split.column], split.cut, split.left_rows, split.left_sum)
                rows.append((cell, node, counts[0].sum(), totals[0].sum() / UNIT, *found, *(None,) * 4))
            frame = pd.DataFrame(rows, columns=FOUND_NAMES)
            yield frame.astype({c: "Int64" for c in ("column", "cut", "left_rows", "low", "high", "number", "child")})

        partial = self.state.mapInArrow(sums, SUMS)
        meeting = partial.repartition(self.scratch.spark.sparkContext.defaultParallelism, "cell", "node")
        found = meeting.mapInPandas(splits, FOUND).collect()
        work.unpersist()
        return found

    def store(self) -> None:
        """Write the scores with all trees so far, so that a job adds a few trees only."""
        layout, since = self.layout, self.stored
        recent = {cell: trees[since:] for cell, trees in self.models.items()}
        work = self.scratch.spark.sparkContext.broadcast(recent)

        def with_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                scores = []
                for block in batch.to_pylist():
                    codes, _, _, score = unpacked(block, len(layout.horizons))
                    score = score.copy()
                    for place in range(layout.per_coin):
                        for tree in work.value.get(block["coin"] * layout.per_coin + place, ()):
                            score[place] += tree[4][leaf_of(tree, codes)]
                    scores.append(score.tobytes())
                at = batch.schema.get_field_index("score")
                yield batch.set_column(at, batch.schema.field(at), pa.array(scores, batch.schema.field(at).type))

        self.state, self.path = self.scratch.replace(self.state.mapInArrow(with_trees, BLOCK), self.path)
        self.stored = max(map(len, self.models.values()))

    def columns_of(self, cell: int, made: int) -> tuple[int, ...]:
        size = len(self.layout.inputs)
        drawn = np.random.default_rng((self.seed, made, cell)).permutation(size)
        return tuple(sorted(drawn[: max(1, round(self.settings.column_share * size))].tolist()))

    def start(self) -> set[int]:
        """Every model begins with the mean label of its rows; returns the windows that have both."""
        root = Growth(2, 1).table(lambda node: 0.0)[0]
        every = {
            cell + role: Task([], root, np.zeros(1, dtype=np.int64), (0,), columns=(0,))
            for cell in self.layout.inner_cells()
            for role in (INNER, REFIT)
        }
        for row in self.run(every, None):
            if row["rows"]:
                table = root.copy()
                table[4, 0] = row["total"] / row["rows"]
                self.sizes[row["cell"]] = row["rows"]
                self.models[row["cell"]] = [table]
        return {c for c in self.layout.inner_cells() if c in self.models and c + REFIT in self.models}

    def train(self) -> None:
        s = self.settings
        going = self.start()
        closed: set[int] = set()  # refit models that cannot be split any more
        for made in range(s.rounds + 1):
            if not going:
                return
            if made and made % s.state_rounds == 0:
                self.store()
            growing = {
                cell: Growth(s.leaves, self.least(cell), self.sizes[cell])
                for c in going
                for cell in (c, c + REFIT)
                if cell not in closed
            }
            columns = {cell: self.columns_of(cell, made) for cell in growing}
            first = True
            while growing and any(g.waiting for g in growing.values()):
                found = self.run(self.tasks(growing, columns, measured=first and made > 0, last=made == s.rounds), made)
                if first:
                    for cell in self.judged(going, found, made):
                        going.discard(cell)
                        growing.pop(cell, None)
                        growing.pop(cell + REFIT, None)
                    if made == s.rounds:
                        return
                first = False
                below: dict[tuple[int, int], list] = {}
                for row in found:
                    if row["node"] >= 0 and row["cell"] in growing:
                        split = None if row["gain"] is None else Split(*(row[n] for n in SPLIT_NAMES))
                        known = (row["number"] or 0, row["rows"], row["total"], split, row["child"])
                        below.setdefault((row["cell"], row["node"]), []).append(known)
                for (cell, node), known in below.items():
                    growing[cell].graft(node, sorted(known, key=lambda k: k[0]))
                for growth in growing.values():
                    growth.advance()
            for cell, growth in growing.items():
                table, order = growth.table(lambda node: s.step * node.total / (node.rows + s.penalty))
                if len(order) > 1:
                    self.models[cell].append(table)
                elif cell % 2 == INNER:
                    going.discard(cell)
                else:
                    closed.add(cell)

    def tasks(self, growing: dict[int, Growth], columns: dict, measured: bool, last: bool) -> dict[int, Task]:
        made = {}
        for cell, growth in growing.items():
            trees = self.models[cell][self.stored :]
            inner = measured and cell % 2 == INNER
            if last:
                made[cell] = Task(trees, columns=columns[cell], measured=inner)
            elif growth.waiting:
                table, order = growth.table(lambda node: 0.0)
                at = {place: i for i, place in enumerate(order)}
                slots = np.full(len(order), -1, dtype=np.int64)
                for i, place in enumerate(growth.waiting):
                    slots[at[place]] = i
                small = frozenset(p for p in growth.waiting if growth.nodes[p].rows <= self.settings.rows_in_task)
                made[cell] = Task(trees, table, slots, tuple(growth.waiting), small, columns[cell], inner)
        return made

    def judged(self, going: set[int], found: Sequence, made: int) -> set[int]:
        """Windows whose training ends: no validation row, or too many rounds without a better error."""
        if not made:
            return set()
        measured = {row["cell"]: row for row in found if row["node"] < 0}
        ended = going - set(measured)
        for cell in going & set(measured):
            row = measured[cell]
            errors = self.errors.setdefault(cell, [])
            errors.append(row["total"] / row["rows"])
            self.spread.setdefault(cell, []).append(row["high"] - row["low"])
            if len(errors) - best_round(errors, self.settings.patience) >= self.settings.patience:
                ended.add(cell)
        return ended

    def result(self) -> dict[tuple[str, int, str], tuple[list[np.ndarray], list[np.ndarray], int]]:
        """Per model key the trees of both models up to the best round, and its number: 0 where the inner
        model predicts the same for all rows of the validation month."""
        found = {}
        for cell in self.layout.inner_cells():
            if cell not in self.models or cell + REFIT not in self.models:
                continue
            errors = self.errors.get(cell, [])
            best = best_round(errors, self.settings.patience) if errors else 0
            if best and not self.spread[cell][best - 1]:
                best = 0
            inner, refit = (self.models[cell + role][: best + 1] for role in (INNER, REFIT))
            found[self.layout.key(cell)] = (inner, refit, best)
        return found


# ---------------------------------------------------------------- predictions


def trees_out_of_sample(
    frame: DataFrame,
    study: Study,
    inputs: Sequence[str],
    policy: str,
    months: Sequence[str],
    end: str,
    horizons: Sequence[int] | None = None,
    coins: Sequence[str] | None = None,
    settings: TreeSettings = TreeSettings(),
) -> DataFrame:
    """Predictions of the test months with the same columns as the other families."""
    horizons, coins, inputs = tuple(horizons or study.horizons), tuple(coins or study.targets), tuple(inputs)
    frame = frame.where(F.col("coin").isin(list(coins)))
    folds = monthly_folds(months, study, policy)
    groups = window_groups(folds)
    early = early_rows(frame, [f for g in groups for f in g], inputs)
    borders = bin_borders(early, inputs, settings.bins)
    scales = label_scales(early, horizons)
    models: dict = {}
    with Scratch(frame.sparkSession) as scratch:
        for windows in groups:
            layout = Layout(coins, horizons, tuple(f.window for f in windows), inputs)
            blocks = binned_blocks(frame, windows, layout, study, borders, scales, settings.rows_per_block)
            booster = Booster(scratch, blocks, layout, settings, study.seed)
            booster.train()
            models |= booster.result()
    return predicted(frame, study, inputs, folds, end, horizons, models, borders, scales)


def predicted(
    frame: DataFrame,
    study: Study,
    inputs: tuple[str, ...],
    folds: Sequence[Fold],
    end: str,
    horizons: tuple[int, ...],
    models: dict,
    borders: dict[str, list[np.ndarray]],
    scales: dict[tuple[str, int], float],
) -> DataFrame:
    spark = frame.sparkSession
    rows = horizon_rows(frame, inputs, horizons)
    held = spark.sparkContext.broadcast(models)

    def apply(table: DataFrame, kept: Sequence[str], names: Sequence[str]) -> DataFrame:
        """``kept`` columns, and the predictions of the models ``names`` (both models are there)."""
        fields = [table.schema[c] for c in kept]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for key, part in batch.groupby(MODEL_KEYS, sort=False):
                    if key not in held.value:
                        continue
                    codes = codes_of(part, inputs, borders[key[0]])
                    out = part[list(kept)].copy()
                    for name in names:
                        trees = held.value[key][("inner_pred", "pred").index(name)]
                        out[name] = added(trees, codes) * scales[key[0], key[1]]
                    yield out

        schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in fields], *[f"{n} double" for n in names]])
        found = table.select(*kept, *[c for c in inputs if c not in kept]).mapInPandas(run, schema)
        # pandas holds a missing return as NaN
        return found.withColumn("fwd_logret", F.when(~F.isnan("fwd_logret"), F.col("fwd_logret")))

    month = window_rows(rows, folds, inputs, study).where("threshold")
    scored = apply(month, [*MODEL_KEYS, "valid", "fwd_logret"], ["pred", "inner_pred"])
    scored = scored.withColumn("inner_pred", F.when(F.col("valid"), F.col("inner_pred")))
    notes = [(*key, f"trees={best}") for key, (_, _, best) in models.items()]
    setting = spark.createDataFrame(notes, "coin string, horizon int, window string, setting string")
    levels = settle(prediction_scale(scored).join(setting, MODEL_KEYS, "left"))
    tested = apply(
        test_rows(rows, folds, inputs, study, end),
        [*MODEL_KEYS, "pos", "open_time", "y", "fwd_logret", "test_month"],
        ["pred"],
    )
    return tested.join(levels, MODEL_KEYS).select("coin", "horizon", "pos", "open_time", *OUTPUT)
