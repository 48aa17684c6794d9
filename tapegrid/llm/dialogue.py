"""Cheapest repair of conversations to alternating turns, by block tables of cost vectors.

A conversation is a string over nine symbols (who speaks, whether the text is cut off, or that the row
must go). The cheapest repair is a path through four states; its cost to the end is a vector of four
numbers, and vectors that differ by a constant behave alike. So few normalised vectors occur, and for
each of them and each block of four symbols the next vector and the added constant are looked up in a
table made once. Rows are sorted over range partitions; a conversation inside one partition is solved
there, one that goes across borders is composed from its segments, however long it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tapegrid.session import settle

DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
# States: nothing yet, after the system row, after a user row, after a complete pair.
NOTHING, SYSTEM, USER, PAIR = range(4)
# The only row each state can be continued with by an inserted or renamed row.
NEXT = np.array([USER, USER, PAIR, USER])
KEEPS = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): PAIR, (PAIR, "u"): USER}
# A row that must go; whole rows by role initial (o: any other); cut-off rows in capitals.
SYMBOLS = "xsuaoSUAO"
BLOCK = 4
NEVER = 1 << 40
SEGMENT_ROWS = 1 << 15
SEGMENT_LETTERS = 1 << 22


def _steps(symbol: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Per state the state after keeping the row (-1: not possible), and what keeping or renaming costs."""
    kept = np.array([KEEPS.get((state, symbol.lower()), -1) for state in range(4)])
    return kept, NEXT, TRUNCATED if symbol.isupper() else 0


def with_inserts(costs: np.ndarray) -> np.ndarray:
    """Costs to the end when rows may be inserted first; last axis is the state."""
    for _ in range(3):
        costs = np.minimum(costs, INSERT + costs[..., NEXT])
    return np.minimum(costs, NEVER)


def before(symbol: str, after: np.ndarray) -> np.ndarray:
    """Costs to the end before a row, from those after it."""
    costs = DELETE + after
    if symbol != "x":
        kept, renamed, more = _steps(symbol)
        costs = np.minimum(costs, REROLE + more + after[..., renamed])
        costs = np.where(kept >= 0, np.minimum(costs, more + after[..., kept]), costs)
    return with_inserts(costs)


END = with_inserts(np.array([0, NEVER, NEVER, 0]))
# Costs of reaching one given state at the end of a segment, one row per state.
REACH = with_inserts(np.where(np.eye(4, dtype=bool), 0, NEVER))


class Tables:
    """Normalised vectors and their transitions by one symbol and by one block of symbols."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        self.vectors: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        for start in (END, *REACH):
            self.enter(start)
        one, added = [], []
        at = 0
        while at < len(self.vectors):  # the set is closed: differences are bounded by the edit costs
            vector = np.array(self.vectors[at])
            moves = [self.enter(before(s, vector)) for s in SYMBOLS]
            one.append([m[0] for m in moves])
            added.append([m[1] for m in moves])
            at += 1
        self.one, self.added = np.array(one), np.array(added, dtype=np.int64)
        n = len(self.vectors)
        # Blocks are read as numbers in base nine, first symbol first; the last symbol acts first.
        codes = np.arange(len(SYMBOLS) ** block)
        place = np.repeat(np.arange(n)[:, None], len(codes), axis=1)
        total = np.zeros((n, len(codes)), dtype=np.int64)
        for _ in range(block):
            symbol = codes % len(SYMBOLS)
            total += self.added[place, symbol]
            place = self.one[place, symbol]
            codes = codes // len(SYMBOLS)
        self.many, self.many_added = place, total
        self.traced: dict[tuple[int, tuple[int, ...], int], tuple[str, int]] = {}

    def enter(self, costs: np.ndarray) -> tuple[int, int]:
        """Number of the normalised vector and the constant taken off."""
        low = int(costs.min())
        if low >= NEVER:
            low = 0
        key = tuple(int(min(c - low, NEVER)) if c < NEVER else NEVER for c in costs)
        if key not in self.number:
            self.number[key] = len(self.vectors)
            self.vectors.append(key)
        return self.number[key], low

    def blocks(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols before the first whole block, and the blocks as numbers."""
        head = len(symbols) % self.block
        base = len(SYMBOLS) ** np.arange(self.block - 1, -1, -1)
        return symbols[:head], symbols[head:].reshape(-1, self.block) @ base

    def borders(self, symbols: np.ndarray, end: int) -> tuple[list[int], int, int]:
        """Vector number after every block (the last is ``end``), the first vector, and the cost."""
        head, blocks = self.blocks(symbols)
        place, cost, after = end, 0, []
        for code in blocks[::-1].tolist():
            after.append(place)
            cost += int(self.many_added[place, code])
            place = int(self.many[place, code])
        after.reverse()
        for symbol in head[::-1].tolist():
            cost += int(self.added[place, symbol])
            place = int(self.one[place, symbol])
        return after, place, cost

    def expand(self, symbols: tuple[int, ...], end: int, state: int) -> tuple[str, int]:
        """ASCII-least cheapest edits through a few rows from ``state``, and the state after them.

        The vectors between the rows are found backward from the border; the path then goes forward
        and takes, of the edits that stay cheapest, the least initial. A state and an initial allow
        one next state only, so the least initial at every step gives the least string.
        """
        key = (end, symbols, state)
        if key in self.traced:
            return self.traced[key]
        after = np.array(self.vectors[end])
        costs = [after]
        for symbol in reversed(symbols):
            costs.append(before(SYMBOLS[symbol], costs[-1]))
        costs.reverse()
        edits = []
        for symbol, here, there in zip(symbols, costs, costs[1:], strict=False):
            name = SYMBOLS[symbol]
            kept, _, more = _steps(name)
            while True:
                due = here[state]
                if due == DELETE + there[state]:
                    edits.append("D")
                elif due == INSERT + here[NEXT[state]]:
                    edits.append("I")
                    state = int(NEXT[state])
                    continue
                elif name != "x" and kept[state] >= 0 and due == more + there[kept[state]]:
                    edits.append("K")
                    state = int(kept[state])
                else:
                    edits.append("R")
                    state = int(NEXT[state])
                break
        self.traced[key] = "".join(edits), state
        return self.traced[key]

    def trace(self, symbols: np.ndarray, end: int, state: int) -> tuple[str, int]:
        """Edits through a segment from ``state``, and the state after it, block by block."""
        after, first, _ = self.borders(symbols, end)
        head, _ = self.blocks(symbols)
        whole = symbols[len(head) :].reshape(-1, self.block).tolist()
        edits = []
        if len(head):
            place = end
            if len(whole):
                place = int(self.many[after[0], self.blocks(symbols)[1][0]])
            found, state = self.expand(tuple(head.tolist()), place, state)
            edits.append(found)
        for block, place in zip(whole, after, strict=True):
            found, state = self.expand(tuple(block), place, state)
            edits.append(found)
        return "".join(edits), state

    def closing(self, state: int) -> tuple[str, int]:
        """Inserts after the last row of a conversation."""
        edits = ""
        while state not in (NOTHING, PAIR):
            edits, state = edits + "I", int(NEXT[state])
        return edits, state


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


def coded(symbols: str) -> np.ndarray:
    return np.array([SYMBOLS.index(s) for s in symbols], dtype=np.int64)


def repaired_rows(
    state: int, edits: str, symbols: str, roles: Sequence[str], texts: Sequence[str]
) -> Iterator[str]:
    """``role:text`` of every row the edits leave; ``roles`` and ``texts`` are of the rows that may stay."""
    rows = zip(roles, texts, strict=True)
    symbol = iter(symbols)
    for edit in edits:
        role, text = "", ""
        if edit != "I" and next(symbol) != "x":
            role, text = next(rows)
        if edit == "D":
            continue
        if edit == "K":
            state = KEEPS[(state, role[:1])]
        else:
            state = int(NEXT[state])
            role = "user" if state == USER else "assistant"
        yield f"{role}:{text}"


def filled(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


FAULTS = 20


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` after the planned damage; nulls of role and text are one blank.

    What happens to a row is drawn by the CRC-32 of ``conv_id:turn`` (null: one blank): one in twenty
    each is dropped, emptied, loses its sentence ends, is repeated, or becomes the user's.
    """
    draw = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % FAULTS
    text, role = filled("text"), filled("role")
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    return (
        rows.withColumn("draw", draw)
        .where("draw <> 0")
        .select(
            "conv_id",
            "turn",
            F.when(F.col("draw") == 4, "user").otherwise(role).alias("role"),
            text.alias("text"),
            F.when(F.col("draw") == 3, 2).otherwise(1).alias("copies"),
        )
        .withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
        .drop("copies", "copy")
    )


SPOKEN = r"[^\x20\x09-\x0D]"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"


def marked(rows: DataFrame) -> DataFrame:
    """Distinct rows of ``conv_id, turn, role, text``, how often each occurs (``n``), whether it is
    blank or seen under an earlier turn (``again``), and the symbol of the first of them; the others
    are duplicates."""
    once = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    once = once.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256)).withColumn(
        "seen", F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))
    )
    first = (
        once.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"))
        .agg(F.min("seen").alias("first"), F.count(F.lit(1)).alias("turns"))
        .where("turns > 1")
        .drop("turns")
    )
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    blank = ~F.col("text").rlike(SPOKEN)
    again = F.col("first").isNotNull() & ~F.col("seen").eqNullSafe(F.col("first"))
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    whole = F.col("text").rlike(ENDED)
    symbol = F.when(blank | again, "x").when(whole, initial).otherwise(F.upper(initial))
    return once.join(first, same, "left").select(
        "conv_id", "turn", "role", "text", "n", blank.alias("blank"), (~blank & again).alias("again"), symbol.alias("symbol")
    )


def segment_type(id_field: T.StructField) -> T.StructType:
    return T.StructType(
        [
            id_field,
            *[T.StructField(n, T.LongType()) for n in ("place", "illegal", "cost")],
            *[T.StructField(n, T.StringType()) for n in ("symbols", "first", "last", "audit", "repaired")],
            *[T.StructField(n, T.ArrayType(T.StringType())) for n in ("roles", "texts")],
            T.StructField("reach", T.ArrayType(T.LongType())),
        ]
    )


LEGAL = {"su", "ua", "au"}


class Segment:
    """Successive rows of one conversation, as they come."""

    def __init__(self, conv_id):
        self.conv_id, self.symbols, self.roles, self.texts = conv_id, [], [], []
        self.first = self.last = None
        self.illegal, self.letters = 0, 0

    def add(self, role: str, text: str, symbol: str, times: int) -> None:
        """A row, and then duplicates of it; the first may be one itself."""
        initial = role[:1]
        if self.first is None:
            self.first = initial
        elif self.last + initial not in LEGAL:
            self.illegal += 1
        self.illegal += times - 1
        self.last = initial
        self.symbols.append(symbol + "x" * (times - 1))
        if symbol != "x":
            self.roles.append(role)
            self.texts.append(text)
            self.letters += len(text)

    def row(self, place: int, whole: bool) -> dict:
        """The segment solved if it is a whole conversation, else with the costs between its ends."""
        symbols = "".join(self.symbols)
        out = {"conv_id": self.conv_id, "place": place, "illegal": self.illegal, "symbols": symbols,
               "first": self.first, "last": self.last}
        codes, known = coded(symbols), tables()
        if not whole:
            return out | {"roles": self.roles, "texts": self.texts, "reach": reach(known, codes)}
        end = known.number[tuple(END.tolist())]
        _, start, cost = known.borders(codes, end)
        edits, state = known.trace(codes, end, NOTHING)
        rows = repaired_rows(NOTHING, edits + known.closing(state)[0], symbols, self.roles, self.texts)
        return out | {"cost": cost + known.vectors[start][NOTHING], "audit": edits + known.closing(state)[0],
                      "repaired": "\n".join(rows)}


def reach(known: Tables, codes: np.ndarray) -> list[int]:
    """Cheapest cost from each state before the rows to each state after them, row by row."""
    columns = []
    for costs in REACH:
        number, _ = known.enter(costs)
        _, start, cost = known.borders(codes, number)
        columns.append([min(NEVER, c + cost) for c in known.vectors[start]])
    return np.array(columns).T.ravel().tolist()


def segments(rows: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Conversations that lie within one partition of the sorted rows, solved, and segments of others."""
    kind = segment_type(rows.schema["conv_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(kind)
        place = TaskContext.get().partitionId() << 32
        current, edge, done = None, True, []
        for batch in batches:
            for conv_id, role, text, n, symbol in zip(*batch.to_pydict().values(), strict=True):
                if current is None or conv_id != current.conv_id:
                    if current is not None:
                        done.append(current.row(place, not edge))
                        place, edge = place + 1, False
                    else:
                        edge = True
                    current = Segment(conv_id)
                while n:
                    if len(current.symbols) >= segment_rows or current.letters >= SEGMENT_LETTERS:
                        done.append(current.row(place, False))
                        place, edge, current = place + 1, True, Segment(conv_id)
                    times = min(n, segment_rows)
                    current.add(role, text, symbol, times)
                    n, symbol = n - times, "x"
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
                done = []
        if current is not None:
            yield pa.RecordBatch.from_pylist([current.row(place, False)], schema=schema)

    order = ("conv_id", "turn", "role", "text")
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return ordered.select("conv_id", "role", "text", "n", "symbol").mapInArrow(run, kind)


def composed(open_segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that go across segments: ``conv_id, illegal, cost, audit, repaired_sha256``, and the
    repaired text of each segment.

    The costs between the ends of segments are composed per conversation, four by four numbers a
    segment; each segment is then traced from all four states, and the states met are followed from
    the first segment on. Only numbers of segments meet in one task, texts are hashed as a stream.
    """
    id_field = open_segments.schema["conv_id"]
    border_type = T.StructType(
        [id_field, *[T.StructField(n, T.LongType()) for n in ("place", "after", "illegal", "cost")],
         T.StructField("ends", T.BooleanType())]
    )

    def borders(group: pa.Table) -> pa.Table:
        known, rows = tables(), sorted(group.to_pylist(), key=lambda r: r["place"])
        illegal = sum(r["illegal"] for r in rows)
        illegal += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(rows, rows[1:]))
        costs, out = END, []
        for number, r in enumerate(reversed(rows)):
            out.append({"conv_id": r["conv_id"], "place": r["place"], "after": known.enter(costs)[0], "ends": number == 0})
            costs = np.minimum((np.array(r["reach"]).reshape(4, 4) + costs).min(axis=1), NEVER)
        out = [r | {"illegal": illegal, "cost": int(costs[NOTHING])} for r in out]
        return pa.Table.from_pylist(out, schema=to_arrow_schema(border_type))

    numbers = open_segments.select("conv_id", "place", "illegal", "first", "last", "reach")
    after = settle(numbers.groupBy("conv_id").applyInArrow(borders, border_type))

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tables()
        for batch in batches:
            for r in batch.to_pylist():
                codes = coded(r["symbols"])
                found = [_from(known, codes, r["after"], state, r["ends"]) for state in range(4)]
                yield pa.RecordBatch.from_pydict(
                    {"conv_id": pa.array([r["conv_id"]], id_arrow), "place": [r["place"]],
                     "edits": pa.array([[f[0] for f in found]], pa.list_(pa.string())),
                     "exits": pa.array([[f[1] for f in found]], pa.list_(pa.int64()))}
                )

    id_arrow = to_arrow_schema(T.StructType([id_field])).field(0).type
    trace_type = T.StructType(
        [id_field, T.StructField("place", T.LongType()), T.StructField("edits", T.ArrayType(T.StringType())),
         T.StructField("exits", T.ArrayType(T.LongType()))]
    )
    traces = settle(
        open_segments.select("conv_id", "place", "symbols")
        .join(after.select("place", "after", "ends"), "place")
        .select("conv_id", "place", "symbols", "after", "ends")
        .mapInArrow(traced, trace_type)
    )
    entry_type = T.StructType([T.StructField("place", T.LongType()), T.StructField("entry", T.LongType())])

    def entered(group: pa.Table) -> pa.Table:
        state, out = NOTHING, []
        for r in sorted(group.to_pylist(), key=lambda r: r["place"]):
            out.append({"place": r["place"], "entry": state})
            state = r["exits"][state]
        return pa.Table.from_pylist(out, schema=to_arrow_schema(entry_type))

    entries = traces.select("conv_id", "place", "exits").groupBy("conv_id").applyInArrow(entered, entry_type)
    chosen = settle(
        traces.join(entries, "place").select("place", "entry", F.col("edits")[F.col("entry").cast("int")].alias("edits"))
    )
    part_type = T.StructType(
        [id_field, T.StructField("place", T.LongType()), T.StructField("repaired", T.StringType())]
    )

    def mended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows = repaired_rows(r["entry"], r["edits"], r["symbols"], r["roles"], r["texts"])
                yield pa.RecordBatch.from_pydict(
                    {"conv_id": pa.array([r["conv_id"]], id_arrow), "place": [r["place"]], "repaired": ["\n".join(rows)]}
                )

    parts = settle(
        open_segments.select("conv_id", "place", "symbols", "roles", "texts").join(chosen, "place")
        .select("conv_id", "place", "symbols", "roles", "texts", "entry", "edits")
        .mapInArrow(mended, part_type)
    )
    hash_type = T.StructType([id_field, T.StructField("repaired_sha256", T.StringType())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, digest, text = None, None, False

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {"conv_id": pa.array([held[0]], id_arrow), "repaired_sha256": [digest.hexdigest()]}
            )

        for batch in batches:
            for r in batch.to_pylist():
                if held is None or held[0] != r["conv_id"]:
                    if held is not None:
                        yield closed()
                    held, digest, text = (r["conv_id"],), hashlib.sha256(), False
                if r["repaired"]:
                    digest.update((b"\n" if text else b"") + r["repaired"].encode())
                    text = True
        if held is not None:
            yield closed()

    hashes = (
        parts.repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "place", "repaired")
        .mapInArrow(hashed, hash_type)
    )
    audits = (
        chosen.join(after, "place")
        .groupBy("conv_id")
        .agg(
            F.max("illegal").alias("illegal"),
            F.max("cost").alias("cost"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "edits"))), lambda s: s["edits"]), "").alias("audit"),
        )
    )
    named = hashes.withColumnRenamed("conv_id", "c")
    return audits.join(named, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c"), parts


def _from(known: Tables, codes: np.ndarray, after: int, state: int, ends: bool) -> tuple[str, int]:
    """Edits of a segment from a state, and the state after it; a state that has no way on is left out."""
    _, start, _ = known.borders(codes, after)
    if known.vectors[start][state] >= NEVER:
        return "", state
    edits, state = known.trace(codes, after, state)
    if ends:
        more, state = known.closing(state)
        edits += more
    return edits, state


def repaired(rows: DataFrame, segment_rows: int = SEGMENT_ROWS) -> tuple[DataFrame, DataFrame]:
    """Verdicts and repaired texts of conversations given as ``conv_id, turn, role, text``.

    Verdicts have one row per ``conv_id``: ``gaps`` (turns missing between the first and the last),
    ``blank``, ``duplicate``, ``truncated`` (rows by their first fault), ``illegal`` (neighbours whose
    role initials are not su, ua or au), ``cost`` and ``audit`` of the cheapest edits to
    ``(s?(ua)+)?``, ASCII-least among equals, and ``repaired_sha256`` over ``role:text`` lines. Texts
    are ``conv_id, place, repaired``: the repaired lines, in one part, or in several ordered by
    ``place`` where the conversation went across partitions or is longer than ``segment_rows``.

    Rows are taken by turn, null turns first, then by role and text; equal rows are neighbours, and
    all but the first of them duplicates. Null roles and texts count as one blank, a null ``conv_id``
    is a conversation of its own; other columns are ignored; an empty table gives no rows.
    """
    source = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), filled("role").alias("role"), filled("text").alias("text"))
    faults = settle(marked(source))
    parts = settle(segments(faults, segment_rows))
    solved = parts.where("audit is not null")
    long_ones, long_parts = composed(parts.where("audit is null"))
    again = F.when(F.col("blank"), 0).when(F.col("again"), F.col("n")).otherwise(F.col("n") - 1)
    by_turn = faults.groupBy("conv_id", "turn").agg(
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(again).alias("duplicate"),
        F.count(F.when(F.col("symbol").isin("S", "U", "A", "O"), 1)).alias("truncated"),
    )
    span = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    facts = by_turn.groupBy("conv_id").agg(
        F.coalesce(span, F.lit(0)).alias("gaps"), *[F.sum(n).alias(n) for n in ("blank", "duplicate", "truncated")]
    )
    columns = ("conv_id", "illegal", "cost", "audit", "repaired_sha256")
    found = solved.withColumn("repaired_sha256", F.sha2(F.col("repaired").cast("binary"), 256)).select(*columns)
    found = found.unionByName(long_ones.select(*columns)).withColumnRenamed("conv_id", "c")
    verdicts = facts.join(found, F.col("conv_id").eqNullSafe(F.col("c"))).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", *columns[1:]
    )
    return verdicts, solved.select("conv_id", "place", "repaired").unionByName(long_parts)


EMPTY = hashlib.sha256(b"").hexdigest()


def audited(rows: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Verdicts on the damaged rows, for every original ``conv_id``."""
    verdicts, _ = repaired(damaged(rows), segment_rows)
    all_ids = rows.select(F.col("conv_id").alias("c")).distinct()
    found = all_ids.join(verdicts, F.col("c").eqNullSafe(F.col("conv_id")), "left")
    zeros = {n: F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return found.select(
        F.col("c").alias("conv_id"), *zeros.values(),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(EMPTY)).alias("repaired_sha256"),
    )
