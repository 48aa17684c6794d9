from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from tapegrid.llm import dialogue

AFTER = {("0", "s"): "S", ("0", "u"): "U", ("S", "u"): "U", ("U", "a"): "A", ("A", "u"): "U"}
NEXT = {"0": "U", "S": "U", "U": "A", "A": "U"}


def shown(value):
    return " " if value is None else str(value)


def brute_damage(rows):
    for conv, turn, role, text in rows:
        draw = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = shown(role), shown(text)
        if draw == 0:
            continue
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        role = "user" if draw == 4 else role
        yield from [(conv, turn, role, text)] * (2 if draw == 3 else 1)


def brute_audit(rows):
    """Cheapest edits of ``(initial, must go, cut off)`` rows as ``cost, audit``: whole strings per state."""

    def closed(best):
        for _ in range(4):
            for q in best:
                cost, audit = best[NEXT[q]]
                best[q] = min(best[q], (cost + 5, "I" + audit))
        return best

    best = closed({q: (0, "") if q in "0A" else (10**9, "") for q in "0SUA"})
    for initial, gone, cut in reversed(rows):
        before = {}
        for q in "0SUA":
            ways = [(best[q][0] + 2, "D" + best[q][1])]
            if not gone:
                more = 5 if cut else 0
                ways.append((best[NEXT[q]][0] + 1 + more, "R" + best[NEXT[q]][1]))
                if (q, initial) in AFTER:
                    kept = best[AFTER[q, initial]]
                    ways.append((kept[0] + more, "K" + kept[1]))
            before[q] = min(ways)
        best = closed(before)
    return best["0"]


def brute(rows):
    """Verdicts of undamaged rows by conversation."""
    convs = collections.defaultdict(list)
    for r in rows:
        convs[r[0]].append(r)
    for conv, held in convs.items():
        held.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, facts, counts = set(), [], collections.Counter()
        for _, _, role, text in held:
            spoken = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
            fault = (
                "blank" if not spoken else "duplicate" if (role, text) in seen
                else "truncated" if spoken[-1] not in ".!?" else None
            )
            counts[fault] += 1
            seen.add((role, text))
            facts.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        turns = {r[1] for r in held if r[1] is not None}
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(facts, facts[1:]))
        cost, audit = brute_audit(facts)
        state, rest, lines = "0", iter(held), []
        for edit in audit:
            role, text = ("", "") if edit == "I" else next(rest)[2:]
            if edit == "D":
                continue
            state = AFTER[state, role[:1]] if edit == "K" else NEXT[state]
            lines.append((role if edit == "K" else "user" if state == "U" else "assistant") + ":" + text)
        yield (
            conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, counts["blank"], counts["duplicate"],
            counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )


def brute_audited(rows):
    found = {r[0]: r for r in brute(brute_damage(rows))}
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    return sorted((found.get(c, (c, *nothing)) for c in {r[0] for r in rows}), key=str)


def conversations():
    draw = random.Random(3)
    rows = []
    for conv in [*range(40), None]:
        for _ in range(draw.choice([1, 2, 3, 8, 40])):
            rows.append(
                (
                    conv, draw.choice([None, *range(12)]),
                    draw.choice(["user", "assistant", "system", "tool", None, ""]),
                    draw.choice([None, "", " \n", "a.", "b!", "c", "d. ", "e?\n\n", "x\x85", "y."]),
                )
            )
    rows += [
        (77, i % 900 if i % 3 else None, draw.choice(["user", "assistant", "system"]), f"t{i % 700}" + draw.choice([".", ""]))
        for i in range(3_000)
    ]
    rows += [(99, 5, "user", "again and again.")] * 500
    return rows


@pytest.mark.parametrize("segment_rows", [1 << 15, 7])
def test_audit_against_brute_force(spark, segment_rows):
    rows = conversations()
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, symbol string, n int")
    held = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = sorted(map(tuple, dialogue.audited(table, segment_rows).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", held)
    assert found == brute_audited(rows)


def test_repaired_texts_hash_to_the_verdicts(spark):
    rows = list(brute_damage(conversations()))
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    verdicts, parts = dialogue.repaired(table, 50)
    texts = collections.defaultdict(list)
    for r in sorted(parts.collect(), key=lambda r: r["place"]):
        texts[r["conv_id"]] += [r["repaired"]] if r["repaired"] else []
    for r in verdicts.collect():
        assert hashlib.sha256("\n".join(texts[r["conv_id"]]).encode()).hexdigest() == r["repaired_sha256"]


def test_no_rows(spark):
    table = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert dialogue.audited(table).count() == 0


def test_block_tables_equal_single_steps():
    tables = dialogue.tables()
    draw = np.random.default_rng(1)
    end = tables.number[tuple(dialogue.END.tolist())]
    for n in range(0, 60):
        codes = draw.integers(0, len(dialogue.SYMBOLS), n)
        costs = dialogue.END
        for code in codes[::-1]:
            costs = dialogue.before(dialogue.SYMBOLS[code], costs)
        _, start, cost = tables.borders(codes, end)
        assert [min(c + cost, dialogue.NEVER) for c in tables.vectors[start]] == costs.tolist()
        names = [(s.lower(), s == "x", s.isupper()) for s in (dialogue.SYMBOLS[c] for c in codes)]
        edits, state = tables.trace(codes, end, dialogue.NOTHING)
        assert (int(costs[0]), edits + tables.closing(state)[0]) == brute_audit(names)


def test_cheapest_and_least_among_all_short_edits():
    """Every sequence of edits of up to three rows, written out."""
    tables = dialogue.tables()
    end = tables.number[tuple(dialogue.END.tolist())]

    def ways(symbols, state, inserts):
        if not symbols:
            if state in "0A":
                yield 0, ""
        else:
            name, rest = symbols[0], symbols[1:]
            yield from ((c + 2, "D" + e) for c, e in ways(rest, state, inserts))
            if name != "x":
                more = 5 if name.isupper() else 0
                yield from ((c + 1 + more, "R" + e) for c, e in ways(rest, NEXT[state], inserts))
                if (state, name.lower()) in AFTER:
                    yield from ((c + more, "K" + e) for c, e in ways(rest, AFTER[state, name.lower()], inserts))
        if inserts:
            yield from ((c + 5, "I" + e) for c, e in ways(symbols, NEXT[state], inserts - 1))

    for n in range(4):
        for symbols in itertools.product(dialogue.SYMBOLS, repeat=n):
            codes = dialogue.coded("".join(symbols))
            _, start, cost = tables.borders(codes, end)
            edits, state = tables.trace(codes, end, dialogue.NOTHING)
            assert (cost + tables.vectors[start][0], edits + tables.closing(state)[0]) == min(ways(symbols, "0", 2))
