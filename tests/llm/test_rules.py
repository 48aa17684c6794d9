from __future__ import annotations

import re
from collections import Counter

from tapegrid.llm import preference, quality, site_lines


# --- quality rules --------------------------------------------------------------------------------


def brute_statistics(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            again += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), again, len(covered))


TEXTS = [
    "", None, " \n\t", "a b c a b c", "x x x x", "x x", "é日 <b> # $%&|*>\né日 <b> # $%&|*>\n\n\n", "a b c d a b c",
    "l\r\nl\r\nl", "one two " * 3_000, "a b\tc\x0ba b c", "\x85 \xa0 a",
]


def test_statistics():
    for text in TEXTS:
        assert quality.statistics((text or "").encode()) == brute_statistics(text), text


def words(prefix, n):
    return " ".join(f"{prefix}{i}" for i in range(n))


def test_shared_lines_go_and_depleted_documents_are_rejected(spark):
    shared = words("notice", 80)
    rows = [(i, f"{words(f'own{chr(97 + i)}x', 60)}\n{shared.upper()} {i:02d}", "a") for i in range(20)]
    rows += [(100 + i, f"{words(f'own{chr(97 + i)}y', 60)}", "a") for i in range(20)]
    rows += [(200, shared + " 77", "a"), (201, f"{words('z', 90)}\n{shared} 78", "a")]
    rows += [(300, f"{words('q', 60)}\n{shared} 79", "b")]
    rows += [(400 + i, words("copy", 70), "c") for i in range(30)]
    rows += [(500, None, "a"), (501, "", None), (502, words("v", 60), None), (502, words("v", 60), None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, kept int")
    found = {}
    for r in quality.judge(docs).collect():
        assert tuple(r[s] for s in quality.STATS) == brute_statistics(dict((i, t) for i, t, _ in rows)[r["doc_id"]])
        found.setdefault(r["doc_id"], []).append((r["base_failed"], r["kept"], r["words_left"]))
    assert found[0] == [(False, False, 60)]  # 60 of 141 words left
    assert found[100] == [(False, True, 60)]
    assert found[200] == [(False, False, 0)]
    assert found[201] == [(False, True, 90)]
    assert found[300] == [(False, True, 141)]  # the host decides
    assert found[400] == [(False, True, 70)]  # copies count once
    assert found[500] == found[501] == [(True, False, 0)]
    assert found[502] == [(False, True, 60)] * 2
    assert quality.judge(docs.where("false")).count() == 0


# --- lines of a site ------------------------------------------------------------------------------


def page(*lines):
    return "<html><body>" + "".join(f"<p>{x}</p>" for x in lines) + "</body></html>"


def test_lines_of_most_pages_go(spark):
    rows = [(i, f"https://user@Host.example:80/{i}", page("menu &amp; more", f"text {i}", "rare" if i < 2 else f"t{i}")) for i in range(10)]
    rows += [(20, "http://single.example/", page("menu &amp; more", "x")), (21, "http://single.example/2", page("menu &amp; more", "y"))]
    rows += [(30, None, None), (31, "", ""), (32, "no url", page("menu &amp; more")), (3, "https://host.example/3", page("again", "again"))]
    rows += [(40, "http://big.example/", page(*[f"line {i}" for i in range(20_000)]))]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, lines int")
    found = [(r["page_id"], r["host"], r["text"], r["n_lines"], r["n_dropped"]) for r in site_lines.without_boilerplate(pages).collect()]
    assert len(found) == len(rows)
    assert (0, "host.example", "text 0\nrare", 3, 1) in found
    assert (9, "host.example", "text 9\nt9", 3, 1) in found
    assert (3, "host.example", "again\nagain", 2, 0) in found
    assert (20, "single.example", "menu & more\nx", 2, 0) in found
    assert (30, "", "", 0, 0) in found and (31, "", "", 0, 0) in found and (32, "", "menu & more", 1, 0) in found
    assert next(f for f in found if f[0] == 40)[3:] == (20_000, 0)
    assert site_lines.without_boilerplate(pages.where("false")).count() == 0


# --- preferences ----------------------------------------------------------------------------------


def pairs(spark, chosen, rejected):
    schema = "pair_id long, turn long, role string, text string, part string"
    sides = [spark.createDataFrame([(*r, "x") for r in side], schema) for side in (chosen, rejected)]
    return {r["pair_id"]: r for r in preference.format_pairs(*sides).collect()}


def shown(role, text):
    return f"<|{role}|>\n{text}<|end|>\n"


def test_common_prefix_is_rendered_once(spark):
    opening = [(1, 0, "system", "be kind"), (1, 1, "user", "héllo")]
    chosen = [*opening, (1, 2, "assistant", "good"), (1, 3, "user", "thanks"), (1, 3, "user", "thanks")]
    rejected = [*opening, (1, 2, "assistant", "bad"), (1, 3, "user", "thanks")]
    row = pairs(spark, chosen, rejected)[1]
    assert row["prompt"] == shown("system", "be kind") + shown("user", "héllo")
    assert row["prompt_turns"] == 2
    assert row["chosen"] == shown("assistant", "good") + shown("user", "thanks")
    assert row["rejected"] == shown("assistant", "bad") + shown("user", "thanks")
    for side, body in (("chosen", "good"), ("rejected", "bad")):
        (span,) = row[f"{side}_mask"]
        assert row[side][span["start"] : span["stop"]] == body + "<|end|>\n"


def test_equal_missing_and_null_sides(spark):
    chosen = [(1, 0, "user", "a"), (2, 0, "user", "b"), (3, None, None, None), (None, 0, "user", "n")]
    rejected = [(1, 0, "user", "a"), (3, None, None, None), (3, 1, "assistant", None), (4, 0, "assistant", "z"), (None, 0, "user", "m")]
    found = pairs(spark, chosen, rejected)
    assert (found[1]["prompt"], found[1]["chosen"], found[1]["rejected"]) == (shown("user", "a"), "", "")
    assert (found[2]["prompt"], found[2]["chosen"]) == ("", shown("user", "b"))
    assert found[3]["prompt"] == shown("", "") and found[3]["rejected"] == shown("assistant", "")
    assert found[4]["rejected"] == shown("assistant", "z") and not found[4]["chosen_mask"]
    assert (found[None]["chosen"], found[None]["rejected"]) == (shown("user", "n"), shown("user", "m"))
    assert pairs(spark, [], []) == {}


def test_a_long_pair_is_one_row(spark):
    """2,050 turns that part at the last one, a null turn before them, and turns of equal number."""
    shared = [(1, None, "system", "s"), *[(1, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(2_049)]]
    shared += [(1, 7, "user", "again"), (1, 7, "user", "again")]
    found = pairs(spark, [*shared, (1, 2_049, "assistant", "good")], [*shared, (1, 2_049, "assistant", "bad")])
    (row,) = found.values()
    turns = sorted({((-1 if t is None else t), r, x) for _, t, r, x in shared})
    assert row["prompt"] == "".join(shown(r, x) for _, r, x in turns) and row["prompt_turns"] == 2_051
    assert (row["chosen"], row["rejected"]) == (shown("assistant", "good"), shown("assistant", "bad"))


def test_neighbour_pairs(spark):
    rows = [
        (0, 0, "user", "q0"), (0, 1, "assistant", "a0"), (1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (1, 2, "user", "more"),
        (2, 0, "user", "q2"), (2, 1, "assistant", "a2"), (5, 0, "user", "no answer"),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r["pair_id"]: r for r in preference.format_pairs(*preference.neighbour_pairs(frame)).collect()}
    assert found[0]["prompt"] == shown("user", "q0")
    assert (found[0]["chosen"], found[0]["rejected"]) == (shown("assistant", "a0"), shown("assistant", "a1"))
    assert found[1]["chosen"] == shown("assistant", "a1") + shown("user", "more")
    assert (found[2]["chosen"], found[2]["rejected"]) == (shown("assistant", "a2"), "")
    assert (found[5]["prompt"], found[5]["chosen"]) == (shown("user", "no answer"), "")
