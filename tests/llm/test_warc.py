from __future__ import annotations

import base64
import gzip
import hashlib
from pathlib import Path

from tapegrid.llm import warc

PAGES = [
    (5, "http://a/1", "<p>é</p>"), (2, "http://a/2", "<p>é</p>"), (9, None, None), (7, "http://b", ""),
    (8, "http://c\r\nX: y", "long " * 400_000), (1, "http://d", "a\r\n\r\nb"), (3, "http://e", "WARC/1.1\r\n\r\n"),
    (3, "http://e", "WARC/1.1\r\n\r\n"), (None, "http://f", "<p>é</p>"), (None, "http://g", "only"),
]


def frame(spark, rows=PAGES):
    return spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int")


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected(rows):
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    out = []
    for i, _, html in rows:
        revisit = i is not None and first[html or ""] != i
        out.append((i, len((html or "").encode()), digest(html), "revisit" if revisit else "response", first[html or ""] if revisit else None))
    return sorted(out, key=str)


def shown(rows):
    return sorted(
        ((r["capture_id"], r["full_bytes"], r["full_digest"], r["answer"]["record_type"], r["refers_to_id"]) for r in rows), key=str
    )


def test_round_trip(spark):
    rows = warc.round_trip(frame(spark).repartition(3)).collect()
    assert shown(rows) == expected(PAGES)
    by_id = {i: html or "" for i, _, html in PAGES if i is not None}
    for r in rows:
        answer = r["answer"]
        if answer["record_type"] == "response" and r["capture_id"] is not None:
            assert answer["payload"].decode() == by_id[r["capture_id"]]
            assert answer["digest_ok"] and answer["http_status"] == 200
        if answer["record_type"] == "revisit":
            assert answer["payload"] is None
        assert r["request"]["record_id"] != r["metadata"]["record_id"] != answer["record_id"]
    assert shown(warc.round_trip(frame(spark), with_payload=False).collect()) == expected(PAGES)


def test_smaller_payloads_never_revisit(spark):
    found = warc.page_captures(frame(spark), least=8).where("refers_to IS NOT NULL").collect()
    assert [(r["capture_id"], r["refers_to"]) for r in found] == [(5, 2)]


def test_empty_table(spark):
    assert warc.round_trip(frame(spark, [])).count() == 0


def test_files_are_ordinary_members(spark, tmp_path):
    folder = f"file://{tmp_path}/archive"
    manifest = warc.write_archives(warc.page_captures(frame(spark)).coalesce(1), folder).collect()
    assert [r["records"] for r in manifest] == [3 * len(PAGES)]
    data = gzip.decompress(Path(manifest[0]["path"].removeprefix("file://")).read_bytes())
    assert data.count(b"WARC-Type: request") == len(PAGES)
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: request")


def test_assembly_of_foreign_records(spark):
    kind = warc.RECORDS
    blank = {n.split()[0]: None for n in kind.split(", ")}

    def row(name, record_type, to=None):
        return tuple({**blank, "record_id": name, "record_type": record_type, "concurrent_to": to}.values())

    rows = [
        row("a", "response"), row("b", "request", "a"), row("c", "metadata", "a"), row("d", "metadata", "a"),
        row("e", "response"), row("f", "request", "nowhere"), row("g", "warcinfo"), row("h", "request"), row(None, "response"),
    ]
    records = spark.createDataFrame(rows, kind.replace("fields map<string,string>", "fields map<string,string>"))
    found = [
        (r["record_id"], r["request"] and r["request"]["record_id"], r["metadata"] and r["metadata"]["record_id"])
        for r in warc.assemble(records).collect()
    ]
    assert sorted(found, key=str) == sorted([("a", "b", "c"), ("a", "b", "d"), ("e", None, None), (None, None, None)], key=str)


def test_cut_off_file_is_an_error(tmp_path):
    data = warc.record("metadata", {"WARC-Record-ID": "x"}, b"a: b")
    try:
        list(warc._members(iter([data[:-4]])))
    except ValueError as error:
        assert "ends within" in str(error)
    else:
        raise AssertionError("no error")
