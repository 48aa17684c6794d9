from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tapegrid.llm import exact

ROWS = [
    (4, "a  b\tc"), (2, "a b c"), (9, "a b c "), (7, None), (5, ""), (6, " "), (3, "A b c"),
    (2, "a b c"), (None, "a\nb c"), (None, "alone"), (8, "x" * 200_000), (1, "x" * 200_000), (11, " "),
]


def normal(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def expected():
    groups = {}
    for i, text in ROWS:
        groups.setdefault(normal(text), []).append(i)
    out = []
    for i, text in ROWS:
        group = groups[normal(text)]
        out.append((i, min((x for x in group if x is not None), default=None), len(group), hashlib.sha256(normal(text).encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "de", 0) for r in rows], "doc_id long, text string, digest string, group_size int")


@pytest.mark.parametrize("files_per_batch", [None, 1])
def test_groups(spark, files_per_batch):
    found = exact.group_rows(frame(spark).repartition(3), files_per_batch=files_per_batch).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["digest"]) for r in found), key=str) == expected()
    kept = [r["digest"] for r in found if r["kept"]]
    assert len(kept) == len(set(kept)) == len({normal(t) for _, t in ROWS})
    assert all(r["doc_id"] == r["keep_id"] for r in found if r["kept"])


def test_full_bytes_decide_where_digests_collide(spark):
    def weak(text):
        return F.length(text).cast("string")

    found = exact.group_rows(frame(spark), digest=weak).collect()
    assert sorted((str((r["doc_id"], r["keep_id"], r["group_size"])) for r in found)) == sorted(str(e[:3]) for e in expected())
    assert sum(r["kept"] for r in found) == len({normal(t) for _, t in ROWS})


def test_kept_rows_have_all_columns(spark, tmp_path):
    path = str(tmp_path / "docs")
    frame(spark).repartition(4).write.parquet(path)
    for docs in (spark.read.parquet(path), frame(spark)):
        kept = exact.keep_first(docs)
        assert kept.columns == docs.columns
        found = [r["text"] for r in kept.collect()]
        assert len(found) == len({normal(t) for _, t in ROWS})
        assert {normal(t) for t in found} == {normal(t) for _, t in ROWS}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact.group_rows(docs).count() == 0
    assert exact.keep_first(docs).count() == 0


def test_state_store_setting_is_put_back(spark):
    before = spark.conf.get(exact.PROVIDER, None)
    exact.group_rows(frame(spark)).count()
    assert spark.conf.get(exact.PROVIDER, None) == before
