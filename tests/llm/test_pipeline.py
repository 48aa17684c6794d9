from __future__ import annotations

import sys
from pathlib import Path

import sentencepiece
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from tapegrid.llm import mixing, toxicity  # noqa: E402
from tapegrid.llm.queries import model_path  # noqa: E402
from tests.llm.test_exact import normal  # noqa: E402
from tests.llm.test_shingles import brute_first, corpus  # noqa: E402
from tests.llm.test_simhash import brute_components, brute_fingerprint  # noqa: E402


def write(spark, folder, docs, labels):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(f"{folder}/labels.parquet")


def test_stages_against_brute_force(spark, tmp_path):
    rows, labels = corpus()
    folder = str(tmp_path)
    write(spark, folder, rows, labels)
    found = corpus_pipeline.run(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    scorer = toxicity.Scorer(toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet")))
    clean = [r for r in rows if scorer.score(r[1]) < 0.5]
    toxic = {r[0] for r in rows if "grunk" in (r[1] or "")}
    rejected = {r[0] for r in rows} - {r[0] for r in clean}
    assert rejected <= toxic and len(rejected) > 0.8 * len(toxic)
    first = {}
    for r in clean:
        key = normal(r[1])
        if key not in first or r[0] < first[key][0]:
            first[key] = r
    single = list(first.values())
    components = brute_components({r[0]: brute_fingerprint(r[1]) for r in single})
    left = [r for r in single if components[r[0]] == r[0]]
    # Then texts that have 0.8 of their five-word shingles in common.
    first = brute_first([(r[0], r[1]) for r in left])
    apart = [r for r in left if first[r[0]] == r[0]]
    assert len(apart) < len(left) < len(single) < len(clean)
    frame = spark.createDataFrame(apart, docs.schema)
    copies = {r["doc_id"]: r["_copies"] for r in mixing.mixture(frame).select("doc_id", F.col("_copies")).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=model_path())
    wanted = sorted((r[0], library.encode(r[1] or "", add_eos=True)) for r in apart for _ in range(copies[r[0]]))
    assert sorted((r["doc_id"], list(r["ids"])) for r in found) == wanted


def test_stages_keep_the_columns(spark, tmp_path):
    write(spark, str(tmp_path), *corpus())
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def test_empty_tables(spark, tmp_path):
    write(spark, str(tmp_path), [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
