"""Toxicity: a linear classifier whose score may not depend on which group a text mentions."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapegrid.session import settle

TOKEN = re.compile(r"[^\W_]+")
PREFIXES = (4, 5, 6)
REMEMBERED_WORDS = 100_000

# Identity terms, exchangeable within a row.
IDENTITY_TERMS = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("women", "men"),
    ("woman", "man"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("disabled", "blind", "deaf"),
    ("muslime", "christen", "juden"),
    ("frauen", "männer"),
    ("musulmans", "chrétiens", "juifs"),
    ("femmes", "hommes"),
    ("musulmanes", "cristianos", "judíos"),
    ("mujeres", "hombres"),
)
NEUTRAL_TERM = "person"


@dataclass(frozen=True)
class Settings:
    """``max_rows`` bounds the labelled sample that is fitted; ``terms`` the vocabulary."""

    max_rows: int = 16_000
    terms: int = 2_048
    min_docs: int = 3
    ridge: float = 1e-4
    fairness: float = 1.0
    steps: int = 300
    learning_rate: float = 0.1
    identity: tuple[tuple[str, ...], ...] = IDENTITY_TERMS
    neutral: str = NEUTRAL_TERM


@dataclass(frozen=True)
class Model:
    """Weights of words (``w:word``) and word beginnings (``p:begin``)."""

    bias: float
    weights: dict[str, float] = field(default_factory=dict)


def word_features(word: str) -> list[str]:
    return ["w:" + word, *["p:" + word[:n] for n in PREFIXES if len(word) > n]]


def features(words: set[str]) -> set[str]:
    """Distinct words of a text and their beginnings, which carry inflected and compound words."""
    return {f for word in words for f in word_features(word)}


def swaps(words: set[str], settings: Settings) -> list[set[str]]:
    """The text's words with its identity terms exchanged: once for the next of their group, once
    for the neutral term. Nothing if it has none."""
    following, neutral = {}, {}
    for group in settings.identity:
        for i, term in enumerate(group):
            if term in words:
                following[term] = group[(i + 1) % len(group)]
                neutral[term] = settings.neutral
    return [{m.get(w, w) for w in words} for m in (following, neutral)] if following else []


def counterfactuals(words: set[str], settings: Settings) -> list[set[str]]:
    """Texts that may score no differently: the text with its identity terms exchanged, or, where it
    has none, with a term put in and with that term exchanged for the next of its group. The term is
    drawn by a digest of the words."""
    found = swaps(words, settings)
    if found or not settings.identity:
        return found
    draw = zlib.crc32(" ".join(sorted(words)).encode())
    group = settings.identity[draw % len(settings.identity)]
    first = draw // len(settings.identity) % len(group)
    return [words | {group[first]}, words | {group[(first + 1) % len(group)]}]


# --- training -------------------------------------------------------------------------------------


def training_rows(docs: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """``doc_id, text, toxic`` of at most ``max_rows`` labelled documents, drawn by digest.

    Documents whose crc32 of the id is divisible by five are held out. Only the drawn ids, whose
    number ``max_rows`` bounds, are broadcast.
    """
    drawn = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(settings.max_rows)
    )
    return settle(docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id"))


def held_out(id_col: str) -> Column:
    """crc32 of the id as text is divisible by five."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def vocabulary(rows: DataFrame, settings: Settings) -> list[str]:
    """The features that tell the classes apart best, by a signed root of chi-square.

    Counted by Spark over all training rows; the driver gets at most ``terms`` of them. Identity
    terms and the neutral term are always in, so that the penalty can hold them together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, toxic in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = pa.array(sorted(features(set(TOKEN.findall((text or "").lower())))), pa.string())
                side = pa.array(np.full(len(found), int(toxic > 0)), pa.int32())
                yield pa.RecordBatch.from_arrays([found, side], names=["feature", "toxic"])

    counts = (
        rows.select("doc_id", "text", "toxic")
        .mapInArrow(run, "feature string, toxic int")
        .groupBy("feature")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("n_toxic"))
        .where(F.col("n") >= settings.min_docs)
    )
    total = rows.agg(F.count(F.lit(1)), F.coalesce(F.avg((F.col("toxic") > 0).cast("double")), F.lit(0.0))).first()
    share = float(total[1])
    if not 0 < share < 1:
        return []
    expected = F.col("n") * F.lit(share)
    strength = F.abs(F.col("n_toxic") - expected) / F.sqrt(expected)
    best = counts.orderBy(strength.desc(), "feature").limit(settings.terms).select("feature").collect()
    fixed = {"w:" + t for group in settings.identity for t in group} | {"w:" + settings.neutral}
    return sorted({row["feature"] for row in best} | fixed)


def encoded_rows(rows: DataFrame, terms: Sequence[str], settings: Settings) -> list[tuple]:
    """(toxic, feature numbers, changes) of the bounded sample: per counterfactual the features that
    it takes out and those it puts in, which are few."""
    shared = rows.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = shared.value

        def code(words: set[str]) -> set[int]:
            return {numbers[f] for f in features(words) if f in numbers}

        def changes(words: set[str], own: set[int]) -> list[list[list[int]]]:
            others = map(code, counterfactuals(words, settings))
            return [[sorted(own - other), sorted(other - own)] for other in others]

        for frame in frames:
            words = [set(TOKEN.findall((t or "").lower())) for t in frame["text"]]
            own = [code(w) for w in words]
            yield pd.DataFrame(
                {
                    "doc_id": frame["doc_id"],
                    "toxic": (frame["toxic"] > 0).astype(int),
                    "own": [sorted(o) for o in own],
                    "changes": [changes(w, o) for w, o in zip(words, own, strict=True)],
                }
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, toxic int, own array<int>, changes array<array<array<int>>>"
    found = rows.select("doc_id", "text", "toxic").mapInPandas(run, schema).collect()
    return sorted((r["doc_id"], r["toxic"], r["own"], r["changes"]) for r in found)


def _flat(lists: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the ones of a sparse matrix."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    columns = np.fromiter((c for row in lists for c in row), np.int64, int(sizes.sum()))
    return np.repeat(np.arange(len(lists)), sizes), columns


class Loss:
    """Mean log loss of the sample, plus ``fairness`` times the mean squared difference of the log odds
    of a text and of its counterfactuals, plus a ridge term. The last parameter is the bias."""

    def __init__(self, rows: Sequence[tuple], size: int, settings: Settings):
        self.toxic = np.array([r[1] for r in rows], dtype=float)
        self.at, self.column = _flat([r[2] for r in rows])
        pairs = [change for r in rows for change in r[3]]
        out_at, out = _flat([taken for taken, _ in pairs])
        in_at, put = _flat([put for _, put in pairs])
        self.pair_at, self.pair_column = np.append(out_at, in_at), np.append(out, put)
        self.sign = np.append(np.ones(len(out)), -np.ones(len(put)))
        self.pairs, self.size, self.settings = len(pairs), size, settings

    def __call__(self, parameters: np.ndarray) -> tuple[float, np.ndarray]:
        """Value and gradient."""
        weights, bias, n = parameters[:-1], parameters[-1], len(self.toxic)
        logit = np.clip(np.bincount(self.at, weights[self.column], n) + bias, -30, 30)
        error = (1 / (1 + np.exp(-logit)) - self.toxic) / n
        ridge = self.settings.ridge
        value = np.mean(np.log1p(np.exp(logit)) - self.toxic * logit) + ridge / 2 * weights @ weights
        gradient = np.append(np.bincount(self.column, error[self.at], self.size) + ridge * weights, error.sum())
        if self.pairs:
            gap = np.bincount(self.pair_at, self.sign * weights[self.pair_column], self.pairs)
            value += self.settings.fairness * np.mean(gap**2)
            back = 2 * self.settings.fairness * gap / self.pairs
            gradient[:-1] += np.bincount(self.pair_column, self.sign * back[self.pair_at], self.size)
        return float(value), gradient


def fit_weights(rows: Sequence[tuple], size: int, settings: Settings) -> tuple[float, np.ndarray]:
    """Logistic regression with the counterfactual penalty, by Adam on the whole sample."""
    loss = Loss(rows, size, settings)
    n, toxic = len(rows), loss.toxic.sum()
    parameters = np.zeros(size + 1)
    parameters[-1] = np.log((toxic + 0.5) / (n - toxic + 1.5))
    mean, square = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, settings.steps + 1 if 0 < toxic < n else 1):
        gradient = loss(parameters)[1]
        mean += 0.1 * (gradient - mean)
        square += 0.001 * (gradient**2 - square)
        rate = settings.learning_rate * min(1.0, 2 * (1 - step / (settings.steps + 1)))
        parameters -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return float(parameters[-1]), parameters[:-1]


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:  # noqa: B008
    """Fit on the bounded sample. Without rows of both classes only the base rate remains."""
    rows = training_rows(docs, labels, settings)
    terms = vocabulary(rows, settings)
    sample = encoded_rows(rows, terms, settings)
    bias, weights = fit_weights(sample, len(terms), settings)
    return Model(bias, {t: float(w) for t, w in zip(terms, weights, strict=True) if w})


# --- scoring --------------------------------------------------------------------------------------


class Scorer:
    """Scores texts, remembering the weighted features of the words met (a bounded number)."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, tuple[str, ...]] = {}

    def _of(self, word: str) -> tuple[str, ...]:
        found = tuple(f for f in word_features(word) if f in self.model.weights)
        if len(self.known) < REMEMBERED_WORDS:
            self.known[word] = found
        return found

    def score(self, text: str | None) -> float:
        words = set(TOKEN.findall((text or "").lower()))
        known = self.known
        met = {f for w in words for f in (known[w] if w in known else self._of(w))}
        logit = self.model.bias + sum(self.model.weights[f] for f in sorted(met))
        return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))


def score_column(model: Model, docs: DataFrame, text_col: str = "text") -> Column:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for batch in texts:
            yield pd.Series([scorer.score(t) for t in batch], dtype=float)

    return score(F.col(text_col))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted``: one row per row of ``docs``, from the text alone.

    Null and empty texts get the score of a text without words; a null id is not held out. Other
    columns are ignored. No shuffle.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.select("doc_id", score_column(model, rows).alias("score")).select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def flagged_mentions(docs: DataFrame, model: Model, settings: Settings = Settings(), text_col: str = "text") -> DataFrame:  # noqa: B008
    """``term, clean, flagged``: of the texts under one half, how many a neutral mention of each identity
    term puts at one half or more."""
    terms = F.array(*[F.lit(t) for group in settings.identity for t in group])
    clean = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("score", score_column(model, docs))
    told = clean.where("score < 0.5").select("text", F.explode(terms).alias("term"))
    told = told.withColumn("text", F.concat_ws(" ", "text", "term"))
    return (
        told.withColumn("score", score_column(model, docs))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("clean"), F.count_if(F.col("score") >= 0.5).alias("flagged"))
    )


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score under one half, all columns kept."""
    score = score_column(model, docs, text_col)
    return docs.select(F.struct("*").alias("row"), score.alias("score")).where("score < 0.5").select("row.*")
