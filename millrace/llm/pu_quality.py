"""Quality classifier by positive-unlabelled learning.

Trusted positives are texts labelled good; everything else is unlabelled web text, of which an unknown share
is good too. With ``prior`` that share, ``P`` a mean over positives and ``U`` one over unlabelled texts, the
risk of a score g under logistic loss is

    prior * P[loss(g, +1)] + max(0, U[loss(g, -1)] - prior * P[loss(g, -1)])

Without the bound at 0 the second part, which estimates the loss on bad texts, goes negative once the model
fits the positives by heart; where a minibatch has it negative, the step undoes that instead.

The prior is estimated from scores of texts held out from a first fit: the share of unlabelled texts above a
threshold over the share of positives above it is at least the prior, and comes closest where the texts above
are all good; the least ratio, with a margin for small counts, is taken.

A text is described by its shape: frequencies of one to three characters in a row with letters and digits
replaced by their kind, and of repeated words and lines. All of it is counts over the whole text, so a text
may be worked on in pieces. Labels, language, source and id are never part of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.encoding import once_per_worker, splitter, text_rows
from millrace.llm.pretokens import END_POINT, chunks

SHAPES = 1024
STATS = 6
WIDTH = SHAPES + STATS
# Rows that a model is fitted on: at most this many of each kind.
POSITIVES = 4000
UNLABELLED = 8000


@dataclass(frozen=True)
class QualityModel:
    """Weights over features and a bias; ``prior`` is the estimated share of good texts."""

    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.weights + self.bias, -40, 40)))


def _shapes() -> np.ndarray:
    """Shape of every code point: its kind for letters, digits and spaces, itself for the rest."""
    kinds = splitter().kinds
    shape = np.arange(END_POINT + 1, dtype=np.uint32)
    shape[kinds == 0] = 1
    shape[kinds == 1] = 2
    shape[kinds == 2] = 3
    cased = "".join(chr(c) for c in np.flatnonzero(kinds == 0))
    shape[[ord(c) for c in cased if c.isupper()]] = 4
    shape[0x0A] = 5
    return shape


def text_features(texts: list[str]) -> np.ndarray:
    """One row of features per text; an empty text has only zeros."""
    n = len(texts)
    grams = np.zeros(n * SHAPES)
    words, same, near, letters = (np.zeros(n) for _ in range(4))
    for held, owner in chunks(texts):
        points, starts, ends, hashes, piece = splitter().split(held)
        text_of = np.repeat(np.array([0, *owner, 0]), [1, *(len(p) + 1 for p in held), 1])[: len(points)]
        inside = points != END_POINT
        shape = once_per_worker("shapes", _shapes)[points]
        gram = np.zeros(len(points), np.uint32)
        whole = inside.copy()
        for length in (1, 2, 3):
            if length > 1:
                whole[: len(whole) - length + 1] &= inside[length - 1 :]
                whole[len(whole) - length + 1 :] = False
            gram[: len(gram) - length + 1] = gram[: len(gram) - length + 1] * np.uint32(0x01000193) + shape[length - 1 :]
            mixed = (gram * np.uint32(0x9E3779B1) + np.uint32(length)) * np.uint32(0x85EBCA6B)
            at = text_of[whole] * SHAPES + (mixed[whole] >> np.uint32(22)).astype(np.int64)
            grams += np.bincount(at, minlength=len(grams))
        letters += np.bincount(text_of[splitter().kinds[points] == 0], minlength=n)
        of = np.array(owner)[piece] if len(piece) else piece
        words += np.bincount(of, minlength=n)
        for lag, into in ((1, same), (2, near)):
            equal = (hashes[lag:] == hashes[:-lag]) & (of[lag:] == of[:-lag]) if len(of) > lag else np.zeros(0, bool)
            into += np.bincount(of[lag:][equal], minlength=n)
    out = np.zeros((n, WIDTH), np.float32)
    sizes = np.fromiter(map(len, texts), np.float64, n)
    out[:, :SHAPES] = np.sqrt(grams.reshape(n, SHAPES) / np.maximum(sizes, 1)[:, None])
    lines = [[line for line in t.split("\n") if line.strip()] for t in texts]
    again = np.array([(len(held) - len(set(held))) / max(len(held), 1) for held in lines])
    some = np.maximum(words, 1)
    out[:, SHAPES] = np.sqrt(same / some)
    out[:, SHAPES + 1] = np.sqrt(near / some)
    out[:, SHAPES + 2] = again
    out[:, SHAPES + 3] = letters / np.maximum(sizes, 1)
    out[:, SHAPES + 4] = np.minimum(letters / some, 20) / 20
    out[:, SHAPES + 5] = sizes > 0
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _descend(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, seed: int, epochs: int) -> tuple[np.ndarray, float]:
    """Weights by Adam over minibatches. Without a prior, unlabelled texts count as bad."""
    rng = np.random.default_rng(seed)
    width = positive.shape[1]
    w, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    size, step = 512, 0
    for epoch in range(epochs):
        order = rng.permutation(len(unlabelled))
        rate = 0.05 * (1 - epoch / epochs) + 0.001
        for at in range(0, len(order), size):
            u = unlabelled[order[at : at + size]]
            p = positive[rng.integers(0, len(positive), size)]
            zp, zu = p @ w[:-1] + w[-1], u @ w[:-1] + w[-1]
            up, uu = _sigmoid(zp), _sigmoid(zu)  # slopes of the loss for label -1
            if prior is None:
                gp, gu = (up - 1) / len(p), uu / len(u)
            else:
                bad = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
                if bad >= 0:
                    gp, gu = prior * (up - 1 - up) / len(p), uu / len(u)
                else:
                    gp, gu = prior * up / len(p), -uu / len(u)
            g = np.append(gp @ p + gu @ u, gp.sum() + gu.sum())
            g[:-1] += 1e-4 * w[:-1]
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1].copy(), float(w[-1])


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of good texts among the unlabelled, from scores of held-out texts of both kinds."""
    if not len(positive) or not len(unlabelled):
        return 0.5
    p, u = np.sort(positive), np.sort(unlabelled)
    at = np.unique(p)
    above_p = 1 - np.searchsorted(p, at, side="left") / len(p)
    above_u = 1 - np.searchsorted(u, at, side="left") / len(u)
    margin = np.sqrt(np.log(20) / 2) * (1 / np.sqrt(len(p)) + 1 / np.sqrt(len(u)))
    best = np.argmin((above_u + margin) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 0, epochs: int = 30) -> QualityModel:
    """The model of least non-negative risk. Without texts of either kind every score is 0.5."""
    if not len(positive) or not len(unlabelled):
        return QualityModel(np.zeros(WIDTH), 0.0, 0.5)
    half_p, half_u = len(positive) // 2, len(unlabelled) // 2
    w, b = _descend(positive[: max(half_p, 1)], unlabelled[: max(half_u, 1)], None, seed, epochs // 2)
    prior = estimate_prior(positive[half_p:] @ w + b, unlabelled[half_u:] @ w + b)
    w, b = _descend(positive, unlabelled, prior, seed, epochs)
    return QualityModel(w, b, prior)


def remainder(id_col: str, by: int) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % by


def _bounded(rows: DataFrame, id_col: str, n: int) -> DataFrame:
    """At most n ids, the same ones each time: those of least hash."""
    ids = rows.select(id_col).where(F.col(id_col).isNotNull())
    known = ids.agg(F.approx_count_distinct(id_col)).first()[0]
    # Only about twice as many as are taken have to be told apart, however many rows an id has.
    bound = min((1 << 63) - 1, int((1 << 65) * n / max(known, 1)) - (1 << 63))
    return ids.where(F.xxhash64(id_col) <= bound).distinct().orderBy(F.xxhash64(id_col), id_col).limit(n)


def _features_of(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """Features of one text of each of these (bounded many) ids, on the driver, in an order of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in text_rows(batches):
            rows = text_features(texts)
            yield pa.RecordBatch.from_arrays([keys, pa.array([r.tobytes() for r in rows], pa.binary())], ["k", "x"])

    held = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    # Of an id with many texts, the one of least hash; tasks settle that among their own rows first.
    picked = held.join(F.broadcast(ids.select(F.col(id_col).alias("id"))), "id").groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = sorted((r.k, r.x) for r in picked.select(F.xxhash64("id"), "text").mapInArrow(run, "k bigint, x binary").collect())
    return np.array([np.frombuffer(x, np.float32) for _, x in rows]).reshape(len(rows), WIDTH)


def train(
    docs: DataFrame,
    labels: DataFrame,
    positives: int = POSITIVES,
    unlabelled: int = UNLABELLED,
    folds: int = 5,
    held_fold: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> QualityModel:
    """Model from documents outside the held-out fold.

    Fitted on at most ``positives`` texts labelled good and ``unlabelled`` texts of any kind, those whose ids
    have the least hashes, so on the same ones each time. An id gives one text, however many rows it has. Labels 0 are not used.
    """
    learned = remainder(id_col, folds) != held_fold
    good = labels.where((F.col("quality") == 1) & learned)
    p = _features_of(docs, _bounded(good, id_col, positives), id_col, text_col)
    u = _features_of(docs, _bounded(docs.where(learned), id_col, unlabelled), id_col, text_col)
    return fit(p, u)


def score_texts(
    docs: DataFrame,
    model: QualityModel,
    cut: float = 0.3,
    folds: int = 5,
    held_fold: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text; nothing is shuffled.

    A null text is an empty one; it has the score of no features at all. A null id is in no fold, so it is not
    held out. Rows are kept as they come, repeated ones too; no rows give none. Other columns are not passed on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in text_rows(batches):
            scores = model.scores(text_features(texts))
            yield pa.RecordBatch.from_arrays([keys, pa.array(scores, pa.float64())], [id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")
    return scored.select(
        id_col,
        F.coalesce(remainder(id_col, folds) == held_fold, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= cut).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, model: QualityModel, cut: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows whose score is at least ``cut``, with all their columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept: list[np.ndarray] = []
            for _, texts in text_rows(iter([batch.select([text_col, text_col])])):
                kept.append(model.scores(text_features(texts)) >= cut)
            yield batch.filter(pa.array(np.concatenate(kept) if kept else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)
