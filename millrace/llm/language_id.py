"""Language identification: averaged embeddings of hashed subwords, a linear softmax, calibrated rejection.

A text is lower-cased; its subwords are the windows of two to four characters of its words, with one mark for
whatever stands between words, hashed into ``BUCKETS`` rows of an embedding table. The mean of their embeddings goes
through a linear layer and a softmax. Table and layer are trained together by stochastic gradient descent on
a bounded sample of labelled texts. For prediction the layer is multiplied into the table once, so a text costs
one row of as many numbers as there are languages per subword.

Some of the sample is kept back to calibrate, each language with its share of the corpus: a temperature that makes scores
honest, then the least score that is accepted. Labels may be wrong: the share of errors in the upper half of the scores
is taken for theirs, and only errors beyond it count against a score. Only scores below ``SURE`` are ever rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.encoding import splitter, text_rows
from millrace.llm.pretokens import END_POINT, chunks

BUCKETS = 1 << 16
WIDTH = 16
SUBWORDS = (2, 3, 4)
# Labelled texts of one language that a model is fitted on, at most, and languages there may be.
PER_LANGUAGE = 400
LANGUAGES = 512
UNKNOWN = "und"
# Shares of the best score that labels allow: below the first a text is rejected, from the second on never.
GUESS, SURE = 0.5, 0.8
# Deviations by which errors must exceed those of the labels.
MARGIN = 2.0


@dataclass(frozen=True)
class LanguageModel:
    """Folded table (bucket x language), languages, bias-free temperature and least accepted score."""

    languages: list[str]
    table: np.ndarray
    temperature: float
    least_score: float

    def probabilities(self, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
        z = sums / np.maximum(counts, 1)[:, None] / self.temperature
        z -= z.max(axis=1, keepdims=True)
        e = np.exp(z)
        return e / e.sum(axis=1, keepdims=True)


def subwords(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the text, bucket) of subwords, for one length and one chunk of texts at a time."""
    for held, owner in chunks([t.lower() for t in texts]):
        sizes = [len(p) for p in held]
        points = np.full(sum(sizes) + 2 * len(held), END_POINT, np.uint32)
        text_of = np.repeat(np.array(owner), [n + 2 for n in sizes])
        at = 0
        for part, n in zip(held, sizes):
            points[at + 1 : at + 1 + n] = np.frombuffer(part.encode("utf-32-le"), np.uint32)
            at += n + 2
        letter = splitter().kinds[points] == 0
        # A run of what is no letter counts as one mark.
        keep = letter.copy()
        keep[0] = True
        keep[1:] |= letter[:-1] | (text_of[1:] != text_of[:-1])
        points, letter, text_of = np.where(letter, points, 0)[keep], letter[keep], text_of[keep]
        gram = points.astype(np.uint32)
        whole = np.ones(len(points), bool)
        for length in range(2, max(SUBWORDS) + 1):
            n = len(points) - length + 1
            if n <= 0:
                break
            if length > 2:  # marks only at the ends
                whole = whole[:n] & letter[length - 2 : length - 2 + n]
            else:
                whole = whole[:n]
            gram = gram[:n] * np.uint32(0x01000193) + points[length - 1 :]
            good = whole & (text_of[:n] == text_of[length - 1 :]) & (letter[:n] | letter[1 : n + 1])
            mixed = (gram[good] * np.uint32(0x9E3779B1) + np.uint32(length)) * np.uint32(0x85EBCA6B)
            yield text_of[:n][good], (mixed >> np.uint32(16)).astype(np.int64)


def fit(
    bags: list[tuple[np.ndarray, np.ndarray]],
    labels: np.ndarray,
    languages: list[str],
    epochs: int = 12,
    rate: float = 4.0,
    seed: int = 0,
    target_error: float = 0.01,
    totals: np.ndarray | None = None,
) -> LanguageModel:
    """Model from bags (buckets, counts). Every fifth bag only calibrates; ``totals`` are the texts of each language."""
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    layer = np.zeros((WIDTH, len(languages)), np.float32)
    numbers = np.arange(len(bags))
    calibrating = numbers % 5 == 4
    learning = numbers[~calibrating]
    shares = [(b, (c / c.sum()).astype(np.float32)) for b, c in bags]
    for epoch in range(epochs):
        for i in rng.permutation(learning):
            buckets, share = shares[i]
            mean = share @ table[buckets]
            z = mean @ layer
            e = np.exp(z - z.max())
            slope = e / e.sum()
            slope[labels[i]] -= 1
            step = rate * (1 - epoch / epochs)
            back = layer @ slope
            layer -= 0.1 * step * np.outer(mean, slope)
            table[buckets] -= step * share[:, None] * back
    folded = (table @ layer).astype(np.float32)
    held = numbers[calibrating] if calibrating.any() else numbers
    if not len(held):
        return LanguageModel(languages, folded, 1.0, 0.0)
    z = np.array([shares[i][1] @ folded[shares[i][0]] for i in held])
    truth = labels[held]
    found = np.bincount(truth, minlength=len(languages))
    weights = ((found if totals is None else totals) / np.maximum(found, 1))[truth]

    def loss(t: float) -> float:
        s = z / t
        top = s.max(axis=1)
        return float(np.average(top + np.log(np.exp(s - top[:, None]).sum(axis=1)) - s[np.arange(len(s)), truth], weights=weights))

    temperature = float(min(np.geomspace(0.02, 20, 61), key=loss))
    p = np.exp((z - z.max(axis=1, keepdims=True)) / temperature)
    p /= p.sum(axis=1, keepdims=True)
    return LanguageModel(languages, folded, temperature, least_accepted(p.max(axis=1), p.argmax(axis=1) != truth, weights, target_error))


def least_accepted(scores: np.ndarray, wrong: np.ndarray, weights: np.ndarray, target_error: float = 0.01) -> float:
    """Least score to accept, from scores, errors and weights of calibration texts."""
    order = np.argsort(scores, kind="stable")
    scores, wrong, weights = scores[order], wrong[order], weights[order]
    above = weights[::-1].cumsum()[::-1]  # of this one and all above it, as the next two
    errors = (wrong * weights)[::-1].cumsum()[::-1] / above
    size = above**2 / (weights**2)[::-1].cumsum()[::-1]
    noise = float(errors[np.flatnonzero(above >= above[0] / 2)[-1]])  # of the upper half
    rate = min(noise + target_error, 1.0)
    good = np.flatnonzero(errors <= rate + MARGIN * np.sqrt(rate * (1 - rate) / size))
    # Where all of them may be accepted, only what is no better than a guess between two languages is not.
    least = 0.0 if good[0] == 0 else float(scores[good[0]])
    return min(max(least, GUESS * (1 - noise)), SURE * (1 - noise))


def train(
    docs: DataFrame,
    folds: int = 4,
    held_fold: int = 2,
    per_language: int = PER_LANGUAGE,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> LanguageModel:
    """Model from text and non-null language of the documents outside the held-out fold.

    Fitted on at most ``per_language`` whole texts of each language, those whose ids have the least hashes, so on the
    same ones each time. An id gives one text of a language, however many rows it has. More than ``LANGUAGES`` languages are refused.
    """
    learned = docs.where(
        F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()
        & (F.crc32(F.col(id_col).cast("string")) % folds != held_fold)
    )
    sizes = learned.groupBy(lang_col).agg(F.count(F.lit(1)), F.approx_count_distinct(id_col)).orderBy(lang_col).limit(LANGUAGES + 1).collect()
    counts = {r[0]: r[1] for r in sizes}
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    languages = list(counts)
    if not languages:
        return fit([], np.zeros(0, np.int64), [])
    unit = 1 << 30
    limits = F.create_map(*[
        x for lang, _, n in sizes for x in (F.lit(lang), F.lit(min(unit, 2 * unit * per_language // n)))
    ])
    held = learned.select(F.col(lang_col).alias("lang"), F.xxhash64(id_col).alias("k"), F.col(text_col).alias("text"))
    place = F.pmod("k", F.lit(unit))
    # About twice as many ids as are taken are told apart; those taken are at most as many for each of at most LANGUAGES.
    ids = held.select("lang", "k").where(place < limits[F.col("lang")]).distinct()
    first = Window.partitionBy("lang").orderBy(place, "k")
    ids = ids.withColumn("no", F.row_number().over(first)).where(F.col("no") <= per_language).select("lang", "k")
    picked = held.join(F.broadcast(ids), ["lang", "k"]).groupBy("lang", "k").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = part.column(2).to_pylist()
                own: list[list[np.ndarray]] = [[] for _ in texts]
                for of, bucket in subwords(texts):
                    for i in np.unique(of):
                        own[i].append(bucket[of == i])
                bags = [np.unique(np.concatenate(b), return_counts=True) if b else None for b in own]
                ok = [i for i, b in enumerate(bags) if b is not None]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(ok, pa.int64())),
                        part.column(1).take(pa.array(ok, pa.int64())),
                        pa.array([bags[i][0].astype(np.uint16).tobytes() for i in ok], pa.binary()),
                        pa.array([bags[i][1].astype(np.uint32).tobytes() for i in ok], pa.binary()),
                    ],
                    ["k", "lang", "buckets", "counts"],
                )

    rows = picked.select("k", "lang", "text").mapInArrow(
        run, "k bigint, lang string, buckets binary, counts binary"
    ).collect()
    rows.sort(key=lambda r: (r.k, r.lang, r.buckets))
    bags = [
        (np.frombuffer(r.buckets, np.uint16).astype(np.int64), np.frombuffer(r.counts, np.uint32).astype(np.float64))
        for r in rows
    ]
    return fit(bags, np.array([languages.index(r.lang) for r in rows], np.int64), languages, totals=np.array([counts[x] for x in languages], np.float64))


def predictions(model: LanguageModel, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language and score of each text, and whether it is accepted; UNKNOWN with score 0 for texts without letters.

    A model without languages knows none and accepts every text with a letter.
    """
    n = len(texts)
    sums, counts = np.zeros((n, len(model.languages))), np.zeros(n)
    for of, bucket in subwords(texts):
        counts += np.bincount(of, minlength=n)
        bounds = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
        if len(bounds):
            sums[of[bounds]] += np.add.reduceat(model.table[bucket], bounds, axis=0, dtype=np.float64)
    if not model.languages:
        return [UNKNOWN] * n, np.zeros(n), counts > 0
    p = model.probabilities(sums, counts)
    best, score = p.argmax(axis=1), np.where(counts > 0, p.max(axis=1), 0.0)
    return [model.languages[b] if c else UNKNOWN for b, c in zip(best, counts)], score, (counts > 0) & (score >= model.least_score)


def identify(
    docs: DataFrame,
    model: LanguageModel,
    folds: int = 4,
    held_fold: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, accepted`` of every whole text; nothing is shuffled.

    A null text, an empty one and one without a letter are ``und`` with score 0 and not accepted. Of languages with
    equal scores the first by name is taken. A null id is in no fold, so it is not held out. Rows are kept as they come,
    repeated ones too; no rows give none. Other columns are not passed on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in text_rows(batches):
            found, score, accepted = predictions(model, texts)
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(found, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())],
                [id_col, "lang_pred", "score", "accepted"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, accepted boolean")
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == held_fold, F.lit(False))
    return scored.select(id_col, held.alias("held_out"), "lang_pred", "score", "accepted")


def keep_accepted(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows whose language is accepted, with all their columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept: list[np.ndarray] = []
            for _, texts in text_rows(iter([batch.select([text_col, text_col])])):
                kept.append(predictions(model, texts)[2])
            yield batch.filter(pa.array(np.concatenate(kept) if kept else np.zeros(0, bool), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
