"""Quality classifier: a linear-chain conditional random field over the lines of a document."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_texts, map_batches, type_of

FIT_ROWS = 4000  # labelled documents the model is fitted on at most
FOLDS = 5
THRESHOLD = 0.3
OTHER, UPPER, LOWER, DIGIT, SPACE, STOP, PIPE, SYMBOL = range(8)
_TABLE = np.array([SPACE if chr(c).isspace() else UPPER if chr(c).isupper() else LOWER if chr(c).isalpha() else DIGIT if chr(c).isdigit()
                   else PIPE if chr(c) == "|" else STOP if chr(c) in ".,;:?'\"-" else SYMBOL if c < 0x180 else OTHER for c in range(0x590)], np.uint8)
NEAR = 7  # leading own features that are repeated for the line before and the line after


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # of the line features, for good against bad
    moves: np.ndarray  # log weight of (label before, label)
    slope: float  # of the document's log odds
    shift: float


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of every line, characters of every line, lines of every text); an empty text is one empty line."""
    lines, counts, repeated = [], np.zeros(len(texts), np.int64), []
    for i, text in enumerate(texts):
        own, seen = text.split("\n"), set()
        counts[i] = len(own)
        for line in own:
            repeated.append(line in seen)
            seen.add(line)
        lines += own
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    points = np.frombuffer("\n".join([*lines, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    kinds = _TABLE[np.minimum(points, len(_TABLE) - 1)]
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    share = [np.add.reduceat((kinds == k).astype(np.int32), starts) / np.maximum(sizes, 1) for k in (UPPER, SYMBOL, PIPE, DIGIT, STOP)]
    words = [line.split() for line in lines]
    total = np.fromiter(map(len, words), np.int64, len(lines))
    kinds_of_word = np.fromiter((len(set(w)) for w in words), np.int64, len(lines))
    variety = kinds_of_word / np.maximum(np.minimum(total, 40), 1)
    ends = np.fromiter((line[-1:] in (".", "!", "?", '"') for line in lines), float, len(lines))
    own = np.stack([*share, np.asarray(repeated, float), np.minimum(variety, 1.0), np.log1p(sizes) / 8, sizes / np.maximum(total, 1) / 40, ends,
                    (total == 0).astype(float), np.ones(len(lines))], axis=1)
    own[:, 8] = np.minimum(own[:, 8], 2)
    first = np.zeros(len(lines), bool)
    first[np.concatenate([[0], np.cumsum(counts)[:-1]])] = True
    before, after = np.zeros((len(lines), NEAR)), np.zeros((len(lines), NEAR))
    before[1:] = own[:-1, :NEAR]
    before[first] = 0
    after[:-1] = own[1:, :NEAR]
    after[np.append(np.flatnonzero(first)[1:] - 1, len(lines) - 1)] = 0
    return np.concatenate([own, before, after], axis=1), sizes, counts


def marginals(scores: np.ndarray, counts: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over many chains at once: (probability of good for every line, expected moves between labels)."""
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    order = np.argsort(-counts, kind="stable")
    begin, length = starts[order], counts[order]
    psi = np.stack([np.ones(len(scores)), np.exp(np.clip(scores, -30, 30))], axis=1)
    move = np.exp(np.clip(moves, -30, 30))
    alpha, beta = np.empty_like(psi), np.ones_like(psi)
    longest = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(longest), side="left")  # chains longer than t
    for t in range(longest):
        at = begin[:active[t]] + t
        value = psi[at] if t == 0 else (alpha[at - 1] @ move) * psi[at]
        alpha[at] = value / value.sum(1, keepdims=True)
    expected = np.zeros((2, 2))
    for t in range(longest - 1, 0, -1):
        at = begin[:active[t]] + t
        ahead = psi[at] * beta[at]
        pair = alpha[at - 1][:, :, None] * move[None] * ahead[:, None, :]
        expected += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
        value = ahead @ move.T
        beta[at - 1] = value / value.sum(1, keepdims=True)
    both = alpha * beta
    return both[:, 1] / both.sum(1), expected


def document_odds(good: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Log odds of the length-weighted mean of the line marginals."""
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    weight = sizes + 1.0
    mean = np.clip(np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts), 1e-6, 1 - 1e-6)
    return np.log(mean / (1 - mean))


def fit(features: np.ndarray, sizes: np.ndarray, counts: np.ndarray, labels: np.ndarray, rounds: int = 150, decay: float = 1e-3) -> Model:
    """Likelihood of the chains whose lines all carry their document's label, by adaptive gradient steps; then the odds
    of the document mean are fitted to the labels, so that a score is a probability of label 1."""
    y = np.repeat(labels, counts).astype(float)
    chains = len(counts)
    seen = np.array([[(counts - 1)[labels == 0].sum(), 0], [0, (counts - 1)[labels == 1].sum()]], float)
    theta = np.zeros(features.shape[1] + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        good, expected = marginals(features @ theta[4:], counts, theta[:4].reshape(2, 2))
        grad = np.concatenate([(seen - expected).ravel(), features.T @ (y - good)]) / chains - decay * theta
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
        theta += 0.1 * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-8)
    good, _ = marginals(features @ theta[4:], counts, theta[:4].reshape(2, 2))
    odds = document_odds(good, sizes, counts)
    x, beta = np.stack([odds, np.ones(chains)], axis=1), np.array([0.5, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-2, 1e-2])
        beta = beta + np.linalg.solve(hessian, x.T @ (labels - p) - 1e-2 * beta)
    return Model(theta[4:], theta[:4].reshape(2, 2), float(beta[0]), float(beta[1]))


def score(texts: list[str], model: Model) -> np.ndarray:
    features, sizes, counts = line_features(texts)
    good, _ = marginals(features @ model.weights, counts, model.moves)
    return 1 / (1 + np.exp(-np.clip(model.slope * document_odds(good, sizes, counts) + model.shift, -30, 30)))


def held_out(column) -> Column:
    """Rows nothing is learnt from; a row without id is one."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % FOLDS == 0, F.lit(True))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                fit_rows: int = FIT_ROWS) -> Model | float:
    """The model, from at most ``fit_rows`` labelled documents that are not held out, taken by a hash of their id.

    Without both labels among them there is nothing to learn: the share of good ones, or 0.5, is every document's score.
    """
    chosen = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_y in (0, 1)").where(~held_out("_id"))
    chosen = chosen.groupBy("_id").agg(F.min("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(fit_rows)
    picked = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).cast("string").alias("_text")).join(
        F.broadcast(chosen), F.col("_doc") == F.col("_id")).select("_text", "_y", "_id")  # at most fit_rows rows

    def describe(batch: pa.RecordBatch) -> pa.RecordBatch:
        features, sizes, counts = line_features(arrow_texts(batch.column(0)))
        ends = np.cumsum(counts)
        cells = [features[e - c:e].astype("<f4").tobytes() for c, e in zip(counts, ends)]
        chars = [sizes[e - c:e].astype("<i8").tobytes() for c, e in zip(counts, ends)]
        return pa.RecordBatch.from_arrays([batch.column(2), batch.column(1), pa.array(cells, pa.binary()), pa.array(chars, pa.binary())], ["id", "y", "cells", "chars"])

    rows = map_batches(picked, describe, f"id {type_of(labels, id_col)}, y int, cells binary, chars binary").collect()
    rows.sort(key=lambda r: (r["id"], bytes(r["cells"])))
    y = np.array([r["y"] for r in rows], int)
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.5
    sizes = [np.frombuffer(bytes(r["chars"]), "<i8") for r in rows]
    counts = np.array([len(s) for s in sizes])
    features = np.frombuffer(b"".join(bytes(r["cells"]) for r in rows), "<f4").reshape(counts.sum(), -1).astype(float)
    return fit(features, np.concatenate(sizes), counts, y)


def score_quality(docs: DataFrame, model: Model | float, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per row of ``docs``, from its whole text alone.

    A null or empty text is one empty line and gets a score like any other; repeated rows get equal scores; an empty table gives no rows.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = arrow_texts(batch.column(1))
        values = np.full(len(texts), model) if isinstance(model, float) else score(texts, model)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64()), pa.array((values >= threshold).astype(np.int32), pa.int32())],
                                          ["doc_id", "score", "predicted"])

    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = map_batches(base, run, f"doc_id {type_of(docs, id_col)}, score double, predicted int")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, model: Model | float, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``, all columns kept; texts are not shuffled."""
    at = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = arrow_texts(batch.column(at))
        values = np.full(len(texts), model) if isinstance(model, float) else score(texts, model)
        return batch.filter(pa.array(values >= threshold))

    return map_batches(docs, run, docs.schema)
