"""Operator 3: toxicity, logistic regression learned by FTRL-proximal.

Features are the distinct hashed words, word pairs and skip pairs (one word
between) of a whole text, lower-cased and stripped of outer punctuation.
Training is the online FTRL-proximal update with one learning rate per
coordinate and L1, so most coordinates stay exactly zero and the model that
is broadcast is a short sorted list of (coordinate, weight).  Scoring is
map-only: look the coordinates of a text up in that list.

The fit uses at most ``fit_rows`` labelled rows (hashed on the executors,
learned in one pass order on the driver); everything else covers all rows.

Defined results: a null, empty or word-less text gets the score of the bias;
null ids keep their row with ``held_out`` false; repeated rows are scored one
by one; an empty table gives an empty result; with no labelled row the score
is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import WordHash, fit_labels, held_out, sample_rows

BITS = 20


@dataclass(frozen=True)
class FtrlParams:
    fit_rows: int = 12_000     # bound of the labelled training sample
    epochs: int = 5
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.0
    seed: int = 11


def _normal(word: str) -> str:
    return word.lower().strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¿¡«»")


def word_hashes() -> WordHash:
    return WordHash(1 << 32, normal=_normal)


def coordinates(text: str | None, hashes: WordHash) -> np.ndarray:
    """All feature coordinates of one whole text (with repeats)."""
    words = (text or "").split()
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    mult, add = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
    shift = np.uint64(64 - BITS)
    parts = [(h * mult) >> shift]
    for gap, salt in ((1, 3), (2, 5)):
        a, b = h[:-gap], h[gap:]
        parts.append((((a * add) ^ (b * np.uint64(2 * salt + 1))) * mult + np.uint64(salt)) >> shift)
    return np.concatenate(parts).astype(np.int32)


def fit(rows: list[tuple[np.ndarray, int]], p: FtrlParams):
    """FTRL-proximal over the rows; returns (bias, coordinates, weights)."""
    dim = 1 << BITS
    z, n = np.zeros(dim + 1), np.zeros(dim + 1)
    rng = np.random.default_rng(p.seed)
    rows = [(np.append(ids, dim), y) for ids, y in rows]   # the last coordinate is the bias
    for _ in range(p.epochs):
        for k in rng.permutation(len(rows)):
            ids, y = rows[k]
            zi, ni = z[ids], n[ids]
            l1 = np.full(len(ids), p.l1)
            l1[-1] = 0.0
            w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((p.beta + np.sqrt(ni)) / p.alpha + p.l2))
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -40, 40))) - y
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / p.alpha
            z[ids] = zi + g - sigma * w
            n[ids] = ni + g * g
    l1 = np.full(dim + 1, p.l1)
    l1[-1] = 0.0
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((p.beta + np.sqrt(n)) / p.alpha + p.l2))
    used = np.flatnonzero(w[:dim])
    return float(w[dim]), used.astype(np.int32), w[used]


def _extract(batches):
    hashes = word_hashes()
    for b in batches:
        ids = [np.unique(coordinates(t, hashes)).tobytes() for t in b["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["label"].cast(pa.int32()), pa.array(ids, pa.binary())],
                                         names=["doc_id", "label", "ids"])


def train(docs: DataFrame, labels: DataFrame, p: FtrlParams = FtrlParams(), label: str = "toxic"):
    rows = (sample_rows(docs, fit_labels(labels, label, p.fit_rows), ["text"])
            .withColumn("doc_id", F.col("doc_id").cast("long"))
            .mapInArrow(_extract, "doc_id long, label int, ids binary").toPandas().sort_values("doc_id"))
    return fit([(np.frombuffer(i, np.int32), int(y)) for y, i in zip(rows["label"], rows["ids"])], p)


def score(docs: DataFrame, model, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (id and ``keep``) with ``held_out`` and ``score``."""
    keep = list(keep or [])
    sent = docs.sparkSession.sparkContext.broadcast(model)   # at most 2^BITS weights, a few thousand after L1

    def run(batches):
        hashes = word_hashes()
        bias, used, weights = sent.value
        dense = np.zeros(1 << BITS)
        dense[used] = weights
        for b in batches:
            out = np.empty(b.num_rows)
            texts = b["_text"]
            for at in range(0, b.num_rows, 256):
                for k, t in enumerate(texts.slice(at, 256).to_pylist(), at):
                    ids = coordinates(t, hashes)
                    ids = ids[dense[ids] != 0]
                    out[k] = bias + (dense[np.unique(ids)].sum() if len(ids) else 0.0)
            cols = [b[c] for c in keep] + [b["doc_id"], b["held_out"], pa.array(1 / (1 + np.exp(-np.clip(out, -40, 40))))]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "doc_id", "held_out", "score"])

    src = docs.select(*keep, "doc_id", F.col("text").alias("_text"), held_out(F.col("doc_id")).alias("held_out"))
    schema = T.StructType([*[src.schema[c] for c in keep], src.schema["doc_id"], T.StructField("held_out", T.BooleanType()),
                           T.StructField("score", T.DoubleType())])
    return src.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, p: FtrlParams = FtrlParams(), threshold: float = 0.5,
             keep: list[str] | None = None) -> DataFrame:
    return (score(docs, train(docs, labels, p), keep)
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))
