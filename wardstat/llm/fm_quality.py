"""Operator 1: quality classifier, a factorisation machine.

Features of a whole text are its distinct hashed words, structure statistics
(shares of character classes, word and line shape, repetition) cut into
levels, and metadata (the recorded character count against the measured one).
The machine adds to the linear part all pairwise interactions of the
features through rank-``k`` factors,

    y = w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2],

so a text is scored in time linear in its features.  Extraction and scoring
are map-only over the partitions of the input; the fit uses at most
``fit_rows`` labelled rows (hashed on the executors, learned on the driver by
mini-batch AdaGrad), and the model is a fixed ``(buckets + levels) * (k + 1)``
floats.

Defined results: a null or empty text has only structure features and is
scored like any other; null ids keep their row with ``held_out`` false;
repeated rows are scored one by one; an empty table gives an empty result;
with no labelled row the score is 0.5 everywhere.  Columns of the input other
than id, text and n_chars are passed through untouched only if named in
``keep``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import WordHash, fit_labels, held_out, sample_rows

WORD_BUCKETS = 1 << 14
LEVELS = 16          # levels a structure statistic is cut into
STATS = 14           # structure statistics and metadata
N_FEATURES = WORD_BUCKETS + STATS * LEVELS


@dataclass(frozen=True)
class FmParams:
    fit_rows: int = 12_000     # bound of the labelled training sample
    factors: int = 8
    epochs: int = 20
    batch: int = 256
    rate: float = 0.1
    l2: float = 1e-4
    seed: int = 7


_CLASS = np.zeros(256, np.uint8)      # 1 letter, 2 upper, 3 digit, 4 space, 5 other ASCII mark, 6 non-ASCII
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = (6 if _b >= 128 else 2 if "A" <= _c <= "Z" else 1 if "a" <= _c <= "z"
                  else 3 if _c.isdigit() else 4 if _c in " \t\n\r\x0b\x0c" else 5)


def _level(x: float) -> int:
    return max(0, min(LEVELS - 1, int(x)))


def features(text: str | None, n_chars, hashes: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids and values of one whole text."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words = text.split()
    distinct = set(words)
    lines = text.split("\n")
    c = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=7)
    chars = max(1, len(raw))
    marks = c[5]
    letters = c[1] + c[2] + c[6]
    n_words = max(1, len(words))
    ends = sum(1 for x in words if not x[-1].isalnum())
    stats = (
        LEVELS * c[2] / max(1, letters), LEVELS * c[3] / chars * 4, LEVELS * marks / chars * 2,
        LEVELS * c[4] / chars * 2, LEVELS * c[6] / chars, len(raw) / n_words,
        LEVELS * len(distinct) / n_words, np.log2(1 + len(words)), np.log2(1 + len(lines)),
        LEVELS * len(set(lines)) / max(1, len(lines)), np.log2(1 + len(words) / max(1, len(lines))),
        LEVELS * ends / n_words, LEVELS * text.count("|") / n_words,
        0 if n_chars is None else 1 + min(8, abs(int(n_chars) - len(text))),
    )
    ids = np.empty(len(distinct) + STATS, np.int32)
    ids[:STATS] = [WORD_BUCKETS + k * LEVELS + _level(s) for k, s in enumerate(stats)]
    ids[STATS:] = np.fromiter(map(hashes.__getitem__, distinct), np.int32, len(distinct))
    values = np.ones(len(ids), np.float32)
    if distinct:
        values[STATS:] = 1.0 / np.sqrt(len(distinct))
    return ids, values


def margins(ids, values, starts, w0, w, v) -> np.ndarray:
    """FM margin of each row of a ragged batch (rows begin at ``starts`` and
    are never empty), by the sum-of-squares identity."""
    x = v[ids] * values[:, None]
    s = np.add.reduceat(x, starts, axis=0)
    q = np.add.reduceat(x * x, starts, axis=0)
    return w0 + np.add.reduceat(w[ids] * values, starts) + 0.5 * (s * s - q).sum(axis=1)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], p: FmParams):
    """Mini-batch AdaGrad on the logistic loss; returns (w0, w, v)."""
    rng = np.random.default_rng(p.seed)
    w0 = 0.0
    w = np.zeros(N_FEATURES, np.float32)
    v = rng.normal(0, 0.05, (N_FEATURES, p.factors)).astype(np.float32)
    if not rows:
        return w0, w, v * 0
    g0, gw, gv = 1e-6, np.full_like(w, 1e-6), np.full_like(v, 1e-6)
    y_all = np.array([r[2] for r in rows], np.float32)
    w0 = float(np.log((y_all.sum() + 1) / (len(rows) - y_all.sum() + 1)))
    for _ in range(p.epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), p.batch):
            pick = order[at:at + p.batch]
            sizes = np.array([len(rows[i][0]) for i in pick])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            ids = np.concatenate([rows[i][0] for i in pick])
            val = np.concatenate([rows[i][1] for i in pick])
            row = np.repeat(np.arange(len(pick)), sizes)
            x = v[ids] * val[:, None]
            s = np.add.reduceat(x, starts, axis=0)
            m = (w0 + np.add.reduceat(w[ids] * val, starts)
                 + 0.5 * (s * s - np.add.reduceat(x * x, starts, axis=0)).sum(axis=1))
            err = (1 / (1 + np.exp(-m)) - y_all[pick]) / len(pick)
            e = err[row]
            d0 = float(err.sum())
            dw = np.bincount(ids, e * val, N_FEATURES).astype(np.float32) + p.l2 * w
            per = (s[row] - x) * (e * val)[:, None]
            dv = np.stack([np.bincount(ids, per[:, f], N_FEATURES) for f in range(p.factors)], 1).astype(np.float32)
            dv += p.l2 * v
            g0 += d0 * d0
            gw += dw * dw
            gv += dv * dv
            w0 -= p.rate * d0 / np.sqrt(g0)
            w -= p.rate * dw / np.sqrt(gw)
            v -= p.rate * dv / np.sqrt(gv)
    return w0, w, v


def _extract(batches):
    """Hash the sampled texts on the executors."""
    hashes = WordHash(WORD_BUCKETS)
    for b in batches:
        out = [features(t, n, hashes) for t, n in zip(b["text"].to_pylist(), b["n_chars"].to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [b["doc_id"], b["label"].cast(pa.int32()), pa.array([i.tobytes() for i, _ in out], pa.binary()),
             pa.array([x.tobytes() for _, x in out], pa.binary())], names=["doc_id", "label", "ids", "vals"])


def train(docs: DataFrame, labels: DataFrame, p: FmParams = FmParams(), label: str = "quality"):
    """Fit on at most ``p.fit_rows`` labelled rows that are not held out."""
    rows = (sample_rows(docs, fit_labels(labels, label, p.fit_rows), ["text", "n_chars"])
            .withColumn("n_chars", F.col("n_chars").cast("long")).withColumn("doc_id", F.col("doc_id").cast("long"))
            .mapInArrow(_extract, "doc_id long, label int, ids binary, vals binary").toPandas())
    rows = rows.sort_values("doc_id")
    return fit([(np.frombuffer(i, np.int32), np.frombuffer(x, np.float32), int(y))
                for y, i, x in zip(rows["label"], rows["ids"], rows["vals"])], p)


def score(docs: DataFrame, model, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (id, text, n_chars and ``keep``) with ``held_out`` and ``score``."""
    keep = list(keep or [])
    w0, w, v = model
    sent = docs.sparkSession.sparkContext.broadcast((w0, w, v))  # fixed size: N_FEATURES * (factors + 1) floats

    def run(batches):
        hashes = WordHash(WORD_BUCKETS)
        w0, w, v = sent.value
        for b in batches:
            out = np.empty(b.num_rows)
            texts, sizes = b["_text"], b["_n_chars"].to_pylist()
            for at in range(0, b.num_rows, 256):
                part = [features(t, n, hashes) for t, n in zip(texts.slice(at, 256).to_pylist(), sizes[at:at + 256])]
                starts = np.concatenate([[0], np.cumsum([len(i) for i, _ in part])[:-1]])
                m = margins(np.concatenate([i for i, _ in part]), np.concatenate([x for _, x in part]), starts, w0, w, v)
                out[at:at + len(part)] = 1 / (1 + np.exp(-np.clip(m, -40, 40)))
            cols = [b[c] for c in keep] + [b["doc_id"], b["held_out"], pa.array(out)]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "doc_id", "held_out", "score"])

    src = docs.select(*keep, "doc_id", F.col("text").alias("_text"), F.col("n_chars").cast("long").alias("_n_chars"),
                      held_out(F.col("doc_id")).alias("held_out"))
    schema = T.StructType([*[src.schema[c] for c in keep], src.schema["doc_id"], T.StructField("held_out", T.BooleanType()),
                           T.StructField("score", T.DoubleType())])
    return src.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, p: FmParams = FmParams(), threshold: float = 0.3,
             keep: list[str] | None = None) -> DataFrame:
    """Train, score every row, and decide: predicted 1 where score >= threshold."""
    return (score(docs, train(docs, labels, p), keep)
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))
