"""Quality score by nearest-neighbour voting in a latent semantic space.

A text becomes hashed byte-pair and byte-triple counts plus a few shape terms
(case, punctuation, repetition); term weighting and a truncated singular value
decomposition, fitted on a bounded sample of labelled documents, turn it into a
short latent vector. The sample's vectors are broadcast with their labels, and
every document takes exact cosine products with all of them, block by block.
Its score is the label average of the nearest neighbours weighted by
similarity.

Scale. One narrow pass over the documents, no shuffle of them. The sample is
bounded by ``sample`` rows (default 4096, those of smallest hash), so the model
is at most sample x dims floats, about 1 MB, whatever the corpus size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import docs_of, map_rows, ship, table

PAIRS, TRIPLES, SHAPES = 1024, 2048, 12
TERMS = PAIRS + TRIPLES + SHAPES
_MIX = np.uint32(0x9E3779B1)


def _kinds() -> np.ndarray:
    k = np.zeros(256, np.int64)
    for lo, hi, c in ((65, 90, 1), (97, 122, 2), (48, 57, 3), (128, 255, 4)):
        k[lo : hi + 1] = c
    k[[9, 10, 11, 12, 13, 32]] = 5
    return k


_KIND = _kinds()


def terms(text: str) -> np.ndarray:
    """Term weights of one text: counts damped to square roots of shares."""
    raw = text.encode()
    out = np.zeros(TERMS, np.float32)
    if not raw:
        return out
    counts = np.zeros(PAIRS + TRIPLES, np.int64)
    kinds = np.zeros(6, np.int64)
    for at in range(0, len(raw), 1 << 20):
        x = np.frombuffer(raw, np.uint8, min(len(raw) - at, (1 << 20) + 2), at)
        kinds += np.bincount(_KIND[x[: 1 << 20]], minlength=6)
        w = x.astype(np.uint32)
        two = (w[:-1] << np.uint32(8)) | w[1:]
        counts[:PAIRS] += np.bincount((two * _MIX) >> np.uint32(22), minlength=PAIRS)
        three = (two[:-1] << np.uint32(8)) | w[2:]
        counts[PAIRS:] += np.bincount((three * _MIX) >> np.uint32(21), minlength=TRIPLES)
    out[:PAIRS] = np.sqrt(counts[:PAIRS] / max(1, counts[:PAIRS].sum()))
    out[PAIRS : PAIRS + TRIPLES] = np.sqrt(counts[PAIRS:] / max(1, counts[PAIRS:].sum()))
    words = raw.split()
    n = max(1, len(words))
    same = sum(map(bytes.__eq__, words, words[1:]))
    shape = [*(kinds / kinds.sum()), same / n, len(set(words)) / n ** 0.9, sum(map(len, words)) / n / 20]
    shape.append(sum(not w[-1:].isalnum() and w[-1] < 128 for w in words) / n)
    shape.append(sum(len(w) < 2 for w in words) / n)
    shape.append(min(1.0, np.log1p(n) / 12))
    out[PAIRS + TRIPLES :] = np.sqrt(np.clip(shape, 0, 4))
    return out


class Model:
    """Term weights, latent axes, and the labelled latent vectors."""

    def __init__(self, mean, weight, axes, vectors, labels, prior, neighbours, power):
        self.mean, self.weight, self.axes = mean, weight, axes
        self.vectors, self.labels = vectors, labels
        self.prior, self.neighbours, self.power = prior, neighbours, power

    def latent(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) * self.weight) @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def score(self, x: np.ndarray, block: int = 512) -> np.ndarray:
        out = np.full(len(x), self.prior)
        if not len(self.vectors):
            return out
        k = min(self.neighbours, len(self.vectors))
        for at in range(0, len(x), block):
            cos = self.latent(x[at : at + block]) @ self.vectors.T
            near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
            w = np.maximum(np.take_along_axis(cos, near, 1), 0).astype(np.float64) ** self.power
            votes = (w * self.labels[near]).sum(1) + 1e-6 * self.prior
            out[at : at + block] = votes / (w.sum(1) + 1e-6)
        return np.clip(out, 0, 1)


def fit(x: np.ndarray, y: np.ndarray, dims: int = 64, neighbours: int = 15, power: float = 4.0, seed: int = 11) -> Model:
    """Latent axes by a randomised truncated SVD of the weighted term matrix."""
    if not len(x):
        return Model(np.zeros(TERMS, np.float32), np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), y, 0.5, neighbours, power)
    mean = x.mean(0)
    weight = (1 / (x.std(0) + 0.01)).astype(np.float32) ** 0.5  # damped inverse spread: rare terms speak louder
    weight[PAIRS + TRIPLES :] *= 3
    z = (x - mean) * weight
    q = np.random.default_rng(seed).standard_normal((TERMS, min(dims + 16, *z.shape))).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(z.T @ (z @ q))
    _, _, vt = np.linalg.svd(z @ q, full_matrices=False)
    axes = np.ascontiguousarray((q @ vt.T)[:, :dims], np.float32)
    model = Model(mean, weight, axes, None, y.astype(np.float32), float(y.mean()), neighbours, power)
    model.vectors = model.latent(x).astype(np.float32)
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = 4096, column: str = "quality") -> Model:
    """Fit on at most ``sample`` labelled rows outside the held-out fold
    (crc32 of the doc_id as text modulo 5 is 0); null labels and rows without
    doc_id are left out. A document labelled twice counts once for each label; of
    rows that repeat a doc_id any may serve. Without labelled rows every score is 0.5."""
    ship(docs.sparkSession)
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
        .where("label is not null and doc_id is not null")
        .where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label")
        .limit(sample)
    )

    def run(batches):
        for b in batches:
            v = [terms(t.as_py()).astype(np.float16).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(v, pa.binary()), b.column(2)], names=["doc_id", "terms", "label"])

    # at most ``sample`` rows are broadcast
    rows = docs_of(docs).join(F.broadcast(chosen), "doc_id").mapInArrow(run, "doc_id long, terms binary, label int")
    rows = rows.orderBy("doc_id", "label").limit(sample).collect()
    x = np.array([np.frombuffer(r["terms"], np.float16) for r in rows], np.float32).reshape(-1, TERMS)
    return fit(x, np.array([r["label"] for r in rows], np.float64))


def scores(docs: DataFrame, model: Model, column: str = "quality_score") -> DataFrame:
    """``docs`` with a column of scores (0 to 1) added, which must be a new name;
    every row is kept with all its columns, repeated rows each. Null text scores
    as empty text; texts are read whole, however long; neighbours of equal
    similarity beyond the last place are taken as they come; an empty table stays
    empty; the score depends on the text alone."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    schema = StructType([*docs.schema.fields, StructField(column, DoubleType())])

    def run(batches):
        m = shared.value
        for b in batches:
            got = []
            text = b.column(at)
            for lo in range(0, len(text), 512):
                part = text[lo : lo + 512]
                got.append(m.score(np.array([terms(t.as_py() or "") for t in part], np.float32).reshape(-1, TERMS)))
            s = np.concatenate(got) if got else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], names=schema.names)

    return map_rows(docs, run, schema)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    d = scores(docs_of(docs), model)
    return d.select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= 0.3).cast("int").alias("predicted"),
    )
