"""Quality classifier by nearest-neighbour voting in a latent-semantic space.

Every text becomes a histogram of byte pairs and hashed words; a truncated SVD
of the labelled histograms gives the latent space.  Labelled vectors (at most
``max_labelled``, so a few MB) are broadcast; every document's exact cosine to
every one of them is a blocked matrix product, and the nearest vote with a
weight that grows with similarity.  No document moves.

* Labels are learned only from rows whose ``crc32(doc_id) % 4`` is not 2; of
  the others the first ``max_labelled`` in hash order of the id are taken.
* Label rows that are null, not 0/1, or contradict each other are ignored.
* A null or empty text has no neighbours and scores the share of label 1; so
  does every document if only one label occurs (1 if there is none).
* A document with a null id is scored like any other, never learned from.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import boxed, modest_batches, unboxed
from glyphmill.llm.flattext import flat, mix, word_hashes, word_limits

PAIRS, WORDS, EXTRA = 1024, 512, 4


@dataclass(frozen=True)
class Params:
    max_labelled: int = 4096
    dims: int = 64
    neighbours: int = 24
    sharpness: float = 12.0
    prior_weight: float = 0.05
    keep_at: float = 0.7


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # per histogram entry
    axes: np.ndarray  # histogram entries x dims
    vectors: np.ndarray  # labelled documents x dims, unit length
    labels: np.ndarray
    prior: float


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def histograms(texts: pa.Array) -> np.ndarray:
    """Square-rooted shares of byte pairs and words, and of words equal to one of the four before."""
    data, offsets = flat(texts)
    starts, ends, first = word_limits(data, offsets)
    words = word_hashes(data, starts, ends, lower=False)
    bucket = (words % np.uint64(WORDS)).astype(np.int64)
    pair_bucket = (mix(np.arange(1, 65537, dtype=np.uint64)) % np.uint64(PAIRS)).astype(np.int64)
    again = np.zeros((EXTRA, len(words)), bool)
    for k in range(EXTRA):
        again[k, k + 1 :] = words[k + 1 :] == words[: -k - 1]
    out = np.zeros((len(texts), PAIRS + WORDS + EXTRA), np.float32)
    for i in range(len(texts)):
        chars = data[offsets[i] : offsets[i + 1]].astype(np.int64)
        a, b = first[i], first[i + 1]
        if len(chars) > 1:
            out[i, :PAIRS] = np.bincount(pair_bucket[chars[:-1] * 256 + chars[1:]], minlength=PAIRS) / (len(chars) - 1)
        if b > a:
            out[i, PAIRS : PAIRS + WORDS] = np.bincount(bucket[a:b], minlength=WORDS) / (b - a)
            for k in range(EXTRA):
                out[i, PAIRS + WORDS + k] = again[k, a + k + 1 : b].sum() / (b - a)
    return np.sqrt(out)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _leading_axes(gram: np.ndarray, dims: int) -> np.ndarray:
    """Leading eigenvectors by subspace iteration from a fixed start."""
    basis = np.random.default_rng(7).standard_normal((len(gram), dims + 16))
    for _ in range(8):
        basis, _ = np.linalg.qr(gram @ basis)
    _, turn = np.linalg.eigh(basis.T @ gram @ basis)
    return np.ascontiguousarray((basis @ turn)[:, ::-1][:, :dims]).astype(np.float32)


def labelled_sample(docs: DataFrame, labels: DataFrame, params: Params) -> DataFrame:
    """``text, y`` of at most ``max_labelled`` labelled documents that may be learned from."""
    known = (
        labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("q"))
        .filter(F.col("q").isin(0, 1) & ~held_out(F.col("id")) & F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.min("q").alias("y"), F.max("q").alias("other"))
        .filter(F.col("y") == F.col("other"))
    )
    texts = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("version"))
    chosen = (
        texts.join(known, "id")
        .select("id", "version", "y")
        .distinct()
        .orderBy(F.xxhash64("id"), "id", "version")
        .limit(params.max_labelled)
    )
    chosen = F.broadcast(chosen)  # at most max_labelled short rows
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("version"), "text")
    return rows.join(chosen, ["id", "version"]).dropDuplicates(["id", "version"]).select("id", "version", "text", "y")


def fit(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> Model:
    """The latent space and the labelled vectors; at most ``max_labelled`` histograms reach the driver."""

    def batches(parts):
        for batch in parts:
            texts = batch.column("text")
            for k in range(0, len(texts), 256):
                rows = histograms(texts.slice(k, 256)).astype("<f4")
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(k, 256),
                        batch.column("version").slice(k, 256),
                        batch.column("y").slice(k, 256).cast(pa.int32()),
                        pa.array([zlib.compress(r.tobytes(), 1) for r in rows], pa.binary()),
                    ],
                    names=["id", "version", "y", "h"],
                )

    modest_batches(docs.sparkSession)
    rows = labelled_sample(docs, labels, params).mapInArrow(batches, "id bigint, version bigint, y int, h binary")
    got = rows.toArrow().sort_by([("id", "ascending"), ("version", "ascending")])
    y = got.column("y").to_numpy().astype(np.float32)
    size = PAIRS + WORDS + EXTRA
    if len(y) == 0 or y.min() == y.max():
        empty = np.zeros((0, params.dims), np.float32)
        axes = np.zeros((size, params.dims), np.float32)
        return Model(np.ones(size, np.float32), axes, empty, y[:0], float(y.mean()) if len(y) else 1.0)
    x = np.stack([np.frombuffer(zlib.decompress(h), "<f4") for h in got.column("h").to_pylist()])
    weights = (1 + np.log(len(x) / (1 + (x > 0).sum(axis=0)))).clip(0.1).astype(np.float32)
    x = _unit(x * weights)
    axes = _leading_axes((x.T @ x).astype(np.float64), params.dims)
    return Model(weights, axes, _unit(x @ axes), y, float(y.mean()))


def vote(texts: pa.Array, model: Model, p: Params = Params()) -> np.ndarray:
    """The similarity-weighted share of label 1 among the nearest labelled documents."""
    out = np.full(len(texts), model.prior)
    if len(model.vectors) == 0:
        return out
    k = min(p.neighbours, len(model.vectors))
    for i in range(0, len(texts), 256):
        block = texts.slice(i, 256)
        z = _unit(_unit(histograms(block) * model.weights) @ model.axes)
        cosine = z @ model.vectors.T
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.take_along_axis(cosine, near, 1).astype(np.float64).clip(0) ** p.sharpness
        votes = (weight * model.labels[near]).sum(1) + p.prior_weight * model.prior
        out[i : i + len(block)] = votes / (weight.sum(1) + p.prior_weight)
    return out.clip(0, 1)


def score_documents(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``keep_at`` on); one narrow pass."""
    # Plain arrays: a broadcast value is unpickled without this package.
    shared = docs.sparkSession.sparkContext.broadcast(vars(fit(docs, labels, params)))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(vote(texts, Model(**shared.value), params), pa.float64())

    scored = boxed(docs).withColumn("score_", score(F.col("row.text")))
    s = F.col("score_")
    return unboxed(scored, docs.columns, score=s, predicted=F.when(s >= params.keep_at, 1).otherwise(0))


def keep_good(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, columns unchanged."""
    scored = score_documents(docs.select(F.struct("*").alias("all"), "doc_id", "text"), labels, params)
    return scored.filter(F.col("predicted") == 1).select("all.*")
