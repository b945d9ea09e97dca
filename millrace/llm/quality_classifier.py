"""Quality classifier (operator 8).

Word vectors come from random indexing over all documents: each hashed word has a sparse random index vector, and a
word's vector is the sum of the index vectors of its neighbours. A document pools its words' vectors (mean and spread),
and a two-layer numpy network, fitted on a bounded sample of labelled rows, turns them into a probability that is
calibrated by a temperature.

Edge cases: a null text is empty and pools to zeros, and is scored like any other; words that hash alike share a
vector; without labelled rows every score is 1 and a warning is given, with labels of one kind only it is their smoothed
share; of an id's labels the least counts, null labels and null ids are not learnt from, and a null id is never held out;
repeated rows are scored one by one; an empty table gives an empty result; only id and text are read, and extra columns,
whatever their names, are carried.
"""

from __future__ import annotations

import warnings
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm.text import encoded, frugal, mix, release, slices

#: Hashed words, dimensions, nonzero entries of an index vector, neighbours on either side.
BUCKETS, DIM, NONZERO, REACH = 1 << 13, 32, 4, 2
#: Labelled rows used for fitting at most, hidden units, passes, share of rows that set the temperature.
MAX_LABELLED, HIDDEN, EPOCHS, CALIBRATION = 20_000, 32, 60, 0.2
#: Buckets that one shuffled row carries. Score from which a document is predicted good.
BLOCK, GOOD = 256, 0.7
#: Bytes of text whose words are held at once: a word takes 4 * DIM bytes, twice.
SLICE = 1 << 18

_IDS = np.arange(BUCKETS, dtype=np.uint64)
_POSITION = np.stack([(mix(_IDS * np.uint64(NONZERO) + np.uint64(k)) % np.uint64(DIM)).astype(np.int64) for k in range(NONZERO)])
_SIGN = np.stack([1.0 - 2.0 * (mix(_IDS * np.uint64(NONZERO) + np.uint64(k)) >> np.uint64(63)).astype(float) for k in range(NONZERO)])


def buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashed lower-case words of all texts in turn, and the number of words of each."""
    known: dict[bytes, int] = {}
    split = [t.split() for t in texts]
    n = np.fromiter(map(len, split), np.int64, len(split))
    ids = np.fromiter((known.setdefault(w, len(known)) for words in split for w in words), np.int64, int(n.sum()))
    hashed = np.fromiter((zlib.crc32(w.lower()) % BUCKETS for w in known), np.int64, len(known))
    return (hashed[ids] if len(ids) else ids), n


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Unit word vectors (BUCKETS x DIM) from the neighbours of every word of every document. Tasks add up one matrix
    of this fixed size each; blocks of it are summed after a shuffle and the driver gets one matrix."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS * DIM)
        for batch in batches:
            for part in slices(batch, 0, SLICE):
                b, n = buckets(encoded(part.column(0)))
                of = np.repeat(np.arange(len(n)), n)
                for step in range(1, REACH + 1):
                    near = np.flatnonzero(of[step:] == of[:-step])
                    left, right = b[near], b[near + step]
                    for k in range(NONZERO):
                        total += np.bincount(np.concatenate([left * DIM + _POSITION[k][right], right * DIM + _POSITION[k][left]]), weights=np.concatenate([_SIGN[k][right], _SIGN[k][left]]), minlength=BUCKETS * DIM)
        rows = total.reshape(-1, BLOCK * DIM)
        used = np.flatnonzero(np.abs(rows).sum(1))
        packed = [zlib.compress(rows[k].astype(np.int16 if np.abs(rows[k]).max() < 32_000 else np.float64).tobytes(), 1) for k in used]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(packed, pa.binary())], names=["block", "sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = zlib.decompress(raw)
                row = np.frombuffer(raw, np.int16 if len(raw) == 2 * BLOCK * DIM else np.float64)
                sums[k] = sums.get(k, 0.0) + row
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.astype(np.float64).tobytes() for x in sums.values()], pa.binary())], names=["block", "sums"])

    out = np.zeros((BUCKETS // BLOCK, BLOCK * DIM))
    shuffled = docs.select(F.col(text_col).alias("text")).mapInArrow(frugal(partial), "block int, sums binary").repartition("block")
    for k, raw in shuffled.mapInArrow(frugal(added), "block int, sums binary").collect():
        out[k] += np.frombuffer(raw, np.float64)
    out = out.reshape(BUCKETS, DIM)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors of each text."""
    b, n = buckets(texts)
    out = np.zeros((len(n), 2 * vectors.shape[1]))
    rows = np.flatnonzero(n)
    if len(rows):
        at = np.concatenate([[0], np.cumsum(n[rows])[:-1]])
        v = vectors[b]
        mean = np.add.reduceat(v, at, axis=0, dtype=np.float64) / n[rows, None]
        square = np.add.reduceat(v * v, at, axis=0, dtype=np.float64) / n[rows, None]
        out[rows] = np.hstack([mean, np.sqrt(np.maximum(square - mean * mean, 0))])
    return out


@dataclass
class Network:
    """Two layers over standardised inputs; ``temperature`` divides the logit. ``fixed`` is a constant score."""

    fixed: float | None = None
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: tuple[np.ndarray, ...] = ()
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh((x - self.centre) / self.scale @ w1 + b1) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.fixed is not None:
            return np.full(len(x), self.fixed)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Network:
    """Adam on the log loss; the temperature is the best of a grid on rows left out of the fit."""
    if not len(y):
        warnings.warn("no labelled rows to learn from: every document scores 1", stacklevel=2)
    if not len(y) or y.min() == y.max():
        return Network(fixed=1.0 if not len(y) else float((y.sum() + 1) / (len(y) + 2)))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    cut = int(len(y) * CALIBRATION)
    held, used = order[:cut], order[cut:]
    net = Network(centre=x[used].mean(0), scale=x[used].std(0) + 1e-6)
    d = x.shape[1]
    w = [rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    xs = (x - net.centre) / net.scale
    for epoch in range(EPOCHS):
        rate = 3e-3 * 0.5 * (1 + np.cos(np.pi * epoch / EPOCHS))
        rng.shuffle(used)
        for at in range(0, len(used), 256):
            k = used[at : at + 256]
            h = np.tanh(xs[k] @ w[0] + w[1])
            e = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -60, 60))) - y[k]) / len(k)
            back = np.outer(e, w[2]) * (1 - h * h)
            grads = [xs[k].T @ back + 1e-4 * w[0], back.sum(0), h.T @ e + 1e-4 * w[2], e.sum(keepdims=True)]
            t += 1
            for j, g in enumerate(grads):
                m[j] = 0.9 * m[j] + 0.1 * g
                v[j] = 0.999 * v[j] + 0.001 * g * g
                w[j] = w[j] - rate * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
    net.weights = tuple(w)
    if cut:
        z, target = net.logits(x[held]), y[held]
        losses = {s: np.logaddexp(0, np.where(target > 0, -z, z) / s).mean() for s in np.geomspace(0.5, 5, 40)}
        net.temperature = float(min(losses, key=losses.get))
    return net


def held_out(doc_id):
    """Rows whose labels are never learnt."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MAX_LABELLED) -> Network:
    """Fit on at most ``most`` labelled rows, the first by a hash of their id."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    sample = known.groupBy(F.col(id_col).alias("label_id")).agg(F.min(label_col).cast("int").alias("label")).orderBy(F.xxhash64("label_id"), "label_id").limit(most)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                x = pooled(encoded(part.column(1)), vectors).astype(np.float32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in x], pa.binary()), part.column(2)], names=["label_id", "x", "label"])

    joined = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "label_id")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = joined.select("label_id", "text", "label").mapInArrow(frugal(features), f"label_id {kind}, x binary, label int").orderBy(F.xxhash64("label_id"), "label_id", "x").limit(most).collect()
    x = np.array([np.frombuffer(r.x, np.float32) for r in rows], float).reshape(len(rows), 2 * vectors.shape[1])
    return fit(x, np.array([r.label for r in rows], float))


def scored_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``row``, a struct of all columns of ``docs``, and ``score``."""
    vectors = word_vectors(docs, text_col)
    net = train(docs, labels, vectors, id_col, text_col, label_col)

    def scores(values: list[str | None]) -> np.ndarray:
        out, at = np.empty(len(values)), 0
        while at < len(values):  # a slice of texts at a time
            to, size = at, 0
            while to < len(values) and (to == at or size < SLICE):
                size += len(values[to] or "")
                to += 1
            out[at:to] = net.score(pooled([(x or "").encode() for x in values[at:to]], vectors))
            at = to
        return out

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for text in batches:
                yield pa.array(scores(text.to_pylist()))
        finally:
            release()

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(row, scored(F.col(text_col)).alias("score"))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """All columns of ``docs`` and ``quality_score``, which takes the place of a column of that name."""
    own = [F.col(f"row.`{c}`") for c in docs.columns if c.lower() != "quality_score"]
    return scored_rows(docs, labels, id_col, text_col, label_col).select(*own, F.col("score").alias("quality_score"))


def op8(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score(docs.select("doc_id", "text"), labels)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= GOOD).cast("int").alias("predicted"))
