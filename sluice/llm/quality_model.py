"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer numpy network."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm.shared import chunks, documents, labels, mix, prefix_hash, small_batches, span_hash, utf8
from sluice.llm.toxicity import sigmoid, slices

#: Hash buckets of tokens, dimensions, entries of an index vector that aren't 0, and neighbours on either side.
BUCKETS, DIMENSIONS, ENTRIES, REACH = 8192, 32, 4, 2
#: The most labelled rows that the network is fitted on (a tenth calibrates), its hidden units and rounds.
MAX_TRAIN, HIDDEN, EPOCHS = 12_000, 32, 60

#: Classes of bytes: white space, letters (any above ASCII), digits, each other ASCII byte by itself.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every run of one class of bytes, white space left out; runs per text). Case counts."""
    raw, offsets = utf8(texts)
    docs = len(offsets) - 1
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(docs, np.int64)
    kind = _CLASS[raw]
    begins = np.ones(len(raw), bool)
    begins[1:] = kind[1:] != kind[:-1]
    begins[offsets[:-1][offsets[:-1] < len(raw)]] = True
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], len(raw))
    some = kind[starts] != 0
    starts, ends = starts[some], ends[some]
    return (span_hash(prefix_hash(raw), starts, ends) % np.uint64(BUCKETS)).astype(np.int64), np.diff(np.searchsorted(starts, offsets))


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(place, sign) of the ENTRIES of each bucket's index vector."""
    h = mix(np.arange(BUCKETS, dtype=np.uint64)[:, None] * np.uint64(ENTRIES) + np.arange(ENTRIES, dtype=np.uint64)[None, :] + np.uint64(1))
    return (h % np.uint64(DIMENSIONS)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sums: for each bucket its count and the sum of its neighbours' index vectors."""
    place, sign = index_vectors()
    total, seen = np.zeros(BUCKETS * DIMENSIONS), np.zeros(BUCKETS)
    for whole in batches:
        for batch in chunks(whole):
            ids, counts = tokens(batch.column(0))
            doc = np.repeat(np.arange(len(counts)), counts)
            seen += np.bincount(ids, minlength=BUCKETS)
            for d in range(1, REACH + 1):
                same = doc[d:] == doc[:-d]
                left, right = ids[:-d][same], ids[d:][same]
                for here, there in ((left, right), (right, left)):
                    for k in range(ENTRIES):
                        total += np.bincount(here * DIMENSIONS + place[there, k], sign[there, k], BUCKETS * DIMENSIONS)
    used = np.flatnonzero(seen)
    flat = np.hstack((seen[used, None], total.reshape(BUCKETS, DIMENSIONS)[used]))
    width = DIMENSIONS + 1
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(used, width).astype(np.int32) * width + np.tile(np.arange(width, dtype=np.int32), len(used))), pa.array(flat.ravel())], ["place", "value"]
    )


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Vectors (BUCKETS x DIMENSIONS) from all texts, centred and scaled over tokens.

    Each task sums its texts first; what comes to the driver has BUCKETS rows at any size.
    """
    width = DIMENSIONS + 1
    sums = docs.select(F.col(text).alias("text")).mapInArrow(_contexts, "place int, value double").where("value <> 0").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    table = np.zeros(BUCKETS * width)
    table[sums.column("place").to_numpy()] = sums.column("value").to_numpy()
    table = table.reshape(BUCKETS, width)
    seen, vectors = table[:, 0], table[:, 1:]
    vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    weight = seen / max(1.0, seen.sum())
    centred = vectors - weight @ vectors
    return (centred / np.sqrt(np.maximum(weight @ centred**2, 1e-9)) * (seen > 0)[:, None]).astype(np.float32)


def pool(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Mean and deviation of a text's word vectors and two of its lengths: texts x (2 DIMENSIONS + 2); zeros for no tokens."""
    out = []
    for part in slices(texts):
        ids, counts = tokens(part)
        some = counts > 0
        n = np.maximum(counts, 1)[:, None]
        mean = np.zeros((len(counts), DIMENSIONS))
        square = mean.copy()
        if some.any():
            at = (np.cumsum(counts) - counts)[some]
            own = vectors[ids]
            mean[some] = np.add.reduceat(own, at, axis=0, dtype=np.float64)
            square[some] = np.add.reduceat(own * own, at, axis=0, dtype=np.float64)
        mean, square = mean / n, square / n
        distinct = np.bincount(np.unique(np.repeat(np.arange(len(counts)), counts) * BUCKETS + ids) // BUCKETS, minlength=len(counts))
        out.append(np.hstack((mean, np.sqrt(np.maximum(square - mean**2, 0)), np.log1p(counts)[:, None], (distinct[:, None] / n))))
    return np.concatenate(out) if out else np.zeros((0, 2 * DIMENSIONS + 2))


@dataclass
class Network:
    vectors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.centre) / self.scale, -6, 6) @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, texts: pa.Array) -> np.ndarray:
        return sigmoid(self.logit(pool(texts, self.vectors)) / self.temperature)


def fit_network(x: np.ndarray, y: np.ndarray, vectors: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = 6) -> Network:
    """Adam on the log loss with weight decay, on nine tenths; the temperature minimises the loss of the rest."""
    rng = np.random.RandomState(seed)
    centre, scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    net = Network(vectors, centre, scale, rng.randn(x.shape[1], hidden) / np.sqrt(x.shape[1]), np.zeros(hidden), np.zeros(hidden), 0.0)
    if not len(x) or y.min() == y.max():
        net.b2 = 0.0 if not len(x) else (4.0 if y.max() else -4.0)
        return net
    order = rng.permutation(len(x))
    held, train = order[: len(x) // 10], order[len(x) // 10 :]
    z = np.clip((x - centre) / scale, -6, 6)
    params = [net.w1, net.b1, rng.randn(hidden) / np.sqrt(hidden), np.array([np.log(y.mean() / (1 - y.mean()))])]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        rng.shuffle(train)
        for a in range(0, len(train), 128):
            rows = train[a : a + 128]
            h = np.tanh(z[rows] @ params[0] + params[1])
            r = (sigmoid(h @ params[2] + params[3]) - y[rows]) / len(rows)
            back = np.outer(r, params[2]) * (1 - h**2)
            grads = [z[rows].T @ back + 1e-3 * params[0], back.sum(0), h.T @ r + 1e-3 * params[2], np.array([r.sum()])]
            t += 1
            for k, g in enumerate(grads):
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                params[k] = params[k] - 0.003 * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    if len(held):
        logits, own = net.logit(x[held]), y[held]
        net.temperature = float(min(np.geomspace(0.25, 8, 61), key=lambda c: np.logaddexp(0, logits / c).sum() - own @ logits / c))
    return net


def fit_quality(docs: DataFrame, marked: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = MAX_TRAIN) -> Network:
    """A network from all texts of docs and at most `most` labelled rows of marked, those least in a hash of their key."""
    vectors = word_vectors(docs, text)
    sent = docs.sparkSession.sparkContext.broadcast(vectors)

    @F.arrow_udf(T.BinaryType())
    def pooled(texts: pa.Array) -> pa.Array:
        return pa.array([row.tobytes() for row in pool(texts, sent.value)], pa.binary())

    chosen = marked.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max(label).alias("__y")).orderBy(F.xxhash64(F.lit(6), key), key).limit(most)
    # at most `most` keys: bounded, so it can be broadcast; a key's rows with different texts are observations each
    read = docs.select(key, text).join(F.broadcast(chosen), key).select(key, "__y", pooled(F.col(text)).alias("x")).distinct().orderBy(key, "x").toArrow()
    x = np.array([np.frombuffer(v.as_buffer()) for v in read.column("x")]).reshape(-1, 2 * DIMENSIONS + 2)
    return fit_network(x, read.column("__y").to_numpy().astype(float), vectors)


def quality_score(spark: SparkSession, net: Network, text: Column | str = "text") -> Column:
    """The calibrated probability of label 1 of a text column; null and empty texts get what no tokens get."""
    sent = spark.sparkContext.broadcast(net)

    @F.arrow_udf(T.DoubleType())
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(sent.value.score(texts))

    return scored(F.col(text) if isinstance(text, str) else text)


def classify_quality(docs: DataFrame, marked: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """docs with score (double, 0 to 1) and predicted (int, 1 from 0.5 on).

    Word vectors come from all texts, labels from marked (key, label 0/1) only; nothing but the
    text is an input of a score. Null and empty texts have a score too; whole texts are read;
    repeated rows get equal scores; an empty table stays empty; no labels give 0.5. Columns with
    these names are replaced, others pass through.
    """
    small_batches(docs.sparkSession)
    net = fit_quality(docs, marked, key, text, label)
    return docs.withColumn("score", quality_score(docs.sparkSession, net, text)).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3, F.lit(0))  # a null key is in no label
    docs = documents(spark, sf_dir).select("doc_id", "text")
    marked = labels(spark, sf_dir).where(part != 1)
    return classify_quality(docs, marked).select("doc_id", (part == 1).alias("held_out"), "score", "predicted")
