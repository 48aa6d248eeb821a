"""Toxicity: a classifier chain of linear models over hashed presence of words and word prefixes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm.shared import documents, labels, lowered, materialize, mix, prefix_hash, small_batches, span_hash, utf8, word_spans

#: Hash buckets of words, the most labelled rows that the models are fitted on, and folds.
BUCKETS, MAX_TRAIN, FOLDS, RIDGE = 1 << 18, 10_000, 4, 0.02
#: A word is fitted if it is in so many documents at least and its share of those with some label
#: exceeds its share of the others by so many standard errors (with 2**18 buckets, few pass by
#: chance), and half of the documents with it have the label.
MIN_DOCS, STANDARD_ERRORS = 5, 5.0
#: Bytes of the prefixes of longer words that are features beside the words.
PREFIXES = (4, 5, 6, 7, 8)
#: A document is rejected from this probability of the chain's last category on.
THRESHOLD = 0.3
CHUNK = 1 << 19

#: Categories that are derived where no label columns are given: the two sides of the toxic texts' main direction.
DERIVED = ("kind_1", "kind_2")

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_buckets(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, int]:
    """(text, bucket) of every run of letters, A-Z folded, and of its prefixes of PREFIXES bytes; number of texts. Null texts have none."""
    raw, offsets = utf8(texts)
    starts, ends, counts = word_spans(raw, offsets, _LETTER[raw])
    prefix, doc = prefix_hash(lowered(raw)), np.repeat(np.arange(len(counts)), counts)
    docs, ids = [doc], [span_hash(prefix, starts, ends)]
    for length in PREFIXES:
        some = ends - starts >= length
        docs.append(doc[some])
        ids.append(~span_hash(prefix, starts[some], starts[some] + length))
    return np.concatenate(docs), (np.concatenate(ids) % np.uint64(buckets)).astype(np.int64), len(counts)


def slices(texts: pa.Array, most: int = CHUNK):
    """texts in slices of about `most` bytes; a longer text is a slice of its own."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets = utf8(texts)
    start = 0
    while start < len(texts):
        stop = min(len(texts), max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1))
        yield texts.slice(start, stop - start)
        start = stop


_SEEN = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("fold", T.IntegerType())])


@F.arrow_udf(_SEEN)
def _presence(texts: pa.Array) -> pa.Array:
    """The distinct buckets of a text, and its fold: by the least of their hashes, so near copies are in one fold."""
    sizes, buckets, folds = [np.zeros(1, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for part in slices(texts):
        doc, ids, n = word_buckets(part)
        pairs = np.unique(doc * BUCKETS + ids)
        doc, ids = pairs // BUCKETS, pairs % BUCKETS
        own = np.bincount(doc, minlength=n)
        fold = np.zeros(n, np.int32)
        if len(ids):
            some = own > 0
            fold[some] = np.minimum.reduceat(mix(ids.astype(np.uint64) + np.uint64(1)), (np.cumsum(own) - own)[some]) % np.uint64(FOLDS)
        sizes.append(own)
        buckets.append(ids.astype(np.int32))
        folds.append(fold)
    lists = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)), pa.int32()), pa.array(np.concatenate(buckets)))
    return pa.StructArray.from_arrays([lists, pa.array(np.concatenate(folds))], ["ids", "fold"])


class Rows:
    """A sparse 0/1 matrix with some dense columns behind it."""

    def __init__(self, columns: np.ndarray, at: np.ndarray, width: int, dense: np.ndarray):
        self.columns, self.at, self.width, self.dense = columns, at, width, dense
        self.row = np.repeat(np.arange(len(at) - 1), np.diff(at))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.columns], len(self.at) - 1) + self.dense @ w[self.width :]

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.concatenate((np.bincount(self.columns, r[self.row], self.width), self.dense.T @ r))

    def take(self, chosen: np.ndarray) -> Rows:
        keep = chosen[self.row]
        return Rows(self.columns[keep], np.concatenate(([0], np.cumsum(np.diff(self.at)[chosen]))), self.width, self.dense[chosen])

    def only(self, wanted: np.ndarray, dense: np.ndarray) -> Rows:
        """The wanted columns' entries, with other dense columns."""
        keep = wanted[self.columns]
        return Rows(self.columns[keep], np.concatenate(([0], np.cumsum(np.bincount(self.row[keep], minlength=len(self.at) - 1)))), self.width, dense)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(x: Rows, y: np.ndarray, ridge: float = RIDGE, rounds: int = 200, memory: int = 8) -> np.ndarray:
    """Weights of a ridge logistic regression (the last dense column, a constant, is free of the penalty), by L-BFGS."""
    penalty = np.full(x.width + x.dense.shape[1], ridge)
    penalty[-1] = 1e-6

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = x.dot(w)
        return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * (penalty * w) @ w), x.back(sigmoid(z) - y) + penalty * w

    w = np.zeros(len(penalty))
    value, grad = loss(w)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        step, alphas = grad.copy(), []
        for s, g, rho in reversed(pairs):
            alphas.append(rho * (s @ step))
            step -= alphas[-1] * g
        step *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(1.0, np.abs(grad).sum())
        for (s, g, rho), a in zip(pairs, reversed(alphas), strict=True):
            step += (a - rho * (g @ step)) * s
        slope, t = grad @ step, 1.0
        while True:
            new = w - t * step
            new_value, new_grad = loss(new)
            if new_value <= value - 1e-4 * t * slope or t < 1e-6:
                break
            t /= 2
        s, g = new - w, new_grad - grad
        done = value - new_value < 1e-6 * max(1.0, abs(value))
        w, value, grad = new, new_value, new_grad
        if s @ g > 1e-10:
            pairs = [*pairs, (s, g, 1 / (s @ g))][-memory:]
        if done:
            break
    return w


def _tells(out: int, totals: dict[int, tuple[int, int]]) -> Column:
    """Whether a bucket's presence tells the label, by the rows of all folds but `out` (-1: of all); see STANDARD_ERRORS.

    totals: (rows, rows with the label) of each fold; a row of the table has n_F and one_F of a bucket.
    """
    folds = [f for f in totals if f != out]
    n1 = sum(totals[f][1] for f in folds)
    n0 = sum(totals[f][0] for f in folds) - n1
    if not n1 or not n0:
        return F.lit(False)
    n, one = (sum((F.col(f"{c}_{f}") for f in folds), F.lit(0)) for c in ("n", "one"))
    p = n / (n1 + n0)
    error = F.sqrt(F.greatest(p * (1 - p), F.lit(1e-12)) * (1 / n1 + 1 / n0))
    return (n >= MIN_DOCS) & (2 * one >= n) & (one / n1 - (n - one) / n0 >= STANDARD_ERRORS * error)


def telling(seen: DataFrame, label: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets that tell the label by all rows or by all but one fold, which of these): bit 0 for all, bit F + 1 without fold F.

    Counted on the executors; the driver gets two numbers a fold, and the buckets that pass.
    """
    totals = {r["fold"]: (r["n"], r["one"]) for r in seen.groupBy("fold").agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("one")).collect()}
    here = lambda f: F.col("fold") == f
    counts = [c for f in totals for c in (F.count_if(here(f)).alias(f"n_{f}"), F.count_if(here(f) & (F.col(label) == 1)).alias(f"one_{f}"))]
    if not counts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    per = seen.select("fold", label, F.explode("ids").alias("bucket")).groupBy("bucket").agg(*counts)
    bits = sum((F.when(_tells(f, totals), 1 << (f + 1)).otherwise(0) for f in (-1, *totals)), F.lit(0))
    found = per.select("bucket", bits.alias("bits")).where("bits > 0").orderBy("bucket").toArrow()
    return found.column("bucket").to_numpy().astype(np.int64), found.column("bits").to_numpy().astype(np.int64)


def main_sides(x: Rows, chosen: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Of each row, whether it lies on the upper side of the main direction of the chosen rows, their words centred.

    The direction is found by power iteration; its largest entry is positive, so the sides don't
    depend on the order of the rows.
    """
    own = x.take(chosen)
    w = 1 + np.cos(np.arange(x.width + x.dense.shape[1]))
    for _ in range(rounds):
        z = own.dot(w)
        w = own.back(z - z.mean() if len(z) else z)
        w[x.width :] = 0
        w /= max(np.linalg.norm(w), 1e-12)
    if len(w) and w[np.argmax(np.abs(w))] < 0:
        w = -w
    z = x.dot(w)
    return z > (z[chosen].mean() if chosen.any() else 0)


@dataclass
class Chain:
    """names in order; column: the model's column of each bucket or -1; words, earlier, constant: the linear models."""

    names: list[str]
    column: np.ndarray
    words: np.ndarray
    earlier: np.ndarray
    constant: np.ndarray

    def score(self, texts: pa.Array) -> np.ndarray:
        """Probabilities (texts x categories); each feeds the models after it."""
        out = []
        width = max(1, self.words.shape[1])
        for part in slices(texts):
            doc, ids, n = word_buckets(part, len(self.column))
            column = self.column[ids]
            known = column >= 0
            pairs = np.unique(doc[known] * width + column[known])
            row, column = pairs // width, pairs % width
            p = np.zeros((n, len(self.names)))
            for k in range(len(self.names)):
                p[:, k] = sigmoid(np.bincount(row, self.words[k][column], n) + p[:, :k] @ self.earlier[k, :k] + self.constant[k])
            out.append(p)
        return np.concatenate(out) if out else np.zeros((0, len(self.names)))


def _columns(batches: Iterator[pa.RecordBatch], buckets: np.ndarray) -> Iterator[pa.RecordBatch]:
    """ids as places among the chosen buckets, the others left out."""
    for batch in batches:
        lists = batch.column(0)
        sizes, ids = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
        at = np.minimum(np.searchsorted(buckets, ids), max(0, len(buckets) - 1))
        known = buckets[at] == ids if len(buckets) else np.zeros(len(ids), bool)
        row = np.repeat(np.arange(len(sizes)), sizes)[known]
        ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(sizes)))))
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at[known].astype(np.int32))), *batch.columns[1:]], batch.schema.names)


def fit_chain(texts: DataFrame, marked: DataFrame, categories: list[str] | None, overall: str = "toxic", key: str = "doc_id", text: str = "text", most: int = MAX_TRAIN) -> Chain:
    """A chain over label columns (0/1) of marked: the categories in order, then the overall one.

    At most `most` labelled rows are fitted on, those least in a hash of their key, so the sample
    has a bound; of these the driver gets the chosen words' columns only. Each model sees the words
    and the probabilities of the categories before it; in fitting, these are out-of-fold predictions,
    whose words are chosen without the fold as well. With categories None two are derived from the
    data (an empty list: none, a single model): the overall label's rows on either side of their main direction. Rows with a null key or
    null labels are left out; a key marked twice has the larger labels; a text that is copied is
    one observation, labelled as its least key is.
    """
    given = [*(categories or ()), overall]
    chosen = (
        marked.where(F.col(key).isNotNull() & F.coalesce(*given).isNotNull())
        .groupBy(key).agg(*(F.coalesce(F.max(n), F.lit(0)).cast("int").alias(n) for n in given))
        .orderBy(F.xxhash64(F.lit(4), key), key).limit(most)
    )
    # at most `most` keys: bounded, so it can be broadcast
    read = texts.select(key, text).join(F.broadcast(chosen), key).select(F.col(key).alias("key"), *given, _presence(F.col(text)).alias("p")).select("key", *given, "p.*")
    one = read.groupBy(F.xxhash64("ids").alias("h"), F.size("ids").alias("size")).agg(F.min_by(F.struct("ids", "fold", *given, "key"), "key").alias("r"))
    seen = materialize(one.select("r.*"), "presence")
    buckets, bits = telling(seen, overall)
    kept = seen.select("ids", "fold", *given, "key").mapInArrow(lambda it: _columns(it, buckets), "ids array<int>, fold int, " + "".join(f"`{n}` int, " for n in given) + f"key {seen.schema['key'].dataType.simpleString()}")
    table = kept.orderBy("key", F.xxhash64("ids")).toArrow().combine_chunks()
    n, width = table.num_rows, len(buckets)
    lists = table.column("ids").combine_chunks()
    at, columns = (lists.offsets.to_numpy().astype(np.int64), lists.flatten().to_numpy().astype(np.int64)) if n else (np.zeros(1, np.int64), np.zeros(0, np.int64))
    fold, y = table.column("fold").to_numpy(), {c: table.column(c).to_numpy().astype(float) for c in given}
    column = np.full(BUCKETS, -1, np.int64)
    column[buckets] = np.arange(width)

    every = Rows(columns, at, width, np.ones((n, 1)))
    names = [*(DERIVED if categories is None else categories), overall]
    if categories is None:
        upper = main_sides(every, y[overall] == 1)
        y |= {name: y[overall] * (upper == side) for name, side in zip(DERIVED, (True, False), strict=True)}
    earlier, constant, words = np.zeros((len(names), len(names))), np.zeros(len(names)), np.zeros((len(names), width))
    if not n:
        return Chain(names, column, words, earlier, constant - 40)
    before = np.zeros((n, 0))

    def rows(bit: int) -> Rows:
        return every.only((bits >> bit) & 1 == 1, np.hstack((before, np.ones((n, 1)))))

    for k, name in enumerate(names):
        w = fit_logistic(rows(0), y[name])
        words[k], earlier[k, :k], constant[k] = w[:width], w[width:-1], w[-1]
        if k < len(names) - 1:
            out = np.zeros(n)
            for f in np.unique(fold):
                x = rows(int(f) + 1)
                if (fold != f).any():
                    out[fold == f] = sigmoid(x.take(fold == f).dot(fit_logistic(x.take(fold != f), y[name][fold != f])))
            before = np.hstack((before, out[:, None]))
    return Chain(names, column, words, earlier, constant)


def chain_scores(spark: SparkSession, chain: Chain, text: Column | str = "text") -> Column:
    """struct<p_NAME double, ...> of a text column; null and empty texts get what the constants give."""
    sent = spark.sparkContext.broadcast(chain)
    kind = T.StructType([T.StructField(f"p_{n}", T.DoubleType()) for n in chain.names])

    @F.arrow_udf(kind)
    def scored(texts: pa.Array) -> pa.Array:
        p = sent.value.score(texts)
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(p[:, k])) for k in range(p.shape[1])], [f.name for f in kind])

    return scored(F.col(text) if isinstance(text, str) else text)


def score_toxicity(docs: DataFrame, marked: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, categories: list[str] | None = None) -> DataFrame:
    """docs with p_NAME (double) of each category, p_toxic and toxic (p_toxic >= threshold).

    The chain is fitted on docs' rows that marked (key, toxic 0/1, and a 0/1 column a category) has;
    see fit_chain. Null and empty texts have no words and get the base rates; whole texts are read;
    repeated rows get equal values; an empty table stays empty. Columns with these names are
    replaced, others pass through. With no labelled rows all probabilities are 0.
    """
    small_batches(docs.sparkSession)
    chain = fit_chain(docs, marked, categories, "toxic", key, text)
    names = [f"p_{n}" for n in chain.names]
    out = docs.drop(*names, "toxic", "__p").withColumn("__p", chain_scores(docs.sparkSession, chain, text))
    return out.withColumns({n: F.col(f"__p.{n}") for n in names}).withColumn("toxic", F.col("p_toxic") >= threshold).drop("__p")


def drop_toxic(docs: DataFrame, marked: DataFrame, **how) -> DataFrame:
    """docs, with their columns, without those that score_toxicity calls toxic."""
    return score_toxicity(docs, marked, **how).where("not toxic").select(*docs.columns)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return score_toxicity(docs, labels(spark, sf_dir).select("doc_id", "toxic")).drop("text")
