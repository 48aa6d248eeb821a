"""Hard negatives by distributed radix selection.

Blocks of anchors meet blocks of rows; a pair of blocks gives integer scores, of which only counts
leave the task: for each anchor and positive a histogram of the scores in its window, a digit at a
time. The sums tell the digit in which the k-th best score lies; the next round counts inside it.
After the last digit the k-th score is known, and only rows that reach it are gathered.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.llm.grid import in_blocks
from sluice.llm.shared import materialize

#: Anchors and rows of a block; anchors whose scores are held at once; bits of a digit.
ANCHOR_BLOCK, ROW_BLOCK, AT_ONCE, DIGIT = 2048, 4096, 128, 8
#: Whole numbers of vectors: components are multiplied by this and rounded down.
SCALE = 256
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def whole_vectors(column: pa.ChunkedArray, scale: int = SCALE) -> np.ndarray:
    """A row per vector of floor(scale * component), as doubles; shorter vectors count as zero beyond their end."""
    lists = column.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    return out


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers, as 64-bit integers; beyond those they stop at the least or greatest."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(width, 1)
    if most < 1 << 53:
        return (a @ b.T).astype(np.int64)
    if most < 1 << 62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    exact = [[min(max(sum(int(x) * int(y) for x, y in zip(u, v, strict=True)), _LEAST), _MOST) for v in b] for u in a]
    return np.array(exact, np.int64).reshape(len(a), len(b))


def _in_order(rows: pa.Table) -> pa.Table:
    """Rows by id, nulls last, then by row: the order that settles ties."""
    ids = rows.column("id")
    order = np.lexsort((rows.column("row").to_numpy(), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)))
    return rows.take(pa.array(order))


def _scored(anchors: pa.Table, rows: pa.Table):
    """(slice of anchors, scores, whether labels are equal) AT_ONCE anchors at a time; rows are in order."""
    v, w = whole_vectors(anchors.column("vector")), whole_vectors(rows.column("vector"))
    ours, theirs = anchors.column("label").to_numpy(), rows.column("label").to_numpy()
    for a in range(0, len(v), AT_ONCE):
        own = slice(a, min(a + AT_ONCE, len(v)))
        yield own, inner_products(v[own], w), ours[own, None] == theirs


def _first(scores: np.ndarray, fits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, column) of the k greatest fitting scores of each line, ties to the first column; all, if fewer."""
    line, column = np.nonzero(fits)
    if k < scores.shape[1]:
        low = np.where(fits, scores, _LEAST)
        floor = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k]
        reach = scores[line, column] >= floor[line]
        line, column = line[reach], column[reach]
    order = np.lexsort((column, -1 - scores[line, column], line))  # -1 - x doesn't overflow
    line, column = line[order], column[order]
    keep = np.arange(len(line)) - np.searchsorted(line, line) < k
    return line[keep], column[keep]


def _positives(anchors: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """The k best rows of a block that share each anchor's label but not its id."""
    rows = _in_order(rows)
    ids, known = rows.column("id").fill_null(0).to_numpy(), ~rows.column("id").is_null().to_numpy(zero_copy_only=False)
    own_id, at, found, scored = anchors.column("id").to_numpy(), [], [], []
    for own, scores, same in _scored(anchors, rows):
        line, column = _first(scores, same & ~((own_id[own, None] == ids) & known), k)
        at.append(line + own.start)
        found.append(column)
        scored.append(scores[line, column])
    at, found = pa.array(np.concatenate(at)), pa.array(np.concatenate(found))
    return pa.table({"anchor": anchors.column("row").take(at), "positive": rows.column("row").take(found), "positive_id": rows.column("id").take(found), "positive_score": np.concatenate(scored)})


def _windows(anchors: pa.Table) -> list[dict[str, np.ndarray]]:
    """The anchors' windows: the first of each, then the second of each that has one, and so on; `at` is the anchor's line."""
    lists = anchors.column("windows").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    flat = {f.name: lists.flatten().field(f.name).to_numpy(zero_copy_only=False) for f in lists.type.value_type}
    first = np.cumsum(sizes) - sizes
    return [{"at": np.flatnonzero(sizes > j)} | {n: c[(first + j)[sizes > j]] for n, c in flat.items()} for j in range(int(sizes.max(initial=0)))]


def _each_window(anchors: pa.Table, rows: pa.Table):
    """(window's columns, its anchors' scores, distance below the window's top, whether a row of another label is in it)."""
    windows = _windows(anchors)
    for own, scores, same in _scored(anchors, rows):
        for w in windows:
            some = (w["at"] >= own.start) & (w["at"] < own.stop)
            now = {n: c[some] for n, c in w.items()}
            line = now["at"] - own.start
            mine = scores[line]
            inside = ~same[line] & (mine >= now["low"][:, None]) & (mine <= now["high"][:, None])
            yield now, mine, now["high"][:, None] - np.where(inside, mine, now["high"][:, None]), inside


def _histogram(anchors: pa.Table, rows: pa.Table, shift: int) -> pa.Table:
    """(anchor, positive, digit, n): rows by the digit of their distance below the top, in the range that holds the k-th.

    A block's digits beyond that of its own k-th row can't hold the k-th of all, and aren't listed.
    """
    out = []
    for w, _, below, inside in _each_window(anchors, rows):
        digit = (below - w["base"][:, None]) >> shift
        line, column = np.nonzero(inside & (digit >= 0) & (digit < 1 << DIGIT))
        counts = np.bincount((line << DIGIT) + digit[line, column], minlength=len(w["at"]) << DIGIT).reshape(-1, 1 << DIGIT)
        before = np.cumsum(counts, axis=1) - counts
        line, digits = np.nonzero((counts > 0) & (before < w["need"][:, None]))
        out.append((w["anchor"][line], w["positive"][line], digits, counts[line, digits]))
    return pa.table(dict(zip(("anchor", "positive", "digit", "n"), (np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True)), strict=True))) if out else None


def _gather(anchors: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """The k first rows of a block that reach each window's k-th score."""
    rows, out, found = _in_order(rows), [], []
    for w, scores, below, inside in _each_window(anchors, rows):
        line, column = _first(scores, inside & (below <= w["reach"][:, None]), k)
        out.append((w["anchor"][line], w["positive"][line], scores[line, column]))
        found.append(column)
    if not out:
        return None
    anchor, positive, scored = (np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True))
    found = pa.array(np.concatenate(found))
    return pa.table({"anchor": anchor, "positive": positive, "negative": rows.column("row").take(found), "negative_id": rows.column("id").take(found), "negative_score": scored})


def _share(score: Column, hundredths: int, up: bool) -> Column:
    """score * hundredths / 100 of a score from 0 on, rounded up or down, without overflow."""
    whole, rest = F.expr("positive_score div 100"), score % 100
    return whole * hundredths + F.floor((rest * hundredths + (99 if up else 0)) / 100)


def hard_negatives(rows: DataFrame, is_anchor: Column, key: str = "vec_id", label: str = "label", vector: str = "embedding", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A score is the inner product of two vectors of floor(SCALE * component). An anchor's positives are
    its `positives` best rows with its label and another key; the negatives of a positive are the
    `negatives` best rows of another label with a score from low % to high % of the positive's. Higher
    scores come first, ties by lesser key, null keys last.

    Rows without label or vector, or with a null or non-finite component, take no part. Vectors of
    unlike lengths count as zero beyond their end. Every row stands for itself: rows that repeat a key
    are no positives of each other, each that is an anchor has its own results, and each may be
    chosen. A positive below zero has no negatives; empty tables give none. Extra columns are ignored.
    """
    fine = F.col(label).isNotNull() & F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    held = rows.where(fine).select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector"), (F.coalesce(is_anchor, F.lit(False)) & F.col(key).isNotNull()).alias("asks"))
    held = materialize(held.withColumn("row", F.monotonically_increasing_id()), "vectors")
    asked, held = held.where("asks").drop("asks"), held.drop("asks")
    sizes, keys = (ANCHOR_BLOCK, ROW_BLOCK), ("row", "row")

    best = in_blocks(asked, held, lambda a, b: _positives(a, b, positives), "anchor long, positive long, positive_id long, positive_score long", keys, sizes)
    first = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), F.asc_nulls_last("positive_id"), "positive")
    chosen = best.withColumn("r", F.row_number().over(first)).where(F.col("r") <= positives).drop("r")
    bounds = chosen.where("positive_score >= 0").withColumns({"low": _share(F.col("positive_score"), low, True), "high": _share(F.col("positive_score"), high, False)}).where("low <= high")
    windows = materialize(bounds.withColumns({"base": F.lit(0).cast("long"), "need": F.lit(negatives).cast("long"), "reach": F.col("high") - F.col("low")}), "windows")

    def with_windows(some: DataFrame) -> DataFrame:
        """Anchors with the windows of their positives: `positives` at most."""
        listed = some.groupBy("anchor").agg(F.collect_list(F.struct("anchor", "positive", "low", "high", "base", "need", "reach")).alias("windows"))
        return asked.join(listed.withColumnRenamed("anchor", "row"), "row")

    span = windows.agg(F.max("reach")).first()[0]  # one number
    digits = max(1, -(-int(span or 0).bit_length() // DIGIT))
    done, open_ = None, windows
    for shift in range(DIGIT * (digits - 1), -1, -DIGIT):
        counted = in_blocks(with_windows(open_), held, lambda a, b, s=shift: _histogram(a, b, s), "anchor long, positive long, digit long, n long", keys, sizes)
        upto = F.sum("n").over(Window.partitionBy("anchor", "positive").orderBy("digit"))  # a row a digit
        sums = counted.groupBy("anchor", "positive", "digit").agg(F.sum("n").alias("n")).withColumn("before", upto - F.col("n"))
        state = materialize(open_.join(sums, ["anchor", "positive"], "left").where("digit is null or before < need"), "digits")
        last = Window.partitionBy("anchor", "positive").orderBy(F.desc("digit"))
        state = state.withColumn("r", F.row_number().over(last)).where("r = 1")
        full = F.coalesce(F.col("before") + F.col("n") >= F.col("need"), F.lit(False))
        now = state.select(*windows.columns, "digit", "before", full.alias("full"))
        # a window with fewer rows than asked for keeps its whole reach; only the first digit can show one
        short = now.where("not full").select(*windows.columns)
        done = short if done is None else done
        open_ = materialize(now.where("full").withColumns({"base": F.col("base") + F.col("digit") * (1 << shift), "need": F.col("need") - F.col("before")}).select(*windows.columns), "windows")
    reached = done.unionByName(open_.withColumn("reach", F.col("base")))

    gathered = in_blocks(with_windows(reached), held, lambda a, b: _gather(a, b, negatives), "anchor long, positive long, negative long, negative_id long, negative_score long", keys, sizes)
    order = Window.partitionBy("anchor", "positive").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"), "negative")
    ranked = gathered.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    named = windows.select("anchor", "positive", "positive_id", "positive_score").join(asked.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return ranked.join(named, ["anchor", "positive"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the vectors whose number is divisible by 50; where it is divisible by 7, the label is the next of ten."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, F.col("vec_id") % 50 == 0)
