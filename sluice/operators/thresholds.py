"""Threshold search and ROC-AUC on running totals over score ranges. Lower scores mean slop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.functions import metrics as M
from sluice.sources import stored

#: Rows of a range, by which the number of ranges grows with the rows.
RANGE_ROWS = 1 << 18


def in_ranges(df: DataFrame, column: str, name: str = "__r") -> DataFrame:
    """df in the shared folder, sorted into ranges of about RANGE_ROWS rows by a column, with the number of each row's range.

    Ranges come from a sample of the values, and rows of one value are in one range.
    """
    rows = stored(df, "rows")
    ranges = max(1, -(-rows.count() // RANGE_ROWS))
    if ranges > 1:
        rows = rows.repartitionByRange(ranges, column)
    else:
        rows = rows.coalesce(1)  # RANGE_ROWS rows at most
    return stored(rows.sortWithinPartitions(column).withColumn(name, F.spark_partition_id()), "ranges")


def _before(ranged: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """A row per range (__r) with the totals of all ranges before it, as __NAME: a table of as many rows as there are ranges."""
    totals = ranged.groupBy("__r").agg(*(c.alias(f"__{n}") for n, c in sums.items()))
    before = Window.partitionBy(F.lit(0)).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("__r", *(F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in sums))


def running_totals(df: DataFrame, score: str, sums: dict[str, Column]) -> DataFrame:
    """A row per distinct score with sums and first (least pos), and with totals up to and with it as cum_NAME.

    Distinct scores are sorted into ranges, so a window holds a like share of them whatever their
    distribution, and the ranges' own totals are a row a range. df is read once.
    """
    per = in_ranges(df.groupBy(score).agg(*(c.alias(n) for n, c in sums.items()), F.min("pos").alias("first")), score)
    own = Window.partitionBy("__r").orderBy(score).rowsBetween(Window.unboundedPreceding, 0)
    out = per.join(F.broadcast(_before(per, {n: F.sum(n) for n in sums})), "__r")  # a row a range
    return out.select(score, "first", *sums, *((F.col(f"__{n}") + F.sum(n).over(own)).alias(f"cum_{n}") for n in sums))


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """df with its rows numbered from 0 in order, by counts of ranges and a window in each."""
    ranged = in_ranges(df, order)
    at = F.col("__c") + F.row_number().over(Window.partitionBy("__r").orderBy(order)) - 1
    return ranged.join(F.broadcast(_before(ranged, {"c": F.count("*")})), "__r").withColumn(name, at).drop("__r", "__c")  # a row a range


def best_threshold(df: DataFrame, score: str = "score", gt: str = "gt_slop") -> DataFrame:
    """One row: threshold, f1, tp, fp, fn, tn. Rejects score <= threshold; the greatest F1, rounded to 3 places, wins, ties to the first in pos.

    NaN and null scores are never candidates. The threshold is rounded to 3 places, as it is applied.
    """
    some = df.where(F.col(score).isNotNull() & ~F.isnan(score))
    totals = running_totals(some, score, {"slop": F.count_if(gt), "n": F.count("*")})
    whole = some.agg(F.count_if(gt).alias("p"), F.count("*").alias("all"))
    tp, fp = F.col("cum_slop"), F.col("cum_n") - F.col("cum_slop")
    cells = totals.join(F.broadcast(whole)).select(  # one row
        F.col(score).alias("raw"), "first", tp.alias("tp"), fp.alias("fp"), (F.col("p") - tp).alias("fn"), (F.col("all") - F.col("p") - fp).alias("tn")
    )
    scored = cells.withColumn("f1", F.round(M.f1(F.col("tp"), F.col("fp"), F.col("fn")), 3))
    return scored.orderBy(F.desc("f1"), "first").limit(1).select(F.round("raw", 3).alias("threshold"), "f1", "tp", "fp", "fn", "tn")


def apply_threshold(df: DataFrame, threshold: DataFrame, score: str = "score") -> DataFrame:
    """df with reject: score <= the rounded threshold; missing scores are admitted."""
    return df.join(F.broadcast(threshold.select("threshold"))).withColumn("reject", F.coalesce(~F.isnan(score) & (F.col(score) <= F.col("threshold")), F.lit(False)))


def roc_auc(df: DataFrame, score: str = "score", gt: str = "gt_slop") -> DataFrame:
    """One row: positives, negatives, auc (3 places), the chance that a slop item scores lower than a legit one, ties a half; null if a class is empty."""
    some = df.where(F.col(score).isNotNull() & ~F.isnan(score))
    totals = running_totals(some, score, {"pos_n": F.count_if(gt), "neg_n": F.count_if(~F.col(gt))})
    # a negative of this score loses to the positives below it and half of those beside it
    won = F.col("neg_n") * (F.col("cum_pos_n") - F.col("pos_n") + 0.5 * F.col("pos_n"))
    out = totals.agg(F.sum("pos_n").alias("positives"), F.sum("neg_n").alias("negatives"), F.sum(won).alias("won"))
    pairs = F.col("positives").cast("double") * F.col("negatives")
    return out.select("positives", "negatives", F.round(F.col("won") / F.nullif(pairs, F.lit(0.0)), 3).alias("auc"))
