"""A streaming validator: files of governed scopes arrive one by one, and a scope is judged once it is whole.

A scope's files are held until the last of them is there, or until no more can come in time. What a batch holds
is a table: the next one gathers it and its own files by scope. What leaves it is joined to the ledger and judged
batch by batch, and each batch's table and verdicts are written under its own number, so a batch that is run again
replaces its own output.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.gates import TRIAD
from sluice.operators.validator import ABLATIONS, accept, validate_directories

#: Files that make a scope whole; the claims are looked for as well.
WHOLE = (*TRIAD, "claims.json")
EVENTS = "scope string, name string, content string, ts timestamp"
#: Scopes after a batch; of those that were let go before it (gone) only the time is kept.
SCOPES = "scope string, ts timestamp, files array<struct<name: string, content: string, ts: timestamp>>, gone boolean"


def _micros(late: str) -> int:
    return pd.Timedelta(late) // pd.Timedelta(microseconds=1)


def _latest(scopes: DataFrame) -> int | None:
    return scopes.agg(F.max(F.unix_micros("ts"))).first()[0]


def _whole() -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, WHOLE)), F.col("files.name"))) == 0


def gathered(events: DataFrame, before: DataFrame, late: str) -> DataFrame:
    """SCOPES after a batch of EVENTS, from those `before` it; ts is that of a scope's last file.

    Of a file that comes twice the later counts. What comes for a scope that was let go is too late, and so is what is
    older than the latest event of earlier batches by `late`. A scope stays for twice `late`, in the time of the events.
    An event with an empty scope only moves time on; those with a null scope, name or time are left out.
    """
    latest, ts = _latest(before), F.unix_micros("ts")
    fresh = events.where("scope is not null and name is not null and ts is not null")
    if latest is not None:
        fresh, before = fresh.where(ts > latest - _micros(late)), before.where(ts >= latest - 2 * _micros(late))
    held = before.select("scope", "ts", F.explode_outer(F.when(~F.col("gone") & ~_whole(), F.col("files"))).alias("f"))
    held = held.select("scope", "f.name", F.struct(F.coalesce("f.ts", "ts").alias("ts"), F.lit(0).alias("fresh"), "f.content").alias("f"))
    rows = held.union(fresh.select("scope", "name", F.struct("ts", F.lit(1).alias("fresh"), "content").alias("f")))
    files = rows.repartition("scope").groupBy("scope", "name").agg(F.max("f").alias("f"))  # a row without a name: gone
    listed = F.collect_list(F.when(F.col("name").isNotNull(), F.struct("name", "f.content", "f.ts"))).alias("files")
    scopes = files.groupBy("scope").agg(F.max("f.ts").alias("ts"), listed, (F.bool_or(F.col("name").isNull()) | (F.col("scope") == "")).alias("gone"))
    return scopes.withColumn("files", F.when(~F.col("gone"), F.col("files")))


def let_go(scopes: DataFrame, late: str) -> DataFrame:
    """scope, ts, files, canon, vocab, claims_json, whole of the SCOPES that a batch lets go: those whose files are whole, or without what is missing `late` after their last file."""
    latest = _latest(scopes)
    content = lambda name: F.get(F.filter("files", lambda f: f["name"] == name), F.lit(0))["content"]
    leaves = _whole() if latest is None else _whole() | (F.unix_micros("ts") < latest - 2 * _micros(late))
    return scopes.where(~F.col("gone") & leaves).select(
        "scope", "ts", F.array_sort("files.name").alias("files"), content("CANON.md").alias("canon"), content("VOCAB.md").alias("vocab"), content("claims.json").alias("claims_json"), _whole().alias("whole"),
    )


def judged(batch: DataFrame, ledger: DataFrame) -> DataFrame:
    """scope, ts, whole and a reject column for each of the validator's arms."""
    return validate_directories(batch, ledger).select("scope", "ts", "whole", *((~accept(without)).alias(arm) for arm, without in ABLATIONS.items()))


def run(spark: SparkSession, folder: str, ledger: DataFrame, home: str, late: str) -> None:
    """Judges what has come into folder (Parquet files of EVENTS) since the last run with this home, and returns.

    Held scopes, progress and verdicts lie in home, so a run goes on where the last one ended, also where it was lost.
    """
    events = spark.readStream.schema(EVENTS).parquet(folder)

    def put(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        here, last = (f"{home}/scopes/{n % 2}" for n in (number, number - 1))  # no batch reads further back than one
        before = own.read.schema(SCOPES).parquet(last) if number else own.createDataFrame([], SCOPES)
        gathered(batch, before, late).write.mode("overwrite").parquet(here)
        judged(let_go(spark.read.schema(SCOPES).parquet(here), late), ledger).write.mode("overwrite").parquet(f"{home}/verdicts/batch={number}")

    query = events.writeStream.option("checkpointLocation", f"{home}/state").foreachBatch(put).trigger(availableNow=True).start()
    query.awaitTermination()


def rates(spark: SparkSession, home: str, window: str = "6 hours") -> DataFrame:
    """window_start, arm, n, rejected, reject_rate of the verdicts so far."""
    wide = spark.read.parquet(f"{home}/verdicts")
    arms = F.inline(F.array(*(F.struct(F.lit(a).alias("arm"), F.col(f"`{a}`").alias("reject")) for a in ABLATIONS)))
    grouped = wide.select("ts", arms).groupBy(F.window("ts", window).alias("w"), "arm").agg(F.count("*").alias("n"), F.count_if("reject").alias("rejected"))
    return grouped.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "arm", "n", "rejected", F.round(F.col("rejected") / F.col("n"), 3).alias("reject_rate"))
