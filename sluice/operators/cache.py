"""Runs that go on from a result cache keyed by item and model signature."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def signature(parts: dict[str, str]) -> str:
    """A signature of a run's models: the same for the same parts in any order."""
    return "|".join(f"{k}={parts[k]}" for k in sorted(parts))


def cached(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What a cache holds, with the run that wrote each row; a cache that isn't there yet holds nothing."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = T.StructType([*schema.fields, T.StructField("run", T.StringType())])
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).parquet(path)


def resume(items: DataFrame, path: str, sig: str, score: Callable[[DataFrame], DataFrame], kind: str, key: str = "pos", value: str = "value", done: Callable[[Column], Column] = Column.isNotNull) -> DataFrame:
    """(key, value, cached) of all items: those that the cache at `path` has under this signature, and the others, scored now.

    score takes the items that are missing and returns key and value (of type `kind`). What it
    returns is appended to the cache, as a run of its own, before it is used, so the next run goes on
    from there. A null value (or one that isn't `done`) is a failed item: kept, and scored again by the
    next run. A null key is in no cache. An item that earlier runs have more than once has the greatest value; repeated items
    that are scored now are a row each. Results of other signatures stay in the cache, unused.
    """
    spark, run = items.sparkSession, uuid.uuid4().hex
    schema = T.StructType([T.StructField(key, items.schema[key].dataType), T.StructField("sig", T.StringType()), *T.StructType.fromDDL(f"`{value}` {kind}")])

    def known() -> DataFrame:
        rows = cached(spark, path, schema).where((F.col("sig") == sig) & (F.col("run") != run) & done(F.col(value)))
        return rows.groupBy(key).agg(F.max(value).alias(value))

    missing = items.join(known().select(key), key, "left_anti")
    score(missing).select(key, F.lit(sig).alias("sig"), F.col(value).cast(schema[value].dataType).alias(value)).write.parquet(f"{path}/run={run}")
    new = cached(spark, path, schema).where(F.col("run") == run).select(key, value, F.lit(False).alias("cached"))
    return known().join(items.select(key), key, "left_semi").select(key, value, F.lit(True).alias("cached")).unionByName(new)
