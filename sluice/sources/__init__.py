"""Readers and writers: tables, JSON documents and trees, scope directories, ledgers, reports."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table as it is read, dealt over all cores if its files are fewer than these: whoever works on its texts isn't one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a local master gets one of its own; others must name one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="sluice-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """df, written once to the folder that executors share and read from there: lineage ends here, and no reader computes it again."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON file (or files) that is one array of records."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_map(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """(pos, key, value) of JSON files that are one object each, in the order of their keys in the file."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.map_entries(F.from_json("value", f"map<string,{value_schema}>"))).alias("pos", "e")).select(F.col("pos").cast("long"), "e.key", "e.value")


def json_tree(spark: SparkSession, path_glob: str, schema: str) -> DataFrame:
    """Records of many JSON files; unreadable files and records are skipped."""
    kind = T.StructType.fromDDL(schema).add("_corrupt", T.StringType())
    read = spark.read.schema(kind).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path_glob)
    return read.where("_corrupt is null").drop("_corrupt")


def scope_directories(spark: SparkSession, path_glob: str) -> DataFrame:
    """A row per governed directory: scope, files, canon, vocab, readme, claims_json."""
    read = spark.read.text(path_glob, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    named = read.select("value", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("scope"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"))
    only = lambda name: F.max(F.when(F.col("name") == name, F.col("value")))
    return named.groupBy("scope").agg(
        F.array_sort(F.collect_set("name")).alias("files"),
        only("CANON.md").alias("canon"), only("VOCAB.md").alias("vocab"), only("README.md").alias("readme"), only("claims.json").alias("claims_json"),
    )


def commit_log(spark: SparkSession, path: str) -> DataFrame:
    """(pos, sha, committed_date) of `sha date` lines; lines of another form are skipped. pos follows the file, from 0 without gaps."""
    lines = spark.read.text(path).select(F.split("value", " ").alias("p"), F.monotonically_increasing_id().alias("at")).where(F.size("p") == 2)
    lines = lines.withColumn("split", F.shiftright("at", 33))
    before = Window.partitionBy(F.lit(0)).orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # a row a split of the files
    first = lines.groupBy("split").agg(F.count("*").alias("n")).select("split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    pos = F.col("first") + F.row_number().over(Window.partitionBy("split").orderBy("at")) - 1
    return lines.join(F.broadcast(first), "split").select(pos.alias("pos"), F.col("p")[0].alias("sha"), F.col("p")[1].alias("committed_date"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def markdown(df: DataFrame, most: int | None = None) -> str:
    """A report table as Markdown: of all rows, or of the first `most`, which a last line then says."""
    rows = (df if most is None else df.limit(most + 1)).collect()
    more, rows = most is not None and len(rows) > most, rows[:most]
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows), *([f"(only the first {most} rows)"] if more else [])])
