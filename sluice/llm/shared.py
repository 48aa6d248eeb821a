"""Shared storage and vectorised text helpers of the training-data operators."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that separate words, [\x20\x09-\x0D].
SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"

#: Text bytes that are worked on at once; a longer document is one chunk of its own.
CHUNK_BYTES = 1 << 19

_P = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_IS_SEP = np.zeros(256, bool)
_IS_SEP[list(SEPARATORS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a local master gets one of its own; others must name one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="sluice-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: Rows of a batch that goes to Python: texts are long, and workers share an executor's memory.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Send texts to Python in batches of BATCH_ROWS rows at most."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, instead: DataFrame | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors.

    instead: a table of materialize's that only df was made from; it is deleted once df is written.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    if instead is not None:
        old = spark._jvm.org.apache.hadoop.fs.Path(_tables.pop(id(instead), (None, path + "-none"))[1])
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    out = spark.read.schema(df.schema).parquet(path)
    _tables[id(out)] = out, path
    while len(_tables) > 64:
        del _tables[next(iter(_tables))]
    return out


#: The latest tables of materialize and their paths, by which they are deleted.
_tables: dict[int, tuple[DataFrame, str]] = {}


def written_order(df: DataFrame, label: str, column: str) -> DataFrame:
    """df with its rows' places in `column` (long, from 0): in the order of its Parquet files, each whole.

    A table that isn't just read from Parquet files is first written in its own order. Readers deal
    files and pieces of them to tasks in any order; file numbers and rows in a file don't change.
    The driver gets one number a file.
    """
    if df._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        df = materialize(df, label)
    name, row = F.col("_metadata.file_name"), F.col("_metadata.row_index")
    rows = df.select(name.alias("f"), row.alias("r")).groupBy("f").agg(F.max("r").alias("r")).collect()
    first, before = {}, 0
    for f, n in sorted(((r["f"], r["r"] + 1) for r in rows), key=lambda x: (int((re.match(r"part-(\d+)", x[0]) or ["", 0])[1]), x[0])):
        first[f] = before
        before += n
    starts = F.from_json(F.lit(json.dumps(first)), "map<string,bigint>")
    return df.withColumn(column, F.element_at(starts, name) + row)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, n + 1 of each at least."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, 1 << 18)
        base, inverse = np.full(size, _P, np.uint64), np.full(size, pow(_P, -1, 1 << 64), np.uint64)
        base[0] = inverse[0] = 1
        _powers[:] = np.multiply.accumulate(base), np.multiply.accumulate(inverse)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def utf8(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_BYTES):
    """Slices of batch with about `most` text bytes each; whole documents always."""
    texts = batch.column(batch.schema.get_field_index(column))
    _, offsets = utf8(texts)
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        stop = min(stop, len(texts))
        yield batch.slice(start, stop - start)
        start = stop


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """Polynomial prefix hashes modulo 2**64; see span_hash."""
    base, _ = powers(len(raw))
    out = np.empty(len(raw) + 1, np.uint64)
    out[0] = 0
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * base[: len(raw)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span; equal bytes, equal hash, wherever they stand."""
    _, inverse = powers(len(prefix))
    length = (ends - starts).astype(np.uint64)
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + length * np.uint64(0xD6E8FEB86659FD93))


def word_spans(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words per document) of the maximal runs of word bytes; runs end with their document.

    inside: a boolean per byte; by default every byte but the separators.
    """
    n = len(raw)
    docs = len(offsets) - 1
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(docs, np.int64)
    inside = ~_IS_SEP[raw] if inside is None else inside
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    last = np.zeros(n + 1, bool)
    last[offsets[1:]] = True
    starts = np.flatnonzero(inside & (first[:n] | ~np.concatenate(([False], inside[:-1]))))
    ends = np.flatnonzero(inside & (last[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def word_hashes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, words per document); lower folds A-Z."""
    raw, offsets = utf8(texts)
    starts, ends, counts = word_spans(raw, offsets)
    return span_hash(prefix_hash(_LOWER[raw] if lower else raw), starts, ends), counts


def lowered(raw: np.ndarray) -> np.ndarray:
    return _LOWER[raw]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")
