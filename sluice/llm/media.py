"""Media columns: payloads as grey images in tar shards, addressed by digest, offset and length.

A payload is stored losslessly as an 8-bit greyscale PNG of 576 samples a row. Each task writes one
tar shard, with a member for each distinct payload named by the digest of what is stored. Rows carry
the digest; each digest has one address (shard, offset, length), whichever tasks stored it, and a
reader gets the image's metadata from the first bytes of a member alone.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.shared import chunks, documents, materialize, new_path, small_batches

#: Samples of a row, the value that fills the last one, and the bytes of a PNG that its metadata are in.
WIDTH, FILL, HEADER = 576, 255, 33
#: A digest that one in HOT rows have isn't joined by a merge; at most HOT digests are so frequent.
HOT = 256
#: The last bytes of a payload that the query's checksum is of.
TAIL = 32
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_TAR = 512


def payload_of(text: bytes) -> bytes:
    """text filled up to a positive multiple of WIDTH bytes."""
    return text + bytes([FILL]) * (max(1, -(-len(text) // WIDTH)) * WIDTH - len(text))


def _part(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(payload: bytes) -> bytes:
    """A PNG whose samples are the bytes of payload; equal payloads, equal images."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # filter 0 before each row
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _part(b"IHDR", header) + _part(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _part(b"IEND", b"")


def header_of(head: bytes) -> tuple[int, int, int]:
    """(width, height, bits a sample) from the first HEADER bytes of an image."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not one of our images")
    width, height, bits = struct.unpack(">IIB", head[16:25])
    return width, height, bits


def decode(image: bytes) -> bytes:
    """The samples of an image of encode."""
    width, height, _ = header_of(image[:HEADER])
    at, body = HEADER, b""
    while at < len(image):
        (n,) = struct.unpack(">I", image[at : at + 4])
        if image[at + 4 : at + 8] == b"IDAT":
            body += image[at + 8 : at + 8 + n]
        at += 12 + n
    return np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def features_of(payload: bytes) -> str:
    """Height, mean and deviation of the samples, and shares of the quarters of their range."""
    values = np.frombuffer(payload, np.uint8)
    quarters = np.bincount(values >> 6, minlength=4) / len(values)
    return f"{len(values) // WIDTH};{values.mean():.4f};{values.std():.4f};" + ",".join(f"{x:.4f}" for x in quarters)


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    """A file system that executors write to without Spark, and the path there; any shared one that Arrow knows."""
    return pafs.FileSystem.from_uri(folder)


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Store this task's payloads in a shard of its own; a row per document with its address.

    The shard's name is new in each attempt, so a lost or doubled attempt leaves at most a shard
    that no row names.
    """
    files, root = _open(folder)
    shard = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}.tar"
    known: dict[bytes, tuple[bytes, int, int]] = {}
    out = None
    at = 0
    for whole in batches:
        for batch in chunks(whole):
            rows = []
            for text in batch.column(1):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                own = hashlib.sha256(raw).digest()
                if own not in known:
                    if out is None:
                        files.create_dir(root, recursive=True)
                        out = files.open_output_stream(f"{root}/{shard}")
                    image = encode(payload_of(raw))
                    name = hashlib.sha256(image).digest()
                    entry = tarfile.TarInfo(f"{name.hex()}.png")
                    entry.size = len(image)
                    head = entry.tobuf(tarfile.USTAR_FORMAT)
                    fill = -len(image) % _TAR
                    out.write(head + image + bytes(fill))
                    known[own] = name, at + len(head), len(image)
                    at += len(head) + len(image) + fill
                rows.append((len(raw), *known[own]))
            n_bytes, names, offsets, lengths = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(names, pa.binary()), pa.array([shard] * len(rows)), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())],
                ["key", "n_bytes", "digest", "shard", "offset", "length"],
            )
    if out is not None:
        out.write(bytes(2 * _TAR))
        out.close()


def store(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str | None = None) -> tuple[DataFrame, DataFrame, str]:
    """(rows: key, n_bytes, digest; payloads: digest, shard, offset, length; the folder of the shards).

    A payload has one row and one address: if several tasks stored it, the first of theirs by shard.
    Null texts are empty ones, whose payload is one row of FILL; any key, null or repeated, has a row
    for each row of docs; no rows, no shard.
    """
    small_batches(docs.sparkSession)
    folder = folder or new_path(docs.sparkSession, "media")
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(
        lambda it: _write(it, folder), f"key {kind}, n_bytes long, digest binary, shard string, offset long, length long"
    )
    rows = materialize(rows, "addresses")
    first = rows.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("a")).select("digest", "a.*")
    return rows.select("key", "n_bytes", "digest"), first, folder


def attach(rows: DataFrame, payloads: DataFrame) -> DataFrame:
    """rows with the other columns of payloads, by digest.

    A digest that one in HOT rows or more have is joined by a broadcast, of HOT rows at most;
    the others are joined by a merge, so no digest's rows are one task.
    """
    total = rows.count()
    hot = [bytes(r["digest"]) for r in rows.groupBy("digest").count().where(F.col("count") * HOT >= max(total, HOT * 2)).select("digest").collect()]
    is_hot = F.coalesce(F.col("digest").isin(hot), F.lit(False)) if hot else F.lit(False)
    rest = rows.where(~is_hot).join(payloads.where(~is_hot).hint("merge"), "digest")
    return rest.unionByName(rows.where(is_hot).join(F.broadcast(payloads.where(is_hot)), "digest")) if hot else rest


def _by_shard(batches: Iterator[pa.RecordBatch], folder: str, work) -> Iterator[tuple[list[str], pa.RecordBatch, list]]:
    """Each batch with the columns of work(file, offset, length, digest) of its rows."""
    files, root = _open(folder)
    name, source = None, None
    for batch in batches:
        values = []
        for shard, offset, length, digest in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("shard", "offset", "length", "digest")), strict=True):
            if shard != name:
                if source is not None:
                    source.close()
                name, source = shard, files.open_input_file(f"{root}/{shard}")
            values.append(work(source, offset, length, digest))
        yield batch.schema.names, batch, list(zip(*values, strict=True)) if values else []
    if source is not None:
        source.close()


def _read(source, offset: int, length: int) -> bytes:
    source.seek(offset)
    return source.read(length)


def with_metadata(payloads: DataFrame, folder: str) -> DataFrame:
    """payloads with width, height and bits (int), from reads of the first HEADER bytes of each member alone."""

    def run(batches):
        for names, batch, columns in _by_shard(batches, folder, lambda source, offset, length, digest: header_of(_read(source, offset, HEADER))):
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int32()) for c in columns)] if columns else [*batch.columns, *[pa.array([], pa.int32())] * 3], [*names, "width", "height", "bits"])

    kept = payloads.drop("width", "height", "bits")
    return _near(kept).mapInArrow(run, _ddl(kept) + ", width int, height int, bits int")


def _full(source, offset: int, length: int, digest: bytes, tail: int = WIDTH) -> tuple:
    image = _read(source, offset, length)
    own = hashlib.sha256(image).digest()
    if own != digest:
        raise ValueError(f"what is stored at {offset} isn't what was written")
    payload = decode(image)
    return len(payload), hashlib.sha256(payload).digest(), zlib.crc32(payload[-tail:]), length, own, features_of(payload)


_FULL = {"payload_bytes": "long", "payload_sha256": "binary", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "binary", "feature": "string"}
_ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def with_features(payloads: DataFrame, folder: str, tail: int = WIDTH) -> DataFrame:
    """payloads with the columns of _FULL, of what is read back from the shards; an error if its digest isn't the row's.

    tail: the last bytes of a payload, a row of samples by default, that tail_crc32 is of.
    """

    def run(batches):
        for names, batch, columns in _by_shard(batches, folder, lambda *a: _full(*a, tail)):
            made = columns or [[]] * len(_FULL)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, _ARROW[k]) for c, k in zip(made, _FULL.values(), strict=True))], [*names, *_FULL])

    kept = payloads.drop(*_FULL)
    return _near(kept).mapInArrow(run, _ddl(kept) + "".join(f", {k} {v}" for k, v in _FULL.items()))


def _near(payloads: DataFrame) -> DataFrame:
    """Rows of a stretch of a shard together and in its order; a stretch is 64 MB, so no shard is one task."""
    return payloads.repartition("shard", F.shiftright("offset", 26)).sortWithinPartitions("shard", "offset")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, payloads, folder = store(documents(spark, sf_dir))
    # the digest is that of the stored form, as read back: with_features makes sure
    known = materialize(with_features(with_metadata(payloads, folder), folder, TAIL).drop("media_sha256"), "payloads")
    hexed = lambda c: F.lower(F.hex(c))
    return attach(rows, known).select(
        F.col("key").alias("doc_id"), "n_bytes", "payload_bytes", hexed("payload_sha256").alias("payload_sha256"), "tail_crc32", "media_bytes",
        hexed("digest").alias("media_sha256"), "feature", "shard", "offset", "length", "width", "height", "bits",
    )
