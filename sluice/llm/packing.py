"""Packing: documents along a Hilbert curve through their projected token vectors, cut into sequences."""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.shared import SEPARATORS, chunks, documents, materialize, small_batches

#: Tokens of a sequence, the id that ends a document, dimensions of the curve and bits of each.
LENGTH, END, DIMENSIONS, BITS = 1024, 0, 3, 12

#: Fixed value: how byte-level BPE vocabularies of this kind split a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


@functools.lru_cache(2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Bytes of a run without white space, or without printable ASCII, from which on a text goes to tokenizers:
#: tiktoken's splitter and merges aren't made for pieces without end.
LONG_RUN = 1 << 13
_SPACE, _PLAIN = np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[*SEPARATORS]] = _PLAIN[33:127] = True


def has_long_run(text: str) -> bool:
    """Whether the text has LONG_RUN bytes or more in a row without white space, or without printable ASCII.

    Any piece that the splitter makes of so many bytes is one of these: letters, digits and signs have
    no white space, and white space of any kind has no printable ASCII.
    """
    if len(text) < LONG_RUN // 4:
        return False
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return any(np.diff(np.flatnonzero(kind[raw]), prepend=-1, append=len(raw)).max() > LONG_RUN for kind in (_SPACE, _PLAIN))


@functools.lru_cache(2)
def encoder(path: str):
    """A function from texts to lists of ids, as tokenizers gives them for the file at path with add_special_tokens=False.

    For a byte-level BPE file the ids are made by tiktoken from the file's vocabulary, whose ids are
    merge ranks: the same ids several times faster (a test compares them). Texts that name an added
    token, those with a very long run (has_long_run), and other files go to tokenizers itself.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    added = [t["content"] for t in spec.get("added_tokens", ())]
    whole = lambda texts: [x.ids for x in _tokenizer(path).encode_batch(texts, add_special_tokens=False)]
    if spec["model"]["type"] == "BPE" and (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not spec["pre_tokenizer"].get("add_prefix_space") and not spec.get("normalizer"):
        import tiktoken

        table, special = _byte_of(), set(added)
        ranks = {bytes(table[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        bpe = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [whole([t])[0] if any(a in t for a in added) or has_long_run(t) else bpe.encode_ordinary(t) for t in texts]
    return whole


def hilbert_key(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places (int64) on the Hilbert curve of points (n x d) of whole coordinates below 2**bits (Skilling 2004)."""
    x = x.astype(np.int64).copy()
    d = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            high = (x[:, i] & q) != 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] = np.where(high, x[:, 0] ^ p, x[:, 0] ^ swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[:, d - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


@functools.lru_cache(1)
def _directions(size: int) -> np.ndarray:
    return np.random.RandomState(7).randn(size, DIMENSIONS).astype(np.float32)


def curve_keys(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The Hilbert key of each document's mean projected token vector; counts are positive."""
    directions = _directions(1 << 17)
    mean = np.add.reduceat(directions[ids & (len(directions) - 1)], np.cumsum(counts) - counts, axis=0) / counts[:, None]
    return hilbert_key(((1 / (1 + np.exp(-6 * mean))) * ((1 << BITS) - 1)).astype(np.int64))


def _encode(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[pa.RecordBatch]:
    encode, row = encoder(path), TaskContext.get().partitionId() << 33
    for whole in batches:
        for batch in chunks(whole):
            lists = encode([t or "" for t in batch.column(1).to_pylist()])
            ids = [np.array([*x, end], "<u4") for x in lists]
            counts = np.array([len(x) for x in ids])
            flat = np.concatenate(ids)
            narrow = int(flat.max()) < 1 << 16
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + len(ids))),
                    batch.column(0),
                    pa.array(curve_keys(flat.astype(np.int64), counts)),
                    pa.array(counts),
                    pa.array([narrow] * len(ids)),
                    pa.array([(x.astype("<u2") if narrow else x).tobytes() for x in ids], pa.binary()),
                    batch.column(2),
                ],
                ["row", "key", "place", "n", "narrow", "ids", "stretch"],
            )
            row += len(ids)


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, before = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column(1).to_numpy()
        ends = before + np.cumsum(n)
        if len(n):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(n), part)), pa.array(ends - n), pa.array(n)], ["row", "part", "start", "n"])
            before = int(ends[-1])


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    names = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    for whole in batches:
        for k in range(0, whole.num_rows, 512):
            batch = whole.slice(k, 512)
            n, at = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            first, last = at // length, (at + n - 1) // length
            pieces = last - first + 1
            doc = np.repeat(np.arange(len(n)), pieces)
            sequence = np.repeat(first - (np.cumsum(pieces) - pieces), pieces) + np.arange(pieces.sum())
            begin = np.maximum(sequence * length, at[doc])
            stop = np.minimum((sequence + 1) * length, (at + n)[doc])
            kinds = batch.column(3).to_pylist()
            ids = [np.frombuffer(x.as_buffer(), "<u2" if narrow else "<u4").astype("<u4") for x, narrow in zip(batch.column(4), kinds, strict=True)]
            crc = [zlib.crc32(ids[d][a:b]) for d, a, b in zip(doc, begin - at[doc], stop - at[doc], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), *(pa.array(np.asarray(x, np.int64)) for x in (begin - at[doc], stop - begin, crc, n[doc], sequence, begin - sequence * length))], names
            )


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, end: int = END, stretch: str | None = None) -> DataFrame:
    """Pieces of all documents: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each text's ids and one `end` follow each other along the Hilbert curve of the documents' mean
    projected token vectors (ties by key) and are cut every `length` ids, so only the last sequence
    is padded. stretch: a whole-numbered column; documents of a lower stretch come first, and the
    curve orders those of one stretch. By default all are one. ids_crc32 is of the piece's ids as little-endian unsigned 32-bit numbers.

    Null and empty texts are one `end`. Texts are encoded whole. Rows that repeat a key are each
    packed; null keys stay null; an empty table gives an empty result; other columns are not read.
    Ids are shuffled once, and what comes to the driver is one number a partition.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    encoded = materialize(
        docs.select(F.col(key).alias("key"), F.col(text).alias("text"), (F.col(stretch) if stretch else F.lit(0)).cast("long").alias("stretch")).mapInArrow(
            lambda it: _encode(it, tokenizer, end), f"row long, key {kind}, place long, n long, narrow boolean, ids binary, stretch long"
        ),
        "tokens",
    )
    order = ["stretch", "place", "key", "row"]
    placed = encoded.select("n", *order).repartitionByRange(*order).sortWithinPartitions(*order).select("row", "n")
    placed = materialize(placed.mapInArrow(_starts, "row long, part long, start long, n long"), "places")
    totals = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    base, before = [0] * (max(totals, default=0) + 1), 0
    for part in sorted(totals):
        base[part] = before
        before += totals[part]
    begin = F.col("start") + F.get(F.from_json(F.lit(json.dumps(base)), "array<bigint>"), F.col("part").cast("int"))
    cut = encoded.join(placed.select("row", begin.alias("at")).hint("merge"), "row").select("key", "n", "at", "narrow", "ids")
    out = cut.mapInArrow(lambda it: _cut(it, length), f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("key", key)


def tokenizer_path() -> str:
    """Where the public byte-level vocabulary lies; never copied into the repository."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), tokenizer_path())
