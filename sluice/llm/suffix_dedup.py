"""Suffix-array dedup: repeated byte strings across documents, by difference-cover suffix sorting.

Suffixes are dealt to tasks by a content-defined anchor: of the 20-grams of a 50-byte window, the
one with the least hash. Equal windows have equal anchors at equal places, so windows that must be
compared meet, and only an anchor's own windows travel. A task sorts the suffixes it got by the
difference-cover algorithm (sort sampled triples, recurse on their names, merge the rest), and
compares the prefixes of neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm.graph import by_group
from sluice.llm.shared import chunks, documents, materialize, prefix_hash, small_batches, span_hash, utf8

LENGTH, GRAM = 50, 20
#: Text bytes whose suffixes one range holds, by which the number of ranges grows with the input, and
#: those that a task gathers before it sends them on.
RANGE_BYTES, FLUSH_BYTES = 6 << 20, 6 << 20
#: Bits of the bitmap that tells most documents without a repeat; a fixed size.
BITMAP = 1 << 23
#: Bytes whose suffixes are sorted at once, if groups allow.
SORT_BYTES = 1 << 19
_FAR = np.int64(2**63 - 1)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole numbers (from 0) that order like the pairs (a, b)."""
    top = int(b.max(initial=0)) + 1
    if (int(a.max(initial=0)) + 1) * top < 2**62:
        return a * top + b
    return np.unique(a, return_inverse=True)[1] * top + np.unique(b, return_inverse=True)[1]


def suffix_ranks(s: np.ndarray, depth: int) -> np.ndarray:
    """Numbers that order the suffixes of s (positive numbers) by their first `depth` entries at least.

    Suffixes that differ there are ordered rightly; others may have any order. The difference cover
    is {1, 2} modulo 3.
    """
    n = len(s)
    padded = np.concatenate((s.astype(np.int64), np.zeros(3, np.int64)))
    at = np.arange(n)
    one, two, zero = at[at % 3 == 1], at[at % 3 == 2], at[at % 3 == 0]
    sample = np.concatenate((one, two))
    names = np.unique(_pair(_pair(padded[sample], padded[sample + 1]), padded[sample + 2]), return_inverse=True)[1] + 1
    if depth > 3 and len(sample) and names.max() < len(sample):
        # the names of one residue, an end, and those of the other: each name stands for three entries
        deeper = suffix_ranks(np.concatenate((names[: len(one)], [0], names[len(one) :])), -(-depth // 3))
        names = np.concatenate((deeper[: len(one)], deeper[len(one) + 1 :])) + 1
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = names
    first = _pair(padded[:n], rank[1 : n + 1])  # of residues 0 and 1: entry, then a sampled suffix
    second = _pair(_pair(padded[:n], padded[1 : n + 1]), rank[2 : n + 2])  # of residues 0 and 2
    zeros_first, zeros_second, ones, twos, samples = (_sorted(x) for x in (first[zero], second[zero], first[one], second[two], names))
    out = np.empty(n, np.int64)
    out[zero] = _below(zeros_first, zeros_first) + _below(zeros_first, ones) + _below(zeros_second, twos)
    own = _below(samples, samples)
    out[one] = own[: len(one)] + _below(ones, zeros_first)
    out[two] = own[len(one) :] + _below(twos, zeros_second)
    return out


def _sorted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(values)
    return values[order], order


def _below(these: tuple[np.ndarray, np.ndarray], those: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """For each of these values, in their first order, how many of those are less; both come from _sorted."""
    out = np.empty(len(these[0]), np.int64)
    out[these[1]] = np.searchsorted(those[0], these[0])
    return out


def equal_windows(text: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(starts in suffix order, class of each): windows of `length` bytes are in one class if they are equal."""
    order = starts[np.argsort(suffix_ranks(text.astype(np.int64) + 1, length)[starts], kind="stable")]
    new = np.ones(len(order), bool)
    reach = np.arange(length)
    for a in range(1, len(order), 1 << 15):
        b = min(len(order), a + (1 << 15))
        new[a:b] = (text[order[a:b, None] + reach] != text[order[a - 1 : b - 1, None] + reach]).any(axis=1)
    return order, np.cumsum(new) - 1


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(document, first and last own window start, place, hash) of each anchor of the windows inside documents."""
    n, width = len(raw), length - gram + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, np.zeros(0, np.uint64)
    prefix = prefix_hash(raw)
    at = np.arange(n - gram + 1)
    hashes = span_hash(prefix, at, at + gram)
    # the hash's upper half, the same for equal windows in whatever chunk, then the place (below 2**32): ties go to the leftmost
    least = (hashes >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)
    done = 1
    while done * 2 <= width:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    if done < width:
        least = np.minimum(least[: len(least) - (width - done)], least[width - done :])
    starts = np.arange(len(least))
    doc = np.searchsorted(offsets, starts, "right") - 1
    inside = starts + length <= offsets[doc + 1]
    starts, doc, anchor = starts[inside], doc[inside], (least[inside] & np.uint64((1 << 32) - 1)).astype(np.int64)
    if not len(starts):
        return none, none, none, none, np.zeros(0, np.uint64)
    first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]))))
    last = np.append(first[1:], len(starts)) - 1
    return doc[first], starts[first], starts[last], anchor[first], hashes[anchor[first]]


def _packed(columns: dict[str, pa.Array]) -> bytes:
    batch = pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


#: Columns of a packed block of anchors: number of its bytes, place of the anchor in its windows' bytes,
#: document's key (as differences), mark of its text, first window start.
_BLOCK = {"size": "<u1", "place": "<u1", "id": "<i8", "mark": "<u2", "lo": "<i4"}


def _pack_block(columns: dict[str, np.ndarray], flat: np.ndarray) -> bytes:
    """Columns by byte planes, then the windows' bytes, compressed."""
    columns = columns | {"id": np.diff(columns["id"], prepend=np.int64(0))}
    planes = [columns[c].astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T.tobytes() for c, kind in _BLOCK.items()]
    return zstandard.compress(np.array([len(columns["id"]), len(flat)], "<i8").tobytes() + b"".join(planes) + flat.tobytes(), 3)


def _unpack_block(data: bytes) -> tuple[dict[str, np.ndarray], np.ndarray]:
    raw = zstandard.decompress(data)
    n, size = np.frombuffer(raw[:16], "<i8").tolist()
    at, columns = 16, {}
    for c, kind in _BLOCK.items():
        width = np.dtype(kind).itemsize
        columns[c] = np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).view(kind).ravel()
        at += n * width
    columns["id"] = np.cumsum(columns["id"])
    return columns, np.frombuffer(raw, np.uint8, size, at)


def _deal(batches: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    """Anchors with their windows, gathered by range; texts that this task has had with a lesser id go as whole runs."""
    seen: dict[int, int] = {}
    held: list[tuple] = []
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        hashes, ids, texts, los, places, lengths, bodies = (np.concatenate(x) for x in zip(*held, strict=True))
        part = (hashes >> np.uint64(40)).astype(np.int64) % ranges
        ends = np.cumsum(lengths)
        order = np.argsort(part, kind="stable")
        some, first = np.unique(part[order], return_index=True)  # only ranges that have anchors here
        numbers, data = [], []
        for r, own in zip(some.tolist(), np.split(order, first[1:]), strict=True):
            n = lengths[own]
            flat = bodies[np.repeat(ends[own] - n - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            numbers.append(r)
            data.append(_pack_block({"size": n, "place": places[own], "id": ids[own], "mark": texts[own], "lo": los[own]}, flat))
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(data, pa.binary())], ["range", "data"])

    for whole in batches:
        for batch in chunks(whole):
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            sizes = np.diff(utf8(batch.column(2))[1])
            keep = np.ones(len(ids), bool)
            whole_runs = []
            for k, (i, t) in enumerate(zip(ids.tolist(), texts.tolist(), strict=True)):
                if t in seen and seen[t] <= i:
                    keep[k] = False
                    if seen[t] < i and sizes[k] >= LENGTH:
                        whole_runs.append(k)
                else:
                    seen[t] = i
            if whole_runs:
                columns = (ids[whole_runs], _mark(texts[whole_runs]), np.zeros(len(whole_runs), np.int64), sizes[whole_runs])
                data = _packed(dict(zip(("id", "mark", "a", "z"), map(pa.array, columns), strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array([ranges + int(ids[whole_runs[0]]) % ranges], pa.int32()), pa.array([data], pa.binary())], ["range", "data"])
            batch = batch.filter(pa.array(keep))
            ids, texts = ids[keep], texts[keep]
            raw, offsets = utf8(batch.column(2))
            doc, lo, hi, anchor, hashes = anchors(raw, offsets)
            if not len(doc):
                continue
            lengths = hi - lo + LENGTH
            bodies = raw[np.repeat(lo - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())]
            held.append((hashes, ids[doc], _mark(texts[doc]), lo - offsets[doc], anchor - lo, lengths, bodies))
            size += len(raw)
            if size >= FLUSH_BYTES:
                yield from out()
                held, size = [], 0
    if held:
        yield from out()


def _least_ids(group: np.ndarray, ids: np.ndarray, bodies: list[np.ndarray], windows: np.ndarray) -> np.ndarray:
    """For each window of each distinct body, the least id that has it: bodies of a group may share windows."""
    out = np.repeat(ids, windows)
    several = np.bincount(group, minlength=int(group.max(initial=-1)) + 1)[group] > 1
    chosen = np.flatnonzero(several)
    if not len(chosen):
        return out
    first_window = np.cumsum(windows) - windows
    sizes = np.array([len(bodies[k]) for k in chosen])
    total = np.cumsum(sizes)
    a = 0
    while a < len(chosen):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + SORT_BYTES, "right")))
        while b < len(chosen) and group[chosen[b]] == group[chosen[b - 1]]:
            b += 1  # a group's windows are sorted together
        own = chosen[a:b]
        text = np.concatenate([bodies[k] for k in own])
        begin = np.cumsum(sizes[a:b]) - sizes[a:b]
        n = windows[own]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        starts = np.repeat(begin, n) + inside
        place = np.repeat(first_window[own], n) + inside
        order, kind = equal_windows(text, starts)
        back = np.empty(len(text), np.int64)
        back[starts] = place
        at = back[order]
        least = np.full(int(kind[-1]) + 1, _FAR)
        np.minimum.at(least, kind, out[at])
        out[at] = least[kind]
        a = b
    return out


def _exact(raw: np.ndarray, offsets: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Numbers that are equal for equal spans of raw only: the hashes, or places of distinct bytes if a hash stands for two."""
    order = np.argsort(hashes, kind="stable")
    same = np.flatnonzero(hashes[order[1:]] == hashes[order[:-1]])
    a, b = order[same], order[same + 1]
    n = offsets[a + 1] - offsets[a]
    differ = bool((n != offsets[b + 1] - offsets[b]).any())
    for k in range(0, 0 if differ else len(a), 1 << 14):  # neighbours in the order of their hashes, byte by byte
        x, y, m = a[k : k + (1 << 14)], b[k : k + (1 << 14)], n[k : k + (1 << 14)]
        inside = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        if (raw[np.repeat(offsets[x], m) + inside] != raw[np.repeat(offsets[y], m) + inside]).any():
            differ = True
            break
    if not differ:
        return hashes
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(raw[x:y].tobytes(), len(known)) for x, y in zip(offsets[:-1], offsets[1:], strict=True)], np.uint64)


def _repeats(batches: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    """Runs of window starts that a document with a lesser id has too."""
    for packed in by_group(batches, ["range"]):
        data = packed.column("data")
        if packed.column("range")[0].as_py() >= ranges:
            yield from pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in data]).to_batches()
            continue
        blocks = [_unpack_block(x.as_buffer()) for x in data]
        ids, marks, lo, places, sizes = (np.concatenate([b[0][c] for b in blocks]).astype(np.int64) for c in ("id", "mark", "lo", "place", "size"))
        raw = np.concatenate([b[1] for b in blocks])
        del blocks, data
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        hashes, bodies = np.empty(len(ids), np.uint64), np.empty(len(ids), np.uint64)
        for a in range(0, len(ids), 1 << 14):
            own = slice(a, min(len(ids), a + (1 << 14)))
            begin, end = offsets[own] - offsets[a], offsets[own.start + 1 : own.stop + 1] - offsets[a]
            prefix = prefix_hash(raw[offsets[a] : offsets[own.stop]])
            bodies[own] = span_hash(prefix, begin, end)
            hashes[own] = span_hash(prefix, begin + places[own], begin + places[own] + GRAM)
        bodies = _exact(raw, offsets, bodies)
        order = np.lexsort((ids, bodies, hashes))
        h, i, body = hashes[order], ids[order], bodies[order]
        new_anchor = np.concatenate(([True], h[1:] != h[:-1]))
        anchor = np.cumsum(new_anchor) - 1
        shared = (np.minimum.reduceat(i, np.flatnonzero(new_anchor)) != np.maximum.reduceat(i, np.flatnonzero(new_anchor)))[anchor]
        order = order[shared]
        if not len(order):
            continue
        h, i, body, anchor = h[shared], i[shared], body[shared], anchor[shared]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (body[1:] != body[:-1])))
        distinct = np.cumsum(new) - 1  # of each occurrence; the first has the least id
        first = np.flatnonzero(new)
        where = order[first]
        windows = offsets[where + 1] - offsets[where] - LENGTH + 1
        group = np.unique(anchor[first], return_inverse=True)[1]
        least = _least_ids(group, i[first], [raw[offsets[k] : offsets[k + 1]] for k in where], windows)
        begin = np.cumsum(windows) - windows
        for a in range(0, len(order), 1 << 15):
            own = slice(a, a + (1 << 15))
            d = distinct[own]
            n = windows[d]
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            row = np.repeat(np.arange(len(d)), n)
            flagged = np.repeat(i[own], n) > least[np.repeat(begin[d], n) + inside]
            row, inside = row[flagged], inside[flagged]
            if not len(row):
                continue
            starts = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (inside[1:] != inside[:-1] + 1))))
            stops = np.append(starts[1:], len(row)) - 1
            r = order[own][row[starts]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[r]), pa.array(marks[r]), pa.array(lo[r] + inside[starts]), pa.array(lo[r] + inside[stops] + LENGTH)], ["id", "mark", "a", "z"]
            )


def _mark(hashes: np.ndarray) -> np.ndarray:
    """16 bits of a text's hash."""
    return (hashes.view(np.uint64) >> np.uint64(48)).astype(np.int64)


def _union(a: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of [a, z)."""
    order = np.argsort(a, kind="stable")
    a, z = a[order], np.maximum.accumulate(z[order])
    new = np.concatenate(([True], a[1:] > z[:-1]))
    return a[new], z[np.append(np.flatnonzero(new)[1:], len(a)) - 1]


_RESULT = T.StructType([T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("kept_sha256", T.StringType())])


@F.arrow_udf(_RESULT)
def _cut(texts: pa.Array, runs: pa.Array) -> pa.Array:
    import hashlib

    rows = []
    for text, own in zip(texts, runs, strict=True):
        raw = text.as_buffer().to_pybytes() if text.is_valid else b""
        if own.is_valid and len(own):
            struct = own.values
            a, z = _union(struct.field("a").to_numpy(), struct.field("z").to_numpy())
            kept = b"".join(raw[x:y] for x, y in zip([0, *z.tolist()], [*a.tolist(), len(raw)], strict=True))
            rows.append((int((z - a).sum()), len(a), kept, hashlib.sha256(kept).hexdigest()))
        else:
            rows.append((0, 0, raw, hashlib.sha256(raw).hexdigest()))
    n, spans, kept, digests = zip(*rows, strict=True) if rows else ((), (), (), ())
    text = [x.decode("utf-8", "replace") for x in kept]
    return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(spans, pa.int64()), pa.array(text, pa.string()), pa.array(digests, pa.string())], [f.name for f in _RESULT])


def repeated_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, mark, a, z): byte ranges [a, z) of documents to be removed, written to the shared folder; they may overlap.

    id: the key, null as the greatest number; mark: 16 bits of the text's hash,
    which tell rows that repeat a key with another text.
    """
    small_batches(docs.sparkSession)
    rows = _keyed(docs, key, text)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(16, -(-total // RANGE_BYTES))
    dealt = rows.mapInArrow(lambda it: _deal(it, ranges), "range int, data binary")
    # one range a task: hashing range numbers would put several in some tasks and none in others
    found = dealt.repartitionById(ranges, F.pmod("range", F.lit(ranges))).sortWithinPartitions("range").mapInArrow(lambda it: _repeats(it, ranges), "id long, mark long, a long, z long")
    return materialize(found, "runs")


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(int(_FAR))).alias("id"), F.xxhash64(whole).alias("hash"), whole.alias("text"))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with n_bytes, n_removed, n_spans (long), kept (string) and kept_sha256.

    Of the UTF-8 bytes of each text, those covered by a LENGTH-byte string that also starts in a
    document with a smaller key are removed; strings are judged on the input and never cross
    documents. kept is decoded with replacement marks where a cut splits a character; the digest is
    of the bytes. n_spans: maximal removed runs.

    Null texts are empty, and texts under LENGTH bytes lose nothing. A null key counts as greater
    than all others; rows with one key don't remove from each other, and repeated rows get equal
    results. An empty table stays empty; columns with these names are replaced, others pass through.
    """
    names = ("n_bytes", "n_removed", "n_spans", "kept", "kept_sha256")
    rows = docs.drop(*names, "__id", "__mark")
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = rows.withColumns({"__id": F.coalesce(F.col(key).cast("long"), F.lit(int(_FAR))), "__mark": F.shiftrightunsigned(F.xxhash64(whole), 48), "n_bytes": F.octet_length(whole).cast("long")})
    runs = repeated_runs(docs, key, text)
    listed = runs.groupBy(F.col("id").alias("__id"), F.col("mark").alias("__mark")).agg(F.collect_list(F.struct("a", "z")).alias("__runs"))

    bit = F.pmod(F.xxhash64("__id", "__mark"), F.lit(BITMAP))
    words = runs.select(F.pmod(F.xxhash64("id", "mark"), F.lit(BITMAP)).alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("v")).toArrow()
    bitmap = np.zeros(BITMAP // 64, np.int64)  # BITMAP bits, whatever the input
    bitmap[words.column("w").to_numpy()] = words.column("v").to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    @F.arrow_udf(T.BooleanType())
    def may_repeat(b: pa.Array) -> pa.Array:
        at = b.to_numpy(zero_copy_only=False)
        return pa.array((sent.value[at >> 6] >> (at & 63)) & 1 == 1)

    marked = rows.withColumn("__may", may_repeat(bit))
    cut = marked.where("__may").join(listed.hint("merge"), ["__id", "__mark"], "left").withColumn("__cut", _cut(F.col(text), F.col("__runs")))
    cut = cut.select("*", *(F.col(f"__cut.{f.name}").alias(f.name) for f in _RESULT)).drop("__runs", "__cut", "__may")
    rest = marked.where("not __may").withColumns({"n_removed": F.lit(0).cast("long"), "n_spans": F.lit(0).cast("long"), "kept": whole, "kept_sha256": F.sha2(whole, 256)}).drop("__may")
    return cut.unionByName(rest).select(*docs.drop(*names).columns, *names)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
