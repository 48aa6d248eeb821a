"""Substring dedup: word sequences that stand in several documents, by prefix-partitioned suffix trees.

Suffixes are taken at content-defined words: of the PREFIX-word strings of a WINDOW-word window, the
one with the least hash, so equal windows have equal suffixes at equal places. A suffix's group is its
first PREFIX words. Groups that lie in one document have no repeat, and nothing of them is shipped.
The others are trees of their own, a task building as many at once as memory holds; the words left of
a suffix that its windows have go along. In a tree, names are given to the strings of 1, 2, 4, 8 words
and so on: a node is a name, the nodes at depth WINDOW are the windows, and those that two documents
have are deep internal nodes. A group too large for a task has its prefixes prolonged to the whole
window: each such group is one node, of which only the least document is wanted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm.shared import chunks, documents, materialize, mix, powers, prefix_hash, small_batches, span_hash, utf8, word_spans

#: Words of a window, and of a suffix's first prefix.
WINDOW, PREFIX = 50, 16
#: Suffixes of a group that one task takes (about 100 MB of it); words whose trees are built at once, if groups allow.
GROUP, TREE_WORDS = 1 << 14, 1 << 18
#: Bits of the map that tells most documents without a repeat; a fixed size.
BITMAP = 1 << 23
_LAST = (1 << 63) - 1


def _grams(hashes: np.ndarray, length: int, times: int = 1) -> np.ndarray:
    """The hash of the `length` words from each word on, as far as there are so many; times: another odd number, another hash."""
    base, inverse = powers(len(hashes))
    upto = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix(hashes * np.uint64(times)) * base[: len(hashes)], out=upto[1:])
    n = max(0, len(hashes) - length + 1)
    return mix((upto[length : length + n] - upto[:n]) * inverse[:n])


def suffixes(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, first and last own window start, place, hash) of each suffix of the windows inside documents; places are words."""
    none = np.zeros(0, np.int64)
    offsets = np.concatenate(([0], np.cumsum(counts)))
    if len(hashes) < WINDOW:
        return none, none, none, none, np.zeros(0, np.uint64)
    grams, width = _grams(hashes, PREFIX), WINDOW - PREFIX + 1
    # the upper half of the hash, then the place (below 2**32): ties go to the leftmost
    least = (grams >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
    done = 1
    while done * 2 <= width:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    least = np.minimum(least[: len(least) - (width - done)], least[width - done :])
    starts = np.arange(len(least))
    doc = np.searchsorted(offsets, starts, "right") - 1
    inside = starts + WINDOW <= offsets[doc + 1]
    starts, doc, place = starts[inside], doc[inside], (least[inside] & np.uint64((1 << 32) - 1)).astype(np.int64)
    if not len(starts):
        return none, none, none, none, np.zeros(0, np.uint64)
    first = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1]))))
    return doc[first], starts[first], starts[np.append(first[1:], len(starts)) - 1], place[first], grams[place[first]]


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, words per document, hashes) of the words of texts."""
    raw, offsets = utf8(texts)
    starts, ends, counts = word_spans(raw, offsets)
    return raw, starts, ends, counts, span_hash(prefix_hash(raw), starts, ends)


def _list(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(values))


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, digest, n_words, prefixes): of each document with a window, the hashes of its suffixes' prefixes."""
    for whole in batches:
        for batch in chunks(whole):
            _, _, _, counts, hashes = _words(batch.column(2))
            doc, _, _, _, found = suffixes(hashes, counts)
            long = counts >= WINDOW
            listed = _list(found.view(np.int64), np.bincount(doc, minlength=len(counts)))
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), listed], ["id", "digest", "n_words", "prefixes"])
            yield out.filter(pa.array(long))


def _joined(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where each word begins and the last ends) of words with a space after each."""
    sizes = ends - starts + 1
    upto = np.concatenate(([0], np.cumsum(sizes)))
    flat = np.full(upto[-1], 32, np.uint8)
    put = np.ones(upto[-1], bool)
    put[upto[1:] - 1] = False
    flat[put] = raw[(np.repeat(starts - upto[:-1], sizes) + np.arange(upto[-1]))[put]]
    return flat, upto


_SALT = np.uint64(0x9E3779B97F4A7C15)


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(prefix, id, row, first, body): of the suffixes with wanted prefixes the first window's place, and the words of all its windows.

    Rows that repeat a document come one after the other, and the first is enough.
    """
    last = None
    for whole in batches:
        for batch in chunks(whole):
            row = batch.column(2).to_numpy()
            fresh = np.concatenate(([row[0] != last], row[1:] != row[:-1]))
            last = row[-1]
            batch = batch.filter(pa.array(fresh))
            if not batch.num_rows:
                continue
            raw, starts, ends, counts, hashes = _words(batch.column(0))
            doc, low, high, _, found = suffixes(hashes, counts)
            lengths = pc.list_value_length(batch.column(3)).to_numpy(zero_copy_only=False)
            # a prefix and its document's place in the batch as one number; two that meet by chance only cost work
            asked = batch.column(3).flatten().to_numpy().view(np.uint64) + np.repeat(np.arange(len(counts)), lengths).astype(np.uint64) * _SALT
            own = np.isin(found + doc.astype(np.uint64) * _SALT, asked)
            doc, low, high, found = doc[own], low[own], high[own], found[own]
            n = high - low + WINDOW
            at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
            flat, upto = _joined(raw, starts[at], ends[at])
            cuts = np.concatenate(([0], upto[np.cumsum(n)])).astype(np.int32)
            texts = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(cuts), pa.py_buffer(flat)])
            first = low - (np.cumsum(counts) - counts)[doc]
            columns = [pa.array(found.view(np.int64)), batch.column(1).take(pa.array(doc)), batch.column(2).take(pa.array(doc)), pa.array(first), texts]
            yield pa.RecordBatch.from_arrays(columns, ["prefix", "id", "row", "first", "body"])


def window_names(words: np.ndarray, starts: np.ndarray, length: int = WINDOW) -> np.ndarray:
    """A number for each start: equal for equal strings of `length` entries from there, by names of 1, 2, 4 ... entries."""
    names, depth = np.unique(words, return_inverse=True)[1].astype(np.int64), 1
    while depth * 2 <= length:
        names = np.concatenate((np.unique(names[:-depth] * (names.max(initial=0) + 1) + names[depth:], return_inverse=True)[1], np.zeros(depth, np.int64)))
        depth *= 2
    return np.unique(names[starts] * (names.max(initial=0) + 1) + names[starts + length - depth], return_inverse=True)[1]


def _tree_repeats(groups: pa.Table) -> Iterator[pa.RecordBatch]:
    """(row, a, z): runs of words that a lesser document has too, of whole groups of suffixes."""
    bodies = groups.column("body").combine_chunks().dictionary_encode()  # equal ones are one
    which = bodies.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    raw, offsets = utf8(bodies.dictionary)
    starts, ends, counts = word_spans(raw, offsets)
    upto = np.concatenate(([0], np.cumsum(ends - starts)))
    keep = np.repeat(starts - upto[:-1], ends - starts) + np.arange(upto[-1])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(upto), pa.py_buffer(raw[keep])]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    windows = counts - WINDOW + 1
    begin = np.cumsum(windows) - windows
    names = window_names(words, np.repeat(np.cumsum(counts) - counts - begin, windows) + np.arange(windows.sum()))
    ids = groups.column("id").to_numpy()
    own = np.full(len(windows), _LAST)
    np.minimum.at(own, which, ids)
    least = np.full(int(names.max(initial=-1)) + 1, _LAST)
    np.minimum.at(least, names, np.repeat(own, windows))
    firsts, rows = groups.column("first").to_numpy(), groups.column("row").to_numpy()
    for a in range(0, len(ids), 1 << 12):
        n = windows[which[a : a + (1 << 12)]]
        row = a + np.repeat(np.arange(len(n)), n)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        some = ids[row] > least[names[begin[which[row]] + inside]]
        row, inside = row[some], inside[some]
        if not len(row):
            continue
        first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (inside[1:] != inside[:-1] + 1))))
        last = np.append(first[1:], len(row)) - 1
        base = firsts[row[first]]
        yield pa.RecordBatch.from_arrays([pa.array(rows[row[first]]), pa.array(base + inside[first]), pa.array(base + inside[last] + WINDOW)], ["row", "a", "z"])


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of the groups, which come sorted by prefix; whole groups are worked on together, TREE_WORDS or so."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        if held.nbytes < 6 * TREE_WORDS:
            continue
        prefix = held.column("prefix").to_numpy()
        cut = int(np.searchsorted(prefix, prefix[-1])) if len(prefix) else 0
        if cut:
            yield from _tree_repeats(held.slice(0, cut))
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield from _tree_repeats(held)


def _prolonged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, g, id, row, a): the windows of suffixes by two hashes of all their words."""
    for whole in batches:
        for batch in chunks(whole, "body"):
            column = lambda n: batch.column(batch.schema.get_field_index(n))
            _, _, _, counts, hashes = _words(column("body"))
            windows = counts - WINDOW + 1
            body = np.repeat(np.arange(len(counts)), windows)
            inside = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
            at = np.repeat(np.cumsum(counts) - counts, windows) + inside
            pick = pa.array(body)
            h, g = (_grams(hashes, WINDOW, times)[at].view(np.int64) for times in (1, 0xD6E8FEB86659FD93))
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(g), column("id").take(pick), column("row").take(pick), pa.array(column("first").to_numpy()[body] + inside)], ["h", "g", "id", "row", "a"])


_RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("kept_sha256", T.StringType())])


def _cut(texts: pa.Array, runs: pa.Array | None) -> pa.Array:
    """n_words, n_removed, kept and its digest of each text without the words of its runs."""
    raw, starts, ends, counts, _ = _words(texts)
    own = np.concatenate(([0], np.cumsum(counts)))
    keep = np.ones(len(starts), bool)
    if runs is not None and len(runs.flatten()):
        which = np.repeat(np.arange(len(runs)), pc.fill_null(pc.list_value_length(runs), 0).to_numpy(zero_copy_only=False))
        flat = runs.flatten()
        covered = np.zeros(len(starts) + 1, np.int64)
        np.add.at(covered, own[which] + flat.field("a").to_numpy(), 1)
        np.add.at(covered, own[which] + flat.field("z").to_numpy(), -1)
        keep = np.cumsum(covered[:-1]) == 0
    left = np.diff(np.concatenate(([0], np.cumsum(keep)))[own])
    flat, upto = _joined(raw, starts[keep], ends[keep])
    cuts = upto[np.concatenate(([0], np.cumsum(left)))]
    kept = [flat[a : max(a, b - 1)].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]  # without the last separator
    columns = [pa.array(counts, pa.int64()), pa.array(counts - left, pa.int64()), pa.array([k.decode() for k in kept], pa.string()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
    return pa.StructArray.from_arrays(columns, [f.name for f in _RESULT])


@F.arrow_udf(_RESULT)
def _cut_all(texts: pa.Array, runs: pa.Array) -> pa.Array:
    return _in_slices(texts, runs)


def _in_slices(texts: pa.Array, runs: pa.Array | None) -> pa.Array:
    out, batch = [], pa.RecordBatch.from_arrays([texts] + ([] if runs is None else [runs]), ["text"] + ([] if runs is None else ["runs"]))
    for part in chunks(batch):
        out.append(_cut(part.column(0), None if runs is None else part.column(1)))
    return pa.concat_arrays(out) if out else pa.array([], pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("kept_sha256", pa.string())]))


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("id"), F.unhex(F.md5(whole)).alias("digest"), whole.alias("text"))


def _bit(key: str = "id", digest: str = "digest") -> Column:
    """A document's place in a map of BITMAP bits."""
    return F.pmod(F.xxhash64(key, digest), F.lit(BITMAP))


def _map_of(some: DataFrame) -> Broadcast:
    """The map of BITMAP bits of the documents in some (id, digest): of one size, whatever the input."""
    words = some.select(_bit().alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("v")).toArrow()
    bitmap = np.zeros(BITMAP // 64, np.int64)
    bitmap[words.column("w").to_numpy()] = words.column("v").to_numpy()
    return some.sparkSession.sparkContext.broadcast(bitmap)


def _in_map(bitmap: np.ndarray, bits: pa.Array) -> pa.Array:
    at = bits.to_numpy(zero_copy_only=False)
    return pa.array((bitmap[at >> 6] >> (at & 63)) & 1 == 1)


def _may_be(sent: Broadcast, bit: Column) -> Column:
    """Whether a document may be among those of a map."""

    @F.arrow_udf(T.BooleanType())
    def may(b: pa.Array) -> pa.Array:
        return _in_map(sent.value, b)

    return may(bit)


def _cut_rest(sent: Broadcast, text: Column, bit: Column) -> Column:
    """The results of the documents that aren't in a map, null of the others."""

    @F.arrow_udf(_RESULT)
    def cut(texts: pa.Array, b: pa.Array) -> pa.Array:
        may = _in_map(sent.value, b)
        rest = _in_slices(texts.filter(pc.invert(may)), None)
        place = np.cumsum(~may.to_numpy(zero_copy_only=False)) - 1
        return rest.take(pa.array(np.maximum(place, 0), mask=may.to_numpy(zero_copy_only=False)))

    return cut.asNondeterministic()(text, bit)  # else a filter on the result would be a second evaluation


def repeated_words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, digest, runs): of documents that lose words, ranges [a, z) of them, which may overlap; written to the shared folder."""
    small_batches(docs.sparkSession)
    rows = _keyed(docs, key, text)
    listed = rows.mapInArrow(_prefixes, "id long, digest binary, n_words long, prefixes array<long>")
    listed = materialize(listed.withColumn("row", F.monotonically_increasing_id()), "prefixes")

    # a text that a lesser document has whole loses all its words; its least row stands for all that have it
    several = listed.groupBy("digest").agg(F.min(F.struct("id", "row")).alias("least"), F.count("*").alias("n")).where("n > 1").select("digest", "least")
    others = listed.select("row", "id", "digest", "n_words").join(materialize(several, "several"), "digest").where("row <> least.row")
    others = materialize(others.select("row", "id", "digest", "n_words", (F.col("id") > F.col("least.id")).alias("loses")), "copies")
    some = listed.join(others.select("row"), "row", "left_anti").select("row", "id", F.explode("prefixes").alias("prefix"))

    # groups that two documents have; how many suffixes a group has tells whether its prefixes are prolonged
    groups = materialize(some.groupBy("prefix").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("n")).where("least < most").select("prefix", (F.col("n") > GROUP).alias("large")), "groups")
    lists = (F.collect_set(F.when(cond, F.col("prefix"))).alias(n) for n, cond in (("small", ~F.col("large")), ("large", F.col("large"))))
    wanted = listed.select("row", "id", "digest").join(some.select("row", "prefix").join(groups, "prefix").groupBy("row").agg(*lists), "row")
    wanted = materialize(wanted, "wanted")

    def bodies(kind: str) -> DataFrame:
        asked = wanted.where(F.size(kind) > 0).select("id", "digest", "row", kind)
        texts = rows.where(_may_be(_map_of(asked), _bit())).join(asked.hint("merge"), ["id", "digest"])
        return texts.select("text", "id", "row", kind).mapInArrow(_bodies, "prefix long, id long, row long, first long, body binary")

    runs = bodies("small").repartition("prefix").sortWithinPartitions("prefix").mapInArrow(_repeats, "row long, a long, z long")
    if not groups.where("large").isEmpty():
        windows = materialize(bodies("large").mapInArrow(_prolonged, "h long, g long, id long, row long, a long"), "windows")
        least = materialize(windows.groupBy("h", "g").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").drop("most"), "nodes")
        runs = runs.unionByName(windows.join(least, ["h", "g"]).where("id > least").select("row", "a", (F.col("a") + WINDOW).alias("z")))
    found = wanted.select("row", "id", "digest").join(runs, "row").select("id", "digest", "a", "z")
    found = found.unionByName(others.where("loses").select("id", "digest", F.lit(0).cast("long").alias("a"), F.col("n_words").alias("z")).distinct())
    return materialize(found.groupBy("id", "digest").agg(F.collect_list(F.struct("a", "z")).alias("runs")), "runs")


def remove_repeated_words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with n_words, n_removed (long), kept (string) and kept_sha256.

    Of the words of each text, those in WINDOW consecutive words that also stand in a document with a
    lesser key are removed; windows are judged on the input and never cross documents. kept: the other
    words, joined by one space; the digest is of its UTF-8 bytes.

    Null texts have no words, and texts under WINDOW words lose none. Keys are whole numbers; a null
    one counts as 2**63 - 1. Rows with one key don't remove from each other, and repeated rows get
    equal results. An empty table stays empty; columns with these names are replaced, others pass.
    """
    names = [f.name for f in _RESULT]
    runs = repeated_words(docs, key, text)
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.drop(*names, "__id", "__digest").withColumns({"__id": F.coalesce(F.col(key).cast("long"), F.lit(_LAST)), "__digest": F.unhex(F.md5(whole))})
    sent, bit = _map_of(runs), _bit("__id", "__digest")
    listed = runs.select(F.col("id").alias("__id"), F.col("digest").alias("__digest"), F.col("runs").alias("__runs"))
    cut = rows.where(_may_be(sent, bit)).join(listed.hint("merge"), ["__id", "__digest"], "left").withColumn("__cut", _cut_all(F.col(text), F.col("__runs")))
    rest = rows.withColumn("__cut", _cut_rest(sent, F.col(text), bit)).where("__cut is not null")
    return cut.drop("__runs").unionByName(rest).select(*docs.drop(*names).columns, *(F.col(f"__cut.{n}").alias(n) for n in names))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return remove_repeated_words(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
