"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets decide."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.graph import by_group, components
from sluice.llm.shared import chunks, documents, materialize, mix, small_batches, word_hashes

WORDS, SIMILARITY = 5, 0.8
#: Chance at most that a pair of exactly the least similarity shares no band, and the rows of a band.
MISS, ROWS = 1e-5, 6
#: Chance at most that a pair of exactly the least similarity has too few equal signature bytes.
MISS_SIGNATURE = 1e-7
#: Documents of a bucket or of a candidate component that are compared with each other or with as many others at once.
BLOCK = 192
#: Rows of buckets whose signatures are compared at once, if buckets allow.
_ROWS_AT_ONCE = 1 << 13
_COLUMNS_AT_ONCE = 4096


def bands_for(similarity: float = SIMILARITY, rows: int = ROWS, miss: float = MISS) -> int:
    """The least number of bands of `rows` rows that a pair of that similarity misses with chance `miss` at most."""
    return max(1, math.ceil(math.log(miss) / math.log1p(-(similarity**rows)))) if similarity < 1 else 1


def least_equal(similarity: float, n: int, miss: float = MISS_SIGNATURE) -> int:
    """The greatest number of n independent MinHashes that fewer of agree, at that similarity, with chance `miss` at most."""
    total, k = 0.0, 0
    while k <= n:
        total += math.comb(n, k) * similarity**k * (1 - similarity) ** (n - k)
        if total > miss:
            break
        k += 1
    return min(k, n)


def shingles(texts: pa.Array, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every n-gram of words in order, their number per text).

    A text of 1 to n-1 words has one n-gram of all its words; one without words has none.
    """
    words, counts = word_hashes(texts)
    grams = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    first = np.cumsum(counts) - counts
    at = np.repeat(first - (np.cumsum(grams) - grams), grams) + np.arange(grams.sum())
    size = np.repeat(np.minimum(counts, n), grams)
    padded = np.concatenate((words, np.zeros(n, np.uint64)))
    h = size.astype(np.uint64)
    for k in range(n):
        h = h * np.uint64(0xD6E8FEB86659FD93) + np.where(size > k, padded[at + k], np.uint64(0))
    return mix(h), grams


def _segments(values: np.ndarray, counts: np.ndarray, reduce: np.ufunc, empty) -> np.ndarray:
    out = np.full(len(counts), empty, values.dtype)
    some = counts > 0
    if some.any():
        out[some] = reduce.reduceat(values, (np.cumsum(counts) - counts)[some])
    return out


def _sketch(batches: Iterator[pa.RecordBatch], n: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    rng = np.random.RandomState(20240229)
    odd = rng.randint(0, 2**32, bands * rows, dtype=np.uint32) | np.uint32(1)
    flip = rng.randint(0, 2**32, bands * rows, dtype=np.uint32)
    for whole in batches:
        for batch in chunks(whole):
            h, counts = shingles(batch.column(1), n)
            short = (h >> np.uint64(32)).astype(np.uint32)
            some = counts > 0
            at = (np.cumsum(counts) - counts)[some]
            found = np.zeros((bands, len(counts)), np.uint64)
            signature = np.zeros((len(counts), (bands * rows + 1) // 2), np.uint8)
            for b in range(bands):
                key = np.full(at.shape, b, np.uint64)
                for k in range(b * rows, (b + 1) * rows):
                    least = np.minimum.reduceat((short ^ flip[k]) * odd[k], at).astype(np.uint64) if len(at) else key
                    key = mix(key ^ least)
                    if k % 2 == 0:
                        signature[some, k // 2] = mix(least) & np.uint64(255)
                found[b, some] = key
            values = pa.array(np.ascontiguousarray(found.T[some]).view(np.int64).ravel())
            ends = np.concatenate(([0], np.cumsum(np.where(some, bands, 0)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(_segments(h, counts, np.add, 0).view(np.int64)),
                    pa.array(_segments(mix(h ^ np.uint64(0x5851F42D4C957F2D)), counts, np.add, 0).view(np.int64)),
                    pa.array(counts.astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(ends), values),
                    pa.array([x.tobytes() for x in signature], pa.binary()),
                ],
                ["key", "f1", "f2", "grams", "bands", "signature"],
            )


def _least_linked(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least place that links (a, b) lead to from each of n places."""
    top = np.arange(n)
    while len(a):
        low = top.copy()
        np.minimum.at(low, a, top[b])
        np.minimum.at(low, b, top[a])
        low = low[low]
        if (low == top).all():
            break
        top = low
    return top


def _alike(group: np.ndarray, own: np.ndarray, apart: np.ndarray, signatures: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places of one group with `need` equal signature bytes or more; where apart, only of different own blocks."""
    found = [np.zeros((2, 0), np.int64)]
    for d in range(1, len(group)):
        i = np.flatnonzero(group[d:] == group[:-d])
        if not len(i):
            break
        i = i[~apart[i] | (own[i] != own[i + d])]
        for k in range(0, len(i), 1 << 13):
            part = i[k : k + (1 << 13)]
            part = part[(signatures[part] == signatures[part + d]).sum(axis=1) >= need]
            found.append(np.stack((part, part + d)))
    return tuple(np.concatenate(found, axis=1))


def _propose(batches: Iterator[pa.RecordBatch], need: int) -> Iterator[pa.RecordBatch]:
    """Of the buckets' pairs with alike signatures, stars: each node with the least that such pairs lead to in its bucket."""
    held: list[pa.Table] = []
    size = 0

    def out(table: pa.Table) -> pa.RecordBatch:
        band, lo, hi, own, node = (table.column(c).to_numpy() for c in ("band", "lo", "hi", "own", "node"))
        signatures = np.stack([np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("signature")])
        order = np.lexsort((node, hi, lo, band))
        band, lo, hi, own, node, signatures = (x[order] for x in (band, lo, hi, own, node, signatures))
        group = np.cumsum(np.concatenate(([True], (band[1:] != band[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))))
        top = _least_linked(*_alike(group, own, lo != hi, signatures, need), len(node))
        some = node[top] != node
        return pa.RecordBatch.from_arrays([pa.array(node[top][some]), pa.array(node[some])], ["a", "b"])

    last = None
    for whole in batches:
        for k in range(0, whole.num_rows, _ROWS_AT_ONCE):
            part = pa.Table.from_batches([whole.slice(k, _ROWS_AT_ONCE)])
            group = np.stack([part.column(c).to_numpy() for c in ("band", "lo", "hi")])
            if size >= _ROWS_AT_ONCE:
                ends = np.flatnonzero((group != last).any(axis=0))
                if len(ends):  # the group that was held ends in this part
                    yield out(pa.concat_tables([*held, part.slice(0, int(ends[0]))]))
                    held, size, part = [], 0, part.slice(int(ends[0]))
            held.append(part)
            size, last = size + part.num_rows, group[:, -1:]
    if size:
        yield out(pa.concat_tables(held))


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in chunks(whole):
            h, counts = shingles(batch.column(batch.schema.get_field_index("text")), n)
            at = np.concatenate(([0], np.cumsum(counts)))
            sets = [np.unique(h[a:b]).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            i = batch.schema.get_field_index("text")
            yield pa.RecordBatch.from_arrays(
                [pa.array(sets, pa.binary()) if k == i else batch.column(k) for k in range(batch.num_columns)],
                ["grams" if k == i else name for k, name in enumerate(batch.schema.names)],
            )


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted distinct values, by products of incidence blocks."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    every = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    _, column, seen = np.unique(every, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), sizes)
    common = seen[column] > 1
    column, row = column[common], row[common]
    renamed = np.cumsum(seen > 1) - 1
    column = renamed[column]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    out = np.zeros((n, n), np.float64)
    total = int(renamed[-1]) + 1 if len(renamed) else 0
    for first in range(0, total, _COLUMNS_AT_ONCE):
        a, b = np.searchsorted(column, (first, first + _COLUMNS_AT_ONCE))
        block = np.zeros((n, min(_COLUMNS_AT_ONCE, total - first)), np.float32)
        block[row[a:b], column[a:b] - first] = 1
        out += block @ block.T
    out[np.diag_indices(n)] = sizes
    return out


def _verify(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Of each group: every node's links to others there, and the least node that links lead to."""
    for group in by_group(batches, ["root", "lo", "hi"]):
        node, own, copies = (group.column(c).to_numpy() for c in ("node", "own", "copies"))
        order = np.argsort(node, kind="stable")
        node, own, copies = node[order], own[order], copies[order]
        grams = group.column("grams").combine_chunks()
        sets = [np.frombuffer(grams[int(i)].as_buffer(), np.uint64) for i in order]
        shared = overlaps(sets)
        sizes = np.diag(shared)
        linked = shared >= similarity * (sizes[:, None] + sizes[None, :] - shared) - 1e-9
        np.fill_diagonal(linked, False)
        if group.column("lo")[0].as_py() != group.column("hi")[0].as_py():
            linked &= own[:, None] != own[None, :]  # pairs inside a block are another group's
        top = np.arange(len(node))
        while True:  # least index that links lead to
            low = np.minimum(top, np.where(linked, top[None, :], len(node)).min(axis=1, initial=len(node)))
            low = low[low]
            if (low == top).all():
                break
            top = low
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array((linked @ copies).astype(np.int64)), pa.array(node[top])], ["node", "links", "root"])


def _in_blocks(rows: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Rows with a group and its number of blocks, dealt by pairs of blocks and sorted: (group, lo, hi, own, columns).

    A row goes to the pairs that its own block is in, so a task has two blocks of a group at once,
    whatever the group's size.
    """
    own = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(group, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", *columns)
    return dealt.repartition(group, "lo", "hi").sortWithinPartitions(group, "lo", "hi")


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = WORDS, similarity: float = SIMILARITY, rows: int = ROWS, miss: float = MISS) -> DataFrame:
    """(key, class_id, n_links, copy_of), a row per document.

    Two documents are linked if the Jaccard similarity of their sets of n-word shingles is
    `similarity` or more. n_links: how many others a document is linked to. copy_of: the least key
    with the same bag of shingles. class_id: the least key that links lead to.

    Copies are one node with a count. MinHash bands (bands_for) put nodes into buckets; in a bucket
    all pairs are compared by signatures of a byte for every other MinHash, in blocks dealt over
    tasks, and those with too few equal bytes (least_equal) go no further. The documents that the
    others connect are compared all with all on their full sets, in blocks again, and only sums
    and stars leave a task. So a pair below the least similarity is never linked, and one at it is
    missed with chance `miss` + MISS_SIGNATURE at most.

    Null and empty texts, and those without words, link to nothing: class_id and copy_of are the
    key itself. A text of fewer than n words has one shingle of all its words. Rows with a null key
    have a null class and no links. Rows that repeat a key are repeated; with different texts they
    share one node. An empty table gives an empty result; other columns are not read.
    """
    small_batches(docs.sparkSession)
    bands = bands_for(similarity, rows, miss)
    plain = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    sketched = materialize(plain.mapInArrow(lambda it: _sketch(it, n, bands, rows), "key long, f1 long, f2 long, grams long, bands array<long>, signature binary"), "sketch")
    some = sketched.where("grams > 0 and key is not null")
    copies = some.groupBy("f1", "f2").agg(F.min("key").alias("node"), F.count("*").alias("copies"))
    copies = materialize(copies, "copies")
    nodes = some.join(copies.select(F.col("node").alias("key")), "key", "left_semi").select(F.col("key").alias("node"), "bands", "signature")
    band = nodes.select("node", F.explode("bands").alias("band"))
    shared = band.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    near = _in_blocks(band.join(shared, "band").join(nodes.select("node", "signature"), "node"), "band", ["node", "signature"])
    need = least_equal(similarity, (bands * rows + 1) // 2)
    proposed = components(near.mapInArrow(lambda it: _propose(it, need), "a long, b long"))
    proposed = materialize(proposed, "proposed")

    counted = proposed.groupBy("root").agg(F.count("*").alias("n")).select("root", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    member = (
        proposed.join(counted, "root")
        .join(copies.groupBy("node").agg(F.sum("copies").alias("copies")), "node")
    )
    chosen = plain.where("key is not null").join(member, plain["key"] == member["node"]).select("root", "node", "copies", "blocks", "text")
    sets = chosen.mapInArrow(lambda it: _sets(it, n), "root long, node long, copies long, blocks int, grams binary")
    dealt = _in_blocks(sets, "root", ["node", "copies", "grams"])
    found = materialize(dealt.mapInArrow(lambda it: _verify(it, similarity), "node long, links long, root long"), "links")

    linked = components(found.where("root < node").select(F.col("root").alias("a"), F.col("node").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    nodes = copies.join(links, "node", "left").join(linked, "node", "left")
    nodes = nodes.select("f1", "f2", F.col("node").alias("copy_of"), F.coalesce("root", "node").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    classed = some.select("key", "f1", "f2").join(nodes, ["f1", "f2"]).select(F.col("key").alias(key), "class_id", "n_links", "copy_of")
    alone = sketched.where("not (grams > 0 and key is not null)").select(F.col("key").alias(key), F.col("key").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("key").alias("copy_of"))
    return classed.unionByName(alone)


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs without those whose class has a smaller key: of each class of jaccard_join the least key stays.

    Rows with a null key stay; rows that repeat a key are one document and stay or go together.
    """
    joined = jaccard_join(docs, key, text, **how)
    return docs.join(materialize(joined.where(F.col(key) > F.col("class_id")).select(key).distinct(), "dropped"), key, "left_anti")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(documents(spark, sf_dir))
