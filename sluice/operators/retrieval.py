"""Cosine retrieval, grounding scores and a token-coverage stand-in for entailment."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Queries and passages of a block; a task holds one block of each.
QUERY_BLOCK, PASSAGE_BLOCK = 4096, 16384
#: Queries whose products with a block of passages are held at once: 8 MB of them, and some copies.
STRIP = 64
_FOUND = "q long, pos long, sim double"


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _codes(a: pa.ChunkedArray, b: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Equal numbers for equal values of two columns; nulls are equal to each other."""
    both = pa.chunked_array([*a.chunks, *b.chunks]).combine_chunks().dictionary_encode("encode").indices.to_numpy()
    return both[: len(a)], both[len(a) :]


def _best(queries: pa.Table, passages: pa.Table, k: int, leave_out: bool) -> pa.Table:
    """The k most similar passages of one block of each query of another: dot products to 6 places, ties by pos."""
    order = np.argsort(passages.column("pos").to_numpy(), kind="stable")
    passages = passages.take(pa.array(order))
    q, pos = queries.column("q").to_numpy(), passages.column("pos").to_numpy()
    theirs, ours = _codes(queries.column("q_source"), passages.column("source")) if leave_out else (q, pos)
    v, w = _vectors(queries.column("vector")), _vectors(passages.column("vector"))
    rows, places, sims = [], [], []
    for a in range(0, len(q), STRIP):
        sim = np.round(v[a : a + STRIP] @ w.T, 6)
        sim[theirs[a : a + STRIP, None] == ours[None, :]] = -np.inf
        if k < sim.shape[1]:  # all that reach the k-th best, so ties are settled by pos
            floor = -np.partition(-sim, k - 1, axis=1)[:, k - 1 : k]
        else:
            floor = np.full((len(sim), 1), -np.inf)
        r, c = np.nonzero((sim >= floor) & np.isfinite(sim))
        best = np.lexsort((c, -sim[r, c], r))
        r, c = r[best], c[best]
        keep = np.arange(len(r)) - np.searchsorted(r, r) < k
        rows.append(q[a : a + STRIP][r[keep]])
        places.append(pos[c[keep]])
        sims.append(sim[r[keep], c[keep]])
    return pa.table({"q": np.concatenate(rows), "pos": np.concatenate(places), "sim": np.concatenate(sims)})


def top_k(queries: DataFrame, corpus: DataFrame, k: int, leave_out: bool = False) -> DataFrame:
    """(q, pos, sim, rank): the k passages most similar to each query by dot product, to 6 places; ties by pos.

    queries: q, vector, q_source; corpus: pos, vector, source. A query's own row (pos = q) isn't a
    passage; with leave_out, none of its source is. A stated query set against all rows: both sides
    are dealt into blocks by hash, each pair of blocks is one matrix product in one task, and only a
    block's k best go on. Rows without a vector are left out.
    """
    queries, corpus = queries.where("vector is not null"), corpus.where("vector is not null")
    q_blocks, p_blocks = (max(1, -(-df.count() // size)) for df, size in ((queries, QUERY_BLOCK), (corpus, PASSAGE_BLOCK)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select("q", "vector", "q_source", F.pmod(F.xxhash64("q"), F.lit(q_blocks)).cast("int").alias("qb"), every(p_blocks).alias("pb"))
    held = corpus.select("pos", "vector", "source", F.pmod(F.xxhash64("pos"), F.lit(p_blocks)).cast("int").alias("pb"), every(q_blocks).alias("qb"))
    found = asked.groupBy("qb", "pb").cogroup(held.groupBy("qb", "pb")).applyInArrow(lambda a, b: _best(a, b, k, leave_out) if a.num_rows and b.num_rows else _NONE, _FOUND)
    w = Window.partitionBy("q").orderBy(F.desc("sim"), "pos")  # k rows a block of passages
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


_NONE = pa.table({"q": pa.array([], pa.int64()), "pos": pa.array([], pa.int64()), "sim": pa.array([], pa.float64())})


def grounding(best: DataFrame) -> DataFrame:
    """q, max, mean_top5 of the five best: their sum over 5, whatever their number."""
    return best.where("rank <= 5").groupBy("q").agg(F.round(F.max("sim"), 4).alias("max"), F.round(F.sum("sim") / 5, 4).alias("mean_top5"))


def context(top: DataFrame, excerpts: DataFrame, length: int) -> DataFrame:
    """q, context: excerpts of a query's passages as `[i] text`, by rank, between rules; a missing text is empty."""
    joined = top.join(excerpts, "pos", "left").select("q", "rank", F.substring(F.coalesce("text", F.lit("")), 1, length).alias("text"))
    ranked = F.array_sort(F.collect_list(F.struct("rank", "text")))
    return joined.groupBy("q").agg(F.array_join(F.transform(ranked, lambda x: F.concat(F.lit("["), x["rank"].cast("string"), F.lit("] "), x["text"])), "\n---\n").alias("context"))


def coverage(claim: Column, context: Column) -> Column:
    """Share of a claim's distinct tokens that its context has too; 0 for no tokens."""
    of = lambda x: F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), 0))
    return F.transform(F.array(F.struct(of(claim).alias("a"), of(context).alias("b"))), lambda s: F.when(F.size(s["a"]) == 0, 0.0).otherwise(F.size(F.array_intersect(s["a"], s["b"])).cast("double") / F.size(s["a"])))[0]


#: Words of a passage that documents are looked up by, at most; passages without a whole inner word that are compared with all texts at once.
GRAM, SHORT = 4, 4096
_WORDS = r"array_remove(split(coalesce({}, ''), '[\\x20\\x09-\\x0D]+'), '')"


def contained(docs: DataFrame, passages: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """(item, key) of the passages (item, text) that stand in documents, character by character.

    All words of a passage but the first and the last stand whole in a text that has it, so texts and
    passages meet on the hash of the first of these, GRAM of them at most, and what meets is compared.
    Passages of one or two words have none: they are compared with all texts, SHORT of them at a time,
    which is the only size that is broadcast. Null texts have no passages, and an empty passage stands
    in every text.
    """
    listed = passages.select(item, F.col(text).alias("passage"), F.expr(_WORDS.format(text)).alias("w")).where("passage is not null")
    listed = listed.withColumn("k", F.least(F.lit(GRAM), F.size("w") - 2))
    texts = docs.select(key, F.col(text).alias("__text"))
    rows = docs.select(key, F.expr(_WORDS.format(text)).alias("w"))
    hashed = lambda at, k: "xxhash64({})".format(", ".join(f"get(w, {at} + {j})" for j in range(k)))
    out = None
    for k in sorted(r["k"] for r in listed.where("k > 0").select("k").distinct().collect()):  # GRAM numbers at most
        grams = rows.where(F.size("w") >= k).select(key, F.explode(F.array_distinct(F.expr(f"transform(sequence(0, size(w) - {k}), i -> {hashed('i', k)})"))).alias("h"))
        met = grams.join(listed.where(F.col("k") == k).select(item, F.expr(hashed("1", k)).alias("h")), "h").select(key, item).distinct()
        out = met if out is None else out.unionByName(met)
    found = None
    if out is not None:
        found = out.join(texts, key).join(passages.select(item, F.col(text).alias("passage")), item).where(F.contains("__text", "passage")).select(item, key)
    short = listed.where("k <= 0").select(item, "passage")
    blocks = -(-short.count() // SHORT)
    numbered = short.withColumn("b", F.pmod(F.xxhash64("passage"), F.lit(max(1, blocks))))
    for b in range(blocks):
        near = texts.join(F.broadcast(numbered.where(F.col("b") == b)), F.contains("__text", "passage")).select(item, key)  # about SHORT rows
        found = near if found is None else found.unionByName(near)
    return texts.join(listed.limit(0), F.lit(True)).select(item, key) if found is None else found.distinct()
