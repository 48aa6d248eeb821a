"""Ranked lexical search over a tiered index.

Every document's postings of the asked terms are kept in tiers: of each term the postings of highest
impact first, and for each tier the greatest impact that the term has below it. Items are scored on
the first tier alone. A document's unseen terms can add no more than their residual bounds, so an item
is proven once the bounds of all documents but a few stay below its k-th score; those few are scored
in full. Items without that proof fall through to the next tier; the last one has all postings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.llm.grid import in_blocks
from sluice.llm.shared import chunks, documents, lowered, materialize, new_path, prefix_hash, small_batches, span_hash, utf8, word_spans

#: Fixed value: the characters that terms are made of, as a pattern.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_INSIDE = np.ones(256, bool)
_INSIDE[:128] = [chr(c).isalnum() for c in range(128)]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bits of the map that tells most terms that no item asks for; a fixed size.
BITS = 23
#: Impacts of a level; a term's postings are dealt to tiers by whole levels.
LEVEL = 1 << 14
#: Tiers before the last hold this share of a term's postings, and so many of a rare term.
SHARES, RARE = (1 / 16, 1 / 4), 256
#: Rows of asked terms and postings in a block; documents of a block that may be scored in full for an item.
ASKED_BLOCK, POSTING_BLOCK, IN_FULL = 8192, 1 << 18, 1024
#: A table of terms of so many rows at most is broadcast; a larger one is joined over so many parts of each term.
LEXICON, PARTS = 100_000, 64


def _bits(texts: pa.Array) -> np.ndarray:
    """The places of whole strings in the map of asked terms."""
    raw, offsets = utf8(texts)
    return (span_hash(prefix_hash(raw), offsets[:-1], offsets[1:]) >> np.uint64(64 - BITS)).astype(np.int64)


def _asked_map(asked: DataFrame) -> np.ndarray:
    """A map of 2**BITS bits with those of the asked terms set."""

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_bits(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.int64(1) << (at & 63))], ["w", "v"])

    words = asked.select("term").mapInArrow(marks, "w long, v long").groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
    out = np.zeros((1 << BITS) // 64, np.int64)
    out[words.column("w").to_numpy()] = words.column("v").to_numpy()
    return out


def _postings(batches: Iterator[pa.RecordBatch], asked: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(id, n, terms, tfs) of each document: its number of terms, and its distinct terms that may be asked for."""
    for whole in batches:
        for batch in chunks(whole):
            raw, offsets = utf8(batch.column(1))
            raw = lowered(raw)
            starts, ends, n = word_spans(raw, offsets, _INSIDE[raw])
            at = (span_hash(prefix_hash(raw), starts, ends) >> np.uint64(64 - BITS)).astype(np.int64)
            some = (asked[at >> 6] >> (at & 63)) & 1 == 1
            doc = np.repeat(np.arange(len(n)), n)[some]
            starts, sizes = starts[some], (ends - starts)[some]
            upto = np.concatenate(([0], np.cumsum(sizes)))
            flat = raw[np.repeat(starts - upto[:-1], sizes) + np.arange(upto[-1])]
            terms = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(upto), pa.py_buffer(flat)).dictionary_encode()
            width = max(1, len(terms.dictionary))
            pairs, tfs = np.unique(doc * width + terms.indices.to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
            cuts = pa.array(np.searchsorted(pairs // width, np.arange(len(n) + 1)).astype(np.int32))
            listed = pa.ListArray.from_arrays(cuts, terms.dictionary.take(pa.array(pairs % width)).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), listed, pa.ListArray.from_arrays(cuts, pa.array(tfs, pa.int64()))], ["id", "n", "terms", "tfs"])


def terms_of(text: Column) -> Column:
    """A text's distinct terms; none of a null."""
    return F.array_distinct(F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(TERM), F.lit(0)))


@dataclass
class Index:
    """documents: row, id, m, terms, tfs; lexicon: term, df, w, cut_K and rest_K of each tier K but the last; postings: row, id, term, impact, by tier."""

    documents: DataFrame
    lexicon: DataFrame
    postings: DataFrame
    rows: int


def _impact(tf: str = "tf") -> Column:
    return F.expr(f"(1000000000 * {tf}) div (1000 * {tf} + 20 * m)")


def build_index(docs: DataFrame, asked: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """The tiered index of all docs' postings of the terms in asked (term), written to the shared folder.

    A document's impact of a term is (1000000000 tf) div (1000 tf + 20 m), m = 50 + (50 n N) div L;
    a term's weight is floor(1000 ln((2 N + 2) / (2 df + 1))).
    """
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(_asked_map(asked))  # 2**BITS bits, whatever is asked
    found = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(lambda it: _postings(it, sent.value), "id long, n long, terms array<string>, tfs array<long>")
    found = materialize(found.where("n > 0").withColumn("row", F.monotonically_increasing_id()), "terms")
    total = found.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
    many, length = total["n"], total["l"] or 1
    m = F.expr(f"50 + cast(cast(n as decimal(18, 0)) * cast({50 * many} as decimal(20, 0)) div {length} as long)")
    held = found.withColumn("m", m).select("row", "id", "m", "terms", "tfs")
    each = held.select("row", "id", "m", F.inline(F.arrays_zip("terms", "tfs"))).select("row", "id", F.col("terms").alias("term"), _impact("tfs").alias("impact"))

    levels = each.groupBy("term", F.floor(F.col("impact") / LEVEL).cast("int").alias("level")).agg(F.count("*").alias("c"), F.max("impact").alias("most"))
    levels = levels.join(asked.select("term").distinct(), "term", "left_semi")
    down = Window.partitionBy("term").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, 0)  # some 60 levels
    levels = levels.withColumns({"upto": F.sum("c").over(down), "df": F.sum("c").over(Window.partitionBy("term"))})
    tiers = [F.col("upto") <= F.greatest(F.lit(RARE), F.floor(F.col("df") * share)) for share in SHARES]
    least = {f"cut_{k}": F.coalesce(F.min(F.when(inside, F.col("level"))), F.lit(1 << 20)) for k, inside in enumerate(tiers)}
    rest = {f"rest_{k}": F.coalesce(F.max(F.when(~inside, F.col("most"))), F.lit(0)) for k, inside in enumerate(tiers)}
    weight = F.floor(1000 * F.log((F.lit(2.0 * many + 2)) / (2 * F.col("df") + 1))).cast("long")
    lexicon = materialize(levels.groupBy("term", "df").agg(*(c.alias(n) for n, c in (least | rest).items())).withColumn("w", weight), "lexicon")

    cuts = lexicon.select("term", *least)
    if lexicon.count() <= LEXICON:
        placed = each.join(F.broadcast(cuts), "term")  # LEXICON rows at most
    else:  # a term that most documents have meets in PARTS places
        salted = cuts.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        placed = each.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(PARTS)).cast("int")).join(salted, ["term", "part"])
    level, tier = F.col("impact") / LEVEL, F.lit(len(SHARES))
    for k in reversed(range(len(SHARES))):
        tier = F.when(level >= F.col(f"cut_{k}"), k).otherwise(tier)
    placed = placed.select("row", "id", "term", "impact", tier.cast("int").alias("tier"))
    path = new_path(spark, "postings")
    placed.write.option("compression", "zstd").partitionBy("tier").parquet(path)
    return Index(held, lexicon, spark.read.schema(placed.schema).parquet(path), many)


def _by_term(postings: pa.Table) -> tuple[dict[str, slice], np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(term's slice, document and impact of each posting in it, documents' rows, their ids); documents are in the order of their ids."""
    rows, first, doc = np.unique(postings.column("row").to_numpy(), return_index=True, return_inverse=True)
    ids = postings.column("id").combine_chunks().take(pa.array(first))
    order = np.lexsort((rows, ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)))
    place = np.empty(len(rows), np.int64)
    place[order] = np.arange(len(rows))
    terms = postings.column("term").combine_chunks().dictionary_encode()
    codes = terms.indices.to_numpy(zero_copy_only=False)
    by = np.argsort(codes, kind="stable")
    cuts = np.searchsorted(codes[by], np.arange(len(terms.dictionary) + 1))
    slices = {t: slice(a, b) for t, a, b in zip(terms.dictionary.to_pylist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)}
    return slices, place[doc.ravel()][by], postings.column("impact").to_numpy()[by], rows[order], ids.take(pa.array(order))


def _scores(asked: pa.Table, postings: pa.Table):
    """(item's rows of asked, score of each document, what seen terms took off its bound), item by item."""
    slices, doc, impact, rows, ids = _by_term(postings)
    q = asked.column("q").to_numpy()
    order = np.argsort(q, kind="stable")
    asked = asked.take(pa.array(order))
    terms, w, rest = asked.column("term").to_pylist(), asked.column("w").to_numpy(), asked.column("rest").to_numpy()
    cuts = np.flatnonzero(np.concatenate(([True], q[order][1:] != q[order][:-1], [True])))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        score, seen = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for k in range(a, b):
            if own := slices.get(terms[k]):
                score[doc[own]] += w[k] * impact[own]
                if rest[k]:
                    seen[doc[own]] += w[k] * rest[k]
        yield asked.slice(a, 1), score, seen, rows, ids


def _rows(q: list, at: list, score: list, rows: np.ndarray, ids: pa.Array) -> pa.Table:
    found = np.concatenate(at)
    return pa.table({"q": np.repeat(np.array(q), [len(x) for x in at]), "row": rows[found], "id": ids.take(pa.array(found)), "score": np.concatenate(score)})


def _best(asked: pa.Table, postings: pa.Table, k: int) -> pa.Table:
    """A block's k best documents of each item by what is seen, ties by id; none below the item's floor."""
    q, at, scored = [], [], []
    for item, score, _, rows, ids in _scores(asked, postings):
        some = np.flatnonzero(score >= item.column("floor")[0].as_py())
        if len(some) > k:
            some = some[score[some] >= np.partition(score[some], len(some) - k)[len(some) - k]]
        some = some[np.lexsort((some, -score[some]))][:k]
        q.append(item.column("q")[0].as_py())
        at.append(some)
        scored.append(score[some])
    return _rows(q, at, scored, rows, ids)


def _candidates(asked: pa.Table, postings: pa.Table) -> pa.Table:
    """A block's documents whose bound reaches an item's k-th score; a null row where they are more than IN_FULL."""
    q, at, scored, over = [], [], [], []
    for item, score, seen, rows, ids in _scores(asked, postings):
        number, bound, reach = (item.column(c)[0].as_py() for c in ("q", "bound", "reach"))
        some = np.flatnonzero(score - seen + bound >= reach)
        if len(some) > IN_FULL:
            over.append(number)
            continue
        q.append(number)
        at.append(some)
        scored.append(score[some])
    some = _rows(q, at, scored, rows, ids).drop(["id", "score"]) if q else None
    none = pa.table({"q": pa.array(over, pa.int64()), "row": pa.nulls(len(over), pa.int64())})
    return none if some is None else pa.concat_tables([some, none])


def search(docs: DataFrame, items: DataFrame, k: int = 50, key: str = "doc_id", text: str = "text", item: str = "item_id", asked_text: str = "text") -> DataFrame:
    """item, rank (int, from 1), key, score (long): each item's k highest-scoring documents with a score above 0, ties by key.

    A score is the sum over an item's distinct terms of weight times impact (see build_index). Null
    texts have no terms; items without terms, or whose terms no document has, get no rows, as with an
    empty table. Keys are whole numbers, a null one after all others. Every row stands for itself:
    rows that repeat a key or an item are scored and asked each. Columns of other names are ignored.
    """
    spark = docs.sparkSession
    listed = materialize(items.select(F.col(item).alias("item"), F.col(asked_text).alias("text")).withColumn("q", F.monotonically_increasing_id()), "items")
    terms = materialize(listed.select("q", F.explode(terms_of(F.col("text"))).alias("term")), "asked")
    index = build_index(docs, terms, key, text)
    asked = materialize(terms.join(index.lexicon, "term").where("w > 0"), "asked")
    keys, sizes, top = ("q", "row"), (ASKED_BLOCK, POSTING_BLOCK), "q long, row long, id long, score long"
    best_first = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    # floor: a score that k documents are known to reach
    out, waiting = None, asked.withColumn("floor", F.lit(1).cast("long"))
    for tier in range(len(SHARES)):
        postings = index.postings.where(F.col("tier") <= tier)
        now = waiting.select("q", "term", "w", "floor", F.col(f"rest_{tier}").alias("rest"))
        seen = in_blocks(now, postings, lambda a, b: _best(a, b, k), top, keys, sizes)
        kth = seen.withColumn("r", F.row_number().over(best_first)).where(F.col("r") == k).select("q", F.col("score").alias("reach"))
        reached = now.groupBy("q", "floor").agg(F.sum(F.col("w") * F.col("rest")).alias("bound")).join(kth, "q", "left")
        reached = materialize(reached.select("q", "bound", F.coalesce("reach", "floor").alias("reach")), "bounds")
        bounds = reached.where("bound < reach")  # a document without any seen term can't be among the k
        few = materialize(in_blocks(now.join(bounds, "q"), postings, _candidates, "q long, row long", keys, sizes), "candidates")
        proven = materialize(bounds.select("q").join(few.where("row is null"), "q", "left_anti"), "proven")
        exact = few.where("row is not null").join(proven, "q", "left_semi")
        if exact.count() <= LEXICON:
            exact = F.broadcast(exact)  # LEXICON rows at most
        whole = index.documents.join(exact, "row").select("q", "row", "id", "m", F.inline(F.arrays_zip("terms", "tfs")))
        whole = whole.select("q", "row", "id", F.col("terms").alias("term"), _impact("tfs").alias("impact")).join(asked.select("q", "term", "w"), ["q", "term"])
        scored = whole.groupBy("q", "row", "id").agg(F.sum(F.col("w") * F.col("impact")).alias("score"))
        out = scored if out is None else out.unionByName(scored)
        waiting = waiting.drop("floor").join(proven, "q", "left_anti").join(reached.select("q", F.col("reach").alias("floor")), "q")
        waiting = materialize(waiting, "waiting")
        if waiting.isEmpty():
            break
    else:
        rest = in_blocks(waiting.select("q", "term", "w", "floor", F.lit(0).cast("long").alias("rest")), index.postings, lambda a, b: _best(a, b, k), top, keys, sizes)
        out = out.unionByName(rest.select(*out.columns))
    ranked = out.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
    return ranked.join(listed.select("q", "item"), "q").select(F.col("item").alias(item), "rank", F.col("id").alias(key), "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
