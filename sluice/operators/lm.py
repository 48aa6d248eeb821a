"""Word models: unigrams and interpolated bigrams with absolute discounting, and perplexities under them.

A frequent word or pair is in most documents. Tables of counts are therefore joined in two parts: the
FREQUENT most frequent rows by a broadcast, all others by a shuffle on what is then no hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.sources import stored

#: Rows of a count table that are broadcast.
FREQUENT = 1 << 16
#: Taken off each bigram's count and given to the unigrams, and what is added to a word's count.
DISCOUNT, ADDED = 0.75, 0.1
#: Fixed value: the greatest mean negative log likelihood that a perplexity is made of.
MOST = 20.0


def look_up(rows: DataFrame, table: DataFrame, keys: list[str], count: str) -> DataFrame:
    """rows with table's columns, joined on keys, by which it is unique; nulls where it has no such row."""
    marked = table.withColumn("__in", F.lit(True))
    top = marked.orderBy(F.desc(count), *keys).limit(FREQUENT)
    near = rows.join(F.broadcast(top), keys, "left")
    far = near.where("__in is null").select(*rows.columns).join(marked, keys, "left")
    return near.where("__in").unionByName(far).drop("__in")


def pairs(tokens: DataFrame) -> DataFrame:
    """(pos, train, u, v): a document's neighbouring words, a row each time. tokens: pos, train, t (array)."""
    size = F.size("t")
    both = F.transform(F.sequence(F.lit(2), size), lambda i: F.struct(F.get("t", i - 2).alias("u"), F.get("t", i - 1).alias("v")))
    return tokens.where(size >= 2).select("pos", "train", F.explode(both).alias("p")).select("pos", "train", "p.u", "p.v")


def bigram_costs(tokens: DataFrame, counted: DataFrame) -> DataFrame:
    """(u, v, n, uni, bi): the negative log likelihood of v alone and after u, for all pairs in counted (see pairs); n: their number.

    Learnt where train is true. P(v) = (c(v) + ADDED) / (N + ADDED (V + 1)); P(v | u) =
    (max(c(uv) - DISCOUNT, 0) + DISCOUNT kinds(u) P(v)) / c(u), kinds(u) being the different words
    seen after u, and P(v) where u was never followed by a word.
    """
    words = stored(tokens.where("train").select(F.explode("t").alias("v")).groupBy("v").agg(F.count("*").alias("c_v")), "words")
    whole = words.agg(F.coalesce(F.sum("c_v"), F.lit(0)).cast("double").alias("all"), F.count("*").cast("double").alias("kinds_v"))
    some = stored(counted.groupBy("u", "v").agg(F.count("*").alias("n"), F.count_if("train").alias("c_uv")), "bigrams")
    contexts = stored(some.where("c_uv > 0").groupBy("u").agg(F.sum("c_uv").alias("c_u"), F.count("*").alias("kinds_u")), "contexts")
    after = stored(look_up(some, contexts, ["u"], "c_u"), "after")
    both = look_up(after, words, ["v"], "c_v").join(F.broadcast(whole))  # one row
    alone = (F.coalesce("c_v", F.lit(0)) + ADDED) / (F.col("all") + ADDED * (F.col("kinds_v") + 1))
    kept = F.greatest(F.col("c_uv") - F.lit(DISCOUNT), F.lit(0.0))
    following = F.when(F.col("c_u") > 0, (kept + DISCOUNT * F.col("kinds_u") * alone) / F.col("c_u")).otherwise(alone)
    return stored(both.select("u", "v", "n", (-F.log(alone)).alias("uni"), (-F.log(following)).alias("bi")), "costs")


def perplexities(texts: DataFrame, words: Column, train: Column) -> DataFrame:
    """(pos, train, n, unigram, bigram): perplexities of each text's words after its first, n of them, to 4 places.

    Models are learnt from texts where train is true. Null where fewer than two words are.
    """
    tokens = stored(texts.select("pos", F.coalesce(train, F.lit(False)).alias("train"), words.alias("t")), "tokens")
    seen = pairs(tokens).drop("train")
    costs = bigram_costs(tokens, pairs(tokens))
    mean = lambda c: F.round(F.exp(F.least(F.avg(c), F.lit(MOST))), 4)
    scored = look_up(seen, costs, ["u", "v"], "n").groupBy("pos").agg(F.count("*").alias("n"), mean("uni").alias("unigram"), mean("bi").alias("bigram"))
    return tokens.select("pos", "train").join(scored, "pos", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
