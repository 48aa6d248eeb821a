"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio of trusted target to raw corpus.

DataFrame and SQL functions only.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.shared import documents, labels

#: Buckets that word unigrams and bigrams are hashed to, and the least length-normalised ratio that is kept
#: where none is derived.
BUCKETS, THRESHOLD = 8192, -0.1
#: A derived threshold: of the trusted documents, one in CALIBRATION is kept out of the counts, and the
#: threshold is the greatest multiple of 1/STEPS below which at most FALSE_REJECTS of them are.
CALIBRATION, STEPS, FALSE_REJECTS = 5, 1000, 0.01
#: Added to every bucket's count in both multinomials.
SMOOTHING = 1.0

_SEP = r"[\\x20\\x09-\\x0D]+"
_WORDS = f"array_remove(split(coalesce({{text}}, ''), '{_SEP}'), '')"

#: {{h}}: name of the hashes of the words. Word counts covered by 5-word windows that are found twice or more: 0 unless some are.
_REPEATS = """element_at(transform(array(
    if(size({h}) < 5, cast(array() as array<bigint>),
       transform(sequence(0, size({h}) - 5), i -> xxhash64(get({h}, i), get({h}, i + 1), get({h}, i + 2), get({h}, i + 3), get({h}, i + 4))))),
    w -> if(size(array_distinct(w)) = size(w), 0L,
        element_at(transform(array(array_sort(transform(w, (x, i) -> struct(x as k, i as i)))),
            s -> element_at(transform(array(array_sort(filter(
                transform(s, (x, j) -> if(x.k <=> get(s, j - 1).k or x.k <=> get(s, j + 1).k, x.i, cast(null as int))), x -> x is not null))),
                p -> aggregate(transform(p, (x, j) -> least(5, coalesce(get(p, j + 1) - x, 5))), 0L, (a, x) -> a + x)), 1)), 1))), 1)"""

_GRAMS = """concat(
    transform({h}, x -> cast(pmod(x, {buckets}) as int)),
    if(size({h}) < 2, cast(array() as array<int>),
       transform(sequence(0, size({h}) - 2), i -> cast(pmod(xxhash64(get({h}, i), get({h}, i + 1)), {buckets}) as int))))"""

#: {{g}}: name of the buckets of a text, {{table}}: a bucket's ratio.
_MEAN = "if(size({g}) = 0, 0D, aggregate({g}, 0D, (a, b) -> a + get({table}, b)) / size({g}))"


def _bind(value: str, name: str, body: str) -> str:
    """SQL of body, in which name is value, computed once a row."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _with_hashes(text: str, body: str) -> str:
    """SQL of body, in which `words` are the words of a text column and `hashes` their hashes."""
    return _bind(_WORDS.format(text=text), "words", _bind("transform(words, x -> xxhash64(x))", "hashes", body))


def grams(text: str, buckets: int = BUCKETS) -> str:
    """SQL of the bucket of every word and word pair of a text column, in order."""
    return _with_hashes(text, _GRAMS.format(h="hashes", buckets=buckets))


def _mean_ratio(table: list[float], buckets: int) -> str:
    """SQL of the mean ratio of `hashes`."""
    constant = f"from_json('{json.dumps([round(x, 9) for x in table])}', 'array<double>')"
    return _bind(_GRAMS.format(h="hashes", buckets=buckets), "g", _MEAN.format(g="g", table=constant))


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed.

    Words are [^\\x20\\x09-\\x0D]+ of the whole text; null has none, so null and empty texts
    fail with n_words 0. Repeated windows are found by 64-bit hashes of their words.
    """
    return _measured(docs, text, {})


def _measured(docs: DataFrame, text: str, more: dict[str, str]) -> DataFrame:
    """docs with base_counts' columns and more: SQL over `hashes` by name. A text is split and hashed once."""
    t = f"coalesce({text}, '')"
    of_words = {
        "n_words": "cast(size(words) as bigint)",
        "word_chars": "cast(length(array_join(words, '')) as bigint)",
        "n_repeat_words": _REPEATS.format(h="hashes"),
        **more,
    }
    out = docs.withColumns(
        {
            "__measures": F.expr(_with_hashes(text, "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in of_words.items()) + ")")),
            "n_symbols": F.expr(f"cast(length({t}) - length(regexp_replace({t}, '[#*$%&|<>]', '')) as bigint)"),
            "n_dup_lines": F.expr(
                rf"element_at(transform(array(filter(split({t}, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')), x -> cast(size(x) - size(array_distinct(x)) as bigint)), 1)"
            ),
        }
    ).withColumns({k: F.col(f"__measures.{k}") for k in of_words})
    return out.drop("__measures").withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def _held(key: str) -> Column:
    return F.crc32(F.col(key).cast("string")) % CALIBRATION == 0


def bucket_counts(docs: DataFrame, trusted: DataFrame, text: str = "text", key: str = "doc_id", buckets: int = BUCKETS) -> list[tuple[int, int, int]]:
    """(all, trusted, trusted and counted in calibration) of each bucket, from all documents.

    trusted: keys of the trusted documents (any number of rows a key). The result has `buckets`
    entries, whatever the corpus; counts are pre-aggregated before they are shuffled.
    """
    own = trusted.select(F.col(key).alias("__t")).where("__t is not null").distinct().withColumn("__in", F.lit(1))
    counted = (
        docs.select(F.col(key).alias("__k"), F.col(text).alias("__text"))
        .join(own.hint("merge"), F.col("__k") == F.col("__t"), "left")  # the same plan at every size
        .select(F.col("__in"), F.when(~_held("__t"), 1).alias("__fit"), F.explode(F.expr(grams("__text", buckets))).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count("*").alias("raw"), F.count("__in").alias("target"), F.count("__fit").alias("fit"))
        .collect()
    )
    out = [(0, 0, 0)] * buckets
    for r in counted:
        out[r["bucket"]] = r["raw"], r["target"], r["fit"]
    return out


def _log_ratios(raw: list[int], target: list[int]) -> list[float] | None:
    if not sum(target):
        return None
    scale = math.log((sum(raw) + SMOOTHING * len(raw)) / (sum(target) + SMOOTHING * len(raw)))
    return [math.log((t + SMOOTHING) / (r + SMOOTHING)) + scale for t, r in zip(target, raw, strict=True)]


def ratios(docs: DataFrame, trusted: DataFrame, text: str = "text", key: str = "doc_id", buckets: int = BUCKETS) -> list[float] | None:
    """log(target / raw) of each bucket, from all documents; None if no text is trusted."""
    raw, target, _ = zip(*bucket_counts(docs, trusted, text, key, buckets), strict=True)
    return _log_ratios(raw, target)


def derived_threshold(docs: DataFrame, trusted: DataFrame, table: list[float] | None, text: str = "text", key: str = "doc_id", buckets: int = BUCKETS) -> float:
    """The threshold that all but FALSE_REJECTS of the trusted documents that table wasn't learnt from reach.

    Every document that is kept out counts, by a histogram in steps of 1/STEPS. THRESHOLD if there is none.
    """
    if table is None:
        return THRESHOLD
    out = trusted.select(F.col(key).alias("__t")).where("__t is not null").where(_held("__t")).distinct()
    own = docs.select(F.col(key).alias("__k"), F.col(text).alias("__text")).join(out.hint("merge"), F.col("__k") == F.col("__t"), "left_semi")
    found = own.select(F.floor(F.expr(_with_hashes("__text", _mean_ratio(table, buckets))) * STEPS).alias("step")).groupBy("step").count().collect()
    total, below = sum(r["count"] for r in found), 0
    for r in sorted(found, key=lambda r: r["step"]):
        below += r["count"]
        if below > FALSE_REJECTS * total:
            return r["step"] / STEPS
    return THRESHOLD


def quality_rules(
    docs: DataFrame, trusted: DataFrame, text: str = "text", key: str = "doc_id", buckets: int = BUCKETS, threshold: float | None = THRESHOLD
) -> DataFrame:
    """docs with the columns of base_counts, llr (double) and kept.

    llr: the mean over a document's hashed words and word pairs of log(target / raw), the two
    multinomials being those of the trusted and of all documents; 0 for a text without words,
    and for all if nothing is trusted. kept: not base_failed and llr >= threshold, for every
    document, by the same numbers; threshold None: derived_threshold. Null keys are never
    trusted; repeated rows count each; an empty table stays empty; columns with these names are
    replaced, others pass through.
    """
    raw, target, fit = zip(*bucket_counts(docs, trusted, text, key, buckets), strict=True)
    table = _log_ratios(raw, target)
    if threshold is None:
        threshold = derived_threshold(docs, trusted, _log_ratios(raw, fit), text, key, buckets)
    out = _measured(docs, text, {"llr": "0D" if table is None else _mean_ratio(table, buckets)})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = labels(spark, sf_dir).where("quality = 1").select("doc_id")
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return quality_rules(docs, trusted, threshold=None).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr"
    )
