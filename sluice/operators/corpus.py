"""The evaluation corpus on the driver's tables: items, ledger, rendered scopes, raters and arms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators.validator import ABLATIONS, accept, validate
from sluice.sources import spread, stored, table

LEDGER_ROWS, FAKE_SHA = 200, "0" * 40
#: Fixed value: the definition of a term that has none of its own.
DEFINED = "defined locally"
#: Proxies of the two model arms, set once on sf0.001: shares of symbols and of distinct tokens.
SYMBOL_SHARE, DISTINCT_SHARE = 0.06, 0.35
CORE = ("C1", "C2", "C3", "C4")
GATES = {"Introspection": "Gintro", "Evidence": "Gevid", "Scope": "Gscope"}
ARMS = ("B0", "B1b", "B2", *ABLATIONS)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, prose, topic, lang, quality, toxic, labelled, klass, gt_slop of every document.

    Labelled documents are the core: legit or slop by quality, structured where pos is even.
    The others are slop that fails one gate, by pos % 3.
    """
    docs, marks = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")), table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "l_id")
    even, legit = F.col("doc_id") % 2 == 0, F.col("quality") == 1
    klass = (
        F.when(F.col("l_id").isNull(), F.element_at(F.array(*map(F.lit, GATES.values())), (F.col("doc_id") % 3 + 1).cast("int")))
        .when(legit, F.when(even, "C1").otherwise("C4"))
        .otherwise(F.when(even, "C3").otherwise("C2"))
    )
    return docs.join(marks, docs["doc_id"] == marks["l_id"], "left").select(
        F.col("doc_id").alias("pos"), F.col("text").alias("prose"), F.col("source").alias("topic"), "lang", "quality", "toxic",
        F.col("l_id").isNotNull().alias("labelled"), klass.alias("klass"), F.when(F.col("l_id").isNull(), True).otherwise(~legit).alias("gt_slop"),
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderkey") < LEDGER_ROWS)
    return orders.select(F.col("o_orderkey").alias("pos"), F.substring(F.sha2(F.col("o_orderkey").cast("string"), 256), 1, 40).alias("sha"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("committed_date"))


def anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """items with the ledger row that each cites, item k citing row k modulo the ledger's rows; nulls where the ledger is empty."""
    led = ledger(spark, sf_dir).select(F.col("pos").alias("l_pos"), "sha", "committed_date")
    rows = items(spark, sf_dir).join(F.broadcast(led.agg(F.count("*").alias("l_rows"))))  # one row
    return rows.join(led, F.expr("pmod(pos, nullif(l_rows, 0))") == F.col("l_pos"), "left").drop("l_pos", "l_rows")


def scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """items rendered as scopes: files, canon, vocab, claims. Bare ones (C2, C4) have one file and no claims."""
    window = ledger(spark, sf_dir).agg(F.min("committed_date").alias("w0"), F.max("committed_date").alias("w1"))
    base = anchored(spark, sf_dir).join(F.broadcast(window))  # one row
    date, klass = F.col("committed_date"), F.col("klass")
    base = base.withColumns(
        {
            "bare": klass.isin("C2", "C4"),
            "used": F.array_sort(F.array_distinct(F.slice(F.regexp_extract_all("prose", F.lit("[A-Za-z]{4,}"), 0), 1, 3))),
            "start": F.when(klass == "C1", F.least("w0", date)).when(klass == "Gscope", "1990-01-01").otherwise(date),
            "end": F.when(klass == "C1", F.greatest("w1", date)).when(klass == "Gscope", "1990-12-31").otherwise(date),
            "cites": F.when(klass == "Gevid", FAKE_SHA).otherwise(F.col("sha")),
        }
    )
    mentions = F.array_join(F.transform("used", lambda t: F.concat(F.lit("[["), t, F.lit("]]"))), " ")
    mentions = F.concat(mentions, F.when(klass == "Gintro", " [[Unresolved]]").otherwise(""))
    canon = F.concat(F.lit("inherits: /\nwindow_start: "), "start", F.lit("\nwindow_end: "), "end", F.lit("\n\nGoverns "), mentions, F.lit(".\n"))
    vocab = F.concat(F.lit("# VOCAB\n"), F.array_join(F.transform("used", lambda t: F.concat(F.lit("- [["), t, F.lit(f"]]: {DEFINED}\n"))), ""))
    claim = F.struct(F.col("prose").alias("text"), F.col("used").alias("terms"), F.col("cites").alias("evidence_commit"), date.alias("evidence_date"))
    return base.select(
        "pos", "klass", "topic", "lang", "gt_slop", "labelled", "quality", "toxic", "prose",
        F.when(F.col("bare"), F.array(F.lit("content.md"))).otherwise(F.array(*map(F.lit, ("CANON.md", "VOCAB.md", "README.md", "claims.json")))).alias("files"),
        F.when(~F.col("bare"), canon).alias("canon"), F.when(~F.col("bare"), vocab).alias("vocab"),
        F.filter(F.array(claim), lambda c: ~F.col("bare")).alias("claims"),
    )


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate(scopes(spark, sf_dir), ledger(spark, sf_dir))


def symbol_share(prose: str = "prose") -> Column:
    return F.length(F.regexp_replace(prose, r"[\p{L}\p{N}\s]", "")).cast("double") / F.nullif(F.length(prose).cast("double"), F.lit(0.0))


def tokens(prose: str | Column = "prose") -> Column:
    return F.regexp_extract_all(F.lower(prose), F.lit("[a-z0-9]+"), 0)


def quality_proxy(prose: str = "prose") -> Column:
    """B2, a stand-in for a model judge: rejects where symbols are many."""
    return F.coalesce(symbol_share(prose) > SYMBOL_SHARE, F.lit(False))


def detector_proxy(prose: str = "prose") -> Column:
    """B1b, a stand-in for a model detector: rejects where tokens repeat."""
    found = tokens(prose)
    return F.coalesce(F.size(F.array_distinct(found)).cast("double") / F.nullif(F.size(found).cast("double"), F.lit(0.0)) < DISTINCT_SHARE, F.lit(False))


def wide_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per item with its prose's length and a reject column for each arm; the validator's flags are made once and the ablations derived.

    Texts are read once: what the arms need of an item is written without its prose.
    """
    parts = F.transform("claims", lambda c: F.struct(c["terms"].alias("terms"), c["evidence_commit"].alias("evidence_commit"), c["evidence_date"].alias("evidence_date")))
    said = {"chars": F.length("prose").cast("long"), "B0": F.lit(False), "B1b": detector_proxy(), "B2": quality_proxy(), "claims": parts}
    slim = stored(scopes(spark, sf_dir).withColumns(said).drop("prose"), "scopes")
    judged = validate(slim, ledger(spark, sf_dir))
    return judged.select("pos", "klass", "topic", "lang", "gt_slop", "labelled", "quality", "toxic", "chars", "B0", "B1b", "B2", *((~accept(without)).alias(arm) for arm, without in ABLATIONS.items()))


def decisions(spark: SparkSession, sf_dir: str, core: bool = False) -> DataFrame:
    """Long form: pos, klass, topic, lang, gt_slop, labelled, arm, reject."""
    wide = wide_decisions(spark, sf_dir)
    wide = wide.where("labelled") if core else wide
    return by_arm(wide.select("pos", "klass", "topic", "lang", "gt_slop", "labelled", *(f"`{a}`" for a in ARMS)))


def by_arm(wide: DataFrame, arms: tuple[str, ...] = ARMS) -> DataFrame:
    """wide with a row per item and arm: arm and reject instead of the arms' columns."""
    listed = F.explode(F.array(*(F.struct(F.lit(a).alias("arm"), F.col(f"`{a}`").alias("reject")) for a in arms)))
    return wide.select(*(c for c in wide.columns if c not in ARMS), listed.alias("d")).select("*", "d.arm", "d.reject").drop("d")


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos and three raters' labels: slop, legit or abstain."""
    said = lambda slop: F.when(~F.col("labelled"), "abstain").when(slop, "slop").otherwise("legit")
    return items(spark, sf_dir).select(
        "pos", "topic", "lang", "labelled", "gt_slop", said(F.col("quality") == 0).alias("r1"), said(F.col("toxic") == 1).alias("r2"), F.when(quality_proxy(), "slop").otherwise("legit").alias("r3")
    )


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """votes with n_slop, n_legit and panel_gt; a tie is legit."""
    raters = F.array("r1", "r2", "r3")
    count = lambda want: F.size(F.filter(raters, lambda v: v == want)).cast("long")
    return votes(spark, sf_dir).withColumns({"n_slop": count("slop"), "n_legit": count("legit")}).withColumn("panel_gt", F.when(F.col("n_slop") > F.col("n_legit"), "slop").otherwise("legit"))
