"""Markdown reports: titled sections over the registered queries' results, which have a row per arm, class or measure."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators import corpus as C
from sluice.plans.rates import QUERIES as RATES
from sluice.plans.scores import QUERIES as SCORES
from sluice.sources import markdown

Build = Callable[[SparkSession, str], DataFrame]


def _plain(name: str) -> Build:
    return {**RATES, **SCORES}[name]


def _interval(name: str, prefix: str) -> Build:
    return lambda spark, sf: _plain(name)(spark, sf).select("arm", F.col("lo").alias(f"{prefix}_lo"), F.col("hi").alias(f"{prefix}_hi"))


def _beside(first: Build, *others: Build) -> Build:
    """The first result with the columns that others have for its arms; an arm that another lacks stays, with nulls."""

    def build(spark: SparkSession, sf: str) -> DataFrame:
        out = first(spark, sf)
        for other in others:
            more = other(spark, sf)
            out = out.join(more.drop(*(set(more.columns) & set(out.columns) - {"arm"})), "arm", "left")
        return out.orderBy("arm")

    return build


def _classes(spark: SparkSession, sf: str) -> DataFrame:
    rates = _plain("reject_rate_by_class")(spark, sf)
    return rates.groupBy("arm").pivot("klass", [*C.CORE, *C.GATES.values()]).agg(F.first("reject_rate")).orderBy("arm")


#: Reports by name: sections of title, what to know when reading it, and what it lists.
REPORTS: dict[str, list[tuple[str, str, Build]]] = {
    "admission": [
        ("Rater agreement", "Fleiss' kappa over the panel's labels.", _plain("fleiss_kappa")),
        ("Panel against intended labels", "", _plain("manipulation_check")),
        ("Detector score", "Area under the curve of perplexity, slop being positive.", _plain("roc_auc")),
        ("Arms", "A rejection predicts slop. Bootstrap interval of F1 at 95 %.", _beside(_plain("confusion_by_arm"), _interval("bootstrap_f1_ci", "f1"))),
        ("Reject rate by class", "", _classes),
        ("What only one gate catches", "", _plain("ablation_marginal")),
        ("Gap and tax", "", _plain("headline_gap_tax")),
    ],
    "association": [
        (
            "Association with content",
            "Phi is 0 where decisions don't depend on content; intervals at 95 % by items and by topics.",
            _beside(_plain("phi_by_arm"), _interval("item_bootstrap_phi_ci", "item"), _interval("cluster_bootstrap_phi_ci", "topic"), _plain("odds_ratio_by_arm")),
        ),
        ("Off-diagonal cells", "Slop in valid structure that is admitted, and legitimate content without structure that is rejected.", _plain("offdiagonal_rates")),
        ("Where two arms disagree", "", _plain("paired_discordance")),
        ("Difference of phi by permutation", "", _plain("phi_diff_perm_hash")),
    ],
    "tournament": [
        ("Association in the tournament", "", _plain("tournament_association")),
        ("Leak through all arms", "", _plain("tournament_leak")),
    ],
}


def render(spark: SparkSession, sf_dir: str, name: str) -> str:
    """The report as Markdown. A section without rows has its header only."""
    parts = [f"# {name.capitalize()}"]
    for title, note, build in REPORTS[name]:
        parts += [f"## {title}", *([note] if note else []), markdown(build(spark, sf_dir))]
    return "\n\n".join(parts) + "\n"


def write_report(spark: SparkSession, sf_dir: str, name: str, path: str) -> None:
    """render's text as the one file in the folder path, which is replaced."""
    spark.createDataFrame([(render(spark, sf_dir, name).removesuffix("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(path)
