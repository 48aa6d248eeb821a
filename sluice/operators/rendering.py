"""Scopes rendered from claims: the files of a governed directory as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.gates import TRIAD

#: A term's definition where it has none, and where the vocabulary goes in circles.
DEFINED, CIRCULAR = "defined locally", "the governed notion of {} as used within this scope"
#: Fixed value: a claim as the claims file has it.
CLAIM = "struct<text:string,terms:array<string>,evidence_commit:string,evidence_date:string>"


def _or(column: str | None, other: Column, scopes: DataFrame) -> Column:
    return F.coalesce(F.col(column), other) if column in scopes.columns else other


def used_terms(claims: str = "claims") -> Column:
    """The distinct terms of all claims, in order."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(claims, lambda c: F.coalesce(c["terms"], F.array().cast("array<string>"))))))


def prose(claims: str = "claims") -> Column:
    """The claims' texts in order, joined by a space."""
    return F.array_join(F.transform(claims, lambda c: F.coalesce(c["text"], F.lit(""))), " ")


def render(scopes: DataFrame) -> DataFrame:
    """scopes with prose, files, canon, vocab, readme and claims_json.

    scopes: claims (array of CLAIM, in order), window_start, window_end; and, where it has them,
    scaffolded (default true: the four files; else only content.md, and null texts), definitions (a
    map from terms), circular (definitions that only name their term), inject (a term that the canon
    names and the vocabulary lacks) and inherits (default /). Terms are those that the claims use.
    """
    claims = F.coalesce(F.col("claims"), F.array().cast(f"array<{CLAIM}>"))
    rows = scopes.withColumn("claims", claims).withColumn("__used", used_terms())
    some = _or("scaffolded", F.lit(True), scopes)
    own = (lambda t: F.coalesce(F.element_at("definitions", t), F.lit(DEFINED))) if "definitions" in scopes.columns else (lambda t: F.lit(DEFINED))
    before, after = CIRCULAR.split("{}")
    says = lambda t: F.when(_or("circular", F.lit(False), scopes), F.concat(F.lit(before), t, F.lit(after))).otherwise(own(t))
    named = F.array_join(F.transform("__used", lambda t: F.concat(F.lit("[["), t, F.lit("]]"))), " ")
    injected = F.concat(F.lit(" [["), F.col("inject"), F.lit("]]")) if "inject" in scopes.columns else F.lit("")
    canon = F.concat(F.lit("inherits: "), _or("inherits", F.lit("/"), scopes), F.lit("\nwindow_start: "), "window_start", F.lit("\nwindow_end: "), "window_end", F.lit("\n\nGoverns "), named, F.coalesce(injected, F.lit("")), F.lit(".\n"))
    vocab = F.concat(F.lit("# VOCAB\n"), F.array_join(F.transform("__used", lambda t: F.concat(F.lit("- [["), t, F.lit("]]: "), says(t), F.lit("\n"))), ""))
    files = F.when(some, F.array(*map(F.lit, sorted([*TRIAD, "claims.json"])))).otherwise(F.array(F.lit("content.md")))
    rows = rows.withColumns({"prose": prose(), "files": files, "canon": F.when(some, canon), "vocab": F.when(some, vocab)})
    return rows.withColumns({"readme": F.when(some, F.concat(F.lit("# README\n"), "prose", F.lit("\n"))), "claims_json": F.when(some, F.to_json("claims", {"ignoreNullFields": "false"}))}).drop("__used")
