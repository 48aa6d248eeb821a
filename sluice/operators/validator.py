"""Structural validation of scopes against an evidence ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions import gates

FLAGS = ("triad_ok", "inheritance_ok", "introspection_ok", "gate_vocab_ok", "gate_evidence_ok", "gate_scope_ok")
#: What a verdict says of each failed gate; lists are written as ['a', 'b'].
REASONS = {
    "triad_ok": "triad missing: ",
    "inheritance_ok": "inheritance: no parent declared or chain does not reach root",
    "introspection_ok": "introspection: undefined terms ",
    "claims_ok": "claims.json unparseable",
    "gate_vocab_ok": "gate1 vocab: claim uses undefined term",
    "gate_evidence_ok": "gate2 evidence: claim cites commit absent from ledger",
    "gate_scope_ok": "gate3 scope: claim evidence outside declared window",
}
#: Undefined terms that a reason names.
NAMED_TERMS = 5
#: Ablations: the flags that each arm leaves out.
ABLATIONS = {"T": None, "T-Introspection": "introspection_ok", "T-Evidence": "gate_evidence_ok", "T-Scope": "gate_scope_ok"}


def validate(scopes: DataFrame, ledger: DataFrame, key: str = "pos") -> DataFrame:
    """scopes with the six flags, accept, reasons, and the files and terms that are missing.

    reasons: the texts of REASONS of the gates that fail, in that order; claims that can't be parsed
    (a column claims_ok that is false, where scopes has one) are a reason but no gate.
    Evidence: no claim may cite a commit that isn't in ledger.sha; the cited commits that are
    missing are found by an anti-join, so the ledger may have any size. A scope without claims
    passes the claim gates.
    """
    cited = scopes.select(key, F.explode("claims").alias("c")).select(key, gates.strip(F.coalesce("c.evidence_commit", F.lit(""))).alias("sha"))
    missing = cited.join(ledger.select("sha"), "sha", "left_anti").select(key).distinct().withColumn("__missing", F.lit(True))
    out = scopes.join(missing, key, "left").withColumns(
        {
            "missing_files": gates.missing_files(F.col("files")),
            "inheritance_ok": gates.inheritance(F.col("canon")),
            "undefined_terms": gates.undefined(F.col("canon"), F.col("vocab")),
            "gate_vocab_ok": gates.vocabulary(F.col("claims"), F.col("vocab")),
            "gate_evidence_ok": F.col("__missing").isNull(),
            "gate_scope_ok": gates.in_scope(F.col("claims"), F.col("canon")),
        }
    )
    out = out.withColumns({"triad_ok": F.size("missing_files") == 0, "introspection_ok": F.size("undefined_terms") == 0}).drop("__missing")
    named = {"triad_ok": F.col("missing_files"), "introspection_ok": F.slice("undefined_terms", 1, NAMED_TERMS)}
    failed = {flag: ~F.col(flag) for flag in REASONS if flag != "claims_ok" or flag in scopes.columns}
    said = F.array(*(F.when(fails, F.concat(F.lit(REASONS[flag]), _listed(named[flag])) if flag in named else F.lit(REASONS[flag])) for flag, fails in failed.items()))
    return out.withColumn("accept", accept(None)).withColumn("reasons", F.array_compact(said))


def _listed(names: Column) -> Column:
    """A list of texts as it is published: in single quotes, in double ones where a text has only the former, with backslashes before what needs them."""

    def quoted(x: Column) -> Column:
        plain = F.replace(x, F.lit("\\"), F.lit("\\\\"))
        single = F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'"))
        return F.when(x.contains("'") & ~x.contains('"'), F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(single)

    return F.concat(F.lit("["), F.array_join(F.transform(names, quoted), ", "), F.lit("]"))


def validate_directories(directories: DataFrame, ledger: DataFrame) -> DataFrame:
    """The verdicts of governed directories, as sources.scope_directories gives them; the key is the directory."""
    claims = F.when(F.array_contains("files", "claims.json"), F.col("claims_json"))
    parsed = directories.withColumns({"claims": gates.parse_claims(claims), "claims_ok": F.coalesce(gates.claims_parse(claims), ~F.array_contains("files", "claims.json"))})
    return validate(parsed, ledger, key="scope")


def accept(without: str | None):
    """The conjunction of the flags but `without`."""
    whole = F.lit(True)
    for flag in FLAGS:
        if flag != without:
            whole = whole & F.col(flag)
    return whole
