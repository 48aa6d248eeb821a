"""Queries of scopes with several claims, of passage eligibility and of source order."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.operators import corpus as C
from sluice.operators import rendering as R
from sluice.operators.validator import FLAGS, validate_directories
from sluice.plans import oracle as O
from sluice.sources import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


_BEFORE, _AFTER = R.CIRCULAR.split("{}")
#: Conversations as scopes whose turns are claims, made to fail by their number's last digit.
CLAIMED = f"""
l AS (SELECT *, count(*) OVER () AS rows_ FROM ledger),
c AS (SELECT conv_id, turn, text, list_slice(regexp_extract_all(text, '[A-Za-z]{{4,}}'), 1, 2) AS terms, sha, committed_date FROM conversations JOIN l ON (conv_id + turn) % rows_ = pos),
s AS (SELECT conv_id, conv_id % 10 AS kind, count(*) AS n, string_agg(coalesce(text, ''), ' ' ORDER BY turn) AS prose, list_sort(list_distinct(flatten(list(terms)))) AS used, min(committed_date) AS d0, max(committed_date) AS d1 FROM c GROUP BY conv_id),
v AS (SELECT *, CASE WHEN kind <> 4 THEN '# VOCAB' || chr(10) || array_to_string(list_transform(CASE WHEN kind = 5 THEN list_slice(used, 2, len(used)) ELSE used END,
    lambda t: '- [[' || t || ']]: ' || CASE WHEN kind = 6 THEN '{_BEFORE}' || t || '{_AFTER}' ELSE '{R.DEFINED}' END || chr(10)), '') END AS vocab FROM s),
f AS (SELECT *, kind <> 4 AS triad_ok, kind NOT IN (4, 9) AS inheritance_ok, NOT (kind = 3 OR kind = 5 AND len(used) > 0) AS introspection_ok, NOT (kind = 5 AND len(used) > 0) AS gate_vocab_ok,
  kind <> 1 AS gate_evidence_ok, NOT (kind = 2 AND d0 < d1 OR kind = 7) AS gate_scope_ok FROM v)"""
_REASONS = """array_to_string(list_filter([CASE WHEN NOT triad_ok THEN 'triad missing: [''CANON.md'', ''README.md'', ''VOCAB.md'']' END, CASE WHEN NOT inheritance_ok THEN 'inheritance: no parent declared or chain does not reach root' END,
  CASE WHEN NOT introspection_ok THEN 'introspection: undefined terms [''' || CASE WHEN kind = 3 THEN 'Unresolved' ELSE used[1] END || ''']' END, CASE WHEN kind = 8 THEN 'claims.json unparseable' END,
  CASE WHEN NOT gate_vocab_ok THEN 'gate1 vocab: claim uses undefined term' END, CASE WHEN NOT gate_evidence_ok THEN 'gate2 evidence: claim cites commit absent from ledger' END,
  CASE WHEN NOT gate_scope_ok THEN 'gate3 scope: claim evidence outside declared window' END], lambda x: x IS NOT NULL), '; ')"""


def claimed(spark, sf):
    """scope, kind, claims and the rendered files of every conversation: a turn is a claim that cites the ledger's row conv_id + turn modulo its rows.

    By the last digit of conv_id: 1 the first claim cites what isn't in the ledger, 2 the window ends with
    the earliest date, 3 the canon names a term without definition, 4 bare, 5 the vocabulary lacks the
    first term, 6 circular definitions, 7 the last claim has no date, 8 the claims can't be parsed, 9 no
    parent.
    """
    led = C.ledger(spark, sf).select("pos", "sha", "committed_date")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "text").join(F.broadcast(led.agg(F.count("*").alias("rows"))))  # one row
    rows = rows.join(led, F.expr("pmod(conv_id + turn, nullif(rows, 0))") == F.col("pos"))
    kind = F.col("conv_id") % 10
    ends = Window.partitionBy("conv_id")  # a conversation's turns
    first, last = F.col("turn") == F.min("turn").over(ends), F.col("turn") == F.max("turn").over(ends)
    claim = F.struct(
        "text", F.slice(F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), 0), 1, 2).alias("terms"),
        F.when((kind == 1) & first, C.FAKE_SHA).otherwise(F.col("sha")).alias("evidence_commit"), F.when(~((kind == 7) & last), F.col("committed_date")).alias("evidence_date"),
    )
    listed = F.transform(F.array_sort(F.collect_list(F.struct("turn", "claim"))), lambda x: x["claim"])
    scopes = rows.withColumn("claim", claim).groupBy(F.col("conv_id").alias("scope")).agg(listed.alias("claims"), F.min("committed_date").alias("window_start"), F.max("committed_date").alias("d1"))
    kind = F.col("scope") % 10
    scopes = scopes.withColumns(
        {
            "kind": kind, "window_end": F.when(kind == 2, F.col("window_start")).otherwise(F.col("d1")), "scaffolded": kind != 4, "circular": kind == 6,
            "inject": F.when(kind == 3, "Unresolved"), "inherits": F.when(kind == 9, "elsewhere"),
        }
    )
    out = R.render(scopes).withColumn("__first", F.concat(F.lit("- [["), F.get(R.used_terms(), F.lit(0)), F.lit(f"]]: {R.DEFINED}\n")))
    lacks = F.when(kind == 5, F.replace("vocab", F.coalesce("__first", F.lit("")), F.lit(""))).otherwise(F.col("vocab"))
    broken = F.when(kind == 8, F.substring("claims_json", 1, F.length("claims_json") - 1)).otherwise(F.col("claims_json"))
    return out.withColumns({"vocab": lacks, "claims_json": broken, "n": F.size("claims").cast("long")}).drop("__first", "d1", "claims")


@query(O.sql(O.LEDGER, CLAIMED, select=f"SELECT conv_id AS scope, n, sha256(prose) AS prose_sha, sha256(vocab) AS vocab_sha, {', '.join(FLAGS)}, {' AND '.join(FLAGS)} AS accept, {_REASONS} AS reasons FROM f"))
def claims_scope_verdict(spark, sf):
    """Verdicts of scopes with several claims, from files to reasons: any claim that fails a gate fails the scope."""
    out = validate_directories(claimed(spark, sf), C.ledger(spark, sf))
    return out.select("scope", "n", F.sha2("prose", 256).alias("prose_sha"), F.sha2("vocab", 256).alias("vocab_sha"), *FLAGS, "accept", F.array_join("reasons", "; ").alias("reasons"))


#: Characters that an eligible passage exceeds, and those that it is cut to.
ELIGIBLE, CUT = 240, 600


@query(f"SELECT doc_id, length(substr(text, 1, {CUT})) AS chars, sha256(substr(text, 1, {CUT})) AS text_sha FROM documents WHERE lang = 'en' AND length(text) > {ELIGIBLE}")
def eligible_passages(spark, sf):
    """Passages of one specialty (a language stands in for it) that are long enough, cut."""
    cut = F.substring("text", 1, CUT)
    docs = table(spark, sf, "documents").where((F.col("lang") == "en") & (F.length("text") > ELIGIBLE))
    return docs.select("doc_id", F.length(cut).cast("long").alias("chars"), F.sha2(cut, 256).alias("text_sha"))


@query(O.sql(O.ITEMS, O.PROXIES, "g AS (SELECT topic AS source, gt_slop, count(*) AS n, round(count(*) FILTER (b2)::DOUBLE / count(*), 3) AS b2_catch_rate FROM proxies WHERE labelled GROUP BY ALL)",
  select="SELECT row_number() OVER (ORDER BY gt_slop DESC, source) AS place, source, gt_slop, n, b2_catch_rate FROM g"))
def sources_in_order(spark, sf):
    """Catch rates by source, slop first, then by name."""
    rows = C.items(spark, sf).where("labelled").withColumn("b2", C.quality_proxy())
    by = rows.groupBy(F.col("topic").alias("source"), "gt_slop").agg(F.count("*").alias("n"), F.round(F.count_if("b2") / F.count("*"), 3).alias("b2_catch_rate"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("gt_slop"), "source"))  # two rows a source at most
    return by.select(place.cast("long").alias("place"), "source", "gt_slop", "n", "b2_catch_rate")
