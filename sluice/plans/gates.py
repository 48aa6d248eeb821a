"""Queries of corpus construction and of the structural validator."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions import gates as G
from sluice.operators import chains
from sluice.operators import corpus as C
from sluice.operators.thresholds import numbered
from sluice.operators.validator import ABLATIONS, FLAGS, NAMED_TERMS, REASONS, accept
from sluice.plans import oracle as O
from sluice.sources import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
FLAGGED = (O.ITEMS, O.LEDGER, O.SCOPES)


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


#: Providers, and the classes with their topic offsets, whether they are slop, and whether an adversary writes them.
PROVIDERS = ("anthropic", "openai", "deepseek")
CLASSES = [("C1", 0, False, False), ("C2", 0, True, False), ("C3", 3, True, True), ("C4", 5, False, False), ("Gintro", 7, True, True), ("Gevid", 11, True, True), ("Gscope", 13, True, True)]
#: The gate classes have an item for every so many of the core's: 40 for 90.
GATE, CORE = 40, 90


@query("""WITH k(klass, off, slop, adversary) AS (VALUES """ + ", ".join(f"('{k}', {o}, {s}, {a})" for k, o, s, a in CLASSES) + f"""),
n AS (SELECT count(*) AS n FROM labels), i AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i FROM labels),
t AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS t, count(*) OVER () AS topics FROM (SELECT DISTINCT source FROM documents))
SELECT klass || '-' || lpad(i::VARCHAR, 6, '0') AS id, klass, i, source AS topic, slop, CASE WHEN adversary THEN 'openai' ELSE (['anthropic', 'openai', 'deepseek'])[i % 3 + 1] END AS provider
FROM k CROSS JOIN i CROSS JOIN n JOIN t ON (i + off) % topics = t WHERE klass LIKE 'C%' OR i < {GATE} * n // {CORE}""")
def spec_grid(spark, sf):
    """Item specifications: as many items a core class as there are labels, over the documents' sources as topics; the adversary is the first provider but one's own."""
    items = numbered(table(spark, sf, "labels").select("doc_id"), "doc_id", "i").select("i")
    topics = numbered(table(spark, sf, "documents").select("source").distinct(), "source", "t")
    sizes = table(spark, sf, "labels").agg(F.count("*").alias("n")).join(topics.agg(F.count("*").alias("topics")))  # one row
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("klass"), F.lit(o).alias("off"), F.lit(s).alias("slop"), F.lit(a).alias("adversary")) for k, o, s, a in CLASSES)))
    grid = items.join(F.broadcast(sizes)).select("i", "n", "topics", kinds.alias("k")).select("i", "n", "topics", "k.*").where(F.col("klass").startswith("C") | F.expr(f"i < {GATE} * n div {CORE}"))
    adversary = next(p for p in PROVIDERS if p != "anthropic")
    turn = F.element_at(F.array(*map(F.lit, PROVIDERS)), (F.col("i") % len(PROVIDERS) + 1).cast("int"))
    named = grid.withColumn("t", F.pmod(F.col("i") + F.col("off"), "topics")).join(topics, "t")
    return named.select(F.format_string("%s-%06d", "klass", "i").alias("id"), "klass", "i", F.col("source").alias("topic"), "slop", F.when(F.col("adversary"), adversary).otherwise(turn).alias("provider"))


@query(O.sql(O.LEDGER, select="SELECT min(committed_date) AS window_start, max(committed_date) AS window_end, count(*) AS n FROM ledger"))
def ledger_window(spark, sf):
    return C.ledger(spark, sf).agg(F.min("committed_date").alias("window_start"), F.max("committed_date").alias("window_end"), F.count("*").alias("n"))


@query(O.sql(O.ITEMS, O.LEDGER, select="SELECT i.pos, l.pos AS ledger_pos, l.sha, l.committed_date FROM items i JOIN ledger l ON i.pos % (SELECT count(*) FROM ledger) = l.pos"))
def evidence_anchor(spark, sf):
    """Item k cites the ledger's row k modulo its length."""
    led = C.ledger(spark, sf).select(F.col("pos").alias("ledger_pos"), "sha")
    return C.anchored(spark, sf).select("pos", "sha", "committed_date").join(led, "sha").select("pos", "ledger_pos", "sha", "committed_date")


@query(O.sql(*FLAGGED, select="SELECT pos, klass, canon, vocab, sha256(prose) AS prose_sha FROM flags"))
def scope_render(spark, sf):
    return C.scopes(spark, sf).select("pos", "klass", "canon", "vocab", F.sha2("prose", 256).alias("prose_sha"))


_ACCEPT = " AND ".join(FLAGS)


@query(O.sql(*FLAGGED, select=f"SELECT pos, klass, {', '.join(FLAGS)}, {_ACCEPT} AS accept FROM flags"))
def validate_verdict(spark, sf):
    return C.verdicts(spark, sf).select("pos", "klass", *FLAGS, "accept")


def _tally(flag):
    return O.sql(*FLAGGED, select=f"SELECT klass, count(*) AS n, count(*) FILTER ({flag}) AS passed FROM flags GROUP BY klass")


def _passed(df, flag):
    return df.groupBy("klass").agg(F.count("*").alias("n"), F.count_if(flag).alias("passed"))


@query(_tally("triad_ok"))
def gate_triad(spark, sf):
    return _passed(C.scopes(spark, sf), G.triad(F.col("files")))


@query(_tally("inheritance_ok"))
def gate_inheritance(spark, sf):
    return _passed(C.scopes(spark, sf), G.inheritance(F.col("canon")))


@query(O.sql(*FLAGGED, select="""SELECT pos, klass, introspection_ok, array_to_string(list_sort(list_distinct(list_filter(list_concat(canon_terms, vocab_terms), lambda t: NOT list_contains(defs, t)))), ',') AS undefined_terms FROM flags"""))
def gate_introspection(spark, sf):
    """Terms used but not defined, as set differences."""
    missing = G.undefined(F.col("canon"), F.col("vocab"))
    return C.scopes(spark, sf).withColumn("m", missing).select("pos", "klass", (F.size("m") == 0).alias("introspection_ok"), F.array_join("m", ",").alias("undefined_terms"))


@query(_tally("gate_vocab_ok"))
def gate_vocab(spark, sf):
    return _passed(C.scopes(spark, sf), G.vocabulary(F.col("claims"), F.col("vocab")))


@query("""WITH led AS (SELECT p_partkey FROM part WHERE p_size <= 40) SELECT l_orderkey AS scope, count(*) AS claims FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM led) GROUP BY l_orderkey""")
def gate_evidence_anti(spark, sf):
    """Scopes that cite evidence absent from the ledger: an anti-join at volume."""
    led = table(spark, sf, "part").where("p_size <= 40").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").join(led, "l_partkey", "left_anti").groupBy(F.col("l_orderkey").alias("scope")).agg(F.count("*").alias("claims"))


_INSIDE = "l_shipdate >= o_orderdate - INTERVAL 365 DAY AND l_shipdate <= o_orderdate + INTERVAL 1500 DAY"


def _ranged(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("inside", F.expr(_INSIDE))


@query(f"""SELECT o_orderkey AS scope, count(l_orderkey) AS claims, count(*) FILTER ({_INSIDE}) AS inside, coalesce(bool_and({_INSIDE}), TRUE) AS scope_ok FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def gate_scope_range(spark, sf):
    """Whether all of a scope's claims are dated in its window; a scope without claims passes."""
    return _ranged(spark, sf).groupBy(F.col("o_orderkey").alias("scope")).agg(F.count("l_orderkey").alias("claims"), F.count_if("inside").alias("inside"), F.coalesce(F.bool_and("inside"), F.lit(True)).alias("scope_ok"))


@query(f"""SELECT o_orderkey AS scope, coalesce(bool_and(p_size <= 40), TRUE) AS evidence_ok, coalesce(bool_and({_INSIDE}), TRUE) AS scope_ok, coalesce(bool_and(p_size <= 40 AND {_INSIDE}), TRUE) AS accept
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey LEFT JOIN part ON l_partkey = p_partkey GROUP BY o_orderkey""")
def gates_relational(spark, sf):
    """Evidence and scope gates together over orders and their lines."""
    led = table(spark, sf, "part").select("p_partkey", (F.col("p_size") <= 40).alias("known"))
    joined = _ranged(spark, sf).join(led, F.col("l_partkey") == F.col("p_partkey"), "left")
    whole = lambda c: F.coalesce(F.bool_and(c), F.lit(True))
    return joined.groupBy(F.col("o_orderkey").alias("scope")).agg(whole(F.col("known")).alias("evidence_ok"), whole(F.col("inside")).alias("scope_ok"), whole(F.col("known") & F.col("inside")).alias("accept"))


@query(" UNION ALL ".join(O.sql(*FLAGGED, select=f"SELECT pos, klass, '{a}' AS arm, {' AND '.join(f for f in FLAGS if f != w)} AS accept FROM flags").join(("SELECT * FROM (", ")")) for a, w in ABLATIONS.items()))
def ablation_long(spark, sf):
    """The validator and its ablations in long form, from one set of flags."""
    arms = F.explode(F.array(*(F.struct(F.lit(a).alias("arm"), accept(w).alias("accept")) for a, w in ABLATIONS.items())))
    return C.verdicts(spark, sf).select("pos", "klass", arms.alias("a")).select("pos", "klass", "a.*")


_LISTED = lambda names: f"'[' || array_to_string(list_transform({names}, lambda x: chr(39) || x || chr(39)), ', ') || ']'"
_MISSING = {
    "triad_ok": "CASE WHEN files_missing THEN ['CANON.md', 'README.md', 'VOCAB.md'] END",
    "introspection_ok": f"list_slice(list_sort(list_distinct(list_filter(list_concat(canon_terms, vocab_terms), lambda t: NOT list_contains(defs, t)))), 1, {NAMED_TERMS})",
}
_SAID = ", ".join(f"CASE WHEN NOT {flag} THEN '{text}'" + (" || " + _LISTED(_MISSING[flag]) if flag in _MISSING else "") + " END" for flag, text in REASONS.items() if flag != "claims_ok")


@query(O.sql(*FLAGGED, select=f"SELECT pos, concat_ws('; ', {_SAID}) AS reasons FROM (SELECT *, NOT triad_ok AS files_missing FROM flags)"))
def verdict_reasons(spark, sf):
    return C.verdicts(spark, sf).select("pos", F.array_join("reasons", "; ").alias("reasons"))


CLAIM = "struct<text:string,terms:array<string>>"


def normalize_claims(raw, topic):
    """Claims of a JSON array of strings or objects: strings become texts, terms default to none, and no claim to a placeholder."""
    parsed = F.from_json(raw, "array<string>")
    one = lambda x: F.when(x.startswith("{"), F.from_json(x, CLAIM)).otherwise(F.struct(x.alias("text"), F.array().cast("array<string>").alias("terms")))
    filled = F.transform(F.transform(parsed, one), lambda c: F.struct(c["text"].alias("text"), F.coalesce(c["terms"], F.array().cast("array<string>")).alias("terms")))
    empty = F.array(F.struct(F.concat(F.lit("A claim about "), topic, F.lit(".")).alias("text"), F.array().cast("array<string>").alias("terms")))
    return F.when(F.coalesce(F.size(filled), F.lit(0)) > 0, filled).otherwise(empty)


@query("""WITH c AS (SELECT conv_id, count(*) FILTER (turn < 3) AS n, count(*) FILTER (turn = 2) AS t, string_agg(text, '|' ORDER BY turn) FILTER (turn < 3) AS texts FROM conversations GROUP BY conv_id)
SELECT conv_id, greatest(n, 1) AS n_claims, t AS n_terms, CASE WHEN n > 0 THEN texts ELSE 'A claim about ' || conv_id || '.' END AS texts FROM c""")
def claims_normalize(spark, sf):
    """The three accepted forms of a claim: text, object without terms, object with terms."""
    kind = T.StructType([T.StructField("text", T.StringType()), T.StructField("terms", T.ArrayType(T.StringType()))])
    turns = table(spark, sf, "conversations").withColumn("claim", F.when(F.col("turn") == 0, F.to_json(F.array("text")).substr(F.lit(2), F.length(F.to_json(F.array("text"))) - 2)).when(F.col("turn") == 1, F.to_json(F.struct("text"))).when(F.col("turn") == 2, F.to_json(F.struct(F.col("text"), F.array("role").alias("terms")).cast(kind))))
    listed = F.array_sort(F.collect_list(F.when(F.col("claim").isNotNull(), F.struct("turn", "claim"))))
    raw = turns.groupBy("conv_id").agg(F.concat(F.lit("["), F.array_join(F.transform(listed, lambda x: x["claim"]), ","), F.lit("]")).alias("raw"))
    out = raw.withColumn("claims", normalize_claims(F.col("raw"), F.col("conv_id").cast("string")))
    return out.select("conv_id", F.size("claims").cast("long").alias("n_claims"), F.aggregate("claims", F.lit(0), lambda a, c: a + F.size(c["terms"])).cast("long").alias("n_terms"), F.array_join(F.transform("claims", lambda c: c["text"]), "|").alias("texts"))


def repair_json(raw, kind: str):
    """An object out of a model's reply: fences off, outermost braces, then as it is or without trailing commas; null if neither parses."""
    plain = F.regexp_replace(F.regexp_replace(G.strip(raw), r"^```[a-zA-Z]*\n?", ""), r"```[^`]*$", "")
    body = F.coalesce(F.nullif(F.regexp_extract(plain, r"(?s)\{.*\}", 0), F.lit("")), plain)
    parse = lambda x: F.when(F.try_parse_json(x).isNotNull(), F.from_json(x, kind))
    return F.coalesce(parse(body), parse(F.regexp_replace(body, r",(\s*[}\]])", "$1")))


@query("""SELECT event_id, event_id % 4 <> 3 AS ok, CASE WHEN event_id % 4 <> 3 THEN (props->>'$.k')::BIGINT END AS k FROM events""")
def json_repair(spark, sf):
    """Replies that are plain, fenced, with a trailing comma, or broken."""
    props, form = F.col("props"), F.col("event_id") % 4
    reply = F.when(form == 0, props).when(form == 1, F.concat(F.lit("```json\n"), props, F.lit("\n```"))).when(form == 2, F.concat(F.lit("Here: "), F.regexp_replace(props, "\\}", ", }"))).otherwise(F.concat(F.lit("{oops "), props))
    out = table(spark, sf, "events").withColumn("o", repair_json(reply, "struct<k:bigint>"))
    return out.select("event_id", F.col("o").isNotNull().alias("ok"), F.col("o.k").alias("k"))


@query("""WITH RECURSIVE walk(node, here, depth, looped) AS (
  SELECT doc_id, doc_id, 0, FALSE FROM documents
  UNION ALL SELECT node, CASE WHEN here % 50 = 49 THEN here ELSE here // 2 END, depth + 1, here % 50 = 49 FROM walk WHERE here <> 0 AND NOT looped)
SELECT node, max(depth)::BIGINT AS depth, NOT bool_or(looped) AS reaches_root FROM walk GROUP BY node""")
def inheritance_recursive(spark, sf):
    """Parent chains followed to the root, loops found (an extension): each scope's parent is half its number, and every fiftieth names itself."""
    number = F.col("doc_id")
    scopes = table(spark, sf, "documents").select(number.alias("node"), F.when(number % 50 == 49, number).otherwise(F.expr("doc_id div 2")).alias("parent"))
    return chains.follow(scopes, F.lit(0)).select("node", "depth", (F.col("ends") == "root").alias("reaches_root"))
