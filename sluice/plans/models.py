"""Queries of model arms: scorers with planted failures, word models, embeddings, approximate retrieval and a stream of scopes."""

from __future__ import annotations

import datetime
import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import functions as F

from sluice.operators import corpus as C
from sluice.operators import embeddings as E
from sluice.operators import ivf as I
from sluice.operators import lm
from sluice.operators import retrieval as V
from sluice.operators import scoring as S
from sluice.plans import oracle as O
from sluice.sources import shared_dir, spread, stored, table
from sluice.streaming import scopes as W

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# ---- scorers: stand-ins for model services, which fail by the length of what they are shown

FORMS = 12


def _variety(text: str) -> float:
    found = re.findall("[a-z0-9]+", text.lower())
    return len(set(found)) / len(found) if found else 1.0


def flaky(answer: Callable[[str], dict], shift: int = 0):
    """A stand-in for a service: replies to a prompt's text (what follows its first empty line), in forms dealt by the text's length.

    Of FORMS forms, 0 is never answered, 1 never readably, 2 and 3 at the second call; 4 comes fenced
    with a trailing comma, 5 has texts for booleans, and 6 lacks what was asked for.
    """

    def ask(prompts: list[str], attempt: int) -> list[str | Exception]:
        out: list[str | Exception] = []
        for prompt in prompts:
            text = prompt.split("\n\n", 1)[1]
            form, reply = (len(text) + shift) % FORMS, answer(text)
            if form == 0 or form == 2 and not attempt:
                out.append(ConnectionError("no answer"))
            elif form == 1 or form == 3 and not attempt:
                out.append("I can't say {")
            elif form == 4:
                out.append("```json\n" + json.dumps(reply)[:-1] + ", }\n```")
            elif form == 5:
                out.append(json.dumps({k: str(v) if isinstance(v, bool) else v for k, v in reply.items()}))
            else:
                out.append(json.dumps(reply) if form != 6 else '{"note": "none"}')
        return out

    return ask


def _steady(answer):
    return lambda prompts, attempt: [json.dumps(answer(p.split("\n\n", 1)[1])) for p in prompts]


def _detected(text: str) -> dict:
    return {"machine_generated": _variety(text) < 0.35, "p_ai": 1 - _variety(text)}


def _admitted(text: str) -> dict:
    return {"admit": len(text) >= 200}


def _labelled(slop: Callable[[str], bool]):
    return lambda text: {"label": "slop" if slop(text) else "legit", "confidence": 0.9}


DETECTOR, JUDGE = S.detector("variety", flaky(_detected), wait=0), S.judge("length", flaky(_admitted, 1), wait=0)
RATERS = (
    S.rater("length", flaky(_labelled(lambda t: len(t) < 200), 2), wait=0),
    S.rater("lines", flaky(_labelled(lambda t: 60 * t.count("\n") > len(t)), 3), wait=0),
    S.rater("variety", flaky(_labelled(lambda t: _variety(t) < 0.5), 4), wait=0),
)

SHOWN = r"""
shown AS (SELECT doc_id AS pos, substr(coalesce(text, ''), 1, 2000) AS t FROM documents),
words AS (SELECT *, regexp_extract_all(lower(t), '[a-z0-9]+') AS w FROM shown),
seen AS (SELECT *, length(t) AS n, CASE WHEN len(w) = 0 THEN 1.0 ELSE len(list_distinct(w))::DOUBLE / len(w) END AS variety FROM words)"""


def _form(shift: int) -> str:
    return f"((n + {shift}) % {FORMS})"


def _calls(shift: int) -> str:
    return f"CASE WHEN {_form(shift)} IN (0, 1) THEN 3 WHEN {_form(shift)} IN (2, 3) THEN 2 ELSE 1 END"


_REJECTED = f"CASE {_form(0)} WHEN 0 THEN FALSE WHEN 1 THEN FALSE WHEN 6 THEN FALSE ELSE variety < 0.35 OR 1 - variety >= 0.5 END"


def _documents(spark, sf):
    return spread(table(spark, sf, "documents").select(F.col("doc_id").alias("pos"), F.col("text").alias("prose")))


@query(O.sql(SHOWN, select=f"SELECT pos, {_REJECTED} AS reject, {_form(0)} IN (0, 1) AS failed, {_calls(0)} AS attempts, CASE {_form(0)} WHEN 0 THEN 'ConnectionError: no answer' WHEN 1 THEN 'unreadable reply' END AS error FROM seen"))
def scored_detector(spark, sf):
    """A detector that fails now and then: its decision on each text, whether it gave one, the calls that took, and the error."""
    out = S.decided(S.outcomes(_documents(spark, sf), DETECTOR), DETECTOR, "reject")
    return out.select("pos", "reject", "failed", "outcome.attempts", "outcome.error")


@query(O.sql(SHOWN, select=f"SELECT pos, CASE WHEN {_form(1)} IN (0, 1, 6) THEN FALSE ELSE n < 200 END AS reject, {_calls(1)} AS attempts FROM seen"))
def scored_judge(spark, sf):
    """A judge that admits what it doesn't answer for."""
    return S.decided(S.outcomes(_documents(spark, sf), JUDGE), JUDGE, "reject").select("pos", "reject", "outcome.attempts")


def _vote(shift: int, slop: str) -> str:
    return f"CASE WHEN {_form(shift)} IN (0, 1) THEN 'abstain' WHEN {_form(shift)} <> 6 AND ({slop}) THEN 'slop' ELSE 'legit' END"


@query(O.sql(SHOWN, f"""v AS (SELECT pos, {_vote(2, "n < 200")} AS a, {_vote(3, "60 * (n - length(replace(t, chr(10), ''))) > n")} AS b, {_vote(4, "variety < 0.5")} AS c FROM seen),
s AS (SELECT *, ((a = 'slop')::INT + (b = 'slop')::INT + (c = 'slop')::INT)::BIGINT AS n_slop, ((a = 'legit')::INT + (b = 'legit')::INT + (c = 'legit')::INT)::BIGINT AS n_legit FROM v)""",
  select="SELECT pos, a AS length, b AS lines, c AS variety, n_slop, n_legit, CASE WHEN n_slop > n_legit THEN 'slop' ELSE 'legit' END AS label FROM s"))
def scored_panel(spark, sf):
    """A panel of three raters, each through the result cache; one that fails abstains."""
    items, path = _documents(spark, sf), f"{shared_dir(spark)}/panel-{uuid.uuid4().hex}"
    out = S.panel(items, RATERS, lambda r: S.resumed(items, r, f"{path}/{r.name}", "first"))
    return out.select("pos", *(F.element_at("votes", r.name).alias(r.name) for r in RATERS), "n_slop", "n_legit", "label")


@query(O.sql(SHOWN, f"r AS (SELECT {_form(0)} NOT IN (0, 1) AS cached, CASE WHEN {_form(0)} IN (0, 1) THEN variety < 0.35 OR 1 - variety >= 0.5 ELSE {_REJECTED} END AS reject, CASE WHEN {_form(0)} IN (0, 1) THEN 1 ELSE {_calls(0)} END AS attempts FROM seen)",
  select="SELECT cached, count(*) AS n, count(*) FILTER (reject) AS rejected, sum(attempts)::BIGINT AS attempts FROM r GROUP BY cached"))
def scored_resume(spark, sf):
    """Two runs over one cache: the second asks only for the rows that failed in the first, of a service that answers by then."""
    items, path = _documents(spark, sf), f"{shared_dir(spark)}/detector-{uuid.uuid4().hex}"
    first = S.resumed(items, DETECTOR, path, "first")
    first.isEmpty()
    again = S.detector(DETECTOR.name, _steady(_detected), wait=0)
    out = S.decided(S.resumed(items, again, path, "first"), again, "reject")
    return out.groupBy("cached").agg(F.count("*").alias("n"), F.count_if("reject").alias("rejected"), F.sum("outcome.attempts").alias("attempts"))


# ---- word models

BIGRAM = f"""
tok AS (SELECT doc_id AS pos, doc_id % 10 <> 0 AS train, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS v, generate_subscripts(regexp_extract_all(lower(text), '[a-z0-9]+'), 1) AS i FROM documents),
uni AS (SELECT v, count(*) AS c_v FROM tok WHERE train GROUP BY v), whole AS (SELECT sum(c_v)::DOUBLE AS s, count(*)::DOUBLE AS kinds FROM uni),
pair AS (SELECT a.pos, a.train, a.v AS u, b.v AS v FROM tok a JOIN tok b ON a.pos = b.pos AND b.i = a.i + 1),
bi AS (SELECT u, v, count(*) AS c_uv FROM pair WHERE train GROUP BY ALL), ctx AS (SELECT u, sum(c_uv)::DOUBLE AS c_u, count(*)::DOUBLE AS kinds_u FROM bi GROUP BY u),
p1 AS (SELECT p.*, (coalesce(c_v, 0) + {lm.ADDED}::DOUBLE) / (s + {lm.ADDED}::DOUBLE * (kinds + 1)) AS alone FROM pair p LEFT JOIN uni ON p.v = uni.v CROSS JOIN whole),
p2 AS (SELECT p1.*, CASE WHEN c_u > 0 THEN (greatest(coalesce(c_uv, 0) - {lm.DISCOUNT}::DOUBLE, 0) + {lm.DISCOUNT}::DOUBLE * kinds_u * alone) / c_u ELSE alone END AS following
  FROM p1 LEFT JOIN ctx ON p1.u = ctx.u LEFT JOIN bi ON p1.u = bi.u AND p1.v = bi.v),
ppl AS (SELECT pos, count(*) AS n, round(exp(least(avg(-ln(alone)), 20)), 4) AS unigram, round(exp(least(avg(-ln(following)), 20)), 4) AS bigram FROM p2 GROUP BY pos)"""


def _bigram(spark, sf):
    docs = spread(table(spark, sf, "documents").select(F.col("doc_id").alias("pos"), F.coalesce("text", F.lit("")).alias("prose")))
    return lm.perplexities(docs, C.tokens(), F.col("pos") % 10 != 0)


@query(O.sql(BIGRAM, select="SELECT doc_id AS pos, doc_id % 10 <> 0 AS train, coalesce(n, 0) AS n, unigram, bigram FROM documents LEFT JOIN ppl ON pos = doc_id"))
def perplexity_bigram(spark, sf):
    """Perplexities under unigrams and interpolated bigrams, learnt from the documents whose number isn't divisible by 10."""
    return _bigram(spark, sf)


@query(O.sql(BIGRAM, select="SELECT doc_id % 10 <> 0 AS train, count(*) AS texts, sum(n)::BIGINT AS n, round(sum(n * ln(unigram)) / sum(n), 4) AS unigram_nll, round(sum(n * ln(bigram)) / sum(n), 4) AS bigram_nll FROM documents JOIN ppl ON pos = doc_id GROUP BY 1"))
def bigram_gain(spark, sf):
    """What bigrams gain over unigrams, on the texts learnt from and on held-out ones: mean negative log likelihood a word."""
    scored = stored(_bigram(spark, sf).where("n > 0"), "perplexities")
    mean = lambda c: F.round(F.sum(F.col("n") * F.log(F.col(c))) / F.sum("n"), 4).alias(f"{c}_nll")
    return scored.groupBy("train").agg(F.count("*").alias("texts"), F.sum("n").alias("n"), mean("unigram"), mean("bigram"))


# ---- embeddings


def _letters(texts: list[str]) -> list[list[float] | None]:
    """A stand-in for an embedding model: counts of two letters, and the length."""
    return [[t.count("a"), t.count("e"), len(t)] for t in texts]


def _letters_at_times(texts: list[str]) -> list[list[float] | None]:
    """The same, failing by the text's length."""
    return [None if len(t) % 7 == 0 else v for t, v in zip(texts, _letters(texts), strict=True)]


EMBEDDED = """
t AS (SELECT doc_id AS pos, text, length(text)::DOUBLE AS n, (length(text) - length(replace(text, 'a', '')))::DOUBLE AS a, (length(text) - length(replace(text, 'e', '')))::DOUBLE AS e FROM documents),
before AS (SELECT DISTINCT text AS known FROM t WHERE pos % 2 = 0 AND n % 7 <> 0)"""


def _embedded(spark, sf):
    """Two runs over one cache: the even documents with a model that fails at times, then all with one that doesn't."""
    docs = spread(table(spark, sf, "documents").select(F.col("doc_id").alias("pos"), "text"))
    path = f"{shared_dir(spark)}/embeddings-{uuid.uuid4().hex}"
    E.embedded(docs.where("pos % 2 = 0"), path, "letters", _letters_at_times)
    return E.embedded(docs, path, "letters", _letters), path


@query(O.sql(EMBEDDED, select="SELECT pos, sha256(text) AS sha, known IS NOT NULL AS cached, round(a / sqrt(a * a + e * e + n * n), 6) AS first, round(n / sqrt(a * a + e * e + n * n), 6) AS last FROM t LEFT JOIN before ON text = known"))
def embedding_runs(spark, sf):
    """Embeddings through a content-addressed cache: hits are read, failures of the first run made anew, each text once."""
    rows, _ = _embedded(spark, sf)
    return rows.select("pos", "sha", "cached", *(F.round(F.get("vector", F.lit(k)), 6).alias(c) for k, c in ((0, "first"), (2, "last"))))


@query(O.sql(EMBEDDED, select="SELECT sha256(text) AS sha, n > 0 AS embedded, 1 AS runs FROM (SELECT DISTINCT text, n FROM t WHERE text IS NOT NULL)"))
def embedding_cache_compacted(spark, sf):
    """What the cache holds once its runs are one: the latest entry of each text."""
    _, path = _embedded(spark, sf)
    E.compact(spark, path)
    return E.entries(spark, path).select("sha", F.col("vector").isNotNull().alias("embedded"), F.lit(len(E.runs(spark, path))).alias("runs"))


# ---- approximate retrieval


def _approximate(spark, sf, k):
    vec = table(spark, sf, "embeddings").select(F.col("vec_id").alias("pos"), F.col("embedding").alias("vector"), F.col("label").alias("source"))
    asked = vec.where("pos % 20 = 0").select(F.col("pos").alias("q"), "vector", F.col("source").alias("q_source"))
    return asked, vec, I.top_k(asked, I.build(vec), k)


@query()
def retrieve_topk_ivf(spark, sf):
    """The 5 most similar vectors that an inverted file finds, for every vector whose number is divisible by 20."""
    return _approximate(spark, sf, 5)[2].select("q", "pos", "sim", "rank")


@query()
def ivf_recall(spark, sf):
    """How much of the exact 5 most similar the inverted file finds."""
    asked, vec, found = _approximate(spark, sf, 5)
    return I.recall(found, V.top_k(asked, vec, 5))


# ---- a stream of scopes

REPLAY = """
sc AS (SELECT pos, klass, TIMESTAMP '2024-01-01' + to_minutes(pos::BIGINT) + CASE WHEN klass IN ('C2', 'C4') OR pos % 50 = 7 THEN INTERVAL 0 MINUTE ELSE to_minutes((pos % 5) * 10) END AS ts FROM items),
st AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, d.arm, d.reject OR sc.pos % 50 = 7 AS reject FROM decisions d JOIN sc ON d.pos = sc.pos WHERE d.arm LIKE 'T%')"""


def _file_events(spark, sf):
    """The corpus's scopes as files that arrive: a minute apart, the README of some up to 40 minutes later or never."""
    rows = C.scopes(spark, sf).select("pos", "files", "canon", "vocab", "claims", F.expr("timestamp '2024-01-01 00:00:00' + make_dt_interval(0, 0, pos, 0)").alias("t"))
    content = F.when(F.col("name") == "CANON.md", F.col("canon")).when(F.col("name") == "VOCAB.md", F.col("vocab")).when(F.col("name") == "claims.json", F.to_json("claims"))
    ts = F.expr("t + make_dt_interval(0, 0, if(name = 'README.md', int(pos % 5) * 10, 0), 0)")
    listed = rows.withColumn("name", F.explode("files")).where("not (name = 'README.md' and pos % 50 = 7)")
    return listed.select(F.col("pos").cast("string").alias("scope"), "name", content.alias("content"), ts.alias("ts"))


@query(O.sql(O.ITEMS, O.PROXIES, O.DECISIONS, REPLAY, select="SELECT window_start, arm, count(*) AS n, count(*) FILTER (reject) AS rejected, round(count(*) FILTER (reject)::DOUBLE / count(*), 3) AS reject_rate FROM st GROUP BY window_start, arm"))
def streaming_validator(spark, sf):
    """Reject rates of the validator's arms by window, of a replay of the corpus's scopes file by file, with a restart between its parts."""
    home = f"{shared_dir(spark)}/scopes-{uuid.uuid4().hex}"
    events, ledger = stored(_file_events(spark, sf), "events"), stored(C.ledger(spark, sf), "ledger")
    ends = events.agg(F.min("ts").alias("a"), F.max("ts").alias("z")).first()
    if ends["a"] is not None:
        part = (ends["z"] - ends["a"]) / REPLAYED
        for k in range(REPLAYED):
            own = events.where(F.col("ts") >= F.lit(ends["a"] + k * part)) if k else events
            own = own.where(F.col("ts") < F.lit(ends["a"] + (k + 1) * part)) if k < REPLAYED - 1 else own
            own.write.mode("append").parquet(f"{home}/in")
            W.run(spark, f"{home}/in", ledger, home, LATE)
    beat = spark.createDataFrame([("", "", None, (ends["z"] or datetime.datetime(2024, 1, 1)) + datetime.timedelta(days=9))], W.EVENTS)
    beat.write.mode("append").parquet(f"{home}/in")  # time goes on, and what hasn't come is let go
    W.run(spark, f"{home}/in", ledger, home, LATE)
    return W.rates(spark, home)


#: Parts that the replay comes in, and how long a scope's files may be apart.
REPLAYED, LATE = 2, "2 hours"
