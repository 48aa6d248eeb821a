"""Queries of scores, thresholds, retrieval, resampling, incremental and streaming runs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.functions import metrics as M
from sluice.operators import cache as K
from sluice.operators import corpus as C
from sluice.operators import lm
from sluice.operators import resample as R
from sluice.operators import retrieval as V
from sluice.operators import thresholds as TH
from sluice.plans import oracle as O
from sluice.sources import shared_dir, stored, table
from sluice.streaming.monitor import reject_rates

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
BASE = (O.ITEMS, O.PROXIES, O.DECISIONS)


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


PPL = r"""
tok AS (SELECT doc_id AS pos, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t, generate_subscripts(regexp_extract_all(lower(text), '[a-z0-9]+'), 1) AS i FROM documents),
freq AS (SELECT t, count(*) AS c FROM tok GROUP BY t), total AS (SELECT sum(c)::DOUBLE AS s FROM freq),
ppl AS (SELECT pos, round(exp(least(avg(-ln(c / s)), 20)), 4) AS score FROM tok JOIN freq USING (t) CROSS JOIN total WHERE i > 1 GROUP BY pos),
scored AS (SELECT i.pos, i.gt_slop, i.labelled, p.score FROM items i LEFT JOIN ppl p USING (pos))"""


def perplexity(spark, sf):
    """items with score: perplexity under a unigram model of all texts; the first token isn't scored; null for fewer than two.

    Scores are made once, into the shared folder, and counted words before them. Texts' words aren't
    shuffled but for rare ones: frequent ones are priced and summed where their text is read.
    """
    items = C.items(spark, sf)
    tokens = stored(items.select("pos", C.tokens().alias("t")), "tokens")
    freq = stored(tokens.select(F.explode("t").alias("t")).groupBy("t").agg(F.count("*").alias("c")), "words")
    total = freq.agg(F.sum("c").cast("double").alias("s"))
    priced = freq.join(F.broadcast(total)).select("t", "c", (-F.log(F.col("c") / F.col("s"))).alias("cost"))  # one row
    own = tokens.select("pos", F.explode(F.slice("t", F.lit(2), F.greatest(F.size("t"), F.lit(1)))).alias("t"))
    ppl = lm.look_up(own, priced, ["t"], "c").groupBy("pos").agg(F.round(F.exp(F.least(F.avg("cost"), F.lit(lm.MOST))), 4).alias("score"))
    return stored(items.select("pos", "gt_slop", "labelled").join(ppl, "pos", "left"), "scores")


@query(O.sql(O.ITEMS, PPL, select="SELECT pos, score AS perplexity FROM scored"))
def perplexity_unigram(spark, sf):
    return perplexity(spark, sf).select("pos", F.col("score").alias("perplexity"))


def _threshold_sql(scored: str) -> str:
    return f"""
cand AS (SELECT score, min(pos) AS first FROM {scored} WHERE score IS NOT NULL GROUP BY score),
cells AS (SELECT c.score AS raw, c.first, count(*) FILTER (s.score <= c.score AND gt_slop) AS tp, count(*) FILTER (s.score <= c.score AND NOT gt_slop) AS fp,
  count(*) FILTER (s.score > c.score AND gt_slop) AS fn, count(*) FILTER (s.score > c.score AND NOT gt_slop) AS tn FROM cand c CROSS JOIN {scored} s WHERE s.score IS NOT NULL GROUP BY c.score, c.first),
best AS (SELECT round(raw, 3) AS threshold, round({O.F1}, 3) AS f1, tp, fp, fn, tn FROM cells ORDER BY f1 DESC, first LIMIT 1)"""


CORE_PPL = (O.ITEMS, PPL, "core AS (SELECT * FROM scored WHERE labelled)")


@query(O.sql(*CORE_PPL, _threshold_sql("core"), select="SELECT * FROM best"))
def best_threshold(spark, sf):
    return TH.best_threshold(perplexity(spark, sf).where("labelled"))


@query(O.sql(*CORE_PPL, _threshold_sql("core"), f"d AS (SELECT gt_slop, coalesce(score <= threshold, FALSE) AS reject FROM core CROSS JOIN best), c AS (SELECT {O.CELLS} FROM d)", select=f"SELECT tp, fp, fn, tn, n, round({O.F1}, 3) AS f1, round({O.PHI}, 3) AS phi FROM c"))
def threshold_arm(spark, sf):
    """The perplexity arm under its rounded threshold."""
    core = perplexity(spark, sf).where("labelled")
    cells = TH.apply_threshold(core, TH.best_threshold(core)).agg(*M.confusion())
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return cells.select("tp", "fp", "fn", "tn", "n", F.round(M.f1(tp, fp, fn), 3).alias("f1"), F.round(M.phi(tp, fp, fn, tn), 3).alias("phi"))


@query(O.sql(*CORE_PPL, """p AS (SELECT count(*) AS pairs, sum(CASE WHEN a.score < b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END)::DOUBLE AS won FROM core a JOIN core b ON a.gt_slop AND NOT b.gt_slop AND a.score IS NOT NULL AND b.score IS NOT NULL)""",
  select="SELECT (SELECT count(*) FROM core WHERE gt_slop AND score IS NOT NULL) AS positives, (SELECT count(*) FROM core WHERE NOT gt_slop AND score IS NOT NULL) AS negatives, round(won / nullif(pairs, 0), 3) AS auc FROM p"))
def roc_auc(spark, sf):
    return TH.roc_auc(perplexity(spark, sf).where("labelled"))


SIMS = """
vec AS (SELECT vec_id AS pos, label AS source, embedding::DOUBLE[] AS vector FROM embeddings),
sims AS (SELECT a.pos AS q, b.pos, a.source AS qs, b.source AS ps, round(list_inner_product(a.vector, b.vector), 6) AS sim FROM vec a JOIN vec b ON a.pos % 20 = 0 AND b.pos <> a.pos),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, pos) AS rank FROM sims),
grounding AS (SELECT q, round(max(sim), 4) AS max, round(sum(sim) / 5, 4) AS mean_top5 FROM ranked WHERE rank <= 5 GROUP BY q)"""


def _top(spark, sf, k, leave_out=False):
    """Vectors whose number is divisible by 20 ask all others; a vector's label is its source."""
    vec = table(spark, sf, "embeddings")
    asked = vec.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("vector"), F.col("label").alias("q_source"))
    return V.top_k(asked, vec.select(F.col("vec_id").alias("pos"), F.col("embedding").alias("vector"), F.col("label").alias("source")), k, leave_out)


@query(O.sql(SIMS, select="SELECT q, max, mean_top5 FROM grounding"))
def grounding_score(spark, sf):
    return V.grounding(_top(spark, sf, 5))


@query(O.sql(SIMS, select="SELECT source AS label, count(*) AS n, round(avg(max), 6) AS mean_max FROM grounding JOIN vec ON q = pos GROUP BY source"))
def similarity_by_class(spark, sf):
    return V.grounding(_top(spark, sf, 5)).join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("q"), "label"), "q").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("max"), 6).alias("mean_max"))


@query(O.sql(SIMS, select="SELECT q, pos, sim, rank FROM ranked WHERE rank <= 3"))
def retrieve_topk(spark, sf):
    return _top(spark, sf, 3)


@query(O.sql(SIMS, "loo AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, pos) AS r FROM sims WHERE qs <> ps)", select="SELECT q, pos, sim, r AS rank FROM loo WHERE r <= 4"))
def retrieve_topk_loo(spark, sf):
    """Top 4 without the query's own source."""
    return _top(spark, sf, 4, leave_out=True)


CONTEXT = """ctx AS (SELECT q, string_agg('[' || rank || '] ' || coalesce(substr(d.text, 1, {n}), ''), chr(10) || '---' || chr(10) ORDER BY rank) AS context FROM ranked r LEFT JOIN documents d ON r.pos = d.doc_id WHERE rank <= 3 GROUP BY q)"""


def _context(spark, sf, length):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("pos"), "text")
    return V.context(_top(spark, sf, 3), docs, length)


@query(O.sql(SIMS, CONTEXT.format(n=600), select="SELECT q, length(context) AS chars, sha256(context) AS context_sha FROM ctx"))
def retrieval_context(spark, sf):
    return _context(spark, sf, 600).select("q", F.length("context").cast("long").alias("chars"), F.sha2("context", 256).alias("context_sha"))


ENTAILED = (SIMS, CONTEXT.format(n=700), r"""c AS (SELECT q, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower(context), '[a-z0-9]+')) AS b FROM ctx JOIN documents ON q = doc_id),
s AS (SELECT q, CASE WHEN len(a) = 0 THEN 0.0 ELSE len(list_intersect(a, b))::DOUBLE / len(a) END AS cover FROM c)""")


@query(O.sql(*ENTAILED, select="SELECT q, round(cover, 6) AS coverage, cover >= 0.5 AS supported FROM s"))
def entail_proxy(spark, sf):
    """Retrieve, then ask whether the context covers half of the claim's tokens: a stand-in for an entailment judge."""
    claims = table(spark, sf, "documents").select(F.col("doc_id").alias("q"), "text")
    out = _context(spark, sf, 700).join(claims, "q").withColumn("c", V.coverage(F.col("text"), F.col("context")))
    return out.select("q", F.round("c", 6).alias("coverage"), (F.col("c") >= 0.5).alias("supported"))


#: Fixed value: a legit passage of more characters takes part in the tournament.
PASSAGE = 240
TOURNAMENT = (O.ITEMS, O.PROXIES, *ENTAILED, f"""
tour AS (SELECT i.pos, i.gt_slop, i.klass NOT IN ('C1', 'C3') AS t, p.b2, coalesce(s.cover < 0.5, FALSE) AS b3e
  FROM items i JOIN proxies p USING (pos) LEFT JOIN s ON s.q = i.pos WHERE i.labelled AND (i.gt_slop OR length(i.prose) > {PASSAGE}))""")


def _tournament(spark, sf):
    """Core slop, and legit passages that are long enough, with T, B2 and B3e; an item without an entailment result is admitted."""
    core = C.wide_decisions(spark, sf).where(F.col("labelled") & (F.col("gt_slop") | (F.col("chars") > PASSAGE)))
    judged = entail_proxy(spark, sf).select(F.col("q").alias("pos"), (~F.col("supported")).alias("b3e"))
    return core.join(judged, "pos", "left").select("pos", "gt_slop", F.col("T").alias("t"), F.col("B2").alias("b2"), F.coalesce("b3e", F.lit(False)).alias("b3e"))


_tlo, _thi = O.wilson("k", "n")


@query(O.sql(*TOURNAMENT, "m AS (SELECT count(*) FILTER (gt_slop AND NOT t AND NOT b3e AND NOT b2) AS k, count(*) FILTER (gt_slop) AS n FROM tour)",
             select=f"SELECT k, n, round(k::DOUBLE / greatest(1, n), 3) AS leak_rate, {_tlo} AS lo, {_thi} AS hi FROM m"))
def tournament_leak(spark, sf):
    """Slop that the validator, the entailment judge and the quality judge all admit."""
    out = _tournament(spark, sf).agg(F.count_if(F.expr("gt_slop AND NOT t AND NOT b3e AND NOT b2")).alias("k"), F.count_if("gt_slop").alias("n"))
    lo, hi = M.wilson(F.col("k"), F.col("n"))
    return out.select("k", "n", F.round(F.col("k") / F.greatest(F.lit(1), "n"), 3).alias("leak_rate"), lo.alias("lo"), hi.alias("hi"))


@query(O.sql(*TOURNAMENT, f"""r AS (SELECT 'T-structure' AS arm, gt_slop, t AS reject FROM tour UNION ALL SELECT 'B3e-entailment', gt_slop, b3e FROM tour UNION ALL SELECT 'B2-semantic', gt_slop, b2 FROM tour),
cells AS (SELECT arm, {O.CELLS} FROM r GROUP BY arm)""",
             select=f"SELECT arm, tp, fp, fn, tn, n, round({O.PHI}, 3) AS phi, round(tp::DOUBLE / greatest(1, tp + fn), 3) AS slop_catch_rate, round(fp::DOUBLE / greatest(1, fp + tn), 3) AS legit_false_reject FROM cells"))
def tournament_association(spark, sf):
    """How each arm's verdicts go with the ground truth in the tournament; all arms in one pass."""
    arms = F.array(*(F.struct(F.lit(name).alias("arm"), F.col(c).alias("reject")) for name, c in (("T-structure", "t"), ("B3e-entailment", "b3e"), ("B2-semantic", "b2"))))
    cells = _tournament(spark, sf).select("gt_slop", F.inline(arms)).groupBy("arm").agg(*M.confusion())
    share = lambda k, other: F.round(F.col(k) / F.greatest(F.lit(1), F.col(k) + F.col(other)), 3)
    return cells.select("arm", "tp", "fp", "fn", "tn", "n", F.round(M.phi(*(F.col(c) for c in ("tp", "fp", "fn", "tn"))), 3).alias("phi"), share("tp", "fn").alias("slop_catch_rate"), share("fp", "tn").alias("legit_false_reject"))


def _b3_sql(score: str) -> str:
    return O.sql(O.ITEMS, SIMS, f"g AS (SELECT i.pos, i.gt_slop, {score} AS score FROM items i JOIN grounding ON i.pos = q WHERE i.labelled)", _threshold_sql("g"),
                 f"d AS (SELECT gt_slop, score <= threshold AS reject FROM g CROSS JOIN best), c AS (SELECT {O.CELLS} FROM d)", select=f"SELECT tp, fp, fn, tn, n, round({O.PHI}, 3) AS phi FROM c")


def _b3(spark, sf, sign):
    scored = C.items(spark, sf).where("labelled").select("pos", "gt_slop").join(V.grounding(_top(spark, sf, 5)).select(F.col("q").alias("pos"), (sign * F.col("max")).alias("score")), "pos")
    cells = TH.apply_threshold(scored, TH.best_threshold(scored)).agg(*M.confusion())
    return cells.select("tp", "fp", "fn", "tn", "n", F.round(M.phi(*(F.col(c) for c in ("tp", "fp", "fn", "tn"))), 3).alias("phi"))


@query(_b3_sql("max"))
def b3_arm(spark, sf):
    """The similarity arm as documented: low similarity is rejected."""
    return _b3(spark, sf, F.lit(1.0))


@query(_b3_sql("-max"))
def b3_arm_ascoded(spark, sf):
    """The similarity arm with the sign that its published numbers have: high similarity is rejected."""
    return _b3(spark, sf, F.lit(-1.0))


@query(O.sql(O.ITEMS, SIMS, select="SELECT i.klass, count(*) AS n, count(max) AS grounded, round(avg(max), 6) AS mean_max FROM items i LEFT JOIN grounding ON pos = q GROUP BY klass"))
def join_grounding_left(spark, sf):
    g = V.grounding(_top(spark, sf, 5)).select(F.col("q").alias("pos"), "max")
    return C.items(spark, sf).join(g, "pos", "left").groupBy("klass").agg(F.count("*").alias("n"), F.count("max").alias("grounded"), F.round(F.avg("max"), 6).alias("mean_max"))


@query("""WITH j AS (SELECT conv_id, substr(string_agg(text, ' ' ORDER BY turn), 1, 2400) AS t FROM conversations GROUP BY conv_id) SELECT conv_id, length(t) AS chars, sha256(t) AS text_sha FROM j""")
def doc_concat(spark, sf):
    """Passages of a document joined in order and cut to 2400 characters."""
    listed = F.array_sort(F.collect_list(F.struct("turn", "text")))
    joined = table(spark, sf, "conversations").groupBy("conv_id").agg(F.substring(F.array_join(F.transform(listed, lambda x: x["text"]), " "), 1, 2400).alias("t"))
    return joined.select("conv_id", F.length("t").cast("long").alias("chars"), F.sha2("t", 256).alias("text_sha"))


@query("SELECT doc_id AS pos, length(substr(text, 1, 2000)) AS chars, sha256(substr(text, 1, 2000)) AS text_sha FROM documents")
def prose_prefix(spark, sf):
    """What a model arm would be shown: the first 2000 characters."""
    cut = F.substring("text", 1, 2000)
    return table(spark, sf, "documents").select(F.col("doc_id").alias("pos"), F.length(cut).cast("long").alias("chars"), F.sha2(cut, 256).alias("text_sha"))


@query(r"""WITH p AS (SELECT doc_id AS pos, regexp_replace(substr(text, 1, 1200), '^\s+|\s+$', '', 'g') AS t FROM documents), s AS (SELECT pos, sha256(t) AS sha, length(t) AS chars FROM p WHERE length(t) >= 120)
SELECT min(pos) AS pos, sha, min(chars) AS chars, count(*) AS copies FROM s GROUP BY sha""")
def passage_dedup(spark, sf):
    """Passages for the index: cut, stripped, long enough, the first of each text."""
    t = F.regexp_replace(F.substring("text", 1, 1200), r"^\s+|\s+$", "")
    p = table(spark, sf, "documents").select(F.col("doc_id").alias("pos"), t.alias("t")).where(F.length("t") >= 120).select("pos", F.sha2("t", 256).alias("sha"), F.length("t").cast("long").alias("chars"))
    return p.groupBy("sha").agg(F.min("pos").alias("pos"), F.min("chars").alias("chars"), F.count("*").alias("copies")).select("pos", "sha", "chars", "copies")


@query("""WITH k AS (SELECT conv_id, turn, sha256('11:' || conv_id || ':' || turn) AS key FROM conversations), f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY key) AS r FROM k)
SELECT conv_id, turn, key FROM f WHERE r = 1 ORDER BY key LIMIT 60""")
def sample_one_per_doc(spark, sf):
    """A seeded order, one passage a document, the first 60: a sampling operator."""
    key = F.sha2(F.concat_ws(":", F.lit("11"), F.col("conv_id").cast("string"), F.col("turn").cast("string")), 256)
    keyed = table(spark, sf, "conversations").select("conv_id", "turn", key.alias("key"))
    return keyed.withColumn("r", F.row_number().over(Window.partitionBy("conv_id").orderBy("key"))).where("r = 1").orderBy("key").limit(60).drop("r")


@query("""WITH cache AS (SELECT DISTINCT sha256(text) AS sha FROM documents WHERE doc_id % 2 = 0) SELECT d.doc_id AS pos, sha256(d.text) AS sha, c.sha IS NOT NULL AS hit FROM documents d LEFT JOIN cache c ON sha256(d.text) = c.sha""")
def embedding_cache_lookup(spark, sf):
    """Texts found in a cache by content hash; the even documents' texts are cached."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("pos"), F.sha2("text", 256).alias("sha"))
    cache = docs.where("pos % 2 = 0").select("sha").distinct().withColumn("hit", F.lit(True))
    return docs.join(cache, "sha", "left").select("pos", "sha", F.coalesce("hit", F.lit(False)).alias("hit"))


@query("SELECT b.item_id, d.doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def leakage_check(spark, sf):
    """Benchmark passages that stand in documents: a stated set of passages against all texts."""
    return V.contained(table(spark, sf, "documents"), table(spark, sf, "benchmark")).select("item_id", "doc_id")


@query(O.sql(O.ITEMS, O.PROXIES, "cache AS (SELECT pos, CASE WHEN pos % 7 = 0 THEN 'old' ELSE 'panel=a|judge=b' END AS sig, b2 AS v FROM proxies WHERE pos % 3 <> 0)", """hit AS (SELECT p.pos, p.b2, c.pos IS NOT NULL AS cached FROM proxies p LEFT JOIN cache c ON p.pos = c.pos AND c.sig = 'panel=a|judge=b')""",
  select="SELECT cached, count(*) AS n, count(*) FILTER (b2) AS rejected FROM hit GROUP BY cached"))
def cache_incremental(spark, sf):
    """Resume from a cache keyed by item and model signature: hits are read, and only misses are scored and kept.

    Two earlier runs fill the cache: one under an older signature, one under this one.
    """
    sig, old = K.signature({"panel": "a", "judge": "b"}), K.signature({"panel": "a", "judge": "older"})
    items, path = C.items(spark, sf).select("pos", "prose"), f"{shared_dir(spark)}/cache-{uuid.uuid4().hex}"
    score = lambda rows: rows.select("pos", C.quality_proxy().alias("value"))
    for part, by in ((F.col("pos") % 7 == 0, old), (F.col("pos") % 7 != 0, sig)):
        K.resume(items.where((F.col("pos") % 3 != 0) & part), path, by, score, "boolean")
    both = K.resume(items, path, sig, score, "boolean")
    return both.groupBy("cached").agg(F.count("*").alias("n"), F.count_if("value").alias("rejected"))


@query(f"""WITH RECURSIVE n AS (SELECT count(*) AS n FROM documents), l(g, state) AS (SELECT 1, ({R.A}::BIGINT * {R.SEED} + {R.C}) % {R.MODULUS} UNION ALL SELECT g + 1, ({R.A}::BIGINT * state + {R.C}) % {R.MODULUS} FROM l, n WHERE g < n) SELECT g::BIGINT AS g, state, state % n AS draw FROM l, n""")
def lcg_stream(spark, sf):
    """The published generator's states, one for each document, and the document that each draws: found in parallel."""
    size = table(spark, sf, "documents").agg(F.count("*").alias("n"))
    return R.lcg_states(spark, F.col("n"), size).join(F.broadcast(size)).select("g", "state", (F.col("state") % F.col("n")).alias("draw"))  # one row


ARMS = C.ARMS
BLOCKS = """
firsts AS (SELECT topic, min(pos) AS f FROM items WHERE labelled GROUP BY topic), numbered AS (SELECT topic, row_number() OVER (ORDER BY f) - 1 AS block FROM firsts)"""


def _lcg_sql(block_cte: str, stat: str) -> str:
    """The percentile interval by naive draws: all iterations walk in step from starts a whole iteration apart."""
    step = f"({R.A}::BIGINT * state + {R.C}) % {R.MODULUS}"
    return "WITH RECURSIVE " + ",".join((O.ITEMS, O.PROXIES, O.DECISIONS, block_cte)) + f""",
m AS (SELECT count(DISTINCT block)::BIGINT AS m FROM blocks),
j(k, a, c) AS (SELECT 0::BIGINT, 1::BIGINT, 0::BIGINT UNION ALL SELECT k + 1, a * {R.A} % {R.MODULUS}, (c * {R.A} + {R.C}) % {R.MODULUS} FROM j, m WHERE k < m),
jump AS (SELECT a, c FROM j, m WHERE k = m),
s(iter, state) AS (SELECT 0::BIGINT, {R.SEED}::BIGINT UNION ALL SELECT iter + 1, (a * state + c) % {R.MODULUS} FROM s, jump WHERE iter < 1999),
d(iter, k, state) AS (SELECT iter, 1::BIGINT, {step} FROM s UNION ALL SELECT iter, k + 1, {step} FROM d, m WHERE k < m),
t AS (SELECT iter, state % m AS block, count(*) AS times FROM d, m GROUP BY ALL),
x AS (SELECT arm, iter, sum(times * tp)::BIGINT AS tp, sum(times * fp)::BIGINT AS fp, sum(times * fn)::BIGINT AS fn, sum(times * tn)::BIGINT AS tn FROM t JOIN blocks USING (block) GROUP BY ALL),
v AS (SELECT arm, list_sort(list(round({stat}, 3))) AS v FROM x GROUP BY arm)
SELECT arm, v[51] AS lo, v[1951] AS hi FROM v"""


ITEM_BLOCKS = f"""rows_ AS (SELECT pos, row_number() OVER (ORDER BY pos) - 1 AS block FROM items WHERE labelled),
blocks AS (SELECT arm, block, (reject AND gt_slop)::INT AS tp, (reject AND NOT gt_slop)::INT AS fp, (NOT reject AND gt_slop)::INT AS fn, (NOT reject AND NOT gt_slop)::INT AS tn FROM decisions JOIN rows_ USING (pos))"""
TOPIC_BLOCKS = BLOCKS.lstrip() + f""",
blocks AS (SELECT arm, block, {O.CELLS} FROM decisions JOIN numbered USING (topic) WHERE labelled GROUP BY arm, block)"""


def _core(spark, sf, arms=ARMS):
    """The labelled items' decisions, made once."""
    return stored(C.wide_decisions(spark, sf).where("labelled").select("pos", "topic", "gt_slop", *(f"`{a}`" for a in arms)), "decisions")


def _item_blocks(spark, sf):
    numbered = TH.numbered(_core(spark, sf).drop("topic"), "pos", "block")
    return C.by_arm(numbered).groupBy("arm", "block").agg(*M.confusion())


def _topic_blocks(spark, sf, arms=ARMS):
    """Topics are numbered in the order of their first item."""
    core = _core(spark, sf, arms)
    numbered = TH.numbered(core.groupBy("topic").agg(F.min("pos").alias("first")), "first", "block").select("topic", "block")
    return C.by_arm(core, arms).join(numbered, "topic").groupBy("arm", "block").agg(*M.confusion())


@query(_lcg_sql(ITEM_BLOCKS, O.F1))
def bootstrap_f1_ci(spark, sf):
    return R.bootstrap(spark, _item_blocks(spark, sf), R.f1_statistic)


@query(_lcg_sql(ITEM_BLOCKS, O.PHI))
def item_bootstrap_phi_ci(spark, sf):
    return R.bootstrap(spark, _item_blocks(spark, sf), M.phi)


@query(_lcg_sql(TOPIC_BLOCKS, O.PHI))
def cluster_bootstrap_phi_ci(spark, sf):
    return R.bootstrap(spark, _topic_blocks(spark, sf), M.phi)


_KINDS_SQL = """
n AS (SELECT count(DISTINCT block)::BIGINT AS n FROM blocks),
vec AS (SELECT block, string_agg(arm || ':' || tp || ',' || fp || ',' || fn || ',' || tn, ';' ORDER BY arm) AS v FROM blocks GROUP BY block),
kinds AS (SELECT v, count(*) AS w, row_number() OVER (ORDER BY v) AS j, any_value(block) AS some FROM vec GROUP BY v),
share AS (SELECT j, w::DOUBLE / sum(w) OVER (ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p FROM kinds),
mass AS (SELECT j, m.range AS m, x.range AS x, exp(lgamma(m.range + 1) - lgamma(x.range + 1) - lgamma(m.range - x.range + 1) + x.range * ln(p) + (m.range - x.range) * ln(1 - p)) AS mass
  FROM share, range(0, (SELECT n + 1 FROM n)) m, range(0, (SELECT n + 1 FROM n)) x WHERE x.range <= m.range AND p < 1),
steps AS (SELECT j, m, x, sum(mass) OVER w AS hi, coalesce(lead(x) OVER w, -1) AS more FROM mass WINDOW w AS (PARTITION BY j, m ORDER BY x)),
dist AS (SELECT j, m, x, CASE WHEN x = 0 THEN -1.0 ELSE lag(hi) OVER (PARTITION BY j, m ORDER BY x) END AS lo, CASE WHEN more < 0 THEN 2.0 ELSE hi END AS hi FROM steps
  UNION ALL SELECT j, m.range, m.range, -1.0, 2.0 FROM share, range(0, (SELECT n + 1 FROM n)) m WHERE p >= 1),
u AS (SELECT i.range AS iter, j, (('0x' || substr(sha256('{seed}:' || i.range || ':' || j), 1, 12))::BIGINT + 0.5) / 281474976710656.0 AS u FROM kinds, range(0, 2000) i),
s(iter, j, rest, times) AS (SELECT range, 0::BIGINT, n, 0::BIGINT FROM range(0, 2000), n
  UNION ALL SELECT s.iter, s.j + 1, s.rest - d.x, d.x FROM s JOIN u ON u.iter = s.iter AND u.j = s.j + 1 JOIN dist d ON d.j = s.j + 1 AND d.m = s.rest AND d.lo < u.u AND u.u <= d.hi),
x AS (SELECT b.arm, s.iter, sum(times * tp)::BIGINT AS tp, sum(times * fp)::BIGINT AS fp, sum(times * fn)::BIGINT AS fn, sum(times * tn)::BIGINT AS tn FROM s JOIN kinds k USING (j) JOIN blocks b ON b.block = k.some GROUP BY ALL),
v AS (SELECT arm, list_sort(list(round({stat}, 3))) AS v FROM x GROUP BY arm)
SELECT arm, v[51] AS lo, v[1951] AS hi FROM v"""


def _by_kinds(stat: str) -> str:
    return "WITH RECURSIVE " + ",".join((O.ITEMS, O.PROXIES, O.DECISIONS, ITEM_BLOCKS, _KINDS_SQL.format(stat=stat, seed=R.SEED)))


@query(_by_kinds(O.F1))
def bootstrap_f1_ci_kinds(spark, sf):
    """bootstrap_f1_ci with draws made for kinds of items instead of items: not the published stream, and as dear for any number of items."""
    return R.bootstrap_kinds(_item_blocks(spark, sf), R.f1_statistic)


@query(_by_kinds(O.PHI))
def bootstrap_phi_ci_kinds(spark, sf):
    return R.bootstrap_kinds(_item_blocks(spark, sf), M.phi)


def _pairs(blocks):
    cells = ("tp", "fp", "fn", "tn")
    return blocks.groupBy("block").agg(*(F.sum(F.when(F.col("arm") == arm, F.col(c)).otherwise(0)).alias(f"{x}_{c}") for x, arm in (("a", "T"), ("b", "B2")) for c in cells))


_SIDE = lambda x, y: ", ".join(f"sum(CASE WHEN swap THEN {y}_{c} ELSE {x}_{c} END)::BIGINT AS {x}_{c}" for c in ("tp", "fp", "fn", "tn"))


def _phi_of(x: str) -> str:
    import re

    return re.sub(r"\b(tp|fp|fn|tn)\b", rf"{x}_\1", O.PHI)


@query("WITH " + ",".join((O.ITEMS, O.PROXIES, O.DECISIONS, TOPIC_BLOCKS)) + f""",
pairs AS (SELECT block, {', '.join(f"sum({c}) FILTER (arm = '{arm}') AS {x}_{c}" for x, arm in (('a', 'T'), ('b', 'B2')) for c in ('tp', 'fp', 'fn', 'tn'))} FROM blocks GROUP BY block),
sp AS (SELECT p.*, i.range AS iter, i.range > 0 AND substr(sha256('{R.PERMUTATION_SEED}:' || i.range || ':' || block), 1, 1) < '8' AS swap FROM pairs p CROSS JOIN range({R.PERMUTATIONS + 1}) i),
su AS (SELECT iter, {_SIDE('a', 'b')}, {_SIDE('b', 'a')} FROM sp GROUP BY iter),
df AS (SELECT iter, round(round({_phi_of('b')}, 3) - round({_phi_of('a')}, 3), 3) AS d FROM su),
ob AS (SELECT d AS stat FROM df WHERE iter = 0)
SELECT stat, count(*) AS iters, round((count(*) FILTER (abs(d) >= abs(stat)) + 1)::DOUBLE / (count(*) + 1), 6) AS p FROM df CROSS JOIN ob WHERE iter > 0 GROUP BY stat""")
def phi_diff_perm_hash(spark, sf):
    """T and B2 swapped in whole topics by hashed coins: parallel, and not the published stream."""
    return R.permute_arms(_pairs(_topic_blocks(spark, sf, ("T", "B2"))), R.PERMUTATIONS, R.PERMUTATION_SEED)


@query()
def phi_diff_perm_mt(spark, sf):
    """The same with the published Mersenne stream: item swaps first, then topics on the same stream, whose parts are drawn in parallel."""
    core = _core(spark, sf, ("T", "B2"))
    return R.swap_tests(core.select("pos", "topic", "gt_slop", F.col("T").alias("a"), F.col("B2").alias("b")))


@query(O.sql(*BASE, f"c AS (SELECT arm, {O.CELLS} FROM decisions WHERE labelled GROUP BY arm)", "x AS (SELECT arm, n, tp, tp + fn AS p, tp + fp AS r, unnest(range(tp, least(tp + fn, tp + fp) + 1)) AS x FROM c)",
  select="""SELECT arm, n, tp, round(least(sum(CASE WHEN n - p - r + x < 0 THEN 0.0 ELSE exp(lgamma(p + 1) - lgamma(x + 1) - lgamma(p - x + 1) + lgamma(n - p + 1) - lgamma(r - x + 1) - lgamma(n - p - r + x + 1) - lgamma(n + 1) + lgamma(r + 1) + lgamma(n - r + 1)) END), 1.0), 6) AS p FROM x GROUP BY arm, n, tp"""))
def f1_perm_exact(spark, sf):
    return R.exact_f1_tail(C.decisions(spark, sf, core=True).groupBy("arm").agg(*M.confusion()))


_F1_OF = lambda x: f"round(coalesce(2.0 * {x} / nullif(p + r, 0), 0), 3)"


@query(O.sql(*BASE, f"c AS (SELECT arm, {O.CELLS} FROM decisions WHERE labelled GROUP BY arm)",
  "x AS (SELECT arm, n, tp, tp + fn AS p, tp + fp AS r, unnest(range(greatest(0, tp + fn + tp + fp - n), least(tp + fn, tp + fp) + 1)) AS x FROM c)",
  "m AS (SELECT *, exp(lgamma(p + 1) - lgamma(x + 1) - lgamma(p - x + 1) + lgamma(n - p + 1) - lgamma(r - x + 1) - lgamma(n - p - r + x + 1) - lgamma(n + 1) + lgamma(r + 1) + lgamma(n - r + 1)) AS mass FROM x)",
  "u AS (SELECT *, sum(mass) OVER (PARTITION BY arm ORDER BY x) AS upto FROM m)",
  f"d AS (SELECT arm, i.range AS iter, ('0x' || substr(sha256('{R.PERMUTATION_SEED}:' || arm || ':' || i.range), 1, 12))::BIGINT / 281474976710656.0 AS v FROM c CROSS JOIN range(1, {R.PERMUTATIONS + 1}) i)",
  "t AS (SELECT d.arm, d.iter, coalesce(min(u.x), max(a.top)) AS x FROM d LEFT JOIN u ON d.arm = u.arm AND u.upto > d.v JOIN (SELECT arm, max(x) AS top FROM x GROUP BY arm) a ON a.arm = d.arm GROUP BY ALL)",
  f"s AS (SELECT t.arm, {_F1_OF('c.tp')} AS f1, {_F1_OF('t.x')} AS f FROM t JOIN (SELECT arm, tp, tp + fn AS p, tp + fp AS r FROM c) c ON t.arm = c.arm)",
  select="SELECT arm, f1, round((count(*) FILTER (f >= f1) + 1)::DOUBLE / (count(*) + 1), 6) AS p, max(f) AS null_max FROM s GROUP BY arm, f1"))
def f1_perm_mc(spark, sf):
    """The sampled form of f1_perm_exact for all arms: with decisions and label totals fixed, permuted labels draw the true positives from a hypergeometric."""
    return R.sampled_f1_tail(C.decisions(spark, sf, core=True).groupBy("arm").agg(*M.confusion()))


@query("""SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, count(*) AS n, count(*) FILTER (event_type = 'error') AS rejected, round(count(*) FILTER (event_type = 'error')::DOUBLE / count(*), 3) AS reject_rate FROM events GROUP BY 1""")
def streaming_reject_rate(spark, sf):
    """Reject rates by window of a stream of admissions (an extension): the events table as a stream."""
    return reject_rates(spark, sf)
